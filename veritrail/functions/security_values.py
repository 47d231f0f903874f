"""Fixed values of prompt-injection screening: patterns and character tables, as they must be for right results."""

from __future__ import annotations

HARD, KEYWORD = "hard", "keyword"

# Parts that several patterns hold.
EXTRACT_VERB = (
    r"(?:reveal|show|print|repeat|output|display|dump|expose|disclose|recite|reproduce|echo|transcribe|share|give\s+me|tell\s+me|let\s+me\s+see|send\s+me|provide|list"
    r"|what'?s|what\s+(?:is|are|was|were)|(?:can|could|would)\s+you\s+(?:show|tell|give|print|repeat|share|reveal)|do\s+you\s+have)"
)
QUALIFIER = (
    r"(?:original|initial|full|exact|verbatim|complete|entire|whole|hidden|internal|secret|private|underlying|system|developer|admin|above|starting|configured|preceding|prior|earlier|previous|"
    r"current|runtime|raw)"
)
PROTECTED_OBJECT = (
    r"(?:prompt|prompts|instruction|instructions|directive|directives|message|messages|rule|rules|ruleset|guideline|guidelines|configuration|config|context|settings|preamble)"
)
TRANSFORM_VERB = r"(?:summari[sz]e|outline|paraphrase|rephrase|rewrite|reword|restate|condense|distil|distill|encode|decode|translate)"
REVEAL_VERB = r"(?:reveal|show|dump|expose|print|output|display|disclose|reproduce|recite|echo|transcribe|replay|share|list|paste|return|send|provide|give)"
RETRIEVED_QUALIFIER = r"(?:retrieved|retrieval|retrieval's|underlying|raw|stored|indexed|cached|gathered|collected|matched|candidate|source)"
CONTEXT_NOUN = r"(?:context|contexts|contexts?window|evidence|evidence\s+blocks?|chunks?|passages?|snippets?|excerpts?|documents?|document\s+blocks?)"
NOT_PROMPT_TECH = (
    r"(?![\s_-]+(?:engineering|engineered|design|designs|architect\w*|optimiz\w+|optimis\w+|chain|chaining|templating|template|augmentation|injection|injections|attack|attacks|"
    r"jailbreak\w*|orchestration|management|versioning|registry|logging|caching|patterns?|driven|based)\b)"
)
OWNED_OBJECT = (
    rf"(?:(?:your|its)\s+(?:(?:{QUALIFIER})\s+){{0,2}}(?:{PROTECTED_OBJECT})\b{NOT_PROMPT_TECH}"
    rf"|the\s+(?:(?:{QUALIFIER})\s+){{0,2}}(?:{PROTECTED_OBJECT})\b(?!\s+of\b){NOT_PROMPT_TECH})"
)
GUARDRAIL_RELEASE = (
    r"\b(?:no|not\s+any|zero|without\s+any)\s+(?:longer\s+|more\s+)?(?:restrictions?|filters?|limits?|limitations?|guardrails?|constraints?|safeguards?|rules?)\b"
    r"|\b(?:restrictions?|filters?|guardrails?|constraints?|safeguards?|rules?)\s+(?:do\s+not|don't|doesn't|no\s+longer)\s+(?:apply|exist|hold|bind)\b"
    r"|\bnot\s+bound\s+by\s+(?:any\s+|your\s+|the\s+)?(?:restrictions?|filters?|rules?|guidelines?|policies|guardrails?)\b"
    r"|\byou\s+(?:have|has|are|is)\s+(?:now\s+)?(?:no|not\s+any|zero)\s+(?:longer\s+)?(?:any\s+)?(?:restrictions?|filters?|limits?|limitations?|guardrails?|constraints?|safeguards?|rules?|guidelines?)\b"
    r"|\bwithout\s+(?:any\s+)?(?:restrictions?|filters?|censorship|limitations?|guardrails?|constraints?|safeguards?|guidelines?)\b"
    r"|\bexempt\s+from\s+(?:your|all|any)\s+(?:rules?|instructions?|policies|restrictions?|guidelines?|filters?)\b"
)

# What tells a question about attacks from an attack.
GENERIC_QUESTION = (
    r"\b(?:what|why|how|which|when|where|who)\s+(?:is|are|was|were|does|do|did|can|could|would|should|might)\b"
    r"|\b(?:explain|describe|define|definition\s+of|meaning\s+of|means|tell\s+me\s+about)\b|\bdifference\s+between\b|\bexamples?\s+of\b"
    r"|\bprotect(?:ing)?\s+against\b|\bdefend(?:ing)?\s+against\b|\bmitigat(?:e|ing)\b|\bwhy\s+(?:do|does|are|is)\b"
    r"|\A(?:is|are|was|were|does|do|did|can|could|should|would|will|has|have|am)\b[^\n]{0,200}\?"
)
IMPERATIVE_ATTACK = (
    r"\bdo\s+anything\s+now\b|\bwithout\s+(?:any\s+)?(?:restrictions?|filters?|censorship|limitations?|guardrails?)\b"
    r"|\byou\s+(?:are|will|must|should|can|shall)\s+now\b|\bfrom\s+now\s+on\b|\bignore\s+(?:all\s+|any\s+)?(?:previous|prior|your|your\s+own|earlier)\b"
    r"|\b(?:tell|show|reveal|print|give|send|repeat)\s+(?:me\s+)?your\b"
    r"|\b(?:enable|activate|enter|switch\s+to|go\s+into|turn\s+on)\b[^?!]{0,40}?\b(?:mode|persona|god|dan|admin|root)\b"
    r"|\banswer\s+(?:without|freely|anything|regardless)\b|\bfor\s+this\s+(?:one\s+)?(?:answer|response|question|request|turn)\b"
    r"|\bmy\s+new\s+(?:rules?|instructions?|prompt)\b"
    r"|\byou\s+(?:must|shall|will|have\s+to|need\s+to)\s+(?:now\s+)?(?:obey|follow|comply\s+with|listen\s+to|accept|respect|apply)\b"
    r"|\b(?:simulate|emulate|roleplay|role-play|pretend|behave|respond|answer)\s+(?:as|like|to\s+be|that\s+you|an?\s+)"
    r"|\b(?:simulate|emulate|roleplay|pretend)\b[^?!.]{0,30}?\bmode\b"
)
ATTACK_CONCEPT = (
    r"\bprompt[\s-]?injection(?:s)?\b|\badversarial\s+prompts?\b|\bjailbreak(?:ing|s|ed)?\b|\bllm\s+(?:security|safety|guardrails?|red[\s-]?team\w*)\b|\bsystem\s+prompt\b"
    r"|\bcontext\s+(?:poisoning|window)\s+attack\b|\bprompt[\s-]?leak\w*\b|\bguardrail\w*\b|\binput\s+sanitisation\b|\binput\s+sanitization\b"
    r"|\b(?:dan|do\s+anything\s+now|developer|sudo|god|god\s+mode|admin|root|unrestricted|unfiltered|evil|opposite)\s+mode\b|\b(?:dan|do\s+anything\s+now)\b"
)

# Rules as (id, tier, pattern), in the order in which they are reported.
RULES = (
    (
        "ignore_previous_instructions", HARD,
        r"\b(?:ignore|disregard|forget|discard|erase|wipe|override|overwrite|bypass|nullify|cancel)\s+(?:all\s+|any\s+|the\s+|your\s+|every\s+|each\s+|these\s+|those\s+)*"
        r"(?:previous|prior|preceding|above|earlier|initial|former|old|existing|original|given|earlier\s+given)\s+"
        r"(?:instruction|instructions|prompt|prompts|rule|rules|directive|directives|message|messages|command|commands|context|guideline|guidelines|constraint|constraints|configuration|config|training)\b"
        r"|\b(?:ignore|disregard|forget)\s+everything\s+(?:you\s+(?:were|have\s+been|was)\s+)?(?:told|instructed|said|above|before|previously)\b"
        r"|\bforget\s+(?:about\s+)?everything\s+(?:above|before|previously|prior)\b"
        r"|\b(?:ignore|disregard|forget|drop|skip|remove|lift|relax|loosen)\s+(?:all\s+|any\s+|the\s+|your\s+|every\s+|each\s+)*"
        r"(?:constraints?|restrictions?|limitations?|rules?|guidelines?|policies|guardrails?|safeguards?)\b",
    ),
    (
        "override_safety_instructions", HARD,
        r"\b(?:ignore|disregard|forget|override|overwrite|bypass|turn\s+off|disable|switch\s+off|drop|skip)\s+(?:all\s+|any\s+|the\s+|your\s+)*"
        r"(?:system|developer|admin|administrator|safety|security|content|moderation|guardrail|guardrails|ethical|ethics|alignment|policy|policies|restriction|restrictions|filter|filters|rules)\s*"
        r"(?:prompt|prompts|instruction|instructions|message|messages|rule|rules|guideline|guidelines|policy|policies|restriction|restrictions|filter|filters|guardrail|guardrails)\b"
        r"|\b(?:you\s+are|this\s+is)\s+(?:no\s+longer\s+)?(?:exempt|free|released)\s+from\s+(?:your|all|any)\s+(?:rules|instructions|policies|restrictions|guidelines)\b",
    ),
    (
        "instruction_supersession", HARD,
        r"\b(?:new|updated|revised|real|actual|true|correct|replacement|override|secret|hidden)\s+(?:system\s+)?"
        r"(?:instruction|instructions|prompt|prompts|rule|rules|directive|directives|order|orders)\s*[:\-]"
        r"|\b(?:the\s+)?(?:new|real|actual|true)\s+(?:instructions?|prompt|rules?)\s+(?:are|is)\b|\btherefore\s+the\s+new\s+(?:instruction|rule|directive)s?\b",
    ),
    (
        "future_obedience_override", HARD,
        r"\bfrom\s+(?:now\s+on|this\s+point\s+(?:on|forward)|here\s+on)\b[^?!.]{0,40}?"
        r"\byou\s+(?:are|will|must|should|can|shall|have\s+to|need\s+to|only|ignore|forget|respond|answer|act|behave|pretend|treat)\b"
        r"|\bin\s+(?:all\s+)?(?:future|subsequent|following)\s+(?:responses?|answers?|replies|messages)[^?!.]{0,40}?\byou\s+(?:must|will|shall|should)\b"
        r"|\byou\s+(?:must|shall|will|have\s+to|need\s+to)\s+(?:now\s+)?(?:obey|follow|comply\s+with|listen\s+to|accept|respect|apply|satisfy)\s+(?:my|these|those|the\s+following)\b"
        r"|\b(?:instead\s+of|rather\s+than)\s+(?:your|the)\s+(?:previous|prior|original|earlier|initial|system|old|former|existing)\b",
    ),
    (
        "role_override", HARD,
        r"\byou\s+are\s+now\b|\byou'?re\s+now\b|\byou\s+will\s+now\b|\byou\s+are\s+no\s+longer\b|\byour\s+new\s+(?:role|identity|persona|purpose|job|function|objective)s?\b"
        r"|\b(?:act|behave|respond|answer|roleplay|role-play|pretend|simulate|emulate)\s+(?:as|like|to\s+be|that\s+you)\b|\bpretend\s+(?:that\s+)?(?:to\s+be|you\s+are|you\s+were|that)\b"
        r"|\b(?:assume|adopt|enter|switch\s+to)\s+(?:a\s+|the\s+|your\s+)?(?:new\s+)?(?:persona|role|identity|character|mode)\b|\bnew\s+(?:persona|system\s+prompt|character|identity)\s*[:\-]"
        r"|\b\d\s*[.)]\s*(?:your|the)\s+(?:system\s+|hidden\s+|secret\s+|internal\s+|initial\s+|original\s+)?(?:prompt|prompts|instruction|instructions|rules?|directives?|configuration|config|context)\b"
        r"|\byour\s+hidden\s+(?:rules?|instructions?|directives?|configuration|config|prompt|guidelines?)\b|\bleak\s+(?:the\s+|your\s+)?(?:prompt|instructions?|rules?|configuration|config|context)\b",
    ),
    (
        "role_marker_spoofing", HARD,
        r"(?:^|\n)[ \t>*_-]*(?:#{1,6}[ \t]*)?(?:\*{1,3}|_{1,3})?[ \t]*(?:system|assistant|developer|human|user)[ \t]*:[ \t]*\S"
        r"|\[/?INST\]|<</?SYS>>|<\|im_(?:start|end)\|>|</?(?:system|assistant|user|developer)>|\[/?(?:SYSTEM|ASSISTANT|USER|INSTRUCTIONS?)\]",
    ),
    ("system_prompt_extraction", HARD, rf"\b{EXTRACT_VERB}\b[^?!]{{0,60}}?\b{OWNED_OBJECT}"),
    (
        "qualified_prompt_extraction", HARD,
        rf"\b{EXTRACT_VERB}\b[^?!]{{0,60}}?\b(?:your|its)\s+(?:{QUALIFIER})\s+(?:{PROTECTED_OBJECT})\b{NOT_PROMPT_TECH}"
        rf"|\b{EXTRACT_VERB}\b[^?!]{{0,60}}?\bthe\s+(?:{QUALIFIER})\s+(?:{PROTECTED_OBJECT})\b(?!\s+of\b){NOT_PROMPT_TECH}",
    ),
    (
        "instruction_summarisation", HARD,
        rf"\b{TRANSFORM_VERB}\b[^?!]{{0,60}}?\b{OWNED_OBJECT}"
        rf"|\b(?:in\s+)?(?:bullet\s+points?|a\s+bullet\s+list|a\s+list|numbered\s+list|a\s+numbered\s+list|steps)\b[^?!]{{0,40}}?\b(?:your|the)\s+(?:{PROTECTED_OBJECT})\b",
    ),
    (
        "context_extraction", HARD,
        r"\bwhat\s+(?:were|was|are|is)\s+you\s+(?:told|instructed|given|taught|said|configured)\b"
        r"|\b(?:repeat|reproduce|print|show|output|dump|list|echo|recite|replay|render)\b[^?!.]{0,50}?\b(?:everything|all\s+(?:of\s+)?(?:the\s+)?(?:text|content|words|instructions?|messages?)"
        r"|the\s+text\s+above|text\s+above|content\s+above|words\s+above|above\s+text|previous\s+(?:messages?|text|content)|prior\s+conversation)\b"
        r"|\bverbatim\b[^?!.]{0,30}?\b(?:prompt|instruction|instructions|context|content|text)\b"
        r"|\byour\s+(?:full|entire|complete|exact|raw|verbatim|whole)\s+(?:context|instructions?|prompt|history|conversation|system)\b"
        r"|\b(?:hidden|internal|secret|private)\s+(?:context|instructions?|prompt|reasoning|chain\s+of\s+thought)\b\s*(?:is|are|was|contains?|:)",
    ),
    (
        "retrieved_context_extraction", HARD,
        rf"\b{REVEAL_VERB}\b[^?!.]{{0,50}}?\b{RETRIEVED_QUALIFIER}\b[^?!.]{{0,30}}?\b{CONTEXT_NOUN}\b"
        rf"|\b{TRANSFORM_VERB}\b[^?!.]{{0,50}}?\b{RETRIEVED_QUALIFIER}\b[^?!.]{{0,30}}?\b{CONTEXT_NOUN}\b"
        rf"|\b(?:what|which)\s+(?:is|are|was|were)\s+the\s+{RETRIEVED_QUALIFIER}\s+{CONTEXT_NOUN}\b"
        rf"|\b{CONTEXT_NOUN}\s+blocks?\s+(?:you|that)\s+(?:have|has|got|are|is)\b|\b{RETRIEVED_QUALIFIER}\s+{CONTEXT_NOUN}\s+blocks?\b"
        rf"|\b(?:{REVEAL_VERB})\b[^?!.]{{0,60}}?\b{CONTEXT_NOUN}\b[^?!.]{{0,30}}?\b{RETRIEVED_QUALIFIER}\b",
    ),
    (
        "template_coverage_request", HARD,
        r"\b(?:raw|unfiltered|debug|internal|full)\s+(?:request|response|prompt|completion|api)\s+(?:payload|body|json|template|format)\b"
        r"|\bwhat\s+(?:did|does|do)\s+(?:the\s+)?(?:raw|unfiltered)\s+(?:prompt|request)\s+(?:look\s+like|say|contain)\b",
    ),
    (
        "guardrail_release", KEYWORD,
        rf"\b{GUARDRAIL_RELEASE}\b"
        r"|\b(?:ignore|disregard|drop|forget)\s+(?:all\s+|any\s+|the\s+|your\s+)*(?:rules?|guidelines?|policies|guardrails?)\b"
        r"(?=[^?!.]{0,60}?\b(?:leak|reveal|show|print|dump|expose|disclose|output|recite)\b)",
    ),
    (
        "jailbreak_vocabulary", KEYWORD,
        r"\bjailbreak(?:ing|s|ed)?\b|\bDAN\s+mode\b|\bdo\s+anything\s+now\b|\bdeveloper\s+mode\b|\bsudo\s+mode\b|\bopposite\s+day\b|\bevil\s+(?:mode|ai|assistant|bot)\b"
        r"|\bunrestricted\s+mode\b|\bunfiltered\s+(?:mode|response|output|answer)?\b|\bwithout\s+(?:any\s+)?(?:restrictions?|filters?|censorship|limitations?|guardrails?)\b"
        r"|\bno\s+longer\s+bound\s+(?:by|to)\b|\bbreak\s+(?:out\s+of|free\s+from)\s+(?:your\s+)?(?:instructions|rules|guidelines|restrictions|programming|training)\b"
        r"|\bignore\s+your\s+(?:programming|guidelines|alignment|training)\b",
    ),
    (
        "malicious_directive", KEYWORD,
        r"\b(?:write|generate|create|produce|give)\s+(?:me\s+)?(?:a\s+|an\s+|some\s+)?(?:malware|ransomware|virus|keylogger|botnet|exploit|sql\s+injection\s+payload|phishing\s+email|spyware)\b"
        r"|\bhow\s+(?:do|can|would)\s+i\s+(?:hack|breach|exploit|ddos|phish)\b",
    ),
)

# Quoting characters, and how quotations open and close.
QUOTES = "'\"`“”‘’«»"
QUOTE_PAIRS = {"'": "'", '"': '"', "`": "`", "“": "”", "‘": "’", "«": "»"}

# Characters that look like Latin letters, and the letters they stand for.
LOOKALIKES = {
    0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0456: "i", 0x0458: "j", 0x0455: "s", 0x04BB: "h", 0x0501: "d", 0x04CF: "l", 0x0432: "b", 0x043C: "m", 0x043D: "h", 0x0442: "t", 0x043A: "k",
    0x03BF: "o", 0x03B1: "a", 0x03B5: "e", 0x03B9: "i", 0x03BD: "v", 0x03C1: "p", 0x03C4: "t", 0x03C5: "u", 0x03C7: "x", 0x03B3: "y", 0x03BA: "k",
    0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x039F: "O", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y", 0x03A7: "X",
    0x0585: "o", 0x0561: "a", 0x0565: "e", 0x0580: "r", 0x056D: "s",
    0x1D00: "A", 0x1D07: "E", 0x026A: "I", 0x1D0F: "O", 0x1D1B: "T", 0x1D1C: "L", 0x0274: "N", 0x0299: "B", 0x1D04: "C", 0x1D05: "D", 0x0493: "F", 0x0262: "G", 0x029C: "H", 0x1D0A: "J", 0x1D0B: "K", 0x1D0D: "M", 0x1D18: "P", 0x01EB: "O", 0x1D20: "V", 0x1D21: "W", 0x028F: "Y", 0x1D22: "Z", 0x0261: "g",
    0x0040: "a", 0x0024: "s", 0x0021: "i", 0x007C: "l",
}
CHEROKEE = "AEIOUVGAKAGEGIGOGUGVHAHEHIHOHUHVLALELILOLULVMA"
CHEROKEE_STARTS = (0x13A0, 0xAB70)
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "(": "c"}
SEPARATORS = ".,:;_~|\\/*+=<>^&-#@'’"

# What an answer must not hold, as (id, pattern).
LEAKS = (
    ("prompt_scaffolding", r"<<<\s*END_CONTEXT_CHUNK|<<<CONTEXT_CHUNK|\[\s*/?\s*(?:SYSTEM|ASSISTANT|USER|INSTRUCTIONS?)\s*\]|<\|im_(?:start|end)\|>|<</?SYS>>"),
    (
        "system_prompt_disclosure",
        r"\b(?:here\s+(?:is|are)|these\s+are)\s+(?:my|the)\s+(?:\w+\s+){0,3}?(?:system|developer|hidden|initial|original)?\s*(?:prompt|instructions?|rules?|directives?)\b"
        r"|\bmy\s+(?:system|developer|hidden|initial|original|full|exact)\s+(?:prompt|instructions?|message)\s+(?:is|are|was|says?|reads?)\b"
        r"|\b(?:my|the)\s+(?:system\s+)?(?:prompt|instructions?)\s*(?:say|says|reads?|states?)\b|\bi\s+(?:was|am|have\s+been)\s+(?:told|instructed|programmed|configured)\s+to\b"
        r"|\bi\s+(?:must|have\s+to)\s+(?:follow|obey|comply\s+with)\s+the\s+following\b|\bmy\s+(?:instructions|rules|guidelines|directives|programming)\s+(?:are|is)\b"
        r"|\bmy\s+training\s+(?:data\s+)?(?:prompt|data)\b|\bprompt\s+engineering\s+note\s*:",
    ),
    (
        "context_disclosure",
        r"\bthe\s+(?:untrusted\s+retrieved\s+context|retrieved\s+context|user\s+query)\s+(?:is|are|was|reads?|contains?|says?)\b|\bcontext\s+window\s+(?:is|contains|includes)\b"
        r"|\b(?:above|below|preceding)\s+(?:the\s+)?(?:user\s+query|system\s+rules|retrieved\s+context)\b|\bI\s+was\s+given\s+the\s+following\s+(?:context|instructions|document)\b",
    ),
    (
        "internal_implementation_disclosure",
        r"\bmy\s+(?:implementation|source\s+code|codebase|pipeline|architecture)\s+(?:is|uses|includes|contains)\b|\bthe\s+source\s+code\s+(?:of|for)\s+this\s+(?:assistant|service|app\w*)\b"
        r"|\bi\s+(?:am|'m)\s+implemented\s+(?:in|using)\b|\bthe\s+(?:prompt|system\s+prompt)\s+template\s+(?:is|reads?)\b"
        r"|\bI\s+(?:was\s+)?(?:built|configured)\s+with\s+the\s+following\s+(?:rules|instructions|config\w*)\b",
    ),
    (
        "instruction_override_echo",
        r"\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions\b|\byou\s+are\s+now\s+in\s+(?:developer|jailbreak|dan|god)\s+mode\b"
        r"|\bdeveloper\s+mode\s+(?:enabled|activated)\b|\bguardrails?\s+(?:are|have\s+been)\s+(?:disabled|removed|off)\b",
    ),
)
