"""Fixed values of routing: what questions are about, by the words and turns of phrase that say so."""

from __future__ import annotations

from dataclasses import dataclass

#: Domains with the file categories that back them, in the order in which a heading's ties are settled; ``faq`` files serve every domain.
DOMAIN_CATEGORY = {
    "certifications": "certifications", "contact": "contact", "education": "education", "availability": "availability", "experience": "experience",
    "skills": "skills", "goals": "goals", "interests": "interests", "projects": "project", "identity": "profile",
}
CROSS_CUTTING, UNKNOWN = "faq", "unknown"

#: Intents in the order in which ties are settled, with their domain.
INTENT_DOMAIN = {
    "certifications": "certifications", "contact": "contact", "education": "education", "availability": "availability", "experience": "experience", "skills": "skills",
    "focus": "goals", "goals": "goals", "interests": "interests", "projects": "projects", "background": "identity", "identity": "identity",
}
PROJECT_DETAIL = "project_detail"
#: Intents answered as a list, domains an intent draws on besides its own, intents that only exist together with those,
#: intents that never join another one, and intents answered by a whole document.
LIST_INTENTS = ("projects", "skills", "interests", "certifications")
EXPANSION = {"background": ("education", "goals"), "focus": ("identity", "skills")}
COMPOSITE = ("background",)
NEVER_JOINS = ("identity", "background")
WHOLE_DOCUMENT = ("skills", "certifications", "interests")
OVERVIEW_INTENTS = ("background", "focus")
#: The share of the best score from which a second intent joins, further domains, weights, words that need another word of their concept.
JOINS_FROM, FURTHER_DOMAINS, STRONG, WEAK, FRAME = 0.9, 2, 2.0, 1.0, 2.5
AMBIGUOUS = ("balance", "history")
#: Words that ask for an overview or a list.
OVERVIEW_WORDS = "summarise summarize summary overview describe description introduction introduce introducing intro explain walkthrough walk profile portrait picture".split()
LIST_CUES = "list all which many what".split()


@dataclass(frozen=True)
class Concept:
    """One thing a question can be about, and the words that name it."""

    name: str
    intent: str
    domains: tuple[str, ...]
    weight: float
    surfaces: tuple[str, ...]


@dataclass(frozen=True)
class Frame:
    """A turn of phrase, matched in lower-cased words with single spaces."""

    name: str
    intent: str
    pattern: str


def _concept(name: str, intent: str, domains: str, weight: float, surfaces: str) -> Concept:
    return Concept(name, intent, tuple(domains.split()), weight, tuple(surfaces.split()))


#: Concepts.
CONCEPTS = (
    _concept("identity-core", "identity", "identity", STRONG, "who name named nickname alias aliases identity called profile introduce introduction introducing initial initials brand subject"),
    _concept("self-reference", "identity", "identity", WEAK, "about describe overview summary summarise summarize"),
    _concept("background", "background", "identity", STRONG, "background backstory story trajectory journey snapshot picture roots origins pathway"),
    _concept(
        "education", "education", "education", STRONG,
        "education educational educate academic academically academia study studies studying studied diploma degree qualification qualifications university college "
        "polytechnic institution cgpa gpa grade grading semester graduation graduate course coursework major alma pursuing pursue",
    ),
    _concept(
        "capability", "skills", "skills", STRONG,
        "skill skills tech technology technologies stack tool tools tooling programming language languages framework frameworks proficiency proficient expertise expert "
        "ability abilities capability capabilities talents good strong skilled strongest best knows know known familiar competent",
    ),
    _concept(
        "tooling", "skills", "skills", STRONG,
        "python javascript typescript react fastapi docker faiss ollama sqlalchemy postgresql tailwind numpy pandas tensorflow pytorch embeddings astro bm25 bm rag",
    ),
    _concept(
        "certification", "certifications", "certifications", STRONG,
        "certification certifications certificate certificates certified credential credentials badge exam aws springboard infosys",
    ),
    _concept("building", "projects", "projects", STRONG, "project projects built build builds building made make creates created create shipped app apps application applications"),
    _concept(
        "building-generic", "projects", "projects", WEAK,
        "platform platforms engine repository repo deployed deployment architecture portfolio system systems tool tools toolkit product products",
    ),
    _concept(
        "employment", "experience", "experience", STRONG,
        "experience experienced work works worked working employment employed job jobs role roles professional professionally company companies employer history years workplace stint stints",
    ),
    _concept(
        "availability", "availability", "availability", STRONG,
        "available availability hire hiring hireable freelance freelancing internship internships intern collaborate collaboration collaborations services service offer "
        "offering offerings book bookable schedule rsvp rate pricing looking seeking seeks vacancy open",
    ),
    _concept("goal", "goals", "goals", STRONG, "goal goals aim aims aiming ambition ambitions ambitious aspire aspires aspiring plan plans planning career careers future milestone"),
    _concept(
        "focus", "focus", "goals identity", STRONG,
        "focus focused focuses focussing focusing concentration concentrates concentrating priority priorities direction interested keen passion passionate specialisation specialization",
    ),
    _concept(
        "hobby", "interests", "interests", STRONG,
        "interest interests hobby hobbies pastime pastimes fun enjoy enjoys enjoyed enjoyment like likes liked favourite favorite into keen leisure anime manga gaming games "
        "comic comics personal balance hometown",
    ),
    _concept("location", "identity", "identity", STRONG, "live lives living based location located hometown"),
    _concept("contact", "contact", "contact", STRONG, "contact contacts email emails mail phone mobile linkedin github instagram whatsapp telegram reach touch dm"),
)

#: Words that name a domain in headings besides those of its concepts.
HEADING_WORDS = {"projects": ("builds", "built", "make", "made")}

_SLOT = r"(?:[\w'-]+\s+){0,2}(?:of\s+)?"

#: Turns of phrase.  ``can-hire`` allows no space before its slot, as it stands.
FRAMES = (
    Frame("capability-do", "skills", rf"\b(?:what|which)\s+can\s+{_SLOT}(?:do|handle|help)\b"),
    Frame(
        "capability-good-at", "skills",
        r"\b(?:good|strong|skilled|proficient|expert|comfortable)\s+at\b|\b(?:strong|skilled|expert)\s+in\b|\bwhat\s+(?:is|are)\s+" + _SLOT + r"(?:good|strong|skilled|best)\s+at\b",
    ),
    Frame("working-on", "projects", r"\b(?:work|works|worked|working|build|builds|built|building|make|makes|made|making)\s+(?:on|upon)\b"),
    Frame("work-with", "skills", r"\b(?:work|works|worked|working)\s+with\b"),
    Frame("help-with", "availability", r"\b(?:help|helps|helping|help\s+out)\s+with\b"),
    Frame("outside-leisure", "interests", r"\b(?:outside|beyond)\s+(?:of\s+)?(?:work|study|school|college|programming|coding|class)\b"),
    Frame("for-fun", "interests", r"\bfor\s+fun\b|\bin\s+(?:his|her|their)\s+spare\s+time\b"),
    Frame("working-toward", "focus", r"\b(?:working|work|aiming|headed|driving)\s+towards?\b"),
    Frame("focused-on", "focus", r"\bfocus(?:es|ed|ing)?\s+(?:on|upon)\b"),
    Frame("interested-in", "focus", r"\binterested\s+in\b|\bkeen\s+on\b"),
    Frame("studies-where", "education", r"\b(?:where|which)\b.*\bstud(?:y|ies|ying)\b"),
    Frame("can-hire", "availability", rf"\b(?:can|could|may)\b{_SLOT}(?:hire|employ|recruit|work\s+with)\b"),
    Frame("looking-for", "availability", r"\b(?:looking|seeking|hoping)\s+for\b"),
    Frame("introductory", "identity", r"\b(?:intro|introductory|introduction|introductions|overview|summary|summarise|summarize|describe|description|profile|explain)\b"),
)

#: Capitalised words that are no project's name: openers, auxiliaries, the speaker, organisations.
NO_PROJECT = (
    "what who whom whose which where when why how is are was were can could may might must should would will shall do have has had does did tell describe explain "
    "summarize summarise give show list hi hello hey thanks i my me infosys springboard aws vercel github linkedin instagram tmdb cgpa"
).split()
