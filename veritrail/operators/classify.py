"""Whether a message is an attack, within the subject of the corpus, or neither."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .security import with_verdict

INJECTION, IN_SCOPE, OFF_TOPIC = "injection", "in_scope", "off_topic"
#: Words that refer to whom the corpus is about, besides the names of the profile.
SUBJECT_WORDS = "you your yours yourself u ur he his him himself she her hers herself they them their theirs".split()
#: Words that make a question or request.
QUESTION_WORDS = (
    "what whats who whom whose which where when why how tell describe explain summarise summarize introduce show list give share know help "
    "brief outline walk is are was were am can could do does did has have had"
).split()
#: Greetings and thanks, with whom they may address.
SMALLTALK = (
    r"(?iuU)^\s*(?:hi|hey|hello|yo|sup|good\s+(?:morning|afternoon|evening|day)|how\s+are\s+you|thanks|thank\s+you|thx|ok|okay|cool|nice|bye|goodbye|see\s+ya|good\s+night|cheers|👍|🙏)\b"
)
ADDRESSEES = ("there", "everyone", "all", "man", "friend")


#: Topics that any corpus about a person covers; those of one corpus, such as its projects, come with its profile.
TOPICS = (
    "portfolio", "about you", "about the assistant", "your name", "his name", "full name", "what's your name", "whats your name", "who are you", "what are you", "what can you do",
    "your skills", "your experience", "your background", "your projects", "your project", "your work", "your knowledge", "your knowledge base", "your docs", "your documentation",
    "your resume", "your cv", "your education", "your certifications", "your achievements", "your stack", "tech stack", "tech used", "technologies used", "tools used",
    "skills", "experience", "projects", "project", "resume", "cv", "curriculum vitae", "education", "degree", "university", "certifications", "achievements",
    "contact", "email", "github", "linkedin", "website", "blog", "availability", "interests", "interest", "hobbies", "hobby", "pastimes", "pastime", "for fun", "do for fun", "enjoy",
    "free time", "spare time", "help me", "advice", "summarize", "summary", "summarise", "difference between",
)


@dataclass(frozen=True)
class Profile:
    """Whom a corpus is about and which topics it covers; all corpus-specific words are here."""

    names: tuple[str, ...] = ()
    topics: tuple[str, ...] = TOPICS


def is_smalltalk(text: Column, profile: Profile = Profile()) -> Column:
    to = "|".join(re.escape(w) for w in (*ADDRESSEES, *(n.lower() for n in profile.names)))
    return text.rlike(SMALLTALK + rf"(?:\s+(?:{to}))?[\s!.,?🙂👋]*$")


def topics(text: Column, profile: Profile = Profile()) -> Column:
    """Topics and names of the profile that a text has as whole words, in order, lower-cased; the longest at a place."""
    words = sorted({t.strip().lower() for t in (*profile.topics, *profile.names) if t.strip()}, key=lambda t: (-len(t), t))
    if not words:
        return F.array().cast("array<string>")
    pattern = rf"(?iuU)(?<!\w)({'|'.join(re.escape(t) for t in words)})(?!\w)"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern)), F.lower)


def _first_of(text: Column, pattern: str, known: list[str]) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})")), lambda w: w.isin(known))
    return F.try_element_at(found, F.lit(1))


def classify(messages: DataFrame, profile: Profile = Profile(), text: str = "message") -> DataFrame:
    """Add ``classification`` (class, reason, smalltalk, topics) and the ``verdict`` of screening.

    In order: empty, attack, small talk, a topic, the subject and a question word; else
    off topic.  A null message is empty.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    judged = with_verdict(messages.withColumn("_clean", clean), "_clean")
    said = F.col("_clean")
    subject = _first_of(said, "[a-z0-9']+", [*SUBJECT_WORDS, *(n.lower() for n in profile.names)])
    form = _first_of(said, "[a-z]+", QUESTION_WORDS)
    facts = judged.withColumns({"_small": is_smalltalk(said, profile), "_topics": topics(said, profile), "_subject": subject, "_form": form})
    cases = [
        (said == "", OFF_TOPIC, F.lit("empty message")),
        (F.col("verdict.is_injection"), INJECTION, F.concat(F.lit("matched "), F.array_join(F.transform("verdict.matches", lambda m: m["rule_id"]), ", "))),
        (F.col("_small"), OFF_TOPIC, F.lit("small talk")),
        (F.size("_topics") > 0, IN_SCOPE, F.concat(F.lit("topics: "), F.array_join("_topics", ", "))),
        (F.col("_subject").isNotNull() & F.col("_form").isNotNull(), IN_SCOPE, F.concat_ws(" ", F.lit("question about"), "_subject", F.lit("by"), "_form")),
    ]

    def first(values) -> Column:
        return reduce(lambda rest, case: F.when(case[0], values(case)).otherwise(rest), reversed(cases), values((None, OFF_TOPIC, F.lit("no topic"))))

    reached = F.col("_small") & (said != "") & ~F.col("verdict.is_injection")
    found = F.struct(first(lambda c: F.lit(c[1])).alias("class"), first(lambda c: c[2]).alias("reason"), reached.alias("smalltalk"), F.col("_topics").alias("topics"))
    return facts.withColumn("classification", found).drop("_clean", "_small", "_topics", "_subject", "_form")
