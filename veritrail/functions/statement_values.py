"""Fixed values of composing: what kind of statement a line is, by its form."""

from __future__ import annotations

from pyspark.sql import Column

#: Sections about the corpus itself.
META_SECTION = r"(?iuU)(?:^|>\s*)(?:how to treat|knowledge boundaries|guardrails|rules|levels)\b"
#: A labelled field, labels of other people, labels of opaque identifiers.
FIELD = r"(?U)^\s*[-*+]?\s*\*{0,2}[A-Z][\w /&.-]{0,38}\*{0,2}:\s+\S"
THIRD_PARTY = (
    r"(?iuU)^\s*[-*+]?\s*\*{0,2}(instructors?|co-?instructors?|teachers?|trainers?|mentors?|supervisors?|coordinators?|reviewers?|authors?|verified\s+by|"
    r"reference(?:\s+number)?|ref\b)\*{0,2}:"
)
OPAQUE_ID = (
    r"(?iuU)^\s*[-*+]?\s*\*{0,2}(cert(?:ificate)?\s*id|registration\s*id|enrol?lment\s*id|verification\s*(?:url|link|id)|uuid|serial(?:\s*(?:no|number))?)\*{0,2}:"
)
#: A sentence that continues the one before, an opening pronoun for a person, text about documents.
CONTINUES = r"(?iuU)^\s*(?:it|this|that|these|those)\s+(?:is|are|was|were)\b"
PRONOUN = r"(?iuU)^\s*(?:he|she|they)\b"
SCAFFOLDING = (
    r"(?iuU)^\s*(?:(?:this|these|the|that)\s+(?:document|documents|section|sections|page|pages|file|files|chunk|chunks|knowledge[- ]base|record|records|entry|entries|list|lists|table|tables)\b"
    r"|they\s+(?:describe|document|list|record|cover|group|are\s+grouped|separate)\b|are\s+grouped\b)"
)


def is_meta_section(section: Column) -> Column:
    return section.rlike(META_SECTION)


def is_field(statement: Column) -> Column:
    return statement.rlike(FIELD)


def is_third_party(statement: Column) -> Column:
    return statement.rlike(THIRD_PARTY)


def is_opaque_id(statement: Column) -> Column:
    return statement.rlike(OPAQUE_ID)


def continues(statement: Column) -> Column:
    return statement.rlike(CONTINUES)


def is_scaffolding(statement: Column) -> Column:
    return statement.rlike(SCAFFOLDING)


def is_milestone(statement: Column, is_list_item: Column) -> Column:
    """A labelled field, or a list item with a digit."""
    return is_field(statement) | (is_list_item & statement.rlike(r"\p{Nd}"))
