"""Text functions as Spark expressions, and the same as DuckDB SQL for checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words that no term is made of.
STOPWORDS = (
    "a about am an and any are as at be been but by can could did do does for from give had has have he her him his how i in is it its "
    "list me my of on or our please she should so tell than that the their them then there these they this those yourself himself "
    "herself myself ourselves themselves to up was we were what when where which who whom why will with would you your"
).split()
#: Words too general to be evidence, besides the function words.
WEAK_WORDS = (
    "also etc just kind made make many one some thing things stuff sort spare get up actually outside someone somebody anyone anybody "
    "everyone everybody nobody use used uses using want way work come doing quick brief short detailed elaborate comprehensive simple "
    "technically practically basically chance walk wonder maybe perhaps possibly guess through across regarding concerning about"
).split()
#: Words that count as one, first the form that stands for the group.
VARIANTS = (("tech", "technological", "technologies", "technology", "techs"), ("bio", "biographies", "biography", "bios"), ("child", "children"))
LEAST_PREFIX, MOST_LONGER = 4, 3

_WEAK = sorted({*STOPWORDS, *WEAK_WORDS})
_WORD = "[a-z0-9]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, even where the optimizer moves or repeats the expression around it."""
    return F.get(F.transform(F.array(value), body), 0)


def _any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a case-insensitive pattern with Unicode classes is found; null is no match."""
    return F.coalesce(reduce(lambda a, p: a | text.rlike(f"(?iuU){p}"), patterns, F.lit(False)), F.lit(False))


#: Sentences that instruct the assistant, and so are never evidence.
DIRECTIVES = (
    r"^\s*(?:do\s+not|don'?t|never|always|must\s+not|should\s+not|cannot|can'?t)\b",
    r"^\s*(?:say|state|report|flag|distinguish|keep|answer|respond|reply|declin\w*|treat|use|quote|omit|avoid|disclos\w*|ignor\w*|disregard\w*)\b",
    r"^\s*(?:you|the\s+assistant)\s+(?:must|should|shall|may|can|will|need)(?:\s+not)?\b",
    r"\b(?:retrieved|knowledge[- ]base)\s+text\b[^.\n]{0,40}\b(?:is|are)\s+data\b|\b(?:instruction|instructions)\s+(?:encountered|found)\s+inside\b|\bnot\s+obeyed\b",
    r"\b(?:answer|respond|reply|say)\b[^.\n]{0,60}\b(?:do\s+not\s+have|do\s+not\s+know|cannot|can'?t|is\s+private)\b",
    r"\b(?:absence|unknown|unrecorded|not\s+on\s+record)\s+is\s+a\s+(?:valid|correct|complete)\s+answer\b",
    r"^\s*only\s+this\s+knowledge\s+base\b",
    r"\b(?:answers?|facts?|numbers?|metrics?|dates?|credentials?)\s+must\b|\bmust\s+(?:be\s+quoted|come\s+from)\b",
    r"^\s*(?:if|when)\s+(?:the\s+)?(?:context|knowledge\s+base)[^.\n]{0,60}\b(?:does\s+not|is\s+absent|is\s+missing)\b",
)
#: Text about the assistant's own machinery.
META_RULES = (
    r"\bsystem\s+prompt\b|\bprompt\s+template\b",
    r"\b(?:absolute\s+rules|hidden\s+instructions|operating\s+instructions|these\s+rules\s+govern|override\s+anything)\b",
    r"\b(?:retrieval\s+mechanism|similarity\s+threshold|top[ _-]?k|knowledge\s+boundar\w*)\b",
    r"\b(?:this|the)\s+assistant'?s?\s+own\s+(?:configuration|rules|settings)\b|\bhow\s+this\s+assistant\b",
    r"\b(?:temperature|fine[- ]?tun\w*|rlhf)\b",
    r"^\s*(?:rule|boundary|boundaries)\s+\d+\s*[.:]",
)
#: Statements that something is not on record.
ABSENCES = (
    r"\b(?:is|are|was|were|has|have)\s+not\s+(?:recorded|stated|documented|listed|available|specified|mentioned|known)\b",
    r"\bnot\s+(?:recorded|stated|documented|on\s+record|specified|mentioned)\b",
    r"\bno\b[^.\n]{0,60}\b(?:is|are|has|have)\s+(?:recorded|stated|documented|listed)\b",
    r"\bnot\s+on\s+record\b",
    r"\b(?:no\s+formal|no\s+years\s+of)\b",
    r"\bthere\s+is\s+no\b|\bthere\s+are\s+no\b",
    r"\bnothing\s+is\s+recorded\b|\bnone\s+is\s+recorded\b",
    r"\bdo\s+not\s+(?:have|hold|exist)\b",
)


def is_directive(text: Column) -> Column:
    return _any_of(text, DIRECTIVES)


def is_meta_rule(text: Column) -> Column:
    return _any_of(text, META_RULES)


def is_negative_evidence(text: Column) -> Column:
    return _any_of(text, ABSENCES)


def words(text: Column) -> Column:
    """All lower-case ASCII words in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"))


def tokenise(text: Column) -> Column:
    """Words without function words and single letters; single digits stay."""
    return F.filter(words(text), lambda w: ((F.length(w) > 1) | w.rlike("^[0-9]$")) & ~w.isin(STOPWORDS))


def _weak_forms() -> tuple[list[str], list[str]]:
    """Words equal to a weak word, a variant or a beginning of one, and the weak words that longer words may begin with."""
    equal = set(_WEAK)
    for group in VARIANTS:
        if equal & set(group):
            equal |= set(group)
    stems = [w for w in _WEAK if len(w) >= LEAST_PREFIX]
    equal |= {w[: len(w) - k] for w in stems for k in range(1, MOST_LONGER + 1) if len(w) - k >= LEAST_PREFIX}
    return sorted(equal), stems


def is_weak(word: Column) -> Column:
    """Whether a word matches a weak word as ``terms_match`` does, by set lookups alone."""
    equal, stems = _weak_forms()
    return reduce(lambda a, k: a | F.substring(word, 1, F.length(word) - k).isin(stems), range(1, MOST_LONGER + 1), word.isin(equal))


def content_terms(text: Column) -> Column:
    """Tokens that are not weak."""
    return F.filter(tokenise(text), lambda w: ~is_weak(w))


def canonical_form(term: Column) -> Column:
    return reduce(lambda rest, g: F.when(term.isin(*g), g[0]).otherwise(rest), VARIANTS, term)


def same_term(a: Column, b: Column) -> Column:
    """Equal, of one variant group, or one the beginning of the other within bounds."""
    near = (F.length(a) >= LEAST_PREFIX) & (F.length(b) >= LEAST_PREFIX) & (F.abs(F.length(a) - F.length(b)) <= MOST_LONGER)
    return (canonical_form(a) == canonical_form(b)) | (near & (F.startswith(a, b) | F.startswith(b, a)))


def terms_match(term: Column, candidates: Column) -> Column:
    return F.exists(candidates, lambda c: same_term(term, c))


def matching_terms(term: Column, candidates: Column) -> Column:
    return F.filter(candidates, lambda c: same_term(term, c))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_key(text: Column) -> Column:
    return F.array_join(words(text), " ")


def clean_markdown(line: Column) -> Column:
    """A line without emphasis and code marks, links as their text, and runs of white space as one."""
    plain = F.regexp_replace(line, r"\*{1,3}|_{1,3}|`+", "")
    linked = F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(linked, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """Sentences; not cut after decimals or a personal initial.  A text without any is itself."""
    parts = F.split(text, r"""(?U)(?<![A-Z]\.)(?<=[.!?])(?<!\d\.)\s+(?=["'(\[]?[A-Z0-9])""", -1)
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def clip(text: Column, most: int = 320) -> Column:
    """At most ``most`` characters, cut at the last space, if there is one, and marked."""
    cut = F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+\z", ""), F.lit("...")))


def as_sentence(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def is_answerable(text: Column) -> Column:
    """Whether a statement can be evidence: two characters, some content term, and neither directive nor rule."""
    return (F.length(text) >= 2) & ~is_directive(text) & ~is_meta_rule(text) & (F.size(content_terms(text)) > 0)


def citation(source_file: Column, section: Column) -> Column:
    return F.concat_ws(" :: ", source_file, section)


def embedding_text(section: Column, text: Column) -> Column:
    """What is embedded of a chunk: its heading path, if any, above its text; null is empty."""
    head, body = F.trim(F.coalesce(section, F.lit(""))), F.coalesce(text, F.lit(""))
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n"), body))


def lexical_text(source_file: Column, section: Column, text: Column) -> Column:
    """What lexical search reads of a chunk: file stem, with spaces for hyphens, and heading path above its text."""
    stem = F.regexp_replace(F.substring_index(source_file, "/", -1), r"\.[^.]*$", "")
    return embedding_text(F.concat_ws(" ", F.translate(stem, "-", " "), section), text)


def chunk_id(source_file: Column, section: Column, ordinal: Column, text: Column) -> Column:
    """File stem, four-digit ordinal and twelve digits of a hash of what the chunk is."""
    stem = F.regexp_replace(F.substring_index(source_file, "/", -1), r"\.[^.]*$", "")
    digest = F.sha2(F.concat_ws("\u0000", source_file, section, ordinal.cast("string"), text), 256)
    return F.format_string("%s-%04d-%s", stem, ordinal, F.substring(digest, 1, 12))


# -- the same in DuckDB SQL ----------------------------------------------------------------


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{_WORD}')"


def sql_tokens(text: str) -> str:
    return f"list_filter({sql_words(text)}, lambda w: (length(w) > 1 or regexp_matches(w, '^[0-9]$')) and w not in ({_quoted(STOPWORDS)}))"


def sql_content_terms(text: str) -> str:
    """By the definition, comparing with every weak word."""
    weak = f"[{_quoted(_WEAK)}]"
    near = "length(w) >= 4 and length(x) >= 4 and abs(length(w) - length(x)) <= 3 and (starts_with(w, x) or starts_with(x, w))"
    return f"list_filter({sql_tokens(text)}, lambda w: len(list_filter({weak}, lambda x: w = x or ({near}))) = 0)"
