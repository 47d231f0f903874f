"""Personal data: exact patterns seed contextual ones, which find identifiers of other forms.

Emails, addresses, card and phone numbers that the base expressions accept are seeds.  The
words around seeds are lexical patterns, and so are the words around looser candidates:
spelled-out or foreign-letter addresses, numbers that fail a check or lack a prefix.  Spark
scores the graph of patterns and instances in rounds: a pattern is trusted for a kind by
the share of its instances that are of that kind, an instance by the trusted patterns in
which it stands, which then supports further patterns.  Trusted instances are added
wherever they occur; base spans always stay.

Defined results: a null or empty text has no spans; repeated rows and ids are judged row
by row, though equal instances in equal words count once; spans of one kind do not overlap,
and an added span overlaps no other; columns not named are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, stored

KINDS = EMAIL, IP, CARD, PHONE = ("email", "ip", "card", "phone")
#: The base expressions, written so that no long run of characters is tried from each of its places.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_LIKE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_LIKE = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_LIKE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Looser forms: what stands for ``@`` and for a dot, numbers by length.
AT = re.compile(r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?|\sat\s", re.IGNORECASE)
NAMES = re.compile(r"[\w-]{1,63}(?:(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)[\w-]{1,63})+", re.IGNORECASE)
DOT = re.compile(r"\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s", re.IGNORECASE)
FOUR = re.compile(r"(?<![\w.])[0-9]{1,4}(?:(?:\.|[(\[{]\.[)\]}]|\sdot\s)[0-9]{1,4}){3}(?![\w])(?!\.[0-9])", re.IGNORECASE)
SIX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])")
NUMBER = re.compile(r"(?<![\w+])\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,18}(?!\w)")
LONGEST_LOCAL, PHONE_DIGITS, CARD_DIGITS = 64, (7, 15), (12, 19)

#: Characters on either side in which the words of a context lie.
CONTEXT = 64
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Instances that a pattern needs, its least confidence, what an unjudged instance counts against it, and the least score of an instance.
SUPPORT, CONFIDENCE, UNKNOWN, ACCEPTED = 3.0, 0.8, 0.2, 0.8
ROUNDS = 3
SALTS = 16

SPANS = "array<struct<start:int,kind:int,end:int,instance:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base expressions accept, leftmost and non-overlapping by kind, in order."""
    spans, free = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            spans.append((start, 0, m.end()))
            free = m.end()
    for m in IP_LIKE.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append((m.start(), 1, m.end()))
    for m in CARD_LIKE.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE_LIKE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _loose(text: str) -> Iterator[tuple[int, int, tuple[int, ...], str]]:
    """(start, end, kinds, instance) of looser forms."""
    for m in AT.finditer(text):
        start, least = m.start(), max(0, m.start() - LONGEST_LOCAL)
        while start > least and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        host = NAMES.match(text, m.end())
        spelled = m.group().strip().lower() == "at"
        if start < m.start() and host and not (spelled and " dot " not in host.group().lower()):
            yield start, host.end(), (0,), f"{text[start:m.start()]}@{DOT.sub('.', host.group())}".lower()
    for m in FOUR.finditer(text):
        yield m.start(), m.end(), (1,), re.sub(r"[^0-9]+", ".", m.group())
    for m in SIX.finditer(text):
        yield m.start(), m.end(), (1,), m.group().lower()
    for m in NUMBER.finditer(text):
        n = len(_digits(m.group()))
        kinds = tuple(k for k, (least, most) in ((2, CARD_DIGITS), (3, PHONE_DIGITS)) if least <= n <= most)
        yield m.start() + (m.group()[0] == "(" and ")" not in m.group()), m.end(), kinds, _digits(m.group())


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...], str]]:
    """Looser forms that overlap neither a span in ``taken`` (start, kind, end) nor an earlier candidate."""
    ends: list[list[int]] = []  # disjoint stretches that are taken, in order
    for start, _, end in taken:
        if ends and start < ends[-1][1]:
            ends[-1][1] = max(end, ends[-1][1])
        else:
            ends.append([start, end])
    found: list[tuple[int, int, tuple[int, ...], str]] = []
    last = 0
    for c in sorted(_loose(text), key=lambda c: (c[0], -c[1], c[2])):
        k = bisect_left(ends, [c[1], 0])  # stretches before k start before the candidate ends
        if c[2] and c[0] >= last and not (k and ends[k - 1][1] > c[0]):
            found.append(c)
            last = c[1]
    return found


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns at a span: two tokens before it, and one on either side; none where there is no word."""
    low, high = max(0, start - CONTEXT), end + CONTEXT
    before = [m.group() for m in TOKEN.finditer(text[low:start].lower()) if m.start() or not low]
    after = [m.group() for m in TOKEN.finditer(text[end:high].lower()) if m.end() < CONTEXT or high >= len(text)]
    pairs = [("before", before[-2:])] + ([("around", [before[-1], after[0]])] if before and after else [])
    return [f"{name} {a} {b}" for name, (a, b) in (p for p in pairs if len(p[1]) == 2) if a.isalpha() or b.isalpha()]


def _instance(text: str, kind: int) -> str:
    return text.lower() if kind == 0 else ".".join(p.lstrip("0") or "0" for p in text.split(".")) if kind == 1 else _digits(text)


def _looks(text: str) -> bool:
    return any(c in text for c in "0123456789@") or " dot " in (low := text.lower()) or "dot" in low and "at" in low


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, loose): base spans and candidates of each row with their patterns; a candidate has a row for each kind it may be."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                sure = base_spans(t) if _looks(t) else []
                base.append([(s, k, e, _instance(t[s:e], k), contexts(t, s, e)) for s, k, e in sure])
                maybe = candidates(t, sure) if _looks(t) else []
                loose.append([(s, k, e, i, contexts(t, s, e)) for s, e, kinds, i in maybe for k in kinds])
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array([[dict(zip(("start", "kind", "end", "instance", "patterns"), x)) for x in xs] for xs in c], kind) for c in (base, loose))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "base", "loose"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(spans, f"row long, doc_id {id_type}, base {SPANS}, loose {SPANS}"), "pii-spans")


def _met(many: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join with a side whose keys are unique: broadcast within bounds, else each key in ``SALTS`` parts by ``spread``."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(salted, [*on, "_salt"], how).drop("_salt")


def _edges(extracted: DataFrame, column: str) -> DataFrame:
    each = extracted.select(F.explode(column).alias("x")).select("x.kind", "x.instance", F.explode("x.patterns").alias("pattern"))
    return each.distinct()


def trusted_instances(extracted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of candidates that are seeds elsewhere or that trusted patterns hold."""
    loose = stored(_edges(extracted, "loose"), "pii-edges")
    lone = extracted.select(F.explode("loose").alias("x")).select("x.instance", "x.kind").distinct()
    seeds = stored(extracted.select(F.explode("base").alias("x")).select("x.instance", "x.kind").distinct(), "pii-seeds")
    known = stored(_met(seeds, stored(lone, "pii-candidates"), ["instance", "kind"], "instance", "left_semi").withColumn("score", F.lit(1.0)), "pii-known")
    if loose.isEmpty():
        return known
    wanted = stored(loose.select("pattern").distinct(), "pii-patterns")
    sure = _met(_edges(extracted, "base"), wanted, ["pattern"], "instance", "left_semi")
    fresh = _met(loose, known, ["instance", "kind"], "pattern", "left_anti")
    seeded = sure.unionByName(_met(loose, known.drop("score"), ["instance", "kind"], "pattern", "left_semi")).distinct()
    edges = stored(seeded.withColumn("seed", F.lit(1.0)).unionByName(fresh.withColumn("seed", F.lit(0.0))), "pii-graph")
    by_instance = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    totals = by_instance.groupBy("pattern").agg(F.count(F.lit(1)).alias("held"), F.sum("seed").alias("seeded"))
    own = edges.groupBy("pattern", "kind").agg(F.sum("seed").alias("of_kind"))
    shares = stored(own.join(totals, "pattern"), "pii-shares")
    unseen = edges.filter("seed = 0").select("pattern", "instance", "kind")
    scores = None
    for _ in range(rounds):
        judged = shares.withColumn("more", F.lit(0.0))
        if scores is not None:
            gained = _met(unseen, scores, ["instance", "kind"], "pattern").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            judged = shares.join(gained, ["pattern", "kind"], "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
        good, against = F.col("of_kind") + F.col("more"), F.col("seeded") - F.col("of_kind")
        confidence = good / (good + against + UNKNOWN * F.greatest(F.col("held") - good - against, F.lit(0.0)))
        trusted = judged.withColumn("confidence", F.round(confidence, 9)).filter((good >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        trusted = stored(trusted.select("pattern", "kind", "confidence"), "pii-trusted")
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        held = _met(unseen, trusted, ["pattern", "kind"], "instance").groupBy("instance", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("score"))
        scores = stored(held, "pii-scores")
    return stored(known.unionByName(scores.filter(F.col("score") >= ACCEPTED)), "pii-trusted-instances")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end) of each row's base spans and of what their contexts led to, in order."""
    extracted = extract(docs, doc_id, text)
    trusted = trusted_instances(extracted, rounds)
    each = extracted.select("row", F.explode("loose").alias("x")).select("row", "x.start", "x.kind", "x.end", "x.instance")
    met = _met(each, trusted, ["instance", "kind"], "row")
    best = met.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return extracted.select("row", "doc_id", plain.alias("base")).join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
