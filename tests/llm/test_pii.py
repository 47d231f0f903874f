import hashlib
import random
import re

import duckdb
import pytest

from veritrail.llm import pii, queries

#: The base expressions as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), k, m.end()) for k, (kind, rx) in enumerate(GIVEN.items()) for m in re.finditer(rx, text) if fits(kind, m.group())]
    return sorted(found)


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


ODD = [
    "", "a@b.c@d.e", "@x.y", "x@y", "x@y..z", "a.b@c-d.e.f, q@r.s.", "é@b.cd", "aé.b@c.de", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.2.3.4", "1.2.3", "00000000000000000000001.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "41111111111111112 4111111111111111", "+1 (743) 555-3824", "++1 743 555 3824.", "+1+17435553824", "+1 ((((( 743", "+123456789012345 6",
    "tel 😀 +44 20 7946 0958 x", "4" * 3000, "1 " * 3000, "a" * 5000 + "@", "+1(" * 2000, "1.1.1.1." * 500, "a@b.c" * 300,
]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_are_those_given(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_random_strings():
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(["1", "4", "0", " ", "-", ".", "@", "a", "+", "(", "25", "x.y", "1.2.3", "4111111111111111", "é", ")"]) for _ in range(draw.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000 + "@", "+1" * 200_000, "1 " * 200_000, "a at " * 100_000, "a@" * 200_000, "(1" * 200_000):
        assert pii.candidates(text, pii.base_spans(text)) is not None


def test_whole_table_keeps_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())
    rows = queries.op11_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(shown(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added


def brute(texts, rounds=pii.ROUNDS):
    """Spans added to each text, by the scores computed with plain sets."""
    base = [plain(t) for t in texts]
    loose = [[(s, k, e, i) for s, e, kinds, i in pii.candidates(t, b) for k in kinds] for t, b in zip(texts, base)]
    seeds, edges = set(), set()
    for t, b in zip(texts, base):
        for s, k, e in b:
            seeds.add((pii._instance(t[s:e], k), k))
            edges |= {(p, pii._instance(t[s:e], k), k) for p in pii.contexts(t, s, e)}
    free = {(p, i, k) for t, xs in zip(texts, loose) for s, k, e, i in xs for p in pii.contexts(t, s, e)}
    edges |= free
    scores = {}
    for _ in range(rounds):
        trust = {}
        for p in {p for p, _, _ in free}:
            held = {i for q, i, _ in edges if q == p}
            seeded = {i for q, i, k in edges if q == p and any((i, j) in seeds and (p, i, j) in edges for j in range(4))}
            for k in range(4):
                own = {i for q, i, j in edges if q == p and j == k and (i, k) in seeds}
                good = len(own) + sum(scores.get((i, k), 0) for q, i, j in free if q == p and j == k and (i, k) not in seeds)
                against = len(seeded) - len(own)
                if good >= pii.SUPPORT and (c := round(good / (good + against + pii.UNKNOWN * max(len(held) - good - against, 0)), 9)) >= pii.CONFIDENCE:
                    trust[p, k] = c
        doubt = {}
        for p, i, k in free:
            if (p, k) in trust and (i, k) not in seeds:
                doubt[i, k] = doubt.get((i, k), 1.0) * (1 - min(trust[p, k], 0.999))
        scores = {x: round(1 - d, 9) for x, d in doubt.items()}
    sure = {x: s for x, s in scores.items() if s >= pii.ACCEPTED} | {x: 1.0 for x in {(i, k) for xs in loose for _, k, _, i in xs} & seeds}
    out = []
    for xs in loose:
        best = {}
        for s, k, e, i in xs:
            if (i, k) in sure:
                best[s, e] = min(best.get((s, e), (2.0, 9)), (-sure[i, k], k))
        out.append(sorted((s, k, e) for (s, e), (_, k) in best.items()))
    return out


PLANTED = [
    *(f"Please call phone: +1 (74{k}) 555-382{k} today" for k in range(5)),
    "Please call phone: 743-555-9999 today",  # no prefix, in the words of phones
    "nothing special 743-555-9999 elsewhere",  # the same number in other words
    "an order of 743-555-1234 units",  # a number in words that no phone has
    *(f"write mail to user{k}@mail{k}.example.com please" for k in range(4)),
    "write mail to günter.x (at) mail5.example (dot) com please",
    "known user1 (at) mail1 (dot) example (dot) com hidden",  # a seed in another form
    *(f"server address is 10.0.0.{k} now" for k in range(3)),
    "server address is 10.0.0.300 now",
    *(f"paid by card number {c}!" for c in ("4111111111111111", "5500005555555559", "4012888888881881")),
    "paid by card number 4111 1111 1111 1112!",
    *(f"mixed words here {x} there" for x in ("10.1.1.1", "a@b.cd", "+1 743 555 0000", "743 555 7777")),
    "reach us via 743-555-9999 soon",
    "reach us via 743-555-8888 soon",
    "", None,
]


def test_contexts_discover_unseen_forms(spark):
    rows = [(k, t) for k, t in enumerate(PLANTED)] + [(3, PLANTED[3]), (None, PLANTED[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", pii.F.lit(1)).withColumn("base", pii.F.lit("x"))
    got = sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.added]) for r in pii.find_personal_data(df).collect()), key=repr)
    texts = [t or "" for _, t in rows]
    want = sorted(((i, plain(t), a) for (i, _), t, a in zip(rows, texts, brute(texts))), key=repr)
    assert got == want
    found = {i: [PLANTED[i][s:e] for s, _, e in added] for i, _, added in got if i is not None and added}
    assert found == {
        5: ["743-555-9999"],
        6: ["743-555-9999"],
        12: ["günter.x (at) mail5.example (dot) com"],
        13: ["user1 (at) mail1 (dot) example (dot) com"],
        17: ["10.0.0.300"],
        21: ["4111 1111 1111 1112"],
        26: ["743-555-9999"],
    }


def test_later_rounds_use_what_earlier_ones_found(spark):
    texts = [f"dial line {k}: +1 (74{k}) 555-382{k} ok" for k in range(4)]
    texts = [t.replace(f"line {k}:", "line:") for k, t in enumerate(texts)] + [f"dial line: 743-555-000{k} ok" for k in range(4)]
    texts += [f"ring desk; 743-555-000{k} bye" for k in range(4)] + ["ring desk; 743-555-7777 bye"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once, more = ({r.doc_id: len(r.added) for r in pii.find_personal_data(df, rounds=n).collect()} for n in (1, 3))
    assert not once[12] and more[12] == 1
    assert [len(a) for a in brute(texts)] == [more[k] for k in range(len(texts))] and sum(more.values()) == 9


def test_empty_table(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
