import collections
import itertools
import random

import numpy as np
import pyarrow as pa

from veritrail.llm import near_dedup as nd
from veritrail.llm import textbytes as tb
from veritrail.llm.components import components

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(4)) for _ in range(300)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def changed(t, n):
    w = t.split()
    for k in RNG.sample(range(len(w)), n):
        w[k] = RNG.choice(WORDS) + "x"
    return " ".join(w)


def bag(t):
    w = t.lower().replace(".", " ").replace("!", " ").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [(i, bag(t or "")) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(bags, 2):
        if a == b or jaccard(a, b) >= nd.SIMILARITY:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(spark):
    rows = []
    for n in (6, 40, 200, 600):
        base = text(n)
        rows += [base, base.upper() + "!", changed(base, n // 60), changed(base, n // 20), text(n)]
        chain = base
        for _ in range(6):  # near copies of near copies
            chain = changed(chain, max(1, n // 60))
            rows.append(chain)
    line = text(12)
    rows += [f"{line}. " * 30, f"{line}. " * 29, None, "", "...", "one", "One!", "two words", text(20_000)]
    RNG.shuffle(rows)
    numbered = [(k * 3, t) for k, t in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in numbered], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(numbered)


def test_hot_group_of_near_copies(spark):
    base = text(150)
    rows = [(k, changed(base, 1)) for k in range(300)] + [(300 + k, text(150)) for k in range(50)]
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got if r.doc_id < 300} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 300)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (7, "c"), (5, "c")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in nd.near_duplicate_classes(docs).collect())
    assert [(x[1], x[2]) for x in got] == [(5, 5), (5, 5), (5, 5), (7, 5), (0, None)]
    assert nd.near_duplicate_classes(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    errors = []
    for _ in range(60):
        a = text(80).split()
        b = a[: RNG.randint(20, 80)] + text(20).split()
        if RNG.random() < 0.5:
            a = a * 3  # weights above one
        ta, tb_ = " ".join(a), " ".join(b)
        keys, counts = nd.elements(*tb.text_bytes(pa.array([ta, tb_])))
        s = nd.signatures(keys, counts, 2, 512)
        errors.append((s[0] == s[1]).mean() - jaccard(bag(ta), bag(tb_)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    seen = dict(got)
    for a, b in edges:
        if a != b:
            assert seen[a] == seen[b]
    groups = collections.defaultdict(set)
    for n, c in got.items():
        groups[c].add(n)
    assert all(min(g) == c for c, g in groups.items())
    assert len(groups[100]) == 31


def test_words_are_told_apart_by_their_bytes():
    thue = "".join("xy"[bin(k).count("1") % 2] for k in range(1024))
    pair = [thue, thue.translate(str.maketrans("xy", "yx"))]
    seg = tb.words(*tb.text_bytes(pa.array([" ".join(pair), pair[0], "", "a"])))
    codes, distinct = seg.distinct()
    assert codes.tolist() == [0, 1, 0, 2] and distinct == [pair[0].encode(), pair[1].encode(), b"a"]
    assert len(set(tb.hashes(seg).tolist())) == 3
    assert nd.similarity.func(pa.array(pair[:1]), pa.array(pair[1:])).to_pylist() == [0.0]


def test_cache_forgets_but_stays_right():
    made = []

    def make(new):
        made.append(len(new))
        return np.array([[len(s)] for s in new])

    cache = tb.SegmentCache(make, limit=2_000)
    for turn in range(20):
        words = [f"w{turn % 3}{'z' * k}" for k in range(30)]
        codes, values = cache.find(tb.words(*tb.text_bytes(pa.array([" ".join(words * 2)]))))
        assert values[codes][:, 0].tolist() == [len(w) for w in words * 2]
    assert sum(made) > 90 and cache.held() <= 60


def test_group_around_the_threshold_equals_brute_force(spark):
    """Copies of one text whose similarities lie on both sides of the threshold, in buckets too large to be compared whole."""
    base, other = text(160), text(160)
    rows = [(k, changed(base, RNG.randint(1, 7))) for k in range(150)] + [(200 + k, changed(other, RNG.randint(2, 6))) for k in range(60)]
    docs = spark.createDataFrame(RNG.sample(rows, len(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in nd.near_duplicate_classes(docs).collect()}
    expected = brute_classes(rows)
    missed = sum(got[i].class_id != c for i, c in expected.items())
    assert all(expected[r.class_id] == expected[i] for i, r in got.items()) and missed <= 2
    assert len(set(expected.values())) > 5
    of = collections.Counter(r.class_id for r in got.values())
    assert all(r.links >= of[r.class_id] - 1 for r in got.values())


def test_recall_on_the_given_documents(spark):
    """All pairs of texts with an id divisible by 20 as queries: at least 0.99 of those at the threshold share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(docs).collect()}
    bags = {i: bag(t or "") for i, t in texts.items()}
    total = {i: sum(b.values()) for i, b in bags.items()}
    links = caught = 0
    for q in (i for i in texts if i % 20 == 0):
        for i, b in bags.items():
            if i != q and 0.8 * total[q] <= total[i] <= total[q] / 0.8 and jaccard(bags[q], b) >= nd.SIMILARITY:
                links += 1
                caught += got[q] == got[i]
    assert links > 5 and caught >= 0.99 * links


def test_rows_of_other_buckets_do_not_pay_for_a_large_group(spark, monkeypatch):
    """A group that the bound rules out is not compared pair by pair because many other rows share a bucket with a copy."""
    base = text(160)
    rows = [(k, changed(base, 4)) for k in range(150)]
    for k in range(300):
        other = text(40)
        rows += [(1000 + 2 * k, other), (1001 + 2 * k, other + " x")]
    made, compared, bucket_pairs, linked = [], [], nd._bucket_pairs, nd._linked

    def counted_bucket_pairs(live, tallies):
        pairs = bucket_pairs(live, tallies)
        made.append((pairs.count(), tallies.agg({"rows": "sum"}).first()[0]))
        return pairs

    def counted_linked(pairs, texts, threshold):
        compared.append(pairs.count())
        return linked(pairs, texts, threshold)

    monkeypatch.setattr(nd, "_bucket_pairs", counted_bucket_pairs)
    monkeypatch.setattr(nd, "_linked", counted_linked)
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows[:150]) | {k: k - k % 2 for k, _ in rows[150:]}
    assert made and all(pairs <= nd.PAIRS_A_ROW * of for pairs, of in made[: nd.TURNS])  # before the bound has thinned the group
    assert sum(compared[1:]) < 150 * 149 / 4
