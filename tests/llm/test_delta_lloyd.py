import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from veritrail.llm import delta_lloyd, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Plain Lloyd rounds in Python integers over rows (vec_id, embedding, label)."""
    top = delta_lloyd.LARGEST
    kept = [(i, [min(max(math.floor(4096 * x), -top), top) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cut = [[r[1][p * width // 8 : (p + 1) * width // 8] for p in range(8)] for r in kept]
    books = [[v[p] for v in cut[:16]] for p in range(8)]

    def assign(p, part):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(6):
        for p in range(8):
            given = [assign(p, v[p])[0] for v in cut]
            for e in range(len(books[p])):
                own = [v[p] for v, g in zip(cut, given) if g == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [[assign(p, v[p]) for p in range(8)] for v in cut]
    errors, by_label = [sum(g for _, g in f) for f in final], {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for k, _ in f), e, by_label[y], digest) for (i, _, y), f, e in zip(kept, final, errors)]


def asked(spark, folder):
    return sorted((tuple(r[c] for c in "vec_id code error label_error codebooks_sha256".split()) for r in queries.op13_delta_lloyd(spark, folder).collect()), key=repr)


def given(spark, tmp_path, rows, schema=SCHEMA):
    folder = f"{tmp_path}/{random.random()}"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    assert asked(spark, sf) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 90])
def test_small_tables_ties_and_bad_rows(spark, tmp_path, n):
    draw = random.Random(n)
    rows = [(draw.randrange(n), [float(np.float32(draw.choice([-1.5, 0.0, 0.1, 7e7, -3e38]) * draw.random())) for _ in range(16)], draw.choice([None, 1, 2])) for _ in range(n)]
    rows += rows[: n // 3]
    bad = [(-5, None, 1), (-4, [], 1), (-3, [None] * 16, 1), (-2, [float("nan")] * 16, 1), (-1, [1.0] * 15 + [float("inf")], None), (10**6, [1.0] * 8, 2)]
    bad += [(None, [0.5] * 16, None)] if n else []
    both = rows + bad[: 5 if not n else None]
    draw.shuffle(both)
    assert asked(spark, given(spark, tmp_path, both)) == sorted(brute(both), key=repr)


def test_clashing_columns_and_codes_decode(spark, tmp_path):
    rows = [(k, [float(np.float32(math.sin(k * j))) for j in range(16)], k % 3) for k in range(60)]
    wide = given(spark, tmp_path, [(*r, 1, "c", 2, "d") for r in rows], SCHEMA + ", row long, code string, error long, delta string")
    assert asked(spark, wide) == sorted(brute(rows), key=repr)
    kept = delta_lloyd.kept_vectors(spark.createDataFrame(rows, SCHEMA))
    books = delta_lloyd.train(kept)
    coded = delta_lloyd.with_codes(kept, books).collect()
    gaps = (delta_lloyd.decode([r.code for r in coded], books) - np.array([r.vec for r in coded])) ** 2
    assert gaps.sum(axis=1).tolist() == [r.error for r in coded]


def test_only_moved_parts_contribute():
    vectors = np.array([[[1, 2], [3, 4]], [[5, 6], [7, 8]]])
    was, now = np.array([[0, 1], [1, 1]]), np.array([[0, 0], [1, 1]])
    assert delta_lloyd.contributions(vectors, was, now, 2) == [
        {"part": 1, "entry": 0, "count": 1, "sums": [3, 4]},
        {"part": 1, "entry": 1, "count": -1, "sums": [-3, -4]},
    ]
    assert delta_lloyd.contributions(vectors, now, now, 2) == []


def test_rounds_move_no_vectors(spark, tmp_path):
    """Vectors and their previous assignments meet bucket by bucket, without an exchange."""
    rows = spark.createDataFrame([(k, [float(k), 1.0] * 8, 0) for k in range(50)], SCHEMA)
    numbered = delta_lloyd.kept_vectors(rows).select(delta_lloyd.F.monotonically_increasing_id().alias("row"), "vec")
    book = np.arange(8 * 4 * 2).reshape(8, 4, 2)
    with delta_lloyd.bucketed(spark, 4) as put:
        held = put(numbered.repartition(4, "row"))
        before = put(delta_lloyd._assigned(held, None, book))
        plan = delta_lloyd._assigned(held, before, book)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({queries.OP13_SQL})").fetchall(), key=repr) == asked(spark, sf)
