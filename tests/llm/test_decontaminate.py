import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from veritrail.llm import decontaminate as dc
from veritrail.llm.shared import BATCH_BYTES

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(3)) for _ in range(400)]


def text(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_seeds_meet_every_window():
    for gone in itertools.combinations(range(dc.WINDOW), dc.MISMATCHES):
        assert any(
            all(at + k not in gone for k, c in enumerate(seed) if c == "1") for seed in dc.SEEDS for at in range(dc.WINDOW - len(seed) + 1)
        )


def brute(docs, items):
    found = {}
    for i, t in docs:
        for j, b in items:
            width = min(len(b), 13)
            need = width - (0 if width < 7 else 1 if width < 13 else 2)
            for shift in range(-len(b) + width, len(t) - width + 1):
                same = [t[k + shift] == b[k] if 0 <= k + shift < len(t) else None for k in range(len(b))]
                for k in range(len(b) - width + 1):
                    part = same[k : k + width]
                    if None not in part and sum(part) >= need:
                        best = (sum(x is True for x in same), -(shift + k))
                        found[i, j] = max(found.get((i, j), best), best)
                        break
    return {(i, j, -s, m) for (i, j), (m, s) in found.items()}


def test_leaks_equal_brute_force(spark):
    items = [(k, text(n)) for k, n in enumerate([15, 20, 40, 13, 12, 7, 4, 60, 5, 6, 8, 9, 10, 11, 1])]
    docs = [(k, text(50)) for k in range(10)]
    for k, (_, b) in enumerate(items):
        hurt = list(b)
        for at in range(3, len(b), 6):
            hurt[at] = "zzz"
        docs += [(100 + k, text(9) + b + text(9)), (200 + k, hurt + text(5)), (300 + k, text(3) + b[: len(b) // 2]), (400 + k, text(30) + b[2:15] + text(4))]
    for k, (_, b) in enumerate(items):
        if 5 <= len(b) < 13:
            for at in range(len(b)):
                docs.append((1000 + 20 * k + at, text(6) + b[:at] + ["zzz"] + b[at + 1 :] + text(6)))
            docs.append((1500 + k, text(6) + ["zzz"] + b[1:-1] + ["zzz"] + text(6)))
    docs += [(700 + k, b) for k, (_, b) in enumerate(items)] + [(800, items[6][1] + items[14][1])]
    docs += [(500, text(20_000) + items[2][1]), (501, items[0][1] * 3)]
    lines = [(i, " ".join(t).capitalize() + ".", "x") for i, t in docs] + [(600, None, "x"), (601, "", "x"), (None, " ".join(items[0][1]), "x")]
    table = spark.createDataFrame(lines + lines[:12], "doc_id long, text string, words string")
    bench = spark.createDataFrame([(j, ", ".join(b)) for j, b in items] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.matched) for r in dc.find_leaks(table, bench).collect()}
    assert got == brute(docs, items)
    assert dc.find_leaks(table.limit(0), bench).count() == 0
    assert dc.find_leaks(table, bench.limit(0)).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and last.filter(~F.col("round_trip")).count() == 0
    assert 100 < kept.count() < docs.count()
    assert corpus_pipeline.run(spark, sf).count() == kept.count()
    leaks = dc.find_leaks(kept, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert leaks.count() == 0


def test_stages_take_empty_tables_and_nulls(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert stage(spark, odd, sf).count() >= 1, name


def test_repeated_and_null_ids_lose_only_copies(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    said = [" ".join(RNG.choice(WORDS) for _ in range(60)) for _ in range(5)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(7, said[0]), (7, said[1]), (7, said[1]), (3, said[1]), (None, said[2]), (None, said[2]), (None, said[3]), (9, said[3]), (None, item), (8, said[4])]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    once = corpus_pipeline.one_of_each(spark, odd, sf)
    assert once.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in once.collect()), key=repr)
    assert kept == sorted([(7, said[0]), (3, said[1]), (None, said[2]), (9, said[3]), (None, item), (8, said[4])], key=repr)
    assert (None, item) not in {(r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, once, sf).collect()}


def test_stages_hand_long_texts_over_in_bounded_batches(spark):
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 3000).alias("text"))
    corpus_pipeline.STAGES[-1][1](spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])

    got = docs.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.size for r in got) < 2 * BATCH_BYTES
