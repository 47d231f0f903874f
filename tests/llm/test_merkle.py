import hashlib
import random
import zlib

import duckdb
import pytest

from veritrail.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row):
    return sha("".join(map(value, row)))


def climb(level):
    """All levels of one tree, from the leaves to the node that is left."""
    levels = [level]
    while len(level) > 1:
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        levels.append(level)
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 8 * 8
        yield level[run:i], level[i + 1 : run + 8]
        i //= 8


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            steps = [*siblings(trees[g], i), *siblings(top, k)]
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            text = row[4] if row[4] is None or not bad else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            now = leaf_of((*row[:4], text))
            for before, after in steps:
                now = sha("".join(before) + now + "".join(after))
            root = top[-1][0]
            proof = sha("".join("".join(b + a) for b, a in steps))
            yield (row[0], leaf_of(row), trees[g][-1][0], root, proof, now, now == root)


def asked(df):
    return sorted((tuple(r[c] for c in "doc_id leaf subroot root proof_sha256 folded_root verified".split()) for r in df.collect()), key=repr)


def given(spark, tmp_path, rows, schema=SCHEMA):
    folder = f"{tmp_path}/{random.random()}"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{sf}/documents.parquet'").fetchall()
    got = asked(queries.op12_merkle(spark, sf))
    assert got == sorted(brute(rows), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 1, 0], [65, 2, 64, 1, 8, 7, 9, 3, 5, 1], [520, 73]])
def test_tree_shapes(spark, tmp_path, sizes):
    langs = [None, "", "de", "en", "é", "z", "a", "b", "c", "d"]
    rows = [(100 * k + i, f"s{i}", langs[k], i, f"Text {i} É") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert asked(queries.op12_merkle(spark, given(spark, tmp_path, rows))) == sorted(brute(rows), key=repr)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 3, ""), (5, "s", "en", 3, ""), (5, "s", "en", 3, "ABC" * 30000), (7, "s", None, 1, "É"), (-9, "", "", 0, "A")]
    schema = SCHEMA + ", tree string, n long, i long, path string, level int, digest string, _tie long"
    folder = given(spark, tmp_path, [(*r, "t", 1, 2, "p", 3, "d", 4) for r in rows], schema)
    assert asked(queries.op12_merkle(spark, folder)) == sorted(brute(rows), key=repr)


def test_empty_table(spark, tmp_path):
    assert queries.op12_merkle(spark, given(spark, tmp_path, [])).count() == 0


def test_scattered_leaves_resolve_by_frontiers(spark):
    leaves = [("=x", 700, i, sha(str(i))) for i in range(700)]
    random.Random(2).shuffle(leaves)
    df = spark.createDataFrame(leaves, "tree string, n long, i long, digest string").repartition(7)
    found = {(r.level, r.i): r.digest for r in merkle.parents(df, 700).collect()}
    levels = climb([sha(str(i)) for i in range(700)])
    assert found == {(k, i): d for k, level in enumerate(levels) if k for i, d in enumerate(level)}


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({queries.OP12_SQL})").fetchall(), key=repr) == asked(queries.op12_merkle(spark, sf))
