import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import kneser_ney as kn
from veritrail.llm import language_id, toxicity

ORDER = 3


def brute(words, order, shared):
    """Interpolated Kneser-Ney by dictionaries; words is a list of (class, word, n)."""
    pad = kn._START * (order - 1)
    tables = {order: collections.Counter()}
    for c, w, n in words:
        s = pad + w + kn._END
        for i in range(len(w) + 1):
            tables[order][c, s[i : i + order]] += n
    for m in range(order - 1, 0, -1):
        source = {(0 if m <= shared else c, g) for c, g in tables[m + 1]}
        tables[m] = collections.Counter((c, g[1:]) for c, g in source)

    def prob(c, context, w, m):
        if m == 0:
            return 1e-6
        own = 0 if m <= shared else c
        mine = {g: n for (k, g), n in tables[m].items() if k == own}
        once, twice = (sum(n == x for n in mine.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        h = context[len(context) - m + 1 :]
        following = {g: n for g, n in mine.items() if g[:-1] == h}
        total = sum(following.values())
        lower = prob(c, context, w, m - 1)
        if not total:
            return lower
        return max(following.get(h + w, 0) - d, 0) / total + d * len(following) / total * lower

    def score(c, word):
        s = pad + word + kn._END
        return sum(np.log(prob(c, s[i : i + order - 1], s[i + order - 1], order)) for i in range(len(word) + 1))

    return score


@pytest.mark.parametrize("shared", [0, 2])
def test_scores_equal_brute_force(spark, shared):
    rng = random.Random(4)
    words = {(c, "".join(rng.choice("abcé" if c else "abd") for _ in range(rng.randint(1, 5)))): rng.randint(1, 3) for _ in range(60) for c in (0, 1)}
    rows = [(c, w, n) for (c, w), n in words.items()]
    model = kn.train(spark.createDataFrame(rows, "cls int, word string, n long"), ORDER, 30, 2, shared)
    score = brute(rows, ORDER, shared)
    asked = sorted({w for _, w, _ in rows})[:20] + ["zzz", "a" * 40]
    got = model.word_scores([w.encode() for w in asked])
    for k, w in enumerate(asked):
        assert got[k, :2] == pytest.approx([score(0, w), score(1, w)], rel=1e-4)
        assert got[k, 2] == len(w) + 1


def test_word_counts_are_whole(spark):
    rows = [(0, "a b a"), (1, "a"), (0, ""), (0, "é " * 5000 + "b")]
    got = {(r.cls, r.word): r.n for r in kn.word_counts(spark.createDataFrame(rows, "cls int, norm string")).collect()}
    assert got == {(0, "a"): 2, (0, "b"): 2, (1, "a"): 1, (0, "é"): 5000}


def toxic_tables(spark, n=400):
    rng = random.Random(1)
    plain = ["house", "river", "stone", "light", "green", "walk", "paper", "cloud"]
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [rng.choice(plain) for _ in range(60)]
        if bad:
            for at in (5, 30, 50):
                words[at] = rng.choice(["idiot", "moron"])
        docs.append((k, " ".join(words).capitalize() + "."))
        labels.append((k, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_separates_and_takes_any_row(spark):
    docs, labels = toxic_tables(spark)
    fitted = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "!!!", "x"), (2, "you moron " + "river " * 40, "y"), (3, "stone " * 30000, None)], "doc_id long, text string, toxicity string")
    got = toxicity.with_toxicity(docs.join(labels, "doc_id"), fitted).collect()
    assert np.mean([(r.toxicity >= 0.5) == bool(r.toxic) for r in got]) > 0.98
    odds = toxicity.with_toxicity(odd, fitted).collect()
    assert [0 <= r.toxicity <= 1 for r in odds] == [True] * 5
    assert odds[0].toxicity == odds[1].toxicity == odds[2].toxicity < odds[3].toxicity


def test_toxicity_ranks_held_out_rows_whatever_rows_fit_it(spark):
    docs, labels = toxic_tables(spark, 600)
    fifth = F.floor(toxicity.fold(F.col("doc_id")) / 4) % 5 == 0
    kept = {"no row to fit": ~fifth, "none toxic to fit": ~fifth | (F.col("toxic") == 0), "toxic rows in that fifth alone": fifth | (F.col("toxic") == 0), "a class in each part": fifth == (F.col("toxic") == 1)}
    for case, rows in kept.items():
        for toxic in ("toxic", "1 - toxic as toxic"):
            given = labels.filter(rows).selectExpr("doc_id", toxic)
            scored = toxicity.with_toxicity(docs, toxicity.fit(docs, given), output="score").join(labels.selectExpr("doc_id", toxic), "doc_id")
            held = scored.filter(toxicity.fold(F.col("doc_id")) % 4 == 2).select("toxic", "score").collect()
            low, high = (np.array([r.score for r in held if r.toxic == c]) for c in (0, 1))
            assert (high[:, None] > low).mean() > 0.95, (case, toxic)


def test_toxicity_without_rows(spark):
    docs, labels = toxic_tables(spark, 8)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert [r.toxicity for r in toxicity.with_toxicity(docs, None).collect()] == [0.0] * 8
    for only in (0, 1):
        fitted = toxicity.fit(docs, labels.selectExpr("doc_id", f"{only} as toxic").union(labels.selectExpr("null", "1")))
        assert toxicity.with_toxicity(docs.limit(0), fitted).count() == 0
        assert all(0 <= r.toxicity <= 1 for r in toxicity.with_toxicity(docs, fitted).collect())


def test_language(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ta", "ki", "mo", "sur"], "bb": ["zsch", "pfo", "ueb", "ing"]}
    rows = [(k, "".join(rng.choice(sounds[lang]) + rng.choice(["", " "]) for _ in range(80)), lang) for k, lang in enumerate(["aa", "bb"] * 150)]
    docs = spark.createDataFrame([*rows, (None, "ta ki", "aa"), (900, "ta", None), (901, None, "aa")], "doc_id long, text string, lang string")
    fitted = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.with_language(docs, fitted).collect()}
    assert all(got[k].language.lang == lang and not got[k].language.rejected for k, _, lang in rows)
    assert got[901].language.lang == "und" and got[901].language.score == 0
    odd = spark.createDataFrame([("",), ("123 ?!",), ("汉字" * 200,), ("TAKIMO surki " * 3000,)], "text string")
    und, digits, foreign, long_text = (r.language for r in language_id.with_language(odd, fitted).collect())
    assert und.lang == digits.lang == "und" and und.rejected and foreign.rejected
    assert long_text.lang == "aa" and not long_text.rejected
    assert language_id.fit(docs.limit(0)) is None
    assert {r.language.lang for r in language_id.with_language(docs, None).collect()} == {"und"}


def test_every_gram_and_context_keeps_its_own_key(spark):
    rng = random.Random(6)
    words = ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(12)) for _ in range(5_000)]
    rows = [(k, " ".join(words[at : at + 50]), "aa", at // 50 % 2) for k, at in enumerate(range(0, len(words), 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    marked = docs.select("doc_id", (toxicity.fold(F.col("doc_id")) % 4 != 2).alias("known"), (F.floor(toxicity.fold(F.col("doc_id")) / 4) % 5 == 0).alias("calibrates"), F.xxhash64("doc_id").alias("place")).collect()
    drawn = {r.doc_id for r in sorted((r for r in marked if r.known and r.calibrates), key=lambda r: r.place)[:3]}

    def distinct(counted, m):
        padded = [kn._START * 4 + w + kn._END for k in counted for w in rows[k][1].split()]
        ends = [p[: i + 1] for p in padded for i in range(4, len(p))]
        return len({e[-m:] for e in ends}), len({e[-m:-1] for e in ends})

    models = (
        (language_id.fit(docs).model, [r.doc_id for r in marked if r.known]),
        (toxicity.fit(docs, docs).model, [r.doc_id for r in marked if r.known and not r.calibrates]),
        (toxicity.fit(docs, docs, calibration_rows=3).model, [r.doc_id for r in marked if r.known and r.doc_id not in drawn]),
    )
    for model, counted in models:
        for m in (4, 5):
            assert (len(model.levels[m - 1].keys), len(model.levels[m - 1].contexts)) == distinct(counted, m)


def test_languages_of_held_out_rows_are_unknown(spark):
    rows = [(k, "ta ki mo sur ta ki", "aa") for k in range(60)]
    held = {r.doc_id for r in spark.range(400).withColumnRenamed("id", "doc_id").filter(toxicity.fold(F.col("doc_id")) % 4 == 2).collect()}
    foreign = [(k, "汉字汉字 字汉", "zz") for k in range(100, 400) if k in held]
    docs = spark.createDataFrame([*rows, *foreign], "doc_id long, text string, lang string")
    fitted = language_id.fit(docs)
    assert fitted.languages == ["aa"]
    got = language_id.with_language(docs.withColumn("language", F.lit(1)), fitted).filter("lang = 'zz'").collect()
    assert got and all(r.language.rejected for r in got)
    only = docs.filter("lang = 'zz'")
    assert language_id.fit(only) is None
    assert {r.language.lang for r in language_id.with_language(only, language_id.fit(only)).collect()} == {"und"}


def test_rejection_is_chosen_on_texts_out_of_the_counts(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ta", "ki", "mo", "sur"], "bb": ["zsch", "pfo", "ueb", "ing"], "cc": ["vle", "dra", "nyo", "hax"]}

    def said(lang, words):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))

    docs = spark.createDataFrame([(k, said(lang, 60), lang) for k, lang in enumerate(["aa", "bb"] * 300)], "doc_id long, text string, lang string")
    fitted = language_id.fit(docs)
    assert len(fitted.levels) == 3 and (fitted.kept > 0.97).all() and (fitted.caught > 0.97).all()
    cases = [(lang, n, said(lang, n)) for lang in sounds for n in (8, 20, 200) for _ in range(40)]
    got = language_id.with_language(spark.createDataFrame(cases, "truth string, n int, text string"), fitted).collect()
    for n in (8, 20, 200):
        assert np.mean([r.language.rejected for r in got if r.n == n and r.truth == "cc"]) > 0.9
        assert np.mean([r.language.rejected for r in got if r.n == n and r.truth != "cc"]) < 0.05


def test_language_normalises_texts_only_where_words_are_read(spark, monkeypatch):
    """Of the plans whose words are read each makes them once, and the one that counts texts by language makes none."""
    plans, counted, collect = {}, kn.word_counts, type(spark.range(1)).collect

    def planned(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    def counted_words(df):
        plans["words"] = planned(df)
        return counted(df)

    def collected(df):
        plans.setdefault("languages", planned(df))
        return collect(df)

    monkeypatch.setattr(kn, "word_counts", counted_words)
    monkeypatch.setattr(type(spark.range(1)), "collect", collected)
    docs = spark.createDataFrame([(k, "ta ki mo sur", "aa") for k in range(200)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).languages == ["aa"]
    assert plans == {"words": 1, "languages": 0}


def test_has_words_where_normal_words_are_not_empty(spark):
    codes = spark.range(0x110000).filter("id not between 55296 and 57343")
    utf16 = F.when(F.col("id") < 0x10000, F.format_string("%04x", "id")).otherwise(
        F.format_string("%04x%04x", F.lit(0xD800) + F.shiftright(F.col("id") - 0x10000, 10), F.lit(0xDC00) + (F.col("id") - 0x10000) % 1024)
    )
    texts = codes.select(F.decode(F.unhex(utf16), "UTF-16BE").alias("text")).unionByName(spark.createDataFrame([(None,), ("",), ("1 2",), ("1\u0301",)], "text string"))
    words = kn.normal_words(F.col("text"), language_id.WORD) != ""
    got = texts.agg(F.count_if(words).alias("some"), F.count_if(language_id.has_words(F.col("text")) != words).alias("wrong"), F.countDistinct("text").alias("texts")).first()
    assert got.some > 100_000 and got.wrong == 0 and got.texts > 1_111_000
