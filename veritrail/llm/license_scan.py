"""Licence notices in texts by Dice similarity to templates, with Spark expressions only.

A text is looked at as lines, sentences, paragraphs and a whole.  Each unit's words give
a set of bigrams; a template of t bigrams can only reach a Dice coefficient d with a unit
of d/(2-d)*t to (2-d)/d*t bigrams, so units are joined to templates by that size alone
and compared with the few that remain.  A licence that no unit resembles is also sought
in every run of as many words as its template, across lines and sentences.  Such a run
holds two thirds of the template's bigrams at least (at 0.8), so only the few texts that
do, close enough together, are compared run by run.

Defined results: null, empty and one-word units have no bigrams and match nothing;
repeated rows of an id count once; of templates of one licence the best match is
reported; rows with a null id are reported together under the null id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kneser_ney import normal_words
from .shared import BROADCAST_ROWS, stored

DICE = 0.8
#: Words that a text is searched for before it is cut into units; with more of them every text is cut.
ANCHORS = 500
#: From so many letters on a word alone is searched for.
LONG_WORD = 5
#: What words are made of, as in ``normal_words``.
LETTERS = r"\p{L}\p{M}\p{N}"
#: Public licence statements and notices, as (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, template string")


def units(text: Column) -> Column:
    """The distinct whole, lines, sentences and paragraphs of a text; the whole comes first."""
    lines = F.split(text, "\n", -1)
    sentences = F.split(text, "\n|[.!?]+\\s+", -1)
    paragraphs = F.split(text, "\n\\s*\n", -1)
    return F.array_distinct(F.concat(F.array(text), lines, sentences, paragraphs))


def _bigrams(words: str) -> Column:
    """The distinct bigrams of a column of words; by name, so that no expression is computed anew for every bigram."""
    return F.when(F.size(words) > 1, F.array_distinct(_pairs(words))).otherwise(F.array().cast("array<long>"))


def _pairs(words: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1)))


def _in_runs(near: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, license, unit, dice) of the runs of ``size`` bigrams of whole texts that resemble a template of at least ``need`` common bigrams."""
    texts = near.withColumn("words", F.split(normal_words(F.col("unit")), " ")).drop("u")
    # written out, for a filter pushed below the projection would normalise the text anew for every bigram
    pairs = stored(texts.withColumn("b", _pairs("words")).drop("words", "unit"), "licence-runs")
    marked = pairs.withColumn("at", F.filter(F.transform("b", lambda x, i: F.when(F.array_contains("t", x), i)), lambda i: i.isNotNull()))
    # the k-th common bigram and the need-th from it must fit into one run: its start is between the two bounds
    last = F.size("b") - F.col("size")
    ends = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda k: F.struct(F.get("at", k).alias("a"), F.get("at", k + F.col("need") - 1).alias("z")))
    close = F.filter(ends, lambda e: e["z"] - e["a"] < F.col("size"))
    starts = F.transform(close, lambda e: F.sequence(F.greatest(e["z"] - F.col("size") + 1, F.lit(0)), e["a"]))
    found = marked.filter((F.size("at") >= F.col("need")) & (last >= 0)).withColumn("starts", F.array_distinct(F.flatten(starts)))
    runs = found.select("doc_id", "license", "nt", "t", F.explode("starts").alias("i"), "b", "size").filter(F.col("i") <= F.size("b") - F.col("size"))
    runs = runs.select("doc_id", "license", "nt", "t", "i", F.array_distinct(F.slice("b", F.col("i") + 1, F.col("size"))).alias("u"))
    dice = 2.0 * F.size(F.array_intersect("u", "t")) / (F.size("u") + F.col("nt"))
    return runs.select("doc_id", "license", F.concat(F.lit("run "), F.col("i")).alias("unit"), dice.alias("dice")).filter(F.col("dice") >= threshold)


def _anchors(given: DataFrame, threshold: float) -> tuple[list[str], list[str]]:
    """Words, and pairs of short words, of which every text that resembles a template, or holds a run that does, has one at least.

    A match shares ``need`` of a template's distinct bigrams, so it has one of any
    ``nt - need + 1`` of them; taken are those whose longer word is longest.  That word
    stands for the bigram unless it is short, when both do, as a pattern.
    """
    first, second = (lambda i: F.element_at("words", i)), (lambda i: F.element_at("words", i + 1))
    longer = lambda i: F.when(F.length(first(i)) >= F.length(second(i)), first(i)).otherwise(second(i))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.length(longer(i)).alias("n"), longer(i).alias("w"), F.concat(first(i), F.lit(f"[^{LETTERS}]+"), second(i)).alias("b")))
    ranked = given.select(F.slice(F.sort_array(F.array_distinct(pairs), asc=False), 1, F.col("nt") - F.col("need") + 1).alias("r")).select(F.inline("r")).distinct()
    taken = ranked.collect()  # at most the bigrams of the templates
    return sorted({r["w"] for r in taken if r["n"] >= LONG_WORD}), sorted({r["b"] for r in taken if r["n"] < LONG_WORD})


def scan_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = DICE) -> DataFrame:
    """(doc_id, license, dice, units) of every licence whose template some unit of a text resembles, else some run of words.

    ``units`` counts the units, and is 1 for a licence found in runs only.
    ``known`` has (license, template).  Templates, spread over the sizes they can meet, are
    broadcast while they are at most ``BROADCAST_ROWS`` rows.
    """
    given = known.dropna().select("license", F.split(normal_words(F.col("template")), " ").alias("words"))
    given = given.select("license", "words", F.size("words").alias("nw"), _bigrams("words").alias("t")).withColumn("nt", F.size("t")).filter("nt > 0")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sized = given.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col("nt") * low).cast("int")), F.ceil(F.col("nt") * high).cast("int"))))
    given = given.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("nt") * low - 1e-9).cast("int")))
    given = stored(given, "licence-templates")
    long, short = _anchors(given, threshold)
    bounds = sized.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    common = given.agg(F.array_join(F.array_distinct(F.flatten(F.collect_list("t"))), ","), F.min("need")).first()
    # size 0 stands for a whole text that holds enough of the templates' bigrams to be looked at in runs
    keys = sized.select("license", "t", "nt", F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("need"), "n")
    keys = keys.unionByName(given.select("license", "t", "nt", (F.col("nw") - 1).alias("size"), "need", F.lit(0).alias("n")))
    likely = F.lit(True)
    if len(long) + len(short) <= ANCHORS:  # in a lambda, so that a text is lowered once
        found = lambda t: reduce(lambda a, w: a | F.contains(t, F.lit(w)), long, F.lit(False))
        pairs = "|".join(short)
        likely = F.exists(F.array(F.lower(F.col(text))), lambda t: found(t) | t.rlike(pairs) if short else found(t))
    parts = docs.filter(likely).select(F.col(doc_id).alias("doc_id"), F.posexplode(units(F.col(text))).alias("pos", "unit")).filter(F.length("unit") > 2 * (bounds[0] or 0))
    words = parts.select("doc_id", "pos", "unit", F.split(normal_words(F.col("unit")), " ").alias("words")).filter(F.size("words") > (bounds[0] or 0))
    sets = words.select("doc_id", "pos", "unit", _bigrams("words").alias("u")).withColumn("own", F.coalesce(F.size("u"), F.lit(0)))
    all_of = F.split(F.lit(common[0] or "0"), ",").cast("array<bigint>")
    in_runs = (F.col("pos") == 0) & (F.size(F.array_intersect("u", all_of)) >= (common[1] or 1))
    sets = sets.select("doc_id", "unit", "u", F.explode(F.when(in_runs, F.array("own", F.lit(0))).otherwise(F.array("own"))).alias("n"))
    met = sets.join(F.broadcast(keys) if bounds[2] <= BROADCAST_ROWS else keys, "n")
    shared = met.withColumn("shared", F.size(F.array_intersect("u", "t")))
    dice = 2.0 * F.col("shared") / (F.col("n") + F.col("nt"))
    likely = shared.filter(F.when(F.col("n") == 0, F.col("shared") >= F.col("need")).otherwise(dice >= threshold))
    likely = stored(likely.select("doc_id", "license", "n", "nt", "t", "size", "need", dice.alias("dice"), "unit"), "licence-units")
    whole = likely.filter("n > 0").select("doc_id", "license", "unit", "dice")
    runs = _in_runs(likely.filter("n = 0").drop("dice"), threshold)
    found = whole.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("units"))
    others = runs.groupBy("doc_id", "license").agg(F.max("dice").alias("dice")).withColumn("units", F.lit(1).cast("long"))
    again = (others["doc_id"].eqNullSafe(found["doc_id"])) & (others["license"] == found["license"])
    return found.unionByName(others.join(found, again, "left_anti"))
