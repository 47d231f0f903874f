"""What must hold before a question is answered: vocabulary that knows its words, evidence that may speak, and is about it.

Words meet words by equi-joins on matching pairs of distinct terms; a question's blocks
are the bounded context that retrieval returned for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routing_values as V
from ..functions import text as T
from ..sources.stored import stored
from . import matching, profile, routing


def concepts(names: tuple[str, ...], text: str = "message") -> Column:
    """A question's content terms without the subject's names."""
    own = [n.lower() for n in names]
    terms = T.content_terms(F.col(text))
    return F.filter(terms, lambda w: ~w.isin(own)) if own else terms


#: The key of the whole vocabulary beside those of files and domains.
EVERYTHING = "*"


def vocabulary(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, term): distinct terms of chunks (text, keys) under each of the wanted ``keys`` (key), and of all under ``EVERYTHING``.

    Only wanted keys are spread before words are, so what is exchanged is a row for each
    key and term of a partition, not the terms of every file.
    """
    read = chunks.select(F.concat(F.array(F.lit(EVERYTHING)), F.coalesce("keys", routing.no_words())).alias("_keys"), F.array_distinct(T.tokenise(F.col("text"))).alias("_terms"))
    wanted = keys.select("key").distinct().unionByName(keys.sparkSession.createDataFrame([(EVERYTHING,)], "key string"))
    spread = read.select(F.explode("_keys").alias("key"), "_terms").join(wanted, "key", "left_semi")
    return spread.select("key", F.explode("_terms").alias("term")).distinct()


def with_support(subjects: DataFrame, chunks: DataFrame, files: DataFrame, names: tuple[str, ...] = (), text: str = "message") -> DataFrame:
    """Add ``concepts``, ``attested``, ``lexical_support``, ``documents`` and ``owners`` to routed questions.

    ``chunks`` has (text, keys) as lexical search reads it, keys null where a file has no
    category; ``files`` is the corpus profile.  A question is attested if it has no
    concept, or some concept matches the vocabulary or a word that routed it.  It has
    lexical support if some concept matches the vocabulary of the files that own the
    answer, or the whole one where those have none.  ``documents`` says whether any file
    may answer, ``owners`` whether any file owns the answer.
    """
    asked = subjects.withColumns({"concepts": concepts(names, text), "_owner": F.get(profile.contributing_keys(), 0), "_allowed": profile.allowed_keys()})
    terms = stored(asked.select("qid", "_owner", F.explode(F.array_distinct("concepts")).alias("term")), "concepts")
    words = stored(vocabulary(chunks, asked.select(F.col("_owner").alias("key")).filter("key is not null")), "vocabulary")
    pairs = matching.matching_pairs(terms.select("term"), words.filter(F.col("key") == EVERYTHING).select("term")).select(F.col("a").alias("term"), F.col("b").alias("token"))
    pairs = stored(pairs, "concept-words")
    known = terms.join(pairs.select("term").distinct(), "term", "left_semi").select("qid").distinct().withColumn("_known", F.lit(True))
    by_key = words.filter(F.col("key") != EVERYTHING).select(F.col("key").alias("_owner"), F.col("term").alias("token"))
    held = by_key.select("_owner").distinct().withColumn("_has_words", F.lit(True))
    scoped = terms.join(pairs, "term").join(by_key, ["_owner", "token"], "left_semi").select("qid").distinct().withColumn("_scoped", F.lit(True))
    present = profile.with_keys(files.select("source_file"), files).select(F.explode("keys").alias("key")).distinct()
    allowed = asked.select("qid", F.explode("_allowed").alias("key")).join(present, "key", "left_semi").select("qid").distinct().withColumn("documents", F.lit(True))
    owners = present.select(F.col("key").alias("_owner")).withColumn("owners", F.lit(True))
    rows = asked.join(known, "qid", "left").join(scoped, "qid", "left").join(allowed, "qid", "left").join(held, "_owner", "left").join(owners, "_owner", "left")
    no, routed = F.lit(False), F.exists("concepts", lambda c: T.terms_match(c, F.col("routing.vocabulary")))
    whole, inside = F.coalesce("_known", no), F.coalesce("_scoped", no)
    support = (F.size("concepts") > 0) & F.when(F.coalesce("_has_words", no), inside).otherwise(whole)
    added = {"attested": (F.size("concepts") == 0) | whole | routed, "lexical_support": support, "documents": F.coalesce("documents", no), "owners": F.coalesce("owners", no)}
    return rows.withColumns(added).drop("_owner", "_allowed", "_known", "_scoped", "_has_words")


def eligible(blocks: DataFrame, subjects: DataFrame) -> DataFrame:
    """Blocks (qid, category, keys, hostile, heading_domain, ...) that may speak to their question.

    Their file is allowed, they hold no attack, and a cross-cutting file's heading belongs
    to a routed domain or to none.
    """
    asked = subjects.select("qid", profile.allowed_keys().alias("_allowed"), F.col("routing.domains").alias("_domains"))
    met = blocks.join(asked, "qid").filter(F.arrays_overlap("keys", "_allowed") & ~F.col("hostile"))
    foreign = (F.col("category") == V.CROSS_CUTTING) & (F.col("heading_domain") != V.UNKNOWN) & ~F.array_contains("_domains", F.col("heading_domain"))
    return met.filter(~foreign).drop("_allowed", "_domains")


def with_met_terms(blocks: DataFrame, chunks: DataFrame, subjects: DataFrame, text: str = "message") -> DataFrame:
    """Add ``met``: those content terms of the question that a block's heading or text matches; ``chunks`` has (position, section, text)."""
    pairs = stored(blocks.select("qid", "position"), "asked-blocks")
    asked = subjects.join(pairs.select("qid").distinct(), "qid", "left_semi")
    asked = asked.select("qid", F.explode(F.array_distinct(T.content_terms(F.col(text)))).alias("term")).withColumn("keys", matching.asking_keys(F.col("term")))
    asked = stored(asked.groupBy("qid").agg(F.collect_list(F.struct("term", "keys")).alias("_terms"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("_asked")), "asked-keys")
    surface = chunks.select("position", F.concat_ws(" ", "section", "text").alias("said")).join(pairs.select("position").distinct(), "position", "left_semi")
    offered = stored(surface.select("position", F.array_distinct(T.content_terms(F.col("said"))).alias("words")), "block-words")
    offered = offered.select("position", matching.offered_keys(F.col("words")).alias("_offered"))
    both = pairs.join(asked, "qid").join(offered, "position").withColumn("_common", F.array_intersect("_asked", "_offered")).filter(F.size("_common") > 0)
    met = both.select("qid", "position", F.explode(F.filter("_terms", lambda t: F.arrays_overlap(t["keys"], F.col("_common")))["term"]).alias("term"))
    met = met.groupBy("qid", "position").agg(F.collect_set("term").alias("met"))
    return blocks.join(met, ["qid", "position"], "left").withColumn("met", F.coalesce("met", routing.no_words()))


def on_topic(blocks: DataFrame, subjects: DataFrame, text: str = "message") -> DataFrame:
    """Blocks (with ``met`` and ``absent``) of files that are about the question's concepts.

    A file stays whole if any of its blocks matches a concept or, unless a list is wanted,
    states that something is not on record.  Where every concept is a word that routed the
    question, its own domain's files, those it spans and cross-cutting entries of its domain
    need no match.  A question without concepts keeps all.
    """
    intent, said = F.col("routing.intent"), F.col(text)
    framing = routing.framing_terms(said, intent)
    open_concepts = T.let(framing, lambda f: F.filter("concepts", lambda c: ~F.array_contains(f, c)))
    asked = subjects.join(blocks.select("qid").distinct(), "qid", "left_semi").select(
        "qid", open_concepts.alias("_open"), routing.is_listing(said, intent).alias("_listing"), F.array_union("routing.terms", "routing.vocabulary").alias("_routed"),
        F.get("routing.domains", 0).alias("_primary"), F.concat(F.slice("routing.domains", 1, 1), F.col("routing.spanned")).alias("_free"),
        (F.size("routing.terms") > 0).alias("_decided"), "owners",
    )
    rows = blocks.join(stored(asked, "asked-concepts"), "qid")
    topical = F.exists("met", lambda t: F.array_contains("_open", t)) | (F.col("absent") & ~F.col("_listing"))
    accounted = F.col("owners") & F.col("_decided") & F.forall("_open", lambda c: T.terms_match(c, F.col("_routed")))
    entry = (F.col("category") == V.CROSS_CUTTING) & (F.col("heading_domain") == F.col("_primary"))
    own = F.arrays_overlap("keys", "_free")
    rows = rows.withColumns({"_topical": topical, "_all_routed": accounted})
    rows = rows.withColumn("_exempt", F.col("_all_routed") & (own | entry | F.col("_topical")))
    rows = rows.withColumns({"_file": F.max("_topical").over(Window.partitionBy("qid", "source_file")), "_any": F.max("_exempt").over(Window.partitionBy("qid"))})
    kept = F.when(F.size("_open") == 0, F.lit(True)).when(F.col("_any"), F.col("_exempt")).otherwise(F.col("_file"))
    return rows.filter(kept).select(blocks.columns)
