"""What a question asks for, and which domains may answer it, row by row without a shuffle.

Concepts and frames are a small table of fixed size, so a question's words are looked up in
literal sets: the bounded common beginnings that count as a match are written out as sets
of words once, on the driver.  Every column here is an expression over one row, however
many questions there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing_values as V
from ..functions import text as T

INTENTS = list(V.INTENT_DOMAIN)
DOMAINS = list(V.DOMAIN_CATEGORY)


def no_words() -> Column:
    return F.array().cast("array<string>")


def _in(values) -> str:
    return f"in ({', '.join(repr(v) for v in values)})"


def _naming(words: str, surfaces: tuple[str, ...]) -> str:
    """SQL for the words that are one of the surfaces, lack their final s, or share a beginning that is at most three shorter."""
    long = sorted({s for s in surfaces if len(s) >= T.LEAST_PREFIX})
    exact = {*surfaces, *(s[:-1] for s in surfaces if s.endswith("s") and len(s) > 1)}
    exact |= {s[: len(s) - k] for s in long for k in range(1, T.MOST_LONGER + 1) if len(s) - k >= T.LEAST_PREFIX}
    longer = [f"substring(w, 1, length(w) - {k}) {_in(long)}" for k in range(1, T.MOST_LONGER + 1)] if long else []
    return f"filter({words}, w -> {' or '.join([f'w {_in(sorted(exact))}', *longer])})"


def naming(words: str, surfaces: tuple[str, ...]) -> Column:
    """Those of a column of words that name one of the surfaces."""
    return F.expr(_naming(words, surfaces)) if surfaces else no_words()


def _set_of(*words: str) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def _signals(words: str, normal: str) -> str:
    """SQL for concepts and frames that are found, in order: (kind, name, intent, weight, words, counts).

    A concept counts unless all of its words are ambiguous.
    """
    found = []
    for c in V.CONCEPTS:
        vague = [w for w in V.AMBIGUOUS if w in c.surfaces]
        counts = f"exists(x, w -> not w {_in(vague)})" if vague else "size(x) > 0"
        found.append(f"transform(array({_naming(words, c.surfaces)}), x -> named_struct('kind', 'concept', 'name', '{c.name}', 'intent', '{c.intent}', 'weight', {c.weight}D, 'words', x, 'counts', {counts}))[0]")
    for f in V.FRAMES:
        hits = f'filter(array_distinct(split(regexp_extract({normal}, r"{f.pattern}", 0), " ")), w -> w <> "")'
        found.append(f"transform(array({hits}), x -> named_struct('kind', 'frame', 'name', '{f.name}', 'intent', '{f.intent}', 'weight', {V.FRAME}D, 'words', x, 'counts', size(x) > 0))[0]")
    return f"filter(array({', '.join(found)}), s -> size(s.words) > 0)"


def _intent_scores(signals: str) -> str:
    """SQL for (intent, domain, score, words) of the intents that have a score, by priority."""
    of = [
        f"transform(array(filter({signals}, s -> s.intent = '{i}' and s.counts)), o -> named_struct('intent', '{i}', 'domain', '{d}', "
        "'score', aggregate(o, 0D, (a, s) -> a + s.weight), 'words', array_distinct(flatten(transform(o, s -> s.words)))))[0]"
        for i, d in V.INTENT_DOMAIN.items()
    ]
    return f"filter(array({', '.join(of)}), s -> s.score > 0)"


def _read(text: str) -> Column:
    """(n_words, signals, scores) of a text; words, signals and scores are each computed once."""
    scored = f"transform(array({_signals('q.words', 'q.normal')}), g -> named_struct('n_words', q.n, 'signals', g, 'scores', {_intent_scores('g')}))[0]"
    worded = f"transform(array(regexp_extract_all(lower(coalesce(`{text}`, '')), '([a-z0-9]+)')), a -> named_struct('n', size(a), 'words', array_distinct(a), 'normal', array_join(a, ' ')))"
    return F.expr(f"transform({worded}, q -> {scored})[0]")


def _domains_of(intent: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = no_words()
    for name, domains in table.items():
        out = F.when(intent == name, _set_of(*domains)).otherwise(out)
    return out


def with_routing(questions: DataFrame, names: tuple[str, ...] = (), text: str = "message", output: str = "routing") -> DataFrame:
    """Add a struct of intent, shape, domains, spanned, terms, vocabulary, scores, joined and trace.

    The best intent wins, ties by a fixed order; others within nine tenths of it join, one a
    domain.  A question of no intent whose only words of content are ``names`` is about the
    subject itself; one with other words is ``unknown``, as is an empty or null one.
    ``domains`` are at most three, the first the question's own; ``spanned`` are those that
    may answer without the question's words.  ``terms`` are words that decided,
    ``vocabulary`` all words that were recognised.
    """
    aliases = [n.lower() for n in names]
    terms = T.content_terms(F.col(text))
    n_own = F.size(F.filter(terms, lambda w: ~w.isin(aliases)) if aliases else terms)

    def best_of(r: Column) -> Column:
        return F.array_max(F.transform(r["scores"], lambda s, k: F.struct(s["score"].alias("score"), (-k).alias("order"), s["intent"].alias("intent"), s["words"].alias("words"))))

    def decided(r: Column, best: Column) -> Column:
        subject = best.isNull() & (r["n_words"] > 0) & (n_own == 0)
        near = F.filter(r["scores"], lambda s: (s["score"] >= best["score"] * V.JOINS_FROM) & (s["intent"] != best["intent"]) & ~s["intent"].isin(*V.NEVER_JOINS))
        alone = T.let(near, lambda n: F.filter(n, lambda s, k: F.array_position(F.transform(n, lambda o: o["domain"]), s["domain"]) == k + 1))
        intent = F.when(subject, "identity").otherwise(F.coalesce(best["intent"], F.lit(V.UNKNOWN)))
        return F.struct(intent.alias("intent"), subject.alias("subject"), alone.alias("joined"))

    def spread(d: Column) -> Column:
        also = F.transform(d["joined"], lambda s: s["domain"])
        places = F.concat(F.array(_domain_of_intent(d["intent"])), _domains_of(d["intent"], V.EXPANSION), also)
        domains = F.when(d["intent"] != V.UNKNOWN, F.slice(F.array_distinct(places), 1, 1 + V.FURTHER_DOMAINS)).otherwise(no_words())
        free = F.array_distinct(F.concat(also, _domains_of(d["intent"], {i: V.EXPANSION[i] for i in V.COMPOSITE})))
        return F.struct(domains.alias("domains"), free.alias("free"))

    def result(r: Column, best: Column, d: Column, p: Column) -> Column:
        known, flat = d["intent"] != V.UNKNOWN, lambda xs: F.flatten(F.transform(xs, lambda s: s["words"]))
        deciding = F.array_sort(F.array_distinct(F.concat(F.coalesce(best["words"], no_words()), flat(d["joined"]))))
        spanned = F.filter(p["free"], lambda x: F.array_contains(p["domains"], x) & (x != F.get(p["domains"], 0)))
        found = lambda s: F.when(s["kind"] == "frame", F.array_join(s["words"], " ")).otherwise(F.array_join(F.array_sort(s["words"]), ","))
        said = F.transform(r["signals"], lambda s: F.concat(F.when(s["counts"], s["kind"]).otherwise("uncorroborated"), F.lit(":"), s["name"], F.lit("("), found(s), F.lit(")")))
        steps = F.array(F.when(d["subject"], "fallback:subject-only"), F.when(F.size(p["domains"]) > 1, F.concat(F.lit("expansion:"), F.array_join(p["domains"], ","))), F.when(r["n_words"] == 0, "empty query"))
        return F.struct(
            d["intent"].alias("intent"),
            F.when(d["intent"].isin(*V.LIST_INTENTS), "list").otherwise("prose").alias("shape"),
            p["domains"].alias("domains"),
            F.when(known, spanned).otherwise(no_words()).alias("spanned"),
            F.when(known, deciding).otherwise(no_words()).alias("terms"),
            F.when(known, F.array_sort(F.array_distinct(flat(r["scores"])))).otherwise(no_words()).alias("vocabulary"),
            F.transform(r["scores"], lambda s: F.struct(s["intent"].alias("intent"), s["score"].alias("score"))).alias("scores"),
            F.transform(d["joined"], lambda s: F.struct(s["intent"].alias("intent"), s["domain"].alias("domain"))).alias("joined"),
            F.concat(said, F.array_compact(steps)).alias("trace"),
        )

    whole = T.let(_read(text), lambda r: T.let(best_of(r), lambda best: T.let(decided(r, best), lambda d: T.let(spread(d), lambda p: result(r, best, d, p)))))
    return questions.withColumn(output, whole)


def _domain_of_intent(intent: Column) -> Column:
    """The own domain of an intent; null for none."""
    return reduce(lambda rest, i: F.when(intent == i, V.INTENT_DOMAIN[i]).otherwise(rest), V.INTENT_DOMAIN, F.lit(None).cast("string"))


def _domain_words(domain: str) -> tuple[str, ...]:
    return tuple(s for c in V.CONCEPTS if domain in c.domains for s in c.surfaces)


def with_heading_domain(df: DataFrame, text: str = "section", output: str = "heading_domain") -> DataFrame:
    """Add the domain whose vocabulary holds the most distinct words of a heading, ties by a fixed order; ``unknown`` if none does."""
    ranks = [f"named_struct('n', size({_naming('_words', _domain_words(d) + V.HEADING_WORDS.get(d, ()))}), 'order', {-k}, 'domain', '{d}')" for k, d in enumerate(DOMAINS)]
    worded = df.withColumn("_words", F.array_distinct(T.words(F.col(text)))).withColumn("_top", F.expr(f"greatest({', '.join(ranks)})"))
    return worded.withColumn(output, F.when(F.col("_top.n") > 0, F.col("_top.domain")).otherwise(V.UNKNOWN)).drop("_words", "_top")


def with_routing_terms(df: DataFrame, domain: str, text: str = "message", output: str = "terms") -> DataFrame:
    """Add the distinct words of a text that name a domain."""
    return df.withColumn("_words", F.array_distinct(T.words(F.col(text)))).withColumn(output, naming("_words", _domain_words(domain))).drop("_words")


def framing_terms(text: Column, intent: Column) -> Column:
    """Words that ask for a description and name no subject; ``history`` does for education and experience only."""
    words = F.array_distinct(T.words(text))
    tells = F.array_contains(words, "tell") & F.array_contains(words, "about")
    history = intent.isin("education", "experience")
    return F.filter(words, lambda w: w.isin(V.OVERVIEW_WORDS) | (history & (w == "history")) | (tells & w.isin("tell", "about")))


def is_overview(text: Column, intent: Column) -> Column:
    return F.size(framing_terms(text, intent)) > 0


def is_listing(text: Column, intent: Column) -> Column:
    """Whether a question wants all of a document: by intent, and by a word that asks for a list."""
    return intent.isin(*V.WHOLE_DOCUMENT) & F.arrays_overlap(T.words(text), _set_of(*V.LIST_CUES))
