"""Answers from retrieved blocks: every gate, every way to choose statements, every shape.

The statements of a question's blocks, at most a context full of them, come together in
one array by a single exchange.  Each way to choose is a fold over that array which leaves
out what repeats an earlier choice; ways are tried in order until one yields something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing_values as V
from ..functions import statement_values as S
from ..functions import text as T
from ..operators import context, evidence, gates, matching, profile, routing, selection
from ..sources.stored import stored

#: Budgets of a plain answer, a list and a journey, blocks searched for an opening, clauses of prose, statements looked through for each that a list or an opening may have.
FOCUSED, LISTED, JOURNEY, OPENINGS, CLAUSES, SPARE = 5, 9, 12, 5, 3, 6
PEAK_FLOOR, LEAST_CHARS, CLIP = 1.6, 12, 320
#: Why a question is not answered.
NO_INTENT, UNKNOWN_PROJECT, NO_DOCUMENTS, NO_EVIDENCE, NOT_ATTESTED, OFF_SUBJECT, NO_STATEMENT = "no_intent", "unknown_project", "no_documents", "no_evidence", "not_attested", "off_subject", "no_statement"


def described(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks (position, source_file, section, text) with category, keys, heading_domain, hostile, units and absent; call it on those that were retrieved."""
    keyed = routing.with_heading_domain(profile.with_keys(chunks, files), "section")
    judged = evidence.with_evidence_units(context.with_context(keyed).drop("safe_text", "triggers"))
    return judged.withColumn("absent", F.exists("units", lambda u: T.is_negative_evidence(u["text"])))


def statements(blocks: DataFrame, known: DataFrame, subjects: DataFrame, weights: DataFrame, text: str = "message") -> DataFrame:
    """(qid, item) of the statements that may be quoted; ``item`` starts with what orders statements in their documents.

    ``blocks`` names the chunks of ``known`` (``described``) that speak to each question,
    ``weights`` has (term, idf).  A statement scores the weights of its words that match the
    question's; its rare terms are those that restating is judged by.
    """
    held = known.join(blocks.select("position").distinct(), "position", "left_semi")
    units = held.select("position", "section", F.posexplode("units").alias("n", "u"))
    said = units.select("position", "n", "section", F.col("u.text").alias("s"), F.col("u.prompt").alias("prompt"), F.col("u.is_list_item").alias("is_list_item"))
    whole = F.concat_ws(" ", "prompt", "s")
    read = said.filter(~S.is_meta_section(F.col("section")) & T.is_answerable(F.col("s"))).withColumns(
        {"negative": T.is_negative_evidence(F.col("s")), "terms": F.array_distinct(T.content_terms(whole)), "surface": F.array_distinct(T.content_terms(F.concat(F.col("section"), F.lit(" "), whole)))}
    )
    long_enough = (F.length(F.trim("s")) >= LEAST_CHARS) | F.col("is_list_item") | F.col("s").rlike(r"\p{Nd}")
    read = read.filter((~S.continues(F.col("s")) | F.col("negative")) & ~S.is_third_party(F.col("s")) & long_enough & (F.size("terms") > 0))
    rare = read.select("position", "n", F.explode("terms").alias("term")).join(weights.filter(F.col("idf") >= PEAK_FLOOR).select("term"), "term", "left_semi")
    rare = rare.groupBy("position", "n").agg(F.collect_set("term").alias("rare"))
    asked = subjects.select("qid", F.explode(F.array_distinct(F.filter(T.content_terms(F.col(text)), lambda t: ~profile.is_part_of_name(t, F.col("project"))))).alias("term"))
    tokens = read.select("position", "n", F.explode("surface").alias("token"))
    pairs = matching.matching_pairs(asked.select("term"), tokens.select(F.col("token").alias("term"))).select(F.col("a").alias("term"), F.col("b").alias("token"))
    wanted = asked.join(pairs, "term").select("qid", "token").distinct().join(weights.select(F.col("term").alias("token"), "idf"), "token")
    own = blocks.select("qid", "position", "source_file", "category", "heading_domain")
    scored = own.select("qid", "position").join(tokens, "position").join(wanted, ["qid", "token"]).groupBy("qid", "position", "n").agg(F.sum("idf").alias("score"), F.max("idf").alias("peak"))
    concepts = subjects.select("qid", "concepts")
    rows = own.join(read, "position").join(concepts, "qid").join(rare, ["position", "n"], "left").join(scored, ["qid", "position", "n"], "left")

    def matches(words: Column) -> Column:
        return F.exists("concepts", lambda c: T.terms_match(c, words))

    prompted, labelled = T.content_terms(F.col("prompt")), T.content_terms(F.substring_index("s", ":", 1))
    elsewhere = F.col("prompt").isNotNull() & F.col("negative") & (F.size(prompted) > 0) & ~matches(prompted)
    unasked = S.is_opaque_id(F.col("s")) & ~matches(labelled)
    kind = F.when(S.is_field(F.col("s")), 2).when(F.col("is_list_item"), 0).otherwise(1)
    item = F.struct(
        "source_file", "position", "n", T.clip(F.trim("s"), CLIP).alias("s"), "terms", F.coalesce("rare", routing.no_words()).alias("rare"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
        F.round(F.coalesce("peak", F.lit(0.0)), 9).alias("peak"), "negative", kind.alias("kind"), S.is_milestone(F.col("s"), F.col("is_list_item")).alias("milestone"), "category", "heading_domain",
        T.citation(F.col("source_file"), F.col("section")).alias("citation"),
    )
    return rows.filter(~elsewhere & ~unasked).select("qid", item.alias("item"))


def _same_subject(x: Column, y: Column) -> Column:
    return selection.jaccard(x["terms"], y["terms"]) >= selection.SAME_SHARE


def _restates(x: Column, y: Column) -> Column:
    return selection.restates(x["rare"], y["rare"])


def _repeats(x: Column, y: Column) -> Column:
    return _same_subject(x, y) | _restates(x, y)


class Choice:
    """Folds over the arrays ``items`` and ``blocks`` of one question."""

    def __init__(self, rows: DataFrame):
        kinds = {f.name: f.dataType for f in rows.schema}
        self.none = F.array().cast(kinds["items"])
        self.items, self.blocks = F.col("items"), F.col("blocks")
        self.primary, self.listing = F.get("routing.domains", 0), F.col("listing")
        self.budget = F.when(self.listing, LISTED).otherwise(FOCUSED)
        self.contributors = F.when(F.size("routing.spanned") > 0, F.col("routing.domains")).otherwise(F.slice("routing.domains", 1, 1))

    def distinct(self, items: Column, most: Column, already: Column | None = None, repeats: Callable = _repeats) -> Column:
        """The first ``most`` items that repeat neither ``already`` nor one another."""
        earlier = self.none if already is None else already

        def add(kept: Column, x: Column) -> Column:
            again = F.exists(kept, lambda y: repeats(x, y)) | F.exists(earlier, lambda y: repeats(x, y))
            return F.when((F.size(kept) >= most) | again, kept).otherwise(F.concat(kept, F.array(x)))

        return F.aggregate(items, self.none, add)

    def of_blocks(self, blocks: Column) -> Column:
        return T.let(F.transform(blocks, lambda b: b["position"]), lambda at: F.filter(self.items, lambda x: F.array_contains(at, x["position"])))

    def entries(self, domain: Column) -> Column:
        """Items of cross-cutting entries under a domain's headings."""
        return F.filter(self.items, lambda x: (x["category"] == V.CROSS_CUTTING) & (x["heading_domain"] == domain))

    def chosen_blocks(self) -> Column:
        """Blocks of the contributing domains or of the named project; all if there are none."""
        own = F.filter(self.blocks, lambda b: F.when(F.col("project").isNotNull(), b["source_file"] == F.col("project_file")).otherwise(F.coalesce(F.array_contains(self.contributors, b["domain"]), F.lit(False))))
        return T.let(own, lambda o: F.when(F.size(o) > 0, o).otherwise(self.blocks))

    def openings(self) -> Column:
        """From each contributing domain in turn the first of its blocks that adds something; the first domain's in document order, others' by matched terms."""
        share = F.greatest(F.lit(1), F.floor(self.budget / F.greatest(F.lit(1), F.size(self.contributors))).cast("int"))

        def of_domain(chosen: Column, k: Column) -> Column:
            domain = F.get(self.contributors, k)
            owned = F.filter(self.blocks, lambda b: (b["domain"] == domain) | ((b["category"] == V.CROSS_CUTTING) & (b["heading_domain"] == domain)))
            by_hits = F.transform(F.array_sort(F.transform(owned, lambda b: F.struct((-b["hits"]).alias("h"), b.alias("b")))), lambda x: x["b"])
            first = F.slice(F.when(k == 0, owned).otherwise(by_hits), 1, OPENINGS)
            found = F.aggregate(
                first, self.none,
                lambda kept, b: F.when(F.size(kept) > 0, kept).otherwise(self.distinct(F.filter(self.items, lambda x: x["position"] == b["position"]), share * SPARE, chosen)),
            )
            return F.when(F.size(chosen) >= self.budget, chosen).otherwise(F.concat(chosen, F.slice(found, 1, share)))

        return F.aggregate(F.sequence(F.lit(0), F.size(self.contributors) - 1), self.none, of_domain)

    def inventory(self) -> Column:
        return self.distinct(self.entries(F.lit("projects")), F.lit(FOCUSED))

    def journey(self) -> Column:
        own = F.transform(F.filter(self.blocks, lambda b: b["domain"] == self.primary), lambda b: b["position"])
        return T.let(own, lambda at: self.distinct(F.filter(self.items, lambda x: x["milestone"] & F.array_contains(at, x["position"])), F.lit(JOURNEY)))

    def history(self) -> Column:
        return self.distinct(self.entries(self.primary), F.lit(FOCUSED))

    def spanning(self) -> Column:
        """All kinds of statements of the whole documents, list items first, fields last."""
        found = self.distinct(self.of_blocks(self.chosen_blocks()), self.budget * SPARE)
        by_kind = F.array_sort(F.transform(found, lambda x: F.struct(x["kind"].alias("k"), x.alias("x"))))
        return F.slice(F.transform(by_kind, lambda x: x["x"]), 1, self.budget)

    def first_block(self) -> Column:
        return self.distinct(self.of_blocks(F.slice(self.chosen_blocks(), 1, 1)), self.budget)

    def targeted(self) -> Column:
        """Statements within a share of the best rare word: what is on record first, then by weight; repeats of words go before restatements are judged."""
        strong = F.filter(self.items, lambda x: x["peak"] >= PEAK_FLOOR)
        best = F.array_max(F.transform(strong, lambda x: x["peak"]))
        near = T.let(best, lambda b: F.filter(strong, lambda x: x["peak"] >= b * selection.SCORE_FLOOR))
        keys = F.transform(near, lambda x: F.struct(x["negative"].alias("a"), (-x["peak"]).alias("p"), (-x["score"]).alias("s"), x.alias("x")))
        ordered, every = F.transform(F.array_sort(keys), lambda k: k["x"]), F.lit(1 << 30)

        def or_equal(repeats: Callable) -> Callable:
            return lambda x, y: (T.normalise_key(x["s"]) == T.normalise_key(y["s"])) | repeats(x, y)

        words = self.distinct(ordered, every, repeats=or_equal(_same_subject))
        return F.slice(self.distinct(words, every, repeats=or_equal(_restates)), 1, self.budget)


def _chosen(rows: DataFrame) -> DataFrame:
    """Add ``choice``: the mode and items of the first way that yields any.

    Questions that want an opening or a list try those before matching statements, others
    only where no statement matches.
    """
    pick = Choice(rows)
    intent, overview, history, listing = F.col("routing.intent"), F.col("overview"), F.col("asks_history"), F.col("listing")
    named = F.col("project").isNotNull()
    spans = F.size("routing.spanned") > 0
    matched = F.exists("items", lambda x: x["peak"] >= PEAK_FLOOR)
    leads = ~listing & ((~named & (intent == "projects")) | intent.isin(*V.OVERVIEW_INTENTS) | overview | spans)
    ways = {
        "inventory": (~named & (intent == "projects") & ~spans, pick.inventory()),
        "journey": (overview & (history | (intent == "education")), pick.journey()),
        "history": (overview & history, pick.history()),
        "list": (listing, pick.spanning()),
        "opening": (leads | ~matched, pick.openings()),
        "first": (leads | ~matched, pick.first_block()),
        "targeted": (matched, pick.targeted()),
    }
    tried = rows.withColumns({f"_{name}": F.when(condition, items).otherwise(pick.none) for name, (condition, items) in ways.items()})
    order = [("inventory", True), ("journey", True), ("history", True), ("list", True), ("opening", leads), ("first", leads), ("targeted", True), ("opening", True), ("first", True)]
    mode = F.coalesce(*(F.when(F.lit(condition) & (F.size(f"_{name}") > 0), name) for name, condition in order))
    found = F.coalesce(*(F.when(F.col("_mode") == name, F.col(f"_{name}")) for name in ways), pick.none)
    picked = tried.withColumn("_mode", mode)
    return picked.withColumn("choice", F.struct(F.col("_mode").alias("mode"), found.alias("items")))


def rendered(items: Column, is_list: Column, subject: str | None) -> Column:
    """Lines of a list, or up to three sentences of prose whose opening pronoun is the subject's name.

    Prose leaves out text about documents and labelled fields unless nothing else is there.
    """
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["s"])), "\n")
    plain = F.filter(items, lambda x: ~S.is_scaffolding(x["s"]) & ~S.is_field(x["s"]))

    def clause(x: Column, k: Column) -> Column:
        named = F.when((k == 0) & x["s"].rlike(S.PRONOUN), F.regexp_replace(x["s"], S.PRONOUN, subject)).otherwise(x["s"]) if subject else x["s"]
        return T.as_sentence(F.trim(named))

    prose = T.let(plain, lambda p: F.array_join(F.transform(F.slice(F.when(F.size(p) > 0, p).otherwise(items), 1, CLAUSES), clause), " "))
    return F.when(is_list, lines).otherwise(prose)


def compose(subjects: DataFrame, hits: DataFrame, known: DataFrame, weights: DataFrame, subject: str | None = None, text: str = "message") -> DataFrame:
    """(qid, declined, mode, statements, citations, response) for every question.

    ``subjects`` are routed questions with support (``gates.with_support``), ``hits`` has
    (qid, position), ``known`` the stored ``described`` chunks.  Texts stay with their
    chunks; a question's blocks carry only what gates look at.  ``declined`` names the first gate
    that a question does not pass, and is null for those that are answered.
    """
    blocks = gates.eligible(hits.select("qid", "position").join(known.drop("text", "units"), "position"), subjects)
    may = stored(gates.with_met_terms(blocks, known, subjects, text), "eligible-blocks")
    topical = stored(gates.on_topic(may, subjects, text), "topical-blocks")
    passes = F.when(F.col("routing.intent") == V.UNKNOWN, NO_INTENT).when(F.col("unknown_project").isNotNull(), UNKNOWN_PROJECT).when(~F.col("documents"), NO_DOCUMENTS)
    some, kept = (x.select("qid").distinct().withColumn(n, F.lit(True)) for x, n in ((may, "_some"), (topical, "_kept")))
    passes = passes.when(F.col("_some").isNull(), NO_EVIDENCE).when(~F.col("attested"), NOT_ATTESTED).when(F.col("_kept").isNull(), OFF_SUBJECT)
    gated = stored(subjects.join(some, "qid", "left").join(kept, "qid", "left").withColumn("declined", passes).drop("_some", "_kept"), "gated-questions")
    open_ = gated.filter("declined is null")
    speak = topical.join(open_.select("qid"), "qid", "left_semi")
    domain = F.element_at(F.create_map(*(F.lit(x) for d, c in V.DOMAIN_CATEGORY.items() for x in (c, d))), F.col("category"))
    hits = F.size(F.filter("met", lambda t: ~profile.is_part_of_name(t, F.col("project"))))
    block = F.struct("source_file", "position", "category", "heading_domain", domain.alias("domain"), hits.alias("hits"))
    placed = speak.join(open_.select("qid", "project"), "qid").groupBy("qid").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    items = statements(speak, known, open_, weights, text).groupBy("qid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    intent, said = F.col("routing.intent"), F.col(text)
    rows = open_.select(
        "qid", "routing", "project", "project_file", routing.is_listing(said, intent).alias("listing"), routing.is_overview(said, intent).alias("overview"), F.array_contains(T.words(said), "history").alias("asks_history")
    )
    rows = rows.join(placed, "qid").join(items, "qid", "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    chosen = stored(_chosen(stored(rows, "statements-of-questions")).select("qid", "routing", "choice"), "chosen-statements")
    as_list = (F.col("choice.mode") == "journey") | (F.col("routing.shape") == "list")
    told = chosen.select(
        "qid", F.col("choice.mode").alias("mode"), F.transform("choice.items", lambda x: x["s"]).alias("statements"),
        F.array_distinct(F.transform("choice.items", lambda x: x["citation"])).alias("citations"),
        F.when(F.col("choice.mode").isNotNull(), rendered(F.col("choice.items"), as_list, subject)).alias("response"),
    )
    out = gated.select("qid", "declined").join(told, "qid", "left")
    return out.withColumn("declined", F.when(F.col("declined").isNull() & F.col("mode").isNull(), NO_STATEMENT).otherwise(F.col("declined")))
