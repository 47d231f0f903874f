"""What a corpus consists of: categories and titles of its files, the domains they back, the projects they name.

All of it is tables, so a question meets files and names by equi-joins.  A file without a
category backs no domain and is no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing_values as V
from ..functions import text as T
from . import routing

#: A project's name is sought in runs of at most so many words.
NAME_WORDS = 3
#: Frontmatter, its category, a title, a run of capitalised words.
FRONT = r"(?sdU)\A---\s*\n(.*?)\n---\s*\n"
CATEGORY = r"(?mdU)^category:\s*([A-Za-z0-9_-]+)\s*$"
TITLE = r"(?mdU)^#\s+(.+?)\s*$"
CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9]*(?:[ -][A-Z][A-Za-z0-9]*)*"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def file_profile(files: DataFrame) -> DataFrame:
    """(source_file, category, title) of files (source_file, text) that name a category in their frontmatter, or, without one, anywhere.

    The title is the first heading of level one, else the file's stem in words.
    """
    text = F.coalesce("text", F.lit(""))
    front = F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1)).otherwise(text)
    stem = F.regexp_replace(F.substring_index("source_file", "/", -1), r"\.[^.]*$", "")
    read = files.select("source_file", front.alias("_front"), text.alias("_text"), _stripped(F.translate(stem, "-_", "  ")).alias("_stem"))
    title = F.regexp_extract(F.concat("_front", F.lit("\n"), "_text"), TITLE, 1)
    found = read.select("source_file", F.lower(F.regexp_extract("_front", CATEGORY, 1)).alias("category"), F.when(_stripped(title) != "", _stripped(title)).otherwise(F.col("_stem")).alias("title"))
    return found.filter(F.col("category") != "")


def domain_files(profile: DataFrame) -> DataFrame:
    """(domain, source_file, is_primary): files of a domain's category, and cross-cutting files for every domain."""
    pairs = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(c).alias("category")) for d, c in V.DOMAIN_CATEGORY.items()))
    own = F.filter(pairs, lambda p: (p["category"] == F.col("category")) | (F.col("category") == V.CROSS_CUTTING))
    return profile.select("source_file", "category", F.inline(F.transform(own, lambda p: F.struct(p["domain"].alias("domain"))))).select(
        "domain", "source_file", (F.col("category") != V.CROSS_CUTTING).alias("is_primary")
    )


def project_names(profile: DataFrame) -> DataFrame:
    """(name_key, project, project_file): compacted names of projects; of equal ones the first by path."""
    named = profile.filter("category = 'project'").select("source_file", F.col("title").alias("project"), T.normalise_key(F.col("title")).alias("spaced"))
    named = named.filter("spaced <> ''")
    keys = named.groupBy("spaced").agg(F.min_by("project", "source_file").alias("project"))
    keys = keys.groupBy(F.replace("spaced", F.lit(" "), F.lit("")).alias("name_key")).agg(F.min_by("project", "spaced").alias("project"))
    return keys.join(named.groupBy("project").agg(F.min("source_file").alias("project_file")), "project").select("name_key", "project", "project_file")


def _runs(words: str) -> Column:
    """Adjacent words, one to ``NAME_WORDS`` of them, written together."""
    count = F.size(words)

    def of(n: int) -> Column:
        starts = F.when(count >= n, F.sequence(F.lit(1), count - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), ""))

    return F.array_distinct(F.concat(*(of(n) for n in range(1, NAME_WORDS + 1))))


def named_projects(questions: DataFrame, names: DataFrame, text: str = "message") -> DataFrame:
    """(qid, project, project_file) of questions that name a project, however its words are joined; the longest name wins."""
    runs = questions.select("qid", T.words(F.col(text)).alias("_words")).select("qid", F.explode(_runs("_words")).alias("name_key"))
    best = F.min_by(F.struct("project", "project_file"), F.struct(-F.length("name_key"), "name_key"))
    return runs.join(names, "name_key").groupBy("qid").agg(best.alias("p")).select("qid", "p.project", "p.project_file")


def unknown_names(questions: DataFrame, names: DataFrame, subject: tuple[str, ...] = (), text: str = "message") -> DataFrame:
    """(qid, unknown_project): the first run of capitalised words that reads like a project which the corpus does not have.

    Not such a name: an abbreviation, ordinary words only, a run with the subject's own
    name, and a question's opening unless a later letter or word shows that it is a name.
    """
    own = [n.lower() for n in subject]
    ordinary = [*V.NO_PROJECT, *own]
    message = F.coalesce(F.col(text), F.lit(""))
    phrases = questions.select("qid", message.rlike("^[A-Z]").alias("_opens"), F.posexplode(F.regexp_extract_all(message, F.lit(CAPITALISED), F.lit(0))).alias("_n", "phrase"))
    read = phrases.withColumn("_words", T.words(F.col("phrase")))
    evidence = F.col("phrase").rlike("[^ ][A-Z]") | F.exists(F.slice("_words", 2, 1 << 30), lambda w: ~w.isin(ordinary))
    opening = F.col("_opens") & (F.col("_n") == 0)
    strange = F.exists("_words", lambda w: ~w.isin(ordinary))
    of_subject = F.exists("_words", lambda w: w.isin(own)) if own else F.lit(False)
    name_like = (F.upper("phrase") != F.col("phrase")) & (~opening | evidence) & strange & ~of_subject
    left = read.filter(name_like).withColumn("name_key", F.array_join("_words", "")).join(names.select("name_key"), "name_key", "left_anti")
    return left.groupBy("qid").agg(F.min_by("phrase", "_n").alias("unknown_project"))


def is_part_of_name(term: Column, project: Column) -> Column:
    """Whether a term of three characters or more is a piece of a project's compacted name."""
    return F.coalesce((F.length(term) >= 3) & F.contains(F.replace(T.normalise_key(project), F.lit(" "), F.lit("")), term), F.lit(False))


def with_subject(questions: DataFrame, profile: DataFrame, subject: tuple[str, ...] = (), text: str = "message") -> DataFrame:
    """Add ``routing``, ``project``, ``project_file`` and ``unknown_project`` to questions (qid, ...).

    A named project makes the question one of detail about that project alone.  An unknown
    name is only looked for where no known one is.
    """
    names = project_names(profile)
    routed = routing.with_routing(questions, subject, text)
    routed = routed.join(named_projects(questions, names, text), "qid", "left").join(unknown_names(questions, names, subject, text), "qid", "left")
    named = F.col("project").isNotNull()
    about = F.col("routing").withField("intent", F.when(named, V.PROJECT_DETAIL).otherwise(F.col("routing.intent")))
    about = about.withField("domains", F.when(named, F.array(F.lit("projects"))).otherwise(F.col("routing.domains")))
    about = about.withField("spanned", F.when(named, routing.no_words()).otherwise(F.col("routing.spanned"))).withField("shape", F.when(named, "prose").otherwise(F.col("routing.shape")))
    about = about.withField("trace", F.when(named, F.concat("routing.trace", F.array(F.concat(F.lit("project:"), "project")))).otherwise(F.col("routing.trace")))
    return routed.withColumns({"routing": about, "unknown_project": F.when(~named, F.col("unknown_project"))})


def file_key(source_file: Column) -> Column:
    return F.concat(F.lit("file:"), source_file)


def with_keys(chunks: DataFrame, profile: DataFrame) -> DataFrame:
    """Add ``category`` and ``keys``, under which a chunk's file may be asked for: its domain, or ``faq``, and itself.

    Chunks of files without a category are left out.
    """
    domain = F.element_at(F.create_map(*(F.lit(x) for d, c in V.DOMAIN_CATEGORY.items() for x in (c, d))), F.col("category"))
    keys = F.array_compact(F.array(F.when(F.col("category") == V.CROSS_CUTTING, V.CROSS_CUTTING).otherwise(domain), file_key(F.col("source_file"))))
    return chunks.join(profile.select("source_file", "category"), "source_file").withColumn("keys", keys)


def _own_file() -> Column:
    return F.array(file_key(F.col("project_file")))


def allowed_keys() -> Column:
    """Keys of what may answer: the domains and the cross-cutting files, or a project's own file; none for a question of no intent.

    Files are matched by key, so a question never meets the files of a domain one by one.
    """
    domains = F.col("routing.domains")
    return F.when(F.col("project").isNotNull(), _own_file()).when(F.size(domains) > 0, F.concat(domains, F.array(F.lit(V.CROSS_CUTTING)))).otherwise(routing.no_words())


def contributing_keys() -> Column:
    """Keys of the files that own the answer: those of the first domain, or a project's own."""
    return F.when(F.col("project").isNotNull(), _own_file()).otherwise(F.slice("routing.domains", 1, 1))


def scope_keys(text: str = "message") -> Column:
    """Keys that retrieval is confined to where a whole document or an overview is wanted; null elsewhere."""
    intent, said = F.col("routing.intent"), F.col(text)
    whole = routing.is_listing(said, intent) | intent.isin(*V.OVERVIEW_INTENTS) | routing.is_overview(said, intent)
    return F.when((intent != V.UNKNOWN) & whole, allowed_keys())
