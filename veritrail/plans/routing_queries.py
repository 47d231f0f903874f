"""Queries of routing, corpus profile and composing, with the SQL that they are checked against.

Questions are all messages of ``conversations`` and, since those name few subjects, a list
of written ones.  Files are the documents, given a frontmatter by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing_values as V
from ..functions import text as T
from ..operators import chunking, context, dense, embedder, evidence, gates, profile, prompts, responses, routing, security, selection
from ..sources.stored import stored
from . import chat, evaluation
from .catalogue import MARKED_SQL, _sql_any, _sql_canonical, _sql_neutralised, marked_messages, query, table

#: The invented subject of the written questions.
SUBJECT = ("noor", "salim")
ASKED = (
    "Who is Noor?", "What can Noor do?", "What is he good at?", "What has Salim worked on and with which tools?", "Tell me about his projects and the technologies he uses", "What's his academic background?",
    "What is Noor's bank balance?", "What does he do for fun and for balance?", "What is his employment history?", "Give me his history", "Which university does he study at?", "Where is she studying, and which degree?",
    "Can someone hire Noor?", "What is he looking for?", "What are his goals?", "What is Noor focused on?", "Is he interested in design?", "What is he working towards?", "How can I reach him by email?",
    "List all his certifications", "Which platform issued his certificates?", "What is his salary expectation?", "Noor?", "Tell me about Noor", "Summarise his education history", "Explain the architecture",
    "What are his hobbies outside of work?", "Where does he live?", "What is the story of his roots?", "Can he help with python?", "", "   ", "???", "Tell me about a project called GlassHouse", "Tell me about SaltHarbour",
    "What is src 1 about?", "Describe Paper Crane", "Which AWS services does Noor know?", "Introduce Noor", "Any chance you could walk me through it?", "What is Noor's certificate ID?", "Is Tin-Lantern fast?", "What does he work with?", "Can I work with him on his plans?", "What about Paper crane and papercrane2?",
)


def asked_messages(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("message"))
    return turns.unionByName(spark.createDataFrame([(-1 - k, m) for k, m in enumerate(ASKED)], "qid long, message string"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(r) + ')' for r in rows)})"


MATCHES = (
    "(word = surface or word || 's' = surface or (length(word) >= 4 and length(surface) >= 4 and abs(length(word) - length(surface)) <= 3 "
    "and (starts_with(word, surface) or starts_with(surface, word))))"
)
ASKED_SQL = "asked as (select conv_id * 1000 + turn as qid, text as message from conversations union all select * from (values " + ", ".join(f"({-1 - k}, {_text(m)})" for k, m in enumerate(ASKED)) + ") t(qid, message))"
SCORES_SQL = f"""{ASKED_SQL}, said as materialized (select qid, message, {T.sql_words('message')} as all_words from asked),
words as materialized (select distinct qid, unnest(all_words) as word from said),
{_table('concepts', 'concept, intent, weight, surface', [(_text(c.name), _text(c.intent), str(c.weight), _text(s)) for c in V.CONCEPTS for s in c.surfaces])},
{_table('frames', 'frame, intent, pattern', [(_text(f.name), _text(f.intent), _text(f.pattern)) for f in V.FRAMES])},
{_table('intents', 'n, intent, domain', [(str(k), _text(i), _text(d)) for k, (i, d) in enumerate(V.INTENT_DOMAIN.items())])},
vocabulary as (select distinct word from words),
named as materialized (select distinct word, concept, intent, weight, word in ({', '.join(_text(a) for a in V.AMBIGUOUS)}) and word in (select surface from concepts c where c.concept = k.concept) as vague
  from vocabulary, concepts k where {MATCHES}),
hits as (select qid, concept, intent, weight, word, bool_or(not vague) over (partition by qid, concept) as counts from words join named using (word)),
turns as (select qid, frame, intent, trim(regexp_extract(array_to_string(all_words, ' '), pattern)) as found from said, frames where regexp_matches(array_to_string(all_words, ' '), pattern)),
signals as materialized (
  select distinct qid, intent, concept as name, weight, word from hits where counts
  union all select distinct qid, intent, 'frame ' || frame, {V.FRAME}, unnest(string_split(found, ' ')) from turns),
scores as materialized (select qid, intent, n, domain, sum(weight) as score from (select distinct qid, intent, name, weight from signals) join intents using (intent) group by all)"""

ROUTED_SQL = f"""{SCORES_SQL},
best as materialized (select qid, intent, domain, score from scores qualify row_number() over (partition by qid order by score desc, n) = 1),
own as (select qid, len(list_filter({T.sql_content_terms('message')}, lambda x: x not in ({', '.join(_text(s) for s in SUBJECT)}))) as n_own, len(all_words) as n_words from said),
decided as materialized (select own.qid, case when best.intent is not null then best.intent when n_words > 0 and n_own = 0 then 'identity' else 'unknown' end as intent, score from own left join best using (qid)),
joined as materialized (select s.qid, s.intent, s.domain, s.n from scores s join decided d using (qid) where s.score >= d.score * {V.JOINS_FROM} and s.intent <> d.intent and s.intent not in ({', '.join(_text(i) for i in V.NEVER_JOINS)})
  qualify row_number() over (partition by s.qid, s.domain order by s.n) = 1),
{_table('expansion', 'intent, domain, place, composite', [(_text(i), _text(d), str(k + 1), str(i in V.COMPOSITE).lower()) for i, ds in V.EXPANSION.items() for k, d in enumerate(ds)])},
places as (select qid, i.domain, 0 as place from decided d join intents i using (intent) union all select qid, e.domain, place from decided d join expansion e using (intent) union all select qid, domain, 10 + n from joined),
domains as materialized (select qid, domain, min(place) as place from places group by qid, domain qualify row_number() over (partition by qid order by min(place)) <= {1 + V.FURTHER_DOMAINS}),
listed as (select qid, list(domain order by place) as domains from domains group by qid),
free as (select qid, domain, 10 + n as place from joined union all select qid, e.domain, 20 + place from decided d join expansion e using (intent) where composite),
spanning as (select qid, list(f.domain order by f.place) as spanned from (select qid, domain, min(place) as place from free group by all) f join domains d using (qid, domain) where d.place > 0 group by qid),
deciding as (select qid, list_sort(list(distinct word)) as terms from signals where (qid, intent) in (select (qid, intent) from decided union all select (qid, intent) from joined) group by qid),
recognised as (select qid, list_sort(list(distinct word)) as vocabulary from signals group by qid)"""


@query(f"with {SCORES_SQL} select qid, intent, score from scores")
def intent_scores(spark, sf_dir):
    """Score of every intent that a question's concepts and frames raise."""
    routed = routing.with_routing(asked_messages(spark, sf_dir), SUBJECT)
    return routed.select("qid", F.inline("routing.scores"))


@query(f"with {SCORES_SQL} select qid, frame, found from turns")
def frames_hit(spark, sf_dir):
    """Turns of phrase in each question."""
    trace = routing.with_routing(asked_messages(spark, sf_dir), SUBJECT).select("qid", F.explode("routing.trace").alias("t"))
    pattern = r"^frame:([^(]+)\((.*)\)$"
    return trace.filter(F.col("t").rlike(pattern)).select("qid", F.regexp_extract("t", pattern, 1).alias("frame"), F.regexp_extract("t", pattern, 2).alias("found"))


@query(
    f"with {ROUTED_SQL} select qid, d.intent, case when d.intent in ({', '.join(_text(i) for i in V.LIST_INTENTS)}) then 'list' else 'prose' end as shape, array_to_string(coalesce(domains, []), ',') as domains, "
    "array_to_string(coalesce(spanned, []), ',') as spanned, array_to_string(coalesce(terms, []), ',') as terms, array_to_string(coalesce(vocabulary, []), ',') as vocabulary "
    "from decided d left join listed using (qid) left join spanning using (qid) left join deciding using (qid) left join recognised using (qid)"
)
def routed_intent(spark, sf_dir):
    """Intent, domains and words of each question."""
    routed = routing.with_routing(asked_messages(spark, sf_dir), SUBJECT)
    return routed.select("qid", "routing.intent", "routing.shape", *(F.array_join(f"routing.{c}", ",").alias(c) for c in ("domains", "spanned", "terms", "vocabulary")))


@query(f"with {ROUTED_SQL} select qid, intent as joins, domain from joined")
def co_answers(spark, sf_dir):
    """Intents that join the best one, each with a domain of its own."""
    scores = routing.with_routing(asked_messages(spark, sf_dir), SUBJECT).select("qid", "routing.joined")
    return scores.select("qid", F.inline("joined")).select("qid", F.col("intent").alias("joins"), "domain")


@query(
    f"with {SCORES_SQL}, {_table('own', 'domain, surface', [(_text(d), _text(s)) for d in V.DOMAIN_CATEGORY for s in sorted(set(routing._domain_words(d) + V.HEADING_WORDS.get(d, ())))])}, "
    f"{_table('ranked', 'domain, n', [(_text(d), str(k)) for k, d in enumerate(V.DOMAIN_CATEGORY)])}, "
    f"met as materialized (select distinct word, domain from vocabulary, own where {MATCHES}), counted as (select qid, domain, count(*) as hits from words join met using (word) group by all), "
    "first as (select qid, domain from counted join ranked using (domain) qualify row_number() over (partition by qid order by hits desc, n) = 1) "
    "select qid, coalesce(domain, 'unknown') as domain from asked left join first using (qid)"
)
def heading_domain(spark, sf_dir):
    """The domain that each message would belong to as a heading."""
    return routing.with_heading_domain(asked_messages(spark, sf_dir), "message", "domain").select("qid", "domain")


FRAMING_SQL = (
    f"list_sort(list_distinct(list_filter(all_words, lambda w: w in ({', '.join(_text(w) for w in V.OVERVIEW_WORDS)}) or (w = 'history' and intent in ('education', 'experience')) "
    "or (w in ('tell', 'about') and list_contains(all_words, 'tell') and list_contains(all_words, 'about')))))"
)


@query(
    f"with {ROUTED_SQL} select qid, array_to_string({FRAMING_SQL}, ',') as framing, intent in ({', '.join(_text(i) for i in V.WHOLE_DOCUMENT)}) and list_has_any(all_words, {_list(V.LIST_CUES)}) as listing "
    "from said join decided using (qid)"
)
def overview_framing(spark, sf_dir):
    """Words that ask for an overview, and whether a question wants a list of everything."""
    routed = routing.with_routing(asked_messages(spark, sf_dir), SUBJECT)
    intent, text = F.col("routing.intent"), F.col("message")
    return routed.select("qid", F.array_join(F.array_sort(routing.framing_terms(text, intent)), ",").alias("framing"), routing.is_listing(text, intent).alias("listing"))


@query(
    f"with {SCORES_SQL}, {_table('own', 'domain, surface', [(_text(d), _text(s)) for d in ('interests', 'goals', 'projects') for s in sorted(set(routing._domain_words(d)))])} "
    f"select qid, domain, array_to_string(list_sort(list(distinct word)), ',') as terms from words join (select distinct word, domain from vocabulary, own where {MATCHES}) using (word) group by all"
)
def routing_terms(spark, sf_dir):
    """Words of each question that name one of three domains."""
    asked = asked_messages(spark, sf_dir)
    found = [routing.with_routing_terms(asked, d).select("qid", F.lit(d).alias("domain"), F.array_join(F.array_sort("terms"), ",").alias("terms")) for d in ("interests", "goals", "projects")]
    return found[0].unionByName(found[1]).unionByName(found[2]).filter("terms <> ''")


# -- the corpus ------------------------------------------------------------------------------

CATEGORIES = [*V.DOMAIN_CATEGORY.values(), V.CROSS_CUTTING, ""]
#: Titles of the first project files, beside those that are made of an id.
TITLES = ("Paper Crane", "papercrane2", "Tin Lantern", "Salt Harbour")


def corpus_files(spark, sf_dir) -> DataFrame:
    """Documents as files with frontmatter: their category goes by id, every thirteenth has none at all."""
    docs = table(spark, sf_dir, "documents")
    at = F.pmod("doc_id", F.lit(len(CATEGORIES) + 1)).cast("int")
    category = F.get(F.array(*(F.lit(c) for c in CATEGORIES)), at)
    k = F.floor(F.col("doc_id") / (len(CATEGORIES) + 1)).cast("int")
    title = F.coalesce(F.get(F.array(*(F.lit(t) for t in TITLES)), k), F.concat(F.lit("Work No. "), F.col("doc_id").cast("string")))
    head = F.concat(F.lit("---\ntitle: Any\ncategory: "), F.initcap(category), F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    text = F.concat(F.when(at < len(CATEGORIES), head).otherwise(""), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.format_string("%s/no-%d_x.md", "source", "doc_id").alias("source_file"), text.alias("text"))


def _sql_get(values, at: str) -> str:
    return f"({_list(values)})[{at} + 1]"


N_KINDS = len(CATEGORIES) + 1
PROFILE_SQL = f"""files as (select doc_id, source || '/no-' || doc_id || '_x.md' as source_file, doc_id % {N_KINDS} as kind, doc_id // {N_KINDS} as k, coalesce(text, '') as text from documents),
profile as materialized (select source_file, {_sql_get(CATEGORIES, 'kind')} as category, coalesce({_sql_get(TITLES, 'k')}, 'Work No. ' || doc_id) as title from files where kind < {len(CATEGORIES) - 1}),
{_table('kinds', 'domain, category', [(_text(d), _text(c)) for d, c in V.DOMAIN_CATEGORY.items()])},
domain_files as materialized (select domain, source_file, profile.category <> 'faq' as is_primary from profile join kinds on profile.category = kinds.category or profile.category = 'faq')"""


@query(f"with {PROFILE_SQL} select source_file, category, title from profile")
def file_profile(spark, sf_dir):
    """Category and title of every file that has a category."""
    return profile.file_profile(corpus_files(spark, sf_dir))


@query(f"with {PROFILE_SQL} select domain, source_file, is_primary from domain_files")
def file_domains(spark, sf_dir):
    """Files that may back each domain."""
    return profile.domain_files(profile.file_profile(corpus_files(spark, sf_dir)))


NAMES_SQL = f"""{PROFILE_SQL}, spaced as (select source_file, title as project, array_to_string({T.sql_words('title')}, ' ') as spaced from profile where category = 'project'),
titled as (select spaced, arg_min(project, source_file) as project from spaced where spaced <> '' group by spaced),
keyed as (select replace(spaced, ' ', '') as name_key, arg_min(project, spaced) as project from titled group by 1),
project_files as (select project, min(source_file) as project_file from spaced where spaced <> '' group by 1),
names as materialized (select name_key, project, project_file from keyed join project_files using (project))"""
RUNS_SQL = f"""{ASKED_SQL}, said as materialized (select qid, message, {T.sql_words('message')} as all_words from asked),
runs as (select distinct qid, array_to_string(all_words[i:i + n - 1], '') as name_key from said, range(1, 4) s(n), unnest(range(1, greatest(len(all_words) - n + 2, 1))) t(i)),
projects as materialized (select qid, project, project_file from runs join names using (name_key) qualify row_number() over (partition by qid order by length(name_key) desc, name_key) = 1)"""


@query(f"with {NAMES_SQL}, {RUNS_SQL} select qid, project, project_file from projects")
def detected_projects(spark, sf_dir):
    """The project that each question names."""
    names = profile.project_names(profile.file_profile(corpus_files(spark, sf_dir)))
    return profile.named_projects(asked_messages(spark, sf_dir), names)


_ORDINARY = ", ".join(_text(w) for w in (*V.NO_PROJECT, *SUBJECT))
UNKNOWN_SQL = f"""found as (select qid, message, regexp_extract_all(message, '{profile.CAPITALISED.removeprefix("(?U)")}') as phrases from asked),
each as (select qid, unnest(phrases) as phrase, unnest(range(len(phrases))) as n, regexp_matches(message, '^[A-Z]') as opens from found),
split as (select *, {T.sql_words('phrase')} as ws from each),
strange as (select qid, phrase, n from split where upper(phrase) <> phrase and len(list_filter(ws, lambda w: w not in ({_ORDINARY}))) > 0 and not list_has_any(ws, {_list(SUBJECT)})
  and (not (opens and n = 0) or regexp_matches(phrase, '[^ ][A-Z]') or len(list_filter(ws[2:], lambda w: w not in ({_ORDINARY}))) > 0) and array_to_string(ws, '') not in (select name_key from names)),
unknowns as materialized (select qid, arg_min(phrase, n) as unknown_project from strange group by qid)"""


@query(f"with {NAMES_SQL}, {RUNS_SQL}, {UNKNOWN_SQL} select qid, unknown_project from unknowns")
def unknown_projects(spark, sf_dir):
    """Names in questions that read like projects which the corpus does not have."""
    names = profile.project_names(profile.file_profile(corpus_files(spark, sf_dir)))
    return profile.unknown_names(asked_messages(spark, sf_dir), names, SUBJECT)


SUBJECTS_SQL = f"""{NAMES_SQL}, {ROUTED_SQL}, {RUNS_SQL[RUNS_SQL.index('runs as'):]},
subjects as materialized (select d.qid, p.project, p.project_file, case when p.project is not null then 'project_detail' else d.intent end as intent,
  case when p.project is not null then ['projects'] else coalesce(domains, []) end as domains from decided d left join listed using (qid) left join projects p using (qid)),
keyed_subjects as materialized (select *, case when project is not null then ['file:' || project_file] when len(domains) > 0 then list_append(domains, 'faq') else [] end as allowed,
  case when project is not null then ['file:' || project_file] else domains[1:1] end as owners from subjects)"""
WHOLE_SQL = (
    f"intent <> 'unknown' and (intent in ({', '.join(_text(i) for i in V.OVERVIEW_INTENTS)}) or len({FRAMING_SQL}) > 0 "
    f"or (intent in ({', '.join(_text(i) for i in V.WHOLE_DOCUMENT)}) and list_has_any(all_words, {_list(V.LIST_CUES)})))"
)


@query(
    f"with {SUBJECTS_SQL} select qid, intent, coalesce(project, '') as project, array_to_string(allowed, ',') as allowed, array_to_string(owners, ',') as owners, "
    f"{WHOLE_SQL} as scoped from said join keyed_subjects using (qid)"
)
def question_scope(spark, sf_dir):
    """What may answer each question, what owns the answer, and whether retrieval is confined to it."""
    subjects = profile.with_subject(asked_messages(spark, sf_dir), profile.file_profile(corpus_files(spark, sf_dir)), SUBJECT)
    keys = subjects.select("qid", "routing.intent", F.coalesce("project", F.lit("")).alias("project"), profile.allowed_keys().alias("allowed"), profile.contributing_keys().alias("owners"), profile.scope_keys().alias("scope"))
    return keys.select("qid", "intent", "project", F.array_join("allowed", ",").alias("allowed"), F.array_join("owners", ",").alias("owners"), F.col("scope").isNotNull().alias("scoped"))


# -- gates --------------------------------------------------------------------------------------

#: Blocks of a question: so many documents, by its id.
BLOCKS = 6


def _pairs_sql(left: str, right: str) -> str:
    """Matching pairs (term, token) of two one-column queries, by beginnings."""
    cut = "range(greatest(length({0}) - 3, 4), length({0}) + 1)"
    return (
        f"l as (select distinct term, {_sql_canonical('term')} as form from ({left})), r as (select distinct token, {_sql_canonical('token')} as form from ({right})), "
        f"lb as (select term, unnest(list_transform({cut.format('term')}, lambda n: term[1:n])) as b from l where length(term) >= 4), rb as (select token, unnest(list_transform({cut.format('token')}, lambda n: token[1:n])) as b from r where length(token) >= 4), "
        "pairs as materialized (select term, token from l join r using (form) union select term, token from lb join r on b = token union select term, token from rb join l on b = term)"
    )


_CONCEPTS = f"list_filter({T.sql_content_terms('message')}, lambda x: x not in ({', '.join(_text(s) for s in SUBJECT)}))"
SUPPORT_SQL = f"""{SUBJECTS_SQL}, wanted as materialized (select qid, owners[1] as owner, allowed, {_CONCEPTS} as concepts from asked join keyed_subjects using (qid)),
terms as materialized (select distinct qid, owner, unnest(concepts) as term from wanted),
held as materialized (select distinct source_file, token from (select f.source_file, unnest({T.sql_tokens('d.text')}) as token from files f join documents d using (doc_id))),
{_pairs_sql('select term from terms', 'select token from held')},
file_keys as materialized (select source_file, 'file:' || source_file as key from profile union all select source_file, coalesce(domain, 'faq') from profile left join kinds using (category)),
key_words as materialized (select distinct key, token from held join file_keys using (source_file)),
route_words as (select distinct qid, unnest(list_concat(coalesce(vocabulary, []), [])) as token from decided left join recognised using (qid) where intent <> 'unknown'),
known as (select distinct qid from terms join pairs using (term)),
inside as (select distinct qid from terms join pairs using (term) join key_words k on k.key = owner and k.token = pairs.token),
routed as (select distinct t.qid from terms t join route_words w using (qid) where {_sql_canonical('t.term')} = {_sql_canonical('w.token')} or (length(t.term) >= 4 and length(w.token) >= 4 and abs(length(t.term) - length(w.token)) <= 3 and (starts_with(t.term, w.token) or starts_with(w.token, t.term)))),
support as materialized (select qid, len(concepts) = 0 or qid in (select qid from known) or qid in (select qid from routed) as attested,
  len(concepts) > 0 and case when owner in (select key from key_words) then qid in (select qid from inside) else qid in (select qid from known) end as lexical_support,
  list_has_any(allowed, (select list(distinct key) from file_keys)) as documents, coalesce(owner in (select key from file_keys), false) as owners from wanted)"""


def supported(spark, sf_dir) -> DataFrame:
    """Routed questions with what the corpus knows of their words."""
    files = stored(profile.file_profile(corpus_files(spark, sf_dir)), "profile")
    routed = stored(profile.with_subject(asked_messages(spark, sf_dir), files, SUBJECT), "routed")
    chunks = profile.with_keys(corpus_files(spark, sf_dir).select("doc_id", "source_file"), files)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(chunks.select("doc_id", "keys"), "doc_id", "left")
    return stored(gates.with_support(routed, texts, files, SUBJECT), "supported")


@query(f"with {SUPPORT_SQL} select qid, attested, lexical_support, documents, owners from support")
def question_support(spark, sf_dir):
    """Whether the corpus attests each question's concepts, whether retrieval can reach its files by words, and whether there are any."""
    return supported(spark, sf_dir).select("qid", "attested", "lexical_support", "documents", "owners")


def asked_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Six documents for each question (qid, position), and the described documents, under headings of which some name a domain.

    Every seventeenth document states an absence, every nineteenth is hostile.
    """
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    at = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: F.pmod(F.col("qid") * 7 + j * 13, F.lit(n)))
    asked = asked_messages(spark, sf_dir).select("qid", F.explode(F.array_distinct(at)).alias("position"))
    said = F.when(F.col("doc_id") % 17 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" No award is recorded."))).otherwise(F.coalesce("text", F.lit("")))
    section = F.get(F.array(*(F.lit(s) for s in SECTIONS)), F.pmod("doc_id", F.lit(len(SECTIONS))).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("position"), F.format_string("%s/no-%d_x.md", "source", "doc_id").alias("source_file"), section.alias("section"), said.alias("text"), (F.col("doc_id") % 19 == 0).alias("hostile"))
    keyed = profile.with_keys(chunks, profile.file_profile(corpus_files(spark, sf_dir)))
    described = routing.with_heading_domain(keyed, "section").withColumn("absent", T.is_negative_evidence(F.col("text")))
    return asked, described


def eligible_for(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eligible blocks, the described documents and the routed questions."""
    subjects = supported(spark, sf_dir)
    asked, described = asked_blocks(spark, sf_dir)
    flags = stored(described.drop("text"), "flags")
    return stored(gates.eligible(asked.join(flags, "position"), subjects), "eligible"), described, subjects


SECTIONS = ("Questions > Projects", "Questions > Skills and tools", "Any", "Questions > Goals", "Questions > Fun")
BLOCKS_SQL = f"""{SUPPORT_SQL}, placed as (select distinct qid, (qid * 7 + j * 13) % n + case when (qid * 7 + j * 13) % n < 0 then n else 0 end as position from asked, range({BLOCKS}) s(j), (select count(*) as n from documents)),
chunks as materialized (select f.doc_id as position, f.source_file, p.category, coalesce(k.domain, 'faq') as domain, ({_list(SECTIONS)})[f.doc_id % {len(SECTIONS)} + 1] as section, f.doc_id % 19 = 0 as hostile,
  f.text || case when f.doc_id % 17 = 0 then ' No award is recorded.' else '' end as text from files f join profile p using (source_file) left join kinds k using (category)),
{_table('headings', 'section, heading_domain', [(_text(s), _text(d)) for s, d in zip(SECTIONS, ('projects', 'skills', 'unknown', 'goals', 'interests'))])},
eligible as materialized (select qid, position, source_file, category, domain, section, heading_domain, text from placed join chunks using (position) join headings using (section) join keyed_subjects using (qid)
  where not hostile and list_has_any([domain, 'file:' || source_file], allowed) and not (category = 'faq' and heading_domain <> 'unknown' and not list_contains(domains, heading_domain)))"""


@query(f"with {BLOCKS_SQL} select qid, position from eligible")
def eligible_blocks(spark, sf_dir):
    """Blocks that may speak to each question."""
    return eligible_for(spark, sf_dir)[0].select("qid", "position")


ON_TOPIC_SQL = f"""{BLOCKS_SQL},
framed as materialized (select said.qid, {FRAMING_SQL.replace('and intent in', 'and k.intent in')} as framing, k.intent in ({', '.join(_text(i) for i in V.WHOLE_DOCUMENT)}) and list_has_any(all_words, {_list(V.LIST_CUES)}) as listing from said join keyed_subjects k using (qid)),
open_terms as materialized (select distinct t.qid, term from terms t join framed f on f.qid = t.qid where not list_contains(framing, term)),
block_words as materialized (select distinct position, unnest({T.sql_content_terms("section || ' ' || text")}) as token from (select distinct position, section, text from eligible)),
meets as (select distinct e.qid, e.position from eligible e join block_words b using (position) join open_terms o on o.qid = e.qid where {_sql_canonical('o.term')} = {_sql_canonical('b.token')}
  or (length(o.term) >= 4 and length(b.token) >= 4 and abs(length(o.term) - length(b.token)) <= 3 and (starts_with(o.term, b.token) or starts_with(b.token, o.term)))),
accounted as (select qid, not exists (select 1 from open_terms o where o.qid = d.qid and not exists (select 1 from route_words w where w.qid = o.qid and ({_sql_canonical('o.term')} = {_sql_canonical('w.token')}
  or (length(o.term) >= 4 and length(w.token) >= 4 and abs(length(o.term) - length(w.token)) <= 3 and (starts_with(o.term, w.token) or starts_with(w.token, o.term))))))
  and len(coalesce(terms, [])) > 0 and intent <> 'unknown' as all_routed from decided d left join deciding using (qid)),
judged as (select e.*, (qid, position) in (select (qid, position) from meets) or (regexp_matches(text, 'No award is recorded') and not listing) as topical, all_routed and s.owners as all_routed, k.domains, coalesce(spanned, []) as spanned,
  qid in (select qid from open_terms) as has_open, k.project from eligible e join framed using (qid) join accounted using (qid) join support s using (qid) join keyed_subjects k using (qid) left join spanning using (qid)),
exempted as (select *, all_routed and (domain = domains[1] or (project is null and list_contains(spanned, domain)) or (category = 'faq' and heading_domain = domains[1]) or topical) as exempt from judged),
final as (select *, bool_or(topical) over (partition by qid, source_file) as whole_file, bool_or(exempt) over (partition by qid) as any_exempt from exempted)"""


@query(f"with {ON_TOPIC_SQL} select qid, position from final where case when not has_open then true when any_exempt then exempt else whole_file end")
def on_topic_blocks(spark, sf_dir):
    """Eligible blocks of files that are about each question."""
    may, described, subjects = eligible_for(spark, sf_dir)
    return gates.on_topic(stored(gates.with_met_terms(may, described, subjects), "met"), subjects).select("qid", "position")


# -- evaluation and embedding -----------------------------------------------------------------------


def quoted_replies(spark, sf_dir) -> DataFrame:
    """For every document a reply of two bullets out of it, which cites it or, for every fourth, the one before it."""
    docs = corpus_files(spark, sf_dir).select("doc_id", "source_file")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]+", " ")
    said = F.concat(F.lit("- **"), F.substring(text, 1, 80), F.lit("**\n- Noor uses "), F.substring(text, 41, 60))
    replies = table(spark, sf_dir, "documents").select("doc_id", said.alias("response"))
    cited = docs.select(F.col("doc_id").alias("_even"), F.col("source_file").alias("cited_file"))
    rows = replies.withColumn("_even", F.col("doc_id") - F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).join(cited, "_even")
    return rows.select(F.col("doc_id").alias("qid"), "response", F.array("cited_file").alias("cited"))


def ascii_files(spark, sf_dir) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]+", " ")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Noor "), text).alias("text"))
    return corpus_files(spark, sf_dir).select("doc_id", "source_file").join(files, "doc_id").select("source_file", "text")


def _sql_plain(text: str) -> str:
    bare = f"regexp_replace(regexp_replace({text}, '\\*{{1,3}}|_{{1,3}}|`+', '', 'g'), '(?m)^\\s*(?:[-*+]|\\d{{1,3}}[.)])\\s+', '', 'g')"
    return f"trim(regexp_replace(lower({bare}), '[^a-z0-9]+', ' ', 'g'))"


_ASCII = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e]+', ' ', 'g')"
GROUNDED_SQL = f"""ascii as materialized (select doc_id, {_ASCII} as t from documents),
said as (select doc_id as qid, doc_id - case when doc_id % 4 = 1 then 1 else 0 end as cited, unnest([trim('**' || t[1:80] || '**'), trim('Noor uses ' || t[41:100])]) as statement from ascii),
plains as (select distinct qid, statement, {_sql_plain('statement')} as p, {_sql_plain("'Noor ' || t")} as held from said join ascii on cited = ascii.doc_id),
checked as materialized (select qid, statement, p = '' or contains(held, p) or contains(held, regexp_replace(p, '^noor\\s+(is|was|has|had|does|did|studies|works|focuses|describes|uses|built)', '\\1')) as grounded from plains)"""


@query(f"with {GROUNDED_SQL} select qid, statement, grounded from checked")
def grounded_statements(spark, sf_dir):
    """Whether each statement of replies is part of the file that it cites."""
    return evaluation.grounded_statements(quoted_replies(spark, sf_dir), ascii_files(spark, sf_dir), ("Noor",))


@query(
    f"""with {GROUNDED_SQL}, files as (select doc_id, source || '/no-' || doc_id || '_x.md' as source_file from documents), cases as (select d.doc_id as qid, d.doc_id - case when d.doc_id % 4 = 1 then 1 else 0 end as cited,
  count(c.qid) as statements, count(*) filter (where not grounded) as violations from documents d left join checked c on c.qid = d.doc_id group by all)
select count(*) as total, count(*) filter (where violations = 0 and cited = qid and qid % 5 <> 0) as passed, count(*) as answered, 0 as declined, 0 as blocked, 0 as refused, count(*)::bigint as source_total,
  count(*) filter (where cited = qid)::bigint as source_hits, sum(statements)::bigint as statements, sum(violations)::bigint as violations, round(count(*) filter (where cited = qid) / count(*), 6) as source_accuracy, count(distinct cited) as documents from cases"""
)
def grounding_report(spark, sf_dir):
    """Counts over a case for every document: it must cite its own file, every fifth must not be answered."""
    replies = quoted_replies(spark, sf_dir).withColumns({"classification": F.lit("in_scope"), "outcome": F.lit("answered")})
    own = corpus_files(spark, sf_dir)
    none = F.array().cast("array<string>")
    cases = own.select(
        F.col("doc_id").alias("qid"), F.lit("in_scope").alias("classification"), F.when(F.col("doc_id") % 5 == 0, "no_context").otherwise("answered").alias("outcome"),
        F.array("source_file").alias("must_cite"), none.alias("any_cite"), none.alias("may_cite"), none.alias("contains"), none.alias("excludes"),
    )
    told = evaluation.report(evaluation.evaluated_cases(cases, replies, ascii_files(spark, sf_dir), ("Noor",)))
    return told.withColumn("source_accuracy", F.round("source_accuracy", 6))


TOKENS, WIDTH = 8, 8
_POOLED = f"list_transform(range({WIDTH}), lambda j: list_sum(list_transform(range({TOKENS}), lambda t: case when (vec_id + t) % 3 <> 0 and vec_id % 50 <> 0 then embedding[t * {WIDTH} + j + 1]::double else 0 end)) / greatest(case when vec_id % 50 = 0 then 0 else len(list_filter(range({TOKENS}), lambda t: (vec_id + t) % 3 <> 0)) end, 1e-9))"


@query(
    f"with p as (select vec_id, {_POOLED} as v from embeddings) select vec_id as position, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as norm, "
    "round(list_sum(list_transform(v, lambda x, i: x * i)), 6) as weighted from p"
)
def mean_pooled(spark, sf_dir):
    """Vectors read as eight tokens, of which a third, or all of every fiftieth vector, are masked."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda t: F.slice("embedding", t * WIDTH + 1, WIDTH))
    mask = F.transform(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda t: ((F.col("vec_id") % 50 != 0) & (F.pmod(F.col("vec_id") + t, F.lit(3)) != 0)).cast("int"))
    pooled = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), embedder.mean_pooled(tokens, mask, WIDTH).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return pooled.select("position", F.round(dense.norm(F.col("v")), 6).alias("norm"), F.round(weighted, 6).alias("weighted"))


# -- prompts and replies ------------------------------------------------------------------------------


def fenced_for(spark, sf_dir) -> DataFrame:
    """Two documents for each message whose id is no multiple of five, as fenced blocks (qid, rank, block)."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    asked = asked_messages(spark, sf_dir).filter(F.col("qid") % 5 != 0)
    at = asked.select("qid", F.posexplode(F.array(F.pmod("qid", F.lit(n)), F.pmod(F.col("qid") * 3 + 1, F.lit(n)))).alias("rank", "doc_id"))
    block = context.rendered(F.col("source"), (F.col("rank") + 1) / F.lit(8.0), security.neutralised(F.coalesce("text", F.lit(""))), F.lit(False))
    return at.join(docs.select("doc_id", "source", "text"), "doc_id").select("qid", "rank", block.alias("block"))


def _sql_neutral(text: str) -> str:
    out = f"replace({text}, chr(0), '')"
    for mark in prompts.RESERVED:
        out = f"replace({out}, '{mark}', '{security.MARKER}')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


PROMPTS_SQL = f"""{ASKED_SQL}, spots as (select qid, r as rank, case when r = 0 then ((qid % n) + n) % n else (((qid * 3 + 1) % n) + n) % n end as doc_id from asked, range(2) t(r), (select count(*) as n from documents) where qid % 5 <> 0),
blocks as (select qid, rank, concat_ws(chr(10), '{security.OPEN} source=' || source || ' similarity=' || printf('%.4f', (rank + 1) / 8.0) || '>>>', {_text(context.DATA_BANNER)}, {_sql_neutralised("coalesce(text, '')")}, '{security.CLOSE}') as block from spots join documents using (doc_id)),
held as (select qid, string_agg(block, chr(10) || chr(10) order by rank) as shown from blocks group by qid),
prompted as (select qid, concat_ws(chr(10) || chr(10), {_text(prompts.RULES)}, '{prompts.QUERY}' || chr(10) || {_sql_neutral("coalesce(message, '')")} || chr(10), {_text(prompts.PREAMBLE)}, coalesce(shown, '{prompts.NO_BLOCKS}'), {_text(prompts.REMINDER)}) as prompt from asked left join held using (qid))"""


@query(f"with {PROMPTS_SQL} select qid, length(prompt) as chars, sha256(prompt) as prompt_sha256 from prompted")
def built_prompts(spark, sf_dir):
    """Prompts of all messages with two fenced documents, or none."""
    built = prompts.prompts(asked_messages(spark, sf_dir), fenced_for(spark, sf_dir))
    return built.select("qid", F.length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


#: Replies as they may come: sound, with a broken source, and malformed in turn.
BODIES = (
    '{"response": "- One fact.\\n- Two facts.", "classification": "in_scope", "outcome": "answered", "sources": [{"source_file": "a.md", "section": "A > B", "similarity": 0.5}, {"source_file": 7}, 3, {"section": "x"}], "retrieval_scores": [0.5]}',
    '{"response": "No.", "classification": "injection", "outcome": "blocked_injection"}',
    '{"response": " ", "classification": "in_scope", "outcome": "answered"}',
    '{"response": 5, "classification": "in_scope", "outcome": "answered"}',
    '{"response": "x", "classification": "in_scope", "outcome": "done"}',
    '{"response": "x", "classification": "other", "outcome": "answered"}',
    '{"response": "x", "classification": "in_scope", "outcome": "no_context", "sources": {"source_file": "a.md"}}',
    "not json", "[1, 2]",
)
#: What becomes of them: (state, statements, sources).
PARSED = (("answered", 2, 1), ("blocked", 1, 0)) + (("malformed", 0, 0),) * 7


@query(
    f"with kinds(k, state, statements, sources) as (values {', '.join(f'({k}, {_text(s)}, {a}, {b})' for k, (s, a, b) in enumerate(PARSED))}) "
    f"select conv_id, turn, state, statements, sources from conversations join kinds on k = (conv_id * 7 + turn) % {len(BODIES)}"
)
def parsed_replies(spark, sf_dir):
    """The state that a reply to each turn puts its reader into; replies are sound or broken by turn."""
    body = F.get(F.array(*(F.lit(b) for b in BODIES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(BODIES)).cast("int"))
    parsed = responses.with_parsed(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = F.col("parsed").isNotNull()
    return parsed.select(
        "conv_id", "turn", F.coalesce("parsed.state", F.lit("malformed")).alias("state"), F.when(held, size(responses.split_statements(F.col("parsed.response")))).otherwise(0).alias("statements"),
        F.when(held, size(F.col("parsed.sources"))).otherwise(0).alias("sources"),
    )


@query(
    "with requests as (select conv_id, turn, text, (conv_id + turn) % 7 as kind from conversations) select conv_id, turn, case when kind = 0 then '' when kind in (1, 2, 3) then '' when length(text) > 400 then '' when regexp_matches(text, '^\\s*$') then '' else text end as message, "
    "case when kind in (0, 1, 2) then 'malformed' when kind = 3 or regexp_matches(text, '^\\s*$') then 'blank' when length(text) > 400 then 'too_long' else '' end as error from requests"
)
def parsed_requests(spark, sf_dir):
    """Requests made of all turns, some of them broken: no JSON, a number for a message, a further field, a blank message."""
    text = F.coalesce("text", F.lit(""))
    kinds = F.array(F.lit("{"), F.lit('{"message": 5}'), F.to_json(F.struct(text.alias("message"), F.lit(1).alias("more"))), F.lit('{"message": " "}'))
    sound = F.to_json(F.struct(text.alias("message")))
    body = F.coalesce(F.get(kinds, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")), sound)
    read = responses.with_request(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")), 400)
    return read.select("conv_id", "turn", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("error", F.lit("")).alias("error"))


@query(
    f"with {PROFILE_SQL}, cited as (select doc_id, unnest([doc_id, doc_id, (doc_id * 7) % n]) as own, unnest(['Any > Part', 'Part', '']) as section, unnest([0, 1, 2]) as i from documents, (select count(*) as n from documents)), "
    "named as (select cited.doc_id, i, coalesce(title, 'Document') as document, case when section = '' then '' else 'Part' end as section from cited join files on own = files.doc_id left join profile using (source_file)), "
    "first as (select doc_id, document, section, min(i) as i from named group by all) select doc_id as qid, string_agg(document || '::' || section, '|' order by i) as shown from first group by doc_id"
)
def display_sources(spark, sf_dir):
    """Distinct documents and sections of three sources a document, as a reader is shown them."""
    own = corpus_files(spark, sf_dir).select("doc_id", "source_file")
    n = own.count()
    cites = F.array(F.struct(F.col("doc_id").alias("own"), F.lit("Any > Part").alias("section")), F.struct(F.col("doc_id").alias("own"), F.lit("Part").alias("section")), F.struct((F.col("doc_id") * 7 % n).alias("own"), F.lit("").alias("section")))
    each = own.select(F.col("doc_id").alias("qid"), F.posexplode(cites).alias("i", "c")).select("qid", "i", "c.own", "c.section").join(own.withColumnRenamed("doc_id", "own"), "own")
    replies = each.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "source_file", "section"))).alias("sources"))
    shown = responses.display_sources(replies, profile.file_profile(corpus_files(spark, sf_dir)))
    return shown.select("qid", F.array_join(F.transform("shown", lambda d: F.concat(d["document"], F.lit("::"), d["section"])), "|").alias("shown"))


@query(
    "select 'ok' as status, 'veritrail' as app, 'deterministic-extractive' as answerer, 'table' as embedding_model, 0.35::double as similarity_threshold, (select count(*) from embeddings) as index_size, "
    "(select max(len(embedding)) from embeddings) as index_dimension, (select count(distinct source) from documents) as knowledge_base_documents"
)
def health(spark, sf_dir):
    """The state of the index."""
    found = responses.health(table(spark, sf_dir, "documents").withColumnRenamed("source", "source_file"), table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec"), "veritrail", "table", dense.THRESHOLD)
    return found.withColumn("index_dimension", F.col("index_dimension").cast("long"))


# -- chunks and statements of made-up files, whose parts are known in closed form -----------------------


def solid_files(spark, sf_dir) -> DataFrame:
    """Each document without white space as one long line, and a short section after it."""
    solid = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9.,!?;]", "")
    return table(spark, sf_dir, "documents").select(F.format_string("%s/doc-%d.md", "source", "doc_id").alias("source_file"), F.concat(solid, F.lit("\n\n# Part\n\n- short")).alias("text"))


@query(
    f"with solid as (select source || '/doc-' || doc_id || '.md' as source_file, 'doc-' || doc_id as stem, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9.,!?;]', '', 'g') as t from documents), "
    f"long as (select source_file, stem, 'Document' as section, t[i * {chunking.MAX_CHARS} + 1:(i + 1) * {chunking.MAX_CHARS}] as text, '' as path, 0 as heading_level, 1 as start_line, 1 as end_line, i * {chunking.MAX_CHARS} as char_start, "
    f"least((i + 1) * {chunking.MAX_CHARS}, length(t)) as char_end, i as ordinal from solid, unnest(range((length(t) + {chunking.MAX_CHARS} - 1) // {chunking.MAX_CHARS})) u(i)), "
    f"tail as (select source_file, stem, 'Part' as section, '# Part' || chr(10) || chr(10) || '- short' as text, 'Part' as path, 1 as heading_level, 3 as start_line, 5 as end_line, length(t) + 2 as char_start, length(t) + 17 as char_end, "
    f"(length(t) + {chunking.MAX_CHARS} - 1) // {chunking.MAX_CHARS} as ordinal from solid), rows as (select * from long union all select * from tail) "
    "select stem || '-' || printf('%04d', ordinal) || '-' || left(sha256(source_file || chr(0) || section || chr(0) || ordinal || chr(0) || text), 12) as chunk_id, source_file, section, text, path, heading_level, start_line, end_line, char_start, char_end, ordinal from rows"
)
def chunked_lines(spark, sf_dir):
    """Chunks of lines without a place to cut, and of a section with a heading: pieces, offsets, lines and ids."""
    cut = chunking.chunk_documents(solid_files(spark, sf_dir))
    whole = [F.col(c).cast("long").alias(c) for c in ("heading_level", "start_line", "end_line", "char_start", "char_end", "ordinal")]
    return cut.select("chunk_id", "source_file", "section", "text", F.array_join("heading_path", " > ").alias("path"), *whole)


@query(
    "with a as (select doc_id, coalesce(nullif(left(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 30), ''), 'x') as a from documents) "
    "select doc_id, unnest(range(6)) as n, unnest(['Fact ' || a || '.', 'Next ' || a || ' 9.11.', 'bullet ' || a || ' goes on', 'k: ' || a || '; z', 'It is ' || a || '.', 'So it is.']) as text, "
    "unnest(['', '', '', '', 'What is ' || a || '?', '']) as prompt, unnest([false, false, true, false, false, false]) as is_list_item from a"
)
def stated_units(spark, sf_dir):
    """Statements of files that have one of each kind of line, with words of each document in them."""
    a = F.coalesce(F.expr("nullif(left(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''), 30), '')"), F.lit("x"))
    front = F.when(F.col("doc_id") % 2 == 0, "---\ncategory: x\n---\n").otherwise("")
    parts = ["# H\n\nFact ", a, ". Next ", a, " 9.11.\n\n- bullet **", a, "**\n  goes on\n\n| Name | Value |\n|---|:-:|\n| k | [", a, "](http://x) | `z` |\n\n**What is ", a, "?**\nIt is ", a, ". So it is.\n"]
    text = F.concat(front, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    units = evidence.with_evidence_units(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", F.posexplode("units").alias("n", "u"))
    return units.select("doc_id", F.col("n").cast("long").alias("n"), "u.text", F.coalesce("u.prompt", F.lit("")).alias("prompt"), "u.is_list_item")


_CUT = "regexp_replace(left(text, 320), ' [^ ]*$', '')"


@query(
    f"with cut as (select doc_id, case when length(text) <= 320 then text else regexp_replace({_CUT}, '[ ,;:]+$', '') || '...' end as clipped from (select doc_id, coalesce(text, '') as text from documents)) "
    "select doc_id, clipped, case when regexp_matches(clipped, '[.!?]$') then clipped else clipped || '.' end as sentence from cut"
)
def clipped_sentences(spark, sf_dir):
    """Every document cut to a statement's length, and as a sentence."""
    cut = table(spark, sf_dir, "documents").select("doc_id", T.clip(F.coalesce("text", F.lit(""))).alias("clipped"))
    return cut.withColumn("sentence", T.as_sentence(F.col("clipped")))


@query(f"with {MARKED_SQL} select message_id, length(text) >= 2 and not ({_sql_any(T.DIRECTIVES)}) and not ({_sql_any(T.META_RULES)}) and len({T.sql_content_terms('text')}) > 0 as answerable from messages")
def answerable_messages(spark, sf_dir):
    """Messages that could be evidence."""
    return marked_messages(spark, sf_dir).select("message_id", T.is_answerable(F.col("text")).alias("answerable"))


_DRESSED = "'**' || doc_id || '**  [' || coalesce(left(text, 40), '') || '](http://x.y/' || doc_id || ') _`' || coalesce(source, '') || '`_ '"


@query(
    f"with lines as (select doc_id, {_DRESSED} as line from documents) select doc_id, "
    "trim(regexp_replace(regexp_replace(regexp_replace(line, '\\*{1,3}|_{1,3}|`+', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\s{2,}', ' ', 'g')) as line from lines"
)
def clean_lines(spark, sf_dir):
    """Lines with emphasis, a link and code around the beginning of each document, without them."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(F.expr(_DRESSED)).alias("line"))


_LETTERS = "'q' || left(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''{0}), 12)"


@query(f"with a as (select doc_id, {_LETTERS.format(chr(44) + chr(39) + 'g' + chr(39))} as a from documents) select doc_id as qid, 'alpha' || a || ' bravo' || a || ' gamma' || a || ' delta' || a || '|alpha' || a || ' lima' || a || ' oscar' || a || ' tango' || a as kept from a")
def kept_statements(spark, sf_dir):
    """Of five statements of words of each document the two that repeat nothing: others are equal, share most words, or say most of a shorter one."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LETTERS.format("")).alias("a"))
    forms = ("alpha bravo gamma delta", "Alpha, BRAVO gamma: delta!", "alpha bravo gamma other", "alpha lima oscar tango", "limas oscars tangos uniform victor whiskey yankee")
    said = F.array(*(F.concat_ws(" ", *(F.concat(F.lit(w.rstrip(",:!s") if k == 4 else w.rstrip(",:!")), F.upper("a") if w.isupper() else F.col("a"), F.lit("s" if k == 4 and w.endswith("s") else "")) for w in f.split())) for k, f in enumerate(forms)))
    rows = a.select(F.col("doc_id").alias("qid"), F.posexplode(said).alias("rank", "statement"))
    return selection.without_repeats(rows, 5).select("qid", F.array_join("kept", "|").alias("kept"))


@query(f"select user_id as qid, event_id from events qualify value >= {selection.SCORE_FLOOR} * max(value) over (partition by user_id)")
def relative_floor(spark, sf_dir):
    """Events of at least a share of their user's largest value."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), "event_id", F.col("value").alias("peak"))
    return selection.above_floor(rows).select("qid", "event_id")


# -- after retrieval ---------------------------------------------------------------------------------------

_FOUND = "placed join chunks using (position) where (qid % 3 + 3) % 3 <> 0"


@query(
    f"with {BLOCKS_SQL}, met_hits as materialized (select qid, domain, source_file from {_FOUND}), seen as (select qid, bool_or(list_contains(owners, domain) or list_contains(owners, 'file:' || source_file)) as owned from met_hits join keyed_subjects using (qid) group by qid) "
    f"select qid, seen.qid is not null as found, not s.owners or coalesce(seen.owned, false) as owned, (seen.qid is null or not (not s.owners or coalesce(seen.owned, false))) and (len({T.sql_content_terms('message')}) = 0 or not lexical_support) and documents as again "
    "from support s join asked using (qid) left join seen using (qid)"
)
def fallback_questions(spark, sf_dir):
    """Whether retrieval found anything, anything of what owns the answer, and whether a question searches its files again; every third question found nothing."""
    subjects = supported(spark, sf_dir)
    asked, described = asked_blocks(spark, sf_dir)
    keyed = stored(described.select("position", "keys"), "keys")
    hits = asked.filter(F.pmod("qid", F.lit(3)) != 0).join(keyed.select("position"), "position", "left_semi")
    again = chat.searches_again(subjects, hits, keyed).select("qid", F.lit(True).alias("again"))
    return chat.misses_owner(subjects, hits, keyed).join(again, "qid", "left").withColumn("again", F.coalesce("again", F.lit(False)))


@query(
    "with n as (select count(*) as n from documents), hits as (select item_id as qid, r as rank, (item_id * 7 + r * 13) % n as position, r / 8.0 as similarity from benchmark, range(4) t(r), n), "
    "held as (select hits.*, source as source_file, lang as section, item_id % 3 <> 0 and r2 as cited from (select *, qid as item_id, rank in (1, 3) as r2 from hits) hits join documents on doc_id = position), "
    "kept as (select * from held where cited or not (select bool_or(h.cited) from held h where h.qid = held.qid)) "
    "select qid, string_agg(position || ':' || source_file || ':' || section, '|' order by rank) as sources, string_agg(cast(similarity as decimal(6, 3)), ',' order by rank) as scores from kept group by qid"
)
def cited_sources(spark, sf_dir):
    """Sources and scores of replies that cite two of their four hits, or, for every third, what was not retrieved."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.col("source").alias("source_file"), F.col("lang").alias("section"))
    n = docs.count()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: (F.col("item_id") * 7 + r * 13) % n)).alias("rank", "position"))
    hits = items.join(docs, "position").withColumn("similarity", F.col("rank") / 8.0)
    # a citation names one hit, so files carry their position
    hits = hits.withColumn("source_file", F.concat("source_file", F.lit("/"), F.col("position").cast("string")))
    own = F.when((F.col("qid") % 3 != 0) & F.col("rank").isin(1, 3), T.citation(F.col("source_file"), F.col("section")))
    cites = hits.groupBy("qid").agg(F.collect_list(own).alias("citations"))
    used = chat.used_sources(hits, cites)
    shown = F.transform("sources", lambda s: F.concat_ws(":", s["position"].cast("string"), F.substring_index(s["source_file"], "/", 1), s["section"]))
    scores = F.transform("sources", lambda s: s["similarity"].cast("decimal(6,3)").cast("string"))
    return used.select("qid", F.array_join(shown, "|").alias("sources"), F.array_join(scores, ",").alias("scores"))
