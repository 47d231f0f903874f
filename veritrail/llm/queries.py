"""The queries of this subpackage with the results they are held to, and their SQL."""

from __future__ import annotations

import hashlib
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, delta_lloyd, language_id, license_scan, merkle, near_dedup, pii, piece_model, telephony, token_pack, toxicity, url_filter
from .shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(toxicity.fold(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, fitted, output="score")
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language_id.with_language(docs.select("doc_id", "text"), language_id.fit(docs))
    return judged.select("doc_id", held_out(), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


#: Ids of byte_bpe_50k.json, its special token among them.
BYTE_BPE_IDS = 50_257


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = token_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), BYTE_BPE_IDS)

    def measure(run: token_pack.Run, ahead: int) -> list[pa.Array]:
        ids = memoryview(run.ids(0, run.n_ids).astype("<u4").tobytes())
        crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(run.starts[:-1].tolist(), run.starts[1:].tolist())]
        return [token_pack.document_ids(run.doc_ids), pa.array(run.starts[:-1] + ahead), pa.array(np.diff(run.starts)), pa.array(crcs, pa.int64())]

    return token_pack.read_documents(runs, measure, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and crc32 (as little-endian 32-bit) of its ids, digest of the decoded text, and whether it is the text."""
    return sentencepiece_digests(_table(spark, sf_dir, "documents"))


def sentencepiece_digests(docs: DataFrame) -> DataFrame:
    def digest(doc_ids: pa.Array, texts: pa.Array, ids: np.ndarray, counts: np.ndarray, decoded: list[bytes]) -> list[pa.Array]:
        ends = np.cumsum(counts)
        data = memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
        same = [t.as_buffer().to_pybytes() == d if t.is_valid else not d for t, d in zip(texts.cast(pa.binary()), decoded)]
        return [doc_ids, pa.array(counts), pa.array(crcs, pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()), pa.array(same, pa.bool_())]

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return piece_model.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model"), digest, schema)


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_media_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules that op4 applies.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.with_verdicts(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
with parts as (
  select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end as rest from pages
), cut as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
select page_id, host, path,
  (select arg_max(rule_host || rule_path, length(rule_host || rule_path)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule,
  coalesce((select arg_max(rule_verdict, length(rule_host || rule_path)) from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)), 'allow') as verdict
from cut
"""

#: The conversation that op6 adds.
PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    out = stored(chat_format.format_conversations(turns.unionByName(probe)), "chat")
    read = out.withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn("loss", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size(F.array_distinct(F.transform("turns", lambda t: t["block"]))).cast("long").alias("n_blocks"),
    )


def _sql_escape(text: str) -> str:
    for old, new in chat_format._steps():
        text = f"replace({text}, '{old}', '{new}')"
    return text


OP6_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), runs as (
  select *, coalesce(role <> lag(role) over (partition by conv_id order by turn nulls first, role, text), true) as fresh from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(length({_sql_escape('text')}) + case when fresh then length({_sql_escape('role')}) + 17 else 6 end) as bigint) as formatted_chars,
  count(*) filter (where fresh) as n_blocks
from runs group by conv_id
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, license_scan.templates(spark))


def _sql_bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def _sql_words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' ')"


OP7_SQL = f"""
with templates(license, template) as (values {', '.join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in license_scan.TEMPLATES)}),
given as (select license, {_sql_bigrams('w')} as t from (select license, {_sql_words('template')} as w from templates)),
units as (
  select distinct doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n|[.!?]+\\s+'), string_split_regex(text, '\\n\\s*\\n'), [text])) as unit from documents
), sets as (select doc_id, unit, {_sql_bigrams('w')} as u from (select doc_id, unit, {_sql_words('unit')} as w from units)),
compared as (
  select doc_id, license, unit, 2.0::double * len(list_intersect(u, t)) / (len(u) + len(t)) as dice from sets, given
  where len(u) > 0 and len(u) between floor(len(t) * {license_scan.DICE} / (2 - {license_scan.DICE})) and ceil(len(t) * (2 - {license_scan.DICE}) / {license_scan.DICE})
)
select doc_id, license, max(dice) as dice, count(distinct unit) as units from compared where dice >= {license_scan.DICE} group by doc_id, license
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    whole = pii.span_text(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), whole.alias("spans"), F.size("added").cast("long").alias("n_added"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    other = merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    proven = merkle.manifest(docs, other=other)
    found = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.col("other"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


#: The unsigned crc32 of an ASCII text, bit by bit.
_SQL_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda h: ascii(h)::bigint)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_LOWERED = f"case when {_SQL_CRC32.format('doc_id::varchar')} % 3 = 0 then translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') else text end"


def _sql_tree(leaves: str, up: str, steps: str) -> str:
    """CTEs with all nodes over leaves (tree, i, n, digest), and each one's siblings before and after it."""
    return f"""{up}(tree, level, i, n, digest) as (select tree, 0, i, n, digest from {leaves} union all
  select tree, level + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' order by i)) from {up} where n > 1 group by tree, level, i // 8),
{steps} as (select a.tree, a.level, a.i, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i < a.i), '') as before, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i > a.i), '') as after
  from {up} a join {up} b on a.tree = b.tree and a.level = b.level and a.i // 8 = b.i // 8 where a.n > 1 group by all)"""


OP12_SQL = f"""
with recursive rows as (
  select doc_id, coalesce('=' || lang, '') as tree, {' || '.join(map(_sql_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))} as content,
    {' || '.join(map(_sql_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_sql_field(f'({_LOWERED})')} as changed from documents
), leaves as (
  select doc_id, tree, sha256(content) as digest, sha256(changed) as other, row_number() over (partition by tree order by doc_id nulls first) - 1 as i, count(*) over (partition by tree) as n from rows
), {_sql_tree('leaves', 'up', 'steps')},
subroots as (select '' as tree, tree as own, row_number() over (order by tree) - 1 as i, count(*) over () as n, digest from up where n = 1),
{_sql_tree('subroots', 'above', 'last')},
walk(doc_id, tree, leaf, level, i, proof, folded) as (select doc_id, tree, digest, 0, i, '', other from leaves union all
  select w.doc_id, w.tree, w.leaf, w.level + 1, w.i // 8, proof || before || after, sha256(before || folded || after) from walk w join steps s on s.tree = w.tree and s.level = w.level and s.i = w.i),
climbed as (select w.doc_id, leaf, s.digest as subroot, s.i, proof, folded from walk w join subroots s on s.own = w.tree where not exists (select 1 from steps t where t.tree = w.tree and t.level = w.level and t.i = w.i)),
finish(doc_id, leaf, subroot, level, i, proof, folded) as (select doc_id, leaf, subroot, 0, i, proof, folded from climbed union all
  select w.doc_id, leaf, subroot, w.level + 1, w.i // 8, proof || before || after, sha256(before || folded || after) from finish w join last s on s.level = w.level and s.i = w.i)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from finish w, (select digest as root from above where n = 1) where not exists (select 1 from last t where t.level = w.level and t.i = w.i)
"""


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(delta_lloyd.kept_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")), "delta-kept")
    books = delta_lloyd.train(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = delta_lloyd.with_label_error(stored(delta_lloyd.with_codes(kept, books).drop("vec"), "delta-codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books.text().encode()).hexdigest()).alias("codebooks_sha256"))


def _sql_rounds() -> str:
    """CTEs of each round's assignments and codebooks, and the last assignments."""
    gap = "list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::bigint"
    out = ["book0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v as c from parts qualify e < 16)"]
    for r in range(delta_lloyd.ROUNDS + 1):
        out.append(f"given{r} as materialized (select vec_id, p, v, e, {gap} as gap from parts join book{r} using (p) qualify row_number() over (partition by vec_id, p order by gap, e) = 1)")
        if r < delta_lloyd.ROUNDS:
            out.append(f"sums{r} as (select p, e, j, floor(sum(v[j]) / count(*))::bigint as x from given{r}, range(1, 9) t(j) group by p, e, j), means{r} as (select p, e, list(x order by j) as c from sums{r} group by p, e)")
            out.append(f"book{r + 1} as materialized (select p, e, coalesce(m.c, b.c) as c from book{r} b left join means{r} m using (p, e))")
    return ", ".join(out)


#: For vectors of 64 components.
OP13_SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, q[p * 8 + 1:p * 8 + 8] as v from kept, range(8) t(p)), {_sql_rounds()},
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(gap)::bigint as error from given{delta_lloyd.ROUNDS} group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book{delta_lloyd.ROUNDS}) as codebooks_sha256
from coded join kept using (vec_id)
"""


def queries() -> dict:
    named = (op1_toxicity, op2_near_dedup, op3_token_pack, op4_url_filter, op5_sentencepiece, op6_chat_format, op7_license_scan, op8_language, op9_telephony, op10_decontaminate, op11_pii, op12_merkle, op13_delta_lloyd)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op6_chat_format": OP6_SQL, "op7_license_scan": OP7_SQL, "op12_merkle": OP12_SQL, "op13_delta_lloyd": OP13_SQL}
