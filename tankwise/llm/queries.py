"""One query for each operator, applied with production parameters to its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, jaccard_join, kd_shards, lexical_search, license_scan, line_dedup, mixing, near_vectors, perplexity, piece_fst, surrogates, top_k, weak_labels

#: The vocabulary file; not part of the repository.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: The secret of the surrogates; without the variable one of this process, which nobody can look surrogates up with later.
SURROGATE_KEY = os.environ.get("SURROGATE_KEY") or secrets.token_hex(32)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.score(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_table(spark, sf_dir, "documents"), key=SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.kd_shards(_table(spark, sf_dir, "documents"), n_shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents"))


def op6_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return piece_fst.encode(docs, piece_fst.read_model(docs, PIECES))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "block_words", "quotas")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("k1", "k2")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_perplexity, op2_near_vectors, op3_surrogates, op4_kd_shards, op5_weak_labels, op6_piece_fst, op7_jaccard_join, op8_mixing, op9_license_scan, op10_line_dedup, op11_filter_audit, op12_top_k, op13_lexical_search,
    )}


_LINES = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {docs}
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), owners as (
  select key, max(doc_id) as owner from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select k.*, coalesce(owner <> doc_id, false) as dropped from keyed k left join owners o using (key)
)
"""

_AUDIT = r"""
with recursive d as (
  select coalesce(source, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id as label_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end as mask from d left join l on doc_id = label_id
), o as (
  select '' as s, 0 as used union all select s || c, used + bit from o, (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(c, bit) where used & bit = 0
), steps as (
  select s as filter_order, cast(length(p) as int) as step, s[length(p)] as filter, used - prior as bit, prior as before
  from (select s from o where length(s) = 5) join (select s as p, used, used - (1 << (ascii(s[-1]) - 65)) as prior from o where s <> '') on starts_with(s, p)
), r as (
  select *, mask & bit <> 0 as fails, mask & before = 0 as here from m, steps
) select part, filter_order, step, filter, count(*) filter (here and not fails) as kept, count(*) filter (here and fails) as removed, count(*) filter (fails and not here) as redundant,
  count(*) filter (mask = bit) as unique_fails, count(*) filter (here and fails and good = 1) as good_lost, count(*) filter (here and fails and toxic = 1) as toxic_lost,
  cast(sum(case when fails then 120 // bit_count(mask) else 0 end) as bigint) as shapley from r group by 1, 2, 3, 4"""

_TOP_K = """
with v as (
  select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding])
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_sum([q.e[i] * v.e[i] for i in range(1, len(v.e) + 1)]) as bigint) as score from v as q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
) select query_id, cast(n as int) as rank, vec_id, score from r where n <= 10"""

_SEARCH = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), c as (
  select count(*) as docs, sum(len(w)) as total from d where len(w) > 0
), tf as (
  select doc_id, len(w) as n, term, count(*) as tf from (select doc_id, w, unnest(w) as term from d) group by all
), df as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, c group by term
), b as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where item_id is not null
), s as (
  select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) as bigint) as score
  from b join tf using (term) join df using (term), c group by item_id, doc_id
), r as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as place from s where score > 0
) select item_id, cast(place as int) as rank, doc_id, score from r where place <= 10"""

ORACLE_SQL = {
    "op11_filter_audit": _AUDIT,
    "op12_top_k": _TOP_K,
    "op13_lexical_search": _SEARCH,
    "op10_line_dedup": _LINES.format(docs="documents") + """
        select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not
          dropped), '')) as kept_sha256 from marked group by doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
