"""A training corpus from documents: five operators in a row, each stage over all that its predecessor kept.

Defined cases, for all stages: columns besides doc_id, text, source and n_chars pass through, whatever their names; null
texts count as empty; an empty table gives no rows; whole texts are worked on, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwise.llm import jaccard_join, line_dedup, mixing, piece_fst, weak_labels
from tankwise.llm.common import drop_tables, row_key, scratch_dir, scratch_tables, table, unpacked, whole_row
from tankwise.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go: so do null, empty and blank texts; equal texts fare alike."""
    return weak_labels.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one; n_chars follows the text. Rows without doc_id keep all lines."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", whole_row(docs).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays, any of those without doc_id last.

    Each text is a document of its own, also where rows share a doc_id (20 bits of a hash tell their texts apart); texts without
    words are similar to nothing and stay. The operator's ids keep the order of doc_id, so that copies are compared with the
    earliest document first.
    """
    at, small = F.monotonically_increasing_id(), F.col("doc_id").between(0, (1 << 42) - 1)
    told_apart = F.shiftleft("doc_id", 20).bitwiseOR(F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    node = F.when(small, told_apart).otherwise(F.lit(1 << 62) + at)
    numbered = table(docs.select(at.alias("at"), node.alias("id"), whole_row(docs).alias("row")), "numbered")
    found = jaccard_join.similar_components(numbered.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("at").alias("at"))
    of = found.select(F.col("doc_id").alias("id"), "component_id").distinct()
    first = numbered.select("id", order.alias("order")).join(of, "id").groupBy("component_id").agg(F.min("order").alias("first"))
    return numbered.join(first.select(F.col("first.at").alias("at")), "at", "left_semi").select(unpacked("row", docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words, a broken number rounded up or down by hash in its proportion.

    A document without words is in no mix and goes; rows alike in doc_id, source and text are taken equally often.
    """
    share = mixing.mix(docs).groupBy("k1", "k2").agg(F.expr("avg(if(size > 0, taken / size, 0))").alias("share"))
    copies = F.expr("cast(floor(share + pmod(xxhash64(k2, k1), 1000000) / 1e6) as int)")
    taken = table(share.select("k1", "k2", copies.alias("copies")).where("copies > 0"), "copies")
    keyed = docs.select(whole_row(docs).alias("row"), *row_key("doc_id", "source", "text"))
    repeated = keyed.join(taken.hint("shuffle_hash"), ["k1", "k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(unpacked("row", docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip and ids of each document; repeated rows each give theirs."""
    return piece_fst.encode(docs, piece_fst.read_model(docs, PIECES), with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: The classifier, the mix and the shortest paths have no SQL form; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of documents; a stage's output and scratch tables are deleted once the next stage is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch_tables():
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before is not None:
            drop_tables(before)
        docs = before = spark.read.parquet(path)
        before.scratch_path = path
    return STAGES[-1][1](spark, docs, sf_dir)
