"""Line dedup across documents by range-partitioned line hashes.

Lines become (hash, document, position) rows, range-partitioned by hash and document, so a line that a third of all
documents hold is spread over many tasks. Inside a range partition rows stream by in the order hash, document, position (the
secondary sort); a row number restarts with each hash and document, and its ones are the first occurrences. They are
counted by hash, partial sums first. What leaves is a keep bitmap for each document that loses lines, compressed to the runs
of its ones; no text travels with the lines.

Defined cases: a null text is one empty line; a document without doc_id neither counts nor loses lines; rows that share
a doc_id are one document for the counts, each row keeping its own bitmap; other columns pass through apply_bitmaps, also
with the names used here (n_lines and n_dropped are replaced); texts and lines of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, drop_tables, lower_ascii, row_key, table, unpacked, whole_row


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def first_occurrences(occ: DataFrame) -> DataFrame:
    """The first of the rows (h1, h2, doc_id, pos) of each line and document, streamed in order from range partitions."""
    in_order = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "k1", "k2")
    return occ.repartitionByRange("h1", "h2", "doc_id").withColumn("nth", F.row_number().over(in_order)).where("nth = 1").drop("nth")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, k1, k2, keep) for each document that loses lines: its keep bitmap as runs (first, count) of kept lines.

    A key of at least min_chars code points found in at least min_docs documents stays only in the largest doc_id.
    """
    key = lower_ascii(F.btrim("line", F.lit(WS)))
    lines = docs.where("doc_id is not null").select("doc_id", *row_key("doc_id", "text"), _lines(F.col("text")).alias("lines"))
    occ = lines.select("doc_id", "k1", "k2", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    occ = occ.where(F.char_length("line") >= min_chars).withColumn("key", key).where(F.char_length("key") >= min_chars)
    occ = table(occ.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "pos", "n", "k1", "k2"), "lines")
    found = first_occurrences(occ).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
    # written, so that the rows of a very common line are split over tasks when they are joined
    owners = table(found.where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner"), "owners")
    dropped = occ.join(owners, ["h1", "h2"]).where("doc_id <> owner")
    dropped = dropped.groupBy("doc_id", "k1", "k2").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("d"))
    starts = F.expr("concat(array(0), transform(filter(d, (x, i) -> i = size(d) - 1 or d[i + 1] <> x + 1), x -> x + 1))")
    ends = F.expr("concat(filter(d, (x, i) -> i = 0 or d[i - 1] <> x - 1), array(n))")
    runs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), (e - s).alias("count"))), lambda r: r["count"] > 0)
    out = table(dropped.select("doc_id", "k1", "k2", runs.alias("keep")), "bitmaps")
    drop_tables(occ, owners)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text reduced to the kept lines, and the long columns n_lines and n_dropped (theirs replaced)."""
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    keyed = docs.select(whole_row(docs).alias("row"), *row_key("doc_id", "text"))
    j = keyed.join(bitmaps.select("k1", "k2", "keep").hint("shuffle_hash"), ["k1", "k2"], "left")
    j = j.withColumn("lines", _lines(F.col("row.text")))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["first"] + 1, r["count"]))), "\n")
    text = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(kept)
    n_lines = F.size("lines").cast("long")
    n_kept = F.aggregate("keep", F.lit(0).cast("long"), lambda a, r: a + r["count"])
    made = j.select("row", text.alias("kept_text"), n_lines.alias("n"), F.coalesce(n_lines - n_kept, F.lit(0)).cast("long").alias("gone"))
    return made.select(*unpacked("row", own), F.col("kept_text").alias("text"), F.col("n").alias("n_lines"), F.col("gone").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
