"""What several operators of this subpackage share: scratch tables, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line definitions: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one of this machine only on a local master without it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Deletes at its end all scratch tables that were written inside: for a caller that has written its result by then."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        drop_tables(*made)


def drop_tables(*tables: DataFrame) -> None:
    """Delete scratch tables that no result reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no added column can clash with them."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])


def unpacked(row: str, columns: list[str]) -> list[Column]:
    """Columns of the struct column row."""
    return [F.col(row)[c].alias(c) for c in columns]


def row_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes that together identify the values of cols, nulls included; equal rows get equal keys."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WS_RUN))).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (node, component) for each node of an edge to another node.

    component is the smallest node reachable. Alternates large-star and small-star rounds until the edges are stars around their
    smallest nodes. A round is two partial aggregations, whose results are written, and two joins with them: so both sides of
    a join come straight from an exchange and adaptive execution splits the rows of a hub over tasks. Tables of a finished round
    are deleted.
    """

    def settled(e: DataFrame) -> bool:
        """Each node above another has one edge, and none below it has one to a smaller node."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1 and up > 0").count()

    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = large.join(lower, "u")
        kept = pairs.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = table(kept.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_tables(e, least, large, lower)
        e = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
