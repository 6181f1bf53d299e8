"""Exact top-k by inner product: three-phase uniform threshold over lists of partial scores.

The dimensions are cut into `lists` slices. A slice of a block of vectors is a node of the algorithm: it knows only partial
scores, those of its dimensions. A score is the sum of its partial scores.

1. Each slice gives every query its k + 1 best partial scores. These candidates get their exact scores; the (k + 1)-th best
   row among them is a cutoff that no row of the answer falls below.
2. The cutoff travels to all slices with the queries. What reaches it has a partial score of cutoff / lists or more in some
   slice, so each slice gives all such entries, and no others.
3. The scores of the collected entries are resolved exactly, from whole vectors; the best k rows are the answer.

Equal vectors are one class: it is compared once and stands for its k + 1 smallest vec_id, more of which no query can list;
queries of a class share one search, k + 1 deep, and each drops its own row. Queries and vectors meet as tiles of bounded
size, a block of one with a block of the other: the work is that of the stated queries against all rows, the shuffle that
of the packed blocks. All arithmetic is of integers: floating-point products only where sums stay below 2^53.

Defined cases: a vector that is null, empty, or holds null or non-finite components, or that has no vec_id, takes no part; a
component is held within +-2^24 after scaling, so that scores of up to 2^14 dimensions fit 64 bits; a vector shorter than
others counts as filled up with zeros; rows that share a vec_id are one vector, the smallest in array order; other columns
are not looked at; an empty table gives no rows; with fewer than k others all are listed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

LIMIT = 1 << 24
_ENTRIES = "query long, cls long, slice int, partial long"


def scaled(vector: Column, by: int = 1024) -> Column:
    """floor(by * x) of each component, as int."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(by * x.cast("double")))).cast("int"))


def classes_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((cls, ids, ints), (query_id, cls)): each different vector with its k + 1 smallest ids, cls the least of them; and each query's."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for NaN, which is above infinity
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", scaled(F.col("embedding")).alias("ints"))
    rows = rows.groupBy("vec_id").agg(F.min("ints").alias("ints"))
    rows = table(rows.select("vec_id", F.xxhash64("ints").alias("h1"), F.xxhash64(F.lit("second"), "ints").alias("h2"), "ints"), "vectors")
    # the limit on the row number lets each task send few rows of a class
    least = rows.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    classes = table(least.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("ints").alias("ints")), "classes")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(classes.select("h1", "h2", "cls"), ["h1", "h2"])
    return classes.select("cls", "ids", "ints"), table(asked.select("query_id", "cls"), "queries")


def _packed(rows: DataFrame, block_rows: int, dims: int, lists: int) -> tuple[DataFrame, int]:
    """Blocks of about block_rows of the rows (cls, ints, cutoff) as one row a slice: (block, slice, ids, matrix, cutoffs)."""
    n = max(1, -(-rows.count() // block_rows))
    cuts = np.linspace(0, dims, lists + 1).astype(int)

    def pack(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ints = block["ints"].combine_chunks()
        size = ints.value_lengths().to_numpy()
        whole = np.zeros((len(size), dims), np.int32)
        whole[np.arange(dims) < size[:, None]] = ints.flatten().to_numpy()
        ids, cutoff = block["cls"].to_numpy().astype(np.int64), block["cutoff"].to_numpy().astype(np.int64)
        parts = [np.ascontiguousarray(whole[:, a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"block": pa.array([block["block"][0].as_py()] * lists, pa.int32()), "slice": pa.array(range(lists), pa.int32()), "ids": pa.array([ids.tobytes()] * lists, pa.binary()), "matrix": pa.array(parts, pa.binary()), "cutoffs": pa.array([cutoff.tobytes()] * lists, pa.binary())})

    dealt = rows.select("cls", "ints", "cutoff", F.pmod(F.xxhash64("cls"), F.lit(n)).cast("int").alias("block"))
    return table(dealt.groupBy("block").applyInArrow(pack, "block int, slice int, ids binary, matrix binary, cutoffs binary"), "blocks"), n


def _tiles(vectors: tuple[DataFrame, int], queries: tuple[DataFrame, int], each: Callable, lists: int) -> DataFrame:
    """each(partial scores, cutoffs of the queries) -> (query, vector) indexes, for every tile."""
    (v, nv), (q, nq) = vectors, queries
    v = v.select(F.col("block").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "slice", "ids", "matrix")
    q = q.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"), "slice", "ids", "matrix", "cutoffs")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            (ids, m), (asked, a, cut) = (tuple(np.frombuffer(t[c][0].as_py(), d) for c, d in (("ids", np.int64), ("matrix", np.int32), ("cutoffs", np.int64)) if c in t.column_names) for t in (left, right))
            m, a = m.reshape(len(ids), -1), a.reshape(len(asked), -1)
            most = float(np.abs(m).max(initial=0)) * float(np.abs(a).max(initial=0)) * m.shape[1]
            kind = np.float64 if most < 2**53 else np.int64
            m = m.astype(kind).T
            for lo in range(0, len(asked), 256):
                part = (a[lo : lo + 256].astype(kind) @ m).astype(np.int64)
                row, at = each(part, ids, cut[lo : lo + 256])
                found.append((asked[lo + row], ids[at], part[row, at]))
        query, cls, partial = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        part_no = left["slice"][0].as_py() if len(left) else 0
        return pa.table({"query": query, "cls": cls, "slice": pa.array(np.full(len(query), part_no, np.int32)), "partial": partial})

    keys = ("vb", "qb", "slice")
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(tile, _ENTRIES)


def _best(n: int) -> Callable:
    """The n largest partial scores of each query, of equal ones the smallest ids."""

    def each(part: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if part.shape[1] <= n:
            return tuple(x.ravel() for x in np.indices(part.shape))
        floor = -np.partition(-part, n - 1, axis=1)[:, n - 1]
        row, at = np.nonzero(part >= floor[:, None])
        order = np.lexsort((ids[at], -part[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < n], at[place < n]

    return each


def _reaching(lists: int) -> Callable:
    """All entries with a partial score of cutoff / lists or more."""

    def each(part: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = -(-cut // lists)
        return np.nonzero(part >= least[:, None])

    return each


def _scored(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(query, cls, ids, score) of the pairs (query, cls), from whole vectors."""
    product = F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("long") * b, F.lit(0)))
    of = pairs.join(classes.select("cls", "ids", F.col("ints").alias("x")), "cls").join(classes.select(F.col("cls").alias("query"), F.col("ints").alias("y")), "query")
    return of.select("query", "cls", "ids", F.aggregate(product, F.lit(0).cast("long"), lambda s, p: s + p).alias("score"))


def top_k(vectors: DataFrame, k: int = 10, lists: int = 2, block_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by 100 the k rows of the highest inner product, ties to smaller ids.

    block_rows and query_rows bound a tile: its vectors and its queries. Larger ones send fewer copies of blocks.
    """
    classes, asked = classes_of(vectors, k)
    dims = classes.agg(F.max(F.size("ints"))).first()[0] or 1
    lists = min(lists, dims)
    blocks = _packed(classes.withColumn("cutoff", F.lit(0).cast("long")), block_rows, dims, lists)
    searched = table(classes.join(asked.select("cls").distinct(), "cls").select("cls", "ints"), "searched")
    # 1: local lists, and a cutoff from the exact scores of what they name
    first = _tiles(blocks, _packed(searched.withColumn("cutoff", F.lit(0).cast("long")), query_rows, dims, lists), _best(k + 1), lists)
    by_list = Window.partitionBy("query", "slice").orderBy(F.desc("partial"), "cls")
    named = first.withColumn("rn", F.row_number().over(by_list)).where(F.col("rn") <= k + 1).select("query", "cls").distinct()
    downward = Window.partitionBy("query").orderBy(F.desc("score"), "cls").rowsBetween(Window.unboundedPreceding, 0)
    so_far = _scored(named, classes).withColumn("rows", F.sum(F.size("ids")).over(downward))
    cutoffs = so_far.where(F.col("rows") > k).groupBy("query").agg(F.max("score").alias("cutoff"))
    # 2: all entries that may reach it; without a cutoff there are k rows or fewer, and all may
    lowest = F.lit(-(1 << 62)).cast("long")
    with_cut = searched.join(cutoffs, F.col("cls") == F.col("query"), "left").select("cls", "ints", F.coalesce("cutoff", lowest).alias("cutoff"))
    entries = _tiles(blocks, _packed(table(with_cut, "cutoffs"), query_rows, dims, lists), _reaching(lists), lists)
    # 3: exact scores
    collected = table(entries.select("query", "cls").distinct(), "collected")
    rows = _scored(collected, classes).select("query", F.explode("ids").alias("vec_id"), "score")
    place = lambda of: F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), "vec_id"))
    best = table(rows.withColumn("rn", place("query")).where(F.col("rn") <= k + 1).select("query", "vec_id", "score"), "best")
    own = asked.join(best, F.col("cls") == F.col("query")).where("query_id <> vec_id").withColumn("rank", place("query_id")).where(F.col("rank") <= k)
    return own.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
