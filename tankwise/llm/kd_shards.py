"""K-d tree shards: split at distributed weighted medians along the widest metadata dimension.

Each document becomes one row of 15-bit coordinates and its bytes. A node that must give k leaves is split along the
dimension with the widest normalised range at the weighted k/2 quantile. The quantile is found digit by digit: sums of
bytes by node and 13-bit digit, at most 8192 rows a node, summed up by a window in Spark; one row a node reaches the
driver. All nodes of a level are searched at once, and the rows with their nodes are written once a level, so no plan grows
with the depth of the tree. Equal coordinates are told apart by a hash of the document, so a hot source or a group of copies splits too.

Defined cases: a null text has no bytes (crc of none is 0); null metadata is coordinate 0; identical rows are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, row_key, table

#: Keys have 63 bits; a node has at most 2 ** DIGIT sums at once.
DIGIT, DIGITS = 13, 5
ROWS_A_BUCKET = 20_000


def document_dims() -> dict[str, Column]:
    named = {c: F.crc32(F.col(c).cast("binary")).cast("double") for c in ("source", "lang")}
    return named | {"length": F.log1p(F.octet_length("text").cast("double")), "doc": F.col("doc_id").cast("double")}


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None, tolerance: float = 2e-4) -> DataFrame:
    """(k1, k2, doc_id, size, text_crc32, shard, slot) for each row; shards number ceil(bytes / target_bytes) unless given.

    A search for a median stops early once its digit holds less than tolerance of the node's bytes.
    """
    dims = dims or document_dims()
    text = F.coalesce("text", F.lit(""))
    size, crc, rid = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")), F.monotonically_increasing_id()
    meta = docs.select("doc_id", *row_key("doc_id", "source", "lang", "text"), size.alias("size"), crc.alias("text_crc32"), rid.alias("rid"), *[c.alias(f"x{i}") for i, c in enumerate(dims.values())])
    meta = table(meta, "meta")
    ends = meta.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    leaves = n_shards or max(1, -(-(ends["size"] or 0) // target_bytes))
    tie = F.expr("(k1 & 4294967295L) << 16 | pmod(rid, 65536)")

    def coordinate(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        at = F.floor((F.col(f"x{i}") - F.lit(lo)) / F.lit(hi - lo) * 32767) if lo is not None and hi > lo else F.lit(0)
        return F.coalesce(at, F.lit(0)).cast("long")

    rows = meta.select("doc_id", "k1", "k2", "size", "text_crc32", "rid", F.array(*[F.shiftleft(coordinate(i), 48).bitwiseOR(tie) for i in range(len(dims))]).alias("keys"), F.lit(1).cast("long").alias("node"))
    rows = table(rows, "level")
    drop_tables(meta)
    want, done = {1: leaves}, []
    while any(k > 1 for k in want.values()):
        active = {n: k for n, k in want.items() if k > 1}
        cuts = _cuts(rows, active, len(dims), tolerance)
        spark = docs.sparkSession
        got = spark.createDataFrame([(n, d, c) for n, (d, c) in cuts.items()] or [(0, 0, 0)], "cut_node long, dim int, cut long")
        side = F.coalesce((F.element_at("keys", F.col("dim") + 1) >= F.col("cut")).cast("long"), F.lit(0))
        child = F.when(F.col("cut_node").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)
        after = rows.join(F.broadcast(got), F.col("node") == F.col("cut_node"), "left").withColumn("node", child).drop("cut_node", "dim", "cut")
        old, rows = rows, table(after, "level")
        drop_tables(old)
        done += [n for n, k in want.items() if k == 1]
        want = {c: m for n, k in active.items() for c, m in ((2 * n, k // 2), (2 * n + 1, k - k // 2))}
    # leaves in the order of the tree: a leaf's path, left-aligned
    depth = max(n.bit_length() for n in [*done, *want])
    order = sorted([*done, *want], key=lambda n: n << (depth - n.bit_length()))
    numbers = docs.sparkSession.createDataFrame(list(zip(order, range(len(order)), strict=True)), "leaf long, shard int")
    rows = rows.join(F.broadcast(numbers), F.col("node") == F.col("leaf")).select("k1", "k2", "doc_id", "size", "text_crc32", "rid", "shard")
    buckets = max(1, -(-ends["n"] // (ROWS_A_BUCKET * leaves)))
    rows = rows.withColumn("bucket", F.pmod("k1", F.lit(buckets)))
    before = rows.groupBy("shard", "bucket").count().selectExpr("shard as s", "bucket as b", "coalesce(sum(count) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0L) as before")
    rows = rows.selectExpr("*", "row_number() over (partition by shard, bucket order by doc_id, k1, k2, rid) - 1 as at")
    rows = rows.join(before, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select("k1", "k2", "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"))


def _cuts(rows: DataFrame, active: dict[int, int], n_dims: int, tolerance: float) -> dict[int, tuple[int, int]]:
    """For each node its widest dimension and the key at which its right part begins."""
    spark = rows.sparkSession
    inside = rows.where(F.col("node").isin(list(active))) if len(active) < 1000 else rows
    coordinate = lambda i: F.shiftright(F.element_at("keys", i + 1), 48)
    wide = inside.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(coordinate(i)) - F.min(coordinate(i))).alias(f"w{i}") for i in range(n_dims)]).collect()
    state = {}
    for r in wide:
        if r["node"] in active:
            k = active[r["node"]]
            state[r["node"]] = {"dim": max(range(n_dims), key=lambda i: (r[f"w{i}"], -i)), "goal": r["w"] * (k // 2) / k, "w": r["w"], "prefix": 0}
    cuts: dict[int, tuple[int, int]] = {}
    for step in range(DIGITS):
        if not state:
            break
        shift = DIGIT * (DIGITS - 1 - step)
        known = F.broadcast(spark.createDataFrame([(n, s["dim"], s["prefix"], float(s["goal"])) for n, s in state.items()], "n long, dim int, prefix long, goal double"))
        at = inside.join(known, F.col("node") == F.col("n")).withColumn("key", F.element_at("keys", F.col("dim") + 1))
        if step:
            at = at.where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        sums = at.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("w"), F.first("goal").alias("goal"))
        sums = sums.selectExpr("*", "sum(w) over (partition by node order by digit) as upto").where("upto >= goal")
        for r in sums.groupBy("node").agg(F.min_by(F.struct("digit", "w", "upto"), "digit").alias("x")).collect():
            s, (digit, w, upto) = state[r["node"]], r["x"]
            below = upto - w
            if step == DIGITS - 1 or w <= tolerance * s["w"]:
                cuts[r["node"]] = s["dim"], min((digit if s["goal"] - below < upto - s["goal"] else digit + 1) << shift, 2**63 - 1)
            s |= {"prefix": digit, "goal": s["goal"] - below}
        state = {n: s for n, s in state.items() if n not in cuts}
    return cuts
