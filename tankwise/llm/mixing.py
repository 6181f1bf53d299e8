"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is laid out as one stream of words, its documents in seeded order, cut into blocks of equal length. The
highest quotients target / (2 q + 1) hand blocks to sources, cumulatively for each output shard, which gives integer
quotas a shard. A source takes whole passes over its blocks and, in the last pass, blocks evenly spaced from a seeded
start; so what a document gives follows from its place in the stream alone, and no table of blocks is needed.

Defined cases: a null text has size 0 and gives nothing; null is a source of its own, the last; identical rows are
interchangeable; without any words every target is 0; columns besides doc_id, source and text are not looked at; texts of
any length are counted whole and cut at block ends; an empty table gives no rows. The list of sources is configuration-sized and planned on the
driver; more than max_sources is an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, table, word_count

ROWS_A_BUCKET = 4_000


def water_fill(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Share sum(sizes) by weight; a share stops at limit times its size and the excess goes to the others by weight."""
    total, full = float(sum(sizes)), set()
    while True:
        rest = total - sum(limit * sizes[i] for i in full)
        open_w = sum(w for i, w in enumerate(weights) if i not in full)
        out = [float(limit * s) if i in full else rest * weights[i] / open_w for i, s in enumerate(sizes)]
        more = {i for i, x in enumerate(out) if i not in full and x > limit * sizes[i]}
        if not more or len(full | more) == len(sizes):
            return [float(min(x, limit * s)) for x, s in zip(out, sizes, strict=True)]
        full |= more


def sainte_lague(targets: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients target / (2 q + 1); ties go to the earlier target."""
    total = sum(targets)
    if total <= 0 or seats <= 0:
        return [0] * len(targets)
    q = [int(t * seats / total) for t in targets]
    up = [(-t / (2 * q[i] + 1), i) for i, t in enumerate(targets) if t > 0]
    heapq.heapify(up)
    for _ in range(seats - sum(q)):
        _, i = heapq.heappop(up)
        q[i] += 1
        heapq.heappush(up, (-targets[i] / (2 * q[i] + 1), i))
    while True:  # a seat moves while a quotient not yet served beats one that was
        best = min((-t / (2 * q[i] + 1), i) for i, t in enumerate(targets) if t > 0)
        worst = min((t / (2 * q[i] - 1), -i) for i, t in enumerate(targets) if q[i])
        if -best[0] <= worst[0] or best[1] == -worst[1]:
            return q
        q[best[1]] += 1
        q[-worst[1]] -= 1


def plan(sources: list[tuple[str | None, int]], weights: list[float] | None = None, limit: int = 3, n_shards: int = 16, blocks: int = 200) -> tuple[int, list[dict]]:
    """Block length and, for each (source, size), its target, quota and cumulative quotas of the shards.

    Sources come in order of code points, null last; weights repeat 1, 2, 3 unless given. The smallest target gets about
    `blocks` blocks.
    """
    sources = sorted(sources, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [s for _, s in sources]
    weights = weights or [1.0 + i % 3 for i in range(len(sources))]
    targets = water_fill(sizes, weights, limit) if sizes else []
    least = min((t for t in targets if t > 0), default=1.0)
    block = max(1, int(least / blocks), max(sizes, default=0) >> 30)
    counts = [-(-s // block) for s in sizes]
    seats, upto = round(sum(sizes) / block), [[] for _ in sizes]
    for k in range(1, n_shards + 1):
        for u, c, x in zip(upto, counts, sainte_lague(targets, round(seats * k / n_shards)), strict=True):
            u.append(max(min(x, limit * c), u[-1] if u else 0))
    return block, [{"source": n, "source_size": s, "target": t, "blocks": c, "quota": u[-1], "upto": u} for (n, s), t, c, u in zip(sources, targets, counts, upto, strict=True)]


PLAN = T.StructType([
    T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_n", T.LongType()),
    T.StructField("_q", T.LongType()), T.StructField("_upto", T.ArrayType(T.LongType())), T.StructField("_buckets", T.LongType()), T.StructField("quotas", T.ArrayType(T.LongType())),
])


def mix(docs: DataFrame, seed: int = 17, weights: list[float] | None = None, limit: int = 3, n_shards: int = 16, max_sources: int = 1_000_000) -> DataFrame:
    """(k1, k2, doc_id, source, size, source_size, target, taken, first_shard, block_words, quotas) for each row of docs.

    quotas: how many blocks of block_words words of the document's source each shard takes; first_shard: where the
    document's first chosen block goes.
    """
    spark = docs.sparkSession
    sized = table(docs.select("doc_id", "source", *row_key("doc_id", "source", "text"), word_count(F.col("text")).alias("size")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    block, rows = plan([(r["source"], r["s"]) for r in found], weights, limit, n_shards)
    count = {r["source"]: r["n"] for r in found}
    quotas = lambda upto: [b - a for a, b in zip([0, *upto], upto, strict=False)]
    planned = [(r["source"], r["source_size"], r["target"], r["blocks"], r["quota"], r["upto"], -(-count[r["source"]] // ROWS_A_BUCKET), quotas(r["upto"])) for r in rows]
    planned = spark.createDataFrame(planned, PLAN)
    x = sized.join(planned, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_h", F.xxhash64(F.lit(seed), "k1", "k2")).withColumn("_bucket", F.expr("pmod(_h, _buckets)"))
    sums = x.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.selectExpr("_source as _s", "_bucket as _b", "coalesce(sum(_sum) over (partition by _source order by _bucket rows between unbounded preceding and 1 preceding), 0L) as _before")
    x = x.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    at = "_before + coalesce(sum(size) over (partition by _source, _bucket order by _h, doc_id, k2 rows between unbounded preceding and 1 preceding), 0L)"
    x = x.selectExpr("*", f"{at} as _at", "if(_n > 0, _q div _n, 0L) as _passes", "if(_n > 0, _q % _n, 0L) as _r", f"if(_n > 0, pmod(xxhash64({seed}L, 'start', _source), _n), 0L) as _o")

    def chosen(i: str) -> str:
        """Chosen blocks before block i of the last pass."""
        return f"(((({i}) + _o) * _r) div greatest(_n, 1L) - (_o * _r) div greatest(_n, 1L))"

    def words(p: str) -> str:
        """Words of chosen blocks before place p of the stream."""
        i = f"(({p}) div {block}L)"
        return f"({chosen(i)} * {block}L + if({chosen(i + ' + 1')} > {chosen(i)}, ({p}) % {block}L, 0L))"

    last = f"({words('_at + size')} - {words('_at')})"
    first = f"if(_passes > 0, _at div {block}L, {chosen(f'_at div {block}L')})"
    x = x.selectExpr("*", f"_passes * size + {last} as taken", f"if(size > 0, {first}, null) as _first")
    shard = F.when(F.col("taken") > 0, F.least(F.size(F.filter("_upto", lambda c: c <= F.col("_first"))), F.lit(n_shards - 1)))
    return x.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "taken", shard.alias("first_shard"), F.lit(block).cast("long").alias("block_words"), "quotas")
