"""Embedding near-duplicates by a robust-pruned flat graph.

Distinct vectors of a label go to the cells of their nearest pivots (two at first, so cells overlap; pivots are a bounded
sample, the max_pivots vectors with the smallest hashes, thinned so that no two are near each other: a tight group then lies
in few cells; every vector is indexed). In each cell every vector gets its nearest candidates, robustly pruned; adjacency
lists are united over cells and cut to the LONGEST nearest. Then each cell, with the outside neighbours its members have, is searched: greedily towards each
member from its own neighbours and from the medoid, so that groups which no path joins to the medoid are searched too, and as
long as neighbours lie within the range (plus a slack) the range is expanded; only what the walk meets is compared. A link counts only when the cosine in double
precision reaches the threshold.

Links inside a cell leave it as a count for each vector and a spanning set of edges, never as all pairs of a group: a pair
counts in the least cell (and its one tile) that holds both. Only links between vectors that share no cell become rows.

An audit compares a bounded sample of all vectors, drawn by hash whatever they found, with all others of their label; while
the mean share of its links that a vector found, over those that have links, is under the goal, cells overlap more and the search runs again; under it at an overlap of
16, all pairs of a label are compared in tiles. The share found is a column of the result.

Cells of more than shard_rows vectors are split by pivots of their own, level by level. Cells so tight that they have one pivot
are worked on in tiles of two blocks each, every pair of blocks, so memory is bounded and no row is dropped; comparisons inside
a tight cell grow with the square of its size, as a count of all links asks.

Defined cases: a vector links with nothing when label or vec_id is null or it is null, empty, all zero or holds null or
non-finite components; vectors are divided by their largest component first, so very large and very small ones are compared
like others; vectors of different length do not link; vectors alike up to that scale are one node whose copies all link, each
row counting; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_tables, table

NEIGHBOURS, DEGREE, ALPHA = 32, 16, 1.2
#: Neighbours of a vector once lists are united: what others chose it for counts too, but a hub keeps no more than these.
LONGEST = 3 * DEGREE
BEAM, SLACK = 24, 0.06
#: Pivots are less alike than this.
APART = 0.8
#: Pivots of a large cell, before they are thinned, and rows of it that one task deals to them.
FAN, SALT_ROWS = 64, 50_000
#: In a split a vector goes to further pivots as long as they are this near to as similar as the nearest.
MARGIN = 0.1
NONE = np.iinfo(np.int64).min
_FOUND = "a long, b long, links long, crosses boolean"
_ROWS = "nid long, shard string, copies long, values array<double>"


def _unit(values: list | np.ndarray) -> np.ndarray:
    x = np.asarray(values, np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def robust_prune(sims: np.ndarray, own: np.ndarray) -> list[int]:
    """Of candidates by falling similarity, those that no kept one shadows: ALPHA * d(kept, c) <= d(node, c) drops c."""
    shadow = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * sims)) <= np.sqrt(np.maximum(0, 2 - 2 * own))[None, :]
    kept, open_ = [], np.ones(len(own), bool)
    while len(kept) < DEGREE and open_.any():
        c = int(open_.argmax())
        kept.append(c)
        open_[c] = False
        open_ &= ~shadow[c]
    return kept


def thinned(x: np.ndarray) -> np.ndarray:
    """Rows of the unit vectors x, in order, that are not near an earlier one."""
    kept = np.zeros_like(x)
    k = 0
    for v in x:
        if not k or (kept[:k] @ v).max() < APART:
            kept[k] = v
            k += 1
    return kept[:k].copy()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, dict[str, list]]]:
    """(shard, nid, unit vectors, other columns) of rows (shard, nid, values, ...) sorted by shard."""
    shard, held = None, []

    def out() -> tuple:
        nid, x, more = zip(*held, strict=True)
        return shard, np.concatenate(nid), _unit(np.concatenate(x)), {c: [v for part in more for v in part[c]] for c in more[0]}

    for batch in batches:
        names, lists = batch.column("shard").to_pylist(), batch.column("values")
        nid, offsets, flat = batch.column("nid").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()
        more = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("shard", "nid", "values")}
        cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and names[a] != shard:
                yield out()
                held = []
            shard = names[a]
            held.append((nid[a:b], flat[offsets[a] : offsets[b]].reshape(b - a, -1), {c: v[a:b] for c, v in more.items()}))
    if held:
        yield out()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst, sim) of each cell's pruned graph, in both directions."""
    for _, ids, x, _ in _groups(batches):
        if len(ids) < 2:
            continue
        edges = set()
        for a in range(0, len(x), 512):
            sims = x[a : a + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
            k = min(NEIGHBOURS, len(x) - 1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            for i in range(len(sims)):
                near = top[i][np.lexsort((top[i], -sims[i][top[i]]))]
                for c in robust_prune(x[near] @ x[near].T, sims[i][near]):
                    edges |= {(a + i, int(near[c])), (int(near[c]), a + i)}
        e = np.array(sorted(edges))
        sim = np.einsum("ij,ij->i", x[e[:, 0]], x[e[:, 1]]).astype(np.float32)  # the same in every cell
        yield pa.RecordBatch.from_pydict({"src": pa.array(ids[e[:, 0]]), "dst": pa.array(ids[e[:, 1]]), "sim": pa.array(sim)})


def greedy(x: np.ndarray, near: list[np.ndarray], q: int, start: int, threshold: float) -> list[int]:
    """Places within the threshold of q that the search reaches; x are the unit vectors, near the adjacency lists."""
    own = x[q]
    first = float(x[start] @ own)
    seen, heap, top = {start, q}, [(-1.0, q)], [first]
    if q != start:
        heap.append((-first, start))
    found = [start] if first >= threshold and start != q else []
    while heap:
        best, i = heapq.heappop(heap)
        if -best < threshold - SLACK and len(top) >= BEAM and -best < top[0]:
            break  # outside the beam and outside the widened range
        fresh = [j for j in near[i] if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for j, v in zip(fresh, (x[fresh] @ own).tolist(), strict=True):
            if v >= threshold:
                found.append(j)
            heapq.heappush(heap, (-v, j))
            heapq.heappush(top, v)
            if len(top) > BEAM:
                heapq.heappop(top)
    return found


def _least_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of cell numbers (NONE: no cell), the least that both hold; the largest number without one."""
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] != NONE)
    return np.where(same, a[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))


def _counted(hit: np.ndarray, ids: np.ndarray, owned) -> Iterator[pa.RecordBatch]:
    """Of the symmetric matrix of links: counts of the owned ones by vector, and edges from the first of each component."""
    links = np.zeros(len(ids), np.int64)
    for a in range(0, len(ids), 64):
        i, j = np.nonzero(hit[a : a + 64])
        own, weight = owned(i + a, j)
        links += np.bincount((i + a)[own], weights=weight[own], minlength=len(ids)).astype(np.int64)
    root = np.full(len(ids), -1)
    for s in range(len(ids)):
        if root[s] < 0:
            front = np.array([s])
            root[s] = s
            while len(front):
                reach = hit[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(reach)
                root[front] = s
    some, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    n = len(some) + len(joined)
    if n:
        b = pa.array([None] * len(some) + ids[root[joined]].tolist(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[joined]])), b, pa.array(links[some].tolist() + [None] * len(joined), pa.int64()), pa.array([False] * n)], ["a", "b", "links", "crosses"])


def _owner(shard_cells: dict[str, list]):
    """For places i and j of a tile: whether their pair counts here, and the copies of j."""
    cell, (lo, hi) = shard_cells["cell"][0], (shard_cells["lo"][0], shard_cells["hi"][0])
    width = max(map(len, shard_cells["cells"]))
    cells = np.array([c + [NONE] * (width - len(c)) for c in shard_cells["cells"]], np.int64)
    block, copies = np.array(shard_cells["block"]), np.array(shard_cells["copies"])

    def owned(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = (lo == hi) | (block[i] != block[j])
        for a in range(0, len(i), 50_000):
            part = slice(a, a + 50_000)
            here[part] &= _least_common(cells[i[part]], cells[j[part]]) == cell
        return here, copies[j]

    return owned


def _search(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, more in _groups(batches):
            core = np.array(more["core"])
            order = np.argsort(~core, kind="stable")  # members first, then the outside neighbours
            n, ids, x = int(core.sum()), ids[order], x[order]
            more = {c: [v[i] for i in order] for c, v in more.items()}
            at = {k: i for i, k in enumerate(ids.tolist())}
            near = [[at[d] for d in (own or ()) if d in at] for own in more["near"]]
            start = int(np.argmax(x @ x.mean(axis=0)))
            hit, outside = np.zeros((n, n), bool), []
            for q in range(n):
                found = np.array(greedy(x, near, q, start, threshold), np.int64)
                hit[q, found[found < n]] = True
                outside += [(q, int(j)) for j in found[found >= n]]
            hit |= hit.T
            yield from _counted(hit, ids[:n], _owner({c: v[:n] for c, v in more.items()}))
            # links with outside neighbours: those that share a cell are counted there
            cells = [set(c) for c in more["cells"]]
            rows = {(min(ids[q], ids[j]), max(ids[q], ids[j])) for q, j in outside if not cells[q] & cells[j]}
            if rows:
                e = np.array(sorted(rows))
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.nulls(len(e), pa.int64()), pa.array([True] * len(e))], ["a", "b", "links", "crosses"])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["nid", "shard", "copies", "values"])


def _assign(pivots, overlap: int):
    """Rows for the cells of the nearest pivots of the label; labels without a pivot are one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nid, group, copies, values = (batch.column(c).to_pylist() for c in ("nid", "grp", "copies", "values"))
            out = []
            by: dict[str, list[int]] = {}
            for i, g in enumerate(group):
                by.setdefault(g, []).append(i)
            for g, rows in by.items():
                if g not in pivots.value:
                    out += [(nid[i], f"{g}:0", copies[i], values[i]) for i in rows]
                    continue
                x, p = _unit([values[i] for i in rows]), pivots.value[g]
                k = min(overlap, len(p))
                top = np.argpartition(-(x @ p.T), k - 1, axis=1)[:, :k]
                out += [(nid[i], f"{g}:{c}", copies[i], values[i]) for i, own in zip(rows, top.tolist(), strict=True) for c in own]
            if out:
                yield _rows(out)

    return run


def _reassign(overlap: int):
    """Rows of large cells, after the cell's own pivots, for the cells of the nearest of these; a tight cell (one pivot) ends in !."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, given, pivots = None, [], np.zeros((0, 0))
        for batch in batches:
            out = []
            for nid, shard, copies, values, salt, kind in zip(*[batch.column(c).to_pylist() for c in ("nid", "shard", "copies", "values", "salt", "kind")], strict=True):
                if (shard, salt) != cell:
                    cell, given, pivots = (shard, salt), [], np.zeros((0, 0))
                if kind == 0:
                    given.append(values)
                    continue
                if given:
                    pivots, given = thinned(_unit(given)), []
                if len(pivots) < 2:
                    out.append((nid, f"{shard}!", copies, values))
                    continue
                sims = pivots @ _unit([values])[0]
                order = np.argsort(-sims, kind="stable")[:overlap]
                out += [(nid, f"{shard}.{c}", copies, values) for c in order.tolist() if sims[c] >= sims[order[0]] - MARGIN]
            if out:
                yield _rows(out)

    return run


def _split(cells: DataFrame, limit: int, overlap: int, parts: int, depth: int = 8) -> DataFrame:
    """cells (a table) with those of more than limit vectors split by pivots of their own, level by level, unless they are tight."""
    for level in range(depth):
        sizes = table(cells.where("shard not like '%!'").groupBy("shard").count().where(F.col("count") > limit).select(F.col("shard").alias("big"), F.col("count").alias("n")), "large")
        if sizes.isEmpty():
            break
        j = cells.join(sizes, F.col("shard") == F.col("big"), "left")
        large = j.where("big is not null").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
        chosen = large.where(F.pmod(F.xxhash64(F.lit(level), "nid"), F.lit(1 << 30)) * F.col("n") < FAN * (1 << 30))
        pivots = chosen.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "kind": F.lit(0)})
        rows = large.withColumns({"salt": F.pmod(F.xxhash64("nid"), F.col("salts")).cast("int"), "kind": F.lit(1)})
        columns = ["nid", "shard", "copies", "values", "salt", "kind"]
        dealt = pivots.select(columns).unionByName(rows.select(columns)).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "nid")
        after = j.where("big is null").select("nid", "shard", "copies", "values").unionByName(dealt.mapInArrow(_reassign(overlap), _ROWS))
        after = table(after, "cells")
        drop_tables(cells, sizes)
        cells = after
    return cells


def _tiled(rows: DataFrame, shard_rows: int) -> DataFrame:
    """rows with larger cells replaced by tiles of two blocks (lo, hi), every pair of blocks; block is the row's own."""
    blocks = F.when(F.col("count") <= shard_rows, 1).otherwise(F.ceil(F.col("count") * 2 / shard_rows)).cast("int")
    sizes = rows.groupBy("shard").count().select(F.col("shard").alias("sized"), blocks.alias("blocks"))
    j = rows.join(sizes, F.col("shard") == F.col("sized")).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    j = j.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return j.withColumn("shard", F.concat_ws("/", "shard", "lo", "hi")).drop("sized", "blocks", "other")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "nid")


def near_links(nodes: DataFrame, threshold: float = 0.93, overlap: int = 2, max_pivots: int = 8192, per_pivot: int = 256, shard_rows: int = 3000, audit: int = 1000, goal: float = 0.95) -> tuple[DataFrame, DataFrame, float | None]:
    """Links of nodes (nid, grp, values, copies): (nid, links) with copies counted, edges (a, b) that join what links, and
    the share of links found that the audit measured (None if its vectors have no link).
    """
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("values", "grp"), "nid").limit(min(max_pivots, n // per_pivot)).select("grp", "values").collect() if n > per_pivot else []
    by: dict[str, list] = {}
    for r in sample:
        by.setdefault(r["grp"], []).append(r["values"])
    pivots = spark.sparkContext.broadcast({g: thinned(_unit(v)) for g, v in by.items()})
    parts = max(12, 2 * n // 10_000)
    while True:
        cells = table(nodes.select("nid", "grp", "copies", "values").mapInArrow(_assign(pivots, overlap), _ROWS), "cells")
        cells = _split(cells, shard_rows, overlap, parts)
        own = table(cells.groupBy("nid").agg(F.sort_array(F.collect_set(F.xxhash64("shard"))).alias("cells")), "own")
        numbered = cells.withColumn("cell", F.xxhash64("shard")).join(own, "nid")
        rows = table(_tiled(numbered, shard_rows), "tiles")
        edges = _dealt(rows.select("shard", "nid", "values"), parts).mapInArrow(_build, "src long, dst long, sim float").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
        # the limit on the row number lets each task send few edges of a hub
        edges = edges.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))).where(F.col("rn") <= LONGEST)
        lists = table(edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near")), "graph")
        members = rows.select("shard", "nid")
        outside = members.join(lists, F.col("nid") == F.col("src")).select("shard", F.explode("near").alias("nid")).distinct().join(members, ["shard", "nid"], "left_anti")
        columns = ["shard", "nid", "values", "cell", "cells", "lo", "hi", "block", "copies", "core"]
        of = nodes.select("nid", "values", "copies").join(own, "nid")
        halo = outside.join(of, "nid").withColumn("cell", F.lit(0).cast("long")).withColumns({c: F.lit(0) for c in ("lo", "hi", "block")}).withColumn("core", F.lit(False))
        whole = rows.withColumn("core", F.lit(True)).select(columns).unionByName(halo.select(columns))
        whole = whole.join(lists, F.col("nid") == F.col("src"), "left").drop("src")
        found = table(_dealt(whole, parts).mapInArrow(_search(threshold), _FOUND), "found")
        counts, joined = _links(found, nodes)
        counts = table(counts, "links")
        recall = _recall(nodes, counts, audit, threshold)
        drop_tables(cells, own, rows, lists)
        if recall is None or recall >= goal:
            return counts, joined, recall
        drop_tables(found, counts)
        if overlap >= 16:
            found = table(_exact(nodes, threshold, shard_rows), "found")
            return *_links(found, nodes), 1.0
        overlap *= 2


def _links(found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nid, links) and edges (a, b) of the rows of _search or _exact."""
    across = found.where("crosses").select("a", "b").distinct()
    both = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(nodes.select(F.col("nid").alias("b"), "copies"), "b").select(F.col("a").alias("nid"), F.col("copies").alias("links"))
    counts = found.where("links is not null").select(F.col("a").alias("nid"), "links").unionByName(more)
    return counts.groupBy("nid").agg(F.sum("links").alias("links")), found.where("b is not null").select("a", "b")


def _recall(nodes: DataFrame, counts: DataFrame, audit: int, threshold: float) -> float | None:
    """Mean share of its links that a vector found, over those of `audit` vectors, drawn from all by hash, that have links.

    None if none of them has.
    """
    spark = nodes.sparkSession
    asked = {r["nid"]: r for r in nodes.orderBy(F.xxhash64(F.lit("audit"), "values"), "nid").limit(audit).select("nid", "grp", "values").collect()}
    by: dict[str, list] = {}
    for r in asked.values():
        by.setdefault(r["grp"], []).append(r)
    sent = spark.sparkContext.broadcast({g: (np.array([r["nid"] for r in own]), _unit([r["values"] for r in own])) for g, own in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for nid, g, v, copies in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if g in sent.value:
                    ids, q = sent.value[g]
                    for i in ids[(q @ _unit([v])[0] >= threshold) & (ids != nid)].tolist():
                        sums[i] = sums.get(i, 0) + copies
        if sums:
            yield pa.RecordBatch.from_pydict({"nid": pa.array(list(sums)), "true_links": pa.array(list(sums.values()))})

    truth = nodes.select("nid", "grp", "values", "copies").mapInArrow(run, "nid long, true_links long").groupBy("nid").agg(F.sum("true_links").alias("true_links"))
    # at most audit rows reach the driver
    shares = [r[0] for r in truth.join(counts, "nid", "left").select(F.coalesce("links", F.lit(0)) / F.col("true_links")).collect()]
    return sum(shares) / len(shares) if shares else None


def _exact(nodes: DataFrame, threshold: float, shard_rows: int) -> DataFrame:
    """Links of all pairs within the threshold, each group compared in tiles of two blocks, every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, x, more in _groups(batches):
            hit = np.zeros((len(x), len(x)), bool)
            for a in range(0, len(x), 256):
                hit[a : a + 256] = x[a : a + 256] @ x.T >= threshold
            np.fill_diagonal(hit, False)
            yield from _counted(hit | hit.T, ids, _owner(more))

    one = F.lit(0).cast("long")
    cell = nodes.select("nid", F.col("grp").alias("shard"), one.alias("cell"), F.array(one).alias("cells"), "copies", "values")
    tiles = table(_tiled(cell, shard_rows), "tiles").select("shard", "nid", "values", "cell", "cells", "lo", "hi", "block", "copies")
    return _dealt(tiles, max(12, tiles.count() // 10_000)).mapInArrow(run, _FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row of vectors (vec_id, embedding, label)."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v))
    fine = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    largest = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    values = F.when(fine, F.transform("embedding", lambda v: v.cast("double") / largest + F.lit(0.0)))
    rows = vectors.select("vec_id", "label", values.alias("values"))
    group = F.when(F.col("values").isNotNull(), F.concat_ws("x", F.col("label").cast("string"), F.size("values")))
    rows = table(rows.withColumn("grp", group), "vectors")
    nodes = rows.where("grp is not null").groupBy("grp", "values").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = table(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    counts, edges, recall = near_links(nodes, threshold, **settings)
    small = nodes.select("nid", "first")
    ends = edges.join(small.select(F.col("nid").alias("a"), F.col("first").alias("x")), "a").join(small.select(F.col("nid").alias("b"), F.col("first").alias("y")), "b")
    ends = ends.select(F.col("x").alias("a"), F.col("y").alias("b"))
    of = nodes.join(counts, "nid", "left").select("grp", "values", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    mine = rows.join(table(of, "of"), ["grp", "values"], "left").select("vec_id", "n", "first")
    copies = mine.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    comp = components(ends.unionByName(copies))
    out = mine.join(comp, F.col("vec_id") == F.col("node"), "left")
    own = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == own, F.lit(False))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), kept.alias("kept"), F.lit(recall).cast("double").alias("recall"))
