"""N-gram Jaccard join: all documents whose sets of 5-word shingles have similarity 0.75 or more, as components.

1. A pass over the texts makes for each document its set size, a 128-bit hash of the set, a few minimum hashes, an XOR
   bitmap of as many bits as its size band, and counts of shingles in 2^20 hash slots. Equal sets become one.
2. Documents that share half of their minimum hashes are compared with a few of their bucket, a star each, not all pairs: at
   first with the smallest id, the smallest set (what documents share that consist of one passage and little else) and some
   drawn by hash. Then, for a few rounds, with hubs of other components than their own: new draws, from the whole bucket
   and from its largest component, and the smallest set of that. This joins most copies cheaply, also those that resemble each other only by way of an original or of other copies; what it misses, step 3 finds.
3. Exact candidates of what may still be missed: each set has its rarest quarter (by slot count, then hash: one order for
   all). Shingles of it that one component holds alone are dropped by a Spark aggregation and a bitmap of the others, before
   entries are shuffled. The rest go to tiles by shingle, size band (their own and the next) and, where a shingle has many
   entries, pair of blocks of documents; in a tile, documents of a group that differ in component and in size by no more than
   0.75 allows are pairs. Two sets that similar must share a shingle there, so no link between components is lost.
4. Bit counts bound the overlap of a pair from above, (n + m - bits that differ) / 2, before the exact intersection of
   sorted arrays: for stars before they become pairs, in tiles already there for the documents of a crowded shingle, so that a
   group of copies that resemble each other, but too little, does not leave its tile as the square of its size.

Defined cases: a null or empty text, or one of white space, has no shingles and links with nothing; fewer than five words
make one shingle; a row without doc_id links with nothing and has no component; rows that share a doc_id are one node and
link if any of them does; of equal sets, sizes and shingle counts (ties) the smallest id or hash comes first, so reruns agree;
texts of any length are taken whole; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_tables, table
from .wordhash import mix64, shingle_sets

SLOT_BITS = 20
SLOT_PARTS = 16
MIN_HASHES = 6
#: Rounds of stars, members that are drawn as hubs of a bucket, and minimum hashes that a document shares with its hub.
ROUNDS, HUBS, SHARED = 4, 6, 3
#: Rounds end when one finds less than this part of the links before; tiles find the rest.
ENOUGH = 20
ENTRIES_A_TILE = 80_000
ID_BITS = 20
#: The bitmap of shared shingles has MARKS_EACH bits for each of them or more, 2 ** MARK_BITS at most.
MARK_BITS, MARK_PARTS, MARKS_EACH = 27, 16, 32
HOT_ENTRIES = 20_000
#: Documents of a shingle with so many entries or more are sent to its tile with a bitmap of CROWD_WORDS times 64 bits.
CROWD, CROWD_WORDS = 64, 4
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**62, MIN_HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _bitmap(h: np.ndarray) -> bytes:
    """XOR bitmap with at least as many bits as the set has members."""
    bits = 1 << max(6, int(len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits that differ, the longer bitmap folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


_SKETCH = "doc_id long, n long, s1 long, s2 long, mins array<long>, bitmap binary, part int, counts binary"


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mins", pa.list_(pa.int64())), ("bitmap", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, h in zip(ids, shingle_sets(batch.column(1), k), strict=True):
                if not len(h):
                    rows.append((doc_id, 0, None, None, None, None, None, None))
                    continue
                np.add.at(counts, (h & _U((1 << SLOT_BITS) - 1)).astype(np.int64), 1)
                s1, s2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64).tolist()
                mins = ((h[None, :] * _MULTIPLIERS[:, None]).min(axis=1) ^ np.arange(MIN_HASHES, dtype=_U)).astype(np.int64).tolist()
                rows.append((doc_id, len(h), s1, s2, mins, _bitmap(h), None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if counts.any():
            parts = counts.reshape(SLOT_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLOT_PARTS, f.type) for f in list(schema)[:6]] + [pa.array(range(SLOT_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(counts, np.uint32)
            sums[part] = np.minimum(sums[part].astype(np.uint64) + x, 2**32 - 1).astype(np.uint32) if part in sums else x
    if sums:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def _levels(sketch: DataFrame) -> np.ndarray:
    """Of each hash slot, eight times the power of two of its count over all documents (a fixed megabyte)."""
    sums = sketch.where("part is not null").select("part", "counts").mapInArrow(_add_up, "part int, counts binary").repartition(SLOT_PARTS, "part").mapInArrow(_add_up, "part int, counts binary")
    out = np.zeros((SLOT_PARTS, (1 << SLOT_BITS) // SLOT_PARTS), np.uint32)
    for r in sums.collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return np.minimum(8 * np.log2(np.maximum(out.reshape(-1), 1)), 255).astype(np.uint8)


def _first(levels: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The rarest quarter of a set."""
    return h[np.argsort(levels[(h & _U((1 << SLOT_BITS) - 1)).astype(np.int64)] | (h >> _U(8)), kind="stable")[: len(h) // 4 + 1]]


def _held(levels, k: int):
    """(h, lo, hi, many): of each prefix shingle the least and the largest component and its entries, added up by the million."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value.astype(np.uint64) << _U(56)
        held, many = [], 0

        def out() -> pa.RecordBatch:
            h, comp = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, comp = h[order], comp[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            lo, hi, n = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at), np.diff(at, append=len(h))
            return pa.RecordBatch.from_pydict({"h": pa.array(h[at].astype(np.int64)), "lo": pa.array(lo), "hi": pa.array(hi), "many": pa.array(n.astype(np.int64))})

        for batch in batches:
            for comp, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(h):
                    held.append((_first(level, h), np.full(len(h) // 4 + 1, comp, np.int64)))
                    many += len(held[-1][0])
                if many > 1_000_000:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    return run


def _mark(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bitmaps (part, bits) of (part, slot) rows."""
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                bits.setdefault(p, np.zeros(size, bool))[slot[part == p]] = True
        if bits:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(bits), pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in bits.values()], pa.binary())})

    return run


def _marks(slots: DataFrame, n_bits: int) -> np.ndarray:
    """A bitmap of 2 ** n_bits bits with the slots (column slot) of the rows set."""
    size = (1 << n_bits) // MARK_PARTS
    rows = slots.selectExpr(f"cast(slot div {size} as int) as part", f"slot % {size} as slot")
    out = np.zeros((MARK_PARTS, size // 8), np.uint8)
    for r in rows.repartition(MARK_PARTS, "part").mapInArrow(_mark(size), "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _cells(h: np.ndarray, ids: np.ndarray, size: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, group): entries repeated for each group (shingle, size band, pair of blocks) that they enter.

    Sizes that allow 0.75 lie in one band or in two next to each other; an entry enters its band and the next. Entries of
    a hot shingle are in one of blocks blocks by id and enter the pairs of theirs with every block.
    """
    band = np.floor(np.log(size) / np.log(1.34)).astype(np.int64)
    which = np.repeat(np.arange(len(h)), 2 * blocks)
    j = np.arange(len(which)) - np.repeat(np.cumsum(2 * blocks) - 2 * blocks, 2 * blocks)
    k = blocks[which]
    own = (mix64(ids[which].astype(_U)) % k.astype(_U)).astype(np.int64)
    other, cell = j % k, band[which] + j // k
    pair = np.minimum(own, other) * k + np.maximum(own, other)
    return which, mix64(h[which] ^ mix64(cell.astype(_U) * _U(0x100000000) + pair.astype(_U)))


def _mark_bits(n: int) -> int:
    """Of the bitmap of n shared shingles: what the driver gathers and sends follows n and stays within 16 MB."""
    return min(MARK_BITS, max(16, (MARKS_EACH * n).bit_length()))


def _words(h: np.ndarray) -> np.ndarray:
    """XOR bitmap of a set in CROWD_WORDS 64-bit words, whatever its size."""
    bits = 64 * CROWD_WORDS
    return np.packbits(np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def _prefixes(levels, marks, crowded, hot, tiles: int, k: int):
    """Tiles' entries: (tile, groups, ids, components, sizes, places in the prefix), each a packed array, and with them ids and
    bitmaps of the documents that have an entry of a crowded shingle there; the places of such entries are inverted (~place).

    marks, crowded: bitmaps of the slots of shared and of crowded shingles; hot: hashes in order and numbers of blocks of the hot ones.
    """
    within = lambda bits, h: bits[(slot := (h & _U(8 * len(bits) - 1)).astype(np.int64)) >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value.astype(np.uint64) << _U(56)
        hot_h, hot_blocks = hot.value
        held, words, many = [], [], 0

        def out() -> pa.RecordBatch:
            h, ids, comp, size, place, doc, crowd = (np.concatenate(x) for x in zip(*held, strict=True))
            tile = ((h >> _U(32)) % _U(tiles)).astype(np.int64)
            order = np.argsort(tile, kind="stable")
            at = np.flatnonzero(np.diff(tile[order], prepend=-1, append=tiles))
            cuts = list(zip(at[:-1], at[1:], strict=True))
            pack = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in cuts], pa.binary())
            met = [np.unique(doc[order[a:b]][crowd[order[a:b]]]) for a, b in cuts]
            own, bits = np.array([i for i, _ in words], np.int64), np.stack([w for _, w in words])
            sent = [pa.array([x[m].tobytes() for m in met], pa.binary()) for x in (own, bits)]
            return pa.RecordBatch.from_arrays([pa.array(tile[order[at[:-1]]], pa.int32()), pack(h), pack(ids), pack(comp - ids), pack(size), pack(np.where(crowd, ~place, place)), *sent], ["tile", "h", "ids", "comp", "size", "place", "crowd", "words"])

        for batch in batches:
            for doc_id, comp, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k), strict=True):
                if n := len(h):
                    first = _first(level, h)
                    place = np.flatnonzero(within(marks.value, first))
                    first, p = first[place], len(place)
                    blocks = np.ones(p, np.int64)
                    if len(hot_h) and p:
                        at = np.minimum(np.searchsorted(hot_h, first), len(hot_h) - 1)
                        blocks = np.where(hot_h[at] == first, hot_blocks[at], 1)
                    which, group = _cells(first, np.full(p, doc_id, np.int64), np.full(p, n, np.int64), blocks)
                    q = len(which)
                    if q:
                        held.append((group, np.full(q, doc_id, np.int64), np.full(q, comp, np.int64), np.full(q, n, np.int32), place[which].astype(np.int32), np.full(q, len(words), np.int32), within(crowded.value, first[which]).astype(bool)))
                        words.append((doc_id, _words(h)))
                    many += q
                if many > 1_000_000:
                    yield out()
                    held, words, many = [], [], 0
        if held:
            yield out()

    return run


def _told_once(ids: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids in order and their bitmaps, without ids that have several: rows that share a doc_id may hold different texts."""
    ids, at, which = np.unique(ids, return_index=True, return_inverse=True)
    same = np.ones(len(ids), bool)
    same[which[(words != words[at][which]).any(axis=1)]] = False
    return ids[same], words[at[same]]


def _tile_pairs(h: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, place: np.ndarray, crowd: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of ids (smaller size first) of a tile that may be similar, as rows of two.

    Similar sets of n and m members share 3 / 7 (n + m) at least, so at their first common shingle each has as many left. Where
    documents of a crowded group have one bitmap (ids crowd in order, words), bits that differ bound what a pair shares.
    """
    crowded, place = place < 0, np.maximum(place, ~place)
    order = np.lexsort((ids, size, h))
    h, ids, comp, size, left, crowded = h[order], ids[order], comp[order], size[order].astype(np.int64), (size - place)[order].astype(np.int64), crowded[order]
    cuts = np.flatnonzero(np.diff(h, prepend=h[0] + _U(1), append=h[-1] + _U(1)))
    lo, hi = np.minimum.reduceat(comp, cuts[:-1]), np.maximum.reduceat(comp, cuts[:-1])
    for k in np.flatnonzero(lo != hi):
        a, b = int(cuts[k]), int(cuts[k + 1])
        n, c, own, rest = size[a:b], comp[a:b], ids[a:b], left[a:b]
        last = np.searchsorted(n, n * 4 // 3, "right")  # partners of i: i + 1 to last[i], by size
        bits = None
        if len(crowd) and crowded[a:b].all():
            at = np.minimum(np.searchsorted(crowd, own), len(crowd) - 1)
            bits, open_ = words[at], crowd[at] != own
        for i in np.flatnonzero((last > np.arange(1, b - a + 1)) & (7 * rest >= 6 * n)):
            to = slice(i + 1, last[i])
            need = 3 * (n[i] + n[to])
            may = (c[to] != c[i]) & (7 * rest[i] >= need) & (7 * rest[to] >= need)
            if bits is not None:
                differ = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
                may &= open_[i] | open_[to] | (7 * ((n[i] + n[to] - differ) // 2) >= need)
            to = own[to][may]
            if len(to):
                yield np.stack([np.full(len(to), own[i]), to], axis=1)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, held = None, []

    def out() -> Iterator[pa.RecordBatch]:
        h, ids, comp, size, place, crowd, words = (np.concatenate(x) for x in zip(*held, strict=True))
        crowd, words = _told_once(crowd, words.reshape(-1, CROWD_WORDS))
        found, many = [], 0

        def batch() -> pa.RecordBatch:
            x = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for x in _tile_pairs(h, ids, comp + ids, size, place, crowd, words):
            found.append(x)
            many += len(x)
            if many > 500_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                many = len(found[0])
                if many > 250_000:
                    yield batch()
                    found, many = [], 0
        if found:
            yield batch()

    for batch in batches:
        for t, *x in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            if t != tile and held:
                yield from out()
                held = []
            tile = t
            held.append([np.frombuffer(v, d) for v, d in zip(x, (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int64, np.uint64), strict=True)])
    if held:
        yield from out()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, sizes, bitmaps) whose bit counts allow the overlap."""
    for batch in batches:
        a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
        both = [min(p, q, (p + q - _differ(v, w)) // 2) for p, q, v, w in zip(n, m, x, y, strict=True)]
        keep = pa.array([4 * o >= 3 * (p + q - o) for o, p, q in zip(both, n, m, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).filter(keep) for c in (a, b)], ["a", "b"])


def _similar(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                if len(x) > len(y):
                    x, y = y, x
                if len(x) and 4 * len(x) >= 3 * len(y):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if 4 * both >= 3 * (len(x) + len(y) - both):
                        found.append((a, b))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(left: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of a written table that are similar, by whole texts."""
    spark = left.sparkSession
    ids = left.select(F.col("a").alias("doc_id")).unionByName(left.select(F.col("b").alias("doc_id"))).distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).alias("slot")
    wanted = spark.sparkContext.broadcast(_marks(ids.select(slot), ID_BITS))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(bits[batch.column("slot").to_numpy()]))

    held = texts.select("doc_id", "text", slot).mapInArrow(some, "doc_id long, text string")
    held = table(held.join(ids, "doc_id"), "texts")
    wanted.destroy()
    both = left.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar(k), "a long, b long")


def _hubs(keys: DataFrame, r: int) -> DataFrame:
    """(key, of, hub): members of the buckets that hold several components, and their components, for round r of stars."""
    # draws: members with the least hashes, of a component and so of the bucket; the smallest set and, at first, the smallest id
    draws = [F.min(F.struct(F.xxhash64(F.lit(HUBS * r + i), "key", "rep").alias("h"), "rep")).alias(f"d{i}") for i in range(HUBS)]
    each = keys.groupBy("key", "comp").agg(F.count("*").alias("many"), F.min(F.struct("n", "rep")).alias("least"), F.min(F.struct("rep")).alias("first"), *draws)
    hub = lambda h: F.struct("comp", F.col(f"{h}.rep").alias("hub"))
    in_largest = F.max_by(F.array(hub("least"), *[hub(f"d{i}") for i in range(HUBS // 2)]), F.struct("many", F.xxhash64(F.lit(r), "comp")))
    in_bucket = [F.min_by(hub(f"d{i}"), f"d{i}.h") for i in range(HUBS // 2 if r else 0, HUBS)] + ([] if r else [F.min_by(hub("first"), "first.rep"), F.min_by(hub("least"), "least")])
    chosen = each.groupBy("key").agg(F.count("*").alias("comps"), *([in_largest.alias("own")] if r else []), F.array(*in_bucket).alias("any")).where("comps > 1")
    chosen = chosen.select("key", F.explode(F.array_distinct(F.concat("own", "any") if r else F.col("any"))).alias("h"))
    return chosen.select("key", F.col("h.comp").alias("of"), "h.hub")


def _stars(sets: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Components (node, component) of the links that rounds of stars find."""
    many, joined = 0, sets.sparkSession.createDataFrame([], "node long, component long")
    for r in range(ROUNDS):
        of = sets.select("rep", "n", "mins", "bitmap").join(joined, F.col("rep") == F.col("node"), "left")
        keys = of.select("rep", "n", "mins", "bitmap", F.coalesce("component", "rep").alias("comp"), F.explode("mins").alias("key"))
        # written, so that the rows of a very common minimum hash are split over tasks when they are joined
        own = sets.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("mins").alias("hub_mins"), F.col("bitmap").alias("hub_bitmap"))
        hubs = table(_hubs(keys, r).join(own, "hub"), "hubs")
        sizes = 4 * F.least("n", "hub_n") >= 3 * F.greatest("n", "hub_n")
        met = keys.join(hubs, "key").where((F.col("comp") != F.col("of")) & sizes & (F.size(F.array_intersect("mins", "hub_mins")) >= SHARED))
        stars = met.select(F.col("hub").alias("a"), F.col("rep").alias("b"), "hub_n", "n", "hub_bitmap", "bitmap").mapInArrow(_bounded, "a long, b long").distinct()
        found = table(_verified(table(stars, "bounded"), texts, k), "links")
        drop_tables(hubs)
        fresh = found.count()
        if r and not fresh:
            break
        many += fresh
        # the components so far stand for the links that made them
        joined = table(components(found.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))), "joined")
        if fresh * ENOUGH < many:
            break  # a further round would join little
    return joined


def similar_components(docs: DataFrame, k: int = 5, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    hot_entries: entries of a shingle in a block; with more, its entries are dealt over pairs of blocks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    texts = docs.where("doc_id is not null")
    sketch = table(docs.mapInArrow(_sketches(k), _SKETCH), "sketch")
    each = sketch.where("part is null")
    sets = table(each.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("bitmap").alias("bitmap")), "sets")
    joined = _stars(sets, texts, k)
    labels = sets.select(F.col("rep").alias("doc_id")).join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))
    # exact candidates between components
    levels = spark.sparkContext.broadcast(_levels(sketch))
    left = table(labels.join(texts, "doc_id").select("doc_id", "comp", "text"), "prefixed")
    held = left.select("comp", "text").mapInArrow(_held(levels, k), "h long, lo long, hi long, many long")
    shared = table(held.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("many").alias("many")).where("lo <> hi").select("h", "many", F.expr(f"(many + {hot_entries - 1}) div {hot_entries}").alias("blocks")), "shared")
    # a shingle is hot with more than hot_entries entries, so few are
    many = shared.where("blocks > 1").select("h", "blocks").collect()
    hot = np.array([r["h"] for r in many], np.int64).astype(_U), np.array([r["blocks"] for r in many], np.int64)
    order = np.argsort(hot[0])
    hot = spark.sparkContext.broadcast((hot[0][order], hot[1][order]))
    n_shared, entries = shared.agg(F.count("*"), F.sum(F.expr("2 * many * blocks"))).first()
    n_bits, tiles = _mark_bits(n_shared), max(12, (entries or 0) // ENTRIES_A_TILE)
    marks = spark.sparkContext.broadcast(_marks(shared.select(F.col("h").bitwiseAND(F.lit((1 << n_bits) - 1)).alias("slot")), n_bits))
    crowds = shared.where(F.col("many") >= CROWD)
    c_bits = _mark_bits(crowds.count())
    crowded = spark.sparkContext.broadcast(_marks(crowds.select(F.col("h").bitwiseAND(F.lit((1 << c_bits) - 1)).alias("slot")), c_bits))
    spread = left.mapInArrow(_prefixes(levels, marks, crowded, hot, tiles, k), "tile int, h binary, ids binary, comp binary, size binary, place binary, crowd binary, words binary")
    pairs = table(spread.repartition(tiles, "tile").sortWithinPartitions("tile").mapInArrow(_pairs, "a long, b long"), "pairs").distinct()
    for sent in (levels, hot, marks, crowded):  # the tables that need them are written
        sent.destroy()
    own = lambda s: sets.selectExpr(f"rep as {s}", f"n as n_{s}", f"bitmap as bitmap_{s}")
    pairs = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(_bounded, "a long, b long")
    more = table(_verified(table(pairs, "bounded"), texts, k), "links")
    copies = each.where("n > 0 and doc_id is not null").join(sets.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    whole = components(reduce(DataFrame.unionByName, [joined.select(F.col("node").alias("a"), F.col("component").alias("b")), more, copies]))
    out = each.select("doc_id", F.col("n").alias("n_shingles")).join(whole, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
