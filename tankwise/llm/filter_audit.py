"""Which of five filters removes which documents in which order, from one count of failure masks a part.

1. Exact duplicates come from a sort: rows are range-partitioned by text fingerprint and doc_id and sorted by fingerprint,
   whole text and doc_id, so that the range bounds hold no texts and a text that a third of all documents share is spread
   over many partitions. Each row is compared with the row before; a run of equal texts remembers its first doc_id. A run
   may begin in the partition before: each partition hands on the texts of its last fingerprint (a digest and the first
   doc_id), a row or two a partition, and the rows of its first fingerprint are looked up there.
2. A row leaves as a mask of the filters that it fails; texts go no further. Masks and labels are counted by part: at most 32
   rows a part, sums that merge. All 120 orders are read off these counts.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code points; D any of #$%&*|; E equal to
the text of a smaller doc_id.

Defined cases: a null text is empty, so null and empty texts are duplicates of each other; a null source is the part ''; a
row without doc_id never fails E, makes no other row fail it, and has no labels; rows that share a doc_id are documents
of their own, and not each other's duplicates; several rows of labels for a doc_id count as one that has what any of
them has; other columns are not looked at; an empty table has no parts and gives no rows; texts of any length are taken
whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WS, WS_RUN, table

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
_FLAGGED = "part string, doc_id long, mask int, fp long, digest binary, first_id long"


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails; bit 0 is A."""
    trimmed = F.btrim(text, F.lit(WS))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, WS_RUN))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0)).cast("int")


def _against_predecessors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, mask, fp, text) in order, E added to the mask where a smaller doc_id of the partition has the text.

    Rows of the first fingerprint carry it and a digest. At the end one row without a part for each text of the last fingerprint:
    its digest and its first doc_id.
    """
    first_fp = last = None  # last: fingerprint, text and first doc_id of the run at hand
    ends: list[tuple[str, int | None]] = []  # texts of the last fingerprint with their first doc_id

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode()).digest()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        part, ids, masks, fps, texts = (batch.column(i) for i in range(5))
        fp, given = fps.to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        doc = ids.fill_null(0).to_numpy()
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = (fp[1:] == fp[:-1]) & pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        if last is not None and last[0] == fp[0]:
            same[0] = last[1] == texts[0].as_py()
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1  # -1: the run of the batch before
        known = given[starts] if len(starts) else np.zeros(0, bool)
        first = np.where(run >= 0, doc[starts[np.maximum(run, 0)]] if len(starts) else 0, last[2] if last and last[2] is not None else 0)
        has_first = np.where(run >= 0, known[np.maximum(run, 0)] if len(starts) else False, bool(last) and last[2] is not None)
        mask = masks.to_numpy() | np.where(given & has_first & (first < doc), _E, 0).astype(np.int32)
        if first_fp is None:
            first_fp = fp[0]
        edge = np.flatnonzero(fp == first_fp)
        digests: list[bytes | None] = [None] * n
        text = shown = None
        for i in edge.tolist():
            if not same[i] or shown is None:
                text = texts[i].as_py()
                shown = digest(text)
            digests[i] = shown
        yield pa.RecordBatch.from_arrays([part, ids, pa.array(mask, pa.int32()), pa.array(fp), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64())], ["part", "doc_id", "mask", "fp", "digest", "first_id"])
        if last is not None and last[0] != fp[-1]:
            ends = []
        for i in starts[fp[starts] == fp[-1]].tolist():
            ends.append((digest(texts[i].as_py()), int(doc[i]) if given[i] else None))
        if len(starts):
            i = int(starts[-1])
            last = (fp[i], texts[i].as_py(), int(doc[i]) if given[i] else None)
    if last is not None:
        m = len(ends)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([last[0]] * m, pa.int64()), pa.array([d for d, _ in ends], pa.binary()), pa.array([i for _, i in ends], pa.int64())], ["part", "doc_id", "mask", "fp", "digest", "first_id"])


def failures(docs: DataFrame) -> DataFrame:
    """(part, doc_id, mask): the mask of the filters that each document fails."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))
    order = F.col("doc_id").asc_nulls_last()
    rows = rows.repartitionByRange("fp", order).sortWithinPartitions("fp", "text", order)
    flagged = rows.select("part", "doc_id", own_failures(F.col("text")).alias("mask"), "fp", "text").mapInArrow(_against_predecessors, _FLAGGED)
    flagged = table(flagged, "flagged")
    # a row or two for each partition: fingerprints of 64 bits hardly ever hold more texts than one
    ends = flagged.where("part is null").groupBy("fp", "digest").agg(F.min("first_id").alias("earliest"))
    ends = F.broadcast(ends) if ends.count() <= 1_000_000 else ends
    found = flagged.where("part is not null").join(ends, ["fp", "digest"], "left")
    again = F.coalesce(F.col("earliest") < F.col("doc_id"), F.lit(False))
    return found.select("part", "doc_id", F.when(again, F.col("mask").bitwiseOR(F.lit(_E))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those with quality = 1 and with toxic = 1 among them."""
    any_of = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c)
    facts = table(labels.where("doc_id is not null").groupBy("doc_id").agg(any_of("quality"), any_of("toxic")).where("quality + toxic > 0"), "labels")
    one = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = table(one, "masks")
    j = known.where("doc_id is not null").join(facts, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("bad"))
    j = j.unionByName(known.where("doc_id is null").selectExpr("part", "mask", "n", "0L as good", "0L as bad"))
    return j.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def _steps() -> Column:
    """All steps of all orders as an array: order, step, filter, its bit, and the mask of the filters before it."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append({"filter_order": order, "step": i + 1, "filter": f, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: string, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of the module docstring's filters."""
    counts = counters(failures(docs), labels)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # at most 32 a part
    rows = by_part.withColumn("s", F.explode(_steps())).select("part", "c", "s.*")

    def total(of: str, cond) -> Column:
        return F.aggregate(F.filter("c", cond), F.lit(0).cast("long"), lambda a, x: a + x[of])

    bit, before = F.col("bit"), F.col("before")
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    through = lambda x: x["mask"].bitwiseAND(before) == 0
    removed = lambda x: fails(x) & through(x)
    # of the 120 orders, a document that fails k filters is removed by each of them in 120 / k
    share = F.aggregate(F.filter("c", fails), F.lit(0).cast("long"), lambda a, x: a + x["n"] * (120 / F.bit_count(x["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda x: through(x) & ~fails(x)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda x: fails(x) & ~through(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == bit).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"), "filter",
    )
