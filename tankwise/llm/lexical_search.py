"""Ranked lexical search of all documents for each query item: windowed bucket scoring.

1. Terms of the items become a sorted array of hashes. One pass over the whole texts keeps, of each document with a term, its
   length and its postings: the items' terms in it and how often. The postings are written; texts go no further.
2. The number of documents, their length and the document frequencies are counted from the postings and give the weights.
3. Postings are range-partitioned and sorted by doc_id and traversed in fixed windows of `window` documents in that order.
   In a window they are inverted: by term, ascending slots. For each item the contributions of its terms are scatter-added
   into an array with a slot a document, which fits the cache, while a bitset notes which slots are occupied. The occupied
   slots are harvested into a heap of the k best; what does not beat its least is dropped at once.
4. A task gives k rows an item at most; the best k of all are the answer.

Items are taken in blocks of about `pairs_at_once` (item, term) pairs, so that what is broadcast (16 bytes a pair) has a
bound; more of them mean another pass over the documents.

Defined cases: an item without item_id asks nothing, items that share one are asked as one; an item without terms, or with
terms that no document holds, gives no rows; a null text has no terms; a document without doc_id counts in all statistics
but is never listed; rows that share a doc_id are documents of their own; other columns are not looked at; an empty
table gives no rows; texts of any length are taken whole. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, table
from .wordhash import words

#: Bytes between terms: all of ASCII but digits and letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_DOCS, _LENGTH = -1, -2


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for w in words(batch.column(1), lower=True, between=_BETWEEN):
            yield pa.RecordBatch.from_arrays([pa.array(ids[w.lo + w.row]), pa.array(w.hashes.astype(np.int64))], ["item_id", "term"])


def _postings(vocabulary):
    """(doc_id, n, terms, tfs) of each document with a term: places in the vocabulary, ascending, and counts, as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for w in words(batch.column(1), lower=True, between=_BETWEEN):
                n = np.diff(w.first)
                at = np.minimum(np.searchsorted(known, w.hashes), len(known) - 1)
                hit = known[at] == w.hashes
                key, tf = np.unique(w.row[hit] * np.int64(len(known)) + at[hit], return_counts=True)
                term, tf = (key % len(known)).astype(np.int32), tf.astype(np.int32)
                cuts = np.searchsorted(key // len(known), np.arange(w.hi - w.lo + 1)).tolist()
                own = np.flatnonzero(n > 0).tolist()
                ids = batch.column(0).slice(w.lo, w.hi - w.lo).take(pa.array(own, pa.int64()))
                pack = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[own]), pack(term), pack(tf)], ["doc_id", "n", "terms", "tfs"])

    return run


def _statistics(size: int):
    """(what, value): documents, their length and the document frequency of each term, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            docs += batch.num_rows
            length += int(batch.column(0).to_numpy().sum())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([seen, [_DOCS, _LENGTH]]).astype(np.int64)), pa.array(np.concatenate([df[seen], [docs, length]]).astype(np.int64))], ["what", "value"])

    return run


@dataclass
class Query:
    """Items as places of their terms (those of item i from first[i] to first[i + 1]), weights, and the statistics of all documents."""

    items: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    docs: int
    length: int


class _Scorer:
    def __init__(self, q: Query, window: int, k: int):
        self.q, self.k = q, k
        self.scores = np.zeros(window, np.int64)
        self.occupied = np.zeros(-(-window // 64), np.uint64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in q.items]

    def window(self, doc_id: np.ndarray, n: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Score the documents of a window (ascending doc_id) for every item; postings are (slot, term, tf)."""
        q = self.q
        order = np.lexsort((slot, term))
        slot, term, tf = slot[order], term[order], tf[order].astype(np.int64)
        m = 10 + (90 * n * q.docs) // q.length
        gives = q.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        # postings of term t from begin[t] to begin[t + 1]; words of the bitset from word_begin[t]
        begin = np.searchsorted(term, np.arange(len(q.weights) + 1))
        word_key = term.astype(np.int64) * len(self.occupied) + (slot >> 6)
        heads = np.flatnonzero(np.diff(word_key, prepend=-1))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), heads) if len(heads) else np.zeros(0, np.uint64)
        word, word_begin = (slot >> 6)[heads], np.searchsorted(term[heads], np.arange(len(q.weights) + 1))
        here = begin[1:] > begin[:-1]
        for i, (lo, hi) in enumerate(zip(q.first[:-1].tolist(), q.first[1:].tolist(), strict=True)):
            own = q.terms[lo:hi]
            own = own[here[own]]
            if not len(own):
                continue
            for t in own.tolist():
                a, b = begin[t], begin[t + 1]
                self.scores[slot[a:b]] += gives[a:b]  # a slot occurs once in a term's postings
                a, b = word_begin[t], word_begin[t + 1]
                self.occupied[word[a:b]] |= bits[a:b]
            self._harvest(self.heaps[i], doc_id)

    def _harvest(self, heap: list[tuple[int, int]], doc_id: np.ndarray) -> None:
        at = np.flatnonzero(np.unpackbits(self.occupied.view(np.uint8), bitorder="little"))
        s = self.scores[at]
        self.scores[at] = 0
        self.occupied[:] = 0
        # doc_ids ascend from window to window, so an equal score comes too late
        keep = s > (heap[0][0] if len(heap) == self.k else 0)
        at, s = at[keep], s[keep]
        if len(s) > self.k:
            least = np.partition(s, len(s) - self.k)[len(s) - self.k]
            at, s = at[s >= least], s[s >= least]
        for score, d in zip(s.tolist(), doc_id[at].tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -d))
            elif (score, -d) > heap[0]:
                heapq.heapreplace(heap, (score, -d))


def _windows(query, window: int, k: int):
    """The k best of each item, (item_id, doc_id, score), of a task's postings in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        scorer, held, many = _Scorer(q, window, k), [], 0

        def score(rows: list[tuple]) -> None:
            doc_id, n, terms, tfs = (list(x) for x in zip(*rows, strict=True))
            sizes = np.array([len(t) // 4 for t in terms])
            joined = (np.frombuffer(b"".join(x), np.int32) for x in (terms, tfs))
            scorer.window(np.array(doc_id, np.int64), np.array(n, np.int64), np.repeat(np.arange(len(sizes)), sizes), *joined)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                many += 1
                if many == window:
                    score(held)
                    held, many = [], 0
        if held:
            score(held)
        found = [(int(item), -d, s) for item, heap in zip(q.items.tolist(), scorer.heaps, strict=True) for s, d in heap]
        item, doc, s = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, s)], ["item_id", "doc_id", "score"])

    return run


def _answers(docs: DataFrame, pairs: DataFrame, window: int, k: int) -> DataFrame:
    """The k best documents of the items of one block of (item_id, term) pairs."""
    spark = docs.sparkSession
    own = pairs.toPandas()  # a block: bounded by pairs_at_once
    if own.empty:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    vocabulary, term = np.unique(own["term"].to_numpy().astype(np.uint64), return_inverse=True)
    items, item = np.unique(own["item_id"].to_numpy(), return_inverse=True)
    order = np.lexsort((term, item))
    first = np.searchsorted(item[order], np.arange(len(items) + 1))
    postings = table(docs.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms binary, tfs binary"), "postings")
    sums = postings.select("n", "terms").mapInArrow(_statistics(len(vocabulary)), "what long, value long").groupBy("what").agg(F.sum("value").alias("value"))
    found = {r["what"]: r["value"] for r in sums.collect()}  # a number for each term of the block
    n_docs, length = found.get(_DOCS) or 0, found.get(_LENGTH) or 0
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    query = spark.sparkContext.broadcast(Query(items, first, term[order], weights, n_docs, max(length, 1)))
    in_order = postings.where("doc_id is not null and length(terms) > 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    best = table(in_order.mapInArrow(_windows(query, window, k), "item_id long, doc_id long, score long"), "best")
    drop_tables(postings)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10, window: int = 8192, pairs_at_once: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, equal scores by ascending doc_id."""
    asked = items.where("item_id is not null").select("item_id", "text").mapInArrow(_item_terms, "item_id long, term long")
    asked = table(asked.distinct(), "asked")
    blocks = -(-asked.count() // pairs_at_once)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = found.unionByName(_answers(docs.select("doc_id", "text"), pairs, window, k))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
