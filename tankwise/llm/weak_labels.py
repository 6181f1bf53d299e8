"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by pattern over all
documents (at most 3^8 patterns); expectation-maximisation on these counts estimates each labeller's accuracies and the
posterior of good for a pattern. Posterior labels of a bounded sample (sample_size documents with the smallest seeded
hashes) train a logistic scorer on hashed byte pairs and triples of whole texts, which then scores every document.

Defined cases: a null, empty or blank text is rejected (score 0); documents alike in text get the same score; with
fewer than two classes in the sample the posterior of the document's votes decides; columns besides doc_id and text, of
whatever names and types, are not looked at (keep_good passes them through); repeated rows, those with null text too,
are judged alike and each kept or rejected; texts of any length are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .perplexity import dup_lines, repeated

LABELLERS = ("symbols", "capitals", "exclaimed", "pipes", "repeats", "stutter", "common_words", "lines")
# Very common words of four languages.
COMMON = frozenset(b"the of and to in is that it for was with as are on be this de la le les et des un une que en du el los las y se con por der die das und ist nicht ein zu den mit von".split())
SLOTS = 1 << 12
ROWS_A_BATCH = 256
_PAIR = np.random.default_rng(11).integers(1, 2**31, 256).astype(np.uint32) | np.uint32(1)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def votes(text: str, n_repeat: int) -> list[int]:
    """1 good, -1 bad, 0 no vote, in the order of LABELLERS."""
    own = text.encode().split()
    n = len(own)
    if not n:
        return [-1] * len(LABELLERS)
    letters = max(1, len(text) - sum(map(text.count, " \n")))
    vote = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    capitals = sum(x.isupper() for x in text.split())
    return [
        vote(sum(map(text.count, "#*$%&|<>@\\^~")) / n, 0.05, 0.4),
        vote(capitals / n, 0.1, 0.35),
        vote(text.count("!") / n, 0.05, 0.3),
        vote(text.count("|") / n, 0.02, 0.25),
        vote(n_repeat / n, 0.1, 0.4),
        vote(sum(a == b for a, b in zip(own, own[1:], strict=False)) / n, 0.05, 0.3),
        vote(-sum(x in COMMON for x in own) / n, -0.12, -0.03) if n >= 30 else 0,
        vote(dup_lines(text) / max(1, text.count("\n")), 0.1, 0.4) if letters > 1 else 0,
    ]


def features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples, SLOTS of each, less for short texts, and a constant."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < 3:
        return np.zeros(2 * SLOTS + 1, np.float32)
    a, b = x[:-1].astype(np.uint32), _PAIR[x[1:]]
    pair = ((a * np.uint32(0x9E3779B1)) ^ b) * np.uint32(0x85EBCA6B)
    triple = (pair[:-1] ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    out = [np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=SLOTS) / (len(h) + 100) for h in (pair, triple)]
    return np.append(np.sqrt(np.concatenate(out)), 1).astype(np.float32)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        again = repeated(batch.column(1)).tolist()
        out = [votes(t or "", n) for t, n in zip(batch.column(1).to_pylist(), again, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int8()))], ["hash", "votes"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) as [labeller, class, vote + 1], and the share of good."""
    post = np.clip((patterns.mean(axis=1) + 1) / 2, 0.02, 0.98)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior, given = 0.5, None
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = (w[1].sum() + 1) / (w.sum() + 2)
        given = np.einsum("cp,plv->lcv", w, onehot) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        log = np.einsum("plv,lcv->pc", onehot, np.log(given)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, given, prior


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 8.0, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by gradient descent with momentum."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / np.float32(len(y)) + np.float32(l2) * w
        speed = np.float32(0.9) * speed + grad
        w -= np.float32(rate) * speed
    return w


def _train(texts: DataFrame, sample_size: int, seed: int):
    """Of texts (hash, text): the broadcast scorer weights (None without two classes) and posteriors by votes."""
    spark = texts.sparkSession
    voted = table(texts.mapInArrow(_vote, "hash long, votes array<byte>"), "votes")
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** 8 rows
    if not found:
        return spark.sparkContext.broadcast((None, {}))
    patterns, counts = np.array([list(r["votes"]) for r in found]), np.array([r["n"] for r in found], float)
    post, _, _ = expectation_maximisation(patterns, counts)
    posterior = {tuple(p): float(x) for p, x in zip(patterns.tolist(), post, strict=True)}
    # the sample: texts with the smallest seeded hashes
    order = F.xxhash64(F.lit(seed), "hash")
    limit = voted.select(order.alias("o")).distinct().orderBy("o").limit(sample_size).agg(F.max("o")).first()[0]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                x = [features(t.encode()).tobytes() for t in texts]
                y = [posterior[tuple(votes(t, n))] for t, n in zip(texts, repeated(batch.column(1)).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(y, pa.float64())], ["hash", "x", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.zeros((sample_size, 2 * SLOTS + 1), np.float32), []
        for batch in batches:
            for row, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                x[len(y)] = np.frombuffer(row.as_buffer(), np.float32)
                y.append(label)
        x, y = x[: len(y)], np.array(y)
        if (y >= 0.5).any() and (y < 0.5).any():
            yield pa.RecordBatch.from_arrays([pa.array([fit(x, y).tobytes()], pa.binary())], ["w"])

    # the sample is bounded, so one task fits it; only the weights reach the driver
    rows = texts.where(order <= limit).dropDuplicates(["hash"]).mapInArrow(sampled, "hash long, x binary, y double")
    w = rows.repartition(1).sortWithinPartitions("hash").mapInArrow(fitted, "w binary").first()
    return spark.sparkContext.broadcast((np.frombuffer(w[0], np.float32) if w else None, posterior))


def _scores(texts: pa.Array, weights: tuple) -> tuple[list[float], list[float]]:
    """Posteriors by votes, and scores."""
    w, by_votes = weights
    own = [t or "" for t in texts.to_pylist()]
    p = [by_votes.get(tuple(votes(t, n)), 0.5) for t, n in zip(own, repeated(texts).tolist(), strict=True)]
    s = [float(1 / (1 + np.exp(-np.clip(features(t.encode()) @ w, -30, 30)))) for t in own] if w is not None else p
    return p, [v if t.strip(" \t\n\x0b\x0c\r") else 0.0 for v, t in zip(s, own, strict=True)]


def classify(docs: DataFrame, sample_size: int = 3000, seed: int = 5) -> DataFrame:
    """(doc_id, posterior, score, kept): posterior of good by votes, the scorer's probability, kept if 0.5 or more."""
    weights = _train(docs.select(F.xxhash64("text").alias("hash"), "text"), sample_size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s = _scores(batch.column(1), weights.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([v >= 0.5 for v in s], pa.bool_())], ["doc_id", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, sample_size: int = 3000, seed: int = 5) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns."""
    weights, at = _train(docs.select(F.xxhash64("text").alias("hash"), "text"), sample_size, seed), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([v >= 0.5 for v in _scores(batch.column(at), weights.value)[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
