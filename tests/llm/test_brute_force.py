"""Operators without SQL recomputed in plain Python: cuts of the tree, blocks of the mix, expectation maximisation, stages of the pipeline."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankwise.llm import kd_shards, mixing, weak_labels
from tankwise.llm.common import row_key, word_count

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n=400, seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    hot = say(50)
    rows = [(i, hot if i % 3 == 0 else say(r.choice([1, 5, 30, 200])), r.choice(["en", "de", "fr", None]), "big" if r.random() < 0.4 else r.choice(["s1", "s2", None])) for i in range(n)]
    rows += [(n + 1, None, "en", "s1"), (n + 2, "", None, None), rows[3], rows[3], (None, hot, "en", "big")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def coordinates(rows):
    """Each row's place along the four dimensions, in 32768 steps of their ranges; null is 0."""
    crc = lambda v: None if v is None else float(zlib.crc32(v.encode()))
    raw = [(crc(s), crc(lang), None if t is None else math.log1p(len(t.encode())), None if i is None else float(i)) for i, t, lang, s in rows]
    out = []
    for column in zip(*raw, strict=True):
        known = [x for x in column if x is not None]
        lo, hi = min(known), max(known)
        out.append([0 if x is None else math.floor((x - lo) / (hi - lo) * 32767) for x in column])
    return list(zip(*out, strict=True))


@pytest.mark.parametrize("leaves", [2, 7, 16])
def test_each_cut_is_a_weighted_median_along_the_widest_dimension(spark, leaves):
    rows = documents()
    got = kd_shards.kd_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), n_shards=leaves, tolerance=0.0).collect()
    place = collections.defaultdict(list)
    for row, at in zip(rows, coordinates(rows), strict=True):
        place[row[0], len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode())].append(at)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append((place[r.doc_id, r.size, r.text_crc32].pop(), r.size))
    assert not any(place.values())

    def check(first, k):
        """Shards first to first + k - 1 are one node of the tree."""
        if k == 1:
            return
        parts = [[x for s in range(a, b) for x in shards[s]] for a, b in ((first, first + k // 2), (first + k // 2, first + k))]
        both = parts[0] + parts[1]
        wide = [max(x[0][d] for x in both) - min(x[0][d] for x in both) for d in range(4)]
        d = wide.index(max(wide))
        assert max(x[0][d] for x in parts[0]) <= min(x[0][d] for x in parts[1])
        left, whole = sum(x[1] for x in parts[0]), sum(x[1] for x in both)
        assert abs(left - whole * (k // 2) / k) <= max(x[1] for x in both)
        check(first, k // 2)
        check(first + k // 2, k - k // 2)

    assert set(shards) == set(range(leaves))
    check(0, leaves)


def block_mix(rows, order, block, plan, seed=17):
    """Words that each document (in the order of its source's stream) gives, block by block."""
    taken = {}
    for source, p in plan.items():
        stream = order[source]
        owner = [i for i, size in stream for _ in range(size)]
        n, q, start = p["blocks"], p["quota"], p["start"]
        times = [q // n + ((i + 1 + start) * (q % n) // n - (i + start) * (q % n) // n) for i in range(n)] if n else []
        for i, _ in stream:
            taken[i] = 0
        for b in range(n):
            for i in owner[b * block : (b + 1) * block]:
                taken[i] += times[b]
    return taken


def test_each_document_gives_its_words_in_the_chosen_blocks(spark):
    rows = documents(seed=3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    block, planned = mixing.plan(list(sizes.items()))
    plan = {p["source"]: p for p in planned}
    # the seeded order of each stream; hashes are Spark's
    keyed = docs.select("doc_id", "source", *row_key("doc_id", "source", "text"), word_count(F.col("text")).alias("size")).withColumn("h", F.xxhash64(F.lit(17), "k1", "k2")).collect()
    starts = {r.source: r.x for r in spark.createDataFrame([(s,) for s in plan], "source string").select("source", F.xxhash64(F.lit(17).cast("long"), F.lit("start"), "source").alias("x")).collect()}
    order = collections.defaultdict(list)
    for n, r in enumerate(sorted(keyed, key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r.k2))):
        order[r.source].append(((r.doc_id, r.size, n), r.size))
    for s, p in plan.items():
        assert len(order[s]) <= mixing.ROWS_A_BUCKET  # one bucket: the order of hashes is that of the stream
        p["start"] = starts[s] % p["blocks"] if p["blocks"] else 0
    want = collections.Counter((i, size, words) for (i, size, _), words in block_mix(rows, order, block, plan).items())
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()) == want
    shares = mixing.water_fill([p["source_size"] for p in planned], [1.0 + i % 3 for i in range(len(planned))], 3)
    assert [p["target"] for p in planned] == shares and [p["source"] for p in planned] == ["big", "s1", "s2", None]


def test_highest_quotients_get_the_seats():
    r = random.Random(1)
    for _ in range(60):
        targets = [r.choice([0, r.randint(1, 500)]) for _ in range(r.randint(1, 7))]
        seats = r.randint(0, 60)
        want = [0] * len(targets)
        for _ in range(seats if sum(targets) else 0):
            i = max(range(len(targets)), key=lambda i: (targets[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert mixing.sainte_lague(targets, seats) == want


def plain_em(patterns, counts, rounds=100):
    """The same model document by document, with dictionaries."""
    post = [min(0.98, max(0.02, (sum(p) / len(p) + 1) / 2)) for p in patterns]
    for _ in range(rounds):
        weight = [(n * (1 - x), n * x) for n, x in zip(counts, post, strict=True)]
        prior = (sum(w[1] for w in weight) + 1) / (sum(map(sum, weight)) + 2)
        given = {}
        for k, c in itertools.product(range(len(patterns[0])), (0, 1)):
            votes = {v: 0.5 + sum(w[c] for p, w in zip(patterns, weight, strict=True) if p[k] == v) for v in (-1, 0, 1)}
            for v in votes:
                given[k, c, v] = votes[v] / sum(votes.values())
        new = []
        for p in patterns:
            bad, good = ((prior if c else 1 - prior) * math.prod(given[k, c, v] for k, v in enumerate(p)) for c in (0, 1))
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        if done:
            break
        post = new
    return post, given


def test_expectation_maximisation_is_the_plain_one_and_finds_the_accuracies():
    r = random.Random(7)
    accuracy, silent = [0.95, 0.8, 0.7, 0.6], [0.1, 0.2, 0.0, 0.5]
    truth = [r.random() < 0.7 for _ in range(4000)]
    seen = collections.Counter()
    right = collections.Counter()
    for good in truth:
        p = tuple(0 if r.random() < s else (1 if (r.random() < a) == good else -1) for a, s in zip(accuracy, silent, strict=True))
        seen[p] += 1
        right[p] += good
    patterns, counts = list(seen), [seen[p] for p in seen]
    post, given, share = weak_labels.expectation_maximisation(np.array(patterns), np.array(counts, float))
    want, plain = plain_em(patterns, counts)
    assert post.tolist() == pytest.approx(want, abs=1e-6)
    assert all(given[k, c, v + 1] == pytest.approx(plain[k, c, v], abs=1e-6) for k, c, v in plain)
    found = [given[k, 1, 2] / (given[k, 1, 0] + given[k, 1, 2]) for k in range(4)]
    assert found == pytest.approx(accuracy, abs=0.06) and share == pytest.approx(0.7, abs=0.05)
    assert sum(seen[p] * (abs(x - right[p] / seen[p])) for p, x in zip(patterns, post, strict=True)) / len(truth) < 0.06


def test_the_classifier_agrees_with_labels_that_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in weak_labels.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    hit = {q: [got[i] == bool(q) for i, x in labels.items() if x == q] for q in (0, 1)}
    assert np.mean(hit[1]) >= 0.9 and np.mean(hit[0]) >= 0.5, {q: np.mean(x) for q, x in hit.items()}


def test_the_pipeline_mixes_by_targets_recomputed_here(spark):
    """Each source's words come near its target; each document comes floor or ceil of its share of times, whatever the operator says."""
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = collections.Counter(r.doc_id for r in c.mix(spark, docs, "").select("doc_id").collect())
    size, source = {}, {}
    for r in docs.collect():
        size[r.doc_id], source[r.doc_id] = len(WORDS.findall(r.text or "")), r.source
    whole = collections.Counter()
    for i, n in size.items():
        whole[source[i]] += n
    names = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, full = {}, set()
    while True:  # the excess of full sources goes to the others by weight
        rest = sum(whole.values()) - sum(3 * whole[s] for s in full)
        open_ = sum(weights[s] for s in names if s not in full)
        target = {s: 3 * whole[s] if s in full else rest * weights[s] / open_ for s in names}
        more = {s for s in names if s not in full and target[s] > 3 * whole[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for i, n in out.items():
        assert size[i] > 0 and n <= 3
        taken[source[i]] += n * size[i]
    # a document's number is rounded by a coin, which misses its words by half their number at most on average
    for s in names:
        assert abs(taken[s] - target[s]) <= 1.5 * math.sqrt(sum(size[i] ** 2 for i in size if source[i] == s)) + 1, s
