"""Filter audit, exact top-k and lexical search on small awkward tables, against brute force."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tankwise.llm import filter_audit, lexical_search, top_k

DOCS = "doc_id long, text string, source string, part string, mask int, fp long, digest binary, k1 string"
LABELS = "doc_id long, quality int, toxic int, n long, good long"


def audit_rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    say = lambda n, kinds=400: " ".join(r.choice(vocabulary[:kinds]) for _ in range(n))
    common = say(60)
    texts = [say(r.choice([10, 49, 50, 80]), r.choice([20, 400])) + r.choice(["", " # ", " ABCDEFG HIJKL " * 3]) for _ in range(60)] + [common] * 90
    texts += [None, "", " \n", None, "", common.upper(), "ÄÖÜ ÉÈ " * 30, say(30_000), say(30_000) + " $", "A" * 50, "\U0001f600 " * 60]
    rows = [(i, t, ["a", None, "", "b", "a"][i % 5], "clash", 7, 1, b"x", "k") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [rows[0], rows[1], (rows[2][0], *rows[3][1:]), (None, common, "a", *rows[0][3:]), (None, None, None, None, None, None, None, None)]


def plain_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = {i for i, q, *_ in labels if q == 1}, {i for i, _, t, *_ in labels if t == 1}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    masks = []
    for i, t, part, *_ in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        masks.append((part or "", {f for f, bad in fails.items() if bad}, i is not None and i in good, i is not None and i in toxic))
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    removed = collections.Counter()
    out = {}
    for part, order, k in itertools.product({p for p, *_ in masks}, orders, range(5)):
        f, before = order[k], set(order[:k])
        mine = [(m, g, x) for p, m, g, x in masks if p == part]
        gone = [(g, x) for m, g, x in mine if f in m and not m & before]
        removed[part, f] += len(gone)
        out[part, order, k + 1] = [sum(not m & (before | {f}) for m, *_ in mine), len(gone), sum(f in m and bool(m & before) for m, *_ in mine), sum(m == {f} for m, *_ in mine), sum(g for g, _ in gone), sum(x for _, x in gone)]
    return {key: (*v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_audit_is_that_of_all_orders(spark, parts):
    rows = audit_rows()
    labels = [(0, 1, 0, 5, 5), (1, 0, 1, 5, 5), (70, 1, 1, 5, 5), (70, 0, 0, 5, 5), (71, None, None, 5, 5), (None, 1, 1, 5, 5), (9999, 1, 1, 5, 5), *[(i, i % 2, i % 3 == 0, 1, 1) for i in range(2, 60)]]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame([(i, q, int(t) if t is not None else None, n, g) for i, q, t, n, g in labels], LABELS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain_audit(rows, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_runs_of_equal_texts_go_on_across_batches_and_partitions():
    """The same rows cut at every place into two batches, or into two partitions whose edges are then looked up."""
    rows = [("p", i, 0, fp, t) for fp, t, ids in ((1, "x", [3, 5]), (2, "a", [1, 1, 4]), (2, "b", [2, 9, None]), (3, "c", [7])) for i in ids]
    columns = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), columns, strict=True)], ["part", "doc_id", "mask", "fp", "text"]) if part else None
    want = [(i, 16 if i in (5, 4, 9) else 0) for _, i, *_ in rows]

    def run(*parts):
        return [r for b in filter_audit._against_predecessors(iter([batch(p) for p in parts if p])) for r in b.to_pylist()]

    for cut in range(len(rows) + 1):
        got = run(rows[:cut], rows[cut:])
        assert [(r["doc_id"], r["mask"]) for r in got if r["part"]] == want
        both = [*run(rows[:cut]), *run(rows[cut:])]
        earliest = {}
        for r in both:
            if r["part"] is None and r["first_id"] is not None:
                key = r["fp"], r["digest"]
                earliest[key] = min(r["first_id"], earliest.get(key, r["first_id"]))
        found = [(r["doc_id"], r["mask"] | (16 if r["doc_id"] is not None and earliest.get((r["fp"], r["digest"]), math.inf) < r["doc_id"] else 0)) for r in both if r["part"]]
        assert found == want, cut


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string"), labels)
    assert one.count() == 600 and one.where("removed = 1 and filter <> 'A'").count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, cls long, query long"


def vectors(n=230, dims=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)).astype(np.float32)
    x[50:120] = x[40]  # a third are alike
    x[130:135] = -x[0]
    rows = [(i, [float(v) for v in row], i % 3, 1, 1) for i, row in enumerate(x)]
    bad = [(300, None, 1, 1, 1), (400, [], 1, 1, 1), (500, [1.0, None] + [0.0] * 10, 1, 1, 1), (600, [math.nan] * 12, 1, 1, 1), (700, [math.inf] * 12, 1, 1, 1), (None, [1.0] * 12, 1, 1, 1)]
    return rows + bad + [(1000, [0.0] * 12, None, 1, 1), (1001, [1.0, 2.0], 1, 1, 1), (1100, [3e38] * 12, 1, 1, 1), (-100, [-1.5] * 12, 1, 1, 1), rows[100], rows[7], (7, [9.0] * 12, 1, 1, 1)]


def plain_top(rows, k):
    own = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            e = [max(-top_k.LIMIT, min(top_k.LIMIT, math.floor(1024 * float(np.float32(x))))) for x in v]
            own[i] = min(own.get(i, e), e)
    out = []
    for q in own:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own[q], e, strict=False)), i) for i, e in own.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "lists": 5, "block_rows": 40, "query_rows": 2}, {"k": 1000}, {"lists": 50}])
def test_top_k_is_exact(spark, settings):
    rows = vectors()
    got = top_k.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), **settings).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top(rows, settings.get("k", 10))


def test_top_k_of_few_or_no_vectors(spark):
    of = lambda rows: sorted(map(tuple, top_k.top_k(spark.createDataFrame(rows, VECTORS)).collect()))
    assert of([]) == [] and of([(0, [1.0], 1, 1, 1)]) == [] and of([(1, [1.0], 1, 1, 1), (2, [1.0], 1, 1, 1)]) == []
    assert of([(0, [1.0], 1, 1, 1), (1, [-1.0], 1, 1, 1)]) == [(0, 1, 1, -(1024 * 1024))]


def test_what_is_collected_reaches_the_cutoff():
    part = np.array([[5, 1, 7, 4], [-3, -9, -4, -4]])
    row, at = top_k._reaching(2)(part, np.arange(4), np.array([9, -7]))
    assert list(zip(row.tolist(), at.tolist(), strict=True)) == [(0, 0), (0, 2), (1, 0)]
    row, at = top_k._best(2)(part, np.array([9, 8, 7, 6]), None)
    assert list(zip(row.tolist(), at.tolist(), strict=True)) == [(0, 2), (0, 0), (1, 0), (1, 3)]


SEARCH = "doc_id long, text string, n long, terms binary, item_id long, row string"


def search_rows():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5))) for _ in range(150)] + ["straße", "ÄRGER", "naïve", "X1", "日本語"]
    say = lambda n: r.choice([" ", "-", ", ", "\n"]).join(r.choice([w, w.upper()]) for w in r.choices(vocabulary, k=n))
    texts = [say(r.randint(1, 60)) for _ in range(150)] + [say(40)] * 30 + [None, "", " .,;- ", "!", say(30_000)]
    rows = [(i * (1 if i % 2 else 10**9), t, 5, b"x", 3, "clash") for i, t in enumerate(texts)]
    items = [(i, say(r.randint(1, 25))) for i in range(12)] + [(20, texts[160]), (21, None), (22, "zzzzzzzz nowhere"), (23, "a"), (23, "b a"), (None, "a"), (-5, say(300))]
    return rows + [rows[3], rows[3], (rows[4][0], *rows[5][1:]), (None, texts[6], 1, b"", 1, "x")], items


def plain_search(rows, items, k=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in find.findall(t or "")]
    docs = [(i, collections.Counter(terms(t))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in own if c[w])
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(i, n + 1, d, -s) for n, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"window": 7, "k": 4}, {"pairs_at_once": 40, "window": 64}])
def test_search_is_exact(spark, settings):
    rows, items = search_rows()
    got = lexical_search.search(spark.createDataFrame(rows, SEARCH).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **settings).collect()
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got) == plain_search(rows, items, settings.get("k", 10))


def test_search_of_empty_tables(spark):
    rows, items = search_rows()
    docs, asked = spark.createDataFrame(rows, SEARCH), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(docs.limit(0), asked).count() == 0 and lexical_search.search(docs, asked.limit(0)).count() == 0
    assert lexical_search.search(docs.withColumn("text", F.lit(None).cast("string")), asked).count() == 0


def test_very_long_texts_and_lines_are_taken_whole(spark):
    """A licence, an entity and a shared line at the end of two million words, and two such texts that differ in one word."""
    from tankwise.llm import jaccard_join, license_scan, line_dedup, mixing, surrogates, weak_labels

    r = random.Random(31)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    long = " ".join(r.choice(vocabulary) for _ in range(200_000))
    line = "this very line of the text is in many of the documents"
    tail = f"\nunder the MIT license, mail jo.doe@mail.example.com\n{line}"
    rows = [(0, long + tail), (1, "x " + long + tail), *[(i, f"short text {i}\n{line}") for i in range(2, 7)]]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    found = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    assert found[0].base_labels == "mit" and found[0].first_word > 199_000
    changed = {x.doc_id: x.text for x in surrogates.replace_entities(docs, "k").collect()}
    assert changed[0].startswith(long) and "jo.doe" not in changed[0] and changed[0].endswith(line)
    left = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert left[0] == (long + tail).rsplit("\n", 1)[0] and left[6].endswith(line) and not left[2].endswith(line)
    assert {x.doc_id: x.component_id for x in jaccard_join.similar_components(docs.where("doc_id < 2")).collect()} == {0: 0, 1: 0}
    assert {x.doc_id: x.size for x in mixing.mix(docs).collect()}[0] == len((long + tail).split())
    assert weak_labels.classify(docs).count() == 7
