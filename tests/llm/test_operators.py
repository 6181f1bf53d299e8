"""Each operator on small awkward tables, against brute force."""

import collections
import hashlib
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tankwise.llm import common, jaccard_join, kd_shards, license_scan, line_dedup, mixing, near_vectors, perplexity, piece_fst, surrogates, weak_labels
from tankwise.llm.queries import PIECES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, pos int"
LINE = "This very line is shared by many of the documents here"


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = say(200)
    texts = [say(r.randint(1, 150)) for _ in range(30)] + [base] * 4
    for _ in range(10):
        w = base.split()
        for _ in range(r.randint(1, 12)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [say(20) + "\n" + LINE + (" \t" if i % 2 else "") + "\n" + say(9) for i in range(7)] + [LINE.upper() + "\n" + LINE]
    texts += [None, "", " \n\t ", "one", "One two", "!!! *** $$$", say(20_000), "Under the MIT License, x. Apache License, Version 2.0; cc-by-nc", "mail the.72@mail3.example.com or +1 (017) 555-7713, card 4929 3590 0253 0524", "MAIL THE.72@MAIL3.EXAMPLE.COM from 10.20.30.40 and Frau Müller"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "a", "a", "b"][i % 5], None, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[40], rows[3], (None, base, "en", "a", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_perplexity_counts_and_bands(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in perplexity.score(docs).collect()}
    for i, t, *_ in corpus():
        w = words(t)
        g = got[i, len(w)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        mark = [any(c[tuple(w[j : j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(w) - 3) + 1)) for k in range(len(w))]
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(mark))
        assert g["base_failed"] == (len(w) < 50 or 100 * sum(mark) > 50 * len(w)) and not (g["base_failed"] and g["kept"])
    assert perplexity.score(empty).count() == 0


def plain_model(texts, order=5):
    """Interpolated modified Kneser-Ney over bytes, in plain dictionaries: a function from a 5-byte key to its probability."""
    counts = {order: collections.Counter()}
    for t in texts:
        data = b" " * (order - 1) + b" ".join([*t.encode().split(), b""])
        counts[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(k[1:] for k in counts[n + 1])
    cuts, total, left = {}, collections.Counter(), collections.Counter()
    for n, c in counts.items():
        m = collections.Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        for k in (1, 2, 3):
            d = None if y is None or not m[k] else k - (k + 1) * y * m[k + 1] / m[k]
            cuts[n, k] = 0.5 if d is None else min(max(d, 0.05), k - 0.05)
        for key, v in c.items():
            total[n, key[:-1]] += v
            left[n, key[:-1]] += cuts[n, min(v, 3)]

    def p(key):
        n = len(key)
        if not n:
            return 1 / 256
        c, ctx = counts[n][key], (n, key[:-1])
        if not total[ctx]:
            return p(key[1:])
        return (c - (cuts[n, min(c, 3)] if c else 0)) / total[ctx] + left[ctx] / total[ctx] * p(key[1:])

    return p


def test_perplexity_is_that_of_the_other_fold_and_both_ways_agree(spark, docs):
    long_ones = [(i, t, lang or "") for i, t, lang, *_ in corpus() if len(words(t)) >= 50 and i is not None]
    fold = lambda t: perplexity.folds_of(pa.array([t]))[0]
    a, b = (sorted((r["doc_id"] or -1, r["n_words"], r["log_ppl"] or 0, r["kept"]) for r in perplexity.score(docs, max_model=m).collect()) for m in (10**7, 0))
    assert a == b  # to the last digit
    got = {r["doc_id"]: r for r in perplexity.score(docs).collect() if r["doc_id"] is not None}
    again = {i for i, t, *_ in corpus() if got.get(i) and got[i]["base_failed"]}
    models = {}
    for i, t, lang in long_ones:
        if i in again:
            assert got[i]["log_ppl"] is None
            continue
        if len(t) > 3000:
            continue
        if (lang, fold(t)) not in models:
            rows = [u for _, u, x, *_ in corpus() if (x or "") == lang and fold(u) == 1 - fold(t)]
            models[lang, fold(t)] = plain_model(rows)
        data = b"    " + b" ".join([*t.encode().split(), b""])
        want = -sum(np.log(models[lang, fold(t)](data[k : k + 5])) for k in range(len(data) - 4)) / (len(data) - 4)
        assert got[i]["log_ppl"] == pytest.approx(want, abs=1e-4)


def test_small_languages_are_judged(spark):
    """Eight documents of a language that share their least window hash, and so a fold, are dealt by their texts."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("aeioubdgklmnprst") for _ in range(r.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    first = next(x for x in iter(lambda: say(3), None) if perplexity.windows(pa.array([x]))[2][0] < 2**54)  # its hash is hardly undercut
    texts = [f"{first} {say(120)}" for _ in range(9)]
    least = perplexity.windows(pa.array(texts))[2]
    texts = [t for t, h in zip(texts, least.tolist(), strict=True) if h == least.max()]
    junk = first + " " + " ".join("".join(r.choice("qxzwvj") for _ in range(6)) for _ in range(120))
    rows = [(i, t, "xx") for i, t in enumerate([*texts, junk])] + [(100, texts[0], "yy"), (101, texts[0], "yy")]
    got = {row.doc_id: row for row in perplexity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    n = len(texts)
    assert n >= 6 and len({perplexity.folds_of(pa.array([t]))[0] for t in texts}) == 1
    assert got[n].log_ppl > max(got[i].log_ppl for i in range(n)) + 0.5 and not got[n].kept
    assert got[100].kept and got[101].kept and got[100].log_ppl == got[101].log_ppl


def test_perplexity_bands_reject_planted_junk_on_both_sides(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    weights = [1 / (k + 2) for k in range(400)]
    say = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    texts = {i: say(r.randint(80, 200)) for i in range(300)}
    shuffled = ["".join(r.sample(texts[i], len(texts[i]))) for i in range(3)]
    foreign = [" ".join("".join(r.choice("jkpquvwxyz") for _ in range(5)) for _ in range(100)) for _ in range(3)]
    often = [" ".join(r.choices(vocabulary[:9], k=120)) for _ in range(3)]
    junk = dict(enumerate(shuffled + foreign + often, 1000))
    df = spark.createDataFrame([(i, "en", t) for i, t in (texts | junk).items()], "doc_id long, lang string, text string")
    got = {x["doc_id"]: x for x in perplexity.score(df).collect()}
    assert all(not got[i]["kept"] and not got[i]["base_failed"] for i in junk)
    assert all(got[i]["log_ppl"] > got[i]["high"] for i in range(1000, 1006)) and all(got[i]["log_ppl"] < got[i]["low"] for i in range(1006, 1009))
    assert sum(got[i]["kept"] for i in texts) >= 290


def test_perplexity_word_order_and_outliers_count(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6))) for _ in range(80)]
    after = {w: r.sample(vocabulary, 4) for w in vocabulary}

    def say():
        w = [r.choice(vocabulary)]
        while len(w) < 80:
            w.append(r.choice(after[w[-1]]))
        return " ".join(w)

    texts = [say() for _ in range(120)]
    mixed = texts[0].split()
    r.shuffle(mixed)
    hard = " ".join("".join(r.choice("uvwxyz") for _ in range(4)) if i % 8 == 0 else w for i, w in enumerate(say().split()))
    rows = [*enumerate(texts), (200, " ".join(mixed)), (201, hard)]
    got = {x["doc_id"]: x for x in perplexity.score(spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string")).collect()}
    assert got[200]["log_ppl"] > got[0]["log_ppl"] + 0.03 and not got[201]["base_failed"] and not got[201]["kept"]
    assert sum(got[i]["kept"] for i in range(120)) >= 110


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 8))
    v = [x.tolist() for x in np.concatenate([base, base[:20] + 0.05 * r.normal(size=(20, 8)), base[:1], base[:1]])]
    rows = [(i, x, int(i % 40 % 3)) for i, x in enumerate(v)] + [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, [None] * 8, 1), (104, v[0], None), (None, v[0], 0), (105, [], 0), (106, [1.0, 2.0], 0), (1, v[1], 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    good = [(i, x, g) for i, x, g in rows if i is not None and g is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links = {n: [m for m, (j, y, h) in enumerate(good) if m != n and g == h and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93] for n, (i, x, g) in enumerate(good)}
    root = {i: i for i, *_ in rows if i is not None}
    for _ in root:
        for n, to in links.items():
            for m in to:
                low = min(root[good[n][0]], root[good[m][0]])
                root[good[n][0]] = root[good[m][0]] = low
    want = [(i, len(links[n]), root[i]) for n, (i, *_) in enumerate(good)]
    left = collections.Counter(i for i, *_ in rows) - collections.Counter(i for i, *_ in good)
    want += [(i, 0, root.get(i)) for i in left.elements()]
    assert got == sorted(want, key=repr)
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_oversize_shards_are_tiled_without_loss(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(1, 6)) + 0.02 * r.normal(size=(60, 6)), r.normal(size=(60, 6))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(df, shard_rows=20, per_pivot=40).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in got)


def groups_of_near_copies(spark, sizes):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(1, 64)) + 0.15 * r.normal(size=(n, 64)) for n in sizes])
    nodes = spark.createDataFrame([(i, "g", 1 + i % 2, v.tolist()) for i, v in enumerate(x)], "nid long, grp string, copies long, values array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.93
    np.fill_diagonal(hit, False)
    return nodes, hit


def parts_of(n, edges):
    root = list(range(n))
    while True:
        was = list(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if was == root:
            return root


def test_small_groups_beside_a_large_one_are_found(spark):
    nodes, hit = groups_of_near_copies(spark, [50] * 20 + [500])
    counts, edges, recall = near_vectors.near_links(nodes, goal=0.0)
    got = {r["nid"]: r["links"] for r in counts.collect()}
    want = hit @ (1 + np.arange(1500) % 2)
    assert all(got[i] <= want[i] for i in got) and recall >= 0.95
    assert sum(got.get(i, 0) for i in range(1000)) >= 0.95 * want[:1000].sum()
    e = [(r["a"], r["b"]) for r in edges.collect()]
    assert len(e) < 6000 < hit.sum() / 2  # a spanning set, not all pairs
    assert parts_of(1500, e) == parts_of(1500, np.argwhere(hit).tolist())


def test_links_of_overlapping_and_tiled_cells_count_once(spark):
    nodes, hit = groups_of_near_copies(spark, [120, 90, 30])
    want = hit @ (1 + np.arange(240) % 2)
    for settings in ({"shard_rows": 25}, {"per_pivot": 12, "overlap": 3}, {"per_pivot": 12, "overlap": 8, "shard_rows": 25}):
        counts, _, recall = near_vectors.near_links(nodes, goal=0.0, **settings)
        got = {r["nid"]: r["links"] for r in counts.collect()}
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() and recall >= 0.9


def test_large_cells_are_split_by_pivots_of_their_own(spark):
    nodes, hit = groups_of_near_copies(spark, [40] * 12 + [150])
    parts_seen = []
    split = near_vectors._split

    def spied(cells, *more, **kw):
        out = split(cells, *more, **kw)
        parts_seen.extend(r["shard"] for r in out.select("shard").distinct().collect())
        return out

    near_vectors._split = spied
    try:
        counts, edges, recall = near_vectors.near_links(nodes, goal=0.0, shard_rows=60)
    finally:
        near_vectors._split = split
    got = {r["nid"]: r["links"] for r in counts.collect()}
    want = hit @ (1 + np.arange(630) % 2)
    assert any("." in x for x in parts_seen) and any(x.endswith("!") for x in parts_seen)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() and recall >= 0.9
    assert parts_of(630, [(r["a"], r["b"]) for r in edges.collect()]) == parts_of(630, np.argwhere(hit).tolist())


def test_failing_the_audit_compares_all(spark):
    nodes, hit = groups_of_near_copies(spark, [30, 2])
    counts, edges, recall = near_vectors.near_links(nodes, overlap=16, goal=1.1, shard_rows=20)
    want = hit @ (1 + np.arange(32) % 2)
    assert recall == 1 and {r["nid"]: r["links"] for r in counts.collect()} == {i: n for i, n in enumerate(want.tolist()) if n}
    assert parts_of(32, [(r["a"], r["b"]) for r in edges.collect()]) == parts_of(32, np.argwhere(hit).tolist())


def test_audit_is_by_vector(spark):
    nodes, hit = groups_of_near_copies(spark, [9, 2])
    counts = spark.createDataFrame([(9, int(1 + 10 % 2))], "nid long, links long")  # all links of one of the pair, no others
    assert near_vectors._recall(nodes, counts, 200, 0.93) == pytest.approx(1 / 11)
    assert near_vectors._recall(nodes.where("nid = 3"), counts, 200, 0.93) is None


def test_extreme_vectors_are_compared_like_others(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 2e-200], 0), (4, [1.0, 2.0], 0), (5, [-1e-200, 1e-200], 0), (6, [3e-310, 6e-310], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = {i: [j for j, y, _ in rows if j != i and abs(np.arctan2(*x) - np.arctan2(*y)) <= np.arccos(0.93)] for i, x, _ in rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(v) for i, v in links.items()} and got[5] == (0, 5)


def test_surrogates(docs, empty):
    rows = corpus()
    out = surrogates.replace_entities(docs, "key")
    assert out.columns.count("k1") == 1 and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    n = len(rows) - 4
    mail, loud = got[n - 2], got[n - 1]
    a, b = re.search(r"[\w.]+@[\w.]+", mail["text"])[0], re.search(r"[\w.]+@[\w.]+", loud["text"])[0]
    assert b == a.upper() and a != "the.72@mail3.example.com" and (mail["n_entities"], loud["n_entities"]) == (3, 3)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", mail["text"]) and re.search(r"card \d{4} \d{4} \d{4} \d{4}$", mail["text"]) and "Müller" not in loud["text"] and "Frau " in loud["text"]
    assert all(got[i]["text"] == t for i, t, *_ in rows[: n - 3] if i is not None)
    made = surrogates.surrogates(surrogates.parts(surrogates.entities(docs)), "key").where("kind <> 'initials'").collect()
    assert len({(r["kind"], r["surrogate"]) for r in made}) == len(made) and not {(r["kind"], r["surrogate"]) for r in made} & {(r["kind"], r["canon"]) for r in made}
    assert surrogates.replace_entities(empty, "key").count() == 0


def test_surrogates_leave_no_part_of_an_entity(spark):
    secret = "Ab3" * 100
    texts = [f"token={secret} end", f"api_key: {secret[:20]}.{secret[:30]}.x9. End", "Mr John Paul Smith left", "then Mr J. Smith left", "Mrs Ann Kovac came. ann Kovac, Ann Kovac and Ann Kovacs"]
    got = [r["text"] for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    assert "Ab3Ab3" not in got[0] + got[1] and re.fullmatch(r"token=[A-Za-z0-9]{300} end", got[0]) and re.fullmatch(r"api_key: \w{20}\.\w{30}\.[a-z]\d\. End", got[1])
    assert not re.search("John|Paul|Smith|J[.]", got[2] + got[3])
    name = re.match(r"Mrs (\w+ \w+) came", got[4])[1]
    assert name != "Ann Kovac" and got[4] == f"Mrs {name} came. ann {name.split()[1]}, {name} and Ann Kovacs"


def replaced(spark, texts, key="key"):
    df = surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key)
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def test_surrogates_keep_persons_together(spark):
    got = replaced(spark, ["Herr Schmidt kam. Schmidt ging, SCHMIDT nicht.", "MR SMITH and Mr John Smith, then Mr Smith and John Smith", "Frau Anna Schmidt"])
    m = re.fullmatch(r"Herr (\w+) kam[.] (\w+) ging, (\w+) nicht[.]", got[0])
    assert m[1] == m[2] != "Schmidt" and m[3] == "SCHMIDT"  # only the written forms that a title carries
    m = re.fullmatch(r"MR (\w+) and Mr (\w+) (\w+), then Mr (\w+) and (\w+) (\w+)", got[1])
    assert m[1] == m[3].upper() and m[3] == m[4] == m[6] and m[2] == m[5] and m[2].endswith("rd") and not {"Smith", "John"} & set(m.groups())
    assert re.fullmatch(r"Frau \w+na \w+", got[2]) and got[2].split()[2] == re.match(r"Herr (\w+)", got[0])[1]


def test_given_names_alone_and_checked_addresses(spark):
    got = replaced(spark, ["Mr John Smith and John went. John, John-Boy, John Brown and Johnny stay.", "10.0.0.256 and 10.0.0.25 and 255.255.255.0", "John went"])
    m = re.fullmatch(r"Mr (\w+) (\w+) and (\w+) went[.] (\w+), John-Boy, John Brown and Johnny stay[.]", got[0])
    assert m[1] == m[3] == m[4] != "John" and m[2] != "Smith" and got[2] == "John went"
    m = re.fullmatch(r"10[.]0[.]0[.]256 and (\S+) and (\S+)", got[1])
    assert m and m[1] != "10.0.0.25" and m[2] != "255.255.255.0"


def test_surrogates_are_keyed_and_keep_country_codes(spark):
    texts = ["jo@gmail.com and al@gmail.com", "+49 30 901820 00 or +1 (017) 555-7713 or +380 44 123 45 67"]
    a, b = replaced(spark, texts, "one"), replaced(spark, texts, b"two")
    hosts = [re.findall(r"@(\S+)", x[0]) for x in (a, b)]
    assert hosts[0][0] == hosts[0][1] and hosts[1][0] == hosts[1][1] and hosts[0][0] != hosts[1][0]
    for x in (a, b):
        assert re.fullmatch(r"\+49 \d\d \d{6} \d\d or \+1 \(\d{3}\) \d{3}-\d{4} or \+380 \d\d \d{3} \d\d \d\d", x[1]) and x[1] != texts[1]
    df = surrogates.surrogates(surrogates.parts(surrogates.entities(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"))), "very secret words")
    assert "very secret words" not in df._jdf.queryExecution().toString()


def test_surrogate_hmac_is_the_known_one(spark):
    import hmac

    k = surrogates._keys(b"some key", 1)[0]
    df = spark.createDataFrame([(*k, "a message")], "attempt int, inner binary, outer binary, m string")
    assert df.select(surrogates._hmac(F.col("m"))).first()[0] == hmac.new(b"some key", b"a message", "sha512").hexdigest()


def test_surrogate_collisions_are_made_again(spark):
    rows = [(i, " ".join(f"Herr {chr(65 + i % 26)}{chr(97 + j % 26)}{chr(97 + i)}x" for j in range(26))) for i in range(26)]
    made = surrogates.surrogates(surrogates.parts(surrogates.entities(spark.createDataFrame(rows, "doc_id long, text string"))), "k").collect()
    assert len({r["surrogate"] for r in made}) == len(made) == 676


def test_kd_shards(docs, empty):
    rows = kd_shards.kd_shards(docs, n_shards=5).collect()
    assert len(rows) == len(corpus())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    small = [r for r in rows if r["size"] < 5000]
    assert kd_shards.kd_shards(empty, n_shards=4).count() == 0 and len(small) == len(rows) - 1
    even = kd_shards.kd_shards(docs.where("length(text) < 5000"), n_shards=4).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in even]
    assert max(sizes) - min(sizes) <= 3000


def test_weak_labels(spark, docs, empty):
    r = random.Random(5)
    good = [" ".join(r.choice(["the", "of", "and", "river", "stone", "light", "walking"]) for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(r.choice(["RIVER!!", "STONE!!", "LIGHT!!", "THE!!"]) for _ in range(80)) for _ in range(30)] + [" | ".join(r.choice(["a$$$", "b***"]) for _ in range(80)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {x["doc_id"]: x["kept"] for x in weak_labels.classify(d, sample_size=120).collect()}
    assert all(got[i] for i in range(150)) and sum(got[i] for i in range(150, 210)) <= 3
    rows = weak_labels.classify(docs).collect()
    assert len(rows) == len(corpus()) and all(x["kept"] is False for x in rows if x["doc_id"] is not None and not words(corpus()[x["doc_id"]][1]))
    kept = weak_labels.keep_good(docs)
    assert kept.columns == docs.columns and weak_labels.classify(empty).count() == 0


def test_pieces(docs, empty):
    model = piece_fst.read_model(docs, PIECES)
    tokens = piece_fst.encode(docs, model, with_ids=True)
    rows = tokens.collect()
    assert len(rows) == len(corpus()) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = sorted(((r["doc_id"], r["text"]) for r in piece_fst.decode(tokens, model).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, *_ in corpus()), key=repr)
    f = piece_fst.PieceTransducer(model)
    for t in ("", " ", "a  b\n c", "é漢字▁x", "ab" * 40):
        assert f.decode(memoryview(f.encode(t)).cast("i")) == t.replace("▁", " ")
    assert piece_fst.encode(empty, model).count() == 0 and piece_fst.decode(piece_fst.encode(empty, model, True), model).count() == 0


def message(*fields):
    """A protocol buffer message of (number, value) fields."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            size, n = b"", len(value)
            while n > 127:
                size, n = size + bytes([n & 127 | 128]), n >> 7
            out += bytes([number << 3 | 2]) + size + bytes([n]) + value
    return out


def unigram_model(pieces, charsmap=b"", squeeze=1, byte_pieces=False):
    """A model file with the pieces {text: score}; a score of None makes a user-defined piece."""
    rows = [message((1, message((1, b"<unk>"), (2, 0.0), (3, 2)))), message((1, message((1, b"<s>"), (2, 0.0), (3, 3))))]
    if byte_pieces:
        rows += [message((1, message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6)))) for b in range(256)]
    rows += [message((1, message((1, p.encode()), (2, s or 0.0), (3, 4 if s is None else 1)))) for p, s in pieces.items()]
    return b"".join(rows) + message((2, message((3, 1)))) + message((3, message((1, b"own"), (2, charsmap), (3, 1), (4, squeeze), (5, 1))))


def test_paths_are_the_cheapest_of_all(docs):
    r = random.Random(4)
    for _ in range(30):
        alphabet = "abc"
        pieces = {"▁": -3.0} | {c: -4.0 - r.random() for c in alphabet[: r.randint(1, 3)]}
        for _ in range(8):
            pieces["".join(r.choice(alphabet) for _ in range(r.randint(2, 4)))] = -r.random() * 9
        f = piece_fst.PieceTransducer(unigram_model(pieces, byte_pieces=True))
        scores = {p: -struct.unpack("<f", struct.pack("<f", s))[0] for p, s in pieces.items()}
        worst = max(scores.values()) + 10
        for _ in range(5):
            chain = "▁" + "".join(r.choice(alphabet + "z") for _ in range(r.randint(0, 9)))

            def cost(rest):
                if not rest:
                    return 0.0
                ways = [scores[rest[:k]] + cost(rest[k:]) for k in range(1, 5) if rest[:k] in scores and k <= len(rest)]
                return min(ways + ([] if rest[0] in scores else [worst + cost(rest[1:])]))

            spelled = sum(scores[f.text[k].decode().replace(" ", "▁")] if k > 257 else worst for k in f.path(chain))
            assert spelled == pytest.approx(cost(chain))


def test_unigram_models_give_the_ids_of_the_library():
    sp = pytest.importorskip("sentencepiece")
    try:
        rules = sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        charsmap = dict(piece_fst._fields(dict(piece_fst._fields(rules))[3]))[2]
    except (AttributeError, KeyError, TypeError):
        charsmap = b""
    r = random.Random(6)
    pieces = {"▁": -2.0, "▁the": -3.1, "the": -3.5, "he": -4.2, "t": -5.0, "h": -5.1, "e": -5.2, "▁a": -3.3, "a": -4.9, "fi": -6.5, "▁▁": -7.0, "<sep>": None, "1": -6.1, "12": -7.7}
    for settings in ({"squeeze": 0}, {"squeeze": 1}, {"squeeze": 1, "charsmap": charsmap}):
        model = unigram_model(pieces, **settings)
        f, lib = piece_fst.PieceTransducer(model), sp.SentencePieceProcessor(model_proto=model)
        texts = ["the a", "  the   he ", "ﬁ the\tA １２", "x<sep>the", "zz the z", "", " "] + ["".join(r.choice("the a1２ﬁz ") for _ in range(12)) for _ in range(60)]
        for t in texts:
            ids = memoryview(f.encode(t)).cast("i").tolist()
            assert ids == lib.encode(t), (t, settings.keys())
            assert f.decode(ids) == lib.decode(ids)


def shingles(t):
    w = words((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, empty):
    rows = [(i, shingles(t)) for i, t, *_ in corpus()]
    root = {i: i for i, _ in rows if i is not None}
    for _ in range(4):
        for i, a in rows:
            for j, b in rows:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs).collect()), key=repr)
    assert got == sorted(((i, len(s), root.get(i)) for i, s in rows), key=repr)
    assert jaccard_join.similar_components(empty).count() == 0


def test_jaccard_bitmap_follows_the_shared_shingles(docs, monkeypatch):
    """A small table sends the driver a small bitmap of shared shingles, and a crowded bitmap loses no link."""
    sizes, marks = [], jaccard_join._marks
    monkeypatch.setattr(jaccard_join, "_marks", lambda slots, n_bits: sizes.append(len(out := marks(slots, n_bits))) or out)
    run = lambda: sorted((tuple(r) for r in jaccard_join.similar_components(docs).collect()), key=repr)
    whole = run()
    assert max(sizes) <= 1 << 17
    monkeypatch.setattr(jaccard_join, "_mark_bits", lambda n: 7)
    assert run() == whole and 16 in sizes
    monkeypatch.undo()
    assert [jaccard_join._mark_bits(n) for n in (0, 1 << 15, 1 << 20, 1 << 30)] == [16, 21, 26, 27]


def test_jaccard_groups_are_by_size_band_and_pairs_of_blocks():
    n = 3000
    ids, size = np.arange(n), np.random.default_rng(6).integers(1, 400, n)
    which, group = jaccard_join._cells(np.full(n, 99, np.uint64), ids, size, np.full(n, 5))
    met = np.zeros((n, n), bool)
    largest = 0
    for g in np.unique(group):
        own = which[group == g]
        met[np.ix_(own, own)] = True
        largest = max(largest, len(own))
    near = (4 * size[:, None] >= 3 * size) & (4 * size >= 3 * size[:, None])
    assert met[near].all() and largest <= n / 4


def test_jaccard_hot_shingles(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:12] + [f"x{r.random()}" for _ in range(r.randint(2, 40))]) for _ in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(1, 2)):
            w[r.randrange(60)] = f"y{r.random()}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    root = list(range(120))
    for _ in range(5):
        for i in range(120):
            for j in range(120):
                if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = jaccard_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot_entries=4).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == list(enumerate(root))


def crowd_texts():
    """A passage changed in four places or, in a few texts, one: most of the first resemble each other by 0.61 only; some share an id."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(240):
        w = list(base)
        for at in r.sample(range(3, 147, 7), 4 if i % 40 else 1):
            w[at] = f"x{i}-{at}"
        out.append((i if i % 20 else 5, " ".join(w)))
    return out


def test_jaccard_crowd_does_not_leave_its_tile_in_pairs(spark, monkeypatch):
    texts, counts, write = crowd_texts(), {}, jaccard_join.table

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.distinct().count()
        return out

    monkeypatch.setattr(jaccard_join, "table", counted)
    none = lambda sets, *_: sets.sparkSession.createDataFrame([], "node long, component long")
    monkeypatch.setattr(jaccard_join, "_stars", none)  # so that tiles find all links
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_join.similar_components(docs).select("doc_id", "component_id").collect())
    sets = [(i, shingles(t)) for i, t in texts]
    root = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets if 4 * len(a & b) >= 3 * len(a | b)]
    for _ in range(6):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert got == sorted((i, root[i]) for i, _ in texts) and len(set(root.values())) > 1
    assert len({(i, j) for i, j in links if i < j}) <= counts["pairs"] < 4000  # 240 texts make 28 680 pairs


def test_jaccard_bitmaps_of_an_id_with_two_texts_are_not_used():
    ids, words = np.array([7, 3, 7, 3, 9]), np.array([[1, 0], [2, 0], [1, 0], [2, 5], [4, 4]], np.uint64)
    own, bits = jaccard_join._told_once(ids, words)
    assert own.tolist() == [7, 9] and bits.tolist() == [[1, 0], [4, 4]]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    made, write = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name: made.append(name) or write(df, name))
    of = lambda edges: {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert of([(9, 1), (1, 8), (5, 4), (4, 4)]) == {1: 1, 8: 1, 9: 1, 4: 4, 5: 4} and made == ["edges"]
    assert of([(i, i + 1) for i in range(40)] + [(60, 50), (60, 55)]) == dict.fromkeys(range(41), 0) | dict.fromkeys((50, 55, 60), 50)
    assert of([(3, 3)]) == {}


def test_mixing(docs, empty):
    rows, again = (sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr) for _ in range(2))
    assert rows == again and len(rows) == len(corpus())
    size = collections.Counter()
    for i, t, _, source, *_ in corpus():
        size[source] += len(words(t))
    taken, target = collections.Counter(), {}
    for _, source, n, whole, goal, took in rows:
        assert whole == size[source] and 0 <= took <= 3 * n
        taken[source] += took
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 1 for s in target) and sum(target.values()) == pytest.approx(sum(size.values()))
    quotas = {r["source"]: (r["block_words"], r["quotas"]) for r in mixing.mix(docs).collect()}
    for s, (block, own) in quotas.items():  # each shard's share of a source is its quota to a block or two
        assert len(own) == 16 and abs(sum(own) * block - taken[s]) <= 2 * block and max(own) - min(own) <= 2
    assert mixing.mix(empty).count() == 0
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2] and mixing.water_fill([100, 1, 1], [1, 1, 1], 3) == [96.0, 3.0, 3.0]


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = got[i]
        assert i is None or (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert not at or (g["first_word"], g["last_word"]) == (min(at)[0], max(at)[0])
    assert license_scan.scan(empty).count() == 0


def test_inexact_license_passage(spark):
    text = "x y Permission is hereby granted, free of any charge, to any person obtaining a copy of the software and associated documentation files z"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), coverage=0.4).first()
    assert (r["labels"], r["base_labels"], r["n_base"]) == ("mit", "", 0) and 0.4 <= r["score"] < 1


def test_edited_and_overlapping_licences(spark):
    from tankwise.llm.licences import LICENCES

    r = random.Random(3)
    mit, bsd = (LICENCES[x].split() for x in ("mit", "bsd-3"))
    edited = list(mit)
    for _ in range(4):  # insertions and deletions
        edited.insert(r.randrange(len(edited)), "really")
        del edited[r.randrange(len(edited))]
    prose = ["words", "of", "the", "software", "without", "any", "order", "and", "of", "this", "notice"]
    texts = {
        1: " ".join(edited), 2: " ".join(prose + bsd + prose + mit), 3: " ".join(mit[:70] + bsd[:60]), 4: LICENCES["gpl-3"], 5: LICENCES["lgpl-2.1"],
        6: " ".join(r.sample(mit, len(mit))), 7: " ".join(x for i in range(0, len(mit), 10) for x in reversed(mit[i : i + 10])), 8: " ".join(" ".join(mit[i : i + 5]) + " and so on and on and on" for i in range(0, 160, 5)),
        9: "GNU General Public License, version 2 or CC BY NC", 10: " ".join(prose * 30),
    }
    got = {x["doc_id"]: (x["labels"], x["base_labels"], x["score"]) for x in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1][0] == "mit" and 0.8 <= got[1][2] < 1
    assert got[2][0] == "bsd-3,mit" and got[3][0] == "bsd-2,bsd-3,mit"  # the first 60 words do not tell the two BSD licences apart
    assert got[4][0] == "gpl-3" and got[5][0] == "lgpl-2.1"
    assert [got[i][0] for i in (6, 7, 8, 10)] == [""] * 4  # order and drift are checked
    assert got[9][:2] == ("cc-by-nc,gpl-2", "cc-by-nc")


def test_line_dedup(docs, empty):
    hold = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t, *_ in corpus():
        if i is not None:
            for x in (t or "").split("\n"):
                hold[key(x)].add(i)
    want = []
    for i, t, *_ in corpus():
        x = (t or "").split("\n")
        kept = [y for y in x if i is None or len(key(y)) < 40 or len(hold[key(y)]) < 5 or max(hold[key(y)]) == i]
        want.append((i, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    out = line_dedup.dedup_lines(docs)
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 6
    assert line_dedup.dedup_lines(empty).count() == 0


def test_copies_that_resemble_only_an_original_that_is_no_hub(spark):
    """40 copies of document 25, each with other words changed, so that no two copies are similar; the smallest id is a copy."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(41):
        w = list(base)
        if i != 25:
            for at in r.sample(range(5, 195), 5):
                w[at] = f"x{i}_{at}"
        texts[i] = " ".join(w)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in texts.items()}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert all(like(25, i) for i in texts) and sum(like(a, b) for a in texts for b in texts if a < b != 25 != a) < 100
    docs = spark.createDataFrame([*texts.items(), (99, "something else altogether in five words")], "doc_id long, text string")
    got = {row.doc_id: row.component_id for row in jaccard_join.similar_components(docs).collect()}
    assert got == dict.fromkeys(texts, 0) | {99: 99}
    assert jaccard_join.similar_components(docs.limit(0)).count() == 0


def test_bpe_ids_are_those_of_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = sp.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: list(r.ids) for r in piece_fst.encode(docs, piece_fst.read_model(docs, PIECES), with_ids=True).collect()}
    assert len(got) == 200 and all(got[r.doc_id] == lib.encode(r.text or "") for r in docs.collect())
    r = random.Random(9)
    model = open(PIECES, "rb").read()
    f = piece_fst.PieceTransducer(model)
    for t in ["a" * 3000, "▁x", "日本語 𝔘𝔫𝔦", "<s> </s> <unk> <0x41>", "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000))]:
        assert memoryview(f.encode(t)).cast("i").tolist() == lib.encode(t)


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_merges_with_unused_and_user_defined_pieces_are_those_of_the_library(byte_pieces):
    sp = pytest.importorskip("sentencepiece")
    r = random.Random(10)
    for _ in range(15):
        rows = [message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))))]
        if byte_pieces:
            rows += [message((1, message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6)))) for b in range(256)]
        pieces = list(dict.fromkeys(["".join(r.choice("abc▁") for _ in range(r.randint(2, 4))) for _ in range(25)] + list("ab▁")))
        kinds = {p: 4 if p == "ab▁c" else 5 if len(p) > 1 and r.random() < 0.3 else 1 for p in pieces}
        rows += [message((1, message((1, p.encode()), (2, -float(i)), (3, kinds[p])))) for i, p in enumerate(pieces)]
        kind = message((3, 2)) + b"\x98\x02\x01" * byte_pieces  # a BPE model; field 35 has a tag of two bytes
        model = b"".join(rows) + message((2, kind)) + message((3, message((1, b"own"), (2, b""), (3, 1), (4, 1), (5, 1))))
        f, lib = piece_fst.PieceTransducer(model), sp.SentencePieceProcessor(model_proto=model)
        for _ in range(20):
            t = "".join(r.choice("abcz ") for _ in range(r.randint(0, 14)))
            assert memoryview(f.encode(t)).cast("i").tolist() == lib.encode(t), (t, pieces, kinds)


def test_planted_links_are_found_by_the_registered_query(spark, tmp_path):
    """4000 vectors of three labels: pairs, chains, groups of up to 300 at the edge of the threshold, and noise; recall by vector."""
    from tankwise.llm import queries

    r = np.random.default_rng(21)
    rows, sizes = [], [2] * 150 + [7] * 60 + [40] * 12 + [300]
    for g, n in enumerate(sizes):
        centre, spread = r.normal(size=64), r.uniform(0.12, 0.27)
        rows += [(v, g % 3) for v in centre + spread * r.normal(size=(n, 64))]
    for g in range(20):  # chains: each link alone joins its ends
        v = r.normal(size=64)
        for _ in range(12):
            v = v / np.linalg.norm(v)
            rows.append((v, g % 3))
            v = v + 0.043 * r.normal(size=64)
    rows += [(v, i % 3) for i, v in enumerate(r.normal(size=(4000 - len(rows), 64)))]
    order = r.permutation(len(rows))
    x, label = np.array([rows[i][0] for i in order], np.float32), np.array([rows[i][1] for i in order])
    table = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {row.vec_id: row for row in queries.op2_near_vectors(spark, str(tmp_path)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hit = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    linked = np.flatnonzero(want)
    assert len(linked) > 1000 and all(got[i].n_links <= want[i] for i in got)
    assert np.mean([got[i].n_links / want[i] for i in linked]) >= 0.95 and got[0].recall >= 0.95
    root = parts_of(len(x), np.argwhere(hit).tolist())
    assert np.mean([got[i].component_id == root[i] for i in linked]) >= 0.95 and all(got[i].component_id == i for i in range(len(x)) if not want[i])
