"""Each stage of the pipeline against plain Python, on documents with clashing columns, nulls, repeated ids and repeated rows."""

import collections
import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tankwise.llm import mixing, piece_fst, weak_labels  # noqa: E402

EXTRA = ["k1", "k2", "row", "lines", "keep", "id", "copy", "copies", "share", "_k1", "_copies", "_one", "a", "b", "n_lines", "component_id", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LINE = "this very line of the text is in many of the documents"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words((t or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def rows():
    r = random.Random(2)
    often = ["the", "of", "and", "to", "in", "is", "was", "with"]
    names = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    say = lambda n: " ".join(r.choice(often) if r.random() < 0.4 else r.choice(names) for _ in range(n))
    base = say(80)
    texts = {i: say(r.randint(40, 120)) for i in range(40)}
    texts |= {i: say(30) + "\n" + LINE + "\n" + say(20) for i in range(40, 47)}
    near = base.split()
    near[3] = "changed"
    texts |= {50: base, 51: base, 52: " ".join(near), 60: None, 61: "", 62: "!!! $$$ ### ||| " * 20, 63: "LOUD! WORDS! " * 40, 70: say(3000)}
    out = [(i, t, "en", ["x", "y", None, "z"][i % 4], len(t or "")) for i, t in texts.items()]
    out += [(0, say(90), "en", "x", 0), (0, texts[0], "en", "x", 0), (5, texts[5], "en", "y", 7), (None, say(70), "en", "x", None), (None, base, "en", "x", None), (None, None, None, None, None)]
    return [(*x, *[f"{c} of {n}" for c in EXTRA]) for n, x in enumerate(out)]


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    seen = [docs.collect()]
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(seen[-1], SCHEMA), "")
        assert out.columns == docs.columns
        seen.append(out.collect())
    return seen, c.STAGES[-1][1](spark, spark.createDataFrame(seen[-1], SCHEMA), "").collect()


def counted(rows_, *skip):
    return collections.Counter(tuple(v for k, v in r.asDict().items() if k not in skip) for r in rows_)


def test_quality(spark, stages):
    (docs, kept, *_), _ = stages
    texts = spark.createDataFrame([(i, r.text) for i, r in enumerate(docs)], "doc_id long, text string")
    good = {r.doc_id for r in weak_labels.classify(texts).where("kept").collect()}
    assert counted(kept) == counted(r for i, r in enumerate(docs) if i in good)
    ids = {r.doc_id for r in kept}
    assert set(range(47)) <= ids and not {60, 61, 62, 63} & ids and None in ids


def test_lines(stages):
    (_, docs, after, *_), _ = stages
    hold = collections.defaultdict(set)
    for r in docs:
        for x in (r.text or "").split("\n") if r.doc_id is not None else ():
            hold[x.strip(" \t\n\x0b\x0c\r").lower()].add(r.doc_id)
    want = collections.Counter()
    for r in docs:
        keys = [(x, x.strip(" \t\n\x0b\x0c\r").lower()) for x in r.text.split("\n")]
        text = "\n".join(x for x, k in keys if r.doc_id is None or len(k) < 40 or len(hold[k]) < 5 or max(hold[k]) == r.doc_id)
        want[tuple((r.asDict() | {"text": text, "n_chars": len(text)}).values())] += 1
    assert counted(after) == want and sum(LINE in r.text for r in after) == 1


def test_near_duplicates(stages):
    (_, _, docs, after, *_), _ = stages
    sets = [shingles(r.text) for r in docs]
    root = list(range(len(docs)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    groups = collections.defaultdict(list)
    for i, r in enumerate(docs):
        groups[root[i]].append(r.doc_id)
    want = sorted((min((d is None, d or 0) for d in g) for g in groups.values()))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == want
    assert [sum(r.doc_id == i for r in after) for i in (0, 5, 50, 51, 52)] == [2, 1, 1, 0, 0]  # two texts of document 0 differ


def test_mix(spark, stages):
    (_, _, _, docs, after), _ = stages
    df = spark.createDataFrame(docs, SCHEMA)
    share = {(r.doc_id, r.source, r.size): r.taken / r.size for r in mixing.mix(df).where("size > 0").collect()}
    got = counted(after)
    for r in docs:
        n, s = got[tuple(r.asDict().values())], share[r.doc_id, r.source, len(words(r.text))]
        assert int(s) <= n <= int(s) + 1
    assert set(got) <= set(counted(docs))


def test_tokens(spark, stages):
    (*_, docs), out = stages
    from tankwise.llm.queries import PIECES

    fst = piece_fst.PieceTransducer(piece_fst.read_model(spark.range(1), PIECES))
    want = sorted(((r.doc_id is None, r.doc_id or 0, memoryview(fst.encode(r.text)).cast("i").tolist()) for r in docs))
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in out) == want and all(r.round_trip for r in out)


def test_run_is_the_stages_and_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline as c
    from tankwise.llm import common

    spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for module in (c, common):
        monkeypatch.setattr(module, "scratch_dir", lambda _: str(tmp_path / "scratch"))
    out = c.run(spark, str(tmp_path))
    assert out.count() > 30 and out.where("not round_trip").count() == 0
    assert ["-".join(p.name.split("-")[:2]) for p in (tmp_path / "scratch").iterdir()] == ["stage-mix"]


def test_empty_table(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in c.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)


@pytest.mark.parametrize("name", ["dedup_lines", "replace_entities"])
def test_operators_that_return_documents_keep_clashing_columns(spark, name):
    from tankwise.llm import line_dedup, surrogates

    docs = spark.createDataFrame(rows(), SCHEMA)
    out = line_dedup.dedup_lines(docs) if name == "dedup_lines" else surrogates.replace_entities(docs, "key")
    own = [c for c in docs.columns if c not in ("text", "n_lines")]
    assert counted(out.select(own).collect()) == counted(docs.select(own).collect()) and out.where(F.col("row").isNull()).count() == 0
