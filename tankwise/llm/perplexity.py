"""Quality rules and n-gram perplexity bands.

A modified Kneser-Ney model for each language, over the UTF-8 bytes of whole texts (order 5, one space between words, so a
word's first bytes are scored after the end of the word before). Base rules come first; documents that pass them are dealt to
two folds by the least hash of their three-word windows, and each is scored by the model of the other fold, so no document
judges itself, nor do its copies and most of its near copies. Where that puts all documents of a (small) language into one
fold, it deals them by the first bit of the texts' hashes in which they differ. Spark counts n-grams of all these documents
by fold, derives continuation counts, discounts and interpolated probabilities with joins on integer keys, for every n-gram
that occurs in the language (an n-gram that the other fold lacks gets the probability of its suffix), and the model is kept
as sorted arrays of keys, the five bytes in 64 bits, with logarithms in whole millionths: sums are of integers, so they are
the same in whatever order and by whichever path they are made.
A document is rejected when its log perplexity leaves the band of its language: three robust standard deviations on each
side of the median (the three-sigma rule), a side's deviation being 1.4826 times the median distance of the documents on
that side. Equal scores count once.

Defined cases: a null text has no words and fails the base rules; documents that fail them have no perplexity; null and
empty lang are one language; a language that has one different text only has no other fold, all its documents score alike and
stay (neither side of a band is narrower than min_width, which only matters for texts nearly all alike); repeated rows are
scored alike; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, table
from .wordhash import grams, mix64, words

ORDER = 5
_U = np.uint64
MASK = {n: (1 << 8 * n) - 1 for n in range(ORDER + 1)}
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text whose windows are held at once.
HELD = 1 << 21
#: Entries of sums that a task holds before it sends them on.
HELD_KEYS = 4_000_000
FOLDS = (0, 1)
#: Logarithms are kept in units of 1 / SCALE.
SCALE = 1_000_000


def pieces(text: bytes) -> list[bytes]:
    """text with one space between words and one at its end, cut into pieces that each begin with the bytes before them."""
    text = b" " * (ORDER - 1) + b" ".join([*text.split(), b""])
    return [text[a : a + HELD + ORDER - 1] for a in range(0, len(text) - ORDER + 1, HELD)]


def text_keys(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """5-byte windows that end at each byte of each piece, across the words; and the piece of each."""
    data = np.frombuffer(b"".join(found), np.uint8).astype(_U)
    keys = np.zeros(max(0, len(data) - ORDER + 1), _U)
    for j in range(ORDER):
        keys = (keys << _U(8)) | data[j : j + len(keys)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    piece = np.repeat(np.arange(len(found)), sizes)[: len(keys)]
    inside = np.arange(len(keys)) + ORDER <= np.cumsum(sizes)[piece]
    return keys[inside], piece[inside]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n[order], at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, c0, c1): 5-byte windows of passing texts with their counts by fold, added up by HELD_KEYS at a time."""
    held: dict[tuple[str, int], list[bytes]] = {}
    sums: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    many = 0

    def flush() -> None:
        for group, found in held.items():
            parts = sums.setdefault(group, [])
            parts.append(np.unique(text_keys(found)[0], return_counts=True))
            # later parts are merged into the first once they are as long together
            if sum(len(k) for k, _ in parts[1:]) >= len(parts[0][0]):
                parts[:] = [_merged(parts)]
        held.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, fold), parts in sums.items():
            keys, n = _merged(parts)
            for a in range(0, len(keys), 50_000):
                part, zero = slice(a, a + 50_000), np.zeros(len(keys[a : a + 50_000]), np.int64)
                c = (n[part], zero) if fold == 0 else (zero, n[part])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(zero), pa.string()), "key": pa.array(keys[part].astype(np.int64)), "c0": pa.array(c[0]), "c1": pa.array(c[1])})
        sums.clear()

    for batch in batches:
        for lang, text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), dealt(batch), strict=True):
            for piece in pieces((text or "").encode()) if fold is not None else ():
                held.setdefault((lang, fold), []).append(piece)
                many += len(piece)
                if many > HELD:
                    flush()
                    many = 0
        if sum(len(k) for parts in sums.values() for k, _ in parts) > HELD_KEYS:
            yield from out()
    flush()
    yield from out()


_COUNTS = "lang string, key long, c0 long, c1 long"
_DEALT = ("lang", "text", "h", "bit")


def _counted(docs: DataFrame) -> DataFrame:
    found = docs.select(*_DEALT).mapInArrow(_count, _COUNTS)
    return found.groupBy("lang", "key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h) of the texts that pass the base rules."""
    for batch in batches:
        keep = pa.array([f is not None for f in folds_of(batch.column(1))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], ["lang", "h"])


def counted(docs: DataFrame, max_langs: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, lang, text) with h and bit, by which dealt() deals them to folds, and the counts of their n-grams.

    bit is null but for languages that the least window hashes put into one fold: there it is the first bit of the texts' hashes
    that is not the same for all.
    """
    docs = docs.select("*", F.xxhash64("text").alias("h"))
    counts = table(_counted(docs.withColumn("bit", F.lit(None).cast("int"))), "ngrams")
    alone = table(counts.groupBy("lang").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where("c0 = 0 or c1 = 0").select("lang"), "alone")
    n = alone.count()
    if not n:
        return docs.withColumn("bit", F.lit(None).cast("int")), counts
    few = F.broadcast(alone) if n <= max_langs else alone
    own = docs.join(few, "lang", "left_semi")
    differ = own.select("lang", "text", "h").mapInArrow(_passing, "lang string, h long").groupBy("lang").agg(F.bit_or("h").alias("any"), F.bit_and("h").alias("all"))
    x = F.col("any").bitwiseXOR(F.col("all"))
    lowest = F.bit_count(x.bitwiseAND(-x) - 1).cast("int")
    bits = table(differ.where("any <> all").select("lang", lowest.alias("bit")), "bits")
    few = F.broadcast(bits) if n <= max_langs else bits
    docs = docs.join(few, "lang", "left")
    again = _counted(docs.where("bit is not null"))
    both = table(counts.join(few.select("lang"), "lang", "left_anti").unionByName(again), "ngrams")
    drop_tables(counts, alone)
    return docs, both


def train(ngrams: DataFrame) -> DataFrame:
    """The model as rows (lang, fold, key, logp): logarithms, in units of 1 / SCALE, of each 5-gram of fold under the counts of the
    other fold. ngrams: the counts of counted().
    """
    counts = {ORDER: ngrams}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit(MASK[n])).alias("key")
        counts[n] = table(counts[n + 1].groupBy("lang", suffix).agg(*[F.sum((F.col(f"c{f}") > 0).cast("long")).alias(f"c{f}") for f in FOLDS]), "ngrams")
    lower = None
    for n in range(1, ORDER + 1):
        of = counts[n].groupBy("lang").agg(*[F.sum((F.col(f"c{f}") == k).cast("double")).alias(f"n{f}{k}") for f in FOLDS for k in (1, 2, 3, 4)])
        x = counts[n].join(F.broadcast(of.select("lang", *[_discount(f, k).alias(f"d{f}{k}") for f in FOLDS for k in (1, 2, 3)])), "lang")
        for f in FOLDS:
            c, d = F.col(f"c{f}"), [F.col(f"d{f}{k}") for k in (1, 2, 3)]
            x = x.withColumn(f"cut{f}", F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
        x = x.withColumn("ctx", F.shiftright("key", 8))
        sums = [F.sum(f"{a}{f}").alias(f"{b}{f}") for f in FOLDS for a, b in (("c", "total"), ("cut", "left"))]
        x = x.join(x.groupBy("lang", "ctx").agg(*sums), ["lang", "ctx"])
        if n == 1:
            x = x.withColumns({f"below{f}": F.lit(1 / 256) for f in FOLDS})
        else:
            x = x.withColumn("suffix", F.col("key").bitwiseAND(F.lit(MASK[n - 1])))
            x = x.join(lower.select("lang", F.col("key").alias("suffix"), *[F.col(f"p{f}").alias(f"below{f}") for f in FOLDS]), ["lang", "suffix"])
        seen = lambda f: (F.col(f"c{f}") - F.col(f"cut{f}") + F.col(f"left{f}") * F.col(f"below{f}")) / F.col(f"total{f}")
        p = [F.when(F.col(f"total{f}") > 0, seen(f)).otherwise(F.col(f"below{f}")).alias(f"p{f}") for f in FOLDS]
        after = table(x.select("lang", "key", "c0", "c1", *p), "probabilities")
        drop_tables(counts[n], *([lower] if lower is not None else []))
        lower = after
    parts = [lower.where(f"c{f} > 0").select("lang", F.lit(f).alias("fold"), "key", F.round(F.log(f"p{1 - f}") * SCALE).cast("int").alias("logp")) for f in FOLDS]
    return parts[0].unionByName(parts[1])


def _discount(f: int, k: int) -> Column:
    """Of counts k in fold f (3: three and more), from the numbers n of n-grams with counts 1 to 4."""
    n = lambda i: F.col(f"n{f}{i}")
    y = F.try_divide(n(1), n(1) + 2 * n(2))
    d = k - (k + 1) * y * F.try_divide(n(k + 1), n(k))
    return F.when(d.isNull(), 0.5).otherwise(F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Model rows as (lang, fold, keys, logs): packed arrays of a batch."""
    for batch in batches:
        lang, fold, key, logp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        group = np.char.add(np.char.add(lang.astype(str), "|"), fold.astype(str))
        for g in np.unique(group):
            own = group == g
            row = {"lang": lang[own][0], "fold": int(fold[own][0]), "keys": key[own].tobytes(), "logs": logp[own].astype(np.int32).tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("keys", pa.binary()), ("logs", pa.binary())]))


class SortedModel:
    """For each language and fold the keys in order and their log probabilities, 12 bytes an entry."""

    def __init__(self, model: DataFrame) -> None:
        parts: dict[tuple[str, int], list] = {}
        for r in model.mapInArrow(_packed, "lang string, fold int, keys binary, logs binary").toArrow().to_pylist():
            parts.setdefault((r["lang"], r["fold"]), []).append((np.frombuffer(r["keys"], _U), np.frombuffer(r["logs"], np.int32)))
        self.tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        while parts:
            group, own = parts.popitem()
            keys, logs = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(keys)
            self.tables[group] = keys[order], logs[order]

    def texts(self, group: tuple[str, int], found: list[bytes]) -> np.ndarray:
        """Log probability of each piece in units of 1 / SCALE; doubles hold the sums of integers exactly."""
        keys, piece = text_keys(found)
        own, at = np.unique(keys, return_inverse=True)
        table_keys, logs = self.tables[group]
        return np.bincount(piece, weights=logs[np.searchsorted(table_keys, own)][at], minlength=len(found))


def _totals(model: SortedModel, groups: list[tuple[str, int]], texts: list[str | None]) -> list[float | None]:
    """Log probability of each text, None for a text without group."""
    out, held, many = [None if g is None else 0.0 for g in groups], {}, 0

    def flush() -> None:
        for group, own in held.items():
            rows, found = zip(*own, strict=True)
            for row, x in zip(rows, model.texts(group, list(found)).tolist(), strict=True):
                out[row] += x
        held.clear()

    for row, (group, text) in enumerate(zip(groups, texts, strict=True)):
        for piece in pieces(text.encode()) if group else ():
            held.setdefault(group, []).append((row, piece))
            many += len(piece)
            if many > HELD:
                flush()
                many = 0
    flush()
    return out


def windows(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words, those inside width-word windows that occur twice or more in it, and its least window hash."""
    n, out, least = (np.zeros(len(texts), t) for t in (np.int64, np.int64, _U))
    for w in words(texts):
        n[w.lo : w.hi] = np.diff(w.first)
        h, at = grams(w, width)
        if len(h):
            row = w.row[at]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least[w.lo + row[first]] = np.minimum.reduceat(h, first)
            _, inverse, times = np.unique(h ^ mix64(row.astype(_U)), return_inverse=True, return_counts=True)
            covered = np.zeros(len(w.hashes), bool)
            twice = at[times[inverse] > 1]
            for j in range(width):
                covered[twice + j] = True
            out[w.lo : w.hi] = np.bincount(w.row[covered], minlength=w.hi - w.lo)
    return n, out, least


def repeated(texts: pa.Array) -> np.ndarray:
    return windows(texts)[1]


def folds_of(texts: pa.Array) -> list[int | None]:
    """The fold of each text, by its least window hash, so that copies and most near copies share one; None if the base rules fail."""
    n, again, least = windows(texts)
    fails = (n < 50) | (100 * again > 50 * n)
    return [None if f else x for f, x in zip(fails.tolist(), (mix64(least) & _U(1)).tolist(), strict=True)]


def dealt(batch: pa.RecordBatch) -> list[int | None]:
    """The folds of rows with text, h and bit: by the bit of h where there is one."""
    h, bit = batch.column("h").to_pylist(), batch.column("bit").to_pylist()
    return [f if f is None or b is None else (x >> b) & 1 for f, x, b in zip(folds_of(batch.column("text")), h, bit, strict=True)]


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


_STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, logp double, n_bytes long"


def _stats(model):
    """Of (doc_id, lang, text, h, bit). model: a broadcast SortedModel, or None for the counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = (batch.column(i).to_pylist() for i in range(3))
            rows, groups = [], [None if f is None else (lang, f) for lang, f in zip(langs, dealt(batch), strict=True)]
            for doc_id, lang, text, again in zip(ids, langs, texts, repeated(batch.column(2)).tolist(), strict=True):
                text = text or ""
                own = text.encode().split()
                rows.append((doc_id, lang, len(own), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), again, sum(map(len, own)) + len(own)))
            if rows:
                totals = [None] * len(rows) if model is None else _totals(model.value, groups, texts)
                *columns, n_bytes = zip(*rows, strict=True)
                types = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns, totals, n_bytes), types, strict=True)], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "logp", "n_bytes"])

    return run


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _joined_scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Scores without a broadcast model, for models too large: each document's n-grams are joined with the model."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text, fold in zip(*[batch.column(i).to_pylist() for i in range(3)], dealt(batch), strict=True):
                for piece in pieces((text or "").encode()) if fold is not None else ():
                    keys, n = np.unique(text_keys([piece])[0], return_counts=True)
                    k = len(keys)
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row] * k, pa.int64()), "lang": pa.array([lang] * k, pa.string()), "fold": pa.array([fold] * k, pa.int32()), "key": pa.array(keys.astype(np.int64)), "m": pa.array(n)})

    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    grams = rows.select("row", *_DEALT).mapInArrow(own, "row long, lang string, fold int, key long, m long")
    sums = grams.join(model, ["lang", "fold", "key"]).groupBy("row").agg(F.sum(F.col("m") * F.col("logp")).alias("sum"))
    # the row's number takes the place of doc_id while the counts are made
    counts = rows.select(F.col("row").alias("doc_id"), *_DEALT).mapInArrow(_stats(None), _STATS).drop("logp").withColumnRenamed("doc_id", "row")
    return counts.join(sums, "row", "left").join(rows.select("row", "doc_id"), "row").withColumnRenamed("sum", "logp").drop("row")


def score(docs: DataFrame, width: float = 3.0, min_width: float = 0.02, max_model: int = 8_000_000, max_langs: int = 100_000) -> DataFrame:
    """Base counts, base_failed, log_ppl, the band (low, high) and kept for each row of docs (doc_id, lang, text).

    max_model: entries of the model up to which it is broadcast (12 bytes each); beyond, n-grams are joined, with the same
    result. max_langs: languages up to which the bands are broadcast.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    docs, ngrams = counted(docs, max_langs)
    model = train(ngrams)
    if model.count() <= max_model:
        sent = spark.sparkContext.broadcast(SortedModel(model))
        scored = docs.select("doc_id", *_DEALT).mapInArrow(_stats(sent), _STATS)
    else:
        scored = _joined_scores(docs, model)
    scored = scored.withColumn("base_failed", base_failed()).withColumn("log_ppl", F.try_divide(-F.col("logp") / SCALE, F.col("n_bytes")))
    scored = table(scored, "scored")
    # equal scores of a language, such as those of copies, count once
    own = scored.where("not base_failed and log_ppl is not null").select("lang", "log_ppl").distinct()
    bins = table(own.groupBy("lang", F.round(F.col("log_ppl") * 1000).cast("long").alias("bin")).count(), "bins")
    bands = _weighted_median(bins).withColumnRenamed("median", "m")
    for side, sign in (("low", -1), ("high", 1)):
        off = bins.join(bands.select("lang", "m"), "lang").select("lang", (sign * (F.col("bin") - F.col("m"))).alias("bin"), "count").where("bin >= 0")
        half = F.greatest(F.col("median") * 1.4826 * width / 1000, F.lit(min_width))
        bands = bands.join(_weighted_median(off), "lang").withColumn(side, F.col("m") / 1000 + sign * half).drop("median")
    bands = table(bands.select(F.col("lang").alias("band_lang"), "low", "high"), "bands")
    few = F.broadcast(bands) if bands.count() <= max_langs else bands
    out = scored.join(few, F.col("lang") == F.col("band_lang"), "left").drop("band_lang")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def _weighted_median(bins: DataFrame) -> DataFrame:
    """(lang, median) of bins with counts: the least bin with half of the count at or below it."""
    upto = bins.selectExpr("lang", "bin", "sum(count) over (partition by lang order by bin) as upto", "sum(count) over (partition by lang) as total")
    return upto.where("2 * upto >= total").groupBy("lang").agg(F.min("bin").alias("median"))
