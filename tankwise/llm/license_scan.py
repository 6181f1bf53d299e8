"""License scans by diagonal voting.

All word k-grams of all documents are joined by hash to their positions in the templates (whole licence texts and notices: a
broadcast bounded by max_template_words). Matches of a document vote for diagonals, position less template position. Around
each diagonal its neighbours up to drift further on are merged, so added or missing words do not break a span, and since all
are measured from one diagonal the drift of a whole span is bounded. A span is then verified: its matches, compared as text, are
taken in the order of the template, each must lie behind the last in the document, and what remains must be enough k-grams
and reach the coverage of the stretch of the template that it has. A phrase or short mention must lie on one diagonal without a gap.

Templates may resemble each other (two versions of a notice): of spans that begin within a few words of each other only those
with the greatest number of k-grams times share count, equal ones all; a span that lies inside a longer one does not count.

Defined cases: a null text has no words; repeated rows are scanned once and each gets the result; a document without
doc_id is scanned like others; without a match labels are empty strings, places null and the score 0; other columns are not
looked at; texts of any length are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, row_key
from .licences import LICENCES, MENTIONS

#: Separators of words: ASCII but letters and digits, after lower-casing.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that count place by place.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
K = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def _templates(spark, phrases: dict[str, str], mentions: dict[str, str], licences: dict[str, str], max_words: int) -> DataFrame:
    """(template, label, base, exact, t_pos, t_gram, n_grams, t_hash): one row for each k-gram of each template."""
    texts = [(t, x, True, True) for t, x in phrases.items()] + [(t, x, False, True) for t, x in mentions.items()] + [(t, x, False, False) for x, t in licences.items()]
    rows = []
    for n, (text, label, base, exact) in enumerate(texts):
        w = _template_words(text)
        grams = [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]
        rows += [(n, label, base, exact, i, g, len(grams)) for i, g in enumerate(grams)]
    if len(rows) > max_words:
        raise ValueError("templates are too long to broadcast")
    schema = "template int, label string, base boolean, exact boolean, t_pos int, t_gram string, n_grams int"
    return F.broadcast(spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("t_gram")))


def spans(keyed: DataFrame, templates: DataFrame, coverage: float, drift: int, passage: int) -> DataFrame:
    """(k1, k2, template, label, base, start, last, share): verified places of templates in keyed (k1, k2, words)."""
    own = F.transform("words", lambda w, i: F.concat_ws(" ", w, *[F.get("words", i + j) for j in range(1, K)]))
    grams = keyed.select("k1", "k2", F.posexplode(own).alias("pos", "gram"))
    hits = grams.withColumn("hash", F.xxhash64("gram")).join(templates, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    key = ["k1", "k2", "template", "label", "base", "exact", "n_grams"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("t_pos")).cast("long").alias("diagonal")).agg(F.sort_array(F.collect_set("t_pos")).alias("votes"))
    # a diagonal of a short template needs all votes alone; the others gather those of the drift diagonals after them
    near = "collect_list(struct(diagonal, votes)) over (partition by k1, k2, template order by diagonal range between current row and {n} following)"
    merged = votes.selectExpr("*", f"if(exact, array(struct(diagonal, votes)), {near.format(n=drift)}) as cluster")
    # a whole short template, or enough of it for a passage
    need = F.when(F.col("exact"), F.col("n_grams")).otherwise(F.least(F.ceil(coverage * F.col("n_grams")), F.lit(passage)))
    merged = merged.withColumn("need", need).where(F.aggregate("cluster", F.lit(0), lambda a, c: a + F.size(c["votes"])) >= F.col("need"))
    # in the order of the template, then of the text: one place for each template position, behind the place before
    flat = F.expr("array_sort(flatten(transform(cluster, c -> transform(c.votes, t -> struct(t as t, t + c.diagonal as p)))))")
    none = F.lit(-1).cast("long")
    start = F.struct(F.lit(-1).alias("t"), none.alias("p"), F.lit(0).alias("n"), F.lit(-1).alias("t0"), none.alias("p0"))

    def take(a: Column, x: Column) -> Column:
        first = a["n"] == 0
        after = F.struct(x["t"].alias("t"), x["p"].alias("p"), (a["n"] + 1).alias("n"), F.when(first, x["t"]).otherwise(a["t0"]).alias("t0"), F.when(first, x["p"]).otherwise(a["p0"]).alias("p0"))
        return F.when((x["t"] > a["t"]) & (x["p"] > a["p"]), after).otherwise(a)

    taken = merged.withColumn("v", F.aggregate(flat, start, take)).withColumn("share", F.col("v.n") / (F.col("v.t") - F.col("v.t0") + 1))
    fine = taken.where((F.col("v.n") >= F.col("need")) & (F.col("share") >= coverage))
    fine = fine.select("k1", "k2", "template", "label", "base", "exact", F.col("v.p0").alias("start"), (F.col("v.p") + K - 1).alias("last"), "share", (F.col("v.n") * F.col("share")).alias("strength"))
    strongest = "max(if(exact, 0, strength)) over (partition by k1, k2 order by start range between 12 preceding and 12 following)"
    earlier = "max(if(exact, null, last)) over (partition by k1, k2 order by start range between unbounded preceding and 1 preceding)"
    longer = "max(if(exact, null, last)) over (partition by k1, k2, start)"
    ranked = fine.selectExpr("*", f"{strongest} as best", f"coalesce({earlier} >= last or {longer} > last, false) as inside")
    return ranked.where("exact or (strength = best and not inside)").drop("best", "inside", "strength", "exact").distinct()


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, licences: dict[str, str] | None = None, mentions: dict[str, str] | None = None, coverage: float = 0.6, drift: int = 8, passage: int = 12, max_template_words: int = 1_000_000) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    coverage: least share of the k-grams in the stretch of a licence that a span has; drift: words that a span may gain or lose
    against its template; passage: k-grams that make a passage of a longer licence count.
    """
    given = (PHRASES if phrases is None else phrases, MENTIONS if mentions is None else mentions, LICENCES if licences is None else licences)
    templates = _templates(docs.sparkSession, *given, max_template_words)
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), words(F.col("text")).alias("words"))
    is_base = lambda c: F.when(F.col("base"), F.col(c))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans(keyed, templates, coverage, drift, passage).groupBy("k1", "k2").agg(
        F.count(is_base("start")).alias("n_base"), F.min(is_base("start")).alias("first_word"), F.max(is_base("start")).alias("last_word"),
        names(is_base("label")).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    out = keyed.select("k1", "k2", "doc_id", F.size("words").cast("long").alias("n_words")).join(found, ["k1", "k2"], "left")
    return out.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
