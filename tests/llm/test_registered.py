"""The registered queries on a small table: SQL where there is some, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import rows_of_spark, rows_of_sql  # noqa: E402

from tankwise.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert rows_of_spark(df) == rows_of_sql(SF, queries.oracle_sql()[name], df.columns)


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r[0] for r in docs.select("doc_id").collect()]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        now = [r[0] for r in out.select("doc_id").collect()]
        assert set(now) <= set(ids) and (name == "mix" or len(now) == len(set(now)))
        if name == "lines":
            assert sorted(now) == sorted(ids)
        docs, ids = spark.createDataFrame(out.collect(), out.schema), now
    assert all(r["round_trip"] for r in c.STAGES[-1][1](spark, docs, SF).collect())
    assert c.run(spark, SF).count() == len(ids)
