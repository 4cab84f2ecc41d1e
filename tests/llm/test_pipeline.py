"""The pipeline's stages on a small corpus, and every registered query on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tideline.llm import registry
from tideline.llm.common import written
from tideline.runtime import ship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_take_effect(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == list(corpus_pipeline.COLUMNS)
        docs = written(new, "test-stage")
        kept.append(docs.count())
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "pieces"]
    assert kept[0] > kept[1] >= kept[2] > kept[3] >= kept[4] > 0.5 * kept[0]
    # Equal texts stay once.
    assert docs.select("text").distinct().count() == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert last.filter("not round_trip").count() == 0


def test_run_equals_its_stages(spark):
    rows = registry.queries()["pipeline"](spark, SF)
    assert rows.count() > 0 and "doc_id" in rows.columns


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n != "pipeline"))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_sql_twins(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF).toPandas()
        want = con.execute(sql).df()
        cols = sorted(got.columns)
        rows = lambda df: sorted(tuple(None if v != v else v for v in r) for r in df[cols].astype(object).itertuples(index=False)) if False else sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
        assert cols == sorted(want.columns) and rows(got) == rows(want)
