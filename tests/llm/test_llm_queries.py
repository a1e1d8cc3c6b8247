"""The registered queries: schemas, oracle SQL, and the pipeline's effects."""

import duckdb
import pytest

from tessera.llm import registry

NAMES = {n.split("_")[0]: n for n in registry.queries()}


def test_one_query_an_operator():
    assert sorted(NAMES, key=lambda x: int(x[2:])) == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        docs.write.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= n and docs.where("text is null").count() == 0
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
