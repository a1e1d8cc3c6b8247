"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, sf_dir, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(x == y or all(p == q or (p[:1].isdigit() and q[:1].isdigit() and math.isclose(float(p), float(q), abs_tol=2e-6)) for p, q in zip(x, y)) for x, y in zip(a, b))


def test_gate_reasons_equal_sql_on_odd_texts(spark, tmp_path):
    """Texts that the tables do not hold: null, empty, other languages, characters unknown to the JVM, letters that fold to more than their lower case."""
    long = "the gate reads whole texts and tells each row apart by words of many kinds " * 4
    texts = [
        (None, "en"), ("", "en"), (" \n\t", "fr"), ("short", None), (long, "ru"), (long, "ja"), (long, "zh"), ("где живёт зелёный слон " * 9, "EN"), ("где живёт зелёный слон " * 9, "en"),
        (long + "\U0001fae8\ufdd0", "en"), ("ab " * 60 + "\u0378" * 9, "de"), (long + "\u200b\ue000\x07", "en"), (" ".join(["ς", "σ", "Σ", "ſ", "s", "ΑΣ", "ας", "ασ"] * 8), "en"),
        (" ".join(["İ", "i", "ß", "ss", "ẞ", "ΟΔΟΣ", "οδοσ", "οδος"] * 6), "es"), (long + "é" * 20, "en"), ("<p>" * 99 + long, "en"), ("z" * 200_001, "en"),
    ]
    docs = [(i, t, lang, "src0") for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    queries, sql = registry.queries(), registry.oracle_sql()
    by_text = queries["doc_quality_reasons"](spark, str(tmp_path)).select("doc_id", "reasons", "accepted")
    assert sorted(map(tuple, by_text.collect())) == sorted(con.sql(f"SELECT doc_id, reasons, accepted FROM ({sql['doc_quality_reasons']})").fetchall())
    assert sorted(map(tuple, queries["quality_reason_counts"](spark, str(tmp_path)).collect())) == sorted(con.sql(sql["quality_reason_counts"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
