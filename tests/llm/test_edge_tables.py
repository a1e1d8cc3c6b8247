"""Every operator's query on tables with nulls, a very long text, ties, repeats and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry

CLASHING = "d h n no k t own kept score key regs bands text_hash piece start length offset side canon added c0 c1 __d __id __n __own __lines __gone __removed __score sequence_id component_id fingerprint n_words DOC".split()


def _tables(spark, folder):
    long = " ".join(f"w{i % 997} the{i}" for i in range(20_000)) + "\n" + "x" * 50_000 + " " * 5_000 + "é" * 20_000
    texts = [None, "", "   \n\n ", long, "a b c d e f g h i j k\n" * 3, "You are an idiot and a moron.", "plain words of a clean text that nobody minds at all, I think"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(9, texts[4], None, None, None), (9, texts[4], None, None, None), (None, texts[6], "en", "src1", 3), (None, None, None, None, None), (10, long, "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, "good", i % 2) for i in range(12)] + [(None, None, None), (5, None, 1)], "doc_id long, quality string, toxic int")
    conv = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "x"), (None, None, "user", long), (None, 1, "assistant", "ok</turn>")]
    conv = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    items = [(0, "plain words of a text"), (0, "plain words of a text"), (0, "idiot"), (1, None), (2, ""), (None, "the text"), (3, long), (4, "unknownword")]
    items = spark.createDataFrame(items, "item_id long, text string")
    made = {}
    for name, extra in (("plain", []), ("clash", CLASHING)):
        made[name] = f"{folder}/{name}"
        for table, df in (("documents", docs), ("labels", labels), ("conversations", conv), ("benchmark", items)):
            df.select(*df.columns, *(F.lit(f"{c}!").alias(c) for c in extra)).coalesce(1).write.parquet(f"{made[name]}/{table}.parquet")
        made[f"empty {name}"] = f"{folder}/empty-{name}"
        for table in ("documents", "labels", "conversations", "benchmark"):
            spark.read.parquet(f"{made[name]}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{made[f'empty {name}']}/{table}.parquet")
    return made


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return _tables(spark, f"file://{tmp_path_factory.mktemp('edge')}")


#: Columns that hold any numbers by contract or depend on measured times.
FREE = {"op3": ["sequence_id", "offset"]}


@pytest.mark.parametrize("name", sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_other_columns_change_nothing(spark, tables, name):
    def result(which):
        df = registry.queries()[name](spark, tables[which])
        return df.columns, sorted(map(str, df.drop(*FREE.get(name.split("_")[0], [])).collect()))

    plain = result("plain")
    assert plain[1] and plain == result("clash")
    if name.split("_")[0] not in ("op3", "op6", "op7", "op11", "op13"):
        assert len(plain[1]) == spark.read.parquet(f"{tables['plain']}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_empty_tables_by_query(spark, tables, name):
    n = 1 if name.startswith("op7") else 0  # conversation -1 is always there
    assert registry.queries()[name](spark, tables["empty clash"]).count() == n
