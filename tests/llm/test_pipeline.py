"""The pipeline against brute force, and each of its stages on edge rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from test_llm_operators import WORD_BPE, brute_cut, brute_lines, brute_near, edge_rows, line_rows, near_rows, sentence

pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(31)
    rows = dict(near_rows()) | dict(line_rows())
    passage = sentence(rng, 60)
    rows |= {400 + k: f"{sentence(rng, 20)} {k} {passage} {sentence(rng, 15)} {k}" for k in range(8)}
    rows |= {500 + k: " ".join(rng.choice(["idiot", "scum", "moron", "clown"]) if j % 4 == 0 else rng.choice("abcdefgh") for j in range(30)) for k in range(30)}
    rows |= {600 + k: f"All rights reserved.\n{sentence(rng, 30)} {k}\n\nAll rights reserved." for k in range(6)}
    return rows


def brute_pipeline(rows, scorer):
    """(doc_id, text) that are left before packing."""
    rows = {d: t for d, t in rows.items() if scorer(t or "") < 0.5}
    gone, kept = brute_lines(list(rows.items()), 1, 6), {}
    for d, t in rows.items():
        left = t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        if d not in gone or left.strip(" "):
            kept[d] = left
    near = brute_near(list(kept.items()), 5, 80)
    rows = {d: t for d, t in kept.items() if near[d][2]}
    cut = dict(zip(rows, brute_cut(list(rows.items()))))
    return {d: t for d, t in cut.items() if t == rows[d] or t.strip(" ")}


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows.items()], "doc_id long, text string, n_chars long").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, int(500 <= d < 530)) for d in rows], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scorer = toxicity.fit(docs, labels).scorer()
    left, tok, want = brute_pipeline(rows, scorer), Tokenizer.from_file(WORD_BPE), []
    assert 20 < len(left) < len(rows) - 40 and not any(500 <= d < 530 for d in left)
    for d, t in left.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    spark.createDataFrame([(5, 0), (23, 1), (24, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_on_edge_rows(spark, labelled, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, no n_chars, and no rows at all."""
    rows = edge_rows() + [(None, None), (None, "no id at all"), ((1 << 63) - 1, "greatest"), (-(1 << 63), "least")]
    odd = ["__d", "__t", "__gone", "__own", "__lines", "__removed", "__score", "__digest", "__rep", "__spans", "component_id", "kept", "line", "key", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(k) for k, c in enumerate(odd)})
    out = stage(spark, df, labelled)
    if name == "best_fit_packing":
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == {d for d, _ in rows}
    else:
        assert out.columns == df.columns and 0 < out.count() <= len(rows)
        assert out.where(" or ".join(f"`{c}` <> {k}" for k, c in enumerate(odd))).count() == 0
        assert out.where("text is null").count() == 2
    assert stage(spark, df.where("false"), labelled).count() == 0
