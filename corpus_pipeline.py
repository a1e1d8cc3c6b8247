"""The training-data pipeline: toxicity, line dedup, near-duplicates, repeated
strings, packing. Each stage's result is written as Parquet and read again as
the next one's documents.

Null texts pass every stage up to packing, where they are empty; an empty table
gives empty results; rows are told apart by doc_id and text, so rows that repeat
both are one document and stay or go together; other columns pass through, and
n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import best_fit_pack
from tessera.llm.shared import drop_path, free_name, quoted, scratch, shuffles_end, tokenizer_path
from tessera.llm.suffix_dedup import without_repeats
from tessera.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _changed(docs, out, removed):
    """``docs``' columns of ``out``, n_chars after the new text, less the rows of which nothing is left."""
    n_chars = {c: F.length("text").cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c == "n_chars"}
    kept = out.where((F.col(removed) == 0) | (F.trim("text") != ""))
    return kept.select(*(n_chars.get(c, quoted(c)) for c in docs.columns))


def line_dedup(spark, docs, sf_dir):
    """Repeated lines of any length go, lines of 6 words or more also within one word's edit, and documents that had nothing but such lines."""
    return _changed(docs, dedup_lines(docs, min_words=1, near_words=6), free_name(docs, "__removed"))


def minhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one of the smallest doc_id; rows without a doc_id stay."""
    gone = near_duplicates(docs, words=5, pct=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(quoted(c) for c in docs.columns))


def suffix_array_dedup(spark, docs, sf_dir):
    """Repeated strings of 50 bytes go where an earlier document has them, and documents that lose all."""
    return _changed(docs, without_repeats(docs), free_name(docs, "__removed"))


def best_fit_packing(spark, docs, sf_dir):
    """The kept documents' pieces, with their sequence and place and their token ids."""
    return best_fit_pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Training, suffix sorting and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Each stage's table goes when the next one is written; the last stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        try:
            with shuffles_end(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
        finally:
            if before:
                drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
