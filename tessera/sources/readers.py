"""Sources: JSON lines with bad rows kept countable, held-out sets, samples, packed tokens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T



def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    """The schema's columns and ``status``: ok, invalid_json or not_object; blank lines are skipped."""
    lines = spark.read.text(path).where(T.strip(F.col("value")) != "")
    kind = F.substring(T.strip(F.col("value")), 1, 1)
    row = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    # the parser stops after the first value, so the line must be the only element of a list
    whole = "try_variant_get(try_parse_json(concat('[', value, ']')), '$', 'array<variant>')"
    df = lines.select(row.alias("r"), kind.alias("k"), F.expr(f"coalesce(size({whole}) = 1, false)").alias("valid"))
    status = F.when(~F.col("valid"), "invalid_json").when(F.col("k") != "{", "not_object").otherwise("ok")
    return df.select("r.*", status.alias("status")).drop("__bad")


def text_or_content(text: Column, content: Column) -> Column:
    """Streams name their text differently: ``text`` unless empty, else ``content``."""
    return F.coalesce(F.nullif(text, F.lit("")), content)


def nested_strings(value) -> Iterator[str]:
    """Every string of a parsed JSON value, however deep."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v


def eval_fragments(spark, path: str, least: int = 80) -> DataFrame:
    """Every nested string of held-out JSON lines, normalised, folded, of at least ``least`` characters; bad JSON raises."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for line in batch.column(0).to_pylist() if line.strip() for s in nested_strings(json.loads(line))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["s"])

    raw = spark.read.text(path).select("value").mapInArrow(parse, "s string")
    folded = raw.select(T.casefold(T.normalize(F.col("s"))).alias("fragment"))
    return folded.where(F.length("fragment") >= least).distinct()


def sample_text(df: DataFrame, order: str, target_chars: int, text_col: str = "text", least: int = 50) -> DataFrame:
    """Rows of more than ``least`` characters, line breaks as spaces, until the target is crossed."""
    from ..operators.sampling import prefix_until

    rows = df.select(order, F.regexp_replace(T.strip(F.col(text_col)), "\n", " ").alias(text_col)).where(F.length(text_col) > least)
    return prefix_until(rows.withColumn("n", F.length(text_col).cast("long")), order, "n", target_chars).drop("n", "before")


def code_sample(df: DataFrame, order: str, target_chars: int, text_col: str = "text") -> tuple[DataFrame, str]:
    """Whole code rows in order until the target is crossed, and the digest of their digests; no row at all raises."""
    from ..operators.accounting import corpus_digest
    from ..operators.sampling import prefix_until

    rows = df.where(F.length(T.strip(F.col(text_col))) > 0).select(order, text_col, F.length(text_col).cast("long").alias("n"))
    out = prefix_until(rows, order, "n", target_chars).drop("n", "before")
    if out.isEmpty():
        raise ValueError("no code rows")
    return out, corpus_digest(out, order, text_col).first()[0]


def whole_files(spark, pattern: str) -> DataFrame:
    """path and text of each file, to be ordered by path."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
