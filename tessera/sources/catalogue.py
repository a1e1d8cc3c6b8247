"""The catalogue of sources: its header's invariants, what is wrong with each entry, and which documents its sources admit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry's fields, those that must not be blank, and the header's only accepted values.
ENTRY = "id string, dataset string, config string, split string, revision string, text_column string, language string, domain string, target_token_share double, license string, license_url string, allowed_for_base_pretraining boolean, blocking_reason string"
NOT_BLANK = ("dataset", "config", "split", "text_column", "language", "domain", "license", "license_url")
HEADER = {"schema_version": "1", "source_revision_policy": "exact_huggingface_commit", "token_share_basis": "final_frozen_tokenizer_tokens", "generated_text_allowed": "false"}
REVISION = "^[0-9a-f]{40}$"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalogue in one JSON document, with ``place``, their number; a header that is not as it must be raises."""
    fields = ", ".join(f"{k} string" for k in HEADER)
    whole = spark.read.schema(f"{fields}, sources array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ENTRY.split(', '))}>>").option("multiLine", "true").json(path)
    wrong = F.array_compact(F.array(*(F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in HEADER.items()), F.when(F.coalesce(F.size("sources"), F.lit(0)) < 1, F.lit("sources"))))
    head = whole.select(wrong.alias("wrong")).collect()
    if len(head) != 1 or head[0]["wrong"]:
        raise ValueError(f"catalogue's header is wrong: {head[0]['wrong'] if len(head) == 1 else 'no single document'}")
    return whole.select(F.posexplode("sources").alias("place", "s")).select("place", "s.*")


def entry_failures(row_id: str = "id") -> Column:
    """Names of what is wrong with an entry by itself; rows also hold ``same_id``, how many have its id."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    share, allowed = F.col("target_token_share"), F.col("allowed_for_base_pretraining")
    checks = [
        (blank(row_id) | (F.col("same_id") > 1), "missing_or_duplicate_id"),
        (~F.coalesce(F.col("revision"), F.lit("")).rlike(REVISION), "revision_is_no_commit"),
        (share.isNull() | F.isnan(share) | (share < 0) | (share > 1), "share_outside_0_1"),
        (allowed.isNull(), "allowed_is_no_boolean"),
        (~allowed & blank("blocking_reason"), "blocked_without_reason"),
        *((blank(c), f"blank:{c}") for c in NOT_BLANK),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in checks)))


def failures(entries: DataFrame, require_complete: bool = True) -> DataFrame:
    """id (null: of the whole) and failure: by entry, and shares that do not sum to 1, allowed shares over 1, blocked sources where none may be."""
    ids = entries.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("same_id"))
    own = entries.join(ids, F.col("id").eqNullSafe(F.col("__id"))).select("id", F.explode(entry_failures()).alias("failure"))
    good = F.col("target_token_share").between(0.0, 1.0)
    allowed = F.coalesce("allowed_for_base_pretraining", F.lit(False))
    total = F.coalesce(F.sum(F.when(good, F.col("target_token_share"))), F.lit(0.0))
    part = F.coalesce(F.sum(F.when(allowed, F.col("target_token_share"))), F.lit(0.0))
    blocked = F.count_if(~F.col("allowed_for_base_pretraining")) > 0
    found = [(F.abs(total - 1) > 1e-9, "shares_do_not_sum_to_1"), (part > 1 + 1e-9, "allowed_shares_over_1"), *([(blocked, "blocked_sources")] if require_complete else [])]
    whole = entries.agg(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in found))).alias("f"))
    return own.unionByName(whole.select(F.lit(None).cast("string").alias("id"), F.explode("f").alias("failure")))


def admitted(docs: DataFrame, entries: DataFrame, source_col: str = "source") -> DataFrame:
    """Documents of sources that the catalogue allows."""
    allowed = entries.where("allowed_for_base_pretraining").select(F.col("id").alias(source_col)).distinct()
    return docs.join(allowed, source_col, "left_semi")
