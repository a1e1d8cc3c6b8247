"""Provenance checks: foreign keys, mixture shares, identities, tombstones, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """relation and key of rows whose parent is missing."""
    return child.select(F.col(key).alias("key")).join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti").select(F.lit(relation).alias("relation"), F.col("key").cast("string").alias("key"))


def mixture_check(shares: DataFrame, key: str, share: str) -> DataFrame:
    """Entries, different keys, total, whether it is 1, and bad shares."""
    total = F.sum(share)
    return shares.agg(F.count("*").alias("entries"), F.count_distinct(key).alias("different"), total.alias("total"), (F.abs(total - 1) <= 1e-9).alias("sums_to_one"), F.count_if((F.col(share) <= 0) | F.col(share).isNull()).cast("long").alias("bad_shares"))


def identity_mismatch(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, expected, actual where the two maps differ, missing keys among them."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def excise(docs: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return docs.join(tombstones.select(key), key, "left_anti")


def excise_content(docs: DataFrame, tombstones: DataFrame, hash_col: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Documents whose content no tombstone names, and the audit of those that go: tombstone_id, reason, content_hash, documents.

    tombstones: tombstone_id, reason, content_hash. A hash that no document has is
    in the audit with 0 documents, so that a request is seen to be met; a document
    without a hash stays. One row a hash, not a list a tombstone, which may name many.
    """
    asked = tombstones.where(F.col("content_hash").isNotNull()).select("tombstone_id", "reason", "content_hash").distinct()
    found = docs.join(asked.select(F.col("content_hash").alias(hash_col)).distinct(), hash_col, "left_semi").groupBy(F.col(hash_col).alias("content_hash")).agg(F.count("*").alias("documents"))
    audit = asked.join(found, "content_hash", "left").select("tombstone_id", "reason", "content_hash", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))
    return docs.join(asked.select(F.col("content_hash").alias(hash_col)).distinct(), hash_col, "left_anti"), audit


def manifest(docs: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per group: documents, bytes and a digest that no order changes."""
    h = F.xxhash64(id_col, text_col)
    return docs.groupBy(group).agg(F.count("*").alias("documents"), F.sum(F.octet_length(text_col)).cast("long").alias("bytes"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), F.lower(F.hex(F.bit_xor(h))).alias("fingerprint"))


def migrate(df: DataFrame, version: int, latest: int, steps: dict) -> DataFrame:
    """Record translators vN -> vN+1, applied in turn."""
    for v in range(version, latest):
        df = steps[v](df)
    return df
