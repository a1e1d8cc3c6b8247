"""Token and byte accounting, shares, perplexity, bits per byte, votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import prefix_sum


def label(c: Column) -> Column:
    """Missing labels count under Unknown."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("Unknown"))


def token_accounting(docs: DataFrame, sets: list[list[str]], n_tok: Column, text_col: str = "text") -> DataFrame:
    """Documents, tokens and bytes for each grouping set (and in all), in one pass."""
    cols = sorted({c for s in sets for c in s})
    rows = docs.select(*(label(F.col(c)).alias(c) for c in cols), n_tok.cast("long").alias("n_tok"), F.octet_length(text_col).cast("long").alias("n_bytes"))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets] + [[]], *(F.col(c) for c in cols))
    return grouped.agg(F.count("*").alias("docs"), F.sum("n_tok").alias("tokens"), F.sum("n_bytes").alias("bytes"))


def with_share(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy()))


def perplexity(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """exp of the summed loss over the summed tokens; infinite without tokens."""
    n = F.sum(tokens)
    return df.agg(F.when(n > 0, F.exp(F.sum(loss) / n)).otherwise(F.lit(math.inf)).alias("perplexity"))


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    return nats / math.log(2) / n_bytes


def winners(runs: DataFrame) -> DataFrame:
    """Per view the stable, learning run of the least value."""
    return runs.where("stable and learning").groupBy("view").agg(F.min_by("tokenizer", F.struct("bpb", "tokenizer")).alias("winner"), F.min("bpb").alias("bpb"))


def majority(won: DataFrame) -> DataFrame:
    """The most frequent winner, its votes, and HIGH for four, MEDIUM for two or more."""
    votes = won.groupBy("winner").agg(F.count("*").alias("votes"))
    best = votes.orderBy(F.desc("votes"), "winner").limit(1)
    return best.withColumn("confidence", F.when(F.col("votes") == 4, "HIGH").when(F.col("votes") >= 2, "MEDIUM").otherwise("LOW"))


def parameter_count(vocab, d, layers, heads, kv, inner, tied=None, qk_norm=None) -> Column:
    """Closed-form size of a decoder with grouped-query attention and gated feed-forward."""
    tied, qk_norm = F.lit(True) if tied is None else tied, F.lit(False) if qk_norm is None else qk_norm
    head = (d / heads).cast("long")
    layer = 2 * d * d + 2 * d * kv * head + 3 * d * inner + 2 * d + F.when(qk_norm, 2 * head).otherwise(0)
    return (vocab * d + layers * layer + d + F.when(tied, 0).otherwise(vocab * d)).cast("long")


def learning_rate(step: Column, total: int, warmup: int, peak: float, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to ``floor`` of the peak."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(peak * F.greatest(F.lit(floor), 0.5 * (1 + F.cos(done * math.pi))))


def tuned_learning_rate(step: Column, total: int, warmup: int, peak: float, least: float) -> Column:
    """Linear warm-up, then a cosine from ``peak`` down to ``least``."""
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(least + 0.5 * (1 + F.cos(done * math.pi)) * (peak - least))


def packed_shares(docs: DataFrame, by: str, tokens: str) -> DataFrame:
    """Packed tokens (an end id a document on top) and their share, by language or domain."""
    n = F.sum(F.col(tokens) + 1).cast("long")
    total = docs.agg(n.alias("all"))
    return docs.groupBy(by).agg(n.alias("packed_tokens")).join(F.broadcast(total)).select(by, "packed_tokens", (F.col("packed_tokens") / F.greatest(F.lit(1), "all")).alias("share"))  # one row


def row_profile(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows, empty rows, heading rows (= ... =) and mean words of the others."""
    t = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    return lines.agg(F.count("*").alias("rows"), F.count_if(t == "").alias("empty"), F.count_if(t.rlike(r"^=.*=$")).alias("headings"), F.avg(F.when(t != "", F.size(T.split_words(t)))).alias("mean_words"))


def decision(checks: DataFrame) -> DataFrame:
    """GO or NO-GO of rows (name, severity, ok): a failed error stops, a failed warning does not."""
    errors, warnings = F.count_if(~F.col("ok") & (F.col("severity") == "error")), F.count_if(~F.col("ok") & (F.col("severity") == "warning"))
    return checks.agg(errors.cast("long").alias("failures"), warnings.cast("long").alias("warnings"), F.when(errors > 0, "NO-GO").otherwise("GO").alias("decision"))


def corpus_digest(docs: DataFrame, order: str = "doc_id", text_col: str = "text", per_leaf: int = 4096) -> DataFrame:
    """An order-sensitive digest: a tree of ``per_leaf`` hashes a node over the documents' ranks, at least two levels.

    Ranks come from sampled ranges, so a tree has the same shape whatever the ids
    are; rows of equal order stand by their hashes. Null texts count as empty.
    """
    own = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h"), F.struct(F.col(order), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("place"), F.lit(1).cast("long").alias("one"))
    level = prefix_sum(own, "place", "one", "k").select("k", "h")
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n"), 256)
    n = docs.count()
    while True:
        level = level.groupBy(F.floor(F.col("k") / per_leaf).alias("k")).agg(joined.alias("h"))
        n = -(-n // per_leaf)
        if n <= per_leaf:
            return level.agg(joined.alias("digest"))
