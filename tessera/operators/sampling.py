"""Deterministic sampling: strata, token budgets, quotas, hash splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def shuffle_key(seed: int, id_col: str = "doc_id") -> Column:
    """A seeded order that any partitioning gives alike."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)


def stratum(language: Column, domain: Column, source: Column) -> Column:
    """Ordered substring rules; ``hi`` and ``bn`` match inside other names as well."""
    lang, dom, src = (F.lower(F.coalesce(c, F.lit(d))) for c, d in ((language, "English"), (domain, ""), (source, "")))
    has = lambda c, s: F.contains(c, F.lit(s))
    return (
        F.when(has(lang, "bengali") | has(lang, "bn"), "Bengali")
        .when(has(lang, "hindi") | has(lang, "hi"), "Hindi")
        .when(has(dom, "math") | has(src, "math"), "Mathematics")
        .when(has(src, "fineweb") | has(dom, "educational"), "English_Educational")
        .otherwise("English_Wikipedia")
    )


def prefix_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` in the order of a column, in two levels.

    Rows are dealt over ranges that Spark samples, however sparse the ids are, and
    written once; sums within ranges run in parallel, and only one row a range
    goes through the unpartitioned window.
    """
    df = staged(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    base = df.groupBy("__range").agg(F.sum(value).alias("__sum"))
    base = base.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(base, "__range").withColumn(out, F.col("__base") + F.col("__within")).drop("__range", "__base", "__within")


DIGITS = 4


def _cut_at(rows: DataFrame, by: list[str], key: str, value: str, bound: Column, inside: Column, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in the order of a hash, group by group, against a bound on the running sum: (all taken, to be decided, the others).

    Sums of hash prefixes tell where each prefix begins (``__base``) and ends; at
    most one with a sum over zero lies across the bound, and only its rows, one in
    16^digits, are put in order (``__prev``: the sum before each). ``inside``: whether
    a prefix that ends at ``__end`` is taken as a whole.
    """
    rows = rows.withColumn("__p", F.substring(key, 1, digits))
    sums = rows.groupBy(*by, "__p").agg(F.sum(value).alias("__s"))
    ends = F.sum("__s").over(Window.partitionBy(*by).orderBy("__p"))  # 16^digits rows a group at most
    rows = rows.join(sums.withColumn("__end", ends).withColumn("__base", F.col("__end") - F.col("__s")).drop("__s"), [*by, "__p"])
    across = (F.col("__base") <= bound) & ~inside
    own = Window.partitionBy(*by, "__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(across).withColumn("__prev", F.col("__base") + F.sum(value).over(own) - F.col(value))
    return rows.where(inside), edge, rows.where(~across & ~inside)


def budget_sample(df: DataFrame, target: int, ratios: dict[str, float], seed: int, stratum_col: str = "stratum", tokens_col: str = "n_tok", id_col: str = "doc_id", refill: tuple[str, ...] = (), digits: int = DIGITS) -> DataFrame:
    """Rows of a stratified sample of about ``target`` tokens, with ``taken_in`` (quota or refill).

    Per stratum documents are taken in hash order while they fit its quota; the
    first that does not is taken if that brings the total closer. A deficit is
    then filled from the rest of the ``refill`` strata until it is crossed.
    Where a quota ends is found by sums of hash prefixes, so no task orders a
    stratum. Only narrow columns take part; join texts back by id. Null counts are 0.
    """
    if abs(sum(ratios.values()) - 1) > 1e-6 or target < 0:
        raise ValueError("ratios must sum to 1 and the target must not be negative")
    quotas = F.create_map(*(x for s, r in ratios.items() for x in (F.lit(s), F.lit(int(target * r)).cast("long"))))
    rows = df.select(F.col(id_col).alias("__id"), F.col(stratum_col).alias("__stratum"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("__n"), shuffle_key(seed, id_col).alias("__key"), shuffle_key(seed + 1, id_col).alias("__key2"))
    rows = staged(rows.where(F.col("__stratum").isin(*ratios)).withColumn("__quota", quotas[F.col("__stratum")]), "sample")
    whole, edge, others = _cut_at(rows, ["__stratum"], "__key", "__n", F.col("__quota"), F.col("__end") <= F.col("__quota"), digits)
    edge = edge.withColumn("__cum", F.col("__prev") + F.col("__n"))
    fits = (F.col("__cum") <= F.col("__quota")) | (F.col("__prev") == 0)
    own = Window.partitionBy("__stratum").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)  # the rows of one prefix
    first = ~fits & (F.sum((~fits).cast("int")).over(own) == 1)
    decided = edge.withColumn("__take", fits | (first & (F.col("__cum") - F.col("__quota") < F.col("__quota") - F.col("__prev"))))
    names = ["__id", "__stratum", "__n", "__key2"]
    quota = whole.select(*names).unionByName(decided.where("__take").select(*names))
    final = lambda d, how: d.select(F.col("__id").alias(id_col), F.col("__stratum").alias(stratum_col), F.col("__n").alias(tokens_col), F.lit(how).alias("taken_in"))
    if not refill:
        return final(quota, "quota")
    deficit = quota.agg(F.coalesce(F.lit(target) - F.sum("__n"), F.lit(target)).alias("__deficit"))
    pool = others.select(*names).unionByName(decided.where("not __take").select(*names)).where(F.col("__stratum").isin(*refill))
    pool = pool.join(F.broadcast(deficit)).withColumn("__all", F.lit(0))  # one row
    taken, edge, _ = _cut_at(pool, ["__all"], "__key2", "__n", F.col("__deficit") - 1, F.col("__end") < F.col("__deficit"), digits)
    more = taken.select(*names).unionByName(edge.where("__prev < __deficit").select(*names))
    return final(quota, "quota").unionByName(final(more, "refill"))


def prefix_until(df: DataFrame, order: str, value: str, budget: int) -> DataFrame:
    """Rows while the total before them is under the budget, so with the crossing row."""
    return prefix_sum(df, order, value, "before").where(F.col("before") < budget)


def quota_split(df: DataFrame, group: str, order: str, n_val: int, n_train: int) -> DataFrame:
    """The first n_val rows of each group for validation, the next n_train for training."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rn", rn).where(F.col("rn") <= n_val + n_train).withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train"))


def hash_split(df: DataFrame, seed: int, pct: int, id_col: str = "doc_id") -> DataFrame:
    """The first floor(pct %) rows of the seeded order are validation.

    Two levels: the order's rank comes from the counts of 256 hash prefixes.
    """
    rows = df.withColumn("__key", shuffle_key(seed, id_col)).withColumn("__p", F.substring("__key", 1, 2))
    base = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    base = base.withColumn("__base", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy()))
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("__p").orderBy("__key"))).join(F.broadcast(base), "__p")  # 256 rows at most
    return ranked.withColumn("split", F.when(F.col("__base") + F.col("__rn") <= F.floor(F.col("__n") * pct / 100), "val").otherwise("train")).drop("__key", "__p", "__base", "__n", "__c", "__rn")


def audit_sample(df: DataFrame, group: str, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """n rows of each group, by the seeded order (a window group limit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(seed, id_col)))).where(F.col("rn") <= n)


def positional_split(df: DataFrame, order: str, percent: int = 85) -> DataFrame:
    """Adds split: train for the first max(1, percent of all) rows in order, val for the rest. Rows of equal order are each a row."""
    placed = prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__k").join(F.broadcast(df.agg(F.count("*").alias("__n"))))  # one row
    first = F.greatest(F.lit(1), F.floor(F.col("__n") * percent / 100))
    return placed.withColumn("split", F.when(F.col("__k") < first, "train").otherwise("val")).drop("__one", "__k", "__n")
