"""Capability matching by Column functions: name equality, SemVer expression, required-property subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import staged

_VERSION = r"^v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_TERM = r"(\^|~|>=|<=|>|<|=)?\s*(\S+)"
_NUMBER = r"^\s*(>=|<=|>|<|=)\s*(-?\d+(?:\.\d+)?)\s*$"


def parsed(text: Column) -> Column:
    """struct(numbers, given, key) of a version: its three numbers, how many are given before a wildcard, and what versions are ordered by; null if it is none.

    The key compares like the version: numbers, then pre-releases before the release,
    among them numeric parts by number and before the others, which go by name.
    """
    part = lambda n: F.regexp_extract(text, _VERSION, n)
    digits = lambda n: part(n).rlike(r"^\d+$")
    given = F.when(~digits(1), 0).when(~digits(2), 1).when(~digits(3), 2).otherwise(3)
    numbers = F.array(*(F.when(given >= n, part(n).cast("long")).otherwise(F.lit(0).cast("long")) for n in (1, 2, 3)))
    own = F.split(part(4), r"\.")
    pieces = F.transform(own, lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"), F.coalesce(F.when(x.rlike(r"^\d+$"), x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("name")))
    pre = F.when(part(4) == "", F.slice(pieces, 1, 0)).otherwise(pieces)
    return F.when(text.rlike(_VERSION), F.struct(numbers.alias("numbers"), given.alias("given"), F.struct(numbers.alias("numbers"), (part(4) == "").alias("release"), pre.alias("pre")).alias("key")))


def _after(v: Column, k: Column) -> Column:
    """The key of the least version, pre-releases included, whose k-th number (from 0) is one higher."""
    numbers = F.transform(v["numbers"], lambda x, i: F.when(i < k, x).when(i == k, x + 1).otherwise(F.lit(0).cast("long")))
    return F.struct(numbers.alias("numbers"), F.lit(False).alias("release"), F.slice(v["key"]["pre"], 1, 0).alias("pre"))


def _meets(key: Column, op: Column, v: Column) -> Column:
    """Whether a version's key meets one term; a term that is no version is not met."""
    low, n = v["key"], v["given"]
    whole, after = n == 3, _after(v, n - 1)
    first = F.when(v["numbers"][0] > 0, 0).when((n > 1) & (v["numbers"][1] > 0), 1).when((n > 2) & (v["numbers"][2] > 0), 2).otherwise(n - 1)
    one_of = (
        F.when(op == "^", (key >= low) & (key < _after(v, first)))
        .when(op == "~", (key >= low) & (key < _after(v, F.least(F.lit(1), n - 1))))
        .when(op == ">=", key >= low)
        .when(op == "<", key < low)
        .when(op == ">", F.when(whole, key > low).otherwise(key >= after))
        .when(op == "<=", F.when(whole, key <= low).otherwise(key < after))
        .otherwise(F.when(whole, key == low).otherwise((key >= low) & (key < after)))
    )
    return F.coalesce(F.when(v.isNull(), False).when(n == 0, ~op.isin("<", ">")).otherwise(one_of), F.lit(False))


def satisfies(version: Column, expression: Column) -> Column:
    """Whether a version meets ^, ~, comparisons, wildcards, joined by spaces (and) or || (or).

    A null or blank expression asks for nothing; what cannot be read is not met.
    """
    found = parsed(F.trim(F.coalesce(version, F.lit(""))))

    def all_met(part: Column) -> Column:
        terms = F.arrays_zip(F.regexp_extract_all(part, F.lit(_TERM), 1).alias("op"), F.regexp_extract_all(part, F.lit(_TERM), 2).alias("text"))
        return (F.size(terms) > 0) & F.forall(terms, lambda t: _meets(found["key"], F.coalesce(t["op"], F.lit("")), parsed(t["text"])))

    met = F.exists(F.split(expression, r"\|\|"), all_met)
    return F.when(expression.isNull() | (F.trim(expression) == ""), True).otherwise(F.coalesce((found["given"] == 3) & met, F.lit(False)))


def has_properties(declared: Column, required: Column) -> Column:
    """Whether each required key is declared with a value that meets the constraint.

    A constraint is a numeric comparison (``>=4096``) or a comma-separated list
    that the declared list must contain.
    """
    items = lambda x: F.transform(F.split(x, ","), lambda v: F.trim(v))

    def met(e: Column) -> Column:
        have, want = F.try_element_at(declared, e["key"]), e["value"]
        op, n, x = F.regexp_extract(want, _NUMBER, 1), F.regexp_extract(want, _NUMBER, 2).try_cast("double"), have.try_cast("double")
        number = F.when(op == ">=", x >= n).when(op == "<=", x <= n).when(op == ">", x > n).when(op == "<", x < n).otherwise(x == n)
        return F.coalesce(F.when(op != "", number).otherwise(F.size(F.array_except(items(want), items(have))) == 0), F.lit(False))

    return F.coalesce(F.forall(F.map_entries(required), met), F.lit(True))


#: Requests or declarations alike that meet in one task at most, about.
BLOCK_ROWS = 1000


def _classes(rows: DataFrame, terms: str, properties: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with kind (name, terms, entries) and block, and each kind with the number of its blocks; rows without a name meet nothing."""
    kind = F.struct("name", F.col(terms).alias("terms"), F.map_entries(properties).alias("entries"))
    rows = rows.where("name is not null").withColumn("kind", kind)
    kinds = rows.groupBy("kind").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    return rows, kinds


def match(requests: DataFrame, declared: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """request_id, model, name, version of every declared capability that meets a request.

    requests: request_id, name, expression, required; declared: model, name, version, properties.
    Expressions and constraints are held against each other once for all rows that
    are alike. The result is as large as requests times declarations that meet; its
    rows are made in blocks of about ``block_rows`` of each, dealt over all tasks.
    """
    requests, asked = _classes(requests, "expression", "required", block_rows)
    declared, had = _classes(declared, "version", "properties", block_rows)
    a, b = asked.select(F.col("kind").alias("a"), F.col("blocks").alias("n_a"), F.col("kind.name").alias("name")), had.select(F.col("kind").alias("b"), F.col("blocks").alias("n_b"), F.col("kind.name").alias("name"))
    pairs = a.join(b, "name").select("a", "b", "n_a", "n_b", *(F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in ("terms", "entries")))
    for c, meet in (("terms", satisfies(F.col("terms_b"), F.col("terms_a"))), ("entries", has_properties(F.map_from_entries("entries_b"), F.map_from_entries("entries_a")))):
        own = F.struct(f"{c}_a", f"{c}_b")
        # the count is always over 0; with it the costly condition stays above the aggregate, else Spark moves it below
        known = pairs.groupBy(f"{c}_a", f"{c}_b").agg(F.count("*").alias("n")).where(F.when(F.col("n") > 0, meet)).select(own.alias(c))
        pairs = pairs.withColumn(c, own).join(known, c, "left_semi")
    pairs = staged(pairs.select("a", "b", "n_a", "n_b"), "capabilities")
    pairs = pairs.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1))).drop("n_a", "n_b")
    spread = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * requests.sparkSession.sparkContext.defaultParallelism)
    block = lambda key, n: F.pmod(F.xxhash64(key), n)
    left = requests.select(F.col("kind").alias("a"), "request_id").join(a.select("a", "n_a"), "a").select("a", block("request_id", F.col("n_a")).alias("block_a"), "request_id")
    right = declared.select(F.col("kind").alias("b"), "model", "name", "version").join(b.select("b", "n_b"), "b").select("b", block("model", F.col("n_b")).alias("block_b"), "model", "name", "version")
    keys = ["a", "block_a", "b", "block_b"]
    left, right = pairs.join(left, ["a", "block_a"]).select(*keys, "request_id"), pairs.join(right, ["b", "block_b"]).select(*keys, "model", "name", "version")
    return left.repartition(spread, *keys).join(right, keys).select("request_id", "model", "name", "version")
