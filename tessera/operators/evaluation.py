"""Evaluation verdicts, roll-ups, A/B deltas, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passed_and_hallucinated(behaviour: Column, status: Column, answer: Column, expected: Column, citations: Column, tools: Column) -> Column:
    """struct(passed, hallucinated) by expected behaviour."""
    soft = status.isin("ABSTAIN", "UNVERIFIED")
    good = status == "PASS"
    want = F.coalesce(expected, F.lit(""))
    has = (want != "") & F.contains(answer, want)
    has_any_case = F.contains(F.lower(answer), F.lower(want))
    tool = F.arrays_overlap(tools, F.array(F.lit("calculator"), F.lit("python_repl")))
    cited = F.size(citations) > 0

    def pair(p, h):
        return F.struct(p.alias("passed"), h.alias("hallucinated"))

    no = F.lit(False)
    return (
        F.when(behaviour == "abstain", pair(soft, ~soft))
        .when(behaviour == "abstain_or_clarify", pair(soft | good, ~(soft | good)))
        .when(behaviour == "retrieve_evidence", pair(good & cited, ~(good & cited) & ~soft))
        .when(behaviour == "execute_tool", pair(has | (tool & good), no))
        .otherwise(pair(good & ((want == "") | has_any_case), no))
    )


def battery(results: DataFrame) -> DataFrame:
    """Rates and means per category and, with a null category, over all."""
    return results.rollup("category").agg(
        F.count("*").alias("n"),
        F.avg(F.col("passed").cast("int")).alias("pass_rate"),
        F.avg(F.col("hallucinated").cast("int")).alias("hallucination_rate"),
        F.avg("repetition").alias("repetition"),
        F.avg("latency_ms").alias("latency_ms"),
        F.sum("tokens").cast("long").alias("tokens"),
        (F.sum("tokens") / F.greatest(F.lit(0.001), F.sum("latency_ms") / 1000)).alias("tokens_per_s"),
    )


def ab_delta(results: DataFrame, base: str, other: str) -> DataFrame:
    """Metrics of two modes side by side and their difference."""
    mean = lambda mode, c: F.avg(F.when(F.col("mode") == mode, F.col(c)))
    out = []
    for c in ("passed", "latency_ms", "tokens"):
        a, b = mean(base, c), mean(other, c)
        out += [a.alias(f"{c}_{base}"), b.alias(f"{c}_{other}"), (b - a).alias(f"{c}_delta")]
    return results.withColumn("passed", F.col("passed").cast("double")).agg(*out)


def gaps(results: DataFrame) -> DataFrame:
    return results.where("not passed").groupBy("domain").agg(F.count("*").alias("failures"))


def telemetry(events: DataFrame) -> DataFrame:
    """One summary a query of its events: success is PASS or UNVERIFIED without an abort."""
    ok = F.max_by("status", F.struct("ts", "event_id")).isin("PASS", "UNVERIFIED") & ~F.bool_or("aborted")
    return events.groupBy("query_id").agg(F.count("*").alias("event_count"), F.sum("tokens").cast("long").alias("tokens_consumed"), F.bool_or(F.col("kind") == "RETRIEVE").alias("retrieval_used"), F.array_sort(F.collect_set("kind")).alias("kinds"), ok.alias("success"))


def confidence(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, standard error and 95 % interval per group."""
    se = F.stddev_samp(value) / F.sqrt(F.count("*").cast("double"))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), se.alias("stderr"), (F.avg(value) - 1.96 * se).alias("ci_low"), (F.avg(value) + 1.96 * se).alias("ci_high"))


def policy_step(route: Column, status: Column, elapsed_ms: Column, retries: Column, max_retries: Column, tokens: Column, max_tokens: Column) -> Column:
    """Where an execution goes on: its limits first, then escalation."""
    stop = (elapsed_ms > 10000) | (tokens > 2 * max_tokens)
    bad = status.isin("REVISE", "ABSTAIN")
    return F.when(stop, "ABSTAIN").when((retries >= max_retries) & bad, "ABSTAIN").when((route == "FAST") & (status == "UNVERIFIED"), "RETRIEVE").when((route == "FAST") & (status == "REVISE"), "THINK").otherwise(route)


def may_call_tool(elapsed_ms: Column, tool_calls: Column, max_tools: Column) -> Column:
    """Whether another tool call is within an execution's limits."""
    return (elapsed_ms <= 10000) & (tool_calls < max_tools)


def compared(base: DataFrame, tuned: DataFrame, by: str) -> DataFrame:
    """Mean scores of two runs by language or task, and their difference; a side without rows counts as 0."""
    mean = lambda df, name: df.groupBy(by).agg(F.avg("score").alias(name))
    both = mean(base, "base").join(mean(tuned, "tuned"), by, "full_outer")
    a, b = F.coalesce("base", F.lit(0.0)), F.coalesce("tuned", F.lit(0.0))
    return both.select(by, a.alias("base"), b.alias("tuned"), (b - a).alias("delta"))


def variants(results: DataFrame) -> DataFrame:
    """One row a variant: n, pass and abstain rate, mean latency and tokens."""
    rate = lambda c: F.avg(c.cast("double"))
    return results.groupBy("variant").agg(
        F.count("*").alias("n"),
        rate(F.col("status") == "PASS").alias("pass_rate"),
        rate(F.col("status") == "ABSTAIN").alias("abstain_rate"),
        F.avg("latency_ms").alias("latency_ms"),
        F.avg("tokens").alias("tokens"),
    )


def suite(results: DataFrame) -> DataFrame:
    """Mean length and repetition per category and, with a null category, over all."""
    return results.rollup("category").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.avg("repetition").alias("mean_repetition"))


def regressed(metrics: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Metrics (metric, before, after; higher is better) that fell by more than the tolerance, relative to before."""
    return metrics.withColumn("regressed", F.col("after") < F.col("before") * (1 - tolerance))
