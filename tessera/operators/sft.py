"""Instruction data: examples from turns, templates, masks, statistics, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.answers import states_answer
from ..sources.stage import staged
from . import verify
from .dedup import mark_first

IGNORE = -100
#: The instruction template.
PREFIX = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n"
RESPONSE = "\n\n### Response:\n"


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, prompt, response of the last system, user and assistant turns; without an answer, none."""
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = conversations.groupBy("conv_id").agg(last("system").alias("system"), last("user").alias("user"), last("assistant").alias("assistant"))
    prompt = F.concat(F.when(F.col("system").isNotNull(), F.concat(F.lit("[SYSTEM]"), "system", F.lit("\n"))).otherwise(""), F.lit("[USER]"), F.col("user"), F.lit("\n[ASSISTANT]"))
    return rows.where("user is not null and assistant is not null").select("conv_id", prompt.alias("prompt"), F.col("assistant").alias("response"))


def alpaca_prompt(instruction: Column, extra: Column) -> Column:
    body = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(instruction, F.lit("\n"), extra)).otherwise(instruction)
    return F.concat(F.lit(PREFIX), body, F.lit(RESPONSE))


def mask_separate(prompt: Column, response: Column, length: int, bos: int, eos: int, pad: int = 0) -> Column:
    """struct(input_ids, labels, attention_mask): regions encoded apart, the response cut first, the prompt keeps its tail."""
    r = F.slice(response, 1, length - 2)
    room = F.lit(length - 2) - F.size(r)
    p = F.when(room >= F.size(prompt), prompt).otherwise(F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), room))
    ids = F.concat(F.array(F.lit(bos)), p, r, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.size(p) + 1), r, F.array(F.lit(eos)))
    fill = F.lit(length) - F.size(ids)
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("input_ids"), F.concat(labels, F.array_repeat(F.lit(IGNORE), fill)).alias("labels"), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill)).alias("attention_mask"))


def mask_joint(full: Column, prompt_len: Column, length: int) -> Column:
    """struct(input_ids, labels): the text encoded once, its head kept, the first prompt_len ids masked."""
    ids = F.slice(full, 1, length)
    n = F.least(prompt_len, F.size(ids))
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(IGNORE), n), F.slice(ids, n + 1, F.size(ids))).alias("labels"))


def build(examples: DataFrame, max_tokens: int = 512, least: int = 5) -> DataFrame:
    """Clean, filter by length, drop repeats of accepted examples (lower-cased), then by tokens."""
    rows = examples.withColumn("prompt", T.strip_boilerplate(F.col("prompt"))).withColumn("response", T.strip_boilerplate(F.col("response")))
    rows = rows.where((F.length("prompt") >= least) & (F.length("response") >= least))
    rows = rows.withColumn("token_count", F.size(T.split_words(F.concat_ws(" ", "prompt", "response")))).where(F.col("token_count") <= max_tokens)
    rows = rows.withColumn("h", F.sha2(F.lower(F.concat("prompt", F.lit("\n"), "response")), 256))
    return mark_first(rows, "h", "conv_id").where("first_seen").drop("first_seen")


def admitted(examples: DataFrame, n_tokens: Column, order: str = "conv_id", max_tokens: int = 512, least: int = 5) -> DataFrame:
    """Every example (prompt, response, check: standard, python_code or math) cleaned, with ``reason``: accepted, too_short, duplicate, syntax_error, math_unverified or too_many_tokens.

    The first by ``order`` of those that pass is accepted; later examples of the
    same lower-cased text are duplicates whatever else they lack, earlier ones
    keep their own reason. ``n_tokens`` is computed from the cleaned columns.
    """
    rows = examples.withColumns({c: T.strip_boilerplate(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt", "response")})
    rows = rows.withColumn("parses", F.when(F.col("check") == "python_code", verify.parses(F.col("response"))).otherwise(F.lit(True)))
    own = (
        F.when((F.length("prompt") < least) | (F.length("response") < least), "too_short")
        .when(~F.col("parses"), "syntax_error")
        .when((F.col("check") == "math") & ~states_answer(F.col("response")), "math_unverified")
        .when(n_tokens > max_tokens, "too_many_tokens")
        .otherwise("accepted")
    )
    h = F.sha2(F.lower(F.concat("prompt", "response")), 256)
    rows = staged(rows.withColumns({"own": own, "h": h, "n_tokens": n_tokens}).drop("parses"), "examples")
    first = rows.where("own = 'accepted'").groupBy("h").agg(F.min(order).alias("first"))
    late = (F.col(order) > F.col("first")) & (F.col("own") != "too_short")
    return rows.join(first, "h", "left").withColumn("reason", F.when(late, "duplicate").otherwise(F.col("own"))).drop("own", "first")


def length_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, total, upper median and the value at zero-based place floor(.95 n) of whole numbers; nulls do not count.

    Selection on counts: the values' counts, summed by sign, exponent and ten
    further bits (at most some 10^5 buckets a group), tell in which bucket a place
    lies; only that bucket's different values are put in order. No task sees the
    rows of a group.
    """
    v = F.col(value).cast("long")
    counts = df.where(v.isNotNull()).groupBy(F.col(group).alias("__g"), v.alias("__v")).agg(F.count("*").alias("__c"))
    size = F.abs("__v")
    shift = F.greatest(F.lit(0), F.ceil(F.log2(size + 1)).cast("int") - 11)  # a double's logarithm never falls, so buckets follow the values
    bucket = F.signum("__v").cast("long") * (shift * 4096 + F.call_function("shiftright", size, shift))
    counts = counts.withColumn("__b", bucket)
    all_of = counts.groupBy("__g").agg(F.sum("__c").alias("n"), F.sum(F.col("__c") * F.col("__v")).alias("total"))
    sums = counts.groupBy("__g", "__b").agg(F.sum("__c").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = all_of.select("__g", F.explode(F.array(F.struct(F.lit("median").alias("name"), F.floor(F.col("n") / 2).alias("k")), F.struct(F.lit("p95").alias("name"), F.floor(F.col("n") * 0.95).alias("k")))).alias("p")).select("__g", "p.*")
    based = sums.select(F.col("__g").alias("__h"), F.col("__b").alias("__hb"), before.alias("__base"), "__s")
    hit = places.join(based, F.expr("__g <=> __h AND k >= __base AND k < __base + __s")).select("__h", "name", "k", "__hb", "__base")
    inside = counts.join(hit, F.expr("__g <=> __h AND __b = __hb")).select("__h", "__v", "__c", "name", "k", "__base")
    upto = F.col("__base") + F.sum("__c").over(Window.partitionBy("__h", "name").orderBy("__v"))
    found = inside.withColumn("__end", upto).where("k < __end AND k >= __end - __c")
    at = found.groupBy("__h").agg(*(F.max(F.when(F.col("name") == c, F.col("__v"))).alias(c) for c in ("median", "p95")))
    return all_of.join(at, F.expr("__g <=> __h")).select(F.col("__g").alias(group), "n", "total", "median", "p95")


def replay(passages: DataFrame, budget: int, order: str = "item_id", tokens: str = "n_tok") -> DataFrame:
    """Passages repeated in order, round after round, until the budget is crossed; (round, order)."""
    total = passages.agg(F.sum(tokens).alias("total"))
    own = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = passages.select(order, tokens, F.coalesce(F.sum(tokens).over(own), F.lit(0)).alias("before")).join(F.broadcast(total))  # one row
    rounds = F.sequence(F.lit(0), F.floor(F.lit(budget) / F.col("total")).cast("int"))
    rows = rows.withColumn("round", F.explode(rounds)).withColumn("before", F.col("before") + F.col("round") * F.col("total"))
    return rows.where(F.col("before") < budget).select("round", order, tokens, "before")


def context_window(turns: DataFrame, max_tokens: int) -> DataFrame:
    """The newest turns of each conversation within a token budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum("n_tok").over(w)).where(F.col("used") <= max_tokens)
