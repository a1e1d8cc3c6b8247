"""Chat formatting with budgeted windows, in DataFrame functions alone.

A conversation's turns are written as ``<turn|i|flag|role>text</turn>`` and a
line feed. Texts have ``&`` and ``<`` escaped, roles also ``>`` and ``|``, so no
text can hold a mark and unescaping restores it. Prefix sums of the turns'
tokens choose spans of whole turns within a budget; each span is a window that
starts with the system turn and up to HISTORY_TURNS turns before the span, as
far as their tokens fit the history's budget. Flags: ``l`` an assistant turn under the
loss mask, ``c`` another turn of the span, ``r`` a repeated turn. A turn is ``l``
or ``c`` in one window only, so targets are never counted twice.

Rows are ordered by turn (then role and text); null roles and texts are empty;
rows that repeat are turns of their own; a null conv_id is a conversation. A turn
longer than the budget is a window by itself, whole. An empty table gives an empty
result; other columns are ignored. A conversation becomes one row,
as its digest needs the whole of it in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 2


def tokens(text: Column) -> Column:
    """The default count of a turn's tokens: a quarter of its characters, and eight for its marks."""
    return (F.floor((F.length(text) + 3) / 4) + 8).cast("long")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escaped_role(c: Column) -> Column:
    return F.replace(F.replace(escaped(c), F.lit(">"), F.lit("&gt;")), F.lit("|"), F.lit("&bar;"))


def unescaped(c: Column) -> Column:
    for mark, char in (("&bar;", "|"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def _written(turn: Column, flag: Column) -> Column:
    return F.concat(F.lit("<turn|"), turn["i"].cast("string"), F.lit("|"), flag, F.lit("|"), turn["role"], F.lit(">"), turn["text"], F.lit("</turn>\n"))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, count=tokens) -> DataFrame:
    """conv_id and windows (array of formatted strings)."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("tok", count(F.col("text")))
    rows = rows.select("conv_id", (F.row_number().over(order) - 1).alias("i"), "tok", (F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok")).alias("before"), (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"), escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "tok", "before", "target", "system", "role", "text"))).alias("t"))
    head = F.element_at("t", 1)
    conv = conv.withColumn("sys", F.when(head["system"], 1).otherwise(0))
    cap = F.greatest(F.lit(1), F.lit(budget - history) - F.when(head["system"], head["tok"]).otherwise(0))
    first = F.struct(F.array(F.col("sys")).alias("starts"), F.when(head["system"], head["tok"]).otherwise(0).cast("long").alias("at"))
    # ends of spans: a turn opens a window where the prefix sum passes what is left of the budget
    narrow = F.transform("t", lambda x: F.struct(x["i"].alias("i"), x["tok"].alias("tok"), x["before"].alias("before")))
    opens = F.aggregate(
        narrow, first, lambda acc, x: F.when((x["before"] + x["tok"] - acc["at"] > cap) & (x["i"] > F.element_at(acc["starts"], -1)), F.struct(F.concat(acc["starts"], F.array(x["i"])).alias("starts"), x["before"].alias("at"))).otherwise(acc), lambda acc: acc["starts"]
    )
    conv = conv.withColumn("starts", opens)

    def before_of(i: Column) -> Column:
        return F.get("t", i)["before"]

    def window(s: Column, w: Column) -> Column:
        end = F.coalesce(F.get("starts", w + 1), F.size("t"))
        system = F.when(F.col("sys") == 1, _written(F.get("t", F.lit(0)), F.when(w == 0, F.lit("c")).otherwise(F.lit("r")))).otherwise(F.lit(""))
        repeat = F.lit(0)
        for k in range(1, history_turns + 1):
            repeat = F.when((s - k >= F.col("sys")) & (before_of(s) - before_of(s - k) <= history), k).otherwise(repeat)
        old = F.when(w > 0, F.array_join(F.transform(F.slice("t", s - repeat + 1, repeat), lambda x: _written(x, F.lit("r"))), "")).otherwise(F.lit(""))
        new = F.array_join(F.transform(F.slice("t", s + 1, end - s), lambda x: _written(x, F.when(x["target"], F.lit("l")).otherwise(F.lit("c")))), "")
        return F.concat(system, old, new)

    return conv.select("conv_id", F.transform("starts", window).alias("windows"))


def read_windows(formatted: DataFrame) -> DataFrame:
    """conv_id and turns (array of i, role, text, loss) read back from the windows, repeated turns left out."""
    parts = F.flatten(F.transform("windows", lambda w: F.slice(F.split(w, r"<turn\|"), 2, F.greatest(F.lit(0), F.size(F.split(w, r"<turn\|")) - 1))))
    df = formatted.select("conv_id", "windows", F.transform(parts, lambda p: F.struct(F.split(F.substring_index(p, ">", 1), r"\|").alias("h"), F.substring_index(F.substring(p, F.length(F.substring_index(p, ">", 1)) + 2, F.length(p)), "</turn>", 1).alias("b"))).alias("p"))
    new = F.filter("p", lambda x: x["h"][1] != "r")
    return df.select("conv_id", "windows", F.transform(new, lambda x: F.struct(x["h"][0].cast("int").alias("i"), unescaped(x["h"][2]).alias("role"), unescaped(x["b"]).alias("text"), (x["h"][1] == "l").alias("loss"))).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    """What a conversation's windows say, as counts and digests."""
    own = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    df = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(own, 256).alias("turns_sha256"), F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "").alias("loss"), F.length(F.array_join("windows", "")).cast("long").alias("formatted_chars"))
    return df.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
