"""Token streams: global offsets, three chunkings, shifts and greedy shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .sampling import prefix_sum


def token_stream(docs: DataFrame, tokens: str = "tokens", order: str = "doc_id", eos: int | None = None, eos_for_empty: bool = True) -> DataFrame:
    """(doc, offset, ids): each document's tokens and where they stand in the stream of all documents, an end id after each. Null tokens are none; rows that repeat an id are each a document."""
    ids = F.coalesce(F.col(tokens), F.array().cast("array<int>"))
    if eos is not None:
        with_end = F.concat(ids, F.array(F.lit(eos)))
        ids = with_end if eos_for_empty else F.when(F.size(ids) > 0, with_end).otherwise(ids)
    rows = docs.select(F.col(order).alias("doc"), ids.alias("ids")).withColumn("n", F.size("ids").cast("long"))
    return prefix_sum(rows, "doc", "n", "offset").select("doc", "offset", "ids")


def offsets(docs: DataFrame, tokens: str = "tokens", order: str = "doc_id") -> DataFrame:
    """doc, n, offset: where each document starts when every one has an end id."""
    rows = docs.select(F.col(order).alias("doc"), (F.size(tokens) + 1).cast("long").alias("n"))
    return prefix_sum(rows, "doc", "n", "offset")


def _chunk(stream: DataFrame, stride: int, size: int) -> DataFrame:
    """Chunks of ``size`` tokens from every multiple of ``stride``; what a document has in a chunk is one slice of its array, one row."""
    n, offset = F.size("ids"), F.col("offset")
    first = F.greatest(F.lit(0), F.floor((offset - size) / stride) + 1)
    last = F.floor((offset + n - 1) / stride)
    rows = stream.where(n > 0).select("offset", "ids", F.explode(F.sequence(first, last)).alias("chunk"))
    at = F.greatest(F.lit(0), F.col("chunk") * stride - offset).cast("int")
    length = F.least(n, F.col("chunk") * stride + size - offset).cast("int") - at
    parts = rows.select("chunk", F.struct((offset + at).alias("at"), F.slice("ids", at + 1, length).alias("ids")).alias("part"))
    whole = parts.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))
    return whole.where(F.size("ids") == size).select("chunk", "ids")


def chunks(stream: DataFrame, length: int) -> DataFrame:
    """Full chunks of length + 1 tokens without overlap; the tail is dropped."""
    return _chunk(stream, length + 1, length + 1)


def windows(stream: DataFrame, length: int) -> DataFrame:
    """Windows of length + 1 tokens that start at multiples of ``length``: neighbours share one token."""
    return _chunk(stream, length, length + 1)


def shifted(packed: DataFrame) -> DataFrame:
    """input_ids and labels, the next token of each."""
    return packed.select("chunk", F.expr("slice(ids, 1, size(ids) - 1)").alias("input_ids"), F.expr("slice(ids, 2, size(ids) - 1)").alias("labels"))


@dataclass
class _Steps:
    """What a run of documents makes of the bytes that the open shard holds before it.

    From ``least[k]`` bytes on (up to the next step) ``value[k]`` bytes are open
    after it, with ``add[k]`` besides those before, and ``cuts[k]`` shards began.
    """

    least: np.ndarray
    add: np.ndarray
    value: np.ndarray
    cuts: np.ndarray

    NAMES: ClassVar[str] = "least array<long>, add array<boolean>, value array<long>, cuts array<long>"

    def __call__(self, total: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.least, total, "right")) - 1
        return int(self.value[k]) + total * bool(self.add[k]), int(self.cuts[k])

    def then(self, other: _Steps) -> _Steps:
        """This run and the next one together."""
        out = []
        for k, (least, add, value, cuts) in enumerate(zip(self.least.tolist(), self.add.tolist(), self.value.tolist(), self.cuts.tolist())):
            if not add:
                after, more = other(value)
                out.append((least, False, after, cuts + more))
                continue
            end = int(self.least[k + 1]) if k + 1 < len(self.least) else None
            first = int(np.searchsorted(other.least, least + value, "right")) - 1
            for j in range(first, len(other.least)):
                begin = max(least, int(other.least[j]) - value)
                if end is not None and begin >= end:
                    break
                out.append((begin, bool(other.add[j]), int(other.value[j]) + value * bool(other.add[j]), cuts + int(other.cuts[j])))
        return _Steps.of(out)

    @staticmethod
    def of(steps: list[tuple[int, bool, int, int]]) -> _Steps:
        """Of steps in order; equal neighbours become one."""
        kept = [x for k, x in enumerate(steps) if k == 0 or x[1:] != steps[k - 1][1:]]
        least, add, value, cuts = zip(*kept)
        return _Steps(np.array(least, "i8"), np.array(add, bool), np.array(value, "i8"), np.array(cuts, "i8"))

    def lists(self) -> list[list]:
        return [self.least.tolist(), self.add.tolist(), self.value.tolist(), self.cuts.tolist()]


def _next_starts(sums: np.ndarray, most: int) -> np.ndarray:
    """For a shard that begins at each document, where the next one begins (the number of documents: not among them)."""
    at = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    # a document over the bound stays with what has no bytes before it, and the next one begins a shard
    return np.where(sums[at] == sums[:-1], at + 1, at)


def _steps(sizes: np.ndarray, most: int) -> _Steps:
    sums = np.append(0, np.cumsum(sizes))
    n, total = len(sizes), int(sums[-1])
    after = _next_starts(sums, most).tolist()
    open_bytes, begun = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        j = after[k]
        open_bytes[k], begun[k] = (total - int(sums[k]), 1) if j >= n else (open_bytes[j], begun[j] + 1)
    first = after[0] if n else 0  # with nothing open, as if a shard began at the first document
    out = [(0, True, total, 0) if first >= n else (0, False, open_bytes[first], begun[first])]
    if most - total >= 1:
        out.append((1, True, total, 0))
    for k in range(n - 1, -1, -1):
        least, end = max(1, most - int(sums[k + 1]) + 1), most - int(sums[k])
        if k == 0 or least <= end:
            out.append((least, False, open_bytes[k], begun[k]))
    return _Steps.of(out)


def _shard_of(sizes: np.ndarray, most: int, total: int) -> np.ndarray:
    """For each document how many shards began, from ``total`` open bytes."""
    sums, out = np.append(0, np.cumsum(sizes)), np.zeros(len(sizes), "i8")
    after = _next_starts(sums, most).tolist()
    if total:
        at = int(np.searchsorted(sums, most - total, "right")) - 1 if total <= most else 0
    else:
        at = after[0] if len(sizes) else 0
    while at < len(sizes):
        out[at] = 1
        at = after[at]
    return np.cumsum(out)


FAN = 64  # runs that are put together at once


def _composed(fan):
    """Runs of one group, in order, to their composition."""

    def run(table):
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        whole = None
        for r in rows:
            own = _Steps(*(np.array(r[c], t) for c, t in (("least", "i8"), ("add", bool), ("value", "i8"), ("cuts", "i8"))))
            whole = whole.then(own) if whole else own
        return pa.table([pa.array([rows[0]["key"]]), pa.array([rows[0]["no"] // fan], pa.int64()), *(pa.array([x], t) for x, t in zip(whole.lists(), _STEP_TYPES))], ["key", "no", "least", "add", "value", "cuts"])

    return run


def _entered(table):
    """Runs of one group and what is open before the group, to what is open before each run."""
    total, begun, out = table.column("total")[0].as_py(), table.column("begun")[0].as_py(), []
    for r in sorted(table.drop_columns(["total", "begun"]).to_pylist(), key=lambda r: r["no"]):
        out.append((r["key"], r["no"], total, begun))
        total, more = _Steps(*(np.array(r[c], t) for c, t in (("least", "i8"), ("add", bool), ("value", "i8"), ("cuts", "i8"))))(total)
        begun += more
    keys, nos, totals, cuts = zip(*out)
    return pa.table([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in (nos, totals, cuts))], ["key", "no", "total", "begun"])


_STEP_TYPES = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def shard_numbers(docs: DataFrame, max_bytes: int, group: str, order: str, size: Column, run_rows: int = 10_000, fan: int = FAN) -> DataFrame:
    """group, order, shard: documents in order go to a shard while its bytes fit; one over the bound has its own.

    The bytes of a shard are counted from its start, a fold that no window
    expresses. Documents are dealt by Spark over ranges of (group, order) and cut
    into runs. What a run makes of the bytes open before it is a step function with
    a step for each place of its first cut, so a few hundred numbers whatever comes
    after. Runs are put together ``fan`` at a time until one is left for each group,
    and what is open before each run comes down the same way: no task sees more than
    ``fan`` runs, however large a group is. Rows of equal order stand as Spark
    sorts them; null sizes count as none.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    rows = docs.select(F.to_json(F.struct(F.col(group).alias("g"))).alias("key"), F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, run_rows):
                piece = batch.slice(lo, run_rows)
                keys = piece.column(0).to_pylist()
                edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for a, b in zip(edges, edges[1:]):
                    own = piece.slice(a, b - a)
                    steps = _steps(own.column(3).to_numpy(), max_bytes).lists()
                    whole = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([own.column(c)])) for c in (2, 3)]
                    yield pa.RecordBatch.from_arrays([own.column(0).slice(0, 1), own.column(1).slice(0, 1), pa.array([part << 32 | seq]), *whole, *(pa.array([x], t) for x, t in zip(steps, _STEP_TYPES))], ["key", "g", "place", "o", "n", "least", "add", "value", "cuts"])
                    seq += 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                o, n = (batch.column(c)[k].values for c in (1, 2))
                shard = _shard_of(n.to_numpy(), max_bytes, batch.column(3)[k].as_py()) + batch.column(4)[k].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(o))), o, pa.array(shard)], ["g", "o", "shard"])

    dealt = rows.repartitionByRange("key", "o").sortWithinPartitions("key", "o")
    runs = dealt.mapInArrow(cut, f"key string, g {kinds[group]}, place long, o array<{kinds[order]}>, n array<long>, {_Steps.NAMES}")
    runs = staged(runs, "runs")
    steps = ["least", "add", "value", "cuts"]
    number = F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1  # one narrow row for each run
    placed = runs.select("key", "place").withColumn("no", number.cast("long"))
    levels = [staged(runs.select("key", "place", *steps).join(placed, ["key", "place"]).select("key", "no", *steps), "steps")]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("key", F.floor(F.col("no") / fan)).applyInArrow(_composed(fan), f"key string, no long, {_Steps.NAMES}")
        levels.append(staged(up, "steps"))
    entry = levels[-1].select("key", F.col("no"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("begun"))
    for level in levels[-2::-1]:
        inside = level.withColumn("above", F.floor(F.col("no") / fan)).join(entry.withColumnRenamed("no", "above"), ["key", "above"])
        entry = inside.groupBy("key", "above").applyInArrow(_entered, "key string, no long, total long, begun long")
    known = placed.join(entry, ["key", "no"]).select("key", "place", "total", "begun")
    out = runs.join(known, ["key", "place"]).select("g", "o", "n", "total", "begun").mapInArrow(numbered, f"g {kinds[group]}, o {kinds[order]}, shard long")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), "shard")


def greedy_shards(docs: DataFrame, max_bytes: int, group: str = "dataset", order: str = "doc_id", text: str = "text") -> DataFrame:
    """group, shard, n_docs, n_bytes, digest of greedily filled shards.

    Sizes, not texts, are numbered (``shard_numbers``); texts join back by group and id, which tell rows apart.
    """
    placed = shard_numbers(docs, max_bytes, group, order, F.octet_length(text)).select(F.col(group).alias("__g"), F.col(order).alias("__o"), "shard")
    rows = docs.select(group, order, text).join(placed, F.col(group).eqNullSafe(F.col("__g")) & F.col(order).eqNullSafe(F.col("__o")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return rows.groupBy(group, "shard").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length(text)).cast("long").alias("n_bytes"), body.alias("body")).withColumn("digest", F.concat(F.lit("shard_"), F.substring(F.sha2("body", 256), 1, 16))).drop("body")
