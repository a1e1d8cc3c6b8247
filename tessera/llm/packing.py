"""Best-fit packing by minimum bin slack.

Documents become token ids with an end id, only documents longer than a
sequence are cut, and the pieces are put into as few sequences as possible.

Minimum bin slack: for a bin, a bitset subset-sum dynamic programme over the
lengths still available finds the fullest feasible combination; that
combination is removed and the next bin follows. The programme works on the
histogram of piece lengths (at most ``capacity`` rows whatever the corpus), and
a combination is used for as many bins as the counts allow at once, so the
driver's work does not grow with the number of bins. Which piece goes where
follows from the piece's rank among those of its length: ranks come from a
row number within (length, block) plus an exclusive prefix sum over blocks, so
a length that many pieces share is never gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import encoder, id_text, materialise, tidily

CAPACITY = 2048
ROWS_PER_BLOCK = 20_000


def fullest(avail: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
    """The (length, times) of the fullest combination of at most ``cap``.

    ``avail``: (length, count) by falling length. Bit s of ``reach`` says that a
    sum s can be made; counts go in as powers of two.
    """
    reach, mask, steps = 1, (1 << (cap + 1)) - 1, []
    for length, count in avail:
        if length > cap:
            continue
        left, k = min(count, cap // length), 1
        while left > 0:
            t = min(k, left)
            left, k = left - t, k * 2
            steps.append((reach, length, t))
            reach |= (reach << (length * t)) & mask
        if reach >> cap & 1:
            break
    s, used = reach.bit_length() - 1, {}
    for before, length, t in reversed(steps):
        if not before >> s & 1:
            used[length] = used.get(length, 0) + t
            s -= length * t
    return list(used.items())


def minimum_bin_slack(histogram: dict[int, int], cap: int = CAPACITY) -> np.ndarray:
    """Runs of equal bins: (length, first rank, last rank + 1, times a bin, first bin, offset).

    Each bin takes the longest length left and then the fullest combination of
    the others for the rest of it.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    assert all(0 < n <= cap for n in left)
    order, rank, runs, bin_no = sorted(left, reverse=True), dict.fromkeys(left, 0), [], 0
    while order:
        top = order[0]
        left[top] -= 1
        combo = {top: 1}
        for n, t in fullest([(n, left[n]) for n in order if left[n]], cap - top):
            combo[n] = combo.get(n, 0) + t
        left[top] += 1
        times, offset = min(left[n] // t for n, t in combo.items()), 0
        for n, t in sorted(combo.items(), reverse=True):
            runs.append((n, rank[n], rank[n] + times * t, t, bin_no, offset))
            rank[n] += times * t
            left[n] -= times * t
            offset += n * t
        bin_no += times
        order = [n for n in order if left[n]]
    return np.array(sorted(runs), "i8").reshape(-1, 6)


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian uint32) of each piece.

    Null and empty texts have the end id alone; a null doc_id stays null; rows
    that repeat are pieces of their own; a text of any length gives all its pieces;
    other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    ids = enc.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for col, v in zip(rows, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(tidily(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(found: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32[, ids]).

    An empty table gives an empty result.
    """
    names = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids") if c != "ids" or keep_ids]
    found = materialise(found.select(*names), "pieces")
    n_blocks = max(1, -(-found.count() // ROWS_PER_BLOCK))
    found = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks)).cast("int"))
    counts = materialise(found.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = minimum_bin_slack(histogram, capacity)
    before = counts.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = found.withColumn("within", within).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within") - 1).select(*names, "rank")
    out_type = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] << 44 | runs[:, 1]  # by length, then first rank
        for batch in batches:
            n = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(key, n << 44 | rank, "right") - 1]
            at = rank - run[:, 1]
            seq, offset = run[:, 4] + at // run[:, 3], run[:, 5] + at % run[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidily(place), out_type)


def best_fit_pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; with ``keep_ids`` also each piece's ids."""
    return pack(pieces(docs, path, end_id, capacity, id_col, text_col), capacity, keep_ids)
