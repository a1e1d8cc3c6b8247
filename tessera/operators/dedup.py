"""Exact deduplication, split leakage and held-out contamination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stage import staged

#: Fixed value: held-out texts under so many characters are not looked for.
FRAGMENT_CHARS = 80
WINDOW, MOST_KEY_BYTES = 80, 8 << 20
_BASE = 0x9E3779B97F4A7C15


def mark_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds first_seen: the earliest row of its key.

    The least order per key is an aggregate with map-side combine, so a hot key
    does not gather its rows in one task as a window would.
    """
    least = df.groupBy(key).agg(F.min(order).alias("__first"))
    return df.join(least, key).withColumn("first_seen", F.col(order) == F.col("__first")).drop("__first")


def leakage(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """Keys present in both splits."""
    return train.select(key).intersect(val.select(key))


def fragments(benchmark: DataFrame, text_col: str = "text", least: int = FRAGMENT_CHARS) -> DataFrame:
    """Different normalised, case-folded held-out texts of at least ``least`` characters."""
    folded = T.casefold(T.normalize(F.col(text_col))).alias("fragment")
    return benchmark.where(F.col(text_col).isNotNull()).select(folded).where(F.length("fragment") >= least).distinct()


def _runs(column: pa.Array, q: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' UTF-8 bytes, and each key's row: of every w neighbouring runs of q bytes the one of least hash, repeats side by side left out."""
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype("i8")
    data = np.frombuffer(column.buffers()[2] or b"", "u1")[off[0] : off[-1]].astype("u8") + np.uint64(1)
    off = off - off[0]
    n = len(data) - q - w + 2  # windows that the bytes hold, those over a text's end too
    if n < 1:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    with np.errstate(over="ignore"):
        h, size = data, 1  # of runs of ``size`` bytes, which is doubled and grown by one up to q
        for bit in bin(q)[3:]:
            h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
            size *= 2
            if bit == "1":
                h = h[:-1] * np.uint64(_BASE) + data[size:]
                size += 1
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    end = np.repeat(off[1:], np.diff(off))[:n]
    inside = np.arange(q + w - 1, q + w - 1 + n) <= end
    new = np.flatnonzero(inside & np.append(True, ~inside[:-1] | (h[1:n] != h[: n - 1]) | (end[1:] != end[:-1])))
    return h[new].astype("i8"), np.searchsorted(off, new, "right") - 1


def _keyed(q: int, w: int, known: np.ndarray | None = None, text: bool = False):
    """(id, text) to a row for each text with its different keys, or only ``known`` (sorted) ones and texts that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                key, row = _runs(part.column(1), q, w)
                if known is not None:
                    hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
                    key, row = key[hit], row[hit]
                both = np.unique(np.stack([row, key], 1), axis=0) if len(key) else np.zeros((0, 2), "i8")
                rows, first = np.unique(both[:, 0], return_index=True)
                keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)), pa.int32()), pa.array(both[:, 1]))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *([part.column(1).take(at)] if text else []), keys], ["id", *(["text"] if text else []), "keys"])

    return run


def contaminated(docs: DataFrame, frags: DataFrame, id_col: str = "doc_id", folded_col: str = "folded", most_key_bytes: int = MOST_KEY_BYTES) -> DataFrame:
    """Ids of documents that contain a fragment as a substring, whatever its script.

    An equi-join: texts are keyed by minimizers, of every window of as many bytes
    as the shortest fragment has (``WINDOW`` at most) the run of least hash. A
    window of a fragment is one of each text that contains it, so any of the
    fragment's keys is among the text's; the one that fewest fragments share is
    taken, and ``contains`` verifies. Keys that take ``most_key_bytes`` at most go
    to the tasks that read the texts, which then only pass on texts with a known
    key; more are joined by a shuffle. Null texts and empty fragments meet nothing.
    """
    spark = docs.sparkSession
    frags = frags.select("fragment").where("fragment <> ''").distinct()
    least = min(WINDOW, frags.agg(F.min(F.octet_length("fragment"))).first()[0] or WINDOW)
    q = max(1, min(24, least // 2))
    w = least - q + 1
    rows = docs.select(F.col(id_col).alias("id"), F.col(folded_col).alias("text")).where("text is not null")
    id_type = rows.schema["id"].dataType.simpleString()
    by_key = frags.select("fragment", F.col("fragment").alias("text")).mapInArrow(_keyed(q, w), "id string, keys array<bigint>").select(F.col("id").alias("fragment"), F.explode("keys").alias("key"))
    shared = by_key.groupBy("key").agg(F.count("*").alias("n"))
    best = by_key.join(shared, "key").groupBy("fragment").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    with_key = staged(best, "fragments")
    if with_key.select("key").distinct().count() * 8 <= most_key_bytes:
        known = np.sort(with_key.select("key").distinct().toArrow().column("key").to_numpy())
        hits = rows.mapInArrow(_keyed(q, w, known, text=True), f"id {id_type}, text string, keys array<bigint>").select("id", "text", F.explode("keys").alias("key"))
        found = hits.join(with_key, "key")
    else:
        pairs = rows.mapInArrow(_keyed(q, w), f"id {id_type}, keys array<bigint>").select("id", F.explode("keys").alias("key")).join(with_key, "key")
        found = pairs.select("id", "fragment").distinct().join(rows, "id")
    return found.where(F.contains("text", "fragment")).select(F.col("id").alias(id_col)).distinct()
