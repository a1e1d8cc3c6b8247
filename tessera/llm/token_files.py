"""Token-id files with directly addressable codes.

An id is split into chunks of 8 bits, low chunk first. Level 0 holds a chunk
of every id and a bit that says whether the id goes on; level k + 1 holds the
next chunks of the ids that go on from level k. A rank directory (bits set
before each block of 512) finds an id's chunk in the next level with one
directory entry and one popcount, so any token is read without decoding a
block before it.

File: magic ``TDAC1\\0\\0\\0``, then int64 n_docs, n_tokens, n_levels; doc ids
(int64) and their validity (uint8); token offsets (int64, n_docs + 1); for each
level int64 n, then n chunk bytes, the packed continuation bits, and the rank
directory (int64). Parts start at multiples of 8 bytes.

Null and empty texts have the end id alone; a text of any length lies whole in
one file; a null doc_id comes first and is read back as null; rows that share a
doc_id follow each other, each with its own ids. An empty table gives no file and
no row. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_path, encoder, id_text, materialise, scratch, tidily

MAGIC, BLOCK, SHARD_BYTES, MOST_TOKENS = b"TDAC1\0\0\0", 512, 8 << 20, 8 << 20
REMEMBERED = 250_000  # words in each generation of the memo
MOST_SHARDS = 1 << 16  # shards only hold more parts beyond that
_ONES = np.array([bin(i).count("1") for i in range(256)], "u1")


def _padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of these documents' ids."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), "u1")])
        before = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, BLOCK // 8).sum(1, dtype="i8"))]).astype("<i8")
        levels.append(np.int64(len(rest)).tobytes() + _padded((rest & 255).astype("u1").tobytes()) + bits.tobytes() + before.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], "u1")
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), _padded(known.tobytes()), np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes(), *levels])


class TokenFile:
    """Random access to a file's tokens: ``self[i]``, ``self.slice(a, b)``, ``self.document(k)``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_levels = np.frombuffer(data, "<i8", 3, 8).tolist()
        at = 32
        known = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(data, "<i8", n_docs, at).tolist(), known.tolist())]
        at += 8 * n_docs + n_docs + -n_docs % 8
        self.offsets = np.frombuffer(data, "<i8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(np.frombuffer(data, "<i8", 1, at)[0])
            chunks = np.frombuffer(data, "u1", n, at + 8)
            at += 8 + n + -n % 8
            n_bits = -(-(-(-n // 8)) // (BLOCK // 8)) * (BLOCK // 8)
            bits = np.frombuffer(data, "u1", n_bits, at)
            at += n_bits
            before = np.frombuffer(data, "<i8", n_bits // (BLOCK // 8) + 1, at)
            at += 8 * len(before)
            self.levels.append((chunks, bits, before))

    def _rank(self, level: int, i: int) -> int:
        """Bits set before bit i."""
        _, bits, before = self.levels[level]
        byte, block = i >> 3, i // BLOCK
        n = int(before[block]) + int(_ONES[bits[block * (BLOCK // 8) : byte]].sum(dtype="i8"))
        return n + int(_ONES[bits[byte] & ((1 << (i & 7)) - 1)]) if i & 7 else n

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b as uint32."""
        out, where = np.zeros(max(0, b - a), "<u4"), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            own = chunks[a:b].astype("<u4") << (8 * level)
            if where is None:
                out |= own
            else:
                out[where] |= own
            more = np.flatnonzero(np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a])
            if not len(more):
                break
            where = more if where is None else where[more]
            a = self._rank(level, a)
            b = a + len(more)
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


def _put(uri: str, name: str, data: bytes) -> None:
    """Write whole or not at all: a retried or doubled task leaves the same file."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{folder}/{name}")


def write_token_files(docs: DataFrame, out_dir: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus in ascending doc_id order; one row per file: shard, part, n_docs, n_tokens.

    A shard is a range of rows of about ``SHARD_BYTES`` of text, whose bounds Spark
    samples whatever the ids are; texts are shuffled once and the files' names give
    their order. A shard of more than ``MOST_TOKENS`` goes on in further parts.
    """
    rows = id_text(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = min(MOST_SHARDS, max(1, -(-n_bytes // SHARD_BYTES)))
    # rows that share a doc_id are dealt by their number in the input; so bounds are sampled without reading texts
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("no"), "text")
    ranged = rows.repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first(), "no").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, REMEMBERED), np.array([end_id], "<u4").tobytes()
        now, part, ids, lengths, texts, size, done = TaskContext.get().partitionId(), 0, [], [], [], 0, []

        def flush():
            nonlocal part, ids, lengths, texts, size
            data = dump(ids, lengths, np.frombuffer(b"".join(texts), "<u4"))
            _put(out_dir, f"{now:012d}-{part:06d}.dac", data)
            done.append((now, part, len(ids), size))
            part, ids, lengths, texts, size = part + 1, [], [], [], 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist()):
                    if size > MOST_TOKENS:
                        flush()
                    own = enc.encode(text) + end
                    ids.append(doc)
                    lengths.append(len(own) // 4)
                    texts.append(own)
                    size += len(own) // 4
        if ids:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], ["shard", "part", "n_docs", "n_tokens"])

    return materialise(ranged.select("doc_id", "text").mapInArrow(tidily(write), "shard long, part long, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files.

    ``files``: what ``write_token_files`` returned; its prefix sums (one row
    per file) give each file's first position.
    """
    spark = files.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(data.as_buffer().to_pybytes())
                shard, part = (int(x) for x in name.rpartition("/")[2].removesuffix(".dac").split("-"))
                n = len(f.doc_ids)
                crc = [zlib.crc32(f.document(k).tobytes()) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(f.doc_ids, pa.int64()), pa.array(f.offsets[:-1]), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())], ["shard", "part", "doc_id", "own", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(out_dir).select("path", "content")
    found = content.mapInArrow(tidily(read), "shard long, part long, doc_id long, own long, n_tokens long, ids_crc32 long")
    base = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(base, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus to the shared folder, read every document back and delete the files; no documents, no rows."""
    spark, out_dir = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    try:
        files = write_token_files(docs, out_dir, path, end_id, id_col, text_col)
        if files.isEmpty():
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        return materialise(read_token_files(files, out_dir), "token-rows")
    finally:
        drop_path(spark, out_dir)
