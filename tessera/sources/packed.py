"""Packed corpora as files of little-endian uint32: a Spark data source, ``packed_tokens``.

A corpus is a folder: token files in the order of their first token's place, a
manifest with every file's length and SHA-256, and a COMPLETE marker. Tasks write
their part of the stream under a staging folder; the commit checks that the parts
join without a gap, writes manifest and marker and renames the folder, so a
corpus is whole or not there. It is never replaced.

Reading checks marker, manifest, byte lengths before any task starts, and ids and
hashes as the files stream by; a changed byte fails the query. Without options rows
are (offset, ids) of up to ``BLOCK`` tokens; with ``seq_len`` they are training
examples (index, input_ids, labels) of every full window of seq_len + 1 tokens that
starts at a multiple of seq_len, also where it reaches into the next file. A task
reads neighbouring files of up to ``TASK_TOKENS`` together, and is told of no others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK, FILE_TOKENS, TASK_TOKENS = 1 << 16, 1 << 25, 1 << 20
#: What a manifest must hold.
REQUIRED = ("schema_version", "token_count", "dtype", "files", "tokens_sha256", "tokens_bytes")


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    fs, at = arrow_fs.FileSystem.from_uri(path)
    return fs, at.rstrip("/")


def _sizes(fs: arrow_fs.FileSystem, folder: str) -> dict[str, int]:
    """Bytes of each file of a folder, by one listing."""
    return {info.base_name: info.size for info in fs.get_file_info(arrow_fs.FileSelector(folder)) if info.type == arrow_fs.FileType.File}


def _digest(files: list[dict]) -> str:
    return hashlib.sha256("\n".join(f["sha256"] for f in files).encode()).hexdigest()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class PackedWriter(DataSourceArrowWriter):
    """Rows (offset, ids) in order within each task; a gap within a task or between two raises."""

    def __init__(self, path: str, vocab_size: int, file_tokens: int, eos: int | None):
        self.path, self.vocab_size, self.file_tokens, self.eos = path, vocab_size, file_tokens, eos
        self.staging = f"{path}.staged-{uuid.uuid4().hex}"
        fs, at = _open(path)
        if fs.get_file_info(at).type != arrow_fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.staging)
        fs.create_dir(folder, recursive=True)
        done, out, own, sha, expected = [], None, {}, None, None

        def close() -> None:
            out.close()
            done.append(own | {"bytes": 4 * own["tokens"], "sha256": sha.hexdigest()})

        def put(data: np.ndarray) -> None:
            if len(data):
                out.write(data.tobytes())
                sha.update(data.tobytes())
                own["tokens"] += len(data)
                own["ends"] += int((data == self.eos).sum()) if self.eos is not None else 0

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            tokens = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            starts, sizes = batch.column("offset").to_numpy(zero_copy_only=False)[sizes > 0], sizes[sizes > 0]
            if not len(tokens):
                continue
            ends = starts + sizes
            due = np.append(starts[0] if expected is None else expected, ends[:-1])
            if (starts != due).any():
                k = int(np.argmax(starts != due))
                raise ValueError(f"rows do not join: {starts[k]} after {due[k]}")
            if tokens.min() < 0 or tokens.max() >= self.vocab_size:
                raise ValueError(f"a token is outside the vocabulary of {self.vocab_size}")
            expected, done_to, at = int(ends[-1]), 0, 0

            tokens = tokens.astype("<u4")
            for offset, size in zip(starts.tolist(), sizes.tolist()):
                for lo in range(0, size, self.file_tokens):
                    part = min(self.file_tokens, size - lo)
                    if out is None or own["tokens"] + at - done_to + part > self.file_tokens:
                        if out is not None:
                            put(tokens[done_to:at])
                            close()
                        done_to = at
                        name = f"tokens-{offset + lo:020d}-{uuid.uuid4().hex[:8]}.uint32"
                        out, own, sha = fs.open_output_stream(f"{folder}/{name}"), {"name": name, "first": offset + lo, "tokens": 0, "ends": 0}, hashlib.sha256()
                    at += part
            put(tokens[done_to:])
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        fs, folder = _open(self.staging)
        fs.create_dir(folder, recursive=True)
        at, sizes = 0, _sizes(fs, folder)
        for f in files:
            if f["first"] != at or sizes.get(f["name"]) != f["bytes"]:
                self.abort(messages)
                raise ValueError(f"packed files do not join at token {at}")
            at += f["tokens"]
        known = {f["name"] for f in files}
        for name in sizes.keys() - known:  # of tasks that were run twice
            fs.delete_file(f"{folder}/{name}")
        ends = sum(f.pop("ends") for f in files)
        manifest = {"schema_version": 1, "dtype": "uint32", "token_count": at, "tokens_bytes": 4 * at, "tokens_sha256": _digest(files), "tokenizer_vocab_size": self.vocab_size, "files": files}
        manifest |= {"eos_token_id": self.eos, "eos_token_count": ends, "discarded_remainder": 0} if self.eos is not None else {}
        for name, text in (("manifest.json", json.dumps(manifest)), ("COMPLETE", "complete\n")):
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write(text.encode())
        fs.move(folder, _open(self.path)[1])

    def abort(self, messages: list) -> None:
        fs, folder = _open(self.staging)
        if fs.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(folder)


def manifest_of(path: str) -> dict:
    """The manifest of a corpus that is complete and whose files have their lengths; else raises."""
    fs, folder = _open(path)
    if fs.get_file_info(f"{folder}/COMPLETE").type != arrow_fs.FileType.File:
        raise ValueError("packed corpus has no COMPLETE marker")
    if fs.get_file_info(f"{folder}/manifest.json").type != arrow_fs.FileType.File:
        raise FileNotFoundError(f"{path}/manifest.json")
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    missing = sorted(set(REQUIRED) - set(manifest))
    if missing:
        raise ValueError(f"packed manifest lacks {missing}")
    if manifest["dtype"] != "uint32":
        raise ValueError("packed tokens must be uint32")
    files = manifest["files"]
    if manifest["tokens_bytes"] != 4 * manifest["token_count"] or sum(f["tokens"] for f in files) != manifest["token_count"] or _digest(files) != manifest["tokens_sha256"]:
        raise ValueError("packed manifest does not fit itself")
    sizes = _sizes(fs, folder)
    for f in files:
        if f["bytes"] != 4 * f["tokens"] or sizes.get(f["name"]) != f["bytes"]:
            raise ValueError(f"{f['name']}: byte length does not match the manifest")
    return manifest


@dataclass
class _Files(InputPartition):
    """Neighbouring files, and those after them that the last windows reach into."""

    own: list[dict]
    after: list[dict]


class PackedReader(DataSourceReader):
    """A task for neighbouring files of ``TASK_TOKENS`` together, or a single larger one; tasks get their files' entries, not the manifest."""

    def __init__(self, path: str, seq_len: int | None):
        self.path, self.seq_len = path, seq_len
        manifest = manifest_of(path)
        self.files, self.top = manifest["files"], manifest.get("tokenizer_vocab_size")
        if seq_len is not None and (seq_len < 1 or manifest["token_count"] <= seq_len):
            raise ValueError("packed corpus is shorter than one training sequence")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": None}

    def partitions(self) -> list[_Files]:
        edges, held = [0], 0
        for k, f in enumerate(self.files):
            if held and held + f["tokens"] > TASK_TOKENS:
                edges.append(k)
                held = 0
            held += f["tokens"]
        edges.append(len(self.files))
        return [_Files(self.files[a:b], self._reached(b)) for a, b in zip(edges, edges[1:]) if a < b]

    def _reached(self, no: int) -> list[dict]:
        """Files from ``no`` on that hold the next seq_len + 1 tokens."""
        out, held = [], 0
        while self.seq_len is not None and no < len(self.files) and held <= self.seq_len:
            out.append(self.files[no])
            held += self.files[no]["tokens"]
            no += 1
        return out

    def _blocks(self, files: list[dict]) -> Iterator[np.ndarray]:
        """The files' tokens as they stream by; a file's hash is known at its end."""
        fs, folder = _open(self.path)
        for f in files:
            sha = hashlib.sha256()
            with fs.open_input_stream(f"{folder}/{f['name']}") as source:
                while data := source.read(4 * BLOCK):
                    sha.update(data)
                    tokens = np.frombuffer(data, "<u4")
                    if self.top is not None and int(tokens.max()) >= self.top:
                        raise ValueError(f"{f['name']}: a token is outside the vocabulary")
                    yield tokens
            if sha.hexdigest() != f["sha256"]:
                raise ValueError(f"{f['name']}: hash mismatch")

    def _head(self, files: list[dict], n: int) -> np.ndarray:
        """The first n tokens of the files."""
        fs, folder = _open(self.path)
        got = np.zeros(0, "<u4")
        for f in files:
            if len(got) >= n:
                break
            with fs.open_input_stream(f"{folder}/{f['name']}") as source:
                got = np.append(got, np.frombuffer(source.read(4 * (n - len(got))), "<u4"))
        return got

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        at, kept = partition.own[0]["first"], np.zeros(0, "<u4")
        if self.seq_len is None:
            for tokens in self._blocks(partition.own):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([tokens.astype("i8")], pa.list_(pa.int64()))], ["offset", "ids"])
                at += len(tokens)
            return
        s = self.seq_len
        start = -(-at // s) * s  # of the first window that begins here
        end = partition.own[-1]["first"] + partition.own[-1]["tokens"]

        def windows(last: int) -> Iterator[pa.RecordBatch]:
            nonlocal start
            n = max(0, (last - start - 1) // s)  # full windows that begin in these files
            n = min(n, max(0, -(-(end - start) // s)))
            if n:
                lo = start - at
                own = np.lib.stride_tricks.sliding_window_view(kept[lo : lo + n * s + 1].astype("i8"), s + 1)[::s]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), s).cast(pa.list_(pa.int64())) for x in (own[:, :-1], own[:, 1:])]
                yield pa.RecordBatch.from_arrays([pa.array(start // s + np.arange(n)), *lists], ["index", "input_ids", "labels"])
                start += n * s

        for tokens in self._blocks(partition.own):
            kept = np.append(kept, tokens)
            yield from windows(at + len(kept))
            drop = min(len(kept), max(0, start - at))
            kept, at = kept[drop:], at + drop
        kept = np.append(kept, self._head(partition.after, s + 1))
        yield from windows(at + len(kept))


class PackedTokens(DataSource):
    """``packed_tokens``: options path; seq_len to read examples; vocab_size, file_tokens, eos to write."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return "index long, input_ids array<long>, labels array<long>" if self.options.get("seq_len") else "offset long, ids array<long>"

    def reader(self, schema) -> PackedReader:
        s = self.options.get("seq_len")
        return PackedReader(self.options["path"], int(s) if s else None)

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        if overwrite:
            raise ValueError("a packed corpus is never replaced; write in append mode to a new path")
        eos = self.options.get("eos")
        return PackedWriter(self.options["path"], int(self.options.get("vocab_size", 1 << 32)), int(self.options.get("file_tokens", FILE_TOKENS)), int(eos) if eos is not None else None)


def write_packed(stream: DataFrame, path: str, vocab_size: int, eos: int | None = None, file_tokens: int = FILE_TOKENS) -> dict:
    """The stream's rows (offset, ids) as a packed corpus; its manifest."""
    spark = stream.sparkSession
    spark.dataSource.register(PackedTokens)
    rows = stream.selectExpr("CAST(offset AS BIGINT) AS offset", "CAST(ids AS ARRAY<BIGINT>) AS ids").where("size(ids) > 0")
    dealt = rows.repartitionByRange("offset").sortWithinPartitions("offset")
    out = dealt.write.format("packed_tokens").mode("append").option("vocab_size", vocab_size).option("file_tokens", file_tokens)
    (out.option("eos", eos) if eos is not None else out).save(path)
    return manifest_of(path)


def read_packed(spark: SparkSession, path: str, seq_len: int | None = None) -> DataFrame:
    spark.dataSource.register(PackedTokens)
    source = spark.read.format("packed_tokens")
    return (source.option("seq_len", seq_len) if seq_len else source).load(path)
