"""Shared plumbing: the cluster's shared folder, tables written there to cut
lineage, and a word-level memo over a public tokenizer."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Shuffle files end with the job that made them, not when the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine (tests) a temporary
    folder is set; on a cluster that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Jobs run inside drop their shuffle files when they end."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def _written(df: DataFrame, path: str, options: dict) -> DataFrame:
    with shuffles_end(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage. The table stays."""
    return _written(df, scratch(df.sparkSession, what), options)


class Scratch:
    """A call's intermediate tables in the shared folder, deleted when the call ends or fails.

    What the call returns must not read them: it is written by ``materialise``.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.paths = spark, scratch(spark, what), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.root)

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        out = _written(df, path, options)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing to come reads."""
        for t in tables:
            drop_path(self.spark, self.paths[id(t)][0])


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's own file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str):
    """The column of exactly this name, dots or not."""
    return F.col("`" + name.replace("`", "``") + "`")


def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim, or nothing where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


_malloc_trim = _trim()


def tidy() -> None:
    """Give freed memory back: workers are kept for later stages, whose memory comes on top."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


def tidily(fn):
    """A function over batches that tidies at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return run


def map_batches(df: DataFrame, fn, added: StructField, n: int | None = None) -> DataFrame:
    """``df.mapInArrow(fn)`` to its first ``n`` columns (all by default) and one more, whatever they are called.

    ``fn`` sees and gives columns by their places.
    """
    fields = df.schema.fields[:n]
    out = StructType([*(StructField(f"c{k}", f.dataType, True) for k, f in enumerate(fields)), StructField("added", added.dataType)])
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(tidily(fn), out).toDF(*(f.name for f in fields), added.name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of whole texts by the ``tokenizers`` library, remembering words.

    The tokenizer drops white space and no token reaches over it, so a text's
    ids are those of its ASCII-space separated chunks, one after the other.
    A chunk is encoded when it is first met and kept as little-endian uint32
    bytes. A chunk of Latin-1 letters and then ASCII marks is in normal form
    and splits into just these two, which go to the library's model; all others
    go through its whole pipeline. Two generations of at most ``most`` chunks
    bound the memory.
    """

    LETTERS = staticmethod(re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch)
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        gc.set_threshold(200_000, 50, 100)  # bytes make no cycles; scanning for them costs a fifth of the time
        self.tok, self.most, self.older, self.cores = Tokenizer.from_file(path), most, {}, {}
        self.model, self.alphabet = self.tok.model, _byte_letters()
        self.whole = any(a.content.rstrip(self.MARKS.decode()).isalpha() for a in self.tok.get_added_tokens_decoder().values())

    def _core(self, part: bytes) -> bytes:
        """Ids of one piece in UTF-8 that the splitting pattern leaves whole."""
        ids = self.cores.get(part)
        if ids is None:
            if len(self.cores) >= self.most:
                self.cores.clear()
            seen = part.decode("latin-1")
            ids = self.cores[part] = array("I", [t.id for t in self.model.tokenize(seen if part.isascii() else seen.translate(self.alphabet))]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(self.MARKS)
            if len(word) >= 200 or not core or self.whole:
                plain = False
            elif core.isalpha():  # ASCII letters alone
                plain, core_lower = True, core.lower()
            else:
                text = core.decode()
                plain = self.LETTERS(text)
                core_lower = text.lower().encode()
            if plain:
                ids = self._core(core_lower)
                if len(core) < len(word):
                    ids += self._core(word[len(core) :])
            else:
                ids = np.array(self.tok.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """The ids of one text as little-endian uint32."""
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = 150_000) -> WordEncoder:
    """One encoder for each Python worker and vocabulary file, which remembers ``most`` words in each generation."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, most)
    _encoders[path].most = most
    return _encoders[path]
