"""Ranked lexical search: an index of compressed postings by shard, searched
document by document.

A shard is a run of about 16 MB of the texts that one task reads, so indexing
shuffles nothing. For each of its terms it holds postings in ascending doc_id,
as gaps and term frequencies in variable-length bytes, and one table of its
documents' ids and lengths. A search takes the items in blocks of a bounded
size; each shard's postings of a block's terms meet in one task, whose size is
bounded by the shard. There each item's lists are merged by a heap of their
heads, one document at a time, into a bounded heap of results keyed by score,
then doc_id. Lists whose greatest possible sum can't lift a document over the
tenth score leave the merge and are only looked up (no document that belongs to
the result is lost by that). The shards' results are merged by rank.

Scores are whole numbers (see ``weight``, ``scaled_length``), so the order of
sums does not matter.

Null texts hold no term; documents without a term count nowhere. A row is a
document, so repeated rows are ranked each on its own, and rows of an equal score
come by doc_id; a null doc_id counts as the largest one. Rows of ``items`` that
repeat an id and a text are one item; rows that share only the id are ranked each
on its own. Items without a known term and empty tables give no rows. Texts may be
of any length; a text beyond a shard's size is a shard of its own. Other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import Scratch, materialise, tidily, tidy
from .terms import LETTERS_DIGITS, counted, even_slices, terms

SHARD_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
MOST_TASKS = 1 << 16  # more shards than that share tasks, one after the other
LAST = (1 << 63) - 1  # stands for a null doc_id
INDEX = "shard long, term binary, df long, n_terms long, postings binary"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian groups of seven bits, the last without the high bit; and where each value begins (n + 1)."""
    values = values.astype("u8")
    n = np.ones(len(values), "i8")
    rest = values >> np.uint64(7)
    while rest.any():
        n += rest > 0
        rest >>= np.uint64(7)
    at = np.append(0, np.cumsum(n))
    out = np.zeros(at[-1], "u1")
    for k in range(int(n.max()) if len(n) else 0):
        has = n > k
        out[at[:-1][has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)) | ((n[has] > k + 1).astype("u8") << np.uint64(7))
    return out, at


def values_of(data: bytes) -> np.ndarray:
    """The values that ``varints`` wrote, as int64."""
    b = np.frombuffer(data, "u1")
    if not len(b):
        return np.zeros(0, "i8")
    ends = np.flatnonzero(b < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype("u8") << (7 * place).astype("u8"), starts).astype("i8")


def _shard(doc_ids: np.ndarray, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, bytes, int, int]:
    """Terms in byte order, each one's documents and postings, the table of documents, their number, and that of all terms."""
    own, before = terms(texts, LETTERS_DIGITS)
    lengths = np.diff(before)
    some = np.flatnonzero(lengths)
    some = some[np.argsort(doc_ids[some], kind="stable")]
    place = np.zeros(len(lengths), "i8")
    place[some] = np.arange(len(some))
    gaps = np.diff(doc_ids[some].astype("u8"), prepend=np.uint64(0))  # modulo 2^64, so any two ids
    table = varints(np.concatenate([gaps, lengths[some].astype("u8")]))[0].tobytes()
    coded = own.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    key, tf = counted(rank[coded.indices.to_numpy()] * max(1, len(some)) + np.repeat(place, lengths))
    term, doc = key // max(1, len(some)), key % max(1, len(some))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    data, at = varints(np.stack([gap, tf], 1).ravel())
    cuts = np.append(at[2 * first], len(data))
    postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    return coded.dictionary.take(pa.array(order)), np.diff(np.append(first, len(term))), postings, table, len(some), int(lengths.sum())


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Postings by shard and term; the row of the empty term is the shard's table of documents, with its number of terms.

    Lazy: write it before it is searched more than once.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in even_slices(batch, 1, shard_bytes):
                term, df, postings, table, n_docs, n_terms = _shard(part.column(0).to_numpy(zero_copy_only=False), part.column(1))
                columns = [pa.concat_arrays([pa.array([b""], pa.large_binary()), term]), np.append(n_docs, df), np.append(n_terms, np.zeros(len(df), "i8")), pa.concat_arrays([pa.array([table], pa.large_binary()), postings])]
                shard = np.full(len(df) + 1, no)
                out = pa.RecordBatch.from_arrays([pa.array(shard), columns[0], pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), columns[3]], ["shard", "term", "df", "n_terms", "postings"])
                yield from (out.slice(k, 50_000) for k in range(0, len(shard), 50_000))
                no += 1

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = StructType([StructField("shard", LongType()), StructField("term", BinaryType()), StructField("df", LongType()), StructField("n_terms", LongType()), StructField("postings", BinaryType())])
    return rows.mapInArrow(tidily(lambda batches: (_small(b, kind) for b in build(batches))), INDEX)


def _small(batch: pa.RecordBatch, kind: StructType) -> pa.RecordBatch:
    """Binary columns with 32-bit offsets, as Spark's ``binary`` is by default."""
    return pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in batch.columns], kind.names)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def scaled_length(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's length against the mean: 100 - 75 + 75 n N div L, for any size of the corpus."""
    if len(lengths) and int(lengths.max()) * 75 * n_docs >= 1 << 62:
        return np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], "i8")
    return 25 + 75 * lengths * n_docs // max(1, n_terms)


def best_documents(lists: list[tuple[int, Sequence[int], Sequence[int]]], most: int) -> list[tuple[int, int]]:
    """The ``most`` best (score, document): the score sums factor * value over the lists (factor, documents ascending, values) that hold it."""
    lists = sorted((factor * max(values), factor, docs, values) for factor, docs, values in lists if docs and factor > 0)
    bounds, sums = [], 0
    for top, *_ in lists:
        bounds.append(sums := sums + top)
    at, rare = [0] * len(lists), 0  # lists before ``rare`` can't make a result by themselves
    heads = [(docs[0], j) for j, (_, _, docs, _) in enumerate(lists)]
    heapify(heads)
    best: list[tuple[int, int]] = []  # a heap of (score, -document)
    least = 0
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            j = heads[0][1]
            _, factor, docs, values = lists[j]
            if j < rare:
                heappop(heads)
                continue
            k = at[j]
            score += factor * values[k]
            at[j] = k = k + 1
            if k < len(docs):
                heapreplace(heads, (docs[k], j))
            else:
                heappop(heads)
        if not score:
            continue
        for j in range(rare - 1, -1, -1):
            if score + bounds[j] <= least:
                break
            _, factor, docs, values = lists[j]
            at[j] = k = bisect_left(docs, doc, at[j])
            if k < len(docs) and docs[k] == doc:
                score += factor * values[k]
        if score > least or len(best) < most:
            if len(best) < most:
                heappush(best, (score, -doc))
            else:
                heapreplace(best, (score, -doc))
            if len(best) == most:
                least = best[0][0]
                while rare < len(lists) and bounds[rare] <= least:
                    rare += 1
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _search_shard(table: pa.Table, items: list[tuple[int, list[tuple[bytes, int]]]], n_docs: int, n_terms: int, most: int) -> tuple[list, list, list]:
    """(items, doc_ids, scores) of one shard's best documents for each item."""
    own = dict(zip(table.column("term").to_pylist(), table.column("postings")))
    docs = values_of(own.pop(b"").as_py())
    ids, lengths = np.cumsum(docs[: len(docs) // 2]), docs[len(docs) // 2 :]
    scale = 8 * scaled_length(lengths, n_docs, n_terms)
    lists = {}
    for term, postings in own.items():
        gap_tf = values_of(postings.as_py()).reshape(-1, 2)
        doc = np.cumsum(gap_tf[:, 0])
        tf = gap_tf[:, 1]
        lists[term] = array("q", doc.tobytes()), array("q", (1_000_000_000 * tf // (1000 * tf + scale[doc])).tobytes())
    out: tuple[list, list, list] = [], [], []
    for no, factors in items:
        for score, doc in best_documents([(f, *lists[t]) for t, f in factors if t in lists], most):
            if score > 0:
                out[0].append(no)
                out[1].append(int(ids[doc]))
                out[2].append(score)
    return out


def _shard_search(items, n_docs, n_terms, most):
    """``_search_shard`` of given items, as a function from table to table."""

    def run(table):
        got = _search_shard(table, items, n_docs, n_terms, most)
        tidy()
        return pa.table([pa.array(x, pa.int64()) for x in got], ["item", "doc_id", "score"])

    return run


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The distinct (id, text) of ``items`` in blocks of about ``block_bytes`` of text, dealt by a hash; a longer text alone.

    One block is on the driver at a time; a block that comes out over twice the bound halves them all.
    """
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    sized = own.withColumn("bytes", F.octet_length("text"))
    n = -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // block_bytes)
    while n:
        block = F.pmod(F.xxhash64("text"), F.lit(n))
        full = sized.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        if full.where(f"bytes - largest > {2 * block_bytes}").isEmpty():
            break
        n *= 2
    for k in range(n):
        yield own.where(block == k).toArrow()


def search(indexed: DataFrame, items: DataFrame, most: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``most`` best documents of a written index."""
    spark = indexed.sparkSession
    known = indexed.where(F.col("term") == F.lit(b"")).agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count("*")).first()
    n_docs, n_terms, n_shards = int(known[0]), int(known[1]), int(known[2])
    kind = items.schema[id_col].dataType
    schema = StructType([StructField("item", LongType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    found = []
    for block in blocks(items, id_col, text_col, block_bytes) if n_docs else ():
        own = []
        for text in block.column("text").combine_chunks().to_pylist():
            all_terms, _ = terms(pa.array([text], pa.large_string()), LETTERS_DIGITS)
            own.append(Counter(all_terms.to_pylist()))
        names = sorted(set().union(*own))
        asked = spark.createDataFrame(pa.table({"term": pa.array(names, pa.binary())}))  # block_bytes of terms at most, or one item's
        df = dict(map(tuple, indexed.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df")).collect()))
        weights = {bytes(t): weight(n_docs, d) for t, d in df.items()}
        work = [(no, [(t, weights[t] * n) for t, n in sorted(c.items()) if weights.get(t)]) for no, c in enumerate(own)]
        also = spark.createDataFrame(pa.table({"term": pa.array([b"", *names], pa.binary())}))
        by_shard = indexed.select("shard", "term", "postings").join(F.broadcast(also), "term").repartition(min(n_shards, MOST_TASKS), "shard").groupBy("shard").applyInArrow(_shard_search(work, n_docs, n_terms, most), schema)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id")))
        top = by_shard.withColumn("rank", rank).where(F.col("rank") <= most)
        names_of = spark.createDataFrame(pa.table({"item": pa.array(range(block.num_rows), pa.int64()), "id": block.column("id")}), StructType([StructField("item", LongType()), StructField("id", kind)]))
        found.append(top.join(F.broadcast(names_of), "item").select(F.col("id").alias(id_col), "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score"))
    if not found:
        return spark.createDataFrame([], StructType([StructField(id_col, kind)])).selectExpr(f"`{id_col}`", "0 AS rank", "0L AS doc_id", "0L AS score")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ranked_documents(docs: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """Index ``docs``, search ``items``; the index goes with the call."""
    with Scratch(docs.sparkSession, "lexical") as tables:
        return materialise(search(tables.table(index(docs), "index"), items, most), "ranked")
