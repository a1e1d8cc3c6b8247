"""Byte-level BPE: trained from counts of pieces in Spark, merge for merge as the
``tokenizers`` library trains it, at any size in the same way.

Pieces stay in a distributed table of token numbers. Training goes in phases. A
phase takes the most frequent pairs of neighbours and cuts every piece where it
has another pair: until a pair at the bound comes up, no merge reaches over a cut,
as a pair that a merge makes is at most as frequent as the pair at its seam. What
is left between cuts are few different segments, however many pieces there are;
Spark counts them, the driver merges them (their size is bounded, see ``train``),
and the pieces' table is written anew with the phase's merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from ..sources.stage import Staging

#: Fixed value: the byte-level splitting pattern, with Unicode's white space spelt out.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Special tokens of the plain tokenizer, and of the one for training assets.
SPECIAL = ("<pad>", "<unk>", "<bos>", "<eos>")
ASSET_SPECIAL = SPECIAL + ("<tool_call>", "<tool_result>", "<scratchpad>", "</scratchpad>", "<evidence>", "</evidence>")


def letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else one from 256 on."""
    out, more = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out.append(chr(b if plain else more))
        more += not plain
    return out


def _prefixed(text: Column) -> Column:
    """A space goes before a text that does not begin with one."""
    return F.when((text == "") | F.startswith(text, F.lit(" ")), text).otherwise(F.concat(F.lit(" "), text))


def holds_special(text: Column, special: tuple[str, ...] = SPECIAL) -> Column:
    """Whether a special token stands in a text."""
    return F.coalesce(reduce(Column.__or__, (F.contains(text, F.lit(s)) for s in special)), F.lit(False))


def pretoken_counts(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """piece and n, after the columns ``by`` if there are some; combined before the shuffle. Null texts have none."""
    text = _prefixed(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    pieces = F.explode(F.regexp_extract_all(text, F.lit(f"({PRETOKEN})"), 1)).alias("piece")
    return docs.select(*by, pieces).groupBy(*by, "piece").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Special tokens, then single bytes, then merged tokens in the order in which they were first made.

    Of a pair that is merged twice the later rank counts.
    """

    special: tuple[str, ...]
    alphabet: tuple[int, ...]
    merges: tuple[tuple[bytes, bytes], ...]

    @cached_property
    def tokens(self) -> list[bytes]:
        """Each id's token."""
        own = dict.fromkeys([*(bytes([b]) for b in self.alphabet), *(a + b for a, b in self.merges)])
        return [s.encode() for s in self.special] + list(own)

    @cached_property
    def ids(self) -> dict[bytes, int]:
        """Ids of bytes and merged tokens."""
        return {t: k for k, t in enumerate(self.tokens) if k >= len(self.special)}

    @cached_property
    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Of each pair of ids its rank and the id it becomes."""
        return {(self.ids[a], self.ids[b]): (k, self.ids[a + b]) for k, (a, b) in enumerate(self.merges)}

    def special_id(self, token: str) -> int | None:
        return self.special.index(token) if token in self.special else None


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token numbers of a column of int32 bytes, and where each row's begin (n + 1)."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype("i8") // 4
    data = column.buffers()[2]
    data = np.frombuffer(data, "<i4") if data is not None and data.size else np.zeros(0, "i4")
    return data[off[0] : off[-1]], off - off[0]


def _binary(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """The opposite of ``_flat``."""
    off = (4 * off).astype("i4")
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat, "<i4"))])


def _pairs(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each number and the one after it their pair as one key, and whether both are in one row."""
    inside = np.ones(max(0, len(flat) - 1), bool)
    ends = off[1:-1]
    inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    return flat[:-1].astype("i8") << 32 | flat[1:], inside


def _segments(column: pa.Array, allowed: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Rows cut at pairs other than ``allowed`` (sorted keys): segments, their rows, and their lengths."""
    flat, off = _flat(column)
    key, link = _pairs(flat, off)
    link &= allowed[np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)] == key
    starts = np.flatnonzero(np.append(True, ~link)) if len(flat) else np.zeros(0, "i8")
    cuts = np.append(starts, len(flat))
    return _binary(flat, cuts), np.searchsorted(off, starts, "right") - 1, np.diff(cuts)


def merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]], in_order: bool = False) -> list[int]:
    """Pairs of the lowest rank first, from the left; n log n.

    in_order: as in training, where a pair that a merge makes is not merged by an earlier one.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    out, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*ranks[p], k, p) for k, p in enumerate(zip(out, out[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        rank, new, k, pair = heapq.heappop(heap)
        j = after[k] if out[k] >= 0 else n
        if j >= n or (out[k], out[j]) != pair:
            continue
        out[k], out[j] = new, -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        for i in (before[k], k):
            if i >= 0 and after[i] < n:
                p = (out[i], out[after[i]])
                found = ranks.get(p)
                if found and not (in_order and found[0] < rank):
                    heapq.heappush(heap, (*found, i, p))
    return [x for x in out if x >= 0]


@dataclass
class _Training:
    """Token names by number, the merges so far, and what merged pairs' counts are still off by.

    A merge leaves its pair's count as it is, less its overlaps; where a later merge
    makes a token that there was already, and so that pair again, the rest adds to
    it, and the pair is merged once more.
    """

    names: list[bytes | None]
    min_count: int
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    left: dict[tuple[int, int], int] = field(default_factory=dict)
    again: bool = False
    over: bool = False

    def __post_init__(self):
        self.number = {t: k for k, t in enumerate(self.names) if t is not None}

    def run(self, segments: Iterable[tuple[array, int]], floor: tuple[int, tuple[int, int]] | None, vocab: int) -> list[tuple[int, int, int]]:
        """Merge segments (numbers, count) until a pair at ``floor`` or after it comes up; also at a token made once more.

        Pairs are recounted only in segments that a merge changes. The heap's
        counts are never too low: a pair that lost some goes back when it comes up.
        """
        flat, start, size, times = array("i"), array("q"), array("i"), array("q")
        pairs: dict[tuple[int, int], int] = defaultdict(int)
        where: dict[tuple[int, int], array] = defaultdict(lambda: array("i"))
        for k, (symbols, n) in enumerate(segments):
            start.append(len(flat))
            size.append(len(symbols))
            times.append(n)
            flat.extend(symbols)
            for p in zip(symbols, symbols[1:]):
                pairs[p] += n
                where[p].append(k)
        if self.again:
            for p in pairs.keys() & self.left.keys():
                pairs[p] += self.left[p]
        heap = [(-n, p) for p, n in pairs.items()]
        heapq.heapify(heap)
        first = len(self.merges)
        while heap and len(self.names) < vocab:
            n, best = heapq.heappop(heap)
            now = pairs.get(best, 0)
            if now != -n:
                if now:
                    heapq.heappush(heap, (-now, best))
                continue
            if floor and (n, best) >= floor:
                break
            if now < max(1, self.min_count):
                self.over = True
                break
            both = self.names[best[0]] + self.names[best[1]]
            new = self.number.get(both)
            known = new is not None
            if not known:
                new = self.number[both] = len(self.names)
                self.names.append(both)
            self.merges.append((*best, new))
            made, overlaps = set(), 0
            for k in set(where.pop(best)):
                at, times_k = start[k], times[k]
                w = flat[at : at + size[k]]
                out, i = array("i"), 0
                while i < len(w):
                    if i + 1 < len(w) and (w[i], w[i + 1]) == best:
                        out.append(new)
                        i += 2
                        overlaps += times_k * (best[0] == best[1] and i < len(w) and w[i] == best[0])
                    else:
                        out.append(w[i])
                        i += 1
                if len(out) == len(w):  # an earlier merge took the pair
                    continue
                flat[at : at + len(out)], size[k] = out, len(out)
                for p in zip(w, w[1:]):
                    pairs[p] -= times_k
                for p in zip(out, out[1:]):
                    pairs[p] += times_k
                    if new in p:
                        made.add(p)
                        where[p].append(k)
                for p in zip(w, w[1:]):
                    if pairs.get(p) == 0:
                        del pairs[p]
                        where.pop(p, None)
            pairs.pop(best, None)
            self.left[best] = now - overlaps
            if known:
                self.again = True
                break
            for p in made & pairs.keys():
                heapq.heappush(heap, (-pairs[p], p))
            if len(heap) > 2 * len(pairs) + 1000:
                heap = [(-c, p) for p, c in pairs.items()]
                heapq.heapify(heap)
        return self.merges[first:]


def train(counts: DataFrame, vocab: int, special: tuple[str, ...] = SPECIAL, all_bytes: bool = False, min_count: int = 0, most_symbols: int = 1_000_000, most_pairs: int = 1 << 16) -> Vocabulary:
    """A vocabulary of ``vocab`` entries (fewer where no pair is left) from piece and n, all pieces counting.

    The most frequent pair first, of equals the one of lower ids. all_bytes: every
    byte has an id, else those that occur. A phase looks at ``most_pairs`` pairs,
    fewer where its segments would hold more than ``most_symbols`` numbers together
    (one pair's runs are taken at any size), which bounds the driver's memory.
    """
    spark = counts.sparkSession
    with Staging(spark, "bpe") as stage:

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            has = np.zeros(256, bool)
            for batch in batches:
                data = batch.column(0).buffers()[2]
                has[np.frombuffer(data, "u1") if data is not None else []] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(has).astype("i4"))], ["byte"])

        counts = stage.table(counts.select(F.col("piece").cast("string").alias("piece"), F.col("n").cast("long").alias("n")))
        used = range(256) if all_bytes else [r[0] for r in counts.select(F.col("piece").cast("binary")).mapInArrow(seen, "byte int").distinct().collect()]
        letter = letters()
        alphabet = sorted(used, key=lambda b: letter[b])
        state = _Training([None] * len(special) + [bytes([b]) for b in alphabet], min_count)
        of = np.full(256, -1, "i4")
        of[alphabet] = np.arange(len(special), len(special) + len(alphabet))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype("i8")
                data = np.frombuffer(column.buffers()[2] or b"", "u1")[off[0] : off[-1]]
                yield pa.RecordBatch.from_arrays([_binary(of[data], off - off[0]), batch.column(1)], ["symbols", "n"])

        # of one byte a piece has no pair; bytes reach Python as UTF-8 of the pieces
        pieces = stage.table(counts.where(F.octet_length("piece") > 1).select(F.col("piece").cast("binary"), "n").mapInArrow(numbered, "symbols binary, n long"))
        k = most_pairs
        while len(state.names) < vocab and not state.over:
            top = _top_pairs(pieces, state, k + 1)
            if not top:
                break
            while True:
                allowed = np.sort(np.array([p for p, _ in top[:k]], "i8"))
                segments = stage.table(pieces.mapInArrow(_cut(allowed), "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n")))
                if k == 1 or (segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) <= 4 * most_symbols:
                    break
                k = max(1, k // 4)
            floor = (-top[k][1], divmod(top[k][0], 1 << 32)) if len(top) > k else None
            found = segments.toArrow()
            rows = zip(found.column("segment").to_pylist(), found.column("n").to_pylist())
            new = state.run(((array("i", s), n) for s, n in rows), floor, vocab)
            if not new or len(state.names) >= vocab:
                break
            pieces = stage.table(pieces.mapInArrow(_applied(allowed, {(a, b): (r, c) for r, (a, b, c) in enumerate(new)}), "symbols binary, n long"))
            stage.drop_before(pieces)
            k = min(most_pairs, 2 * k)
        return Vocabulary(special, tuple(alphabet), tuple((state.names[a], state.names[b]) for a, b, _ in state.merges))


def _top_pairs(pieces: DataFrame, state: _Training, most: int) -> list[tuple[int, int]]:
    """(pair's key, count) of the ``most`` most frequent pairs, of equals the lower key first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = _flat(batch.column(0))
            key, inside = _pairs(flat, off)
            times = np.repeat(batch.column(1).to_numpy(), np.diff(off))[:-1]
            own = pa.table({"pair": key[inside], "n": times[inside]}).group_by("pair").aggregate([("n", "sum")])
            yield from own.rename_columns(["pair", "n"]).combine_chunks().to_batches()

    found = pieces.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    if state.again:  # at most one row for each merge
        left = pieces.sparkSession.createDataFrame([((a << 32) | b, n) for (a, b), n in state.left.items()], "pair long, more long")
        found = found.join(F.broadcast(left), "pair", "left").select("pair", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    got = found.orderBy(F.desc("n"), "pair").limit(most).toArrow()
    return list(zip(got.column("pair").to_pylist(), got.column("n").to_pylist()))


def _cut(allowed: np.ndarray):
    """Segments of two numbers or more and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, rows, lengths = _segments(batch.column(0), allowed)
            long = pa.array(lengths > 1)
            own = pa.table({"segment": segments.filter(long), "n": batch.column(1).take(pa.array(rows)).filter(long)}).group_by("segment").aggregate([("n", "sum")])
            yield from own.rename_columns(["segment", "n"]).combine_chunks().to_batches()

    return run


def _applied(allowed: np.ndarray, ranks: dict[tuple[int, int], tuple[int, int]]):
    """Pieces after a phase's merges, those that still have a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            segments, rows, _ = _segments(batch.column(0), allowed)
            coded = segments.dictionary_encode()
            done = pa.array([merged(array("i", s).tolist(), ranks, in_order=True) for s in coded.dictionary.to_pylist()], pa.list_(pa.int32())).take(coded.indices)
            sizes = np.bincount(rows, np.diff(done.offsets.to_numpy()), batch.num_rows).astype("i8")
            out = _binary(done.flatten().to_numpy(), np.append(0, np.cumsum(sizes)))
            some = pa.array(sizes > 1)
            yield pa.RecordBatch.from_arrays([out.filter(some), batch.column(1).filter(some)], ["symbols", "n"])

    return run


class Encoder:
    """Ids of texts as the library gives them; remembers at most ``most`` pieces."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        import regex

        self.v, self.most, self.memo = vocabulary, most, {}
        self.split = regex.compile(PRETOKEN)
        self.unknown = vocabulary.special_id("<unk>")
        self.by_byte = [vocabulary.ids.get(bytes([b]), self.unknown) for b in range(256)]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def piece(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            ids = self.memo[piece] = merged([self.by_byte[b] for b in piece.encode() if self.by_byte[b] is not None], self.v.ranks)
        return ids

    def __call__(self, text: str, ends: bool = False) -> list[int]:
        """Special tokens in the text are ids of their own. ends: <bos> before and <eos> after."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.v.special_id(part))
            elif part:
                for piece in self.split.findall(part if part[0] == " " else " " + part):
                    out += self.piece(piece)
        return [self.v.special_id("<bos>"), *out, self.v.special_id("<eos>")] if ends else out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", ends: bool = False) -> DataFrame:
    """doc_id and tokens, a row a row; a null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own(t or "", ends) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens array<int>")


def counted(rows: DataFrame, vocabulary: Vocabulary, text_col: str = "text", name: str = "tokens", pieces: bool = False) -> DataFrame:
    """``rows`` with the number of their texts' ids as column ``name``, 0 of a null text. pieces: each text is a piece of ``pretoken_counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)
        ids = own.piece if pieces else own
        for batch in batches:
            n = [len(ids(t or "")) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0).cast("long")).schema)


def decode(tokens: list[int], vocabulary: Vocabulary, skip_special: bool = True) -> str:
    """The text of ids; bytes that are no UTF-8 give the replacement character."""
    first = len(vocabulary.special) if skip_special else 0
    return b"".join(vocabulary.tokens[t] for t in tokens if t >= first).decode("utf-8", "replace")


def decode_rows(rows: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", name: str = "text", skip_special: bool = True) -> DataFrame:
    """``rows`` with the text of their ids as column ``name``; null tokens give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else decode(t, vocabulary, skip_special) for t in batch.column(batch.schema.get_field_index(tokens)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit("")).schema)


def save(spark, vocabulary: Vocabulary, path: str) -> str:
    """Bytes and merges and, beside them, their digest, the vocabulary's size and the special tokens' ids. Never overwrites."""
    body = writers.canonical_json({"alphabet": list(vocabulary.alphabet), "merges": [[a.hex(), b.hex()] for a, b in vocabulary.merges]})
    digest = hashlib.sha256(body.encode()).hexdigest()
    meta = {"schema_version": 1, "tokenizer_sha256": digest, "vocab_size": len(vocabulary.tokens), "special_tokens": {t: k for k, t in enumerate(vocabulary.special)}}
    writers.write_text(spark, f"{path}/merges.json", body)
    writers.write_text(spark, f"{path}/metadata.json", writers.canonical_json(meta))
    return digest


def load(spark, path: str) -> Vocabulary:
    """What ``save`` wrote; a digest, size or special token's id that does not fit raises."""
    body, meta = (spark.read.text(f"{path}/{name}.json", wholetext=True).first()[0] for name in ("merges", "metadata"))
    meta = json.loads(meta)
    if hashlib.sha256(body.encode()).hexdigest() != meta["tokenizer_sha256"]:
        raise ValueError("merges do not match their digest")
    own, special = json.loads(body), meta["special_tokens"]
    if sorted(special.values()) != list(range(len(special))):
        raise ValueError("special tokens' ids do not match")
    out = Vocabulary(tuple(sorted(special, key=special.get)), tuple(own["alphabet"]), tuple((bytes.fromhex(a), bytes.fromhex(b)) for a, b in own["merges"]))
    if meta["vocab_size"] != len(out.tokens):
        raise ValueError("the vocabulary's size does not match")
    return out
