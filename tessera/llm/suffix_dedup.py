"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes if a string of SPAN bytes that covers it also starts in a document
with a smaller doc_id. Sorting every suffix of the corpus would shuffle many
times its size, so only the suffixes that matter are sorted:

1. Exact copies of a text are told by digest; the smallest doc_id's text stands
   for all, and its copies go whole. The distinct texts are written once, as a
   table bucketed by block.
2. Each window of SPAN bytes has an anchor: the place of its least K-gram hash
   (leftmost of equals). The anchor depends on the window's bytes alone, so equal
   windows have equal anchors. A block sends the hashes of its anchors, each
   once; hashes that two blocks have, or two documents of a block, go on.
3. For these, the block sends each different context (the bytes of all windows
   that share the anchor) once, with its smallest doc_id. A context is a suffix
   cut where its windows end. Contexts of an anchor hash meet in one task and are
   sorted deep-shallow: a refinement sort (lexsort on 8-byte characters) to a
   shallow depth, then blind tries for groups with longer common prefixes. Where an anchor
   has different contexts, the windows' suffixes are sorted likewise.
4. Windows whose smallest doc_id is smaller than the context's own go back to the
   block as bit masks, and the covered bytes are removed.

A string that a third of all documents hold is sent once a block, not once a
document. An anchor with more than HOT_CONTEXTS contexts (the edges of a string
that many documents hold have as many) does not meet in one task: its windows go
as 128-bit hashes, whose least doc_id is an aggregate combined
before the shuffle and joined back to the blocks. All other windows are compared
byte by byte; hashes only bring them together.

Null, empty and shorter texts lose nothing; texts of any length are taken whole,
in parts of CHUNK bytes; a null doc_id counts as the greatest long; rows that
repeat a doc_id are one document, so nothing is removed for a match between them
(rows that repeat as a whole get the same result). An empty table gives an empty
result. Other columns are ignored, or pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .bytewords import BASE, BYTE, U, buffers, mix
from .shared import Scratch, free_name, id_text, map_batches, materialise, quoted, shuffles_end, tidily, tidy

SPAN, K, SHALLOW = 50, 24, 16
REACH = SPAN - K + 1
BLOCK_BYTES, RANGE_BYTES, BLOCKS_PER_BUCKET, RANGES_PER_TASK = 4 << 20, 6 << 20, 4, 4
HOT_CONTEXTS = RANGE_BYTES // 600  # an anchor of an eighth of a range; by windows it takes ten times the room
MOST_PARTS = 1 << 16  # parts only hold more beyond that; nothing is left out
CHUNK, SORTED_AT_ONCE = 1 << 18, 12_000
_LOW = U(CHUNK - 1)
NULL_ID = (1 << 63) - 1


class BlindTrie:
    """A trie of bit positions only; strings are compared once an insertion, at the leaf."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, item: int) -> None:
        x = int.from_bytes(key.ljust(78, b"\0") + len(key).to_bytes(2, "big"), "big")
        if self.root is None:
            self.root = (x, [item])
            return
        node = self.root
        while len(node) == 3:
            node = node[1 + (x >> node[0] & 1)]
        bit = (x ^ node[0]).bit_length() - 1
        if bit < 0:
            node[1].append(item)
            return
        up, side, at = None, 0, self.root
        while len(at) == 3 and at[0] > bit:
            up, side = at, 1 + (x >> at[0] & 1)
            at = at[side]
        leaf = (x, [item])
        new = [bit, at, leaf] if x >> bit & 1 else [bit, leaf, at]
        if up is None:
            self.root = new
        else:
            up[side] = new

    def __iter__(self) -> Iterator[list[int]]:
        """Items of equal strings together, in the strings' order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[2], node[1]]
            else:
                yield node[1]


def deep_shallow(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of each string's class of equals), sorted by group, then bytes.

    Strings of at most 78 bytes.
    """
    n = len(starts)
    order = np.argsort(group, kind="stable")
    new = np.ones(n, bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    padded = np.concatenate([data, np.zeros(8, "u1")])
    for depth in range(0, SHALLOW, 8):
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, n))
        act = np.flatnonzero(np.repeat(size > 1, size))  # places of groups still open
        if not len(act):
            break
        own = order[act]
        at = np.minimum(starts[own] + depth, len(data))
        ch = np.zeros(len(act), U)
        for j in range(8):
            byte = padded[at + j].astype(U)
            byte[depth + j >= lens[own]] = 0
            ch = ch << U(8) | byte
        cls = np.cumsum(new)[act]
        sub = np.lexsort((ch, cls))
        order[act] = own[sub]
        ch, cls = ch[sub], cls[sub]
        new[act[1:]] |= (ch[1:] != ch[:-1]) | (cls[1:] != cls[:-1])
    raw = data.tobytes()
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, n))
    for a, m in zip(heads[size > 1].tolist(), size[size > 1].tolist()):
        own = order[a : a + m].tolist()
        same: dict[bytes, list[int]] = {}
        for i in own:
            s = starts[i]
            same.setdefault(raw[s : s + lens[i]], []).append(i)
        if len(same) > 1:
            trie, names = BlindTrie(), list(same)
            for k, key in enumerate(names):
                trie.insert(key, k)
            at = a
            for leaf in trie:
                items = same[names[leaf[0]]]
                new[at] = True
                order[at : at + len(items)] = items
                at += len(items)
    number = np.empty(n, "i8")
    number[order] = np.cumsum(new) - 1
    return order, number


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) of all runs of windows with one anchor.

    ``ends``: where segments end; windows do not cross them. At most CHUNK bytes.
    """
    n = len(buf) - K + 1
    empty = np.zeros(0, "i8")
    if len(buf) < SPAN:
        return np.zeros(0, U), empty, empty, empty
    with np.errstate(over="ignore"):
        h, power, width = BYTE[buf], BASE, 1
        eight = None
        while width < 8:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        eight = h
        h = eight[:n] * power + eight[8 : 8 + n]
        h = mix(h * power + eight[16 : 16 + n])
    v = h & ~_LOW | np.arange(n, dtype=U)
    width = 1
    while 2 * width <= REACH:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    v = np.minimum(v[: n - REACH + 1], v[REACH - width : n - width + 1])
    begins = np.append(0, ends[:-1])
    ok = np.zeros(len(buf) + 1, "i4")
    long = ends - begins >= SPAN
    np.add.at(ok, begins[long], 1)
    np.add.at(ok, ends[long] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(ok)[: len(v)] > 0)
    if not len(at):
        return np.zeros(0, U), empty, empty, empty
    p = (v[at] & _LOW).astype("i8")
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(first)
    return h[p[heads]], p[heads], at[heads], at[np.append(heads[1:], len(at)) - 1]


class Block:
    """The texts of a block, by doc_id, and their anchors."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.doc = table.column(0).to_numpy()
        col = table.column(1).cast(pa.large_binary()).combine_chunks()
        self.text, off = buffers(col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks))
        self.off = off
        found, lo, n = [], 0, len(off) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
            a, b = int(off[lo]), int(off[hi])
            if b - a <= CHUNK:
                found.append((*anchors(self.text[a:b], off[lo + 1 : hi + 1] - a), a))
            else:  # one text longer than a chunk: in parts of whole windows
                for s in range(a, b - SPAN + 1, CHUNK - SPAN + 1):
                    e = min(b, s + CHUNK)
                    found.append((*anchors(self.text[s:e], np.array([e - s])), s))
            lo = hi
        self.hash = np.concatenate([f[0] for f in found]) if found else np.zeros(0, U)
        self.anchor, self.first, self.last = (np.concatenate([f[k] + f[4] for f in found]) if found else np.zeros(0, "i8") for k in (1, 2, 3))
        self.of = np.searchsorted(off, self.first, "right") - 1

    def contexts(self, shared: np.ndarray):
        """Different contexts of the anchors whose hash's low 48 bits are in ``shared``, or that two documents have.

        Sets chosen (anchor numbers), number (context of each), source (first anchor of each context).
        """
        low = _low(self.hash)
        doc = self.doc[self.of] if len(self.of) else np.zeros(0, "i8")
        order = np.lexsort((doc, self.hash))
        h, d = self.hash[order], doc[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, "i8")
        end = np.append(begin[1:], len(h)) - 1
        many = np.zeros(len(h), bool)
        if len(h):
            many[order] = np.repeat(d[begin] != d[end], end - begin + 1)
        self.chosen = np.flatnonzero(many | np.isin(low, shared))
        raw, number, seen, source = self.text.tobytes(), [], {}, []
        for k, s, e in zip(self.chosen.tolist(), self.first[self.chosen].tolist(), (self.last[self.chosen] + SPAN).tolist()):
            c = raw[s:e]
            j = seen.get(c)
            if j is None:
                j = seen[c] = len(source)
                source.append(k)
            number.append(j)
        self.number, self.source = np.array(number, "i8"), np.array(source, "i8")
        return self


def _low(h: np.ndarray) -> np.ndarray:
    return h & U((1 << 48) - 1)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blobs: list[bytes]) -> np.ndarray:
    own = np.frombuffer(b"".join(blobs), "u1").reshape(-1, 6)
    out = np.zeros((len(own), 8), "u1")
    out[:, :6] = own
    return out.reshape(-1).view("<u8").astype(U)


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each different key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
    for a, b in zip(cut, [*cut[1:], len(k)]):
        yield int(k[a]), order[a:b]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype("i8")


def _masks(h, doc, windows, back, data) -> np.ndarray:
    """For each context the bits of its windows that a smaller doc_id has.

    ``back``: the anchor's offset in the context.
    """
    lens = windows + SPAN - 1
    starts = np.cumsum(lens) - lens
    _, cls = deep_shallow(data, starts, lens, h)
    n_cls = int(cls.max()) + 1
    least = np.full(n_cls, NULL_ID)
    np.minimum.at(least, cls, doc)
    rep = np.zeros(n_cls, "i8")
    rep[cls] = np.arange(len(cls))
    ch = h[rep]
    alone = np.ones(n_cls, bool)  # the only context of its anchor
    alone[1:] &= ch[1:] != ch[:-1]
    alone[:-1] &= ch[1:] != ch[:-1]
    # windows of the others, as suffixes of SPAN bytes; class c has its own from base[c]
    c = np.flatnonzero(~alone)
    n = windows[rep[c]]
    base = np.zeros(n_cls, "i8")
    base[c] = np.cumsum(n) - n
    all_least = np.zeros(0, "i8")
    if len(c):
        of = np.repeat(c, n)
        k = np.arange(len(of)) - np.repeat(base[c], n)
        with np.errstate(over="ignore"):
            group = mix(ch[of] * BASE + (back[rep[of]] - k).astype(U))
        _, w = deep_shallow(data, starts[rep[of]] + k, np.full(len(of), SPAN), group)
        low = np.full(int(w.max()) + 1, NULL_ID)
        np.minimum.at(low, w, least[of])
        all_least = low[w]
    mask = np.where(alone[cls] & (least[cls] < doc), (1 << windows) - 1, 0)
    rest = np.flatnonzero(~alone[cls])
    m = windows[rest]
    who = np.repeat(rest, m)
    k = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
    hit = all_least[base[cls[who]] + k] < doc[who] if len(who) else np.zeros(0, bool)
    np.bitwise_or.at(mask, who[hit], 1 << k[hit])
    return mask


def _masks_in_parts(h, doc, windows, back, data) -> np.ndarray:
    """As ``_masks``, some anchors after the others, so that memory stays bounded."""
    lens = windows + SPAN - 1
    starts, order = np.cumsum(lens) - lens, np.argsort(h, kind="stable")
    out, a, n = np.zeros(len(h), "i8"), 0, len(h)
    while a < n:
        b = min(n, a + SORTED_AT_ONCE)
        if b < n:  # all contexts of an anchor stay together
            b = a + int(np.searchsorted(h[order[a:]], h[order[b - 1]], "right"))
        own = order[a:b]
        first = np.cumsum(lens[own]) - lens[own]
        at = np.arange(int(lens[own].sum())) + np.repeat(starts[own] - first, lens[own])
        out[own] = _masks(h[own], doc[own], windows[own], back[own], data[at])
        a = b
    return out


def _distinct_texts(rows: DataFrame, n_blocks: int) -> DataFrame:
    """block, doc_id, text: each different text of a batch once, with its smallest doc_id."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["block", "text"]).aggregate([("doc_id", "min")])
            yield from t.select(["block", "doc_id_min", "text"]).rename_columns(["block", "doc_id", "text"]).to_batches()

    block = F.pmod(F.xxhash64(F.lit("block"), "text"), F.lit(n_blocks)).cast("int").alias("block")
    return rows.select(block, "doc_id", "text").mapInArrow(tidily(combine), "block int, doc_id long, text string")


def _one_each(table: pa.Table) -> pa.Table:
    """A block's texts, each once, with the smallest doc_id."""
    return table.select(["doc_id", "text"]).group_by("text").aggregate([("doc_id", "min")]).select(["text", "doc_id_min"]).rename_columns(["text", "doc_id"])


def _together(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls work(blocks, sizes of blobs, their bytes) for each bucket of batches (bucket, block, blob) sorted by bucket."""
    now, held = None, []

    def ends():
        return work(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    for batch in batches:
        bucket, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        data, off = buffers(batch.column(2))
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
        for a, b in zip(cut, [*cut[1:], len(bucket)]):
            if bucket[a] != now:
                if held:
                    yield from ends()
                now, held = bucket[a], []
            held.append((block[a:b], np.diff(off[a : b + 1]), data[off[a] : off[b]]))
    if held:
        yield from ends()


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(*c) for c in columns], names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each different text: digest (SHA-256 of the text), rep (its smallest doc_id), n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, start, end ... of what goes from rep's text)."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    n_buckets = min(MOST_PARTS, max(1, -(-n_blocks // BLOCKS_PER_BUCKET)))
    n_ranges = max(1, -(-n_bytes // RANGE_BYTES))
    n_parts = min(MOST_PARTS, -(-n_ranges // RANGES_PER_TASK))
    name = f"tessera_texts_{uuid.uuid4().hex}"
    with Scratch(spark, "suffix-dedup") as tmp:
        try:
            with shuffles_end(spark):
                _distinct_texts(rows, n_blocks).repartition(n_buckets, "block").write.option("compression", "zstd").option("path", f"{tmp.root}/texts").bucketBy(n_buckets, "block").saveAsTable(name)
            return _decided(spark, spark.table(name), n_ranges, n_parts, hot_contexts, tmp)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _decided(spark, texts: DataFrame, n_ranges: int, n_parts: int, hot_contexts: int, tmp: Scratch) -> DataFrame:
    reply, sent_type = "block int, kind int, blob binary", "bucket int, block long, blob binary"

    def both(other: DataFrame, fn, schema: str) -> DataFrame:
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return fn(key, left, right)
            finally:
                tidy()

        return texts.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(run, schema)

    def met(sent: DataFrame, work) -> DataFrame:
        return sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidily(lambda batches: _together(batches, work)), reply)

    def gather(key, left: pa.Table, right: pa.Table) -> pa.Table:
        h, n = np.unique(Block(_one_each(left)).hash, return_counts=True)
        scale = np.floor(np.log2(n)).astype("i8")
        out = [(k, c, _six(h[i[scale[i] == c]])) for k, i in _by(_bucket(h, n_ranges)) for c in np.unique(scale[i]).tolist()]
        return pa.table({"bucket": pa.array([k for k, _, _ in out], pa.int32()), "block": pa.array([key[0].as_py() * 32 + c for _, c, _ in out], pa.int64()), "blob": pa.array([x for *_, x in out], pa.binary())})

    def repeated(codes, sizes, data):
        """Hashes of two blocks or more go back to these: kind 0, or 2 where they have more than hot_contexts anchors of one.

        A code is the block and the logarithm of its number of these anchors.
        """
        h, of = _from_six([data.tobytes()]), np.repeat(codes, sizes // 6)
        order = np.argsort(h, kind="stable")
        s, weight, of = h[order], 1 << (of[order] & 31), of >> 5
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, "i8")
        size = np.diff(np.append(cut, len(s)))
        n, total = np.repeat(size, size), np.repeat(np.add.reduceat(weight, cut) if len(cut) else size, size)
        for kind, keep in ((0, (n > 1) & (total <= hot_contexts)), (2, (n > 1) & (total > hot_contexts))):
            at = order[keep]
            for k, i in _by(of[at]):
                yield _rows(["block", "kind", "blob"], ([k], pa.int32()), ([kind], pa.int32()), ([_six(h[at[i]])], pa.binary()))

    empty = spark.createDataFrame([], reply)
    shared = tmp.table(met(both(empty, gather, sent_type), repeated), "shared-anchors", compression="uncompressed")

    def blobs(t: pa.Table, *kinds: int) -> list[bytes]:
        return [x for k, x in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist()) if k in kinds]

    def block_of(left: pa.Table, right: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
        """The block with its contexts, which of these belong to hot anchors, and which go the other way.

        Hashes that differ only beyond the 48 bits that came back go both ways.
        """
        shared_, hot = _from_six(blobs(right, 0)), _from_six(blobs(right, 2))
        b = Block(_one_each(left)).contexts(np.concatenate([shared_, hot]))
        low = _low(b.hash[b.source])
        value, n = np.unique(_low(np.unique(b.hash[b.source])), return_counts=True)
        is_hot = np.isin(low, hot)
        return b, is_hot, ~is_hot | np.isin(low, value[n > 1])

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b, _, cold = block_of(left, right)
        at, out = np.flatnonzero(cold), []
        raw = b.text.tobytes()
        squeeze = zstandard.ZstdCompressor(level=1)
        for k, i in _by(_bucket(b.hash[b.source[at]], n_ranges)):
            own = b.source[at[i]]
            parts = [np.int64(len(i)).tobytes(), b.hash[own].astype("<u8").tobytes(), b.doc[b.of[own]].astype("<i8").tobytes(), at[i].astype("<u4").tobytes(), (b.last[own] - b.first[own] + 1).astype("u1").tobytes(), (b.anchor[own] - b.first[own]).astype("u1").tobytes()]
            parts += [raw[s:e] for s, e in zip(b.first[own].tolist(), (b.last[own] + SPAN).tolist())]
            out.append((k, squeeze.compress(b"".join(parts))))
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def decide(blocks, sizes, blob):
        cols, data, counts, at = [[], [], [], [], []], [], [], 0
        for n_own in sizes.tolist():
            x = zstandard.ZstdDecompressor().decompress(blob[at : at + n_own].tobytes())
            at += n_own
            n, here = int(np.frombuffer(x, "<i8", 1)[0]), 8
            for c, kind in zip(cols, ("<u8", "<i8", "<u4", "u1", "u1")):
                c.append(np.frombuffer(x, kind, n, here))
                here += n * np.dtype(kind).itemsize
            data.append(np.frombuffer(x, "u1", offset=here))
            counts.append(n)
        h, doc, number, windows, back = (np.concatenate(c) for c in cols)
        if len(h):
            mask = _masks_in_parts(h.astype(U), doc.astype("i8"), windows.astype("i8"), back.astype("i8"), np.concatenate(data))
            of, hit = np.repeat(blocks, counts), np.flatnonzero(mask)
            for k, i in _by(of[hit]):
                own = hit[i]
                out = np.stack([number[own].astype("<u4"), mask[own].astype("<u4")], 1).tobytes()
                yield _rows(["block", "kind", "blob"], ([k], pa.int32()), ([1], pa.int32()), ([out], pa.binary()))

    masks = tmp.table(met(both(shared, send, sent_type), decide), "repeat-masks")
    if not shared.where("kind = 2").isEmpty():
        masks = masks.unionByName(_hot_masks(both(shared, lambda key, left, right: _hot_windows(key[0].as_py(), *block_of(left, right)[:2]), "w binary, doc long, block int, number long, bit int"), tmp))

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = block_of(left, right)[0]
        mask = np.zeros(len(b.source), "i8")
        got = np.frombuffer(b"".join(blobs(right, 1)), "<u4").reshape(-1, 2)
        np.bitwise_or.at(mask, got[:, 0], got[:, 1].astype("i8"))
        doc = b.doc[b.of[b.chosen]]
        smallest = b.doc[b.of[b.source]]
        np.minimum.at(smallest, b.number, doc)
        cover = np.zeros(len(b.text) + 1, "i4")
        again = doc > smallest[b.number] if len(b.number) else np.zeros(0, bool)
        np.add.at(cover, b.first[b.chosen[again]], 1)
        np.add.at(cover, b.last[b.chosen[again]] + SPAN, -1)
        own = np.flatnonzero(~again & (mask[b.number] != 0)) if len(b.number) else np.zeros(0, "i8")
        for bit in range(REACH):
            at = b.first[b.chosen[own[mask[b.number[own]] >> bit & 1 == 1]]] + bit
            np.add.at(cover, at, 1)
            np.add.at(cover, at + SPAN, -1)
        return _results(b, np.cumsum(cover)[:-1] > 0)

    return materialise(both(shared.unionByName(masks), cut, "rep long, digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"), "repeats")


def _hot_windows(block: int, b: Block, hot: np.ndarray) -> pa.Table:
    """The windows of a block's contexts of hot anchors, with their contexts' smallest doc_id."""
    raw, smallest = b.text.tobytes(), b.doc[b.of[b.source]]
    np.minimum.at(smallest, b.number, b.doc[b.of[b.chosen]])
    w, doc, number, bit = [], [], [], []
    for k in np.flatnonzero(hot).tolist():
        s, e = int(b.first[b.source[k]]), int(b.last[b.source[k]]) + 1
        w += [xxhash.xxh3_128_digest(raw[i : i + SPAN]) for i in range(s, e)]
        doc += [int(smallest[k])] * (e - s)
        number += [k] * (e - s)
        bit += range(e - s)
    return pa.table({"w": pa.array(w, pa.binary()), "doc": pa.array(doc, pa.int64()), "block": pa.array([block] * len(w), pa.int32()), "number": pa.array(number, pa.int64()), "bit": pa.array(bit, pa.int32())})


def _hot_masks(windows: DataFrame, tmp: Scratch) -> DataFrame:
    """As the masks of contexts that meet, by an aggregate of windows."""
    windows = tmp.table(windows, "hot-windows")
    least = tmp.table(windows.groupBy("w").agg(F.min("doc").alias("least")), "hot-least")  # a join of two exchanges can be split
    hit = windows.join(least.hint("merge"), "w").where("least < doc").groupBy("block", "number").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, mask = (batch.column(k).to_numpy() for k in (1, 2))
            pairs = np.stack([number, mask], 1).astype("<u4").tobytes()
            yield _rows(["block", "kind", "blob"], batch.column(0), ([1] * len(number), pa.int32()), ([pairs[8 * k : 8 * k + 8] for k in range(len(number))], pa.binary()))

    return tmp.table(hit.mapInArrow(tidily(blob), "block int, kind int, blob binary"), "hot-masks")


def _results(b: Block, gone: np.ndarray) -> pa.Table:
    """The row of each of a block's texts; ``gone``: of each byte, whether it goes."""
    raw, res = b.text.tobytes(), [[], [], [], [], [], [], []]
    total = np.append(0, np.cumsum(gone))
    for k, (s, e) in enumerate(zip(b.off[:-1].tolist(), b.off[1:].tolist())):
        n, text = int(total[e] - total[s]), raw[s:e]
        digest, spans, kept = hashlib.sha256(text), [], text
        if n:
            spans = np.flatnonzero(np.diff(gone[s:e].astype("i1"), prepend=0, append=0)).tolist()
            kept = without(text, spans)
        for c, v in zip(res, (int(b.doc[k]), digest.digest(), e - s, n, len(spans) // 2, hashlib.sha256(kept).hexdigest() if n else digest.hexdigest(), spans)):
            c.append(v)
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("rep", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), res, kinds)})


def without(text: bytes, spans: list[int]) -> bytes:
    """The bytes outside of the spans (start, end, start, end ...)."""
    return b"".join(text[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(text)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; copies of an earlier document's text lose all of it."""
    done = repeats(docs, id_col, text_col, **options).drop("spans")
    rows = id_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    out = rows.join(done.hint("merge"), "digest")  # a text's copies may be split over tasks
    copy = (F.coalesce("doc_id", F.lit(NULL_ID)) > F.col("rep")) & (F.col("n_bytes") >= SPAN)
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, and how many these were.

    The number is in __removed, with underscores after it where ``docs`` has such a
    column. Halves of characters that lost some of their bytes go with them. Null
    texts stay null.
    """
    done = repeats(docs, id_col, text_col, **options)
    digest, rep, spans, removed = (free_name(docs, x) for x in ("__digest", "__rep", "__spans", "__removed"))
    found = done.where(f"n_removed > 0 or n_bytes >= {SPAN}").select(F.col("digest").alias(digest), F.col("rep").alias(rep), F.col("spans").alias(spans), F.col("n_bytes").cast("int").alias(removed))
    keyed = docs.withColumn(digest, F.unhex(F.sha2(quoted(text_col).cast("string"), 256)))
    joined = keyed.join(found.hint("merge"), digest, "left")
    whole = F.coalesce(quoted(id_col).cast("long"), F.lit(NULL_ID)) > F.col(rep)
    joined = joined.select(*(quoted(c) for c in docs.columns), F.when(whole, F.array(F.lit(0), F.col(removed))).otherwise(F.col(spans)).alias(spans))

    at, n = docs.columns.index(text_col), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(n).to_pylist()
            changed = [k for k, s in enumerate(own) if s]
            text = batch.column(at)
            if changed:
                out = text.to_pylist()
                for k in changed:
                    out[k] = without(out[k].encode(), own[k]).decode("utf-8", "ignore")
                text = pa.array(out, text.type)
            gone = pa.array([sum(s[1::2]) - sum(s[::2]) if s else 0 for s in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], text, *batch.columns[at + 1 : n], gone], [*batch.schema.names[:n], "added"])

    return map_batches(joined, cut, StructField(removed, LongType()), n)
