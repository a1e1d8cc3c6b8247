"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles. Its sketch has M registers
``floor(1 - log_b(min x))`` of exponentially distributed values x of its
shingles, truncated to a byte: mergeable by maximum, and equal with a
probability that rises with the Jaccard similarity. Runs of ROWS registers make
a band; documents that share a band's values are candidates. In a band group each
sketch is compared with those not yet reached, and linked where the joint
likelihood of both allows the threshold: a spanning forest a group, never its
pairs. Components of these links hold all real links, and inside each the full
shingle sets decide, again against documents not yet reached. So each real link
is found or follows from others that were.

At similarity 0.85 a pair shares none of the 32 bands with a probability of
(1 - 0.85^4)^32 = 6e-11, at 0.8 of 5e-8; the likelihood test loses less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U, buffers, mix, shingle_sets, slices
from .components import connected_components
from .shared import Scratch, id_text, materialise, tidily

M, ROWS, B, RATE = 128, 4, 1.1, 20.0
SALTS = 32
BLOCK_SHINGLES, BLOCK_SKETCHES = 2_000_000, 8192
_A = mix(np.arange(1001, 1001 + M, dtype=U)) | U(1)
_C = mix(np.arange(5001, 5001 + M, dtype=U))
_BANDS = mix(np.arange(9001, 9001 + M, dtype=U)) | U(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches (bytes) of non-empty sets of 64-bit hashes."""
    all_, n = np.concatenate(sets), np.array([len(s) for s in sets])
    first, least = np.cumsum(n) - n, np.empty((len(sets), M), U)
    with np.errstate(over="ignore"):
        for i in range(M):
            least[:, i] = np.minimum.reduceat(all_ * _A[i] + _C[i], first)
    x = -np.log1p(-(least.astype("f8") + 1) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(B)), 0, 255).astype("u1")


def bands(regs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        wide = (regs.astype(U) + U(1)) * _BANDS
        return mix(wide.reshape(len(regs), M // ROWS, ROWS).sum(2, dtype=U) ^ _C[: M // ROWS]).view("i8")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / math.log(B)


def possible(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray, at_least: float) -> np.ndarray:
    """Whether the joint likelihood of two sketches allows a similarity of ``at_least``.

    The likelihood of (greater, less, equal) registers is maximised over all
    similarities and over those that are high enough; where the latter falls
    short by 18 in logarithm or more, the pair is out.
    """
    up, down = (one > many).sum(1), (one < many).sum(1)
    u = (size / (size + sizes))[:, None]
    v, top = 1 - u, np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 48)[None, :] * top
    floor = at_least + (top - at_least) * np.linspace(0, 1, 16)[None, :]

    def loglik(j):
        a, b = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-9), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-9)
        return (up[:, None] * np.log(a) + down[:, None] * np.log(b) + (M - up - down)[:, None] * np.log(np.maximum(1 - a - b, 1e-9))).max(1)

    high = loglik(floor)
    return (top[:, 0] >= at_least - 1e-9) & (high >= np.maximum(loglik(grid), high) - 18)


def _forest(g: int, near) -> list[tuple[int, int]]:
    """A spanning forest of g nodes; near(x, left) gives those of ``left`` that x links to."""
    left, queue, out = np.arange(1, g), [0], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        hit = near(x, left)
        out += [(x, int(y)) for y in hit]
        queue += hit.tolist()
        if len(hit):
            left = left[~np.isin(left, hit)]
    return out


def likely_links(regs: np.ndarray, n: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """A spanning forest (positions) of the pairs whose sketches allow the threshold."""

    def near(x, left):
        return np.concatenate([part[possible(regs[x], int(n[x]), regs[part], n[part], pct / 100)] for part in (left[k : k + 4096] for k in range(0, len(left), 4096))])

    return _forest(len(n), near)


def links(sets: list[np.ndarray], pct: int) -> list[tuple[int, int]]:
    """A spanning forest (positions) of the graph of 100 * |A & B| >= pct * |A | B|."""
    n = np.array([len(s) for s in sets])
    if len(sets) < 2:
        return []
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first, mark = np.cumsum(n) - n, np.zeros(len(universe), bool)

    def near(x, left):
        c, hit = left[100 * np.minimum(n[left], n[x]) >= pct * np.maximum(n[left], n[x])], []
        mark[ids[first[x] : first[x] + n[x]]] = True
        for k in range(0, len(c), 1024):
            part = c[k : k + 1024]
            at = np.cumsum(n[part]) - n[part]
            own = ids[np.arange(n[part].sum()) + np.repeat(first[part] - at, n[part])]
            inter = np.add.reduceat(mark[own].astype("i8"), at)
            hit.append(part[100 * inter >= pct * (n[part] + n[x] - inter)])
        mark[ids[first[x] : first[x] + n[x]]] = False
        return np.concatenate(hit) if hit else c

    return _forest(len(sets), near)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the whole set), regs and bands (null for empty sets)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(*buffers(part.column(1)), words)
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                regs = registers(full) if full else np.zeros((0, M), "u1")
                of, raw = iter(bands(regs) if full else ()), iter(regs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(raw).tobytes() if k else None for k in n.tolist()], pa.binary()), pa.array([next(of) if k else None for k in n.tolist()], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "regs", "bands"])

    return rows.mapInArrow(tidily(sketch), "doc_id long, n_shingles long, key binary, regs binary, bands array<long>")


def _block_pairs(id_col: str):
    """The pairs of blocks that a row belongs to: all of its group's blocks meet two by two."""
    own = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))


def near_duplicates(docs: DataFrame, words: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Texts without a word, and rows without a doc_id, are linked with nothing;
    rows that repeat a doc_id count as one document. component_id is the least
    doc_id that can be reached. Texts of any length are taken whole, an empty
    table gives an empty result, other columns are ignored.
    """
    with Scratch(docs.sparkSession, "near-dedup") as tmp:
        return materialise(_near(id_text(docs, id_col, text_col), words, pct, tmp), "near-duplicates")


def _near(rows: DataFrame, words: int, pct: int, tmp: Scratch) -> DataFrame:
    sig = tmp.table(sketches(rows, words), "sketches")
    known = sig.where("key is not null and doc_id is not null")
    classes = tmp.table(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "classes")
    rep_band = classes.select("rep", F.explode("bands").alias("band"))
    shared = rep_band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band", F.ceil(F.col("size") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    members = rep_band.join(shared, "band").join(classes.select("rep", "n", "regs"), "rep")
    groups = members.select("band", F.explode(_block_pairs("rep")).alias("p"), "rep", "n", "regs").select("band", "p.i", "p.j", "rep", "n", "regs")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of two all at once, each different larger group once."""
        seen: set[tuple] = set()
        now, held = None, []

        def ends(done: list[list]) -> pa.RecordBatch:
            a, b = [], []
            two = list({(g[0][0], g[1][0]): g for g in done if len(g) == 2 and (g[0][0], g[1][0]) not in seen}.values())
            if two:
                r = np.frombuffer(b"".join(x[2] for g in two for x in g), "u1").reshape(-1, 2, M)
                n = np.array([[x[1] for x in g] for g in two])
                ok = possible(r[:, 0], n[:, 0], r[:, 1], n[:, 1], pct / 100)
                a, b = [g[0][0] for g, y in zip(two, ok) if y], [g[1][0] for g, y in zip(two, ok) if y]
                seen.update((g[0][0], g[1][0]) for g in two)
            for g in done:
                ids = tuple(x[0] for x in g)
                if len(g) > 2 and ids not in seen:
                    if len(g) < 64:
                        seen.add(ids)
                    e = likely_links(np.frombuffer(b"".join(x[2] for x in g), "u1").reshape(-1, M), np.array([x[1] for x in g]), pct)
                    a += [ids[x] for x, _ in e]
                    b += [ids[y] for _, y in e]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if len(held) > 1:
                        done.append(held)
                    now, held = row[:3], []
                held.append(row[3:])
            if len(seen) > 1_000_000:
                seen.clear()
            yield ends(done)
        if len(held) > 1:
            yield ends([held])

    likely_edges = groups.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep").mapInArrow(tidily(likely), "a long, b long")
    coarse = tmp.table(connected_components(likely_edges, tmp), "coarse")
    n_of = coarse.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    blocks = n_of.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = n_of.select("node", "component").join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "blocks")
    texts = rows.join(dealt, "doc_id")
    spread = texts.select("component", F.explode(_block_pairs("doc_id")).alias("p"), "doc_id", "text").select("component", "p.i", "p.j", "doc_id", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def found():
            e = links(sets, pct) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in e], pa.int64()), pa.array([ids[b] for _, b in e], pa.int64())], ["a", "b"])

        for batch in batches:
            for part in slices(batch, 4):
                keys = zip(*(part.column(k).to_pylist() for k in range(3)))
                for key, doc, s in zip(keys, part.column(3).to_pylist(), shingle_sets(*buffers(part.column(4)), words)):
                    if key != now:
                        if len(ids) > 1:
                            yield found()
                        now, ids, sets = key, [], []
                    if len(s):
                        ids.append(doc)
                        sets.append(s)
        if len(ids) > 1:
            yield found()

    checked = spread.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id").mapInArrow(tidily(verify), "a long, b long")
    final = connected_components(checked, tmp)
    # a class's documents take its representative's component; its hot keys are salted
    labels = classes.where("copies > 1").select("key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("c1"))
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = sig.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left").select("doc_id", "n_shingles", "c1")
    out = out.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("c1", "component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
