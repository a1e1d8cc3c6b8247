"""Source divergence audit: how each source of a language differs from the
others and from the language as a whole in its use of terms.

Terms are counted per (language, source) where the texts are read; the counts
meet by (language, source, term) and then by (language, term), so that no key
gathers more rows than there are tasks or sources. A language keeps the terms in
at least ``least_docs`` of its documents. Its kept terms are dealt by hash into
blocks, and its sources by number into tiles of at most ``tile_groups``; a task
builds the dense int64 matrix of two tiles' sources by one block's terms, gets
the sums of |p - q| of all their pairs by broadcasting a few terms at a time, and
keeps a heap of each source's best terms. Spark sums the partial pair matrices
and ranks what the heaps held.

All arithmetic is on whole numbers; shares are parts of 10^9 by long division,
which is exact up to 9 * 10^15 terms a language.

Null texts, languages and sources are empty strings; a document of an empty text
still makes its group occur. Repeated rows count as often as they are there.
Groups without terms differ from the others by the smoothing alone; a language
without a kept term gives pairs of value 0, a language of one source no pairs, an
empty table no rows. Texts may be of any length; equal values are ranked by the
item's UTF-8 bytes. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialise, tidily
from .terms import LETTERS, counted, even_slices, terms

SLICE_BYTES, TILE_CELLS, TILE_GROUPS, MOST_TERMS = 24 << 20, 1 << 17, 128, 50
PARTS = 1_000_000_000


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, uses, documents) of one slice of (lang, source, text), and the empty term once for each group."""
    group = pa.table({"lang": part.column(0), "source": part.column(1), "row": np.arange(part.num_rows)}).group_by(["lang", "source"]).aggregate([("row", "list")])
    rows = group.column("row_list").combine_chunks()
    of = np.empty(part.num_rows, "i8")
    of[rows.flatten().to_numpy()] = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    own, before = terms(part.column(2), LETTERS)
    coded, n, g = own.dictionary_encode(), part.num_rows, len(rows)
    key, uses = counted(coded.indices.to_numpy().astype("i8") * n + np.repeat(np.arange(n), np.diff(before)))  # by term and document
    key = key // n * g + of[key % n]
    order = np.argsort(key, kind="stable")
    key, n_docs = counted(key)
    uses = np.add.reduceat(uses[order], np.cumsum(n_docs) - n_docs) if len(key) else uses
    at = np.append(key % g, np.arange(g))
    term = pa.concat_arrays([coded.dictionary.take(pa.array(key // g)), pa.array([b""] * g, pa.large_binary())]).cast(pa.binary())
    zeros = np.zeros(g, "i8")
    return pa.RecordBatch.from_arrays(
        [*(pa.array(group.column(c).combine_chunks()).take(pa.array(at)).cast(pa.string()) for c in ("lang", "source")), term.cast(pa.string()), pa.array(np.append(uses, zeros)), pa.array(np.append(n_docs, zeros))],
        ["lang", "source", "term", "n", "d"],
    )


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n (uses), d (documents that use it); the empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in even_slices(batch, 2, slice_bytes):
                out = _count(part)
                yield from (out.slice(k, 50_000) for k in range(0, out.num_rows, 50_000))

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(tidily(run), "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(count: np.ndarray, total: np.ndarray, n_kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 n_kept)), three digits at a time."""
    rest, by, out = count + 5, total + 5 * n_kept, np.int64(0)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + more
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """For rows of a and b (groups by terms) the sums of |difference| of all pairs."""
    out = np.zeros((len(a), len(b)), "i8")
    step = max(1, cells // max(1, out.size))
    for k in range(0, a.shape[1], step):
        out += np.abs(a[:, None, k : k + step] - b[None, :, k : k + step]).sum(-1)
    return out


def _tiles(most_terms):
    """A tile's rows to its partial pair sums (part 'pair': groups i < j) and best terms (part 'term': group i)."""

    def run(table):
        head = table.column("term").is_null().to_numpy()
        no, n, kept, total = (table.column(c).to_numpy() for c in ("no", "n", "kept", "total"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        nos, first = np.unique(no[head], return_index=True)
        totals, n_kept, lang_total = n[head][first], int(kept[head][0]), int(total[head][0])
        in_block = table.column("in_block").to_numpy()[head][0]
        coded = table.column("term").filter(pa.array(~head)).combine_chunks().dictionary_encode()
        names, term = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        count = np.zeros((len(nos), len(names)), "i8")
        count[np.searchsorted(nos, no[~head]), term] = n[~head]
        overall = np.zeros(len(names), "i8")
        overall[term] = kept[~head]  # the term's uses in the whole language
        p = shares(count, totals[:, None], n_kept) if n_kept else np.ones_like(count)
        tile = table.column("tile_of").to_numpy()[head][first]
        a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        f = pair_sums(p[a], p[b])
        if n_kept:  # kept terms of the block that none of these sources uses
            unused = shares(np.zeros(len(nos), "i8"), totals, n_kept)
            f += np.abs(unused[a][:, None] - unused[b][None, :]) * (in_block - len(names))
        i, j = np.nonzero(nos[a][:, None] < nos[b][None, :])
        out = [["pair"] * len(i), nos[a][i], nos[b][j], [None] * len(i), f[i, j]]
        if low == high and names:
            more = p - shares(overall, np.int64(lang_total), n_kept)
            for g in range(len(nos)):
                at = np.flatnonzero((count[g] > 0) & (more[g] > 0)).tolist()
                best = nsmallest(most_terms, ((-int(more[g, t]), names[t]) for t in at))
                out = [[*x, *y] for x, y in zip(out, (["term"] * len(best), [nos[g]] * len(best), [None] * len(best), [t for _, t in best], [-v for v, _ in best]))]
        lang = [table.column("lang")[0].as_py()] * len(out[0])
        return pa.table([pa.array(lang, pa.string()), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:3]), pa.array([t and t.decode() for t in out[3]], pa.string()), pa.array(out[4], pa.int64())], ["lang", "part", "i", "j", "term", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = MOST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tile_groups: int = TILE_GROUPS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """lang, source, part, item, value, rank of all pairs of sources and of each source's ``most_terms`` best terms."""
    with Scratch(docs.sparkSession, "divergence") as tables:
        by_term = Window.partitionBy("lang", "term")
        counts = term_counts(docs, text_col, lang_col, source_col)
        seen = counts.select("lang", "source", "term", "n", F.sum("d").over(by_term).alias("df"), F.sum("n").over(by_term).alias("uses"))
        first = F.row_number().over(by_term.orderBy("source")) == 1
        seen = tables.table(seen.withColumn("first", first).where((F.col("df") >= least_docs) | (F.col("term") == "")), "kept")
        groups = seen.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        langs = seen.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.when(F.col("first") & (F.col("term") != ""), 1)).alias("kept"), F.count(F.when(F.col("term") == "", 1)).alias("sources"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        # one row for each group of the corpus, as the result has one for each pair of them
        groups = tables.table(groups.join(langs, "lang").withColumn("no", number.cast("long")), "groups")
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.least("sources", F.lit(2 * tile_groups)) / F.lit(tile_cells)))
        groups = groups.withColumns({"tile_of": F.floor(F.col("no") / tile_groups), "tiles": F.ceil(F.col("sources") / tile_groups), "blocks": n_blocks})
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))

        def dealt(rows: DataFrame) -> DataFrame:
            """Each row once for each pair of tiles that its group's is one of."""
            return rows.withColumn("other", other).withColumns({"low": F.least("tile_of", "other"), "high": F.greatest("tile_of", "other")}).drop("other", "tiles", "blocks")

        numbered, zero = groups.select("lang", "source", "no", "tile_of", "tiles", "blocks"), F.lit(0).cast("long")
        placed = seen.where("term <> ''").join(numbered, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
        in_block = placed.where("first").groupBy("lang", "block").agg(F.count("*").alias("in_block"))
        cells = placed.select("lang", F.col("term").cast("binary").alias("term"), "no", "n", F.col("uses").alias("kept"), zero.alias("total"), "block", zero.alias("in_block"), "tile_of", "tiles", "blocks")
        spread = groups.withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1))).join(in_block, ["lang", "block"], "left")
        heads = spread.select("lang", F.lit(None).cast("binary").alias("term"), "no", "n", "kept", "total", "block", F.coalesce("in_block", zero).alias("in_block"), "tile_of", "tiles", "blocks")
        tiles = dealt(cells).unionByName(dealt(heads)).groupBy("lang", "block", "low", "high").applyInArrow(_tiles(most_terms), "lang string, part string, i long, j long, term string, value long")
        tiles = tables.table(tiles, "tiles")
        names = groups.select("lang", F.col("no").alias("i"), "source")
        sums = tiles.where("part = 'pair'").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        named = sums.join(names, ["lang", "i"]).join(names.withColumnsRenamed({"i": "j", "source": "item"}), ["lang", "j"]).select("lang", "source", "item", "value")
        pairs = named.unionByName(named.selectExpr("lang", "item AS source", "source AS item", "value")).withColumn("part", F.lit("pair"))
        best = tiles.where("part = 'term'").join(names, ["lang", "i"]).select("lang", "source", F.col("term").alias("item"), "value", "part")
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= most_terms).unionByName(pairs.withColumn("rank", rank))
        return materialise(ranked.select("lang", "source", "part", "item", "value", "rank"), "divergence")
