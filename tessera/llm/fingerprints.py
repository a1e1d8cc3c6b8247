"""Exact fingerprints of canonical texts, in DataFrame functions alone.

A text's canonical form is its NFC normal form, fully case-folded, with runs of
white space as one space and none at its ends. Texts are grouped by a wide
digest (two chained 64-bit xxHash values), and where a digest is shared, the
canonical bytes themselves are compared: the fingerprint is the digest and the
text's number among the different texts of its group, by their bytes, which is 0 unless two texts collide.
Equal texts always have equal fingerprints and different canonical texts
different ones.

Next texts are found on narrow rows: (doc_id, digest of the text, length) sorted
by ranges that Spark samples, whatever the ids are. The texts themselves move by
row keys only: once to hand each document's start to the one before it, and
once for each use of the edited text.

Null and empty texts have the empty canonical form; texts of any length are taken
whole; a null doc_id comes last in descending order; equal doc_ids are ordered by
a hash of the text; rows that repeat doc_id and text are one document in that
order and get equal results, one row each. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, id_text, materialise

ROWS_PER_RANGE, MOST_RANGES = 50_000, 1 << 16


def canonical(text: Column) -> Column:
    """NFC, full case folding, white space folded. ASCII texts need no Unicode tables."""
    icu = F.lit("com.ibm.icu.text.Normalizer")
    nfc = F.reflect(icu, F.lit("compose"), text, F.lit(False))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfc, F.lit(True))
    wide = F.reflect(icu, F.lit("compose"), folded, F.lit(False))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(plain, r"[\s\u0085\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as hex: the second value is chained on the first's seed."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """o and t, by which documents are told apart and ordered; doc_id; text. o falls as doc_id rises."""
    rows = id_text(docs, id_col, text_col)
    return rows.select(F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("o"), F.xxhash64("text").alias("t"), "doc_id", "text")


def _numbers(digests: DataFrame, canons: Callable[[DataFrame], DataFrame], tmp: Scratch) -> DataFrame | None:
    """o, t, side, number of the documents whose digest different canonical texts share, or None if there are none.

    ``digests``: o, t, side, wide. ``canons`` gives o, t, side, wide, canon of the
    rows (o, t and the sides that are asked for, ``sides``) that it is given. Only
    documents of a digest seen twice or more are asked for; copies combine before the shuffle.
    """
    shared = digests.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide")
    asked = digests.join(shared.hint("merge"), "wide").groupBy("o", "t").agg(F.collect_set("side").alias("sides"))
    texts = canons(tmp.table(asked, "shared-digests"))
    twice = texts.groupBy("wide", "canon").agg(F.lit(1).alias("one")).groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide")
    twice = tmp.table(twice, "collisions")
    if twice.isEmpty():
        return None
    texts = texts.join(twice.hint("merge"), "wide")
    number = texts.groupBy("wide", "canon").agg(F.lit(1).alias("one")).select("wide", "canon", (F.row_number().over(Window.partitionBy("wide").orderBy("canon")) - 1).alias("number"))
    return tmp.table(texts.join(number.hint("merge"), ["wide", "canon"]).select("o", "t", "side", "number").distinct(), "numbers")


def _asked(rows: DataFrame, asked: DataFrame, canon_of: dict[str, Column], wide: Callable[[Column], Column]) -> DataFrame:
    """o, t, side, wide, canon of the sides asked for."""
    found = rows.join(asked.hint("merge"), ["o", "t"])
    each = found.select("o", "t", F.explode(F.array(*(F.when(F.array_contains("sides", side), F.struct(F.lit(side).alias("side"), canon.alias("canon"))) for side, canon in canon_of.items()))).alias("x")).where("x is not null")
    return each.select("o", "t", "x.side", wide(F.col("x.canon")).alias("wide"), "x.canon")


def _fingerprint(wide: str, number: str | None) -> Column:
    return F.concat(wide, F.lit("-"), F.coalesce(F.col(number).cast("string"), F.lit("0")) if number else F.lit("0"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: Callable[[Column], Column] = digest) -> DataFrame:
    """doc_id and fingerprint of every row. ``wide``: the digest of a canonical text."""
    rows = _keyed(docs, id_col, text_col)
    with Scratch(docs.sparkSession, "fingerprints") as tmp:
        narrow = tmp.table(rows.select("o", "t", "doc_id", wide(canonical(F.col("text"))).alias("wide")), "digests")
        numbers = _numbers(narrow.select("o", "t", F.lit("own").alias("side"), "wide"), lambda asked: _asked(rows, asked, {"own": canonical(F.col("text"))}, wide), tmp)
        if numbers is not None:
            narrow = narrow.join(numbers.drop("side").hint("merge"), ["o", "t"], "left")
        return materialise(narrow.select("doc_id", _fingerprint("wide", "number" if numbers is not None else None).alias("fingerprint")), "fingerprints")


def next_of(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """o, t, k (a third of the length), next_o, next_t of each document: the next in descending doc_id, after the last the first."""
    each = rows.groupBy("o", "t").agg(F.first(F.floor(F.length("text") / 3).cast("int")).alias("k"))
    each = tmp.table(each, "lengths")
    n_ranges = min(MOST_RANGES, max(1, -(-each.count() // ROWS_PER_RANGE)))
    ranged = tmp.table(each.repartitionByRange(n_ranges, "o", "t").withColumn("range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("range").agg(F.min(F.struct("o", "t")).alias("head"))
    by = Window.orderBy("range")  # one row for each of MOST_RANGES ranges at most
    heads = heads.select("range", F.coalesce(F.lead("head").over(by), F.first("head").over(by)).alias("after"))
    line = Window.partitionBy("range").orderBy("o", "t")
    following = F.coalesce(F.lead(F.struct("o", "t")).over(line), F.col("after")).alias("f")
    return ranged.join(F.broadcast(heads), "range").select("o", "t", "k", following).select("o", "t", "k", F.col("f.o").alias("next_o"), F.col("f.t").alias("next_t"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: Callable[[Column], Column] = digest) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the next document's start.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1 or 0: the digests are exact).
    """
    rows = _keyed(docs, id_col, text_col)
    with Scratch(docs.sparkSession, "edited-fingerprints") as tmp:
        following = tmp.table(next_of(rows, tmp), "next")
        once = rows.groupBy(F.col("o").alias("next_o"), F.col("t").alias("next_t")).agg(F.first("text").alias("next_text"))
        tails = once.join(following.hint("merge"), ["next_o", "next_t"]).select("o", "t", "next_o", "next_t", F.substring(F.col("next_text"), F.lit(1), F.col("k")).alias("tail"))
        tails = tmp.table(tails, "tails", compression="zstd")

        n = F.length("text")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.col("tail"))
        both = rows.join(tails.hint("merge"), ["o", "t"]).withColumn("edited", edited)
        narrow = both.select("o", "t", "doc_id", "next_o", "next_t", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), wide(canonical(F.col("text"))).alias("wide"), wide(canonical(F.col("edited"))).alias("edited_wide"))
        narrow = tmp.table(narrow, "digests")

        sides = narrow.select("o", "t", F.explode(F.array(F.struct(F.lit("own").alias("side"), F.col("wide").alias("wide")), F.struct(F.lit("edited").alias("side"), F.col("edited_wide").alias("wide")))).alias("x")).select("o", "t", "x.*")
        numbers = _numbers(sides, lambda asked: _asked(both, asked, {"own": canonical(F.col("text")), "edited": canonical(F.col("edited"))}, wide), tmp)
        if numbers is not None:
            for side in ("own", "edited"):
                narrow = narrow.join(numbers.where(F.col("side") == side).select("o", "t", F.col("number").alias(f"{side}_number")).hint("merge"), ["o", "t"], "left")
        mark = [_fingerprint("wide", "own_number" if numbers is not None else None), _fingerprint("edited_wide", "edited_number" if numbers is not None else None)]
        marked = tmp.table(narrow.select("o", "t", "doc_id", "next_o", "next_t", "n_chars", "edited_sha256", mark[0].alias("fingerprint"), mark[1].alias("edited_fingerprint")), "fingerprints")
        nexts = marked.groupBy(F.col("o").alias("next_o"), F.col("t").alias("next_t")).agg(F.first("fingerprint").alias("next_fingerprint"))
        likeness = [(F.col("fingerprint") == F.col(c)).cast("double").alias(name) for c, name in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
        out = marked.join(nexts.hint("merge"), ["next_o", "next_t"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *likeness)
        return materialise(out, "edited-fingerprints")
