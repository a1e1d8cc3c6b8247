"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone.

A line (between line feeds) is its sequence of words. Lines of at least
``min_words`` words that repeat an earlier line go; lines of at least
``near_words`` words also go if an earlier line of as many is within one word's
edit (insertion, deletion or substitution). Earlier means by doc_id, then
position. Shorter lines stay; with ``min_words`` 1 only blank ones do.

1. A line is hashed as its words with single spaces between. Equal lines are
   combined before the shuffle; only each line's first place goes on.
2. One edit cannot touch both the first and the last half of a line, so lines
   within the bound share one of two keys: e words at either end, e growing with
   the length (near_words / 2, doubled whenever the length doubles; a line of
   just such a length has the keys of both). Lines that share none drop out;
   nothing is lost. The others are numbered in the order of their places.
3. All variants with one word deleted are emitted as hashed keys (running
   exclusive ors of position-dependent hashes, linear in the line's length).
   Lines of equal length that share a variant with the same position deleted
   differ in that word; a line equal to another's variant lacks one word. So the
   earliest line of a group decides for all others of it and no pairs within
   groups are made.
4. Each line and the earliest of each of its groups are verified word by word.

Hot lines and keys are combined before each shuffle, and joins on them are sort
merge joins whose hot side Spark's adaptive execution splits. Texts move twice,
keyed by row: for the candidate lines' words and for the texts that are left.

Null texts stay null and keep all lines; a null doc_id counts as the greatest
long. Rows are told apart by doc_id and a digest of the text (its order breaks
ties of doc_id), so only rows that repeat both are one document. Lines of any
length take linear time. An empty table gives an empty table. Other columns pass
through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, free_name, materialise, quoted

MIN_WORDS, NEAR_WORDS = 1, 6


def single_spaced(text: Column) -> Column:
    """White space but line feeds as single spaces; most texts have no other and stay as they are."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    plain = F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, t, text: what tells rows apart, and the text."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.where(F.col(text_col).isNotNull()).select(d.alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def n_words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def end_keys(line: Column, n: Column, near_words: int) -> Column:
    """The hashes of e words at the start and at the end, for each e of the line's length."""
    level = F.floor(F.log2(n / near_words)).cast("int")
    e = (F.lit(near_words // 2) * F.pow(F.lit(2.0), level)).cast("int")
    half = (e / 2).cast("int")

    def ends(k: Column) -> list[Column]:
        return [F.xxhash64(F.lit(name), k, F.call_function("substring_index", line, F.lit(" "), sign)) for name, sign in (("start", k), ("end", -k))]

    edge = (n == 2 * e) & (n > near_words)
    return F.when(n < near_words, F.lit(None).cast("array<bigint>")).when(edge, F.array(*ends(e), *ends(half))).otherwise(F.array(*ends(e)))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one insertion, deletion or substitution apart."""

    def lacks(long: Column, short: Column) -> Column:
        at = F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(long, 1, F.greatest(F.lit(0), F.size(short))), short, lambda x, y: x != y), True), F.lit(0)), F.size(long)).cast("int")
        rest = F.concat(F.slice(long, 1, at - 1), F.slice(long, at + 1, F.size(long)))
        return rest == short

    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z)) <= 1
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, lacks(a, b)).when(F.size(b) == F.size(a) + 1, lacks(b, a)).otherwise(False)


def _variants(words: DataFrame) -> DataFrame:
    """r, key, i: of each line its variant without word i, and itself as i = -1."""
    # running exclusive ors: words before place i keep their place, those after it move down by one
    each = words.repartition("r").select("r", F.posexplode(F.split("line", " ")).alias("i", "word"))
    each = each.select("r", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("down"))
    line = Window.partitionBy("r")
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.select("r", "i", F.bit_xor("here").over(so_far).bitwiseXOR(F.col("here")).alias("before"), F.bit_xor("down").over(so_far).alias("down_to"), F.bit_xor("here").over(line).alias("all"), F.bit_xor("down").over(line).alias("all_down"), F.count("*").over(line).cast("int").alias("n"))
    size = lambda m: F.xxhash64(F.lit("size"), m)
    variant = F.struct(F.col("before").bitwiseXOR(F.col("all_down")).bitwiseXOR(F.col("down_to")).bitwiseXOR(size(F.col("n") - 1)).alias("key"), F.col("i").alias("i"))
    whole = F.struct(F.col("all").bitwiseXOR(size(F.col("n"))).alias("key"), F.lit(-1).alias("i"))
    return rows.select("r", F.explode(F.when(F.col("i") == 0, F.array(variant, whole)).otherwise(F.array(variant))).alias("v")).select("r", "v.*")


def near_lines(rows: DataFrame, first: DataFrame, tmp: Scratch) -> DataFrame:
    """h1, h2 of the distinct lines that an earlier line is within one edit of.

    ``first``: h1, h2, d, t, no (the first place) and keys of each distinct line.
    """
    keyed = first.select("h1", "h2", "d", "t", "no", F.explode("keys").alias("key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    # written first: a join of two exchanges is one whose hot side Spark can split
    cand = keyed.join(tmp.table(keys, "shared-keys").hint("merge"), "key", "left_semi").select("h1", "h2", "d", "t", "no").distinct()
    # ids of a sorted table rise with its order
    cand = tmp.table(cand.orderBy("d", "t", "no").withColumn("r", F.monotonically_increasing_id()), "candidates")
    wanted = cand.groupBy("d", "t").agg(F.collect_list(F.struct("no", "r")).alias("want"))
    once = rows.groupBy("d", "t").agg(F.first("text").alias("text"))
    words = once.join(wanted.hint("merge"), ["d", "t"]).select(F.split(single_spaced(F.col("text")), "\n").alias("lines"), "want")
    words = words.select(F.inline(F.transform("want", lambda w: F.struct(w["r"].alias("r"), F.trim(F.get("lines", w["no"])).alias("line")))))
    words = tmp.table(words, "candidate-lines")

    emitted = _variants(words)
    groups = emitted.groupBy("key", "i").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    key = Window.partitionBy("key")
    whole_at, variant_at = F.min(F.when(F.col("i") < 0, F.col("lo"))).over(key), F.min(F.when(F.col("i") >= 0, F.col("lo"))).over(key)
    best = groups.select("key", "i", "hi", F.when(F.col("i") < 0, variant_at).otherwise(F.least("lo", whole_at)).alias("best")).where("best < hi").drop("hi")
    pairs = emitted.join(tmp.table(best, "variant-groups").hint("merge"), ["key", "i"]).where("best < r").select("r", "best").distinct()
    pairs = pairs.join(words.hint("merge"), "r").join(words.select(F.col("r").alias("best"), F.col("line").alias("other")).hint("merge"), "best")
    near = pairs.where(within_one(F.split("line", " "), F.split("other", " "))).select("r").distinct()
    return tmp.table(cand.join(near.hint("merge"), "r").select("h1", "h2"), "near-lines")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, t and lines (sorted positions from 0) to remove from each row that loses some."""
    if near_words < 4 or near_words % 2:
        raise ValueError("near_words must be even and at least 4")
    rows = rows_of(docs, id_col, text_col)
    with Scratch(docs.sparkSession, "line-dedup") as tmp:
        line, n = F.trim("line"), F.col("n")
        seen = rows.select("d", "t", F.posexplode(F.split(single_spaced(F.col("text")), "\n")).alias("no", "line")).select("d", "t", "no", line.alias("line"))
        seen = seen.withColumn("n", n_words(F.col("line"))).where(n >= min_words)
        seen = tmp.table(seen.select("d", "t", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), end_keys(F.col("line"), n, near_words).alias("keys")), "lines")
        first = seen.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "no")).alias("at"), F.count("*").alias("c"), F.first("keys").alias("keys"))
        first = tmp.table(first.select("h1", "h2", "at.*", "c", "keys"), "distinct-lines")
        near = near_lines(rows, first, tmp)
        gone = first.drop("keys").join(near.withColumn("near", F.lit(True)).hint("merge"), ["h1", "h2"], "left").where("c > 1 or near").select("h1", "h2", F.struct("d", "t", "no").alias("at1"), F.coalesce("near", F.lit(False)).alias("near"))
        hit = seen.select("d", "t", "no", "h1", "h2").join(tmp.table(gone, "repeated-lines").hint("merge"), ["h1", "h2"]).where(F.col("near") | (F.struct("d", "t", "no") > F.col("at1")))
        return materialise(hit.groupBy("d", "t").agg(F.sort_array(F.collect_set("no")).alias("lines")), "removed-lines")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less its removed lines, and the numbers of lines and of removed lines.

    These two columns are __lines and __removed, each with underscores after it where ``docs`` has such a column.
    """
    removed = removed_lines(docs, min_words, near_words, id_col, text_col)
    d, t, gone, own = (free_name(docs, x) for x in ("__d", "__t", "__gone", "__own"))
    text = F.col(text_col)
    keyed = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), t: F.xxhash64(text)})
    df = keyed.join(removed.select(F.col("d").alias(d), F.col("t").alias(t), F.col("lines").alias(gone)).hint("merge"), [d, t], "left")
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    df = df.withColumn(own, F.when(F.col(gone).isNotNull(), F.split(text, "\n")))
    keep = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(gone))
    left = F.when(F.col(own).isNull(), text).otherwise(F.array_join(F.transform(keep, lambda i: F.get(own, i)), "\n"))
    n_lines, n_removed = F.when(text.isNull(), 0).otherwise(n).cast("long"), F.when(text.isNull() | F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return df.select(*(quoted(c) if c != text_col else left.alias(c) for c in docs.columns), n_lines.alias(free_name(docs, "__lines")), n_removed.alias(free_name(docs, "__removed")))
