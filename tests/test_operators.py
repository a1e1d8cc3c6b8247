"""Edge rows that the tables do not hold, against small models."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import accounting, capabilities, dedup, evaluation, packing, quality, retrieval, sampling, sft, tokenizer, verify
from tessera.sources import packed, readers, writers

ODD = ["", "  a \t b ", "é\r\n\r\nx", "x\x0by\x85z", " q r ", "ひらがな漢字", "한국어 text", "A" * 25, "हिन्दी कि", "ß SS ẞ", "<b>x</b> y", "a�b", "x \x00\x07 y"]


def one(spark, values, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in df.select("i", col(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


def test_normalize(spark):
    def model(s):
        import re

        s = unicodedata.normalize("NFC", s)
        lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in s.splitlines()]
        return "\n".join(x for x in lines if x).strip()

    assert one(spark, ODD, T.normalize) == [model(s) for s in ODD]


def test_casefold(spark):
    assert one(spark, ODD, T.casefold) == [s.casefold() for s in ODD]


def test_scripts(spark):
    assert one(spark, ["漢字かな", "abcд", "дa", "123", "한국", "কো a b", ""], T.dominant_script) == ["Japanese", "Latin", "Cyrillic", "Unknown", "Hangul", "Bengali", "Unknown"]
    df = spark.createDataFrame([("hi", "Latin"), ("ja", "Han"), ("xx", "Latin"), (None, "Latin"), ("EN ", "Cyrillic")], "l string, s string")
    assert [r[0] for r in df.select(T.script_mismatch(F.col("l"), F.col("s"))).collect()] == ["language_script_mismatch:Devanagari!=Latin", None, None, None, "language_script_mismatch:Latin!=Cyrillic"]


def test_repetition_and_runs(spark):
    assert one(spark, ["a b c a b c", "a b", "", "x x x x"], lambda c: T.repetition(T.split_words(c), 3, 3)) == [0.25, 0.0, 0.0, 0.5]
    assert one(spark, ["a a b b b", "", "x"], lambda c: T.longest_run(T.split_words(c))) == [3, 0, 1]


def test_gate_reasons(spark):
    long = "word number %d is here and some more text follows " * 6
    rows = [(1, None, "en"), (2, "short", "en"), (3, "z" * 30 + long, "en"), (4, long.replace("%d", "1"), "ru"), (5, "same " * 60, "en"), (6, "<p>" * 40 + long, "en")]
    df = spark.createDataFrame(rows, "id int, text string, language string")
    got = {r["id"]: r["reasons"] for r in quality.reasons(df, quality.QualityPolicy(require_metadata=False)).collect()}
    assert got[1] == ["missing_text"] and got[2] == ["too_short"] and "repeated_character_run" in got[3]
    assert "language_script_mismatch:Cyrillic!=Latin" in got[4] and "low_word_diversity" in got[5] and "html_boilerplate" in got[6]


def test_gate_metadata(spark):
    df = spark.createDataFrame([("x" * 10, "s", "latest", "en", "d", "l", " ", "v1")], "text string, source string, source_revision string, language string, domain string, license string, document_id string, preprocessing_version string")
    assert {"unfrozen_metadata:source_revision", "missing_metadata:document_id"} <= set(quality.reasons(df).first()["reasons"])


def test_contamination_finds_parts_of_words(spark):
    frag = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    docs = spark.createDataFrame([(1, "xx" + frag + "yy end"), (2, frag[:60]), (3, "nothing"), (4, "a" * 90)], "doc_id long, folded string")
    frags = spark.createDataFrame([(frag,), ("a" * 85,)], "fragment string")
    assert sorted(r[0] for r in dedup.contaminated(docs, frags).collect()) == [1, 4]


def test_first_seen_with_hot_key(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    assert dedup.mark_first(df, "h", "doc_id").where("first_seen").count() == 667


def test_sample_contract(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stratum"), (F.col("id") % 50).alias("n_tok"))
    ids = lambda seed: sorted(r["doc_id"] for r in sampling.budget_sample(df, 2000, {"a": 0.5, "b": 0.5}, seed).collect())
    assert ids(1) == ids(1) != ids(2)
    total = sampling.budget_sample(df, 2000, {"a": 0.5, "b": 0.5}, 1, refill=("a",)).agg(F.sum("n_tok")).first()[0]
    assert abs(total - 2000) < 150


def test_prefix_sum_is_whole(spark):
    # sparse ids, one of them far from all others
    place = F.when(F.col("id") == 9_999, F.lit((1 << 63) - 1)).otherwise(F.col("id") * 1_000_003 - (1 << 40))
    df = spark.range(10_000).select(place.alias("k"), (F.col("id") % 7).alias("v"))
    got = sampling.prefix_sum(df, "k", "v", "before").orderBy("k").collect()
    want, acc = [], 0
    for k in range(10_000):
        want.append(acc)
        acc += k % 7
    assert [r["before"] for r in got] == want


def test_packing_rebuilds_the_stream(spark):
    docs = spark.createDataFrame([(0, [5, 6]), (1, []), (2, [7, 8, 9, 10])], "doc_id long, tokens array<int>")
    stream = [t for r in packing.token_stream(docs, eos=0).orderBy("offset").collect() for t in r["ids"]]
    assert stream == [5, 6, 0, 0, 7, 8, 9, 10, 0]
    w = packing.windows(packing.token_stream(docs, eos=0), 2).orderBy("chunk").collect()
    assert [r["ids"] for r in w] == [[5, 6, 0], [0, 0, 7], [7, 8, 9], [9, 10, 0]]
    assert [r["ids"] for r in packing.chunks(packing.token_stream(docs, eos=0, eos_for_empty=False), 2).orderBy("chunk").collect()] == [[5, 6, 0], [7, 8, 9]]


def test_greedy_shards(spark):
    df = spark.createDataFrame([("d", 1, "doc1"), ("d", 2, "doc2"), ("d", 3, "doc3")], "dataset string, doc_id long, text string")
    assert [(r["shard"], r["n_docs"]) for r in packing.greedy_shards(df, 10).orderBy("shard").collect()] == [(0, 2), (1, 1)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "cat cat cat"), (3, "dogs bark"), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Cat!"), (2, "zebra")], "query_id long, text string")
    got = retrieval.bm25(q, docs, 3).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [2, 1]
    idf, avg = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1), 8 / 4
    assert got[0]["score"] == pytest.approx(idf * 3 * 2.5 / (3 + 1.5 * (0.25 + 0.75 * 3 / avg)))


def test_bm25_in_blocks_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "é", "dd", "e", "ff", "g"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(90)] + ["a b dd"] * 9 + [None]
    asked = [(k, " ".join(word() for _ in range(3))) for k in range(7)] + [(7, "zz"), (8, None)]
    toks = [(t or "").split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    idf = {w: math.log((len(toks) - n + 0.5) / (n + 0.5) + 1) for w in "a b é dd e ff g".split() for n in [sum(w in t for t in toks)]}
    want = []
    for q, text in asked:
        score = {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in (text or "").split()) for d, t in enumerate(toks) if d % 3}
        want += [(q, d, n) for n, d in enumerate(sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))[:5], 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for only in (F.col("doc_id") % 3 != 0, docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("doc"))):
        for query_bytes in (12, 1 << 20):
            got = retrieval.bm25(queries, docs, 5, candidates=only, query_bytes=query_bytes)
            assert sorted((r["query_id"], r["doc"], r["rank"]) for r in got.collect()) == sorted(want) and len(want) > 30


def test_normal_forms_of_every_character(spark):
    from unittest import mock

    odd = [chr(x) for x in range(0x10000) if not 0xD800 <= x < 0xE000] + ["\U0001d15e", "\U00010400", "\U0001f600"]
    df = spark.createDataFrame([(f"{x} a{x} \n {x}b\t{x}",) for x in odd] + [("",), (None,), (" \u3000\n",)], "t string").withColumn("n", F.length("t"))
    old_strip = lambda c: F.regexp_replace(c, rf"\A{T.SPACE}++|(?<!{T.SPACE}){T.SPACE}++\z", "")
    got = [T.strip(F.col("t")), T.nfc(F.col("t")), T.casefold(F.col("t")), T.normalize(F.col("t"))]
    icu = lambda name, method, flag: F.reflect(F.lit(name), F.lit(method), F.col("t"), F.lit(flag))
    with mock.patch.object(T, "strip", old_strip), mock.patch.object(T, "_NEAR_SPACE", ""):
        want = [old_strip(F.col("t")), icu("com.ibm.icu.text.Normalizer", "compose", False), icu("com.ibm.icu.lang.UCharacter", "foldCase", True), T.normalize(F.col("t"))]
    same = F.array(*(F.when(F.col("t").isNull(), g.isNull()).otherwise(g.eqNullSafe(w)) for g, w in zip(got, want)))
    assert df.select("t", same.alias("same")).where(F.exists("same", lambda x: ~x)).collect() == []
    assert set(T.WHITE) == {x for x in odd if x.isspace()} and "btrim" in df.select(T.strip(F.col("t")))._jdf.queryExecution().logical().toString().lower()


def test_normalize_of_plain_texts_runs_no_pattern_over_them(spark):
    """As lines taken one by one, whatever breaks and blanks stand in them; a plain text takes a small part of the time of a pattern that looks at each character."""
    import re
    import time
    import unicodedata

    rng = random.Random(6)
    parts = ["a", "é", "e\u0301", "本", "word", " ", "  ", "\t", "\n", "\r", "\r\n", "\n\r", *"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u200b\u3000"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3_000)]
    want = {t: "\n".join(x for x in (re.sub("[ \t]+", " ", line).strip() for line in unicodedata.normalize("NFC", t).splitlines()) if x) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", T.normalize(F.col("t")).alias("n")).collect()} == want
    plain = spark.range(400).select(F.repeat(F.concat(F.lit("a line with é and " + "some words of a plain text, " * 5 + "\n"), F.col("id").cast("string")), 400).alias("t")).localCheckpoint()
    space, breaks = T.SPACE, T.LINE_BREAK
    pattern = rf"(?=[^!-\x84\x{{A1}}-\x{{167F}}])(?<!{space})[\s\x1c-\x1f\x85\p{{Z}}&&[^\n\r\x0B\f\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]]*+(?:{breaks}){space}*+"
    took = []
    for c in (F.regexp_replace("t", pattern, "\n"), T.normalize(F.col("t"))):
        took.append([])
        for _ in range(3):
            began = time.perf_counter()
            plain.select(c.alias("n")).agg(F.sum(F.octet_length("n"))).first()
            took[-1].append(time.perf_counter() - began)
    assert min(took[1]) < min(took[0]) / 2, took


def test_characters_are_counted_as_one_by_one(spark):
    """Counts over runs and by shortcuts for ASCII texts equal those of single characters."""
    import unicodedata

    rng = random.Random(7)
    letters = [*map(chr, range(0x180)), *"\u0301\u03a9\u0416\u0627\u0915\u3042\u4e00\uac00\u200b\u2014\u2029\ufffd\U0001f600"]
    rows = ["".join(rng.choices(letters[: rng.choice([128, len(letters)])], k=rng.randint(0, 9))) for _ in range(3_000)]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = {r["t"]: tuple(r)[1:] for r in df.select("t", *(f(F.col("t")) for f in (T.visible_count, T.alnum_count, T.control_count, T.dominant_script))).collect()}
    kind = unicodedata.category
    for t in rows:
        count = {name: (sum(any(a <= ord(x) <= b for a, b in own) for x in t), -next((k for k, x in enumerate(t) if any(a <= ord(x) <= b for a, b in own)), 0), name) for name, own in T.SCRIPTS.items()}
        script = "Japanese" if count["Japanese"][0] else max((x for x in count.values() if x[0]), default=(0, 0, "Unknown"))[2]
        assert got[t] == (sum(not x.isspace() and kind(x)[0] not in "CZ" for x in t), sum(kind(x)[0] in "LN" for x in t), sum(kind(x)[0] == "C" and x not in "\n\t" for x in t), script), repr(t)


def test_minimizers_equal_their_definition():
    """Of every w neighbouring runs of q bytes the least hash, of runs hashed byte by byte; time grows with the logarithm of q."""
    import time

    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aé b", k=rng.choice([0, 1, 3, 9, 40]))) for _ in range(rng.randint(1, 6))]
        q, w, want = rng.randint(1, 30), rng.randint(1, 20), []
        for row, t in enumerate(texts):
            b, last = (t or "").encode(), None
            mixed = []
            for k in range(len(b) - q + 1):
                h = 0
                for x in b[k : k + q]:
                    h = (h * 0x9E3779B97F4A7C15 + x + 1) % 2**64
                h = (h ^ h >> 31) * 0x94D049BB133111EB % 2**64
                mixed.append(h ^ h >> 29)
            for k in range(len(mixed) - w + 1):
                least = min(mixed[k : k + w])
                want += [] if least == last else [(least, row)]
                last = least
        key, row = dedup._runs(pa.array(texts, pa.string()), q, w)
        assert list(zip(key.view("u8").tolist(), row.tolist())) == want
    column, took = pa.array(["".join(rng.choices("abcdefgh ", k=5_000))] * 100), {}
    for q in (4, 256):
        took[q] = []
        for _ in range(3):
            began = time.perf_counter()
            dedup._runs(column, q, 2)
            took[q].append(time.perf_counter() - began)
    assert min(took[256]) < 5 * min(took[4]), took


def test_verifiers(spark):
    rows = [("who is Ada Lovelace", "Ada Lovelace wrote programs.", ["Ada Lovelace wrote the first programs"]), ("who is Ada Lovelace", "Ada wrote it", ["bananas are yellow"]), ("q", "a", None)]
    df = spark.createDataFrame(rows, "q string, a string, e array<string>")
    assert [r[0] for r in df.select(verify.grounded(F.col("q"), F.col("a"), F.col("e"))["status"]).collect()] == ["PASS", "REVISE", "UNVERIFIED"]
    code = spark.createDataFrame([("```python\nx = 1\n```",), ("```python\nx = = 1\n```",), ("plain",)], "a string")
    assert [r[0] for r in code.select(verify.code(F.col("a"))["status"]).collect()] == ["PASS", "REVISE", "UNVERIFIED"]


def test_route(spark):
    from tessera.plans.answers import ASKED

    df = spark.createDataFrame([(q,) for q in ASKED], "q string")
    assert [r[0] for r in df.select(retrieval.route(F.col("q"))["path"]).collect()] == ["TOOL", "TOOL", "RETRIEVE", "THINK", "ABSTAIN", "FAST"]


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [7, 8]), ([1], [9] * 10)], "p array<int>, r array<int>")
    got = [r[0] for r in df.select(sft.mask_separate(F.col("p"), F.col("r"), 6, 98, 99)).collect()]
    assert got[0]["input_ids"] == [98, 4, 5, 7, 8, 99] and got[0]["labels"] == [-100, -100, -100, 7, 8, 99]
    assert got[1]["input_ids"] == [98, 9, 9, 9, 9, 99] and got[1]["attention_mask"] == [1] * 6


def test_verdicts(spark):
    rows = [("abstain", "ABSTAIN", "", "", [], []), ("abstain", "PASS", "x", "", [], []), ("retrieve_evidence", "PASS", "x", "", ["d"], []), ("execute_tool", "REVISE", "it is 42", "42", [], []), ("answer", "PASS", "Paris", "paris", [], []), ("answer", "UNVERIFIED", "Paris", "paris", [], [])]
    df = spark.createDataFrame(rows, "b string, s string, a string, e string, c array<string>, t array<string>")
    c = F.col
    got = [tuple(r[0]) for r in df.select(evaluation.passed_and_hallucinated(c("b"), c("s"), c("a"), c("e"), c("c"), c("t"))).collect()]
    assert got == [(True, False), (False, True), (True, False), (True, False), (True, False), (False, False)]


def naive_bpe(counts, alphabet, most):
    """Most frequent pair first, of equals the one of lower ids; every piece counts."""
    number = {bytes([b]): k for k, b in enumerate(alphabet)}
    words, merges = [([number[bytes([b])] for b in p.encode()], n) for p, n in counts.items()], []
    names = dict(enumerate(number))
    while len(merges) < most:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((names[best[0]], names[best[1]]))
        new = len(names)
        names[new] = names[best[0]] + names[best[1]]
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [new]
                i += 1
    return tuple(merges)


def test_bpe_counts_every_piece(spark):
    rng = random.Random(31)
    counts = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))): rng.choice([1, 1, 1, 2, 5, 40]) for _ in range(60)} | {"zzyx": 1}
    df = spark.createDataFrame(list(counts.items()), "piece string, n long").repartition(3)
    used = sorted({b for p in counts for b in p.encode()})
    want = naive_bpe(counts, used, 40)
    assert len({a + b for a, b in want}) == len(want)  # no token is made twice, where the library has a rule of its own
    assert tokenizer.train(df, 4 + len(used) + 40).merges == want
    assert tokenizer.train(df, 4 + len(used) + 40, most_pairs=5, most_symbols=10).merges == want  # many phases


def test_contamination_in_any_script(spark):
    """Chinese and Japanese fragments without spaces, shared openings, many fragments a key; equal to a search of all pairs, by either join."""
    rng = random.Random(4)
    of = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    han, kana, latin = "天地玄黄宇宙洪荒日月盈昃", "あいうえおかきくけこ", "abcd efg hij "
    frags = [of(s, rng.randint(80, 160)) for s in (han, kana, latin) for _ in range(8)] + ["x" * 80, " " * 40 + "y" * 41] + ["open " * 20 + of(latin, 20) for _ in range(6)]
    texts = [of(rng.choice([han, kana, latin]), rng.randint(0, 300)) for _ in range(60)] + [None, "", "x" * 79, "x" * 500]
    for k, f in enumerate(frags):
        texts += [of(latin, k) + f + of(han, 5), f[:-1], f[1:] + "!", f]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, frags[0])], "doc_id long, folded string").repartition(5)
    known = spark.createDataFrame([(f,) for f in frags + ["", frags[0]]], "fragment string")
    want = sorted({k for k, t in [*enumerate(texts), (0, frags[0])] if t and any(f in t for f in frags)})
    for most in (8 << 20, 0):
        found = dedup.contaminated(docs, known, most_key_bytes=most)
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
        assert sorted(r[0] for r in found.collect()) == want
    assert dedup.contaminated(docs, known.where("fragment = ''")).count() == 0
    short = spark.createDataFrame([("漢",), ("ab",)], "fragment string")
    assert dedup.contaminated(spark.createDataFrame([(1, "a漢"), (2, "ba"), (3, "xab")], "doc_id long, folded string"), short).count() == 2


def test_bpe_queries_train_at_the_reference_size(spark, sf_dir):
    from tessera.plans.tokens import bpe_merges

    assert bpe_merges(spark, sf_dir).count() > 256


def test_version_expressions(spark):
    """Named cases, and random versions and expressions against the plain model."""
    import semver_model

    yes = [("1.2.0", "^1.0.0"), ("0.2.5", "^0.2.3"), ("1.2.9", "~1.2"), ("1.9.0", "1.x"), ("3.0.0", ">=1.0.0 <2.0.0 || 3.0.0"), ("1.0.0-rc.2", ">1.0.0-rc.1"), ("1.2.3", None), ("1.10.0", ">1.9.0")]
    no = [("2.0.0", "^1.0.0"), ("0.3.0", "^0.2.3"), ("1.3.0", "~1.2"), ("2.0.0", "1.x"), ("2.0.0-rc.1", "^1.0.0"), ("1.0.0-rc.1", ">=1.0.0"), ("x", "^1.0.0"), (None, "*"), ("1.0.0", "odd")]
    rng = random.Random(12)
    number = lambda: rng.choice(["0", "1", "2", "10", "x", "*"])
    version = lambda: ".".join(number() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "-rc.1", "-rc.2", "-alpha", "-1", "+b"])
    term = lambda: rng.choice(["", "^", "~", ">=", "<=", ">", "<", "="]) + rng.choice(["", " "]) + rng.choice([version(), version(), "odd"])
    cases = [(version(), rng.choice([" ", " || "]).join(term() for _ in range(rng.randint(1, 3)))) for _ in range(600)]
    cases += [(rng.choice(["0.0.1", "0.1.0", "1.0.0", "1.2.3", "1.2.3-rc.1", "10.0.0"]), term()) for _ in range(600)] + yes + no + [("1.0.0", ""), ("1.0.0", " || ")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, v string, e string")
    got = [r[0] for r in df.orderBy("k").select(capabilities.satisfies(F.col("v"), F.col("e"))).collect()]
    assert got == [semver_model.satisfies(v, e) for v, e in cases]
    assert got[1200 : 1200 + len(yes) + len(no)] == [True] * len(yes) + [False] * len(no) and 100 < sum(got) < 1100


def test_capability_match(spark):
    declared = [
        ("a", "function_calling", "2.0.0", {"supports_parallel_calls": "true", "max_tokens": "4096"}),
        ("b", "function_calling", "1.2.0", {"supports_parallel_calls": "true", "max_tokens": "2048"}),
        ("a", "bengali", "2.1.0", {"script_support": "Bengali,Latin", "indic_glue_benchmark_score": "88.4"}),
    ]
    requests = [
        (1, "function_calling", "^1.0.0", {"max_tokens": ">=1024"}),
        (2, "function_calling", ">=1.0.0", {"max_tokens": ">=4096"}),
        (3, "bengali", "~2.1", {"script_support": "Bengali", "indic_glue_benchmark_score": ">=80"}),
        (4, "bengali", "^2.0.0", {"dialect_coverage": "Dhaka"}),
    ]
    declared = spark.createDataFrame(declared, "model string, name string, version string, properties map<string, string>")
    requests = spark.createDataFrame(requests, "request_id int, name string, expression string, required map<string, string>")
    assert sorted(map(tuple, capabilities.match(requests, declared).collect())) == [(1, "b", "function_calling", "1.2.0"), (2, "a", "function_calling", "2.0.0"), (3, "a", "bengali", "2.1.0")]


def test_capabilities_alike_meet_in_blocks(spark):
    import semver_model

    declared = [(f"m{k}", "n" if k % 9 else None, ["1.2.0", "1.2.0-rc.1", "2.0.0", "odd"][k % 4], {"max_tokens": str(k % 3)} if k % 5 else None) for k in range(120)]
    requests = [(k // 2, "n", [None, "^1.0.0", ">=2.0.0"][k % 3], [None, {"max_tokens": ">=1"}][k % 2]) for k in range(60)]
    want = []
    for r, _, e, needed in requests:
        for m, name, v, p in declared:
            if name and (not needed or p and int(p["max_tokens"]) >= 1) and (not e or semver_model.satisfies(v, e)):
                want.append((r, m, name, v))
    declared = spark.createDataFrame(declared, "model string, name string, version string, properties map<string, string>")
    requests = spark.createDataFrame(requests, "request_id int, name string, expression string, required map<string, string>")
    for block_rows in (3, 1000):
        assert sorted(map(tuple, capabilities.match(requests, declared, block_rows=block_rows).collect())) == sorted(want) and len(want) > 500


def test_accounting(spark):
    assert accounting.perplexity(spark.createDataFrame([], "l double, n long"), "l", "n").first()[0] is not None
    checks = spark.createDataFrame([("a", "error", True), ("b", "warning", False)], "name string, severity string, ok boolean")
    assert accounting.decision(checks).first()["decision"] == "GO"


def test_jsonl_and_publish(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"text":"a","n":1}\n\nnot json\n[1]\n{"text":"b"}\n')
    got = [r["status"] for r in readers.read_jsonl(spark, str(p), "text string, n int").collect()]
    assert sorted(got) == ["invalid_json", "not_object", "ok", "ok"]
    df = spark.range(3)
    assert not writers.publish(df, f"file://{tmp_path}/out", ["too many duplicates"])
    assert writers.publish(df, f"file://{tmp_path}/out", []) and spark.read.parquet(f"{tmp_path}/out").count() == 3
    with pytest.raises(FileExistsError):
        writers.publish(df, f"file://{tmp_path}/out", [])


def _packed(spark, tmp_path, stream, **options):
    """One row for each of some runs of the stream, dealt over tasks."""
    rng, at, rows = random.Random(1), 0, []
    while at < len(stream):
        n = min(rng.choice([1, 5, 40, 300]), len(stream) - at)
        rows.append((at, stream[at : at + n]))
        at += n
    path = f"file://{tmp_path}/packed"
    df = spark.createDataFrame([*rows, (7, [])], "offset long, ids array<long>").repartition(3)
    return path, packed.write_packed(df, path, 100, **options)


def test_packed_files_round_trip(spark, tmp_path):
    """Files of few tokens, so that windows and rows cross them; nothing is replaced."""
    rng = random.Random(3)
    stream = [rng.randint(0, 99) for _ in range(2_001)]
    path, manifest = _packed(spark, tmp_path, stream, file_tokens=64, eos=7)
    assert manifest["token_count"] == 2_001 and manifest["tokens_bytes"] == 8_004 and manifest["eos_token_count"] == stream.count(7) and len(manifest["files"]) > 20
    back = [t for r in packed.read_packed(spark, path).orderBy("offset").collect() for t in r["ids"]]
    assert back == stream
    for s in (1, 10, 100, 1000, 2000):
        got = {r["index"]: (r["input_ids"], r["labels"]) for r in packed.read_packed(spark, path, seq_len=s).collect()}
        assert got == {k: (stream[k * s : k * s + s], stream[k * s + 1 : k * s + s + 1]) for k in range((2_001 - 1) // s)}
    with pytest.raises(Exception, match="shorter than one"):
        packed.read_packed(spark, path, seq_len=2_001).count()
    with pytest.raises(Exception, match="exists|Exists|packed"):
        _packed(spark, tmp_path, stream)


def test_packed_files_are_read_together(spark, tmp_path, monkeypatch):
    """Tasks grow with tokens, not with files; what is sent to a task names its own files only; windows reach into the next task's files."""
    import pickle

    rng = random.Random(4)
    stream = [rng.randint(0, 99) for _ in range(2_001)]
    path, manifest = _packed(spark, tmp_path, stream, file_tokens=20)
    files = [f["name"] for f in manifest["files"]]
    assert len(files) > 60 and packed.read_packed(spark, path, seq_len=10).rdd.getNumPartitions() == 1
    monkeypatch.setattr(packed, "TASK_TOKENS", 150)
    for s in (1, 7, 100, 400, 2000, None):
        reader = packed.PackedReader(path, s)
        parts = reader.partitions()
        assert len(parts) < 20 and [f["name"] for p in parts for f in p.own] == files
        sent = pickle.dumps(reader)
        assert not any(f.encode() in sent for f in files)
        rows = [r for p in parts for b in pickle.loads(sent).read(p) for r in b.to_pylist()]
        if s is None:
            assert [t for r in rows for t in r["ids"]] == stream
        else:
            assert rows == [{"index": k, "input_ids": stream[k * s : k * s + s], "labels": stream[k * s + 1 : k * s + s + 1]} for k in range(2_000 // s)]


@pytest.mark.parametrize("harm,what", [("marker", "COMPLETE"), ("short", "byte length"), ("byte", "hash mismatch"), ("vocabulary", "outside the vocabulary"), ("key", "lacks")])
def test_packed_files_are_checked(spark, tmp_path, harm, what):
    path, manifest = _packed(spark, tmp_path, list(range(100)) * 5, file_tokens=200)
    folder = tmp_path / "packed"
    first = folder / manifest["files"][0]["name"]
    if harm == "marker":
        (folder / "COMPLETE").unlink()
    elif harm == "short":
        first.write_bytes(first.read_bytes()[:-4])
    elif harm == "byte":
        first.write_bytes(bytes([first.read_bytes()[0] ^ 1]) + first.read_bytes()[1:])
    else:
        import json

        changed = manifest | {"tokenizer_vocab_size": 50}
        if harm == "key":
            changed.pop("dtype")
        (folder / "manifest.json").write_text(json.dumps(changed))
    with pytest.raises(Exception, match=what):
        packed.read_packed(spark, path).count()


def test_packed_writer_refuses(spark, tmp_path):
    for rows, what in (([(0, [5]), (2, [6])], "join"), ([(1, [5])], "join"), ([(0, [100])], "vocabulary")):
        df = spark.createDataFrame(rows, "offset long, ids array<long>")
        with pytest.raises(Exception, match=what):
            packed.write_packed(df, f"file://{tmp_path}/refused", 100)
        assert not (tmp_path / "refused").exists()


def test_length_statistics_are_exact(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0, 1, 7, -5, 10**12 + rng.randint(0, 9), rng.randint(-(10**6), 10**6), 2048, 4095, 4096])) for g in ("a", "a", "b", None) for _ in range(157)] + [("one", 3), ("none", None)]
    got = {r[0]: tuple(r)[1:] for r in sft.length_statistics(spark.createDataFrame(rows, "role string, w long"), "role", "w").collect()}
    want = {}
    for g in ("a", "b", None, "one"):
        own = sorted(v for x, v in rows if x == g and v is not None)
        want[g] = (len(own), sum(own), own[len(own) // 2], own[math.floor(len(own) * 0.95)])
    assert got == want


def test_corpus_digest_does_not_hang_on_ids(spark):
    texts = ["a", None, "b", "b", "ccc"] * 8
    digest = lambda ids, t=texts: accounting.corpus_digest(spark.createDataFrame(list(zip(ids, t)), "doc_id long, text string").repartition(3), per_leaf=4).first()[0]
    plain = digest(range(40))
    assert plain == digest([k * 10**12 - 5 for k in range(40)]) and plain != digest(range(40, 0, -1))
    assert digest([1] * 40) == digest([1] * 40, texts[::-1])
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(t or "") for t in texts]
    for _ in range(3):
        level = [sha("\n".join(level[k : k + 4])) for k in range(0, len(level), 4)]
    assert [plain] == level


def test_eval_fragments(spark, tmp_path):
    p = tmp_path / "eval.jsonl"
    p.write_text('{"q": "%s", "n": {"a": ["%s", "short"]}}\n' % ("x y " * 30, "Caf\\u00e9 " * 20))
    got = {r[0] for r in readers.eval_fragments(spark, str(p)).collect()}
    assert got == {("x y " * 30).strip(), ("café " * 20).strip()}


def test_packing_by_slices(spark):
    """Equal to slicing the whole stream; empty, null and very long documents, repeated ids, chunks of one document and of many."""
    rng = random.Random(2)
    docs = [(k, [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 40, 400]))]) for k in rng.sample(range(10**6), 60)]
    df = spark.createDataFrame([*docs, (-5, None)], "doc_id long, tokens array<int>").repartition(5)
    stream = [x for _, t in sorted([*docs, (-5, [])]) for x in [*t, 0]]
    placed = packing.token_stream(df, eos=0)
    for length in (1, 7, 64):
        got = {r["chunk"]: r["ids"] for r in packing.chunks(placed, length).collect()}
        assert got == {k: stream[k * (length + 1) :][: length + 1] for k in range(len(stream) // (length + 1))}
        got = {r["chunk"]: r["ids"] for r in packing.windows(placed, length).collect()}
        assert got == {k: stream[k * length :][: length + 1] for k in range((len(stream) - 1) // length)}
    twice = packing.token_stream(spark.createDataFrame([(1, [5, 6]), (1, [5, 6]), (2, [7])], "doc_id long, tokens array<int>"))
    assert sorted((r["offset"], r["ids"]) for r in twice.collect()) == [(0, [5, 6]), (2, [5, 6]), (4, [7])]
    assert packing.chunks(placed.where("false"), 3).count() == 0


def test_positional_split_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "k int, t string")
    assert sorted((r["k"], r["split"]) for r in sampling.positional_split(df, "k", 50).collect()) == [(1, "train"), (1, "train"), (2, "val"), (3, "val")]


def _greedy(sizes, most):
    shard, total, out = 0, 0, []
    for n in sizes:
        if total and total + n > most:
            shard, total = shard + 1, 0
        total += n
        out.append(shard)
    return out


def test_steps_compose():
    """A run's step function against the fold from every number of open bytes, alone and composed."""
    rng = random.Random(8)
    for _ in range(150):
        most = rng.choice([1, 5, 20])
        runs = [np.array([rng.choice([0, 0, 1, 2, 3, 7, 30]) for _ in range(rng.randint(1, 9))]) for _ in range(3)]
        whole = None
        for r in runs:
            own = packing._steps(r, most)
            whole = whole.then(own) if whole else own
        for total in range(45):
            now, begun = total, 0
            for r in runs:
                begun_here = 0
                at = packing._shard_of(r, most, now)
                for k, n in enumerate(r.tolist()):
                    if now and now + n > most:
                        begun, begun_here, now = begun + 1, begun_here + 1, 0
                    now += n
                    assert at[k] == begun_here
            assert whole(total) == (now, begun)


def test_shard_numbers_over_many_runs(spark):
    """One group of most rows over many runs and levels, an absent group, documents of no bytes and over the bound."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([0, 1, 5, 5, 9, 40, 120])) for k in range(600)]
    df = spark.createDataFrame(rows, "dataset string, doc_id long, n long").repartition(4)
    got = {(r[0], r[1]): r[2] for r in packing.shard_numbers(df, 100, "dataset", "doc_id", F.col("n"), run_rows=7, fan=3).collect()}
    want = {}
    for g in ("hot", "b", None):
        own = [(k, n) for d, k, n in rows if d == g]
        want |= {(g, k): s for (k, _), s in zip(own, _greedy([n for _, n in own], 100))}
    assert got == want
    assert packing.shard_numbers(df.where("false"), 100, "dataset", "doc_id", F.col("n")).count() == 0


def _sample(rows, target, ratios, seed, refill):
    """Document by document, in the order of the hashes."""
    import hashlib

    key = lambda s, i: hashlib.sha256(f"{s}:{i}".encode()).hexdigest()
    taken, total, rest = [], 0, []
    for stratum, ratio in ratios.items():
        quota, cum, open_ = int(target * ratio), 0, True
        for i, _, n in sorted((r for r in rows if r[1] == stratum), key=lambda r: key(seed, r[0])):
            fits = cum + n <= quota or cum == 0
            if open_ and (fits or cum + n - quota < quota - cum):
                taken.append((i, stratum, n, "quota"))
                total += n
            else:
                rest.append((i, stratum, n))
            open_ &= fits
            cum += n
    missing = target - total
    for i, stratum, n in sorted((r for r in rest if r[1] in refill), key=lambda r: key(seed + 1, r[0])):
        if missing <= 0:
            break
        taken.append((i, stratum, n, "refill"))
        missing -= n
    return sorted(taken)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_budget_sample_by_prefixes(spark, digits):
    rng = random.Random(digits)
    for target in (0, 7, 300, 100_000):
        rows = [(i, rng.choice("aaabc"), rng.choice([0, 1, 3, 20, 150])) for i in range(150)]
        ratios = {"a": 0.5, "b": 0.3, "c": 0.2}
        df = spark.createDataFrame([*rows, (999, None, 4), (998, "other", 4)], "doc_id long, stratum string, n_tok long").repartition(3)
        got = sampling.budget_sample(df, target, ratios, 5, refill=("a", "b"), digits=digits)
        assert sorted(map(tuple, got.collect())) == _sample(rows, target, ratios, 5, ("a", "b"))
    with pytest.raises(ValueError):
        sampling.budget_sample(df, 10, {"a": 0.5}, 1)
