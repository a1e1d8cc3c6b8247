"""Each operator against a brute-force model, on edge rows: nulls, empty and very
long texts, ties, repeated rows, empty tables, extra columns with odd names."""

import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_windows, fingerprints, line_dedup, near_dedup, packing, pieces, quality_rules, shared, suffix_dedup, token_files, toxicity
from tessera.llm.components import connected_components

WORD_BPE, PIECE_BPE = shared.tokenizer_path("word_bpe_49k.json"), shared.tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, score double, component long, rank int, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "idea", "über", "naïve", "night", "walks", "seven", "doors", "green"]) for _ in range(n))


def edge_rows():
    rng = random.Random(4)
    base, shared_part = sentence(rng, 60), sentence(rng, 30)
    near = base.split()
    near[5] = "changed"
    rows = [(5, base), (9, base), (9, base), (12, " ".join(near)), (20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "one"), (30, sentence(rng, 40) + " " + shared_part), (31, shared_part + " " + sentence(rng, 40))]
    rows += [(40, "a" * 3000), (41, sentence(rng, 9000)), (42, "x\ny\n" + shared_part + "\n" + shared_part), (43, shared_part + "\nzz " + "q " * 20), (44, "é" * 120), (45, "e" + "é" * 119)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "b", 0.5, 1, 2, 3) for d, t in edge_rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def texts():
    return [(d, t or "") for d, t in edge_rows()]


# --- quality rules


def test_quality_measures(docs):
    got = by_id(quality_rules.quality_cascade(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = {}
    for d, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = {}
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), []).append(i)
        rep = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.setdefault(d, []).append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_quality_order_does_not_matter(docs):
    a = by_id(quality_rules.quality_cascade(docs), "kept")
    b = by_id(quality_rules.quality_cascade(docs, rules=quality_rules.RULES[::-1], sample_rows=1), "kept")
    assert a == b


# --- suffix dedup


def brute_repeats(rows, span=50):
    least = {}
    for d, t in rows:
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            least[w] = min(d, least.get(w, d))
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if least[t[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.setdefault(d, []).append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_suffix_dedup(docs):
    got = by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats([(d, t.encode()) for d, t in texts()])


def test_suffix_dedup_splits_hot_anchors_and_blocks(docs):
    """Each block a few texts, and every shared anchor on the way of hot ones."""
    got = by_id(suffix_dedup.remove_repeats(docs, hot_contexts=1, block_bytes=500), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats([(d, t.encode()) for d, t in texts()])


def brute_cut(rows):
    """Texts without their repeated bytes, halves of characters dropped."""
    least, out = {}, []
    raw = [((1 << 63) - 1 if d is None else d, None if t is None else t.encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t or b"") - 49):
            least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    for d, t in raw:
        gone = bytearray(len(t or b""))
        for i in range(len(gone) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append(None if t is None else bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_suffix_dedup_text(docs):
    out = suffix_dedup.without_repeats(docs.withColumn("__removed", F.lit("own")).withColumn("a.b", F.lit(1)))
    assert out.columns == [*docs.columns, "__removed", "a.b", "__removed_"]
    want = sorted(zip((d for d, _ in edge_rows()), brute_cut(edge_rows())), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want


def test_deep_shallow_sorts():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice((3, 20, 40, 70)))) for _ in range(300)]
    strings += [b"common prefix of many bytes " + s[:30] for s in strings]
    lens = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), "u1")
    order, number = suffix_dedup.deep_shallow(data, np.cumsum(lens) - lens, lens, np.zeros(len(strings), "u8"))
    ranked = [strings[i] for i in order]
    assert ranked == sorted(strings)
    assert len({(n, s) for n, s in zip(number.tolist(), strings)}) == len(set(strings)) == number.max() + 1


@pytest.mark.parametrize("seed", range(8))
def test_anchors_depend_on_windows_alone(seed):
    rng = np.random.default_rng(seed)
    part = rng.integers(97, 100, 80).astype("u1")
    a, b = np.concatenate([rng.integers(97, 100, 33).astype("u1"), part]), np.concatenate([rng.integers(97, 100, 61).astype("u1"), part, rng.integers(97, 100, 5).astype("u1")])

    def of(buf):
        out = {}
        for h, p, s, e in zip(*suffix_dedup.anchors(buf, np.array([len(buf)]))):
            for k in range(s, e + 1):
                out[k] = (int(h), int(p) - k)
        return out

    x, y = of(a), of(b)
    assert all(x[33 + k] == y[61 + k] for k in range(31)) and len(x) == len(a) - 49


# --- packing


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    want = {}
    for d, t in texts():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want.setdefault(d, []).append((k // 2048, k, len(own), zlib.crc32(own.tobytes())))
    rows = packing.best_fit_pack(docs, WORD_BPE).collect()
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_minimum_bin_slack_places_every_rank_once(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(20)}
    runs, seen, load = packing.minimum_bin_slack(hist, 100).tolist(), {}, {}
    for n, a, b, t, first, _ in runs:
        for rank in range(a, b):
            assert (n, rank) not in seen
            seen[n, rank] = True
            load[first + (rank - a) // t] = load.get(first + (rank - a) // t, 0) + n
    assert len(seen) == sum(hist.values()) and max(load.values()) <= 100
    assert len(load) <= 1.1 * (sum(n * c for n, c in hist.items()) / 100) + 2


def test_word_encoder_equals_library():
    rng = random.Random(3)
    enc = shared.WordEncoder(WORD_BPE, most=50)
    for _ in range(1500):
        t = "".join(rng.choice("abzAÉéñ'’.,!%<|>0½ ́ \n\tßſİ\x1c\x85　漢🙂") for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


# --- line dedup


def within(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(rows, min_words=1, near_words=6):
    order = sorted(((d, no), tuple(x for x in re.split("[ \t\x0b\f\r]+", line) if x)) for d, t in rows for no, line in enumerate((t or "").split("\n")))
    order = [(at, w) for at, w in order if len(w) >= min_words]
    first = {}
    for at, w in order:
        first.setdefault(w, at)
    long = [(w, at) for w, at in first.items() if len(w) >= near_words]
    near = {w for w, at in long if any(b < at and w != v and within(w, v) for v, b in long)}
    gone = {}
    for at, w in order:
        if w in near or first[w] < at:
            gone.setdefault(at[0], set()).add(at[1])
    return gone


def line_rows():
    rng = random.Random(8)
    base = [sentence(rng, n).split() for n in (12, 13, 23, 24, 25, 48, 49, 7)]
    rows = [(k, "\n".join(" ".join(w) for w in base)) for k in (3, 4)]
    for k in range(40):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            kind = rng.randint(0, 2)
            w[i : i + (kind != 1)] = [f"w{rng.randint(0, 3)}"] * (kind != 2)
        rows.append((100 + k, " ".join(w) + "\n" + sentence(rng, 3)))
    return rows


def test_line_dedup(spark):
    rows = line_rows() + edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["d"]: set(r["lines"]) for r in line_dedup.removed_lines(df, 6, 12).collect()}
    assert got == brute_lines(rows, 6, 12)


def test_line_dedup_of_short_near_lines(spark):
    rows = line_rows() + [(900, "Licensed under the Apache License, Version 2.0."), (901, "Licensed under the Apache Licence, Version 2.0."), (902, "a b c d e f g h i j k l"), (903, "a b c d e f h i j k l"), (904, "a b c d e f"), (905, "a b c x d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["d"]: set(r["lines"]) for r in line_dedup.removed_lines(df, 1, 6).collect()}
    assert got == brute_lines(rows, 1, 6) and {901, 903, 905} <= set(got)


def test_pipeline_drops_near_lines_of_seven_words(spark):
    import corpus_pipeline

    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "left\nLicensed under the Apache Licence, Version 2.0.")]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, None).collect()} == {1: rows[0][1], 2: "left"}


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(21)
    line = [sentence(rng, 9) + f" {k}" for k in range(6)]
    twice = [line[0], line[1], line[2]]
    rows = [(1, "\n".join(twice)), (None, "\n".join([line[3], line[1], line[4]])), (None, "\n".join([line[5], "own one two three four five", line[0]])), (7, line[2] + "\nleft 1 2 3 4 5 6"), (7, "left 7 6 5 4 3 2\n" + line[3])]
    rows += [(None, None), (7, None), (8, "same place one two three four five"), (8, "same place one two three four five\nand more words of one row")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {(r["doc_id"], r["text"]) for r in out}
    assert len(out) == len(rows) and all(r["__removed"] == 0 for r in out if r["text"] is None)
    assert {(1, rows[0][1]), (None, None), (7, "left 1 2 3 4 5 6")} <= got
    lines = sorted(x for _, t in got for x in (t or "").split("\n") if x)
    assert lines == sorted({x for _, t in rows for x in (t or "").split("\n") if x})  # each line once, none lost


def test_pipeline_cuts_repeats_of_null_and_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(22)
    shared_part = sentence(rng, 40)
    a, b = "a" * 20 + shared_part, "b" * 20 + shared_part
    rows = [(1, shared_part), (2, a), (2, b), (None, "c" * 20 + shared_part), (None, "d" * 20 + shared_part)]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.suffix_array_dedup(spark, df, None)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "c" * 20), (0, "d" * 20), (1, shared_part), (2, "a" * 20), (2, "b" * 20)]


def test_pipeline_ends_with_token_ids(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "the river walks"), (2, "seven green doors at night")], "doc_id long, text string")
    out = corpus_pipeline.best_fit_packing(spark, df, None).collect()
    assert len(out) == 2 and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)


def test_pipeline_drops_short_repeated_lines(spark):
    import corpus_pipeline

    rows = [(k, f"own {k}\n\nAll rights reserved.\n\n線は一語である") for k in range(4)]
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, None).collect()}
    assert out == {0: rows[0][1]} | {k: f"own {k}\n\n" for k in (1, 2, 3)}


def test_line_dedup_keeps_columns(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns[:7] == docs.columns
    assert out.count() == docs.count() and out.where("text is null").count() == 1


# --- toxicity


def test_toxicity_learns_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(1500):
        toxic = d % 6 == 0
        w = sentence(rng, 30).split()
        if toxic:
            w[rng.randrange(30)] = rng.choice(["idiot", "scum", "lowei" + rng.choice("abcd")])
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    docs = spark.createDataFrame(rows + [(1500, None), (1501, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")
    held = [d for d in range(1500) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert got.loc[held, "held_out"].all() and not got.loc[[d for d in range(1500) if d not in set(held)], "held_out"].any()
    assert (got.loc[held, "predicted"] == [int(d % 6 == 0) for d in held]).mean() > 0.97
    assert got["score"].between(0, 1).all() and got.loc[1500, "score"] == got.loc[1501, "score"]


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def votes_of(table):
    row, voter = np.nonzero(table)
    return toxicity.Votes(row, voter, np.ones(len(row)), *table.shape)


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    good = [(truth & (rng.random(4000) < 0.8)) | (rng.random(4000) < 0.02) for _ in range(3)]
    bad = rng.random(4000) < 0.02
    v = np.stack([*good, bad, bad, bad], 1)
    post = toxicity.label_model(votes_of(v), np.ones(6))
    assert ((post > 0.5) == truth).mean() > 0.95
    assert post[bad & ~good[0] & ~good[1] & ~good[2]].mean() < 0.5


def test_label_model_equals_brute_force_em():
    rng = random.Random(5)
    table = [[rng.random() < p for p in (0.3, 0.2, 0.1, 0.6)] for _ in range(60)]
    polarity, n = [1, 1, 1, -1], 60
    post = [1 / (1 + math.exp(-2 * (min(3, sum(x for x, s in zip(r, polarity) if s > 0)) - sum(x for x, s in zip(r, polarity) if s < 0)))) for r in table]
    for _ in range(7):
        t, on, off, new = sum(post), [], [], []
        for j in range(4):
            on.append(min(1 - 1e-4, max(1e-4, (sum(p for p, r in zip(post, table) if r[j]) + 0.5) / (t + 1))))
            off.append(min(1 - 1e-4, max(1e-5, (sum(1 - p for p, r in zip(post, table) if r[j]) + 0.05) / (n - t + 1))))
        for r in table:
            a, b = (t + 1) / (n + 2), 1 - (t + 1) / (n + 2)
            for j in range(4):
                a *= on[j] if r[j] else 1 - on[j]
                b *= off[j] if r[j] else 1 - off[j]
            new.append(a / (a + b))
        post = new
    got = toxicity.label_model(votes_of(np.array(table)), np.array(polarity, "f8"), rounds=7, share_at=())
    assert np.allclose(got, post, atol=1e-6)


def test_shares_equal_brute_force():
    rng = np.random.default_rng(3)
    v = rng.random((2500, 5)) < 0.3
    v[:, 1] = v[:, 0]
    post, on, off = rng.random(2500), rng.random(5), rng.random(5)
    rest = v - (post[:, None] * on + (1 - post[:, None]) * off)
    std = np.maximum(rest.std(0), 1e-3)
    want = 1 / np.maximum(1, np.maximum((rest / std).T @ (rest / std) / 2500 - 0.1, 0).sum(0))
    assert np.allclose(toxicity.independent_share(votes_of(v), post, on, off), want, rtol=1e-3)


def test_scores_equal_brute_force(docs, spark):
    """The score is the logistic of the voters' weights, for every whole text."""
    rows = [(k, "one two three") for k in range(100, 140)] + [(k, "such scum and idiot idiot words") for k in range(200, 220)]
    known = spark.createDataFrame([(d, t, int(d >= 200)) for d, t in rows], "doc_id long, text string, toxic int")
    model = toxicity.fit(known, known.select("doc_id", "toxic"))
    n = len(model.terms)
    for r in toxicity.score(docs, model).collect():
        t = next((t or "") for d, t in edge_rows() if d == r["doc_id"])
        f = toxicity.features(t)
        terms = [k for k, x in enumerate(model.terms) if f.get(x)]
        z = model.bias + sum(model.weights[k] * math.log1p(f[model.terms[k]]) for k in terms)
        lexicon = any(k >= model.n_suggested for k in terms)
        words = {w for w in re.findall(r"\w+", t.lower()) if any(x in model.terms for x in ["=" + w, *("^" + w[:k] for k in range(4, len(w)))])}
        fires = (len(words) > 1, len(words) > 2, not lexicon, not words)
        z += sum(model.weights[n + k] * math.log(2) for k, x in enumerate(fires) if x)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    assert toxicity.score(known, model).where("predicted <> cast(doc_id >= 200 as int)").count() == 0


# --- pieces


def test_pieces_equal_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rng, m = random.Random(5), pieces.PieceMachine(PIECE_BPE, most=100)
    for _ in range(800):
        t = "".join(rng.choice("abtheinor  \n▁éñ🙂\x00½①กب.,") for _ in range(rng.randint(0, 50)))
        assert m.encode(t).tolist() == sp.encode(t), t
        assert m.decode(m.encode(t)) == sp.decode(sp.encode(t))
    got = pieces.encode_pieces(docs, PIECE_BPE)
    assert by_id(got, "n_ids", "round_trip") == {d: sorted((len(sp.encode(t or "")), True) for e, t in edge_rows() if e == d) for d, _ in edge_rows()}
    back = by_id(pieces.decode_pieces(got, PIECE_BPE), "text")
    assert back == {d: sorted((t or "",) for e, t in edge_rows() if e == d) for d, _ in edge_rows()}


def test_pieces_of_long_runs():
    """Texts of a megabyte without an ASCII space between words, or of nothing else, within seconds each."""
    import base64
    import time

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rng, m = random.Random(7), pieces.PieceMachine(PIECE_BPE)
    blob = base64.b64encode(rng.randbytes(600_000)).decode()
    cjk = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(150_000))
    for t in (" " * 1_000_000, " " * 999_999 + "x", "    " + cjk, "   " + blob, blob, cjk + "\n" * 50_000 + "." * 50_000):
        began = time.time()
        ids = m.encode(t)
        assert time.time() - began < 40
        assert ids.tolist() == sp.encode(t)
        assert m.decode(ids) == t


def test_normaliser_machine():
    m, end = pieces.normaliser(True)
    for t in ("", " ", "a  b é漢", "▁x "):
        assert pieces.transduced(m, t.encode()).decode() == "▁" + t.replace(" ", "▁")
        assert pieces.transduced(m, t.encode(), end).decode() == t.replace(" ", "▁")


def test_unigram_paths_are_cheapest():
    """Tropical shortest paths against all segmentations."""
    m = pieces.PieceMachine(PIECE_BPE)
    rng = random.Random(3)
    m.bpe, words = False, ["a", "b", "c", "ab", "bc", "abc", "ca", "é"]
    m.score = {w: -rng.random() * len(w) for w in words}
    m.piece = words
    m.compile([(k, w, -m.score[w]) for k, w in enumerate(words)])

    def best(t):
        if not t:
            return 0.0
        return min([-m.score[w] + best(t[len(w) :]) for w in words if t.startswith(w)] + ([pieces.FALLBACK + best(t[1:])] if t[0] not in m.score else []))

    for _ in range(60):
        t = "".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 9)))
        got = m.path(t.encode())
        assert math.isclose(sum(-m.score[words[k]] if k < len(words) else pieces.FALLBACK for k in got), best(t))
        assert "".join(words[k] if k < len(words) else chr(k - len(words)) for k in got) == t


# --- chat windows


def turns(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "<turn|0|l|x>&amp;</turn>"), (1, 2, "assistant", "&lt; <b> | >"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "sys|tem>", "odd"), (4, 0, "system", "alone"), (None, 0, "user", "no id"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    rows += [(6, k, ["user", "assistant"][k % 2], sentence(rng, rng.randint(1, 400))) for k in range(60)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("windows", F.lit(1)).withColumn("i", F.lit("x"))


def test_chat_round_trip(spark):
    rows, df = turns(spark)
    want = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[0] or -9, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    formatted = chat_windows.format_conversations(df)
    read = {r["conv_id"]: r["turns"] for r in chat_windows.read_windows(formatted).collect()}
    assert {c: [(t["role"], t["text"]) for t in x] for c, x in read.items()} == want
    assert all(t["loss"] == (t["role"] == "assistant") for x in read.values() for t in x)
    for r in chat_windows.digests(chat_windows.read_windows(formatted)).collect():
        own = want[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_budget(spark):
    _, df = turns(spark)
    many = {r["conv_id"]: r["windows"] for r in chat_windows.format_conversations(df).collect()}
    assert len(many[6]) > 5 and len(many[1]) == 1
    for w in many[6]:
        sizes = [(len(b) + 3) // 4 + 8 for b in re.findall(r">([^<]*)</turn>", w)]
        assert sum(sizes) <= chat_windows.BUDGET or len(re.findall(r"\|[lc]\|", w)) == 1
    assert any(re.search(r"<turn\|\d+\|r\|", w) for w in many[6][1:]) and "|r|" not in many[6][0]


# --- near-duplicates


def brute_near(rows, words, pct):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= pct * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def near_rows():
    rng = random.Random(9)
    base = sentence(rng, 80).split()
    rows = list({d: (d, t) for d, t in edge_rows()}.values())
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(80)] = f"n{rng.randint(0, 99)}"
        rows.append((200 + k, " ".join(w).upper() if k % 5 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("words,pct", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, pct):
    rows = near_rows()
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("band", F.lit(1))
    got = by_id(near_dedup.near_duplicates(df, words, pct), "n_shingles", "component_id", "kept")
    assert {d: v[0] for d, v in got.items()} == brute_near(rows, words, pct)


def test_likelihood_keeps_links():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(20, 600))
        both = int(n * 0.85 / (2 - 0.85) * 2) + 1
        pool = rng.integers(0, 1 << 63, 2 * n, dtype="u8")
        a, b = pool[: (n + both // 2)], pool[(n - both // 2) :]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if j >= 0.85:
            r = near_dedup.registers([np.unique(a), np.unique(b)])
            assert near_dedup.possible(r[0], len(a), r[1:], np.array([len(b)]), 0.85)[0]


def test_components(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 150)]
    with shared.Scratch(spark, "test") as tmp:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long"), tmp).collect()}
        assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150}


# --- fingerprints


def test_fingerprints(spark):
    rows = [(1, "Straße  und\tWeg"), (2, "STRASSE UND WEG "), (3, "café x"), (4, "café X"), (5, None), (6, ""), (7, "other"), (7, "other"), (8, "日本語テキスト" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("wide", F.lit("x"))
    got = [(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprints(df).collect()]
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())).strip()
    by_text = {}
    for d, f in got:
        for t in {canon(x) for e, x in rows if e == d}:
            by_text.setdefault(t, set()).add(f)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())).strip()


@pytest.mark.parametrize("weak", [False, True])
def test_edited(spark, weak):
    """Every column against brute force; a weak digest makes texts collide."""
    rows = [(k * 3, sentence(random.Random(k % 7), k)) for k in range(30)] + [(1000, None), (-(1 << 63), "least id"), ((1 << 63) - 1, "greatest id"), (1001, "A  b"), (1002, "a b "), (None, "no id"), (None, "no id either")]
    df = spark.createDataFrame(rows + [rows[5]], "doc_id long, text string").withColumn("o", F.lit(1)).withColumn("wide", F.lit("x"))
    by_hash = {r["text"]: r["t"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), by_hash[r[1]]))
    wide = (lambda c: F.lpad(F.length(c).cast("string"), 32, "0")) if weak else fingerprints.digest
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprints.edited_fingerprints(df, wide=wide).collect()}
    want, prints = {}, {}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest()] = (t, edited, nxt)
    assert got.keys() == want.keys()
    for key, (t, edited, nxt) in want.items():
        r = got[key]
        assert r["near_edited"] == float(canon(t) == canon(edited)) and r["near_next"] == float(canon(t) == canon(nxt))
        for text, mark in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(canon(text), mark) == mark
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_number_collisions(spark):
    rows = [(1, "abc"), (2, "xyz"), (3, "ABC "), (4, "long text")]
    got = dict(fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), wide=lambda c: F.length(c).cast("string")).collect())
    assert got == {1: "3-0", 2: "3-1", 3: "3-0", 4: "9-0"}


# --- token files


def test_token_files(docs, spark):
    from tokenizers import Tokenizer

    tok, want, at = Tokenizer.from_file(WORD_BPE), [], 0
    for d, t in sorted(texts()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.token_file_round_trip(docs, WORD_BPE).collect()) == sorted(want)


def test_token_files_of_wide_ids(spark, monkeypatch):
    """Ids over the whole range, one far from the rest, in many small shards."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 60)
    rng = random.Random(12)
    ids = [-(1 << 63), (1 << 63) - 1, -7, 0] + list(range(1 << 40, (1 << 40) + 60))
    rows = [(d, sentence(rng, rng.randint(0, 9))) for d in ids]
    df = spark.createDataFrame(rows + [(None, "x")], "doc_id long, text string").repartition(5)
    got = sorted(token_files.token_file_round_trip(df, WORD_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(ids)]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0


@pytest.mark.parametrize("seed", range(5))
def test_codes_give_any_token(seed):
    rng = np.random.default_rng(seed)
    ids = rng.choice([3, 255, 256, 40_000, 70_000, 1 << 25], 1700).astype("u4")
    f = token_files.TokenFile(token_files.dump([1, None, 3], [5, 0, 1695], ids))
    assert f.doc_ids == [1, None, 3] and f.slice(0, 1700).tolist() == ids.tolist()
    for i in rng.integers(0, 1700, 200).tolist():
        assert f[i] == ids[i]
    for _ in range(100):
        a, b = sorted(rng.integers(0, 1701, 2).tolist())
        assert f.slice(a, b).tolist() == ids[a:b].tolist()
    assert f.document(1).tolist() == [] and f.document(2).tolist() == ids[5:].tolist()


# --- empty tables


def test_empty_tables(empty, spark):
    convs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quality_rules.quality_cascade(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.best_fit_pack(empty, WORD_BPE).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert pieces.encode_pieces(empty, PIECE_BPE).count() == 0
    assert chat_windows.digests(chat_windows.read_windows(chat_windows.format_conversations(convs))).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert token_files.token_file_round_trip(empty, WORD_BPE).count() == 0
