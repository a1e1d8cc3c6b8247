"""Lexical search, quality classifier and source divergence against brute force."""

import math
import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import divergence, lexical_search, quality_classifier
from tessera.llm.shared import materialise

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def _ranked(docs, items, most=10):
    tf = [(i, Counter(_terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in tf:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(_terms(text)).items() if t in c)
            if s:
                scores.append((-s, (1 << 63) - 1 if i is None else i, s))
        out += [(item, k, None if d == (1 << 63) - 1 else d, s) for k, (_, d, s) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,shard_bytes,block_bytes", [(0, 1 << 20, 1 << 20), (1, 400, 500), (2, 40, 300)])
def test_search_equals_brute_force(spark, seed, shard_bytes, block_bytes):
    rng = Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÄB9", "the", "THE", "x"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(3, len(words))]) + rng.choice([" ", ", ", "\n", "-", "__"]) for _ in range(n))
    docs = [(rng.choice([k - 50, k, 7, k << 40]), rng.choice([text(rng.randint(1, 90)), text(3), "the the", "", None, "!!"])) for k in range(160)] + [(None, "the w1"), (None, "the w1"), ((1 << 63) - 2, "w1 w2"), (-(1 << 63), "w1 w2")]
    items = [(k, text(rng.randint(1, 40))) for k in range(12)] + [(0, "w1 the the"), (0, "w1 the the"), (None, "w1"), (5, ""), (6, None), (8, "nowhere")]
    indexed = materialise(lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=shard_bytes), "test")
    got = lexical_search.search(indexed, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _ranked(docs, items)


def test_heap_merge_keeps_ties_and_bounds():
    """Every list, frequent or rare, with many equal scores, against a full sum."""
    rng = Random(3)
    for _ in range(200):
        lists = []
        for _ in range(rng.randint(1, 8)):
            docs = sorted(rng.sample(range(80), rng.randint(0, 80)))
            lists.append((rng.choice([0, 1, 1, 5, 40]), docs, [rng.choice([1, 1, 2, 9]) for _ in docs]))
        sums = Counter()
        for f, docs, values in lists:
            for d, v in zip(docs, values):
                sums[d] += f * v
        want = sorted(((s, d) for d, s in sums.items() if s), key=lambda x: (-x[0], x[1]))[:5]
        assert lexical_search.best_documents(lists, 5) == want


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 63) - 1, 5], "i8")
    data, at = lexical_search.varints(values)
    assert lexical_search.values_of(data.tobytes()).tolist() == values.tolist() and at[-1] == len(data)
    assert lexical_search.values_of(b"").tolist() == []


def test_scaled_length_beyond_64_bits():
    n, docs, total = 10**9, 10**11, 3 * 10**13
    assert lexical_search.scaled_length(np.array([n, 3]), docs, total).tolist() == [25 + 75 * n * docs // total, 25 + 75 * 3 * docs // total]


def _audit(rows, least_docs, most):
    """All parts by plain Python, from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    use, df, whole, sources = Counter(), defaultdict(set), Counter(), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        sources[lang].add(source)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(A_Z)):
            use[lang, source, t] += 1
            whole[lang, t] += 1
            df[lang, t].add(k)
    out = []
    for lang, own in sources.items():
        kept = [t for (l, t), d in df.items() if l == lang and len(d) >= least_docs]
        p = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))
        total = {s: sum(use[lang, s, t] for t in kept) for s in own}
        q = {t: p(whole[lang, t], sum(whole[lang, x] for x in kept)) for t in kept}
        for s in own:
            mine = {t: p(use[lang, s, t], total[s]) for t in kept}
            pairs = [(-sum(abs(mine[t] - p(use[lang, o, t], total[o])) for t in kept), o) for o in own if o != s]
            best = [(q[t] - mine[t], t) for t in kept if use[lang, s, t] and mine[t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(best, key=lambda x: (x[0], x[1].encode()))[:most])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)]
    return sorted(out)


@pytest.mark.parametrize("groups,cells,size", [(128, 1 << 19, 1 << 20), (2, 40, 300), (1, 7, 50)])
def test_divergence_equals_brute_force(spark, groups, cells, size, monkeypatch):
    rng = Random(5)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyZü"] + ["été", "ß", "one1two"]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "s10", "Ü", None]), " ".join(rng.choice(words[rng.randint(0, 9) :]) for _ in range(rng.randint(0, 12)))) for _ in range(120)]
    rows += [("en", "quiet", None), ("fr", "alone", "mot"), ("it", "a", ""), ("it", "b", "12 !"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    monkeypatch.setattr(divergence, "SLICE_BYTES", size)
    got = divergence.audit(docs, least_docs=8, most_terms=4, tile_groups=groups, tile_cells=cells)
    assert sorted(map(tuple, got.collect())) == _audit(rows, 8, 4)


def test_shares_are_exact():
    rng = Random(1)
    for _ in range(500):
        total, kept = rng.randint(0, 10**15), rng.randint(1, 10**8)
        n = rng.randint(0, total)
        assert divergence.shares(np.array([n]), np.int64(total), kept)[0] == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)


def test_tokens_and_context_vectors(spark):
    texts = ["The cat### the cat", "", "THE cat", None, "a,b  c9"]
    place, shape, before = quality_classifier.tokens(pa.array([t or "" for t in texts]))
    assert before.tolist() == [0, 5, 5, 7, 7, 11]
    assert place[0] == place[3] == place[5] and place[1] == place[4] == place[6] and shape[0] != shape[3] != shape[5]
    got = quality_classifier.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    dims, signs = quality_classifier.index_vectors(quality_classifier.BUCKETS, 1)
    want = np.zeros_like(got)
    for t in range(len(texts)):
        for a in range(before[t], before[t + 1]):
            for b in range(before[t], before[t + 1]):
                if 0 < abs(a - b) <= quality_classifier.WINDOW:
                    for d, s in zip(dims[place[b]], signs[place[b]]):
                        want[place[a], d] += s
    assert (got == want).all() and got.any()


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert quality_classifier.fit_temperature(3 * logits, y) == pytest.approx(3, rel=0.15)


def test_quality_held_out_accuracy(spark):
    """On sf0.1's held-out fold clean documents stay and most others go; held-out labels change nothing."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = quality_classifier.held_out("doc_id")
    model = quality_classifier.fit(docs, labels.where(~held))
    got = quality_classifier.score(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(good) > 500 and len(bad) > 80
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.9
    assert ((got.score - got.quality) ** 2).mean() < 0.02
    again = quality_classifier.fit(docs, labels)
    assert np.allclose(again.network.w1, model.network.w1) and again.network.temperature == pytest.approx(model.network.temperature)


def test_quality_bound_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(3, "###")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, most_labelled=20)
    assert quality_classifier.score(docs, model).count() == 301


def test_suffix_dedup_leaves_the_warehouse_empty(spark, tmp_path):
    """Its bucketed table lies in the shared folder while the call runs, and is gone afterwards."""
    from pathlib import Path

    from tessera.llm import suffix_dedup

    paths, warehouse = [], Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    before = suffix_dedup._decided

    def watched(session, texts, *rest):
        paths.extend(texts.inputFiles())
        assert not any(warehouse.rglob("*.parquet"))
        return before(session, texts, *rest)

    docs = spark.createDataFrame([(1, "a" * 60), (2, "b" + "a" * 60)], "doc_id long, text string")
    suffix_dedup._decided = watched
    try:
        assert suffix_dedup.remove_repeats(docs).count() == 2
    finally:
        suffix_dedup._decided = before
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert paths and all(shared in p for p in paths)
    assert not any(Path(p.removeprefix("file://")).exists() for p in paths)
