"""BPE against the ``tokenizers`` library: merges, vocabulary, ids, round trips."""

from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tokenizer

lib = pytest.importorskip("tokenizers")


def library(texts, vocab, special=tokenizer.SPECIAL, all_bytes=False):
    t = lib.Tokenizer(lib.models.BPE(unk_token="<unk>", byte_fallback=not all_bytes))
    t.pre_tokenizer, t.decoder = lib.pre_tokenizers.ByteLevel(), lib.decoders.ByteLevel()
    more = {"initial_alphabet": lib.pre_tokenizers.ByteLevel.alphabet()} if all_bytes else {}
    t.train_from_iterator(texts, lib.trainers.BpeTrainer(vocab_size=vocab, special_tokens=list(special), show_progress=False, **more))
    return t


def same(t, v):
    """Same tokens under the same ids, same merges by rank."""
    import json

    letter = tokenizer.letters()
    name = lambda b: "".join(letter[x] for x in b)
    n = len(v.special)
    assert {k: (s if k < n else name(b)) for k, (s, b) in enumerate(zip([*v.special, *[""] * len(v.tokens)], v.tokens))} == {k: s for s, k in t.get_vocab().items()}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.loads(t.to_str())["model"]["merges"]]
    assert [(name(a), name(b)) for k, (a, b) in enumerate(v.merges) if (a, b) not in v.merges[k + 1 :]] == merges


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets_in_phases(spark, seed):
    """Runs of one letter, ties, tokens made twice; few pairs and symbols a phase, so that many phases follow."""
    rng = Random(seed)
    texts = ["".join(rng.choice(["a", "a", "b", "ab", "aaa", " ", "c", "ca", "\n", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None]
    docs = frame(spark, texts)
    t = library([x or "" for x in texts], 90)
    whole = tokenizer.train(tokenizer.pretoken_counts(docs), 90)
    same(t, whole)
    small = tokenizer.train(tokenizer.pretoken_counts(docs), 90, most_pairs=9, most_symbols=120)
    assert (small.alphabet, small.merges) == (whole.alphabet, whole.merges)


def test_pieces_of_any_script(spark):
    rng = Random(9)
    signs = ["don't", "we'll", "  ", " ", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "9", "४२", "हिन्दी", "বাংলা", "漢字", "한국", "🙂", "é", "?!", "_", "​", "﻿", "A"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    docs, split = frame(spark, texts), lib.pre_tokenizers.ByteLevel()
    letter = tokenizer.letters()
    want: dict = {}
    for x in texts:
        for p, _ in split.pre_tokenize_str(x):
            want[p] = want.get(p, 0) + 1
    got = {"".join(letter[b] for b in r["piece"].encode()): r["n"] for r in tokenizer.pretoken_counts(docs).collect()}
    assert got == want
    t = library(texts, 400, tokenizer.ASSET_SPECIAL, all_bytes=True)
    v = tokenizer.train(tokenizer.pretoken_counts(docs), 400, tokenizer.ASSET_SPECIAL, all_bytes=True, most_pairs=40)
    same(t, v)
    odd = texts + ["<bos>hi<eos> there", "x<tool_call><evidence> y</evidence>", "<pad", "", "q\x00z", "  lead"]
    rows = tokenizer.encode(frame(spark, odd), v)
    assert [r["tokens"] for r in rows.orderBy("doc_id").collect()] == [e.ids for e in t.encode_batch(odd)]
    back = tokenizer.decode_rows(rows, v).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t.decode(e.ids) for e in t.encode_batch(odd)]


def test_unknown_bytes_and_ends(spark):
    t = library(["abc abd"], 40)
    v = tokenizer.train(tokenizer.pretoken_counts(frame(spark, ["abc abd"])), 40)
    same(t, v)
    odd = ["abz", "日本", "ab abc<unk>", ""]
    assert [r["tokens"] for r in tokenizer.encode(frame(spark, odd), v).orderBy("doc_id").collect()] == [e.ids for e in t.encode_batch(odd)]
    ends = tokenizer.encode(frame(spark, ["abc", None]), v, ends=True).orderBy("doc_id").collect()
    assert [r["tokens"] for r in ends] == [[2, *t.encode("abc").ids, 3], [2, 3]]
    assert tokenizer.decode(ends[0]["tokens"], v) == t.decode(ends[0]["tokens"], skip_special_tokens=True)


def test_documents_at_two_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = library([r["text"] or "" for r in docs.orderBy("doc_id").collect()], 3000)
    v = tokenizer.train(tokenizer.pretoken_counts(docs), 3000, most_symbols=20_000, most_pairs=600)
    same(t, v)
    got = tokenizer.encode(docs.limit(20), v).join(docs, "doc_id").select("text", "tokens").collect()
    assert [r["tokens"] for r in got] == [t.encode(r["text"]).ids for r in got]


def test_long_pieces_merge_in_n_log_n():
    ranks = {(0, 0): (0, 1), (1, 1): (1, 2), (2, 2): (2, 3)}
    assert tokenizer.merged([0] * 200_001, ranks) == [3] * 25_000 + [0]
    assert tokenizer.merged([0, 1, 0], {(0, 1): (5, 2), (2, 0): (1, 3)}) == [3]
    assert tokenizer.merged([0, 1, 0], {(0, 1): (5, 2), (2, 0): (1, 3)}, in_order=True) == [2, 0]


def test_nothing_to_train_on(spark):
    empty = tokenizer.train(tokenizer.pretoken_counts(frame(spark, [None, ""])), 50)
    assert empty.merges == () and empty.tokens == [b"<pad>", b"<unk>", b"<bos>", b"<eos>"]
    assert tokenizer.train(tokenizer.pretoken_counts(frame(spark, ["ab ab"])), 20, min_count=3).merges == ()
    one = frame(spark, ["x"]).where(F.lit(False))
    assert tokenizer.encode(one, empty).count() == 0


def test_tokens_per_language_counts_each_row(spark, tmp_path, monkeypatch):
    """As whole texts are encoded, row by row: repeated and null ids, special tokens inside, null languages, languages without a token."""
    from tessera.plans import tokens

    rows = [(1, "en", "the other thing, the other"), (1, "en", "the <eos>other<pad> \n\n thing"), (None, "en", "the  other\tthing \n"), (2, "fr", "l'autre chose <eos>"), (3, None, "the the"), (4, "de", ""), (5, "de", None), (6, "es", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(tokens, "VOCAB", 45)
    v = tokenizer.train(tokenizer.pretoken_counts(docs), 45)
    assert v.merges
    own, want = tokenizer.Encoder(v), {}
    for _, lang, t in rows:
        w = want.setdefault(lang, [0, 0, 0, 0])
        for k, x in enumerate((len(own(t or "")), len((t or "").encode()), len(t or ""), len((t or "").split()))):
            w[k] += x
    got = {r["lang"]: tuple(r)[1:] for r in tokens.tokens_per_language(spark, str(tmp_path)).collect()}
    share = lambda a, b: a / b if b else None
    assert got == {k: (n, share(b, n), share(n, c), share(n, w)) for k, (n, b, c, w) in want.items()}
