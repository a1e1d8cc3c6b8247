"""Admission, stored tokenizers, tools, shards, snapshots and reports on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval, sft, tokenizer
from tessera.operators.tools import Tool, Tools
from tessera.sources import readers, writers
from tessera.sources.stage import shared_folder
from tessera.streaming import streams


def test_openings_go_once_each_in_order(spark):
    def brute(text):
        for p in T.BOILERPLATE:
            text = text[len(p) :] if text.startswith(p) else text
        return text.strip()

    first, last = T.BOILERPLATE[0], T.BOILERPLATE[-1]
    texts = ["", "plain", first, first + " a", first + first + "b", first + last + "c", last + first + "d", "x" + first]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.strip_boilerplate(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [*map(brute, texts), None]


def test_admitted(spark):
    rows = [
        (1, "write code", "x = (", "python_code"), (2, "WRITE code", "x = (", "standard"), (3, "write code", "x = (", "python_code"),
        (4, "add one and one", "two, surely", "math"), (5, "add one and one", "1+1 equals 2", "math"), (6, "hi", "long enough", "standard"),
        (7, "write more code", "see ```python\n y = 1\n``` done", "python_code"), (8, "write at length", "a b c d e f g h i", "standard"), (9, None, None, "math"),
        (10, "add one and one", "1+1 equals 2", "standard"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, prompt string, response string, check string")
    got = sft.admitted(df, F.size(T.split_words(F.col("response"))), max_tokens=8)
    assert {r["conv_id"]: r["reason"] for r in got.collect()} == {
        1: "syntax_error", 2: "accepted", 3: "duplicate", 4: "math_unverified", 5: "accepted", 6: "too_short", 7: "accepted", 8: "too_many_tokens", 9: "too_short", 10: "duplicate",
    }
    assert sft.admitted(df.limit(0), F.lit(0)).isEmpty()


def test_tokenizer_is_stored_and_checked(spark):
    v, path = tokenizer.Vocabulary(("<pad>", "<eos>"), (97, 98, 255), ((b"a", b"b"), (b"ab", b"\xff"))), shared_folder(spark, "tokenizer")
    tokenizer.save(spark, v, path)
    assert tokenizer.load(spark, path) == v and len(v.tokens) == 7
    for change in ({"tokenizer_sha256": "0"}, {"vocab_size": 300}, {"special_tokens": {"<pad>": 1, "<eos>": 259}}):
        meta = json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0]) | change
        other = shared_folder(spark, "tokenizer")
        tokenizer.save(spark, v, other)
        writers.replace_text(spark, f"{other}/metadata.json", json.dumps(meta))
        with pytest.raises(ValueError):
            tokenizer.load(spark, other)


def test_tools(spark):
    def fails(_):
        raise KeyError("k")

    tools = Tools(Tool("echo", "old", str.lower), Tool("fails", "fails", fails))
    tools.register(Tool("echo", "says it again", lambda a: a))
    assert tools.names() == ["echo", "fails"] and tools.get("none") is None
    assert tools.catalogue(spark).where("name = 'echo'").first()["description"] == "says it again"
    with pytest.raises(TypeError):
        tools.register("echo")
    rows = spark.createDataFrame([("echo", "A"), ("fails", "x"), ("none", "x"), (None, None)], "n string, a string")
    got = [r["r"] for r in rows.select(tools.invoke(F.col("n"), F.col("a")).alias("r")).collect()]
    assert [(r["success"], r["output"], r["error"] is None) for r in got] == [(True, "A", True), (False, None, False), (False, None, False), (False, None, False)]


def test_shards_and_snapshot_over_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "g", "x" * 4) for i in range(5)], "doc_id long, ds string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.document_stream(spark, f"{tmp_path}/in", "doc_id long, ds string, text string")
    out = streams.run_to_shards(stream, f"{tmp_path}/out", f"{tmp_path}/c1", 8, "ds")
    assert sorted((r["batch"], r["n_docs"]) for r in out.collect()) == [(b, n) for b in range(3) for n in (1, 2, 2)]
    path = f"file://{tmp_path}/progress.json"
    runs = streams.document_stream(spark, f"{tmp_path}/in", "doc_id long, ds string, text string").select(F.col("ds").alias("run_id"), F.col("doc_id").alias("step"))
    streams.run_to_snapshot(runs, path, f"{tmp_path}/c2")
    assert json.loads(spark.read.text(path, wholetext=True).first()[0]) == [{"run_id": "g", "step": 24}]
    assert streams.run_to_snapshot(runs, path, f"{tmp_path}/c2") == {"g": {"run_id": "g", "step": 24}}  # nothing new


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "k string, n int")
    _, md = writers.write_report(df, f"{shared_folder(spark, 'report')}/r", "T")
    assert spark.read.text(md, wholetext=True).first()[0] == "# T\n\n| k | n |\n| --- | --- |\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        writers.write_report(df, "unused", "T", most=1)


def test_code_sample_needs_rows(spark):
    with pytest.raises(ValueError):
        readers.code_sample(spark.createDataFrame([(1, "  "), (2, None)], "doc_id long, text string"), "doc_id", 10)


def test_cosine_of_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [])], "vec_id long, embedding array<double>")
    for size in (1 << 20, 8):
        got = retrieval.cosine_topk(v, v.where("vec_id in (1, 5)"), 2, block_bytes=size).select("query_id", "vec_id", "rank").collect()
        assert sorted(map(tuple, got)) == [(1, 2, 1), (1, 4, 2)]
    assert [r["vec_id"] for r in retrieval.cosine_topk(v, v.where("vec_id = 1"), 9, 0.9).collect()] == [2]


def test_cosine_prunes_and_loses_nothing(spark):
    """All pairs by a plain model: clusters, equal and opposite vectors, queries in one block and in many, a sample of few and of all."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.1
    x[7], x[11], x[20] = x[3], x[3], -x[3]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    for k, least, options in ((5, None, {}), (5, None, {"block_bytes": 200, "sample": 3}), (400, 0.9, {"sample": 40}), (1, None, {"sample": 300}), (3, 0.99999, {})):
        want = []
        for q in range(0, 300, 20):
            scores = sorted(((-float((u[q] * u[t]).sum()), t) for t in range(300) if t != q))
            want += [(q, t, n) for n, (s, t) in enumerate(scores[:k], 1) if least is None or -s >= least]
        got = retrieval.cosine_topk(v, v.where("vec_id % 20 = 0"), k, least, **options)
        assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == sorted(want)
    compared = retrieval.nearest(v, v.where("vec_id % 20 = 0"), 5).agg(F.sum("compared")).first()[0]
    assert 15 * 5 <= compared < 15 * 300 / 2
    assert retrieval.cosine_topk(v.where("false"), v, 3).count() == 0 and retrieval.cosine_topk(v, v.where("false"), 3).count() == 0
    assert retrieval.cosine_topk(v.where("vec_id < 2"), v.where("vec_id = 0"), 3).count() == 1


def test_calculator_meets_parts_in_order():
    """Values, and which refusal comes first where several are due."""
    cases = [
        ("2 + 3 * 4", "14"), ("(1 + 2) ** 3", "27"), ("sqrt(16) + pi - pi", "4"), ("7 // 2", "3"), ("-3.5", "-3.5"), ("round(2.5)", "2"), ("True + 1", "2"),
        ("7 % 0", "Division or modulo by zero."), ("2 ** 5000", "Exponentiation result exceeds safe computation bounds."), ("20000 ** 2", "Exponentiation result exceeds safe computation bounds."),
        ("__import__(1)", "Disallowed function call in calculator expression."), ("x + 1", "Unknown constant or variable: 'x'"), ("[1]", "Unsupported mathematical syntax: List"), ("", "Empty expression provided to calculator."), (None, "Empty expression provided to calculator."), ("sqrt(-1)", "Math function error 'sqrt': "),
        ("foo(x)", "Disallowed function call in calculator expression."), ("x | 1", "Unsupported mathematical syntax: BinOp"), ("foo(1/0)", "Disallowed function call in calculator expression."), ("1/0 + foo(1)", "Division or modulo by zero."), ("a.b(1)", "Disallowed function call in calculator expression."),
        ("not x", "Unsupported mathematical syntax: UnaryOp"), ("sqrt(x)", "Unknown constant or variable: 'x'"), ("(1/0) | 2", "Unsupported mathematical syntax: BinOp"), ("1 +", "Syntax error in mathematical expression: "), ("+".join(["1"] * 5000), "5000"),
    ]
    from tessera.functions.answers import _calculate

    for expression, want in cases:
        success, output, error = _calculate(expression)
        assert (output or error).startswith(want) and success == (error is None), expression


def test_endless_dedup_holds_no_state(spark, tmp_path):
    """Batch by batch the first of equal texts; a restart goes on, a repeated or half-written batch changes nothing."""
    from tessera.streaming import streams

    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "doc_id long, text string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{n}")
    put([(3, "b"), (1, "a"), (2, "a"), (4, None), (5, "")], 1)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    run = lambda: sorted((r["doc_id"], r["text"]) for r in streams.run_deduplicated(stream(), out, f"file://{tmp_path}/state", buckets=4).collect())
    assert run() == [(1, "a"), (3, "b"), (4, None)]
    put([(6, "a"), (7, "c"), (8, "c")], 2)
    put([(9, "c"), (10, "d")], 3)
    want = [(1, "a"), (3, "b"), (4, None), (7, "c"), (10, "d")]
    assert run() == want and run() == want
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver was lost before the last batch was committed
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert run() == want
    assert not list((tmp_path / "state").glob("state/*"))


def test_lines_are_counted_once_over_restarts(spark, tmp_path):
    """Files that grow, a line that is not ended, a line longer than a task's piece, a batch that is run again."""
    from tessera.sources.lines import appended_lines
    from tessera.streaming import streams

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "_hidden").write_text("no\n")

    def run(piece_bytes=10):
        lines = appended_lines(spark, f"file://{folder}", piece_bytes)
        return {r["value"]: r["lines"] for r in streams.run_line_counts(lines, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "value").collect()}

    (folder / "a.log").write_text("".join(f"line {k}\n" for k in range(9)) + "half")
    (folder / "b.log").write_text("x" * 100 + "\né\r\n\n")
    want = {f"line {k}": 1 for k in range(9)} | {"x" * 100: 1, "é": 1, "": 1}
    assert run() == want
    assert run() == want  # nothing new
    with (folder / "a.log").open("a") as f:
        f.write(" a line\nline 3\nopen")
    (folder / "c.log").write_text("line 3\n")
    want |= {"half a line": 1, "line 3": 3}
    assert run() == want
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver was lost before the last batch was committed
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert run(1000) == want


def test_catalogue_rules(spark, tmp_path):
    from tessera.sources import catalogue

    good = {"id": "a", "dataset": "d", "config": "c", "split": "train", "revision": "0" * 40, "text_column": "text", "language": "en", "domain": "web", "target_token_share": 0.5, "license": "l", "license_url": "u", "allowed_for_base_pretraining": True}
    head = {"schema_version": 1, "source_revision_policy": "exact_huggingface_commit", "token_share_basis": "final_frozen_tokenizer_tokens", "generated_text_allowed": False}

    def read(entries, **changes):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(head | {"sources": entries} | changes, indent=1))
        return catalogue.read_catalogue(spark, f"file://{path}")

    found = lambda sources, **k: sorted((r["id"] or "", r["failure"]) for r in catalogue.failures(read(sources), **k).collect())
    assert found([good, good | {"id": "b"}]) == []
    assert found([good, good]) == [("a", "missing_or_duplicate_id")] * 2
    assert found([good | {"target_token_share": 1.5}]) == [("", "allowed_shares_over_1"), ("", "shares_do_not_sum_to_1"), ("a", "share_outside_0_1")]
    blocked = good | {"id": "b", "allowed_for_base_pretraining": False}
    assert found([good, blocked]) == [("", "blocked_sources"), ("b", "blocked_without_reason")]
    assert found([good, blocked | {"blocking_reason": "why"}], require_complete=False) == []
    assert found([good | {"revision": "A" * 40, "domain": " "}, {"id": None}]) == [("", "allowed_is_no_boolean"), *[("", f"blank:{c}") for c in sorted(catalogue.NOT_BLANK)], ("", "missing_or_duplicate_id"), ("", "revision_is_no_commit"), ("", "share_outside_0_1"), ("", "shares_do_not_sum_to_1"), ("a", "blank:domain"), ("a", "revision_is_no_commit")]
    for changes in ({"schema_version": 2}, {"generated_text_allowed": True}, {"token_share_basis": None}, {"sources": []}):
        with pytest.raises(ValueError, match=next(iter(changes))):
            read([good], **changes)
    docs = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, k int")
    assert [r["k"] for r in catalogue.admitted(docs, read([good, blocked])).collect()] == [1]


def test_storage_keeps_to_its_folder(spark, tmp_path):
    from tessera.sources.storage import Storage

    s = Storage(spark, f"file://{tmp_path}/store")
    (tmp_path / "store-beside").mkdir()
    s.write("a/b.txt", "one")
    assert s.read("/a/b.txt") == b"one" and s.exists("a/../a/b.txt") and not s.exists("a/c.txt")
    with pytest.raises(FileExistsError):
        s.write("a/b.txt", "two")
    s.write("a/b.txt", "two", overwrite=True)
    s.write("a/ü.txt", "é")
    assert s.read("a/b.txt") == b"two" and s.read("a/ü.txt") == "é".encode()
    assert s.files() == ["a/b.txt", "a/ü.txt"] and s.files("a/b") == ["a/b.txt"] and s.files("x") == []
    for path in ("../x", "a/../../store-beside/x", "..", "", "/", "a/../..", "file:/etc/passwd"):
        with pytest.raises(ValueError):
            s.place(path)
    assert s.delete("a/b.txt") and not s.delete("a/b.txt")
    with pytest.raises(FileNotFoundError):
        s.read("a/b.txt")


def test_tombstones_are_audited(spark):
    from tessera.operators import provenance

    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, content_hash string")
    gone = spark.createDataFrame([("t1", "r", "x"), ("t1", "r", "x"), ("t2", "s", "x"), ("t2", "s", "z"), ("t3", "s", None)], "tombstone_id string, reason string, content_hash string")
    kept, audit = provenance.excise_content(docs, gone)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    assert sorted(map(tuple, audit.collect())) == [("t1", "r", "x", 2), ("t2", "s", "x", 2), ("t2", "s", "z", 0)]
