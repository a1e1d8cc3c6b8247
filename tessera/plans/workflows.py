"""Admission of examples, memories, fused rankings, streams into files, tools, logs and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import evaluation, retrieval, sampling, sft
from ..operators.tools import Tool, Tools
from ..sources import readers, writers
from ..sources.stage import shared_folder
from ..streaming import streams
from . import query, table
from .answers import BM25, LAST
from .tokens import WORDS
from .tools import _STRIPPED


def _words(text: str) -> str:
    return WORDS.replace("text", text)


@query(
    rf"""WITH {LAST}, p AS (SELECT conv_id, {_STRIPPED.format("prompt")} AS prompt, {_STRIPPED.format("response")} AS response FROM x),
    u AS (SELECT * FROM p UNION ALL SELECT conv_id + 1000000, translate(prompt, 'aeiou', 'AEIOU'), response FROM p WHERE conv_id % 5 = 0 UNION ALL SELECT conv_id + 2000000, 'hi', response FROM p WHERE conv_id % 7 = 0),
    o AS (SELECT *, CASE WHEN length(prompt) < 5 OR length(response) < 5 THEN 'too_short' WHEN conv_id % 3 = 0 AND NOT (contains(response, '####') OR contains(response, 'The answer is') OR contains(response, 'equals')) THEN 'math_unverified' WHEN len({_words("prompt || ' ' || response")}) > 120 THEN 'too_many_tokens' ELSE 'accepted' END AS own FROM u),
    f AS (SELECT *, min(conv_id) FILTER (own = 'accepted') OVER (PARTITION BY sha256(lower(prompt || response))) AS first FROM o)
    SELECT conv_id, CASE WHEN conv_id > first AND own <> 'too_short' THEN 'duplicate' ELSE own END AS reason FROM f"""
)
def sft_admission(spark, sf_dir):
    """Every example's reason: a third must state an answer, a fifth is repeated with capital vowels, a seventh is too short."""
    x = sft.chat_examples(table(spark, sf_dir, "conversations"))
    again = x.where("conv_id % 5 = 0").select((F.col("conv_id") + 1_000_000).alias("conv_id"), F.translate("prompt", "aeiou", "AEIOU").alias("prompt"), "response")
    short = x.where("conv_id % 7 = 0").select((F.col("conv_id") + 2_000_000).alias("conv_id"), F.lit("hi").alias("prompt"), "response")
    rows = x.unionByName(again).unionByName(short).withColumn("check", F.when(F.col("conv_id") % 3 == 0, "math").otherwise("standard"))
    return sft.admitted(rows, F.size(T.split_words(F.concat_ws(" ", "prompt", "response"))), max_tokens=120).select("conv_id", "reason")


@query(
    rf"""WITH {LAST}, t AS (SELECT conv_id, len({_words("prompt")}) AS p, least(len({_words("prompt || response")}), 96) AS n FROM x)
    SELECT conv_id, CAST(n AS BIGINT) AS length, CAST(least(p, n) AS BIGINT) AS masked FROM t"""
)
def chat_mask_counts(spark, sf_dir):
    """Ids and masked ids of chat examples whose text is encoded once (here word lengths) and cut at its end."""
    ids = lambda c: F.transform(T.split_words(c), F.length)
    x = sft.chat_examples(table(spark, sf_dir, "conversations"))
    m = x.select("conv_id", sft.mask_joint(ids(F.concat("prompt", "response")), F.size(ids(F.col("prompt"))), 96).alias("m"))
    return m.select("conv_id", F.size("m.input_ids").cast("long").alias("length"), F.size(F.filter("m.labels", lambda x: x == sft.IGNORE)).cast("long").alias("masked"))


@query(f"WITH t AS (SELECT lang, count(*) AS docs, CAST(sum(len({WORDS})) AS BIGINT) AS tokens FROM documents GROUP BY lang) SELECT lang, docs, tokens, round(100 * tokens / sum(tokens) OVER (), 4) AS percent FROM t ORDER BY tokens DESC, lang")
def language_token_order(spark, sf_dir):
    """Languages by their tokens, the greatest first."""
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(T.split_words(F.col("text")))).alias("tokens"))
    total = t.agg(F.sum("tokens").alias("total"))
    return t.join(F.broadcast(total)).select("lang", "docs", "tokens", F.round(100 * F.col("tokens") / F.col("total"), 4).alias("percent")).orderBy(F.desc("tokens"), "lang")  # one row


@query(
    """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 2 = 0 AND label % 3 <> 2 AND vec_id % 4 = 0 AND (vec_id % 5 = 0 OR vec_id % 7 > 2)),
    q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS qe FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(qe, e) AS score FROM m JOIN q ON vec_id <> query_id)
    SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 3"""
)
def memory_recall(spark, sf_dir):
    """One owner's facts and habits that bear a tag and have not expired, by likeness to each query."""
    v, k = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    now = F.lit("2024-06-01").cast("timestamp")
    kind = F.when(F.col("label") % 3 == 0, "fact").when(F.col("label") % 3 == 1, "habit").otherwise("event")
    tags = F.when(k % 4 == 0, F.array(F.lit("kept"), F.lit("seen"))).otherwise(F.array(F.lit("seen")))
    m = v.select("vec_id", "embedding", F.when(k % 2 == 0, "ann").otherwise("bo").alias("owner"), kind.alias("kind"), tags.alias("tags"), F.when(k % 5 != 0, F.timestamp_add("DAY", k % 7 - 2, now)).alias("expires_at"))
    out = retrieval.recall_memories(m, v.where("vec_id % 50 = 0"), "ann", ["fact", "habit"], ["kept"], now, 3, 0.05)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {BM25.replace('<FILTER>', '')}, vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), near AS (SELECT q.vec_id AS query_id, q.e AS qe, o.* FROM vecs o JOIN vecs q ON q.vec_id <> o.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
    by_vec AS (SELECT query_id, vec_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(qe, e) DESC, vec_id) AS rank FROM near QUALIFY rank <= 20),
    fuse AS (SELECT query_id, doc, sum(1 / (rank + 60)) AS score FROM (SELECT CAST(query_id AS BIGINT) AS query_id, doc, rank FROM r WHERE rank <= 20 UNION ALL SELECT query_id, doc, rank FROM by_vec) GROUP BY ALL)
    SELECT query_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM fuse QUALIFY rank <= 5"""
)
def fused_topk(spark, sf_dir):
    """Hybrid retrieval: an item's documents by its terms and by its vector, made one ranking by reciprocal ranks."""
    items, v = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    by_terms = retrieval.bm25(items, table(spark, sf_dir, "documents"), 20).select("query_id", "doc", "rank")
    asked = v.join(items.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    by_vectors = retrieval.cosine_topk(v, asked, 20).select("query_id", F.col("vec_id").alias("doc"), "rank")
    return retrieval.fused(by_terms.unionByName(by_vectors), 5).select("query_id", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT CASE event_id % 2 WHEN 0 THEN 'plain' ELSE 'retrieval' END AS variant, count(*) AS n, round(avg((event_type = 'click')::INT), 6) AS pass_rate, round(avg((event_type = 'error')::INT), 6) AS abstain_rate, round(avg(value), 4) AS latency_ms, round(avg(user_id), 4) AS tokens FROM events GROUP BY ALL")
def variant_summary(spark, sf_dir):
    """Two variants' rates and means."""
    status = F.when(F.col("event_type") == "click", "PASS").when(F.col("event_type") == "error", "ABSTAIN").otherwise("REVISE")
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "plain").otherwise("retrieval").alias("variant"), status.alias("status"), F.col("value").alias("latency_ms"), F.col("user_id").alias("tokens"))
    digits = {"pass_rate": 6, "abstain_rate": 6, "latency_ms": 4, "tokens": 4}
    return evaluation.variants(e).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("SELECT lang AS category, count(*) AS n, round(avg(n_chars), 4) AS mean_length, round(avg((n_chars % 100) / 100.0::DOUBLE), 4) AS mean_repetition FROM documents GROUP BY ROLLUP (lang)")
def suite_averages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("n_chars").alias("length"), ((F.col("n_chars") % 100) / 100).alias("repetition"))
    return evaluation.suite(d).withColumns({c: F.round(c, 4) for c in ("mean_length", "mean_repetition")})


@query("WITH m AS (SELECT lang AS metric, avg(n_chars) FILTER (doc_id % 2 = 0) AS before, avg(n_chars) FILTER (doc_id % 2 = 1) AS after FROM documents GROUP BY lang) SELECT metric, round(before, 4) AS before, round(after, 4) AS after, after < before * 0.995 AS regressed FROM m")
def metric_regressions(spark, sf_dir):
    """Metrics of two runs and whether they fell by more than half a per cent."""
    mean = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("metric")).agg(mean(0).alias("before"), mean(1).alias("after"))
    return evaluation.regressed(m).withColumns({c: F.round(c, 4) for c in ("before", "after")})


@query("SELECT CASE doc_id % 7 WHEN 0 THEN 'Bengali' WHEN 1 THEN 'Hindi' WHEN 2 THEN 'Mathematics' WHEN 3 THEN 'Mathematics' WHEN 4 THEN 'English_Educational' WHEN 5 THEN 'English_Educational' ELSE 'English_Wikipedia' END AS stratum, count(*) AS docs FROM documents GROUP BY ALL")
def stratum_rules(spark, sf_dir):
    """Strata of documents whose language, domain and source are made to meet every rule, and null in the last."""
    met = [("bn-IN", "math", "a"), ("Hindi", "math", "a"), ("en", "Mathematics", "a"), ("en", "", "openmath"), ("en", "", "FineWeb-Edu"), ("en", "Educational", "a"), (None, None, None)]
    case = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip("lds", row))) for row in met))
    d = table(spark, sf_dir, "documents").select(F.get(case, F.col("doc_id") % 7).alias("c"))
    return d.groupBy(sampling.stratum(F.col("c.l"), F.col("c.d"), F.col("c.s")).alias("stratum")).agg(F.count("*").alias("docs"))


def _stream(spark, sf_dir, name):
    return streams.document_stream(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


@query("SELECT source, count(*) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS within FROM documents GROUP BY source")
def stream_shards(spark, sf_dir):
    """Documents that arrive as a stream, written in shards of 1 MB at most."""
    out = streams.run_to_shards(_stream(spark, sf_dir, "documents"), shared_folder(spark, "stream-shards"), shared_folder(spark, "stream-shards-state"), 1 << 20, "source")
    within = F.bool_and((F.col("n_bytes") <= 1 << 20) | (F.col("n_docs") == 1))
    return out.groupBy("source").agg(F.sum("n_docs").alias("docs"), F.sum("n_bytes").alias("bytes"), within.alias("within"))


@query("SELECT event_type AS run_id, max(event_id) AS step, arg_max(value, event_id) AS loss FROM events GROUP BY ALL")
def progress_snapshot(spark, sf_dir):
    """The newest row of every run of a stream, read back from its snapshot."""
    path = f"{shared_folder(spark, 'progress')}/progress.json"
    e = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    streams.run_to_snapshot(e, path, shared_folder(spark, "progress-state"))
    return spark.read.schema("run_id string, step long, loss double").json(path)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def telemetry_log(spark, sf_dir):
    """Events appended to a log of JSON lines in two turns, and read back."""
    path, e = shared_folder(spark, "log"), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for k in range(2):
        writers.append_lines(e.where(F.col("event_id") % 2 == k), path)
    log = readers.read_jsonl(spark, path, "event_id long, event_type string, value double").where("status = 'ok'")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, count(*) AS docs FROM documents GROUP BY lang")
def report_round_trip(spark, sf_dir):
    """A report's rows as read back from its JSON."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    path, _ = writers.write_report(d, f"{shared_folder(spark, 'report')}/languages", "Documents by language")
    rows = json.loads(spark.read.text(path, wholetext=True).first()[0])["rows"]
    return spark.createDataFrame([(r["lang"], r["docs"]) for r in rows], "lang string, docs long")


@query("WITH s AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE lang = 'en' AND length(text) > 0) SELECT doc_id, sha256(text) AS h, true AS digested FROM s WHERE before < 200000")
def code_rows(spark, sf_dir):
    """Whole rows of one kind until 200,000 characters are crossed, with their digest."""
    rows, digest = readers.code_sample(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", 200_000)
    return rows.select("doc_id", F.sha2("text", 256).alias("h"), F.lit(len(digest) == 64).alias("digested"))


@query(
    """SELECT o_orderkey AS id, ['calculator', 'reverse', 'absent', 'calculator', 'reverse'][o_orderkey % 5 + 1] AS name, o_orderkey % 5 IN (0, 1) AS success,
    CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey * 2 AS VARCHAR) WHEN 1 THEN reverse('a' || o_orderkey) END AS output, o_orderkey % 5 > 1 AS has_error FROM orders"""
)
def tool_calls(spark, sf_dir):
    """A call of a registered tool for each order, with failures, a null argument and an unknown name as rows."""
    tools = Tools(Tool("calculator", "arithmetic", A.calculated), Tool("reverse", "text backwards", lambda a: a[::-1]))
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*(F.lit(x) for x in ("calculator", "reverse", "absent", "calculator", "reverse"))), (k % 5 + 1).cast("int"))
    argument = F.when(k % 5 == 0, F.format_string("%d * 2", k)).when(k % 5 == 1, F.concat(F.lit("a"), k.cast("string"))).when(k % 5 == 2, "x").when(k % 5 == 3, F.format_string("%d / 0", k))
    r = table(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"), tools.invoke(name, argument).alias("r"))
    return r.select("id", "name", "r.success", "r.output", F.col("r.error").isNotNull().alias("has_error"))
