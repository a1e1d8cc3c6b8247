"""Retrieval, routing, verification, evaluation, instruction data and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, retrieval, sft, verify
from ..sources.stage import staged
from . import query, table
from .tokens import WORDS

TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace(nfc_normalize({}), '[!-/:-@\[-`{{-~।॥—‘’“”«»]', '', 'g')), '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')"
BM25 = rf"""d AS (SELECT doc_id, lang, {TOKENS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
p AS (SELECT tok, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS tok FROM d) GROUP BY ALL), i AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
q AS (SELECT query_id, tok, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS tok FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, p.doc_id AS doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(1.0, al)))) AS score FROM q JOIN p USING (tok) JOIN i USING (tok), st <FILTER> GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM s WHERE score > 0)"""


_ENGLISH = "WHERE p.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _ranked(df):
    return df.select("query_id", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25.replace('<FILTER>', '')} SELECT query_id, doc, round(score, 4) AS score, rank FROM r WHERE rank <= 3")
def bm25_topk(spark, sf_dir):
    return _ranked(retrieval.bm25(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 3))


@query(f"WITH {BM25.replace('<FILTER>', _ENGLISH)} SELECT query_id, doc, round(score, 4) AS score, rank FROM r WHERE rank <= 3 AND score >= 1.0")
def bm25_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _ranked(retrieval.bm25(_queries(spark, sf_dir), docs, 3, candidates=F.col("lang") == "en", min_score=1.0))


@query(f"WITH {BM25.replace('<FILTER>', '')} SELECT tok AS token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM i, st")
def bm25_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieval.idf(retrieval.postings(docs), retrieval.statistics(docs)).withColumn("idf", F.round("idf", 6))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)
def embedding_cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = retrieval.cosine_topk(v, v.where("vec_id % 50 = 0"), 5)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, '<evidence doc_id=\"' || doc_id || '\" provenance=\"' || source || '\">' || chr(10) || text || chr(10) || '</evidence>' AS block FROM documents")
def context_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", retrieval.context_block(F.col("doc_id"), F.lit(None).cast("string"), F.col("source"), F.col("text")).alias("block"))


#: Hand-made questions beside the conversations', so that each path is met.
ASKED = ["calculate 12 * 4", "write a python function", "who invented the telephone", "prove that it halts step by step", "predict exact lottery numbers", "hello there"]
_ASKED_SQL = " UNION ALL ".join(f"SELECT {-k - 1} AS id, '{q}' AS q" for k, q in enumerate(ASKED))
_ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(trim(q), '(?i){p}') THEN {{'path': '{name}', 'score': {score:.2f}}}" for name, score, p in retrieval.ROUTES) + " ELSE {'path': 'FAST', 'score': 0.65} END"


def _asked(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    own = spark.createDataFrame([(-k - 1, q) for k, q in enumerate(ASKED)], "id long, q string")
    return turns.unionByName(own)


@query(f"WITH a AS (SELECT conv_id * 1000 + turn AS id, text AS q FROM conversations WHERE role = 'user' UNION ALL {_ASKED_SQL}), r AS (SELECT {_ROUTE_SQL} AS r FROM a) SELECT r.path AS path, CAST(r.score AS DOUBLE) AS score, count(*) AS queries FROM r GROUP BY ALL")
def router_paths(spark, sf_dir):
    r = _asked(spark, sf_dir).select(retrieval.route(F.col("q")).alias("r"))
    return r.groupBy(F.col("r.path").alias("path"), F.col("r.score").alias("score")).agg(F.count("*").alias("queries"))


@query(
    f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, text AS q FROM conversations WHERE role = 'user' UNION ALL {_ASKED_SQL}), r AS (SELECT id, {_ROUTE_SQL} AS r, abs(id) % 10 / 10.0 AS c FROM a)
    SELECT id, r.path AS path, CASE r.path WHEN 'FAST' THEN 128 WHEN 'THINK' THEN CASE WHEN c < 0.7 THEN 256 ELSE 512 END WHEN 'ABSTAIN' THEN 64 ELSE 256 END AS max_tokens,
    CASE r.path WHEN 'FAST' THEN 50 WHEN 'TOOL' THEN 30 WHEN 'ABSTAIN' THEN 1 ELSE 40 END AS top_k, CASE r.path WHEN 'THINK' THEN CASE WHEN c < 0.7 THEN 2 ELSE 4 END WHEN 'TOOL' THEN 2 WHEN 'RETRIEVE' THEN 1 ELSE 0 END AS max_reasoning_steps,
    CASE r.path WHEN 'TOOL' THEN 3 WHEN 'RETRIEVE' THEN 1 ELSE 0 END AS max_tool_calls FROM r"""
)
def router_budgets(spark, sf_dir):
    r = _asked(spark, sf_dir).select("id", retrieval.route(F.col("q"))["path"].alias("path"), (F.abs("id") % 10 / 10.0).alias("complexity"))
    return retrieval.allocated(r).select("id", "path", "max_tokens", "top_k", "max_reasoning_steps", "max_tool_calls")


_REP3 = f"CASE WHEN len(w) < 3 THEN 0 ELSE 1.0 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) / (len(w) - 2) END"


@query(
    f"""WITH a AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'assistant'), r AS (SELECT *, {_REP3} AS rep FROM a)
    SELECT conv_id, turn, CASE WHEN len(w) = 0 OR rep > 0.25 THEN 'REVISE' ELSE 'PASS' END AS status, round(CASE WHEN len(w) = 0 THEN 0 WHEN rep > 0.25 THEN 1 - rep ELSE 0.95 END, 6) AS score FROM r"""
)
def structural_verdict(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    v = a.select("conv_id", "turn", verify.structural(F.col("text")).alias("v"))
    return v.select("conv_id", "turn", "v.status", F.round("v.score", 6).alias("score"))


_ANSWER = "CASE k % 8 WHEN 0 THEN k || ' + ' || n || ' = ' || (k + n) WHEN 1 THEN k || ' * ' || n || ' = ' || (k * n + 1) WHEN 2 THEN 'no numbers but ' || k WHEN 3 THEN k || ' - ' || n || ' = ' || (k - n) || ' and 9 / 3 = 3' WHEN 4 THEN '2 + 3 * ' || n || ' = 14' WHEN 5 THEN k || ' / 0 = 1' WHEN 6 THEN '0.1 + 0.2 = 0.3' ELSE '5 - 2 = 3, ' || n || ' - 2 = 4' END"


@query(
    rf"""WITH a AS (SELECT k AS id, {_ANSWER} AS answer FROM (SELECT o_orderkey AS k, o_orderkey % 13 AS n FROM orders)), e AS (SELECT id, unnest(regexp_extract_all(answer, '\d+(?:\.\d+)?\s*[-+*/]\s*\d+(?:\.\d+)?\s*=\s*\d+(?:\.\d+)?')) AS q FROM a),
    x AS (SELECT id, regexp_extract(q, '^(\d+(?:\.\d+)?)', 1)::DOUBLE AS a, regexp_extract(q, '\s*([-+*/])', 1) AS op, regexp_extract(q, '[-+*/]\s*(\d+(?:\.\d+)?)', 1)::DOUBLE AS b, regexp_extract(q, '=\s*(\d+(?:\.\d+)?)', 1)::DOUBLE AS c FROM e),
    w AS (SELECT id, bool_or(coalesce(abs(CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b ELSE CASE WHEN b <> 0 THEN a / b END END - c) > 1e-4, true)) AS wrong FROM x GROUP BY id)
    SELECT a.id, CASE WHEN wrong IS NULL THEN 'UNVERIFIED' WHEN wrong THEN 'REVISE' ELSE 'PASS' END AS status FROM a LEFT JOIN w USING (id)"""
)
def math_verdict(spark, sf_dir):
    """Equations of each order's key: true, false, none, several, by zero, of decimals, in a chain."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 13
    say = lambda form, *x: F.format_string(form, *x)
    forms = [say("%d + %d = %d", k, n, k + n), say("%d * %d = %d", k, n, k * n + 1), say("no numbers but %d", k), say("%d - %d = %d and 9 / 3 = 3", k, n, k - n), say("2 + 3 * %d = 14", n), say("%d / 0 = 1", k), F.lit("0.1 + 0.2 = 0.3"), say("5 - 2 = 3, %d - 2 = 4", n)]
    answer = F.when(k % 8 == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        answer = answer.when(k % 8 == i, form)
    return table(spark, sf_dir, "orders").select(k.alias("id"), verify.mathematical(answer)["status"].alias("status"))


@query()
def grounding_verdict(spark, sf_dir):
    """Each answer against the retrieved documents of its question's text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    best = retrieval.bm25(items.withColumnRenamed("item_id", "query_id"), table(spark, sf_dir, "documents"), 2)
    best = staged(best.select("query_id", "doc", "rank"), "best")
    few = F.broadcast(best) if best.count() <= 100_000 else best  # else the texts of all documents would be shuffled
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("evidence")).join(few, "doc")
    evidence = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    rows = items.join(evidence.withColumnRenamed("query_id", "item_id"), "item_id", "left")
    return rows.select("item_id", verify.grounded(F.col("text"), F.col("text"), F.col("evidence")).alias("v")).select("item_id", "v.status", F.round("v.score", 6).alias("score"))


#: Events as evaluation results: type is the category, value the latency, k of props the tokens.
_RESULTS = "e AS (SELECT event_id, user_id, event_type AS category, value AS latency_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, user_id % 3 > 0 AS passed, user_id % 3 = 0 AND event_id % 2 = 0 AS hallucinated, (event_id % 10) / 10.0 AS repetition, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS mode FROM events)"


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("category"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("user_id") % 3 > 0).alias("passed"), ((F.col("user_id") % 3 == 0) & (F.col("event_id") % 2 == 0)).alias("hallucinated"), ((F.col("event_id") % 10) / 10.0).alias("repetition"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("mode"))


_ROUNDED = ("pass_rate", "hallucination_rate", "repetition", "latency_ms", "tokens_per_s")


@query(f"WITH {_RESULTS} SELECT category, count(*) AS n, round(avg(passed::INT), 6) AS pass_rate, round(avg(hallucinated::INT), 6) AS hallucination_rate, round(avg(repetition), 6) AS repetition, round(avg(latency_ms), 6) AS latency_ms, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / greatest(0.001, sum(latency_ms) / 1000), 6) AS tokens_per_s FROM e GROUP BY ROLLUP (category)")
def eval_battery_rollup(spark, sf_dir):
    return evaluation.battery(_results(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in _ROUNDED})


_AB = ", ".join(f"round(avg({c}::DOUBLE) FILTER (mode = 'a'), 6) AS {c}_a, round(avg({c}::DOUBLE) FILTER (mode = 'b'), 6) AS {c}_b, round(avg({c}::DOUBLE) FILTER (mode = 'b') - avg({c}::DOUBLE) FILTER (mode = 'a'), 6) AS {c}_delta" for c in ("passed", "latency_ms", "tokens"))


@query(f"WITH {_RESULTS} SELECT {_AB} FROM (SELECT mode, passed::INT AS passed, latency_ms, tokens FROM e)")
def ab_delta(spark, sf_dir):
    out = evaluation.ab_delta(_results(spark, sf_dir), "a", "b")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"WITH {_RESULTS} SELECT category AS domain, count(*) AS failures FROM e WHERE NOT passed GROUP BY category")
def gap_counts(spark, sf_dir):
    return evaluation.gaps(_results(spark, sf_dir).withColumnRenamed("category", "domain"))


@query(
    f"""WITH t AS (SELECT user_id AS query_id, event_id, ts, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, CASE event_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVISE' ELSE 'UNVERIFIED' END AS status, value < 1 AS aborted FROM events)
    SELECT query_id, count(*) AS event_count, CAST(sum(tokens) AS BIGINT) AS tokens_consumed, arg_max(status, (ts, event_id)) IN ('PASS', 'UNVERIFIED') AND NOT bool_or(aborted) AS success, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM t GROUP BY query_id"""
)
def telemetry_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "PASS").when(F.col("event_id") % 3 == 1, "REVISE").otherwise("UNVERIFIED")
    rows = e.select(F.col("user_id").alias("query_id"), "event_id", "ts", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), status.alias("status"), (F.col("value") < 1).alias("aborted"))
    return evaluation.telemetry(rows).select("query_id", "event_count", "tokens_consumed", "success", F.array_join("kinds", ",").alias("kinds"))


@query(f"WITH {_RESULTS} SELECT category, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(stddev_samp(latency_ms) / sqrt(count(*)), 6) AS stderr, round(avg(latency_ms) - 1.96 * stddev_samp(latency_ms) / sqrt(count(*)), 6) AS ci_low, round(avg(latency_ms) + 1.96 * stddev_samp(latency_ms) / sqrt(count(*)), 6) AS ci_high FROM e GROUP BY category")
def metric_confidence(spark, sf_dir):
    out = evaluation.confidence(_results(spark, sf_dir), "category", "latency_ms")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stderr", "ci_low", "ci_high")})


LAST = """l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'system') AS s, arg_max(text, turn) FILTER (role = 'user') AS u, arg_max(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, CASE WHEN s IS NULL THEN '' ELSE '[SYSTEM]' || s || chr(10) END || '[USER]' || u || chr(10) || '[ASSISTANT]' AS prompt, a AS response FROM l WHERE u IS NOT NULL AND a IS NOT NULL)"""


@query(f"WITH {LAST} SELECT conv_id, sha256(prompt) AS prompt, sha256(response) AS response FROM x")
def chat_examples(spark, sf_dir):
    x = sft.chat_examples(table(spark, sf_dir, "conversations"))
    return x.select("conv_id", F.sha2("prompt", 256).alias("prompt"), F.sha2("response", 256).alias("response"))


@query(f"WITH c AS (SELECT role, len({WORDS}) AS w FROM conversations), r AS (SELECT role, w, row_number() OVER (PARTITION BY role ORDER BY w) - 1 AS k, count(*) OVER (PARTITION BY role) AS n FROM c) SELECT role, count(*) AS n, CAST(sum(w) AS BIGINT) AS total, CAST(max(w) FILTER (k = n // 2) AS BIGINT) AS median, CAST(max(w) FILTER (k = floor(n * 0.95)) AS BIGINT) AS p95 FROM r GROUP BY role")
def sft_length_stats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", F.size(T.split_words(F.col("text"))).cast("long").alias("w"))
    return sft.length_statistics(c, "role", "w")


_SW = WORDS.replace("text", "prompt || ' ' || response")


@query(
    rf"""WITH {LAST}, p AS (SELECT conv_id, trim(prompt) AS prompt, trim(response) AS response FROM x), t AS (SELECT conv_id, prompt, response, len({_SW}) AS n FROM p WHERE length(prompt) >= 5 AND length(response) >= 5),
    f AS (SELECT *, min(conv_id) OVER (PARTITION BY lower(prompt || chr(10) || response)) AS first FROM t WHERE n <= 512) SELECT conv_id, CAST(n AS BIGINT) AS token_count FROM f WHERE conv_id = first"""
)
def sft_dedup(spark, sf_dir):
    return sft.build(sft.chat_examples(table(spark, sf_dir, "conversations"))).select("conv_id", F.col("token_count").cast("long").alias("token_count"))


@query(
    rf"""WITH {LAST}, t AS (SELECT conv_id, len({WORDS.replace('text', 'prompt')}) AS p, least(len({WORDS.replace('text', 'response')}), 126) AS r FROM x)
    SELECT conv_id, CAST(128 AS BIGINT) AS length, CAST(r + 1 AS BIGINT) AS supervised, CAST(2 + r + least(p, 126 - r) AS BIGINT) AS attended FROM t"""
)
def sft_loss_mask_counts(spark, sf_dir):
    ids = lambda c: F.transform(T.split_words(F.col(c)), F.length)
    x = sft.chat_examples(table(spark, sf_dir, "conversations")).select("conv_id", ids("prompt").alias("p"), ids("response").alias("r"))
    m = x.select("conv_id", sft.mask_separate(F.col("p"), F.col("r"), 128, 1, 2).alias("m"))
    return m.select("conv_id", F.size("m.labels").cast("long").alias("length"), F.size(F.filter("m.labels", lambda v: v != sft.IGNORE)).cast("long").alias("supervised"), F.size(F.filter("m.attention_mask", lambda v: v == 1)).cast("long").alias("attended"))


@query(
    rf"""WITH p AS (SELECT item_id, CAST(len({WORDS}) AS BIGINT) AS n FROM benchmark), s AS (SELECT sum(n) AS total FROM p), r AS (SELECT unnest(range(0, CAST(floor(5000 / total) AS BIGINT) + 1)) AS round FROM s),
    b AS (SELECT round, item_id, n AS n_tok, coalesce(sum(n) OVER (ORDER BY round, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p, r) SELECT round, item_id, n_tok, CAST(before AS BIGINT) AS before FROM b WHERE before < 5000"""
)
def replay_mix(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select("item_id", F.size(T.split_words(F.col("text"))).cast("long").alias("n_tok"))
    return sft.replay(p, 5000).select(F.col("round").cast("long").alias("round"), "item_id", "n_tok", "before")


@query(rf"WITH c AS (SELECT conv_id, turn, sum(len({WORDS})) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM c WHERE used <= 400")
def session_context_window(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.split_words(F.col("text"))).cast("long").alias("n_tok"))
    return sft.context_window(t, 400).select("conv_id", "turn", "used")


@query("SELECT quality, toxic, count(*) AS docs, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def quality_metrics(spark, sf_dir):
    from ..operators.accounting import with_share

    g = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"))
    return with_share(g, "docs").withColumn("share", F.round("share", 6))


@query(rf"WITH p AS (SELECT item_id, 'Below is an instruction that describes a task. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM benchmark) SELECT item_id, sha256(prompt) AS h FROM p")
def alpaca_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(sft.alpaca_prompt(F.col("text"), F.lit("")), 256).alias("h"))
