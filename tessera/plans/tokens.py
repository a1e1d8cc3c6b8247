"""Accounting, sampling, sharding, packing, provenance and tokenizer queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounting, packing, provenance, sampling, tokenizer
from ..sources.stage import staged
from . import query, table

WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')"
RATIOS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
SEED, TARGET = 20260817, 100_000
VOCAB = 32_000  # the reference's


def _counted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumn("n_tok", F.size(T.split_words(F.col("text"))).cast("long"))


@query(
    rf"""SELECT lang, source, count(*) AS docs, CAST(sum(len({WORDS})) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes
    FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())"""
)
def token_accounting_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return accounting.token_accounting(d, [["lang"], ["source"], ["lang", "source"]], F.size(T.split_words(F.col("text"))))


@query(rf"WITH s AS (SELECT lang, CAST(sum(len({WORDS})) AS BIGINT) AS tokens FROM documents GROUP BY lang) SELECT lang, tokens, round(tokens / sum(tokens) OVER (), 6) AS share FROM s")
def stratum_share(spark, sf_dir):
    s = _counted(spark, sf_dir).groupBy("lang").agg(F.sum("n_tok").alias("tokens"))
    return accounting.with_share(s, "tokens").withColumn("share", F.round("share", 6))


@query("SELECT CASE WHEN lang LIKE '%bn%' THEN 'Bengali' WHEN lang LIKE '%hi%' THEN 'Hindi' ELSE 'English_Wikipedia' END AS stratum, count(*) AS docs FROM documents GROUP BY ALL")
def document_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(sampling.stratum(F.col("lang"), F.lit(""), F.col("source")).alias("stratum")).agg(F.count("*").alias("docs"))


SAMPLE_SQL = rf"""c AS (SELECT doc_id, lang AS stratum, CAST(len({WORDS}) AS BIGINT) AS n_tok FROM documents),
p AS (SELECT *, sha256('{SEED}:' || doc_id) AS k, CASE stratum WHEN 'en' THEN 50000 WHEN 'fr' THEN 20000 WHEN 'de' THEN 20000 ELSE 10000 END AS quota FROM c),
r AS (SELECT *, sum(n_tok) OVER (PARTITION BY stratum ORDER BY k) AS cum FROM p),
f AS (SELECT *, cum - n_tok AS prev, (cum <= quota OR cum - n_tok = 0) AS fits FROM r),
o AS (SELECT *, sum((NOT fits)::INT) OVER (PARTITION BY stratum ORDER BY k) AS n_out FROM f),
t AS (SELECT *, (fits AND n_out = 0) OR (NOT fits AND n_out = 1 AND cum - quota < quota - prev) AS take FROM o),
d AS (SELECT {TARGET} - sum(n_tok) AS deficit FROM t WHERE take),
x AS (SELECT doc_id, stratum, n_tok, coalesce(sum(n_tok) OVER (ORDER BY sha256('{SEED + 1}:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev2 FROM t WHERE NOT take AND stratum IN ('en', 'fr')),
s AS (SELECT doc_id, stratum, n_tok, 'quota' AS taken_in FROM t WHERE take UNION ALL SELECT doc_id, stratum, n_tok, 'refill' FROM x, d WHERE prev2 < deficit)"""


def _sample(spark, sf_dir):
    return sampling.budget_sample(_counted(spark, sf_dir).withColumnRenamed("lang", "stratum"), TARGET, RATIOS, SEED, refill=("en", "fr"))


@query(f"WITH {SAMPLE_SQL} SELECT * FROM s")
def stratified_budget_sample(spark, sf_dir):
    return _sample(spark, sf_dir)


@query(f"WITH {SAMPLE_SQL} SELECT stratum, count(*) AS docs, CAST(sum(n_tok) AS BIGINT) AS tokens, CAST(sum(sum(n_tok)) OVER () - {TARGET} AS BIGINT) AS delta FROM s GROUP BY stratum")
def sample_summary(spark, sf_dir):
    s = _sample(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("docs"), F.sum("n_tok").alias("tokens"))
    return s.withColumn("delta", F.sum("tokens").over(Window.partitionBy()) - TARGET)


@query(
    """WITH u AS (SELECT source, doc_id FROM (SELECT source, doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM u)
    SELECT source, doc_id, CAST(rn AS BIGINT) AS rn, CASE WHEN rn <= 3 THEN 'val' ELSE 'train' END AS split FROM r WHERE rn <= 13"""
)
def quota_val_train_split(spark, sf_dir):
    from ..operators.dedup import mark_first

    d = mark_first(table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id").where("first_seen").select("source", "doc_id")
    return sampling.quota_split(d, "source", "doc_id", 3, 10).withColumn("rn", F.col("rn").cast("long"))


@query(rf"WITH c AS (SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_tok FROM documents), p AS (SELECT *, CAST(sum(n_tok) OVER (ORDER BY doc_id) - n_tok AS BIGINT) AS before FROM c) SELECT doc_id, n_tok, before FROM p WHERE before < 50000")
def prefix_until_budget(spark, sf_dir):
    return sampling.prefix_until(_counted(spark, sf_dir).select("doc_id", "n_tok"), "doc_id", "n_tok", 50_000).select("doc_id", "n_tok", "before")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id)) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rn <= floor(n * 5 / 100) THEN 'val' ELSE 'train' END AS split FROM r")
def hash_split_95_5(spark, sf_dir):
    return sampling.hash_split(table(spark, sf_dir, "documents").select("doc_id"), 7, 5)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || doc_id)) AS rn FROM documents) WHERE rn <= 5")
def stratified_audit_sample(spark, sf_dir):
    return sampling.audit_sample(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", 5, 11).select("lang", "doc_id")


SHARDS = """RECURSIVE o AS (SELECT source, doc_id, text, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
g AS (SELECT source, doc_id, text, n, k, 0 AS shard, n AS total FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.text, o.n, o.k, CASE WHEN g.total > 0 AND g.total + o.n > 20000 THEN g.shard + 1 ELSE g.shard END, CASE WHEN g.total > 0 AND g.total + o.n > 20000 THEN o.n ELSE g.total + o.n END
  FROM g JOIN o ON o.source = g.source AND o.k = g.k + 1)"""


def _shards(spark, sf_dir):
    return packing.greedy_shards(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), 20_000, group="source")


@query(f"WITH {SHARDS} SELECT source, CAST(shard AS BIGINT) AS shard, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_bytes FROM g GROUP BY source, shard")
def greedy_shards(spark, sf_dir):
    return _shards(spark, sf_dir).select("source", "shard", "n_docs", "n_bytes")


@query(f"WITH {SHARDS} SELECT source, CAST(shard AS BIGINT) AS shard, 'shard_' || substr(sha256(string_agg(text, chr(10) ORDER BY doc_id)), 1, 16) AS digest FROM g GROUP BY source, shard")
def shard_hash(spark, sf_dir):
    return _shards(spark, sf_dir).select("source", "shard", "digest")


def _tokens(spark, sf_dir):
    """Documents as token ids; a word's id is its code-point length, which both engines can tell."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.split_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.transform("w", F.length).alias("tokens"))


STREAM = rf"""d AS (SELECT doc_id, list_transform({WORDS}, lambda x: length(x)) AS t FROM documents),
e AS (SELECT doc_id, unnest(list_append(t, 0)) AS token, generate_subscripts(list_append(t, 0), 1) AS k FROM d),
s AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, token, doc_id FROM e)"""
_DIGEST = "sha256(array_to_string(list(token ORDER BY pos), ','))"


def _digest(df):
    return df.select("chunk", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("h"))


@query(rf"SELECT doc_id AS doc, CAST(len({WORDS}) + 1 AS BIGINT) AS n, CAST(sum(len({WORDS}) + 1) OVER (ORDER BY doc_id) - len({WORDS}) - 1 AS BIGINT) AS 'offset' FROM documents")
def doc_token_offsets(spark, sf_dir):
    return packing.offsets(_tokens(spark, sf_dir))


@query(f"WITH {STREAM.replace('list_append(t, 0)', 'CASE WHEN len(t) > 0 THEN list_append(t, 0) ELSE t END')} SELECT CAST(pos // 129 AS BIGINT) AS chunk, {_DIGEST} AS h FROM s GROUP BY 1 HAVING count(*) = 129")
def packed_chunks_a(spark, sf_dir):
    return _digest(packing.chunks(packing.token_stream(_tokens(spark, sf_dir), eos=0, eos_for_empty=False), 128))


@query(f"WITH {STREAM}, b AS (SELECT pos, token, pos // 128 AS chunk FROM s UNION ALL SELECT pos, token, pos // 128 - 1 FROM s WHERE pos % 128 = 0 AND pos > 0) SELECT CAST(chunk AS BIGINT) AS chunk, {_DIGEST} AS h FROM b GROUP BY 1 HAVING count(*) = 129")
def packed_windows_b(spark, sf_dir):
    return _digest(packing.windows(packing.token_stream(_tokens(spark, sf_dir), eos=0), 128))


@query(f"WITH {STREAM.replace('list_append(t, 0)', 't')} SELECT CAST(pos // 129 AS BIGINT) AS chunk, {_DIGEST} AS h FROM s GROUP BY 1 HAVING count(*) = 129")
def packed_chunks_c(spark, sf_dir):
    return _digest(packing.chunks(packing.token_stream(_tokens(spark, sf_dir)), 128))


@query(f"WITH {STREAM}, c AS (SELECT CAST(pos // 129 AS BIGINT) AS chunk, token, pos, lead(token) OVER (PARTITION BY pos // 129 ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY pos // 129) AS n FROM s) SELECT chunk, CAST(sum(token) AS BIGINT) AS input_sum, CAST(sum(nxt) AS BIGINT) AS label_sum FROM c WHERE n = 129 AND nxt IS NOT NULL GROUP BY chunk")
def next_token_pairs(spark, sf_dir):
    p = packing.shifted(packing.chunks(packing.token_stream(_tokens(spark, sf_dir), eos=0), 128))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("chunk", total(F.col("input_ids")).alias("input_sum"), total(F.col("labels")).alias("label_sum"))


@query(f"WITH {STREAM} SELECT CAST(max(token) AS BIGINT) AS max_id, max(token) < 64000 AS in_range FROM s")
def token_id_range(spark, sf_dir):
    top = _tokens(spark, sf_dir).agg(F.max(F.array_max("tokens")).cast("long").alias("max_id"))
    return top.withColumn("in_range", F.col("max_id") < 64000)


@query(
    """SELECT 'label->document' AS relation, CAST(l.doc_id AS VARCHAR) AS key FROM labels l ANTI JOIN documents d USING (doc_id)
    UNION ALL SELECT 'order->customer', CAST(o_custkey AS VARCHAR) FROM orders ANTI JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'customer->supplier nation', CAST(c_nationkey AS VARCHAR) FROM customer ANTI JOIN supplier ON s_nationkey = c_nationkey"""
)
def fk_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    a = provenance.orphans(t("labels"), "doc_id", t("documents"), "doc_id", "label->document")
    b = provenance.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey", "order->customer")
    return a.unionByName(b).unionByName(provenance.orphans(t("customer"), "c_nationkey", t("supplier"), "s_nationkey", "customer->supplier nation"))


@query("WITH s AS (SELECT source, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY source) SELECT count(*) AS entries, count(DISTINCT source) AS different, round(sum(share), 9) AS total, abs(sum(share) - 1) <= 1e-9 AS sums_to_one, CAST(count(*) FILTER (share <= 0) AS BIGINT) AS bad_shares FROM s")
def mixture_share_check(spark, sf_dir):
    s = accounting.with_share(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "n")
    return provenance.mixture_check(s, "source", "share").withColumn("total", F.round("total", 9))


@query(
    """WITH e AS (SELECT source AS key, count(*) AS v FROM documents GROUP BY source), a AS (SELECT source AS key, count(*) AS v FROM documents WHERE lang <> 'es' AND source <> 'src3' GROUP BY source)
    SELECT coalesce(e.key, a.key) AS key, coalesce(CAST(e.v AS VARCHAR), 'missing') AS expected, coalesce(CAST(a.v AS VARCHAR), 'missing') AS actual FROM e FULL JOIN a ON a.key = e.key WHERE e.v IS DISTINCT FROM a.v"""
)
def identity_mismatch(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "lang")
    n = lambda x: x.groupBy("key").agg(F.count("*").alias("v"))
    return provenance.identity_mismatch(n(d), n(d.where("lang <> 'es' AND key <> 'src3'")), "key", "v").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in ("expected", "actual")})


@query("SELECT source, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def dataset_manifest(spark, sf_dir):
    return provenance.manifest(table(spark, sf_dir, "documents"), "source").drop("fingerprint")


@query(
    """WITH l AS (SELECT k // 4096 AS leaf, sha256(string_agg(sha256(text), chr(10) ORDER BY k)) AS h FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY leaf)) AS digest FROM l"""
)
def corpus_digest(spark, sf_dir):
    return accounting.corpus_digest(table(spark, sf_dir, "documents"))


@query(r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS piece FROM documents) GROUP BY piece")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@query()
def pretoken_counts(spark, sf_dir):
    return tokenizer.pretoken_counts(table(spark, sf_dir, "documents"))


@query()
def bpe_merges(spark, sf_dir):
    v = tokenizer.train(tokenizer.pretoken_counts(table(spark, sf_dir, "documents")), VOCAB)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(v.merges)], "rank int, left binary, right binary")


@query()
def tokens_per_language(spark, sf_dir):
    """Each different piece is encoded once; whole texts only where a special token stands in them, which cuts pieces anew."""
    docs = table(spark, sf_dir, "documents").select("lang", "text").withColumn("special", tokenizer.holds_special(F.col("text")))
    counts = staged(tokenizer.pretoken_counts(docs, by=("lang", "special")), "pieces")
    v = tokenizer.train(counts.groupBy("piece").agg(F.sum("n").alias("n")), VOCAB)
    plain = tokenizer.counted(counts.where("NOT special").repartition("piece"), v, "piece", pieces=True).select("lang", (F.col("n") * F.col("tokens")).alias("tokens"))
    others = tokenizer.counted(docs.where("special"), v).select("lang", "tokens")
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.split_words(F.col("text")))).alias("words"))
    n = plain.unionByName(others).unionByName(sizes, allowMissingColumns=True)
    s = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "bytes", "chars", "words")}
    return n.groupBy("lang").agg(s["tokens"].alias("tokens"), *(F.try_divide(s[a], s[b]).alias(f"{a}_per_{b[:-1]}") for a, b in (("bytes", "tokens"), ("tokens", "chars"), ("tokens", "words"))))


@query(rf"SELECT round(exp(sum(l_extendedprice * l_discount) / 1e4 / sum(l_quantity)), 6) AS perplexity FROM lineitem")
def weighted_perplexity(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount") / 1e4).alias("loss"), "l_quantity")
    return accounting.perplexity(d, "loss", "l_quantity").select(F.round("perplexity", 6).alias("perplexity"))


@query(r"SELECT lang, round(sum(n_chars) / ln(2) / sum(strlen(text)), 6) AS bpb, round(ln(64000), 6) AS uniform FROM documents GROUP BY lang")
def bits_per_byte(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("nats"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return g.select("lang", F.round(accounting.bits_per_byte(F.col("nats"), F.col("n_bytes")), 6).alias("bpb"), F.round(F.log(F.lit(64000.0)), 6).alias("uniform"))


@query(
    """WITH r AS (SELECT lang AS "view", source AS tokenizer, avg(n_chars) AS bpb FROM documents GROUP BY ALL), w AS (SELECT "view", first(tokenizer ORDER BY bpb, tokenizer) AS winner FROM r GROUP BY "view"),
    v AS (SELECT winner, count(*) AS votes FROM w GROUP BY winner ORDER BY votes DESC, winner LIMIT 1) SELECT winner, votes, CASE WHEN votes = 4 THEN 'HIGH' WHEN votes >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v"""
)
def winner_vote(spark, sf_dir):
    r = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("view"), F.col("source").alias("tokenizer")).agg(F.avg("n_chars").alias("bpb"))
    return accounting.majority(accounting.winners(r.withColumns({"stable": F.lit(True), "learning": F.lit(True)})))


@query("WITH c AS (SELECT 'part' || p_partkey AS name, 1000 * p_size AS v, 64 * (1 + p_partkey % 12) AS d, 1 + p_partkey % 24 AS n, 1 + p_partkey % 4 AS kv, p_partkey % 2 AS qk FROM part) SELECT 'v1' AS name, 99496704 AS parameters UNION ALL SELECT 'v2', 112382208 UNION ALL SELECT name, CAST(v * d + d + n * (2 * d * d + 2 * d * kv * 64 + 3 * d * 2048 + 2 * d + qk * 128) AS BIGINT) FROM c")
def parameter_counts(spark, sf_dir):
    """Sizes of the two published models and of a model for each part."""
    fields = "name string, vocab long, d long, layers long, heads long, kv long, inner long, qk boolean"
    rows = spark.createDataFrame([("v1", 64000, 768, 8, 12, 4, 2048, False), ("v2", 48000, 768, 12, 12, 4, 2048, True)], fields)
    k, c = F.col("p_partkey").cast("long"), F.col
    made = [F.concat(F.lit("part"), k), c("p_size").cast("long") * 1000, (k % 12 + 1) * 64, k % 24 + 1, k % 12 + 1, k % 4 + 1, F.lit(2048).cast("long"), k % 2 == 1]
    rows = rows.unionByName(table(spark, sf_dir, "part").select(*(x.alias(f.split()[0]) for x, f in zip(made, fields.split(", ")))))
    return rows.select("name", accounting.parameter_count(c("vocab"), c("d"), c("layers"), c("heads"), c("kv"), c("inner"), qk_norm=c("qk")).alias("parameters"))


@query("SELECT event_id, round(CASE WHEN i < 100 THEN 0.0006 * (i + 1) / 100 ELSE 0.0006 * greatest(0.1, 0.5 * (1 + cos(least(1.0, (i - 100) / 900.0) * pi()))) END, 9) AS lr FROM (SELECT event_id, event_id % 1000 AS i FROM events)")
def learning_rates(spark, sf_dir):
    """The rate at each event's step."""
    return table(spark, sf_dir, "events").select("event_id", F.round(accounting.learning_rate(F.col("event_id") % 1000, 1000, 100, 0.0006), 9).alias("lr"))


@query(
    r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS t FROM documents), p AS (SELECT t, len(list_filter(regexp_split_to_array(t, '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')) AS w FROM l)
    SELECT count(*) AS "rows", CAST(count(*) FILTER (t = '') AS BIGINT) AS "empty", CAST(count(*) FILTER (regexp_matches(t, '^=.*=$')) AS BIGINT) AS headings, round(avg(w) FILTER (t <> ''), 6) AS mean_words FROM p"""
)
def dataset_row_profile(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return accounting.row_profile(lines).withColumn("mean_words", F.round("mean_words", 6))


@query(
    """WITH c AS (SELECT (SELECT count(*) FROM documents) >= 100 AS a, (SELECT count(DISTINCT lang) FROM documents) >= 10 AS b, (SELECT count(*) FROM labels) > 0 AS d)
    SELECT CAST((NOT a)::INT + (NOT d)::INT AS BIGINT) AS failures, CAST((NOT b)::INT AS BIGINT) AS warnings, CASE WHEN a AND d THEN 'GO' ELSE 'NO-GO' END AS decision FROM c"""
)
def preflight_decision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.agg((F.count("*") >= 100).alias("ok")).select(F.lit("enough documents").alias("name"), F.lit("error").alias("severity"), "ok")
    b = docs.agg((F.count_distinct("lang") >= 10).alias("ok")).select(F.lit("ten languages").alias("name"), F.lit("warning").alias("severity"), "ok")
    d = table(spark, sf_dir, "labels").agg((F.count("*") > 0).alias("ok")).select(F.lit("labels").alias("name"), F.lit("error").alias("severity"), "ok")
    return accounting.decision(a.unionByName(b).unionByName(d))
