"""Answer, tool, policy, checkpoint and planning queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import accounting, capabilities, evaluation, verify
from . import query, table
from .tokens import WORDS


_STRIPPED = r"regexp_replace({}, '^[\s\x1c-\x1f\x85\pZ]+|[\s\x1c-\x1f\x85\pZ]+$', '', 'g')"


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
    g AS (SELECT conv_id, turn, asked, CASE WHEN turn % 4 = 1 THEN asked || chr(10) || text ELSE text END AS said FROM c WHERE role = 'assistant' AND asked IS NOT NULL),
    a AS (SELECT conv_id, turn, {_STRIPPED.format("CASE WHEN starts_with(said, asked) THEN substr(said, length(asked) + 1) ELSE said END")} AS text FROM g)
    SELECT conv_id, turn, text AS answer, CAST(greatest(1, len({WORDS})) AS BIGINT) AS tokens FROM a"""
)
def prompt_echo(spark, sf_dir):
    """Answers without their question; every second of them is made to repeat it."""
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", asked.alias("asked")).where("role = 'assistant' and asked is not null")
    said = F.when(F.col("turn") % 4 == 1, F.concat("asked", F.lit("\n"), "text")).otherwise(F.col("text"))
    answer = c.select("conv_id", "turn", A.strip_echo(said, F.col("asked")).alias("answer"))
    return answer.select("conv_id", "turn", "answer", A.estimated_tokens(F.col("answer")).cast("long").alias("tokens"))


def _by_key(k, *cases):
    """The k-th of the cases, by the remainder of a key."""
    out = F.when(k % len(cases) == 0, cases[0])
    for n, case in enumerate(cases[1:], 1):
        out = out.when(k % len(cases) == n, case)
    return out


_EXPRESSION = "CASE o_orderkey % 10 WHEN 0 THEN k || ' + 3 * (' || k || ' % 7)' WHEN 1 THEN k || ' // 0' WHEN 2 THEN 'foo(' || k || ' / 0)' WHEN 3 THEN k || ' | 1' WHEN 4 THEN 'x + ' || k WHEN 5 THEN '-' || k || ' % 5' WHEN 6 THEN '2 ** (1001 + ' || k || ')' WHEN 7 THEN 'floor(' || k || ' / 4) + 0 * pi' WHEN 8 THEN '1 / 0 + foo(' || k || ')' ELSE '[' || k || ']' END"


@query(
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders), x AS (SELECT o_orderkey AS id, {_EXPRESSION} AS expression FROM o)
    SELECT id, expression, id % 10 IN (0, 5, 7) AS success, CASE id % 10 WHEN 0 THEN CAST(id + 3 * (id % 7) AS VARCHAR) WHEN 5 THEN CAST((5 - id % 5) % 5 AS VARCHAR) WHEN 7 THEN CAST(id // 4 AS VARCHAR) END AS output,
    CASE WHEN id % 10 IN (1, 8) THEN 'Division or modulo by zero.' WHEN id % 10 = 2 THEN 'Disallowed function call in calculator expression.' WHEN id % 10 = 3 THEN 'Unsupported mathematical syntax: BinOp' WHEN id % 10 = 4 THEN 'Unknown constant or variable: ' || chr(39) || 'x' || chr(39)
    WHEN id % 10 = 6 THEN 'Exponentiation result exceeds safe computation bounds.' WHEN id % 10 = 9 THEN 'Unsupported mathematical syntax: List' END AS error FROM x"""
)
def calculator(spark, sf_dir):
    """An expression of each order's key: values, and refusals in the order in which the parts are met."""
    k = F.col("o_orderkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    forms = [text(k, " + 3 * (", k, " % 7)"), text(k, " // 0"), text("foo(", k, " / 0)"), text(k, " | 1"), text("x + ", k), text("-", k, " % 5"), text("2 ** (1001 + ", k, ")"), text("floor(", k, " / 4) + 0 * pi"), text("1 / 0 + foo(", k, ")"), text("[", k, "]")]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _by_key(F.col("o_orderkey"), *forms).alias("expression"))
    return rows.select("id", "expression", A.calculate(F.col("expression")).alias("r")).select("id", "expression", "r.*")


@query()
def calculator_turns(spark, sf_dir):
    """The first arithmetic expression of every turn that has one, calculated."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", A.arithmetic_in(F.col("text")).alias("expression"))
    held = spark.createDataFrame([(-1, 0, "12 * (3 + 4)")], "conv_id long, turn long, expression string")  # so that there is one
    rows = c.where("expression is not null").unionByName(held)
    return rows.select("conv_id", "turn", "expression", A.calculate(F.col("expression")).alias("r")).select("conv_id", "turn", "expression", "r.*")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || ' * (3 + ' || o_orderkey % 7 || ')' END AS expression, CASE WHEN o_orderkey % 2 = 0 THEN 'x = ' || o_orderkey || chr(10) END AS code, o_orderkey % 4 < 2 AS states_answer FROM orders"""
)
def answer_extraction(spark, sf_dir):
    """What is read from a question and an answer made of each order's key: the arithmetic, the code block, whether a result is stated."""
    k = F.col("o_orderkey")
    q = F.when(k % 3 > 0, F.format_string("what is %d * (3 + %d)?", k, k % 7)).otherwise("how are you?")
    a = F.concat(F.when(k % 2 == 0, F.format_string("see ```python\nx = %d\n``` done", k)).otherwise("no code"), _by_key(k, F.format_string(" #### %d", k), F.lit(". The answer is open"), F.lit(" yet"), F.lit("")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), A.arithmetic_in(q).alias("expression"), A.fenced_code(a).alias("code"), A.states_answer(a).alias("states_answer"))


@query()
def response_scores(spark, sf_dir):
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(r[0]) for r in ("user", "assistant")))
    pairs = pairs.where("u is not null and a is not null")
    return pairs.select("conv_id", A.response_score(F.col("a"), F.col("u"), F.lit("instruction_following")).alias("s")).select("conv_id", "s.*")


@query(
    """SELECT o_orderkey AS case_id, ['REVISE', 'REVISE', 'REVISE', 'PASS', 'REVISE', 'PASS', 'PASS', 'PASS', 'UNVERIFIED', 'PASS', 'REVISE'][o_orderkey % 11 + 1] AS status,
    [0.0, 0.3, 0.1, 0.95, 0.0, 0.95, 0.95, 0.95, 0.5, 0.95, 0.2][o_orderkey % 11 + 1]::DOUBLE AS score FROM orders"""
)
def verdict_cases(spark, sf_dir):
    """Answers made of each order's key: empty, repetitive, false and true sums, broken and good code, facts without and with evidence."""
    k = F.col("o_orderkey")
    say = lambda form, *x: F.format_string(form, *x)
    answer = _by_key(
        k, F.lit(""), F.repeat(say("%d b c ", k), 4), say("so 25 * %d = %d", k, 25 * k + 5), say("so 25 * %d = %d", k, 25 * k), say("```python\nx = (%d\n```", k), say("```\nx = %d\n```", k), say("```rust\nlet x = (%d;\n```", k), say("inline ```x = (%d``` is left alone", k),
        F.lit("It was Bell."), F.lit("Bell invented the telephone."), F.lit("Bell invented the telephone."),
    )
    question = F.when(k % 11 == 8, "Who invented the telephone?").when(k % 11 > 8, "Who invented the Telephone?").otherwise("tell me")
    evidence = F.when(k % 11 == 9, F.array(F.lit("The telephone was invented by Bell."))).when(k % 11 == 10, F.array(F.lit("Rivers run downhill.")))
    rows = table(spark, sf_dir, "orders").select(k.alias("case_id"), question.alias("q"), answer.alias("a"), evidence.alias("e"))
    rows = rows.withColumn("code", verify.code(F.col("a"))["status"])
    v = verify.composite(F.col("q"), F.col("a"), F.col("e"), F.col("code"))
    return rows.select("case_id", v.alias("v")).select("case_id", "v.status", F.round("v.score", 6).alias("score"))


@query()
def composite_verdict(spark, sf_dir):
    """Every answer of the conversations against its own question, with the conversation's system turn as evidence where there is one."""
    system = F.max(F.when(F.col("role") == "system", F.col("text"))).over(Window.partitionBy("conv_id"))
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.coalesce(asked, F.lit("")).alias("q"), F.when(system.isNotNull(), F.array(system)).alias("e")).where("role = 'assistant'")
    c = c.withColumn("code", verify.code(F.col("text"))["status"])
    v = verify.composite(F.col("q"), F.col("text"), F.col("e"), F.col("code"))
    return c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.status", F.round("v.score", 6).alias("score"))


_STATE = "s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'FAST' WHEN 1 THEN 'TOOL' ELSE 'THINK' END AS route, CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'UNVERIFIED' ELSE 'ABSTAIN' END AS status, value * 100 AS ms, event_id % 5 AS calls, event_id % 2 AS retries, user_id AS tokens FROM events)"


@query(
    f"""WITH {_STATE} SELECT event_id, CASE WHEN ms > 10000 OR tokens > 256 THEN 'ABSTAIN' WHEN retries >= 1 AND status IN ('REVISE', 'ABSTAIN') THEN 'ABSTAIN' WHEN route = 'FAST' AND status = 'UNVERIFIED' THEN 'RETRIEVE'
    WHEN route = 'FAST' AND status = 'REVISE' THEN 'THINK' ELSE route END AS next, ms <= 10000 AND calls < 3 AS may_call FROM s"""
)
def policy_steps(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    route = F.when(k % 3 == 0, "FAST").when(k % 3 == 1, "TOOL").otherwise("THINK")
    status = F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "REVISE").when(k % 4 == 2, "UNVERIFIED").otherwise("ABSTAIN")
    step = evaluation.policy_step(route, status, F.col("value") * 100, k % 2, F.lit(1), F.col("user_id"), F.lit(128))
    return e.select("event_id", step.alias("next"), evaluation.may_call_tool(F.col("value") * 100, k % 5, F.lit(3)).alias("may_call"))


@query("SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL OR value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS improved FROM events")
def best_so_far(spark, sf_dir):
    best = F.min("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", (best.isNull() | (F.col("value") < best)).alias("improved"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn > 3")
def retention_victims(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("rn", rn).where("rn > 3").select("user_id", "event_id")


@query("SELECT doc_id, source || '-' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id)) AS VARCHAR), 8, '0') AS new_id FROM documents")
def reindexed_ids(spark, sf_dir):
    from ..operators.sampling import shuffle_key

    rn = F.row_number().over(Window.partitionBy("source").orderBy(shuffle_key(5)))
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("%s-%08d", F.col("source"), rn).alias("new_id"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= count(*) OVER () // 4 * 4")
def rank_partition(spark, sf_dir):
    """Each document's data-parallel rank; the tail that does not fill all ranks is dropped."""
    from ..operators.sampling import prefix_sum

    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).cast("long").alias("one"))
    n = d.agg(F.count("*").alias("n"))
    placed = prefix_sum(d, "doc_id", "one", "k").join(F.broadcast(n))  # one row
    return placed.where(F.col("k") < F.floor(F.col("n") / 4) * 4).select("doc_id", (F.col("k") % 4).alias("rank"))


@query("WITH n AS (SELECT p_partkey, 1000 * p_size AS vocab, unnest(range(1, 13)) AS n FROM part) SELECT p_partkey, vocab, CAST(coalesce(max(n) FILTER (vocab * 768 + n * (2 * 768 * 768 + 2 * 768 * 256 + 3 * 768 * 2048 + 2 * 768) <= 32000 * 768 + 12 * (2 * 768 * 768 + 2 * 768 * 256 + 3 * 768 * 2048 + 2 * 768) + 5000000), 1) AS BIGINT) AS layers FROM n GROUP BY ALL")
def layers_under_cap(spark, sf_dir):
    """For a vocabulary of each part's size the most layers that stay within five million parameters of 12 layers at 32,000."""
    lit = F.lit
    size = lambda vocab, n: accounting.parameter_count(vocab, lit(768), n, lit(12), lit(4), lit(2048))
    plans = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000).cast("long").alias("vocab"), F.explode(F.sequence(lit(1), lit(12))).alias("n"))
    fits = F.when(size(F.col("vocab"), F.col("n")) <= size(lit(32_000), lit(12)) + 5_000_000, F.col("n"))
    return plans.groupBy("p_partkey", "vocab").agg(F.coalesce(F.max(fits), lit(1)).cast("long").alias("layers"))


@query("WITH r AS (SELECT event_type AS run, user_id AS rate, avg(value) AS loss FROM events GROUP BY ALL) SELECT run, arg_min(rate, (loss, rate)) AS best_rate FROM r WHERE loss < 2.5 * ln(64000) * 10 GROUP BY run")
def learning_rate_choice(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("rate")).agg(F.avg("value").alias("loss"))
    return r.where(F.col("loss") < 2.5 * F.log(F.lit(64000.0)) * 10).groupBy("run").agg(F.min_by("rate", F.struct("loss", "rate")).alias("best_rate"))


@query("WITH t AS (SELECT lang, sum(n_chars) AS n FROM documents GROUP BY lang) SELECT CAST(min(n) AS BIGINT) AS budget, CAST(least(min(n) // 4096, 500) AS BIGINT) AS steps FROM t")
def equal_token_budget(spark, sf_dir):
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("n"))
    return t.agg(F.min("n").alias("budget")).select("budget", F.least(F.floor(F.col("budget") / 4096), F.lit(500)).cast("long").alias("steps"))


@query()
def log_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.format_string("Step %d | Loss %.3f | Tok/s %.1f | Mem 0.77", F.col("event_id"), F.col("value"), F.col("value") * 10).alias("line"))
    return lines.select("event_id", A.log_metrics(F.col("line")).alias("m")).select("event_id", "m.*")


_DECLARED = "SELECT 'm' || p_partkey AS model, 'size' || p_size AS name, p_partkey % 3 AS major, p_partkey % 5 AS minor, p_partkey % 7 AS patch, p_partkey % 11 = 0 AS pre, p_partkey % 40 AS tokens FROM part"


@query(
    f"""WITH d AS ({_DECLARED}), r AS (SELECT s_suppkey AS request_id, 'size' || (s_suppkey % 50 + 1) AS name, s_suppkey % 4 AS form, s_suppkey % 20 AS least FROM supplier)
    SELECT request_id, model, name, major || '.' || minor || '.' || patch || CASE WHEN pre THEN '-rc.1' ELSE '' END AS version FROM r JOIN d USING (name)
    WHERE tokens >= least AND CASE form WHEN 0 THEN (major = 1 AND (minor, patch) >= (2, 0) AND NOT (pre AND (minor, patch) = (2, 0))) WHEN 1 THEN major = 1 AND minor = 2 AND NOT (pre AND patch = 0)
    WHEN 2 THEN (major, minor, patch) >= (2, 0, 0) AND NOT (pre AND (major, minor, patch) = (2, 0, 0)) ELSE (major = 0 AND minor = 1 AND patch >= 3 AND NOT (pre AND patch = 3)) OR ((major, minor, patch) = (1, 1, 1) AND NOT pre) END"""
)
def capability_match(spark, sf_dir):
    """Requests of suppliers matched with capabilities that parts declare, by name, SemVer expression and properties (V14)."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    version = F.concat(F.format_string("%d.%d.%d", p % 3, p % 5, p % 7), F.when(p % 11 == 0, "-rc.1").otherwise(""))
    declared = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), p).alias("model"), F.concat(F.lit("size"), F.col("p_size")).alias("name"), version.alias("version"), F.create_map(F.lit("max_tokens"), (p % 40).cast("string")).alias("properties"))
    form = F.when(s % 4 == 0, "^1.2.0").when(s % 4 == 1, "~1.2").when(s % 4 == 2, ">=2.0.0").otherwise("^0.1.3 || 1.1.1")
    requests = table(spark, sf_dir, "supplier").select(s.alias("request_id"), F.format_string("size%d", s % 50 + 1).alias("name"), form.alias("expression"), F.create_map(F.lit("max_tokens"), F.format_string(">=%d", s % 20)).alias("required"))
    return capabilities.match(requests, declared)


@query("SELECT doc_id, text, lang AS language, source, 'unknown' AS license, 2 AS version FROM documents")
def schema_migration(spark, sf_dir):
    from ..operators.provenance import migrate

    steps = {1: lambda df: df.select("doc_id", "text", F.col("lang").alias("language"), "source", F.lit("unknown").alias("license"), F.lit(2).alias("version"))}
    return migrate(table(spark, sf_dir, "documents"), 1, 2, steps)


@query(
    f"""WITH t AS (SELECT doc_id, replace({_STRIPPED.format("text")}, chr(10), ' ') AS text FROM documents), s AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE length(text) > 50)
    SELECT doc_id, sha256(text) AS h FROM s WHERE before < 1000000"""
)
def sample_filter(spark, sf_dir):
    """A tokenizer sample: rows over 50 characters, line breaks as spaces, until a million characters are crossed."""
    from ..sources.readers import sample_text

    return sample_text(table(spark, sf_dir, "documents"), "doc_id", 1_000_000).select("doc_id", F.sha2("text", 256).alias("h"))
