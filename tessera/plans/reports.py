"""Reports, gates, splits and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounting, evaluation, quality, sampling
from ..sources import catalogue, packed, readers, writers
from ..sources.stage import shared_folder, staged
from . import corpus, query, table
from .corpus import FOLD, GATE_ROWS, NORM
from .tokens import STREAM, WORDS

_JUDGED = "NOT duplicate AND NOT contaminated"


@query(
    f"""WITH {GATE_ROWS}, t AS (SELECT count(*) AS documents, CAST(count(*) FILTER (duplicate) AS BIGINT) AS duplicates, CAST(count(*) FILTER (NOT duplicate AND contaminated) AS BIGINT) AS contaminated,
    CAST(count(*) FILTER (accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER ({_JUDGED} AND len(list_filter(reasons, lambda r: starts_with(r, 'language_script_mismatch:'))) > 0) AS BIGINT) AS script_warnings FROM a),
    r AS (SELECT *, round((documents - accepted) / documents, 6) AS reject_rate, round(duplicates / documents, 6) AS duplicate_rate, round(script_warnings / documents, 6) AS script_warning_rate FROM t)
    SELECT *, concat_ws(',', CASE WHEN contaminated > 0 THEN 'heldout_contamination' END, CASE WHEN reject_rate > 0.02 THEN 'reject_rate' END, CASE WHEN duplicate_rate > 0.005 THEN 'duplicate_rate' END, CASE WHEN script_warning_rate > 0 THEN 'script_warning_rate' END, CASE WHEN accepted = 0 THEN 'no_accepted_documents' END) AS failures,
    CASE WHEN contaminated > 0 OR reject_rate > 0.02 OR duplicate_rate > 0.005 OR script_warning_rate > 0 OR accepted = 0 THEN 'FAIL' ELSE 'PASS' END AS decision FROM r"""
)
def corpus_gate_decision(spark, sf_dir):
    """Counters, rates, threshold failures and the decision that lets the corpus be published or not."""
    out = quality.gate_failures(quality.gate_totals(corpus.gate_rows(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("reject_rate", "duplicate_rate", "script_warning_rate")}).withColumn("failures", F.array_join("failures", ","))


@query(
    f"""WITH {GATE_ROWS}, k AS (SELECT a.*, d.source, q.script FROM a JOIN documents d USING (doc_id) JOIN q USING (doc_id) WHERE accepted)
    SELECT 'language' AS dimension, language AS value, count(*) AS docs FROM k GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'script', script, count(*) FROM k GROUP BY ALL"""
)
def corpus_gate_accepted(spark, sf_dir):
    """Accepted documents by language, source and script, in one pass over the gate's rows."""
    kept = corpus.gate_rows(spark, sf_dir).where("accepted")
    dims = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (("language", "language"), ("source", "source"), ("script", "dominant_script"))))
    return kept.select(F.explode(dims).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("docs"))


@query(
    f"""WITH {GATE_ROWS} SELECT reason, count(*) AS docs FROM (SELECT unnest(CASE WHEN duplicate THEN ['normalized_exact_duplicate'] WHEN contaminated THEN ['heldout_contamination'] ELSE reasons END) AS reason FROM a) GROUP BY reason"""
)
def corpus_gate_rejections(spark, sf_dir):
    """What documents are rejected for, in the gate's order: duplicates, contamination, then each reason."""
    first = F.when(F.col("duplicate"), F.array(F.lit("normalized_exact_duplicate"))).when(F.col("contaminated"), F.array(F.lit("heldout_contamination"))).otherwise(F.col("reasons"))
    return corpus.gate_rows(spark, sf_dir).select(F.explode(first).alias("reason")).groupBy("reason").agg(F.count("*").alias("docs"))


@query(f"WITH {GATE_ROWS} SELECT 'accepted' AS corpus, a.doc_id, sha256(d.text) AS h FROM a JOIN documents d ON d.doc_id = a.doc_id WHERE accepted")
def gated_publish(spark, sf_dir):
    """What is read back of two publishes: the whole corpus, which the gate refuses, and its accepted documents, which it lets through."""
    rows = staged(corpus.gate_rows(spark, sf_dir), "gate-rows")
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), None
    for name, judged in (("all", rows), ("accepted", rows.where("accepted"))):
        path = shared_folder(spark, f"published-{name}")
        decision = quality.gate_failures(quality.gate_totals(judged)).first()
        if writers.publish(docs.join(judged.select("doc_id"), "doc_id", "left_semi"), path, list(decision["failures"])):
            read = spark.read.parquet(path).select(F.lit(name).alias("corpus"), "doc_id", F.sha2("text", 256).alias("h"))
            out = out.unionByName(read) if out else read
    return out if out else docs.where("false").select(F.lit("").alias("corpus"), "doc_id", F.sha2("text", 256).alias("h"))


_FILTER = r"""p AS (SELECT doc_id, source, text AS t, len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')) AS w FROM documents),
f AS (SELECT doc_id, source, sha256(t) AS h, NOT (length(t) < 180 OR w < 30 OR length(regexp_replace(t, '[^\p{L}\p{N}\s\x1c-\x1f\x85\pZ]', '', 'g')) / length(t) < 0.65) AS good FROM p),
u AS (SELECT *, good AND doc_id <> min(doc_id) FILTER (good) OVER (PARTITION BY h) AS dup FROM f),
n AS (SELECT *, CASE WHEN good AND NOT dup THEN row_number() OVER (PARTITION BY source, good AND NOT dup ORDER BY doc_id) END AS k FROM u)"""


@query(
    f"""WITH {_FILTER} SELECT source, count(*) AS streamed, CAST(count(*) FILTER (NOT good) AS BIGINT) AS rejected, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicates, CAST(count(*) FILTER (k <= 20) AS BIGINT) AS val_accepted, CAST(count(*) FILTER (k > 20) AS BIGINT) AS train_accepted FROM n GROUP BY source"""
)
def source_filter_stats(spark, sf_dir):
    """By source: streamed, rejected, duplicates, and accepted into a validation quota of 20, then into training."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.nfc(F.col("text")), 256).alias("h"), (quality.first_reason(T.nfc(F.col("text")), F.col("source")) == "passed").alias("good"))
    d = staged(d, "filtered")
    least = d.where("good").groupBy("h").agg(F.min("doc_id").alias("first"))
    d = d.join(least, "h", "left").withColumn("dup", F.col("good") & (F.col("doc_id") != F.col("first")))
    counts = d.groupBy("source").agg(F.count("*").alias("streamed"), F.count_if(~F.col("good")).cast("long").alias("rejected"), F.count_if("dup").cast("long").alias("duplicates"), F.count_if(F.col("good") & ~F.col("dup")).cast("long").alias("kept"))
    # the quota is filled first, so only the number kept decides
    return counts.select("source", "streamed", "rejected", "duplicates", F.least("kept", F.lit(20)).cast("long").alias("val_accepted"), F.greatest(F.col("kept") - 20, F.lit(0)).cast("long").alias("train_accepted"))


@query(f"WITH t AS (SELECT lang, len({WORDS}) + 1 AS n FROM documents) SELECT lang, CAST(sum(n) AS BIGINT) AS packed_tokens, round(sum(n) / (SELECT sum(n) FROM t), 6) AS share FROM t GROUP BY lang")
def packed_language_shares(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.size(T.split_words(F.col("text"))).alias("n"))
    return accounting.packed_shares(d, "lang", "n").withColumn("share", F.round("share", 6))


def _share_sql(k: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"round(CASE WHEN len(w) < {k} THEN 0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {gram}))) / (len(w) - {k - 1}) END, 4)"


@query(f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS token_count, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 4) AS unique_token_ratio, {_share_sql(3)} AS rep_3gram, {_share_sql(4)} AS rep_4gram FROM t")
def repetition_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.split_words(F.col("text")).alias("w"))
    return d.select("doc_id", T.repetition_metrics(F.col("w")).alias("m")).select("doc_id", "m.token_count", "m.unique_token_ratio", "m.rep_3gram", "m.rep_4gram")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, count(*) OVER () * 85 // 100) THEN 'train' ELSE 'val' END AS split FROM documents")
def positional_split(spark, sf_dir):
    return sampling.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id, round(CASE WHEN s < 20 THEN 2e-5 * (s + 1) / 20 ELSE 1e-6 + 0.5 * (1 + cos(pi() * least(1, (s - 20) / 180.0))) * (2e-5 - 1e-6) END, 12) AS rate FROM (SELECT event_id, event_id % 210 AS s FROM events)")
def tuned_learning_rates(spark, sf_dir):
    """The rate at each event's step, also beyond the last one."""
    return table(spark, sf_dir, "events").select("event_id", F.round(accounting.tuned_learning_rate(F.col("event_id") % 210, 200, 20, 2e-5, 1e-6), 12).alias("rate"))


@query(
    """WITH r AS (SELECT lang, doc_id, n_chars % 10 AS score, doc_id % 2 AS tuned FROM documents), b AS (SELECT lang, avg(score) AS m FROM r WHERE tuned = 0 GROUP BY lang), t AS (SELECT lang, avg(score) AS m FROM r WHERE tuned = 1 AND lang <> 'en' GROUP BY lang)
    SELECT coalesce(b.lang, t.lang) AS lang, round(coalesce(b.m, 0), 6) AS base, round(coalesce(t.m, 0), 6) AS tuned, round(coalesce(t.m, 0) - coalesce(b.m, 0), 6) AS delta FROM b FULL JOIN t ON b.lang = t.lang"""
)
def base_against_tuned(spark, sf_dir):
    """Two runs' mean scores by language side by side; one has no English rows."""
    r = table(spark, sf_dir, "documents").select("lang", "doc_id", (F.col("n_chars") % 10).alias("score"))
    out = evaluation.compared(r.where("doc_id % 2 = 0"), r.where("doc_id % 2 = 1 and lang <> 'en'"), "lang")
    return out.select("lang", *(F.round(c, 6).alias(c) for c in ("base", "tuned", "delta")))


@query("SELECT status, count(*) AS rows FROM (SELECT CASE doc_id % 10 WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'not_object' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def jsonl_statuses(spark, sf_dir):
    """Documents written as JSON lines, some of them broken, read back with each row's status."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.to_json(F.struct("doc_id", "text"))
    broken = F.when(F.col("doc_id") % 10 == 7, F.concat(line, F.lit("}"))).when(F.col("doc_id") % 10 == 8, F.lit("[1, 2]")).otherwise(line)
    path = shared_folder(spark, "lines")
    d.select(F.explode(F.array(broken, F.lit("  "))).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "doc_id long, text string").groupBy("status").agg(F.count("*").alias("rows"))


@query("SELECT doc_id, text FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = shared_folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return readers.read_jsonl(spark, path, "doc_id long, text string").drop("status")


@query(f"SELECT DISTINCT {FOLD.format(NORM)} AS fragment FROM benchmark WHERE length({FOLD.format(NORM)}) >= 80")
def eval_fragment_file(spark, sf_dir):
    """Held-out strings nested in JSON lines."""
    b = table(spark, sf_dir, "benchmark")
    path = shared_folder(spark, "held-out")
    b.select(F.to_json(F.struct("item_id", F.array(F.struct(F.col("text").alias("q"))).alias("parts"))).alias("value")).write.text(path)
    return readers.eval_fragments(spark, path)


@query("SELECT source, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY source")
def whole_file_sample(spark, sf_dir):
    """One file a source, read whole and in the order of the names: each holds its documents' digests."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    path = shared_folder(spark, "samples")
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "h").write.partitionBy("source").option("lineSep", "\n").text(path)
    files = readers.whole_files(spark, f"{path}/*/*.txt")
    return files.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.sha2(F.regexp_replace("text", "\n", ""), 256).alias("h"))


@query(f"SELECT CAST(sum(len({WORDS})) AS BIGINT) AS tokens, CAST(sum(list_sum(list_transform({WORDS}, lambda x: length(x)))) AS BIGINT) AS total FROM documents")
def packed_round_trip(spark, sf_dir):
    """Packed tokens (here word lengths) written as uint32 files, read back and checked against their manifest."""
    from ..operators.packing import token_stream

    ids = F.transform(T.split_words(F.col("text")), F.length)
    path = shared_folder(spark, "packed")
    packed.write_packed(token_stream(table(spark, sf_dir, "documents").select("doc_id", ids.alias("tokens"))), path, 1 << 20)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return packed.read_packed(spark, path).agg(F.sum(F.size("ids")).cast("long").alias("tokens"), F.sum(total).cast("long").alias("total"))


@query(f"WITH {STREAM}, b AS (SELECT pos, token, pos // 128 AS chunk FROM s UNION ALL SELECT pos, token, pos // 128 - 1 FROM s WHERE pos % 128 = 0 AND pos > 0) SELECT CAST(chunk AS BIGINT) AS chunk, sha256(array_to_string((list(token ORDER BY pos))[:128], ',')) AS inputs, sha256(array_to_string((list(token ORDER BY pos))[2:], ',')) AS labels FROM b GROUP BY 1 HAVING count(*) = 129")
def packed_training_examples(spark, sf_dir):
    """Training examples read from packed files, over their borders: inputs and labels of every full window."""
    from ..operators.packing import token_stream

    ids = F.transform(T.split_words(F.col("text")), F.length)
    path = shared_folder(spark, "packed")
    packed.write_packed(token_stream(table(spark, sf_dir, "documents").select("doc_id", ids.alias("tokens")), eos=0), path, 1 << 20, eos=0, file_tokens=10_000)
    text = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return packed.read_packed(spark, path, seq_len=128).select(F.col("index").alias("chunk"), text("input_ids").alias("inputs"), text("labels").alias("labels"))


@query(
    """WITH f AS (SELECT source, sha256(string_agg(sha256(text) || chr(10), '' ORDER BY doc_id)) AS expected, sha256(string_agg(sha256(text || '!') || chr(10), '' ORDER BY doc_id)) AS changed FROM documents GROUP BY source)
    SELECT source, expected, CASE source WHEN 'src3' THEN changed ELSE 'missing' END AS found FROM f WHERE source IN ('src3', 'src5')"""
)
def checksum_mismatches(spark, sf_dir):
    """A file for each source, listed with its checksum; a later copy in which one file holds other text and one is missing is held against the list."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")

    def written(rows, text, what):
        path = shared_folder(spark, what)
        rows.select("source", "doc_id", F.sha2(text, 256).alias("h")).repartition("source").sortWithinPartitions("source", "doc_id").select("source", "h").write.partitionBy("source").option("lineSep", "\n").text(path)
        return staged(writers.checksums(spark, path).withColumn("path", F.regexp_extract("path", "source=([^/]+)", 1)), "checksums")

    listed = written(d, F.col("text"), "listed").select("path", "sha256")
    later = written(d.where("source <> 'src5'"), F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")), "later")
    return writers.mismatched(later, listed).select(F.col("path").alias("source"), F.col("sha256").alias("expected"), F.coalesce("found", F.lit("missing")).alias("found"))


_ENTRIES = """e AS (SELECT source AS id, count(*) / (SELECT count(*) FROM documents) AS share, source NOT IN ('src3', 'src5') AS allowed, source = 'src3' AS reasoned, source = 'src7' AS no_license, source = 'src9' AS no_commit FROM documents GROUP BY source)"""


def _catalogue(spark, sf_dir):
    """A catalogue with an entry for each source of the documents, some of them flawed, written as one JSON document and read back."""
    d = table(spark, sf_dir, "documents")
    s, total = F.col("source"), d.agg(F.count("*").alias("all"))
    rows = d.groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
    values = {
        "id": s, "dataset": F.concat(F.lit("set/"), s), "config": F.lit("default"), "split": F.lit("train"), "revision": F.when(s == "src9", "main").otherwise(F.sha1(s)), "text_column": F.lit("text"), "language": F.lit("en"), "domain": F.lit("web"),
        "target_token_share": F.col("n") / F.col("all"), "license": F.when(s == "src7", " ").otherwise("cc-by"), "license_url": F.lit("https://example.org/license"), "allowed_for_base_pretraining": ~s.isin("src3", "src5"), "blocking_reason": F.when(s == "src3", "no licence yet"),
    }
    entries = rows.select(F.struct(*(v.alias(k) for k, v in values.items())).alias("e")).agg(F.collect_list("e").alias("sources"))  # an entry a source
    header = {k: F.lit({"1": 1, "false": False}.get(v, v)).alias(k) for k, v in catalogue.HEADER.items()}
    path = shared_folder(spark, "catalogue")
    entries.select(F.to_json(F.struct(*header.values(), "sources")).alias("value")).coalesce(1).write.text(path)
    return catalogue.read_catalogue(spark, path)


@query(
    f"""WITH {_ENTRIES} SELECT id, 'blocked_without_reason' AS failure FROM e WHERE NOT allowed AND NOT reasoned UNION ALL SELECT id, 'blank:license' FROM e WHERE no_license UNION ALL SELECT id, 'revision_is_no_commit' FROM e WHERE no_commit
    UNION ALL SELECT NULL, 'blocked_sources' FROM e HAVING bool_or(NOT allowed)"""
)
def source_catalogue(spark, sf_dir):
    """What is wrong with a catalogue of the documents' sources."""
    return catalogue.failures(_catalogue(spark, sf_dir))


@query("SELECT source, count(*) AS docs FROM documents WHERE source NOT IN ('src3', 'src5') GROUP BY source")
def catalogue_admission(spark, sf_dir):
    """Documents of the sources that the catalogue allows."""
    return catalogue.admitted(table(spark, sf_dir, "documents").select("source"), _catalogue(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("docs"))
