"""Queries over streams; each equals a batch query over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.lines import appended_lines
from ..sources.stage import shared_folder
from ..streaming import streams
from . import query, table


def _docs(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    return streams.document_stream(spark, f"{sf_dir}/documents.parquet", schema)


@query("SELECT sha256(text) AS h, count(*) > 0 AS kept FROM documents GROUP BY text")
def stream_dedup(spark, sf_dir):
    """Different texts of a stream of documents, against a table of those that came before."""
    out = streams.run_deduplicated(_docs(spark, sf_dir), shared_folder(spark, "stream-dedup"), shared_folder(spark, "stream-dedup-state"))
    return out.select("h", F.lit(True).alias("kept"))


@query(r"SELECT lang, count(*) AS docs, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def stream_counts(spark, sf_dir):
    name = f"counts_{uuid.uuid4().hex}"
    return streams.run_to_table(streams.running_counts(_docs(spark, sf_dir), "lang"), "complete", name, shared_folder(spark, "stream-counts"))


@query(r"SELECT lang, count(*) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT lang, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents) GROUP BY lang")
def stream_line_counts(spark, sf_dir):
    """Lines of files in two runs, a task for each megabyte of a file; the second run counts what came after the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("\t", "lang", F.regexp_replace("text", "[\n\r]", " ")).alias("line"))
    folder, out, state = shared_folder(spark, "lines"), shared_folder(spark, "line-counts"), shared_folder(spark, "line-state")
    for part in range(2):
        d.where(F.col("doc_id") % 2 == part).select("line").write.mode("append").option("lineSep", "\n").text(folder)
        lines = appended_lines(spark, folder, piece_bytes=1 << 20)
        lines = lines.select(F.substring_index("value", "\t", 1).alias("lang"), F.expr("substring(value, length(substring_index(value, '\t', 1)) + 2)").alias("value"))
        counts = streams.run_line_counts(lines, out, state, "lang")
    return counts.select("lang", "lines", "bytes")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = streams.document_stream(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"windows_{uuid.uuid4().hex}"
    w = streams.run_to_table(streams.event_windows(e, "1 day", "365 days"), "complete", name, shared_folder(spark, "events"))
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))
