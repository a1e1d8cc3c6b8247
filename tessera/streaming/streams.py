"""Incremental forms of the batch operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.packing import greedy_shards
from ..sources import writers
from ..sources.stage import delete, staged


def document_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, or of the folder of one file by that file's name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hpath).isFile():
        return reader.option("pathGlobFilter", hpath.getName()).parquet(str(hpath.getParent().toString()))
    return reader.parquet(path)


def first_seen(stream: DataFrame, text_col: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose content hash has not arrived before; with a watermark, within it.

    Without one the state holds every hash ever seen; a stream without end
    should name an event-time column and a delay.
    """
    df = stream.withColumn("h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    if watermark:
        return df.withWatermark(*watermark).dropDuplicatesWithinWatermark(["h"])
    return df.dropDuplicates(["h"])


def run_deduplicated(stream: DataFrame, path: str, checkpoint: str, order: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """Rows whose content has not arrived before, over a stream without end; of equal ones in a batch the least ``order``.

    Instead of state that grows in memory, digests lie in a table by batch and
    hash bucket; a batch is held against the buckets that it touches, of earlier
    batches alone, and writes its rows and new digests under its own number. So a
    repeated batch, whole or half written, gives the same again. Null texts are equal
    to empty ones.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        h = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
        marked = rows.withColumn("h", h).withColumn("__place", F.struct(F.col(order), F.monotonically_increasing_id()))
        marked = staged(marked.withColumn("__bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")), "arrived")
        first = marked.groupBy("h").agg(F.min("__place").alias("__first"), F.first("__bucket").alias("__own"))
        fs, seen = writers._fs(spark, f"{path}/seen")
        if fs.exists(seen):
            touched = [r[0] for r in marked.select("__bucket").distinct().collect()]  # ``buckets`` numbers at most
            known = spark.read.schema("h string, batch long, bucket int").parquet(f"{path}/seen").where(F.col("bucket").isin(touched) & (F.col("batch") < batch))
            first = first.join(known.select("h"), "h", "left_anti")
        first = staged(first, "first")
        fresh = marked.join(first, (marked["h"] == first["h"]) & (marked["__place"] == first["__first"])).select(*(marked[c] for c in marked.columns if not c.startswith("__")))
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        first.select("h", F.col("__own").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/seen/batch={batch}")
        for table in (marked, first):
            for f in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
                delete(spark, f)

    return _run_batches(stream, keep, checkpoint).sparkSession.read.parquet(f"{path}/rows").drop("batch")


def running_counts(stream: DataFrame, group: str, text_col: str = "text") -> DataFrame:
    """Documents, words and bytes per group; restarts go on from the checkpoint."""
    sizes = stream.select(group, F.size(T.split_words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("w"), F.octet_length(text_col).cast("long").alias("b"))
    return sizes.groupBy(group).agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("b").alias("bytes"))


def run_line_counts(lines: DataFrame, path: str, checkpoint: str, group: str) -> DataFrame:
    """group, lines, words, bytes of a stream of lines (``appended_lines``), counted once each over restarts and in the middle of files.

    Each micro-batch writes its own counts under its number, so a repeated one
    overwrites itself; the sum over batches is read back.
    """

    def count(rows: DataFrame, batch: int) -> None:
        words = F.size(T.split_words(F.col("value"))).cast("long")
        rows.groupBy(group).agg(F.count("*").alias("lines"), F.sum(words).alias("words"), F.sum(F.octet_length("value").cast("long")).alias("bytes")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    done = _run_batches(lines, count, checkpoint).sparkSession.read.parquet(path)
    return done.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("lines", "words", "bytes")))


def event_windows(events: DataFrame, width: str, late: str, ts: str = "ts") -> DataFrame:
    """Counts and sums per event type and tumbling window (an extension)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(df: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Run over what is there (availableNow) into a table in memory; for bounded results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what is there to Parquet files, exactly once over restarts."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(path)


def run_to_shards(stream: DataFrame, path: str, checkpoint: str, max_bytes: int, group: str, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Each micro-batch cut into greedy shards of at most ``max_bytes`` and written under its batch's number.

    A repeated batch overwrites its own folder, so shards are written exactly
    once; the last shard of a batch may be short, as nothing is kept open
    between batches.
    """

    def flush(docs: DataFrame, batch: int) -> None:
        greedy_shards(docs, max_bytes, group, order, text).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _run_batches(stream, flush, checkpoint).sparkSession.read.parquet(path)


def run_to_snapshot(stream: DataFrame, path: str, checkpoint: str, run: str = "run_id", step: str = "step") -> dict:
    """The newest row of every run, in one JSON file that is replaced at once after each micro-batch; runs must be few."""

    def upsert(rows: DataFrame, batch: int) -> None:
        newest = rows.groupBy(run).agg(F.max_by(F.struct(*rows.columns), step).alias("row")).select("row.*")
        for r in newest.toLocalIterator():
            if r[run] not in seen or seen[r[run]][step] <= r[step]:
                seen[r[run]] = r.asDict(True)
        writers.replace_text(rows.sparkSession, path, writers.canonical_json(list(seen.values())))

    spark = stream.sparkSession
    fs, p = writers._fs(spark, path)
    old = json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else []
    seen = {r[run]: r for r in old}
    _run_batches(stream, upsert, checkpoint)
    return seen


def _run_batches(stream: DataFrame, each, checkpoint: str) -> DataFrame:
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream
