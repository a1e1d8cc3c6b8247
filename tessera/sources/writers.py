"""Sinks: published only if a gate passes, never overwritten, with manifests and checksums."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _fs(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def publish(df: DataFrame, path: str, failures: list[str], fmt: str = "parquet") -> bool:
    """Write to a staging folder and rename it; nothing is written if a gate failed, and nothing overwritten."""
    spark = df.sparkSession
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    if failures:
        return False
    staged = f"{path}.staged"
    df.write.mode("overwrite").format(fmt).save(staged)
    _, tmp = _fs(spark, staged)
    return bool(fs.rename(tmp, final))


def write_text(spark, path: str, text: str) -> None:
    """One small file, never overwritten."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def write_manifest(spark, folder: str, manifest: dict) -> str:
    """A manifest named by its own hash; an equal one is left as it is."""
    name = f"{folder}/manifest_{sha256_json(manifest)[:16]}.json"
    fs, p = _fs(spark, name)
    if not fs.exists(p):
        write_text(spark, name, canonical_json(manifest))
    return name


def write_shards(docs: DataFrame, path: str, max_bytes: int, group: str, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Greedy content-addressed shards as a table partitioned by shard id; equal shards are one."""
    from ..operators.packing import greedy_shards

    shards = greedy_shards(docs, max_bytes, group, order, text)
    shards.select("digest", "n_docs", "n_bytes").dropDuplicates(["digest"]).write.mode("errorifexists").parquet(path)
    return shards


def checksums(spark, path: str) -> DataFrame:
    """sha256 and path of each file under a folder, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", "length")


def mismatched(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected checksums (path, sha256) whose file is missing or differs."""
    found = actual.select("path", F.col("sha256").alias("found"))
    return expected.join(found, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def replace_text(spark, path: str, text: str) -> None:
    """One small file, put in place of an older one by an atomic rename."""
    jvm = spark.sparkContext._jvm
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, tmp, text)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    p = jvm.org.apache.hadoop.fs.Path
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p(tmp), p(path), how)


def markdown_table(columns: list[str], rows: list) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *([cell(v) for v in r] for r in rows)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_report(df: DataFrame, path: str, title: str, most: int = 10_000) -> tuple[str, str]:
    """A small result as ``path``.json and ``path``.md; more than ``most`` rows are no report and raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    spark = df.sparkSession
    replace_text(spark, f"{path}.json", json.dumps({"title": title, "rows": [r.asDict(True) for r in rows]}, ensure_ascii=False, default=str))
    replace_text(spark, f"{path}.md", f"# {title}\n\n{markdown_table(df.columns, rows)}")
    return f"{path}.json", f"{path}.md"


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines beside those that are there, as a log of events grows."""
    df.write.mode("append").json(path)
