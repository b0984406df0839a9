"""Sources and sinks: JSON Lines, documents, CSV, partitioned releases, models, file inventories."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_STATES = "episode_id string, task_family string, instruction string, step_index bigint, previous_actions array<string>, observation string, admissible_actions array<string>"
CANDIDATES = "episode_id string, split string, step_index bigint, action string, success boolean, terminal boolean, cycle_detected boolean, trace_return double, previous_actions array<string>, observation string, instruction string"
PAIRS = "source string, episode_id string, step_index bigint, positive_action string, negative_action string, positive_return double, negative_return double, weight double, features map<string,double>"
RANKER = "schema_version string, feature_names array<string>, weights array<double>, max_abs_score double"
EPISODES = "episode_id string, domain string, split string, task_family string, instruction string, steps array<struct<step_index:bigint,observation:string,action:string,environment_executable:boolean,goal_progress:boolean>>, success boolean, termination_reason string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Declared schema, blank lines skipped, .gz read as it is. strict: a malformed line fails the read instead of becoming nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Compact lines, keys in schema order, nulls left out; ``by`` gives a folder for each value."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document, over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver to any store that Spark reaches."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", most: int = 1_000_000) -> bool:
    """A single file with a header, for small reports; nothing is written for no rows, and more than ``most`` are an error, as one task writes them."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a CSV report has {most} rows at most")
    if n:
        rows.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return n > 0


def scan_slice(rows: DataFrame, order: list[str], start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from ``start`` on, ``limit`` at most, in a fixed order."""
    out = rows.orderBy(*order).offset(start)
    return out if limit is None else out.limit(limit)


def report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small report as indented JSON in one file; more than ``most`` rows are an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has {most} rows at most")
    write_text(rows.sparkSession, path, json.dumps([r.asDict(recursive=True) for r in found], indent=2, ensure_ascii=False, default=str) + "\n")


def save_ranker(spark: SparkSession, path: str, weights: dict[str, float], max_abs_score: float = 2.0) -> None:
    names = sorted(weights)
    row = ("entity-residual-ranker-v1", names, [weights[n] for n in names], max_abs_score)
    spark.createDataFrame([row], RANKER).coalesce(1).write.mode("overwrite").json(path)


def load_ranker(spark: SparkSession, path: str) -> DataFrame:
    """(feature, weight) of a saved ranker."""
    pairs = F.arrays_zip(F.col("feature_names").alias("feature"), F.col("weights").alias("weight"))
    return read_jsonl(spark, path, RANKER).select(F.inline(pairs))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def lint(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, found): files whose text has the pattern, with its first match."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return texts.select(F.input_file_name().alias("path"), F.regexp_extract("value", f"({pattern})", 1).alias("found")).filter(F.col("found") != "")


SCORES = "key string, score double"


def missing_scores(keys: DataFrame, cache: DataFrame, content: str) -> DataFrame:
    """Rows whose content isn't in the cache (key: SHA-256 of the content): what a scorer still has to do. Adds key."""
    return keys.withColumn("key", F.sha2(F.col(content).cast("binary"), 256)).join(cache.select("key"), "key", "left_anti")


def cached_scores(rows: DataFrame, path: str, content: str, score: Column) -> DataFrame:
    """(content, key, score) of the distinct contents; what the cache at ``path`` lacks is scored and appended to it.

    Appends go through Spark's committer, so a lost task leaves no half of a file. Two runs at a time may both append a key: scores are a function of the content, any counts.
    """
    spark = rows.sparkSession
    distinct = rows.select(content).distinct()
    old = spark.read.schema(SCORES).json(path) if exists(spark, path) else spark.createDataFrame([], SCORES)
    missing_scores(distinct, old, content).select("key", score.cast("double").alias("score")).write.mode("append").json(path)
    known = spark.read.schema(SCORES).json(path).groupBy("key").agg(F.any_value("score").alias("score"))
    return distinct.withColumn("key", F.sha2(F.col(content).cast("binary"), 256)).join(known, "key").select(content, "key", "score")


def identity_guard(spark: SparkSession, path: str, identity: dict) -> None:
    """Resume only under identical inputs: writes the identity beside an output, or raises if another one lies there."""
    text = json.dumps(identity, sort_keys=True)
    if not exists(spark, path):
        write_text(spark, path, text + "\n")
    elif read_text(spark, path).strip() != text:
        raise ValueError("output belongs to other inputs")
