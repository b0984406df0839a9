"""What the operators of this package share: table access, word counting and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever sizes are counted: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text as long; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master (tests) may leave it unset and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths below the shared folder that this process made and has not deleted.
_made: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{shared_root(spark).rstrip('/')}/waymark-{label}-{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: a cut in the lineage that outlives any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def made() -> list[str]:
    """Paths below the shared folder that this process made and has not deleted."""
    return list(_made)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    name = context._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(context._jsc.hadoopConfiguration()).delete(name, True)
    if path in _made:
        _made.remove(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that materialise() wrote and that nothing will read any more."""
    delete(table.sparkSession, table.written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end all that operators wrote to the shared folder within, but for the paths in the list that it yields.

    An operator's result still reads its intermediate tables, so a result that shall outlive the block is materialised in it and its path kept.
    """
    before, kept = set(_made), []
    try:
        yield kept
    finally:
        for path in [p for p in _made if p not in before and p not in kept]:
            delete(spark, path)


#: Rows that an Arrow batch of whole texts may have; Spark's default of 10,000 holds too much where texts are long.
TEXT_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch, so that memory off the heap and in Python workers follows a thousand texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        spark.conf.set(name, TEXT_BATCH)


def partitions(spark: SparkSession, rows: int = 0, rows_each: int = 1) -> int:
    """The session's number of shuffle partitions, or as many as hold rows_each rows, where that is more: an explicit number isn't adapted at run time."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-rows // rows_each), 100_000))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, that of the default file system if it names none: what executors see may not be the driver's own disk."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` of df's rows (all, if it has no more), the same ones at every run: those whose hash of keys is in the lowest share. Costs a count."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.xxhash64(*keys) < F.lit(int(-(2**63) + rows / n * 2**64)))
