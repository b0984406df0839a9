"""Event-time operators over streams: late rows as a side output, joins of two streams within an interval, sessions.

Late rows are told apart first, against what earlier batches have seen, and kept in a table of their own; so nothing that the operators behind see is dropped without a trace. State goes as soon as the watermark
has passed what it could still meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run(stream: DataFrame, path: str) -> None:
    """Everything that is there now, into the Parquet table at path/rows; a later run goes on after it."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()


def rows_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(f"{path}/rows")


def exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def split_late(stream: DataFrame, path: str, time: str, delay: str) -> None:
    """Runs the stream over all that is there now and appends its rows to path/on_time or path/late. A row is late if it is older than the newest row of all batches before its own, less the delay.

    Each batch overwrites folders of its own number, so a batch that is repeated after a failure leaves what it would have left at first. Rows with a null time are late.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        newest = None
        if exists(spark, f"{path}/newest"):
            seen = spark.read.schema("number long, newest timestamp").option("recursiveFileLookup", "true").parquet(f"{path}/newest")
            newest = seen.filter(F.col("number") < number).agg(F.max(F.unix_micros("newest"))).first()[0]
        late = F.col(time).isNull() if newest is None else F.col(time).isNull() | (F.col(time) < F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}"))
        for side, condition in (("late", late), ("on_time", ~late)):
            held.filter(condition).write.mode("overwrite").parquet(f"{path}/{side}/batch-{number}")
        top = held.agg(F.max(F.col(time).cast("timestamp")).alias("newest")).select(F.lit(number).cast("long").alias("number"), "newest")
        top.write.mode("overwrite").parquet(f"{path}/newest/batch-{number}")
        held.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()


def side(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    """The rows of one side of ``split_late``."""
    return spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")


def side_stream(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]], left_time: str, right_time: str, within: str, delay: str) -> DataFrame:
    """Pairs of a left and a right row with equal keys, the right one at most ``within`` after the left one and not before it; for streams and batches.

    Columns of both sides must differ. delay: how much later than newer rows a row may come. A left row is forgotten once the watermark is ``within`` past it, a right row once the watermark has passed it.
    """
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    on: Column = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for x, y in by:
        on = on & (F.col(x) == F.col(y))
    return a.join(b, on)


def sessions(stream: DataFrame, by: Sequence[str], time: str, gap: str, delay: str, aggregates: Sequence[Column]) -> DataFrame:
    """(by, start, end, aggregates): runs of rows of a key with less than ``gap`` between neighbours; end is the last row's time plus the gap. A stream tells a session once the watermark has passed its end, and forgets it then."""
    grouped = stream.withWatermark(time, delay).groupBy(*by, F.session_window(time, gap).alias("_session")).agg(*aggregates)
    return grouped.select(*by, F.col("_session.start").alias("start"), F.col("_session.end").alias("end"), *[c for c in grouped.columns if c not in {*by, "_session"}])


def replay(spark: SparkSession, rows: DataFrame, arrival: str, path: str, step: Callable[[DataFrame], None]) -> None:
    """Lets rows arrive in the order of the whole numbers in ``arrival``: after each number's rows have come, step runs over the stream of all files."""
    for number in sorted(r[0] for r in rows.select(arrival).distinct().collect()):
        rows.filter(F.col(arrival) == number).drop(arrival).write.mode("append").parquet(path)
        step(spark.readStream.schema(rows.drop(arrival).schema).parquet(path))
