"""Release tables laid out for their joins: bucketed by key, so that tables of one layout join without an exchange, and partitioned by what readers select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def save_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int, partition: str | None = None, path: str | None = None) -> DataFrame:
    """Writes rows as the table ``name``, dealt into buckets by a hash of keys and sorted by them; with ``partition``, in a folder for each of its values. Files lie at path, or in the shared folder.

    Rows are dealt by the same hash first, so each bucket is one file a partition. Joins and aggregations over keys of tables with as many buckets need no exchange.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    writer = rows.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).option("path", path or shared_path(spark, name))
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return spark.table(name)


def adopt(spark: SparkSession, name: str, path: str, schema: str, keys: Sequence[str], buckets: int, partition: str | None = None) -> DataFrame:
    """The table that save_bucketed wrote at path, in a session that doesn't know it yet."""
    split = f"PARTITIONED BY ({partition})" if partition else ""
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet {split} CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if partition:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
