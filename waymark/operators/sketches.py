"""Summaries that merge: stored sketches of distinct counts, quantiles and frequencies, and a cube of exact distinct counts from bitmaps.

Sketches are made once for each group of a fine grain (a day and a key, say) and stored. Any coarser group, or any range of days, comes from merging rows of that table; the rows behind it are not read
again. Theta and KLL sketches and bitmaps combine before the shuffle, so a group that has a third of all rows costs one sketch a task; count-min tables combine in tasks of so many rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Theta sketches hold 2^LG_NOMINAL hashes; the relative standard error of a count beyond that is RSE = 1 / sqrt(2^LG_NOMINAL - 1). Counts up to it are exact.
LG_NOMINAL = 12
#: KLL sketches of this k have normalised rank errors below RANK_ERROR in 99 of 100 cases.
KLL_K, RANK_ERROR = 200, 0.0165
#: Rows and cells of a count-min table: an estimate is never too low, and too high by more than 2 / CELLS of all occurrences with probability 2^-DEPTH.
DEPTH, CELLS = 5, 2048
#: Rows whose cells one task adds up: at most DEPTH cells each, so a task's memory is bounded whatever the input.
ROWS_A_TASK = 500_000


def relative_error(lg_nominal: int = LG_NOMINAL) -> float:
    """One standard error of a theta estimate."""
    return (2**lg_nominal - 1) ** -0.5


def build(rows: DataFrame, by: Sequence[str], distinct: str, value: str, lg_nominal: int = LG_NOMINAL, k: int = KLL_K) -> DataFrame:
    """(by, n, items, spread): for each group its rows, a theta sketch of the different values of ``distinct`` and a KLL sketch of ``value``. Nulls are in neither sketch; a group without values has an empty one."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.theta_sketch_agg(distinct, lg_nominal).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("spread"),
    )


def save(sketches: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds sketches to the table at path, by ``partition`` (a day, say) if given, so that ranges of it are pruned."""
    writer = sketches.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def update(spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str], distinct: str, value: str, partition: str, lg_nominal: int = LG_NOMINAL, k: int = KLL_K) -> DataFrame:
    """The table at path after it got the sketches of all partitions of rows that it lacks. What it has is neither read from rows (the filter reaches the scan) nor made again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.parquet(path).select(F.col(partition).alias("_known")).distinct()
        rows = rows.join(known, F.col(partition) == F.col("_known"), "left_anti")
    save(build(rows, by, distinct, value, lg_nominal, k), path, partition)
    return spark.read.parquet(path)


def merge(sketches: DataFrame, by: Sequence[str], lg_nominal: int = LG_NOMINAL, k: int = KLL_K) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_union_agg("items", lg_nominal).alias("items"), F.kll_merge_agg_double("spread", k).alias("spread"))


def estimates(sketches: DataFrame, by: Sequence[str], ranks: Sequence[float] = (0.5,), lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """(by, n, distinct, distinct_low, distinct_high, q<rank in percent>...): estimates, and three standard errors around the distinct count (none where it is exact)."""
    count = F.theta_sketch_estimate("items")
    off = F.when(count > 2**lg_nominal, F.lit(3 * relative_error(lg_nominal))).otherwise(F.lit(0.0))
    quantiles = [F.when(F.kll_sketch_get_n_double("spread") > 0, F.kll_sketch_get_quantile_double("spread", F.lit(float(r)))).alias(f"q{round(100 * r):02d}") for r in ranks]
    return sketches.select(*by, "n", count.alias("distinct"), F.floor(count * (1 - off)).alias("distinct_low"), F.ceil(count * (1 + off)).alias("distinct_high"), *quantiles)


def overlap_of(sketches: DataFrame, by: Sequence[str], kind: str, one: str, other: str) -> DataFrame:
    """(by, common): how many different items two kinds of rows of a group share, from their sketches alone."""
    side = lambda v: F.max_by("items", F.when(F.col(kind) == v, F.lit(1)))
    pairs = sketches.filter(F.col(kind).isin(one, other)).groupBy(*by).agg(side(one).alias("_a"), side(other).alias("_b"), F.count_distinct(kind).alias("_kinds")).filter("_kinds = 2")
    return pairs.select(*by, F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("common"))


def cell(item: str | Column, line: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(line, item), F.lit(cells)).cast("int")


def dealt(rows: DataFrame, by: Sequence[str], item: str, spread: Sequence[str] = (), a_task: int = ROWS_A_TASK) -> DataFrame:
    """(by, item): rows with an item by range of group and item, about ``a_task`` a task (rows are counted for that). Rows of one item are cut by the columns of ``spread`` (a row's key, say), if given."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // a_task))
    order = [F.col(c) for c in (*by, item)]
    if spread:
        rows, order = rows.withColumn("_spread", F.xxhash64(*spread)), [*order, F.col("_spread")]
    return rows.filter(F.col(item).isNotNull()).select(*order).repartitionByRange(tasks, *order).select(*by, item)


def count_min(rows: DataFrame, by: Sequence[str], item: str, depth: int = DEPTH, cells: int = CELLS, spread: Sequence[str] = (), a_task: int = ROWS_A_TASK) -> DataFrame:
    """(by, line, cell, n): a count-min sketch as a table of its cells that aren't 0; tables of groups merge by adding n.

    Rows are ``dealt`` out first, so a small group's cells are added up in one task before they are exchanged, and a large group is cut into runs of items.
    """
    lines = F.array(*[F.struct(F.lit(i).alias("line"), cell(item, F.lit(i), cells).alias("cell")) for i in range(depth)])
    return dealt(rows, by, item, spread, a_task).select(*by, F.inline(lines)).groupBy(*by, "line", "cell").agg(F.count("*").alias("n"))


def merge_counts(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by, "line", "cell").agg(F.sum("n").alias("n"))


def frequencies(table: DataFrame, items: DataFrame, by: Sequence[str], item: str, depth: int = DEPTH, cells: int = CELLS) -> DataFrame:
    """(by, item, estimate): how often each of items (by, item) occurs at most, the least of its cells. An item that no group has is 0."""
    lines = F.array(*[F.struct(F.lit(i).alias("line"), cell(item, F.lit(i), cells).alias("cell")) for i in range(depth)])
    asked = items.select(*by, item).distinct().select(*by, item, F.inline(lines))
    return asked.join(table, [*by, "line", "cell"], "left").groupBy(*by, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cube(rows: DataFrame, dimensions: Sequence[str], item: str, label: str = "cube") -> DataFrame:
    """(dimensions, level, n, distinct): rows and different values of ``item`` for every combination of the dimensions' values, of every subset of them.

    level has the bit of a dimension (the first one's is the highest) where it is summed over, as GROUPING_ID has it; the dimension is null then. item is a whole number; nulls count as rows only.

    Each distinct combination and range of 32,768 numbers becomes one bitmap, which is written: rows are exchanged once and never multiplied by the number of levels. Levels
    come from OR-ing bitmaps: each from the level above that has one dimension more, so that the work shrinks from level to level.
    """
    number = F.col(item).cast("long")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number))
    base = rows.groupBy(*dimensions, F.bitmap_bucket_number(number).alias("_bucket")).agg(F.count("*").alias("_n"), bits.alias("_bits"))
    levels = {tuple(dimensions): written(base, label)}
    for size in range(len(dimensions) - 1, -1, -1):
        for kept in itertools.combinations(dimensions, size):
            wider = next(tuple(d for d in dimensions if d in kept or d == more) for more in reversed(dimensions) if more not in kept)
            levels[kept] = levels[wider].groupBy(*kept, "_bucket").agg(F.sum("_n").alias("_n"), F.bitmap_or_agg("_bits").alias("_bits"))

    def counted(kept: tuple[str, ...]) -> DataFrame:
        # Rows without an item are in a bucket of null, whose bitmap is empty.
        found = levels[kept].groupBy(*kept).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0)).alias("distinct"))
        level = sum(1 << i for i, d in enumerate(reversed(dimensions)) if d not in kept)
        return found.select(*[F.col(d) if d in kept else F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dimensions], F.lit(level).cast("long").alias("level"), "n", "distinct")

    out = None
    for kept in levels:
        own = counted(kept)
        own = own.filter(F.col("n").isNotNull())  # the level without dimensions has a row even of no rows
        out = own if out is None else out.unionByName(own)
    return out
