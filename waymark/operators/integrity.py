"""Checks over tables: duplicates, forbidden columns, prefixes, inventories, overlaps, pending work. Each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORBIDDEN = ("expert_action", "expert_rank")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def require_absent(rows: DataFrame, columns: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """rows itself; raises if a forbidden column is there."""
    if found := sorted(set(columns) & set(rows.columns)):
        raise ValueError(f"forbidden columns: {found}")
    return rows


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose column is null or not allowed."""
    return rows.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def context_changes(done: DataFrame, states: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Resumed rows whose state is unknown or whose context columns differ from it. Adds problem."""
    source = states.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("known"))
    on = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    joined = done.join(source, on, "left").withColumn("problem", F.when(F.col("known").isNull(), "unknown state").when(~same, "changed context"))
    return joined.filter(F.col("problem").isNotNull()).select(*done.columns, "problem")


def prefix_errors(done: DataFrame, tasks: DataFrame) -> DataFrame:
    """Places at which done (place, id) isn't the beginning of tasks (place, id)."""
    d, t = done.select("place", F.col("id").alias("done_id")), tasks.select("place", F.col("id").alias("task_id"))
    return d.join(t, "place", "left").filter(~F.col("done_id").eqNullSafe(F.col("task_id")))


def inventory_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state): missing, extra or changed between two inventories."""
    o = old.select(key, F.struct(*columns).alias("o"))
    n = new.select(key, F.struct(*columns).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "extra").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, key, "full_outer").select(key, state.alias("state")).filter(F.col("state").isNotNull())


def overlaps(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that lie in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits")).filter(F.col("splits") > 1)


def pending(states: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """States without a finished row."""
    return states.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def nested(smaller: DataFrame, larger: DataFrame, keys: list[str]) -> bool:
    return smaller.join(larger, keys, "left_anti").isEmpty()


def differing(computed: DataFrame, recorded: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose computed and recorded values differ by more than the tolerance, or that only one side has."""
    c, r = computed.select(*keys, F.col(value).alias("computed")), recorded.select(*keys, F.col(value).alias("recorded"))
    far = F.col("computed").isNull() | F.col("recorded").isNull() | (F.abs(F.col("computed") - F.col("recorded")) > tolerance)
    return c.join(r, keys, "full_outer").filter(far)


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only the first or only the second table has; none if the key sets are identical."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second")
    return x.join(y, keys, "full_outer").withColumn("side", side).filter(F.col("side").isNotNull()).select(*keys, "side")


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str], rows_at_most: int = 100_000) -> DataFrame:
    """rows with the columns of the table's row for their key (rows column to table column); rows without one keep nulls. A small table, by its count, is broadcast."""
    small = F.broadcast(table) if table.count() <= rows_at_most else table
    condition = [rows[a] == small[b] for a, b in on.items()]
    return rows.join(small, condition, "left").drop(*[small[b] for a, b in on.items() if a == b])


def having_key(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the set."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def list_differences(a: DataFrame, b: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """(place, problem): places of an ordered list that the other lacks, or where it has something else."""
    x, y = a.select(place, F.struct(*columns).alias("_x")), b.select(place, F.struct(*columns).alias("_y"))
    problem = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "extra").when(F.col("_x") != F.col("_y"), "other")
    return x.join(y, place, "full_outer").select(place, problem.alias("problem")).filter(F.col("problem").isNotNull())


def prefix_gaps(done: DataFrame, tasks: DataFrame, group: str, place: str) -> DataFrame:
    """(group, place): tasks before a group's last finished one that aren't finished; with none, and no prefix_errors, done is a prefix."""
    last = done.groupBy(group).agg(F.max(place).alias("_last"))
    return tasks.join(last, group).filter(F.col(place) < F.col("_last")).join(done, [group, place], "left_anti").select(group, place)


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(first_only, second_only): how many different rows only one of two sets has."""
    one = a.distinct().withColumn("_in", F.lit(1)).unionByName(b.distinct().withColumn("_in", F.lit(2)))
    sides = one.groupBy(*a.columns).agg(F.sum("_in").alias("_in"))
    return sides.agg(F.count_if(F.col("_in") == 1).alias("first_only"), F.count_if(F.col("_in") == 2).alias("second_only"))


def changed_paths(before: str, after: str) -> Column:
    """Sorted paths at which two flattened states (maps from path to text) differ."""
    both = F.map_zip_with(F.col(before), F.col(after), lambda _, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda _, differs: differs)))


def same_but(before: Column, after: Column, *fields: str) -> Column:
    """Whether two structs agree, some fields aside."""
    return before.dropFields(*fields).eqNullSafe(after.dropFields(*fields))
