"""Computations along a global order that no task sees whole: running sums, last values, row numbers, ranks, RANGE frames.

Rows are dealt out by range of (keys, order) and sorted, so a key with a third of all rows is cut along the order like any other run of rows. Each partition computes what it can
alone, in Arrow batches. What it lacks is what earlier partitions carry into its first key: two rows a partition say that, and they are put together afterwards. One exchange of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from ..session import written

FIRST, LAST = 1, 2


def starts(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's key differs from the row before; before: the last row of the batch before, None at a partition's beginning."""
    out = np.zeros(batch.num_rows, dtype=bool)
    out[0] = before is None
    for k in keys:
        own = batch.column(k)
        last = own.slice(0, 1) if before is None else before.column(k)
        above = pa.concat_arrays([last, own.slice(0, len(own) - 1)])
        differ = pc.fill_null(pc.not_equal(own, above), False).to_numpy(zero_copy_only=False)
        out |= differ | (own.is_null().to_numpy(zero_copy_only=False) != above.is_null().to_numpy(zero_copy_only=False))
    return out


def filled(column: pa.Array, new: np.ndarray, carried: pa.Array) -> pa.Array:
    """The last value that isn't null, from the key's beginning on; carried: that of the batch before, for the key that goes on."""
    at = np.arange(len(column))
    begin = np.maximum.accumulate(np.where(new, at, -1))
    last = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), at, -1))
    own = (last >= begin) & (last >= 0)
    take = np.where(own, last + 1, 0)
    return pa.concat_arrays([carried, column]).take(pa.array(take, mask=~own & (begin >= 0)))


def summed(column: pa.Array, new: np.ndarray, carried: float) -> np.ndarray:
    """Sums from the key's beginning on, nulls as 0; carried: that of the batch before, for the key that goes on."""
    x = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(x)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
    return total - np.where(begin >= 0, (total - x)[np.maximum(begin, 0)], 0) + np.where(begin < 0, carried, 0).astype(x.dtype)


def scanning(keys: Sequence[str], fills: Sequence[str], sums: Sequence[str], keep: str | None):
    """For mapInArrow over a sorted partition: its rows with local results, and two rows for its edges."""

    def result_schema(rows: pa.Schema) -> pa.Schema:
        added = {"_part": pa.int32(), "_edge": pa.int32(), "_open": pa.bool_()} | {f"_f_{c}": rows.field(c).type for c in fills} | {f"_s_{c}": rows.field(c).type for c in sums}
        return pa.schema([*[pa.field(f.name, f.type) for f in rows], *[pa.field(*x) for x in added.items()]])

    def edge(batch: pa.RecordBatch, row: int, kind: int, part: int, results: dict[str, pa.Array]) -> pa.RecordBatch:
        columns, schema = [], result_schema(batch.schema)
        for f in schema:
            if f.name in keys:
                columns.append(batch.column(f.name).slice(row, 1))
            elif f.name in results:
                columns.append(results[f.name].slice(row, 1) if kind == LAST else pa.nulls(1, f.type))
            else:
                columns.append({"_part": pa.array([part], pa.int32()), "_edge": pa.array([kind], pa.int32())}.get(f.name, pa.nulls(1, f.type)))
        return pa.record_batch(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last, opened = TaskContext.get().partitionId(), None, None, True
        carried_fill, carried_sum = {}, {c: 0 for c in sums}
        for batch in batches:
            n, schema = batch.num_rows, result_schema(batch.schema)
            if not n:
                continue
            new = starts(batch, keys, before)
            of_first = (np.cumsum(new) == (1 if before is None else 0)) & opened
            results = {}
            for c in fills:
                column = batch.column(c)
                results[f"_f_{c}"] = filled(column, new, carried_fill.get(c, pa.nulls(1, column.type)))
                carried_fill[c] = results[f"_f_{c}"].slice(n - 1, 1)
            for c in sums:
                total = summed(batch.column(c), new, carried_sum[c])
                results[f"_s_{c}"], carried_sum[c] = pa.array(total), total[-1].item()
            if before is None:
                yield edge(batch, 0, FIRST, part, results)
            opened = bool(of_first[-1])
            added = results | {"_part": pa.array(np.full(n, part, dtype=np.int32)), "_edge": pa.array(np.zeros(n, dtype=np.int32)), "_open": pa.array(of_first)}
            out = pa.record_batch([added[f.name] if f.name in added else batch.column(f.name) for f in schema], schema=schema)
            yield out if keep is None else out.filter(pc.fill_null(batch.column(keep), False))
            before, last = batch.slice(n - 1, 1), edge(batch, n - 1, LAST, part, results)
        if last is not None:
            yield last

    return run


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], fills: Sequence[str] = (), sums: Sequence[str] = (), keep: str | None = None) -> DataFrame:
    """rows with ``last_<c>`` for each column c of fills, the last value of the key up to the row that isn't null, and ``run_<c>`` for each of sums (long or double), the sum of the key up to the row.

    order: columns or sort orders within a key; rows equal in all of them lie in one task, so it should tell rows apart. keep: a boolean column; only rows where it is true come back. Null
    keys are a key. Names that begin with an underscore and _part, _edge, _open, _f_ and _s_ are taken.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    longs = [c for c in sums if not isinstance(kinds[c], DoubleType)]
    wide = rows.withColumns({c: F.col(c).cast("long") for c in longs}) if longs else rows
    added = [StructField("_part", IntegerType()), StructField("_edge", IntegerType()), StructField("_open", BooleanType())]
    added += [StructField(f"_f_{c}", kinds[c]) for c in fills] + [StructField(f"_s_{c}", wide.schema[c].dataType) for c in sums]
    schema = StructType([StructField(f.name, f.dataType) for f in wide.schema.fields] + added)
    dealt = wide.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    local = written(dealt.mapInArrow(scanning(by, fills, sums, keep), schema), "scan")
    edges = local.filter(F.col("_edge") > 0)
    earlier = Window.partitionBy(*by).orderBy("_part", "_edge").rowsBetween(Window.unboundedPreceding, -1)
    into = [F.last(f"_f_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in fills] + [F.sum(f"_s_{c}").over(earlier).alias(f"_on_{c}") for c in sums]
    carried = edges.select("_part", "_edge", *into).filter(F.col("_edge") == FIRST).drop("_edge")
    both = local.filter(F.col("_edge") == 0).join(F.broadcast(carried), "_part", "left")  # a row for each partition of the exchange
    whole = [F.coalesce(f"_f_{c}", F.when(F.col("_open"), F.col(f"_in_{c}"))).alias(f"last_{c}") for c in fills]
    whole += [(F.col(f"_s_{c}") + F.when(F.col("_open"), F.coalesce(f"_on_{c}", F.lit(0))).otherwise(F.lit(0))).alias(f"run_{c}") for c in sums]
    return both.select(*rows.columns, *whole)


def numbered(rows: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "number") -> DataFrame:
    """rows with their number (from 1) along the order, over all rows or within each key."""
    return scan(rows.withColumn("_one", F.lit(1).cast("long")), by, order, sums=["_one"]).withColumnRenamed("run__one", name).drop("_one")


def tie_index(rows: DataFrame, order: str, by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """(by, order, n, run_n, run_groups, run_<c>): a row for each group of ties, with what lies up to its end. Ties are added up before anything is shuffled, so a value that a third of all rows have is one row a task."""
    groups = rows.groupBy(*by, order).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).withColumn("groups", F.lit(1).cast("long"))
    return scan(groups, by, [order], sums=["n", "groups", *sums]).drop("groups", *sums)


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """right with its columns ``names`` renamed, and the conditions that they equal left's, null being equal to null."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    return renamed, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in names]


def attach(rows: DataFrame, index: DataFrame, names: Sequence[str]) -> DataFrame:
    """rows with the other columns of index, found by equal names (null equals null). Adaptive execution cuts a value that very many rows have."""
    renamed, on = same(rows, index, names)
    joined = rows.join(renamed, on, "inner") if on else rows.crossJoin(F.broadcast(renamed))  # without names index is one row
    return joined.drop(*[f"_r_{c}" for c in names])


def ranks(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with rank, dense_rank, percent_rank and cume_dist along ``order`` (nulls first), over all rows or within each key, as SQL's windows define them."""
    index = tie_index(rows, order, by)
    totals = index.groupBy(*by).agg(F.max("run_n").alias("_total"))
    full = attach(index, totals, by)
    rank, total = F.col("run_n") - F.col("n") + 1, F.col("_total")
    named = full.select(
        *by, order, rank.alias("rank"), F.col("run_groups").alias("dense_rank"),
        F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0)).alias("percent_rank"), (F.col("run_n") / total).alias("cume_dist"),
    )
    return attach(rows, named, [*by, order])


def nth_value(rows: DataFrame, value: str, n: int, order: Sequence[str], by: Sequence[str] = (), name: str = "nth_value") -> DataFrame:
    """rows with the value of the n-th row along the order (which tells rows apart): null for rows before it and in keys with fewer rows, as SQL's frame up to the current row has it."""
    placed = numbered(rows, order, by, "_number")
    at = placed.filter(F.col("_number") == n).select(*by, F.col(value).alias("_nth"))
    if not by:
        found = at.agg(F.first("_nth").alias("_nth"))  # one row at most
    else:
        found = placed.select(*by).distinct()
        renamed, on = same(found, at, by)
        found = found.join(renamed, on, "left").drop(*[f"_r_{c}" for c in by])
    return attach(placed, found, by).withColumn(name, F.when(F.col("_number") >= n, F.col("_nth"))).drop("_number", "_nth")


def range_sums(rows: DataFrame, order: str, before: Column, after: Column, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with frame_n and frame_<c>: how many rows lie in order - before .. order + after, both ends included, and the sums of their columns c (long, exact; or double).

    SQL's RANGE frame, from differences of running totals: each distinct place looks up the totals at both ends of its frame in sorted sequences, so the work doesn't grow with the
    frame's width. A null order is its own frame's only place.
    """
    from .temporal import as_of

    index = tie_index(rows, order, by, sums)
    names = ["n", *sums]
    totals = index.filter(F.col(order).isNotNull()).select(*by, F.col(order).alias("_at"), *[F.col(f"run_{c}").alias(f"_u_{c}") for c in names])
    upper = as_of(index.withColumn("_to", F.col(order) + after), totals, "_to", by, "_at", [f"_u_{c}" for c in names], null_keys=True)
    lower_totals = totals.select(*by, "_at", *[F.col(f"_u_{c}").alias(f"_l_{c}") for c in names])
    both = as_of(upper.withColumn("_from", F.col(order) - before), lower_totals, "_from", by, "_at", [f"_l_{c}" for c in names], exact=False, null_keys=True)
    # Nulls come first: they are counted in every running total, so the end of the nulls is the least lower end.
    nulls = index.filter(F.col(order).isNull()).select(*by, *[F.col(f"run_{c}").alias(f"_z_{c}") for c in names])
    renamed, on = same(both, nulls, by)
    zeroed = both.join(renamed, on, "left") if by else both.join(F.broadcast(nulls.agg(*[F.max(f"_z_{c}").alias(f"_z_{c}") for c in names])))
    frames = zeroed.select(*by, order, *[F.when(F.col(order).isNull(), F.col(f"run_{c}")).otherwise(F.col(f"_u_{c}") - F.coalesce(f"_l_{c}", f"_z_{c}", F.lit(0))).alias(f"frame_{c}") for c in names])
    return attach(rows, frames, [*by, order])
