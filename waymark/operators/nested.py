"""Differences of nested states of unknown schema: variants, read level by level."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_nested(v: str | Column) -> Column:
    """Whether a variant is an object or array with something in it."""
    kind = F.schema_of_variant(v)
    return (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>")) | ((kind == "ARRAY<VOID>") & (F.to_json(v) != "[]"))


def leaves(rows: DataFrame, ids: Sequence[str], state: str) -> DataFrame:
    """(ids, path, value): every scalar, empty object and empty array of a row's variant, as JSON; paths are ``a.b[0]``, "" for a state that is a scalar itself. A null variant has no leaves.

    All rows go down one level at a time, however deep each is, until none has a level left: there are as many steps as the deepest state has levels.
    """
    spark, names = rows.sparkSession, [F.col(c) for c in ids]
    level, out = rows.select(*names, F.lit("").alias("path"), F.col(state).alias("_v")).filter(F.col("_v").isNotNull()), None
    while True:
        ends = level.filter(~is_nested("_v")).select(*ids, "path", F.to_json("_v").alias("value"))
        out = ends if out is None else out.unionByName(ends)
        deeper = level.filter(is_nested("_v"))
        if deeper.isEmpty():
            return out
        inner = deeper.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        own = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
        level = inner.select(*names, F.concat("path", own).alias("path"), F.col("value").alias("_v"))


def flat(text: str | None) -> dict[str, list[str]]:
    """Leaves by path of a state that is written as JSON, as ``leaves`` has them; numbers stay as they are written."""
    out: dict[str, list[str]] = {}
    if text is None:
        return out
    number = lambda x: ("number", x)
    todo = [("", json.loads(text, parse_int=number, parse_float=number, parse_constant=number))]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        else:
            out.setdefault(path, []).append(v[1] if isinstance(v, tuple) else json.dumps(v))
    return out


def differing():
    """A UDF of two states as JSON: the sorted paths that only one has or whose values differ. Equal texts aren't read."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, other in batches:
            out = []
            for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True):
                x, y = (flat(a), flat(b)) if a != b else ({}, {})
                out.append(sorted(p for p in x.keys() | y.keys() if sorted(x.get(p, ())) != sorted(y.get(p, ()))))
            yield pa.array(out, type=pa.list_(pa.string()))

    return of


def changes(rows: DataFrame, ids: Sequence[str], before: str, after: str, clock: Sequence[str] = ()) -> DataFrame:
    """(ids, paths, idle), a row for each row of rows: the sorted paths that only one of two states has, or whose values differ, and whether none but those of ``clock`` (or below them) do.

    Both states are in one row, so a row is compared where it lies: nothing is exchanged or joined, and no level is read again. ids tell rows apart. States are variants of any shape; null is a state without leaves.
    """
    found = rows.select(*ids, differing()(F.to_json(before), F.to_json(after)).alias("paths"))
    timed = lambda p: F.lit(False) if not clock else functools.reduce(
        lambda x, y: x | y, [(p == c) | F.startswith(p, F.lit(f"{c}.")) | F.startswith(p, F.lit(f"{c}[")) for c in clock]
    )
    return found.select(*ids, "paths", F.forall("paths", timed).alias("idle"))
