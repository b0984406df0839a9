"""Sketches within their bounds, and the bitmap cube against sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import sketches


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def rows(spark):
    """Days of very different size; day 3 has two thirds of all rows."""
    n = 60_000
    day = F.when(F.col("id") % 3 < 2, 3).otherwise(F.col("id") % 7).cast("int")
    item = F.pmod(F.xxhash64("id"), F.lit(20_000))
    return spark.range(n).select(day.alias("day"), F.when(F.col("id") % 11 == 0, "a").otherwise("b").alias("key"), item.alias("item"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10_000)) / 10).alias("x")).cache()


@pytest.mark.parametrize("days", [[3], [0, 1, 2], [0, 1, 2, 3, 4, 5, 6], [6]])
def test_any_range_of_days_merges_within_the_bounds(spark, rows, days, tmp_path):
    path = f"file://{tmp_path}/s"
    sketches.save(sketches.build(rows, ["day", "key"], "item", "x", 10), path, "day")
    stored = spark.read.parquet(path)
    merged = sketches.merge(stored.filter(F.col("day").isin(days)), ["key"], 10)
    assert all(str(tmp_path) in f for f in merged.inputFiles())  # sketches only
    own = [r for r in rows.filter(F.col("day").isin(days)).collect()]
    for r in sketches.estimates(merged, ["key"], [0.1, 0.5, 0.9], 10).collect():
        exact, xs = {o["item"] for o in own if o["key"] == r["key"]}, sorted(o["x"] for o in own if o["key"] == r["key"])
        assert r["n"] == len(xs) and r["distinct_low"] <= len(exact) <= r["distinct_high"]
        for name, rank in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
            below, upto = sum(x < r[name] for x in xs) / len(xs), sum(x <= r[name] for x in xs) / len(xs)
            assert below - 3 * sketches.RANK_ERROR <= rank <= upto + 3 * sketches.RANK_ERROR


def test_only_new_days_are_sketched(spark, rows, tmp_path):
    path = f"file://{tmp_path}/s"
    shape = {"by": ["day", "key"], "distinct": "item", "value": "x", "partition": "day"}
    first = sketches.update(spark, path, rows.filter("day < 3"), **shape)
    assert {r["day"] for r in first.select("day").collect()} == {0, 1, 2}
    files = set(first.inputFiles())
    whole = sketches.update(spark, path, rows, **shape)
    assert files < set(whole.inputFiles())
    assert plain(whole.groupBy("day").agg(F.sum("n")).collect()) == plain(rows.groupBy("day").count().collect())


def test_what_two_groups_share(spark, rows):
    s = sketches.build(rows, ["day", "key"], "item", "x", 16)
    got = {r["day"]: r["common"] for r in sketches.overlap_of(s, ["day"], "key", "a", "b").collect()}
    own = {}
    for r in rows.collect():
        own.setdefault((r["day"], r["key"]), set()).add(r["item"])
    assert got == {d: len(own[d, "a"] & own[d, "b"]) for d in range(7)}


def test_nulls_and_no_rows(spark):
    schema = "day int, item long, x double"
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, 5, None), (None, 6, 1.5)], schema)
    got = sketches.estimates(sketches.merge(sketches.build(df, ["day"], "item", "x"), ["day"]), ["day"]).collect()
    assert plain((r["day"], r["n"], r["distinct"], r["q50"]) for r in got) == plain([(1, 2, 0, None), (2, 1, 1, None), (None, 1, 1, 1.5)])
    none = spark.createDataFrame([], schema)
    assert sketches.merge(sketches.build(none, ["day"], "item", "x"), ["day"]).collect() == sketches.count_min(none, ["day"], "item").collect() == []
    assert sketches.cube(none, ["day"], "item").collect() == []


def test_count_min_never_counts_too_little(spark, rows):
    table = sketches.merge_counts(sketches.count_min(rows, ["day"], "item", 4, 256), [])
    exact = {r["item"]: r["count"] for r in rows.groupBy("item").count().collect()}
    items = spark.createDataFrame([(i,) for i in [*list(exact)[:300], -5]], "item long")
    got = {r["item"]: r["estimate"] for r in sketches.frequencies(table, items, [], "item", 4, 256).collect()}
    assert len(got) == 301 and all(exact.get(i, 0) <= n <= exact.get(i, 0) + 6 * 60_000 / 256 for i, n in got.items())


def test_count_min_deals_rows_out_by_their_number(spark, rows):
    hot = F.when(F.col("x") < 700, F.lit(5)).otherwise(F.col("item"))  # one item has two thirds of all rows
    df = rows.withColumns({"item": F.when(F.col("x") < 990, hot), "id": F.monotonically_increasing_id()}).withColumn("day", F.when(F.col("day") != 6, F.col("day"))).cache()
    lines = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line")
    every = df.filter("item IS NOT NULL").select("day", "item", lines).withColumn("cell", sketches.cell("item", F.col("line"), 64))
    got = sketches.count_min(df, ["day"], "item", 3, 64, ["id"], 5_000)
    assert got.columns == ["day", "line", "cell", "n"]
    assert plain(got.collect()) == plain(every.groupBy("day", "line", "cell").count().collect())
    assert plain(sketches.count_min(df, ["day"], "item", 3, 64).collect()) == plain(got.collect())
    sizes = lambda d: [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes(sketches.dealt(df, ["day"], "item", ["id"], 5_000))) < 10_000
    assert len(sizes(sketches.dealt(df.unionByName(df), ["day"], "item", ["id"], 5_000))) > 20  # twice the rows, twice the tasks


def test_cube_equals_sets_and_rows_are_exchanged_once(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x"] * 5 + ["y", None]), rng.choice([1, 2, None]), rng.choice(["p", "q"]), rng.choice([None, 0, -1, -40_000, 32_768, 32_769, *range(50), 10**12])) for _ in range(800)]
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "a string, b int, c string, item long").repartition(3)
    want = {}
    for bits in itertools.product([0, 1], repeat=3):
        for r in rows:
            key = (*[None if gone else v for v, gone in zip(r, bits, strict=False)], bits[0] * 4 + bits[1] * 2 + bits[2])
            n, items = want.setdefault(key, [0, set()])
            want[key][0] += 1
            if r[3] is not None:
                items.add(r[3])
    got = sketches.cube(df, names, "item")
    assert got.columns == [*names, "level", "n", "distinct"]
    assert plain(got.collect()) == plain((*k, n, len(s)) for k, (n, s) in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and all("cube" in f for f in got.inputFiles())  # levels come from the written bitmaps
