"""Nested differences against plain Python, and bucketed tables that join without an exchange."""

import json
import random

from pyspark.sql import functions as F

from waymark.operators import nested
from waymark.sources import layout


def flat(x, path=""):
    if isinstance(x, dict) and x:
        return {p: v for k, y in x.items() for p, v in flat(y, f"{path}.{k}" if path else k).items()}
    if isinstance(x, list) and x:
        return {p: v for i, y in enumerate(x) for p, v in flat(y, f"{path}[{i}]").items()}
    return {path: json.dumps(x, separators=(",", ":"))}


def state(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2, "x", "y", True, None, [], {}, 1.5])
    if rng.random() < 0.4:
        return [state(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc") + str(rng.randint(0, 1)): state(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def test_nested_changes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        a = {"clock": {"m": rng.randint(0, 3)}, "s": state(rng, 4)}
        b = {"clock": {"m": rng.randint(0, 3)}, "s": a["s"] if rng.random() < 0.3 else state(rng, 4)}
        rows.append((i, None if i % 40 == 0 else json.dumps(a), "7" if i % 41 == 0 else None if i % 43 == 0 else json.dumps(b)))
    df = spark.createDataFrame(rows, "id long, a string, b string").select("id", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = {r["id"]: r for r in nested.changes(df, ["id"], "a", "b", ["clock"]).collect()}
    assert len(got) == len(rows)
    for i, a, b in rows:
        x, y = (flat(json.loads(t)) if t is not None else {} for t in (a, b))
        paths = sorted(p for p in x.keys() | y.keys() if x.get(p) != y.get(p))
        assert got[i]["paths"] == paths and got[i]["idle"] == all(p == "clock" or p.startswith("clock.") for p in paths)


def test_no_states_have_no_changes(spark):
    df = spark.createDataFrame([], "id long, a string").select("id", F.parse_json("a").alias("a"), F.parse_json("a").alias("b"))
    assert nested.changes(df, ["id"], "a", "b").collect() == []


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).select("id", (F.col("id") % 3).alias("v"), F.when(F.col("id") % 10 == 0, "valid").otherwise("train").alias("split"))
        one = layout.save_bucketed(a, "release_one", ["id"], 4, "split", f"file://{tmp_path}/one")
        two = layout.save_bucketed(a.select("id", (F.col("v") + 1).alias("w")), "release_two", ["id"], 4, path=f"file://{tmp_path}/two")
        joined = one.join(two, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.filter(F.col("w") == F.col("v") + 1).count() == 1000
        counted = one.groupBy("id").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        pruned = one.filter("split = 'valid'")
        assert pruned.count() == 100 and "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().executedPlan().toString()
        spark.sql("DROP TABLE release_one")
        again = layout.adopt(spark, "release_again", f"file://{tmp_path}/one", "id BIGINT, v BIGINT, split STRING", ["id"], 4, "split")
        assert again.count() == 1000 and "Exchange" not in again.join(two, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("release_one", "release_two", "release_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_nested_changes_exchange_nothing(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,2.50]},"c":[]}', '{"a":{"b":[1,2.5]},"c":{}}')], "id long, a string, b string").select("id", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    found = nested.changes(df, ["id"], "a", "b")
    assert [tuple(r) for r in found.collect()] == [(1, ["c"], False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
