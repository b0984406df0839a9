"""As-of joins, joins of intervals, ranks and frames along a global order against brute force on small and odd tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import tables
from waymark.operators import ordered, reports, temporal


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def sides(seed, n=120):
    """Rows of few keys and times, so that ties abound; some keys and times are null, one key has most rows."""
    rng = random.Random(seed)
    key = lambda: rng.choice(["a"] * 12 + ["b", "c", None])
    at = lambda: rng.choice([None, *range(40)])
    return [(i, key(), at()) for i in range(n)], [(key(), at(), 1000 + i) for i in range(n // 2)]


def brute_as_of(left, right, direction, tolerance, exact):
    out = []
    for i, k, t in left:
        own = [(at, v) for key, at, v in right if key == k and None not in (k, t, at)]
        back = max((x for x in own if x[0] < t or exact and x[0] == t), default=None) if t is not None else None
        ahead = min((x for x in own if x[0] > t or exact and x[0] == t), default=None) if t is not None else None
        if tolerance is not None:
            back = back if back and t - back[0] <= tolerance else None
            ahead = ahead if ahead and ahead[0] - t <= tolerance else None
        if direction == "nearest":
            found = back if back and (not ahead or t - back[0] <= ahead[0] - t) else ahead
        else:
            found = back if direction == "backward" else ahead
        out.append((i, k, t, found and found[1]))
    return out


@pytest.mark.parametrize(("direction", "tolerance", "exact"), [*itertools.product(["backward", "forward", "nearest"], [None, 2], [True, False])])
def test_as_of(spark, direction, tolerance, exact):
    left, right = sides(hash((direction, tolerance, exact)) % 1000)
    a = spark.createDataFrame([(*r, [r[0]]) for r in left], "id long, k string, t long, more array<long>").repartition(3)
    b = spark.createDataFrame(right, "k string, at long, v long").repartition(2)
    got = temporal.as_of(a, b, "t", ["k"], "at", direction=direction, tolerance=None if tolerance is None else F.lit(tolerance), exact=exact)
    assert got.columns == ["id", "k", "t", "more", "v"]
    rows = got.collect()
    assert all(r["more"] == [r["id"]] for r in rows)
    want = brute_as_of(left, right, direction, tolerance, exact)
    assert plain(r[:3] + (r["v"],) for r in rows) == plain(want)
    inner = temporal.as_of(a, b, "t", ["k"], "at", direction=direction, tolerance=None if tolerance is None else F.lit(tolerance), exact=exact, how="inner")
    assert plain(r[:3] + (r["v"],) for r in inner.collect()) == plain(w for w in want if w[3] is not None)


def test_as_of_without_keys_or_rows(spark):
    left, right = sides(5)
    a, b = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "key string, at long, v long")
    got = temporal.as_of(a, b.drop("key"), "t", right_on="at").collect()
    assert plain(got) == plain((i, k, t, w[3]) for (i, k, t), w in zip(left, brute_as_of([(i, "x", t) for i, _, t in left], [("x", *r[1:]) for r in right], "backward", None, True), strict=True))
    none = temporal.as_of(a, b.filter("false").drop("key"), "t", right_on="at").collect()
    assert len(none) == len(left) and all(r["v"] is None for r in none)
    assert temporal.as_of(a.filter("false"), b, "t", right_on="at", columns=["v"]).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        temporal.as_of(a, a, "t")
    with pytest.raises(ValueError, match="direction"):
        temporal.as_of(a, b, "t", right_on="at", direction="sideways")


def test_a_hot_key_is_cut_by_time(spark, monkeypatch):
    held = []
    monkeypatch.setattr(ordered, "written", lambda df, label, f=ordered.written: held.append(f(df, label)) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 20_000
        a = spark.range(n).select("id", F.lit("hot").alias("k"), (F.col("id") * 3).alias("t"))
        b = spark.range(50).select(F.lit("hot").alias("k"), (F.col("id") * 7).alias("at"), F.col("id").alias("v"))  # all near the beginning: later partitions have none of their own
        got = temporal.as_of(a, b, "t", ["k"], "at")
        assert got.filter(F.col("v") != F.least(F.floor(F.col("t") / 7), F.lit(49))).count() == 0 and got.count() == n
        sizes = [r["count"] for r in held[0].filter("_edge = 0").groupBy("_part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < n / 2
        plan = a.repartitionByRange("k", "t")._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_overlaps(left, right, closed):
    extra = 1 if closed else 0
    ok = lambda s, e: s is not None and e is not None and s < e + extra
    return [(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[1] is not None and ok(*a[2:]) and ok(*b[2:]) and a[2] < b[3] + extra and b[2] < a[3] + extra]


@pytest.mark.parametrize(("closed", "hot_rows", "longest"), [(False, 1 << 16, 30), (True, 3, 30), (False, 2, 5000), (True, 1 << 16, 10**12)])
def test_overlaps(spark, closed, hot_rows, longest):
    rng = random.Random(longest + hot_rows)

    def rows(first):
        out = []
        for i in range(90):
            s = rng.randint(-200, 200)
            length = rng.choice([0, 1, 2, 3, rng.randint(0, 20), rng.randint(0, longest), -3])
            out.append((first + i, rng.choice(["a", "a", "a", "b", None]), rng.choice([s] * 9 + [None]), rng.choice([s + length] * 9 + [None])))
        return [*out, *out[:5]]

    left, right = rows(0), rows(1000)
    a, b = spark.createDataFrame(left, "i long, k string, s long, e long"), spark.createDataFrame(right, "j long, k string, x long, y long")
    got = temporal.overlap(a, b, ("s", "e"), ("x", "y"), ["k"], closed, hot_rows)
    assert got.columns == ["i", "k", "s", "e", "j", "x", "y"]
    assert plain((r["i"], r["j"]) for r in got.collect()) == plain(brute_overlaps(left, right, closed))
    free = temporal.overlap(a.drop("k"), b.drop("k"), ("s", "e"), ("x", "y"), closed=closed, hot_rows=hot_rows)
    same_key = lambda rows: [(r[0], "", *r[2:]) for r in rows]
    assert plain((r["i"], r["j"]) for r in free.collect()) == plain(brute_overlaps(same_key(left), same_key(right), closed))
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_overlaps_of_nothing(spark):
    a = spark.createDataFrame([], "i long, s long, e long")
    assert temporal.overlap(a, a.toDF("j", "x", "y"), ("s", "e"), ("x", "y")).collect() == []


@pytest.mark.parametrize("length", [1, 3, 4, 5, 64, 65, 4**20, 4**20 + 1, 2**61])
def test_levels_hold_their_lengths(spark, length):
    level = spark.range(1).select(temporal.level_of(F.lit(length)).alias("x")).first()["x"]
    assert 4**level >= length and (level == 0 or 4 ** (level - 1) < length)


def values(n=150):
    rng = random.Random(n)
    return [(i, rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, 5, 5, 5, *range(12)]), rng.randint(-50, 50)) for i in range(n)] + [(n, "lone", 3, 1)]


VALUES = "id long, k string, x long, v long"
low = lambda x: (x is not None, x or 0)  # noqa: E731  nulls first


@pytest.mark.parametrize("by", [[], ["k"]])
def test_ranks(spark, by):
    rows = values()
    got = ordered.ranks(spark.createDataFrame(rows, VALUES).repartition(3), "x", by).collect()
    want = []
    for r in rows:
        own = [low(s[2]) for s in rows if not by or s[1] == r[1]]
        before, upto = sum(x < low(r[2]) for x in own), sum(x <= low(r[2]) for x in own)
        want.append((*r, before + 1, len({x for x in own if x <= low(r[2])}), before / (len(own) - 1) if len(own) > 1 else 0.0, upto / len(own)))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_numbers_and_nth_values(spark, by):
    rows = values()
    df = spark.createDataFrame(rows, VALUES).repartition(3)
    got = ordered.nth_value(ordered.numbered(df, ["x", "id"], by), "v", 4, ["x", "id"], by).collect()
    want = []
    for r in rows:
        own = sorted((s for s in rows if not by or s[1] == r[1]), key=lambda s: (low(s[2]), s[0]))
        n = own.index(r) + 1
        want.append((*r, n, own[3][3] if n >= 4 else None))
    assert plain(got) == plain(want)


@pytest.mark.parametrize(("by", "before", "after"), [([], 2, 0), (["k"], 2, 0), (["k"], 0, 3), ([], -1, 2), (["k"], 100, 100)])
def test_range_sums(spark, by, before, after):
    rows = values()
    got = ordered.range_sums(spark.createDataFrame(rows, VALUES).repartition(3), "x", F.lit(before), F.lit(after), ["v"], by).collect()
    want = []
    for r in rows:
        own = [s for s in rows if not by or s[1] == r[1]]
        frame = [s for s in own if (s[2] is None if r[2] is None else s[2] is not None and r[2] - before <= s[2] <= r[2] + after)]
        want.append((*r, len(frame), sum(s[3] for s in frame)))
    assert plain(got) == plain(want)


def test_no_rows_have_no_order(spark):
    df = spark.createDataFrame([], VALUES)
    assert ordered.ranks(df, "x").collect() == ordered.numbered(df, ["x"]).collect() == ordered.range_sums(df, "x", F.lit(1), F.lit(1), ["v"], ["k"]).collect() == []
    assert ordered.nth_value(df, "v", 2, ["x"]).collect() == [] and ordered.range_sums(df, "x", F.lit(1), F.lit(1), ["v"]).collect() == []


def test_doubles_are_summed_along_an_order(spark):
    df = spark.createDataFrame([(i, i / 4 if i % 5 else None) for i in range(50)], "i long, x double").repartition(3)
    total, want = 0.0, []
    for i in range(50):
        total += i / 4 if i % 5 else 0
        want.append((i, i / 4 if i % 5 else None, total))
    assert plain(ordered.scan(df, [], ["i"], sums=["x"]).collect()) == plain(want)


def test_a_tied_value_fills_many_bins_and_tasks(spark):
    df = spark.range(10_000).select("id", F.lit(1.5).alias("m"), (F.col("id") % 2 == 0).alias("ok"))
    got = sorted((r["bin"], r["pairs"]) for r in reports.equal_bins(df, "id", "m", "ok").collect())
    assert got == [(i, 2000) for i in range(1, 6)]


def test_history_fold_takes_any_table(spark):
    tables.register(spark)
    rows = [(k, i, v, [i]) for k, values in {"a": "xyxxzx", "b": "yy", None: "x"}.items() for i, v in enumerate(values)] + [("a", 6, None, []), ("a", 7, None, None)]
    df = spark.createDataFrame(rows, "k string, at long, v string, more array<long>").repartition(3)
    got = spark.sql("SELECT * FROM history_fold(TABLE({df}), 'k', 'at', 'v')", df=df)
    assert got.columns == ["k", "at", "v", "more", "visits", "run", "kinds", "back"]
    want = []
    for k, at, v, more in rows:
        own = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])][: at + 1]
        run = next((i for i, x in enumerate(reversed(own)) if x != v), len(own))
        want.append((k, at, v, more, own.count(v), run, len(set(own)), len(own) > 2 and own[-3] == v != own[-2]))
    assert plain(got.collect()) == plain(want)
    for bad in ("'k', 'at', 'w'", "'k', 'at, w', 'v'"):
        with pytest.raises(Exception, match="no column w"):
            spark.sql(f"SELECT * FROM history_fold(TABLE({{df}}), {bad})", df=df).collect()
    with pytest.raises(Exception, match="already"):
        spark.sql("SELECT * FROM history_fold(TABLE({df}), 'k', 'at', 'v')", df=df.withColumn("run", F.lit(1))).collect()


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_totals_make_no_pairs(spark, closed):
    rng = random.Random(5)
    spans = lambda n, most: [(i, rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(-2, most)) for i in range(n)]
    left, right = spans(40, 9), [*spans(50, 30), (99, None, 1, 50), (98, "a", None, 5)]
    a, b = spark.createDataFrame([*left, left[0]], "i long, k string, s long, e long"), spark.createDataFrame(right, "j long, k string, t long, f long")
    valid = lambda s, e: s is not None and (s <= e if closed else s < e)
    for by in ([], ["k"]):
        want = {}
        for i, k, s, e in [*left, left[0]]:
            for _, m, t, f in right:
                if valid(s, e) and valid(t, f) and (not by or k == m) and ((t <= e and s <= f) if closed else (t < e and s < f)):
                    n, c = want.get(i, (0, 0))
                    want[i] = n + 1, c + min(e, f) - max(s, t)
        made = temporal.overlap_totals(a, b, ["i"], ("s", "e"), ("t", "f"), by, closed)
        assert {r["i"]: (r["n"], r["common"]) for r in made.collect()} == want
    # 9e8 pairs at one time: their number is told without making them.
    many = spark.range(30_000)
    hot = temporal.overlap_totals(many.selectExpr("1L AS i", "5L AS s", "9L AS e"), many.selectExpr("7L AS t", "20L AS f"), ["i"], ("s", "e"), ("t", "f"), closed=closed)
    assert [tuple(r) for r in hot.collect()] == [(1, 900_000_000, 1_800_000_000)]
