"""Streams whose rows arrive out of order: late rows, joins, sessions, forgotten state."""

import datetime

from pyspark.sql import functions as F

from waymark.streaming import joins, traces

SCHEMA = "id long, user string, kind string, minute long, arrival int"
DAY0 = datetime.datetime(2024, 1, 1)


def arriving(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("id", "user", "kind", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60).alias("ts"), "arrival")


ROWS = [
    (1, "a", "v", 0, 0), (2, "a", "p", 10, 0), (3, "b", "v", 100, 0), (4, "a", "v", 200, 0),
    (5, "a", "p", 195, 1), (6, "a", "p", 150, 1), (7, "b", "p", 130, 1), (8, "b", "v", 400, 1), (9, "c", "v", None, 1),
    (10, "b", "p", 455, 2), (11, "a", "p", 399, 2), (12, "b", "v", 330, 2), (13, "a", "v", 1000, 2),
    (14, "b", "p", 10, 3), (15, "a", "p", 1001, 3),
]


def late_ids(rows, delay):
    late, newest = set(), None
    for number in sorted({r[4] for r in rows}):
        own = [r for r in rows if r[4] == number]
        late |= {r[0] for r in own if r[3] is None or newest is not None and r[3] < newest - delay}
        newest = max([r[3] for r in own if r[3] is not None] + ([newest] if newest is not None else []))
    return late


def test_late_rows_stay_apart(spark, tmp_path):
    path, rows = f"file://{tmp_path}/s", arriving(spark, ROWS)
    joins.replay(spark, rows, "arrival", f"{path}/in", lambda s: joins.split_late(s, path, "ts", "60 MINUTES"))
    like = rows.drop("arrival")
    late = {r["id"] for r in joins.side(spark, path, "late", like).collect()}
    assert late == late_ids(ROWS, 60) and late and {r["id"] for r in joins.side(spark, path, "on_time", like).collect()} == {r[0] for r in ROWS} - late


def test_streams_join_within_an_interval_over_batches(spark, tmp_path):
    path, sink, rows = f"file://{tmp_path}/s", f"file://{tmp_path}/pairs", arriving(spark, ROWS)
    like = rows.drop("arrival")

    def pairs():
        side = lambda kind: joins.side_stream(spark, path, "on_time", like).filter(F.col("kind") == kind).select(*[F.col(c).alias(f"{kind}_{c}") for c in ("id", "user", "ts")])
        return joins.interval_join(side("v"), side("p"), [("v_user", "p_user")], "v_ts", "p_ts", "60 MINUTES", "60 MINUTES").select("v_id", "p_id")

    def step(stream):
        joins.split_late(stream, path, "ts", "60 MINUTES")
        joins.run(pairs(), sink)

    joins.replay(spark, rows, "arrival", f"{path}/in", step)
    late = late_ids(ROWS, 60)
    on_time = [r for r in ROWS if r[0] not in late]
    want = sorted((v[0], p[0]) for v in on_time for p in on_time if v[2] == "v" and p[2] == "p" and v[1] == p[1] and 0 <= p[3] - v[3] <= 60)
    assert sorted(map(tuple, joins.rows_of(spark, sink, pairs()).collect())) == want and (8, 10) in want and (13, 15) in want


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    path, sink, rows = f"file://{tmp_path}/in", f"file://{tmp_path}/out", arriving(spark, [(1, "a", "x", 0, 0), (2, "a", "x", 20, 0), (3, "a", "x", 45, 1), (4, "b", "x", 50, 1), (5, "a", "x", 200, 2), (6, "b", "x", 400, 3)])
    told = lambda s: joins.sessions(s, ["user"], "ts", "30 MINUTES", "10 MINUTES", [F.count("*").alias("n")])
    joins.replay(spark, rows, "arrival", path, lambda s: joins.run(told(s), sink))
    got = {(r["user"], (r["start"] - DAY0).seconds // 60, (r["end"] - DAY0).seconds // 60, r["n"]) for r in joins.rows_of(spark, sink, told(spark.readStream.schema(rows.drop("arrival").schema).parquet(path))).collect()}
    assert got == {("a", 0, 75, 3), ("b", 50, 80, 1), ("a", 200, 230, 1)}  # the last one is still open


def stops(spark, tmp_path, forget):
    rows = [(i, 1, "click", i, 0) for i in range(6)] + [(50, 2, "view", 20 * 1440, 1), (51, 2, "click", 21 * 1440, 2)] + [(60 + i, 1, "click", 22 * 1440 + i, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, minute long, arrival int")
    df = df.select("event_id", "user_id", "event_type", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minute") * 60).alias("ts"), "arrival")
    path = f"file://{tmp_path}/{forget.replace(' ', '')}"
    ended = lambda s: traces.episode_stops(s, forget=forget)
    joins.replay(spark, df, "arrival", f"{path}/in", lambda s: joins.run(ended(s), f"{path}/out"))
    found = joins.rows_of(spark, f"{path}/out", ended(spark.readStream.schema(df.drop("arrival").schema).parquet(f"{path}/in")))
    return sorted(map(tuple, found.collect()))


def test_ended_users_are_forgotten_after_a_time(spark, tmp_path):
    assert stops(spark, tmp_path, "400 days") == [(1, "stagnation", 6)]
    assert stops(spark, tmp_path, "5 days") == [(1, "stagnation", 6), (1, "stagnation", 6)]
