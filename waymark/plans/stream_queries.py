"""Late rows, joins of two streams and sessions over events that arrive out of order, each beside its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..streaming import joins
from . import views
from .oracles import view
from .register import Register

query = Register()

DELAY, EIGHT_DAYS = "2 DAYS", 8 * 86_400
ARRIVING = f"""ar AS (SELECT *, least(3, (secs - {views.EPOCH_2024}) // {EIGHT_DAYS} + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS arrival FROM ev),
nw AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ar GROUP BY arrival),
ot AS (SELECT ar.*, coalesce(ts < before - INTERVAL 2 DAYS, false) AS late FROM ar JOIN nw USING (arrival))"""


def _arriving(spark, sf_dir):
    """Events in four batches of about eight days; every thirteenth comes a batch later than its like. Times are points in time whatever the session's time zone."""
    e = views.events(spark, sf_dir)
    micros = F.col("secs") * 1_000_000 + F.expr("pmod(CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT), 1000000)")
    arrival = F.least(F.lit(3), F.floor((F.col("secs") - views.EPOCH_2024) / EIGHT_DAYS) + F.when(F.col("k") % 13 == 0, 1).otherwise(0)).cast("int")
    return e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.timestamp_micros(micros).alias("ts"), arrival.alias("arrival"))


def _split(spark, sf_dir, then=None):
    """Where the events, as they arrive, are told apart; then(path) runs after each arrival."""
    path, rows = shared_path(spark, "arrivals"), _arriving(spark, sf_dir)

    def step(stream):
        joins.split_late(stream, path, "ts", DELAY)
        if then:
            then(path)

    joins.replay(spark, rows, "arrival", f"{path}/in", step)
    return path, rows.drop("arrival")


@query(view(views.SQL_EVENTS, "SELECT event_id FROM ot WHERE late", ARRIVING))
def late_events(spark, sf_dir):
    """Events that come more than two days after newer ones: the side output."""
    path, like = _split(spark, sf_dir)
    return joins.side(spark, path, "late", like).select("event_id")


@query(view(views.SQL_EVENTS, """SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM ot a JOIN ot b ON a.user_id = b.user_id AND NOT a.late AND NOT b.late AND a.event_type = 'view' AND b.event_type = 'purchase'
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS""", ARRIVING))  # fmt: skip
def stream_interval_join(spark, sf_dir):
    """Views and the purchases of their user within six hours, as two streams whose rows come out of order."""
    sink, like = shared_path(spark, "pairs"), _arriving(spark, sf_dir).drop("arrival")

    def joined(path):
        kind = lambda k, p: joins.side_stream(spark, path, "on_time", like).filter(F.col("event_type") == k).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
        return joins.interval_join(kind("view", "view"), kind("purchase", "purchase"), [("view_user", "purchase_user")], "view_ts", "purchase_ts", "6 HOURS", DELAY).select("view_id", "purchase_id")

    path, _ = _split(spark, sf_dir, lambda path: joins.run(joined(path), sink))
    return joins.rows_of(spark, sink, joined(path))


@query(view(views.SQL_EVENTS, """SELECT user_id, count(*) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 28800000000 AS end_us FROM (
  SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 8 HOURS, true) AS opens FROM ot WHERE NOT late))
  GROUP BY user_id, session HAVING epoch_us(max(ts)) + 28800000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 172800000000 FROM ot WHERE NOT late)""", ARRIVING))  # fmt: skip
def stream_sessions(spark, sf_dir):
    """Users' sessions with less than eight hours between events, as far as the watermark has closed them."""
    sink, like = shared_path(spark, "sessions"), _arriving(spark, sf_dir).drop("arrival")

    def told(path):
        found = joins.sessions(joins.side_stream(spark, path, "on_time", like), ["user_id"], "ts", "8 HOURS", DELAY, [F.count("*").alias("events"), F.sum("cents").alias("cents")])
        return found.select("user_id", "events", "cents", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))

    path, _ = _split(spark, sf_dir, lambda path: joins.run(told(path), sink))
    return joins.rows_of(spark, sink, told(path))
