"""As-of joins, joins of intervals, RANGE frames and ranks along a global order, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import ordered, temporal
from . import views
from .oracles import view
from .register import Register

query = Register()

#: What each event of a kind is matched with: the views of its user, of several at one time the one of the largest id.
VIEWS = "v AS (SELECT user_id, ts AS at, max(event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)"


def _kind(spark, sf_dir, kind):
    return views.table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def _views(spark, sf_dir):
    return _kind(spark, sf_dir, "view").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))


def _purchases(spark, sf_dir):
    return _kind(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")


@query(f"WITH {VIEWS} SELECT p.event_id, v.view_id, v.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.at")
def asof_backward(spark, sf_dir):
    """Each purchase with its user's last view until then."""
    return temporal.as_of(_purchases(spark, sf_dir), _views(spark, sf_dir), "ts", ["user_id"], "at").select("event_id", "view_id", "view_value")


@query(f"WITH {VIEWS} SELECT p.event_id, v.view_id, v.view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN v ON p.user_id = v.user_id AND p.ts < v.at")
def asof_forward(spark, sf_dir):
    """Each purchase with its user's first view after it; purchases without one have no row."""
    return temporal.as_of(_purchases(spark, sf_dir), _views(spark, sf_dir), "ts", ["user_id"], "at", direction="forward", exact=False, how="inner").select("event_id", "view_id", "view_value")


@query(f"""WITH {VIEWS} SELECT p.event_id, CASE WHEN p.ts - v.at <= INTERVAL 6 HOURS THEN v.view_id END AS view_id
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.at""")  # fmt: skip
def asof_within_six_hours(spark, sf_dir):
    found = temporal.as_of(_purchases(spark, sf_dir), _views(spark, sf_dir), "ts", ["user_id"], "at", ["view_id"], tolerance=F.expr("INTERVAL '6' HOUR"))
    return found.select("event_id", "view_id")


@query(f"""WITH {VIEWS}, p AS (SELECT * FROM events WHERE event_type = 'purchase'),
b AS (SELECT p.event_id, p.ts, v.view_id, v.at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.at),
f AS (SELECT p.event_id, v.view_id, v.at FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.at)
SELECT event_id, CASE WHEN f.at IS NULL OR b.ts - b.at <= f.at - b.ts THEN b.view_id ELSE f.view_id END AS view_id FROM b JOIN f USING (event_id)""")  # fmt: skip
def asof_nearest(spark, sf_dir):
    return temporal.as_of(_purchases(spark, sf_dir), _views(spark, sf_dir), "ts", ["user_id"], "at", ["view_id"], "nearest").select("event_id", "view_id")


@query("""WITH o AS (SELECT o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, last_order FROM lineitem ASOF LEFT JOIN o ON l_shipdate > o_orderdate""")  # fmt: skip
def asof_without_keys(spark, sf_dir):
    """Each line with the last order of any customer on a day before it was shipped."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = views.table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderkey").alias("last_order"))
    return temporal.as_of(lines, orders, "l_shipdate", [], "o_orderdate", exact=False).select("l_orderkey", "l_linenumber", "last_order")


SPANS = """sp AS (SELECT event_id, user_id, event_type, secs AS s, secs + CASE WHEN k % 11 = 0 THEN 200000 WHEN k % 3 = 0 THEN 0 ELSE k * 120 END AS e FROM ev)"""


def _spans(spark, sf_dir, kind, prefix):
    e = views.events(spark, sf_dir).filter(F.col("event_type") == kind)
    length = F.when(F.col("k") % 11 == 0, 200_000).when(F.col("k") % 3 == 0, 0).otherwise(F.col("k") * 120)
    return e.select(F.col("event_id").alias(f"{prefix}_id"), "user_id", F.col("secs").alias(f"{prefix}_s"), (F.col("secs") + length).alias(f"{prefix}_e"))


@query(view(views.SQL_EVENTS, """SELECT a.event_id AS click_id, b.event_id AS view_id FROM sp a JOIN sp b
  ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""", SPANS))  # fmt: skip
def interval_overlaps(spark, sf_dir):
    """Pairs of a click's and a view's intervals, of one user, that overlap; some are empty, some last for days."""
    a, b = _spans(spark, sf_dir, "click", "click"), _spans(spark, sf_dir, "view", "view")
    return temporal.overlap(a, b, ("click_s", "click_e"), ("view_s", "view_e"), ["user_id"]).select("click_id", "view_id")


@query(view(views.SQL_EVENTS, """SELECT a.event_id AS error_id, count(*) AS signups, CAST(sum(least(a.s + 600, b.e) - greatest(a.s, b.s)) AS BIGINT) AS seconds FROM sp a JOIN sp b
  ON a.event_type = 'error' AND b.event_type = 'signup' AND a.s <= b.e AND b.s <= a.s + 600 GROUP BY 1""", SPANS))  # fmt: skip
def interval_overlaps_of_all(spark, sf_dir):
    """For each error the signups, of any user, whose closed intervals touch its ten minutes, and for how long."""
    a = _spans(spark, sf_dir, "error", "error").select("error_id", "error_s", (F.col("error_s") + 600).alias("error_e"))
    b = _spans(spark, sf_dir, "signup", "signup").select("signup_id", "signup_s", "signup_e")
    return temporal.overlap_totals(a, b, ["error_id"], ("error_s", "error_e"), ("signup_s", "signup_e"), closed=True, names=("signups", "seconds"))


RANKED = "rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 12) AS percent_rank, round(cume_dist() OVER w, 12) AS cume_dist"


def _ranks():
    return ("rank", "dense_rank", F.round("percent_rank", 12).alias("percent_rank"), F.round("cume_dist", 12).alias("cume_dist"))


@query(f"SELECT l_orderkey, l_linenumber, {RANKED} FROM lineitem WINDOW w AS (ORDER BY l_quantity)")
def distribution_ranks(spark, sf_dir):
    """Ranks of all lines by quantity: fifty values, each with very many ties."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ordered.ranks(lines, "l_quantity").select("l_orderkey", "l_linenumber", *_ranks())


@query(f"SELECT event_id, {RANKED} FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)")
def distribution_ranks_by_type(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ordered.ranks(events, "value", ["event_type"]).select("event_id", *_ranks())


@query("""SELECT event_id, row_number() OVER w AS number, nth_value(event_id, 7) OVER w AS seventh, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS third_of_user
  FROM events WINDOW w AS (ORDER BY ts, event_id)""")  # fmt: skip
def nth_values(spark, sf_dir):
    """The number of each event along time, the seventh event of all, and the third of its user, once they are there."""
    events = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    own = ordered.nth_value(events, "event_id", 3, ["ts", "event_id"], ["user_id"], "third_of_user")
    whole = ordered.nth_value(own, "event_id", 7, ["ts", "event_id"], name="seventh")
    return ordered.numbered(whole, ["ts", "event_id"]).select("event_id", "number", "seventh", "third_of_user")


@query("""SELECT event_id, count(*) OVER w AS frame_n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS frame_cents FROM events
  WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")  # fmt: skip
def range_frame_sums(spark, sf_dir):
    """Events and their cents in the six hours up to each event, over all users."""
    events = views.table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return ordered.range_sums(events, "ts", F.expr("INTERVAL '6' HOUR"), F.expr("INTERVAL '0' HOUR"), ["cents"]).select("event_id", "frame_n", "frame_cents")


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER w AS frame_n, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS frame_quantity FROM lineitem
  WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 10 DAYS FOLLOWING)""")  # fmt: skip
def range_frame_sums_by_flag(spark, sf_dir):
    """Six hot keys: each line with its like shipped from 30 days before to 10 days after it."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", F.col("l_quantity").cast("long").alias("quantity"))
    found = ordered.range_sums(lines, "l_shipdate", F.expr("INTERVAL '30' DAY"), F.expr("INTERVAL '10' DAY"), ["quantity"], ["l_returnflag", "l_linestatus"])
    return found.select("l_orderkey", "l_linenumber", "frame_n", "frame_quantity")


@query("""SELECT event_id, visits, run, kinds, back FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS visits, row_number() OVER (PARTITION BY user_id, event_type, stretch ORDER BY ts, event_id) AS run,
    count(*) FILTER (first) OVER w AS kinds, coalesce(lag(event_type, 2) OVER w = event_type AND lag(event_type) OVER w <> event_type, false) AS back
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS stretch FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")  # fmt: skip
def history_fold_in_sql(spark, sf_dir):
    """A fold over each user's events, called from SQL as a table function."""
    tables.register(spark)
    events = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return spark.sql("SELECT event_id, visits, run, kinds, back FROM history_fold(TABLE({events}), 'user_id', 'ts, event_id', 'event_type')", events=events)
