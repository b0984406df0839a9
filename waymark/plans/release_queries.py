"""Differences of nested states, and joins of bucketed release tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import nested, reports
from ..sources import layout
from . import views
from .oracles import ORACLE, view
from .register import Register

query = Register()

#: The state after an event: its shape differs by the event's type, and lists are as long as k says.
_PATHS = {
    "at.pair[0]": "CASE WHEN event_type = 'click' AND k % 3 > 0 THEN k % 2 END", "at.pair[1]": "CASE WHEN event_type = 'click' AND k % 3 > 1 THEN k % 5 END",
    "at.type": "event_type", "props.cents": "CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END", "props.k": "k", "time.secs": "secs",
}
#: A click without a pair has an empty list, which is a leaf too.
_EMPTY = "CASE WHEN event_type = 'click' AND k % 3 = 0 THEN '[]' END"
_LEAVES = sorted([*_PATHS.items(), ("at.pair", _EMPTY)])
_LAGS = ", ".join(f"""{e} IS DISTINCT FROM lag({e}) OVER w AS "{p}\"""" for p, e in _LEAVES)


@query(view(views.SQL_EVENTS, "SELECT event_id, array_to_string(list_filter([" + ", ".join(f"""CASE WHEN "{p}" THEN '{p}' END""" for p, _ in _LEAVES) + """], lambda x: x IS NOT NULL), ',') AS paths,
  NOT (""" + " OR ".join(f'"{p}"' for p, _ in _LEAVES if p != "time.secs") + f""") AS idle FROM (SELECT *, {_LAGS}, lag(event_id) OVER w AS earlier FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY secs, event_id)) WHERE earlier IS NOT NULL"""))  # fmt: skip
def nested_state_changes(spark, sf_dir):
    """What changes in a user's nested state from event to event, and whether only the clock does. States are JSON of no common schema."""
    e = views.events(spark, sf_dir)
    pair = F.slice(F.array(F.col("k") % 2, F.col("k") % 5), 1, (F.col("k") % 3).cast("int"))
    cents = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"))
    # Fields that are null aren't written.
    state = F.to_json(F.struct(
        F.struct("secs").alias("time"), F.struct("k", cents.alias("cents")).alias("props"), F.struct(F.col("event_type").alias("type"), F.when(F.col("event_type") == "click", pair).alias("pair")).alias("at"),
    ))
    w = Window.partitionBy("user_id").orderBy("secs", "event_id")
    both = e.select("event_id", "user_id", "secs", F.parse_json(state).alias("now"), state.alias("_text")).withColumn("was", F.try_parse_json(F.lag("_text").over(w)))
    found = nested.changes(both.filter(F.col("was").isNotNull()), ["event_id"], "was", "now", ["time"])
    return found.select("event_id", F.array_join("paths", ",").alias("paths"), "idle")


@query(ORACLE["paired_delta"])
def bucketed_paired_delta(spark, sf_dir):
    """The paired comparison by family, from two release tables bucketed by episode: their join needs no exchange."""
    runs, keys = views.runs(spark, sf_dir), ["episode_id", "task_family"]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables = [layout.save_bucketed(runs.filter(F.col("variant") == v).select(*keys, "success", "steps"), f"runs_{v}_{uuid.uuid4().hex}", keys, buckets) for v in ("reference", "candidate")]
    base, new = (t.select(*keys, F.col("success").alias(f"{p}_success"), F.col("steps").alias(f"{p}_steps")) for t, p in zip(tables, ("base", "new"), strict=True))
    pairs = base.join(new.hint("merge"), keys).withColumns({"success_delta": F.col("new_success").cast("long") - F.col("base_success").cast("long"), "step_delta": F.col("new_steps") - F.col("base_steps")})
    s = reports.paired_summary(pairs, by_family=True)
    return s.withColumns({c: F.round(c, 6) for c in ("success_rate_delta", "mean_step_delta", "mcnemar_p")})
