"""Structured Streaming forms of the trace operators: append sinks, duplicate suppression, long-lived state, early stops, windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Steps without a change of state after which an episode stops, and steps it may have at most.
STAGNANT, BUDGET = 6, 50
#: Actions that make a decision key together with the state.
RECENT = 8


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, event time as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Runs an append stream over all that is there into a Parquet sink with a checkpoint, and reads the sink.

    Sink and offsets lie in the shared folder: a restart goes on after the last committed batch and writes nothing twice.
    """
    spark = stream.sparkSession
    path = shared_path(spark, label)
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start(f"{path}/rows")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def distinct_observations(stream: DataFrame, keys: list[str], horizon: str = "400 days") -> DataFrame:
    """Each key once: repeats within the horizon are dropped, and their state is forgotten after it."""
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys).select(*keys)


def memory(stream: DataFrame) -> DataFrame:
    """(user_id, seen, places): a row of (1, 0) for each event, and one of (0, 1) for each observation that a user hasn't had before.

    What is remembered is one key for each (user, observation) in the state store, so no state grows in a row or is rewritten, however many observations a user has. Nothing is forgotten, as an observation counts once for ever: the
    state grows with the different (user, observation) pairs.
    """
    what = F.concat_ws("/", F.coalesce("event_type", F.lit("")), F.coalesce("props", F.lit("")))
    keyed = stream.select("user_id", what.alias("observation"))
    row = lambda df, seen, places: df.select("user_id", F.lit(seen).cast("long").alias("seen"), F.lit(places).cast("long").alias("places"))
    return row(keyed, 1, 0).unionByName(row(keyed.dropDuplicates(["user_id", "observation"]), 0, 1))


def final_memory(rows: DataFrame) -> DataFrame:
    """Every user's events and different observations over all batches' rows."""
    return rows.groupBy("user_id").agg(F.sum("seen").alias("seen"), F.sum("places").alias("places"))


def episode_stops(stream: DataFrame, stagnant: int = STAGNANT, budget: int = BUDGET, goal: str | None = None, cycle: bool = True, forget: str = "400 days") -> DataFrame:
    """(user_id, reason, steps) once an episode ends: at an event of type ``goal``, after the same event type ``stagnant`` times in a row, after
    ``budget`` events, or (unless ``cycle`` is off) by cycle: the state and the last eight actions were there before. Of several reasons the first of
    these counts.

    An event's type is the action and the state it leads to, so the last ``RECENT`` types are the decision key; the keys seen, fewer than ``budget``,
    are kept until the end. A user's events of a batch are taken in the order of time and id; after its end a user's events are ignored.

    A user whose last event is older than the newest of all by ``forget`` is forgotten, ended or not, so state follows the users of that time; later events begin anew, and events older than that are ignored.
    """
    out = "user_id long, reason string, steps long"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        steps, run, last, over, recent, seen = state.get if state.exists else (0, 0, "", False, [], [])
        recent, seen = list(recent), set(seen)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        reason = None
        for kind in rows["event_type"] if not over else ():
            steps, run = steps + 1, run + 1 if kind == last else 1
            last = kind
            recent = [*recent, kind][-RECENT:]
            decision = json.dumps(recent)
            if goal is not None and kind == goal:
                reason = "goal"
            elif run >= stagnant or steps >= budget:
                reason = "stagnation" if run >= stagnant else "budget"
            elif cycle and decision in seen:
                reason = "cycle"
            if reason:
                over, recent, seen = True, [], set()
                break
            seen.add(decision)
        state.update((steps, run, last, over, recent, sorted(seen)))
        state.setTimeoutTimestamp(max(int(rows["_ms"].max()), state.getCurrentWatermarkMs()) + 1)
        if reason:
            yield pd.DataFrame({"user_id": [key[0]], "reason": [reason], "steps": [steps]})

    kept = "steps long, run long, last string, over boolean, recent array<string>, seen array<string>"
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", forget).withColumn("_ms", F.unix_millis("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(update, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def windows(rows: DataFrame, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows; for batches and, behind a watermark, for streams. An extra beyond the trace operators."""
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")
