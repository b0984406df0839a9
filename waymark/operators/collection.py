"""Collecting feedback: outcomes of recorded rollouts, attempts with a retry and a table of failures, the collection's prior, what observations showed."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from . import progress

# Points of the collection's prior by factor. It never emits the two factors that the basis doesn't either.
POINTS = {
    "goal_token_exact": 2.0, "goal_token_partial": 1.25, "observation_token": 0.15, "take_schema": 0.15, "introspection_schema": -0.5, "revisit_unit": -2.0, "entity_match": 6.0,
    "entity_mismatch": -6.0, "entity_mention": 2.0, "visible_target_take": 5.0, "visible_target_navigation": -0.75, "delivery_action": 6.0, "delivery_navigation_ready": 3.0,
    "delivery_navigation_unready": -0.5, "delivery_reference": 0.5, "treatment_navigation_held": 5.0, "treatment_navigation_unheld": 1.0, "premature_delivery": -12.0, "light_repeat": -8.0,
    "light_first_use": 6.0, "light_examine": 5.0, "light_examine_ready": 8.0, "light_navigation": 10.0, "light_premature_move": -8.0, "multi_object_delivery": 4.0,
    "multi_object_acquisition": 2.0, "recent_repeat": -2.5, "inverse_transition": -3.0,
}

#: Longest run of actions whose repetition makes a cycle.
CYCLE = 6


def prior(annotated: DataFrame) -> DataFrame:
    """(episode_id, step, prior): points of an action when candidates are collected; -1 for an action without words."""
    total = sum((v * F.lit(POINTS[k]) for k, v in progress.factor_values().items()), F.lit(0.0))
    return progress.prepared(annotated).select("episode_id", "step", F.when(F.size("x_words") == 0, -1.0).otherwise(total).alias("prior"))


def rollouts(trace: DataFrame, rollout: list[str], predicates: list[str], max_steps: int = 50, repeats: int = 2) -> DataFrame:
    """(rollout, steps, no_progress_fraction, cycle_detected, budget_pressure) from recorded traces.

    trace: rollout keys, position (0 is the state before the candidate), step (in the episode), action (that led here; any at 0), observation and predicates. A step makes no progress
    if no predicate changes; a cycle is a state (observation and predicates) that was there before, or actions that end in a repeated run of at most CYCLE actions, at any step however
    late. A step sees the last CYCLE x repeats actions only, which is all that such an end can hold.
    """
    order = Window.partitionBy(*rollout).orderBy("position")
    same = F.lit(True)
    for c in predicates:
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    again = F.row_number().over(Window.partitionBy(*rollout, "observation", *predicates).orderBy("position")) > 1
    own = F.when(F.col("position") > 0, F.col("action"))
    recent = F.transform(F.collect_list(own).over(order.rowsBetween(1 - CYCLE * repeats, Window.currentRow)), lambda a: T.normalize(a))
    marked = trace.withColumns({"still": same & (F.col("position") > 0), "again": again, "run": N.has_cycle(recent, CYCLE, repeats)})
    n = F.max("position")
    return marked.groupBy(*rollout).agg(
        n.alias("steps"), (F.count_if("still") / F.greatest(n, F.lit(1))).alias("no_progress_fraction"), F.bool_or(F.col("again") | F.col("run")).alias("cycle_detected"),
        F.least(F.max("step") / F.lit(max_steps), F.lit(1.0)).alias("budget_pressure"),
    )


def called(work: Callable[[dict, int], float], row: dict, attempt: int, timeout: float) -> float:
    """work(row, attempt) in a thread of its own, which is left behind if it doesn't answer in time: it holds up neither other calls nor the worker's end."""
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            answer.put((float(work(row, attempt)), None))
        except Exception as e:
            answer.put((None, e))

    threading.Thread(target=call, daemon=True).start()
    try:
        result, error = answer.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"no answer within {timeout:g} s") from None
    if error is not None:
        raise error
    return result


def attempts(rows: DataFrame, work: Callable[[dict, int], float], timeout: float = 60.0, tries: int = 2) -> DataFrame:
    """rows with result (double), tries (how many were made) and errors (texts): work(row, try) again after an error or a timeout. A row that fails at all tries has no result; the job goes on.

    A call that hangs costs its own row ``timeout`` seconds for each try, and no other row anything.
    """
    names = rows.columns
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", result double, tries int, errors array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                result, errors = None, []
                for k in range(tries):
                    try:
                        result = called(work, dict(zip(names, row, strict=True)), k, timeout)
                        break
                    except Exception as e:  # whatever goes wrong is recorded, the stream continues
                        errors.append(f"{type(e).__name__}: {e}")
                out.append((*row, result, len(errors) + (result is not None), errors))
            yield pd.DataFrame(out, columns=[*names, "result", "tries", "errors"])

    return rows.mapInPandas(run, schema)


def failures(attempted: DataFrame) -> DataFrame:
    """The side output: rows of ``attempts`` without a result."""
    return attempted.filter(F.col("result").isNull())


def observation_memory(steps: DataFrame, key: str = "instruction") -> DataFrame:
    """(key, place, seen): base names that were visible at each place, from observations that tell where one arrives.

    An observation counts once for each (key, number of earlier actions, text), as a repeated call would repeat it. In long form, so no set is gathered.
    """
    once = steps.select(key, "step", T.normalize("observation").alias("said")).distinct()
    place = F.nullif(F.trim(F.regexp_extract("said", r"\byou arrive at (.+?)\.", 1)), F.lit(""))
    shown = once.select(key, place.alias("place"), F.explode(T.visible_entities("said")).alias("name")).filter(F.col("place").isNotNull())
    return shown.select(key, "place", T.entity_base("name").alias("seen")).distinct()


def valid_since(rows: DataFrame, group: str, minute: str, captured: Column, window: int = 120) -> DataFrame:
    """Adds valid: whether the group's last capture, this row's included, is at most ``window`` minutes old."""
    order = Window.partitionBy(group).orderBy(minute, *[c for c in ("event_id",) if c in rows.columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(captured, F.col(minute)), ignorenulls=True).over(order)
    return rows.withColumn("valid", F.coalesce(F.col(minute) - last <= window, F.lit(False)))
