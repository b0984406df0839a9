"""State of an ordered history, as window expressions over one row for each step.

Every column describes what is known before the row's action. All windows share the partitioning by episode, so the
whole fold costs one exchange and never builds a step's prefix as an array; only the cycle test looks at a bounded tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

CYCLE_LENGTH, CYCLE_REPEATS = 6, 3
RECENT = 4


def annotate(steps: DataFrame) -> DataFrame:
    """Adds the state before each action. Needs episode_id, step, action, instruction, observation.

    held_object, current_location, lamp_location (null if none), lamp_used, treatment_done, placed_count (placements of the
    goal object at the goal's destination, repeats included), placed_distinct, target_location (where this action leads to or
    looks), visits (of target_location so far), recent_repeat, inverse_transition, unique_ratio (of the last six actions; 1 at the
    start), cycle (whether the actions up to this one end in a repeated run).
    """
    order = Window.partitionBy("episode_id").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumns({
        "norm": T.normalize("action"), "goal": T.parse_goal("instruction"),
        "take_object": T.matched("action", "take_from", "object"), "take_source": T.matched("action", "take_from", "source"),
        "move_object": T.matched("action", "move_to", "object"), "move_target": T.matched("action", "move_to", "target"),
        "go_target": T.matched("action", "go_to", "target"),
        "look_target": T.matched("action", "examine", "object"),
    })
    rows = rows.withColumn("segment", F.count("take_object").over(upto)).withColumn("target_location", F.coalesce("go_target", "look_target"))
    # Between two takes the held object is the first one's, until something with its name is put down.
    segment = Window.partitionBy("episode_id", "segment").orderBy("step")
    since = segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("picked", F.first("take_object").over(since)).withColumn(
        "held_after",
        F.when(~F.coalesce(F.bool_or(T.entity_base("move_object") == T.entity_base("picked")).over(since), F.lit(False)), F.col("picked")),
    )
    lamp = F.col("norm").startswith("use desklamp")
    rows = rows.withColumn("location_after", F.last("go_target", ignorenulls=True).over(upto)).withColumn("lamp_here", F.when(lamp, F.struct("step", "location_after")))
    goal_object, goal_place = F.col("goal.object"), F.col("goal.destination")
    placed = F.col("move_object").isNotNull() & (goal_object != "") & (goal_place != "") & (T.entity_base("move_object") == goal_object) & F.contains("move_target", goal_place)
    treated = (F.col("goal.treatment") == "") | (goal_object == "") | F.coalesce(F.bool_or(F.col("norm").startswith(F.concat_ws(" ", "goal.treatment", "goal.object"))).over(before), F.lit(False))
    place = Window.partitionBy("episode_id", "target_location").orderBy("step")
    # Distinct things put down are counted by their first time, so no window gathers names.
    rows = rows.withColumn("put_id", F.when(placed, T.normalize("move_object")))
    first_put = F.row_number().over(Window.partitionBy("episode_id", "put_id").orderBy("step")) == 1
    rows = rows.withColumn("put_first", F.col("put_id").isNotNull() & first_put)
    lag = lambda c, n=1: F.lag(c, n).over(order)
    recent = F.lit(False)
    for n in range(1, RECENT + 1):
        recent = recent | F.coalesce(lag("norm", n) == F.col("norm"), F.lit(False))
    inverse = (
        ((lag("take_object") == F.col("move_object")) & (lag("take_source") == F.col("move_target")))
        | ((lag("move_object") == F.col("take_object")) & (lag("move_target") == F.col("take_source")))
    )
    last_six = F.collect_list("norm").over(order.rowsBetween(-6, -1))
    tail = F.collect_list("norm").over(order.rowsBetween(-(CYCLE_LENGTH * CYCLE_REPEATS - 1), Window.currentRow))
    return rows.withColumns({
        "held_object": lag("held_after"),
        "current_location": F.last("go_target", ignorenulls=True).over(before),
        "lamp_used": F.coalesce(F.bool_or(lamp).over(before), F.lit(False)),
        "lamp_location": F.min("lamp_here").over(before)["location_after"],
        "treatment_done": treated,
        "placed_count": F.count("put_id").over(before),
        "placed_distinct": F.count(F.when(F.col("put_first"), 1)).over(before),
        "visits": F.when(F.col("target_location").isNotNull(), F.row_number().over(place) - 1).otherwise(0).cast("long"),
        "recent_repeat": recent,
        "inverse_transition": F.coalesce(inverse, F.lit(False)),
        "unique_ratio": F.when(F.size(last_six) > 0, F.size(F.array_distinct(last_six)) / F.size(last_six)).otherwise(F.lit(1.0)),
        "cycle": N.has_cycle(tail, CYCLE_LENGTH, CYCLE_REPEATS),
    }).drop("segment", "picked", "held_after", "location_after", "lamp_here", "put_id", "put_first")


def stagnation_runs(steps: DataFrame, state: str) -> DataFrame:
    """(episode_id, start_step, run_length, state): runs of consecutive steps whose state is equal."""
    order = Window.partitionBy("episode_id").orderBy("step")
    changed = F.when(F.lag(state).over(order).eqNullSafe(F.col(state)), 0).otherwise(1)
    runs = steps.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    return runs.groupBy("episode_id", "run").agg(F.min("step").alias("start_step"), F.count("*").alias("run_length"), F.first(state).alias("state")).drop("run")


def phase(held: str = "held_object") -> Column:
    """Phase label of an annotated row: illuminate, examine, treat, deliver, acquire or complete."""
    goal = F.col("goal")
    needed = F.col(held).isNotNull() & (T.entity_base(held) == goal["object"])
    return (
        F.when(goal["needs_light"] & F.col("lamp_used") & (F.col("examined_goal")), "complete")
        .when(goal["needs_light"] & F.col("lamp_used"), "examine")
        .when(goal["needs_light"], "illuminate")
        .when(F.col("placed_distinct") >= goal["count"], "complete")
        .when(needed & (goal["treatment"] != "") & ~F.col("treatment_done"), "treat")
        .when(needed, "deliver")
        .otherwise("acquire")
    )


def with_examined(annotated: DataFrame) -> DataFrame:
    """Adds examined_goal: whether an earlier action examined the goal object."""
    before = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(T.entity_base("look_target") == F.col("goal.object"), F.lit(False))
    acquired = F.coalesce(T.entity_base("take_object") == F.col("goal.object"), F.lit(False))
    return annotated.withColumns({
        "examined_goal": F.coalesce(F.bool_or(hit).over(before), F.lit(False)),
        "acquired_goal": F.coalesce(F.bool_or(acquired).over(before), F.lit(False)),
    })


def predicates(annotated: DataFrame) -> DataFrame:
    """The eight progress predicates of every step, as doubles."""
    rows = with_examined(annotated)
    goal = F.col("goal")
    examined = F.col("examined_goal") | (goal["needs_light"] & F.col("lamp_used") & F.col("acquired_goal"))
    fraction = F.least(goal["count"], F.col("placed_distinct")) / goal["count"]
    complete = F.when(goal["needs_light"], F.col("lamp_used") & examined).otherwise((fraction >= 1) & F.col("treatment_done"))
    visible = (goal["object"] != "") & F.rlike(F.lower("observation"), F.concat(F.lit(r"\b"), goal["object"], F.lit(r"\s+\d+\b")))
    place = F.coalesce((goal["destination"] != "") & F.contains("current_location", goal["destination"]), F.lit(False))
    number = lambda c: c.cast("double")
    return rows.select(
        "episode_id", "step", number(visible).alias("target_visible"), number(F.col("acquired_goal")).alias("target_acquired"),
        number(F.col("treatment_done")).alias("treatment_satisfied"), number(place).alias("destination_reached"), number(fraction).alias("placed_fraction"),
        number(F.col("lamp_used")).alias("lamp_active"), number(examined).alias("goal_examined"), number(complete).alias("task_complete"),
    )


def summaries(annotated: DataFrame) -> DataFrame:
    """A line of state memory for every step."""
    return annotated.select(
        "episode_id", "step",
        F.format_string(
            "location: %s; held: %s; placements: %d; lamp: %s",
            F.coalesce("current_location", F.lit("unknown")), F.coalesce("held_object", F.lit("none")), "placed_count", F.coalesce("lamp_location", F.lit("none")),
        ).alias("memory"),
    )
