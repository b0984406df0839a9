"""Prompts as arrays of messages: the next action, and the same with examples, a bounded history and a state memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

# What prompts say.
SYSTEM = "You are an embodied task planner. Select the next high-level action from the text observation and action history. Output exactly one action string."
ASK = "Return the next action only."
CHOOSE = "Use the examples and current state to choose exactly one legal next action."
HEADS = {"task": "Task instruction:", "before": "Previous actions:", "seen": "Current observation:", "goal": "Persistent goal:", "state": "Current observable state:"}
#: How many of a kind the state memory names.
PLACES, OTHERS = 12, 8


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sections(*parts: tuple[str, Column] | Column) -> Column:
    """Parts with a blank line between them; a pair has its head above, by name or as it is."""
    lines = [F.concat(F.lit(HEADS.get(p[0], p[0]) + "\n"), p[1]) if isinstance(p, tuple) else p for p in parts]
    return F.concat_ws("\n\n", *lines)


def next_action(instruction: str | Column, previous: str | Column, observation: str | Column, example: str | Column = "") -> Column:
    """System and user message for the next action; no previous actions are ``(none)``."""
    before = F.when(F.size(T.col(previous)) > 0, F.array_join(T.col(previous), "\n")).otherwise("(none)")
    shown = F.lit(example) if isinstance(example, str) else example
    user = sections(("task", T.col(instruction)), ("before", before), ("seen", T.col(observation)), F.lit(ASK))
    return F.array(message("system", F.lit(SYSTEM)), message("user", F.concat(shown, user)))


def aligned(instruction: str | Column, previous: str | Column, observation: str | Column, examples: str | Column, window: int = 0, head: str = "Examples:", state: Column | None = None) -> Column:
    """The next action's messages, with examples under ``head`` before, and the goal and the state memory of the whole history behind; only the last ``window`` actions (0: all) are quoted.

    state: the state memory's text, if it is known already (``remembered`` makes it of rows); previous then need not be longer than the window.
    """
    quoted = N.tail(previous, window) if window > 0 else T.col(previous)
    own = next_action(instruction, quoted, observation)
    shown = F.lit(examples) if isinstance(examples, str) else examples
    user = sections((head, shown), own[1]["content"], ("goal", T.col(instruction)), ("state", state_summary(previous) if state is None else state), F.lit(CHOOSE))
    return F.array(own[0], message("user", user))


def state_summary(previous: str | Column) -> Column:
    """What a list of actions says of the state, as text: place, thing in hand, places seen first, and what was treated, put down and used last."""
    own = F.transform(T.col(previous), lambda a: T.normalize(a))

    def lines(h: Column) -> Column:
        some = lambda k: F.filter(F.transform(h, lambda a: told(a)[k]), lambda x: x.isNotNull())
        return memory({k: some(k) for k in told(F.lit(""))})

    return N.bind(own, lines)


def told(action: str | Column) -> dict[str, Column]:
    """What one action tells the state memory, each null if it doesn't: where it goes, what is in hand then (empty: nothing), what it puts where, treats and uses."""
    part = lambda schema, group: T.matched(action, schema, group)
    return {
        "gone": part("go_to", "target"), "hand": F.coalesce(part("take_from", "object"), F.when(part("move_to", "object").isNotNull(), "")),
        "put": F.concat(part("move_to", "object"), F.lit(" -> "), part("move_to", "target")),
        "treated": F.nullif(F.concat_ws(" ", part("treatment", "verb"), part("treatment", "object")), F.lit("")), "used": F.nullif(F.regexp_extract(T.normalize(action), "^use (.+)$", 1), F.lit("")),
    }


def memory(said: dict[str, Column]) -> Column:
    """The state memory's text from arrays of what actions told, in their order. ``places``: those gone to by first visit, if they are known already; then arrays need hold no more than the text names."""
    last = lambda xs, none: F.coalesce(F.nullif(F.try_element_at(xs, F.lit(-1)), F.lit("")), F.lit(none))
    named = lambda xs, n: F.when(F.size(xs) > 0, F.array_join(N.tail(xs, n), ", ")).otherwise("none")
    places = said["places"] if "places" in said else F.array_distinct(said["gone"])
    rows = {
        "current location": last(said["gone"], "unknown"), "held object": last(said["hand"], "none"), "visited locations": named(places, PLACES),
        "completed treatments": named(said["treated"], OTHERS), "completed placements": named(said["put"], OTHERS), "used devices": named(said["used"], OTHERS),
    }
    return F.concat_ws("\n", F.lit("Observable state memory:"), *[F.concat(F.lit(f"- {k}: "), v) for k, v in rows.items()])


def remembered(steps: DataFrame, n: int | None = None, name: str = "memory") -> DataFrame:
    """steps (episode_id, step, action, ...) with the state memory's text of all actions before each, or of the last n. An action is parsed once, not by each of the steps that remember it."""
    parts = told("action")
    rows = steps.withColumns({f"_m_{k}": v for k, v in parts.items()})
    if n is None:
        rows, said = _carried(rows)
    else:
        w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(-n, -1)
        said = {k: F.collect_list(f"_m_{k}").over(w) for k in parts}  # nulls aren't collected
    rows = rows.withColumns({f"_l_{k}": v for k, v in said.items()})
    return rows.withColumn(name, memory({k: F.col(f"_l_{k}") for k in said})).drop(*[c for c in rows.columns if c not in steps.columns])


def _carried(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """What all actions before a step told, as far as the text names it. An action that tells something new holds the last few of its kind, and a step has those of the last such action: a history of any length costs its length."""
    before = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy("episode_id", "_m_gone").orderBy("step")) == 1
    # Beside what is in hand, an action tells one thing at most.
    kinds = {"places": F.when(first, F.col("_m_gone")), **{k: F.col(f"_m_{k}") for k in ("put", "treated", "used")}}
    rows = rows.withColumns({"_m_kind": F.coalesce(*[F.when(v.isNotNull(), k) for k, v in kinds.items()]), "_m_own": F.coalesce(*kinds.values())})
    lately = Window.partitionBy("episode_id", "_m_kind").orderBy("step").rowsBetween(1 - max(PLACES, OTHERS), Window.currentRow)
    rows = rows.withColumn("_m_few", F.collect_list("_m_own").over(lately))
    last = lambda x: F.last(x, ignorenulls=True).over(before)
    return rows, {k: F.array(last(F.col(f"_m_{k}"))) for k in ("gone", "hand")} | {k: last(F.when(F.col("_m_kind") == k, F.col("_m_few"))) for k in kinds}
