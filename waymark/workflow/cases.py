"""Workflow cases and what follows from them: plans, candidate feedback, pairs, closed-loop runs. One case a task row; no state is shared."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.progress import scales
from . import lab
from . import roles as R

# Scope, samples, sites, whether samples are stored, which comes first, recovery.
TRAIN = (
    ("ir_only", 1, "front", False, "single"), ("ir_only", 1, "sparse", False, "single"), ("ir_only", 1, "back", False, "single"), ("ir_only", 1, "full", False, "single"),
    ("prep_to_ir", 1, "front", False, "single"), ("prep_to_ir", 1, "full", False, "single"), ("full_cycle", 1, "front", True, "single"), ("full_cycle", 1, "full", True, "single"),
    ("ir_only", 2, "front_full", False, "A_first"), ("ir_only", 2, "sparse_back", False, "B_first"), ("prep_to_ir", 2, "front_full", False, "A_first"), ("ir_only", 2, "full_front", False, "B_first"),
)
UNSEEN = (
    ("full_cycle", 2, "full_front", True, "B_first"), ("full_cycle", 2, "sparse_back", True, "B_first"), ("full_cycle", 1, "back", True, "single"), ("full_cycle", 2, "front_full", True, "A_first"),
    ("prep_to_ir", 2, "full_sparse", False, "B_first"), ("ir_only", 2, "back_back", False, "A_first"), ("prep_to_ir", 1, "back", False, "single"), ("ir_only", 2, "sparse_full", False, "A_first"),
)
RECOVERY = (("raw_on_agv", True), ("prep_ready", True), ("prepared_on_agv", False), ("running_measurement", False), ("characterized_at_slot", True))
SITES = {"front": (1, 2, 3), "sparse": (1, 3), "back": (4, 5), "full": (1, 2, 3, 4, 5, 6)}
PROTOCOLS = ("ATR", "REFLECT", "TRANS")
#: split, specs, repeats, first serial number less one
SPLITS = (("train", TRAIN, 30, 0), ("seen_test", TRAIN[:8], 10, 10_000), ("compositional_unseen", UNSEEN, 10, 20_000), ("recovery_test", tuple(("recovery", 1, "front", store, "single", how) for how, store in RECOVERY), 16, 30_000))
CASE = "split string, scope string, n_samples int, pattern string, store boolean, priority string, recovery string, variant int, serial long"


def cases(spark: SparkSession) -> DataFrame:
    """(episode_id, signature and CASE columns): 600 cases. Specs are rows of a small table, variants an exploded sequence."""
    rows = [(split, *spec, *("none",) * (6 - len(spec)), repeats, offset + k * repeats) for split, specs, repeats, offset in SPLITS for k, spec in enumerate(specs)]
    table = spark.createDataFrame(rows, "split string, scope string, n_samples int, pattern string, store boolean, priority string, recovery string, repeats int, base long")
    every = table.withColumn("variant", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1))).withColumn("serial", F.col("base") + F.col("variant") + 1)
    label = F.concat(F.lit("MWF11-"), F.replace(F.upper("split"), F.lit("_"), F.lit("-")), F.lit("-"), F.format_string("%05d", "serial"))
    signature = F.concat_ws("|", "scope", F.concat(F.lit("n"), F.col("n_samples").cast("string")), "pattern", F.when(F.col("store"), "store").otherwise("station"), "priority", "recovery")
    return every.select(label.alias("episode_id"), signature.alias("signature"), *[c.split()[0] for c in CASE.split(", ")])


@dataclass(frozen=True)
class Setup:
    """How a scope or a recovery begins: which samples are ahead, their stage and place, minutes modulo, the vehicle's dock by variant, and what they have measured."""

    who: str = "none"
    stage: str = "RAW"
    place: str = "SHELF_RAW"
    clock: int | None = None
    docks: tuple[str, ...] = ("STANDBY",)
    measured: str = "none"


SETUPS = {
    "full_cycle": Setup(clock=20),
    "ir_only": Setup("all", "PREPARED", "TRANSFER", 40, ("IR", "STANDBY", "STANDBY")),
    "prep_to_ir": Setup("lead", "PREPARED", "PREP", 30, ("STANDBY", "PREP")),
    "raw_on_agv": Setup("first", "RAW", "AGV", docks=("SHELF",)),
    "prep_ready": Setup("first", "PREPARED", "PREP"),
    "prepared_on_agv": Setup("first", "PREPARED", "AGV", docks=("PREP",)),
    "running_measurement": Setup("first", "PREPARED", "ROBOT", docks=("IR",), measured="one"),
    "characterized_at_slot": Setup("first", "CHARACTERIZED", "TRANSFER", measured="all"),
}


def start(row) -> tuple[lab.State, dict]:
    """The initial state and the goal of a case row. Which part of the laboratory holds a sample follows from its place."""
    ids = [f"V{row.serial:05d}{x}" for x in "AB"[: row.n_samples]]
    parts = [row.pattern] if row.n_samples == 1 else row.pattern.split("_", 1)
    own = {i: lab.sample(SITES[p], PROTOCOLS[(row.serial + k) % 3], k + 1) for k, (i, p) in enumerate(zip(ids, parts, strict=True))}
    goal = {"store": bool(row.store), "order": ids[::-1] if row.priority == "B_first" else ids}
    recovery, v = row.recovery != "none", int(row.variant)
    setup = SETUPS[row.recovery if recovery else row.scope]
    minute = v if setup.clock is None else v % setup.clock
    agv, lab_parts = {"place": setup.docks[v % len(setup.docks)]}, {}
    for slot, i in zip("AB", {"none": [], "all": ids, "lead": goal["order"][:1], "first": ids[:1]}[setup.who], strict=False):
        x = own[i]
        x |= {"stage": setup.stage, "place": f"TRANSFER_{slot}" if setup.place == "TRANSFER" else setup.place}
        if setup.measured == "one":
            x["measured"] = [1]
        elif setup.measured == "all":
            x |= {"measured": list(x["sites"]), "saved": True, "verified": True}
        match setup.place:
            case "AGV":
                agv["load"] = i
            case "PREP":
                lab_parts["prep"] = {"sample": i, "status": "READY"}
            case "TRANSFER":
                lab_parts.setdefault("slots", {})[slot] = i
            case "ROBOT":  # in the middle of its second measurement
                lab_parts["robot"] = {"zone": "MEASUREMENT_STAGE", "held": i, "slot": "A", "side": lab.FRONT}
                lab_parts["instrument"] = {"protocol": x["protocol"], "configured": i, "run": "RUNNING", "site": 2, "result": i}
                lab_parts["background"] = minute
    state = lab.new_state(own, minute, agv=agv, **lab_parts)
    if not recovery:  # some variants find the instrument partly set up
        if v % 2 == 1:
            state["background"] = minute
        if v % 3 == 2:
            state["instrument"]["protocol"] = own[ids[0]]["protocol"]
    return state, goal


def per_case(f: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """An operator that yields the rows of f(row) for each case, the cases being spread over all partitions."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = list(f(row))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "episode_id").mapInPandas(run, schema)


def planned(row) -> Iterator[tuple]:
    state, goal = start(row)
    ok, done, states = lab.plan(state, goal)
    cost = 0.0
    for k, (skill, arg) in enumerate(done):
        cost += lab.SKILLS[skill].cost
        yield row.episode_id, row.split, k, skill, arg, float(cost), states[k + 1]["minute"], ok


PLAN = "episode_id string, split string, step_index long, skill string, argument string, cost double, minute long, success boolean"


def plans(rows: DataFrame) -> DataFrame:
    """Every step of every case's plan, with cost and clock so far."""
    return per_case(planned, PLAN)(rows)


def judged(row, every: int = 6) -> Iterator[tuple]:
    """Candidate feedback at up to ``every`` evenly spaced states of the plan: legality, problems, steps that remain after the candidate."""
    state, goal = start(row)
    _, done, states = lab.plan(state, goal)
    places = list(dict.fromkeys(round(k * (len(done) - 1) / (every - 1)) for k in range(every))) if done else []
    for at in places:
        for action in lab.actions(states[at]):
            problems, after = lab.attempt(states[at], action)
            reached, rest, _ = lab.plan(after, goal) if not problems else (False, [], [])
            yield (
                row.episode_id, row.split, at, f"{action[0]}({action[1]})", not problems, len(problems), len(rest) if reached else None, action == done[at],
                not problems and lab.unchanged(states[at], after),
            )


FEEDBACK = "episode_id string, split string, step_index long, action string, legal boolean, n_errors long, remaining long, is_expert boolean, idempotent boolean"


def feedback(rows: DataFrame) -> DataFrame:
    return per_case(judged, FEEDBACK)(rows)


def pairs(rows: DataFrame) -> DataFrame:
    """Preference pairs from the legal candidates' feedback: the best one against every worse or idle one."""
    from ..operators.pairs import best_against_worse

    legal = feedback(rows).filter("legal")
    return best_against_worse(legal)


def scored(s: lab.State, goal: dict, history: list[lab.Action]) -> list[tuple[lab.Action, lab.State, dict[str, float], float]]:
    """(action, successor, roles, structural score) of every legal action."""
    options, scale = R.legal(s), scales()
    found = [(a, after, R.roles(s, goal, a, after, history, set(options))) for a, after in options.items()]
    return [(a, after, own, R.score(own, scale)) for a, after, own in found]


def featured(row, every: int = 6) -> Iterator[tuple]:
    """Features of every legal candidate at up to ``every`` evenly spaced states of the plan, in long form."""
    state, goal = start(row)
    _, done, states = lab.plan(state, goal)
    for at in list(dict.fromkeys(round(k * (len(done) - 1) / (every - 1)) for k in range(every))) if done else []:
        for action, after, own, value in scored(states[at], goal, done[:at]):
            for name, x in {**R.features(states[at], goal, action, after, own), "structural": value}.items():
                yield row.episode_id, at, f"{action[0]}({action[1]})", name, float(x)


FEATURES = "episode_id string, step_index long, action string, feature string, value double"


def candidate_features(rows: DataFrame) -> DataFrame:
    return per_case(featured, FEATURES)(rows)


#: Weights of the scaled structural and the standardized residual score beside the actor's, by variant.
VARIANTS = {"actor": (0.0, 0.0), "actor_structural": (R.STRUCTURAL_WEIGHT, 0.0), "actor_residual": (0.0, R.RESIDUAL_WEIGHT), "full": (R.STRUCTURAL_WEIGHT, R.RESIDUAL_WEIGHT)}
#: A small ranker over candidate features, for runs without a trained one.
RESIDUAL = {"productive_transition": 1.0, "role:lifecycle_progress": 0.5, "idempotent": -1.0}


def scaled(values: list[float]) -> list[float]:
    """By the largest absolute value; 0 where that is tiny."""
    top = max(map(abs, values))
    return [x / top if top >= 1e-8 else 0.0 for x in values]


def standardized(values: list[float]) -> list[float]:
    """Population z-scores; 0 where the spread is tiny."""
    mean = sum(values) / len(values)
    spread = (sum((x - mean) ** 2 for x in values) / len(values)) ** 0.5
    return [(x - mean) / spread if spread >= 1e-8 else 0.0 for x in values]


def run_closed(row, budget: int = 50, stagnant: int = 6, actor: float = 1.0, variant: str = "actor_structural", ranker: dict[str, float] | None = None) -> Iterator[tuple]:
    """Runs a case by the scores that a variant fuses: a stand-in actor that prefers the planner's action, the structural score scaled within the state, and a
    linear ranker's score of the candidates' features standardized within the state.

    Stops at the goal, the budget, without legal actions, after ``stagnant`` actions in a row that change nothing but the clock, or where the state
    (but for the clock) and the last eight actions were there before. Ties go to the largest action text.
    """
    state, goal = start(row)
    by_structure, by_residual = VARIANTS[variant]
    history: list[lab.Action] = []
    seen: set[str] = set()
    idle, cost, reason = 0, 0.0, "budget"
    while len(history) < budget:
        if lab.complete(state, goal):
            reason = "goal"
            break
        if idle >= stagnant:
            reason = "stagnation"
            break
        decision = json.dumps([{k: v for k, v in state.items() if k != "minute"}, history[-8:]], sort_keys=True)
        if decision in seen:
            reason = "cycle"
            break
        seen.add(decision)
        options = scored(state, goal, history)
        if not options:
            reason = "stuck"
            break
        wish = lab.next_action(state, goal)
        structure = scaled([x[3] for x in options])
        weights = (ranker or RESIDUAL) if by_residual else {}
        residual = standardized([sum(weights.get(k, 0.0) * v for k, v in R.features(state, goal, *x[:3]).items()) for x in options]) if weights else [0.0] * len(options)
        fused = [actor * (x[0] == wish) + by_structure * s + by_residual * r for x, s, r in zip(options, structure, residual, strict=True)]
        best = max(range(len(options)), key=lambda k: (fused[k], options[k][0]))  # noqa: B023
        chosen, after, _, _ = options[best]
        idle = idle + 1 if lab.unchanged(state, after) else 0
        cost += lab.SKILLS[chosen[0]].cost
        history.append(chosen)
        state = after
    if lab.complete(state, goal):
        reason = "goal"
    yield row.episode_id, row.split, row.scope, reason == "goal", len(history), cost, reason


RESULT = "episode_id string, split string, scope string, success boolean, steps long, cost double, reason string"


def closed_loop(rows: DataFrame, **settings) -> DataFrame:
    """One row a case; settings are those of run_closed."""
    return per_case(partial(run_closed, **settings), RESULT)(rows)


def started(row) -> Iterator[tuple]:
    """A case's initial state in columns."""
    s, _ = start(row)
    stages = ",".join(sorted(f"{x['stage']}@{x['place']}" for x in s["samples"].values()))
    yield (
        row.episode_id, row.split, row.scope, s["minute"], s["agv"]["place"], s["prep"]["status"], s["background"] is not None, s["instrument"]["protocol"] is not None,
        stages, len(lab.actions(s)), len(lab.broken(s)),
    )


STARTED = "episode_id string, split string, scope string, minute long, agv string, prep string, background boolean, protocol boolean, samples string, candidates long, violations long"


def starts(rows: DataFrame) -> DataFrame:
    return per_case(started, STARTED)(rows)


def planned_effects(row) -> Iterator[tuple]:
    """What a case's plan does, by kind of skill, and how many of its states break an invariant."""
    state, goal = start(row)
    ok, done, states = lab.plan(state, goal)
    names = [a for a, _ in done]
    count = lambda start: sum(n.startswith(start) for n in names)
    kinds = ("measure_site", "poll_measurement", "switch_grip", "save_measurement", "verify_result", "unload_characterized", "run_preparation", "place_mold")
    yield row.episode_id, ok, *map(count, kinds), sum(bool(lab.broken(s)) for s in states)


EFFECTS = "episode_id string, completed boolean, measured long, polled long, flipped long, saved long, verified long, stored long, prepared long, placed long, violations long"


# Fixed value: what the workflow's prompt says.
SYSTEM = "You schedule deterministic skills in a materials laboratory. Select exactly one action from legal_actions. Return only its compact JSON object."


def compact(value) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def action_object(action: lab.Action) -> dict:
    skill, argument = action
    return {"skill": skill, "args": {lab.SKILLS[skill].parameter: argument} if argument else {}}


def messages(task: str, state: lab.State, goal: dict, history: list[lab.Action], legal: list[lab.Action], target: lab.Action | None = None) -> list[tuple[str, str]]:
    """(role, content) of a prompt: goal, state, the last eight actions and the legal ones as canonical JSON; with a target, the answer too."""
    payload = {"task": task, "goal": goal, "state": state, "recent_actions": [action_object(a) for a in history[-8:]], "legal_actions": [action_object(a) for a in legal]}
    answer = [("assistant", compact(action_object(target)))] if target else []
    return [("system", SYSTEM), ("user", compact(payload)), *answer]


def prompted(row) -> Iterator[tuple]:
    """The training prompts of a case: one for each step of its plan."""
    state, goal = start(row)
    _, done, states = lab.plan(state, goal)
    for k, action in enumerate(done):
        own = messages(row.signature, states[k], goal, done[:k], list(R.legal(states[k])), action)
        yield row.episode_id, k, [role for role, _ in own], own[1][1], own[2][1]


PROMPTS = "episode_id string, step_index long, roles array<string>, user string, answer string"


def prompts(rows: DataFrame) -> DataFrame:
    return per_case(prompted, PROMPTS)(rows)


def plan_effects(rows: DataFrame) -> DataFrame:
    return per_case(planned_effects, EFFECTS)(rows)


def release_report(rows: DataFrame) -> DataFrame:
    """(section, name, value): counts of cases by split, scope, initial dock and sample stage, full cycles, and signatures that the unseen split shares with training."""
    begun = starts(rows).select("episode_id", "agv", "samples")
    joined = rows.join(begun, "episode_id")
    stages = joined.select(F.explode(F.split("samples", ",")).alias("s")).select(F.substring_index("s", "@", 1).alias("name"))
    tables = [(name, joined.select(F.col(c).alias("name"))) for name, c in (("split", "split"), ("scope", "scope"), ("initial_agv", "agv"))] + [("initial_stage", stages)]
    tables.append(("lifecycle", joined.filter((F.col("scope") == "full_cycle") & F.col("store")).select(F.lit("full_cycle").alias("name"))))
    parts = [t.groupBy("name").agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "name", "value") for section, t in tables]
    sides = rows.filter(F.col("split").isin("train", "compositional_unseen")).groupBy("signature").agg(F.count_distinct("split").alias("n"))
    parts.append(sides.agg(F.count_if(F.col("n") > 1).alias("value")).select(F.lit("leakage").alias("section"), F.lit("shared_signatures").alias("name"), "value"))
    return reduce(DataFrame.unionByName, parts)


def summarize(results: DataFrame) -> DataFrame:
    """Episodes, successes, mean steps and cost overall, by split and by scope."""
    level = F.when(F.grouping("split") == 0, "split").when(F.grouping("scope") == 0, "scope").otherwise("overall")
    return results.groupingSets([[], [F.col("split")], [F.col("scope")]], F.col("split"), F.col("scope")).agg(
        level.alias("level"), F.count("*").alias("episodes"), F.count_if("success").alias("successes"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.avg("cost"), 6).alias("mean_cost")
    )


def audit(rows: DataFrame) -> DataFrame:
    """(split, cases, signatures, shared): how many signatures of a split another split has too."""
    w = Window.partitionBy("signature")
    spread = rows.select("split", "signature").distinct().withColumn("splits", F.count("*").over(w))
    shared = spread.groupBy("split").agg(F.count("*").alias("signatures"), F.count_if(F.col("splits") > 1).alias("shared"))
    return rows.groupBy("split").agg(F.count("*").alias("cases")).join(shared, "split")
