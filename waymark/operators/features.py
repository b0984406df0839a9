"""Sparse features of an action in its state: entity effects, search, lexical overlap, semantic factors, router context.

The entity state is what running counts over an episode's steps say; no prefix is kept, neither as actions nor as names.
Features are maps without zeros.
"""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

FLAGS = ("target_acquired", "target_treated", "target_placed", "target_inspected", "destination_reached", "holding_target")
PHASES = ("acquire", "treat", "deliver", "illuminate", "examine", "complete")


def present(entries: list[tuple[Column | str, Column]]) -> Column:
    """A map of the entries that aren't 0; keys may be computed."""
    rows = [F.struct((F.lit(k) if isinstance(k, str) else k).alias("key"), v.cast("double").alias("value")) for k, v in entries]
    return F.map_from_entries(F.filter(F.array(*rows), lambda e: e["key"].isNotNull() & (e["value"] != 0)))


def number(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def entity_state(steps: DataFrame) -> DataFrame:
    """Adds the parsed action ``p``, the goal ``goal`` (strict dialect) and the entity state around the action, all null-free.

    held, place: text before the action, empty if none; visits: how often the action's target was gone to; been, been_word: whether anything of its base name (by either rule) was; repeats: how
    often the action was done; item_put: whether the thing that it takes was put down before; recent: the last four actions; seen: visible entities; after: a struct of the goal flags and of the numbers of different things
    visited, placed, treated, examined and opened, with the action's own effect.

    An action touches one thing (its ``item``). Things are counted at their first time, and a thing put down counts where it lies by the change against its last
    place, so running sums over the episode say all: memory is linear in the episode, whatever its vocabulary.
    """
    order = Window.partitionBy("episode_id").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = steps.withColumns({"p": T.parse_action("action", entities=True), "norm": T.normalize("action"), "goal": T.parse_goal("instruction", "strict"), "seen": T.visible_entities("observation")})
    p, goal = F.col("p"), F.col("goal")
    part = lambda s, f: F.nullif(F.when(p["schema"] == s, p[f]), F.lit(""))
    rows = rows.withColumns({"t_obj": part("take_from", "object"), "m_obj": part("move_to", "object"), "g_to": part("go_to", "target")})
    rows = rows.withColumn("seg", F.count("t_obj").over(upto))
    since = Window.partitionBy("episode_id", "seg").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("picked", F.first("t_obj").over(since)).withColumn("h_after", F.when(~F.coalesce(F.bool_or(F.col("m_obj") == F.col("picked")).over(since), F.lit(False)), F.col("picked")))
    rows = rows.withColumns({"held": F.coalesce(F.lag("h_after").over(order), F.lit("")), "h_after": F.coalesce("h_after", F.lit(""))})
    of_goal = lambda x: F.coalesce(T.entity_base(x) == goal["object"], F.lit(False))
    by_lamp = (p["schema"] == "use") & T.entity_base("p.object").contains("lamp") & (F.col("held") != "") & of_goal("held")
    put_to = F.when(F.col("m_obj").isNotNull(), F.nullif(p["target"], F.lit("")))
    things = {
        "visited": F.col("g_to"), "placed": F.when(put_to.isNotNull(), F.col("m_obj")), "treated": part("treatment", "object"),
        "examined": F.coalesce(part("examine", "object"), F.when(by_lamp, F.col("held"))), "opened": part("open", "object"),
    }
    item = F.coalesce(*[F.when(x.isNotNull(), F.concat(F.lit(f"{k}:"), x)) for k, x in things.items()])
    at_goal = put_to.isNotNull() & of_goal("m_obj") & (goal["destination"] != "") & T.entity_base(put_to).contains(goal["destination"])
    rows = rows.withColumns({"item": item, "at_goal": F.coalesce(at_goal, F.lit(False)).cast("int"), "g_base": T.entity_base("g_to"), "g_word": T.drop_last_word("g_to")})
    same = Window.partitionBy("episode_id", "item").orderBy("step")
    rows = rows.withColumns({"new": F.col("item").isNotNull() & (F.row_number().over(same) == 1), "moved_there": F.col("at_goal") - F.coalesce(F.lag("at_goal").over(same), F.lit(0))})
    ever = lambda c: F.coalesce(F.bool_or(c).over(upto), F.lit(False))
    tool = F.coalesce(part("use", "object"), part("use_with", "tool"))
    flags = {
        "target_acquired": ever(of_goal("t_obj")),
        "target_treated": ever(of_goal(part("treatment", "object")) & ((goal["treatment"] == "") | (p["verb"] == goal["treatment"]))),
        "target_placed": F.sum(F.when(F.col("item").startswith("placed:"), F.col("moved_there")).otherwise(0)).over(upto) >= goal["count"],
        "target_inspected": ever(of_goal(things["examined"])) & (~goal["needs_light"] | ever(tool.contains("lamp"))),
        "destination_reached": ever((goal["destination"] != "") & (F.col("g_to") == goal["destination"])),
        "holding_target": (F.col("h_after") != "") & of_goal("h_after"),
    }
    known = [F.count(F.when(F.col("new") & F.col("item").startswith(f"{k}:"), 1)).over(upto).cast("int").alias(f"n_{k}") for k in things]
    went = F.col("g_to").isNotNull()
    # Whether the thing that is taken was put down before: takes and moves of a thing in one window.
    handled = Window.partitionBy("episode_id", F.coalesce("t_obj", "m_obj")).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    put_before = F.col("t_obj").isNotNull() & F.coalesce(F.bool_or(F.col("item").startswith("placed:")).over(handled), F.lit(False))
    times = lambda c: F.row_number().over(Window.partitionBy("episode_id", c).orderBy("step")) - 1
    return rows.withColumns({
        "after": F.struct(*[v.alias(k) for k, v in flags.items()], *known, F.col("h_after").alias("held")),
        "place": F.coalesce(F.last("g_to", ignorenulls=True).over(before), T.arrival_location("observation"), F.lit("")),
        "visits": F.when(went, times("item")).otherwise(0), "been": went & (times("g_base") > 0), "been_word": went & (times("g_word") > 0), "item_put": put_before, "repeats": times("norm"),
        "recent": F.collect_list("norm").over(order.rowsBetween(-4, -1)), "n_before": F.row_number().over(order) - 1,
    }).drop("t_obj", "m_obj", "g_to", "g_base", "g_word", "seg", "picked", "h_after", "item", "at_goal", "new", "moved_there")


def transition(state: DataFrame) -> DataFrame:
    """Adds ``before``: the goal flags and numbers as the action before left them; at the start no flag holds and nothing is known."""
    order = Window.partitionBy("episode_id").orderBy("step")
    fields = state.schema["after"].dataType.fields
    start = F.struct(*[F.lit({"boolean": False, "int": 0, "string": ""}[f.dataType.simpleString()]).alias(f.name) for f in fields])
    return state.withColumn("before", F.coalesce(F.lag("after").over(order), start))


def effect_features(t: DataFrame) -> Column:
    """Names and effects of the action against the state before it."""
    p, goal, b, a = F.col("p"), F.col("goal"), F.col("before"), F.col("after")
    obj, target = T.entity_base(p["object"]), T.entity_base(F.when(p["target"] != "", p["target"]).otherwise(p["source"]))
    seen = lambda x: (x != "") & F.exists("seen", lambda s: T.entity_base(s) == x)
    go, been = p["schema"] == "go_to", F.col("been")
    grown = [(f"delta:{k}", a[f"n_{k}"] - b[f"n_{k}"]) for k in ("placed", "treated", "examined", "opened")]
    return present([
        ("bias", F.lit(1.0)), (F.concat(F.lit("schema:"), p["schema"]), F.lit(1.0)), (F.concat(F.lit("verb:"), p["verb"]), F.lit(1.0)),
        (F.concat(F.lit("object:"), obj), number(obj != "")), (F.concat(F.lit("target:"), target), number(target != "")),
        ("candidate:matches_goal", number((obj != "") & (obj == goal["object"]))),
        ("candidate:matches_destination", number((target != "") & (goal["destination"] != "") & target.contains(goal["destination"]))),
        ("candidate:matches_treatment", number((goal["treatment"] != "") & (p["verb"] == goal["treatment"]))),
        ("candidate:object_visible", number(seen(obj))), ("candidate:source_visible", number(seen(target))), ("candidate:goal_visible", number(seen(goal["object"]))),
        ("candidate:novel_location", number(go & ~been)), ("candidate:visited_location", number(go & been)), ("candidate:repeats", number(F.array_contains("recent", F.col("norm")))),
        *[(f"delta:{f}", a[f].cast("double") - b[f].cast("double")) for f in FLAGS],
        ("delta:visited", number(a["n_visited"] != b["n_visited"])), ("delta:held", number(a["held"] != b["held"])), *grown,
    ])


def state_features() -> Column:
    b, goal = F.col("before"), F.col("goal")
    return present([
        *[(f"state:{f}", number(b[f])) for f in FLAGS], ("state:history_length", N.capped_ratio("n_before", 50)), ("state:visited_count", N.capped_ratio(b["n_visited"], 12)),
        ("state:placed_count", N.capped_ratio(b["n_placed"], 4)), ("state:treated_count", N.capped_ratio(b["n_treated"], 4)), ("state:goal_count", goal["count"]),
        (F.concat(F.lit("location:"), T.entity_base("place")), number(F.col("place") != "")), (F.concat(F.lit("held:"), T.entity_base("held")), number(F.col("held") != "")),
    ])


def search_features(affinity: Column | None = None) -> Column:
    """For goings only: affinity of the place (0 without a prior), novelty and capped revisits."""
    visits = F.when(F.col("been"), F.greatest(F.col("visits"), F.lit(1))).otherwise(0)
    aff = F.lit(0.0) if affinity is None else affinity
    again = N.capped_ratio(visits, 6)
    own = present([("search:affinity", aff), ("search:novel", number(visits == 0)), ("search:revisit_count", again), ("search:affinity_novel", aff * number(visits == 0)), ("search:affinity_revisit", aff * again)])
    return F.when(F.col("p.schema") == "go_to", own).otherwise(F.create_map().cast("map<string,double>"))


def lexical_features() -> Column:
    """Overlaps of the action's words with instruction, goal, observation and the last four actions, and entity matches."""
    goal_part = F.when(F.instr("instruction", "task is to:") > 0, F.substring_index("instruction", "task is to:", -1)).otherwise(F.col("instruction"))
    joined = F.array_join("recent", " ")
    p = F.col("p")
    # Tokens are made once; each serves several features.
    tokens = {
        "act": T.id_tokens("action"), "raw_act": T.raw_tokens("action"), "asked": T.id_tokens("instruction"), "raw_asked": T.raw_tokens("instruction", True), "sought": T.id_tokens(goal_part),
        "raw_sought": T.raw_tokens(goal_part, True), "said": T.id_tokens("observation"), "raw_said": T.raw_tokens("observation", True), "last": T.id_tokens(joined), "raw_last": T.raw_tokens(joined),
        "obj": T.drop_last_word(p["object"]), "target": T.drop_last_word(F.when(p["target"] != "", p["target"]).otherwise(p["source"])), "shown": F.transform("seen", lambda s: T.drop_last_word(s)),
    }
    return N.bind(F.struct(*[v.alias(k) for k, v in tokens.items()]), _lexical)


def _lexical(t: Column) -> Column:
    p, goal, obj, target, shown = F.col("p"), F.col("goal"), t["obj"], t["target"], t["shown"]
    common = lambda a, b: F.size(F.array_intersect(t[a], t[b]))
    go, been = p["schema"] == "go_to", F.col("visits") > 0
    return present([
        ("lex:raw_instruction_overlap", common("raw_act", "raw_asked")), ("lex:raw_goal_overlap", common("raw_act", "raw_sought")),
        ("lex:raw_observation_overlap", common("raw_act", "raw_said")), ("lex:raw_recent_overlap", common("raw_act", "raw_last")),
        ("lex:instruction_jaccard", N.jaccard(t["act"], t["asked"])), ("lex:instruction_coverage", N.coverage(t["act"], t["asked"])),
        ("lex:goal_jaccard", N.jaccard(t["act"], t["sought"])), ("lex:goal_coverage", N.coverage(t["act"], t["sought"])),
        ("lex:observation_jaccard", N.jaccard(t["act"], t["said"])), ("lex:recent_overlap", N.coverage(t["act"], t["last"])),
        ("lex:goal_object_action", number((goal["object"] != "") & (obj == goal["object"]))), ("lex:goal_destination_action", number((goal["destination"] != "") & target.contains(goal["destination"]))),
        ("lex:goal_treatment_action", number((goal["treatment"] != "") & (p["verb"] == goal["treatment"]))), ("lex:target_visible", number((goal["object"] != "") & F.array_contains(shown, goal["object"]))),
        ("lex:action_object_visible", number((obj != "") & F.array_contains(shown, obj))), ("lex:history_action_repeat_count", F.col("repeats")),
        ("lex:history_location_visit_count", F.when(go, F.col("visits")).otherwise(0)), ("lex:action_is_new_location", number(go & ~been)), ("lex:action_is_visited_location", number(go & been)),
    ])


def semantic_features() -> Column:
    """Matches, goal-place bindings, flag changes and effects, for a learner to weigh."""
    p, goal, b, a = F.col("p"), F.col("goal"), F.col("before"), F.col("after")
    obj, target = T.drop_last_word(p["object"]), T.drop_last_word(F.when(p["target"] != "", p["target"]).otherwise(p["source"]))
    seen = lambda x: (x != "") & F.exists("seen", lambda s: T.drop_last_word(s) == x)
    go, been = p["schema"] == "go_to", F.col("been_word")
    bind = lambda name, x: (F.concat(F.lit(f"sem:bind:{name}="), x, F.lit("|location="), target), number(go & (target != "") & (x != "")))
    effects = [("visited", number(a["n_visited"] != b["n_visited"])), ("held", number(a["held"] != b["held"])), *[(k, a[f"n_{k}"] - b[f"n_{k}"]) for k in ("placed", "treated", "examined", "opened")]]
    change = lambda f: a[f].cast("double") - b[f].cast("double")
    return present([
        (F.concat(F.lit("sem:schema:"), p["schema"]), F.lit(1.0)), (F.concat(F.lit("sem:verb:"), F.when(p["verb"] == "", "other").otherwise(p["verb"])), F.lit(1.0)),
        ("sem:action_object_matches_goal", number((obj != "") & (obj == goal["object"]))),
        ("sem:action_target_matches_destination", number((target != "") & (goal["destination"] != "") & target.contains(goal["destination"]))),
        ("sem:action_matches_treatment", number((goal["treatment"] != "") & (p["verb"] == goal["treatment"]))),
        ("sem:object_visible", number(seen(obj))), ("sem:target_visible", number(seen(target))), ("sem:goal_visible", number(seen(goal["object"]))),
        ("sem:holding_goal", number(b["holding_target"])), ("sem:destination_reached", number(b["destination_reached"])), ("sem:action_repeats_recent", number(F.array_contains("recent", F.lower("action")))),
        ("sem:go_to_new_location", number(go & ~been)), ("sem:go_to_visited_location", number(go & been)), bind("goal_object", goal["object"]), bind("treatment", goal["treatment"]),
        *[(f"sem:delta:{f}", change(f)) for f in FLAGS], *[(f"sem:effect:{f}", change(f)) for f in FLAGS], *[(f"sem:effect:{k}", v) for k, v in effects],
    ])


def featurise(steps: DataFrame, weighed: Collection[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(episode_id, step, keep..., features): effects, search, lexical and semantic features of every step in one map. Given the names that are ``weighed``, families without any of them aren't made."""
    t = transition(entity_state(steps))
    families = {"search:": search_features, "lex:": lexical_features, "sem:": semantic_features}
    maps = [make() for prefix, make in families.items() if weighed is None or any(k.startswith(prefix) for k in weighed)]
    if weighed is None or not maps or any(not k.startswith(tuple(families)) for k in weighed):
        maps = [effect_features(t), *maps]
    return t.select("episode_id", "step", *keep, (F.map_concat(*maps) if len(maps) > 1 else maps[0]).alias("features"))


def counted(names: Column) -> Column:
    """A map from each name to how often it occurs; null names don't."""
    some = F.filter(names, lambda n: n.isNotNull())
    return N.bind(some, lambda xs: F.map_from_entries(F.transform(F.array_distinct(xs), lambda n: F.struct(n, F.size(F.filter(xs, lambda x: x == n)).cast("double")))))


def contract_names(recent: str) -> Column:
    """Names that contract violation records in the observation give an action (the last four records count); recent: the last eight actions, normalised."""
    norm, verb = T.normalize("action"), T.action_verb("action")

    def of(r: Column) -> Column:
        asked, own = r["required_action"], T.action_verb(r["required_action"])
        exact, blocked = (asked != "") & (norm == asked), (r["blocked_action"] != "") & (norm == r["blocked_action"])
        open_ = F.array(
            F.when(asked != "", F.concat(F.lit("contract_required_verb="), own)), F.when(exact, "contract_required_action_exact"), F.when(exact, F.concat(F.lit("contract_required_action_exact|verb="), verb)),
            F.when(exact & (own == "examine"), "contract_required_examine_target"), F.when(blocked, "contract_blocked_action_exact"), F.when(blocked, F.concat(F.lit("contract_blocked_action_exact|verb="), verb)),
        )
        name = "contract_required_action_satisfied"
        return F.when((asked != "") & F.array_contains(recent, asked), F.array(F.lit(name), F.concat(F.lit(f"{name}|verb="), own))).otherwise(open_)

    return N.bind(T.contract_records("observation"), lambda rs: F.concat(F.flatten(F.transform(N.tail(rs, 4), of)), F.when(F.size(rs) > 0, F.array(F.lit("has_contract_record"))).otherwise(F.array().cast("array<string>"))))


def contract_features(recent: str = "recent") -> Column:
    """The legacy schema contract_record_v1."""
    return counted(F.concat(F.array(F.lit("bias")), contract_names(recent)))


def bag_features(family: str | Column = "family", recent: str = "recent") -> Column:
    """The legacy schema bag_v1: words of the action, alone and against goal and observation, by task family and verb, with contract names. recent: the last eight actions, normalised."""
    fam, verb, norm = T.col(family), T.action_verb("action"), T.normalize("action")
    goal, seen = F.array_distinct(T.word_tokens(T.task_goal("instruction"))), F.array_distinct(T.word_tokens("observation"))
    tag = lambda head, x: F.concat(F.lit(head), x)

    def named(words: Column) -> Column:
        each = F.flatten(F.transform(words, lambda w: F.array(
            tag("action_token=", w), F.when(F.array_contains(goal, w), tag("goal_action_token=", w)), F.when(F.array_contains(goal, w), F.concat(F.lit("family="), fam, F.lit("|goal_action_token="), w)),
            F.when(F.array_contains(seen, w), tag("obs_action_token=", w)),
        )))
        again = F.array_contains(N.tail(recent, 4), norm)
        last = F.try_element_at(T.col(recent), F.lit(-1))
        schemas = (("take_from", "^take .+ from .+"), ("move_to", "^move .+ to .+"), ("go_to", "^go to .+"), ("treatment", "^(clean|cool|heat) .+ with .+"))
        whole = F.array(
            F.lit("bias"), tag("family=", fam), tag("verb=", verb), F.concat(F.lit("family="), fam, F.lit("|verb="), verb), tag("action=", norm), tag("action_len_bin=", F.least(F.size(words), F.lit(8)).cast("string")),
            F.when(again, "repeat_recent_action"), F.when(again, tag("repeat_recent_action|verb=", verb)), F.when(last.isNotNull(), F.concat(F.lit("last_verb="), T.action_verb(last), F.lit("|current_verb="), verb)),
            F.when(norm.contains("lamp"), "mentions_lamp"), *[F.when(norm.rlike(p), f"schema={s}") for s, p in schemas],
        )
        overlap = lambda other: N.capped_ratio(F.size(F.filter(words, lambda w: F.array_contains(other, w))), 6)
        return F.map_concat(counted(F.concat(whole, each, contract_names(recent))), present([("goal_overlap_count", overlap(goal)), ("observation_overlap_count", overlap(seen))]))

    return N.bind(T.word_tokens("action"), named)


def pair_difference(positive: str | Column, negative: str | Column) -> Column:
    """Positive less negative by name. Differences within ZERO of 0 go where the negative side has the name; what only the positive side has stays."""
    both = F.map_zip_with(T.col(positive), T.col(negative), lambda _, x, y: F.struct((F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))).alias("v"), y.isNull().alias("alone")))
    return F.transform_values(F.map_filter(both, lambda _, e: e["alone"] | (F.abs(e["v"]) >= N.ZERO)), lambda _, e: e["v"])


def rebuilt(features: str | Column, *views: Column) -> Column:
    """Features with all ``lex:`` and ``sem:`` entries replaced by those of the views, of which entries within ZERO of 0 go."""
    rest = F.map_filter(T.col(features), lambda k, _: ~k.startswith("lex:") & ~k.startswith("sem:"))
    return F.map_concat(rest, *[F.map_filter(v, lambda _, x: F.abs(x) >= N.ZERO) for v in views])


def with_memory(state: DataFrame) -> DataFrame:
    """Adds what the episode's observations so far (this step's included) say of the place that an action goes to, on rows of ``transition``.

    known: whether the place was observed; shown, lamp: whether the goal object, or a lamp, was seen there. Arrivals and goings meet as events of a place in
    one window by (episode, place), arrivals of a step before its going; so no set of places is gathered. A step's row is the event of its going: nothing is joined, and rows stay where their episode is.
    """
    rows = state.withColumn("_here", F.nullif(F.trim(F.regexp_extract(T.normalize("observation"), r"\byou arrive at (.+?)\.", 1)), F.lit("")))
    rows = rows.withColumn("_to", F.when(F.col("p.schema") == "go_to", F.nullif(F.col("p.target"), F.lit(""))))
    seen_goal = (F.col("goal.object") != "") & F.exists("seen", lambda s: T.entity_base(s) == F.col("goal.object"))
    seen_lamp = F.exists("seen", lambda s: T.entity_base(s).contains("lamp"))
    event = lambda kind, place, a, b: F.struct(F.lit(kind).alias("kind"), place.alias("place"), a.alias("a"), b.alias("b"))
    events = rows.withColumn("_e", F.explode(F.array(event(0, F.col("_here"), seen_goal, seen_lamp), event(1, F.col("_to"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))))
    events = events.filter((F.col("_e.kind") == 1) | F.col("_e.place").isNotNull()).withColumns({"_place": F.col("_e.place"), "_kind": F.col("_e.kind")})
    upto = Window.partitionBy("episode_id", "_place").orderBy("step", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ever = lambda c: F.col("_place").isNotNull() & F.coalesce(F.bool_or(c).over(upto), F.lit(False))
    told = events.withColumns({"known": ever(F.col("_kind") == 0), "shown": ever(F.col("_e.a")), "lamp": ever(F.col("_e.b"))})
    return told.filter(F.col("_kind") == 1).drop("_here", "_to", "_e", "_place", "_kind")


def memory_scores(remembered: DataFrame) -> DataFrame:
    """(episode_id, step, search, role): the search-recovery score and the role calibration of every action, on rows of ``with_memory``. All released runtimes weigh both 0.

    Both are sums of points over conditions on the action, the state before it and the memory.
    """
    p, goal, b, c = F.col("p"), F.col("goal"), F.col("before"), F.col
    is_ = lambda *schemas: p["schema"].isin(*schemas)
    obj, to = T.entity_base(p["object"]), T.entity_base(p["target"])
    on, holding = obj == goal["object"], b["holding_target"]
    at_goal = (goal["destination"] != "") & F.contains(to, goal["destination"])
    several, treats = goal["count"] > 1, goal["treatment"] != ""
    tool = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in T.TREATMENT_TOOLS.items() for x in kv]), goal["treatment"]), F.lit(""))
    times = lambda most: F.least(F.greatest(c("visits"), F.lit(1)), F.lit(most)).cast("double")
    points = lambda rows: sum((F.when(cond, value).otherwise(0.0) for cond, value in rows), F.lit(0.0))
    barren = c("known") & ~c("shown")
    put, search_go = is_("move_to"), is_("go_to") & ~holding
    ending = put & F.when(treats, b["target_treated"]).otherwise(~goal["needs_light"] & holding)
    search = points((
        (search_go & ~c("known") & (c("visits") == 0), 0.35), (search_go & barren, F.lit(-0.55) * times(3)),
        (is_("take_from") & (c("held") == ""), F.when(on, 0.75).otherwise(-2.5)),
        (goal["needs_light"] & holding & is_("use") & obj.contains("lamp"), 2.0), (goal["needs_light"] & holding & is_("move_to", "take_from"), -2.0),
        (treats & is_("treatment"), F.when(on & (p["verb"] == goal["treatment"]), 2.5).otherwise(-2.5)),
        (treats & holding & ~b["target_treated"] & is_("go_to") & (to == tool), 2.0), (treats & holding & ~b["target_treated"] & put, -2.0),
        (ending, F.when(on & at_goal, 2.5).otherwise(-1.0)), (several & is_("take_from") & on, F.when(c("item_put"), -2.0).otherwise(1.0)),
        (several & ~b["target_placed"] & search_go & at_goal, -2.0),
    ))
    role = points((
        (is_("treatment") & b["target_treated"] & on, -4.0), (several & is_("take_from") & c("item_put"), -4.0), (search_go & at_goal & barren, F.lit(-2.5) * times(2)),
        (goal["needs_light"] & holding & is_("go_to") & c("known") & ~c("lamp"), F.lit(-3.0) * times(2)), (goal["needs_light"] & holding & is_("go_to") & ~c("known") & (c("visits") == 0), 0.25),
    ))
    return remembered.select(
        "episode_id", "step", F.when(goal["object"] == "", 0.0).otherwise(search).alias("search"), F.when(c("norm").isin(*T.META_ACTIONS), -2.0).otherwise(role).alias("role")
    )


def object_affinity(priors: DataFrame) -> DataFrame:
    """(object, place, score) from (object, place, n): counts divided by the object's largest."""
    return priors.select("object", "place", (F.col("n") / F.max("n").over(Window.partitionBy("object"))).alias("score"))


def tool_prior(annotated: DataFrame, tool: str = "use desklamp") -> DataFrame:
    """(place, score): where the tool is used, by counts divided by the largest."""
    used = annotated.filter(F.col("norm").startswith(tool) & F.col("current_location").isNotNull())
    counts = used.groupBy(T.entity_base("current_location").alias("place")).agg(F.count("*").alias("n"))
    return counts.select("place", (F.col("n") / F.max("n").over(Window.partitionBy())).alias("score"))  # a row a place


def router_context(rows: DataFrame, max_steps: int = 30) -> DataFrame:
    """(episode_id, step, nineteen context features) of rows that history.annotate and with_examined made."""
    from .history import phase

    order = Window.partitionBy("episode_id").orderBy("step")
    goal = F.col("goal")
    placed = F.least(goal["count"], F.col("placed_distinct"))
    back = lambda k: F.lag("norm", k).over(order)
    holding = F.coalesce(T.entity_base("held_object") == goal["object"], F.lit(False)) & (goal["object"] != "")
    label = phase()
    return rows.select(
        "episode_id", "step", N.capped_ratio(goal["count"], 6).alias("required_count_scaled"), number(goal["count"] > 1).alias("repeated_goal"),
        number((goal["count"] > 1) & (placed > 0) & (placed < goal["count"])).alias("partial_repeated_goal"), (placed / goal["count"]).alias("placed_fraction"),
        ((goal["count"] - placed) / goal["count"]).alias("remaining_fraction"), N.capped_ratio("step", max_steps).alias("history_fraction"), number(holding).alias("holding_goal_object"),
        number(goal["treatment"] != "").alias("treatment_required"), number(holding & (goal["treatment"] != "") & F.col("treatment_done")).alias("held_treatment_complete"),
        number(goal["needs_light"]).alias("needs_light"), number(F.col("lamp_used")).alias("lamp_used"), *[number(label == p).alias(f"phase_{p}") for p in PHASES],
        number(F.coalesce(back(1) == back(2), F.lit(False))).alias("immediate_repeat"),
        number(F.coalesce((back(1) == back(3)) & (back(2) == back(4)), F.lit(False))).alias("period_two_cycle"),
    )


def route(kind: str, value: int = 1, placed: str = "placed_distinct") -> Column:
    """A router's condition on a row with ``goal``."""
    count = F.col("goal.count")
    known = {"required_count_at_least": count >= value, "repeated_goal": count > 1, "repeated_goal_partial": (count > 1) & (F.col(placed) > 0) & (F.col(placed) < count)}
    return known.get(kind, F.lit(False))


def action_context(mode: str, schema: str = "action_schema", vocabulary: str = "object_vocabulary", admissible: str = "admissible_actions") -> Column:
    """What of the action interface a mode may see, as a map of arrays."""
    if mode not in ("free_form", "schema_constrained", "oracle_admissible"):
        raise ValueError(f"unsupported action mode: {mode}")
    shown = {"free_form": [], "schema_constrained": [schema, vocabulary], "oracle_admissible": [schema, vocabulary, admissible]}[mode]
    return F.create_map(*[x for c in shown for x in (F.lit(c), F.col(c))]).cast("map<string,array<string>>")


def goal_vector(goal: str = "goal") -> Column:
    """Weights of the eight progress predicates that a goal asks for."""
    g = F.col(goal)
    return F.struct(
        F.lit(0.0).alias("target_visible"), F.lit(0.0).alias("target_acquired"), number(g["treatment"] != "").alias("treatment_satisfied"), F.lit(0.0).alias("destination_reached"),
        number(g["destination"] != "").alias("placed_fraction"), F.when(g["needs_light"], 0.35).otherwise(0.0).alias("lamp_active"), number(g["needs_light"]).alias("goal_examined"), F.lit(1.0).alias("task_complete"),
    )


PREDICATES = ("target_visible", "target_acquired", "treatment_satisfied", "destination_reached", "placed_fraction", "lamp_active", "goal_examined", "task_complete")


def progress_reward(before: str, after: str, weights: str) -> Column:
    """Weighted gains of the predicates, losses not counted; all three are structs of PREDICATES."""
    w = lambda n: F.greatest(F.lit(0.0), F.col(weights)[n])
    mass = sum((w(n) for n in PREDICATES), F.lit(0.0))
    gain = sum((F.greatest(F.lit(0.0), F.col(after)[n] - F.col(before)[n]) * w(n) for n in PREDICATES), F.lit(0.0))
    return F.when(mass > 0, gain / mass).otherwise(F.lit(0.0))


# --- filters over a state's candidates, each with the unfiltered candidates as fallback ------------------------------


def or_all(filtered: Column, everything: Column) -> Column:
    return F.when(F.size(filtered) > 0, filtered).otherwise(everything)


def goal_filter(candidates: str | Column, goal: Column, placed_ids: Column) -> Column:
    """Without takes of things that aren't the goal object or were placed already, and without moves of other things."""
    def fits(a: Column) -> Column:
        take, move = T.matched(a, "take_from", "object"), T.matched(a, "move_to", "object")
        bad_take = take.isNotNull() & ((T.entity_base(take) != goal["object"]) | F.array_contains(placed_ids, T.normalize(take)))
        return ~(bad_take | (move.isNotNull() & (T.entity_base(move) != goal["object"])))

    c = T.col(candidates)
    return F.when(goal["object"] == "", c).otherwise(or_all(F.filter(c, fits), c))


def cycle_filter(candidates: str | Column, history: str | Column, max_len: int = 6, repeats: int = 2) -> Column:
    """Without actions that would end the history in a repeated run.

    An action ends it in copies of a run of n if it is what came n actions before and the history's end repeats itself with period n. The latter doesn't depend on
    the action, so a history tells at once which actions close a run.
    """
    if repeats < 2:
        raise ValueError("repeats must be at least 2")
    c = T.col(candidates)

    def kept(h: Column) -> Column:
        size = F.size(h)

        def closing(n: int) -> Column:
            most, rest = n * repeats - 1, n * (repeats - 1) - 1
            first = F.greatest(size - most + 1, F.lit(1))
            periodic = (size >= most) & (F.slice(h, first, F.lit(rest)) == F.slice(h, first + n, F.lit(rest))) if rest else size >= most
            return F.when(periodic, F.try_element_at(h, F.lit(-n)))

        closed = F.array(*[closing(n) for n in range(1, max_len + 1)])
        ok = N.bind(closed, lambda xs: F.filter(c, lambda a: ~F.exists(xs, lambda x: x.eqNullSafe(T.normalize(a)))))
        return F.when(size == 0, c).otherwise(N.bind(ok, lambda x: or_all(x, c)))

    return N.bind(F.transform(T.col(history), lambda a: T.normalize(a)), kept)


def observable_filter(candidates: str | Column, history: str | Column) -> Column:
    """cycle_filter up to length 12; where the last twelve actions are six different ones at most, those that came twice go too."""
    recent = N.tail(F.transform(T.col(history), lambda a: T.normalize(a)), 12)

    def narrowed(both: Column) -> Column:
        kept, last = both["kept"], both["last"]
        novel = F.filter(kept, lambda a: F.size(F.filter(last, lambda r: r == T.normalize(a))) < 2)
        return F.when((F.size(last) == 12) & (F.size(F.array_distinct(last)) <= 6), N.bind(novel, lambda x: or_all(x, kept))).otherwise(kept)

    return N.bind(F.struct(cycle_filter(candidates, history, 12).alias("kept"), recent.alias("last")), narrowed)


def branch_errors(rows: DataFrame) -> DataFrame:
    """Branches (action, rollout_actions) that don't begin with their candidate or aren't one to eight steps long."""
    n = F.size("rollout_actions")
    return rows.filter((n < 1) | (n > 8) | ~F.try_element_at("rollout_actions", F.lit(1)).eqNullSafe(F.col("action")))


# --- what no built-in function computes ------------------------------------------------------------------------------


def similarity() -> Column:
    """A UDF of (proposal, action): 0.65 of the matching-block ratio plus 0.35 of the words' Jaccard; equal texts give 1."""

    @F.arrow_udf("double")
    def score(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        clean = lambda x: " ".join((x or "").lower().split())
        for left, right in pairs:
            out = []
            for a, b in zip(map(clean, left.to_pylist()), map(clean, right.to_pylist()), strict=True):
                x, y = set(a.split()), set(b.split())
                words = len(x & y) / len(x | y) if x | y else 0.0
                out.append(1.0 if a == b else 0.65 * difflib.SequenceMatcher(None, a, b).ratio() + 0.35 * words)
            yield pa.array(out, type=pa.float64())

    return score


#: Names whose buckets a Python worker remembers; it forgets them all beyond.
REMEMBERED = 200_000
_buckets: dict[tuple[str, int], int] = {}


def bucket_of(name: str, dimension: int) -> int:
    """The first eight bytes of BLAKE2b, little-endian, modulo the dimension."""
    if (name, dimension) not in _buckets:
        if len(_buckets) >= REMEMBERED:
            _buckets.clear()
        _buckets[name, dimension] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % dimension
    return _buckets[name, dimension]


def bucket(dimension: int) -> Column:
    """A UDF from feature names to buckets."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            yield pa.array([None if n is None else bucket_of(n, dimension) for n in names.to_pylist()], type=pa.int64())

    return of


def hashed(rows: DataFrame, keys: list[str], dimension: int = 4096) -> DataFrame:
    """(keys, bucket, value): features summed by bucket. Without keys each name is added up over all rows first, and hashed once."""
    long = rows.select(*keys, F.explode("features").alias("feature", "value"))
    if not keys:
        long = long.groupBy("feature").agg(F.sum("value").alias("value"))
    long = long.withColumn("bucket", bucket(dimension)("feature"))
    return long.groupBy(*keys, "bucket").agg(F.sum("value").alias("value"))
