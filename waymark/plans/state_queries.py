"""Queries over state, filters, prompts, scorers and collection, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import collection, features, history, integrity, progress, prompts, ranking, runtime, sampling, training
from . import views
from .feature_oracles import CHAIN, EFFECT, LEXICAL, TOKENS, long
from .oracles import BASIS, GOALS_LENIENT, HISTORY, PREDICATES, view
from .register import Register
from .views import SQL_CANDIDATES, SQL_EVENTS, SQL_TRAJECTORY

query = Register()
STEP = ["episode_id", "step"]
ORDER = "PARTITION BY episode_id ORDER BY step"


def before(n: int, column: str = "action"):
    """The last n values before a step, as a bounded array."""
    return F.collect_list(column).over(Window.partitionBy("episode_id").orderBy("step").rowsBetween(-n, -1))


def _trajectory(spark, sf_dir):
    return views.trajectory(spark, sf_dir)


# --- filters over candidates -------------------------------------------------------------------------------------------
# Candidates of a step: the different actions among the last twelve of its episode, by name.


def cycles(array: str, longest: int) -> str:
    """Whether an array ends with two copies of a run of at most ``longest`` elements."""
    return "(" + " OR ".join(f"(len({array}) >= {2 * n} AND {array}[-{n}:] = {array}[-{2 * n}:-{n + 1}])" for n in range(1, longest + 1)) + ")"


def last(n: int) -> str:
    return f"coalesce(list(action) OVER ({ORDER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), [])"


CANDIDATES = f"cd AS (SELECT *, list_sort(list_distinct({last(12)})) AS c, {last(24)} AS h FROM tr)"
SAID = "SELECT episode_id, step, CAST(len(c) AS BIGINT) AS n, array_to_string(kept, '|') AS kept FROM "


def _candidates(spark, sf_dir):
    t = _trajectory(spark, sf_dir).withColumns({"c": F.array_sort(F.array_distinct(before(12))), "h": before(24)})
    return t.withColumn("n", F.size("c").cast("long"))


def _said(rows, kept):
    return rows.select(*STEP, "n", F.array_join(kept, "|").alias("kept"))


@query(view(SQL_TRAJECTORY, SAID + "ob", CANDIDATES,
    f"ck AS (SELECT *, CASE WHEN len(h) = 0 THEN c ELSE list_filter(c, lambda a: NOT {cycles('list_append(h, a)', 12)}) END AS f FROM cd)",
    "cl AS (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE c END AS k1, h[-12:] AS l FROM ck)",
    "cm AS (SELECT *, list_filter(k1, lambda a: len(list_filter(l, lambda x: x = a)) < 2) AS v FROM cl)",
    "ob AS (SELECT *, CASE WHEN len(l) = 12 AND len(list_distinct(l)) <= 6 AND len(v) > 0 THEN v ELSE k1 END AS kept FROM cm)"))
def observable_candidates(spark, sf_dir):
    """Candidates without those that go round in a cycle or, where little is new, came twice."""
    rows = _candidates(spark, sf_dir)
    return _said(rows, features.observable_filter("c", "h"))


@query(view(SQL_TRAJECTORY, SAID + "cl", CANDIDATES,
    f"ck AS (SELECT *, CASE WHEN len(h) = 0 THEN c ELSE list_filter(c, lambda a: NOT {cycles('list_append(h, a)', 6)}) END AS f FROM cd)",
    "cl AS (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE c END AS kept FROM ck)"))
def cycle_filtered(spark, sf_dir):
    return _said(_candidates(spark, sf_dir), features.cycle_filter("c", "h"))


@query(view(SQL_TRAJECTORY, SAID + "gk", CANDIDATES, rf"""gf AS (SELECT *, list_filter(c, lambda a: NOT (
    (a LIKE 'take %' AND (regexp_replace(regexp_extract(a, '^take (.+?) from (.+)$', 1), '\s+\d+$', '') <> g[1] OR regexp_extract(a, '^take (.+?) from (.+)$', 1) IN ('mug 1', 'mug 2')))
    OR (a LIKE 'move %' AND regexp_replace(regexp_extract(a, '^move (.+?) to (.+)$', 1), '\s+\d+$', '') <> g[1]))) AS f
    FROM (SELECT *, list_extract({GOALS_LENIENT}, CAST(episode_id % 6 + 1 AS BIGINT)) AS g FROM cd))""",
    "gk AS (SELECT *, CASE WHEN g[1] = '' OR len(f) = 0 THEN c ELSE f END AS kept FROM gf)"))
def goal_filtered(spark, sf_dir):
    """Candidates that suit the goal, when two mugs lie where they should already."""
    placed = F.array(F.lit("mug 1"), F.lit("mug 2"))
    rows = _candidates(spark, sf_dir).withColumn("goal", T.parse_goal("instruction"))
    return _said(rows, features.goal_filter("c", F.col("goal"), placed))


ROUTES = (("at_least_two", "required_count_at_least", 2), ("repeated", "repeated_goal", 1), ("partial", "repeated_goal_partial", 1), ("unknown", "no such condition", 1))


@query(view(SQL_TRAJECTORY, "SELECT episode_id, step, g_count >= 2 AS at_least_two, g_count > 1 AS repeated, g_count > 1 AND placed_distinct > 0 AND placed_distinct < g_count AS partial, false AS unknown FROM an", *HISTORY))
def route_conditions(spark, sf_dir):
    rows = history.annotate(_trajectory(spark, sf_dir))
    return rows.select(*STEP, *[features.route(kind, n).alias(name) for name, kind, n in ROUTES])


@query(view(SQL_TRAJECTORY, """SELECT mode, count(*) AS rows, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(CASE WHEN mode = 'oracle_admissible' THEN n ELSE 0 END) AS BIGINT) AS admissible
  FROM (SELECT len(c) AS n FROM cd) CROSS JOIN (VALUES ('free_form', 0), ('schema_constrained', 2), ('oracle_admissible', 3)) m(mode, keys) GROUP BY 1""", CANDIDATES))  # fmt: skip
def action_contexts(spark, sf_dir):
    """What each mode may see of the action interface: how many fields, and how many admissible actions."""
    rows, out = _candidates(spark, sf_dir).withColumns({"s": F.array(F.lit("go to")), "v": F.array(F.lit("mug"))}), None
    for mode in ("free_form", "schema_constrained", "oracle_admissible"):
        seen = rows.select(features.action_context(mode, "s", "v", "c").alias("m"))
        got = seen.agg(F.count("*").alias("rows"), F.sum(F.size("m")).alias("keys"), F.sum(F.coalesce(F.size(F.try_element_at("m", F.lit("c"))), F.lit(0))).cast("long").alias("admissible"))
        got = got.select(F.lit(mode).alias("mode"), "rows", "keys", "admissible")
        out = got if out is None else out.unionByName(got)
    return out


@query(view(SQL_TRAJECTORY, f"""SELECT episode_id, step FROM (SELECT *, lead(action) OVER ({ORDER}) AS nxt FROM tr) WHERE step % 10 = 3 OR (step % 10 = 7 AND coalesce(nxt, '') <> action) OR step % 10 = 9"""))
def branch_protocol(spark, sf_dir):
    """Branches of which some are empty, some too long and some begin with another action."""
    w = Window.partitionBy("episode_id").orderBy("step")
    follow = F.coalesce(F.lead("action").over(w), F.lit(""))
    kind = F.col("step") % 10
    own = F.when(kind == 3, F.array().cast("array<string>")).when(kind == 7, F.array(follow)).when(kind == 9, F.array_repeat("action", 9)).otherwise(F.array("action", follow))
    return features.branch_errors(_trajectory(spark, sf_dir).withColumn("rollout_actions", own)).select(*STEP)


# --- state, memory, outcomes -------------------------------------------------------------------------------------------


def _sql_summary() -> str:
    last = "CASE WHEN coalesce(len({x}), 0) > 0 THEN {x}[-1] END"
    named = "CASE WHEN len({x}) > 0 THEN array_to_string({x}[-{n}:], ', ') ELSE 'none' END"
    return view(SQL_TRAJECTORY, f"""SELECT episode_id, step, md5('Observable state memory:' || chr(10) || '- current location: ' || coalesce({last.format(x="gone")}, 'unknown') || chr(10)
    || '- held object: ' || coalesce(nullif({last.format(x="hand")}, ''), 'none') || chr(10) || '- visited locations: ' || {named.format(x="firsts", n=12)} || chr(10)
    || '- completed treatments: ' || {named.format(x="treated", n=8)} || chr(10) || '- completed placements: ' || {named.format(x="put", n=8)} || chr(10) || '- used devices: ' || {named.format(x="used", n=8)}) AS memory_md5
  FROM (SELECT *, list_filter(gone, lambda x, i: list_position(gone, x) = i) AS firsts FROM sm)""",
        f"""sh AS (SELECT episode_id, step, coalesce(list(action) OVER ({ORDER} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), []) AS h FROM tr)""",
        r"""sm AS (SELECT *, list_transform(list_filter(h, lambda a: a LIKE 'go to %'), lambda a: substr(a, 7)) AS gone,
    list_transform(list_filter(h, lambda a: a LIKE 'take %' OR a LIKE 'move %'), lambda a: CASE WHEN a LIKE 'take %' THEN regexp_extract(a, '^take (.+?) from (.+)$', 1) ELSE '' END) AS hand,
    list_transform(list_filter(h, lambda a: a LIKE 'heat %'), lambda a: 'heat ' || regexp_extract(a, '^heat (.+?) with (.+)$', 1)) AS treated,
    list_transform(list_filter(h, lambda a: a LIKE 'move %'), lambda a: regexp_replace(a, '^move (.+?) to (.+)$', '\1 -> \2')) AS put,
    list_transform(list_filter(h, lambda a: a LIKE 'use %'), lambda a: substr(a, 5)) AS used FROM sh)""")  # fmt: skip


@query(_sql_summary())
def state_summary(spark, sf_dir):
    """The state memory's text from the last thirty actions."""
    t = prompts.remembered(_trajectory(spark, sf_dir).select(*STEP, "action"), 30)
    return t.select(*STEP, F.md5(F.col("memory").cast("binary")).alias("memory_md5"))


PROMPT = """'Task instruction:' || chr(10) || instruction || chr(10) || chr(10) || 'Previous actions:' || chr(10) || CASE WHEN len(h) > 0 THEN array_to_string(h, chr(10)) ELSE '(none)' END || chr(10) || chr(10)
  || 'Current observation:' || chr(10) || observation || chr(10) || chr(10) || 'Return the next action only.'"""
HISTORY_8 = f"ph AS (SELECT *, coalesce(list(action) OVER ({ORDER} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM tr)"


@query(view(SQL_TRAJECTORY, f"""SELECT episode_id, step, md5('You are an embodied task planner. Select the next high-level action from the text observation and action history. Output exactly one action string.') AS system_md5,
  md5({PROMPT}) AS user_md5 FROM ph""", HISTORY_8))  # fmt: skip
def next_action_prompts(spark, sf_dir):
    t = _trajectory(spark, sf_dir).select(*STEP, prompts.next_action("instruction", before(8), "observation").alias("m"))
    digest = lambda i: F.md5(F.col("m")[i]["content"].cast("binary"))
    return t.select(*STEP, digest(0).alias("system_md5"), digest(1).alias("user_md5"))


@query(view(SQL_TRAJECTORY, """SELECT episode_id, step, instruction, array_to_string(h, chr(10)) AS previous, observation, '' AS candidate FROM ph WHERE len(h) > 0""", HISTORY_8))
def prompt_sections(spark, sf_dir):
    """Prompts made and taken apart again; a next-action prompt has no candidate."""
    t = _trajectory(spark, sf_dir).withColumn("h", before(8)).filter(F.size("h") > 0)
    t = t.select(*STEP, prompts.next_action("instruction", "h", "observation")[1]["content"].alias("p"))
    return t.select(*STEP, *[T.prompt_section("p", s).alias(s) for s in ("instruction", "previous", "observation", "candidate")])


@query(view(SQL_TRAJECTORY, """SELECT episode_id, step, list_extract(h, 1) AS first_quoted, CAST(len(h) AS BIGINT) AS quoted, instruction AS goal, true AS has_state, true AS ends_well FROM (
  SELECT episode_id, step, instruction, list(action) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM tr) WHERE len(h) > 0"""))  # fmt: skip
def aligned_prompts(spark, sf_dir):
    """Prompts with examples, the last four actions quoted and the state memory of all actions before, read back by their sections."""
    t = prompts.remembered(_trajectory(spark, sf_dir)).withColumn("h", before(4)).filter(F.size("h") > 0)
    p = t.select(*STEP, prompts.aligned("instruction", "h", "observation", "Training example 1\nGoal: x", 4, state=F.col("memory"))[1]["content"].alias("p"))
    quoted = F.split(T.prompt_section("p", "previous"), "\n")
    goal = F.regexp_extract("p", r"(?s)Persistent goal:\n(.*?)\n\nCurrent observable state:", 1)
    return p.select(*STEP, quoted[0].alias("first_quoted"), F.size(quoted).cast("long").alias("quoted"), goal.alias("goal"), F.contains("p", F.lit("- held object: ")).alias("has_state"), F.endswith("p", F.lit(prompts.CHOOSE)).alias("ends_well"))


@query(view(SQL_TRAJECTORY, """SELECT event_id, 'blocked ' || lower(action) AS blocked_action, action AS required_action, 'v' || (k % 3) AS version, action AS cleaned, CAST(1 + (k % 2) AS BIGINT) AS records FROM tr"""))
def parsed_outputs(spark, sf_dir):
    """Model outputs with a reasoning block, a prefix and quotes, and contract violation records in a text."""
    t = _trajectory(spark, sf_dir)
    raw = F.concat(F.lit("<think>\nhm, x\n</think>\n\n  Next action: "), F.when(F.col("k") % 2 == 0, F.concat(F.lit('"'), "action", F.lit('"'))).otherwise(F.col("action")), F.lit("\nbecause"))
    record = F.concat(F.lit("Contract violation record: Blocked "), F.upper("action"), F.lit(" requires a thing under V"), (F.col("k") % 3).cast("string"), F.lit(". Required action: "), "action", F.lit(". "))
    text = F.concat(F.lit("Note. "), F.when(F.col("k") % 2 == 1, F.concat(record, record)).otherwise(record))
    r = t.select("event_id", T.contract_records(text).alias("r"), T.clean_output(raw).alias("cleaned"))
    return r.select("event_id", *[F.col("r")[0][c].alias(c) for c in ("blocked_action", "required_action", "version")], "cleaned", F.size("r").cast("long").alias("records"))


@query(view(SQL_CANDIDATES, """SELECT event_id, CASE WHEN k % 2 = 0 THEN string_split(episode_id, '/')[3] ELSE 'other/' || event_id END AS task, 'load(k=' || k || ',name=' || event_type || ')' AS key,
  '["' || episode_id || '",' || event_id || ',["' || event_type || '","x"]]' AS json_key, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30, least(30, trace_return)))), 9) AS sigmoid,
  CASE WHEN k <= 10 THEN '<=10' WHEN k <= 50 THEN '<=50' ELSE '>50' END AS bin FROM ca"""))  # fmt: skip
def scalar_functions(spark, sf_dir):
    """Task ids without namespace, action keys, canonical JSON keys, the clamped logistic function, bins."""
    c = views.candidates(spark, sf_dir)
    task = F.when(F.col("k") % 2 == 0, F.col("episode_id")).otherwise(F.concat(F.lit("other/"), F.col("event_id").cast("string")))
    args = F.create_map(F.lit("name"), "event_type", F.lit("k"), F.col("k").cast("string"))
    return c.select(
        "event_id", T.task_identity(task).alias("task"), T.action_key(F.lit("load"), args).alias("key"), T.canonical_key("episode_id", "event_id", F.array("event_type", F.lit("x"))).alias("json_key"),
        F.round(N.sigmoid("trace_return"), 9).alias("sigmoid"), N.bin_label("k", [10, 50]).alias("bin"),
    )


@query(view(SQL_TRAJECTORY, "SELECT DISTINCT instruction, 'shelf ' || (k % 7) AS place, e AS seen FROM tr, LATERAL (SELECT unnest(['at shelf', 'see mug']) AS e)"))
def observation_memory(spark, sf_dir):
    return collection.observation_memory(_trajectory(spark, sf_dir))


NAMES = ("target_visible", "target_acquired", "treatment_satisfied", "destination_reached", "placed_fraction", "lamp_active", "goal_examined", "task_complete")


def _sql_rollouts() -> str:
    same = " AND ".join(f"{n} IS NOT DISTINCT FROM lag({n}) OVER w" for n in NAMES)
    keys = ", ".join(NAMES)
    return view(SQL_TRAJECTORY, f"""SELECT episode_id, chunk, max(position) AS steps, round(count(*) FILTER (still AND position > 0) / CAST(greatest(max(position), 1) AS DOUBLE), 9) AS no_progress_fraction,
    bool_or(again > 1 OR run) AS cycle_detected, round(least(max(step) / 50.0::DOUBLE, 1.0::DOUBLE), 9) AS budget_pressure FROM (
    SELECT *, {cycles('acts', 6)} AS run FROM (SELECT *, {same} AS still, row_number() OVER (PARTITION BY episode_id, chunk, observation, {keys} ORDER BY position) AS again,
      coalesce(list(CASE WHEN position > 0 THEN action END) FILTER (position > 0) OVER (PARTITION BY episode_id, chunk ORDER BY position ROWS UNBOUNDED PRECEDING), []) AS acts
      FROM rt WINDOW w AS (PARTITION BY episode_id, chunk ORDER BY position))) GROUP BY 1, 2""", *HISTORY, PREDICATES,
        f"rt AS (SELECT tr.episode_id, tr.step // 9 AS chunk, tr.step % 9 AS position, tr.step, tr.action, tr.observation, {keys} FROM tr JOIN pr USING (episode_id, step))")


@query(_sql_rollouts())
def rollout_outcomes(spark, sf_dir):
    """Every nine steps of an episode as a recorded rollout: the state before, and eight steps."""
    t = _trajectory(spark, sf_dir)
    p = history.predicates(history.annotate(t)).join(t.select(*STEP, "action", "observation"), STEP)
    trace = p.withColumns({"chunk": F.floor(F.col("step") / 9), "position": F.col("step") % 9})
    r = collection.rollouts(trace, ["episode_id", "chunk"], list(NAMES))
    return r.select("episode_id", "chunk", "steps", F.round("no_progress_fraction", 9).alias("no_progress_fraction"), "cycle_detected", F.round("budget_pressure", 9).alias("budget_pressure"))


WEIGHTS = f"""gw AS (SELECT pr.*, list_extract({GOALS_LENIENT}, CAST(pr.episode_id % 6 + 1 AS BIGINT)) AS g FROM pr)"""
WEIGHTED = """gv AS (SELECT *, CAST(g[3] <> '' AS DOUBLE) AS w_treatment_satisfied, CAST(g[2] <> '' AS DOUBLE) AS w_placed_fraction, CASE WHEN g[5] THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS w_lamp_active,
  CAST(g[5] AS DOUBLE) AS w_goal_examined, 1.0::DOUBLE AS w_task_complete FROM gw)"""
WEIGHT_NAMES = ("treatment_satisfied", "placed_fraction", "lamp_active", "goal_examined", "task_complete")


@query(view(SQL_TRAJECTORY, "SELECT DISTINCT episode_id, " + ", ".join(f"w_{n} AS {n}" for n in WEIGHT_NAMES) + ", 0.0::DOUBLE AS target_visible FROM gv", *HISTORY, PREDICATES, WEIGHTS, WEIGHTED))
def goal_vectors(spark, sf_dir):
    t = _trajectory(spark, sf_dir).select("episode_id", T.parse_goal("instruction").alias("goal")).distinct()
    v = t.select("episode_id", features.goal_vector().alias("w"))
    return v.select("episode_id", *[F.col(f"w.{n}").alias(n) for n in (*WEIGHT_NAMES, "target_visible")])


@query(view(SQL_TRAJECTORY, "SELECT episode_id, step, round((" + " + ".join(f"greatest(0.0::DOUBLE, n_{n} - {n}) * w_{n}" for n in WEIGHT_NAMES) + ") / (" + " + ".join(f"w_{n}" for n in WEIGHT_NAMES) + """), 9) AS reward
  FROM (SELECT *, """ + ", ".join(f"lead({n}) OVER ({ORDER}) AS n_{n}" for n in WEIGHT_NAMES) + " FROM gv) WHERE n_task_complete IS NOT NULL", *HISTORY, PREDICATES, WEIGHTS, WEIGHTED))  # fmt: skip
def verifier_reward(spark, sf_dir):
    """The weighted gain of the predicates from each step to the next."""
    annotated = history.annotate(_trajectory(spark, sf_dir))
    w = Window.partitionBy("episode_id").orderBy("step")
    p = history.predicates(annotated).select(*STEP, F.struct(*NAMES).alias("b")).withColumn("a", F.lead("b").over(w)).filter(F.col("a").isNotNull())
    goals = annotated.select("episode_id", T.parse_goal("instruction").alias("goal")).distinct().select("episode_id", features.goal_vector().alias("w"))
    return p.join(goals, "episode_id").select(*STEP, F.round(features.progress_reward("b", "a", "w"), 9).alias("reward"))


@query("SELECT conv_id, CAST(round_even(i * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) AS position FROM (SELECT conv_id, count(*) * 7 AS n FROM conversations GROUP BY 1), range(0, 6) t(i) GROUP BY 1, 2")
def sampled_steps(spark, sf_dir):
    """Six evenly spaced positions, of as many as seven times a conversation's turns."""
    n = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 7).alias("n"))
    return n.select("conv_id", F.explode(sampling.evenly_spaced("n")).alias("position"))


@query(view(SQL_EVENTS, """SELECT event_id, coalesce(minute - last <= 120, false) AS valid FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN minute END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY minute, event_id ROWS UNBOUNDED PRECEDING) AS last FROM (SELECT *, secs // 600 AS minute FROM ev))"""))  # fmt: skip
def capture_validity(spark, sf_dir):
    """Whether a user's last signup is at most 120 units of ten minutes old."""
    e = views.events(spark, sf_dir).withColumn("minute", F.floor(F.col("secs") / 600))
    return collection.valid_since(e, "user_id", "minute", F.col("event_type") == "signup").select("event_id", "valid")


# --- scorers and priors ------------------------------------------------------------------------------------------------


@query(view(SQL_TRAJECTORY, "SELECT episode_id, step, round(coalesce(sum(contribution), 0), 6) AS prior FROM tr LEFT JOIN bc USING (episode_id, step) GROUP BY 1, 2", *HISTORY, *BASIS))
def collection_prior(spark, sf_dir):
    """The collection's points; on the released coefficients they equal the factor formula's score."""
    return collection.prior(history.annotate(_trajectory(spark, sf_dir))).select(*STEP, F.round("prior", 6).alias("prior"))


@query("SELECT * FROM (VALUES ('goal_token_exact', 4.0::DOUBLE), ('observation_token', 2.0::DOUBLE), ('entity_match', 4.0::DOUBLE), ('entity_mismatch', -4.0::DOUBLE), ('revisit_floor', -3.0::DOUBLE), ('inverse_transition', -2.0::DOUBLE), ('delivery_reference', 4.0::DOUBLE), ('multi_object_delivery', 5.0::DOUBLE), ('light_examine_ready', 5.0::DOUBLE)) t(factor, coefficient)")
def legacy_coefficients(spark, sf_dir):
    """Coefficients of the earlier generator with all parameters 1: polarity times the sum of the descriptors. Those that the SQL states by hand."""
    ones = dict.fromkeys(("bias", *progress.DESCRIPTORS), 1.0)
    stated = "goal_token_exact observation_token entity_match entity_mismatch revisit_floor inverse_transition delivery_reference multi_object_delivery light_examine_ready".split()
    own = progress.legacy_coefficients(ones)
    return spark.createDataFrame([(k, own[k]) for k in stated], "factor string, coefficient double")


def word_scorer(instruction: str, previous: list[str], observation: str, action: str) -> float:
    """A plain scorer as a plug-in: shared words with the instruction, less a tenth for each of the previous actions given."""
    return len(set(action.split()) & set(instruction.lower().replace(".", "").split())) - len(previous) / 10


@query(view(SQL_TRAJECTORY, """SELECT episode_id, step, round(len(list_intersect(list_distinct(string_split(action, ' ')), list_distinct(string_split(replace(lower(instruction), '.', ''), ' ')))) - least(step, 3) / 10.0::DOUBLE, 9) AS score
  FROM tr"""))  # fmt: skip
def registered_scorer(spark, sf_dir):
    """A Python scorer registered under a name and called from SQL."""
    runtime.register_scorer(spark, "waymark_word_score", word_scorer)
    rows = _trajectory(spark, sf_dir).withColumn("previous", before(3))
    return rows.selectExpr(*STEP, "round(waymark_word_score(instruction, previous, observation, action), 9) AS score")


@query(view(SQL_TRAJECTORY, r"""SELECT object, place, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY object), 9) AS score FROM (
  SELECT regexp_replace(regexp_extract(action, '^take (.+?) from (.+)$', 1), '\s+\d+$', '') AS object, regexp_extract(action, '^take (.+?) from (.+)$', 2) AS place, count(*) AS n FROM tr WHERE action LIKE 'take %' GROUP BY 1, 2)"""))  # fmt: skip
def object_prior(spark, sf_dir):
    """Where things are taken from, by counts divided by a thing's largest."""
    t = _trajectory(spark, sf_dir).select(T.entity_base(T.matched("action", "take_from", "object")).alias("object"), T.matched("action", "take_from", "source").alias("place"))
    n = t.filter(F.col("place").isNotNull()).groupBy("object", "place").agg(F.count("*").alias("n"))
    return features.object_affinity(n).withColumn("score", F.round("score", 9))


@query(view(SQL_CANDIDATES, """SELECT event_id, round(CASE event_type WHEN 'view' THEN a WHEN 'click' THEN 0.25::DOUBLE * a + 0.75::DOUBLE * b ELSE 0.5::DOUBLE * a + 0.5::DOUBLE * b END, 6) AS score,
  round(CASE WHEN k % 2 = 0 THEN a ELSE b END, 6) AS routed FROM (SELECT *, trace_return / 100 AS a, CAST(k AS DOUBLE) / 100 AS b FROM ca)"""))  # fmt: skip
def phase_weighted_scores(spark, sf_dir):
    """Two value models weighted by a label, and routed by a rule."""
    c = views.candidates(spark, sf_dir)
    models = {"a": F.col("trace_return") / 100, "b": F.col("k").cast("double") / 100}
    weighted = ranking.by_phase(F.col("event_type"), models, {"view": {"a": 1.0}, "click": {"a": 0.25, "b": 0.75}}, {"a": 0.5, "b": 0.5})
    return c.select("event_id", F.round(weighted, 6).alias("score"), F.round(ranking.routed(models["a"], models["b"], F.col("k") % 2 == 0), 6).alias("routed"))


def _sql_memory() -> str:
    on, to = "o = g_obj", r"regexp_replace(tgt, '\s+\d+$', '')"
    at_goal = f"(g_dest <> '' AND contains({to}, g_dest))"
    visits = lambda most: f"least(greatest(visits, 1), {most})"
    ending = "CASE WHEN g_treat <> '' THEN NOT (b_holding_target AND NOT b_target_treated) AND b_target_treated ELSE NOT g_light AND b_holding_target END"
    search = (
        f"CASE WHEN go AND NOT b_holding_target THEN CASE WHEN NOT known AND visits = 0 THEN 0.35::DOUBLE WHEN known AND NOT shown THEN -0.55::DOUBLE * {visits(3)} ELSE 0 END ELSE 0 END",
        f"CASE WHEN schema = 'take_from' AND held = '' THEN CASE WHEN {on} THEN 0.75::DOUBLE ELSE -2.5::DOUBLE END ELSE 0 END",
        "CASE WHEN g_light AND b_holding_target THEN CASE WHEN schema = 'use' AND contains(o, 'lamp') THEN 2 WHEN schema IN ('move_to', 'take_from') THEN -2 ELSE 0 END ELSE 0 END",
        f"CASE WHEN g_treat <> '' AND schema = 'treatment' THEN CASE WHEN {on} AND verb = g_treat THEN 2.5::DOUBLE ELSE -2.5::DOUBLE END ELSE 0 END",
        f"CASE WHEN g_treat <> '' AND b_holding_target AND NOT b_target_treated THEN CASE WHEN go AND {to} = CASE g_treat WHEN 'clean' THEN 'sinkbasin' WHEN 'cool' THEN 'fridge' ELSE 'microwave' END THEN 2 WHEN schema = 'move_to' THEN -2 ELSE 0 END ELSE 0 END",
        f"CASE WHEN schema = 'move_to' AND {ending} THEN CASE WHEN {on} AND {at_goal} THEN 2.5::DOUBLE ELSE -1 END ELSE 0 END",
        f"CASE WHEN g_count > 1 AND schema = 'take_from' AND {on} THEN CASE WHEN list_contains(coalesce(b_mvo, []), obj) THEN -2 ELSE 1 END ELSE 0 END",
        f"CASE WHEN g_count > 1 AND NOT b_target_placed AND go AND NOT b_holding_target AND {at_goal} THEN -2 ELSE 0 END",
    )
    role = (
        f"CASE WHEN schema = 'treatment' AND b_target_treated AND {on} THEN -4 ELSE 0 END", "CASE WHEN g_count > 1 AND schema = 'take_from' AND list_contains(coalesce(b_mvo, []), obj) THEN -4 ELSE 0 END",
        f"CASE WHEN go AND NOT b_holding_target AND {at_goal} AND known AND NOT shown THEN -2.5::DOUBLE * {visits(2)} ELSE 0 END",
        f"CASE WHEN go AND g_light AND b_holding_target THEN CASE WHEN known AND NOT lamp THEN -3.0::DOUBLE * {visits(2)} WHEN NOT known AND visits = 0 THEN 0.25::DOUBLE ELSE 0 END ELSE 0 END",
    )
    return view(SQL_TRAJECTORY, f"SELECT episode_id, step, round({' + '.join(search)}, 6) AS search, round({' + '.join(role)}, 6) AS role FROM mm", *CHAIN,
        """mo AS (SELECT episode_id, step, list('shelf ' || (k % 7)) OVER (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS been_at FROM tr)""",
        "mm AS (SELECT tn.*, list_contains(been_at, tgt) AS known, false AS shown, false AS lamp FROM tn JOIN mo USING (episode_id, step))")


@query(_sql_memory())
def memory_scores(spark, sf_dir):
    """Search recovery and role calibration from what observations showed at each place. The view's observations name no goal object and no lamp."""
    t = features.with_memory(features.transition(features.entity_state(_trajectory(spark, sf_dir))))
    return features.memory_scores(t).select(*STEP, F.round("search", 6).alias("search"), F.round("role", 6).alias("role"))


RECORDED = """rc AS (SELECT *, CASE k % 3 WHEN 0 THEN observation || ' Contract violation record: ' || was || ' requires x under V1. Required action: ' || action || '. Contract violation record: ' || action || ' requires x under V1. Required action: ' || coalesce(was, 'look') || '.'
  ELSE observation END AS said FROM (SELECT *, coalesce(lag(action) OVER (PARTITION BY episode_id ORDER BY step), 'look') AS was, coalesce(list(action) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h,
    ['pick_and_place_simple', 'look_at_obj_in_light', 'pick_two_obj_and_place', 'pick_heat_then_place_in_recep', 'pick_clean_then_place_in_recep', 'pick_cool_then_place_in_recep'][CAST(episode_id % 6 + 1 AS BIGINT)] AS fam,
    string_split(action, ' ')[1] AS verb FROM tr))"""
# Two records: the first asks for this action and blocks the last one, the second asks for the last one, which was done unless there is none, and blocks this one.
CONTRACT = """ct AS (SELECT episode_id, step, unnest(list_concat(['has_contract_record'],
    CASE WHEN list_contains(h, action) THEN ['contract_required_action_satisfied', 'contract_required_action_satisfied|verb=' || verb]
      ELSE ['contract_required_verb=' || verb, 'contract_required_action_exact', 'contract_required_action_exact|verb=' || verb, CASE WHEN verb = 'examine' THEN 'contract_required_examine_target' END,
        CASE WHEN action = was THEN 'contract_blocked_action_exact' END, CASE WHEN action = was THEN 'contract_blocked_action_exact|verb=' || verb END] END,
    CASE WHEN list_contains(h, was) THEN ['contract_required_action_satisfied', 'contract_required_action_satisfied|verb=' || string_split(was, ' ')[1]]
      ELSE ['contract_required_verb=' || string_split(was, ' ')[1], 'contract_blocked_action_exact', 'contract_blocked_action_exact|verb=' || verb] END)) AS feature FROM rc WHERE k % 3 = 0)"""


def _sql_bag() -> str:
    from .oracles import words

    return view(SQL_TRAJECTORY, """SELECT episode_id, step, feature, round(sum(v), 9) AS value FROM (SELECT episode_id, step, feature, 1.0::DOUBLE AS v FROM ct UNION ALL SELECT episode_id, step, unnest(f), 1.0::DOUBLE FROM bg
    UNION ALL SELECT episode_id, step, 'goal_overlap_count', least(len(list_filter(aw, lambda t: list_contains(gw, t))), 6) / 6.0::DOUBLE FROM bw
    UNION ALL SELECT episode_id, step, 'observation_overlap_count', least(len(list_filter(aw, lambda t: list_contains(ow, t))), 6) / 6.0::DOUBLE FROM bw) WHERE feature IS NOT NULL AND v <> 0 GROUP BY 1, 2, 3""",
        RECORDED, CONTRACT, f"""bw AS (SELECT *, {words('action')} AS aw, {words("substr(instruction, 18)")} AS gw, {words('said')} AS ow FROM rc)""",
        """bg AS (SELECT episode_id, step, list_concat(['bias', 'family=' || fam, 'verb=' || verb, 'family=' || fam || '|verb=' || verb, 'action=' || action, 'action_len_bin=' || least(len(aw), 8),
      CASE WHEN list_contains(h[-4:], action) THEN 'repeat_recent_action' END, CASE WHEN list_contains(h[-4:], action) THEN 'repeat_recent_action|verb=' || verb END,
      CASE WHEN len(h) > 0 THEN 'last_verb=' || string_split(was, ' ')[1] || '|current_verb=' || verb END, CASE WHEN contains(action, 'lamp') THEN 'mentions_lamp' END,
      CASE verb WHEN 'take' THEN 'schema=take_from' WHEN 'move' THEN 'schema=move_to' WHEN 'go' THEN 'schema=go_to' WHEN 'heat' THEN 'schema=treatment' END],
      list_transform(aw, lambda t: 'action_token=' || t), list_transform(aw, lambda t: CASE WHEN list_contains(gw, t) THEN 'goal_action_token=' || t END),
      list_transform(aw, lambda t: CASE WHEN list_contains(gw, t) THEN 'family=' || fam || '|goal_action_token=' || t END), list_transform(aw, lambda t: CASE WHEN list_contains(ow, t) THEN 'obs_action_token=' || t END)) AS f FROM bw)""")  # fmt: skip


def _recorded(spark, sf_dir):
    w = Window.partitionBy("episode_id").orderBy("step")
    t = _trajectory(spark, sf_dir).withColumns({"recent": before(8), "was": F.coalesce(F.lag("action").over(w), F.lit("look")), "family": T.family_budget("instruction")})
    record = lambda blocked, asked: F.concat(F.lit(" Contract violation record: "), blocked, F.lit(" requires x under V1. Required action: "), asked, F.lit("."))
    said = F.concat("observation", record(F.col("was"), F.col("action")), record(F.col("action"), F.col("was")))
    return t.withColumn("observation", F.when(F.col("k") % 3 == 0, said).otherwise(F.col("observation")))


@query(_sql_bag())
def legacy_bag_features(spark, sf_dir):
    f = _recorded(spark, sf_dir).select(*STEP, F.explode(features.bag_features()).alias("feature", "value"))
    return f.withColumn("value", F.round("value", 9))


@query(view(SQL_TRAJECTORY, "SELECT episode_id, step, feature, CAST(count(*) AS DOUBLE) AS value FROM (SELECT episode_id, step, feature FROM ct UNION ALL SELECT episode_id, step, 'bias' FROM rc) WHERE feature IS NOT NULL GROUP BY 1, 2, 3", RECORDED, CONTRACT))
def legacy_contract_features(spark, sf_dir):
    return _recorded(spark, sf_dir).select(*STEP, F.explode(features.contract_features()).alias("feature", "value"))


# --- pair views ----------------------------------------------------------------------------------------------------------


def _sql_difference(name: str, source: str) -> str:
    """Features of a step (source at step) less those of the step before; differences of 0 go where the earlier step has the name."""
    return f"""{name} AS (SELECT episode_id, step, feature, sum(v) AS value FROM (SELECT episode_id, step, feature, value AS v, 0 AS neg FROM {source} WHERE step > 0
  UNION ALL SELECT episode_id, step + 1, feature, -value, 1 FROM {source}) WHERE (episode_id, step) IN (SELECT episode_id, step FROM tr WHERE step > 0)
  GROUP BY 1, 2, 3 HAVING max(neg) = 0 OR abs(sum(v)) >= 1e-12)"""


@query(view(SQL_TRAJECTORY, "SELECT episode_id, step, feature, round(value, 9) AS value FROM di", *CHAIN, long("ef", EFFECT), _sql_difference("di", "ef")))
def pair_view_difference(spark, sf_dir):
    """Effect features of each action less those of the action before it."""
    t = features.transition(features.entity_state(_trajectory(spark, sf_dir)))
    w = Window.partitionBy("episode_id").orderBy("step")
    f = t.select(*STEP, features.effect_features(t).alias("f")).withColumn("n", F.lag("f").over(w)).filter(F.col("n").isNotNull())
    return f.select(*STEP, F.explode(features.pair_difference("f", "n")).alias("feature", "value")).withColumn("value", F.round("value", 9))


@query(view(SQL_TRAJECTORY, """SELECT episode_id, step, feature, round(value, 9) AS value FROM ef WHERE step > 0
  UNION ALL SELECT episode_id, step, feature, round(value, 9) FROM di WHERE abs(value) >= 1e-12""", *CHAIN, TOKENS, long("ef", EFFECT), long("le", LEXICAL, "tk"), _sql_difference("di", "le")))  # fmt: skip
def pair_rebuilt(spark, sf_dir):
    """Stored features with stale lexical entries, which are replaced by new differences; the rest stays."""
    t = features.transition(features.entity_state(_trajectory(spark, sf_dir)))
    w = Window.partitionBy("episode_id").orderBy("step")
    f = t.select(*STEP, features.effect_features(t).alias("e"), features.lexical_features().alias("l")).withColumn("n", F.lag("l").over(w)).filter(F.col("n").isNotNull())
    stale = F.map_concat("e", F.create_map(F.lit("lex:old"), F.lit(1.0), F.lit("sem:old"), F.lit(2.0)))
    return f.select(*STEP, F.explode(features.rebuilt(stale, features.pair_difference("l", "n"))).alias("feature", "value")).withColumn("value", F.round("value", 9))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'agv.place' END, CASE WHEN o_orderkey % 3 = 0 THEN 'robot.held' END, CASE WHEN o_orderkey % 5 = 0 THEN 'samples.gone' END],
  lambda x: x IS NOT NULL), ',') AS paths, NOT (o_orderkey % 2 = 0) AS idle FROM orders""")  # fmt: skip
def state_changes(spark, sf_dir):
    """Paths at which two flattened states differ, and whether two states agree but for the clock."""
    k = F.col("o_orderkey")
    put = lambda c, name, x, y: (F.lit(name), F.when(c, y).otherwise(x))
    same = {"agv.place": "IR", "robot.held": "none"}
    was = F.map_concat(F.create_map(*[F.lit(x) for kv in same.items() for x in kv]), F.when(k % 5 == 0, F.create_map(F.lit("samples.gone"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    now = F.create_map(*put(k % 2 == 0, "agv.place", F.lit("IR"), F.lit("SHELF")), *put(k % 3 == 0, "robot.held", F.lit("none"), F.lit("V1")))
    state = lambda place, minute: F.struct(place.alias("place"), minute.alias("minute"))
    idle = integrity.same_but(state(F.lit("IR"), k), state(F.when(k % 2 == 0, "SHELF").otherwise("IR"), k + 1), "minute")
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", was.alias("was"), now.alias("now"), idle.alias("idle"))
    return o.select("o_orderkey", F.array_join(integrity.changed_paths("was", "now"), ",").alias("paths"), "idle")


# --- attempts, training --------------------------------------------------------------------------------------------------


def flaky(row: dict, attempt: int) -> float:
    """Fails at first for every seventh event and for good for every fourteenth."""
    if row["event_id"] % 7 == 0 and (attempt == 0 or row["event_id"] % 14 == 0):
        raise ValueError(f"try {attempt}")
    return row["value"]


@query("""SELECT event_id, CASE WHEN event_id % 14 = 0 THEN NULL ELSE round(value, 6) END AS result, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS tries,
  CASE WHEN event_id % 14 = 0 THEN 'ValueError: try 0|ValueError: try 1' WHEN event_id % 7 = 0 THEN 'ValueError: try 0' ELSE '' END AS errors FROM events""")  # fmt: skip
def attempted_rows(spark, sf_dir):
    a = collection.attempts(views.table(spark, sf_dir, "events").select("event_id", "value"), flaky)
    return a.select("event_id", F.round("result", 6).alias("result"), "tries", F.array_join("errors", "|").alias("errors"))


@query("SELECT event_id, 'ValueError: try 0' AS first_error, 'ValueError: try 1' AS retry_error FROM events WHERE event_id % 14 = 0")
def collection_failures(spark, sf_dir):
    a = collection.attempts(views.table(spark, sf_dir, "events").select("event_id", "value"), flaky)
    return collection.failures(a).select("event_id", F.col("errors")[0].alias("first_error"), F.col("errors")[1].alias("retry_error"))


def _nation_pairs(spark, sf_dir):
    """One training pair for each nation: a table of the same rows at every scale."""
    n = views.table(spark, sf_dir, "nation")
    f = F.create_map(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")), F.lit(1.0), F.lit("bias"), F.lit(0.5), F.lit("key"), (F.col("n_nationkey") % 5 - 2).cast("double"))
    return n.select(F.lit("m").alias("model"), F.col("n_nationkey").cast("long").alias("pair_id"), f.alias("features"), (F.lit(1.0) + F.col("n_nationkey") / 25).alias("weight"))


def sgd_sql(rate: float, adagrad: bool, epochs: int = 2, seed: int = 23, rows: int = 25, l2: float = 1e-4) -> str:
    """The ranker's steps as a recursive query. The order of pairs is the cumulative shuffle of the seeded generator; weights go over seven features."""
    import random

    rng, order, steps = random.Random(seed), list(range(rows)), []
    for _ in range(epochs):
        rng.shuffle(order)
        steps += order
    names = ["bias", "key", *[f"region_{i}" for i in range(5)]]
    x = "[0.5::DOUBLE, CAST(n_nationkey % 5 - 2 AS DOUBLE), " + ", ".join(f"CASE WHEN n_regionkey = {i} THEN 1.0::DOUBLE END" for i in range(5)) + "]"
    margin = "list_sum(list_transform(range(1, 8), lambda j: coalesce(x[j], 0) * w[j]))"
    slope = f"((1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, {margin})))) - 1.0::DOUBLE) * sw)"
    grad = f"({slope} * x[j] + {l2!r}::DOUBLE * w[j])"
    seen = f"list_transform(range(1, 8), lambda j: CASE WHEN x[j] IS NULL THEN s[j] ELSE s[j] + {grad} * {grad} END)"
    move = f"{rate!r}::DOUBLE * {grad}" + (f" / sqrt(s[j] + {grad} * {grad})" if adagrad else "")
    return f"""WITH RECURSIVE od AS (SELECT unnest({steps}) AS r, unnest(range(1, {len(steps) + 1})) AS i),
pr AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r, {x} AS x, 1.0::DOUBLE + n_nationkey / 25.0::DOUBLE AS sw FROM nation),
st AS (SELECT i, x, sw FROM od JOIN pr USING (r)),
go AS (SELECT CAST(0 AS BIGINT) AS i, list_transform(range(1, 8), lambda j: 0.0::DOUBLE) AS w, list_transform(range(1, 8), lambda j: 1e-8::DOUBLE) AS s
  UNION ALL SELECT CAST(st.i AS BIGINT), list_transform(range(1, 8), lambda j: CASE WHEN x[j] IS NULL THEN w[j] ELSE w[j] - {move} END), {seen} FROM go JOIN st ON st.i = go.i + 1)
SELECT 'm' AS model, unnest({names}) AS feature, round(unnest(w), 9) AS weight FROM go WHERE i = {len(steps)}"""


@query(sgd_sql(0.08, False))
def ranker_sgd_steps(spark, sf_dir):
    return training.train(_nation_pairs(spark, sf_dir), epochs=2).withColumn("weight", F.round("weight", 9))


@query(sgd_sql(0.05, True))
def ranker_adagrad_steps(spark, sf_dir):
    return training.train(_nation_pairs(spark, sf_dir), epochs=2, rate=0.05, adagrad=True).withColumn("weight", F.round("weight", 9))


def rounds_sql(rate: float, adagrad: bool, rounds: int, l2: float = 1e-4) -> str:
    """Rounds of mean gradients over all vectors, one pair of tables a round."""
    move = f"{rate!r}::DOUBLE * g" + (" / sqrt(s + g * g)" if adagrad else "")
    out = """WITH ro AS MATERIALIZED (SELECT row_number() OVER () AS r, 'label_' || CAST(label % 4 AS VARCHAR) AS model, embedding AS v, 1.0::DOUBLE + vec_id % 3 AS sw FROM embeddings WHERE label IS NOT NULL),
en AS MATERIALIZED (SELECT r, model, sw, unnest(v)::DOUBLE AS x, unnest(range(len(v))) AS p FROM ro), tt AS (SELECT model, sum(sw) AS t FROM ro GROUP BY 1),
w0 AS (SELECT model, p, 0.0::DOUBLE AS w, 1e-8::DOUBLE AS s FROM en GROUP BY 1, 2)"""
    for i in range(rounds):
        out += f""",
m{i} AS MATERIALIZED (SELECT r, (1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, sum(w * x))))) - 1.0::DOUBLE) * any_value(sw) AS d FROM en JOIN w{i} USING (model, p) GROUP BY 1),
g{i} AS (SELECT model, p, w, s, h / t + {l2!r}::DOUBLE * w AS g FROM (SELECT model, p, sum(d * x) AS h FROM en JOIN m{i} USING (r) GROUP BY 1, 2) JOIN w{i} USING (model, p) JOIN tt USING (model)),
w{i + 1} AS MATERIALIZED (SELECT model, p, w - {move} AS w, s + g * g AS s FROM g{i})"""
    return out + f"\nSELECT model, printf('f%02d', p) AS feature, round(w, 9) AS weight FROM w{rounds}"


def _vector_pairs(spark, sf_dir):
    """A training pair for each vector with a label; models are labels by fours, one of which holds three tenths of all pairs, and every pair has every feature."""
    e = views.table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull())
    entries = F.transform("embedding", lambda x, i: F.struct(F.format_string("f%02d", i), x.cast("double")))
    return e.select(F.concat(F.lit("label_"), (F.col("label") % 4).cast("string")).alias("model"), F.map_from_entries(entries).alias("features"), (F.lit(1.0) + F.col("vec_id") % 3).alias("weight"))


@query(rounds_sql(0.8, False, 4))
def train_ranker_rounds(spark, sf_dir):
    """Rankers of four models by rounds over all their pairs."""
    return training.train_rounds(_vector_pairs(spark, sf_dir), 4, 0.8).withColumn("weight", F.round("weight", 9))


@query(rounds_sql(0.05, True, 3))
def train_ranker_adagrad_rounds(spark, sf_dir):
    return training.train_rounds(_vector_pairs(spark, sf_dir), 3, 0.05, adagrad=True).withColumn("weight", F.round("weight", 9))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS pair_id, CAST(CASE WHEN n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_nationkey % 2 = 1) THEN 7 ELSE 3 END AS BIGINT) AS features,
  CAST(CASE WHEN n_nationkey % 5 = 2 THEN 2 ELSE 3 END AS BIGINT) AS nonzero FROM nation WHERE n_nationkey % 2 = 1""")
def frozen_namespace(spark, sf_dir):
    """Half of the pairs, with the first one's features padded to all names."""
    p = _nation_pairs(spark, sf_dir)
    f = training.frozen_namespace(p.filter(F.col("pair_id") % 2 == 1), p)
    return f.select("pair_id", F.size("features").cast("long").alias("features"), F.size(F.filter(F.map_values("features"), lambda v: v != 0)).cast("long").alias("nonzero"))


@query("SELECT step FROM (SELECT n_nationkey * 10 AS step, n_regionkey % 3 AS success, CAST(20 - n_nationkey % 4 AS DOUBLE) AS average_steps FROM nation) ORDER BY success DESC, average_steps, step LIMIT 1")
def checkpoint_choice(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 10).alias("step"), (F.col("n_regionkey") % 3).alias("success"), (F.lit(20.0) - F.col("n_nationkey") % 4).alias("average_steps"))
    return training.best_checkpoint(n)

