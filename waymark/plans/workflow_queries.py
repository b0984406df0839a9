"""Queries over the laboratory workflow, beside SQL that says what plans, states and candidates must be like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.progress import scales
from ..workflow import cases, lab, roles
from .oracles import CASES
from .register import Register

query = Register()


@query("""SELECT name, domain, CAST(cost AS DOUBLE) AS cost, parameter FROM (
  SELECT 'move_agv_to_' || x AS name, 'agv' AS domain, 2 AS cost, '' AS parameter FROM (VALUES ('shelf'), ('prep'), ('ir'), ('standby')) t(x)
  UNION ALL SELECT x, 'agv', 2, CASE x WHEN 'load_raw_from_shelf' THEN 'sample_id' ELSE '' END FROM (VALUES ('load_raw_from_shelf'), ('unload_raw_to_prep'), ('load_prepared_from_prep'), ('unload_prepared_to_A'),
    ('unload_prepared_to_B'), ('load_characterized_from_A'), ('load_characterized_from_B'), ('unload_characterized_to_shelf')) t(x)
  UNION ALL SELECT x, 'ir_robot', c, '' FROM (VALUES ('pick_mold_from_A', 2), ('pick_mold_from_B', 2), ('switch_grip_side_at_A', 3), ('switch_grip_side_at_B', 3), ('place_mold_to_A', 2), ('place_mold_to_B', 2), ('return_to_wait_loading', 1)) t(x, c)
  UNION ALL SELECT 'measure_site_' || i, 'ir_robot', 4, '' FROM range(1, 7) t(i)
  UNION ALL SELECT x, 'software', c, p FROM (VALUES ('run_background_capture', 3, ''), ('select_protocol', 1, 'protocol'), ('configure_sample_metadata', 1, 'sample_id'), ('save_measurement_result', 2, ''), ('verify_result_file', 1, ''), ('poll_measurement_complete', 1, '')) t(x, c, p)
  UNION ALL SELECT 'run_preparation_recipe', 'prep', 5, '')""")  # fmt: skip
def skill_catalog(spark, sf_dir):
    return spark.createDataFrame([(k.name, k.domain, float(k.cost), k.parameter) for k in lab.SKILLS.values()], "name string, domain string, cost double, parameter string")


@query("""SELECT * FROM (VALUES ('alf_one_step', false, false, true), ('alf_aligned', false, false, false), ('portable_weak', false, false, false), ('workstation_resource_alignment', true, false, true),
  ('workstation_full', true, true, true)) t(profile, resource_alignment, short_horizon, penalize_neutral)""")  # fmt: skip
def structural_profiles(spark, sf_dir):
    rows = [(k, v["resources"], v["horizon"] > 0, v["neutral_is_risk"]) for k, v in roles.PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, resource_alignment boolean, short_horizon boolean, penalize_neutral boolean")


STARTS = f"""WITH {CASES}, ss AS (SELECT *, CASE WHEN scope = 'recovery' THEN recovery ELSE scope END AS kind FROM cs),
bg AS (SELECT *, CASE kind WHEN 'full_cycle' THEN variant % 20 WHEN 'ir_only' THEN variant % 40 WHEN 'prep_to_ir' THEN variant % 30 ELSE variant END AS minute,
  CASE kind WHEN 'ir_only' THEN CASE WHEN variant % 3 = 0 THEN 'IR' ELSE 'STANDBY' END WHEN 'prep_to_ir' THEN CASE WHEN variant % 2 = 1 THEN 'PREP' ELSE 'STANDBY' END WHEN 'raw_on_agv' THEN 'SHELF'
    WHEN 'prepared_on_agv' THEN 'PREP' WHEN 'running_measurement' THEN 'IR' ELSE 'STANDBY' END AS agv,
  CASE WHEN kind IN ('prep_to_ir', 'prep_ready') THEN 'READY' ELSE 'EMPTY' END AS prep,
  CASE WHEN scope = 'recovery' THEN kind = 'running_measurement' ELSE variant % 2 = 1 END AS background, CASE WHEN scope = 'recovery' THEN kind = 'running_measurement' ELSE variant % 3 = 2 END AS protocol,
  CASE kind WHEN 'full_cycle' THEN CASE n_samples WHEN 2 THEN 'RAW@SHELF_RAW,RAW@SHELF_RAW' ELSE 'RAW@SHELF_RAW' END WHEN 'ir_only' THEN CASE n_samples WHEN 2 THEN 'PREPARED@TRANSFER_A,PREPARED@TRANSFER_B' ELSE 'PREPARED@TRANSFER_A' END
    WHEN 'prep_to_ir' THEN CASE n_samples WHEN 2 THEN 'PREPARED@PREP,RAW@SHELF_RAW' ELSE 'PREPARED@PREP' END WHEN 'raw_on_agv' THEN 'RAW@AGV' WHEN 'prep_ready' THEN 'PREPARED@PREP'
    WHEN 'prepared_on_agv' THEN 'PREPARED@AGV' WHEN 'running_measurement' THEN 'PREPARED@ROBOT' ELSE 'CHARACTERIZED@TRANSFER_A' END AS samples FROM ss)"""


@query(STARTS + """SELECT episode_id, split, scope, CAST(minute AS BIGINT) AS minute, agv, prep, background, protocol, samples, CAST(29 + 3 * n_samples AS BIGINT) AS candidates, CAST(0 AS BIGINT) AS violations FROM bg""")
def workflow_starts(spark, sf_dir):
    """Initial states: clock, docks, samples, how many candidate actions there are (29 skills without argument, two by sample, one by protocol), broken invariants (none)."""
    return cases.starts(cases.cases(spark))


SITES = "CASE {p} WHEN 'front' THEN 3 WHEN 'sparse' THEN 2 WHEN 'back' THEN 5 ELSE 6 END"
FLIPS = "CASE WHEN {p} IN ('back', 'full') THEN 1 ELSE 0 END"
FIRST, SECOND = "string_split(pattern, '_')[1]", "string_split(pattern, '_')[2]"


@query(f"""WITH {CASES} SELECT episode_id, true AS completed,
  CAST(CASE recovery WHEN 'running_measurement' THEN 1 WHEN 'characterized_at_slot' THEN 0 ELSE {SITES.format(p=FIRST)} + CASE WHEN n_samples = 2 THEN {SITES.format(p=SECOND)} ELSE 0 END END AS BIGINT) AS measured,
  CAST(recovery = 'running_measurement' AS BIGINT) AS polled, CAST({FLIPS.format(p=FIRST)} + CASE WHEN n_samples = 2 THEN {FLIPS.format(p=SECOND)} ELSE 0 END AS BIGINT) AS flipped,
  CAST(CASE recovery WHEN 'characterized_at_slot' THEN 0 ELSE n_samples END AS BIGINT) AS saved, CAST(CASE recovery WHEN 'characterized_at_slot' THEN 0 ELSE n_samples END AS BIGINT) AS verified,
  CAST(CASE WHEN store THEN n_samples ELSE 0 END AS BIGINT) AS stored, CAST(CASE scope WHEN 'full_cycle' THEN n_samples WHEN 'prep_to_ir' THEN n_samples - 1 ELSE CAST(recovery = 'raw_on_agv' AS INT) END AS BIGINT) AS prepared,
  CAST(CASE recovery WHEN 'characterized_at_slot' THEN 0 ELSE n_samples END AS BIGINT) AS placed, CAST(0 AS BIGINT) AS violations FROM cs""")  # fmt: skip
def workflow_plan_effects(spark, sf_dir):
    """Every plan reaches its goal without a broken invariant, and measures, flips, saves, prepares and stores just what its case needs."""
    return cases.plan_effects(cases.cases(spark))


@query(f"""WITH {CASES} SELECT episode_id, CAST(CASE recovery WHEN 'characterized_at_slot' THEN 5 ELSE 6 END AS BIGINT) AS states, CAST(0 AS BIGINT) AS without_expert, CAST(0 AS BIGINT) AS illegal_expert,
  CAST(0 AS BIGINT) AS legal_with_errors, CAST(0 AS BIGINT) AS illegal_without_errors FROM cs""")  # fmt: skip
def workflow_decisions(spark, sf_dir):
    """Feedback states of every case: six at most, one expert action in each, which is legal; legal are the candidates without errors."""
    f = cases.feedback(cases.cases(spark))
    per = f.groupBy("episode_id", "step_index").agg(
        F.count_if("is_expert").alias("experts"), F.count_if(F.col("is_expert") & ~F.col("legal")).alias("bad"), F.count_if(F.col("legal") & (F.col("n_errors") > 0)).alias("a"), F.count_if(~F.col("legal") & (F.col("n_errors") == 0)).alias("b")
    )
    return per.groupBy("episode_id").agg(F.count("*").alias("states"), F.count_if(F.col("experts") != 1).alias("without_expert"), F.sum("bad").alias("illegal_expert"), F.sum("a").alias("legal_with_errors"), F.sum("b").alias("illegal_without_errors"))


@query("SELECT CAST(0 AS BIGINT) AS not_worse, CAST(0 AS BIGINT) AS same_action, CAST(0 AS BIGINT) AS several_best, true AS some")
def workflow_pair_check(spark, sf_dir):
    """Preference pairs: the negative is idle or leaves more to do, is another action, and a state has one best action."""
    p = cases.pairs(cases.cases(spark))
    worse = F.col("negative_idempotent") | (F.col("negative_remaining") > F.col("positive_remaining"))
    state = p.groupBy("episode_id", "step_index").agg(F.count_distinct("positive_action").alias("best"), F.count_if(~worse).alias("bad"), F.count_if(F.col("positive_action") == F.col("negative_action")).alias("same"))
    return state.agg(F.sum("bad").alias("not_worse"), F.sum("same").alias("same_action"), F.count_if(F.col("best") > 1).alias("several_best"), (F.count("*") > 0).alias("some"))


@query("SELECT CAST(0 AS BIGINT) AS wrong_scores, CAST(0 AS BIGINT) AS wrong_interactions, CAST(0 AS BIGINT) AS wrong_gains, CAST(0 AS BIGINT) AS zeros, true AS some")
def workflow_formula_check(spark, sf_dir):
    """Candidate features: the structural score is the formula over the roles, interactions repeat the roles by domain, the gain is the sum of four roles, nothing is stored as 0."""
    f = cases.candidate_features(cases.cases(spark))
    scale = scales()
    points = {f"role:{name}": sign * scale[s] for name, (sign, s) in roles.ROLES.items()}
    gains = [f"role:{k}" for k in ("goal_completion", "lifecycle_progress", "readiness_progress", "entity_priority_binding")]
    at = lambda name: F.coalesce(F.sum(F.when(F.col("feature") == name, F.col("value"))), F.lit(0.0))
    role = F.regexp_extract("feature", r"^interaction:[a-z_]+:(.*)$", 1)
    per = f.groupBy("episode_id", "step_index", "action").agg(
        (at("structural") - sum((at(k) * F.lit(v) for k, v in points.items()), F.lit(0.0))).alias("score"), (at("semantic_progress_delta") - sum(map(at, gains), F.lit(0.0))).alias("gain"),
        (F.sum(F.when(role != "", F.col("value") * (F.length(role) + 1)).otherwise(0.0)) - F.sum(F.when(F.col("feature").startswith("role:"), F.col("value") * (F.length("feature") - 4)).otherwise(0.0))).alias("inter"),
        F.count_if((F.col("value") == 0) & (F.col("feature") != "structural")).alias("zeros"),
    )
    far = lambda c: F.count_if(F.abs(c) > 1e-9)
    return per.agg(far("score").alias("wrong_scores"), far("inter").alias("wrong_interactions"), far("gain").alias("wrong_gains"), F.sum("zeros").alias("zeros"), (F.count("*") > 0).alias("some"))


@query(f"""WITH {CASES} SELECT episode_id, 'goal,legal_actions,recent_actions,state,task' AS keys, true AS canonical, true AS answer_is_legal, true AS history_bounded, signature AS task FROM cs""")
def workflow_prompts(spark, sf_dir):
    """Prompts of every plan's steps: their keys, in order and without blanks; the answer is one of the legal actions; eight actions of history at most."""
    p = cases.prompts(cases.cases(spark))
    user = F.from_json("user", "goal string, legal_actions array<string>, recent_actions array<string>, state string, task string")
    keys = F.array_join(F.json_object_keys("user"), ",")
    per = p.select("episode_id", keys.alias("k"), user.alias("u"), "answer", F.col("user").startswith('{"goal":{"').alias("tight"))
    return per.groupBy("episode_id").agg(
        F.max("k").alias("keys"), F.bool_and("tight").alias("canonical"), F.bool_and(F.array_contains("u.legal_actions", F.col("answer"))).alias("answer_is_legal"),
        F.bool_and(F.size("u.recent_actions") <= 8).alias("history_bounded"), F.max("u.task").alias("task"),
    )


EVALUATED = ("seen_test", "compositional_unseen", "recovery_test")


@query(f"""WITH {CASES} SELECT v.variant, split, count(*) AS episodes, count(*) AS ended, CASE v.variant WHEN 'actor' THEN count(*) END AS actor_successes FROM cs
  CROSS JOIN (VALUES ('actor'), ('actor_structural'), ('actor_residual'), ('full')) v(variant) WHERE split <> 'train' GROUP BY 1, 2""")  # fmt: skip
def workflow_variants(spark, sf_dir):
    """The four variants of the closed loop over the three test splits: every run ends by a known reason, and the stand-in actor alone follows the planner to each goal."""
    own = cases.cases(spark).filter(F.col("split").isin(*EVALUATED))
    runs = [cases.closed_loop(own, variant=v).withColumn("variant", F.lit(v)) for v in cases.VARIANTS]
    known = F.col("reason").isin("goal", "budget", "stagnation", "cycle", "stuck")
    got = reduce(DataFrame.unionByName, runs).groupBy("variant", "split").agg(F.count("*").alias("episodes"), F.count_if(known).alias("ended"), F.count_if("success").alias("successes"))
    return got.select("variant", "split", "episodes", "ended", F.when(F.col("variant") == "actor", F.col("successes")).alias("actor_successes"))


@query(STARTS + """, al AS (SELECT 'split' AS section, split AS name FROM bg UNION ALL SELECT 'scope', scope FROM bg UNION ALL SELECT 'initial_agv', agv FROM bg
  UNION ALL SELECT 'initial_stage', string_split(s, '@')[1] FROM (SELECT unnest(string_split(samples, ',')) AS s FROM bg) UNION ALL SELECT 'lifecycle', 'full_cycle' FROM bg WHERE scope = 'full_cycle' AND store)
SELECT section, name, count(*) AS value FROM al GROUP BY 1, 2 UNION ALL SELECT 'leakage', 'shared_signatures', count(*) FROM (
  SELECT signature FROM cs WHERE split IN ('train', 'compositional_unseen') GROUP BY 1 HAVING count(DISTINCT split) > 1)""")  # fmt: skip
def workflow_release_report(spark, sf_dir):
    return cases.release_report(cases.cases(spark))
