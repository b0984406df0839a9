"""The queries as SQL over the driver's tables, written independently of the DataFrame plans."""

from __future__ import annotations

from ..functions.text import ACTION_STOPWORDS, TOKEN_STOPWORDS
from ..operators.progress import FACTORS, coefficients
from ..workflow.cases import SPLITS
from .views import SQL_CANDIDATES, SQL_EVENTS, SQL_RUNS, SQL_STRATA, SQL_TRAJECTORY, SQL_VECTORS

ORACLE: dict[str, str] = {}


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def base(x: str) -> str:
    return rf"regexp_replace({norm(x)}, '\s+\d+$', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+'), lambda w: NOT list_contains({quoted(ACTION_STOPWORDS)}, w))"


def ids(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '\d+', ' ', 'g'), '[a-z][a-z0-9_-]*'), lambda w: NOT list_contains({quoted(TOKEN_STOPWORDS)}, w) AND length(w) > 1))"


def view(cte: str, select: str, *more: str) -> str:
    return "WITH " + ",\n".join([cte.strip(), *more]) + "\n" + select


PAIR_STEPS = [
    """ra AS (SELECT *, row_number() OVER (PARTITION BY episode_id, step_index, success
      ORDER BY CASE WHEN success THEN -trace_return ELSE trace_return END, action) AS rank FROM ca)""",
    "ke AS (SELECT * FROM ra WHERE rank <= CASE WHEN success THEN 4 ELSE 8 END)",
    """pa AS (SELECT p.episode_id, p.step_index, p.action AS positive_action, n.action AS negative_action, p.trace_return AS positive_return,
      n.trace_return AS negative_return, 1.0::DOUBLE / count(*) OVER (PARTITION BY p.episode_id, p.step_index) AS weight,
      CASE WHEN substr(sha1(p.episode_id), 1, 16) < 'cccccccccccccc00' THEN 'train' ELSE 'holdout' END AS split
      FROM ke p JOIN ke n ON p.episode_id = n.episode_id AND p.step_index = n.step_index AND p.success AND NOT n.success)""",
]
ORACLE["pair_accuracy_by_group"] = view(SQL_CANDIDATES, """
SELECT split, step_index, count(*) AS pairs, count(*) FILTER (positive_return > negative_return) AS correct,
  round(avg(CAST(positive_return > negative_return AS DOUBLE)), 6) AS accuracy, round(sum(weight), 6) AS weight FROM pa GROUP BY 1, 2""", *PAIR_STEPS)  # fmt: skip
ORACLE["pair_build"] = view(SQL_CANDIDATES, "SELECT * FROM pa", *PAIR_STEPS)
ORACLE["pair_weights"] = view(SQL_CANDIDATES, "SELECT episode_id, step_index, round(sum(weight), 9) AS total, count(*) AS pairs FROM pa GROUP BY 1, 2", *PAIR_STEPS)
ORACLE["pair_stats"] = view(SQL_CANDIDATES, """
SELECT CAST(sum(p + n) AS BIGINT) AS candidate_rows, count(*) AS state_groups, count(*) FILTER (p > 0 AND n > 0) AS groups_with_both_outcomes,
  CAST(sum(p) AS BIGINT) AS positive_rows, CAST(sum(n) AS BIGINT) AS negative_rows
FROM (SELECT count(*) FILTER (success) AS p, count(*) FILTER (NOT success) AS n FROM ca GROUP BY episode_id, step_index)""")  # fmt: skip
ORACLE["pair_best_against_worse"] = view(SQL_CANDIDATES, """
SELECT f.episode_id, f.step_index, b.action AS positive_action, f.action AS negative_action, b.remaining AS positive_remaining,
  f.remaining AS negative_remaining, f.idempotent AS negative_idempotent
FROM fe f JOIN (SELECT * FROM fe WHERE remaining IS NOT NULL AND NOT idempotent
  QUALIFY row_number() OVER (PARTITION BY episode_id, step_index ORDER BY remaining, action) = 1) b USING (episode_id, step_index)
WHERE f.action <> b.action AND (f.idempotent OR f.remaining > b.remaining)""",
    "fe AS (SELECT episode_id, step_index, action, CASE WHEN k % 11 <> 0 THEN k END AS remaining, k % 13 = 0 AS idempotent FROM ca)")
ORACLE["hash_fold_split"] = "SELECT o_orderkey, substr(sha1('alfworld/train/' || o_orderkey), 1, 16) < 'cccccccccccccc00' AS train FROM orders"
ORACLE["mod5_holdout"] = """SELECT o_orderkey, list_sum(list_transform(string_split(sha256(CAST(o_orderkey AS VARCHAR)), ''),
  lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0 AS holdout FROM orders"""

ORACLE["normalize_text"] = f"SELECT doc_id, md5({norm('text')}) AS normal_md5 FROM documents"
ORACLE["word_tokens"] = view(SQL_TRAJECTORY, f"""SELECT event_id, array_to_string({words('action')}, ' ') AS words,
  (SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(string_split(replace({norm('observation')}, '.', ''), ' ')) AS w,
    generate_subscripts(string_split(replace({norm('observation')}, '.', ''), ' '), 1) AS p) WHERE w <> '' GROUP BY w)) AS raw FROM tr""")  # fmt: skip
ORACLE["id_tokens"] = f"SELECT item_id, array_to_string(list_sort({ids('text')}), ' ') AS tokens FROM benchmark"
ORACLE["entity_base"] = view(SQL_TRAJECTORY, f"SELECT event_id, {base('action')} AS base, CASE WHEN strpos({norm('action')}, ' ') > 0 THEN regexp_replace({norm('action')}, ' [^ ]*$', '') ELSE {norm('action')} END AS dropped FROM tr")
ORACLE["parse_action"] = view(SQL_TRAJECTORY, r"""
SELECT event_id, schema,
  CASE WHEN schema = 'treatment' THEN regexp_extract(a, '^(\w+)', 1) ELSE string_split(a, ' ')[1] END AS verb,
  CASE schema WHEN 'take_from' THEN regexp_extract(a, '^take (.+?) from (.+)$', 1) WHEN 'move_to' THEN regexp_extract(a, '^move (.+?) to (.+)$', 1)
    WHEN 'treatment' THEN regexp_extract(a, '^\w+ (.+?) with (.+)$', 1) WHEN 'use_with' THEN regexp_extract(a, '^use (.+?) with (.+)$', 1)
    WHEN 'go_to' THEN '' WHEN 'other' THEN a ELSE regexp_extract(a, '^\w+ (.+)$', 1) END AS object,
  CASE WHEN schema = 'take_from' THEN regexp_extract(a, '^take (.+?) from (.+)$', 2) ELSE '' END AS source,
  CASE schema WHEN 'move_to' THEN regexp_extract(a, '^move (.+?) to (.+)$', 2) WHEN 'go_to' THEN regexp_extract(a, '^go to (.+)$', 1) ELSE '' END AS target,
  CASE schema WHEN 'treatment' THEN regexp_extract(a, ' with (.+)$', 1) WHEN 'use_with' THEN regexp_extract(a, ' with (.+)$', 1) ELSE '' END AS tool
FROM sc""", r"""sc AS (SELECT event_id, action AS a, CASE WHEN regexp_matches(action, '^take .+ from .+$') THEN 'take_from' WHEN regexp_matches(action, '^move .+ to .+$') THEN 'move_to'
  WHEN action LIKE 'go to %' THEN 'go_to' WHEN regexp_matches(action, '^(clean|cool|heat) .+ with .+$') THEN 'treatment'
  WHEN regexp_matches(action, '^use .+ with .+$') THEN 'use_with' WHEN action LIKE 'open %' THEN 'open' WHEN action LIKE 'close %' THEN 'close'
  WHEN action LIKE 'examine %' THEN 'examine' WHEN action LIKE 'use %' THEN 'use' ELSE 'other' END AS schema FROM tr)""")  # fmt: skip

#: The six goals' meaning, stated by hand for either dialect.
GOALS_LENIENT = "[('mug', 'desk', '', 1, false), ('mug', '', '', 1, true), ('mug', 'desk', '', 2, false), ('mug', 'desk', 'heat', 1, false), ('mug', 'shelf', 'clean', 1, false), ('mug', 'desk', 'cool', 1, false)]"
GOALS_STRICT = "[('mug', 'desk', '', 1, false), ('mug', '', '', 1, true), ('mug', 'desk', '', 2, false), ('mug', 'the', 'heat', 1, false), ('mug', 'shelf', 'clean', 1, false), ('mug', 'a', 'cool', 1, false)]"


def goal_rows(goals: str) -> str:
    return f"""SELECT episode_id, g[1] AS object, g[2] AS destination, g[3] AS treatment, CAST(g[4] AS BIGINT) AS count, g[5] AS needs_light
FROM (SELECT DISTINCT user_id AS episode_id, list_extract({goals}, CAST(user_id % 6 + 1 AS BIGINT)) AS g FROM events)"""


ORACLE["parse_goal_lenient"], ORACLE["parse_goal_strict"] = goal_rows(GOALS_LENIENT), goal_rows(GOALS_STRICT)
ORACLE["task_family"] = """
SELECT DISTINCT user_id AS episode_id,
  ['pick_and_place_simple', 'look_at_obj_in_light', 'pick_two_obj_and_place', 'pick_heat_then_place_in_recep', 'pick_clean_then_place_in_recep', 'pick_cool_then_place_in_recep'][CAST(user_id % 6 + 1 AS BIGINT)] AS budget_family,
  ['pick_and_place_simple', 'look_at_obj_in_light', 'pick_two_obj_and_place', 'pick_heat_then_place_in_recep', 'pick_clean_then_place_in_recep', 'pick_cool_then_place_in_recep'][CAST(user_id % 6 + 1 AS BIGINT)] AS prompt_family
FROM events"""
ORACLE["observation_entities"] = view(SQL_TRAJECTORY, "SELECT event_id, CASE WHEN 'mug ' || (k % 9) < 'shelf' THEN 'at shelf ' || (k % 7) || ',see mug ' || (k % 9) END AS entities, 'shelf ' || (k % 7) AS place FROM tr")
ORACLE["lexical_overlap"] = f"""
WITH g AS (SELECT row_number() OVER (ORDER BY item_id) AS r, {ids('text')} AS goal FROM benchmark),
d AS (SELECT doc_id, {ids('text')} AS own, doc_id % (SELECT count(*) FROM benchmark) + 1 AS r FROM documents),
j AS (SELECT doc_id, CAST(len(own) AS BIGINT) AS tokens, len(goal) AS goals, len(list_intersect(own, goal)) AS common FROM d JOIN g USING (r))
SELECT doc_id, CASE WHEN tokens + goals - common > 0 THEN round(CAST(common AS DOUBLE) / (tokens + goals - common), 9) ELSE 0.0::DOUBLE END AS jaccard,
  CASE WHEN goals > 0 THEN round(CAST(common AS DOUBLE) / goals, 9) ELSE 0.0::DOUBLE END AS coverage, tokens FROM j"""

HISTORY = [
    rf"""gl AS (SELECT *, list_extract({GOALS_LENIENT}, CAST(episode_id % 6 + 1 AS BIGINT)) AS g FROM tr)""",
    r"""pt AS (SELECT *, g[1] AS g_obj, g[2] AS g_dest, g[3] AS g_treat, g[4] AS g_count, g[5] AS g_light,
  nullif(regexp_extract(action, '^take (.+?) from (.+)$', 1), '') AS t_obj, nullif(regexp_extract(action, '^take (.+?) from (.+)$', 2), '') AS t_src,
  nullif(regexp_extract(action, '^move (.+?) to (.+)$', 1), '') AS m_obj, nullif(regexp_extract(action, '^move (.+?) to (.+)$', 2), '') AS m_dst,
  nullif(regexp_extract(action, '^go to (.+)$', 1), '') AS go, nullif(regexp_extract(action, '^examine (.+)$', 1), '') AS ex FROM gl)""",
    r"""sg AS (SELECT *, coalesce(go, ex) AS tgt, count(t_obj) OVER e AS seg,
  coalesce(m_obj IS NOT NULL AND g_obj <> '' AND g_dest <> '' AND regexp_replace(m_obj, '\s+\d+$', '') = g_obj AND contains(m_dst, g_dest), false) AS put
  FROM pt WINDOW e AS (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING))""",
    r"""hf AS (SELECT *, first_value(t_obj) OVER s AS picked FROM sg WINDOW s AS (PARTITION BY episode_id, seg ORDER BY step ROWS UNBOUNDED PRECEDING))""",
    r"""ha AS (SELECT *, CASE WHEN NOT coalesce(bool_or(regexp_replace(m_obj, '\s+\d+$', '') = regexp_replace(picked, '\s+\d+$', '')) OVER s, false) THEN picked END AS held_after
  FROM hf WINDOW s AS (PARTITION BY episode_id, seg ORDER BY step ROWS UNBOUNDED PRECEDING))""",
    r"""lo AS (SELECT *, last_value(go IGNORE NULLS) OVER e AS loc_after, lag(held_after) OVER o AS held_object, last_value(go IGNORE NULLS) OVER b AS current_location,
  coalesce(bool_or(action LIKE 'use desklamp%') OVER b, false) AS lamp_used,
  g_treat = '' OR g_obj = '' OR coalesce(bool_or(starts_with(action, g_treat || ' ' || g_obj)) OVER b, false) AS treatment_done,
  count(*) FILTER (put) OVER b AS placed_count,
  CASE WHEN tgt IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY episode_id, tgt ORDER BY step) - 1 END AS visits,
  coalesce(lag(action, 1) OVER o = action, false) OR coalesce(lag(action, 2) OVER o = action, false) OR coalesce(lag(action, 3) OVER o = action, false) OR coalesce(lag(action, 4) OVER o = action, false) AS recent_repeat,
  coalesce((lag(t_obj) OVER o = m_obj AND lag(t_src) OVER o = m_dst) OR (lag(m_obj) OVER o = t_obj AND lag(m_dst) OVER o = t_src), false) AS inverse_transition,
  len(list_distinct(list(action) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))) AS six,
  least(step, 6) AS of_six,
  len(list_distinct(list(CASE WHEN put THEN m_obj END) OVER b)) AS pd,
  coalesce(bool_or(regexp_replace(ex, '\s+\d+$', '') = g_obj) OVER b, false) AS examined_goal,
  coalesce(bool_or(regexp_replace(t_obj, '\s+\d+$', '') = g_obj) OVER b, false) AS acquired_goal
  FROM ha WINDOW e AS (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY episode_id ORDER BY step),
    b AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    r"""fl AS (SELECT episode_id, min(step) AS lamp_step, arg_min(coalesce(loc_after, ''), step) AS lamp_loc FROM lo WHERE action LIKE 'use desklamp%' GROUP BY 1)""",
    r"""an AS (SELECT lo.*, CASE WHEN lo.step > fl.lamp_step THEN nullif(fl.lamp_loc, '') END AS lamp_location, coalesce(pd, 0) AS placed_distinct,
  CASE WHEN of_six > 0 THEN CAST(six AS DOUBLE) / of_six ELSE 1.0::DOUBLE END AS unique_ratio FROM lo LEFT JOIN fl USING (episode_id))""",
]
ORACLE["history_state"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, held_object, current_location, lamp_location, lamp_used, treatment_done FROM an", *HISTORY)
ORACLE["visit_counts"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, tgt AS target_location, CAST(visits AS BIGINT) AS visits, placed_count, CAST(placed_distinct AS BIGINT) AS placed_distinct FROM an", *HISTORY)
ORACLE["repetition_flags"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, recent_repeat, inverse_transition, round(unique_ratio, 9) AS unique_ratio FROM an", *HISTORY)
ORACLE["cycle_flags"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, " + " OR ".join(
    "(len(a) >= {n2} AND a[-{n}:] = a[-{n2}:-{n1}])".format(n=n, n2=2 * n, n1=n + 1) for n in range(1, 7)) + """ AS cycle
FROM (SELECT episode_id, step, list(event_type) OVER (PARTITION BY episode_id ORDER BY step ROWS 11 PRECEDING) AS a FROM tr)""")  # fmt: skip
ORACLE["stagnation_runs"] = view(SQL_TRAJECTORY, """SELECT episode_id, min(step) AS start_step, count(*) AS run_length, event_type AS state
FROM (SELECT *, step - row_number() OVER (PARTITION BY episode_id, event_type ORDER BY step) AS island FROM tr) GROUP BY episode_id, event_type, island""")  # fmt: skip
PREDICATES = r"""pr AS (SELECT episode_id, step,
  CAST(g_obj <> '' AND regexp_matches(lower(observation), '\b' || g_obj || '\s+\d+\b') AS DOUBLE) AS target_visible, CAST(acquired_goal AS DOUBLE) AS target_acquired,
  CAST(treatment_done AS DOUBLE) AS treatment_satisfied, CAST(coalesce(g_dest <> '' AND contains(current_location, g_dest), false) AS DOUBLE) AS destination_reached,
  CAST(least(g_count, placed_distinct) AS DOUBLE) / g_count AS placed_fraction, CAST(lamp_used AS DOUBLE) AS lamp_active,
  CAST(examined_goal OR (g_light AND lamp_used AND acquired_goal) AS DOUBLE) AS goal_examined,
  CAST(CASE WHEN g_light THEN lamp_used AND (examined_goal OR acquired_goal) ELSE placed_distinct >= g_count AND treatment_done END AS DOUBLE) AS task_complete FROM an)"""
ORACLE["progress_predicates"] = view(SQL_TRAJECTORY, "SELECT * FROM pr", *HISTORY, PREDICATES)
ORACLE["phase_label"] = view(SQL_TRAJECTORY, r"""SELECT episode_id, step, CASE WHEN g_light THEN CASE WHEN lamp_used AND examined_goal THEN 'complete' WHEN lamp_used THEN 'examine' ELSE 'illuminate' END
  WHEN placed_distinct >= g_count THEN 'complete' WHEN held_object IS NOT NULL AND regexp_replace(held_object, '\s+\d+$', '') = g_obj THEN
    CASE WHEN g_treat <> '' AND NOT treatment_done THEN 'treat' ELSE 'deliver' END ELSE 'acquire' END AS phase FROM an""", *HISTORY)  # fmt: skip
ORACLE["discounted_return"] = view(SQL_TRAJECTORY, """SELECT episode_id, round(sum(pow(0.9::DOUBLE, step) * r), 6) AS value, count(*) AS steps FROM (
  SELECT episode_id, step, greatest(0.0::DOUBLE, lead(v) OVER (PARTITION BY episode_id ORDER BY step) - v) - 0.01::DOUBLE AS r,
    lead(v) OVER (PARTITION BY episode_id ORDER BY step) AS nv FROM (SELECT *, 0.5::DOUBLE * placed_fraction + 0.5::DOUBLE * target_acquired AS v FROM pr))
WHERE nv IS NOT NULL GROUP BY 1""", *HISTORY, PREDICATES)  # fmt: skip

ORACLE["contract_scales"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in (("exact_evidence", 2), ("partial_evidence", 1.25), ("weak_evidence", 0.5), ("entity_binding", 6), ("workflow_progress", 3), ("prerequisite_risk", 4), ("cycle_cost", 1))) + ") t(scale, units)"
COEFFICIENTS = "co AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{g}', {coefficients()[n]!r}::DOUBLE)" for n, g, *_ in FACTORS) + ") t(factor, factor_group, coefficient))"
ORACLE["factor_coefficients"] = f"WITH {COEFFICIENTS} SELECT factor, factor_group, round(coefficient, 9) AS coefficient FROM co"
IN_ACTION = "(g_dest <> '' AND contains(action, g_dest))"
ON_TARGET = "coalesce(abase = g_obj, false)"
BASIS_CASES = {
    "goal_token_exact": "len(list_filter(aw, lambda t: list_contains(gw, t)))",
    "goal_token_partial": "len(list_filter(aw, lambda t: NOT list_contains(gw, t) AND len(list_filter(gw, lambda q: contains(q, t))) > 0))",
    "observation_token": "len(list_filter(aw, lambda t: list_contains(ow, t)))",
    "take_schema": "CAST(starts_with(action, 'take ') AS INT)",
    "introspection_schema": "CAST(action IN ('look', 'inventory') AS INT)",
    "revisit_unit": "CASE WHEN held_object IS NULL AND tgt IS NOT NULL THEN least(visits, 3) ELSE 0 END",
    "entity_match": f"CAST(g_obj <> '' AND {ON_TARGET} AS INT)",
    "entity_mismatch": f"CAST(g_obj <> '' AND abase IS NOT NULL AND NOT {ON_TARGET} AS INT)",
    "entity_mention": "CAST(g_obj <> '' AND abase IS NULL AND contains(action, g_obj) AS INT)",
    "visible_target_take": f"CAST(vis AND held_object IS NULL AND t_obj IS NOT NULL AND {ON_TARGET} AS INT)",
    "visible_target_navigation": "CAST(vis AND held_object IS NULL AND go IS NOT NULL AS INT)",
    "delivery_action": f"CAST({IN_ACTION} AND m_obj IS NOT NULL AND {ON_TARGET} AS INT)",
    "delivery_navigation_ready": f"CAST({IN_ACTION} AND go IS NOT NULL AND holds AND treatment_done AS INT)",
    "delivery_navigation_unready": f"CAST({IN_ACTION} AND go IS NOT NULL AND NOT (holds AND treatment_done) AS INT)",
    "delivery_reference": f"CAST({IN_ACTION} AND go IS NULL AND NOT (m_obj IS NOT NULL AND {ON_TARGET}) AS INT)",
    "treatment_navigation_held": "CAST(at_tool AND holds AS INT)",
    "treatment_navigation_unheld": "CAST(at_tool AND NOT holds AS INT)",
    "premature_delivery": f"CAST(g_treat <> '' AND g_obj <> '' AND NOT treatment_done AND m_obj IS NOT NULL AND {ON_TARGET} AND {IN_ACTION} AS INT)",
    "light_repeat": "CAST(g_light AND action LIKE 'use %desklamp%' AND lamp_used AS INT)",
    "light_first_use": "CAST(g_light AND action LIKE 'use %desklamp%' AND NOT lamp_used AS INT)",
    "light_examine": "CAST(g_light AND ex IS NOT NULL AND g_obj <> '' AND contains(action, g_obj) AS INT)",
    "light_examine_ready": "CAST(g_light AND ex IS NOT NULL AND g_obj <> '' AND contains(action, g_obj) AND lamp_used AND holds AND current_location IS NOT DISTINCT FROM lamp_location AS INT)",
    "light_navigation": "CAST(g_light AND lamp_used AND holds AND coalesce(go = lamp_location, false) AS INT)",
    "light_premature_move": f"CAST(g_light AND lamp_used AND holds AND lamp_location IS NOT NULL AND m_obj IS NOT NULL AND {ON_TARGET} AS INT)",
    "multi_object_delivery": f"CAST(g_count > 1 AND placed_count < g_count AND m_obj IS NOT NULL AND {ON_TARGET} AND {IN_ACTION} AS INT)",
    "multi_object_acquisition": f"CAST(g_count > 1 AND placed_count < g_count AND t_obj IS NOT NULL AND {ON_TARGET} AS INT)",
    "recent_repeat": "CAST(recent_repeat AS INT)",
    "inverse_transition": "CAST(inverse_transition AS INT)",
}
BASIS = [
    COEFFICIENTS,
    rf"""bx AS (SELECT *, {words('action')} AS aw, list_distinct({words("substr(instruction, 18)")}) AS gw, list_distinct({words('observation')}) AS ow,
  regexp_replace(coalesce(t_obj, m_obj), '\s+\d+$', '') AS abase, coalesce(regexp_replace(held_object, '\s+\d+$', '') = g_obj, false) AND g_obj <> '' AS holds,
  g_obj <> '' AND regexp_matches(lower(observation), '\b' || g_obj || '\s+\d+\b') AS vis,
  g_treat <> '' AND g_obj <> '' AND NOT treatment_done AND go IS NOT NULL AND contains(action, CASE g_treat WHEN 'clean' THEN 'sinkbasin' WHEN 'cool' THEN 'fridge' ELSE 'microwave' END) AS at_tool FROM an)""",
    "bl AS (" + "\nUNION ALL ".join(f"SELECT episode_id, step, '{n}' AS factor, CAST({e} AS DOUBLE) AS value FROM bx" for n, e in BASIS_CASES.items()) + ")",
    "bc AS (SELECT episode_id, step, factor, factor_group, value, value * coefficient AS contribution FROM bl JOIN co USING (factor) WHERE value <> 0)",
]
ORACLE["factor_basis"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, factor, value, round(contribution, 6) AS contribution FROM bc", *HISTORY, *BASIS)
ORACLE["factor_groups"] = view(SQL_TRAJECTORY, "SELECT factor_group, count(*) AS n, round(sum(contribution), 4) AS total FROM bc GROUP BY 1", *HISTORY, *BASIS)
ORACLE["factor_ablation"] = view(SQL_TRAJECTORY, """SELECT tr.episode_id, tr.step, round(coalesce(sum(contribution), 0), 6) AS score,
  round(coalesce(sum(contribution) FILTER (factor_group NOT IN ('entity_binding', 'cycle_avoidance')), 0), 6) AS without
FROM tr LEFT JOIN bc USING (episode_id, step) GROUP BY 1, 2""", *HISTORY, *BASIS)  # fmt: skip

BUDGET = "bu AS (SELECT family, key, row_number() OVER (PARTITION BY family ORDER BY sha256('17:' || key), key) AS r, count(*) OVER (PARTITION BY family) AS n FROM st)"
for percent in (25, 50, 75):
    ORACLE[f"budget_states_{percent}"] = view(SQL_STRATA, f"SELECT family, key FROM bu WHERE r <= greatest(1, round_even(n * {percent} / 100.0, 0))", BUDGET)
ORACLE["budget_nesting"] = view(SQL_STRATA, """SELECT family, count(*) FILTER (r <= greatest(1, round_even(n * 25 / 100.0, 0))) AS n25,
  count(*) FILTER (r <= greatest(1, round_even(n * 50 / 100.0, 0))) AS n50, count(*) FILTER (r <= greatest(1, round_even(n * 75 / 100.0, 0))) AS n75,
  CAST(0 AS BIGINT) AS lost25, CAST(0 AS BIGINT) AS lost50 FROM bu GROUP BY 1""", BUDGET)  # fmt: skip
ORACLE["balanced_take"] = view(SQL_STRATA, """SELECT family, key, turn FROM (SELECT family, key, row_number() OVER (PARTITION BY family ORDER BY sha256(CAST(key AS VARCHAR)), key) AS turn FROM st)
ORDER BY turn, sha256(family), family LIMIT 137""")  # fmt: skip
ORACLE["balanced_limit"] = view(SQL_STRATA, "SELECT family, key, turn FROM (SELECT family, key, row_number() OVER (PARTITION BY family ORDER BY key) AS turn FROM st) ORDER BY turn, family LIMIT 61")
ORACLE["compact_topk"] = view(SQL_CANDIDATES, """SELECT episode_id, step_index, action, kind, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id, step_index, kind ORDER BY CASE kind WHEN 'legal_counterfactual' THEN rem WHEN 'illegal_counterfactual' THEN k % 5 END NULLS LAST, action) AS rank
  FROM (SELECT *, CASE WHEN k % 7 <> 0 THEN k END AS rem, CASE event_type WHEN 'signup' THEN 'expert' WHEN 'error' THEN 'illegal_counterfactual' ELSE 'legal_counterfactual' END AS kind FROM ca))
WHERE kind = 'expert' OR rank <= 2""")  # fmt: skip
ORACLE["candidate_select"] = view(SQL_TRAJECTORY, """SELECT state, action, place FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY CASE WHEN n <= 8 THEN action WHEN lead = 1 THEN '0' ELSE '1' END,
    CASE WHEN n <= 8 THEN action WHEN lead = 1 THEN schema ELSE sha1('candidate|0|' || action) END, action) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY state, schema ORDER BY action) AS lead, count(*) OVER (PARTITION BY state) AS n
    FROM (SELECT DISTINCT episode_id AS state, action, string_split(action, ' ')[1] AS schema FROM tr)))
WHERE place <= 8""")  # fmt: skip
ORACLE["shortlist"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, action, value, row_number() OVER (PARTITION BY episode_id ORDER BY value DESC, step) AS place FROM tr QUALIFY place <= 16")

Z = "CASE WHEN stddev_pop({x}) OVER s < 1e-8 THEN 0.0::DOUBLE ELSE ({x} - avg({x}) OVER s) / stddev_pop({x}) OVER s END"
M = "CASE WHEN max(abs({x})) OVER s < 1e-8 THEN 0.0::DOUBLE ELSE {x} / max(abs({x})) OVER s END"
STATE = "WINDOW s AS (PARTITION BY episode_id, step_index)"
ORACLE["group_standardize"] = view(SQL_CANDIDATES, f"SELECT event_id, round({Z.format(x='trace_return')}, 6) AS z FROM ca {STATE}")
ORACLE["signed_max_scale"] = view(SQL_CANDIDATES, f"SELECT event_id, round({M.format(x='trace_return')}, 9) AS scaled FROM ca {STATE}")
ORACLE["fuse_argmax"] = view(SQL_CANDIDATES, """SELECT episode_id, step_index, action, fused FROM fu QUALIFY row_number() OVER (PARTITION BY episode_id, step_index ORDER BY fused DESC, action DESC) = 1""",
    f"fu AS (SELECT episode_id, step_index, action, round(trace_return + 0.25::DOUBLE * {M.format(x='CAST(k AS DOUBLE)')} + 0.25::DOUBLE * {Z.format(x='CAST(k % 17 AS DOUBLE)')}, 6) AS fused FROM ca {STATE})")
ORACLE["softmax_topk"] = view(SQL_CANDIDATES, """SELECT event_id, place, round(e / sum(e) OVER (PARTITION BY episode_id, step_index), 6) AS share FROM (
  SELECT *, exp((trace_return - max(trace_return) OVER s) / 10.0::DOUBLE) AS e, row_number() OVER (PARTITION BY episode_id, step_index ORDER BY trace_return DESC, action) AS place
  FROM ca WINDOW s AS (PARTITION BY episode_id, step_index)) WHERE place <= 3""")  # fmt: skip
SCORED = "sv AS (SELECT vec_id, label, sum(x * w) AS margin FROM ve GROUP BY 1, 2)"
ORACLE["ranker_score"] = view(SQL_VECTORS, "SELECT vec_id, label, round(margin, 6) AS margin, round(2.0::DOUBLE * tanh(margin / 2.0::DOUBLE), 6) AS score FROM sv", SCORED)
ORACLE["pair_accuracy_by_source"] = view(SQL_VECTORS, "SELECT label, count(*) AS pairs, count(*) FILTER (round(margin, 9) > 0) AS correct FROM sv GROUP BY 1", SCORED)
ORACLE["sparse_diff"] = view(SQL_RUNS, """SELECT * FROM (
  SELECT task_family, 'sum' AS feature, CAST(coalesce(sum(steps) FILTER (variant = 'candidate'), 0) - coalesce(sum(steps) FILTER (variant = 'reference'), 0) AS DOUBLE) AS value FROM ru GROUP BY 1
  UNION ALL SELECT task_family, 'max', CAST(coalesce(max(steps) FILTER (variant = 'candidate'), 0) - coalesce(max(steps) FILTER (variant = 'reference'), 0) AS DOUBLE) FROM ru GROUP BY 1) WHERE value <> 0""")  # fmt: skip

ORACLE["summary_rollup"] = view(SQL_RUNS, """SELECT CASE WHEN grouping(variant) = 0 THEN 'variant' WHEN grouping(task_family) = 0 THEN 'family' ELSE 'overall' END AS level, variant, task_family,
  count(*) AS episodes, count(*) FILTER (success) AS successes, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, CAST(sum(steps) AS BIGINT) AS step_count,
  round(avg(steps), 6) AS average_steps, CAST(sum(invalid) AS BIGINT) AS invalid_actions, round(CAST(sum(invalid) AS DOUBLE) / CAST(sum(steps) AS DOUBLE), 6) AS invalid_rate
FROM ru GROUP BY GROUPING SETS ((), (variant), (task_family))""")  # fmt: skip
PAIRED = [
    """bo AS (SELECT episode_id, task_family, bool_or(success) FILTER (variant = 'reference') AS bs, bool_or(success) FILTER (variant = 'candidate') AS ns,
  max(steps) FILTER (variant = 'reference') AS b, max(steps) FILTER (variant = 'candidate') AS n FROM ru GROUP BY 1, 2)""",
    "pd AS (SELECT *, CAST(ns AS BIGINT) - CAST(bs AS BIGINT) AS sd, n - b AS td FROM bo WHERE b IS NOT NULL AND n IS NOT NULL)",
]
EXACT = """least(1.0::DOUBLE, 2.0::DOUBLE * list_sum(list_transform(range(0, least(recovered, regressed) + 1),
  lambda i: exp(lgamma(recovered + regressed + 1) - lgamma(i + 1) - lgamma(recovered + regressed - i + 1) - (recovered + regressed) * ln(2.0::DOUBLE)))))"""
SUMMARY = """count(*) AS episodes, count(*) FILTER (bs) AS reference_success, count(*) FILTER (ns) AS candidate_success, count(*) FILTER (bs AND ns) AS both_success,
  count(*) FILTER (sd = 1) AS recovered, count(*) FILTER (sd = -1) AS regressed, count(*) FILTER (NOT bs AND NOT ns) AS both_fail,
  round(avg(sd), 6) AS success_rate_delta, round(avg(td), 6) AS mean_step_delta"""
ORACLE["paired_delta"] = view(SQL_RUNS, f"SELECT *, round(CASE WHEN recovered + regressed = 0 THEN 1.0::DOUBLE ELSE {EXACT} END, 6) AS mcnemar_p FROM (SELECT task_family, {SUMMARY} FROM pd GROUP BY 1)", *PAIRED)
ORACLE["mcnemar"] = view(SQL_RUNS, f"SELECT episodes, recovered, regressed, both_success, both_fail, round(CASE WHEN recovered + regressed = 0 THEN 1.0::DOUBLE ELSE {EXACT} END, 6) AS mcnemar_p FROM (SELECT {SUMMARY} FROM pd)", *PAIRED)
#: Cumulative Poisson(1) probabilities times 2^32, rounded up, until they reach 2^32.
POISSON = "5e2d58d9 bc5ab1b2 eb715e1e fb239798 ff1025f6 ffd90f3c fffa8b72 ffff540d ffffed20 fffffe22 ffffffd5 fffffffd".split()
DRAW = "CASE " + " ".join(f"WHEN u < '{x}' THEN {k}" for k, x in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"
ORACLE["bootstrap_ci"] = view(SQL_RUNS, """SELECT count(*) AS samples, round(quantile_cont(a, 0.025), 6) AS success_low, round(quantile_cont(a, 0.975), 6) AS success_high,
  round(quantile_cont(b, 0.025), 6) AS steps_low, round(quantile_cont(b, 0.975), 6) AS steps_high
FROM (SELECT s, CAST(sum(w * sd) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS a, CAST(sum(w * td) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS b FROM dr GROUP BY s)""",
    *PAIRED, "ha AS (SELECT sd, td, blk, sha256(blk || ':' || episode_id) AS h FROM pd, range(0, 2500) t(blk))",
    f"dr AS (SELECT blk * 8 + i AS s, sd, td, {DRAW} AS w FROM (SELECT blk, i, sd, td, substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS u FROM ha, range(0, 8) t(i)))")
ORACLE["margin_quintiles"] = view(SQL_VECTORS, """SELECT CAST(ceil(5.0::DOUBLE * r / n) AS BIGINT) AS bin, count(*) AS pairs, round(avg(m), 6) AS mean_value, round(min(m), 6) AS min_value,
  round(max(m), 6) AS max_value, round(100.0::DOUBLE * avg(CAST(ok AS DOUBLE)), 6) AS accuracy_pct
FROM (SELECT *, row_number() OVER (ORDER BY m, vec_id) AS r, count(*) OVER () AS n FROM (SELECT vec_id, round(abs(margin), 9) AS m, round(margin, 9) > 0 AS ok FROM sv)) GROUP BY 1""", SCORED)  # fmt: skip
CONTRIBUTIONS = """cb AS (SELECT vec_id AS row_id, printf('f%02d', pos) AS feature, ['Action schema', 'Search/history', 'Verified effects', 'Other'][CAST(pos % 4 + 1 AS BIGINT)] AS feature_group, round(x * w, 9) AS c FROM ve)"""
ORACLE["group_contributions"] = view(SQL_VECTORS, """SELECT CASE WHEN margin > 0 THEN 'Correct' ELSE 'Incorrect' END AS outcome, feature_group, round(avg(coalesce(s, 0)), 6) AS mean_signed,
  round(avg(abs(coalesce(s, 0))), 6) AS mean_absolute, count(*) AS pair_count
FROM (SELECT row_id, sum(c) AS margin FROM cb GROUP BY 1) CROSS JOIN (VALUES ('Action schema'), ('Search/history'), ('Verified effects')) g(feature_group)
LEFT JOIN (SELECT row_id, feature_group, sum(c) AS s FROM cb GROUP BY 1, 2) USING (row_id, feature_group) GROUP BY 1, 2""", CONTRIBUTIONS)  # fmt: skip
ORACLE["top_factors"] = view(SQL_VECTORS, "SELECT feature, round(sum(c) / (SELECT count(*) FROM embeddings), 6) AS mean_signed, round(sum(abs(c)) / (SELECT count(*) FROM embeddings), 6) AS mean_absolute FROM cb GROUP BY 1", CONTRIBUTIONS)
ORACLE["step_summary"] = """SELECT min(n) AS minimum, quantile_cont(n, 0.5) AS median, CAST(-quantile_disc(-n, 0.5) AS DOUBLE) AS upper_median, round(avg(n), 3) AS mean, max(n) AS maximum, count(*) AS rows
FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)"""
ORACLE["difficulty_mix"] = "SELECT CASE WHEN n <= 10 THEN 'short' WHEN n <= 22 THEN 'medium' ELSE 'long' END AS difficulty, count(*) AS n FROM (SELECT 4 * count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1"
ORACLE["release_audit"] = """SELECT count(*) AS groups, min(n) AS fewest, round(avg(n), 6) AS mean, max(n) AS most, count(*) FILTER (f <> 1) AS without_first
FROM (SELECT count(*) AS n, count(*) FILTER (l_linenumber = 1) AS f FROM lineitem GROUP BY l_orderkey)"""
ORACLE["ledger_topk"] = """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem QUALIFY place <= 3"""
ORACLE["prior_counts"] = view(SQL_TRAJECTORY, "SELECT place, event_type, n, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY place), 9) AS prior FROM (SELECT 'shelf ' || (k % 7) AS place, event_type, count(*) AS n FROM tr GROUP BY 1, 2)")

ORACLE["dup_check"] = "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
ORACLE["inventory_diff"] = """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'extra' ELSE 'changed' END AS state
FROM orders WHERE (o_orderkey % 7 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)) OR (o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0)"""
ORACLE["split_overlap"] = "SELECT l_partkey AS id, count(DISTINCT l_returnflag) AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"
ORACLE["prefix_check"] = view(SQL_TRAJECTORY, "SELECT episode_id || '/' || step AS place, 'other' AS done_id, action AS task_id FROM tr WHERE starts_with(md5(episode_id || '/' || step), '00')")
ORACLE["resume_pending"] = view(SQL_CANDIDATES, "SELECT episode_id, step_index FROM ca GROUP BY 1, 2 HAVING NOT bool_or(success)")
ORACLE["latest_rows"] = view(SQL_EVENTS, "SELECT event_id, user_id, event_type, secs FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
ORACLE["forbidden_columns"] = "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase') OR event_type IS NULL"
ORACLE["prompt_messages"] = "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS prompt_md5, count(*) AS turns FROM conversations GROUP BY 1"

ORACLE["stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"
ORACLE["stream_memory"] = "SELECT user_id, count(*) AS seen, count(DISTINCT event_type || '/' || props) AS places FROM events GROUP BY 1"
ORACLE["stream_stops"] = view(SQL_TRAJECTORY, """SELECT episode_id AS user_id, CASE WHEN s <= 50 THEN 'stagnation' ELSE 'budget' END AS reason, least(s, 50) AS steps
FROM (SELECT episode_id, coalesce(min(step + 1) FILTER (e1 = event_type AND e2 = event_type AND e3 = event_type), 1000000) AS s, count(*) AS n FROM (
  SELECT *, lag(event_type, 1) OVER o AS e1, lag(event_type, 2) OVER o AS e2, lag(event_type, 3) OVER o AS e3 FROM tr WINDOW o AS (PARTITION BY episode_id ORDER BY step)) GROUP BY 1)
WHERE s <= 50 OR n >= 50""")  # fmt: skip
ORACLE["stream_stops_full"] = view(SQL_TRAJECTORY, """SELECT episode_id AS user_id, CASE t WHEN g THEN 'goal' WHEN s THEN 'stagnation' WHEN 50 THEN 'budget' ELSE 'cycle' END AS reason, t AS steps
FROM (SELECT *, least(g, s, c, 50) AS t FROM (SELECT episode_id, coalesce(min(step + 1) FILTER (event_type = 'purchase'), 1000000) AS g,
  coalesce(min(step + 1) FILTER (len(list_distinct(l)) = 1 AND len(l) = 4), 1000000) AS s, coalesce(min(step + 1) FILTER (len(k) = 8 AND again > 1), 1000000) AS c, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, k ORDER BY step) AS again FROM (SELECT episode_id, step, event_type,
    list(event_type) OVER (PARTITION BY episode_id ORDER BY step ROWS 3 PRECEDING) AS l, list(event_type) OVER (PARTITION BY episode_id ORDER BY step ROWS 7 PRECEDING) AS k FROM tr))
  GROUP BY 1)) WHERE t <= n""")  # fmt: skip
ORACLE["event_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

SPEC_ROWS = ", ".join(
    f"('{split}', '{s[0]}', {s[1]}, '{s[2]}', {str(s[3]).lower()}, '{s[4]}', '{s[5] if len(s) > 5 else 'none'}', {repeats}, {offset + k * repeats})" for split, specs, repeats, offset in SPLITS for k, s in enumerate(specs)
)
CASES = f"""cs AS (SELECT 'MWF11-' || replace(upper(split), '_', '-') || '-' || printf('%05d', base + v + 1) AS episode_id,
  scope || '|n' || n || '|' || pattern || '|' || CASE WHEN store THEN 'store' ELSE 'station' END || '|' || priority || '|' || recovery AS signature,
  split, scope, n AS n_samples, pattern, store, priority, recovery, CAST(v AS INT) AS variant, CAST(base + v + 1 AS BIGINT) AS serial
  FROM (SELECT *, unnest(range(0, repeats)) AS v FROM (VALUES {SPEC_ROWS}) t(split, scope, n, pattern, store, priority, recovery, repeats, base)))"""
ORACLE["workflow_cases"] = f"WITH {CASES} SELECT * FROM cs"
ORACLE["workflow_audit"] = f"""WITH {CASES}, sp AS (SELECT DISTINCT split, signature FROM cs), sh AS (SELECT signature, count(*) AS n FROM sp GROUP BY 1)
SELECT split, c.cases, s.signatures, s.shared FROM (SELECT split, count(*) AS cases FROM cs GROUP BY 1) c
JOIN (SELECT split, count(*) AS signatures, count(*) FILTER (n > 1) AS shared FROM sp JOIN sh USING (signature) GROUP BY 1) s USING (split)"""

PHASE = r"""CASE WHEN g_light THEN CASE WHEN lamp_used AND examined_goal THEN 'complete' WHEN lamp_used THEN 'examine' ELSE 'illuminate' END
  WHEN placed_distinct >= g_count THEN 'complete' WHEN hold THEN CASE WHEN g_treat <> '' AND NOT treatment_done THEN 'treat' ELSE 'deliver' END ELSE 'acquire' END"""
ORACLE["router_context"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, " + ", ".join([
    "least(g_count, 6) / 6.0::DOUBLE AS required_count_scaled", "CAST(g_count > 1 AS DOUBLE) AS repeated_goal", "CAST(g_count > 1 AND pl > 0 AND pl < g_count AS DOUBLE) AS partial_repeated_goal",
    "CAST(pl AS DOUBLE) / g_count AS placed_fraction", "CAST(g_count - pl AS DOUBLE) / g_count AS remaining_fraction", "least(step, 30) / 30.0::DOUBLE AS history_fraction", "CAST(hold AS DOUBLE) AS holding_goal_object",
    "CAST(g_treat <> '' AS DOUBLE) AS treatment_required", "CAST(hold AND g_treat <> '' AND treatment_done AS DOUBLE) AS held_treatment_complete", "CAST(g_light AS DOUBLE) AS needs_light", "CAST(lamp_used AS DOUBLE) AS lamp_used",
    *[f"CAST(ph = '{p}' AS DOUBLE) AS phase_{p}" for p in ("acquire", "treat", "deliver", "illuminate", "examine", "complete")],
    "CAST(coalesce(a1 = a2, false) AS DOUBLE) AS immediate_repeat", "CAST(coalesce(a1 = a3 AND a2 = a4, false) AS DOUBLE) AS period_two_cycle",
]) + " FROM ro", *HISTORY,
    r"""hl AS (SELECT *, least(g_count, placed_distinct) AS pl, coalesce(regexp_replace(held_object, '\s+\d+$', '') = g_obj, false) AND g_obj <> '' AS hold,
  lag(action, 1) OVER o AS a1, lag(action, 2) OVER o AS a2, lag(action, 3) OVER o AS a3, lag(action, 4) OVER o AS a4 FROM an WINDOW o AS (PARTITION BY episode_id ORDER BY step))""",
    f"ro AS (SELECT *, {PHASE} AS ph FROM hl)")
ORACLE["tool_prior"] = view(SQL_TRAJECTORY, r"""SELECT place, round(CAST(n AS DOUBLE) / max(n) OVER (), 9) AS score
FROM (SELECT regexp_replace(current_location, '\s+\d+$', '') AS place, count(*) AS n FROM an WHERE action LIKE 'use desklamp%' AND current_location IS NOT NULL GROUP BY 1)""", *HISTORY)  # fmt: skip

ORACLE["exact_match"] = """WITH r AS (SELECT quality = 1 AS ok, n_chars / 1000.0::DOUBLE AS s, lang, source FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' END AS field, coalesce(lang, source) AS value, count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(s), 6) AS mean_latency
FROM r GROUP BY GROUPING SETS ((), (lang), (source))"""
ORACLE["collection_report"] = view(SQL_CANDIDATES, """SELECT count(*) AS branch_count, count(DISTINCT (episode_id, step_index)) AS state_count, count(*) FILTER (success) AS success_count,
  count(*) FILTER (NOT success) AS failure_count, count(*) FILTER (k % 5 = 0) AS cycle_count FROM ca""")  # fmt: skip
ORACLE["vocabulary_coverage"] = """WITH e AS (SELECT DISTINCT l_returnflag AS split, l_partkey AS k FROM lineitem)
SELECT split, count(*) AS keys, count(*) FILTER (k NOT IN (SELECT k FROM e WHERE split = 'A')) AS unseen, count(*) FILTER (k NOT IN (SELECT k FROM e WHERE split = 'A')) = 0 AS covered FROM e GROUP BY 1"""
ORACLE["routed_scores"] = view(SQL_CANDIDATES, """SELECT event_id, round((exp(b - greatest(a, b)) * a + exp(a - greatest(a, b)) * b) / (exp(b - greatest(a, b)) + exp(a - greatest(a, b))), 6) AS soft,
  round(CASE WHEN a > b THEN b ELSE a END, 6) AS hard, round(0.25::DOUBLE * a + 0.75::DOUBLE * b, 6) AS both
FROM (SELECT event_id, trace_return / 100 AS a, CAST(k AS DOUBLE) / 100 AS b FROM ca)""")  # fmt: skip
