"""SQL of the feature queries. The entity state is rebuilt from lists of all earlier actions, unlike the running counts of the DataFrame plans."""

from __future__ import annotations

import difflib
import hashlib

from .oracles import GOALS_STRICT, ids, quoted, view
from .views import SQL_TRAJECTORY

ORACLE: dict[str, str] = {}


def b(x: str) -> str:
    return rf"regexp_replace({x}, '\s+\d+$', '')"


def w(x: str) -> str:
    """Without the last word, if there are several."""
    return rf"CASE WHEN strpos({x}, ' ') > 0 THEN regexp_replace({x}, ' [^ ]*$', '') ELSE {x} END"


def some(items: str, test: str) -> str:
    return f"(len(list_filter(coalesce({items}, []), lambda x: {test})) > 0)"


PARSED = rf"""pa AS (SELECT episode_id, step, event_id, action, instruction, observation, k, schema,
  CASE WHEN schema = 'treatment' THEN regexp_extract(action, '^(\w+)', 1) ELSE string_split(action, ' ')[1] END AS verb,
  CASE schema WHEN 'take_from' THEN regexp_extract(action, '^take (.+?) from (.+)$', 1) WHEN 'move_to' THEN regexp_extract(action, '^move (.+?) to (.+)$', 1)
    WHEN 'treatment' THEN regexp_extract(action, '^\w+ (.+?) with (.+)$', 1) WHEN 'go_to' THEN '' ELSE regexp_extract(action, '^\w+ (.+)$', 1) END AS obj,
  CASE WHEN schema = 'take_from' THEN regexp_extract(action, '^take (.+?) from (.+)$', 2) ELSE '' END AS src,
  CASE schema WHEN 'move_to' THEN regexp_extract(action, '^move (.+?) to (.+)$', 2) WHEN 'go_to' THEN regexp_extract(action, '^go to (.+)$', 1) ELSE '' END AS tgt,
  list_extract({GOALS_STRICT}, CAST(episode_id % 6 + 1 AS BIGINT)) AS g
  FROM (SELECT *, CASE WHEN action LIKE 'take %' THEN 'take_from' WHEN action LIKE 'move %' THEN 'move_to' WHEN action LIKE 'go to %' THEN 'go_to' WHEN action LIKE 'heat %' THEN 'treatment'
    WHEN action LIKE 'open %' THEN 'open' WHEN action LIKE 'examine %' THEN 'examine' ELSE 'use' END AS schema FROM tr))"""
SEGMENTS = """se AS (SELECT *, count(*) FILTER (schema = 'take_from') OVER (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS seg FROM pa)"""
HELD = """hb AS (SELECT *, CASE WHEN NOT coalesce(bool_or(schema = 'move_to' AND obj = picked) OVER s, false) THEN picked END AS h_after
  FROM (SELECT *, first_value(CASE WHEN schema = 'take_from' THEN obj END) OVER (PARTITION BY episode_id, seg ORDER BY step ROWS UNBOUNDED PRECEDING) AS picked FROM se)
  WINDOW s AS (PARTITION BY episode_id, seg ORDER BY step ROWS UNBOUNDED PRECEDING))"""
HELD_BEFORE = f"""hc AS (SELECT *, coalesce(lag(h_after) OVER (PARTITION BY episode_id ORDER BY step), '') AS held, coalesce(h_after, '') AS a_held,
  g[1] AS g_obj, g[2] AS g_dest, g[3] AS g_treat, g[4] AS g_count, g[5] AS g_light FROM hb)"""


def lists(prefix: str, window: str) -> str:
    of = lambda cond, value: f"list({value}) FILTER ({cond}) OVER {window}"
    lamp = f"schema = 'use' AND contains({b('obj')}, 'lamp') AND held <> '' AND {b('held')} = g_obj"
    return f"""{of("schema = 'go_to'", "tgt")} AS {prefix}vis, {of("schema = 'take_from'", "obj")} AS {prefix}tak, {of("schema = 'open'", "obj")} AS {prefix}ope,
  {of(f"schema = 'examine' OR ({lamp})", "CASE WHEN schema = 'examine' THEN obj ELSE held END")} AS {prefix}exa, {of("schema = 'use'", "obj")} AS {prefix}too,
  {of("schema = 'treatment'", "obj")} AS {prefix}tro, {of("schema = 'treatment'", "verb")} AS {prefix}trv,
  {of("schema = 'move_to'", "obj")} AS {prefix}mvo, {of("schema = 'move_to'", "tgt")} AS {prefix}mvt"""


STATE = f"""es AS (SELECT *, {lists("b_", "b")}, {lists("a_", "e")}, list(action) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent,
  list(action) OVER b AS acts, ['at shelf ' || (k % 7), 'see mug ' || (k % 9)] AS seen
  FROM hc WINDOW b AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY episode_id ORDER BY step ROWS UNBOUNDED PRECEDING))"""


def flags(p: str) -> str:
    # A thing lies where it was put last: the place of its last move.
    at_goal = f"""len(list_filter(list_distinct(coalesce({p}mvo, [])), lambda o: {b('o')} = g_obj AND g_dest <> '' AND
      contains({b(f"{p}mvt[len({p}mvo) + 1 - list_position(list_reverse({p}mvo), o)]")}, g_dest)))"""
    size = lambda c: f"len(list_distinct(coalesce({p}{c}, [])))"
    light = some(f"{p}too", "contains(x, 'lamp')")
    return f"""{some(f"{p}tak", f"{b('x')} = g_obj")} AS {p}target_acquired,
  (len(list_filter(range(1, len(coalesce({p}tro, [])) + 1), lambda i: {b(f"{p}tro[i]")} = g_obj AND (g_treat = '' OR {p}trv[i] = g_treat))) > 0) AS {p}target_treated,
  ({at_goal} >= g_count) AS {p}target_placed, ({some(f"{p}exa", f"{b('x')} = g_obj")} AND (NOT g_light OR {light})) AS {p}target_inspected,
  (g_dest <> '' AND list_contains(coalesce({p}vis, []), g_dest)) AS {p}destination_reached,
  {size('vis')} AS {p}visited, {size('mvo')} AS {p}placed, {size('tro')} AS {p}treated, {size('exa')} AS {p}examined, {size('ope')} AS {p}opened"""


NAMES = "CASE WHEN tgt <> '' THEN tgt ELSE src END"
TRANSITION = f"""tn AS (SELECT *, {flags("b_")}, {flags("a_")}, (held <> '' AND {b("held")} = g_obj) AS b_holding_target, (a_held <> '' AND {b("a_held")} = g_obj) AS a_holding_target,
  {b("obj")} AS o, {b(NAMES)} AS t, {w("obj")} AS ow, {w(NAMES)} AS tw, schema = 'go_to' AS go,
  len(list_filter(coalesce(b_vis, []), lambda x: x = tgt)) AS visits, len(list_filter(coalesce(acts, []), lambda x: x = action)) AS repeats, len(coalesce(acts, [])) AS n_before,
  {some("b_vis", f"{b('x')} = {b('tgt')}")} AS been, {some("b_vis", f"({w('x')}) = ({w('tgt')})")} AS been_word, coalesce(list_contains(recent, action), false) AS again,
  coalesce(list_extract(b_vis, len(b_vis)), 'shelf ' || (k % 7)) AS place FROM es)"""
CHAIN = [PARSED, SEGMENTS, HELD, HELD_BEFORE, STATE, TRANSITION]
FLAGS = ("target_acquired", "target_treated", "target_placed", "target_inspected", "destination_reached", "holding_target")
Entries = list[tuple[str, str]]


def num(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def change(f: str) -> str:
    return f"CAST(a_{f} AS INT) - CAST(b_{f} AS INT)"


GROWN = [(k, f"a_{k} - b_{k}") for k in ("placed", "treated", "examined", "opened")]
EFFECT: Entries = [
    ("'bias'", "1"), ("'schema:' || schema", "1"), ("'verb:' || verb", "1"), ("'object:' || o", num("o <> ''")), ("'target:' || t", num("t <> ''")),
    ("'candidate:matches_goal'", num("o <> '' AND o = g_obj")), ("'candidate:matches_destination'", num("t <> '' AND g_dest <> '' AND contains(t, g_dest)")),
    ("'candidate:matches_treatment'", num("g_treat <> '' AND verb = g_treat")), ("'candidate:object_visible'", num(f"o <> '' AND {some('seen', f'{b("x")} = o')}")),
    ("'candidate:source_visible'", num(f"t <> '' AND {some('seen', f'{b("x")} = t')}")), ("'candidate:goal_visible'", num(f"g_obj <> '' AND {some('seen', f'{b("x")} = g_obj')}")),
    ("'candidate:novel_location'", num("go AND NOT been")), ("'candidate:visited_location'", num("go AND been")), ("'candidate:repeats'", num("again")),
    *[(f"'delta:{f}'", change(f)) for f in FLAGS], ("'delta:visited'", num("a_visited <> b_visited")), ("'delta:held'", num("a_held <> held")), *[(f"'delta:{k}'", v) for k, v in GROWN],
]
STATE_FEATURES: Entries = [
    *[(f"'state:{f}'", f"CAST(b_{f} AS INT)") for f in FLAGS], ("'state:history_length'", "least(n_before, 50) / 50.0::DOUBLE"), ("'state:visited_count'", "least(b_visited, 12) / 12.0::DOUBLE"),
    ("'state:placed_count'", "least(b_placed, 4) / 4.0::DOUBLE"), ("'state:treated_count'", "least(b_treated, 4) / 4.0::DOUBLE"), ("'state:goal_count'", "g_count"),
    (f"'location:' || {b('place')}", num("place <> ''")), (f"'held:' || {b('held')}", num("held <> ''")),
]
AGAIN = "least(CASE WHEN been THEN greatest(visits, 1) ELSE 0 END, 6) / 6.0::DOUBLE"
SEARCH: Entries = [("'search:novel'", num("go AND NOT been")), ("'search:revisit_count'", f"CASE WHEN go THEN {AGAIN} ELSE 0 END")]


def raw(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda z: z <> ''))"


def overlap(x: str, y: str) -> str:
    return f"len(list_intersect({x}, {y}))"


def jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) > 0 THEN CAST({overlap(x, y)} AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) ELSE 0 END"


def covered(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN CAST({overlap(x, y)} AS DOUBLE) / len({x}) ELSE 0 END"


TOKENS = f"""tk AS (SELECT *, {ids("action")} AS ia, {ids("instruction")} AS ii, {ids("substr(instruction, 18)")} AS ig, {ids("observation")} AS io, {ids("coalesce(array_to_string(recent, ' '), '')")} AS ir,
  {raw("action")} AS ra, {raw("replace(lower(instruction), '.', '')")} AS ri, {raw("replace(lower(substr(instruction, 18)), '.', '')")} AS rg,
  {raw("replace(lower(observation), '.', '')")} AS ro, {raw("coalesce(array_to_string(recent, ' '), '')")} AS rr FROM tn)"""
LEXICAL: Entries = [
    ("'lex:raw_instruction_overlap'", overlap("ra", "ri")), ("'lex:raw_goal_overlap'", overlap("ra", "rg")), ("'lex:raw_observation_overlap'", overlap("ra", "ro")), ("'lex:raw_recent_overlap'", overlap("ra", "rr")),
    ("'lex:instruction_jaccard'", jaccard("ia", "ii")), ("'lex:instruction_coverage'", covered("ia", "ii")), ("'lex:goal_jaccard'", jaccard("ia", "ig")), ("'lex:goal_coverage'", covered("ia", "ig")),
    ("'lex:observation_jaccard'", jaccard("ia", "io")), ("'lex:recent_overlap'", covered("ia", "ir")), ("'lex:goal_object_action'", num("g_obj <> '' AND ow = g_obj")),
    ("'lex:goal_destination_action'", num("g_dest <> '' AND contains(tw, g_dest)")), ("'lex:goal_treatment_action'", num("g_treat <> '' AND verb = g_treat")),
    ("'lex:target_visible'", num(f"g_obj <> '' AND {some('seen', f'({w("x")}) = g_obj')}")), ("'lex:action_object_visible'", num(f"ow <> '' AND {some('seen', f'({w("x")}) = ow')}")),
    ("'lex:history_action_repeat_count'", "repeats"), ("'lex:history_location_visit_count'", "CASE WHEN go THEN visits ELSE 0 END"),
    ("'lex:action_is_new_location'", num("go AND visits = 0")), ("'lex:action_is_visited_location'", num("go AND visits > 0")),
]
SEMANTIC: Entries = [
    ("'sem:schema:' || schema", "1"), ("'sem:verb:' || verb", "1"), ("'sem:action_object_matches_goal'", num("ow <> '' AND ow = g_obj")),
    ("'sem:action_target_matches_destination'", num("tw <> '' AND g_dest <> '' AND contains(tw, g_dest)")), ("'sem:action_matches_treatment'", num("g_treat <> '' AND verb = g_treat")),
    ("'sem:object_visible'", num(f"ow <> '' AND {some('seen', f'({w("x")}) = ow')}")), ("'sem:target_visible'", num(f"tw <> '' AND {some('seen', f'({w("x")}) = tw')}")),
    ("'sem:goal_visible'", num(f"g_obj <> '' AND {some('seen', f'({w("x")}) = g_obj')}")), ("'sem:holding_goal'", num("b_holding_target")), ("'sem:destination_reached'", num("b_destination_reached")),
    ("'sem:action_repeats_recent'", num("again")), ("'sem:go_to_new_location'", num("go AND NOT been_word")), ("'sem:go_to_visited_location'", num("go AND been_word")),
    ("'sem:bind:goal_object=' || g_obj || '|location=' || tw", num("go AND tw <> '' AND g_obj <> ''")), ("'sem:bind:treatment=' || g_treat || '|location=' || tw", num("go AND tw <> '' AND g_treat <> ''")),
    *[(f"'sem:delta:{f}'", change(f)) for f in FLAGS], *[(f"'sem:effect:{f}'", change(f)) for f in FLAGS],
    ("'sem:effect:visited'", num("a_visited <> b_visited")), ("'sem:effect:held'", num("a_held <> held")), *[(f"'sem:effect:{k}'", v) for k, v in GROWN],
]


def long(name: str, entries: Entries, source: str = "tn") -> str:
    """A CTE of (episode_id, step, feature, value) without zeros."""
    structs = ",\n    ".join(f"{{'f': {n}, 'v': CAST({v} AS DOUBLE)}}" for n, v in entries)
    return f"{name} AS (SELECT episode_id, step, e.f AS feature, e.v AS value FROM (SELECT episode_id, step, unnest([{structs}]) AS e FROM {source}) WHERE e.v <> 0)"


ROUNDED = "SELECT episode_id, step, feature, round(value, 9) AS value FROM lo"
ORACLE["effect_features_long"] = view(SQL_TRAJECTORY, "SELECT * FROM lo", *CHAIN, long("lo", EFFECT))
ORACLE["state_features_long"] = view(SQL_TRAJECTORY, ROUNDED, *CHAIN, long("lo", STATE_FEATURES))
ORACLE["search_features_long"] = view(SQL_TRAJECTORY, ROUNDED, *CHAIN, long("lo", SEARCH))
ORACLE["lexical_features_long"] = view(SQL_TRAJECTORY, ROUNDED, *CHAIN, TOKENS, long("lo", LEXICAL, "tk"))
ORACLE["semantic_features_long"] = view(SQL_TRAJECTORY, "SELECT * FROM lo", *CHAIN, long("lo", SEMANTIC))
ORACLE["goal_flags"] = view(SQL_TRAJECTORY, "SELECT episode_id, step, " + ", ".join(f"b_{f} AS {f}" for f in FLAGS) + " FROM tn", *CHAIN)
ALL = long("lo", [*EFFECT, *SEARCH, *LEXICAL, *SEMANTIC], "tk")
SEARCH_NAMES = ("candidate:novel_location", "candidate:repeats", "candidate:visited_location", "sem:action_repeats_recent", "sem:go_to_new_location", "sem:go_to_visited_location")
GROUP = f"""CASE WHEN regexp_matches(feature, '^(object|target):') THEN 'Entity context' WHEN regexp_matches(feature, '^(delta|sem:delta|sem:effect):') THEN 'Verified effects'
  WHEN regexp_matches(feature, '^(schema|verb|sem:schema|sem:verb):') THEN 'Action schema'
  WHEN list_contains({quoted(SEARCH_NAMES)}, feature) OR regexp_matches(feature, '^(search:|lex:recent|lex:observation|lex:raw_recent|lex:raw_observation)') THEN 'Search/history'
  WHEN regexp_matches(feature, '^(candidate:matches|sem:action_)') THEN 'Goal/entity alignment' WHEN starts_with(feature, 'lex:') THEN 'Lexical context' ELSE 'Other' END"""
ORACLE["feature_vocabulary"] = view(SQL_TRAJECTORY, f"SELECT feature, {GROUP} AS feature_group, count(*) AS n FROM lo GROUP BY 1, 2", *CHAIN, TOKENS, ALL)
DISPLAY = {
    "delta:holding_target": "holding target", "schema:close": "close action", "delta:target_acquired": "target acquired", "delta:opened": "opened state", "schema:open": "open action",
    "delta:target_treated": "target treated", "schema:use": "use action", "lex:observation_jaccard": "observation overlap", "candidate:matches_goal": "goal match", "delta:treated": "treatment effect",
}
ORACLE["feature_display"] = view(SQL_TRAJECTORY, "SELECT DISTINCT feature, CASE " + " ".join(f"WHEN feature = '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + """
  WHEN starts_with(feature, 'sem:bind:') THEN replace(replace(replace(substr(feature, 10), 'goal_object=', ''), 'treatment=', ''), '|location=', ' @ ') ELSE replace(feature, ':', ' ') END AS display FROM lo""", *CHAIN, TOKENS, ALL)


def hashed(names: list[str], dimension: int) -> str:
    """A table of names and buckets, by Python's own BLAKE2b."""
    return ", ".join(f"('{n}', {int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), 'little') % dimension})" for n in names)


def vocabulary() -> list[str]:
    """Every name that a feature of the trajectory view can have: its schemas, verbs, things and places are few."""
    verbs, things, places = ("go", "heat", "examine", "open", "take", "move", "use"), ("mug", "drawer", "desklamp"), ("shelf", "desk")
    schemas = ("go_to", "treatment", "examine", "open", "take_from", "move_to", "use")
    fixed = [n[1:-1] for n, _ in (*EFFECT, *SEARCH, *LEXICAL, *SEMANTIC) if "||" not in n]
    made = [f"{p}schema:{s}" for p in ("", "sem:") for s in schemas] + [f"{p}verb:{v}" for p in ("", "sem:") for v in verbs] + [f"object:{x}" for x in things] + [f"target:{x}" for x in places]
    return sorted({*fixed, *made, *[f"sem:bind:{k}={v}|location={x}" for k, v in (("goal_object", "mug"), ("treatment", "heat"), ("treatment", "clean"), ("treatment", "cool")) for x in places]})


ORACLE["hashed_features"] = view(SQL_TRAJECTORY, "SELECT bucket, round(sum(value), 6) AS value FROM lo JOIN hs USING (feature) GROUP BY 1", *CHAIN, TOKENS, ALL,
    f"hs AS (SELECT feature, CAST(bucket AS BIGINT) AS bucket FROM (VALUES {hashed(vocabulary(), 1024)}) t(feature, bucket))")


def similarity() -> str:
    """SQL of action_similarity. SQL has no matching-block ratio, so all pairs of the view's actions come with difflib's."""
    actions = [f"go to shelf {i}" for i in range(7)] + [f"heat mug {i} with microwave 1" for i in range(9)] + [f"examine mug {i}" for i in range(9)] + [f"open drawer {i}" for i in range(5)]
    actions += [f"take mug {i} from shelf {j}" for i in range(9) for j in range(7)] + [f"move mug {i} to desk {j}" for i in range(9) for j in range(3)] + ["use desklamp 1"]

    def score(a: str, z: str) -> float:
        x, y = set(a.split()), set(z.split())
        return 1.0 if a == z else 0.65 * difflib.SequenceMatcher(None, a, z).ratio() + 0.35 * len(x & y) / len(x | y)

    rows = ", ".join(f"('{a}', '{z}', {score(a, z)!r}::DOUBLE)" for a in actions for z in actions)
    return view(SQL_TRAJECTORY, f"""SELECT episode_id, step, round(s, 9) AS similarity FROM (SELECT episode_id, step, action, lag(action) OVER (PARTITION BY episode_id ORDER BY step) AS was FROM tr)
JOIN (VALUES {rows}) t(a, z, s) ON a = was AND z = action""")
