"""Features against a plain replay of each episode."""

import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import numeric as N
from waymark.functions import text as T
from waymark.operators import features, history

CHOICES = (
    "go to shelf 1", "go to desk 2", "go to desk 1", "take mug 1 from shelf 1", "take cup 2 from desk 2", "move mug 1 to desk 2", "move cup 2 to shelf 1", "use desklamp 1", "open box 1",
    "examine mug 1", "heat mug 1 with microwave 1", "clean cup 2 with sinkbasin 1", "use knife 1 with board 2", "close box 1", "look",
)
GOALS = (("put a mug in desk", "mug", "desk", "", 1, False), ("heat some mug and put it in desk", "mug", "desk", "heat", 1, False), ("examine the mug with the desklamp", "mug", "", "", 1, True), ("put two mug in desk", "mug", "desk", "", 2, False))
SEEN = "On the desk 2, you see a mug 1, and a cup 2."


def base(x):
    return re.sub(r"\s+\d+$", "", x)


def parse(a):
    for schema, pattern in (("take_from", r"take (.+?) from (.+)"), ("move_to", r"move (.+?) to (.+)"), ("go_to", r"go to ()(.+)"), ("treatment", r"(?:clean|cool|heat) (.+?) with (.+)"), ("use_with", r"use (.+?) with (.+)"), ("open", r"open (.+)()"), ("close", r"close (.+)()"), ("examine", r"examine (.+)()"), ("use", r"use (.+)()")):
        if m := re.fullmatch(pattern, a):
            return schema, a.split()[0], m[1], m[2]
    return "other", a.split()[0], a, ""


class Replay:
    def __init__(self, goal):
        self.goal, self.held, self.place = goal, "", ""
        self.visited, self.taken, self.treated, self.placed, self.tools, self.examined, self.opened, self.done = [], set(), set(), {}, set(), set(), set(), []

    def step(self, a):
        schema, verb, x, y = parse(a)
        if schema == "go_to":
            self.place = y
            self.visited.append(y)
        elif schema == "take_from":
            self.held = x
            self.taken.add(x)
        elif schema == "move_to":
            self.placed[x] = y
            self.held = "" if self.held == x else self.held
        elif schema == "treatment":
            self.treated.add((x, verb))
        elif schema == "use_with":
            self.tools.add(y)
        elif schema == "use":
            self.tools.add(x)
            if "lamp" in x and self.held and base(self.held) == self.goal[1]:
                self.examined.add(self.held)
        elif schema == "examine":
            self.examined.add(x)
        elif schema == "open":
            self.opened.add(x)
        self.done.append(a)

    def numbers(self):
        _, obj, dest, treat, count, light = self.goal
        placed = [k for k, v in self.placed.items() if base(k) == obj and dest and dest in base(v)]
        return {
            "target_acquired": any(base(x) == obj for x in self.taken), "target_treated": any(base(x) == obj and (not treat or v == treat) for x, v in self.treated), "target_placed": len(placed) >= count,
            "target_inspected": any(base(x) == obj for x in self.examined) and (not light or any("lamp" in t for t in self.tools)), "destination_reached": bool(dest) and dest in self.visited,
            "holding_target": bool(self.held) and base(self.held) == obj, "placed": len(self.placed), "treated": len({x for x, _ in self.treated}), "examined": len(self.examined), "opened": len(self.opened),
        }


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(9)
    return {f"e{i}": (GOALS[i % 4], [rng.choice(CHOICES) for _ in range(30)]) for i in range(24)}


@pytest.fixture(scope="module")
def steps(spark, runs):
    flat = [(e, i, a, "Your task is to: " + goal[0], SEEN) for e, (goal, acts) in runs.items() for i, a in enumerate(acts)]
    return spark.createDataFrame(flat, "episode_id string, step long, action string, instruction string, observation string").repartition(5)


def test_effects_equal_a_replay(spark, runs, steps):
    t = features.transition(features.entity_state(steps))
    got = {(r["episode_id"], r["step"]): r["f"] for r in t.select("episode_id", "step", features.effect_features(t).alias("f")).collect()}
    for e, (goal, acts) in runs.items():
        s = Replay(goal)
        for i, a in enumerate(acts):
            before, been, recent, held = s.numbers(), [base(v) for v in s.visited], s.done[-4:], s.held
            s.step(a)
            after, f = s.numbers(), got[e, i]
            schema, verb, x, y = parse(a)
            assert f["bias"] == f[f"schema:{schema}"] == f[f"verb:{verb}"] == 1
            for k in before:
                assert f.get(f"delta:{k}", 0) == float(after[k]) - float(before[k]), (e, i, a, k)
            assert f.get("delta:held", 0) == (s.held != held) and f.get("candidate:repeats", 0) == (a in recent)
            assert f.get("candidate:novel_location", 0) == (schema == "go_to" and base(y) not in been)
            assert f.get("candidate:matches_goal", 0) == (base(x) == goal[1])
            assert 0 not in f.values()


def test_lexical_and_semantic_features(spark, runs, steps):
    t = features.transition(features.entity_state(steps))
    rows = t.select("episode_id", "step", features.lexical_features().alias("l"), features.semantic_features().alias("s"), features.search_features().alias("q"), features.state_features().alias("z")).collect()
    stop = set("a an and are at do for from in is it of on or put the to two with you".split())
    ids = lambda x: {w for w in re.findall(r"[a-z][a-z0-9_-]*", re.sub(r"\d+", " ", x.lower())) if w not in stop and len(w) > 1}
    for r in rows:
        goal, acts = runs[r["episode_id"]]
        i, a = r["step"], acts[r["step"]]
        act, instruction = ids(a), ids("Your task is to: " + goal[0])
        assert r["l"].get("lex:instruction_jaccard", 0) == pytest.approx(len(act & instruction) / len(act | instruction) if act | instruction else 0)
        assert r["l"].get("lex:goal_coverage", 0) == pytest.approx(len(act & ids(goal[0])) / len(act) if act else 0)
        assert r["l"].get("lex:history_action_repeat_count", 0) == acts[:i].count(a)
        visits = acts[:i].count(a) if a.startswith("go to ") else 0
        assert r["l"].get("lex:history_location_visit_count", 0) == visits
        raw = set(a.split()) & set(SEEN.lower().replace(".", "").split())
        assert r["l"].get("lex:raw_observation_overlap", 0) == len(raw)
        if a.startswith("go to "):
            been = {base(x[6:]) for x in acts[:i] if x.startswith("go to ")}
            assert r["q"].get("search:novel", 0) == (base(a[6:]) not in been)
            assert r["s"][f"sem:bind:goal_object=mug|location={base(a[6:])}"] == 1
        else:
            assert r["q"] == {}
        assert r["z"]["state:goal_count"] == goal[4] and r["z"].get("state:history_length", 0) == pytest.approx(min(i, 50) / 50)


def test_filters_fall_back(spark):
    row = spark.createDataFrame([(["take cup 1 from a", "take mug 1 from a", "move cup 1 to b", "go to x"], ["go to a", "go to b", "go to a"], ["go to b"])], "c array<string>, h array<string>, only array<string>")
    goal = F.struct(F.lit("mug").alias("object"), F.lit("desk").alias("destination"))
    none, placed = F.array().cast("array<string>"), F.array(F.lit("mug 1"))
    got = row.select(
        features.goal_filter("c", goal, none).alias("g"), features.goal_filter("c", goal, placed).alias("p"), features.cycle_filter("only", "h").alias("all_cycle"),
        features.cycle_filter(F.array(F.lit("go to b"), F.lit("x")), "h").alias("cut"), features.observable_filter("c", "h").alias("o"),
    ).first()
    assert got["g"] == ["take mug 1 from a", "go to x"] and got["p"] == ["go to x"]
    assert got["all_cycle"] == ["go to b"] and got["cut"] == ["x"] and len(got["o"]) == 4


def test_router_and_reward(spark, steps):
    rows = history.with_examined(history.annotate(steps))
    got = features.router_context(rows).filter("step = 0").collect()
    assert all(r["placed_fraction"] == 0 and sum(r[f"phase_{p}"] for p in features.PHASES) == 1 for r in got)
    one = rows.limit(1).select(*[F.struct(*[F.lit(v if p == "placed_fraction" else 0.0).alias(p) for p in features.PREDICATES]).alias(n) for n, v in (("b", 0.0), ("a", 0.5))], features.goal_vector().alias("w"), features.route("repeated_goal").alias("r"), features.action_context("free_form").alias("c"))
    r = one.select(features.progress_reward("b", "a", "w").alias("x"), "w", "c").first()
    assert r["x"] == pytest.approx(0.5 * r["w"]["placed_fraction"] / sum(r["w"])) and r["c"] == {}
    with pytest.raises(ValueError):
        features.action_context("other")


def test_similarity_and_buckets(spark):
    pairs = [("take mug", "take  MUG"), ("take mug 1", "take cup 1"), ("", ""), (None, "x"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string").select(features.similarity()("a", "b").alias("s"), features.bucket(97)("a").alias("k"), "a", "b")
    for r in df.collect():
        a, b = (" ".join((x or "").lower().split()) for x in (r["a"], r["b"]))
        x, y = set(a.split()), set(b.split())
        want = 1.0 if a == b else 0.65 * difflib.SequenceMatcher(None, a, b).ratio() + 0.35 * (len(x & y) / len(x | y) if x | y else 0)
        assert r["s"] == pytest.approx(want)
        assert r["k"] == (None if r["a"] is None else int.from_bytes(hashlib.blake2b(r["a"].encode(), digest_size=8).digest(), "little") % 97)


def test_branches(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), ("a", ["b"]), ("a", []), ("a", ["a"] * 9)], "action string, rollout_actions array<string>")
    assert features.branch_errors(df).count() == 3


def test_a_history_tells_which_actions_close_a_run(spark):
    rng = random.Random(9)
    rows = [([rng.choice(["a", "B  c", "d"]) for _ in range(rng.randrange(25))],) for _ in range(200)]
    df = spark.createDataFrame(rows, "h array<string>").withColumn("c", F.array(F.lit("A"), F.lit("b c"), F.lit("d"), F.lit("e")))
    for most, repeats in ((6, 2), (12, 2), (3, 3)):
        norm = F.transform("h", lambda a: T.normalize(a))
        slow = F.filter("c", lambda a: ~N.has_cycle(F.concat(norm, F.array(T.normalize(a))), most, repeats))
        want = F.when(F.size("h") == 0, F.col("c")).otherwise(features.or_all(slow, F.col("c")))
        got = df.select(features.cycle_filter("c", "h", most, repeats).alias("got"), want.alias("want"))
        assert got.count() == 200 and got.filter("got <> want").isEmpty()
    plan = df.select(features.cycle_filter("c", "h", 12).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert "sequence" not in plan  # no run is looked for anew for each candidate


def test_memory_needs_no_join(spark):
    acts = ["go to shelf 1", "take mug 1 from shelf 1", "go to shelf 2", "look", "go to shelf 1"]
    steps = spark.createDataFrame([(1, i, a, "put a mug in desk.", f"You arrive at shelf {i % 2 + 1}. Here: mug {i}.") for i, a in enumerate(acts)], "episode_id long, step long, action string, instruction string, observation string")
    found = features.with_memory(features.transition(features.entity_state(steps)))
    assert [(r["step"], r["known"], r["shown"], r["lamp"]) for r in found.sort("step").collect()] == [(0, True, True, False), (1, False, False, False), (2, True, True, False), (3, False, False, False), (4, True, True, False)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_without_keys_adds_names_up_first(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 0.5},)], "features map<string,double>")
    want = {}
    for k, v in (("a", 1.5), ("b", 2.0)):
        want[features.bucket_of(k, 8)] = want.get(features.bucket_of(k, 8), 0) + v
    found = features.hashed(rows, [], 8)
    assert {r["bucket"]: r["value"] for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
