"""Operators of collection, runtimes, paths and checks on odd input."""

import json
import math
import os
import re
import time
from collections import defaultdict

import exact
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import text as T
from waymark.operators import collection, features, history, integrity, progress, prompts, ranking, runtime, training
from waymark.plans import state_queries, views
from waymark.sources import files
from waymark.workflow import cases, roles


def one(spark):
    return spark.range(1)


def test_attempts_time_out_and_go_on(spark):
    def slow(row, attempt):
        if row["id"] == 2 and attempt == 0:
            time.sleep(3)
        if row["id"] == 3:
            raise KeyError("x")
        return row["id"] * 2

    got = {r["id"]: r for r in collection.attempts(spark.range(5), slow, timeout=0.5).collect()}
    assert got[2]["result"] == 4 and got[2]["tries"] == 2 and got[2]["errors"][0].startswith("TimeoutError")
    assert got[3]["result"] is None and len(got[3]["errors"]) == 2 and got[4]["errors"] == []
    assert collection.attempts(spark.range(0), slow).collect() == []


def test_a_hung_call_costs_its_own_row_only(spark):
    def hangs(row, attempt):
        if row["id"] in (1, 3):
            time.sleep(600)
        return row["id"] * 2

    begun = time.time()
    got = {r["id"]: r for r in collection.attempts(spark.range(6).coalesce(1), hangs, timeout=0.3).collect()}
    assert time.time() - begun < 60
    assert [got[i]["result"] for i in range(6)] == [0, None, 4, None, 8, 10]
    assert got[3]["tries"] == 2 and all(e.startswith("TimeoutError") for e in got[3]["errors"]) and got[4]["errors"] == []


def rollout(spark, actions):
    """Outcome of a rollout whose observations never repeat."""
    rows = [("r", i, i, a, f"o{i}", i) for i, a in enumerate([None, *actions])]
    trace = spark.createDataFrame(rows, "rollout string, position long, step long, action string, observation string, p long")
    return collection.rollouts(trace, ["rollout"], ["p"]).first()


@pytest.mark.parametrize("steps", [10, 60, 64, 66, 100, 300])
def test_late_cycles_are_found(spark, steps):
    plain = [f"go to shelf {i}" for i in range(steps)]
    for end in ([], ["open a", "close a"] * 2, ["a", "b", "c", "d", "e", "f"] * 2):
        got = rollout(spark, plain[: steps - len(end)] + end if len(end) < steps else end)
        assert got["cycle_detected"] is bool(end)
    middle = plain[: steps // 2] + ["open a", "close a"] * 2 + plain[steps // 2 :]
    assert rollout(spark, middle)["cycle_detected"] is True
    assert rollout(spark, ["a", "b", "c", "d", "e", "f", "g"] * 2)["cycle_detected"] is False  # a run longer than any that counts


@pytest.mark.parametrize("path, want", [("a/../b", "b"), ("/a/./b//c", "/a/b/c"), ("../x", "../x"), ("../../x/..", "../.."), ("a/b/../../c", "c"), ("", ""), ("/..", "/..")])
def test_normal_path(spark, path, want):
    assert one(spark).select(T.normal_path(F.lit(path)).alias("p")).first()["p"] == want


@pytest.mark.parametrize("path, bad", [("a/b.json", False), ("", True), ("/a", True), ("a\\b", True), ("c:d", True), ("a/../b", True), ("./a", True), ("a//b", True), ("a/", True), ("a..b/c", False)])
def test_release_paths(spark, path, bad):
    assert one(spark).select(T.invalid_release_path(F.lit(path)).alias("p")).first()["p"] is bad


def test_canonical_key_is_compact_json(spark):
    values = ("a \"quoted\" \\ \n line", 7, ["x", "\u00e9/"], None)
    df = spark.createDataFrame([values], "a string, b long, c array<string>, d string")
    assert df.select(T.canonical_key("a", "b", "c", "d").alias("k")).first()["k"] == json.dumps(list(values), ensure_ascii=False, separators=(",", ":"))


def test_pair_difference_drops_zeros_of_the_negative_side_only(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 1e-13, "c": 2.0}, {"a": 1.0, "c": 0.5, "d": 3.0})], "p map<string,double>, n map<string,double>")
    got = df.select(features.pair_difference("p", "n").alias("x"), features.rebuilt(F.create_map(F.lit("lex:z"), F.lit(1.0), F.lit("k"), F.lit(2.0)), F.create_map(F.lit("lex:a"), F.lit(0.0))).alias("y")).first()
    assert got["x"] == {"b": 1e-13, "c": 1.5, "d": -3.0} and got["y"] == {"k": 2.0}


def test_report_and_identity(spark, tmp_path):
    path = f"file://{tmp_path}/r.json"
    files.report(spark.range(3), path)
    assert json.loads(files.read_text(spark, path)) == [{"id": i} for i in range(3)]
    with pytest.raises(ValueError):
        files.report(spark.range(3), path, most=2)


def test_runtime_documents(spark):
    with pytest.raises(ValueError):
        runtime.load(json.dumps({"schema_version": "other"}))
    assert callable(runtime.load(json.dumps({"schema_version": "structured-progress-potential-runtime-v1"})))


def test_runtimes_score_a_step_in_one_pass(spark):
    actions = ["go to shelf 1", "take mug 2 from shelf 1", "open drawer 3", "go to desk 1", "move mug 2 to desk 1", "move mug 2 to desk 1", "look", ""]
    steps = [(e, i, a, "Your task is to: put a mug in desk.", "You see mug 2.") for e in (1, 2, None) for i, a in enumerate(actions)]
    df = spark.createDataFrame(steps, "episode_id long, step long, action string, instruction string, observation string").repartition(3, "episode_id")
    rankers = [{"delta:placed": 1.5, "bias": 0.1}, {"lex:goal_coverage": 2.0, "search:novel": -1.0}, {"sem:verb:take": 1.0, "verb:open": 0.5}, {"none": 1.0}, {}]
    made = [{"schema_version": "structured-progress-potential-runtime-v1", "structured_weight": w, "base_cost": c} for w, c in ((0.5, 1.0), (2.0, 3.0), (0.0, 1.0))]
    made += [{"schema_version": "unified-progress-value-runtime-v1", "structured_weight": w, "semantic_weight": 0.5, "ranker": r} for r in rankers for w in (0.25, 0.0)]
    made += [{"schema_version": "unified-progress-value-runtime-v1"}]
    annotated = history.annotate(df)
    formula = {c: {(r["episode_id"], r["step"]): r["score"] for r in progress.score(annotated, c).collect()} for c in (1.0, 3.0)}
    features_of = {(r["episode_id"], r["step"]): r["features"] for r in features.featurise(df).collect()}
    got = runtime.scores(annotated, {f"d{i}": json.dumps(d) for i, d in enumerate(made)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the one that the steps came with
    rows = got.collect()
    assert len(rows) == len(steps)  # those without an episode too
    for r in rows:
        key = r["episode_id"], r["step"]
        for i, d in enumerate(made):
            want = formula[d.get("base_cost", 1.0)][key] * d.get("structured_weight", 0.0)
            if "ranker" in d:
                want += 0.5 * 2 * math.tanh(sum(d["ranker"].get(k, 0.0) * v for k, v in features_of[key].items()) / 2)
            assert r[f"d{i}"] == pytest.approx(want)
    alone = runtime.load(json.dumps(made[3]))(annotated)
    assert sorted(r["score"] for r in alone.collect()) == sorted(r["d3"] for r in rows)


def test_state_summary_of_nothing(spark):
    empty = spark.createDataFrame([([],)], "h array<string>")
    text = empty.select(prompts.state_summary("h").alias("t"), prompts.next_action(F.lit("x"), "h", F.lit("y"))[1]["content"].alias("m")).first()
    assert "current location: unknown" in text["t"] and text["t"].count("none") == 5 and "Previous actions:\n(none)" in text["m"]


def test_checks_of_key_sets(spark):
    a, b = spark.range(5), spark.range(2, 7)
    assert {(r["id"], r["side"]) for r in integrity.unmatched(a, b, ["id"]).collect()} == {(0, "first"), (1, "first"), (5, "second"), (6, "second")}
    assert integrity.unmatched(a, a, ["id"]).isEmpty()
    assert integrity.set_differences(a, b).first() == (2, 2)
    table = spark.createDataFrame([(1, "x")], "key long, name string")
    assert {(r["id"], r["name"]) for r in integrity.lookup(a, table, {"id": "key"}).collect()} == {(i, "x" if i == 1 else None) for i in range(5)}
    assert integrity.lookup(a, table, {"id": "key"}, rows_at_most=0).count() == 5


def test_small_groups_keep_their_order(spark):
    rows = spark.createDataFrame([("a", i, float(-i)) for i in range(3)] + [("b", i, float(i)) for i in range(5)], "g string, i long, s double")
    got = {(r["g"], r["i"]): r["place"] for r in ranking.retrieval_shortlist(rows, ["g"], "s", "i", 3).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 3, ("b", 4): 1, ("b", 3): 2, ("b", 2): 3}


def test_only_the_first_row_is_padded(spark):
    rows = spark.createDataFrame([(2, {"a": 1.0}), (5, {"b": 1.0}), (9, {"c": 1.0})], "pair_id long, features map<string,double>")
    got = {r["pair_id"]: r["features"] for r in training.frozen_namespace(rows.filter("pair_id > 2"), rows).collect()}
    assert got == {5: {"a": 0.0, "b": 1.0, "c": 0.0}, 9: {"c": 1.0}}
    assert training.frozen_namespace(rows.limit(0), rows).collect() == []


def test_variants_fuse_scaled_scores():
    assert cases.scaled([1.0, -4.0]) == [0.25, -1.0] and cases.scaled([0.0, 1e-9]) == [0.0, 0.0]
    assert cases.standardized([1.0, 3.0]) == [-1.0, 1.0] and cases.standardized([2.0, 2.0]) == [0.0, 0.0]
    assert set(cases.VARIANTS) == {"actor", "actor_structural", "actor_residual", "full"} and set(roles.PROFILES) >= {"alf_aligned", "workstation_full"}


def test_reference_bootstrap_agrees_with_the_hash_bootstrap(spark):
    from waymark.operators import reports

    deltas = [((i * 7) % 3 - 1, (i * 5) % 11 - 5) for i in range(60)]
    success, steps = (sorted(x) for x in exact.bootstrap_exact(iter(deltas), samples=2_000))
    pairs = spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(deltas)], "episode_id string, success_delta long, step_delta long")
    got = reports.bootstrap(pairs, 2_001).first()  # not a multiple of the draws a hash gives
    assert got["samples"] == 2_001
    for low, high, x in ((got["success_low"], got["success_high"], success), (got["steps_low"], got["steps_high"], steps)):
        width = x[1950] - x[50]
        assert abs(low - x[50]) < width / 8 and abs(high - x[1950]) < width / 8


def test_remembered_is_the_state_summary_of_the_last_actions(spark):
    acts = ["go to shelf 1", "take mug 1 from shelf 1", "heat mug 1 with microwave 1", "use desklamp 1", "move mug 1 to desk 2", "look", None, "go to shelf 2", "go to shelf 1", "Use  lamp 3"] * 3
    steps = spark.createDataFrame([(e, i, a) for e in (1, 2) for i, a in enumerate(acts[e:])], "episode_id long, step long, action string")
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(-7, -1)
    rows = prompts.remembered(steps, 7).withColumn("h", F.collect_list("action").over(w)).withColumn("want", prompts.state_summary("h")).collect()
    assert len(rows) == 57 and all(r["memory"] == r["want"] for r in rows)


def summary_by_hand(actions):
    """The state memory of a whole history, one action after another."""
    place, held, places, treated, put, used = "unknown", "none", [], [], [], []
    for action in actions:
        a = " ".join((action or "").lower().split())
        if m := re.match(r"go to (.+)$", a):
            place = m[1]
            places += [place] if place not in places else []
        elif m := re.match(r"take (.+?) from .+$", a):
            held = m[1]
        elif m := re.match(r"move (.+?) to (.+)$", a):
            held, put = "none", [*put, f"{m[1]} -> {m[2]}"]
        elif m := re.match(r"(clean|cool|heat) (.+?) with .+$", a):
            treated.append(f"{m[1]} {m[2]}")
        elif m := re.match(r"use (.+)$", a):
            used.append(m[1])
    named = lambda xs, n: ", ".join(xs[-n:]) or "none"
    return "\n".join([
        "Observable state memory:", f"- current location: {place}", f"- held object: {held}", f"- visited locations: {named(places, 12)}",
        f"- completed treatments: {named(treated, 8)}", f"- completed placements: {named(put, 8)}", f"- used devices: {named(used, 8)}",
    ])


def test_remembered_tells_of_the_whole_history(spark):
    early = ["take mug 7 from shelf 1", "Go to  shelf 1", "use desklamp 1", "cool egg 1 with fridge 1", "move cup 1 to desk 1", "take mug 9 from shelf 2"]
    many = [a for i in range(15) for a in (f"go to shelf {i}", None, f"heat mug {i} with microwave 1", f"go to shelf {i // 2}", f"move mug {i} to desk 1", f"use lamp {i}", f"use lamp {i}", "")]
    acts = {1: early + ["look"] * 40, 2: many, 3: ["look", None], 4: early + many + ["open drawer 1"] * 35 + early[::-1]}
    steps = spark.createDataFrame([(e, i, a, i) for e, xs in acts.items() for i, a in enumerate(xs)], "episode_id long, step long, action string, `a.b` long")
    rows = prompts.remembered(steps, name="text")
    assert rows.columns == [*steps.columns, "text"]
    got = {(r["episode_id"], r["step"]): r["text"] for r in rows.collect()}
    assert got == {(e, i): summary_by_hand(xs[:i]) for e, xs in acts.items() for i in range(len(xs))}
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("h", F.collect_list("action").over(w)).withColumn("want", prompts.state_summary("h"))
    assert rows.filter("text <> want").isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables absent")
def test_aligned_prompts_remember_more_than_thirty_actions(spark, monkeypatch):
    # The whole text comes out as the first line quoted.
    monkeypatch.setattr(T, "prompt_section", lambda p, section: F.translate(F.col(p), "\n", "\t"))
    got = {(r["episode_id"], r["step"]): r["first_quoted"] for r in state_queries.aligned_prompts(spark, "/root/testdata/sf0.001").collect()}
    told = defaultdict(list)
    for r in views.trajectory(spark, "/root/testdata/sf0.001").orderBy("episode_id", "step").collect():
        told[r["episode_id"]].append(r["action"])
    assert max(map(len, told.values())) > 60 and len(got) == sum(len(xs) - 1 for xs in told.values())
    for (episode, step), text in got.items():
        assert f"Current observable state:\n{summary_by_hand(told[episode][:step])}\n\n" in text.replace("\t", "\n")
