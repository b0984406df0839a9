import datetime
import random

import exact
import pytest
from pyspark.sql import functions as F

from waymark.operators import history, integrity, pairs, progress, ranking, reports, sampling, training
from waymark.sources import files
from waymark.streaming import traces
from waymark.workflow import cases, lab


def steps(spark, rows):
    """rows: (episode, actions, instruction, observation)."""
    flat = [(e, i, a, t, o) for e, actions, t, o in rows for i, a in enumerate(actions)]
    return spark.createDataFrame(flat, "episode_id string, step long, action string, instruction string, observation string")


def factors(spark, actions, instruction, observation=""):
    rows = history.annotate(steps(spark, [("e", actions, instruction, observation)]))
    return progress.basis(rows).orderBy(F.desc("step")).select("factors").first()[0], progress.score(rows).orderBy(F.desc("step")).first()["score"]


@pytest.mark.parametrize("verb,tool", [("heat", "microwave"), ("clean", "sinkbasin"), ("cool", "fridge")])
def test_golden_treatment(spark, verb, tool):
    goal = f"{verb} some apple and put it in countertop."
    got, score = factors(spark, ["take apple 1 from table 1", f"{verb} apple 1 with {tool} 1"], goal, f"At {tool} 1.")
    assert got == {"goal_token_exact": 2.0, "observation_token": 1.0, "entity_mention": 1.0} and score == pytest.approx(6.15)
    assert factors(spark, ["take apple 1 from table 1", f"go to {tool} 1"], goal)[0]["treatment_navigation_held"] == 1
    assert factors(spark, [f"go to {tool} 1"], goal)[0]["treatment_navigation_unheld"] == 1


def test_golden_scales():
    assert progress.scales() == {"exact_evidence": 2, "partial_evidence": 1.25, "weak_evidence": 0.5, "entity_binding": 6, "workflow_progress": 3, "prerequisite_risk": 4, "cycle_cost": 1}
    own = progress.coefficients()
    assert len(own) == 30 and own["entity_match"] == 6 and own["premature_delivery"] == -12 and sum(own.values()) == pytest.approx(26.8)
    with pytest.raises(ValueError):
        progress.scales(0)


def replay(actions):
    held = place = lamp = None
    out = []
    for a in actions:
        out.append((held, place, lamp))
        w = a.split()
        if a.startswith("take "):
            held = " ".join(w[1:3])
        elif a.startswith("move ") and held and w[1] == held.split()[0]:
            held = None
        elif a.startswith("go to "):
            place = " ".join(w[2:])
        elif a.startswith("use desklamp") and lamp is None:
            lamp = place or "?"
    return out


def test_history_equals_a_replay(spark):
    rng = random.Random(2)
    choices = ["go to shelf 1", "go to desk 2", "take mug 1 from shelf 1", "take cup 2 from desk 2", "move mug 3 to desk 2", "move cup 2 to shelf 1", "use desklamp 1", "open box 1"]
    runs = [(f"e{i}", [rng.choice(choices) for _ in range(25)], "put a mug in desk", "") for i in range(20)]
    got = {}
    for r in history.annotate(steps(spark, runs)).collect():
        got[r["episode_id"], r["step"]] = r
    for e, actions, *_ in runs:
        for i, (held, place, lamp) in enumerate(replay(actions)):
            r = got[e, i]
            assert (r["held_object"], r["current_location"], r["lamp_location"] or ("?" if r["lamp_used"] else None)) == (held, place, lamp)
            assert r["recent_repeat"] == (actions[i] in actions[max(0, i - 4) : i])
            assert r["placed_count"] == actions[:i].count("move mug 3 to desk 2")


def test_pairs(spark):
    rows = [("a", 0, "take", True, 1.0), ("a", 0, "go table", False, 0.0), ("a", 0, "go bowl", False, -1.0), ("b", 0, "x", False, 0.0), ("c", 0, "p", True, 1.0)]
    rows += [("d", 1, f"p{i}", True, float(i)) for i in range(9)] + [("d", 1, f"n{i}", False, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "episode_id string, step_index int, action string, success boolean, trace_return double")
    got = pairs.build(df).collect()
    a = [r for r in got if r["episode_id"] == "a"]
    assert len(a) == 2 and sum(r["weight"] for r in a) == pytest.approx(1) and {r["episode_id"] for r in got} == {"a", "d"}
    d = [r for r in got if r["episode_id"] == "d"]
    assert len(d) == 32 and {r["positive_action"] for r in d} == {"p8", "p7", "p6", "p5"} and {r["negative_action"] for r in d} == {f"n{i}" for i in range(8)}
    assert pairs.stats(df).first()["groups_with_both_outcomes"] == 2


def test_budgets_nest(spark):
    df = spark.createDataFrame([("f", i) for i in range(20)] + [("g", 99)], "family string, key long")
    taken = {p: {tuple(r) for r in sampling.budget(df, p).collect()} for p in (25, 50, 75, 100)}
    assert [len(taken[p]) for p in (25, 50, 75, 100)] == [6, 11, 16, 21]
    assert taken[25] < taken[50] < taken[75] < taken[100]
    with pytest.raises(ValueError):
        sampling.budget(df, 30)


def test_candidates_are_stable(spark):
    acts = ["look", "help", "inventory", "take apple 1 from table 1", "go to table 1", " "]
    for order in (acts, acts[::-1]):
        df = spark.createDataFrame([("s", a) for a in order], "state string, action string")
        assert [r["action"] for r in sampling.select_candidates(df).orderBy("place").collect()] == ["go to table 1", "take apple 1 from table 1"]
    many = spark.createDataFrame([("s", f"{v} x{i}") for v in ("go", "take", "open") for i in range(9)], "state string, action string")
    got = [r["action"] for r in sampling.select_candidates(many, 5).orderBy("place").collect()]
    assert got[:3] == ["go x0", "open x0", "take x0"] and len(got) == 5


def test_fusion_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 3.0), (1, "b", 0.0, 0.0, 1.0), (2, "a", 1.0, 0.0, 5.0), (2, "b", 1.0, 0.0, 5.0)], "g int, action string, actor double, s double, r double")
    rows = df.select("g", "action", *[c.alias(n) for n, c in ranking.fuse("actor", "s", "r", ["g"]).items()])
    assert {r["g"]: r["action"] for r in ranking.argmax(rows, ["g"], "full", "action").collect()} == {1: "a", 2: "b"}


def test_bins(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 1116), i % 3 == 0) for i in range(1116)], "k int, v double, ok boolean")
    got = {r["bin"]: (r["pairs"], r["min_value"], r["max_value"]) for r in reports.equal_bins(df, "k", "v", "ok").collect()}
    assert [got[b][0] for b in range(1, 6)] == [223, 223, 223, 223, 224] and got[1][1:] == (0.0, 222.0) and got[5][2] == 1115.0


def test_paired(spark):
    rows = [("e1", "reference", "f", True, 5, 0), ("e1", "candidate", "f", False, 9, 1), ("e2", "reference", "f", False, 1, 0), ("e2", "candidate", "f", True, 2, 0), ("e3", "candidate", "f", True, 2, 0)]
    df = spark.createDataFrame(rows, "episode_id string, variant string, task_family string, success boolean, steps int, invalid int")
    s = reports.paired_summary(reports.paired(df)).first()
    assert (s["episodes"], s["recovered"], s["regressed"], s["mean_step_delta"], s["mcnemar_p"]) == (2, 1, 1, 2.5, 1.0)
    assert {r["level"]: r["episodes"] for r in reports.completion(df).collect() if r["level"] == "overall"} == {"overall": 5}


def test_sgd_separates(spark):
    rng = random.Random(5)
    rows = [({"a": rng.random(), "b": rng.random() - 0.5}, 1.0) for _ in range(200)]
    for adagrad in (False, True):
        w = training.fit_pairs(rows, 10, 0.1, 1e-4, 3, adagrad)
        assert w["a"] > abs(w["b"]) and w == training.fit_pairs(rows, 10, 0.1, 1e-4, 3, adagrad)
    df = spark.createDataFrame([(m, i, f, w) for m in ("x", "y") for i, (f, w) in enumerate(rows)], "model string, pair_id int, features map<string,double>, weight double")
    got = {(r["model"], r["feature"]): r["weight"] for r in training.train(df, 10, 0.1, 1e-4, 3).collect()}
    assert got["x", "a"] == got["y", "a"] == training.fit_pairs(rows, 10, 0.1, 1e-4, 3)["a"]


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert [tuple(r) for r in integrity.duplicates(a, ["k"]).collect()] == [(2, 2)]
    b = spark.createDataFrame([(1, "z"), (3, "w")], "k int, v string")
    assert {r["k"]: r["state"] for r in integrity.inventory_diff(a.distinct(), b, "k", ["v"]).collect()} == {1: "changed", 2: "missing", 3: "extra"}
    with pytest.raises(ValueError):
        integrity.require_absent(a.withColumn("expert_rank", F.lit(1)))
    place = lambda ids: spark.createDataFrame(list(enumerate(ids)), "place int, id string")
    assert integrity.prefix_errors(place("a"), place("ab")).isEmpty()
    assert not integrity.prefix_errors(place("b"), place("ab")).isEmpty() and not integrity.prefix_errors(place("abc"), place("ab")).isEmpty()
    changed = integrity.context_changes(b, a.distinct(), ["k"], ["v"]).collect()
    assert {(r["k"], r["problem"]) for r in changed} == {(1, "changed context"), (3, "unknown state")}
    assert integrity.same_set(a, a) and not integrity.same_set(a, a.distinct()) and integrity.nested(b.filter("k = 1"), a, ["k"])


def test_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "x.jsonl").write_text('{"schema_version": "v", "feature_names": ["a"], "weights": [1.5], "max_abs_score": 2.0}\n\n')
    assert files.read_jsonl(spark, f"{d}/x.jsonl", files.RANKER).count() == 1
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.read_jsonl(spark, f"{d}/bad.jsonl", files.RANKER).collect()
    files.save_ranker(spark, f"{d}/ranker", {"b": 1.0, "a": -2.0})
    assert {r["feature"]: r["weight"] for r in files.load_ranker(spark, f"{d}/ranker").collect()} == {"a": -2.0, "b": 1.0}
    inventory = files.inventory(spark, f"{d}/x.jsonl").first()
    assert inventory["size"] == (tmp_path / "x.jsonl").stat().st_size and len(inventory["sha256"]) == 64
    assert files.lint(spark, f"{d}/bad.jsonl", "no.e").first()["found"] == "nope"
    assert files.write_csv(spark.range(3), f"{d}/csv") and not files.write_csv(spark.range(0), f"{d}/none")
    files.identity_guard(spark, f"{d}/id.json", {"a": 1})
    files.identity_guard(spark, f"{d}/id.json", {"a": 1})
    with pytest.raises(ValueError):
        files.identity_guard(spark, f"{d}/id.json", {"a": 2})


def test_workflow_contracts(spark):
    s = lab.new_state({"V": lab.sample((1, 3), "ATR", 1)})
    assert lab.attempt(s, ("move_agv_to_standby", ""))[0] and lab.attempt(s, ("measure_site_1", ""))[0] and lab.attempt(s, ("fly", ""))[0]
    assert lab.broken(s | {"agv": {"place": "SHELF", "load": "V"}})
    ok, after = lab.attempt(s, ("move_agv_to_shelf", ""))
    assert not ok and after["minute"] == 4 and s["minute"] == 0
    rows = cases.cases(spark)
    assert rows.count() == 600 and rows.select("episode_id").distinct().count() == 600
    plans = cases.plans(rows)
    assert plans.filter("not success").isEmpty() and plans.select("episode_id").distinct().count() == 600
    per = cases.feedback(rows.filter("split = 'recovery_test'")).groupBy("episode_id", "step_index").agg(F.count_if("is_expert").alias("n"), F.min("remaining").alias("m"))
    assert per.filter("n != 1").isEmpty() and per.filter("m is null").isEmpty()


def test_workflow_background_expires():
    s = lab.new_state({}, background=0)
    assert lab.background_valid(s | {"minute": 120}) and not lab.background_valid(s | {"minute": 121})


def test_workflow_roles():
    from waymark.workflow import roles as R

    s = lab.new_state({"V1": lab.sample((1, 3), "ATR", 1)})
    goal = {"store": False, "order": ["V1"]}
    after = lab.attempt(s, ("move_agv_to_shelf", ""))[1]
    own = R.roles(s, goal, ("move_agv_to_shelf", ""), after, [])
    # Loading becomes legal and is progress; the move itself changes nothing of the sample.
    assert own == {"goal_completion": 0, "lifecycle_progress": 0, "readiness_progress": pytest.approx(1 / 3), "entity_priority_binding": 0, "prerequisite_violation": 0, "cycle_execution_cost": 0.2}
    assert R.score(own, progress.scales()) == pytest.approx(1.25 / 3 - 0.2)
    assert R.roles(s, goal, ("move_agv_to_shelf", ""), after, [("move_agv_to_shelf", "")])["cycle_execution_cost"] == 1.2
    loaded = lab.attempt(after, ("load_raw_from_shelf", "V1"))[1]
    own = R.roles(after, goal, ("load_raw_from_shelf", "V1"), loaded, [])
    assert own["lifecycle_progress"] == 0.5 and own["entity_priority_binding"] == 1
    idle = lab.attempt(s, ("select_protocol", "REFLECT"))[1]
    assert R.roles(s, goal, ("select_protocol", "REFLECT"), idle, [], neutral_is_risk=True)["prerequisite_violation"] == 1
    f = R.features(after, goal, ("load_raw_from_shelf", "V1"), loaded, own)
    assert f["candidate:binds_active"] == f["candidate:is_next_unsatisfied"] == f["delta:samples.<sample>.place"] == f["skill:load_raw_from_shelf"] == 1 and 0 not in f.values()
    with pytest.raises(ValueError):
        R.score({}, progress.scales())


def test_closed_loop_with_and_without_actor():
    from types import SimpleNamespace

    row = SimpleNamespace(episode_id="e", split="s", scope="full_cycle", n_samples=1, pattern="front", store=True, priority="single", recovery="none", variant=0, serial=1)
    (done,) = cases.run_closed(row)
    assert done[3] and done[6] == "goal"
    (alone,) = cases.run_closed(row, actor=0.0)
    assert alone[4] <= 50


def test_closed_loop_stops_by_cycle():
    from types import SimpleNamespace

    row = SimpleNamespace(episode_id="e", split="train", scope="ir_only", n_samples=1, pattern="back", store=False, priority="single", recovery="none", variant=0, serial=61)
    (alone,) = cases.run_closed(row, actor=0.0)
    assert not alone[3] and alone[4:] == (14, 22.0, "cycle")


def test_bootstrap_draws_as_many_resamples_as_the_reference(spark):
    rows = [(f"e{i}", (i % 7 == 0) - (i % 11 == 0), i % 5 - 1) for i in range(60)]
    got = reports.bootstrap(spark.createDataFrame(rows, "episode_id string, success_delta long, step_delta long")).first()
    success, steps = (sorted(x) for x in exact.bootstrap_exact([r[1:] for r in rows]))
    assert got["samples"] == len(success) == 20_000
    for name, own in (("success", success), ("steps", steps)):
        assert got[f"{name}_low"] == pytest.approx(own[500], abs=0.03) and got[f"{name}_high"] == pytest.approx(own[-501], abs=0.03)


def test_legacy_descriptors():
    d = progress.descriptors
    assert d("goal_token_exact")["evidence_strength"] == 3 and d("entity_match")["binding_strength"] == 3 and d("visible_target_take")["binding_strength"] == 2
    assert d("delivery_navigation_ready")["ready_navigation"] == 1 and d("treatment_navigation_unheld")["unready_navigation"] == 1 and d("treatment_navigation_held")["ready_navigation"] == 1
    assert d("light_repeat")["workflow_depth"] == 2 and d("light_repeat")["regression_severity"] == 2 and d("premature_delivery")["regression_severity"] == 3
    assert d("multi_object_delivery")["multiplicity"] == 2 and d("multi_object_acquisition")["multiplicity"] == 1 and d("light_examine_ready")["terminal_effect"] == 1
    own = progress.legacy_coefficients({"bias": 1.0, "evidence_strength": 0.5})
    assert own["goal_token_exact"] == 2.5 and own["recent_repeat"] == -1.0 and progress.legacy_coefficients({})["entity_match"] == 0.05


def test_checkpoints_and_namespaces(spark):
    rows = spark.createDataFrame([(40, 20, 17.0), (56, 21, 18.83), (64, 21, 16.75)], "step int, success int, average_steps double")
    assert training.best_checkpoint(rows).first()["step"] == 64
    every = spark.createDataFrame([(1, {"a": 1.0}), (2, {"b": 2.0}), (3, {"lex:c": 1.0})], "pair_id int, features map<string,double>")
    got = {r["pair_id"]: r["features"] for r in training.frozen_namespace(every.filter("pair_id > 1"), every).collect()}
    assert got == {2: {"b": 2.0, "a": 0.0, "lex:c": 0.0}, 3: {"lex:c": 1.0}}
    assert [r["feature"] for r in training.vocabulary(every, exclude=("lex:",)).collect()] == ["a", "b"]


def test_stream_stops_at_goal_and_cycle(spark, tmp_path):
    kinds = {1: "ab" * 20, 2: "aabg" + "a" * 9, 3: "abc" * 3 + "d" + "abc" * 2, 4: "abcabcabcab" + "g", 5: "a" * 7, 6: "abcdefgh" + "hgfedcba"}
    rows = [(100 * u + i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), u, k, 0.0, "") for u, own in kinds.items() for i, k in enumerate(own)]
    early = [r for r in rows if r[1].minute < 6]  # the second batch goes on with the state of the first
    for part in (early, [r for r in rows if r not in early]):
        spark.createDataFrame(part, traces.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(traces.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    stops = lambda **more: {r["user_id"]: (r["reason"], r["steps"]) for r in traces.drain(traces.episode_stops(stream, **more), "stops").collect()}
    assert stops(goal="g") == {1: ("cycle", 10), 2: ("goal", 4), 4: ("cycle", 11), 5: ("stagnation", 6), 6: ("goal", 7)}
    assert stops() == {1: ("cycle", 10), 2: ("stagnation", 10), 4: ("cycle", 11), 5: ("stagnation", 6)}
    assert stops(budget=10) == {1: ("budget", 10), 2: ("stagnation", 10), 3: ("budget", 10), 4: ("budget", 10), 5: ("stagnation", 6), 6: ("budget", 10)}


def test_bootstrap_draws_are_summed_in_the_task(spark):
    import hashlib

    bounds = [int(x, 16) for x in reports.poisson_bounds()]
    rows = [(f"e{i}", i % 3 - 1, i % 7 - 2) for i in range(50)]
    frame = spark.createDataFrame(rows, "episode_id string, success_delta long, step_delta long").coalesce(1)
    names = [f"{n}{i}" for i in range(reports.DRAWS) for n in "nat"]
    for r in frame.mapInArrow(reports.drawing(3), "b long, " + ", ".join(f"{n} long" for n in names)).collect():
        for i in range(reports.DRAWS):
            draw = lambda e: int(hashlib.sha256(f"{r['b']}:{e}".encode()).hexdigest()[8 * i : 8 * i + 8], 16)  # noqa: E731, B023
            w = [sum(draw(e) >= x for x in bounds) for e, _, _ in rows]
            assert (r[f"n{i}"], r[f"a{i}"], r[f"t{i}"]) == (sum(w), sum(x * a for x, (_, a, _) in zip(w, rows)), sum(x * t for x, (_, _, t) in zip(w, rows)))
