import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import numeric as N
from waymark.functions import text as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_actions(spark):
    cases = {
        "Take  apple 1 from table 1": ("take_from", "take", "apple 1", "table 1", "", ""), "move a to b": ("move_to", "move", "a", "", "b", ""), "go to shelf 2": ("go_to", "go", "", "", "shelf 2", ""),
        "heat apple 1 with microwave 1": ("treatment", "heat", "apple 1", "", "", "microwave 1"), "use lamp 1 with x": ("use_with", "use", "lamp 1", "", "", "x"),
        "open drawer 1": ("open", "open", "drawer 1", "", "", ""), "examine mug 1": ("examine", "examine", "mug 1", "", "", ""), "look": ("other", "look", "look", "", "", ""), "": ("other", "empty", "", "", "", ""), None: ("other", "empty", "", "", "", ""),
    }
    got = values(spark, [(a,) for a in cases], "a string", T.parse_action("a", entities=True).alias("p"))
    assert [tuple(r[0]) for r in got] == list(cases.values())


def test_goals_in_two_dialects(spark):
    row = [("Your task is to: put an apple in a bowl.",)]
    strict, lenient = (values(spark, row, "a string", T.parse_goal("a", d).alias("g"))[0][0] for d in ("strict", "lenient"))
    assert (strict["destination"], lenient["destination"]) == ("a", "bowl") and strict["object"] == lenient["object"] == "apple"
    counts = {"put two mugs": 2, "put one of the two mugs": 1, "at most three": 1, "choose one from three": 1, "bring 12 mugs": 12, "one or two": 1, "both cups": 2, "a mug": 1, "one then seven": 7}
    assert [r[0] for r in values(spark, [(c,) for c in counts], "a string", T.required_count("a"))] == list(counts.values())


def test_families_differ_in_order(spark):
    rows = ["look at two mugs under the desklamp", "find two and clean them", "warm the mug", "wash a cup", ""]
    got = values(spark, [(r,) for r in rows], "a string", T.family_budget("a"), T.family_prompt("a"))
    assert got[0] == ("look_at_obj_in_light", "look_at_obj_in_light") and got[1] == ("pick_two_obj_and_place", "pick_two_obj_and_place")
    assert got[2] == ("pick_and_place_simple", "pick_heat_then_place_in_recep") and got[3] == ("pick_and_place_simple", "pick_clean_then_place_in_recep")


def test_text_helpers(spark):
    got = values(
        spark, [("mug 1", "<think>x\ny</think>\n Action: 'go to a' \nmore", "Contract violation record: a  b requires c under v1. Required action: d e. x", "Task instruction:\nI\n\nPrevious actions:\nP\n\nCurrent observation:\nO")],
        "e string, o string, r string, p string", T.entity_base("e"), T.drop_last_word(F.lit("big red")), T.clean_output("o"), T.contract_records("r"), T.prompt_section("p", "previous"), T.prompt_section("p", "observation"),
        T.task_identity(F.lit("alfworld/train/1")), T.action_key(F.lit("f"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))),
    )[0]
    assert got[:3] == ("mug", "big", "go to a") and tuple(got[3][0]) == ("a b", "d e", "v1") and got[4:] == ("P", "O", "1", "f(a=1,b=2)")


def test_folds_equal_arithmetic(spark):
    import hashlib

    keys = [f"alfworld/train/{i}" for i in range(2000)]
    got = values(spark, [(k,) for k in keys], "k string", N.in_fold("k"), N.holdout_mod5("k"))
    for k, (train, holdout) in zip(keys, got, strict=True):
        assert train == (int.from_bytes(hashlib.sha1(k.encode()).digest()[:8], "big") / 2.0**64 < 0.8)
        assert holdout == (int(hashlib.sha256(k.encode()).hexdigest(), 16) % 5 == 0)


def test_mcnemar(spark):
    pairs = [(3, 10), (0, 0), (5, 5), (0, 12), (400, 350), (3000, 2800)]
    for (a, b), (p,) in zip(pairs, values(spark, pairs, "a int, b int", N.mcnemar("a", "b")), strict=True):
        n = a + b
        exact = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n)
        assert p == pytest.approx(exact, rel=1e-9)


def test_cycles(spark):
    rng = random.Random(1)
    rows = [[rng.choice("ab") for _ in range(rng.randint(0, 14))] for _ in range(300)]

    def cycle(a, longest, times):
        return any(len(a) >= n * times and all(a[-n * times :][i] == a[-n * times :][i % n] for i in range(n * times)) for n in range(1, longest + 1))

    got = values(spark, [(r,) for r in rows], "a array<string>", N.has_cycle("a", 6, 2), N.has_cycle("a", 3, 3))
    assert got == [(cycle(r, 6, 2), cycle(r, 3, 3)) for r in rows]


def test_sparse_vectors(spark):
    row = [({"a": 1.0, "b": 2.0}, {"b": 2.0, "c": 3.0})]
    d, dot, kept = values(spark, row, "x map<string,double>, y map<string,double>", N.sparse_difference("x", "y"), N.sparse_dot("x", "y"), N.keep_prefix("y", None, ("c",)))[0]
    assert d == {"a": 1.0, "c": -3.0} and dot == 4.0 and kept == {"b": 2.0}
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))
    assert values(spark, row, "x map<string,double>, y map<string,double>", N.jaccard(a, b), N.coverage(b, a), N.discounted(F.array(F.lit(1.0), F.lit(1.0))))[0] == (0.5, 1.0, 1.9)
