import random

import numpy as np
import pandas as pd
import pytest
from brute import brute_features, brute_posteriors
from pyspark.sql import functions as F

from waymark.llm import ann, language, toxicity

WORDS = {"en": "the of and to in is that for it was with as".split(), "fr": "le la les des une est que pour dans qui éàç".split(), "de": "der die das und ist nicht für über von mit".split()}


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        rows.append((i, text(rng, lang), lang if rng.random() < 0.9 else rng.choice(list(WORDS)), f"h{i % 7}.example.{lang}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_language_of_clean_texts(spark, docs):
    got = language.identify(docs).collect()
    right = [r["language"] == r["source"].rsplit(".")[-1] for r in got]
    assert sum(right) / len(right) > 0.98 and all(r["kept"] for r in got)
    assert all(0 < r["posterior"] <= 1 for r in got)


def test_language_edge_cases(spark, docs):
    odd = spark.createDataFrame([(1000, None, "fr", None), (1001, "", None, "x"), (1002, "der und die", None, None), (1003, "x" * 200_000, None, "y"), (None, "le la les", "zz", "z")], docs.schema)
    both = docs.unionByName(odd).withColumns({"language": F.lit("clash"), "host": F.lit(1), "priors": F.lit(2)})
    got = {r["doc_id"]: r for r in language.identify(both).filter("doc_id >= 1000 or doc_id is null").collect()}
    assert got[1000]["language"] == "fr" and not got[1000]["kept"] and not got[1001]["kept"]
    assert got[1002]["language"] == "de" and got[1002]["kept"] and got[1002]["host"] == 1
    assert got[None]["language"] == "fr" and not got[1003]["kept"]
    assert language.identify(docs.limit(0)).collect() == []


def test_posterior_is_bayes(spark):
    """The whole posterior by plain arithmetic, with copies, ties, hosts with and without a suffix."""
    rng = random.Random(9)
    rows = [(i, text(rng, "en" if i % 3 else "fr", 1 + i % 9), rng.choice(["en", "fr", None, "zz"]), rng.choice(["a.fr", "b.fr", "c.en", "plain", None]), rng.choice(["fr", "EN", "xx", None])) for i in range(300)]
    rows += [rows[0]] * 5 + [(900, "", "fr", "a.fr", None), (901, None, None, "new.fr", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part string")
    model = language.TrigramModel.fit(language.training_rows(df, "text", "lang", "doc_id"))
    assert model.langs == ("en", "fr", "zz", "und")  # whatever five rows declare is a language
    order = lambda r: tuple("-" if v is None else v for v in r)
    got = sorted((order(r[:5]), *r[5:]) for r in language.identify(df, path="part").collect())
    want = sorted((order(r), *p) for r, p in zip(rows, brute_posteriors(model, rows), strict=True))
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3]


def test_rare_language_is_known_at_every_size(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, "en" if i % 2 else "fr", 8), "en" if i % 2 else "fr") for i in range(10_000)]
    rows += [(20_000 + i, " ".join(rng.choice(["ordu", "eta", "hau", "zen", "gure", "izan"]) for _ in range(30)), "eu") for i in range(language.LEAST_ROWS)]
    rows += [(None, "0123", "en")] * 20 + [(None, "\u4e00" * 3, "zh")] * (language.LEAST_ROWS - 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_rows(df, "text", "lang", "doc_id")
    assert 1500 < len(sample) < 2500 and {lang for lang, _ in sample} == {"en", "fr", "eu"}
    assert language.TrigramModel.fit([*sample, ("en", "0123")]).langs == ("en", "eu", "fr", "und")
    got = language.identify(df, host=None).filter("doc_id >= 20000").collect()
    assert len(got) == language.LEAST_ROWS and all(r["language"] == "eu" and r["kept"] for r in got)


def test_copies_bound_the_sample(spark):
    rows = [(1, "the same text", "en")] * 30_000 + [(i, f"le texte {i}", "fr") for i in range(100)] + [(i, "drei", "de") for i in range(language.LEAST_ROWS)]
    sample = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert sum(lang == "en" for lang, _ in sample) <= language.LEAST_ROWS and sum(lang == "fr" for lang, _ in sample) == 100 and sample.count(("de", "drei")) == language.LEAST_ROWS


def test_rows_a_language():
    assert language.rows_a_language([5, 300, 1000]) == 1000  # fewer than TRAIN_ROWS: all of them
    assert language.rows_a_language([5, 5000, 5000]) == 997 and language.rows_a_language([9000] * 200) == language.LANGUAGE_ROWS


def test_host_priors_are_smoothed_by_level(spark):
    rows = [("a.x.fr", "fr")] * 50 + [("b.x.fr", "de")] + [("plain", "de")] * 10 + [(None, None)]
    got = {r["_prior_host"]: np.exp(r["_priors"]) for r in language.host_priors(spark.createDataFrame(rows, "host string, says string"), ("de", "fr", "und")).collect()}
    assert got["a.x.fr"][1] > got["b.x.fr"][1] > 0.5 and got["plain"][0] > 0.5
    top = (np.array([11, 50]) + 20 * 0.5) / (61 + 20)
    up = (np.array([1, 50]) + 20 * top) / (51 + 20)
    assert got["b.x.fr"][:2] == pytest.approx((np.array([1, 0]) + 20 * up) / 21 * (1 - language.UNKNOWN_PRIOR))


def test_grammar_marks_events():
    scorer = toxicity.ClauseScorer(toxicity.Lexicon({"idio": 2.0}))
    at = lambda t: [i for i, x in enumerate(scorer(t)[:16]) if x]
    assert at("what an idiot") == [0]
    assert at("you idiot") == [1] and at("idiot, you") == [0]  # the target counts within its clause
    assert at("he is not an idiot") == [5] and at("she said idiot") == [3]
    assert at("not one two three idiot") == [0]  # beyond the negation's reach
    assert at("I will kill it") == [8] and at("kill you") == [9]
    assert at("skill and videoidiot") == [] and scorer(None) == scorer("") == [0.0] * toxicity.FEATURES


def test_scorer_equals_rules_on_random_texts():
    rng = random.Random(11)
    lexicon = {"idio": 2.0, "idiotic": 3.5, "moron ": 1.5, "kill": 1.0, "schwach": 2.5}
    scorer = toxicity.ClauseScorer(toxicity.Lexicon(lexicon))
    words = ["idiot", "Idiotic", "moron", "morons", "killer", "destroy", "beat", "schwachkopf", "not", "never", "said", "quoted", "you", "sie", "the", "a", "x1y", "42", "is", "no", "\u00e9crit", "videoidiot"]
    for _ in range(400):
        t = "".join(rng.choice(words) + rng.choice([" "] * 8 + [". ", ", ", "\n", "  ", "-", "(", "!"]) for _ in range(rng.randint(0, 40)))
        assert scorer(t) == pytest.approx(brute_features(lexicon, t), abs=1e-12), t


def test_whole_clauses_are_read_whatever_their_length():
    scorer = toxicity.ClauseScorer(toxicity.Lexicon({"idiot": 1.0}))
    at = lambda t: [i for i, x in enumerate(scorer(t)[:16]) if x]
    for n in (20, 100, 2_000):
        filler = "word " * n
        assert at(f"he said {filler}you idiot") == [3] and at(f"idiot {filler}you") == [1]
        assert at(f"{filler}. idiot {filler}") == [0]
    many = "idiot " + "word " * 200
    assert scorer(many * 50)[:16] == pytest.approx(brute_features({"idiot": 1.0}, many * 50)[:16])


def test_lexicon_has_no_limit_on_stems(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnop"
    code = lambda i: "".join(letters[(i >> (4 * k)) & 15] for k in range(4))
    bad = [f"{code(i)}zz" for i in range(3_000)]
    rows = [(" ".join(rng.choice(bad) for _ in range(300)), 1) for _ in range(120)] + [(" ".join(f"q{code(rng.randrange(500))}" for _ in range(30)), 0) for _ in range(600)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int")).stems
    assert len(got) > 2_000 and all(s.strip() in w for s in got for w in [next(b for b in bad if b.startswith(s.strip()))])


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.15
        words = [rng.choice(WORDS["en"]) + rng.choice("abcdef") for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgling", "zorglet", "quabish", "mofferel"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows + [(9000, None, "x"), (9001, "", "x"), (None, "zorgling", "x"), (9002, "zorglet " * 50_000, "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(9000, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, lab).withColumn("fold", toxicity.fold()).collect()}
    held = [(got[i]["predicted"], bad) for i, bad in labels if got[i]["fold"] == 2]
    assert len(held) > 500 and sum(p == b for p, b in held) / len(held) > 0.99
    assert got[9000]["predicted"] == got[9001]["predicted"] == 0 and got[9002]["predicted"] == got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    twice = toxicity.labelled(df.unionByName(df), lab)  # a row for each labelled id, however often it repeats
    assert twice.count() == toxicity.labelled(df, lab).count() <= 3000
    none = toxicity.score(df, lab.limit(0)).collect()
    assert len(none) == df.count() and all(0 <= r["score"] <= 1 for r in none)
    assert toxicity.score(df.limit(0), lab).collect() == []


def brute(ids, v, every, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            c = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
            own = [j for j in np.lexsort((ids, -c)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), float(c[j])) for j in own]
    return out


def recall(got, want):
    return sum(len({i for i, _ in w} & {i for i, _ in got[q].values()}) for q, w in want.items()) / sum(map(len, want.values()))


def by_query(rows):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return got


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    v[100:160] = v[100]  # ties
    rows = [(int(i), x.tolist(), "clash") for i, x in enumerate(v)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [1.0, None] * 8), (5150, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + [(*r, "x") for r in odd], "vec_id long, embedding array<double>, near string").withColumns({"row": F.lit(1), "dim": F.lit(2), "block": F.lit("b")}).repartition(3)
    want = brute(np.arange(3000), v, 50, 5)
    for settings in ({}, {"least_rows": 64, "block": 100, "visit": 14, "pivots": 48, "least": 0}):  # one file; many files, of which a query walks some and some are cut
        got = by_query(ann.search(df, **settings).collect())
        assert set(got) == set(want) and recall(got, want) >= 0.9
        assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
        exact = lambda q, i: float((v[q] * v[i]).sum() / np.sqrt((v[q] * v[q]).sum() * (v[i] * v[i]).sum()))
        for q, own in got.items():
            assert sorted(own) == [1, 2, 3, 4, 5]
            assert all(s == pytest.approx(exact(q, i), abs=1e-12) for i, s in own.values())


def test_ann_walks_few_files_of_fifty_thousand_vectors(spark):
    """Default settings on many files, over vectors that hardly have neighbours (the nearest has a cosine near 0.5)."""
    n, rng = 50_000, np.random.default_rng(8)
    v = rng.normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(v)})).repartition(8)
    got = by_query(ann.search(df).collect())
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = np.arange(0, n, 50)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -9
    best = np.argpartition(-near, 5, axis=1)[:, :5]
    hits = sum(len({i for i, _ in got[q].values()} & set(own)) for q, own in zip(asked.tolist(), best.tolist(), strict=True))
    index = ann.build(df)
    walked = index.queries().select(F.col("u").alias("q"), "file").join(index.posted().select("u", "file"), "file").distinct().select("q", "u").distinct()
    assert set(got) == set(asked.tolist()) and hits / (5 * len(asked)) >= 0.9
    assert walked.count() / len(asked) <= 0.28 * n


def test_ann_copies_are_one_entry(spark, monkeypatch):
    monkeypatch.setattr(ann, "COPIES", 7)
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, size=(900, 6)).astype(float)
    v[::3] = [1.0, 2.0, 3.0, -1.0, 0.0, 1.0]  # a third of all rows
    v[(v == 0).all(axis=1)] = 1.0
    df = spark.createDataFrame([(int(i) % 880, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    index = ann.build(df, every=10)
    assert index.entries.count() == len(np.unique(v, axis=0)) and index.members.count() == 900
    got = ann.search(df, every=10).collect()
    cosine = lambda a, b: (v[a] * v[b]).sum() / np.sqrt((v[a] * v[a]).sum() * (v[b] * v[b]).sum())
    want = []
    for q in range(900):
        if q % 880 % 10 == 0:
            own = sorted((-round(cosine(q, j), 9), j % 880) for j in range(900) if j != q)[:5]
            want += [(q % 880, n, j, -c) for n, (c, j) in enumerate(own, 1)]
    assert sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got) == sorted((q, n, c) for q, n, _, c in want)
    best = {(q, j) for q, n, j, c in want if c == 1.0}
    assert {(r["query_id"], r["vec_id"]) for r in got if round(r["score"], 9) == 1.0} == best


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1e200, 1e200])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df).collect())
    assert got == [(0, 1, 3, 0.707107), (0, 2, 50, 0.0), (50, 1, 3, 0.707107), (50, 2, 0, 0.0)]
    assert ann.search(df.limit(0)).collect() == []


def test_ann_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (7, [1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (8, [3.0, 2.0, 1.0]), (100, [4.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 3)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0, 0.995), (0, 1, 7, 1.0), (0, 2, 0, 0.995), (0, 2, 7, 0.995), (50, 1, 8, 0.714)]


def test_footrule_is_what_a_file_is_ranked_by():
    rng = np.random.default_rng(4)
    v, pivots, prefix = rng.normal(size=(60, 8)), ann.directions(rng.normal(size=(20, 8))), 6
    order = ann.orders(v, pivots, 12)
    rows, cosines = ann.ranked(v, ann.norms(v), order[:, :prefix], v[:5], order[:5], 20, 18)
    for q in range(5):
        rank = [list(order[q]).index(p) if p in order[q] else 12 for p in range(20)]
        footrule = np.array([sum(abs(rank[p] - j) for j, p in enumerate(order[x, :prefix])) for x in range(60)])
        assert set(rows[q]) == set(np.lexsort((np.arange(60), footrule))[:18])
        assert cosines[q] == pytest.approx((v[rows[q]] @ v[q]) / (ann.norms(v[rows[q]]) * ann.norms(v[q : q + 1])))


def test_pivots_are_centres(spark):
    rng = np.random.default_rng(1)
    centres = ann.directions(rng.normal(size=(4, 5)))
    sample = np.concatenate([centres[i % 4][None] * rng.uniform(0.1, 9) + rng.normal(size=(1, 5)) * 1e-3 for i in range(200)])
    found = ann.fitted(sample, 4)
    assert (found @ centres.T).max(axis=1) == pytest.approx(np.ones(4), abs=1e-3)
    assert len(ann.fitted(sample[:3], 3)) == 3
