import hashlib
import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from waymark.llm import components, jaccard

def test_near_copies_meet_as_small_differences():
    """Blocks hold what texts differ by, whatever the texts' length; whole texts lie in no pair of blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    columns = {"key": [1] * 40, "lo": [0] * 20 + [1] * 20, "hi": [0] * 20 + [1] * 20, "share": [2.0] * 40, "node": list(range(40)), "text": texts}
    kinds = {"key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "share": pa.float64(), "node": pa.int64(), "text": pa.string()}
    batch = pa.record_batch([pa.array(v, type=kinds[k]) for k, v in columns.items()], names=list(columns))
    rows = [r for b in jaccard.differences(iter([batch.slice(0, 13), batch.slice(13)])) for r in b.to_pylist()]
    heads = [r for r in rows if r["node"] == jaccard.HEAD]
    assert [(r["own"], r["minus"]) for r in heads] == [(0, []), (1, [])] and all(len(r["plus"]) > 2900 for r in heads)
    sets = jaccard.sets_of([t.encode() for t in texts])
    for r in rows:
        if r["node"] != jaccard.HEAD:
            assert len(r["plus"]) + len(r["minus"]) <= 30
            whole = set(heads[r["own"]]["plus"]) - set(r["minus"]) | set(r["plus"])
            assert whole == set(sets[r["node"]].view(np.int64).tolist())


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(fresh(rng.randint(1, 120))) for _ in range(80)]
    base = fresh(200)
    for _ in range(40):  # near copies of one text, some linked only through others
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    passage = " ".join(fresh(60))
    texts += [" ".join(fresh(60)) + " " + passage for _ in range(30)]  # a shared passage alone is no link
    texts += [texts[80].upper(), texts[80].replace(" ", "  "), "a b c", "A  b c!", "x", "", "...", None, "w1 " * 20_000]
    texts += [texts[0]] * 25
    return texts


def words_of(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        alone = unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI"))
        if alone or unicodedata.category(c)[0] in "PSZC":
            out += [run] * bool(run) + [c] * alone
            run = ""
        else:
            run += c
    return out


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    low = [(t or "").lower() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
            if low[i] != low[j]:
                links[i].add(low[j])
                links[j].add(low[i])
    return [find(i) for i in range(len(texts))], [len(x) for x in links]


@pytest.mark.parametrize("chars", [1 << 23, 4_000])
def test_join_equals_brute_force(spark, monkeypatch, chars):
    texts = corpus()
    monkeypatch.setattr(jaccard, "VERIFY_CHARS", chars)
    monkeypatch.setattr(jaccard, "PRUNE_BLOCK", 16)
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", 8)
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in enumerate(texts)], DOCS + ", node long").repartition(6)
    got = sorted(jaccard.join(df).collect(), key=lambda r: r["doc_id"])
    classes, links = brute(texts)
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert [r["class_id"] for r in got] == classes
    assert [r["n_links"] for r in got] == links
    assert got[0]["n_copies"] == 26 == got[-1]["n_copies"]


def test_repeated_and_null_ids_lose_no_link_and_make_none(spark):
    rng = random.Random(7)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    dashed = [f"w{rng.randrange(999)}" for _ in range(60)]
    texts = corpus(2)[:130] + [han, han[:60] + "\u4e00" + han[61:], " ".join(dashed), "\u2014".join(dashed), "\u2014 \u00ab" + " \u2026 ".join(dashed), "\u2014", "\u4e8c", "", None, "\u0e01\u0e02 \u3042!"]
    ids = [rng.choice([None, 5, 5, 6, i, i]) for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (5, texts[0]), (None, texts[85]), (None, texts[85]), (6, texts[85]), (7, ""), (7, None), (7, texts[3])]
    got = jaccard.join(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(5)).collect()
    classes, links = brute([t for _, t in rows])
    # A row by its id, its text's class (blank texts: its id) and links; the classes themselves are compared as partitions.
    low = [(t or "").lower() for _, t in rows]
    label = lambda i: ("blank", rows[i][0]) if not shingle_set(rows[i][1]) else classes[i]
    key_of = {hashlib.md5(t.encode()).hexdigest(): t for t in low}
    want = sorted((str(rows[i][0]), low[i], links[i]) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), key_of[r["key"]], r["n_links"]) for r in got) == want
    label_of = {(str(rows[i][0]), low[i]): label(i) for i in range(len(rows))}
    pairs = {(r["class_id"], str(label_of[str(r["doc_id"]), key_of[r["key"]]])) for r in got if shingle_set(key_of[r["key"]])}
    assert len({c for c, _ in pairs}) == len(pairs) == len({x for _, x in pairs})
    leads = [(str(r["doc_id"]), key_of[r["key"]]) for r in got if r["lead"]]
    assert {str(label_of[x]) for x in leads} == {str(label(i)) for i in range(len(rows))}
    assert len({label_of[x] for x in set(leads)}) == len({x for x in set(leads) if shingle_set(x[1])}) + len({x[0] for x in leads if not shingle_set(x[1])})


def test_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (None, t + " eight"), (3, t), (3, "other text of more than five words"), (4, "Other text of more than five words"), (5, None), (5, None)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["class_id"] is not None for r in got)
    assert len({r["class_id"] for r in got if r["doc_id"] in (3, 4)}) == 2  # two texts of one id are two classes
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_least_matches_is_the_posterior():
    rng = np.random.default_rng(0)
    (n, m) = jaccard.least_matches(0.8, 32, 32, 0.01)[0]
    above = lambda k: (rng.beta(k + 1, n - k + 1, 200_000) >= 0.8).mean()
    assert above(m) >= 0.009 and above(m - 1) <= 0.011


def test_minhash_estimates_jaccard():
    a = " ".join(f"x{i}" for i in range(400))
    b = " ".join(f"x{i}" if i < 360 else f"y{i}" for i in range(400))
    va, vb = (np.frombuffer(x, "<u2") for x in jaccard.signatures([a.encode(), b.encode()]))
    true = len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    assert abs((va == vb).mean() - true) < 0.12


def test_shingles_equal_texts_alone_or_together():
    texts = [t.lower().encode() for t in corpus() if t]
    h, n = jaccard.shingles(texts)
    parts = np.split(h, np.cumsum(n)[:-1])
    for t, p in zip(texts, parts, strict=True):
        assert jaccard.shingles([t])[0].tolist() == p.tolist()
        assert len(set(p.tolist())) == len(shingle_set(t.decode()))


def test_words_of_any_script():
    for t in ("caf\u00e9\u2014au lait \u00abx\u00bb", "\u65e5\u672c\u8a9e\u306e\u6587 and words", "\u0e44\u0e17\u0e22 a", "\u043c\u0438\u0440, \u2026\u043c\u0438\u0440\u2019\u0441"):
        raw = jaccard.plain(t)
        blank = jaccard.BLANK[np.frombuffer(raw, np.uint8)]
        assert "".join(" " if x else chr(c) for c, x in zip(raw, blank, strict=True)).split() == [w.encode().decode("latin-1") for w in words_of(t)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    letters = [chr(97 + i // 10) + chr(97 + i % 10) for i in range(90)]
    words = {"en": [f"th{x}e" for x in letters], "de": [f"sch{x}ung" for x in letters]}
    rows, labels = [], []
    for i in range(500):
        lang = rng.choice(["en", "en", "de"])
        w = [rng.choice(words[lang]) for _ in range(rng.randint(8, 80))]
        bad = rng.random() < 0.12
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["mofferel", "zorgling"]))
        rows.append((i, " ".join(w), lang, "hot" if i % 3 == 0 else f"s{i % 4}", 1))
        labels.append((i, 1, int(bad)))
    clean = next(r for r, l in zip(rows, labels, strict=True) if not l[2] and len(r[1].split()) > 40)
    rows += [(1000 + i, clean[1], clean[2], "hot", 1) for i in range(30)] + [(2000, "", "en", "s1", 0), (2001, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {r[0]: r for r in rows}, {i for i, _, t in labels if t}, clean[0]


def test_pipeline_stages(spark, sf_dir):
    from waymark.llm.common import materialise

    d, rows, toxic, clean = sf_dir
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, d), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append([r["doc_id"] for r in out.collect()])
        docs = out
    known, civil, single, mixed, packed = map(set, seen)
    assert known == set(rows) - {2000, 2001}
    assert civil == known - toxic
    classes, _ = brute([rows[i][1] for i in sorted(civil)])
    order = sorted(civil)
    assert single == {order[c] for c in classes} and clean in single
    assert len(seen[2]) == len(single)
    words = {i: len(rows[i][1].split()) for i in single}
    assert mixed <= single and abs(sum(words[i] for i in seen[3]) - sum(words.values())) <= 5 * max(words.values())
    assert sorted(seen[4]) == sorted(seen[3])


def test_bins_follow_the_training_order(spark, sf_dir):
    from waymark.llm import mixing, packing
    from waymark.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    order = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    mixed = materialise(corpus_pipeline.mix(spark, docs, sf_dir[0]), "test")
    with pytest.warns(UserWarning, match="no training order"):
        assert corpus_pipeline.reading_order(spark.createDataFrame([(1, "x")], "doc_id long, text string")) is None
    assert mixed.count() == len(order)
    shard = mixed.select("doc_id", corpus_pipeline.reading_order(mixed).alias("shard")).collect()
    size = {s: sum(r["shard"] == s for r in shard) for s in {r["shard"] for r in shard}}
    at, want = 0, []
    for s in sorted(size):
        want += [(s, i) for i in order[at : at + size[s]]]
        at += size[s]
    assert sorted(want) == sorted((r["shard"], r["doc_id"]) for r in shard)
    packed = corpus_pipeline.pack(spark, mixed, sf_dir[0]).filter("bin is not null").collect()
    assert {r["bin"] >> packing.BIN_BITS for r in packed} <= set(size)


def test_a_stage_deletes_what_the_one_before_left(spark, sf_dir):
    from waymark.llm.common import made, materialise

    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    lazy = corpus_pipeline.language_id(spark, docs, sf_dir[0])
    own = {p for p in made() if any(p.split("/")[-1] in file for file in lazy.inputFiles())}
    n = corpus_pipeline.toxic(spark, lazy, sf_dir[0]).count()  # not written between: the tables that it reads stay
    assert own <= set(made()) and n == lazy.join(spark.read.parquet(f"{sf_dir[0]}/labels.parquet"), "doc_id", "left").filter("toxic is null or toxic = 0").count()
    first = materialise(corpus_pipeline.language_id(spark, docs, sf_dir[0]), "test")
    left = corpus_pipeline._left[next(iter(corpus_pipeline._left))]
    assert left and set(left) <= set(made())
    assert corpus_pipeline.toxic(spark, first, sf_dir[0]).count() == n and not set(left) & set(made())


def test_language_id_neither_writes_nor_shuffles_texts(spark, sf_dir):
    from waymark.llm.common import made

    docs, before = spark.read.parquet(f"{sf_dir[0]}/documents.parquet"), set(made())
    kept = corpus_pipeline.language_id(spark, docs, sf_dir[0])
    assert all("text" not in spark.read.parquet(p).columns for p in set(made()) - before)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    many = spark.createDataFrame([(i, "the cat is on the mat and it is warm", "en", f"host{i}", 1) for i in range(300)] + [(1000 + i, None, "en", None, 0) for i in range(5)], docs.schema)
    assert corpus_pipeline.language_id(spark, many.unionByName(many), sf_dir[0]).count() == 600


def test_intermediate_tables_are_deleted(spark, sf_dir):
    from waymark.llm import common

    before = set(common._made)
    corpus_pipeline.run(spark, sf_dir[0]).collect()
    assert len(set(common._made) - before) == 1  # what the last stage reads


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    from waymark.llm.common import materialise

    names = ["bucket", "order_key", "weight", "epoch", "target", "node", "key", "class_id", "score", "language", "host", "_row", "size"]
    docs = materialise(spark.read.parquet(f"{sf_dir[0]}/documents.parquet").limit(200).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names]), "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf_dir[0]), "test")
        assert out.columns == docs.columns and not out.isEmpty()
        assert out.filter(" OR ".join(f"`{n}` != concat('{n}', doc_id)" for n in names)).isEmpty()
        docs = out
    assert corpus_pipeline.pack(spark, docs, sf_dir[0]).count() == docs.count()


def test_pipeline_of_nothing_and_of_odd_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (None, "x " * 50_000, "en", "s", 1)], docs.schema)
    for name, rows in (("none", docs.limit(0)), ("odd", odd), ("some", docs.limit(60).unionByName(odd).unionByName(odd))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf_dir[0]}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(got) <= 3 * rows.count() and (name == "some") == bool(got)


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir[0]).collect())) for _ in range(2))
    assert first == again and first
