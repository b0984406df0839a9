"""Line dedup, sort-means and hard negatives against brute force on small and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from waymark.llm import clustering, hard_negatives, line_dedup

DOCS = "doc_id long, text string"


def brute_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute_lines(rows, min_docs=10, keep_first=False):
    """(doc_id, lines, dropped, kept text) of (doc_id, text) rows, in order."""
    texts, docs, first = [(i, (t or "").split("\n")) for i, t in rows], {}, {}
    for r, (_, lines) in enumerate(texts):
        for p, line in enumerate(lines):
            docs.setdefault(brute_key(line), set()).add(r)
            first.setdefault(brute_key(line), (r, p))
    gone = lambda r, p, line: (k := brute_key(line)) and len(docs[k]) >= min_docs and not (keep_first and first[k] == (r, p))
    out = []
    for r, (i, lines) in enumerate(texts):
        kept = [line for p, line in enumerate(lines) if not gone(r, p, line)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def odd_texts():
    rng = random.Random(11)
    lines = ["Read more", " read MORE\t", "É", "é", "", "  ", "a\rb", "x" * 5000, *(f"line {k}" for k in range(60))]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(i, "Share this page\n" + str(i)) for i in range(1000, 1060)]
    return [*rows, (2000, None), (2001, ""), (2002, "\n\n"), (2003, "\n".join(["line 1"] * 40000)), (None, "line 1\nonly here"), (7, "line 2"), (7, "line 2")]


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("partitions", [1, 5])
def test_lines_of_enough_documents_go(spark, partitions):
    rows = odd_texts()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", n_lines int, keep string").repartition(partitions)
    found = line_dedup.find(df)
    got = line_dedup.apply(df, found)
    assert got.columns == ["doc_id", "text", "keep", "n_lines", "n_dropped", "kept_text"]
    assert plain((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == plain(brute_lines(rows))
    for r in found.collect():
        assert sum(k["length"] for k in r["keep"]) == r["n_lines"] - r["n_dropped"] and all(k["length"] > 0 for k in r["keep"])


def test_first_occurrences_stay(spark):
    rows = [r for r in odd_texts() if r[0] != 7]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = line_dedup.apply(df, line_dedup.find(df, min_docs=2, keep_first=True)).collect()
    assert plain((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == plain(brute_lines(rows, 2, True))


def test_a_common_line_is_split_by_chunks_and_postings_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_BITS", 3)
    df = spark.createDataFrame([(i, f"all have it\n{i}") for i in range(500)], DOCS).repartition(3)
    posted = line_dedup.postings(line_dedup.numbered(df))
    plan = line_dedup.streamed(posted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
    got = line_dedup.streamed(posted).collect()
    assert sorted({(r["h"], r["docs"]) for r in got}, key=lambda x: x[1])[-1][1] == 500 and sum(r["docs"] == 1 for r in got) == 500
    assert sum(r["docs"] == 500 for r in got) >= 60  # chunks of eight documents


def test_no_documents_have_no_lines(spark):
    df = spark.createDataFrame([], DOCS)
    assert line_dedup.apply(df, line_dedup.find(df)).count() == 0


def brute_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [int(np.floor(scale * float(c))) for c in x]) for i, x in rows if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [x for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, c) in zip(kept, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, own, strict=True)]


def vectors(n, dim, seed, spread=3):
    rng = np.random.default_rng(seed)
    return [[float(c) for c in rng.integers(-spread, spread + 1, dim) / 4] for _ in range(n)]


@pytest.mark.parametrize(("dim", "rows", "k", "rounds"), [(2, 300, 8, 10), (3, 5, 8, 4), (2, 40, 1, 2), (4, 60, 6, 0)])
def test_sort_means_equals_whole_search(spark, dim, rows, k, rounds):
    data = [(i % 250, v) for i, v in enumerate(vectors(rows, dim, rows))]  # small whole numbers: many ties and equal vectors
    odd = [(900, None), (901, []), (902, [0.5] * (dim + 1)), (903, [None] * dim), (904, [float("nan")] * dim), (905, [float("inf")] * dim), (906, [1e300] * dim), (None, [0.25] * dim), data[0], data[0]]
    table = [(*r, 5) for r in data + odd]
    got = clustering.cluster(spark.createDataFrame(table, "vec_id long, embedding array<double>, cluster int").repartition(3), k, rounds, dim=dim)
    want = brute_clusters([r for r in data + odd if r[0] != 906], k, rounds, dim, 1024, 3)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(want)


def test_a_scan_stops_and_finds_the_nearest():
    rng = np.random.default_rng(5)
    centroids, x = rng.integers(-50, 50, (30, 3)), rng.integers(-60, 60, (500, 3))
    gaps = np.array([clustering.squared(centroids, c) for c in centroids])
    order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(gaps)])
    apart = np.take_along_axis(gaps, order, axis=1)
    all_far = np.array([clustering.squared(x, c) for c in centroids])
    cluster, distance = clustering.nearest(x, rng.integers(0, 30, 500), centroids, order, apart)
    assert (cluster == all_far.argmin(axis=0)).all() and (distance == all_far.min(axis=0)).all()


def test_no_vectors_have_no_clusters(spark):
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_negatives(rows, positives, negatives, every):
    kept = [(n, i, y, [int(np.floor(256 * float(c))) for c in x]) for n, (i, x, y) in enumerate(rows) if i is not None and y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for n, i, y, x in kept:
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, w, strict=True)), j, m, z) for m, j, z, w in kept if m != n and len(w) == len(x))
        for p, j, _, _ in [s for s in scored if s[3] == y][:positives]:
            own = [s for s in scored if s[3] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(own, 1)]
    return out


@pytest.mark.parametrize(("block", "columns"), [(1 << 21, 4096), (2000, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, columns):
    monkeypatch.setattr(hard_negatives, "COLUMNS", columns)
    monkeypatch.setattr(hard_negatives, "ROWS", 3)
    rng = random.Random(2)
    rows = [(i, v, rng.randint(0, 3)) for i, v in enumerate(vectors(220, 4, 9))]
    rows += [(300 + i, [0.5, 0.5, 0.25, 0.0], i % 2) for i in range(60)]  # one vector many times
    rows += [(400, [1.0, 2.0], 1), (401, [1.0, 1.0], 1), (402, [1.0, 0.5], 2), (500, None, 1), (501, [0.1], None), (None, [0.1], 1), (502, [None], 1), (503, [float("nan")], 1), (504, [], 1), (510, [], 1), (511, [], 2)]
    rows += [rows[0], rows[10], (-10, [-0.5, 0.25, 0.25, 0.5], 2), (0, [0.25, 0.25, 0.25, 0.25], 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(3)
    got = hard_negatives.mine(df, positives=3, negatives=4, every=10, block_numbers=block).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert plain(tuple(r[n] for n in names) for r in got) == plain(brute_negatives(rows, 3, 4, 10))


@pytest.mark.parametrize("columns", [4096, 5])
def test_large_components_are_exact(spark, monkeypatch, columns):
    monkeypatch.setattr(hard_negatives, "COLUMNS", columns)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.5, 3.25, 20_000.0, 4e6 - rng.randint(0, 9)]) * rng.choice([1, 1, -1]) for _ in range(4)], rng.randint(0, 2)) for i in range(150)]
    rows += [(200 + i, [4e6, 4e6, 4e6, 4e6 - i % 3], i % 2) for i in range(20)] + [(400 + i, v, i % 2) for i, v in enumerate(vectors(40, 3, 6))] + [(300 + i, [2e6, 2e6, 2e6, 2e6 - i / 256], 2) for i in range(20)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), positives=3, negatives=4, every=10).collect()
    want = brute_negatives(rows, 3, 4, 10)
    assert plain(map(tuple, got)) == plain(want) and any(abs(r[5]) > 1 << 57 for r in want) and any(abs(r[5]) < 1 << 30 for r in want)


def test_shares_equal_whole_numbers():
    p = np.array([0, 1, 99, 100, 101, -1, -99, -101, (1 << 62) - 1, 3 - (1 << 62), 12_345_678_901_234_567], dtype=np.int64)
    for h in (30, 90):
        up, down = hard_negatives.share(p, h)
        assert up.tolist() == [-(-h * int(x) // 100) for x in p] and down.tolist() == [h * int(x) // 100 for x in p]


def test_labels_move_on(spark):
    df = spark.createDataFrame([(7, 9), (14, None), (8, 3), (None, 4)], "vec_id long, label int")
    assert sorted(map(repr, map(tuple, hard_negatives.relabelled(df).collect()))) == sorted(map(repr, [(7, 0), (14, None), (8, 3), (None, 4)]))


def test_large_components_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1e300, 1.0], 1), (3, [0.5, 0.5], 2), (4, [-1e9, 0.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3, 2 * 256 * 256, 2 * 256 * 128)]
