import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing, packing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_targets_fill_up_to_caps(spark):
    rows = [("a", 1000), ("b", 10), ("c", 500), ("d", 0), (None, 100)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert [got[s]["weight"] for s in ("a", "b", "c", "d", None)] == [1, 2, 3, 1, 2]
    # Brute force: reshare the excess of capped sources until none is above.
    weight, cap = {s: got[s]["weight"] for s, _ in rows}, {s: 3.0 * n for s, n in rows}
    target, open_, left = {}, set(cap), 1610.0
    while True:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > cap[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    for s in cap:
        assert got[s]["target"] == pytest.approx(target[s])


def test_mix_takes_the_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a"] * 6 + ["b", "c", None]), 1) for i in range(900)]
    rows += [rows[0], rows[0], (900, None, "en", "a", 0), (901, "x " * 5000, "en", "b", 0), (None, "q r s", "en", "c", 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", size long").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(0 <= r["position"] <= 1 for r in own if r["taken"])
    narrow = mixing.mix(df, keep=["doc_id", "source"])
    assert narrow.columns == ["doc_id", "source", *mixing.RESULT]
    plain = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"], r["position"] or -1)
    assert sorted(map(plain, narrow.collect())) == sorted(map(plain, got))
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"], r["position"] or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))
    copies = mixing.curriculum(df)
    assert copies.columns == [*df.columns, "epoch", "position"]
    places = [r["position"] for r in copies.collect()]
    assert places == sorted(places) and len(places) == sum(r["epochs"] for r in got)


def test_columns_of_any_name_stay(spark):
    names = ["bucket", "order_key", "weight", "epoch", "target", "position", "size", "taken", "stream_start", "o_source"]
    rows = [(i, f"word {'x ' * (i % 9)}", "s" if i % 3 else None, *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.curriculum(df, numbered=False)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert mixing.curriculum(df).columns == [c for c in df.columns if c not in ("epoch", "position")] + ["epoch", "position"]
    mixed = mixing.mix(df).collect()
    assert all((r["bucket"], r["order_key"], r["weight"], r["epoch"]) == tuple(f"{n}{r['doc_id']}" for n in ("bucket", "order_key", "weight", "epoch")) for r in mixed)


def test_null_and_repeated_ids_fill_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)  # more digits change no place
    rows = [(None if i % 2 else 7, f"a b {i}", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    many = sorted((r["text"], r["taken"], r["position"]) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1 << 16)
    assert sorted((r["text"], r["taken"], r["position"]) for r in mixing.mix(df).collect()) == many


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == [] and mixing.curriculum(empty).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


def test_schedule_is_inverted(spark):
    for tilt in (-0.5, 0.0, 0.5):
        for t in (0.0, 0.1, 0.5, 1.0):
            demand = (1 - tilt) * t + tilt * t * t
            got = spark.range(1).select(mixing.position_at(F.lit(demand), F.lit(tilt)).alias("t")).first()["t"]
            assert got == pytest.approx(t, abs=1e-12)


def brute_best_fit(sizes, sources, clusters, capacity, limit):
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        fit = [(b["free"], b["since"], i) for i, b in enumerate(bins) if b["free"] >= s and b["sources"].count(a) < limit and c not in b["clusters"]]
        if fit:
            i = min(fit)[2]
        else:
            bins.append({"free": capacity, "sources": [], "clusters": set(), "since": -1})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["free"]))
        b["free"] -= s
        b["sources"].append(a)
        b["clusters"].add(c)
        b["since"] = len(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_best_fit_under_conflicts(seed):
    rng = np.random.default_rng(seed)
    n = 300
    sizes = np.sort(rng.integers(1, 100, n))[::-1]
    sources, clusters = rng.choice([1, 1, 1, 2, 3, 4], n), rng.integers(0, 60, n)
    where, offset, free = packing.pack_shard(sizes, sources, clusters, 100, 2)
    assert list(zip(where.tolist(), offset.tolist(), strict=True)) == brute_best_fit(sizes, sources, clusters, 100, 2)
    assert all(f == 100 - sizes[where == b].sum() for b, f in zip(where, free, strict=True))


def test_pack_table(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(400)]
    rows += [(1000 + i, "copy of one text", "en", "x", 1) for i in range(60)] + [(2000, None, "en", None, 0), (2001, "", "en", None, 0), (2002, "v " * 1000, "en", None, 0), rows[5], (None, "n", None, None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], DOCS + ", bin long")
    got = packing.pack(df, capacity=100, max_per_source=3, shard_rows=128).collect()
    assert len(got) == len(rows)
    bins = {}
    for r in got:
        assert r["size"] == r["full_bins"] * 100 + r["tail"] and (r["bin"] is None) == (r["tail"] == 0)
        if r["bin"] is not None:
            bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        assert sum(r["tail"] for r in own) + own[0]["bin_free"] == 100
        names = [r["source"] for r in own]
        assert max(map(names.count, names)) <= 3
        assert sum(1000 <= (r["doc_id"] or 0) < 1060 for r in own) <= 1
        spans = sorted((r["bin_offset"], r["tail"]) for r in own)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert packing.pack(df.limit(0)).collect() == []


def test_identical_rows_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 1 << 13)
    same = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("hot").alias("source"))
    mixed = same.unionByName(spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("source")))
    got = packing.pack(mixed)
    per = got.groupBy((F.col("bin") / (1 << packing.BIN_BITS)).cast("long").alias("shard")).count().collect()
    assert sum(r["count"] for r in per) == 201_000 and max(r["count"] for r in per) < 2 * packing.SHARD_ROWS
    assert got.groupBy("bin").agg(F.count_if(F.col("doc_id") == 1).alias("n")).filter("n > 1").isEmpty()


def test_pack_by_given_shards(spark):
    df = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 7}") for i in range(300)], "doc_id long, text string, source string")
    got = packing.pack(df, capacity=60, shard=F.floor(F.col("doc_id") / 100)).collect()
    assert len(got) == 300 and all(r["bin"] >> packing.BIN_BITS == r["doc_id"] // 100 for r in got)
    for k in range(3):
        own = sorted((r for r in got if r["doc_id"] // 100 == k), key=lambda r: r["doc_id"])
        sizes = sorted(((r["size"], r["doc_id"]) for r in own), reverse=True)
        assert sum(s for s, _ in sizes) == sum({r["bin"]: 60 - r["bin_free"] for r in own}.values())


def glob_fits(glob, text):
    import re

    parts = {"any": "[\\s\\S]*", "part": "[^/]*", "one": "[\\s\\S]"}
    pattern = b"".join(parts[k].encode() if k != "byte" else re.escape(bytes([b])) for k, b in url_filter.tokens(glob))
    return re.fullmatch(pattern, text) is not None


def test_automaton_equals_regular_expressions():
    rng = random.Random(5)
    globs = ["", "*", "**", "a*b", "**b?", "*a/**", "?", "a" * 70 + "*", "**" + "ab" * 50, "/*/**/x", "*?*", "é*"]
    urls = ["".join(rng.choice("ab/xé") for _ in range(rng.randint(0, 12))).encode() for _ in range(500)] + [b"a" * 75, b"zz" + b"ab" * 50, b"", b"a" * 3000]
    machine = url_filter.Automaton.compile(globs)
    assert machine.words > 1
    hits = machine.hits(machine.run(urls))
    for u, row in zip(urls, hits, strict=True):
        assert [bool(x) for x in row] == [glob_fits(g, u) for g in globs], u


def test_judge(spark):
    urls = {
        "http://Sub.Example.ORG/es/x?q": ("sub.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://a.org/es/": ("a.org", "/es/", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://org/": ("org", "/", "org/", "allow"),
        "https://a.org": ("a.org", "", None, "allow"),
        "https://a.com/fr/a.org/": ("a.com", "/fr/a.org/", "com/fr/", "allow"),
        "https://x.net/a.org/": ("x.net", "/a.org/", None, "allow"),
        "http://www.casino-win.net/": ("www.casino-win.net", "/", None, "block"),
        "https://casino.com/fr/": ("casino.com", "/fr/", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://x.net/" + "a/" * 30_000: ("x.net", "/" + "a/" * 30_000, None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(url_filter.judge(df).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(urls.values())
    assert url_filter.judge(df.limit(0)).collect() == []


def test_null_clusters_conflict_with_nothing(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i}") for i in range(200)], "doc_id long, text string, source string")
    bins = lambda cluster: {r["bin"] for r in packing.pack(df, capacity=2048, cluster=cluster).collect()}
    assert len(bins(F.lit(None).cast("long"))) == 1 and len(bins(F.when(F.col("doc_id") >= 10, F.lit(7)))) == 190 and len(bins(F.lit(0))) == 200


def test_copies_take_places_in_turn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = [(i % 3, "w " * (i % 3 + 1), "a") for i in range(50)] + [(9, "x y z", s) for s in ("a", "b", None)] * 11 + [(None, None, "b")] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plain = lambda frame: sorted(map(repr, (tuple(r) for r in frame.select("doc_id", "source", *mixing.RESULT).collect())))
    assert plain(mixing.mix(df, keep=["doc_id", "source"])) == plain(mixing.mix(df))
    assert mixing.mix(df, keep=["doc_id"]).columns == ["doc_id", *mixing.RESULT]
