"""The registered queries against brute force (or SQL) over the smallest driver tables."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import brute_features, brute_lexicon, brute_posteriors
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from waymark.llm import language, packing, toxicity
from waymark.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    return lambda table: con.execute(f"SELECT * FROM read_parquet('{DATA}/{table}.parquet')").fetchall()


def run(spark, name):
    return __spark_entry__.queries()[name](spark, DATA)


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    df = run(spark, name)
    found = con.execute(Q.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda r, cols: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in (r[c] for c in cols))
    cols = sorted(names)
    assert sorted(plain(r, cols) for r in df.collect()) == sorted(plain(dict(zip(names, r, strict=True)), cols) for r in found.fetchall())


def test_op5(spark, rows):
    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for doc, text, *_ in sorted(rows("documents")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op5_token_files").collect()} == want


def test_op6(spark, rows):
    docs, labels = rows("documents"), {r[0]: r[2] for r in rows("labels") if r[2] is not None}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    sample = [(t, labels[i]) for i, t, *_ in docs if t and i in labels and fold(i) != 2]
    tables = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(*tables)
    assert model.lexicon.stems == pytest.approx(brute_lexicon(sample))
    got = {r["doc_id"]: r for r in run(spark, "op6_toxicity").collect()}
    assert set(got) == {r[0] for r in docs}
    for doc, t, *_ in docs:
        want = float(model.score(np.array([brute_features(model.lexicon.stems, t)]))[0])
        assert got[doc]["score"] == pytest.approx(want, abs=1e-9)
        assert got[doc]["held_out"] == (fold(doc) == 2) and got[doc]["predicted"] == (got[doc]["score"] >= 0.3)


def test_op7(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op7_media").collect()}
    for doc, text, *_ in rows("documents"):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > r["payload_bytes"] and r["codec"] == "raw "


def test_op8(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op8_language_id").collect()}
    docs = [(i, t, lang, source, None) for i, t, lang, source, *_ in rows("documents")]
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.TrigramModel.fit(language.training_rows(df, "text", "lang", "doc_id"))
    assert len(got) == len(docs)
    for doc, (best, posterior, kept) in zip(docs, brute_posteriors(model, docs), strict=True):
        r = got[doc[0]]
        assert (r["language"], r["kept"]) == (best, kept) and r["posterior"] == pytest.approx(posterior)
    assert sum(r["kept"] for r in got.values()) >= 0.98 * len(got)


def test_language_of_pages(spark, rows):
    pages = []
    for i, url, html, *_ in rows("pages"):
        text = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>|<[^>]+>", " ", html)
        markup = re.search(r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", html)
        parts = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        path = re.match(r"^/([a-z]{2})/", parts[2]) if parts else None
        pages.append((i, text, markup and markup[1].lower(), parts[1].lower() if parts else "", path and path[1]))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, text string, markup string")
    model = language.TrigramModel.fit(language.training_rows(df, "text", "markup", "page_id"))
    got = {r["page_id"]: r for r in run(spark, "language_of_pages").collect()}
    assert len(got) == len(pages) and len(model.langs) > 2
    for page, (best, posterior, kept) in zip(pages, brute_posteriors(model, pages), strict=True):
        r = got[page[0]]
        assert (r["language"], r["kept"], r["markup"], r["host"]) == (best, kept, page[2], page[3]) and r["posterior"] == pytest.approx(posterior)
    assert sum(r["language"] == r["markup"] for r in got.values()) >= 0.95 * len(got)


def best_fit(items, capacity, per_source):
    """(bin, offset) of (size, source, cluster) items: each goes to the tightest bin that may take it, of equally tight ones to that which has been so for the longest."""
    counts, bins, out, clock = Counter(c for _, _, c in items), [], [], 0
    for size, source, cluster in items:
        fit = [b for b in bins if b["free"] >= size and b["sources"][source] < per_source and not (counts[cluster] > 1 and cluster in b["clusters"])]
        if not fit:
            fit = [{"free": capacity, "since": 0, "sources": Counter(), "clusters": set(), "n": len(bins)}]
            bins += fit
        b, clock = min(fit, key=lambda b: (b["free"], b["since"])), clock + 1
        out.append((b["n"], capacity - b["free"]))
        b |= {"free": b["free"] - size, "since": clock}
        b["sources"][source] += 1
        b["clusters"].add(cluster)
    return out, [b["free"] for b in bins]


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.1"])
def test_op1(spark, folder):
    """Sizes, shards and places of the whole query against a plain best fit of each shard."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n, key = docs.count(), packing.fingerprint().alias("cluster")
    shard = F.pmod(F.xxhash64("doc_id", key, F.lit(0).cast("long")), F.lit(-(-n // packing.SHARD_ROWS)))
    want, shards = {}, {}
    for r in docs.select("doc_id", "text", "source", key, F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("s"), shard.alias("shard")).collect():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        full, tail = divmod(size, packing.CAPACITY)
        want[r["doc_id"]] = [r["source"], size, full, tail, None, None, None]
        if tail:
            shards.setdefault(r["shard"], []).append((-tail, r["cluster"], r["doc_id"], r["s"]))
    assert len(want) == n  # ids don't repeat in these tables
    for number, own in shards.items():
        own.sort()
        places, free = best_fit([(-t, s, c) for t, c, _, s in own], packing.CAPACITY, packing.MAX_PER_SOURCE)
        for (_, _, doc, _), (b, offset) in zip(own, places, strict=True):
            want[doc][4:] = [(number << packing.BIN_BITS) + b, offset, free[b]]
    got = __spark_entry__.queries()["op1_best_fit_packing"](spark, folder).collect()
    assert {r["doc_id"]: list(r)[1:] for r in got} == want


def test_op9(spark, rows):
    turns = {}
    for conv, turn, role, text in [*rows("conversations"), *Q.CONTROL_CHAT]:
        turns.setdefault(conv, []).append((turn, role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: r for r in run(spark, "op9_chat").collect()}
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in own)) and not r["rewrites"]


def test_op10(spark, rows):
    own = sorted((r[0], r[1]) for r in rows("embeddings"))
    ids, v = np.array([i for i, _ in own]), np.array([x for _, x in own], dtype=float)
    got = {}
    for r in run(spark, "op10_permutation_index").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        x = v[ids == q][0]
        cosine = (v * x).sum(1) / np.sqrt((v * v).sum(1) * (x * x).sum())
        best = [j for j in np.lexsort((ids, -cosine)) if ids[j] != q][:5]
        hits += len({int(ids[j]) for j in best} & {i for i, _ in found.values()})
        assert all(s == pytest.approx(cosine[ids == i][0], abs=1e-12) for i, s in found.values())
    assert hits / (5 * len(got)) >= 0.9


def test_op1_op4_and_pipeline_hold_every_document(spark, rows):
    docs = {r[0] for r in rows("documents")}
    for name in ("op1_best_fit_packing", "op4_jaccard_join"):
        assert {r["doc_id"] for r in run(spark, name).collect()} == docs
    assert {r["doc_id"] for r in run(spark, "pipeline").collect()} <= docs
