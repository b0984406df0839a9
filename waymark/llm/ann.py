"""Approximate nearest neighbours by a permutation index.

1. Pivots are the centres of a bounded sample's clusters. A vector is represented by the order of its nearest pivots.
2. A vector is posted in the inverted files of its FILES nearest pivots. A query walks the files of its VISIT nearest pivots only (of more, while these hold fewer than LEAST_ROWS vectors); nothing of other files is shipped or read.
3. Within a file, vectors are ranked by their footrule distance from the query: for each of a vector's PREFIX nearest pivots, how far its place is from that which the query gives the pivot. The share RERANK of the file
   with the smallest distances is reranked by cosine in double precision on the original vectors. All queries of a file are ranked together, in blocks.
4. A query's results from its files meet, at most k from each.

Equal vectors are one entry of the index, with their k + 1 smallest ids, which is all that any query can need of them; equal queries are searched once. So copies, even a third of all rows, make no work
but their own rows. A file with more than BLOCK vectors is cut by a hash. Recall and visited shares against brute force are in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, small_batches

#: Pivots, numbers (components) that the sample has at most that they are fitted on, vectors of it that each pivot stands for at least, and rounds of fitting.
PIVOTS, SAMPLE_NUMBERS, SAMPLE_EACH, ROUNDS = 1024, 1 << 21, 8, 10
#: Files that a vector is posted in, that a query walks, and how many vectors these hold at least. Lengths with fewer vectors have one file, all of which is reranked.
FILES, VISIT, LEAST_ROWS = 8, 40, 4096
#: Pivots of a vector's order, and of a query's; those beyond a query's order all have the next place.
PREFIX, ORDER = 16, 256
#: Share of a file that is reranked, and how many at least; vectors that a task holds at once.
RERANK, LEAST_RERANK, BLOCK = 0.4, 48, 1 << 15
#: Copies of a vector that one task goes through, and numbers that a step of the ranking holds at most.
COPIES, AT_ONCE = 1024, 1 << 20
EVERY = 50


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, dim, v): rows that take part, with their vectors as doubles. Out are null ids, null, empty and zero vectors, and null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    some = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    return own.filter(some).select("vec_id", F.size("v").alias("dim"), "v")


def scaled(v: np.ndarray) -> np.ndarray:
    """Times a power of two, which is exact, so that no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) if len(v) else v


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def directions(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / norms(v)[:, None]


def orders(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """[n, prefix] the nearest pivots (directions) by cosine, nearest first, ties to the smaller number."""
    return np.argsort(-(directions(v) @ pivots.T), axis=1, kind="stable")[:, :prefix]


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fitted(sample: np.ndarray, pivots: int, rounds: int = ROUNDS) -> np.ndarray:
    """[pivots, dim] centres of the sample's directions by spherical k-means, from the sample's first vectors on. An empty centre stays."""
    x = directions(sample)
    centres = x[:pivots].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        order, sizes = np.argsort(near, kind="stable"), np.bincount(near, minlength=len(centres))
        full = np.flatnonzero(sizes)
        sums = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[full])
        length = norms(sums)
        centres[full[length > 0]] = sums[length > 0] / length[length > 0, None]
    return centres


def sample_pivots(v: DataFrame, sizes: dict[int, int], pivots: int, numbers: int) -> dict[int, np.ndarray]:
    """Pivots of each length in ``sizes``, fitted on those of its different vectors that have the smallest hashes, a bounded number of components in all."""
    wanted = {dim: max(1, min(n, PIVOTS * 16, numbers // len(sizes) // dim)) for dim, n in sizes.items()}
    if not wanted:
        return {}
    # A few copies may lie below the bound that would do without them, so it is set higher and the excess cut off.
    share = lambda rows, n: min(2**63 - 1, int(-(2**63) + 2 * rows / n * 2**64))
    end = F.element_at(F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, share(wanted[dim], n))]), F.col("dim"))
    most = F.element_at(F.create_map(*[F.lit(x) for x in (y for item in wanted.items() for y in item)]), F.col("dim"))
    low = v.filter(F.col("dim").isin(*sizes)).withColumn("hash", F.xxhash64("v")).filter(F.col("hash") <= end)
    single = low.groupBy("dim", "hash").agg(F.min("v").alias("v"))
    first = single.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy("hash"))).filter(F.col("n") <= most)
    found: dict[int, list] = {}
    for r in first.orderBy("dim", "n").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: fitted(x := np.array(rows, dtype=float), max(1, min(pivots, len(x) // SAMPLE_EACH))) for dim, rows in found.items()}


def posting(pivots: dict[int, np.ndarray], prefix: int, order: int):
    """For mapInArrow over (..., dim, v, asked): adds the order of the nearest pivots, longer for queries, and a query's cosine with itself. Lengths without pivots have an empty order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "asked"))
            near: list = [[]] * len(dims)
            own = np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                v = matrix(batch.column("v").take(pa.array(rows)), dim)
                s = scaled(v)
                own[rows] = (s * s).sum(axis=1) / (norms(s) * norms(s))
                if dim in pivots:
                    named = orders(v, pivots[dim], max(prefix, order)).astype(np.int16)
                    for i, x in zip(rows, named, strict=True):
                        near[i] = x if asked[i] else x[:prefix]
            yield pa.record_batch([*batch.columns, pa.array(near, type=pa.list_(pa.int16())), pa.array(own)], names=[*batch.schema.names, "near", "own_score"])

    return run


def walking(counts: dict[int, dict[int, int]], visit: int, least: int):
    """A UDF from (dim, near) to the files that a query walks: those of its ``visit`` nearest pivots, and more while they hold fewer than ``least`` vectors."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for dims, near in batches:
            out = []
            for dim, order in zip(dims.to_pylist(), near.to_pylist(), strict=True):
                if not order:
                    out.append([0])
                    continue
                held, files = 0, []
                for c in order:
                    if len(files) >= visit and held >= least:
                        break
                    files.append(c)
                    held += counts[dim].get(c, 0)
                out.append(files)
            yield pa.array(out, type=pa.list_(pa.int32()))

    return of


@dataclass
class Index:
    """entries: (u, h, g, dim, v, asked, n, first, near, own_score), a row for each different vector; counts: vectors of each file, by length."""

    entries: DataFrame
    members: DataFrame
    counts: dict[int, dict[int, int]]
    files: int
    prefix: int
    visit: int
    least_rows: int
    block: int

    def posted(self) -> DataFrame:
        """(dim, file, split, h, u, v, near): each entry in the files of its nearest pivots."""
        files = F.when(F.size("near") > 0, F.slice("near", 1, self.files)).otherwise(F.array(F.lit(0).cast("short"))).cast("array<int>")
        own = self.entries.select("dim", F.explode(files).alias("file"), "h", "u", "v", F.slice("near", 1, self.prefix).alias("near"))
        return own.withColumn("split", F.pmod(F.xxhash64("u"), self.splits()).cast("int"))

    def splits(self) -> Column:
        """How many blocks a row's file fills."""
        large = [F.lit(x) for dim, own in self.counts.items() for file, n in own.items() if n > self.block for x in (dim * 65536 + file, -(-n // self.block))]
        return F.coalesce(F.element_at(F.create_map(*large), F.col("dim") * 65536 + F.col("file")), F.lit(1)) if large else F.lit(1)

    def queries(self) -> DataFrame:
        """(dim, file, split, h, u, v, near): each different query in the files that it walks."""
        asked = self.entries.filter("asked").withColumn("file", F.explode(walking(self.counts, self.visit, self.least_rows)("dim", "near")))
        return asked.withColumn("split", F.explode(F.sequence(F.lit(0), self.splits() - 1))).select("dim", "file", "split", "h", "u", "v", "near")


def ranked(v: np.ndarray, lengths: np.ndarray, prefix: np.ndarray, q: np.ndarray, near: np.ndarray, pivots: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """[queries, count] rows of a file with the smallest footrule distances (of equal ones the first), and their cosines. q is scaled."""
    if count >= len(v):
        rows = np.broadcast_to(np.arange(len(v)), (len(q), len(v)))
    else:
        rank = np.full((len(q), pivots), near.shape[1], dtype=np.int32)
        np.put_along_axis(rank, near.astype(np.int64), np.arange(near.shape[1], dtype=np.int32)[None, :], axis=1)
        footrule = sum(np.abs(rank[:, prefix[:, j]] - j) for j in range(prefix.shape[1])).astype(np.int64)
        rows = np.argpartition(footrule * len(v) + np.arange(len(v)), count - 1, axis=1)[:, :count]
    return rows, (v[rows] * q[:, None, :]).sum(axis=2) / (lengths[rows] * norms(q)[:, None])


def searching(n_pivots: dict[int, int], k: int, rerank: float, least: int):
    """For mapInArrow over (dim, file, split, is_query, h, u, v, near), sorted by the first five: a file's vectors come before its queries. Gives (query, u, score), at most k for each query and file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            k4 = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k4], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                dim, now, asked = int(k4[0][a]), (int(k4[0][a]), int(k4[1][a]), int(k4[2][a])), bool(k4[3][a])
                part = batch.slice(a, b - a)
                us, v, near = part.column(5).to_numpy(), scaled(matrix(part.column(6), dim)), part.column(7)
                if now != key:
                    key, stored, held = now, [], None
                if not asked:
                    stored.append((us, v, matrix(near, len(near[0])) if dim in n_pivots else np.zeros((len(us), 0), dtype=np.int16)))
                    continue
                if not stored:
                    continue
                if held is None:
                    own_us, own_v, own_near = (np.concatenate(x) for x in zip(*stored, strict=True))
                    held = own_us, own_v, norms(own_v), own_near
                own_us, own_v, lengths, own_near = held
                order = matrix(near, len(near[0])) if dim in n_pivots else np.zeros((len(us), 0), dtype=np.int16)
                count = min(len(own_us), max(least, k + 1, math.ceil(rerank * len(own_us)))) if dim in n_pivots else len(own_us)
                step = max(1, AT_ONCE // max(len(own_us), count * dim))
                for at in range(0, len(us), step):
                    asks = us[at : at + step]
                    rows, cosines = ranked(own_v, lengths, own_near, v[at : at + step], order[at : at + step], n_pivots.get(dim, 1), count)
                    cosines = np.where(own_us[rows] == asks[:, None], -np.inf, cosines)
                    # Of equal scores all stay that may be among the k: which of them are is for the smallest ids to say.
                    kth = np.partition(cosines, max(0, cosines.shape[1] - k), axis=1)[:, max(0, cosines.shape[1] - k)]
                    i, j = np.nonzero((cosines >= kth[:, None]) & (cosines > -np.inf))
                    yield pa.record_batch([pa.array(asks[i]), pa.array(own_us[rows[i, j]]), pa.array(cosines[i, j])], names=["query", "u", "score"])

    return run


def build(
    rows: DataFrame, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, sample_numbers: int = SAMPLE_NUMBERS, files: int = FILES, visit: int = VISIT,
    least_rows: int = LEAST_ROWS, prefix: int = PREFIX, order: int = ORDER, block: int = BLOCK,
) -> Index:
    spark = rows.sparkSession
    small_batches(spark)
    named = valid(rows, key, vector).select("vec_id", "dim", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    v = materialise(named.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > least_rows).collect()}
    points = sample_pivots(v, sizes, pivots, sample_numbers)
    single = v.groupBy("dim", "h", "g").agg(
        F.any_value("v").alias("v"), F.bool_or(F.col("vec_id") % every == 0).alias("asked"), F.count("*").alias("n"), F.min(F.struct("vec_id", "row")).alias("first"),
    )
    kinds = "dim int, h long, g long, v array<double>, asked boolean, n long, first struct<vec_id: long, row: long>, near array<short>, own_score double"
    entries = materialise(single.mapInArrow(posting(points, prefix, order), kinds).withColumn("u", F.monotonically_increasing_id()), "entries")
    counts: dict[int, dict[int, int]] = {dim: {} for dim in points}
    posted = entries.filter(F.size("near") > 0).select("dim", F.explode(F.slice("near", 1, files)).alias("file"))
    for r in posted.groupBy("dim", "file").agg(F.count("*").alias("n")).collect():  # a row a pivot
        counts[r["dim"]][r["file"]] = r["n"]
    return Index(entries, v, counts, files, prefix, visit, least_rows, block)


def smallest(index: Index, k: int) -> DataFrame:
    """(u, vec_id, row): the k smallest members of each entry. A vector with very many copies is gone through in parts."""
    ones = index.entries.filter("n = 1").select("u", "first.*")
    many = index.entries.filter("n > 1").select("dim", "h", "g", "u", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    own = index.members.select("dim", "h", "g", "vec_id", "row").join(many, ["dim", "h", "g"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    order = ["vec_id", "row"]
    for group in (["u", "part"], ["u"]):
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= k)
    return ones.unionByName(own.select("u", "vec_id", "row"))


def search(rows: DataFrame, k: int = 5, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", rerank: float = RERANK, least: int = LEAST_RERANK, **settings: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``, among all other rows.

    Nearest first by cosine in double precision, ties to the smaller id. Rows that repeat an id are rows of their own: each is a candidate for the others, and a query
    of its own. Vectors are compared with those of their own length. Rows with a null id, or whose vector is null, empty, zero or holds a null or
    non-finite component take no part. Fewer than k others give all of them; no valid vector gives no rows. Other columns are not read. settings: see ``build``.
    """
    spark = rows.sparkSession
    index = build(rows, every, key, vector, **settings)
    columns = ["dim", "file", "split", "is_query", "h", "u", "v", "near"]
    both = index.posted().withColumn("is_query", F.lit(False)).select(columns).unionByName(index.queries().withColumn("is_query", F.lit(True)).select(columns))
    n_files = sum(-(-n // index.block) for own in index.counts.values() for n in own.values())
    tasks = both.repartition(max(partitions(spark), min(n_files // 4, 8192)), "dim", "file", "split").sortWithinPartitions("dim", "file", "split", "is_query", "h", "u")
    n_pivots = dict.fromkeys(index.counts, settings.get("pivots", PIVOTS))
    found = tasks.mapInArrow(searching(n_pivots, k, rerank, least), "query long, u long, score double").groupBy("query", "u").agg(F.max("score").alias("score"))
    # Copies of the query's own vector come first, and are found without a search.
    own = index.entries.filter("asked").select(F.col("u").alias("query"), "u", F.col("own_score").alias("score"))
    named = found.join(index.entries.select("u", F.col("first.vec_id").alias("low")), "u")
    best = named.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low", "u"))).filter(F.col("_n") <= k)
    members = best.select("query", "u", "score").unionByName(own).join(smallest(index, k + 1), "u")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("_n") <= k + 1)
    results = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "row"))).alias("found"))  # k + 1 at most
    asked = index.members.filter(F.col("vec_id") % every == 0).select("dim", "h", "g", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))
    entries = index.entries.filter("asked").select("dim", "h", "g", F.col("u").alias("query"))
    each = asked.join(entries, ["dim", "h", "g"]).join(results, "query")
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("query_row")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
