"""Hard-negative mining by blocked dense products.

Vectors become integers. A block of anchors, whose size is bounded by BLOCK_NUMBERS, is broadcast to all tasks; each task multiplies it with its candidates a few thousand at a time, in
float64, where sums of products below 2^53 are exact; products with vectors so large that sums could be more are made again in 64-bit integers. The first pass keeps for each anchor and task the nearest rows of its own label; these meet in one merge.
The second pass keeps, for each anchor and positive, the best rows of other labels whose score lies in the positive's window; these meet in another. What a task keeps is bounded by the block,
what it sends are a few rows for each anchor, however many rows a label or a repeated vector has. Blocks of anchors follow one another; each one's result is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_path

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 10, 256
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Numbers that a block of anchors has about at most (components, and what a task keeps for each anchor), and anchors and candidates of one product.
BLOCK_NUMBERS, KEPT_NUMBERS = 1 << 21, 160
ROWS, COLUMNS = 512, 4096
#: Scores stay below this, sums in float64 are exact below that, and scores below the last fit one 64-bit number with a place among COLUMNS.
LARGEST_SCORE, EXACT, PACKED = 1 << 62, 1 << 53, 1 << 50
#: Less than any score.
NONE = -(1 << 62)
KEPT = "anchor long, slot int, row long, vec_id long, score long"


def relabelled(rows: DataFrame, key: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """rows whose label moves on by one where the id is divisible by ``every``: labels that are wrong on purpose."""
    moved = F.when(F.col(key) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return rows.withColumn(label, moved)


def whole(rows: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(row, vec_id, dim, label, v): rows that take part, with floor(scale * component), numbered and written once."""
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    dim = F.size("x")
    most = F.least(F.lit(float(1 << 30)), F.floor(F.sqrt(F.lit(float(LARGEST_SCORE)) / F.greatest(dim, F.lit(1)))).cast("double"))
    large = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) >= most))
    kept = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~large)
    v = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    dealt = kept.repartition(partitions(rows.sparkSession))
    return materialise(dealt.select(F.monotonically_increasing_id().alias("row"), "vec_id", dim.alias("dim"), "label", v.alias("v")), "vectors")


class Best:
    """The k best (score, id, row) seen for each of n lists: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.rows = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def add(self, begin: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores[i, j]: of candidate j for list begin + i, counted where it fits. Candidates lie by id and row, COLUMNS at most."""
        worst = self.scores[begin : begin + len(scores), -1:]
        some = np.flatnonzero((fits & (scores >= worst)).any(axis=1))
        if not len(some):
            return
        width, least, own = scores.shape[1], np.iinfo(np.int64).min, np.where(fits[some], scores[some], NONE)
        if np.abs(scores[some]).max() < PACKED:
            # A score and the place from the right in one number: the larger one is the better, and no two are equal.
            number = np.where(fits[some], scores[some] * width + np.arange(width - 1, -1, -1), least)
            if width > self.k:
                number = np.partition(number, width - self.k, axis=1)[:, width - self.k :]
            found, place = number > least, width - 1 - number % width
        else:
            place = np.argsort(-own, axis=1, kind="stable")[:, : self.k]
            found = np.take_along_axis(own, place, axis=1) > NONE
        value = np.take_along_axis(own, place, axis=1)
        at = begin + some
        merged = [
            np.concatenate([old[at], np.where(found, new, none)], axis=1)
            for old, new, none in ((self.scores, value, NONE), (self.ids, ids[place], np.iinfo(np.int64).max), (self.rows, rows[place], -1))
        ]
        first = np.lexsort((merged[2], merged[1], -merged[0]), axis=-1)[:, : self.k]
        self.scores[at], self.ids[at], self.rows[at] = (np.take_along_axis(x, first, axis=1) for x in merged)

    def kept(self, anchors: np.ndarray, slot: int) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > NONE)
        columns = [anchors[i], np.full(len(i), slot, dtype=np.int32), self.rows[i, j], self.ids[i, j], self.scores[i, j]]
        return pa.record_batch([pa.array(c) for c in columns], names=["anchor", "slot", "row", "vec_id", "score"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of a and b, whole numbers in float64 as ``whole`` admits them."""
    scores = (a @ b.T).astype(np.int64)
    most = math.sqrt(EXACT / max(1, a.shape[1]))
    large_a, large_b = (np.flatnonzero((np.abs(x) >= most).any(axis=1)) for x in (a, b))
    if len(large_a):
        scores[large_a] = a[large_a].astype(np.int64) @ b.astype(np.int64).T
    if len(large_b):
        scores[:, large_b] = a.astype(np.int64) @ b[large_b].astype(np.int64).T
    return scores


def share(p: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of p, which may not fit 64 bits in hundredths, rounded up and rounded down."""
    q, r = np.divmod(p, 100)
    return hundredths * q - (-hundredths * r) // 100, hundredths * q + hundredths * r // 100


@dataclass
class Block:
    """Anchors of one length, and for the second pass the scores of their positives (NONE where there are fewer)."""

    rows: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    positives: np.ndarray | None = None

    def lists(self, positives: int, negatives: int) -> list[Best]:
        """What a task keeps: one list for each anchor, or one for each anchor and positive."""
        return [Best(len(self.rows), positives)] if self.positives is None else [Best(len(self.rows), negatives) for _ in range(positives)]

    def multiply(self, best: list[Best], ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        for at in range(0, len(self.rows), ROWS):
            own = slice(at, at + ROWS)
            scores = products(self.v[own], v)
            same = self.labels[own, None] == labels[None, :]
            if self.positives is None:
                best[0].add(at, scores, same & (self.rows[own, None] != rows[None, :]), ids, rows)
                continue
            for slot, kept in enumerate(best):
                p = self.positives[own, slot, None]
                kept.add(at, scores, ~same & (p > NONE) & (scores >= share(p, LOW)[0]) & (scores <= share(p, HIGH)[1]), ids, rows)


def multiplying(blocks: dict[int, Block], positives: int, negatives: int):
    """For mapInArrow over (row, vec_id, dim, label, v): what a task keeps of its candidates for the anchors of blocks, by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: b.lists(positives, negatives) for dim, b in blocks.items()}
        for batch in batches:
            rows, ids, dims, labels = (batch.column(i).to_numpy() for i in range(4))
            for dim in [d for d in np.unique(dims).tolist() if d in blocks]:
                own = np.flatnonzero(dims == dim)
                own = own[np.lexsort((rows[own], ids[own]))]
                v = batch.column(4).take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim).astype(np.float64)
                for at in range(0, len(own), COLUMNS):
                    part = own[at : at + COLUMNS]
                    blocks[dim].multiply(best[dim], ids[part], rows[part], labels[part], v[at : at + COLUMNS])
        for dim, lists in best.items():
            for slot, kept in enumerate(lists):
                yield kept.kept(blocks[dim].rows, slot)

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each (anchor, slot) among what tasks kept, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_of(anchors: list[Row]) -> dict[int, Block]:
    out = {}
    for dim in {r["dim"] for r in anchors}:
        own = [r for r in anchors if r["dim"] == dim]
        v = np.array([r["v"] for r in own], dtype=np.float64).reshape(len(own), dim)
        out[dim] = Block(np.array([r["row"] for r in own], dtype=np.int64), np.array([r["label"] for r in own], dtype=np.int64), v)
    return out


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = SCALE,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the first negatives in its window.

    Anchors are the rows whose id is divisible by ``every``; rows that repeat an id are anchors, and candidates, of their own. A row's score is its integer inner product with the anchor; higher scores come first,
    then smaller ids. An anchor's positives are the first other rows of its label, fewer if there are no more; a positive without a negative in its window gives no rows. Rows with a
    null id, a null label, a null vector, or a null or non-finite component take no part; nor do those with a component so large that a score might not fit a long (LARGEST_SCORE; about a million at 64 components). Vectors meet
    those of their own length only. No anchors give no rows; other columns are not read.
    """
    spark = rows.sparkSession
    v = whole(rows, key, vector, label, scale)
    asked = v.filter(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.col("dim").cast("long") + KEPT_NUMBERS)).first()[0] or 0
    count = -(-size // block_numbers)
    path = shared_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return spark.createDataFrame([], schema)
    for number in range(count):
        anchors = asked.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == number).collect()  # a block of bounded size
        blocks = blocks_of(anchors)
        near = merged(v.mapInArrow(multiplying(blocks, positives, negatives), KEPT), positives).collect()
        own = {r["row"]: r["vec_id"] for r in anchors}
        for dim, block in blocks.items():
            place = {r: i for i, r in enumerate(block.rows.tolist())}
            blocks[dim].positives = np.full((len(block.rows), positives), NONE)
            for r in near:
                if r["anchor"] in place:
                    blocks[dim].positives[place[r["anchor"]], r["rank"] - 1] = r["score"]
        pairs = spark.createDataFrame([(r["anchor"], r["rank"] - 1, own[r["anchor"]], r["vec_id"], r["score"]) for r in near], "anchor long, slot int, anchor_id long, positive_id long, positive_score long")
        best = merged(v.mapInArrow(multiplying(blocks, positives, negatives), KEPT), negatives)
        found = best.join(F.broadcast(pairs), ["anchor", "slot"])  # as many rows as the block has positives
        named = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        named.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
