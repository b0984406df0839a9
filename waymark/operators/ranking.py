"""Scores of candidates within their state: normalisation, fusion, selection, sparse rankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

TINY = 1e-8


def standardize(score: str | Column, group: list[str]) -> Column:
    """Population z-score within the group; 0 where the spread is below TINY."""
    w = Window.partitionBy(*group)
    spread = F.stddev_pop(T.col(score)).over(w)
    return F.when(spread < TINY, 0.0).otherwise((T.col(score) - F.avg(T.col(score)).over(w)) / spread)


def signed_max_scale(score: str | Column, group: list[str]) -> Column:
    """Divided by the group's largest absolute value; 0 where that is below TINY."""
    top = F.max(F.abs(T.col(score))).over(Window.partitionBy(*group))
    return F.when(top < TINY, 0.0).otherwise(T.col(score) / top)


def softmax(score: str | Column, group: list[str], temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*group)
    shifted = (T.col(score) - F.max(T.col(score)).over(w)) / F.lit(temperature)
    return F.exp(shifted) / F.sum(F.exp(shifted)).over(w)


def softmax_top(rows: DataFrame, group: list[str], score: str, tie: str, k: int, temperature: float = 1.0) -> DataFrame:
    """The k largest softmax shares of each group, renormalised. Adds share and place."""
    rows = rows.withColumn("share", softmax(score, group, temperature)).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie)).cast("long"))
    top = rows.filter(F.col("place") <= k)
    return top.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(*group)))


def fuse(actor: str, structural: str, residual: str, group: list[str], structural_weight: float = 0.25, residual_weight: float = 0.25) -> dict[str, Column]:
    """Scores of the four variants: the actor alone, with structure, with residual, with both."""
    s = F.lit(structural_weight) * signed_max_scale(structural, group)
    r = F.lit(residual_weight) * standardize(residual, group)
    a = T.col(actor)
    return {"actor": a, "actor_structural": a + s, "actor_residual": a + r, "full": a + s + r}


def argmax(rows: DataFrame, group: list[str], score: str, action: str, largest_action: bool = True, position: str | None = None) -> DataFrame:
    """(group, action, score) of the best row; ties go to the largest action, or to the earliest position."""
    tie = F.col(action) if largest_action else -F.col(position)
    return rows.groupBy(*group).agg(F.max_by(F.struct(action, score), F.struct(F.col(score), tie)).alias("best")).select(*group, f"best.{action}", f"best.{score}")


def linear_score(features: DataFrame, key: list[str], weight: str, bound: float = 2.0) -> DataFrame:
    """(key, margin, score) from long rows (key, x, weight): the sparse dot product and its bounded form."""
    return features.groupBy(*key).agg(F.sum(F.col("x") * F.col(weight)).alias("margin")).withColumn("score", N.bounded_score("margin", bound))


def routed(score_a: Column, score_b: Column, condition: Column) -> Column:
    """Rule router between two value models."""
    return F.when(condition, score_a).otherwise(score_b)


def mixture(scores: list[Column], logits: list[Column], temperature: float = 1.0, top_k: int | None = None) -> Column:
    """A learned router: scores weighted by the softmax of logits; with top_k only the largest weights count, renormalised, ties to the first."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    shares = [F.exp((x - top) / F.lit(temperature)) for x in logits]
    if top_k is not None:
        ahead = [sum((((y > x) | (y == x) & F.lit(j < i)).cast("int") for j, y in enumerate(logits) if j != i), F.lit(0)) for i, x in enumerate(logits)]
        shares = [F.when(a < max(1, top_k), s).otherwise(0.0) for a, s in zip(ahead, shares, strict=True)]
    total = sum(shares[1:], shares[0])
    return sum((s / total * x for s, x in zip(shares[1:], scores[1:], strict=True)), shares[0] / total * scores[0])


def ensemble(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of value models; models of weight 0 aren't planned at all."""
    used = [F.lit(w) * scores[name] for name, w in weights.items() if w != 0]
    return sum(used[1:], used[0]) if used else F.lit(0.0)


def by_phase(phase: Column, scores: dict[str, Column], weights: dict[str, dict[str, float]], default: dict[str, float]) -> Column:
    """An ensemble whose weights depend on the phase label."""
    out = ensemble(scores, default)
    for label, own in weights.items():
        out = F.when(phase == label, ensemble(scores, own)).otherwise(out)
    return out


def retrieval_shortlist(rows: DataFrame, group: list[str], score: str, position: str, limit: int) -> DataFrame:
    """Of groups with more than ``limit`` rows, the limit best by falling score, ties in input order; smaller groups stay whole, in input order. Adds place."""
    n = F.count("*").over(Window.partitionBy(*group))
    order = Window.partitionBy(*group).orderBy(F.when(F.col("_n") > limit, -F.col(score)).otherwise(0.0), position)
    ranked = rows.withColumn("_n", n).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.filter((F.col("_n") <= limit) | (F.col("place") <= limit)).drop("_n")
