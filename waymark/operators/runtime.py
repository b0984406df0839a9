"""Scorers as plug-ins: runtimes chosen by the schema version of their document, and Python scorers as functions of SQL."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import features, progress

Scorer = Callable[[str, list[str], str, str], float]


#: What a document asks for: the factor formula's base cost and weight, and the weights of a linear ranker's features with the weight of its bounded score. A part without a weight isn't planned.
Parts = tuple[float, float | None, dict[str, float], float | None]


def structured(document: dict) -> Parts:
    """The factor formula alone, times its weight."""
    return float(document.get("base_cost", 1.0)), float(document.get("structured_weight", 1.0)), {}, None


def unified(document: dict) -> Parts:
    """The factor formula and a linear ranker's bounded score, weighted. A part of weight 0 isn't planned."""
    ranked = float(document.get("semantic_weight", 0.0)) or None
    ranker = {k: float(v) for k, v in document["ranker"].items()} if ranked else {}
    return float(document.get("base_cost", 1.0)), float(document.get("structured_weight", 0.0)) or None, ranker, ranked


# Names of the two document schemas.
RUNTIMES = {"structured-progress-potential-runtime-v1": structured, "unified-progress-value-runtime-v1": unified}


def parts_of(document: str) -> Parts:
    payload = json.loads(document)
    runtime = RUNTIMES.get(payload.get("schema_version"))
    if runtime is None:
        raise ValueError(f"unsupported runtime: {payload.get('schema_version')!r}")
    return runtime(payload)


def load(document: str) -> Callable[[DataFrame], DataFrame]:
    """The scorer that a runtime document (JSON text) asks for: a function of annotated rows that returns (episode_id, step, score)."""
    parts_of(document)  # an unknown one fails here
    return lambda annotated: scores(annotated, {"score": document})


def scores(annotated: DataFrame, documents: dict[str, str]) -> DataFrame:
    """(episode_id, step, name...): the scores of several runtime documents (JSON texts) by name.

    All of them read one row of the step: formulas are expressions on the annotated row, rankers share one map of the features that any of them weighs. So a step's state is made once, whatever the
    number of documents, nothing is joined, and the windows of both states find the exchange by episode that the rows came with.
    """
    parts = {name: parts_of(d) for name, d in documents.items()}
    costs = sorted({cost for cost, weight, _, _ in parts.values() if weight is not None})
    formulas = {cost: f"_formula{i}" for i, cost in enumerate(costs)}
    weighed = {k for _, _, ranker, ranked in parts.values() if ranked is not None for k in ranker}
    rows = progress.prepared(annotated) if costs else annotated
    rows = rows.select("episode_id", "step", "action", "instruction", "observation", *[progress.score_of(cost).alias(c) for cost, c in formulas.items()])
    if any(ranked is not None for *_, ranked in parts.values()):
        rows = features.featurise(rows, weighed, tuple(formulas.values()))

    def total(cost: float, weight: float | None, ranker: dict[str, float], ranked: float | None) -> Column:
        own = [F.col(formulas[cost]) * F.lit(weight)] if weight is not None else []
        if ranked is not None:
            model = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in ranker.items()])) if ranker else F.create_map().cast("map<string,double>")
            own.append(F.lit(ranked) * N.bounded_score(N.sparse_dot("features", model)))
        return functools.reduce(Column.__add__, own) if own else F.lit(0.0)

    return rows.select("episode_id", "step", *[total(*p).alias(name) for name, p in parts.items()])


def scorer(f: Scorer):
    """A UDF of (instruction, previous actions, observation, action) from a Python scorer, over Arrow batches; nulls come as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([float(f(i or "", p or [], o or "", a or "")) for i, p, o, a in rows], type=pa.float64())

    return score


def register_scorer(spark: SparkSession, name: str, f: Scorer) -> Callable[..., Column]:
    """Makes a scorer callable from SQL under the name."""
    return spark.udf.register(name, scorer(f))
