"""Deterministic sampling and top-k: nested budgets, balanced takes, compact counterfactuals, candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

SEED = 17


def _text_hash(key: Column) -> Column:
    return F.sha2(key.cast("binary"), 256)


def hash_ranks(states: DataFrame, seed: int = SEED, family: str = "family", key: str = "key") -> DataFrame:
    """Adds rank (from 1, by hash) and total of each state's family.

    A family may hold most of all states, so ranks come from two levels: hash buckets are counted first, then rows are ranked within their bucket.
    """
    hashed = states.withColumn("h", _text_hash(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("b", F.substring("h", 1, 2))
    counts = hashed.groupBy(family, "b").agg(F.count("*").alias("n"))
    sofar = Window.partitionBy(family).orderBy("b")
    counts = counts.withColumns({"before": F.sum("n").over(sofar) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(family))})
    counts = counts.select(F.col(family).alias("c_family"), F.col("b").alias("c_b"), "before", "total")
    within = Window.partitionBy(family, "b").orderBy("h", key)
    ranked = hashed.withColumn("r", F.row_number().over(within)).join(counts, F.col(family).eqNullSafe(F.col("c_family")) & (F.col("b") == F.col("c_b")))
    return ranked.withColumn("rank", F.col("r") + F.col("before")).drop("h", "b", "c_family", "c_b", "before", "r")


def within_budget(percent: int) -> Column:
    """Whether a ranked state is among percent of its family: half to even, one at least. Smaller budgets nest in larger ones."""
    if percent not in (25, 50, 75, 100):
        raise ValueError("percent must be 25, 50, 75 or 100")
    return F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("total") * percent / 100))


def budget(states: DataFrame, percent: int, seed: int = SEED, family: str = "family", key: str = "key") -> DataFrame:
    """States of each family with the lowest hashes: percent of them."""
    chosen = within_budget(percent)
    return hash_ranks(states, seed, family, key).filter(chosen).drop("rank", "total")


def balanced_take(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, taken in turn from every group: each group by hash of key, groups by hash of their name. Adds turn (from 1).

    Each turn takes a row from every group that has one left, so no group needs more than n ranked rows.
    """
    h = _text_hash(F.col(key).cast("string"))
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(h, key)).cast("long")).filter(F.col("turn") <= n)
    return ranked.orderBy("turn", _text_hash(F.col(group).cast("string")), group).limit(n)


def balanced_limit(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """As balanced_take, with groups and rows in the order of their names."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key)).cast("long")).filter(F.col("turn") <= n)
    return ranked.orderBy("turn", group).limit(n)


def compact_feedback(rows: DataFrame, k: int = 2) -> DataFrame:
    """Each state's expert action, its k best other legal and its k simplest illegal ones. Adds kind and rank.

    Needs episode_id, step_index, action, is_expert, legal, remaining, n_errors. Legal by remaining steps (unknown last), illegal by number of errors; ties by action.
    """
    kind = F.when(F.col("is_expert"), "expert").when(F.col("legal"), "legal_counterfactual").otherwise("illegal_counterfactual")
    order = Window.partitionBy("episode_id", "step_index", "kind").orderBy(
        F.when(F.col("kind") == "legal_counterfactual", F.col("remaining")).when(F.col("kind") == "illegal_counterfactual", F.col("n_errors")).asc_nulls_last(), "action"
    )
    ranked = rows.withColumn("kind", kind).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter((F.col("kind") == "expert") | (F.col("rank") <= k))


def select_candidates(rows: DataFrame, limit: int = 16) -> DataFrame:
    """At most ``limit`` actions of every state (state, action): one of each schema first (by name), then by hash. Adds place (from 1).

    Meta actions and blanks go. A state with no more than limit actions keeps all, by name.
    """
    own = rows.withColumn("norm", T.normalize("action")).filter((F.col("norm") != "") & ~F.col("norm").isin(*T.META_ACTIONS))
    own = own.withColumn("schema", F.substring_index("norm", " ", 1))
    lead = Window.partitionBy("state", "schema").orderBy("norm", "action")
    own = own.withColumns({"lead": F.row_number().over(lead), "n": F.count("*").over(Window.partitionBy("state"))})
    few = F.col("n") <= limit
    first = F.col("lead") == 1
    order = Window.partitionBy("state").orderBy(
        F.when(few, F.col("norm")).when(first, F.lit("0")).otherwise(F.lit("1")),
        F.when(few, F.col("action")).when(first, F.col("schema")).otherwise(N.stable_key(F.lit("candidate"), F.lit(0), "action")), "action",
    )
    return own.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit).drop("lead", "n")


def shortlist(rows: DataFrame, group: list[str], score: str, position: str, limit: int = 16) -> DataFrame:
    """The ``limit`` best rows of each group by falling score, ties in input order. Adds place."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), position)
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)


def evenly_spaced(length: str | Column, n: int = 6) -> Column:
    """At most n distinct positions from 0 to length - 1, evenly spaced, half to even."""
    last = T.col(length) - 1
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * last / (n - 1)).cast("long")))
