"""Preference pairs: candidates of a state, positives against negatives, weights and hash splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

MAX_POSITIVES, MAX_NEGATIVES = 4, 8


def ranked(candidates: DataFrame, max_positives: int = MAX_POSITIVES, max_negatives: int = MAX_NEGATIVES) -> DataFrame:
    """The best positives and worst negatives of every state with both: adds rank, n_pos and n_neg (as kept).

    Positives by falling return, negatives by rising return, ties by action. One exchange by state serves all windows.
    """
    state = Window.partitionBy("episode_id", "step_index")
    outcome = Window.partitionBy("episode_id", "step_index", "success")
    key = F.when(F.col("success"), -F.col("trace_return")).otherwise(F.col("trace_return"))
    cap = F.when(F.col("success"), max_positives).otherwise(max_negatives)
    return (
        candidates.withColumn("rank", F.row_number().over(outcome.orderBy(key.asc_nulls_first(), "action")))
        .filter(F.col("rank") <= cap)
        .withColumns({"n_pos": F.count_if("success").over(state), "n_neg": F.count_if(~F.col("success")).over(state)})
        .filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    )


def build(candidates: DataFrame, max_positives: int = MAX_POSITIVES, max_negatives: int = MAX_NEGATIVES) -> DataFrame:
    """(episode_id, step_index, positive_action, negative_action, positive_return, negative_return, weight, split).

    A state has at most max_positives * max_negatives pairs, built inside its row from two bounded arrays: no self-join and no second exchange.
    Weights of a state sum to 1; an episode goes to train with hash share 0.8, else to holdout.
    """
    kept = ranked(candidates, max_positives, max_negatives)
    side = lambda cond: F.collect_list(F.when(cond, F.struct("action", "trace_return")))
    states = kept.groupBy("episode_id", "step_index").agg(side(F.col("success")).alias("pos"), side(~F.col("success")).alias("neg"))
    pairs = states.withColumn("weight", F.lit(1.0) / (F.size("pos") * F.size("neg"))).withColumn("p", F.explode("pos")).withColumn("n", F.explode("neg"))
    return pairs.select(
        "episode_id", "step_index", F.col("p.action").alias("positive_action"), F.col("n.action").alias("negative_action"),
        F.col("p.trace_return").alias("positive_return"), F.col("n.trace_return").alias("negative_return"), "weight",
        F.when(N.in_fold("episode_id"), "train").otherwise("holdout").alias("split"),
    )


def stats(candidates: DataFrame) -> DataFrame:
    """One row of counts over all states."""
    states = candidates.groupBy("episode_id", "step_index").agg(F.count_if("success").alias("p"), F.count_if(~F.col("success")).alias("n"))
    return states.agg(
        F.sum(F.col("p") + F.col("n")).alias("candidate_rows"), F.count("*").alias("state_groups"),
        F.count_if((F.col("p") > 0) & (F.col("n") > 0)).alias("groups_with_both_outcomes"),
        F.sum("p").alias("positive_rows"), F.sum("n").alias("negative_rows"),
    )


def best_against_worse(feedback: DataFrame) -> DataFrame:
    """One-to-many pairs: a state's best candidate (fewest remaining steps, ties by action) against each that needs more or changes nothing.

    Needs episode_id, step_index, action, remaining (null: unknown), idempotent.
    """
    state = Window.partitionBy("episode_id", "step_index")
    usable = F.when(F.col("remaining").isNotNull() & ~F.col("idempotent"), F.struct("remaining", "action"))
    rows = feedback.withColumn("best", F.min(usable).over(state)).filter(F.col("best").isNotNull())
    worse = F.col("idempotent") | (F.col("remaining") > F.col("best.remaining"))
    return rows.filter(worse & (F.col("action") != F.col("best.action"))).select(
        "episode_id", "step_index", F.col("best.action").alias("positive_action"), F.col("action").alias("negative_action"),
        F.col("best.remaining").alias("positive_remaining"), F.col("remaining").alias("negative_remaining"), F.col("idempotent").alias("negative_idempotent"),
    )
