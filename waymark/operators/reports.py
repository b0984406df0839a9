"""Reports: completion by grouping sets, paired comparison, bootstrap, equal-count bins, contributions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from .ordered import numbered

#: Resamples of a bootstrap, as many as the reference draws.
BOOTSTRAP = 20_000


def completion(runs: DataFrame, by: tuple[str, str] = ("variant", "task_family"), names: tuple[str, str] = ("variant", "family"), timeouts: bool = False) -> DataFrame:
    """Counts and rates overall and by each of two columns, in one aggregation with grouping sets; ``level`` tells which.

    timeouts adds, from termination_reason, runs that reached the step limit, and those or that the environment ended without success: reports mean either by a timeout.
    """
    a, b = by
    level = F.when(F.grouping(a) == 0, names[0]).when(F.grouping(b) == 0, names[1]).otherwise("overall")
    reason = F.col("termination_reason") if timeouts else None
    more = [F.count_if(reason == "max_steps").alias("timeouts"), F.count_if(reason.isin("max_steps", "env_done_without_success")).alias("timeouts_or_ended")] if timeouts else []
    return runs.groupingSets([[], [F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(
        level.alias("level"), F.count("*").alias("episodes"), F.count_if("success").alias("successes"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.sum("steps").alias("step_count"), F.avg("steps").alias("average_steps"), F.sum("invalid").alias("invalid_actions"), (F.sum("invalid") / F.sum("steps")).alias("invalid_rate"), *more,
    )


def paired(runs: DataFrame) -> DataFrame:
    """(episode_id, task_family, base_success, new_success, success_delta, step_delta) of episodes that ran under both variants; one exchange."""
    at = lambda name, column: F.max(F.when(F.col("variant") == name, F.col(column)))
    both = runs.groupBy("episode_id", "task_family").agg(
        at("reference", "success").alias("base_success"), at("candidate", "success").alias("new_success"),
        at("reference", "steps").alias("base_steps"), at("candidate", "steps").alias("new_steps"),
    ).filter(F.col("base_steps").isNotNull() & F.col("new_steps").isNotNull())
    return both.select(
        "episode_id", "task_family", "base_success", "new_success",
        (F.col("new_success").cast("long") - F.col("base_success").cast("long")).alias("success_delta"), (F.col("new_steps") - F.col("base_steps")).alias("step_delta"),
    )


def paired_summary(pairs: DataFrame, by_family: bool = False) -> DataFrame:
    """Recovered, regressed, both and neither, mean deltas and the exact test."""
    got = pairs.groupBy(*["task_family"] * by_family).agg(
        F.count("*").alias("episodes"), F.count_if("base_success").alias("reference_success"), F.count_if("new_success").alias("candidate_success"),
        F.count_if(F.col("base_success") & F.col("new_success")).alias("both_success"), F.count_if(F.col("success_delta") == 1).alias("recovered"),
        F.count_if(F.col("success_delta") == -1).alias("regressed"), F.count_if(~F.col("base_success") & ~F.col("new_success")).alias("both_fail"),
        F.avg("success_delta").alias("success_rate_delta"), F.avg("step_delta").alias("mean_step_delta"),
    )
    return got.withColumn("mcnemar_p", N.mcnemar("recovered", "regressed"))


#: Draws that one hash gives: eight hex digits each.
DRAWS = 8


def poisson_bounds(digits: int = 8) -> list[str]:
    """Cumulative probabilities of a Poisson variable with mean 1, as hex digits, which sort as their numbers do; up to where these end."""
    out, term, total, k = [], math.exp(-1), 0.0, 0
    while True:
        total += term
        if (bound := math.ceil(total * 16**digits)) >= 16**digits:
            return out
        out.append(f"{bound:0{digits}x}")
        k += 1
        term /= k


def drawing(blocks: int):
    """For mapInArrow over (episode_id, success_delta, step_delta): for each block a row of the sums of weights, and of weights times deltas, of all its resamples over a task's episodes."""
    bounds = [int(x, 16) for x in poisson_bounds()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((blocks, DRAWS, 3), dtype=np.int64)
        for batch in batches:
            ids = [None if e is None else f":{e}".encode() for e in batch.column(0).to_pylist()]
            # Products and sums of a batch are whole numbers far below 2^53.
            deltas = np.stack([np.ones(len(ids)), *[pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2)]], axis=1)
            for b in range(blocks):
                head = str(b).encode()
                digests = b"".join([hashlib.sha256(head if e is None else head + e).digest() for e in ids])
                draws = np.frombuffer(digests, dtype=">u4").astype(np.uint32).reshape(len(ids), DRAWS)
                weights = np.zeros(draws.shape, dtype=np.uint8)
                for bound in bounds:
                    weights += draws >= bound
                sums[b] += (weights.T.astype(np.float64) @ deltas).astype(np.int64)
        columns = [pa.array(np.arange(blocks, dtype=np.int64)), *[pa.array(np.ascontiguousarray(sums[:, i, j])) for i in range(DRAWS) for j in range(3)]]
        yield pa.record_batch(columns, names=["b", *[f"{n}{i}" for i in range(DRAWS) for n in "nat"]])

    return run


def bootstrap(pairs: DataFrame, samples: int = BOOTSTRAP) -> DataFrame:
    """Percentile intervals of the mean deltas by a hash bootstrap that any engine can repeat.

    Resample s gives an episode the weight of a Poisson(1) draw, taken from digits of sha256("block:episode"), a block being DRAWS resamples: a row-local
    decision, so resampling needs no index join; a task adds all resamples up in numpy and sends a row a block.
    """
    blocks = -(-samples // DRAWS)
    # Few bytes make much work, so they go to all cores.
    parts = pairs.sparkSession.sparkContext.defaultParallelism
    dealt = pairs.select("episode_id", "success_delta", "step_delta").repartition(parts, "episode_id")
    names = [f"{n}{i}" for i in range(DRAWS) for n in "nat"]
    drawn = dealt.mapInArrow(drawing(blocks), "b long, " + ", ".join(f"{n} long" for n in names))
    per = drawn.groupBy("b").agg(*[F.sum(n).alias(n) for n in names])
    each = F.array(*[F.struct((F.col("b") * DRAWS + i).alias("s"), (F.col(f"a{i}") / F.col(f"n{i}")).alias("success"), (F.col(f"t{i}") / F.col(f"n{i}")).alias("steps")) for i in range(DRAWS)])
    means = per.select(F.inline(each)).filter(F.col("s") < samples)
    at = lambda c, p: F.percentile(c, F.lit(p))
    return means.agg(
        F.count("*").alias("samples"), at("success", 0.025).alias("success_low"), at("success", 0.975).alias("success_high"),
        at("steps", 0.025).alias("steps_low"), at("steps", 0.975).alias("steps_high"),
    )


def equal_bins(rows: DataFrame, key: str, value: str, correct: str, bins: int = 5) -> DataFrame:
    """Bins of nearly equal counts over rows sorted by value (ties by key): bin i has ranks from i*n/bins on, larger bins last.

    Rows are numbered along (value, key) over a range partitioning, so neither all rows nor a value that many rows have lie in one task.
    """
    placed = numbered(rows.select(key, value, correct), [value, key], name="r").withColumn("bin", F.ceil(F.lit(float(bins)) * F.col("r") / F.lit(float(max(rows.count(), 1)))).cast("long"))
    return placed.groupBy("bin").agg(
        F.count("*").alias("pairs"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        (F.lit(100.0) * F.avg(F.col(correct).cast("double"))).alias("accuracy_pct"),
    )


def group_contributions(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mean signed and absolute contribution by outcome and group, counting 0 where a row lacks the group.

    rows: row_id, feature_group, contribution (long form); a row's outcome is Correct if all its contributions sum to more than 0.
    """
    own = rows.groupBy("row_id").agg(F.sum("contribution").alias("margin"), *[F.sum(F.when(F.col("feature_group") == g, F.col("contribution"))).alias(f"g{i}") for i, g in enumerate(groups)])
    long = own.select(
        F.when(F.col("margin") > 0, "Correct").otherwise("Incorrect").alias("outcome"),
        F.explode(F.array(*[F.struct(F.lit(g).alias("feature_group"), F.coalesce(f"g{i}", F.lit(0.0)).alias("c")) for i, g in enumerate(groups)])).alias("e"),
    )
    return long.groupBy("outcome", "e.feature_group").agg(F.avg("e.c").alias("mean_signed"), F.avg(F.abs("e.c")).alias("mean_absolute"), F.count("*").alias("pair_count"))


def factor_means(rows: DataFrame, n_rows: int) -> DataFrame:
    """Mean signed and absolute contribution of each feature over all n_rows rows, those without the feature included."""
    n = F.lit(float(max(n_rows, 1)))
    return rows.groupBy("feature").agg((F.sum("contribution") / n).alias("mean_signed"), (F.sum(F.abs("contribution")) / n).alias("mean_absolute"))


def step_summary(rows: DataFrame, value: str) -> DataFrame:
    """Minimum, both medians, mean (three digits) and maximum. Medians come from exact percentiles: nothing is collected."""
    n = F.count(value)
    return rows.agg(
        F.min(value).alias("minimum"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)").alias("upper_median"), F.round(F.avg(value), 3).alias("mean"), F.max(value).alias("maximum"), n.alias("rows")
    )


def exact_match(results: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, total, correct, mean_latency): overall (field and value null) and by each field, in one pass over (exact_match, latency_sec, fields)."""
    keys = [F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))]
    keys += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = results.select("exact_match", "latency_sec", F.explode(F.array(*keys)).alias("k"))
    return long.groupBy("k.field", "k.value").agg(F.count("*").alias("total"), F.count_if("exact_match").alias("correct"), F.avg(F.coalesce("latency_sec", F.lit(0.0))).alias("mean_latency"))


def collection(branches: DataFrame) -> DataFrame:
    """One row: branches, states, successes, failures, cycles."""
    return branches.agg(
        F.count("*").alias("branch_count"), F.count_distinct("episode_id", "step_index").alias("state_count"), F.count_if("success").alias("success_count"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failure_count"), F.count_if("cycle_detected").alias("cycle_count"),
    )


def coverage(rows: DataFrame, split: str, key: str, base: str) -> DataFrame:
    """(split, keys, unseen, covered): how many keys a split has, how many of them the base split lacks, and whether it lacks none.

    Keys are counted once each before splits meet, so no set is collected.
    """
    each = rows.select(F.col(split).alias("split"), F.col(key).alias("k")).distinct()
    known = each.filter(F.col("split") == base).select("k", F.lit(1).alias("known"))
    joined = each.join(known, each["k"].eqNullSafe(known["k"]), "left").select("split", "known")
    found = joined.groupBy("split").agg(F.count("*").alias("keys"), F.count_if(F.col("known").isNull()).alias("unseen"))
    return found.withColumn("covered", F.col("unseen") == 0)
