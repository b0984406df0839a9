"""Mixing sources to target weights with a time-varying curriculum; DataFrame functions only.

Every source has a target (its share of all words by weight, at most ``max_epochs`` times what it has) and a weight
schedule over training time t in [0, 1]: density 1 - tilt + 2 * tilt * t, whose integral is 1. A source's documents lie
in a stream in a fixed pseudo-random order, the stream repeating for each epoch. The schedule's integral tells how many of a source's
words are demanded up to t; inverting it at a document's place in the stream gives the training position of the
document. Sorting by position by range gives the curriculum.

The order is that of an MD5 of id and text, so neither a null nor a repeated id gathers rows. Places come from prefix sums on two levels: over the buckets
of a source (beginnings of the MD5), then within a bucket. Rows that repeat both id and text have one MD5; where only ids and sources are wanted, they are counted first
and take their places one after the other, so that a third of all rows may be copies of one. Where whole rows are wanted, a window streams over them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Rows that a bucket may have on average, even if one source has all rows, and the least hex digits of the order key that make a bucket.
BUCKET_ROWS, LEAST_DIGITS = 1 << 16, 3
#: Copies of a row that one task makes of their count.
COPIES = 1 << 16
WEIGHT_CYCLE = 3
MAX_EPOCHS = 3
#: Tilt of the schedule by weight: light sources fade out over training, heavy sources ramp up.
TILTS = {1: -0.5, 2: 0.0, 3: 0.5}


def source_targets(sizes: DataFrame, cycle: int = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights go 1..cycle, repeating, over the sources by code point, null last. With every cap c (max_epochs times the
    size) and weight w, sources in the order of c / w and S words in all, the level at which a source stops is
    (S - caps before) / (weights from it on); the largest of these levels is the water level, and a source's target is
    min(c, level * w). One row a source: the only unpartitioned windows here run over that summary.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") - F.col("caps_before")).cast("double") / F.col("weights_left").cast("double"))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight").cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def position_at(demand: Column, tilt: Column) -> Column:
    """Training time at which a share ``demand`` (0 to 1) of a source has been asked for: the inverse of (1 - s) t + s t²."""
    b = F.lit(1.0) - tilt
    return F.lit(2.0) * demand / (b + F.sqrt(b * b + F.lit(4.0) * tilt * demand))


RESULT = ("size", "source_size", "target", "taken", "epochs", "position")


def placed(docs: DataFrame, max_epochs: int, keep: list[str] | None = None) -> DataFrame:
    """docs with its places in the streams, in columns that begin with ``_mix_`` (size, total, weight, target, start, taken, epochs).

    keep: columns that are wanted. Without the text among them, sizes and keys are written once to the shared folder, so that texts are read once.
    """
    text = F.col("text") if "text" in docs.columns else None
    keyed = docs.withColumn("_mix_size", F.col("size").cast("long") if text is None else word_count(text))
    inner = F.md5(text.cast("binary")) if text is not None else F.lit(None).cast("string")
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(inner, F.lit("")))
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    keyed = keyed.withColumn("_mix_key", F.md5(own.cast("binary"))).withColumn("_mix_bucket", F.substring("_mix_key", 1, digits))
    counted = keep is not None and set(keep) <= {"doc_id", "source"}
    if counted:
        alike = keyed.groupBy("doc_id", "source", "_mix_size", "_mix_key", "_mix_bucket").agg(F.count("*").alias("_mix_n"))
        keyed = materialise(alike, "sizes").withColumn("_mix_all", F.col("_mix_size") * F.col("_mix_n"))
    elif keep is not None and "text" not in keep:
        keyed = materialise(keyed.select(*dict.fromkeys([*keep, "doc_id", "source"]), "_mix_size", "_mix_key", "_mix_bucket"), "sizes")
    every = F.col("_mix_all" if counted else "_mix_size")
    # Sums of (source, bucket) first: a hot source costs a row a bucket, never a task of its own.
    buckets = keyed.groupBy("source", F.col("_mix_bucket").alias("bucket")).agg(F.sum(every).alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        buckets.withColumn("before", F.sum("bucket_size").over(so_far) - F.col("bucket_size"))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("b.source").alias("_mix_source"), F.col("b.bucket").alias("_mix_of"), F.col("before").alias("_mix_before"),
            F.col("source_size").alias("_mix_total"), F.col("weight").alias("_mix_weight"), F.col("target").alias("_mix_target"),
        )
    )
    within = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = keyed.withColumn("_mix_within", F.sum(every).over(within) - every).join(
        offsets, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_of"))
    )
    if counted:
        found = dealt_copies(found).withColumn("_mix_within", F.col("_mix_within") + F.col("_mix_copy") * F.col("_mix_size")).drop("_mix_copy", "_mix_n", "_mix_all")
    start, whole, zero = F.col("_mix_before") + F.col("_mix_within"), F.floor("_mix_target").cast("long"), F.lit(0).cast("long")
    parts = [F.greatest(zero, F.least(F.col("_mix_size"), whole - F.col("_mix_start") - F.lit(e) * F.col("_mix_total"))) for e in range(max_epochs)]
    return (
        found.withColumn("_mix_start", start)
        .withColumns({"_mix_taken": sum(parts[1:], parts[0]), "_mix_epochs": sum(((x > 0).cast("int") for x in parts[1:]), (parts[0] > 0).cast("int"))})
        .drop("_mix_key", "_mix_bucket", "_mix_source", "_mix_of", "_mix_before", "_mix_within")
    )


def dealt_copies(rows: DataFrame) -> DataFrame:
    """A row for each of the _mix_n copies of a row, numbered from 0 as _mix_copy; made of their count in pieces, which are the work of many tasks."""
    last = F.col("_mix_n") - 1
    few = rows.filter(F.col("_mix_n") <= COPIES).withColumn("_mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = rows.filter(F.col("_mix_n") > COPIES).withColumn("_mix_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES))))
    first = F.col("_mix_piece") * COPIES
    many = pieces.repartition("_mix_key", "_mix_piece").withColumn("_mix_copy", F.explode(F.sequence(first, F.least(first + COPIES - 1, last)))).drop("_mix_piece")
    return few.unionByName(many)


def position(epoch: Column | int, tilts: dict[int, float] | None = None) -> Column:
    """Training time of a copy of a placed row."""
    start = F.col("_mix_start") + F.lit(epoch) * F.col("_mix_total") if isinstance(epoch, int) else F.col("_mix_start") + epoch * F.col("_mix_total")
    return position_at(start.cast("double") / F.col("_mix_target"), tilt_of(F.col("_mix_weight"), tilts))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, tilts: dict[int, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds size, source_size, target, taken, epochs and position (of the first copy) to the columns ``keep`` (all, by default) of every row of docs.

    Needs doc_id, source and text (or size, where there is no text). The run ends at the source's target: the document there is taken in part, those
    after it not at all (taken 0, position null). A text that is null or blank has size 0 and is never taken. Sources and ids
    may be null; repeated rows take adjacent places. Columns of the added names are replaced; all others stay. No rows give no rows.
    """
    rows = placed(docs, max_epochs, keep)
    at = F.when(F.col("_mix_taken") > 0, position(0, tilts))
    made = [F.col(f"_mix_{x}").alias(name) for x, name in zip(("size", "total", "target", "taken", "epochs"), RESULT[:-1], strict=True)]
    return rows.select(*[c for c in (docs.columns if keep is None else keep) if c not in RESULT], *made, at.alias("position"))


def tilt_of(weight: Column, tilts: dict[int, float] | None = None) -> Column:
    tilt = F.lit(0.0)
    for w, s in sorted((tilts or TILTS).items()):
        tilt = F.when(weight == w, F.lit(float(s))).otherwise(tilt)
    return tilt


def curriculum(docs: DataFrame, max_epochs: int = MAX_EPOCHS, numbered: bool = True) -> DataFrame:
    """The mixed training order itself: a row for each copy that is taken, range-sorted by position, then doc_id and epoch.

    Has the columns of docs, whatever their names, and if ``numbered`` also epoch (from 0) and position, which replace columns of these names. Documents that the mix leaves
    out have no row; the last copy of a source, of which the mix takes a part, is whole here.
    """
    copies = placed(docs, max_epochs).filter(F.col("_mix_epochs") > 0).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_epochs") - 1)))
    copies = copies.withColumn("_mix_position", position(F.col("_mix_epoch"))).orderBy("_mix_position", "doc_id", "_mix_epoch")
    if not numbered:
        return copies.select(*docs.columns)
    return copies.select(*[c for c in docs.columns if c not in ("epoch", "position")], F.col("_mix_epoch").alias("epoch"), F.col("_mix_position").alias("position"))
