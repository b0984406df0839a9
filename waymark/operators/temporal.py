"""Joins by time: as-of joins, and joins of overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..session import written
from . import ordered


def plain_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the columns that can be sorted and hashed."""
    return [c for c in names if not isinstance(df.schema[c].dataType, ArrayType | MapType | StructType | VariantType)]


def as_of(
    left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), right_on: str | None = None, columns: Sequence[str] | None = None, direction: str = "backward",
    tolerance: Column | None = None, exact: bool = True, ties: Sequence[str] | None = None, how: str = "left", null_keys: bool = False,
) -> DataFrame:
    """left with ``columns`` of the row of right that is nearest in time, among those with the same keys: the last at or before the left row, or the first at or after it.

    right_on: right's time, if it is called otherwise. direction: "backward", "forward", or "nearest" (the closer of both, the earlier if both are as close). tolerance: how far apart the two may be (what can be subtracted from
    the time: a number or an interval). exact: whether equal times match. Of right rows of one key and time the last by ``ties`` matches (the first, forward); by default all plain columns are compared. how: "left"
    keeps left rows without a match, "inner" doesn't. A left row with a null time, or (unless null_keys) a null key, has no match.

    Both sides are events of one sequence, dealt out by range of key and time; each partition carries its last match to the next. So a key that has a third of all rows is cut by time.
    """
    right_on = right_on or on
    columns = [c for c in right.columns if c not in {*by, right_on}] if columns is None else list(columns)
    if clash := set(columns) & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    if direction == "nearest":
        back = [f"_b_{c}" for c in columns]
        once = right.select(*by, right_on, *[F.col(c).alias(b) for c, b in zip(columns, back, strict=True)], F.col(right_on).alias("_b_at"))
        shared = {"ties": None if ties is None else [f"_b_{c}" if c in columns else c for c in ties]}
        first = as_of(left, once, on, by, right_on, [*back, "_b_at"], "backward", tolerance, exact, how="left", null_keys=null_keys, **shared)
        again = right.select(*right.columns, F.col(right_on).alias("_f_at"))
        both = as_of(first, again, on, by, right_on, [*columns, "_f_at"], "forward", tolerance, exact, ties, "left", null_keys)
        earlier = F.col("_b_at").isNotNull() & (F.col("_f_at").isNull() | (F.col(on) - F.col("_b_at") <= F.col("_f_at") - F.col(on)))
        found = both.filter(F.coalesce("_b_at", "_f_at").isNotNull()) if how == "inner" else both
        return found.select(*left.columns, *[F.when(earlier, F.col(b)).otherwise(F.col(c)).alias(c) for c, b in zip(columns, back, strict=True)])
    if direction not in ("backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    back = direction == "backward"
    ties = plain_columns(right, columns) if ties is None else list(ties)
    keys = [f"_k{i}" for i in range(len(by))]
    named = lambda df: [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    kind = left.schema[on].dataType
    # Where times are equal, matches that count lie before the left row in the order of the scan.
    before = exact == back
    match = F.struct(F.col(right_on).cast(kind).alias("_at"), *columns)
    known = F.col(right_on).isNotNull()
    for c in by:
        known = known & (F.col(c).isNotNull() | F.lit(null_keys))
    spread = F.xxhash64(*plain_columns(left, left.columns)) if plain_columns(left, left.columns) else F.lit(0).cast("long")
    l_rows = left.select(
        *named(left), F.col(on).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(ties)],
        spread.alias("_spread"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"), F.lit(True).alias("_own"),
    )
    r_rows = right.filter(known).select(
        *named(right), F.col(right_on).cast(kind).alias("_t"), F.lit(0 if before else 2).alias("_side"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(ties)],
        F.lit(0).cast("long").alias("_spread"), match.alias("_right"), F.lit(False).alias("_own"),
    )
    events = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_o{i}" for i in range(len(ties))], "_spread"]
    scanned = ordered.scan(events, keys, order if back else [F.desc(c) for c in order], fills=["_right"], keep="_own")
    at, t = F.col("last__right._at"), F.col("_t")
    good = at.isNotNull() & t.isNotNull()
    if tolerance is not None:
        good = good & ((t - tolerance <= at) if back else (at - tolerance <= t))
    found = scanned.withColumn("_match", F.when(good, F.col("last__right")))
    if how == "inner":
        found = found.filter(F.col("_match").isNotNull())
    return found.select("_left.*", *[F.col(f"_match.`{c}`").alias(c) for c in columns])


#: Each level's bins are this much wider than the level's below.
WIDER, BITS = 4, 2
#: Postings of a bin beyond which it is cut, and cut bins up to which their table is broadcast.
HOT_ROWS, BROADCAST_BINS = 1 << 16, 1 << 18


def level_of(length: Column) -> Column:
    """The lowest level whose bins are at least as wide as the length: WIDER^level."""
    level = F.ceil(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.log(F.lit(float(WIDER)))).cast("int")
    # The logarithm of a large number may be off by a hair.
    low = F.greatest(level - 1, F.lit(0))
    return F.when(width_of(low) >= length, low).when(width_of(level) >= length, level).otherwise(level + 1)


def width_of(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level * BITS)


def bin_of(place: Column) -> Column:
    """The bin of a place at the row's ``_level``."""
    return F.call_function("shiftright", place, F.col("_level") * BITS)


def overlap(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), closed: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All columns of both sides (whose names must differ, but for the keys) for each pair of rows with equal keys whose intervals overlap.

    Intervals are [start, end) of whole numbers within 2^61 of 0, or [start, end] if closed; those that are null or empty, and rows with a null key, overlap nothing.

    Bins are dyadic: a level's bins are WIDER times as wide as the level's below. An interval lies in one or two bins of the lowest level that is as wide as it is; there the longer of two meets
    the shorter, which is posted at the levels above its own that the other side has. A pair that meets in two bins counts in its first one. A bin with many postings is cut: its right rows are dealt over parts, its left rows go to
    each. So there is neither a cartesian product nor a bin in one task.
    """
    extra = 1 if closed else 0

    def posted(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        s, e = F.col(span[0]).cast("long"), F.col(span[1]).cast("long") + extra
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side)
        rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], s.alias(f"_{side}s"), e.alias(f"_{side}e"), whole)
        known = F.col(f"_{side}s") < F.col(f"_{side}e")
        for i in range(len(by)):
            known = known & F.col(f"_k{i}").isNotNull()
        return rows.filter(known).withColumn("_own", level_of(F.col(f"_{side}e") - F.col(f"_{side}s")))

    a, b = posted(left, left_span, "a"), posted(right, right_span, "b")
    has = lambda rows: sorted(r[0] for r in rows.select("_own").distinct().collect())  # noqa: E731  at most 33 numbers
    levels = {"a": has(a), "b": has(b)}
    keys = [f"_k{i}" for i in range(len(by))]

    def in_bins(rows: DataFrame, side: str, level: Column) -> DataFrame:
        """A posting for each bin of ``level`` that the interval touches."""
        return rows.withColumn("_level", level).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(f"_{side}s")), bin_of(F.col(f"_{side}e") - 1))))

    def meeting(longer: DataFrame, shorter: DataFrame, long_side: str, strictly: bool) -> DataFrame:
        """Pairs whose longer interval is on long_side; strictly: of equal levels the other call has them."""
        short_side = "b" if long_side == "a" else "a"
        above = F.filter(F.array(*[F.lit(x) for x in levels[long_side]]).cast("array<int>"), lambda x: (x > F.col("_own")) if strictly else (x >= F.col("_own")))
        big = in_bins(longer, long_side, F.col("_own")).drop("_own")
        small = in_bins(shorter, short_side, F.explode(above)).drop("_own")
        return cut(big, small, [*keys, "_level", "_bin"], hot_rows)

    first_common = F.col("_bin") == bin_of(F.greatest("_as", "_bs"))
    over = (F.col("_as") < F.col("_be")) & (F.col("_bs") < F.col("_ae"))
    pairs = [meeting(a, b, "a", False), meeting(b, a, "b", True)]
    both = pairs[0].filter(first_common & over).select("a", "b").unionByName(pairs[1].filter(first_common & over).select("a", "b"))
    return both.select("a.*", *[F.col(f"b.`{c}`").alias(c) for c in right.columns if c not in by])


def overlap_totals(
    left: DataFrame, right: DataFrame, ids: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), closed: bool = False, names: tuple[str, str] = ("n", "common")
) -> DataFrame:
    """(ids, n, common): with how many right intervals (of equal keys) those of a left id overlap, and how long in sum; ids without any are absent. What counts as an interval and an overlap is as in ``overlap``.

    No pair is made. Starts and ends of right intervals, added up by time, and both ends of left ones are events of one sequence. Those that overlap [s, e) are as many as start before e, less those that end
    by s; the time that they cover up to x is the sum of x - start over those that started, less that of x - end over those that ended. So running totals say all, and work grows with rows, not with pairs.
    """
    keys = [f"_k{i}" for i in range(len(by))]

    def spans(df: DataFrame, span: tuple[str, str], more: Sequence[str]) -> DataFrame:
        s, e = F.col(span[0]).cast("long"), F.col(span[1]).cast("long")
        rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], s.alias("_s"), e.alias("_e"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(more)])
        known = (F.col("_s") <= F.col("_e")) if closed else (F.col("_s") < F.col("_e"))
        for k in keys:
            known = known & F.col(k).isNotNull()
        return rows.filter(known)

    zero = lambda c: F.lit(0).cast("long").alias(c)
    point = lambda at, **v: F.struct(F.col(at).alias("_t"), *[v[c].cast("long").alias(c) if c in v else zero(c) for c in ("_ns", "_ss", "_ne", "_se")])
    ends = F.array(point("_s", _ns=F.lit(1), _ss=F.col("_s")), point("_e", _ne=F.lit(1), _se=F.col("_e")))
    told = spans(right, right_span, ()).select(*keys, F.inline(ends)).groupBy(*keys, "_t").agg(*[F.sum(c).alias(c) for c in ("_ns", "_ss", "_ne", "_se")])
    told = told.withColumns({"_side": F.lit(1), "_spread": F.lit(0).cast("long"), "_asks": F.lit(False), "_sign": F.lit(0)})
    # A closed interval meets those that end at its start or start at its end.
    asked = spans(left, left_span, ids)
    own = [c for c in asked.columns if c.startswith("_i")]
    ask = lambda at, side, sign: F.struct(F.col(at).alias("_t"), F.lit(side).alias("_side"), F.lit(sign).alias("_sign"))
    asked = asked.select(*keys, *own, F.xxhash64(*own).alias("_spread"), F.inline(F.array(ask("_s", 0 if closed else 2, -1), ask("_e", 2 if closed else 0, 1))))
    events = asked.withColumn("_asks", F.lit(True)).unionByName(told, allowMissingColumns=True).fillna(0, ["_ns", "_ss", "_ne", "_se"])
    run = ordered.scan(events, keys, ["_t", "_side", "_spread"], sums=["_ns", "_ss", "_ne", "_se"], keep="_asks")
    c = lambda name: F.col(f"run_{name}")
    covered = c("_ns") * F.col("_t") - c("_ss") - c("_ne") * F.col("_t") + c("_se")
    totals = run.groupBy(*own).agg(F.sum(F.when(F.col("_sign") > 0, c("_ns")).otherwise(-c("_ne"))).alias("_n"), F.sum(covered * F.col("_sign")).alias("_common"))
    return totals.filter(F.col("_n") > 0).select(*[F.col(o).alias(i) for o, i in zip(own, ids, strict=True)], F.col("_n").alias(names[0]), F.col("_common").alias(names[1]))


def cut(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """The equi-join of both sides. Where right has more than hot_rows rows of a key, they are dealt over parts by a hash, and the left rows of the key go to each part; likewise for left."""

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias(name))

    hot = parts(left, "_lp").join(parts(right, "_rp"), on, "full_outer").select(*on, F.coalesce("_lp", F.lit(1)).alias("_lp"), F.coalesce("_rp", F.lit(1)).alias("_rp"))
    hot = written(hot, "hot-bins")
    count = hot.count()
    if not count:
        return left.join(right, on)
    hot = F.broadcast(hot) if count <= BROADCAST_BINS else hot

    def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        marked = rows.join(hot, on, "left").withColumns({"_lp": F.coalesce("_lp", F.lit(1)), "_rp": F.coalesce("_rp", F.lit(1))})
        spans = [c for c in rows.columns if c in ("_as", "_ae", "_bs", "_be")]
        mine = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*spans, F.to_json("a" if "a" in rows.columns else "b")), F.col(own)).cast("int")).otherwise(F.lit(0))
        return marked.withColumn(names[0], mine).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_lp", "_rp")

    x, y = dealt(left, "_lp", "_rp", ("_ls", "_rs")), dealt(right, "_rp", "_lp", ("_rs", "_ls"))
    return x.join(y, [*on, "_ls", "_rs"])
