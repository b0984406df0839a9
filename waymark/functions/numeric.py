"""Numbers, hashes, sets and sparse vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

ZERO = 1e-12


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two sets (arrays without repeats); 0 for two empty ones."""
    common, total = F.size(F.array_intersect(col(a), col(b))), F.size(col(a)) + F.size(col(b))
    return F.when(total > 0, common / (total - common)).otherwise(F.lit(0.0))


def coverage(source: str | Column, target: str | Column) -> Column:
    n = F.size(col(source))
    return F.when(n > 0, F.size(F.array_intersect(col(source), col(target))) / n).otherwise(F.lit(0.0))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), col(x)))))


def bounded_score(margin: str | Column, bound: float = 2.0) -> Column:
    return F.lit(bound) * F.tanh(col(margin) / F.lit(bound))


def capped_ratio(n: str | Column, cap: int) -> Column:
    return F.least(col(n), F.lit(cap)) / F.lit(float(cap))


def bin_label(x: str | Column, edges: list[float]) -> Column:
    """``<=t`` for the first edge that holds x, else ``>last``."""
    out = F.lit(f">{edges[-1]:g}")
    for t in reversed(edges):
        out = F.when(col(x) <= t, f"<={t:g}").otherwise(out)
    return out


def in_fold(key: str | Column, share_hex: str = "cccccccccccccc00") -> Column:
    """Whether a key's unit-interval hash (first 8 bytes of SHA-1) lies below the share; 0.8 by default, compared as hex text."""
    return F.substring(F.sha1(col(key).cast("binary")), 1, 16) < share_hex


def holdout_mod5(key: str | Column) -> Column:
    """Whether SHA-256 as a number is divisible by 5: 16 is 1 modulo 5, so the hex digits' sum decides."""
    digits = F.split(F.sha2(col(key).cast("binary"), 256), "")
    value = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: acc + F.conv(d, 16, 10).cast("int"))
    return value % 5 == 0


def stable_key(*parts: str | Column) -> Column:
    return F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts]).cast("binary"))


def sparse_difference(a: str | Column, b: str | Column) -> Column:
    """a - b by name; entries within ZERO of 0 go."""
    diff = F.map_zip_with(col(a), col(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.map_filter(diff, lambda _, v: F.abs(v) >= ZERO)


def sparse_dot(a: str | Column, weights: str | Column) -> Column:
    return F.aggregate(F.map_entries(col(a)), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(col(weights), e["key"]), F.lit(0.0)))


def keep_prefix(features: str | Column, prefix: str | None = None, exclude: tuple[str, ...] = ()) -> Column:
    def keep(k: Column, _: Column) -> Column:
        ok = k.startswith(prefix) if prefix else F.lit(True)
        for p in exclude:
            ok = ok & ~k.startswith(p)
        return ok

    return F.map_filter(col(features), keep)


def drop_zeros(features: str | Column) -> Column:
    return F.map_filter(col(features), lambda _, v: v != 0)


def mcnemar(recovered: str | Column, regressed: str | Column) -> Column:
    """Exact two-sided binomial test of discordant pairs, in logarithms so that thousands of pairs don't overflow."""
    a, b = col(recovered).cast("int"), col(regressed).cast("int")
    n, m = a + b, F.least(a, b)
    # log C(n, k + 1) = log C(n, k) + log((n - k) / (k + 1))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m, F.lit(0))),
        F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] + F.log(F.greatest(n - k, F.lit(1)).cast("double") / (k + 1).cast("double"))).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total")
        ),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * walk["total"]))


def discounted(rewards: str | Column, gamma: float = 0.9) -> Column:
    """Sum of gamma^i times reward i."""
    return F.aggregate(
        col(rewards),
        F.struct(F.lit(0.0).alias("v"), F.lit(1.0).alias("g")),
        lambda acc, r: F.struct((acc["v"] + acc["g"] * r).alias("v"), (acc["g"] * F.lit(gamma)).alias("g")),
        lambda acc: acc["v"],
    )


def tail(arr: str | Column, n: int) -> Column:
    """The last n elements."""
    return F.slice(col(arr), F.greatest(F.size(col(arr)) - (n - 1), F.lit(1)), n)


def has_cycle(actions: str | Column, max_len: int = 6, repeats: int = 3) -> Column:
    """Whether the actions end with ``repeats`` copies of a run of at most max_len actions."""
    if repeats < 2:
        raise ValueError("repeats must be at least 2")
    def ends_so(a: Column) -> Column:
        size = F.size(a)

        def copies(n: Column) -> Column:
            last = F.slice(a, size - n + 1, n)
            same = F.lit(True)
            for k in range(2, repeats + 1):
                same = same & (F.slice(a, size - n * k + 1, n) == last)
            return same

        longest = F.least(F.lit(max_len), F.floor(size / repeats).cast("int"))
        return F.when(longest > 0, F.exists(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), copies)).otherwise(F.lit(False))

    return bind(col(actions), ends_so)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]
