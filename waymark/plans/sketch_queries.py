"""Sketches against exact counts, and the bitmap cube, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches
from ..session import shared_path, written
from . import views
from .register import Register

query = Register()

#: A small sketch, so that counts of thousands are estimates.
LG, FINE = 9, ["day", "l_returnflag"]


def _lines(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem")
    return lines.select(F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


def _stored(spark, sf_dir):
    """The sketches of each day and flag, stored and read again."""
    path = shared_path(spark, "sketches")
    sketches.save(sketches.build(_lines(spark, sf_dir), FINE, "l_orderkey", "l_extendedprice", LG), path)
    return spark.read.parquet(path)


@query("""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, true AS within, true AS median_within FROM lineitem GROUP BY 1, 2""")
def sketch_ranges(spark, sf_dir):
    """Different orders and the median price of each year and flag from the sketches of days: whether the exact count lies within three standard errors, and the median's rank within three times the bound."""
    merged = sketches.merge(_stored(spark, sf_dir).withColumn("year", F.year("day")), ["year", "l_returnflag"], LG)
    guess = sketches.estimates(merged, ["year", "l_returnflag"], lg_nominal=LG)
    lines = _lines(spark, sf_dir).join(F.broadcast(guess.select("year", "l_returnflag", "q50")), ["year", "l_returnflag"])  # a row a year and flag
    below, upto = F.count_if(F.col("l_extendedprice") < F.col("q50")), F.count_if(F.col("l_extendedprice") <= F.col("q50"))
    exact = lines.groupBy("year", "l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), (below / F.count("*")).alias("low"), (upto / F.count("*")).alias("high"))
    off = 3 * sketches.RANK_ERROR
    return guess.join(exact, ["year", "l_returnflag"]).select(
        "year", "l_returnflag", "n", "orders", F.col("orders").between(F.col("distinct_low"), F.col("distinct_high")).alias("within"),
        ((F.col("low") <= 0.5 + off) & (F.col("high") >= 0.5 - off)).alias("median_within"),
    )


@query("""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey, count(*) AS exact, true AS within FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1, 2""")
def sketch_frequencies(spark, sf_dir):
    """How often every tenth supplier occurs in a year, from count-min tables of days and suppliers' flags: never less than exactly, and at most 2 / cells of the year's lines more."""
    lines = _lines(spark, sf_dir)
    daily = sketches.count_min(lines, ["day", "l_returnflag"], "l_suppkey", spread=["l_orderkey"])
    yearly = written(sketches.merge_counts(daily.withColumn("year", F.year("day")), ["year"]), "yearly")  # read twice below
    exact = lines.groupBy("year", "l_suppkey").agg(F.count("*").alias("exact")).filter(F.col("l_suppkey") % 10 == 0)
    found = sketches.frequencies(yearly, exact, ["year"], "l_suppkey")
    sizes = yearly.filter(F.col("line") == 0).groupBy("year").agg(F.sum("n").alias("all"))
    both = found.join(exact, ["year", "l_suppkey"]).join(F.broadcast(sizes), "year")  # a row a year
    over = F.col("estimate") - F.col("exact")
    return both.select("year", "l_suppkey", "exact", ((over >= 0) & (over <= F.ceil(F.col("all") * 2 / sketches.CELLS))).alias("within"))


@query("""SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS BIGINT) AS level, count(*) AS n, count(DISTINCT l_partkey) AS "distinct"
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, year(l_shipdate))""")  # fmt: skip
def distinct_cube(spark, sf_dir):
    """Lines and different parts on all eight levels of flag, status and year."""
    return sketches.cube(_lines(spark, sf_dir), ["l_returnflag", "l_linestatus", "year"], "l_partkey")
