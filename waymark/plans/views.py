"""Adapter views: the library's inputs derived from the driver's tables by fixed mappings, in Spark and (for the oracles) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOALS = (
    "Your task is to: put a mug in desk.",
    "Your task is to: examine the mug with the desklamp.",
    "Your task is to: find two mug and put them in desk.",
    "Your task is to: heat some mug and put it in the desk.",
    "Your task is to: clean a mug and put it on shelf.",
    "Your task is to: put a cool mug in a desk.",
)
#: Steps of one task of a trajectory. Every window over an episode runs in the task that has it, so a task's memory is that of so many steps (and of the longest episode), whatever the input.
STEPS_A_TASK = 50_000
EPOCH_2024 = 1_704_067_200
WEEK = 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the number in props and seconds since 1970 on the table's own clock, whatever the session's time zone."""
    e = table(spark, sf_dir, "events").withColumn("since", F.expr("CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    seconds = F.expr("extract(DAY FROM since) * 86400L + extract(HOUR FROM since) * 3600 + extract(MINUTE FROM since) * 60 + floor(extract(SECOND FROM since))")
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.regexp_extract("props", r'"k": *(-?\d+)', 1).try_cast("long").alias("k"), seconds.cast("long").alias("secs"))


def tasks_for(rows: DataFrame, a_task: int | None = None) -> int:
    """How many tasks hold the rows, STEPS_A_TASK each unless told otherwise; parquet files tell their number without being read."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (a_task or STEPS_A_TASK)))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an episode for each user: episode_id, step, event_id, action, instruction, observation, value. Dealt out by episode over as many tasks as the events ask for."""
    k = lambda m: F.pmod(F.col("k"), F.lit(m)).cast("string")
    click = (
        F.when(F.pmod(F.col("k"), F.lit(5)) == 0, F.concat(F.lit("heat mug "), k(9), F.lit(" with microwave 1")))
        .when(F.pmod(F.col("k"), F.lit(5)) == 1, F.concat(F.lit("examine mug "), k(9)))
        .otherwise(F.concat(F.lit("open drawer "), k(5)))
    )
    action = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("go to shelf "), k(7)))
        .when(F.col("event_type") == "click", click)
        .when(F.col("event_type") == "signup", F.concat(F.lit("take mug "), k(9), F.lit(" from shelf "), k(7)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("move mug "), k(9), F.lit(" to desk "), k(3)))
        .otherwise("use desklamp 1")
    )
    # Renamed before the window, so that later windows by episode find its partitioning.
    order = Window.partitionBy("episode_id").orderBy("ts", "event_id")
    goals = F.element_at(F.array(*map(F.lit, GOALS)), (F.pmod(F.col("episode_id"), F.lit(len(GOALS))) + 1).cast("int"))
    dealt = events(spark, sf_dir).withColumnRenamed("user_id", "episode_id").drop("secs").repartition(tasks_for(table(spark, sf_dir, "events")), "episode_id")
    return dealt.select(
        "episode_id", (F.row_number().over(order) - 1).cast("long").alias("step"), "event_id", "event_type", "value", "k",
        action.alias("action"), goals.alias("instruction"),
        F.concat(F.lit("You arrive at shelf "), k(7), F.lit(". You see mug "), k(9), F.lit(".")).alias("observation"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows: a state is a user's week; purchases and signups succeed; the value is the return."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("alfworld/train/"), F.col("user_id").cast("string")).alias("episode_id"),
        F.floor((F.col("secs") - EPOCH_2024) / WEEK).cast("long").alias("step_index"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("action"),
        F.col("event_type").isin("purchase", "signup").alias("success"),
        F.col("value").alias("trace_return"), "event_type", "k", "event_id",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an episode (a user's week) under two variants: reference before noon, candidate after."""
    e = events(spark, sf_dir)
    hour = F.floor(F.pmod(F.col("secs"), F.lit(86_400)) / 3600)
    keyed = e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.floor((F.col("secs") - EPOCH_2024) / WEEK).cast("string")).alias("episode_id"),
        F.when(hour < 12, "reference").otherwise("candidate").alias("variant"), "event_type", "user_id",
    )
    return keyed.groupBy("episode_id", "variant", F.pmod(F.col("user_id"), F.lit(3)).alias("fam")).agg(
        F.bool_or(F.col("event_type") == "purchase").alias("success"),
        F.count("*").alias("steps"),
        F.count_if(F.col("event_type") == "error").alias("invalid"),
    ).select("episode_id", "variant", F.concat(F.lit("family_"), F.col("fam").cast("string")).alias("task_family"), "success", "steps", "invalid")


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as states, their customers' market segments as families."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("family"), F.col("o_orderkey").alias("key"), "o_orderstatus", "o_totalprice", "o_orderpriority")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: vec_id, label, position from 0, value. The ranker's weight of position i is ((i % 7) - 3) / 10."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "label", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def weight_of(pos: str):
    return (F.pmod(F.col(pos), F.lit(7)) - 3).cast("double") / F.lit(10.0)


#: The same views as SQL common table expressions.
SQL_EVENTS = r"""
ev AS (SELECT event_id, user_id, event_type, value, ts, TRY_CAST(regexp_extract(props, '"k": *(-?\d+)', 1) AS BIGINT) AS k,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS secs FROM events)"""
SQL_TRAJECTORY = (
    SQL_EVENTS
    + r""",
tr AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_id, event_type, value, k,
  CASE event_type WHEN 'view' THEN 'go to shelf ' || (k % 7)
    WHEN 'click' THEN CASE k % 5 WHEN 0 THEN 'heat mug ' || (k % 9) || ' with microwave 1' WHEN 1 THEN 'examine mug ' || (k % 9) ELSE 'open drawer ' || (k % 5) END
    WHEN 'signup' THEN 'take mug ' || (k % 9) || ' from shelf ' || (k % 7)
    WHEN 'purchase' THEN 'move mug ' || (k % 9) || ' to desk ' || (k % 3)
    ELSE 'use desklamp 1' END AS action,
  list_extract([""" + ", ".join(f"'{g}'" for g in GOALS) + r"""], CAST(user_id % 6 + 1 AS BIGINT)) AS instruction,
  'You arrive at shelf ' || (k % 7) || '. You see mug ' || (k % 9) || '.' AS observation
  FROM ev)"""
)
SQL_CANDIDATES = (
    SQL_EVENTS
    + f""",
ca AS (SELECT 'alfworld/train/' || user_id AS episode_id, CAST(floor((secs - {EPOCH_2024}) / {WEEK}) AS BIGINT) AS step_index,
  event_type || ' ' || event_id AS action, event_type IN ('purchase', 'signup') AS success, value AS trace_return, event_type, k, event_id FROM ev)"""
)
SQL_RUNS = (
    SQL_EVENTS
    + f""",
ru AS (SELECT user_id || '/' || CAST(floor((secs - {EPOCH_2024}) / {WEEK}) AS BIGINT) AS episode_id,
  CASE WHEN floor((secs % 86400) / 3600) < 12 THEN 'reference' ELSE 'candidate' END AS variant,
  'family_' || (user_id % 3) AS task_family, bool_or(event_type = 'purchase') AS success, count(*) AS steps,
  count(*) FILTER (event_type = 'error') AS invalid FROM ev GROUP BY 1, 2, 3)"""
)
SQL_STRATA = """
st AS (SELECT c_mktsegment AS family, o_orderkey AS key, o_orderstatus, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_VECTORS = """
ve AS (SELECT vec_id, label, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS x, CAST(((i - 1) % 7) - 3 AS DOUBLE) / 10.0::DOUBLE AS w
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i))"""
