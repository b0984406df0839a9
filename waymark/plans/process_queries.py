"""Conversations told to processes, as a batch and as a stream, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import process
from ..streaming import joins
from .register import Register

query = Register()

#: Arrivals of the stream.
ARRIVALS = 3
#: Step of the message that opens a conversation.
RESET = -(1 << 62)

_SQL = """SELECT conv_id, turn, CAST(row_number() OVER w AS BIGINT) AS turns, CAST(sum(length(text)) OVER w AS BIGINT) AS characters, lag(md5(text)) OVER w AS before
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING)"""


def _command(spark: SparkSession) -> str:
    return json.dumps([spark.sparkContext.pythonExec, "-m", "waymark.sources.transcript_process"])


def _requests(spark: SparkSession, sf_dir: str, path: str, arrivals: int, number: int) -> None:
    """Arrival ``number`` of ``arrivals``: each conversation as a reset and a step for each turn; whole conversations arrive together."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    opens = told.select("conv_id").distinct().select("conv_id", F.lit(RESET).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = told.unionByName(opens)
    message = F.to_json(F.struct(F.when(F.col("text").isNull(), "reset").otherwise("step").alias("command"), "text"))
    # Turns without a number come after the reset and before the others, as in the SQL.
    step = F.coalesce(F.col("turn").cast("long"), F.lit(RESET + 1))
    own = rows.filter(F.pmod(F.col("conv_id"), F.lit(arrivals)) == number)
    process.save_requests(own, path, f"arrival-{number:06d}", F.col("conv_id"), step, message, [F.col("role"), F.col("text")])


def _answers(found: DataFrame) -> DataFrame:
    """(conv_id, turn, turns, characters, before) of steps; an error leaves nulls, so it can't pass for an answer."""
    answer = F.from_json("response", "turns bigint, characters bigint, before string")
    steps = found.filter(F.col("step") > RESET).select(F.col("episode").cast("long").alias("conv_id"), F.when(F.col("step") > RESET + 1, F.col("step")).alias("turn"), answer.alias("a"))
    return steps.select("conv_id", "turn", "a.turns", "a.characters", "a.before")


@query(_SQL)
def process_replay(spark, sf_dir):
    """All conversations told to child processes, one for each task."""
    process.register(spark)
    path = shared_path(spark, "requests")
    _requests(spark, sf_dir, path, 1, 0)
    return _answers(spark.read.format(process.FORMAT).option("command", _command(spark)).load(path))


@query(_SQL)
def stream_process_replay(spark, sf_dir):
    """The same as a stream over arrivals: it stops after each, goes on at the next, and deletes what it has committed."""
    process.register(spark)
    path, sink = shared_path(spark, "requests"), shared_path(spark, "answers")
    for number in range(ARRIVALS):
        _requests(spark, sf_dir, path, ARRIVALS, number)
        stream = _answers(spark.readStream.format(process.FORMAT).option("command", _command(spark)).option("cleanup", "delete").load(path))
        joins.run(stream, sink)
    return joins.rows_of(spark, sink, stream)
