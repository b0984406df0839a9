"""Table functions: folds over the ordered rows of a key, for use in SQL on any table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


class HistoryFold:
    """``history_fold(TABLE(t), key, order, value)``: the table's own columns, and for each row what its key's rows up to it say of the value.

    visits: how often the value was there, this row included; run: how many rows in a row have had it; kinds: how many different values there were; back: whether it was there two rows before but not
    one. A null is a value like any other. The table may have any columns but these; its rows are dealt by the key and come in the order of the columns that ``order`` names, separated by commas. What is
    remembered of a key are its different values.
    """

    ADDED = ("visits", "run", "kinds", "back")

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        names = {f.name for f in table.dataType.fields}
        columns = [c.strip() for c in order.value.split(",")]
        if missing := sorted({key.value, value.value, *columns} - names):
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if clash := sorted(names & set(HistoryFold.ADDED)):
            raise ValueError(f"the table has a column {', '.join(clash)} already")
        added = [StructField(c, BooleanType() if c == "back" else LongType()) for c in HistoryFold.ADDED]
        return AnalyzeResult(StructType([*table.dataType.fields, *added]), partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(c) for c in columns])

    def __init__(self) -> None:
        self.seen: dict = {}
        self.last: list = []
        self.run = 0

    def eval(self, row: Row, key: str, order: str, value: str) -> Iterator[tuple]:
        now = row[value]
        self.seen[now] = self.seen.get(now, 0) + 1
        self.run = self.run + 1 if self.last and self.last[-1] == now else 1
        back = len(self.last) == 2 and self.last[0] == now and self.last[1] != now
        self.last = [*self.last, now][-2:]
        yield (*row, self.seen[now], self.run, len(self.seen), back)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("history_fold", udtf(HistoryFold))
