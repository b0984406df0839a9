"""A connector to processes that answer a line of JSON with a line of JSON (A13), as a Python data source for batches and streams.

Requests are a table: an episode is a run of requests, the first of which resets the process. ``save_requests`` deals a table out into arrival folders of Parquet files with whole episodes in order; a task reads one file, starts
one process and sends it the requests, so processes run wherever Spark has cores. What a task holds is one request, one answer and a batch of rows, however long an episode is.

A process that dies or doesn't answer in time is started again and brought back to where it was by the episode's earlier requests. A reader that dies takes its process along (its input ends), and its task runs again.
"""

from __future__ import annotations

import hashlib
import json
import queue
import subprocess
import threading
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The message that ends a process, and the fields of an answer that say whether it succeeded and why not.
CLOSE, OK, ERROR = {"command": "close"}, "ok", "error"

SCHEMA = "episode string, step bigint, response string, error string"
ARROW = pa.schema([("episode", pa.string()), ("step", pa.int64()), ("response", pa.string()), ("error", pa.string())])
FORMAT = "json_process"
#: Rows that leave a reader together.
BATCH = 256


class Gone(Exception):
    """The process has ended or doesn't answer."""


class Refused(Exception):
    """The process has answered that it can't."""


class Process:
    """A child process asked line by line. Lines that are no JSON object are its noise and skipped; the end of its errors is kept for messages."""

    def __init__(self, command: list[str], timeout: float):
        self.timeout = timeout
        self.child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, encoding="utf-8", errors="replace")
        self.lines: queue.Queue[str | None] = queue.Queue(64)
        self.errors: deque[str] = deque(maxlen=8)
        self.stopped = False
        threading.Thread(target=self._listen, daemon=True).start()
        threading.Thread(target=lambda: self.errors.extend(self.child.stderr), daemon=True).start()

    def _put(self, line: str | None) -> None:
        while not self.stopped:
            try:
                return self.lines.put(line, timeout=1)
            except queue.Full:
                continue

    def _listen(self) -> None:
        for line in self.child.stdout:
            self._put(line)
        self._put(None)

    def ask(self, request: str) -> str:
        """The answer's text; Gone or Refused otherwise."""
        try:
            self.child.stdin.write(request + "\n")
            self.child.stdin.flush()
            while True:
                line = self.lines.get(timeout=self.timeout)
                if line is None:
                    break
                try:
                    answer = json.loads(line)
                except ValueError:
                    continue
                if isinstance(answer, dict):
                    if not answer.get(OK):
                        raise Refused(str(answer.get(ERROR, "refused")))
                    return line.strip()
        except (OSError, ValueError):
            pass
        except queue.Empty:
            raise Gone("no answer in time") from None
        raise Gone(" ".join(["process ended.", *self.errors]).strip())

    def close(self, grace: float = 2) -> None:
        """Asks the process to end and ends it if it doesn't."""
        self.stopped = True
        try:
            self.child.stdin.write(json.dumps(CLOSE) + "\n")
            self.child.stdin.close()
            self.child.wait(grace)
        except (OSError, ValueError, subprocess.TimeoutExpired):
            self.child.kill()
            self.child.wait()


@dataclass
class File(InputPartition):
    path: str


def requests_of(path: str, skip: int = 0) -> Iterator[tuple[str, int, str]]:
    """(episode, step, request) of a file in order, from row ``skip`` on; row groups before it aren't read."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        table = pq.ParquetFile(source)
        for g in range(table.num_row_groups):
            size = table.metadata.row_group(g).num_rows
            if skip >= size:
                skip -= size
                continue
            for batch in table.iter_batches(BATCH, row_groups=[g], columns=["episode", "step", "request"]):
                if skip >= len(batch):
                    skip -= len(batch)
                    continue
                part = batch.slice(skip)
                skip = 0
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class Session:
    """The answers to the requests of one file, by processes of which one lives at a time."""

    def __init__(self, path: str, command: list[str], timeout: float, restarts: int):
        self.path, self.command, self.timeout, self.restarts = path, command, timeout, restarts
        self.process: Process | None = None

    def stop(self) -> None:
        if self.process:
            self.process.close()
        self.process = None

    def recovered(self, first: int, done: int, seen: bytes) -> None:
        """A new process that has got the ``done`` requests from row ``first`` on again, and has given the answers whose digest is ``seen``."""
        self.stop()
        self.process = Process(self.command, self.timeout)
        again = hashlib.sha256()
        if done:
            for at, (_, _, request) in enumerate(requests_of(self.path, first)):
                again.update(self.process.ask(request).encode() + b"\n")
                if at + 1 == done:
                    break
        if again.digest() != seen:
            raise Refused("the process gave other answers when asked again")

    def rows(self) -> Iterator[tuple[str, int, str | None, str | None]]:
        now: object = object()  # no episode yet; null is one, too
        first = done = left = 0
        seen, failure = hashlib.sha256(), None
        for at, (episode, step, request) in enumerate(requests_of(self.path)):
            if episode != now:
                now, first, done, left, seen, failure = episode, at, 0, self.restarts, hashlib.sha256(), None
            response, known = None, failure
            while response is None and failure is None:
                try:
                    if self.process is None:
                        self.recovered(first, done, seen.digest())
                    response = self.process.ask(request)
                except Gone as e:
                    self.stop()
                    left -= 1
                    if left < 0:
                        failure = str(e)
                except Refused as e:
                    failure = str(e)
            if response is not None:
                done += 1
                seen.update(response.encode() + b"\n")
            yield episode, step, response, f"not asked after: {known}" if known else failure

    def batches(self) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        try:
            for row in self.rows():
                held.append(row)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in held], ARROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in held], ARROW)
        finally:
            self.stop()


def arrivals(path: str) -> list[str]:
    """Arrival folders in order of their names, up to the first that its writer hasn't finished (no _SUCCESS yet), so that none is passed over."""
    store, name = fs.FileSystem.from_uri(path)
    out = []
    for entry in sorted(store.get_file_info(fs.FileSelector(name, allow_not_found=True)), key=lambda e: e.base_name):
        if entry.type == fs.FileType.Directory and entry.base_name[:1] not in "._":
            if store.get_file_info(f"{entry.path}/_SUCCESS").type == fs.FileType.NotFound:
                break
            out.append(entry.base_name)
    return out


def files_of(path: str, folders: list[str]) -> list[File]:
    store, name = fs.FileSystem.from_uri(path)
    return [
        File(f"{path.rstrip('/')}/{folder}/{e.base_name}") for folder in folders for e in sorted(store.get_file_info(fs.FileSelector(f"{name}/{folder}")), key=lambda e: e.base_name)
        if e.type == fs.FileType.File and e.base_name[:1] not in "._"
    ]


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.command = options["path"], json.loads(options["command"])
        self.timeout, self.restarts, self.delete = float(options.get("timeout", 60)), int(options.get("restarts", 2)), options.get("cleanup", "off") == "delete"

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads if there are no partitions
            return iter(())
        return Session(partition.path, self.command, self.timeout, self.restarts).batches()


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[File]:
        return files_of(self.path, arrivals(self.path))


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets are names of arrival folders, which never change once finished: the same two offsets give the same requests again, as often as a batch is repeated."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(arrivals(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return files_of(self.path, [a for a in arrivals(self.path) if start["after"] < a <= end["after"]])

    def commit(self, end: dict) -> None:
        """With cleanup=delete, folders that no batch will ask for again go, but for the last, whose name is the stream's place."""
        if self.delete:
            store, name = fs.FileSystem.from_uri(self.path)
            for folder in arrivals(self.path):
                if folder < end["after"]:
                    store.delete_dir(f"{name}/{folder}")


class JsonProcess(DataSource):
    """Options: path (of save_requests), command (a JSON list), timeout (seconds an answer may take, 60), restarts (of an episode's process, 2), cleanup (off, or delete: a stream's arrival folders go when committed).

    Rows: episode, step, response (the answer's JSON), error. A request that is refused, or whose process dies more than ``restarts`` times, has an error; the rest of its episode isn't asked and says so. Other episodes go on.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonProcess)


def save_requests(rows: DataFrame, path: str, arrival: str, episode: Column, step: Column, request: Column, ties: list[Column] | None = None, tasks: int | None = None) -> None:
    """Writes the arrival folder path/``arrival``: an episode's requests lie in one of ``tasks`` files (default: shuffle partitions), in order of step and ties.

    Names must grow from arrival to arrival, and an arrival holds whole episodes. A folder half written by a lost job is not read; writing it again replaces it. Null episodes are one episode; a null request is sent as ``null``.
    """
    n = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(episode.cast("string").alias("episode"), step.cast("long").alias("step"), F.coalesce(request, F.lit("null")).alias("request"), *[c.alias(f"_{i}") for i, c in enumerate(ties or [])])
    order = ["episode", "step", *[f"_{i}" for i in range(len(ties or []))]]
    dealt = named.repartition(n, "episode").sortWithinPartitions(*order)
    dealt.drop(*order[2:]).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path.rstrip('/')}/{arrival}")
