"""The connector to child processes: answers, failures, recovery, arrivals and streams."""

import json
import os
import subprocess
import sys
import textwrap

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.sources import process
from waymark.streaming import joins

#: Counts the steps of an episode; some texts make it fail, once for each file that marks the failure, or always.
CHILD = """
import json, os, sys, time, signal, random
def first(name):
    try:
        os.close(os.open(os.path.join(sys.argv[1], name), os.O_CREAT | os.O_EXCL))
        return True
    except FileExistsError:
        return False
n = 0
for line in sys.stdin:
    m = json.loads(line)
    if not isinstance(m, dict):
        print(json.dumps({"ok": False, "error": "no object"}), flush=True)
        continue
    t = m.get("text", "")
    if m["command"] == "close":
        break
    n = 0 if m["command"] == "reset" else n + 1
    if t == "die" or t == "die once" and first("died"):
        sys.stderr.write("worn out\\n"); sys.stderr.flush(); os._exit(3)
    if t == "hang once" and first("hung"):
        time.sleep(600)
    if t == "kill reader once" and first("killed"):
        os.kill(os.getppid(), signal.SIGKILL); time.sleep(1)
    if t == "noise":
        print("no json\\n17\\n", flush=True)
    out = {"ok": t != "refuse", "n": n, "text": t}
    if t == "refuse":
        out["error"] = "never"
    if t == "random":
        out["r"] = random.random()
    print(json.dumps(out), flush=True)
"""


@pytest.fixture
def command(tmp_path):
    path = tmp_path / "child.py"
    path.write_text(CHILD)
    return [sys.executable, str(path), str(tmp_path)]


def requests(path, episodes, group=3):
    """A file of episodes {name: texts}; each begins with a reset."""
    rows = [(e, i, json.dumps({"command": "step" if i else "reset", "text": t})) for e, texts in episodes for i, t in enumerate(["", *texts])]
    table = pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("episode", pa.string()), ("step", pa.int64()), ("request", pa.string())))})
    pq.write_table(table, path, row_group_size=group)
    return f"file://{path}"


def answers(path, command, timeout=20.0, restarts=2):
    out = []
    for batch in process.Session(path, command, timeout, restarts).batches():
        out += [(r["episode"], r["step"], json.loads(r["response"])["n"] if r["response"] else None, r["error"]) for r in batch.to_pylist()]
    return out


def good(episode, n, begin=0):
    return [(episode, i, i, None) for i in range(begin, n + 1)]


def test_answers_in_order_past_noise(tmp_path, command):
    path = requests(tmp_path / "a.parquet", [("a", ["x", "noise", ""]), (None, ["x"]), ("b", ["long " * 40_000] * 300)])
    assert answers(path, command) == good("a", 3) + good(None, 1) + good("b", 300)


@pytest.mark.parametrize("failure", ["die once", "hang once"])
def test_a_process_that_fails_is_brought_back(tmp_path, command, failure):
    path = requests(tmp_path / "a.parquet", [("a", ["x"] * 5 + [failure] + ["y"] * 5), ("b", ["z"])])
    assert answers(path, command, timeout=1.5 if failure == "hang once" else 20.0) == good("a", 11) + good("b", 1)
    assert (tmp_path / ("died" if failure == "die once" else "hung")).exists()


def test_failures_cost_the_rest_of_their_episode_only(tmp_path, command):
    path = requests(tmp_path / "a.parquet", [("a", ["x", "die", "y", "y"]), ("b", ["refuse", "y"]), ("c", ["z"])])
    out = answers(path, command)
    assert out[:2] == good("a", 1) and out[5] == ("b", 0, 0, None) and out[8:] == good("c", 1)
    assert [r[2] for r in out[2:5]] == [None] * 3 and "worn out" in out[2][3] and out[3][3].startswith("not asked after: ")
    assert out[6:8] == [("b", 1, None, "never"), ("b", 2, None, "not asked after: never")]


def test_other_answers_after_a_restart_are_an_error(tmp_path, command):
    path = requests(tmp_path / "a.parquet", [("a", ["random", "die once", "y"]), ("b", ["z"])])
    out = answers(path, command)
    assert [r[2] for r in out] == [0, 1, None, None, 0, 1] and "other answers" in out[2][3]


def test_a_command_that_cannot_start_is_raised(tmp_path):
    path = requests(tmp_path / "a.parquet", [("a", ["x"])])
    with pytest.raises(FileNotFoundError):
        answers(path, ["/no/such/command"])


def saved(spark, path, arrival, rows):
    """rows: (episode, step, text, tie); text None makes a null request."""
    df = spark.createDataFrame(rows, "episode string, step long, text string, tie int")
    request = F.when(F.col("text").isNotNull(), F.to_json(F.struct(F.when(F.col("step") == 0, "reset").otherwise("step").alias("command"), "text")))
    process.save_requests(df, path, arrival, F.col("episode"), F.col("step"), request, [F.col("tie")], 3)


def reader(spark, command, stream=False, **options):
    process.register(spark)
    return (spark.readStream if stream else spark.read).format(process.FORMAT).option("command", json.dumps(command)).options(**options)


def rows(df):
    n = F.get_json_object("response", "$.n").cast("int")
    return sorted(((r[0] or "-", r[1] if r[1] is not None else -1, r[2], r[3]) for r in df.select("episode", "step", n, "error").collect()), key=str)


def test_batches_and_odd_rows(spark, tmp_path, command):
    path = f"file://{tmp_path}/in"
    assert reader(spark, command).load(path).count() == 0  # nothing there yet
    saved(spark, path, "a1", [])
    assert reader(spark, command).load(path).count() == 0
    saved(spark, path, "a2", [(None, 0, "", 1), (None, 1, "x", 1), ("t", 0, "", 1), ("t", 1, "second", 2), ("t", 1, "first", 1), ("t", 1, "first", 1), ("n", 0, None, 1), ("n", 1, "x", 1)])
    got = reader(spark, command).load(path)
    texts = [r[0] for r in got.filter("episode = 't'").select(F.get_json_object("response", "$.text")).collect()]
    assert texts == ["", "first", "first", "second"]  # ties in order, repeats kept
    want = [("-", 0, 0, None), ("-", 1, 1, None), *good("t", 1), ("t", 1, 2, None), ("t", 1, 3, None), ("n", 0, None, "no object"), ("n", 1, None, "not asked after: no object")]
    assert rows(got) == sorted(want, key=str)


def test_stream_goes_on_after_finished_arrivals(spark, tmp_path, command):
    path, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = reader(spark, command, stream=True, cleanup="delete").load(path)
    saved(spark, path, "a1", [("a", 0, "", 1), ("a", 1, "die once", 1), ("a", 2, "x", 1)])
    joins.run(stream, sink)
    assert rows(joins.rows_of(spark, sink, stream)) == good("a", 2)
    for arrival in ("a2", "a3"):
        saved(spark, path, arrival, [(arrival, 0, "", 1), (arrival, 1, "x", 1)])
    os.rename(tmp_path / "in/a2/_SUCCESS", tmp_path / "held")  # a2 isn't finished, so a3 waits, too
    joins.run(stream, sink)
    assert rows(joins.rows_of(spark, sink, stream)) == good("a", 2)
    os.rename(tmp_path / "held", tmp_path / "in/a2/_SUCCESS")
    joins.run(stream, sink)
    assert rows(joins.rows_of(spark, sink, stream)) == sorted(good("a", 2) + good("a2", 1) + good("a3", 1), key=str)
    joins.run(stream, sink)  # nothing new, nothing twice
    assert joins.rows_of(spark, sink, stream).count() == 7
    saved(spark, path, "a4", [("a4", 0, "", 1)])
    joins.run(stream, sink)
    assert joins.rows_of(spark, sink, stream).count() == 8 and process.arrivals(path) == ["a3", "a4"]


def test_offsets_are_replayed(spark, tmp_path, command):
    path = f"file://{tmp_path}/in"
    for arrival in ("a1", "a2", "a3"):
        saved(spark, path, arrival, [(arrival, 0, "", 1)])
    r = process.StreamReader({"path": path, "command": "[]"})
    assert r.initialOffset() == {"after": ""} and r.latestOffset() == {"after": "a3"}
    once = r.partitions({"after": "a1"}, {"after": "a2"})
    r.commit({"after": "a3"})  # without cleanup nothing goes
    assert once == r.partitions({"after": "a1"}, {"after": "a2"}) and all("/a2/" in f.path for f in once)


def test_a_killed_reader_runs_again(tmp_path, command):
    """A session of its own, whose tasks may be tried again: a process kills the Python worker that reads it."""
    (tmp_path / "in/a").mkdir(parents=True)
    requests(tmp_path / "in/a/part.parquet", [("a", ["x", "kill reader once", "y"]), ("b", ["z"])])
    (tmp_path / "in/a/_SUCCESS").touch()
    code = f"""
        import json
        from waymark.session import build_session
        from waymark.sources import process
        spark = build_session("killed", "local[2,3]")
        process.register(spark)
        found = spark.read.format(process.FORMAT).option("command", {json.dumps(command)!r}).load("file://{tmp_path}/in")
        print("FOUND", json.dumps(sorted([r["episode"], r["step"], json.loads(r["response"])["n"]] for r in found.collect())))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=180)
    assert (tmp_path / "killed").exists(), done.stderr[-2000:]
    line = next(x for x in done.stdout.splitlines() if x.startswith("FOUND"))
    assert json.loads(line[6:]) == [["a", 0, 0], ["a", 1, 1], ["a", 2, 2], ["a", 3, 3], ["b", 0, 0], ["b", 1, 1]]
