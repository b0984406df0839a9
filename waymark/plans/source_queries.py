"""Queries over sources, sinks, joins, sets and checks, beside their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import integrity, ranking, reports, sampling
from ..session import shared_path
from ..sources import files
from . import views
from .oracles import view
from .register import Register
from .views import SQL_CANDIDATES, SQL_RUNS, SQL_STRATA, SQL_TRAJECTORY, SQL_VECTORS

query = Register()
STATE = ["episode_id", "step_index"]


def _orders(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


ORDERS = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
SQL_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


@query(SQL_ORDERS)
def jsonl_round_trip(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    files.write_jsonl(_orders(spark, sf_dir), path)
    return files.read_jsonl(spark, path, ORDERS)


@query(SQL_ORDERS)
def jsonl_gzip(spark, sf_dir):
    path = shared_path(spark, "jsonl-gz")
    _orders(spark, sf_dir).write.option("compression", "gzip").json(path)
    return files.read_jsonl(spark, path, ORDERS)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100")
def scan_slice(spark, sf_dir):
    """A limit is what this operator is for."""
    return files.scan_slice(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100, 250)


@query(view(SQL_CANDIDATES, "SELECT DISTINCT episode_id, step_index FROM ca ORDER BY episode_id, step_index LIMIT 100"))
def ordered_states(spark, sf_dir):
    return files.scan_slice(views.candidates(spark, sf_dir).select(*STATE).distinct(), STATE, 0, 100)


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def json_report(spark, sf_dir):
    """A report written as one indented document, and read back over its lines."""
    path = shared_path(spark, "report") + "/report.json"
    files.report(views.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return files.read_document(spark, path, "r_regionkey bigint, r_name string")


@query("""SELECT n_name, 'configs/models/' || lower(n_name) || '.json' AS model, 'file:///m/' || n_name AS remote, '/abs/' || n_name AS fixed,
  CASE WHEN n_regionkey % 2 = 0 THEN lower(n_name) || '.jsonl' ELSE '/elsewhere/' || lower(n_name) || '.jsonl' END AS portable, n_regionkey = 3 AS invalid FROM nation""")
def config_links(spark, sf_dir):
    """Links of configuration files, records of paths, and entries of a release's list."""
    n = views.table(spark, sf_dir, "nation")
    low, base = F.lower("n_name"), F.concat(F.lit("configs/runs/"), F.col("n_regionkey").cast("string"), F.lit(".json"))
    path = F.concat(F.when(F.col("n_regionkey") % 2 == 0, "/data/x/../").otherwise("/elsewhere/"), low, F.lit(".jsonl"))
    entry = F.concat(F.when(F.col("n_regionkey") == 3, "a/../").otherwise("a/"), low)
    return n.select(
        "n_name", T.resolve_link(base, F.concat(F.lit("../models/./"), low, F.lit(".json"))).alias("model"), T.resolve_link(base, F.concat(F.lit("file:///m/"), "n_name")).alias("remote"),
        T.resolve_link(base, F.concat(F.lit("/abs/"), "n_name")).alias("fixed"), T.portable_path(path, "/data").alias("portable"), T.invalid_release_path(entry).alias("invalid"),
    )


@query("SELECT n_regionkey AS region, count(*) AS nations, min(n_name) AS first FROM nation GROUP BY 1")
def csv_report(spark, sf_dir):
    path = shared_path(spark, "csv")
    rows = views.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))
    files.write_csv(rows, path)
    return spark.read.option("header", True).schema("region int, nations bigint, first string").csv(path)


@query(SQL_ORDERS)
def release_export(spark, sf_dir):
    """One folder for each status, read back with the folders' names as a column."""
    path = shared_path(spark, "release")
    files.write_jsonl(_orders(spark, sf_dir), path, by=["o_orderstatus"])
    return spark.read.schema(ORDERS).json(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT printf('f%02d', i) AS feature, CAST((i % 7) - 3 AS DOUBLE) / 10.0::DOUBLE AS weight FROM range(0, 64) t(i)")
def ranker_saved(spark, sf_dir):
    path = shared_path(spark, "ranker")
    files.save_ranker(spark, path, {f"f{i:02d}": (i % 7 - 3) / 10 for i in range(64)})
    return files.load_ranker(spark, path)


@query(view(SQL_TRAJECTORY, "SELECT action, round(length(action) / 7.0::DOUBLE, 9) AS score, bool_or(episode_id % 2 = 0) AS known FROM tr GROUP BY 1"))
def score_cache(spark, sf_dir):
    """Actions of half of the episodes are scored first; the second run scores and appends what the cache lacks."""
    t, path = views.trajectory(spark, sf_dir), shared_path(spark, "scores")
    score = F.length("action") / 7
    files.cached_scores(t.filter(F.col("episode_id") % 2 == 0), path, "action", score)
    before = spark.read.schema(files.SCORES).json(path).select("key", F.lit(True).alias("was"))  # lists its files now, before the second run
    before.count()
    every = files.cached_scores(t, path, "action", score)
    return every.join(before, "key", "left").select("action", F.round("score", 9).alias("score"), F.col("was").isNotNull().alias("known"))


def _notes(spark, sf_dir, label):
    path = shared_path(spark, label)
    for r in views.table(spark, sf_dir, "region").select("r_name").collect():  # five files
        files.write_text(spark, f"{path}/{r['r_name'].replace(' ', '_')}.txt", r["r_name"])
    return path


def _name(path: str = "path"):
    return F.replace(F.regexp_extract(path, r"([^/]+)\.txt$", 1), F.lit("_"), F.lit(" "))


@query("SELECT r_name AS name, CAST(length(r_name) AS BIGINT) AS size, sha256(r_name) AS sha256 FROM region")
def file_inventory(spark, sf_dir):
    return files.inventory(spark, _notes(spark, sf_dir, "inventory")).select(_name().alias("name"), "size", "sha256")


@query("SELECT r_name AS name, regexp_extract(r_name, '[AEIOU]{2}|SIA', 0) AS found FROM region WHERE regexp_matches(r_name, '[AEIOU]{2}|SIA')")
def text_lint(spark, sf_dir):
    return files.lint(spark, _notes(spark, sf_dir, "lint"), "[AEIOU]{2}|SIA").select(_name().alias("name"), "found")


@query("SELECT * FROM (VALUES (1, 'first', true), (2, 'same inputs', true), (3, 'other inputs', false)) t(run, what, accepted)")
def identity_guard(spark, sf_dir):
    """A run, its repetition, and a run with other inputs over one output."""
    path, out = shared_path(spark, "identity") + "/identity.json", []
    for k, (what, identity) in enumerate((("first", {"seed": 1, "rows": "a"}), ("same inputs", {"rows": "a", "seed": 1}), ("other inputs", {"seed": 2, "rows": "a"})), 1):
        try:
            files.identity_guard(spark, path, identity)
            out.append((k, what, True))
        except ValueError:
            out.append((k, what, False))
    return spark.createDataFrame(out, "run int, what string, accepted boolean")


# --- joins and sets --------------------------------------------------------------------------------------------------


@query(view(SQL_RUNS, """SELECT episode_id, CASE WHEN r THEN 'first' ELSE 'second' END AS side FROM (
  SELECT episode_id, bool_or(variant = 'reference') AS r, bool_or(variant = 'candidate') AS c FROM ru GROUP BY 1) WHERE r <> c"""))  # fmt: skip
def paired_key_audit(spark, sf_dir):
    """Episodes that ran under one variant only: a comparison wants none."""
    r = views.runs(spark, sf_dir)
    return integrity.unmatched(r.filter(F.col("variant") == "reference"), r.filter(F.col("variant") == "candidate"), ["episode_id"])


@query("SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def manifest_lookup(spark, sf_dir):
    s, n = views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), views.table(spark, sf_dir, "nation")
    return integrity.lookup(s, n, {"s_nationkey": "n_nationkey"}).select("s_suppkey", "n_name", "n_regionkey")


@query(view(SQL_STRATA, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT key FROM bu WHERE r <= greatest(1, round_even(n * 50 / 100.0, 0)))",
    "bu AS (SELECT family, key, row_number() OVER (PARTITION BY family ORDER BY sha256('17:' || key), key) AS r, count(*) OVER (PARTITION BY family) AS n FROM st)"))
def budget_rows(spark, sf_dir):
    """Rows of the states that a budget of half chooses."""
    chosen = sampling.budget(views.strata(spark, sf_dir), 50).select(F.col("key").alias("l_orderkey"))
    return integrity.having_key(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), chosen, ["l_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rows_in_set(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return integrity.having_key(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey")


@query(view(SQL_CANDIDATES, """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown state' ELSE 'changed context' END AS problem FROM ca
  WHERE event_id % 11 = 0 OR event_id % 7 = 0"""))  # fmt: skip
def resume_context(spark, sf_dir):
    """Resumed rows of which some belong to no state and some have another context."""
    c = views.candidates(spark, sf_dir).select("event_id", "action", F.col("k").alias("context"))
    done = c.withColumn("event_id", F.when(F.col("event_id") % 11 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id"))).withColumn("context", F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("context")))
    return integrity.context_changes(done, c, ["event_id"], ["action", "context"]).select(F.when(F.col("event_id") < 0, -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"), "problem")


@query("""SELECT o_orderkey, round(o_totalprice, 6) AS computed, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice + 0.5::DOUBLE, 6) END AS recorded FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0""")
def recorded_values(spark, sf_dir):
    """Recorded values of which some are missing and some differ; differences below the tolerance don't count."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    recorded = o.filter(F.col("o_orderkey") % 5 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 3 == 0, 0.5).otherwise(1e-10))
    return integrity.differing(o, recorded, ["o_orderkey"], "o_totalprice").select("o_orderkey", F.round("computed", 6).alias("computed"), F.round("recorded", 6).alias("recorded"))


@query("SELECT count(*) FILTER (p % 3 <> 0 AND p % 4 = 0) AS first_only, count(*) FILTER (p % 3 = 0 AND p % 4 <> 0) AS second_only FROM (SELECT DISTINCT l_partkey AS p FROM lineitem)")
def set_equality(spark, sf_dir):
    p = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"))
    return integrity.set_differences(p.filter(F.col("p") % 3 != 0), p.filter(F.col("p") % 4 != 0))


@query("""SELECT split, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, 'early' AS split FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'late' FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1""")  # fmt: skip
def concatenated_splits(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_orderkey")
    part = lambda m, name: o.filter(F.col("o_orderkey") % m == 0).withColumn("split", F.lit(name))
    return part(2, "early").unionByName(part(3, "late")).groupBy("split").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT o_orderkey AS place, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 17 = 0 THEN 'extra' ELSE 'other' END AS problem FROM orders
  WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0 OR o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0 OR o_orderkey % 19 = 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""")  # fmt: skip
def list_equality(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("id"))
    other = o.filter(F.col("place") % 13 != 0).withColumn("id", F.when(F.col("place") % 19 == 0, -1).otherwise(F.col("id")))
    return integrity.list_differences(o.filter(F.col("place") % 17 != 0), other, "place", ["id"])


@query(view(SQL_TRAJECTORY, """SELECT episode_id, step FROM tr t JOIN (SELECT episode_id, max(step) AS last FROM tr WHERE step % 4 <> 2 GROUP BY 1) USING (episode_id) WHERE step % 4 = 2 AND step < last"""))
def prefix_gaps(spark, sf_dir):
    t = views.trajectory(spark, sf_dir).select("episode_id", "step")
    return integrity.prefix_gaps(t.filter(F.col("step") % 4 != 2), t, "episode_id", "step")


# --- reports and ranks ------------------------------------------------------------------------------------------------

REASON = "CASE WHEN success THEN 'goal' WHEN steps >= 3 THEN 'max_steps' WHEN steps = 2 THEN 'env_done_without_success' ELSE 'stopped' END"


@query(view(SQL_RUNS, f"""SELECT CASE WHEN grouping(variant) = 0 THEN 'split' WHEN grouping(task_family) = 0 THEN 'family' ELSE 'overall' END AS level, variant, task_family, count(*) AS episodes,
  count(*) FILTER (success) AS successes, round(avg(steps), 6) AS average_steps, count(*) FILTER (reason = 'max_steps') AS timeouts,
  count(*) FILTER (reason IN ('max_steps', 'env_done_without_success')) AS timeouts_or_ended FROM (SELECT *, {REASON} AS reason FROM ru) GROUP BY GROUPING SETS ((), (variant), (task_family))"""))  # fmt: skip
def summary_timeouts(spark, sf_dir):
    reason = F.when(F.col("success"), "goal").when(F.col("steps") >= 3, "max_steps").when(F.col("steps") == 2, "env_done_without_success").otherwise("stopped")
    r = reports.completion(views.runs(spark, sf_dir).withColumn("termination_reason", reason), names=("split", "family"), timeouts=True)
    return r.select("level", "variant", "task_family", "episodes", "successes", F.round("average_steps", 6).alias("average_steps"), "timeouts", "timeouts_or_ended")


@query(view(SQL_RUNS, """SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(scope) = 0 THEN 'scope' ELSE 'overall' END AS level, split, scope, count(*) AS episodes,
  count(*) FILTER (success) AS successes, round(avg(steps), 6) AS mean_steps, round(avg(cost), 6) AS mean_cost
  FROM (SELECT variant AS split, task_family AS scope, success, steps, CAST(steps * 2 + invalid AS DOUBLE) AS cost FROM ru) GROUP BY GROUPING SETS ((), (split), (scope))"""))  # fmt: skip
def scope_rollup(spark, sf_dir):
    from ..workflow import cases

    r = views.runs(spark, sf_dir).select(F.col("variant").alias("split"), F.col("task_family").alias("scope"), "success", "steps", (F.col("steps") * 2 + F.col("invalid")).cast("double").alias("cost"))
    return cases.summarize(r)


@query(view(SQL_CANDIDATES, """SELECT episode_id, step_index, action, row_number() OVER (PARTITION BY episode_id, step_index ORDER BY CASE WHEN n > 3 THEN -trace_return ELSE 0 END, event_id) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY episode_id, step_index) AS n FROM ca) QUALIFY n <= 3 OR place <= 3"""))  # fmt: skip
def retrieval_shortlist(spark, sf_dir):
    return ranking.retrieval_shortlist(views.candidates(spark, sf_dir), STATE, "trace_return", "event_id", 3).select(*STATE, "action", "place")


@query(view(SQL_CANDIDATES, """SELECT episode_id, step_index, action, round(trace_return / 50, 0) AS score FROM ca
  QUALIFY row_number() OVER (PARTITION BY episode_id, step_index ORDER BY round(trace_return / 50, 0) DESC, event_id) = 1"""))  # fmt: skip
def argmax_earliest(spark, sf_dir):
    """Coarse scores, so that there are ties: the earliest in the list wins."""
    c = views.candidates(spark, sf_dir).withColumn("score", F.round(F.col("trace_return") / 50, 0))
    return ranking.argmax(c, STATE, "score", "action", largest_action=False, position="event_id")


@query("SELECT o_orderstatus, string_agg(p || '=' || n, ',' ORDER BY p) AS counts FROM (SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def report_maps(spark, sf_dir):
    """A map of counts for each status, its keys in order."""
    n = views.table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    own = n.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("m"))  # a few priorities
    return own.select("o_orderstatus", F.array_join(F.transform("m", lambda e: F.concat(e["p"], F.lit("="), e["n"].cast("string"))), ",").alias("counts"))


@query(view(SQL_VECTORS, "SELECT vec_id, count(*) AS n, round(sum(x), 6) AS total FROM ve WHERE pos BETWEEN 10 AND 19 AND pos <> 13 GROUP BY 1"))
def feature_namespace(spark, sf_dir):
    """Features of one prefix, but for another."""
    from ..functions import numeric as N

    v = views.vectors(spark, sf_dir).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("f%02d", "pos"), "x"))).alias("features"))
    kept = v.select("vec_id", F.explode(N.keep_prefix("features", "f1", ("f13",))).alias("f", "x"))
    return kept.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


@query(view(SQL_VECTORS, "SELECT vec_id, count(*) AS n FROM ve WHERE round(x * 5, 0) <> 0 GROUP BY 1"))
def drop_zeros(spark, sf_dir):
    from ..functions import numeric as N

    v = views.vectors(spark, sf_dir).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.round(F.col("x") * 5, 0).alias("x")))).alias("features"))
    return v.select("vec_id", F.explode(N.drop_zeros("features"))).groupBy("vec_id").agg(F.count("*").alias("n"))


DOCUMENTS = {
    "structured": {"schema_version": "structured-progress-potential-runtime-v1", "structured_weight": 0.5},
    "unified": {"schema_version": "unified-progress-value-runtime-v1", "structured_weight": 0.25, "semantic_weight": 0.5, "ranker": {"delta:placed": 1.5, "candidate:repeats": -0.75, "bias": 0.1}},
    "semantic": {"schema_version": "unified-progress-value-runtime-v1", "structured_weight": 0.0, "semantic_weight": 1.0, "ranker": {"schema:go_to": 1.0}},
}


def _runtime_sql() -> str:
    from .feature_oracles import CHAIN, EFFECT, long
    from .oracles import BASIS, HISTORY

    return view(SQL_TRAJECTORY, """SELECT episode_id, step, round(0.5::DOUBLE * coalesce(s, 0), 6) AS structured,
  round(0.25::DOUBLE * coalesce(s, 0) + 0.5::DOUBLE * 2.0::DOUBLE * tanh(coalesce(m, 0) / 2.0::DOUBLE), 6) AS unified, round(2.0::DOUBLE * tanh(coalesce(q, 0) / 2.0::DOUBLE), 6) AS semantic
  FROM tr LEFT JOIN (SELECT episode_id, step, sum(contribution) AS s FROM bc GROUP BY 1, 2) USING (episode_id, step)
  LEFT JOIN (SELECT episode_id, step, sum(CASE feature WHEN 'delta:placed' THEN 1.5::DOUBLE WHEN 'candidate:repeats' THEN -0.75::DOUBLE WHEN 'bias' THEN 0.1::DOUBLE ELSE 0 END * value) AS m,
    sum(CASE feature WHEN 'schema:go_to' THEN 1.0::DOUBLE ELSE 0 END * value) AS q FROM ef GROUP BY 1, 2) USING (episode_id, step)""", *HISTORY, *BASIS, *CHAIN, long("ef", EFFECT))  # fmt: skip


@query(_runtime_sql())
def runtime_dispatch(spark, sf_dir):
    """Three runtime documents, written and read, each dispatched by its schema version; all of them score a step in one pass. Steps without an episode score 0."""
    from ..operators import history, runtime

    texts = {}
    for name, document in DOCUMENTS.items():
        path = shared_path(spark, "runtime") + "/runtime.json"
        files.write_text(spark, path, json.dumps(document))
        texts[name] = files.read_text(spark, path)
    scored = runtime.scores(history.annotate(views.trajectory(spark, sf_dir)), texts)
    return scored.select("episode_id", "step", *[F.when(F.col("episode_id").isNull(), 0.0).otherwise(F.round(name, 6)).alias(name) for name in texts])
