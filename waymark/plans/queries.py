"""The library's queries: each takes (spark, sf_dir) and runs an operator over whole driver tables through the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import features, history, integrity, ordered, pairs, progress, ranking, reports, sampling, training
from ..streaming import traces
from ..workflow import cases
from . import views

QUERIES: dict = {}
STATE = ["episode_id", "step_index"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def small_values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- pairs ---------------------------------------------------------------------------------------------------------


@query
def pair_accuracy_by_group(spark, sf_dir):
    """Flagship: pairs of every state, scored by a fixed hash score, accuracy by split and week."""
    scored = pairs.build(views.candidates(spark, sf_dir)).withColumn("correct", F.col("positive_return") > F.col("negative_return"))
    return scored.groupBy("split", "step_index").agg(
        F.count("*").alias("pairs"), F.count_if("correct").alias("correct"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.round(F.sum("weight"), 6).alias("weight")
    )


@query
def pair_build(spark, sf_dir):
    return pairs.build(views.candidates(spark, sf_dir))


@query
def pair_stats(spark, sf_dir):
    return pairs.stats(views.candidates(spark, sf_dir))


@query
def pair_weights(spark, sf_dir):
    return pairs.build(views.candidates(spark, sf_dir)).groupBy(*STATE).agg(F.round(F.sum("weight"), 9).alias("total"), F.count("*").alias("pairs"))


@query
def pair_best_against_worse(spark, sf_dir):
    rows = views.candidates(spark, sf_dir).select(*STATE, "action", F.when(F.col("k") % 11 != 0, F.col("k")).alias("remaining"), (F.col("k") % 13 == 0).alias("idempotent"))
    return pairs.best_against_worse(rows)


@query
def hash_fold_split(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", N.in_fold(F.concat(F.lit("alfworld/train/"), F.col("o_orderkey").cast("string"))).alias("train"))


@query
def mod5_holdout(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", N.holdout_mod5(F.col("o_orderkey").cast("string")).alias("holdout"))


# --- text ----------------------------------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize("text").cast("binary")).alias("normal_md5"))


@query
def word_tokens(spark, sf_dir):
    return views.trajectory(spark, sf_dir).select("event_id", F.array_join(T.word_tokens("action"), " ").alias("words"), F.array_join(T.raw_tokens("observation", True), " ").alias("raw"))


@query
def id_tokens(spark, sf_dir):
    return views.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.id_tokens("text")), " ").alias("tokens"))


@query
def entity_base(spark, sf_dir):
    return views.trajectory(spark, sf_dir).select("event_id", T.entity_base("action").alias("base"), T.drop_last_word("action").alias("dropped"))


@query
def parse_action(spark, sf_dir):
    return views.trajectory(spark, sf_dir).select("event_id", T.parse_action("action", entities=True).alias("p")).select("event_id", "p.*")


def _goals(spark, sf_dir, dialect):
    users = views.trajectory(spark, sf_dir).select("episode_id", "instruction").distinct()
    return users.select("episode_id", T.parse_goal("instruction", dialect).alias("g")).select("episode_id", "g.*")


@query
def parse_goal_strict(spark, sf_dir):
    return _goals(spark, sf_dir, "strict")


@query
def parse_goal_lenient(spark, sf_dir):
    return _goals(spark, sf_dir, "lenient")


@query
def task_family(spark, sf_dir):
    users = views.trajectory(spark, sf_dir).select("episode_id", "instruction").distinct()
    return users.select("episode_id", T.family_budget("instruction").alias("budget_family"), T.family_prompt("instruction").alias("prompt_family"))


@query
def observation_entities(spark, sf_dir):
    t = views.trajectory(spark, sf_dir)
    return t.select("event_id", F.array_join(F.array_sort(T.visible_entities("observation")), ",").alias("entities"), T.arrival_location("observation").alias("place"))


@query
def lexical_overlap(spark, sf_dir):
    """Token overlap of every whole document with the benchmark item that its id falls on."""
    items = ordered.numbered(views.table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], name="r").select("r", T.id_tokens("text").alias("goal"))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", T.id_tokens("text").alias("own"))
    # A fixed evaluation set; the documents carry the volume.
    n, chars = views.table(spark, sf_dir, "benchmark").agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    joined = docs.join(F.broadcast(items) if n <= 10_000 and chars <= 1 << 26 else items, (F.pmod("doc_id", F.lit(n)) + 1) == F.col("r"))
    return joined.select("doc_id", F.round(N.jaccard("own", "goal"), 9).alias("jaccard"), F.round(N.coverage("goal", "own"), 9).alias("coverage"), F.size("own").cast("long").alias("tokens"))


# --- history -------------------------------------------------------------------------------------------------------


def _annotated(spark, sf_dir):
    return history.annotate(views.trajectory(spark, sf_dir))


@query
def history_state(spark, sf_dir):
    return _annotated(spark, sf_dir).select("episode_id", "step", "held_object", "current_location", "lamp_location", "lamp_used", "treatment_done")


@query
def visit_counts(spark, sf_dir):
    return _annotated(spark, sf_dir).select("episode_id", "step", "target_location", "visits", "placed_count", "placed_distinct")


@query
def repetition_flags(spark, sf_dir):
    return _annotated(spark, sf_dir).select("episode_id", "step", "recent_repeat", "inverse_transition", F.round("unique_ratio", 9).alias("unique_ratio"))


@query
def cycle_flags(spark, sf_dir):
    """Cycles of at most six actions, twice in a row, among the event types."""
    w = Window.partitionBy("episode_id").orderBy("step")
    tail = F.collect_list("event_type").over(w.rowsBetween(-11, 0))
    return views.trajectory(spark, sf_dir).select("episode_id", "step", N.has_cycle(tail, 6, 2).alias("cycle"))


@query
def stagnation_runs(spark, sf_dir):
    return history.stagnation_runs(views.trajectory(spark, sf_dir), "event_type")


@query
def progress_predicates(spark, sf_dir):
    return history.predicates(_annotated(spark, sf_dir))


@query
def phase_label(spark, sf_dir):
    return history.with_examined(_annotated(spark, sf_dir)).select("episode_id", "step", history.phase().alias("phase"))


@query
def discounted_return(spark, sf_dir):
    """Discounted gain of the placed fraction and the target's acquisition along each episode, less a step cost."""
    w = Window.partitionBy("episode_id").orderBy("step")
    p = history.predicates(_annotated(spark, sf_dir)).withColumn("v", 0.5 * F.col("placed_fraction") + 0.5 * F.col("target_acquired"))
    after = F.lead("v").over(w)
    gain = F.when(after.isNotNull(), F.greatest(F.lit(0.0), after - F.col("v")) - F.lit(0.01))
    rewards = p.withColumn("r", gain).filter(F.col("r").isNotNull())
    return rewards.groupBy("episode_id").agg(F.round(F.sum(F.pow(F.lit(0.9), F.col("step")) * F.col("r")), 6).alias("value"), F.count("*").alias("steps"))


# --- formula -------------------------------------------------------------------------------------------------------


@query
def contract_scales(spark, sf_dir):
    return small_values(spark, list(progress.scales().items()), "scale string, units double")


@query
def factor_coefficients(spark, sf_dir):
    return progress.coefficient_table(spark).withColumn("coefficient", F.round("coefficient", 9))


@query
def factor_basis(spark, sf_dir):
    return progress.factor_rows(_annotated(spark, sf_dir)).select("episode_id", "step", "factor", "value", F.round("contribution", 6).alias("contribution"))


@query
def factor_groups(spark, sf_dir):
    rows = progress.factor_rows(_annotated(spark, sf_dir))
    return rows.groupBy("factor_group").agg(F.count("*").alias("n"), F.round(F.sum("contribution"), 4).alias("total"))


@query
def factor_ablation(spark, sf_dir):
    """Scores with all groups, and without entity binding and cycle avoidance."""
    full, cut = progress.score_of(), progress.score_of(disabled=("entity_binding", "cycle_avoidance"))
    return progress.prepared(_annotated(spark, sf_dir)).select("episode_id", "step", F.round(full, 6).alias("score"), F.round(cut, 6).alias("without"))


# --- sampling ------------------------------------------------------------------------------------------------------


def _budget(percent):
    def run(spark, sf_dir):
        return sampling.budget(views.strata(spark, sf_dir), percent).select("family", "key")

    run.__name__ = f"budget_states_{percent}"
    return query(run)


budget_states_25, budget_states_50, budget_states_75 = map(_budget, (25, 50, 75))


@query
def budget_nesting(spark, sf_dir):
    """Sizes by family of the three budgets, and how many states of a smaller one the next lacks (none)."""
    ranked = sampling.hash_ranks(views.strata(spark, sf_dir).select("family", "key"))
    inside = {p: sampling.within_budget(p) for p in (25, 50, 75)}
    lost = lambda small, large: F.count_if(inside[small] & ~inside[large]).alias(f"lost{small}")
    return ranked.groupBy("family").agg(*[F.count_if(c).alias(f"n{p}") for p, c in inside.items()], lost(25, 50), lost(50, 75))


@query
def balanced_take(spark, sf_dir):
    return sampling.balanced_take(views.strata(spark, sf_dir).select("family", "key"), "family", "key", 137)


@query
def balanced_limit(spark, sf_dir):
    return sampling.balanced_limit(views.strata(spark, sf_dir).select("family", "key"), "family", "key", 61)


@query
def compact_topk(spark, sf_dir):
    c = views.candidates(spark, sf_dir).select(*STATE, "action", (F.col("event_type") == "signup").alias("is_expert"), (F.col("event_type") != "error").alias("legal"), F.when(F.col("k") % 7 != 0, F.col("k")).alias("remaining"), (F.col("k") % 5).alias("n_errors"))
    return sampling.compact_feedback(c).select(*STATE, "action", "kind", "rank")


@query
def candidate_select(spark, sf_dir):
    rows = views.trajectory(spark, sf_dir).select(F.col("episode_id").alias("state"), "action").distinct()
    return sampling.select_candidates(rows, 8).select("state", "action", "place")


@query
def shortlist(spark, sf_dir):
    rows = views.trajectory(spark, sf_dir).select("episode_id", "step", "action", "value")
    return sampling.shortlist(rows, ["episode_id"], "value", "step", 16)


# --- ranking -------------------------------------------------------------------------------------------------------


def _fused(spark, sf_dir):
    c = views.candidates(spark, sf_dir).select(*STATE, "action", F.col("trace_return").alias("actor"), F.col("k").cast("double").alias("structural"), (F.col("k") % 17).cast("double").alias("residual"))
    return c.select("*", *[v.alias(f"v_{k}") for k, v in ranking.fuse("actor", "structural", "residual", STATE).items()])


@query
def group_standardize(spark, sf_dir):
    c = views.candidates(spark, sf_dir)
    return c.select("event_id", F.round(ranking.standardize("trace_return", STATE), 6).alias("z"))


@query
def signed_max_scale(spark, sf_dir):
    return views.candidates(spark, sf_dir).select("event_id", F.round(ranking.signed_max_scale("trace_return", STATE), 9).alias("scaled"))


@query
def fuse_argmax(spark, sf_dir):
    rows = _fused(spark, sf_dir).withColumn("fused", F.round("v_full", 6))
    return ranking.argmax(rows, STATE, "fused", "action")


@query
def softmax_topk(spark, sf_dir):
    top = ranking.softmax_top(views.candidates(spark, sf_dir), STATE, "trace_return", "action", 3, 10.0)
    return top.select("event_id", "place", F.round("share", 6).alias("share"))


@query
def ranker_score(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("w", views.weight_of("pos"))
    return ranking.linear_score(v, ["vec_id", "label"], "w").select("vec_id", "label", F.round("margin", 6).alias("margin"), F.round("score", 6).alias("score"))


@query
def pair_accuracy_by_source(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("w", views.weight_of("pos"))
    scored = ranking.linear_score(v, ["vec_id", "label"], "w")
    return scored.groupBy("label").agg(F.count("*").alias("pairs"), F.count_if(F.round("margin", 9) > 0).alias("correct"))


@query
def sparse_diff(spark, sf_dir):
    """Differences of event counts by type between the halves of a day, in long form."""
    e = views.runs(spark, sf_dir).select("variant", "task_family", "steps")
    maps = e.groupBy("task_family", "variant").agg(F.sum("steps").cast("double").alias("n"), F.max("steps").cast("double").alias("m"))
    two = maps.groupBy("task_family").pivot("variant", ["reference", "candidate"]).agg(F.first("n").alias("n"), F.first("m").alias("m"))
    side = lambda v: F.create_map(F.lit("sum"), F.coalesce(f"{v}_n", F.lit(0.0)), F.lit("max"), F.coalesce(f"{v}_m", F.lit(0.0)))
    return two.select("task_family", F.explode(N.sparse_difference(side("candidate"), side("reference"))).alias("feature", "value"))


def _pairs_for_training(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    rows = v.groupBy("vec_id", "label").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("f%02d", "pos"), "x"))).alias("features"))
    return rows.select(F.concat(F.lit("label_"), F.pmod("label", F.lit(4)).cast("string")).alias("model"), F.col("vec_id").alias("pair_id"), "features", F.lit(1.0).alias("weight"))


@query
def train_ranker_sgd(spark, sf_dir):
    return training.train(_pairs_for_training(spark, sf_dir), epochs=2).withColumn("weight", F.round("weight", 9))


@query
def train_ranker_adagrad(spark, sf_dir):
    return training.train(_pairs_for_training(spark, sf_dir), epochs=2, rate=0.05, adagrad=True).withColumn("weight", F.round("weight", 9))


# --- reports -------------------------------------------------------------------------------------------------------


@query
def summary_rollup(spark, sf_dir):
    r = reports.completion(views.runs(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ("success_rate", "average_steps", "invalid_rate")})


@query
def paired_delta(spark, sf_dir):
    s = reports.paired_summary(reports.paired(views.runs(spark, sf_dir)), by_family=True)
    return s.withColumns({c: F.round(c, 6) for c in ("success_rate_delta", "mean_step_delta", "mcnemar_p")})


@query
def mcnemar(spark, sf_dir):
    s = reports.paired_summary(reports.paired(views.runs(spark, sf_dir)))
    return s.select("episodes", "recovered", "regressed", "both_success", "both_fail", F.round("mcnemar_p", 6).alias("mcnemar_p"))


@query
def bootstrap_ci(spark, sf_dir):
    """Intervals from 20,000 resamples."""
    b = reports.bootstrap(reports.paired(views.runs(spark, sf_dir)))
    return b.select("samples", *[F.round(c, 6).alias(c) for c in b.columns[1:]])


@query
def margin_quintiles(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("w", views.weight_of("pos"))
    s = ranking.linear_score(v, ["vec_id"], "w").select("vec_id", F.round(F.abs("margin"), 9).alias("m"), (F.round("margin", 9) > 0).alias("ok"))
    q = reports.equal_bins(s, "vec_id", "m", "ok")
    return q.select("bin", "pairs", *[F.round(c, 6).alias(c) for c in q.columns[2:]])


def _contributions(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    group = F.element_at(F.array(*map(F.lit, ("Action schema", "Search/history", "Verified effects", "Other"))), (F.pmod("pos", F.lit(4)) + 1).cast("int"))
    return v.select(F.col("vec_id").alias("row_id"), F.format_string("f%02d", "pos").alias("feature"), group.alias("feature_group"), F.round(F.col("x") * views.weight_of("pos"), 9).alias("contribution"))


@query
def group_contributions(spark, sf_dir):
    g = reports.group_contributions(_contributions(spark, sf_dir), ["Action schema", "Search/history", "Verified effects"])
    return g.select("outcome", "feature_group", F.round("mean_signed", 6).alias("mean_signed"), F.round("mean_absolute", 6).alias("mean_absolute"), "pair_count")


@query
def top_factors(spark, sf_dir):
    rows = _contributions(spark, sf_dir)
    f = reports.factor_means(rows, views.table(spark, sf_dir, "embeddings").count())
    return f.select("feature", F.round("mean_signed", 6).alias("mean_signed"), F.round("mean_absolute", 6).alias("mean_absolute"))


@query
def step_summary(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return reports.step_summary(turns, "turns")


@query
def difficulty_mix(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 4).alias("n"))
    return lines.groupBy(T.difficulty("n").alias("difficulty")).agg(F.count("*").alias("n"))


@query
def release_audit(spark, sf_dir):
    """Lines an order: records, and whether exactly one has the first line number."""
    per = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("firsts"))
    return per.agg(F.count("*").alias("groups"), F.min("n").alias("fewest"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("firsts") != 1).alias("without_first"))


@query
def ledger_topk(spark, sf_dir):
    """The three dearest lines of every part."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return sampling.shortlist(rows, ["l_partkey"], "l_extendedprice", "at", 3).drop("at")


@query
def prior_counts(spark, sf_dir):
    """Max-normalised counts of actions by place."""
    w = Window.partitionBy("place")
    c = views.trajectory(spark, sf_dir).groupBy(T.arrival_location("observation").alias("place"), "event_type").agg(F.count("*").alias("n"))
    return c.select("place", "event_type", "n", F.round(F.col("n") / F.max("n").over(w), 9).alias("prior"))


# --- integrity -----------------------------------------------------------------------------------------------------


@query
def dup_check(spark, sf_dir):
    return integrity.duplicates(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def inventory_diff(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest"), F.col("o_custkey").alias("size"))
    old, new = o.filter(F.col("path") % 7 != 0), o.filter(F.col("path") % 11 != 0).withColumn("size", F.when(F.col("path") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return integrity.inventory_diff(old, new, "path", ["digest", "size"])


@query
def split_overlap(spark, sf_dir):
    e = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("split"))
    return integrity.overlaps(e, "id", "split")


@query
def prefix_check(spark, sf_dir):
    t = views.trajectory(spark, sf_dir).select(F.concat_ws("/", F.col("episode_id").cast("string"), F.col("step").cast("string")).alias("place"), F.col("action").alias("id"))
    done = t.withColumn("id", F.when(F.md5(F.col("place").cast("binary")).startswith("00"), "other").otherwise(F.col("id")))
    return integrity.prefix_errors(done, t)


@query
def resume_pending(spark, sf_dir):
    states = views.candidates(spark, sf_dir)
    return integrity.pending(states.select(*STATE).distinct(), states.filter("success").select(*STATE), STATE)


@query
def latest_rows(spark, sf_dir):
    return integrity.latest(views.events(spark, sf_dir).select("event_id", "user_id", "event_type", "secs"), "user_id", "event_id")


@query
def forbidden_columns(spark, sf_dir):
    rows = integrity.require_absent(views.candidates(spark, sf_dir))
    return integrity.outside(rows.select("event_id", "event_type"), "event_type", ["click", "view", "signup", "purchase"])


@query
def prompt_messages(spark, sf_dir):
    """Each conversation as one prompt, turns in order."""
    c = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").cast("binary")).alias("prompt_md5"), F.size("m").cast("long").alias("turns"))


# --- streams -------------------------------------------------------------------------------------------------------


@query
def stream_dedupe(spark, sf_dir):
    return traces.drain(traces.distinct_observations(traces.events(spark, sf_dir), ["user_id", "event_type"]), "dedupe")


@query
def stream_memory(spark, sf_dir):
    return traces.final_memory(traces.drain(traces.memory(traces.events(spark, sf_dir)), "memory"))


@query
def stream_stops(spark, sf_dir):
    """Stagnation and budget only, as its SQL has it; stream_stops_full stops at goal and cycle too."""
    return traces.drain(traces.episode_stops(traces.events(spark, sf_dir), 4, 50, cycle=False), "stops")


@query
def stream_stops_full(spark, sf_dir):
    return traces.drain(traces.episode_stops(traces.events(spark, sf_dir), 4, 50, goal="purchase"), "stops")


@query
def event_windows(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return traces.windows(rows).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


# --- workflow ------------------------------------------------------------------------------------------------------


@query
def workflow_cases(spark, sf_dir):
    return cases.cases(spark)


@query
def workflow_plan(spark, sf_dir):
    return cases.plans(cases.cases(spark))


@query
def workflow_feedback(spark, sf_dir):
    return cases.feedback(cases.cases(spark))


@query
def workflow_compact_feedback(spark, sf_dir):
    return sampling.compact_feedback(cases.feedback(cases.cases(spark)))


@query
def workflow_pairs(spark, sf_dir):
    return cases.pairs(cases.cases(spark))


@query
def workflow_eval(spark, sf_dir):
    return cases.summarize(cases.closed_loop(cases.cases(spark)))


@query
def workflow_candidate_features(spark, sf_dir):
    """How often each candidate feature occurs, and its mean."""
    long = cases.candidate_features(cases.cases(spark))
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query
def workflow_audit(spark, sf_dir):
    return cases.audit(cases.cases(spark))


# --- features ------------------------------------------------------------------------------------------------------


@query
def effect_features_long(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", F.explode(features.effect_features(t)).alias("feature", "value"))


@query
def lexical_features_long(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", F.explode(features.lexical_features()).alias("feature", "value")).withColumn("value", F.round("value", 9))


@query
def semantic_features_long(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", F.explode(features.semantic_features()).alias("feature", "value"))


@query
def state_features_long(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", F.explode(features.state_features()).alias("feature", "value")).withColumn("value", F.round("value", 9))


@query
def search_features_long(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", F.explode(features.search_features()).alias("feature", "value")).withColumn("value", F.round("value", 9))


@query
def goal_flags(spark, sf_dir):
    t = features.transition(features.entity_state(views.trajectory(spark, sf_dir)))
    return t.select("episode_id", "step", *[F.col(f"before.{f}").alias(f) for f in features.FLAGS])


@query
def feature_display(spark, sf_dir):
    names = features.featurise(views.trajectory(spark, sf_dir)).select(F.explode(F.map_keys("features")).alias("feature")).distinct()
    return names.select("feature", T.display_name("feature").alias("display"))


@query
def feature_vocabulary(spark, sf_dir):
    long = features.featurise(views.trajectory(spark, sf_dir)).select(F.explode("features").alias("feature", "value"))
    counts = long.groupBy("feature").agg(F.count("*").alias("n"))
    return counts.select("feature", T.feature_group("feature").alias("feature_group"), "n")


@query
def hashed_features(spark, sf_dir):
    return features.hashed(features.featurise(views.trajectory(spark, sf_dir)), [], 1024).withColumn("value", F.round("value", 6))


@query
def router_context(spark, sf_dir):
    return features.router_context(history.with_examined(_annotated(spark, sf_dir)))


@query
def tool_prior(spark, sf_dir):
    return features.tool_prior(_annotated(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query
def action_similarity(spark, sf_dir):
    """Every action against the one before it in its episode."""
    w = Window.partitionBy("episode_id").orderBy("step")
    t = views.trajectory(spark, sf_dir).withColumn("was", F.lag("action").over(w)).filter(F.col("was").isNotNull())
    return t.select("episode_id", "step", F.round(features.similarity()("was", "action"), 9).alias("similarity"))


# --- further reports -----------------------------------------------------------------------------------------------


@query
def exact_match(spark, sf_dir):
    """Labels as matches, by source and language of their documents."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = views.table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("quality") == 1).alias("exact_match"), (F.col("n_chars") / 1000).alias("latency_sec"), "lang", "source")
    return reports.exact_match(rows, ["lang", "source"]).withColumn("mean_latency", F.round("mean_latency", 6))


@query
def collection_report(spark, sf_dir):
    return reports.collection(views.candidates(spark, sf_dir).withColumn("cycle_detected", F.col("k") % 5 == 0))


@query
def vocabulary_coverage(spark, sf_dir):
    """Parts by return flag of their lines, against those of flag A."""
    return reports.coverage(views.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "A")


@query
def routed_scores(spark, sf_dir):
    """Two value models under a softmax router and a top-1 router, and an ensemble."""
    c = views.candidates(spark, sf_dir).withColumns({"a": F.col("trace_return") / 100, "b": F.col("k").cast("double") / 100})
    soft = ranking.mixture([F.col("a"), F.col("b")], [F.col("b"), F.col("a")])
    hard = ranking.mixture([F.col("a"), F.col("b")], [F.col("b"), F.col("a")], top_k=1)
    both = ranking.ensemble({"a": F.col("a"), "b": F.col("b")}, {"a": 0.25, "b": 0.75})
    return c.select("event_id", *[F.round(x, 6).alias(n) for n, x in (("soft", soft), ("hard", hard), ("both", both))])
