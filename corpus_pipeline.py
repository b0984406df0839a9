"""The corpus pipeline: five operators in a row, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import functools
import threading
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import jaccard, language, mixing, packing, toxicity
from waymark.llm.common import delete, made, materialise, scratch, table


#: Intermediate tables of the stage that ran last, by application and thread.
_left: dict[tuple[str, int], list[str]] = {}


def stage(f: Callable) -> Callable:
    """A stage that first deletes what the stage before left in the shared folder: its result is written and read again by now. What docs still reads stays."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, threading.get_ident())
        left = [p for p in _left.pop(key, []) if p in made()]
        if left:
            read = docs.inputFiles()
            for path in left:
                if not any(path.split("/")[-1] in file for file in read):
                    delete(spark, path)
        before = set(made())
        out = f(spark, docs, sf_dir)
        _left[key] = [p for p in made() if p not in before]
        return out

    return run


def wrapped(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns, and all columns in one struct ``_row``, which no column that an operator adds can clash with."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *columns)


#: Names of rejected documents up to which they are broadcast (two numbers each); beyond, documents and names meet in a shuffle by name.
BROADCAST_NAMES = 250_000


def decided_by() -> list[Column]:
    """What language ID decides by, as two hashes: documents equal in text, declared language and source share the decision."""
    parts = [x for c in ("text", "lang", "source") for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("_name_a"), F.xxhash64(F.lit(1), *parts).alias("_name_b")]


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that language ID rejects (unknown, or no text) go.

    Texts are neither written nor shuffled: the operator gets names, and documents are held against the names of those that it rejects.
    """
    names = ["_name_a", "_name_b"]
    judged = language.identify(docs.select("doc_id", "text", "lang", "source", *decided_by()), keep=names)
    rejected = materialise(judged.filter(~F.col("kept")).select(*names).distinct(), "rejected")
    few = rejected.count() <= BROADCAST_NAMES
    own = wrapped(docs, *decided_by())
    return own.join(F.broadcast(rejected) if few else rejected, names, "left_anti").select("_row.*")


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the others go."""
    return toxicity.score(wrapped(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).filter("predicted = 0").select("_row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked or equal texts: the class's first text under its smallest doc_id; of rows that repeat both, the smallest."""
    leads = jaccard.join(docs).filter("lead").select(jaccard.name_of("doc_id", F.col("key")).alias("_name"), F.col("key").alias("_key")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("_row"), jaccard.name_of().alias("_name"), jaccard.text_key().alias("_key"))
    kept = own.join(leads.hint("shuffle_hash"), ["_name", "_key"], "left_semi")
    return kept.groupBy("_name", "_key").agg(F.min("_row").alias("_row")).select("_row.*")


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row for each copy of a document that the mix takes, in the order of training. Written, its files lie in that order."""
    return mixing.curriculum(docs, numbered=False)


def reading_order(docs: DataFrame) -> Column | None:
    """Shards of at most SHARD_ROWS rows that follow each other in docs' files, numbered along them; None, with a warning, if docs doesn't come straight from files, as a stage's docs do."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        warnings.warn("documents that aren't read from files have no training order: bins are dealt by a hash", stacklevel=2)
        return None
    number = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    return number * (1 << 20) + F.floor(F.col("_metadata.row_index") / packing.SHARD_ROWS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every document. Documents near each other in training share bins, which are numbered along the training order."""
    return packing.pack(docs, shard=reading_order(docs))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Language ID and toxicity are learned models, which SQL can't express; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
            kept.append(docs.written_to)
        if last:
            delete(spark, last)
        last = docs.written_to
    return STAGES[-1][1](spark, docs, sf_dir)
