"""Dropping lines that many documents share; DataFrame functions only.

1. Texts are read once: every line becomes two 64-bit hashes of its key, written to the shared folder with a number for the document's row.
2. Hashes are dealt out by range of (hash, chunk of documents) and sorted by hash, document and position. A window streams over them: a line is a first occurrence where
   the document changes, and each (hash, chunk) gives one row: how many documents, and the first line. Chunks hold at most 2^CHUNK_BITS documents, so a line that every
   document has is the work of many tasks; their rows add up to the whole count.
3. Hashes of enough documents meet the lines again, chunk by chunk. What leaves is not text but a keep bitmap for each document, compressed to the runs of lines that
   stay, as (start, length). ``apply`` cuts texts by it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What is stripped from both ends of a line before its key is taken.
BLANK = " \t\n\x0b\x0c\r"
MIN_DOCS, LEAST_CHARS = 10, 1
#: A chunk has at most two to the power of so many documents.
CHUNK_BITS = 16


def lines_of(text: str = "text") -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """A stripped line with A-Z in lower case; other letters stay as they are."""
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, string.ascii_uppercase, string.ascii_lowercase))


def text_name(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def numbered(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row, doc_id, name, n_lines, keys), written once: a number for the row, the text's digest, and two hashes for each line, null where the key is too short."""
    stripped = F.transform(lines_of(), lambda x: F.btrim(x, F.lit(BLANK)))
    hashed = lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g")))
    keys = F.transform(F.transform(stripped, key_of), hashed)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_name().alias("name"), keys.alias("keys"))
    return materialise(rows.withColumn("n_lines", F.size("keys").cast("long")), "lines")


def postings(rows: DataFrame) -> DataFrame:
    """(h, g, row, pos): a row for each line that has a key."""
    return rows.select("row", F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull()).select("key.h", "key.g", "row", "pos")


def chunk() -> Column:
    return F.shiftright("row", CHUNK_BITS).alias("chunk")


def streamed(posted: DataFrame) -> DataFrame:
    """(h, g, chunk, docs, first): for each chunk of documents that has a line, how many documents have it in all, and its first (row, pos), in the order of rows. Postings are exchanged once, by range."""
    group = ["h", "g", "chunk"]
    ranged = posted.select("*", chunk()).repartitionByRange(*group).sortWithinPartitions(*group, "row", "pos")
    before = F.lag("row").over(Window.partitionBy(*group).orderBy("row", "pos"))
    found = ranged.withColumn("opens", (before.isNull() | (before != F.col("row"))).cast("long"))
    each = found.groupBy(*group).agg(F.sum("opens").alias("docs"), F.min(F.struct("row", "pos")).alias("first"))
    line = Window.partitionBy("h", "g")  # a row a chunk
    return each.select(*group, F.sum("docs").over(line).alias("docs"), F.min("first").over(line).alias("first"))


def find(docs: DataFrame, min_docs: int = MIN_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, name, n_lines, n_dropped, keep), a row for each row of docs.

    A line goes if its key (the line without white space at its ends, A-Z in lower case) has at least least_chars code points and is found in at least min_docs documents. With
    keep_first its first occurrence, in the order in which rows were read, stays. keep holds the runs of lines that stay as (start, length), lines counted from 0; name is the
    text's digest. Null and empty texts are one empty line. A document is a row: rows that repeat an id, or are equal altogether, are documents of their own; a line that
    a document repeats counts once. Ids may be null. No rows give no rows; other columns are not read.
    """
    rows = numbered(docs, least_chars)
    posted = postings(rows)
    common = streamed(posted).filter(F.col("docs") >= min_docs)
    gone = posted.select("*", chunk()).join(common, ["h", "g", "chunk"])
    if keep_first:
        gone = gone.filter(F.struct("row", "pos") != F.col("first"))
    dropped = gone.groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))
    joined = rows.select("row", "doc_id", "name", "n_lines").join(dropped, "row", "left")
    own = F.coalesce("dropped", F.array().cast("array<int>"))
    ends = joined.withColumns({"n_dropped": F.size(own).cast("long"), "_ends": F.concat(F.array(F.lit(-1)), own, F.array(F.col("n_lines").cast("int")))})
    runs = F.transform("_ends", lambda x, i: F.struct((x + 1).alias("start"), (F.get("_ends", i + 1) - x - 1).alias("length")))
    return ends.select("doc_id", "name", "n_lines", "n_dropped", F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def kept_text(keep: str = "keep", text: str = "text") -> Column:
    """The lines of a text that its bitmap keeps, joined."""
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines_of(text), r["start"] + 1, r["length"]))), "\n")


def apply(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (which replace columns of these names), a row for each row of docs, from what ``find`` said of the same rows.

    A bitmap finds its text by id and digest. Rows equal in both are cut alike: by the bitmap that keeps most, the first one's where first occurrences stay.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    names = [c for c in docs.columns if c not in added]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_name().alias("_name"), F.col("text").alias("_text"))
    cuts = found.groupBy("doc_id", "name").agg(F.min(F.struct("n_dropped", "n_lines", "keep")).alias("_cut"))
    both = own.join(cuts, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_name") == F.col("name"))).select("_row", "_text", "_cut.*")
    return both.select("_row.*", "n_lines", "n_dropped", kept_text("keep", "_text").alias("kept_text"))
