"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents go by decreasing size. Bins lie by residual; a bin carries bitmaps of the sources and of the duplicate clusters it
holds. For a document the search starts at the bins whose residual equals its size and goes on to the successor residuals until a compatible bin is found: the tightest
one. Without any, a new bin opens. Every document is placed.

A document larger than a bin fills whole bins of its own; its rest is packed. Packing runs in shards of about SHARD_ROWS documents, by a hash of
the document or by any bounded ranges that the caller names; rows that repeat a document are counted first and dealt out one by one. So no source, document or group of copies
gathers in a task; a copy in another shard can't meet its twin in a bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, word_count

CAPACITY = 2048
#: Documents of one source that a bin may hold (bit planes of the source bitmap), and documents of a shard.
MAX_PER_SOURCE = 8
SHARD_ROWS = 4096
#: Copies of a row that one task makes of its count, and bits of a bin's number within its shard.
COPIES, BIN_BITS = 1 << 16, 20


@dataclass
class Bins:
    """Open bins by residual. A residual's bins are kept in the order in which they got it."""

    capacity: int
    max_per_source: int
    residual: list[int] = field(default_factory=list)
    planes: list[list[int]] = field(default_factory=list)  # bitmap k: sources that the bin holds more than k times
    clusters: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.at: dict[int, dict[int, None]] = {}
        self.filled = 0  # bit r: some open bin has residual r

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.planes[b][-1] & source or self.clusters[b] & cluster)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset). source and cluster are single bits; a cluster of 0 conflicts with nothing."""
        above = self.filled >> size
        low = size
        while above:
            step = (above & -above).bit_length() - 1
            low += step
            for b in self.at[low]:
                if self.compatible(b, source, cluster):
                    return b, self.put(b, size, source, cluster)
            above >>= step + 1
            low += 1
        self.residual.append(self.capacity)
        self.planes.append([0] * self.max_per_source)
        self.clusters.append(0)
        b = len(self.residual) - 1
        self.link(b, self.capacity)
        return b, self.put(b, size, source, cluster)

    def link(self, b: int, r: int) -> None:
        self.at.setdefault(r, {})[b] = None
        self.filled |= 1 << r

    def put(self, b: int, size: int, source: int, cluster: int) -> int:
        r = self.residual[b]
        own = self.at[r]
        del own[b]
        if not own:
            self.filled &= ~(1 << r)
        if r > size:
            self.link(b, r - size)
        self.residual[b] = r - size
        for k, plane in enumerate(self.planes[b]):
            if not plane & source:
                self.planes[b][k] |= source
                break
        self.clusters[b] |= cluster
        return self.capacity - r


def bits(values: np.ndarray, least: int, known: np.ndarray | None = None) -> list[int]:
    """A bit for each value that occurs ``least`` times; 0 for the others, and for those that aren't known."""
    known = np.ones(len(values), dtype=bool) if known is None else known
    kinds, inverse = np.unique(values, return_inverse=True)
    counts = np.bincount(inverse[known], minlength=len(kinds))
    number = np.cumsum(counts >= least) - 1
    return [1 << int(number[k]) if some and counts[k] >= least else 0 for k, some in zip(inverse, known, strict=True)]


def pack_shard(
    sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, max_per_source: int, clustered: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, residual of the bin in the end) of each item; sizes are 1..capacity, in the order of packing. clustered: whether an item has a cluster."""
    bins = Bins(capacity, max_per_source)
    placed = [bins.place(int(s), a, c) for s, a, c in zip(sizes, bits(sources, 1), bits(clusters, 2, clustered), strict=True)]
    where = np.array([b for b, _ in placed], dtype=np.int64)
    return where, np.array([o for _, o in placed], dtype=np.int64), np.array(bins.residual, dtype=np.int64)[where] if placed else where


def packing(capacity: int, max_per_source: int):
    """For mapInArrow over (shard, tail, cluster, source_key, *kept), sorted by shard and packing order."""

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = lambda name: t.column(name).to_numpy()
        n = int((column("tail") > 0).sum())  # those without a tail come last
        clusters, clustered = t.column("cluster").fill_null(0).to_numpy()[:n], t.column("cluster").is_valid().to_numpy()[:n]
        where, offset, free = pack_shard(column("tail")[:n], column("source_key")[:n], clusters, capacity, max_per_source, clustered)
        shard, none = int(t.column("shard")[0].as_py()), pa.nulls(t.num_rows - n, pa.int64())
        out = t.drop_columns(["shard", "cluster", "source_key"])
        for name, values in (("bin", (shard << BIN_BITS) + where), ("bin_offset", offset), ("bin_free", free)):
            out = out.append_column(name, pa.chunked_array([pa.array(values, type=pa.int64()), none]))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column(0).to_numpy()
            cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if key is not None and shards[a] != key:
                    yield finish(held)
                    held = []
                key = shards[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield finish(held)

    return run


def fingerprint(text: str = "text") -> Column:
    """The default duplicate cluster: documents of one text, letter case aside."""
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, cluster: Column | None = None, shard_rows: int = SHARD_ROWS, shard: Column | None = None) -> DataFrame:
    """(doc_id, source, size, full_bins, tail, bin, bin_offset, bin_free), a row for each row of docs.

    size counts words. A document fills full_bins = size div capacity bins alone; its tail of size mod capacity words lies in ``bin`` from bin_offset;
    bin_free is what the bin has left. A tail of 0 (null, empty and blank texts too) needs no bin (bin null). cluster: any long column of duplicate
    clusters, a null conflicting with nothing; by default equal texts. shard: any column of numbers from 0 that deals rows to shards of bounded size; by default a hash of the document and the
    number of its copy. Ids and sources may be null (a null source is a source of its own); ties go by cluster and id, repeated rows are copies in bins of their own. No rows
    give no rows. Only ids and sizes are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        (fingerprint() if cluster is None else cluster.cast("long")).alias("cluster"), *([] if shard is None else [shard.cast("long").alias("shard")]),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    if shard is None:
        own = ["doc_id", "source", "size", "cluster"]
        counted = rows.groupBy(*own).agg(F.count("*").alias("n"))
        # Copies are numbered in pieces, so that making them of their count is the work of many tasks.
        pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES)))).repartition(partitions(spark), *own, "piece")
        first = F.col("piece") * COPIES
        numbered = pieces.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
        rows = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("long"))
    sized = rows.select(
        "shard", (F.col("size") % capacity).alias("tail"), "cluster", F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("source_key"), "doc_id", "source", "size",
        F.floor(F.col("size") / capacity).cast("long").alias("full_bins"),
    )
    ordered = sized.repartition(max(1, min(shards, 20 * partitions(spark))), "shard").sortWithinPartitions("shard", F.desc("tail"), "cluster", "doc_id", "source_key")
    kinds = "tail long, doc_id long, source string, size long, full_bins long, bin long, bin_offset long, bin_free long"
    return ordered.mapInArrow(packing(capacity, max_per_source), kinds).select("doc_id", "source", "size", "full_bins", "tail", "bin", "bin_offset", "bin_free")
