"""Token ids in Arrow IPC files of equal-length sequences.

A file holds one partition's ids, end to end in ascending doc_id order, as record batches of ``BATCH_ROWS`` rows with two
fixed-size-list columns: ``tokens`` (uint16, or uint32 for larger vocabularies) and ``mask`` (false on the padding behind a
file's last id). Every batch but the last has the same rows, so sequence k of a file is row k % BATCH_ROWS of batch k // BATCH_ROWS:
a memory-mapped read of any sequence copies nothing. Beside it lies a second Arrow file with (doc_id, start, n_tokens).

Files are named by partition and a random part. A manifest table written by Spark's committer names the files of the attempts
that counted; what a lost executor left is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, qualified, shared_path, small_batches

SEQUENCE = 1024
BATCH_ROWS = 64
#: Entries of the cache from a blank-free piece of text to its ids, per Python worker; it is emptied beyond.
CACHE_ENTRIES = 1_000_000
#: Characters of text that are encoded together.
GROUP_CHARS = 1 << 20
INDEX_ROWS = 65_536
#: Documents that a file has, about, where the session's shuffle partitions are fewer than that takes.
FILE_DOCS = 200_000

_encoders: dict[tuple[str, int], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts piece by piece, a piece being a run of anything but ASCII white space.

    This holds for tokenizers that lower case, drop white space and never look across it, as the word BPE does: its normalizer acts
    on single characters or runs without white space, and its pre-tokenizer's matches hold no white space. Two things make pieces repeat
    more: ASCII letters are lower-cased first, and a full stop or comma behind an ASCII letter or digit becomes a piece of its own, as
    the pre-tokenizer parts them too. Both are left out for texts with characters from U+0300 on, where combining marks begin, or
    with ``<|``, which may begin a special token.
    """

    ODD = bytes(range(0xCC, 0x100))
    #: Between texts that are prepared together; no byte of UTF-8.
    BREAK = b"\xff"

    def __init__(self, path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}
        #: Whether an id ends a word; empty if the vocabulary doesn't tell.
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.parted = np.zeros(256, dtype=bool)
        self.parted[[*range(48, 58), *range(97, 123)]] = True

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        odd = [b"<|" in r or len(r.translate(None, self.ODD)) != len(r) for r in raws]
        plain = np.frombuffer(self.BREAK.join(r.lower() for r, o in zip(raws, odd, strict=True) if not o), dtype=np.uint8)
        stops = np.flatnonzero(((plain[1:] == 46) | (plain[1:] == 44)) & self.parted[plain[:-1]]) + 1
        split = iter(np.insert(plain, stops, 32).tobytes().split(self.BREAK))
        return [r.split() if o else next(split).split() for r, o in zip(raws, odd, strict=True)]

    def learn(self, new: list[bytes]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # Pieces of letters alone are a word each; many are encoded as one text and parted where words end.
        words = [p for p in new if p.isalpha() or p.decode("utf-8", "replace").isalpha()]
        if words:
            ids = np.array(encode([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                raw, w = ids.tobytes(), self.dtype.itemsize
                cuts = (ends * w).tolist()
                self.known.update(zip(words, (raw[a:b] for a, b in zip([0, *cuts], cuts)), strict=True))
        rest = [p for p in new if p not in self.known]
        for piece, got in zip(rest, encode([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False), strict=True):
            self.known[piece] = np.array(got.ids, dtype=self.dtype).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, its end id last, as little-endian bytes of self.dtype."""
        pieces = self.pieces(texts)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = set(chain.from_iterable(pieces)).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, own)) + self.end for own in pieces]


def encoder(path: str, end_id: int) -> PieceEncoder:
    """One for each Python worker, so that its cache serves all tasks there."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI as executors see it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    if "://" not in uri:
        raise ValueError(f"a path without a scheme: {uri}")
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences and batches of an Arrow file, holding a batch at most."""

    def __init__(self, sink, dtype: np.dtype, length: int = SEQUENCE, rows: int = BATCH_ROWS):
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.kind, self.dtype, self.length, self.size = ipc.new_file(sink, self.schema), kind, dtype, length, length * rows
        self.held, self.count = bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        whole = self.size * self.dtype.itemsize
        if len(self.held) >= whole:
            done = len(self.held) // whole * whole
            for at in range(0, done, whole):
                self.write(bytes(self.held[at : at + whole]))
            del self.held[:done]
        self.count += len(ids) // self.dtype.itemsize

    def write(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype=self.dtype)
        padded = -len(ids) % self.length
        mask = np.ones(len(ids) + padded, dtype=bool)
        mask[len(ids) :] = False
        ids = np.concatenate([ids, np.zeros(padded, dtype=self.dtype)]) if padded else ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.length) for x, t in ((ids, self.kind), (mask, pa.bool_()))]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.write(bytes(self.held))
        self.out.close()


class SequenceReader:
    """Random access to the ids of a file, batch by batch, through views of the mapped file where it is local."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))
        self.at, self.now = -1, np.empty(0)
        self.batches = self.file.num_record_batches
        self.size = self.file.get_batch(0).num_rows * self.file.schema.field("tokens").type.list_size if self.batches else 1

    def batch(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.now = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.now

    def ids(self, start: int, count: int) -> np.ndarray:
        parts, end = [], start + count
        while start < end:
            k, low = divmod(start, self.size)
            part = self.batch(k)[low : low + end - start]
            parts.append(part)
            start += len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, dtype="<u2")


def writing(folder: str, path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (doc_id, tie, text), sorted: writes a partition's two files and yields their manifest row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        fs, base = filesystem(folder)
        name = f"{base}/{uuid.uuid4().hex}"
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        first, writer, index, docs = None, None, None, 0
        rows: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                fs.create_dir(base, recursive=True)
                sinks = [fs.open_output_stream(f"{name}.{kind}.arrow") for kind in ("ids", "docs")]
                writer, index = SequenceWriter(sinks[0], encode.dtype), ipc.new_file(sinks[1], index_schema)
            for ids, texts in groups(batch):
                for doc, got in zip(ids, encode(texts), strict=True):
                    rows.append((doc, writer.count, len(got) // encode.dtype.itemsize))
                    writer.add(got)
                docs += len(ids)
                if len(rows) >= INDEX_ROWS:
                    index.write_batch(index_batch(rows, index_schema))
                    rows = []
        if writer is None:
            return
        if rows:
            index.write_batch(index_batch(rows, index_schema))
        writer.close()
        index.close()
        for sink in sinks:
            sink.close()
        columns = [[first[0]], [first[1]], [name], [docs], [writer.count]]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["first_id", "first_tie", "name", "docs", "tokens"])

    return write


def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch's documents in runs of about GROUP_CHARS characters, so that few long ones don't fill the memory."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0), batch.column(2), strict=True):
        text = text.as_py() or ""
        ids.append(doc.as_py())
        texts.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def index_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes every document's ids and returns the manifest: (name, docs, tokens, base), a row for each file.

    Needs doc_id (long) and text; null texts count as empty (the end id alone), a null doc_id comes first, and rows that share a doc_id
    follow by the text's hash. base is the number of ids in all files before. The manifest has a row for each
    partition, so the driver may hold it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or shared_path(spark, "tokens"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ordered = rows.repartitionByRange(partitions(spark, docs.count(), FILE_DOCS), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.mapInArrow(writing(f"{folder}/files", tokenizer, end_id), "first_id long, first_tie long, name string, docs long, tokens long").write.parquet(f"{folder}/manifest")
    found = spark.read.parquet(f"{folder}/manifest").orderBy(F.col("first_id").asc_nulls_first(), "first_tie").collect()
    base, out = 0, []
    for r in found:
        out.append((r["name"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    return spark.createDataFrame(out, "name string, docs long, tokens long, base long").withColumn("folder", F.lit(f"{folder}/files"))


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (folder, name, base): a row for each document of the files."""
    for batch in batches:
        for folder, name, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, _ = filesystem(folder)
            tokens = SequenceReader(fs, f"{name}.ids.arrow")
            index = ipc.open_file(fs.open_input_file(f"{name}.docs.arrow"))
            for k in range(index.num_record_batches):
                part = index.get_batch(k)
                starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                sums = [zlib.crc32(tokens.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                yield pa.record_batch(
                    [part.column(0), pa.array(starts + base), part.column(2), pa.array(sums, type=pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, computed from the files."""
    spread = manifest.select("folder", "name", "base").repartition(partitions(manifest.sparkSession, manifest.count()), "name")
    return spread.mapInArrow(reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequences(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(name, sequence, tokens, mask): the equal-length sequences as a trainer sees them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = filesystem(folder)
                file = ipc.open_file(fs.open_input_file(f"{name}.ids.arrow"))
                at = 0
                for k in range(file.num_record_batches):
                    part = file.get_batch(k)
                    n = part.num_rows
                    yield pa.record_batch(
                        [pa.array([name] * n), pa.array(range(at, at + n), type=pa.int64()), part.column(0).cast(pa.list_(pa.int32())), part.column(1).cast(pa.list_(pa.bool_()))],
                        names=["name", "sequence", "tokens", "mask"],
                    )
                    at += n

    return manifest.select("folder", "name").mapInArrow(read, "name string, sequence long, tokens array<int>, mask array<boolean>")
