"""N-gram Jaccard join with Bayesian candidate pruning.

1. Documents of one text (letter case aside) share a node, numbered when the table of texts is written; the ids of documents play no part before the end.
2. Every text gets SLOTS MinHash values of its five-word shingles. Texts that agree in all ROWS_PER_BAND values of a band share a bucket; buckets with the
   same members count once. A pair at the threshold misses all bands with probability (1 - 0.8^4)^32 < 1e-7.
3. Within buckets, pairs that met in no earlier band compare their MinHash values STEP at a time. With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1); a pair
   goes as soon as the posterior probability of reaching the threshold falls below TOLERANCE. What is left joins texts to candidate groups.
4. Within candidate groups, all pairs are verified exactly on their shingle sets. A text is read and shipped once, to its block, where it becomes the difference of its set from the block's common shingles (those that
   more than half of the block's texts have); blocks meet as differences. The links are counted for each text and the linked texts' components are the classes.

Buckets and groups of any size are cut into blocks by a hash; a task holds two blocks. Pairs live inside a task only, what leaves it is a
count and a star edge for each text. A group of n texts in blocks of b sends each signature, and each difference (a few hashes for a near copy), to n / b tasks.

Words are runs of letters, digits and marks, lower case. Characters of scripts that put no blanks between words are words of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, small_batches
from .components import connected

SHINGLE_WORDS = 5
THRESHOLD = "0.8"
SLOTS, ROWS_PER_BAND, STEP = 128, 4, 16
TOLERANCE = 1e-7
#: Texts of a block when MinHash values, or whole shingle sets, are compared; characters that a block of whole texts has on average at most.
PRUNE_BLOCK, VERIFY_BLOCK, VERIFY_CHARS = 512, 384, 1 << 22
#: Candidate texts up to which their names (about a hundred bytes each) are broadcast to the documents; beyond, a shuffled join brings the texts.
BROADCAST_TEXTS = 250_000
PAIRS_AT_ONCE = 1 << 16
BYTES_AT_ONCE = 1 << 18
COLUMNS_AT_ONCE = 2048
HASHES_AT_ONCE = 1 << 19
#: Stands for a block itself among its texts, whose numbers are 0 and more.
HEAD = -1
SEED = 20_240_229

_rng = np.random.default_rng(SEED)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MULTIPLIERS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
PLACES = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: ASCII bytes but letters and digits part words; so do, once ``plain`` has blanked them, punctuation and symbols beyond ASCII.
BLANK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Blocks of punctuation and symbols, and of scripts without blanks between words (Thai, Lao, Burmese, Khmer, kana, Han).
SYMBOLS = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u2bff\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u3030\ufe10-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\ufffd]+")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles in a row, number of each text's). Texts are lower case.

    A word's hash is the sum of byte values times powers of BASE from the word's beginning, mixed; a shingle's is that of its words'
    hashes by place, mixed. A text of fewer words than a shingle has one, of all its words; one without words has none.
    """
    counts = np.zeros(len(texts), dtype=np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    begins = np.flatnonzero(~blank & before)
    if not len(begins):
        return np.empty(0, dtype=np.uint64), counts
    ends = np.flatnonzero(blank & ~before)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[raw] * powers(BASE, len(raw)), dtype=np.uint64)])
    words = mixed((sums[ends] - sums[begins]) * powers(INVERSE, len(raw))[begins] + (ends - begins).astype(np.uint64))
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    owner = np.searchsorted(text_ends, begins, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, dtype=np.uint64)])
    last = np.cumsum(n_words)  # end of each text's words
    first = last - n_words
    total = np.zeros(len(words), dtype=np.uint64)
    room = last[owner] - np.arange(len(words))  # words from here to the text's end
    for k in range(SHINGLE_WORDS):
        total += np.where(room > k, mixed(padded[k : k + len(words)] + PLACES[k]) * PLACES[k], np.uint64(0))
    full = room >= SHINGLE_WORDS
    short = (n_words > 0) & (n_words < SHINGLE_WORDS)
    full[first[short]] = True
    np.add.at(counts, owner[full], 1)
    return mixed(total[full]), counts


def signatures(texts: list[bytes]) -> list[bytes | None]:
    """16 bits of each MinHash value as little-endian bytes; None for texts without words."""
    hashes, counts = shingles(texts)
    some = np.flatnonzero(counts)
    if not len(some):
        return [None] * len(texts)
    starts = (np.cumsum(counts) - counts)[some]
    least = np.full((len(some), SLOTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    chunk = 1 << 14
    for a in range(0, len(hashes), chunk):  # pieces that stay in the cache
        part = hashes[a : a + chunk]
        lo, hi = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, a + len(part), side="left")
        cuts = np.maximum(starts[lo:hi] - a, 0)
        own = least[lo:hi]
        for k in range(SLOTS):
            np.minimum(own[:, k], np.minimum.reduceat(part * MULTIPLIERS[k] + ADDENDS[k], cuts), out=own[:, k])
    found = iter((mixed(least) >> np.uint64(48)).astype("<u2"))
    return [next(found).tobytes() if c else None for c in counts]


def plain(text: str | None) -> bytes:
    """Lower case, with words beyond ASCII between blanks."""
    low = (text or "").lower()
    if not low.isascii():
        low = UNSPACED.sub(r" \g<0> ", SYMBOLS.sub(" ", low))
    return low.encode("utf-8", "surrogatepass")


def in_blocks(texts: list[str | None], work: Callable[[list[bytes]], list]) -> list:
    """work over runs of about BYTES_AT_ONCE, so that memory follows that and the longest text."""
    out: list = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(plain(t))
        size += len(held[-1])
        if size >= BYTES_AT_ONCE:
            out += work(held)
            held, size = [], 0
    return out + (work(held) if held else [])


def least_matches(threshold: float, slots: int = SLOTS, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m of n matches goes. The posterior P(J >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, slots + 1, step):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance or m > n:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(values: np.ndarray, i: np.ndarray, j: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs (i, j) that no step drops."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int32)
    done = 0
    for n, m in table:
        matches += (values[i[alive], done:n] == values[j[alive], done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def first_met(earlier: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no bucket of an earlier band, where they were compared already. earlier: each text's values of those bands, a number a band."""
    i, j = pairs
    for b in range(earlier.shape[1]):
        new = earlier[i, b] != earlier[j, b]
        i, j = i[new], j[new]
    return i, j


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that it is linked with through the pairs."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, was, label.copy())  # a label that moved takes its followers along
        label = label[label]
        if (label == was).all():
            break
    return label


def blocked_pairs(side: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's rows: all of one block, or those across two. side: the row's block, 0 or 1."""
    a, b = (np.arange(len(side)), None) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if within:
        rows = max(1, PAIRS_AT_ONCE // max(1, len(a)))
        for at in range(0, len(a), rows):
            i, j = np.meshgrid(a[at : at + rows], a, indexing="ij")
            keep = i < j
            yield i[keep], j[keep]
    elif len(a) and len(b):
        rows = max(1, PAIRS_AT_ONCE // len(b))
        for at in range(0, len(a), rows):
            i, j = np.meshgrid(a[at : at + rows], b, indexing="ij")
            yield i.reshape(-1), j.reshape(-1)


def blocks_of(share: Column) -> Column:
    return F.greatest(F.ceil(share), F.lit(1)).cast("int")


def block_of(share: Column) -> Column:
    """The block, of those that a row's group fills, that the row lies in."""
    return F.pmod(F.xxhash64("node", F.lit(17)), blocks_of(share)).cast("int")


def dealt(rows: DataFrame, key: str, share: Column, columns: list[str], own: Column | None = None) -> DataFrame:
    """Cuts groups into blocks and deals out pairs of blocks: (key, lo, hi, side, *columns), sorted by group within partitions.

    share: how many blocks a row's group fills; they are rounded up, and each row goes once to every pair of blocks with its own, which is ``own`` or else a hash's.
    """
    spark = rows.sparkSession
    blocks = blocks_of(share)
    own = block_of(share) if own is None else own
    return (
        rows.select(F.col(key).alias("key"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), "node", *columns)
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", *columns)
        .repartition(partitions(spark), "key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Sorted rows of ``dealt`` as (whether the group is one block, its rows)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(i).to_numpy() for i in range(3)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in k:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(int(c[a]) for c in k)
            if key is not None and now != key:
                yield key[1] == key[2], pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key[1] == key[2], pa.Table.from_batches(held)


def pruning(threshold: float, tolerance: float):
    """For mapInArrow over dealt rows with signatures: star edges (a, b) among the pairs that survive."""
    table = least_matches(threshold, tolerance=tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        count = 0
        for within, rows in grouped(batches):
            nodes = rows.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            order = np.argsort(nodes, kind="stable")
            nodes, side = nodes[order], rows.column("side").to_numpy()[order]
            values = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype="<u2").reshape(-1, SLOTS)[order]
            earlier = np.ascontiguousarray(values[:, : ROWS_PER_BAND * int(rows.column("band")[0].as_py())]).view("<u8")
            kept = [(i[s], j[s]) for i, j in map(partial(first_met, earlier), blocked_pairs(side, within)) if len(s := survivors(values, i, j, table))]
            if kept:
                star = stars(len(nodes), *(np.concatenate(x) for x in zip(*kept, strict=True)))
                far = np.flatnonzero(star != np.arange(len(nodes)))
                out.append(np.stack([nodes[star[far]], nodes[far]]))
                count += len(far)
            if count >= 1 << 14:
                yield edges_batch(out)
                out, count = [], 0
        if out:
            yield edges_batch(out)

    return run


def edges_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(parts, axis=1)
    return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def linked_pairs(sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """[n, n] whether two sets reach the Jaccard threshold, exactly: the sizes of all intersections by products of the incidence matrix."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    if n == 2:
        common = np.array([[sizes[0], x := len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [x, sizes[1]]])
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        number = np.cumsum(counts > 1) - 1
        column, owner = number[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        total = int((counts > 1).sum())
        common = np.zeros((n, n), dtype=np.float64)
        for at in range(0, total, COLUMNS_AT_ONCE):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
            incidence = np.zeros((n, COLUMNS_AT_ONCE), dtype=np.float32)
            incidence[owner[lo:hi], column[lo:hi] - at] = 1
            common += incidence @ incidence.T
        common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return (common * threshold.denominator >= union * threshold.numerator) & (sizes[:, None] > 0) & (sizes[None, :] > 0)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    hashes, counts = shingles(texts)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Those that more than half of the sets have, sorted."""
    kinds, counts = np.unique(np.concatenate(sets), return_counts=True)
    return kinds[2 * counts > len(sets)]


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (key, lo, hi, share, node, text), sorted by the first three: a block's common shingles as plus of the node HEAD, then for each text what its set has more (plus) and less (minus)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "own", "share", "node", "plus", "minus"])

    out: list[tuple] = []
    held = 0
    for _, rows in grouped(batches):
        key, own, share = (rows.column(c)[0].as_py() for c in ("key", "lo", "share"))
        sets = in_blocks(rows.column("text").to_pylist(), sets_of)
        base = common_shingles(sets)
        out.append((key, own, share, HEAD, base.view(np.int64), []))
        for node, own_set in zip(rows.column("node").to_pylist(), sets, strict=True):
            more, less = (np.setdiff1d(x, y, assume_unique=True).view(np.int64) for x, y in ((own_set, base), (base, own_set)))
            out.append((key, own, share, node, more, less))
            held += len(more) + len(less)
        held += len(base)
        if held >= HASHES_AT_ONCE or len(out) >= 1 << 10:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def verifying(threshold: Fraction):
    """For mapInArrow over dealt differences: (node, links, star) for every text with links in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for within, rows in grouped(batches):
            nodes, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            if (nodes != HEAD).sum() < 2:
                continue
            plus, minus = (rows.column(c) for c in ("plus", "minus"))
            hashes = lambda column, k: column[int(k)].values.to_numpy().view(np.uint64)
            base = {int(side[k]): hashes(plus, k) for k in np.flatnonzero(nodes == HEAD)}
            order = np.argsort(nodes, kind="stable")
            order = order[nodes[order] != HEAD]
            nodes, side = nodes[order], side[order]
            sets = [np.concatenate([np.setdiff1d(base[int(x)], hashes(minus, k), assume_unique=True), hashes(plus, k)]) for k, x in zip(order, side, strict=True)]
            linked = linked_pairs(sets, threshold) & (nodes[:, None] != nodes[None, :])
            if not within:
                linked &= side[:, None] != side[None, :]
            links = linked.sum(axis=1)
            i, j = np.nonzero(np.triu(linked))
            star = stars(len(nodes), i, j)
            out += [(int(nodes[k]), int(links[k]), int(nodes[star[k]])) for k in np.flatnonzero(links)]
            if len(out) >= 1 << 14:
                yield links_batch(out)
                out = []
        if out:
            yield links_batch(out)

    return run


def links_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["node", "links", "star"])


def signing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(in_blocks(batch.to_pylist(), signatures), type=pa.binary())


def text_key(text: str = "text") -> Column:
    return F.md5(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


def name_of(doc_id: str | Column = "doc_id", key: str | Column | None = None) -> Column:
    """What a document is called: its id, or a hash of its text where it has none."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(own.cast("long"), F.xxhash64(text_key() if key is None else key))


def join(docs: DataFrame, threshold: str = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, key, class_id, n_links, n_copies, lead), a row for each row of docs.

    key is the text's; class_id the smallest name (doc_id, or a hash of the text where that is null) among all documents whose texts links join, n_links the number of
    different texts linked with this one (Jaccard of five-word shingle sets >= threshold), n_copies the rows with this text. lead marks the rows of the class's
    first text under its smallest name. A text without words (null too) is linked with nothing, not even its like: it is a class of its own row's name, and its lead.
    Rows that repeat a doc_id with other texts are documents of their own; where two classes have one smallest name, all but that of the smallest key are
    called by a hash of their first text instead. So neither a null nor a repeated doc_id makes or hides a link. No rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    exact = Fraction(threshold)
    signature = F.arrow_udf(signing, "binary")
    key = text_key()
    signed = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), signature("text").alias("signature"), F.length("text").cast("long").alias("chars")), "signatures")
    # Numbers are given once, at the writing; they differ between runs, but nothing of the result depends on them.
    texts = materialise(
        signed.filter(F.col("signature").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.any_value("signature").alias("signature"), F.max("chars").alias("chars"))
        .select(F.monotonically_increasing_id().alias("node"), "key", name_of("doc_id", F.col("key")).alias("name"), "n_copies", "signature", "chars"),
        "texts",
    )
    # Buckets: only numbers and counts are shuffled here; signatures join those that have company.
    width = 2 * ROWS_PER_BAND
    every_band = F.sequence(F.lit(0), F.lit(SLOTS // ROWS_PER_BAND - 1))
    names = F.transform(every_band, lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("signature", b * width + 1, F.lit(width))).alias("bucket")))
    bands = texts.select("node", F.inline(names))
    # Of buckets with the same members the one of the first band stays: there, no pair that it has first is passed over.
    buckets = (
        bands.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first"), F.min("band").alias("band"))
        .filter(F.col("n") > 1)
        .groupBy("n", "members", "first")
        .agg(F.min(F.struct("band", "bucket")).alias("own"))
        .select("own.band", "own.bucket", "n")
    )
    members = bands.select("node", "bucket").join(buckets, "bucket").join(texts.select("node", "signature"), "node")
    pairs = dealt(members, "bucket", F.col("n") / PRUNE_BLOCK, ["band", "signature"]).mapInArrow(pruning(float(exact), tolerance), "a long, b long")
    candidates = connected(pairs, "candidates")
    keyed = candidates.join(texts.select("node", "name", "key", "chars"), "node")
    sizes = keyed.groupBy("component").agg(F.greatest(F.count("*") / VERIFY_BLOCK, F.sum("chars") / VERIFY_CHARS).alias("share"))
    wanted = materialise(keyed.drop("chars").join(sizes, "component"), "wanted")
    # A text is read from one of its documents, that with the text's name; rows that repeat it (null ids) are dropped after the join.
    whole = docs.select(name_of("doc_id", key).alias("name"), key.alias("key"), "text")
    few = wanted.count() <= BROADCAST_TEXTS
    held = whole.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["name", "key"]).dropDuplicates(["name", "key"])
    own = block_of(F.col("share"))
    placed = held.select(F.col("component").alias("key"), own.alias("lo"), own.alias("hi"), F.col("share").cast("double").alias("share"), "node", "text")
    blocks = placed.repartition(partitions(docs.sparkSession), "key", "lo").sortWithinPartitions("key", "lo")
    differing = blocks.mapInArrow(differences, "key long, own int, share double, node long, plus array<long>, minus array<long>")
    pairs = dealt(differing, "key", F.col("share"), ["plus", "minus"], F.col("own"))
    verified = materialise(pairs.mapInArrow(verifying(exact), "node long, links long, star long"), "links")
    groups = connected(verified.select(F.col("star").alias("a"), F.col("node").alias("b")), "classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = texts.select("node", "key", "name", "n_copies").join(groups, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct("name", "key")).alias("lead")
    classes = joined.groupBy("component").agg(first)
    owners = classes.groupBy("lead.name").agg(F.min("lead.key").alias("owner"))  # of classes with one smallest name, that which keeps it
    called = classes.join(owners, F.col("lead.name") == F.col("name")).select(
        "component", F.col("lead.key").alias("lead_key"), F.col("name").alias("lead_name"), F.when(F.col("lead.key") == F.col("owner"), F.col("name")).otherwise(F.xxhash64("lead.key")).alias("class_id")
    )
    named = joined.join(called, "component").select("key", "n_copies", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "lead_key", "lead_name")
    own = name_of("doc_id", F.col("key"))
    return (
        signed.select("doc_id", "key", F.when(F.col("signature").isNotNull(), F.col("key")).alias("t_key"))
        .join(named.withColumnRenamed("key", "n_key"), F.col("t_key") == F.col("n_key"), "left")
        .select(
            "doc_id", "key", F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
            (F.col("n_key").isNull() | (F.col("key") == F.col("lead_key")) & (own == F.col("lead_name"))).alias("lead"),
        )
    )
