"""Language ID by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: byte-trigram likelihoods of the whole text, the language that the markup (or the
metadata) declares, the address suffix (the host's last label), and a prior for the host. Host priors come from a grouped aggregation over all documents of
what their texts alone say, each level smoothed by the one above: host, the address's last label, everything, uniform.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Rows of labelled text, about, that the likelihoods are learned from, chosen by a hash, and rows that each language may have of them at least.
TRAIN_ROWS, LANGUAGE_ROWS = 2_000, 50
#: Buckets of hashed trigrams, added counts, and rows of a language in the sample for it to be known.
BUCKETS = 1 << 16
ALPHA = 0.02
LEAST_ROWS = 5
#: A text weighs as much as this many of its trigrams at most, so that a very long one doesn't make a language.
TEXT_WEIGHT = 4096
#: Trigrams overlap, so their log likelihoods count for a third.
TEMPER = 1 / 3
#: How far the declared language and the address suffix are believed.
DECLARED_TRUE, SUFFIX_TRUE = 0.9, 0.6
#: The language of texts that no model explains, its prior, and the weight of the level above in host priors.
UNKNOWN, UNKNOWN_PRIOR, KAPPA = "und", 1e-6, 20.0
#: A document stays if its language is known with this posterior.
LEAST_POSTERIOR = 0.5
#: Hosts up to which their priors are broadcast (about a hundred bytes each); beyond, a shuffled join, whose hot hosts adaptive execution splits.
BROADCAST_HOSTS = 200_000
BLOCK_BYTES = 1 << 18


@dataclass(frozen=True)
class TrigramModel:
    """langs ends with UNKNOWN; table[bucket, lang] is the log probability of the trigram's last byte and context together."""

    langs: tuple[str, ...]
    table: np.ndarray

    @functools.cached_property
    def rows(self) -> np.ndarray:
        """[langs, buckets]: a language's probabilities together, so that they stay in the cache."""
        return np.ascontiguousarray(self.table.T)

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TrigramModel:
        """rows: (language, text). UNKNOWN gets the mean of the product of single-byte frequencies over all languages and the uniform distribution."""
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in rows:
            if words := prepared(text):
                by_lang.setdefault(lang, []).append(words)
        langs = sorted(k for k, v in by_lang.items() if len(v) >= LEAST_ROWS and k != UNKNOWN)
        table = np.zeros((BUCKETS, len(langs) + 1), dtype=np.float32)
        single = np.ones(256)
        for i, lang in enumerate(langs):
            counts = np.zeros(BUCKETS)
            for text in by_lang[lang]:
                raw = np.frombuffer(text, dtype=np.uint8)
                share = min(1.0, TEXT_WEIGHT / len(raw))  # of the whole text
                single += share * np.bincount(raw, minlength=256)
                counts += share * np.bincount(trigrams(raw), minlength=BUCKETS)
            table[:, i] = np.log((counts + ALPHA) / (counts.sum() + ALPHA * BUCKETS))
        p = np.log(single / single.sum())
        # The mean over a bucket's trigrams of their product of single frequencies, by the same hash.
        b, c = (x.reshape(-1) for x in np.indices((256, 256), dtype=np.uint32))
        mass = np.zeros(BUCKETS)
        for a in range(256):
            mass += np.bincount(hashed(np.full(1, a, dtype=np.uint32), b, c), weights=np.exp(p[a] + p[b] + p[c]), minlength=BUCKETS)
        table[:, -1] = np.log((mass + 1 / BUCKETS) / 2)
        return cls((*langs, UNKNOWN), table)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """[n, langs] tempered log likelihood of each prepared text."""
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(lengths)  # prepared texts have three bytes at least
        if not len(some):
            return out
        grams = trigrams(np.frombuffer(b"".join(texts), dtype=np.uint8))
        ends = np.cumsum(lengths[some])
        across = np.concatenate([ends[:-1] - 1, ends[:-1] - 2])
        for i, own in enumerate(self.rows):
            logs = own[grams]
            logs[across] = 0
            out[some, i] = np.add.reduceat(logs, ends - lengths[some], dtype=np.float64)
        return out * TEMPER


#: Digits, punctuation and white space say nothing of a language; all are blanks.
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def prepared(text: str | None) -> bytes:
    """Lower case, words between single blanks; nothing for a text without letters."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []
    return b" ".join([b"", *words, b""]) if words else b""


def hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def trigrams(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.uint32)
    return hashed(wide[:-2], wide[1:-1], wide[2:])


def rows_a_language(counts: list[int]) -> int:
    """The most rows that a language may have for all to have TRAIN_ROWS together, languages with fewer rows being whole; LANGUAGE_ROWS at least."""
    left = TRAIN_ROWS
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:
            return max(LANGUAGE_ROWS, left // (len(counts) - i))
        left -= n
    return max(LANGUAGE_ROWS, *counts, 0)


def training_rows(docs: DataFrame, text: str, declared: str, key: str) -> list[tuple[str, str]]:
    """A sample of each language that LEAST_ROWS rows with letters declare, the same rows at every run: all rows of a language up to
    rows_a_language, about so many beyond. So a language is known or not whatever the table's size, and copies crowd out none but their own."""
    lang = F.col(declared)
    labelled = docs.filter(lang.isNotNull() & (lang != UNKNOWN) & F.col(text).rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    counted = labelled.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS).collect()
    if not counted:
        return []
    most = rows_a_language([r["n"] for r in counted])
    ends = [(r["lang"], int(-(2**63) + most / r["n"] * 2**64) if r["n"] > most else 2**63 - 1) for r in counted]
    end = F.element_at(F.create_map(*[F.lit(x) for pair in ends for x in pair]), lang)
    # The text is in the hash, so that rows without a key or with one key aren't all in or all out. Copies count as LEAST_ROWS at most, so the sample is bounded.
    known = labelled.filter(lang.isin(*[name for name, _ in ends])).filter(F.xxhash64(key, declared, text) <= end)
    different = known.groupBy(lang.alias("lang"), F.col(text).alias("text")).agg(F.least(F.count("*"), F.lit(LEAST_ROWS)).alias("n"))
    return sorted((r["lang"], r["text"]) for r in different.collect() for _ in range(r["n"]))


def likelihoods(model: TrigramModel):
    """A UDF from texts to arrays of tempered log likelihoods; null texts and those without letters get null."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = []
            held: list[bytes] = []
            size = 0

            def flush() -> None:
                got = iter(model.score([t for t in held if t]))
                out.extend(next(got).tolist() if t else None for t in held)
                held.clear()

            for text in batch:
                held.append(prepared(text.as_py()))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.array(out, type=pa.list_(pa.float64()))

    return score


def last_label(host: str | Column) -> Column:
    """The address suffix: what follows the host's last dot; null without a dot."""
    name = F.col(host) if isinstance(host, str) else host
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def host_priors(scored: DataFrame, langs: tuple[str, ...]) -> DataFrame:
    """(_prior_host, _priors): for every host, log priors of langs. scored: host and says (the language of the text alone, or null).

    A host's share is (its count + KAPPA * the parent's share) / (all its counts + KAPPA), likewise for the parent (the address's last
    label, none without a dot) over everything, and for everything over the uniform distribution.
    """
    known = langs[:-1]
    parent = last_label("host")
    counts = [F.count_if(F.col("says") == lang).cast("double").alias(f"n{i}") for i, lang in enumerate(known)]
    hosts = scored.groupBy("host").agg(*counts).withColumn("parent", parent)
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(known))]
    top = hosts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(len(known))]).first()
    above = hosts.groupBy("parent").agg(*sums).select(F.col("parent").alias("p_name"), *[F.col(f"n{i}").alias(f"p{i}") for i in range(len(known))])
    joined = hosts.join(above, F.col("parent").eqNullSafe(F.col("p_name")))

    def level(counts: list[Column], over: list[Column]) -> list[Column]:
        total = sum(counts, F.lit(0.0))
        return [(n + F.lit(KAPPA) * q) / (total + F.lit(KAPPA)) for n, q in zip(counts, over, strict=True)]

    columns = lambda prefix: [F.col(f"{prefix}{i}") for i in range(len(known))]
    shares = level(columns("n"), level(columns("p"), level([F.lit(float(t)) for t in top], [F.lit(1.0 / len(known))] * len(known))))
    logs = [F.log(F.lit(1 - UNKNOWN_PRIOR) * q) for q in shares]
    return joined.select(F.col("host").alias("_prior_host"), F.array(*logs, F.lit(math.log(UNKNOWN_PRIOR))).alias("_priors"))


def evidence(col: Column, langs: tuple[str, ...], true: float) -> list[Column]:
    """Log probability of the declared value under each language; 0 where it is null or names no known language."""
    known = langs[:-1]
    wrong = math.log((1 - true) / max(1, len(known) - 1)) if len(known) > 1 else 0.0
    told = F.coalesce(col.isin(*known), F.lit(False))
    return [*(F.when(~told, 0.0).otherwise(F.when(col == lang, math.log(true)).otherwise(wrong)) for lang in known), F.when(told, math.log(1 / len(known))).otherwise(0.0)]


def named_language(name: Column, langs: tuple[str, ...]) -> Column:
    """The known language that an address part such as ``fr`` or ``.DE`` names, or null."""
    bare = F.lower(F.regexp_replace(name, r"^\.", ""))
    return F.when(bare.isin(*langs[:-1]), bare)


def identify(
    docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", path: str | None = None, key: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """Adds language, posterior (of that language) and kept to the columns ``keep`` (all, by default) of every row of docs; columns of these names are replaced.

    Evidence: the whole text, the declared language, the host's address suffix and, if named, another address part ``path``, and the host's prior. Null texts and
    those without letters bring no text evidence and are never kept; their language is what the other evidence says. A null host takes part as a host of
    its own, without a suffix. Repeated rows are rows of their own; so a host's prior counts each copy. Without any labelled row every language is ``und``. Ties go to the first
    language by name. Texts are scored once: the wanted columns and the scores are written to the shared folder, and the priors and the result read that.
    """
    small_batches(docs.sparkSession)
    made = ["language", "posterior", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = training_rows(docs, text, declared, key) if declared else []
    model = TrigramModel.fit(rows)
    if len(model.langs) == 1:
        return docs.select(*keep).withColumns({"language": F.lit(UNKNOWN), "posterior": F.lit(1.0), "kept": F.lit(False)})
    langs = model.langs
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    host_of = F.col(host).cast("string") if host else F.lit(None).cast("string")
    told = evidence(F.col(declared), langs, DECLARED_TRUE) if declared else [F.lit(0.0)] * len(langs)
    parts = [evidence(named_language(x, langs), langs, SUFFIX_TRUE) for x in (last_label(host_of), *([F.col(path)] if path else []))]
    beside = F.array(*[sum(own, F.lit(0.0)) for own in zip(told, *parts, strict=True)])
    # Internal columns lie in structs of their own, so that no column of docs can clash with them.
    scored = materialise(docs.select(F.struct(*keep).alias("_row"), host_of.alias("_host"), likelihoods(model)(text).alias("_ll"), beside.alias("_beside")), "scored")
    alone = scored.select(F.col("_host").alias("host"), best(F.col("_ll")).alias("says"))
    # Counted once, so that the size decides between broadcast and shuffle; a row a host.
    priors = materialise(host_priors(alone, langs), "priors")
    small = priors.count() <= BROADCAST_HOSTS
    out = scored.join(F.broadcast(priors) if small else priors, F.col("_host").eqNullSafe(F.col("_prior_host")), "left")
    flat = math.log(1 / len(langs))
    total = F.array(*[F.coalesce(F.col("_ll")[i], F.lit(0.0)) + F.coalesce(F.col("_priors")[i], F.lit(flat)) + F.col("_beside")[i] for i in range(len(langs))])
    shifted = F.aggregate("_total", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("_total")))
    known = F.col("_ll").isNotNull() & (F.col("_language") != UNKNOWN) & (F.col("_posterior") >= LEAST_POSTERIOR)
    found = out.withColumn("_total", total).withColumns({"_language": best(F.col("_total")), "_posterior": F.lit(1.0) / shifted})
    return found.select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_language").alias("language"), F.col("_posterior").alias("posterior"), known.alias("kept"))
