"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause by class. Those of insult and threat emit an event, whose arc has the word's weight in the lexicon;
those of negation, reported speech and target emit the marks of their states. Their composition is one automaton over product states, whose
output at a word joins what the five emit. The machine walks a clause once, from its real start to its real end, and sums the weights of events by
output; the mark of the target is read at the clause's end, as a target may follow the insult. A logistic model over a document's sums scores it.

Insult stems and their weights, and the model's weights, are learned from labelled rows: stems that mark toxic documents far
beyond chance. Words of negation, reported speech, targets and threats are fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, materialise, partitions, small_batches

#: Fixed word lists of the grammar, by class.
NEGATION = "not never no nobody nicht nie kein keine ne pas jamais aucun nunca jamás ningún".split()
REPORTED = "said says told wrote writes claimed quoted sagte schrieb behauptete zitierte dit écrit affirme dijo escribió afirmó".split()
TARGET = "you your yours yourself they them he she du dich dir euch sie tu toi vous vos tú usted ustedes".split()
THREAT = "kill hurt destroy beat burn shoot töten schlagen zerstören vernichten tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREATS, NEGATES, REPORTS, TARGETS = range(6)
#: Words after a negation that it covers.
NEGATION_REACH = 3
#: A clause ends here.
CLAUSE_END = re.compile(r"[.,;:!?\n()]")
WORD = re.compile(r"[^\W\d_]+")
#: What the composed machine may emit at a word, as bits: an event; it is a threat, negated, reported; and the mark that a target was named.
EVENT, IS_THREAT, NEGATED, REPORTED_SPEECH, TARGETED = 16, 8, 4, 2, 1

#: Labelled rows for learning, about, chosen by a hash of their ids.
TRAIN_ROWS = 24_000
#: Prefix lengths that may be stems, besides whole words, and how many chance stems are tolerated: 5 catches more but judges more clean texts wrong, with an equal F1
#: in cross-validation over the folds that may teach (README).
STEM_LENGTHS = (4, 5, 6, 7)
CHANCE_STEMS = 0.5
#: Share of a stem's documents that are toxic, at least.
LEAST_PURITY = 0.75
THRESHOLD = 0.3
RIDGE = 1e-3
FEATURES = 20


@dataclass(frozen=True)
class Transducer:
    """delta[state, class] is the next state, emits[state, class] the output bits of that arc. Every transducer reads every word."""

    delta: np.ndarray
    emits: np.ndarray

    @classmethod
    def event(cls, kind: int, bits: int) -> Transducer:
        """One state; the arc of a word of class ``kind`` emits the event."""
        emits = np.zeros((1, 6), dtype=int)
        emits[0, kind] = bits
        return cls(np.zeros((1, 6), dtype=int), emits)

    @classmethod
    def countdown(cls, on: int, reach: int, bit: int) -> Transducer:
        """A word of class ``on`` marks the ``reach`` words behind it."""
        states = np.arange(reach + 1)
        delta = np.repeat(np.maximum(states - 1, 0)[:, None], 6, axis=1)
        delta[:, on] = reach
        return cls(delta, np.repeat(np.where(states > 0, bit, 0)[:, None], 6, axis=1))

    @classmethod
    def latch(cls, on: int, bit: int) -> Transducer:
        """Marks all words of the clause behind one of class ``on``."""
        delta = np.array([[0] * 6, [1] * 6])
        delta[:, on] = 1
        return cls(delta, np.array([[0] * 6, [bit] * 6]))

    def compose(self, other: Transducer) -> Transducer:
        """The synchronous product: state s * (other's states) + t, outputs joined."""
        m = len(other.delta)
        s, t = np.divmod(np.arange(len(self.delta) * m), m)
        return Transducer(self.delta[s] * m + other.delta[t], self.emits[s] | other.emits[t])


def grammar() -> Transducer:
    """Insult, threat, negation, reported speech and target as one automaton; its start is state 0."""
    return reduce(Transducer.compose, [
        Transducer.event(INSULT, EVENT), Transducer.event(THREATS, EVENT | IS_THREAT), Transducer.countdown(NEGATES, NEGATION_REACH, NEGATED),
        Transducer.latch(REPORTS, REPORTED_SPEECH), Transducer.latch(TARGETS, TARGETED),
    ])


@dataclass
class Lexicon:
    """Stems: word beginnings, or whole words if they end with a blank; values are their weights."""

    stems: dict[str, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        """Finds insults and threats at word beginnings. Value: (class, length, weight, whole word)."""
        found = ahocorasick.Automaton()
        for word in THREAT:
            found.add_word(word, (THREATS, len(word), 1.0, True))
        for stem, weight in self.stems.items():
            bare = stem.rstrip(" ")
            found.add_word(bare, (INSULT, len(bare), weight, stem != bare))
        found.make_automaton()
        return found


CLASSES = {w: c for words, c in ((NEGATION, NEGATES), (REPORTED, REPORTS), (TARGET, TARGETS)) for w in words}


def letter(c: str) -> bool:
    """Whether a character is one of WORD's."""
    return c.isalnum() and not c.isdecimal()


class ClauseScorer:
    """Features of whole texts. Only clauses with an insult or a threat are read word by word; others emit nothing."""

    def __init__(self, lexicon: Lexicon):
        self.find, machine = lexicon.automaton(), grammar()
        self.delta, self.emits = machine.delta.tolist(), machine.emits.tolist()

    def hits(self, low: str) -> dict[int, tuple[int, float, str]]:
        """(class, weight, stem) by the place of the word that it begins, the heaviest stem of a word, of equal ones the shortest."""
        found: dict[int, tuple[int, float, str]] = {}
        for last, (kind, length, weight, whole) in self.find.iter(low):
            begin = last - length + 1
            if begin and letter(low[begin - 1]) or whole and last + 1 < len(low) and letter(low[last + 1]):
                continue
            if begin not in found or weight > found[begin][1]:
                found[begin] = kind, weight, low[begin : last + 1]
        return found

    def __call__(self, text: str | None) -> list[float]:
        """[0:16] log(1 + weight) by kind (8 threat, 4 negated, 2 reported, 1 targeted), then 16: log clauses, 17: largest weight, 18: distinct stems, 19: events per word."""
        out = [0.0] * FEATURES
        low = text.lower() if text else ""
        hits = self.hits(low) if low else None
        if not hits:
            return out
        ends = CLAUSE_END.sub("\n", low)  # of the same length, so that one search finds any end
        done, clauses = -1, 0
        for at in sorted(hits):
            if at < done:
                continue
            begin, end = ends.rfind("\n", max(0, done), at) + 1, ends.find("\n", at)
            # Without an end between the last clause and this hit the search gives 0; that clause's end is the least beginning.
            begin, done, clauses = max(begin, done, 0), end if end >= 0 else len(low), clauses + 1
            state, sums = 0, [0.0] * 16
            for m in WORD.finditer(low, begin, done):
                kind, weight, _ = hits.get(m.start()) or (CLASSES.get(m[0], OTHER), 0.0, "")
                emitted = self.emits[state][kind]
                if emitted & EVENT:
                    sums[emitted & ~(EVENT | TARGETED)] += weight
                state = self.delta[state][kind]
            targeted = self.emits[state][OTHER] & TARGETED
            for kind, total in enumerate(sums):
                if total:
                    out[kind | targeted] += total
        out[:16] = [math.log1p(x) for x in out[:16]]
        out[16], out[17], out[18] = math.log1p(clauses), max(h[1] for h in hits.values()), math.log1p(len({h[2] for h in hits.values()}))
        out[19] = len(hits) / (1 + len(low) / 6)
        return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # FEATURES, then the intercept
    scale: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = rows / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo 4; rows with 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of about TRAIN_ROWS labelled documents outside the held-out fold, written once: a row for each id (the text of the smallest hash, should
    an id repeat). Only their ids and labels (16 bytes a row) are broadcast, and only their texts are shuffled."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2))
    chosen = hash_sample(own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), ["doc_id"], TRAIN_ROWS)
    found = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")
    single = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")
    return materialise(single.repartition(partitions(docs.sparkSession)), "labelled")


def distinct_words(rows: DataFrame) -> DataFrame:
    """(words, toxic): the word sets of rows, one of those that agree in four MinHash values, lest copies of a document count as many witnesses."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    least = lambda seed: F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(seed))))
    keyed = rows.select(words.alias("words"), "toxic").withColumn("copies", F.xxhash64(*map(least, range(4)), "toxic"))
    return keyed.groupBy("copies").agg(F.min_by(F.struct("words", "toxic"), F.xxhash64("words")).alias("own")).select("own.words", "own.toxic")


def stem_counts(words: DataFrame) -> DataFrame:
    """(stem, toxic, n): documents that have the stem."""
    cut = lambda k: F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k))
    stems = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(w, F.lit(" "))), *map(cut, STEM_LENGTHS)))
    return words.select(F.explode(stems).alias("stem"), "toxic").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))


def beyond_chance(toxic: Column, n: Column, share: float, limit: float) -> Column:
    """Whether the bound (Chernoff) on the log probability that chance marks so many of n documents is at most ``limit``."""
    q = toxic / n
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / F.lit(1 - share))).otherwise(0.0)
    return (q > share) & (-n * (q * F.log(q / F.lit(share)) + rest) <= limit)


def pruned(found: dict[str, tuple[float, int, int]]) -> dict[str, float]:
    """Weights of the stems that stay. found: stem (with a blank behind it, a whole word) to (weight, toxic documents, documents).

    Of stems that begin alike the shortest stays, and a longer one only if it weighs clearly more. A beginning goes if, without the documents of the longest
    among its own longer stems, it no longer marks toxic ones.
    """
    kept: dict[str, tuple[float, int, int]] = {}
    for stem in sorted(found, key=lambda x: (len(x.rstrip()), x)):
        bare = stem.rstrip()
        above = next((kept[bare[:k]] for k in range(min(STEM_LENGTHS), len(bare) + 1) if bare[:k] in kept), None)
        if above is None or found[stem][0] > above[0] + 0.7:
            kept[stem] = found[stem]
    names = sorted(kept)
    out = {}
    for i, stem in enumerate(names):
        _, toxic, n = kept[stem]
        bare, longer, j = stem.rstrip(), (0, 0), i + 1
        while j < len(names) and names[j].startswith(bare):
            longer, j = max(longer, kept[names[j]][1:]), j + 1
        if stem != bare or toxic - longer[0] >= LEAST_PURITY * (n - longer[1]) and n > longer[1]:
            out[stem] = kept[stem][0]
    return out


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """All stems beyond chance. Counts cover all rows given; what reaches the driver is the surviving stems of that bounded sample."""
    words = materialise(distinct_words(rows).repartition(partitions(rows.sparkSession)), "words")
    total = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not total["t"] or total["t"] == total["n"]:
        return Lexicon({})
    share = total["t"] / total["n"]
    odds = F.log((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)) - math.log(share / (1 - share))
    counts = stem_counts(words).filter((F.col("toxic") >= 3) & (F.col("toxic") >= F.col("n") * LEAST_PURITY))
    # As many stems could have come about by chance as have three documents; their number is about that of documents.
    limit = math.log(CHANCE_STEMS / (1 + 50 * total["n"]))
    sure = counts.filter(beyond_chance(F.col("toxic"), F.col("n"), share, limit)).select("stem", odds.alias("odds"), "toxic", "n")
    return Lexicon(pruned({r["stem"]: (r["odds"], r["toxic"], r["n"]) for r in sure.collect()}))


def featurise(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded training sample, on the driver: FEATURES doubles a row."""
    got = rows.select(features_udf(lexicon)("text").alias("f"), F.col("toxic")).collect()
    return np.array([r["f"] for r in got]).reshape(-1, FEATURES), np.array([r["toxic"] for r in got], dtype=float)


def features_udf(lexicon: Lexicon):
    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = ClauseScorer(lexicon)
        for batch in batches:
            yield pa.array([scorer(t.as_py()) for t in batch], type=pa.list_(pa.float64()))

    return features


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights. Without labels of both kinds the model gives every text the labels' share, or 0.5 without any."""
    rows = labelled(docs, labels)
    lexicon = learn_lexicon(rows)
    x, y = featurise(rows, lexicon)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(FEATURES)
    w = np.zeros(FEATURES + 1)
    if len(y):
        design = np.hstack([x / scale, np.ones((len(x), 1))])
        ridge = np.diag([RIDGE * len(y)] * FEATURES + [1e-6])
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
    return Model(lexicon, w, scale)


def scores_udf(model: Model):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = ClauseScorer(model.lexicon)
        for batch in batches:
            rows = np.array([scorer(t.as_py()) for t in batch]).reshape(-1, FEATURES)
            yield pa.array(model.score(rows), type=pa.float64())

    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to every row of docs, learning from labels. Columns of these names are replaced.

    Null and empty texts get the score of a text without events; equal texts get equal scores. Labels, language, source and id are no inputs of a score. An id
    with several labels is toxic if one says so; labels of null are none. Documents are read once for learning and once for scoring, and never shuffled.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    scored = docs.drop("score", "predicted").withColumn("score", scores_udf(model)("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
