"""URL filters as a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And machine. A pattern is a run of positions; bit i of the state
says that the pattern's first i tokens fit what was read. For a byte c the machine steps to
((D << 1) & B[c]) | (D & S[c]), where B[c] has the positions that take c and S[c] the positions before a wildcard that
may take c too. The step is the same for all patterns at once, and for all URLs of a batch at once.

Globs over the canonical URL ``.host/path``: ``*`` stands for any bytes without ``/``, ``**`` for any bytes, ``?`` for one byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's rules: verdict, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What the filter itself blocks where no rule fits.
BLOCKED_GLOBS = (
    "*casino**",
    "*cheap-pills**",
    "*free-bets**",
    "*spam-farm**",
    "*.ads-track.**",
    "**/wp-login.php",
    "**.exe",
)
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_glob(host: str, path: str) -> str:
    """Fits the host and its subdomains where the path starts with path. Host and path are taken literally."""
    return f"*.{host}{path}**"


def tokens(glob: str) -> list[tuple[str, int | None]]:
    """('byte', b), ('one', None), ('part', None) for * and ('any', None) for **."""
    out: list[tuple[str, int | None]] = []
    raw, i = glob.encode(), 0
    while i < len(raw):
        if raw[i : i + 2] == b"**":
            out.append(("any", None))
            i += 2
        else:
            out.append(("part", None) if raw[i] == 42 else ("one", None) if raw[i] == 63 else ("byte", raw[i]))
            i += 1
    return out


@dataclass(frozen=True)
class Automaton:
    """words x 64 bits of state for all patterns."""

    step: np.ndarray  # [256, words] positions that take a byte
    stay: np.ndarray  # [256, words] positions that a wildcard keeps
    start: np.ndarray  # [words]
    final: tuple[int, ...]  # bit of each pattern's last position
    words: int

    @classmethod
    def compile(cls, globs: Iterable[str]) -> Automaton:
        step: list[set[int]] = [set() for _ in range(256)]
        stay: list[set[int]] = [set() for _ in range(256)]
        start, final, bit = [], [], 0
        for glob in globs:
            start.append(bit)  # nothing read yet
            for kind, byte in tokens(glob):
                if kind in ("part", "any"):
                    for c in range(256):
                        if kind == "any" or c != 47:
                            stay[c].add(bit)
                else:
                    bit += 1
                    for c in range(256) if kind == "one" else (byte,):
                        step[c].add(bit)
            final.append(bit)
            bit += 1
        words = max(1, (bit + 63) // 64)
        return cls(cls.masks(step, words), cls.masks(stay, words), cls.masks([set(start)], words)[0], tuple(final), words)

    @staticmethod
    def masks(sets: list[set[int]], words: int) -> np.ndarray:
        out = np.zeros((len(sets), words), dtype=np.uint64)
        for row, bits in enumerate(sets):
            for b in bits:
                out[row, b // 64] |= np.uint64(1 << (b % 64))
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """[n, words] final states. URLs leave the active set as they end, so one long URL doesn't pad the others."""
        n = len(urls)
        state = np.tile(self.start, (n, 1))
        lengths = np.fromiter((len(u) for u in urls), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(urls), dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        one, top = np.uint64(1), np.uint64(63)
        live, at = n, 0
        ends = -lengths[order]
        while live and (live := int(np.searchsorted(ends, -at, side="left"))) > 0:
            rows = order[:live]
            if live < 4:
                for r in rows:
                    state[r] = self.run_one(state[r], urls[r][at:])
                break
            c = flat[begins[rows] + at]
            d = state[rows]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[rows] = (moved & self.step[c]) | (d & self.stay[c])
            at += 1
        return state

    def run_one(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """The same for a single URL, with Python's wide integers; ends early once no pattern is alive."""
        join = lambda words: sum(int(w) << (64 * i) for i, w in enumerate(words))
        step, stay, d = [join(x) for x in self.step], [join(x) for x in self.stay], join(state)
        for c in rest:
            d = ((d << 1) & step[c]) | (d & stay[c])
            if not d:
                break
        return np.array([(d >> (64 * i)) & (2**64 - 1) for i in range(self.words)], dtype=np.uint64)

    def hits(self, state: np.ndarray) -> np.ndarray:
        """[n, patterns] whether each pattern fits."""
        bits = np.array(self.final, dtype=np.int64)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) == 1


def matcher(rules=RULES, globs=BLOCKED_GLOBS):
    """A function of batches of canonical URLs to (number of the longest rule that fits or -1, number of the first glob or -1)."""
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    patterns = [rule_glob(rules[i][1], rules[i][2]) for i in ranked] + list(globs)

    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = Automaton.compile(patterns)
        for urls in batches:
            if not len(urls):
                yield pd.DataFrame({"rule_no": pd.Series([], dtype="int32"), "glob_no": pd.Series([], dtype="int32")})
                continue
            hit = machine.hits(machine.run([u.encode("utf-8", "surrogatepass") for u in urls]))
            by_rule, by_glob = hit[:, : len(ranked)], hit[:, len(ranked) :]
            rule = np.array([*ranked, -1])[np.where(by_rule.any(1), by_rule.argmax(1) if len(ranked) else 0, len(ranked))]
            glob = np.where(by_glob.any(1), by_glob.argmax(1) if len(globs) else 0, -1)
            yield pd.DataFrame({"rule_no": rule.astype("int32"), "glob_no": glob.astype("int32")})

    return match


def judge(pages: DataFrame, url: str = "url", rules=RULES, globs=BLOCKED_GLOBS) -> DataFrame:
    """Adds host, path, rule, verdict and glob to every row of pages; columns of these names are replaced.

    A null URL or one without ``://`` has empty host and path, no rule fits it, and the globs see ``.`` alone (allowed).
    Rows don't move between partitions.
    """
    at = lambda k: F.coalesce(F.regexp_extract(F.col(url), URL_PARTS, k), F.lit(""))
    found = F.pandas_udf(matcher(rules, globs), "rule_no int, glob_no int")
    pick = lambda values, no: F.when(F.col(no) >= 0, F.element_at(F.array(*map(F.lit, values)), F.col(no) + 1)) if values else F.lit(None).cast("string")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "glob")]
    return (
        pages.select(*kept, F.translate(at(1), UPPER, LOWER).alias("host"), at(2).alias("path"))
        .withColumn("_found", found(F.concat(F.lit("."), "host", "path")))
        .withColumns({"_rule_no": F.col("_found.rule_no"), "_glob_no": F.col("_found.glob_no")})
        .withColumns({"rule": pick([h + p for _, h, p in rules], "_rule_no"), "glob": pick(list(globs), "_glob_no")})
        .withColumn(
            "verdict",
            F.coalesce(pick([v for v, _, _ in rules], "_rule_no"), F.when(F.col("_glob_no") >= 0, "block").otherwise("allow")),
        )
        .drop("_found", "_rule_no", "_glob_no")
    )
