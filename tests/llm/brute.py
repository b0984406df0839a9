"""Plain versions of learned operators' arithmetic, shared by tests."""

import math
import re

import numpy as np

from waymark.llm import language, toxicity


def brute_features(lexicon, text):
    """The scorer's features by plain rules over clauses and words."""
    low, sums, stems, clauses, top, events = (text or "").lower(), [0.0] * 16, set(), 0, 0.0, 0
    for clause in re.split(r"[.,;:!?\n()]", low):
        words, found = re.findall(r"[^\W\d_]+", clause), []
        for i, w in enumerate(words):
            own = [(v, -len(s), s.strip()) for s, v in lexicon.items() if (w == s.strip() if s.endswith(" ") else w.startswith(s))]
            kinds = [("insult", *max(own))] if own else []
            if w in toxicity.THREAT and (not kinds or kinds[0][1] <= 1.0):
                kinds = [("threat", 1.0, 0, w)]
            if kinds:
                found.append((i, *kinds[0]))
        if not found:
            continue
        clauses += 1
        hit = {i for i, *_ in found}
        plain = [None if i in hit else w for i, w in enumerate(words)]
        targeted = any(w in toxicity.TARGET for w in plain)
        for i, kind, weight, _, stem in found:
            negated = any(w in toxicity.NEGATION for w in plain[max(0, i - toxicity.NEGATION_REACH) : i])
            reported = any(w in toxicity.REPORTED for w in plain[:i])
            sums[8 * (kind == "threat") + 4 * negated + 2 * reported + targeted] += weight
            stems.add(stem)
            top, events = max(top, weight), events + 1
    if not events:
        return [0.0] * toxicity.FEATURES
    return [*np.log1p(sums), np.log1p(clauses), top, np.log1p(len(stems)), events / (1 + len(low) / 6)]


def brute_lexicon(rows):
    """Stems of (text, toxic) rows by counting sets; rows of one word set and label are one witness."""
    sets = {(frozenset(w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3), y) for t, y in rows}
    n, toxic = {}, {}
    for words, y in sets:
        for stem in {w + " " for w in words} | {w[:k] for w in words for k in toxicity.STEM_LENGTHS if len(w) >= k}:
            n[stem] = n.get(stem, 0) + 1
            toxic[stem] = toxic.get(stem, 0) + y
    total, bad = len(sets), sum(y for _, y in sets)
    share, limit = bad / total, math.log(toxicity.CHANCE_STEMS / (1 + 50 * total))
    found = {}
    for s, t in toxic.items():
        q = t / n[s]
        if t >= 3 and q >= toxicity.LEAST_PURITY and q > share:
            surprise = -n[s] * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0))
            if surprise <= limit:
                found[s] = (math.log((t + 0.5) / (n[s] - t + 0.5)) - math.log(share / (1 - share)), t, n[s])
    return toxicity.pruned(found)


def brute_posteriors(model, rows):
    """(language, posterior, kept) of rows (id, text, declared, host, path)."""
    known = model.langs[:-1]
    ll = [model.score([words])[0] if (words := language.prepared(r[1])) else None for r in rows]
    says = [None if x is None else model.langs[int(np.argmax(x))] for x in ll]
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h else None
    smooth = lambda n, over: (n + language.KAPPA * over) / (n.sum() + language.KAPPA)

    def counts(of):
        out = {}
        for s, r in zip(says, rows, strict=True):
            out.setdefault(of(r[3]), np.zeros(len(known)))
            if s in known:
                out[of(r[3])][known.index(s)] += 1
        return out

    hosts, suffixes = counts(lambda h: h), counts(suffix)
    top = smooth(sum(hosts.values()), np.full(len(known), 1 / len(known)))

    def told(v, true):
        wrong = (1 - true) / max(1, len(known) - 1) if len(known) > 1 else 1.0
        return np.log([true if v == x else wrong for x in known] + [1 / len(known)]) if v in known else np.zeros(len(known) + 1)

    out = []
    for (_, _, declared, host, path), x in zip(rows, ll, strict=True):
        prior = smooth(hosts[host], smooth(suffixes[suffix(host)], top))
        z = (0 if x is None else x) + np.log([*prior * (1 - language.UNKNOWN_PRIOR), language.UNKNOWN_PRIOR]) + told(declared, language.DECLARED_TRUE)
        z = z + told((suffix(host) or "").lower(), language.SUFFIX_TRUE) + told((path or "").lower(), language.SUFFIX_TRUE)
        best, p = model.langs[int(np.argmax(z))], 1 / np.exp(z - z.max()).sum()
        out.append((best, p, x is not None and best != language.UNKNOWN and p >= language.LEAST_POSTERIOR))
    return out
