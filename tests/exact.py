"""Plain versions of what the library approximates, for tests."""

import random
from collections.abc import Iterator


def bootstrap_exact(deltas: Iterator[tuple[int, int]], samples: int = 20_000, seed: int = 1729) -> tuple[list[float], list[float]]:
    """Means of resampled pairs with the standard library's generator, for checks against published intervals."""
    paired = list(deltas)
    rng = random.Random(seed)
    success, steps = [], []
    for _ in range(samples):
        chosen = [paired[rng.randrange(len(paired))] for _ in paired]
        success.append(sum(a for a, _ in chosen) / len(chosen))
        steps.append(sum(b for _, b in chosen) / len(chosen))
    return success, steps
