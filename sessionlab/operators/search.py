"""Hyper-parameter search: seeded draws from ranges, and successive halving over growing sets of left-out folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Whole:
    low: int
    high: int


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False


@dataclass(frozen=True)
class Choice:
    values: tuple


def draw(space: Mapping[str, Whole | Real | Choice], n: int, seed: int = 42) -> list[dict]:
    """``n`` candidates; candidate k depends on the seed, k and the parameter's name alone, so more draws keep the earlier ones."""

    def value(kind, rng):
        if isinstance(kind, Whole):
            return int(rng.integers(kind.low, kind.high + 1))
        if isinstance(kind, Choice):
            return kind.values[int(rng.integers(len(kind.values)))]
        if kind.log:
            return float(math.exp(rng.uniform(math.log(kind.low), math.log(kind.high))))
        return float(rng.uniform(kind.low, kind.high))

    return [{name: value(space[name], np.random.default_rng([seed, k, *name.encode()])) for name in sorted(space)} for k in range(n)]


@dataclass(frozen=True)
class Trial:
    candidate: int
    params: dict
    #: Score of every fold the candidate was fitted for.
    scores: dict

    @property
    def mean(self) -> float:
        return sum(self.scores.values()) / len(self.scores)


def halving(
    candidates: Sequence[dict], folds: Sequence, evaluate: Callable[[dict, list], Mapping], keep: float = 0.5, start: int = 1, parallelism: int = 4
) -> list[Trial]:
    """Trials, best first. All candidates are scored on ``start`` folds, the better share ``keep`` of them on twice as many, and so on.

    ``evaluate(params, folds)`` returns the score of each of the folds (higher is better); candidates run as a bounded number of concurrent
    jobs, and a fold is never scored twice for one candidate. Candidates that reach the last round, which covers all folds, come before
    dropped ones; equal scores keep the order of the candidates.
    """
    scores: list[dict] = [{} for _ in candidates]
    alive, reach = list(range(len(candidates))), min(start, len(folds))
    mean = lambda c: sum(scores[c].values()) / len(scores[c])
    while alive:
        def one(c):
            new = [f for f in folds[:reach] if f not in scores[c]]
            return dict(evaluate(candidates[c], new)) if new else {}

        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for c, got in zip(alive, pool.map(one, alive), strict=True):
                scores[c].update(got)
        alive.sort(key=lambda c: (-mean(c), c))
        if reach == len(folds):
            break
        alive = alive[: max(1, math.ceil(len(alive) * keep))]
        reach = min(2 * reach, len(folds))
    ranked = sorted(range(len(candidates)), key=lambda c: (-len(scores[c]), -mean(c), c))
    return [Trial(c, candidates[c], scores[c]) for c in ranked]
