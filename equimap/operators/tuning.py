"""Tuning by good and bad densities (tree-structured Parzen estimators), with trials cut by the median of earlier ones.

Only the few numbers of finished trials are on the driver; what a trial costs is up to its evaluation, a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Range:
    """A parameter from lo to hi, whole numbers or not, on a logarithmic scale or not."""

    lo: float
    hi: float
    whole: bool = False
    log: bool = False

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else float(v)

    def outer(self, u: float) -> float:
        v = math.exp(u) if self.log else u
        v = min(self.hi, max(self.lo, v))
        return int(round(v)) if self.whole else float(v)


@dataclass
class Trial:
    params: dict[str, float]
    steps: list[float] = field(default_factory=list)
    pruned: bool = False

    @property
    def value(self) -> float:
        return float(np.mean(self.steps)) if self.steps else math.inf


def _density(u: np.ndarray, seen: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """A mixture of normal densities at the seen values, each as wide as its farther neighbour is away, and a wide one in the
    middle; cut to the range."""
    at = np.append(seen, (lo + hi) / 2)
    order = np.argsort(at)
    sides = np.concatenate(([lo], at[order], [hi]))
    wide = np.empty(len(at))
    wide[order] = np.maximum(sides[1:-1] - sides[:-2], sides[2:] - sides[1:-1])
    wide = np.clip(wide, (hi - lo) / min(100, len(at) + 1), hi - lo)
    wide[-1] = hi - lo
    erf = np.vectorize(math.erf)
    mass = (erf((hi - at) / wide / math.sqrt(2)) - erf((lo - at) / wide / math.sqrt(2))) / 2
    z = (u[:, None] - at) / wide
    return (np.exp(-z * z / 2) / (wide * math.sqrt(2 * math.pi) * mass)).mean(axis=1)


def _drawn(rng, n: int, seen: np.ndarray, lo: float, hi: float) -> np.ndarray:
    at = np.append(seen, (lo + hi) / 2)
    which = rng.integers(0, len(at), n)
    wide = np.full(len(at), max((hi - lo) / min(100, len(at) + 1), np.ptp(seen) / 2 if len(seen) > 1 else 0.0))
    wide[-1] = hi - lo
    out = rng.normal(at[which], wide[which])
    for _ in range(50):
        bad = (out < lo) | (out > hi)
        if not bad.any():
            break
        out[bad] = rng.normal(at[which[bad]], wide[which[bad]])
    return np.clip(out, lo, hi)


def minimise(
    evaluate: Callable[[dict], Iterable[float]],
    space: dict[str, Range],
    trials: int,
    startup: int = 5,
    seed: int = 42,
    first: dict | None = None,
    candidates: int = 24,
    good_share: float = 0.25,
    least_steps: int = 1,
) -> list[Trial]:
    """All trials. evaluate(parameters) gives a trial's steps, one by one (such as scores of folds); their mean is its value.

    The first trial is the stated one, `startup` ones are random. Then, for each parameter, values of the best share of the
    trials and of the others make two densities; of some values drawn from the good one, that with the largest ratio is tried.
    After `startup` whole trials, a trial whose mean so far lies above the median of the others' means after as many steps is
    cut, but not before `least_steps`; cut trials count as bad."""
    rng, out = np.random.default_rng(seed), []
    for t in range(trials):
        if t == 0 and first is not None:
            p = dict(first)
        elif t <= startup:
            p = {k: r.outer(rng.uniform(r.inner(r.lo), r.inner(r.hi))) for k, r in space.items()}
        else:
            ranked = sorted(out, key=lambda x: (x.pruned, x.value))
            n = max(1, math.ceil(good_share * len(ranked)))
            p = {}
            for k, r in space.items():
                lo, hi = r.inner(r.lo), r.inner(r.hi)
                good, bad = (np.array([r.inner(x.params[k]) for x in part]) for part in (ranked[:n], ranked[n:]))
                u = _drawn(rng, candidates, good, lo, hi)
                p[k] = r.outer(float(u[np.argmax(_density(u, good, lo, hi) / _density(u, bad, lo, hi))]))
        trial = Trial(p)
        out.append(trial)
        whole = [x for x in out[:-1] if not x.pruned]
        for step in evaluate(p):
            trial.steps.append(float(step))
            n = len(trial.steps)
            others = [float(np.mean(x.steps[:n])) for x in whole if len(x.steps) > n]
            if n >= least_steps and len(whole) >= startup and others and trial.value > float(np.median(others)):
                trial.pruned = True
                break
    return out
