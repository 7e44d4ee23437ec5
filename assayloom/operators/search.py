"""Guided search of settings: Parzen-estimator proposals and early stopping of poor trials.

A space maps a name to ("int", low, high), ("step", low, high, step), ("float", low, high), ("log", low, high) or
("choice", value, ...). Trials are proposed in batches; the trials of a batch are evaluated side by side by the
caller, one rung (fold) after the other. Every proposal depends on the seed, the trial's number and the scores
before its batch alone, so a search is the same whenever its scores are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

Space = Mapping[str, tuple]
#: Random trials before the first guided one, share of trials that count as good, and proposals compared.
STARTUP, GOOD_SHARE, CANDIDATES = 8, 0.25, 24
#: Trials that must have passed a rung before one is stopped there.
LEAST_AT_RUNG = 4


@dataclass
class Trial:
    number: int
    params: dict
    scores: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def value(self) -> float:
        return float(np.mean(self.scores)) if self.scores else -math.inf


def _bounds(spec: tuple) -> tuple[float, float]:
    if spec[0] == "log":
        return math.log(spec[1]), math.log(spec[2])
    return float(spec[1]), float(spec[2])


def _value(spec: tuple, at: float):
    """A point of the scale that the parameter is drawn on as a value of it."""
    kind, low, high = spec[:3]
    if kind == "log":
        return float(min(max(math.exp(at), low), high))
    if kind == "float":
        return float(min(max(at, low), high))
    step = spec[3] if kind == "step" else 1
    return int(low + step * min(max(round((at - low) / step), 0), (high - low) // step))


def _place(spec: tuple, value) -> float:
    return math.log(value) if spec[0] == "log" else float(value)


def draw(space: Space, rng: np.random.Generator) -> dict:
    """One uniform draw."""
    out = {}
    for name, spec in space.items():
        if spec[0] == "choice":
            out[name] = spec[1 + int(rng.integers(len(spec) - 1))]
        else:
            out[name] = _value(spec, rng.uniform(*_bounds(spec)))
    return out


class _Density:
    """Parzen estimate of one parameter: a bump per value, and the uniform draw as one more."""

    def __init__(self, spec: tuple, values: Sequence):
        self.spec = spec
        if spec[0] == "choice":
            counts = np.array([1.0 + sum(v == c for v in values) for c in spec[1:]])
            self.shares = counts / counts.sum()
            return
        low, high = _bounds(spec)
        self.centres = np.sort([_place(spec, v) for v in values])
        around = np.r_[low, self.centres, high]
        gaps = np.maximum(np.diff(around)[:-1], np.diff(around)[1:])
        self.widths = np.clip(gaps, (high - low) / min(100, 1 + len(values)), high - low)
        self.low, self.high = low, high

    def sample(self, rng: np.random.Generator):
        if self.spec[0] == "choice":
            return self.spec[1 + int(rng.choice(len(self.shares), p=self.shares))]
        k = int(rng.integers(len(self.centres) + 1))
        if k == len(self.centres):
            return _value(self.spec, rng.uniform(self.low, self.high))
        return _value(self.spec, float(np.clip(rng.normal(self.centres[k], self.widths[k]), self.low, self.high)))

    def log(self, value) -> float:
        if self.spec[0] == "choice":
            return math.log(self.shares[self.spec[1:].index(value)])
        z = (_place(self.spec, value) - self.centres) / self.widths
        bumps = np.exp(-0.5 * z**2) / (self.widths * math.sqrt(2 * math.pi))
        return math.log((bumps.sum() + 1 / max(self.high - self.low, 1e-300)) / (len(self.centres) + 1))


def propose(space: Space, done: Sequence[Trial], number: int, seed: int) -> dict:
    """Settings of trial ``number``: the candidate likeliest under the good trials against the others.

    Trials that were stopped rank behind all that were not.
    """
    rng = np.random.default_rng((seed, number))
    if len(done) < STARTUP:
        return draw(space, rng)
    ranked = sorted(done, key=lambda t: (t.stopped, -t.value, t.number))
    cut = max(2, math.ceil(GOOD_SHARE * len(ranked)))
    good = {n: _Density(s, [t.params[n] for t in ranked[:cut]]) for n, s in space.items()}
    rest = {n: _Density(s, [t.params[n] for t in ranked[cut:]]) for n, s in space.items()}
    candidates = [{n: good[n].sample(rng) for n in space} for _ in range(CANDIDATES)]
    return max(candidates, key=lambda p: sum(good[n].log(v) - rest[n].log(v) for n, v in p.items()))


def search(
    space: Space, evaluate: Callable[[list[Trial], int], Sequence[float]], trials: int, rungs: int, batch: int = 4,
    seed: int = 42, guided: bool = True, stop: bool = True,
) -> list[Trial]:
    """Runs ``trials`` trials and returns them by number; scores are to be large.

    ``evaluate(trials, rung)`` scores the trials on one rung. A trial goes on to the next rung if its mean so far is
    not below the median of all trials at that rung; ``stop=False`` lets every trial finish.
    """
    done: list[Trial] = []
    at_rung: list[list[float]] = [[] for _ in range(rungs)]
    while len(done) < trials:
        numbers = range(len(done), min(trials, len(done) + batch))
        now = [Trial(n, propose(space, done, n, seed) if guided else draw(space, np.random.default_rng((seed, n)))) for n in numbers]
        active = now
        for rung in range(rungs):
            for trial, score in zip(active, evaluate(active, rung) if active else ()):
                trial.scores.append(float(score) if math.isfinite(score) else -math.inf)
            at_rung[rung] += [t.value for t in active]
            if stop and rung + 1 < rungs and len(at_rung[rung]) >= LEAST_AT_RUNG:
                limit = float(np.median(at_rung[rung]))
                for t in active:
                    t.stopped = t.value < limit
                active = [t for t in active if not t.stopped]
        done += now
    return done


def best(trials: Sequence[Trial]) -> Trial:
    """The finished trial with the greatest mean; the first one on ties."""
    return max((t for t in trials if not t.stopped), key=lambda t: (t.value, -t.number))
