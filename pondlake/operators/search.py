"""ML-13: the next trial of a Bayesian search.

A Gaussian process over the unit cube of the search space (log scale for log-uniform
dimensions, one coordinate a category) is fitted to the trials' scores; the next trial
is the candidate with the greatest expected improvement. The trials, a few dozen rows,
are all it sees; the data stays in the trials' own Spark jobs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

import numpy as np

#: Seeded random trials before the first proposal.
FIRST_TRIALS = 4
#: Candidates drawn for a proposal; half as many again are drawn near the best trial.
CANDIDATES = 1000


def _draw(space: Mapping[str, Mapping], u: Sequence[float]) -> dict:
    """A point of the space from one number of [0, 1) a dimension."""
    out = {}
    for (name, s), x in zip(space.items(), u):
        if s["type"] == "Categorical":
            options = list(s["categories"])
            out[name] = options[int(x * len(options))]
            continue
        low, high = float(s["low"]), float(s["high"])
        if s["type"] == "Integer":
            out[name] = int(low) + int(x * (int(high) - int(low) + 1))
        elif s["type"] == "Real":
            log = s.get("prior") == "log-uniform"
            out[name] = low * (high / low) ** x if log else low + (high - low) * x
        else:
            raise ValueError(f"unknown space type {s['type']!r}")
    return out


def _place(space: Mapping[str, Mapping], point: Mapping) -> list[float]:
    """Coordinates of a point: [0, 1] a number, one coordinate a category."""
    out: list[float] = []
    for name, s in space.items():
        v = point[name]
        if s["type"] == "Categorical":
            out += [0.35 * (v == c) for c in s["categories"]]  # half a range apart
            continue
        low, high = float(s["low"]), float(s["high"])
        if high == low:
            out.append(0.0)
        elif s.get("prior") == "log-uniform":
            out.append(math.log(v / low) / math.log(high / low))
        else:
            out.append((v - low) / (high - low))
    return out


def _kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """Matern 5/2."""
    d = np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0)) * math.sqrt(5) / length
    return (1 + d + d * d / 3) * np.exp(-d)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Length scale and noise of the greatest likelihood, by a grid."""
    best = None
    for length in (0.1, 0.2, 0.4, 0.8, 1.6):
        k = _kernel(x, x, length)
        for noise in (1e-4, 1e-2, 1e-1):
            low = np.linalg.cholesky(k + noise * np.eye(len(x)))
            solved = np.linalg.solve(low.T, np.linalg.solve(low, y))
            likelihood = -0.5 * y @ solved - np.log(np.diag(low)).sum()
            if best is None or likelihood > best[0]:
                best = (likelihood, length, low, solved)
    return best[1:]


def propose(space: Mapping[str, Mapping], points: Sequence[Mapping], scores: Sequence[float], seed: int) -> dict:
    """The next point to try, larger scores being better. The same trials and seed
    give the same point. Scores that are not finite count as the least finite one."""
    rng = random.Random(f"{seed}:{len(points)}")
    draw = lambda: [rng.random() for _ in space]
    finite = [s for s in scores if math.isfinite(s)]
    if len(points) < FIRST_TRIALS or not finite:
        return _draw(space, draw())
    y = np.array([s if math.isfinite(s) else min(finite) for s in scores])
    y = (y - y.mean()) / (y.std() or 1.0)
    x = np.array([_place(space, p) for p in points])
    length, low, solved = _fit(x, y)

    top = points[int(y.argmax())]
    candidates = [_draw(space, draw()) for _ in range(CANDIDATES)]
    for _ in range(CANDIDATES // 2):  # near the best trial: some dimensions drawn again or moved a little
        near = dict(top)
        for (name, s), u in zip(space.items(), draw()):
            if rng.random() < 0.5:
                if s["type"] != "Categorical":
                    here = _place({name: s}, top)[0]
                    u = min(max(here + 0.1 * rng.gauss(0, 1), 0.0), 1 - 1e-9)
                near[name] = _draw({name: s}, [u])[name]
        candidates.append(near)
    at = np.array([_place(space, p) for p in candidates])
    cross = _kernel(at, x, length)
    mean = cross @ solved
    half = np.linalg.solve(low, cross.T)
    spread = np.sqrt(np.maximum(1 - (half ** 2).sum(axis=0), 1e-12))
    z = (mean - y.max() - 0.01) / spread
    normal = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    return candidates[int((spread * (z * below + normal)).argmax())]
