"""The distributions: how to draw from them, and where they have one, the distribution function and its inverse.

Parameters: zero(), exponential(rate), normal(mean, standard deviation), poisson(mean), uniform(low, high).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


@dataclass(frozen=True)
class Distribution:
    """`draw` (generator, parameters, n), `mean`, and for what can be inverted `cdf` and `icdf` (value, parameters).
    `discrete` ones have mass at single points."""

    parameters: int
    draw: Callable
    mean: Callable
    cdf: Callable | None = None
    icdf: Callable | None = None
    discrete: bool = False


def _poisson_cdf(x: float, p: list[float]) -> float:
    if x < 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    term = total = math.exp(-p[0])
    for k in range(1, int(math.floor(x)) + 1):
        term *= p[0] / k
        total += term
    return min(1.0, total)


def _normal_cdf(x: float, p: list[float]) -> float:
    return 0.5 * math.erfc((p[0] - x) / (p[1] * math.sqrt(2))) if math.isfinite(x) else float(x > 0)


def _normal_icdf(u: float, p: list[float]) -> float:
    return -math.inf if u <= 0 else math.inf if u >= 1 else p[0] + p[1] * _NORMAL.inv_cdf(u)


DISTRIBUTIONS: dict[str, Distribution] = {
    "zero": Distribution(0, lambda g, p, n: np.zeros(n), lambda p: 0.0, discrete=True),
    "exponential": Distribution(1, lambda g, p, n: g.exponential(1 / p[0], n), lambda p: 1 / p[0], lambda x, p: 1 - math.exp(-p[0] * x) if x > 0 else 0.0, lambda u, p: -math.log1p(-u) / p[0] if u < 1 else math.inf),
    "normal": Distribution(2, lambda g, p, n: g.normal(p[0], p[1], n), lambda p: p[0], _normal_cdf, _normal_icdf),
    "poisson": Distribution(1, lambda g, p, n: g.poisson(p[0], n).astype(float), lambda p: p[0], _poisson_cdf, discrete=True),
    "uniform": Distribution(2, lambda g, p, n: g.uniform(p[0], p[1], n), lambda p: (p[0] + p[1]) / 2, lambda x, p: min(1.0, max(0.0, (x - p[0]) / (p[1] - p[0]))), lambda u, p: p[0] + u * (p[1] - p[0])),
}


def generator(seed: int, variable: int, sub: int = 0) -> np.random.Generator:
    """The stream of a variable: the same seed and variable always give the same values, in any task."""
    mask = 2**64 - 1
    return np.random.Generator(np.random.Philox(key=((seed & mask) << 64 | variable & mask), counter=sub << 192 if sub else 0))


def draws(dist: str, params: list[float], seed: int, variable: int, n: int, sub: int = 0) -> np.ndarray:
    """`n` values of a variable."""
    return DISTRIBUTIONS[dist].draw(generator(seed, variable, sub), params, n)
