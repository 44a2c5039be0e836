import numpy as np
import pytest

from strandloom.llm import pitman_yor as py


def exact(c, level, others, parent):
    """The law of the tables of a dish, by the recurrence of the generalised Stirling numbers."""
    d, s = py.DISCOUNT[level], py.STRENGTH[level]
    log = np.full(c + 2, -np.inf)
    log[1] = 0.0
    t = np.arange(1, c + 1)
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            log[1:-1] = np.logaddexp(log[:-2], np.log(np.maximum(n - t * d, 0)) + log[1:-1])
    p = log[1:-1] + np.cumsum(np.log(s + d * (others + t - 1.0)) + np.log(parent))
    p = np.exp(p - p.max())
    return p / p.sum()


@pytest.mark.parametrize("c", [129, 1000])
@pytest.mark.parametrize(("level", "others", "parent"), [(0, 1000, 0.001), (0, 20000, 0.001), (0, 0, 0.999), (1, 20000, 0.001), (1, 500, 0.01), (0, 100000, 0.1)])
def test_large_dishes_follow_the_same_conditional(c, level, others, parent):
    law, n = exact(c, level, others, parent), 4000
    got = py._tables(np.full(n, c), np.ones(n, int), level, np.full(n, others + 1.0), np.full(n, parent), np.random.default_rng(0))
    t = np.arange(1, c + 1)
    mean = law @ t
    assert got.mean() == pytest.approx(mean, abs=5 * np.sqrt(law @ (t - mean) ** 2 / n) + 1e-9)
    assert np.abs(np.cumsum(np.bincount(got, minlength=c + 1)[1:] / n) - np.cumsum(law)).max() < 0.03


@pytest.mark.parametrize("level", [0, 1])
def test_integral_gives_stirling_numbers(level):
    d, c = py.DISCOUNT[level], py.STIRLING
    t = np.arange(1, c - 2, 4)
    got = py.log_stirling(np.full(len(t), c), t, 4, d)
    at = t[:, None] + np.arange(4)
    factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, c + 1)))]
    assert np.abs(got + factorial[c] - factorial[at] - at * np.log(d) - py.stirling(level)[c, at]).max() < 1e-7
