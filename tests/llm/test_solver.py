"""The classifier's solver against another one, and its memory."""

import tracemalloc

import numpy as np

from palimpsest.llm import quality
from palimpsest.llm.quality import FEATURES, Rows, dual_coordinate_descent, fit_rows, log_count_ratio, packed


def some_rows(n, most, seed=3):
    rng = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 3 == 0, 1.0, -1.0)
    good, bad = rng.permutation(FEATURES)[:most], rng.permutation(FEATURES)[:most]
    return [packed(np.unique(np.concatenate((rng.choice(good if s > 0 else bad, most // 2), rng.integers(0, FEATURES, most // 2))))) for s in y], y


def objective(w, b, x, y, cost):
    return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()


def test_dual_coordinate_descent_like_a_plain_solver():
    """Projected gradient ascent on the whole dual, with dense matrices."""
    found, y = some_rows(50, 60)
    y[:6] *= -1  # not separable
    rows, own = Rows(found), np.arange(50)
    scale = log_count_ratio(rows, own, y)
    cost = np.where(y > 0, 3.0, 1.5)
    w, b = dual_coordinate_descent(rows, own, scale, y, cost, epochs=3000)
    x = np.zeros((50, FEATURES))
    for i in own:
        x[i, rows[i]] = scale[rows[i]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = (x @ x.T + 1) * np.outer(y, y)
    alpha, rate = np.zeros(50), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, cost)
    plain, shift = (alpha * y) @ x, alpha @ y
    ours, theirs = objective(w, b, x, y, cost), objective(plain, shift, x, y, cost)
    assert ours <= theirs * 1.001 + 1e-6 and np.allclose(w, plain, atol=2e-3) and abs(b - shift) < 2e-2
    # The gap between primal and dual is closed.
    assert objective(plain, shift, x, y, cost) - (alpha.sum() - alpha @ q @ alpha / 2) < 1e-3 * theirs


def test_budget_changes_memory_alone(monkeypatch):
    found, y = some_rows(400, 20_000)
    whole = fit_rows(Rows(found), y)
    tracemalloc.start()
    thrifty = fit_rows(Rows(found, budget=1 << 20), y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole.weights == thrifty.weights).all() and whole.curve == thrifty.curve
    assert peak < 24 << 20 < sum(4 * len(quality.unpacked(f)) for f in found)
