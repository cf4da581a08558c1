"""The ordinal fit against a plain likelihood and another optimiser, on texts with real grades."""

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.toxicity import _ordinal


def loss(params, texts, grades, counts, words, top, penalty):
    """Mean negative log-likelihood, row by row, and the penalty on the weights."""
    cuts = np.cumsum([params[words], *np.exp(params[words + 1:])])
    total = 0.0
    for held, grade, n in zip(texts, grades, counts):
        score = sum(params[w] for w in held)
        upto = [0.0, *(1 / (1 + np.exp(score - c)) for c in cuts), 1.0]
        total -= n * np.log(max(upto[grade + 1] - upto[grade], 1e-12))
    return (total + penalty / 2 * (params[:words] ** 2).sum()) / counts.sum()


def descend(f, x, steps=300):
    """Quasi-Newton with numeric slopes and halved steps."""
    slope = lambda x: np.array([(f(x + h) - f(x - h)) / 2e-5 for h in 1e-5 * np.eye(len(x))])
    inverse, g = np.eye(len(x)), slope(x)
    for _ in range(steps):
        move, size = -inverse @ g, 1.0
        while f(x + size * move) > f(x) + 1e-4 * size * (g @ move) and size > 1e-9:
            size /= 2
        new = x + size * move
        step, turn = new - x, (after := slope(new)) - g
        if step @ turn > 1e-14:
            rho = 1 / (step @ turn)
            a = np.eye(len(x)) - rho * np.outer(step, turn)
            inverse = a @ inverse @ a.T + rho * np.outer(step, step)
        x, g = new, after
        if np.abs(g).max() < 1e-7:
            break
    return x


def test_fit_reaches_the_likelihood_maximum():
    rng = np.random.default_rng(6)
    words, top = 4, 3
    truth, cuts = np.array([2.0, 1.0, 0.5, 3.0]), np.array([1.0, 2.5, 4.0])
    texts, grades = [], []
    for _ in range(400):
        held = np.flatnonzero(rng.random(words) < 0.4)
        noise = rng.logistic()
        texts.append(held)
        grades.append(int((truth[held].sum() + noise > cuts).sum()))
    grades, counts = np.array(grades), rng.integers(1, 4, 400).astype(float)
    row, which = np.repeat(np.arange(400), [len(t) for t in texts]), np.concatenate(texts)
    weights, thresholds = _ordinal(row, which, grades, counts, words, top)
    f = lambda p: loss(p, texts, grades, counts, words, top, toxicity.PENALTY)
    found = np.concatenate([weights, thresholds[:1], np.log(np.diff(thresholds))])
    best = descend(f, np.concatenate([np.zeros(words), [0.5], np.zeros(top - 1)]))
    assert f(found) <= f(best) + 1e-5
    assert np.allclose(weights, best[:words], atol=0.02) and np.allclose(thresholds, np.cumsum([best[words], *np.exp(best[words + 1:])]), atol=0.02)
    assert (np.diff(thresholds) > 0).all() and np.allclose(weights, truth, atol=0.6)
