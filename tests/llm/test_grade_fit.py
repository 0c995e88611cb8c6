"""The ordinal fit against direct evaluation: likelihood, gradient and tails."""

import math
import random

import numpy as np
import pytest

from aerolith.llm import quality_grade
from aerolith.llm.quality_grade import Ordinal, features


def direct_loss(weights, cuts, rows, grades, cost, decay):
    """The mean weighted negative log-likelihood and the penalty, in plain loops."""
    total = 0.0
    for row, g, c in zip(rows, grades, cost, strict=True):
        score = sum(weights[s] * v for s, v in row)
        tail = [1.0] + [1 / (1 + math.exp(-(score - t))) for t in cuts] + [0.0]
        total -= c * math.log(tail[g] - tail[g + 1])
    return total / len(rows) + decay / 2 * sum(w * w for w in weights)


@pytest.mark.parametrize("grades", [3, 4])
def test_gradient_and_likelihood(grades):
    rng = random.Random(grades)
    rows = [[(s, rng.random()) for s in rng.sample(range(6), 3)] for _ in range(25)]
    y = np.array([rng.randrange(grades) for _ in rows])
    cost = np.array([rng.uniform(0.5, 2) for _ in rows])
    p = np.array([rng.uniform(-1, 1) for _ in range(6 + 1 + grades - 2)])
    slots, values = np.array([s for r in rows for s, _ in r]), np.array([v for r in rows for _, v in r])
    owner = np.repeat(np.arange(len(rows)), 3)

    def direct(q):
        cuts = q[6] + np.concatenate([[0.0], np.cumsum(np.exp(q[7:]))])
        return direct_loss(q[:6], cuts, rows, y, cost, 0.1)

    loss, grad = quality_grade.loss_and_gradient(p, 6, slots, values, owner, y, cost, 0.1)
    assert loss == pytest.approx(direct(p))
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        assert grad[k] == pytest.approx((direct(p + step) - direct(p - step)) / 2e-6, abs=1e-5)


def test_tails_are_sigmoids_of_ordered_thresholds():
    model = Ordinal(4)
    model.first, model.gaps = -0.5, np.array([0.1, -0.7])
    cuts = [-0.5, -0.5 + math.exp(0.1), -0.5 + math.exp(0.1) + math.exp(-0.7)]
    assert model.thresholds().tolist() == pytest.approx(cuts)
    scores = np.array([-2.0, 0.0, 1.3])
    assert model.tails(scores) == pytest.approx(np.array([[1 / (1 + math.exp(-(s - c))) for c in cuts] for s in scores]))


def test_fit_orders_grades():
    rng = random.Random(2)
    texts = [(g, " ".join(rng.choices(["bad", "poor", "noise"] if g == 0 else ["rude", "fine"] if g == 1 else ["good", "fine", "clear"], k=20) + rng.choices(["the", "of", "it"], k=20))) for g in [0, 1, 2] * 60]
    hasher = quality_grade.Hasher()
    rows = [features(t.encode(), hasher) for _, t in texts]
    model = Ordinal().fit(rows, np.array([g for g, _ in texts]))
    score = np.array([v @ model.weights[s] for s, v in rows])
    expected = model.tails(score).sum(1)
    means = [expected[[i for i, (g, _) in enumerate(texts) if g == k]].mean() for k in range(3)]
    assert means[0] < 0.3 and 0.7 < means[1] < 1.3 and means[2] > 1.7
