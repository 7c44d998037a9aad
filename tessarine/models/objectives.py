"""Training losses of positive scores (n) and their negatives (n, k), and penalties of vectors, on the tape.

Pointwise losses take every score with its label, pairwise ones each positive with each of its negatives, setwise ones
a positive with all of its negatives. ``reduction`` is the mean or the sum of the terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import tape
from .tape import Value

_ACTIVATION = {"relu": tape.relu, "softplus": tape.softplus}


@dataclass(frozen=True)
class Loss:
    """``kind``: pointwise (terms of scores and labels), pairwise (of positive and negative scores) or setwise (of both)."""

    kind: str
    terms: Callable[..., Value]
    settings: dict[str, object] = field(default_factory=dict)


def _bce(x, y, pos_weight=1.0):
    return pos_weight * (y * tape.softplus(-x)) + (1 - y) * tape.softplus(x)


def _mse(x, y):
    return (x - y) ** 2


def _delta(x, y, margin=0.0, activation="softplus"):
    return _ACTIVATION[activation](margin - (2 * y - 1) * x)


def _double(x, y, positive_margin=1.0, negative_margin=0.5, balance=0.5, activation="relu"):
    act = _ACTIVATION[activation]
    return balance * (y * act(positive_margin - x)) + (1 - balance) * ((1 - y) * act(negative_margin + x))


def _after_sigmoid(x, y):
    p = tape.sigmoid(x)
    return -(y * tape.log(tape.maximum(p, 1e-44)) + (1 - y) * tape.log(tape.maximum(1 - p, 1e-44)))


def _focal(x, y, gamma=2.0, alpha=None):
    right = y * tape.sigmoid(x) + (1 - y) * tape.sigmoid(-x)
    out = (1 - right) ** gamma * _bce(x, y)
    return out if alpha is None else out * (alpha * y + (1 - alpha) * (1 - y))


def _margin(p, n, margin=1.0, activation="relu"):
    return _ACTIVATION[activation](n - p + margin)


def _entropy(p, n, margin=0.0, temperature=1.0):
    own, other = (p - margin) / temperature, n / temperature
    return tape.log_sum_exp(tape.concat([own.reshape(*own.shape, 1), other])) - own


def _adversarial(p, n, margin=0.0, temperature=1.0):
    """The negatives' weights are not differentiated."""
    weigh = tape.softmax(n * temperature).x
    return 0.5 * (tape.softplus(-(p + margin)) + (tape.softplus(n + margin) * weigh).sum(-1))


#: Every loss by name.
LOSSES: dict[str, Loss] = {
    "bce": Loss("pointwise", _bce),
    "bce_after_sigmoid": Loss("pointwise", _after_sigmoid),
    "mse": Loss("pointwise", _mse),
    "pointwise_hinge": Loss("pointwise", _delta, {"margin": 1.0, "activation": "relu"}),
    "soft_pointwise_hinge": Loss("pointwise", _delta, {"margin": 1.0}),
    "softplus": Loss("pointwise", _delta),
    "double_margin": Loss("pointwise", _double),
    "focal": Loss("pointwise", _focal),
    "margin_ranking": Loss("pairwise", _margin),
    "soft_margin_ranking": Loss("pairwise", _margin, {"activation": "softplus"}),
    "pairwise_logistic": Loss("pairwise", _margin, {"margin": 0.0, "activation": "softplus"}),
    "cross_entropy": Loss("setwise", _entropy),
    "infonce": Loss("setwise", _entropy, {"margin": 0.02, "temperature": 0.05}),
    "nssa": Loss("setwise", _adversarial, {"margin": 9.0}),
    "adversarial_bce": Loss("setwise", _adversarial),
}


def smoothed(y: np.ndarray, epsilon: float, classes: int = 2) -> np.ndarray:
    return (1 - epsilon) * y + epsilon / (classes - 1) * (1 - y)


def loss_of(name: str, positive: Value, negative: Value, weights: np.ndarray | None = None, smoothing: float = 0.0, reduction: str = "mean", **settings) -> Value:
    """The reduced loss of positive scores (n) and negative scores (n, k); ``weights`` of the positives hold for their negatives too.

    Smoothing is for pointwise losses only, and weights aren't for pairwise ones; asking for them raises ValueError.
    """
    loss = LOSSES[name]
    chosen = loss.settings | settings
    if smoothing and loss.kind != "pointwise":
        raise ValueError(f"{name} has no labels to smooth")
    if weights is not None and loss.kind == "pairwise":
        raise ValueError(f"{name} takes no weights")
    if loss.kind == "pointwise":
        scores = tape.concat([positive.reshape(-1), negative.reshape(-1)])
        y = smoothed(np.concatenate([np.ones(positive.x.size), np.zeros(negative.x.size)]), smoothing)
        terms = loss.terms(scores, y, **chosen)
        w = None if weights is None else np.concatenate([weights, np.repeat(weights, negative.shape[-1])])
    else:
        p = positive.reshape(*positive.shape, 1) if loss.kind == "pairwise" else positive
        terms, w = loss.terms(p, negative, **chosen), weights
    if w is not None:
        return (terms * w).sum() / (float(np.sum(w)) if reduction == "mean" else 1.0)
    return terms.mean() if reduction == "mean" else terms.sum()


def lp(v: Value, p: float = 2.0) -> Value:
    return tape.norm(v, p).mean()


def power_sum(v: Value, p: float = 2.0) -> Value:
    return tape.norm(v, p, power=True).mean()


def norm_limit(v: Value, p: float = 2.0, most: float = 1.0) -> Value:
    return tape.relu(tape.norm(v, p, power=True) - most).sum()


def orthogonality(a: Value, b: Value, epsilon: float = 1e-5) -> Value:
    """How far the squared cosine of each pair of vectors is above ``epsilon``."""
    size = (a * a).sum(-1) * (b * b).sum(-1)
    return tape.relu((a * b).sum(-1) ** 2 / tape.maximum(size, 1e-24) - epsilon).sum()


#: Penalties of one table of vectors.
PENALTIES: dict[str, Callable[..., Value]] = {"lp": lp, "power_sum": power_sum, "norm_limit": norm_limit}


def combined(v: Value, shares: dict[str, float], total: float = 1.0) -> Value:
    """A weighted mean of penalties, times ``total``."""
    scale = total / sum(shares.values())
    out = Value(0.0)
    for name, share in shares.items():
        out = out + PENALTIES[name](v) * (scale * share)
    return out
