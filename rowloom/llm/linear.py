"""Logistic regression on screened hashed features, for bounded training samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

FEATURES = 1 << 20
SCREENED = 256
RIDGE = 0.05
ROUNDS = 30
COUNTED = 500


@dataclass(frozen=True)
class Model:
    """Weights of hashed features, of earlier probabilities, and the bias."""

    weights: dict[int, float] = field(default_factory=dict)
    earlier: tuple[float, ...] = ()
    bias: float = -np.inf

    def score(self, features: np.ndarray, earlier: tuple[float, ...] = ()) -> float:
        if np.isinf(self.bias):  # one label value only was seen
            return float(self.bias > 0)
        known = self.weights
        z = self.bias + sum(known[f] for f in features.tolist() if f in known)
        return float(1 / (1 + np.exp(-np.clip(z + sum(w * p for w, p in zip(self.earlier, earlier, strict=True)), -500, 500))))


def screen(rows: list[np.ndarray], labels: np.ndarray, keep: int = SCREENED) -> np.ndarray:
    """The features with the highest chi-square against the labels; each row holds a feature once."""
    inside, seen = np.zeros(FEATURES), np.zeros(FEATURES)
    # Some rows at a time: the counts need working copies of all features they look at.
    for start in range(0, len(rows), COUNTED):
        some = rows[start : start + COUNTED]
        every = np.concatenate(some)
        weights = np.repeat(labels[start : start + COUNTED], [len(r) for r in some])
        inside += np.bincount(every, weights=weights, minlength=FEATURES)
        seen += np.bincount(every, minlength=FEATURES)
    n, positive = float(len(rows)), float(labels.sum())
    spread = seen * (n - seen) * positive * (n - positive)
    chi = np.divide(n * (inside * n - seen * positive) ** 2, spread, out=np.zeros(FEATURES), where=spread > 0)
    best = np.argsort(-chi, kind="stable")[:keep]
    return best[(chi[best] > 0) & (seen[best] > 1)]


def train(rows: list[np.ndarray], labels: np.ndarray, earlier: np.ndarray | None = None) -> Model:
    """Ridge logistic regression by Newton steps; a constant where one label value only is seen (none: 0)."""
    extra = earlier if earlier is not None else np.zeros((len(rows), 0))
    blank = (0.0,) * extra.shape[1]
    if not len(rows) or labels.min() == labels.max():
        return Model(earlier=blank, bias=np.inf if len(rows) and labels[0] == 1 else -np.inf)
    chosen = screen(rows, labels)
    column = np.full(FEATURES, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)))
    for at, features in enumerate(rows):
        hit = column[features]
        x[at, hit[hit >= 0]] = 1
    x = np.hstack([x, extra, np.ones((len(rows), 1))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    k = len(chosen)
    return Model({int(f): float(v) for f, v in zip(chosen, w[:k], strict=True)}, tuple(w[k:-1].tolist()), float(w[-1]))


def train_chain(rows: list[np.ndarray], labels: list[np.ndarray], fold: np.ndarray, folds: int) -> list[Model]:
    """One model per category; later ones are fed the earlier probabilities, each out of its fold."""
    models: list[Model] = []
    earlier = np.zeros((len(rows), 0))
    for at, label in enumerate(labels):
        models.append(train(rows, label, earlier))
        if at + 1 == len(labels):
            break
        out = np.zeros(len(rows))
        for k in range(folds):
            here, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            model = train([rows[i] for i in rest], label[rest], earlier[rest])
            out[here] = [model.score(rows[i], tuple(earlier[i])) for i in here]
        earlier = np.column_stack([earlier, out])
    return models


def chained(models: list[Model], features: np.ndarray) -> tuple[float, ...]:
    """The probabilities of all categories, each fed the ones before it."""
    found: tuple[float, ...] = ()
    for model in models:
        found += (model.score(features, found),)
    return found


def hashed(terms, code: Callable[[bytes], int]) -> np.ndarray:
    """Distinct feature numbers of some terms."""
    return np.unique(np.fromiter(map(code, terms), np.int64) & (FEATURES - 1)).astype(np.int32)
