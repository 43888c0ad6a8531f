"""Quality scores from a sparse ensemble of rules.

Small boosted trees are grown over text statistics; every path from a root to a node is a
conjunctive rule. A lasso logistic model weighs the rules, most get weight 0, and what is left is
compiled into one Spark column expression over the statistics' columns.

Defined results: a null or empty text has all statistics 0 and is scored like any other; with no
training rows every score is 0.5, and with labels of one kind only that label's share, smoothed.
Null labels and ids teach nothing; rows that repeat are scored each, and count in training as often as they
stand there; a very long text is read whole, in one task; columns other than id and text, of whatever
names, don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .textstats import STATISTICS, with_statistics


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, above, threshold) hold: above means greater, else at most."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, threshold in self.conditions:
            v = x[:, names.index(name)]
            out &= v > threshold if above else v <= threshold
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            out = out & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The probability of label 1, clipped to what a double's exp can hold."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))

    def score(self, x: np.ndarray, names: tuple[str, ...] = STATISTICS) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + np.where(rule.holds(x, names), weight, 0.0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _split(binned: np.ndarray, target: np.ndarray, rows: np.ndarray, features: np.ndarray, bins: int, least: int) -> tuple[int, int] | None:
    """The feature and bin that lower the squared error most, or None."""
    best, gain = None, 1e-9
    total, n = target[rows].sum(), len(rows)
    for f in features:
        b = binned[rows, f]
        count = np.cumsum(np.bincount(b, minlength=bins))[:-1]
        part = np.cumsum(np.bincount(b, weights=target[rows], minlength=bins))[:-1]
        ok = (count >= least) & (n - count >= least)
        if ok.any():
            value = np.where(ok, part**2 / np.maximum(count, 1) + (total - part) ** 2 / np.maximum(n - count, 1), -np.inf) - total**2 / n
            if value.max() > gain:
                gain, best = value.max(), (int(f), int(value.argmax()))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], *, trees: int = 40, depth: int = 3, shrink: float = 0.1, bins: int = 48, seed: int = 11) -> list[Rule]:
    """Rules from all nodes of boosted trees, each grown on half of the rows and two thirds of the statistics."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for v in x.T]
    binned = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x.T, strict=True)], axis=1)
    logit = np.full(len(x), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[Rule, None] = {}
    least = max(5, len(x) // 200)
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-logit))
        sample = rng.permutation(len(x))[: max(2 * least, len(x) // 2)]
        features = rng.permutation(x.shape[1])[: max(1, 2 * x.shape[1] // 3)]
        nodes = [((), sample, np.arange(len(x)))]
        for _ in range(depth):
            below = []
            for path, rows, everything in nodes:
                cut = _split(binned, gradient, rows, features, bins, least) if len(rows) >= 2 * least else None
                if cut is None or cut[1] >= len(edges[cut[0]]):
                    below.append((path, rows, everything))
                    continue
                f, b = cut
                for above in (False, True):
                    own = (*path, (names[f], above, float(edges[f][b])))
                    side = lambda r, f=f, b=b, above=above: r[(binned[r, f] > b) == above]
                    found.setdefault(Rule(own))
                    below.append((own, side(rows), side(everything)))
            nodes = below
        for _, rows, everything in nodes:
            p = 1 / (1 + np.exp(-logit[rows]))
            if len(rows):
                logit[everything] += shrink * 4 * gradient[rows].sum() / max(4 * (p * (1 - p)).sum(), 1.0)
    return list(found)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal gradient with momentum; columns of ``r`` are 0 or 1, the bias isn't penalised."""
    n, m = r.shape
    mean = r.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    z = (r - mean) / scale
    v = np.ones(m)
    for _ in range(20):  # the largest eigenvalue of z'z / n bounds the step
        v = z.T @ (z @ v) / n
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4.0 / (np.linalg.norm(z @ v) ** 2 / n + 1)
    w, u, t = np.zeros(m), np.zeros(m), 1.0
    b = ub = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(z @ u + ub, -30, 30))) - y) / n
        w2 = u - step * (z.T @ g)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = ub - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w / scale, b - float((mean / scale) @ w)


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, *, penalty: float = 0.002, trees: int = 40, depth: int = 3) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble((), (), 0.0)
    if y.min() == y.max():
        return RuleEnsemble((), (), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = grow_rules(x, y, names, trees=trees, depth=depth)
    r = np.stack([rule.holds(x, names) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    distinct = np.unique(r, axis=1, return_index=True)[1] if r.shape[1] else np.zeros(0, int)
    rules, r = [rules[k] for k in sorted(distinct)], r[:, sorted(distinct)]
    if not rules:
        return RuleEnsemble((), (), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    w, b = lasso_logistic(r, y, penalty)
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return RuleEnsemble(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(b))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 12000, **how) -> RuleEnsemble:
    """Fit on the ``sample_rows`` labelled documents whose ids come first in a hash order (the only bound).

    The sample is taken from the labels alone, so only its texts are read and only its statistics
    reach the driver. A document whose labels contradict each other is left out.
    """
    given = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id"))
    given = given.agg(F.min(label).alias("_least"), F.max(label).alias("_label")).where("_least = _label").drop("_least")
    chosen = given.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_of")).join(F.broadcast(chosen), "_id")  # at most sample_rows ids
    got = with_statistics(rows, "_of", ["_label"]).limit(2 * sample_rows).toPandas()  # ids that repeat could bring more rows
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[list(STATISTICS)].to_numpy(float), got["_label"].to_numpy(float), **how)


def score(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", keep: list[str], out: str = "score") -> DataFrame:
    """Columns ``keep`` with the ensemble's probability, from the compiled expression; it replaces a kept column of its name."""
    keep = [c for c in keep if c != out]
    names = [f"c{k}" for k in range(len(keep))]
    counted = with_statistics(numbered(docs, keep, text), f"c{len(keep)}", names)
    return counted.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], model.column().alias(out))
