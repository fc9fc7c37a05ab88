"""Exact Shapley values of tree ensembles, and of the stacked churn model built on them.

A fitted ensemble is read as a table of leaves: per leaf its weighted value and, for every
feature on its path, the interval a row must lie in and the share of training rows
that lie there.  The game is the usual one: a feature that is known follows the row, one that
is not spreads by these shares.  One leaf is a product of its features' terms, so a
feature's Shapley value is a weighted sum of the coefficients of the product of the others,
a polynomial of the path's length; nothing is enumerated or sampled.

Leaves (the size of the model) go to the tasks; rows stay where they are.

The stacked model is logistic in the features and its base scores.  On the log-odds scale
the linear part of a feature is ``coef * (x - mean)``.  A base score shares its own
``coef * (p - p at base)`` out over the features by their Shapley values: forests are averages of
probabilities and need nothing more; a boosted margin goes through a logistic link, and its
values are scaled by (p - p at base) / (margin - margin at base).  Base and
contributions sum to the log-odds of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators.churn import ID, StackedModel
from stockroom.session import ScratchTable, forget_folder, scratch_path

CELLS_AT_ONCE = 1 << 20


@dataclass
class Leaves:
    """Leaves of all trees; paths of fewer features are filled with terms that change nothing."""

    value: np.ndarray  # (leaves,) tree weight x prediction
    feature: np.ndarray  # (leaves, depth)
    low: np.ndarray  # a row follows where low < x <= high
    high: np.ndarray
    share: np.ndarray  # training rows that follow, of those that reach the splits of the feature
    logistic: bool  # whether the sum is the margin of a boosted classifier

    def base(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())

    def followed(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves, depth): a missing value goes right at every split."""

        at = x[:, self.feature]
        return np.where(np.isnan(at), np.isposinf(self.high), (at > self.low) & (at <= self.high))

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the trees and its Shapley values, a row per row of ``x``."""

        depth = self.feature.shape[1]
        out, total = np.zeros(x.shape), np.zeros(len(x))
        weight = [factorial(s) * factorial(depth - 1 - s) / factorial(depth) for s in range(depth)]
        columns = [(self.feature[:, i, None] == np.arange(x.shape[1])).astype(float) for i in range(depth)]
        step = max(1, CELLS_AT_ONCE // max(1, self.feature.size))
        for start in range(0, len(x), step):
            rows = slice(start, start + step)
            follows = self.followed(x[rows]).astype(float)
            total[rows] = follows.prod(axis=2) @ self.value
            for i in range(depth):
                known = [np.ones(follows.shape[:2])]  # coefficients by the number of known features
                for j in range(depth):
                    if j != i:
                        spread, follow = self.share[:, j], follows[:, :, j]
                        known = [(known[s] * spread if s < len(known) else 0) + (known[s - 1] * follow if s else 0) for s in range(len(known) + 1)]
                gain = self.value * (follows[:, :, i] - self.share[:, i]) * sum(w * k for w, k in zip(weight, known, strict=True))
                out[rows] += gain @ columns[i]
        return total, out

    def probability(self, total):
        return 1 / (1 + np.exp(-2 * total)) if self.logistic else total

    def base_score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The learner's probability and how its features move it from ``probability(base())``."""

        total, parts = self.contributions(x)
        if not self.logistic:
            return total, parts
        base = self.base()
        p0 = self.probability(base)
        moved, p = total - base, self.probability(total)
        flat = np.abs(moved) < 1e-12
        slope = np.where(flat, 2 * p0 * (1 - p0), (p - p0) / np.where(flat, 1, moved))
        return p, parts * slope[:, None]


def leaves_of(model) -> Leaves:
    """Leaves of a fitted Spark gradient-boosted or random-forest classifier, from its node table."""

    spark = SparkSession.active()
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    nodes: dict[int, dict[int, tuple]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():  # a row per node of the model
        node = row.nodeData
        nodes.setdefault(row.treeID, {})[node.id] = node
    weights = list(model.treeWeights)
    forget_folder(spark, path)
    logistic = "GBT" in type(model).__name__
    found = []
    for tree, weight in enumerate(weights):
        todo = [(0, {})]
        while todo:
            number, path_ = todo.pop()
            node = nodes[tree][number]
            if node.leftChild < 0:
                stats = node.impurityStats
                value = node.prediction if logistic else stats[1] / sum(stats)
                found.append((weight * value / (1 if logistic else sum(weights)), path_))
                continue
            if node.split.numCategories != -1:
                raise ValueError("splits over categories are not covered")
            at, feature = node.split.leftCategoriesOrThreshold[0], node.split.featureIndex
            for child, left in ((node.leftChild, True), (node.rightChild, False)):
                low, high, share = path_.get(feature, (-np.inf, np.inf, 1.0))
                share *= nodes[tree][child].rawCount / node.rawCount
                todo.append((child, path_ | {feature: (low, min(high, at), share) if left else (max(low, at), high, share)}))
    depth = max(1, max(len(p) for _, p in found))
    empty = (0, -np.inf, np.inf, 1.0)
    cells = [[*((f, *term) for f, term in p.items()), *[empty] * (depth - len(p))] for _, p in found]
    feature, low, high, share = (np.array([[c[k] for c in row] for row in cells]) for k in range(4))
    return Leaves(np.array([v for v, _ in found]), feature.astype(int), low, high, share, logistic)


def churn_contributions(model: StackedModel, df: DataFrame) -> DataFrame:
    """(customer_id, log_odds, base_log_odds, contributions) of every row; one contribution per model feature.

    ``base_log_odds`` is the model at the mean of every feature of ``df`` and the base of its learners.
    A null feature is missing, as in scoring; the linear part of a missing value is missing too.
    """

    features = model.features
    means = df.agg(*(F.avg(F.col(f"`{f}`").cast("double")).alias(f"m{n}") for n, f in enumerate(features))).first()
    mean = np.array([m if m is not None else 0.0 for m in means])
    coefficients = np.array([float(c) for c in model.meta.coefficients])
    learners = [leaves_of(m) for m in model.base_models]
    of_base, of_feature = coefficients[: len(learners)], coefficients[len(learners) :]
    base = float(model.meta.intercept) + float(of_feature @ mean) + sum(float(c * m.probability(m.base())) for c, m in zip(of_base, learners, strict=True))
    shared = df.sparkSession.sparkContext.broadcast((learners, of_base, of_feature, mean, base))

    def explain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners, of_base, of_feature, mean, base = shared.value
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_pylist(), float).reshape(batch.num_rows, len(mean))
            parts = of_feature * (x - mean)
            for coefficient, learner in zip(of_base, learners, strict=True):
                parts = parts + coefficient * learner.base_score(x)[1]
            rows = pa.array(list(parts), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base + parts.sum(axis=1)), pa.array(np.full(len(x), base)), rows], names=[ID, "log_odds", "base_log_odds", "contributions"])

    numbers = F.array(*(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features))
    kind = df.schema[ID].dataType.simpleString()
    return df.select(ID, numbers.alias("x")).mapInArrow(explain_rows, f"{ID} {kind}, log_odds double, base_log_odds double, contributions array<double>")


def explain(model: StackedModel, df: DataFrame) -> DataFrame:
    """(feature, mean_abs_contribution, base_value) over all rows, log-odds scale."""

    rows = churn_contributions(model, df)
    means = [F.avg(F.abs(F.col("contributions")[n])).alias(f"c{n}") for n in range(len(model.features))]
    one = ScratchTable(rows.agg(*means, F.max("base_log_odds").alias("base_value")), "explanation").df
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"c{n}").alias("mean_abs_contribution")) for n, f in enumerate(model.features)))
    return one.select(F.inline(cells), "base_value")
