"""Tree Shapley values against enumeration of subsets; the model store's round trip and its checks."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stockroom.operators import churn, tree_shapley
from stockroom.session import ensure_checkpoint_dir, scratch_path
from stockroom.sinks import model_store, writers

FEATURES = ["a", "b", "c", "d", "e", "f g"]  # a name with a space too


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 6)).round(1)
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=240) / 2 > 0).astype(int)
    rows = [(f"c{i}", int(y), *map(float, r)) for i, (r, y) in enumerate(zip(x, label, strict=True))]
    rows[0] = (rows[0][0], rows[0][1], None, *rows[0][3:])
    return spark.createDataFrame(rows, "customer_id string, churn_label int, " + ", ".join(f"`{f}` double" for f in FEATURES))


def enumerated(leaves, x):
    """Shapley values of one row by all subsets of features."""

    def worth(known):
        inside = leaves.followed(x[None])[0]
        return (leaves.value * np.where(np.isin(leaves.feature, list(known)), inside, leaves.share).prod(axis=1)).sum()

    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for some in combinations(others, size):
                out[i] += factorial(size) * factorial(n - 1 - size) / factorial(n) * (worth({*some, i}) - worth(some))
    return out


@pytest.mark.parametrize(("kind", "options"), [(GBTClassifier, {"maxIter": 6, "maxDepth": 4}), (RandomForestClassifier, {"numTrees": 5, "maxDepth": 5})])
def test_equals_enumeration_and_spark_scores(customers, kind, options):
    learner = kind(seed=1, labelCol="churn_label", **options)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(customers)
    model = learner.fit(data.where("a is not null"))
    leaves = tree_shapley.leaves_of(model)
    rows = model.transform(data).collect()
    x = np.array([[np.nan if row[f] is None else row[f] for f in FEATURES] for row in rows])
    total, parts = leaves.contributions(x)
    assert np.allclose(leaves.probability(total), [row.probability[1] for row in rows], atol=1e-9)
    assert np.allclose(parts.sum(axis=1), total - leaves.base(), atol=1e-9)
    for n in range(0, 240, 40):
        assert np.allclose(parts[n], enumerated(leaves, x[n]), atol=1e-9)
    p, shared = leaves.base_score(x)
    assert np.allclose(shared.sum(axis=1), p - leaves.probability(leaves.base()), atol=1e-9)


@pytest.mark.parametrize("kind", ["fallback", "two"])
def test_stack_contributions_sum_to_score_and_store_keeps_scores(spark, customers, kind):
    whole = customers.where("a is not null")
    model = churn.fit_stacked(whole, kind=kind, max_iter=4, folds=2)
    score = {r.customer_id: r.churn_probability for r in churn.predict(model, whole).collect()}
    for r in tree_shapley.churn_contributions(model, whole).collect():
        assert np.isclose(r.log_odds, r.base_log_odds + sum(r.contributions), atol=1e-9)
        assert np.isclose(1 / (1 + np.exp(-r.log_odds)), score[r.customer_id], atol=1e-9)
    summary = tree_shapley.explain(model, whole).collect()
    assert [r.feature for r in summary] == FEATURES and all(r.mean_abs_contribution >= 0 for r in summary)

    path = model_store.save(model, scratch_path(spark, "store-test"))
    again = {r.customer_id: r.churn_probability for r in churn.predict(model_store.load(path), whole).collect()}
    assert again == score
    model_store.save(model, path)  # an earlier one is replaced
    assert model_store.load(path).features == FEATURES


def test_store_finds_damage_and_loads_single_models(spark, customers):
    data = VectorAssembler(inputCols=FEATURES[1:], outputCol="features").transform(customers)
    model = RandomForestClassifier(numTrees=2, labelCol="churn_label", seed=3).fit(data)
    path = model_store.save(model, scratch_path(spark, "store-test"))
    assert model_store.load(path).toDebugString == model.toDebugString
    assert writers.load_model(f"{path}/parts/0").toDebugString == model.toDebugString
    data.limit(3).select(F.lit("x").alias("value")).coalesce(1).write.mode("append").text(f"{path}/parts/0/data")
    with pytest.raises(ValueError, match="manifest"):
        model_store.load(path)
    assert ensure_checkpoint_dir(spark) in path
