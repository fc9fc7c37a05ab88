"""Churn: M7-M10, A18, P18, P25, T3.

* M7: deterministic stratified split; per class, rows ordered by
  ``md5(id:seed)`` and the first ``ceil(frac * n_class)`` go to validation.
  Ranks are range-parallel (no single-partition window per class).
* M8: stacked classifier on ``pyspark.ml``: base learners (gradient-boosted
  trees; the shipped fallback path is one GBT) produce out-of-fold scores
  (fold = hash of the id), and a logistic-regression meta learner is trained
  on [base scores + features] (passthrough).
* M9: batch scoring of every customer plus retention actions; AUC when labels
  are present (null when only one class is present).
* M10: ``operators/tree_shapley.py`` explains the whole stack by exact Shapley
  values; ``explain`` here is the linear part on the meta learner's own inputs
  (``coef * (x - mean)``), averaged in absolute value over *all* rows in one aggregate.
* A18: exact ROC AUC by the rank (Mann-Whitney) form with average ranks for
  ties, using integer counts per distinct score.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.ordered import with_global_order
from stockroom.functions.scalar import retention_action

ID, LABEL = "customer_id", "churn_label"
FITS_AT_ONCE = 4  # base learners fitted side by side; each is a Spark job over the same cached table


def feature_columns(df: DataFrame, exclude=(ID, LABEL)) -> list[str]:
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return [f.name for f in df.schema.fields if f.name not in exclude and f.dataType.simpleString() in numeric]


def stratified_split(df: DataFrame, label: str = LABEL, id_col: str = ID, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """M7: adds ``is_valid``: per class, the first ceil(frac * n) rows in md5(id:seed) order."""

    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    ranked = with_global_order(df.withColumn("__h", key), [F.col(label).asc(), F.col("__h").asc(), F.col(id_col).asc()], row_number_col="__grn")
    per_class = ranked.groupBy(label).agg(F.min("__grn").alias("__start"), F.count(F.lit(1)).alias("__n"))
    j = ranked.join(F.broadcast(per_class), label)  # one row per class value
    rank = F.col("__grn") - F.col("__start") + 1
    return j.withColumn("is_valid", rank <= F.ceil(F.lit(test_frac) * F.col("__n"))).drop("__h", "__grn", "__start", "__n")


def roc_auc(scored: DataFrame, label: str = LABEL, score: str = "score") -> DataFrame:
    """One row ``auc`` (null when only one class is present).

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P * N), over distinct
    scores s; ``neg_below`` is a global running sum (range-parallel).
    """

    g = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    run = with_global_order(g, [F.col("s").asc()], row_number_col=None, sum_of=F.col("neg"), running_sum_col="neg_upto")
    big = "decimal(38,0)"
    num = F.sum(F.col("pos").cast(big) * (F.lit(2) * (F.col("neg_upto") - F.col("neg")) + F.col("neg")).cast(big))
    agg = run.agg(num.alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")))
    return agg.select(auc.alias("auc"))


@dataclass
class StackedModel:
    features: list[str]
    base_models: list
    meta: object
    meta_inputs: list[str]


def _assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def _base_learners(kind: str, max_iter: int, seed: int):
    if kind == "fallback":  # the shipped path: one boosted model
        return [GBTClassifier(maxIter=max_iter, maxDepth=3, stepSize=0.1, seed=seed, labelCol=LABEL)]
    return [
        GBTClassifier(maxIter=max_iter, maxDepth=4, stepSize=0.08, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, labelCol=LABEL),
        RandomForestClassifier(numTrees=max(max_iter, 20), maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, labelCol=LABEL),
    ]


def _p1(col: str) -> F.Column:
    return vector_to_array(F.col(col))[1]


def fit_stacked(train: DataFrame, features: list[str] | None = None, kind: str = "fallback", max_iter: int = 100, folds: int = 5, seed: int = 42) -> StackedModel:
    """M8: out-of-fold base scores -> logistic meta learner with passthrough.

    The fits of all learners and folds (and on all rows) are independent and share one cached
    table; ``FITS_AT_ONCE`` of them run side by side, so the stages of one fill the cores that
    another leaves idle.  Every fold's rows pass through its learners' models in a row: no join
    on the id, and a customer who is there twice stays twice.
    """

    features = features or feature_columns(train)
    data = _assemble(train.withColumn(LABEL, F.col(LABEL).cast("double")), features).withColumn(
        "__fold", F.pmod(F.xxhash64(F.col(ID), F.lit(seed)), F.lit(folds))
    ).cache()
    learners = _base_learners(kind, max_iter, seed)

    @inheritable_thread_target(train.sparkSession)
    def fit(task: tuple[int, int | None]):
        b, left_out = task
        rows = data if left_out is None else data.where(F.col("__fold") != left_out)
        return learners[b].copy().setPredictionCol(f"__pred{b}").setProbabilityCol(f"__prob{b}").setRawPredictionCol(f"__raw{b}").fit(rows)

    tasks = [(b, k) for k in [*range(folds), None] for b in range(len(learners))]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        models = dict(zip(tasks, pool.map(fit, tasks), strict=True))
    full = [models[b, None] for b in range(len(learners))]
    oof = None
    for k in range(folds):
        part = _base_scores([models[b, k] for b in range(len(learners))], data.where(F.col("__fold") == k))
        oof = part if oof is None else oof.unionByName(part)
    meta_inputs = [f"base_{b}" for b in range(len(learners))] + features
    meta = LogisticRegression(maxIter=1000, labelCol=LABEL, featuresCol="meta_features").fit(_assemble(oof, meta_inputs, "meta_features"))
    data.unpersist()
    return StackedModel(features, full, meta, meta_inputs)


def _base_scores(models: list, x: DataFrame) -> DataFrame:
    """Adds ``base_<b>``, the score of every base model."""

    for b, m in enumerate(models):
        x = m.transform(x).withColumn(f"base_{b}", _p1(f"__prob{b}")).drop(f"__pred{b}", f"__prob{b}", f"__raw{b}")
    return x


def predict(model: StackedModel, df: DataFrame) -> DataFrame:
    """M9: id, churn_probability, retention_action (P18) for every row."""

    x = _base_scores(model.base_models, _assemble(df, model.features))
    x = _assemble(x.drop("features"), model.meta_inputs, "meta_features")
    scored = model.meta.transform(x).withColumn("churn_probability", _p1("probability"))
    keep = [c for c in (ID, LABEL) if c in df.columns]
    return scored.select(*keep, "churn_probability", retention_action("churn_probability").alias("retention_action"))


def explain(model: StackedModel, df: DataFrame) -> DataFrame:
    """(feature, mean_abs_contribution, base_value) by linear SHAP on the meta learner (log-odds scale)."""

    x = _assemble(df, model.features)
    for b, m in enumerate(model.base_models):
        x = m.transform(x).withColumn(f"base_{b}", _p1(f"__prob{b}"))
    coefs = [float(c) for c in model.meta.coefficients]
    names = model.meta_inputs
    means = x.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).first()
    contrib = [F.avg(F.abs(F.lit(c) * (F.col(n).cast("double") - F.lit(float(means[n] or 0.0))))).alias(n) for n, c in zip(names, coefs)]
    base_value = float(model.meta.intercept) + sum(c * float(means[n] or 0.0) for n, c in zip(names, coefs))
    row = x.agg(*contrib)
    stacked = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs_contribution")) for n in names])
    return row.select(F.inline(stacked)).withColumn("base_value", F.lit(base_value))


def score_adhoc(model: StackedModel, spark, features: dict) -> DataFrame:
    """P25: score one inline feature record under the id ``ad_hoc_customer``."""

    row = {ID: "ad_hoc_customer", **{f: float(features.get(f, 0.0)) for f in model.features}}
    schema = ", ".join([f"{ID} string"] + [f"`{f}` double" for f in model.features])
    return predict(model, spark.createDataFrame([tuple(row[c] for c in [ID, *model.features])], schema))


def retention_radar(scores: DataFrame, k: int = 15, sample_first: int | None = None) -> DataFrame:
    """Highest churn probabilities first.

    Default: a true top-k over all scored customers (TakeOrderedAndProject:
    every task keeps k rows).  ``sample_first=15`` reproduces the reference's
    dashboard, which scores only the first 15 customers (by id) and sorts them.
    """

    if sample_first is not None:
        scores = scores.orderBy(F.col(ID)).limit(sample_first)
    return scores.orderBy(F.col("churn_probability").desc(), F.col(ID)).limit(k)


def permutation_importance(model: StackedModel, df: DataFrame, features: list[str] | None = None, buckets: int | None = None, seed: int = 42) -> DataFrame:
    """M10 (whole stack): AUC drop when one feature is permuted, per feature.

    The permutation is a cyclic shift of the feature inside hash buckets of the
    id (rows ordered by a second hash): a window partitioned by a uniform hash
    bucket, so no bucket is hot, and the result is deterministic.  One pass
    (score + exact AUC) per feature.
    """

    from pyspark.sql import Window

    spark = df.sparkSession
    n_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    features = features or model.features
    base = roc_auc(predict(model, df), score="churn_probability").first()["auc"]
    bucket = F.pmod(F.xxhash64(F.col(ID), F.lit(seed)), F.lit(n_buckets))
    w = Window.partitionBy("__b").orderBy(F.xxhash64(F.col(ID), F.lit(seed + 1)), F.col(ID))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = df.withColumn("__b", bucket)
    rows = []
    for f in features:
        shifted = tagged.withColumn(f, F.coalesce(F.lead(f, 1).over(w), F.first(f).over(whole))).drop("__b")
        auc = roc_auc(predict(model, shifted), score="churn_probability").first()["auc"]
        rows.append((f, None if base is None or auc is None else float(base - auc)))
    return spark.createDataFrame(rows, "feature string, auc_drop double").withColumn("base_auc", F.lit(base).cast("double"))
