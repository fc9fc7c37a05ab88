"""The registered churn queries fit with the library's own rounds and folds."""

from pyspark.sql import functions as F

from stockroom.operators import churn
from stockroom.plans import catalog


def test_registered_churn_model_uses_the_defaults(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalog, "_cf", lambda spark, sf: spark.range(4))
    monkeypatch.setattr(churn, "stratified_split", lambda cf: cf.withColumn("is_valid", F.col("id") == 0))
    monkeypatch.setattr(churn, "fit_stacked", lambda train, **options: given.append(options))
    monkeypatch.setattr(catalog, "_MODELS", {})
    catalog._churn_model(spark, "none")
    assert given == [{}]
    catalog._churn_model(spark, "none", kind="two")
    assert given == [{}, {"kind": "two"}]
