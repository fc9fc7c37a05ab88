"""J8 on the declared views, and the tie of rows at the same instant."""

import datetime as dt

from pyspark.sql import functions as F

from stockroom.operators import churn, feature_store


def test_service_defaults_to_the_declared_fields_and_breaks_ties(spark):
    day = dt.datetime(2024, 1, 10)
    requests = spark.createDataFrame([(1, "a", day), (2, "a", day - dt.timedelta(days=9)), (3, "b", day)], "customer_id int, sku string, ts timestamp_ntz")
    customer = [n for n, _ in feature_store.CUSTOMER_VIEW["fields"]]
    customers = spark.createDataFrame([(1, day - dt.timedelta(days=30)), (3, day - dt.timedelta(days=31))], "customer_id int, event_timestamp timestamp_ntz")
    customers = customers.select("*", *[F.lit(7).alias(n) for n in customer])
    series = [n for n, _ in feature_store.SERIES_VIEW["fields"] if n != "region"]
    rows = spark.createDataFrame([("a", "EAST", day), ("a", "WEST", day), ("a", "NORTH", day)], "sku string, region string, event_timestamp timestamp_ntz")
    rows = rows.select("*", *[F.lit(5).alias(n) for n in series])
    got = {r.customer_id: r for r in feature_store.feature_service(requests, customers, rows, sku_tie="region").collect()}
    assert got[1].sku_region == "WEST" and got[1].customer_recency == 7 and got[1].sku_avg_price == 5
    assert got[2].sku_region is None and got[2].customer_recency is None
    assert got[3].customer_recency is None and got[3].sku_feature_ts is None


def test_repeated_customers_do_not_multiply_the_training_rows(spark):
    once = spark.range(40).select(F.col("id").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churn_label"), F.col("id").cast("double").alias("x"))
    model = churn.fit_stacked(once.unionByName(once), max_iter=1, folds=2)
    assert model.meta.summary.predictions.count() == 80
