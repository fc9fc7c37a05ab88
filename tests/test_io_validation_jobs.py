"""Sources, sinks, validation, the training job and the streaming extension."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from stockroom.operators import drift, features, validation
from stockroom.plans import jobs
from stockroom.sinks import writers
from stockroom.sources import readers
from stockroom.sources.tables import table, transactions
from stockroom.streaming import ingest

from .conftest import SF_SMOKE


def test_validation_report_edge_cases(spark):
    rows = [(None, "A", 1, 1.0, 1.0), (1, None, 2, 2.0, 2.0), (2, "B", -1, 3.0, None), (3, "C", 4, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "customer_id int, sku string, quantity int, unit_price double, revenue double").withColumns(
        {"date": F.current_date(), "region": F.lit("r")}
    )
    rep = {(r["rule"], r["column"]): r for r in validation.validation_report(df).collect()}
    assert rep[("not_null", "customer_id")]["failed"] == 1
    assert rep[("not_null", "sku")]["failed"] == 1
    assert rep[("non_negative", "quantity")]["failed"] == 1
    assert rep[("non_negative", "revenue")]["failed"] == 1  # null fails (shipped fallback)
    assert rep[("non_negative", "unit_price")]["success"] is True
    lenient = {(r["rule"], r["column"]): r["failed"] for r in validation.validation_report(df, null_fails=False).collect()}
    assert lenient[("non_negative", "revenue")] == 0
    with pytest.raises(validation.ValidationError):
        validation.gate(df)
    valid, bad = validation.split_valid(df)
    assert valid.count() == 1 and bad.count() == 3
    with pytest.raises(validation.ValidationError, match="Missing required columns"):
        validation.check_required_columns(df.drop("region", "date"))


def test_rest_source_reads_pages_on_executors(spark):
    folder = tempfile.mkdtemp(prefix="stockroom-rest-")
    ev = table(spark, SF_SMOKE, "events").select("event_id", "event_type", "value").orderBy("event_id").limit(30).collect()
    urls = []
    for p in range(3):
        recs = [r.asDict() for r in ev[p * 10 : (p + 1) * 10]]
        path = os.path.join(folder, f"page{p}.json")
        with open(path, "w") as fh:
            json.dump({"data": recs}, fh)
        urls.append(f"file://{path}")
    readers.read_api(spark, urls[0], "event_id long, event_type string, value double")  # registers the source
    df = (
        spark.read.format("rest_json").schema("event_id long, event_type string, value double").option("urls", json.dumps(urls)).load()
    )
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["event_id"] for r in df.collect()) == [r["event_id"] for r in ev]


def test_csv_and_dispatch(spark):
    folder = tempfile.mkdtemp(prefix="stockroom-csv-")
    table(spark, SF_SMOKE, "region").write.mode("overwrite").option("header", True).csv(folder)
    frames, status = readers.ingest_sources(
        spark,
        [
            readers.IngestionSource("regions", "csv", path=folder, schema="r_regionkey int, r_name string"),
            readers.IngestionSource("nations", "parquet", path=f"{SF_SMOKE}/nation.parquet"),
            readers.IngestionSource("bad", "ftp"),
        ],
    )
    assert frames["regions"].count() == 5 and frames["nations"].count() == 25
    st = {r["source"]: r["status"] for r in status.collect()}
    assert st == {"regions": "registered", "nations": "registered", "bad": "failed"}


def test_lineage_edges_and_reachability(spark):
    path = writers.shared_path(spark, "lineage_test", str(time.time_ns()))
    writers.emit_lineage(spark, path, "ingest", "r1", ["raw"], ["bronze", "silver"])
    writers.emit_lineage(spark, path, "train", "r1", ["silver"], ["features", "models"])
    lin = spark.read.parquet(path)
    edges = {(r["upstream"], r["downstream"]) for r in writers.lineage_edges(lin).collect()}
    assert ("raw", "silver") in edges and ("silver", "models") in edges
    reach = {r[0] for r in writers.downstream_of(lin, "raw").collect()}
    assert reach == {"bronze", "silver", "features", "models"}


def test_retrain_policy_and_status(spark):
    d = drift.retrain_policy(spark.createDataFrame([(0.25, 9.8), (0.1, 16.0), (0.1, 5.0)], "psi double, mape double")).collect()
    assert d[0]["should_retrain"] and d[0]["reasons"] == ["PSI exceeded threshold (0.250 > 0.200)"]
    assert d[1]["reasons"] == ["MAPE exceeded threshold (16.00 > 15.00)"]
    assert not d[2]["should_retrain"] and d[2]["reasons"] == []
    t = drift.monitoring_table(spark.createDataFrame([("Churn AUC", 0.85), ("PSI", 0.1), ("API Latency (s)", 2.0)], "metric string, value double"))
    st = {r["metric"]: r["status"] for r in t.collect()}
    assert st == {"Churn AUC": "alert", "PSI": "healthy", "API Latency (s)": "alert"}


def test_training_job_end_to_end(spark):
    res = jobs.run_training_job(spark, SF_SMOKE, churn_iters=5, churn_folds=2, segment_ks=range(6, 7))
    assert res["validation"]["success"]
    assert 0.0 <= res["metrics"]["churn_auc"] <= 1.0
    inv = spark.read.parquet(res["outputs"]["inventory"])
    assert inv.count() == transactions(spark, SF_SMOKE).select("sku").distinct().count()
    ts = spark.read.parquet(res["outputs"]["time_series_features"])
    assert "event_timestamp" in ts.columns


def test_streaming_rollup_equals_batch_for_closed_days(spark):
    base = writers.shared_path(spark, "stream_test", str(time.time_ns()))
    tx = transactions(spark, SF_SMOKE).select(
        "date", "customer_id", "sku", "region", "quantity", "unit_price", "revenue", "promotion_flag", "weather_index"
    )
    tx.write.parquet(f"{base}/landed")
    q = ingest.start_daily_rollup(spark, f"{base}/landed", tx.schema, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{base}/out")
    batch = features.daily_rollup(tx.withColumns({"channel": F.lit("x")}))
    n_out = out.count()
    assert n_out > 0
    # every emitted day equals the batch rollup for that day
    diff = out.select("date", "sku", "region", "quantity").exceptAll(batch.select("date", "sku", "region", "quantity"))
    assert diff.count() == 0


def test_observed_landing_counts_rules_during_write(spark):
    base = writers.shared_path(spark, "observe_test", str(time.time_ns()))
    tx = transactions(spark, SF_SMOKE).withColumn("quantity", F.when(F.col("l_linenumber") == 1, F.lit(-1)).otherwise(F.col("quantity")))
    counts = writers.land_observed(tx, f"{base}/silver", f"{base}/quarantine")
    bad = tx.where(F.col("quantity") < 0).count()
    assert counts["checked"] == tx.count() and counts["non_negative:quantity"] == bad
    assert spark.read.parquet(f"{base}/quarantine").count() == bad


def test_calendar_frame_rolling(spark):
    import datetime as dt

    rows = [("S", "R", dt.date(2024, 1, d), q) for d, q in ((1, 10), (2, 20), (9, 30))]
    daily = spark.createDataFrame(rows, "sku string, region string, date date, quantity long").withColumn("revenue", F.col("quantity").cast("decimal(18,4)"))
    out = {r["date"].day: r["rolling_qty_7"] for r in features.with_rolling_and_lags(daily, calendar=True).collect()}
    assert out == {1: 10.0, 2: 15.0, 9: 30.0}  # day 9 sees only itself within 7 calendar days
    rows_frame = {r["date"].day: r["rolling_qty_7"] for r in features.with_rolling_and_lags(daily).collect()}
    assert rows_frame[9] == 20.0


def test_dynamic_overwrite_replaces_only_written_partitions(spark):
    base = writers.shared_path(spark, "dyn_test", str(time.time_ns()))
    import datetime as dt

    a = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "date date, v int")
    b = spark.createDataFrame([(dt.date(2024, 1, 2), 20)], "date date, v int")
    writers.write_table(a, base, partition_by=["date"], salt_buckets=2)
    writers.write_table(b, base, partition_by=["date"], salt_buckets=2)
    got = {(r["date"].day, r["v"]) for r in spark.read.parquet(base).collect()}
    assert got == {(1, 1), (2, 20)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_reference_csv_layout_runs_through_operators(spark):
    from stockroom.operators import inventory

    folder = writers.shared_path(spark, "csv_tx", str(time.time_ns()))
    tx = transactions(spark, SF_SMOKE).select(
        F.col("date"), F.col("customer_id").cast("string").alias("customer_id"), "sku", "region", "channel", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"), F.col("discount_pct").cast("double").alias("discount_pct"),
        "promotion_flag", "inventory_on_hand", F.col("weather_index").cast("double").alias("weather_index"),
        F.lit(0).alias("holiday_flag"), F.col("revenue").cast("double").alias("revenue"), "churned",
    )
    tx.coalesce(1).write.option("header", True).csv(folder)
    loaded = readers.load_transactions(spark, folder)
    assert "row_seq" in loaded.columns and loaded.count() == tx.count()
    validation.gate(loaded)
    inv = inventory.recommend(loaded).collect()
    assert len(inv) == tx.select("sku").distinct().count()
    cf = features.customer_features(loaded)
    assert cf.count() == tx.select("customer_id").distinct().count()
    assert features.time_series_features(loaded).count() == tx.select("date", "sku", "region").distinct().count()


def test_lineage_reaches_past_ten_hops(spark):
    rows = [(f"job{i}", f"run{i}", [f"d{i}"], [f"d{i + 1}"]) for i in range(13)]
    lin = spark.createDataFrame(rows, "job_name string, run_id string, inputs array<string>, outputs array<string>")
    assert {r[0] for r in writers.downstream_of(lin, "d0").collect()} == {f"d{i}" for i in range(1, 14)}


def test_membership_list_of_any_length(spark):
    from stockroom.operators.dashboard import filter_members

    df = spark.range(20_000).withColumnRenamed("id", "k")
    assert filter_members(df, "k", range(5, 10_020)).count() == 10_015
