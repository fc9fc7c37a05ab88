"""Batch jobs: M28 training job and the monitoring snapshot.

One lazy lineage per job: ``transactions`` is built once and persisted, each
feature table is checkpointed once and shared by every model stage, and
actions happen only at sinks and at the few scalar results (metrics).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import churn, drift, features, forecast, inventory, pricing, segment, validation
from stockroom.session import checkpointed
from stockroom.sinks import model_store, writers
from stockroom.sources.tables import transactions


def run_training_job(
    spark: SparkSession,
    sf_dir: str,
    out_dir: str | None = None,
    run_ts: _dt.datetime | None = None,
    run_id: str | None = None,
    churn_iters: int = 100,
    churn_folds: int = 5,
    segment_ks=range(6, 11),
    land: bool = True,
) -> dict:
    """Validate + land, features + export, churn, segments, elasticity,
    inventory, run log and lineage.  Demand is not trained here (as in the
    reference); ``forecast`` functions run on the exported series table."""

    run_id = run_id or str(uuid.uuid4())
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    out = out_dir or writers.shared_path(spark, "runs", run_id)
    tx = transactions(spark, sf_dir).persist()
    result = validation.gate(tx)  # V5: whole batch rejected on failure
    outputs = {}
    if land:
        landed = writers.land_bronze_silver(tx, f"{out}/bronze/transactions", f"{out}/silver/transactions")
        outputs.update(landed)
        writers.emit_lineage(spark, f"{out}/lineage", "transactions_ingestion", run_id, [sf_dir], [landed["bronze"], landed["silver"]], run_ts)

    ts = checkpointed(features.time_series_features(tx))
    cf = checkpointed(features.customer_features(tx))
    outputs["time_series_features"] = writers.export_features(ts, f"{out}/features/time_series", run_ts)
    outputs["customer_features"] = writers.export_features(cf, f"{out}/features/customers", run_ts)

    split = checkpointed(churn.stratified_split(cf))
    model = churn.fit_stacked(split.where(~F.col("is_valid")).drop("is_valid"), max_iter=churn_iters, folds=churn_folds)
    valid_scores = churn.predict(model, split.where(F.col("is_valid")).drop("is_valid"))
    auc = churn.roc_auc(valid_scores, score="churn_probability").first()["auc"]
    outputs["churn_model"] = model_store.save(model, f"{out}/models/churn")

    seg = segment.segment_customers(cf, ks=segment_ks)
    outputs["segment_profile"] = writers.write_result(seg["profile"], f"{out}/segments/profile")

    elasticity = float(pricing.elasticity_loglog(ts).first()["price_elasticity"])
    inv = inventory.recommend(tx)
    outputs["inventory"] = writers.write_result(inv, f"{out}/inventory")

    metrics = {
        "churn_auc": float(auc) if auc is not None else float("nan"),
        "segmentation_silhouette": float(seg["silhouette_score"]),
        "price_elasticity": elasticity,
    }
    params = {"run_id": run_id, "segmentation_algorithm": seg["algorithm"], "validation_success": result["success"]}
    writers.log_run(spark, f"{out}/run_log", run_id, params, metrics, outputs, run_ts)
    writers.emit_lineage(spark, f"{out}/lineage", "training", run_id, [f"{out}/silver/transactions" if land else sf_dir], list(map(str, outputs.values())), run_ts)
    tx.unpersist()
    return {"run_id": run_id, "metrics": metrics, "outputs": outputs, "validation": result}


def monitoring_snapshot(spark: SparkSession, tx: DataFrame, churn_auc: float | None = None, latency_s: float | None = None) -> dict:
    """M27 + M5 + M29 + P23: observed PSI, mean naive MAPE, KPI status table and retrain decision."""

    psi_row = drift.observed_drift_snapshot(tx).first()
    daily = features.daily_rollup(tx)
    mape = forecast.naive_mape(daily).agg(F.avg("mape")).first()[0]
    rows = [("PSI", float(psi_row["psi"])), ("Demand MAPE", float(mape))]
    if churn_auc is not None:
        rows.append(("Churn AUC", float(churn_auc)))
    if latency_s is not None:
        rows.append(("API Latency (s)", float(latency_s)))
    table = drift.monitoring_table(spark.createDataFrame(rows, "metric string, value double"))
    decision = drift.retrain_policy(spark.createDataFrame([(float(psi_row["psi"]), float(mape))], "psi double, mape double"))
    return {"psi": psi_row, "mape": mape, "table": table, "decision": decision}
