"""Sinks: K1-K8.

Writes are plain ``DataFrameWriter`` calls.  Partitioned writes are rebalanced by
the partition columns: adaptive execution deals a day that holds a third of all rows to
several tasks by its size, and merges small days.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators.validation import split_valid
from stockroom.session import ScratchTable, ensure_checkpoint_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared checkpoint location (never machine-local on a cluster)."""

    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "stockroom", *parts)


def table_format(spark: SparkSession, preferred: str = "delta") -> str:
    """``delta`` when its data source is on the classpath, else ``parquet``."""

    if preferred != "delta":
        return preferred
    try:
        spark._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
        return "delta"
    except Exception:  # noqa: BLE001
        return "parquet"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, whole: bool = False, salt_buckets: int | None = None) -> str:
    """K1/K2: write ``df`` (optionally partitioned).

    Rows are rebalanced by the partition columns: adaptive execution merges small partitions and
    splits one that holds most rows, by size.  A rerun replaces only the partitions it writes,
    or with ``whole`` the table.  ``salt_buckets`` is not used any more: sizes decide.
    """

    if not partition_by:
        df.write.format(fmt).mode(mode).save(path)
        return path
    rebalanced = df.hint("rebalance", *(F.col(c) for c in partition_by))
    # per-write option: the caller's session configuration is left untouched
    writer = rebalanced.write.format(fmt).mode(mode).option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.partitionBy(*partition_by).save(path)
    return path


def land_bronze_silver(
    tx: DataFrame, bronze: str, silver: str, fmt: str = "parquet", null_fails: bool = True, quarantine: str | None = None
) -> dict:
    """K3: bronze = typed raw rows; silver = rows passing V2/V3, both partitioned by date.

    Both tables are replaced.  The source is persisted once so both writes (and the quarantine) read it once.
    """

    src = tx.persist()
    try:
        write_table(src, bronze, fmt, partition_by=["date"], whole=True)
        valid, bad = split_valid(src, null_fails)
        write_table(valid, silver, fmt, partition_by=["date"], whole=True)
        if quarantine:
            write_table(bad, quarantine, fmt)
    finally:
        src.unpersist()
    return {"bronze": bronze, "silver": silver, "quarantine": quarantine}


def land_observed(tx: DataFrame, silver: str, quarantine: str, fmt: str = "parquet", null_fails: bool = True) -> dict:
    """V4/V5 with the write: the source is persisted once; rule failure counts
    come from one aggregate over the persisted rows, valid rows go to silver and
    failing rows to the quarantine table (the input is computed only once).

    (``DataFrame.observe`` would fold the counts into the write itself, but in
    PySpark 4.1 classic it leaves a non-serializable observation manager on the
    session that breaks later closures, so it is not used.)
    """

    from stockroom.operators.validation import rule_predicates

    rules = rule_predicates(null_fails)
    src = tx.persist()
    try:
        row = src.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(p).alias(f"{r}:{c}") for r, c, p in rules]).first()
        valid, bad = split_valid(src, null_fails)
        write_table(valid, silver, fmt, partition_by=["date"], whole=True)
        write_table(bad, quarantine, fmt)
    finally:
        src.unpersist()
    return row.asDict()


def export_features(df: DataFrame, path: str, run_ts: _dt.datetime, fmt: str = "parquet") -> str:
    """K4: add one ``event_timestamp`` literal for the run and write."""

    return write_table(df.withColumn("event_timestamp", F.lit(run_ts).cast("timestamp")), path, fmt)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """K5: write a result table (e.g. inventory recommendations)."""

    return write_table(df, path, fmt)


RUN_LOG_SCHEMA = "run_id string, kind string, key string, value string, logged_at timestamp"
LINEAGE_SCHEMA = "job_name string, run_id string, inputs array<string>, outputs array<string>, event_time timestamp"


def log_run(spark: SparkSession, path: str, run_id: str, params: dict, metrics: dict, artifacts: dict | None = None, at: _dt.datetime | None = None) -> DataFrame:
    """K6: append (run_id, kind, key, value, logged_at) rows to the run-log table."""

    at = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, "param", k, str(v), at) for k, v in params.items()]
    rows += [(run_id, "metric", k, repr(float(v)), at) for k, v in metrics.items()]
    rows += [(run_id, "artifact", k, str(v), at) for k, v in (artifacts or {}).items()]
    df = spark.createDataFrame(rows, RUN_LOG_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def emit_lineage(spark: SparkSession, path: str, job_name: str, run_id: str | None, inputs: list[str], outputs: list[str], at: _dt.datetime | None = None) -> DataFrame:
    """K7: append one lineage event (job, run, inputs[], outputs[], time)."""

    at = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    df = spark.createDataFrame([(job_name, run_id or str(uuid.uuid4()), inputs, outputs, at)], LINEAGE_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def lineage_edges(lineage: DataFrame) -> DataFrame:
    """K7 query: dataset-level edges (upstream dataset -> job -> downstream dataset)."""

    ins = lineage.select("job_name", "run_id", F.explode("inputs").alias("upstream"))
    outs = lineage.select("job_name", "run_id", F.explode("outputs").alias("downstream"))
    return ins.join(outs, ["job_name", "run_id"]).select("upstream", "job_name", "downstream").distinct()


def downstream_of(lineage: DataFrame, dataset: str) -> DataFrame:
    """K7 query: every dataset reachable from ``dataset``, however many jobs away.

    Datasets and jobs are nodes, so a job's inputs are never paired with its outputs.  Step k joins
    what is known with paths of exactly 2**k edges and then joins these paths with themselves, so a
    chain of 10,000 jobs takes some 15 steps.  A step that finds nothing new ends it, since a
    shortest path passes through every distance before its own; so cycles end too.
    """

    run = F.struct(F.lit("run").alias("kind"), F.concat_ws("|", "job_name", "run_id").alias("name"))
    one = lambda c: F.struct(F.lit("dataset").alias("kind"), c.alias("name"))
    into = lineage.select(F.explode("inputs").alias("d"), run.alias("run")).select(one(F.col("d")).alias("node"), F.col("run").alias("next"))
    out = lineage.select(run.alias("run"), F.explode("outputs").alias("d")).select(F.col("run").alias("node"), one(F.col("d")).alias("next"))
    paths = ScratchTable(into.unionByName(out).distinct(), "lineage-paths")
    start = lineage.sparkSession.createDataFrame([(("dataset", dataset),)], "node struct<kind: string, name: string>")
    known, count = ScratchTable(start, "lineage-known"), 1
    while True:
        found = known.df.join(paths.df, "node").select(F.col("next").alias("node"))
        grown = ScratchTable(known.df.unionByName(found).distinct(), "lineage-known")
        known.drop()
        known, before, count = grown, count, grown.df.count()
        if count == before:
            break
        doubled = ScratchTable(paths.df.join(paths.df.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")).distinct(), "lineage-paths")
        paths.drop()
        paths = doubled
    # the dataset itself counts when a job downstream writes it again
    back = into.join(known.df, "node").select(F.col("next").alias("node")).distinct().join(out, "node").select("next.name").where(F.col("name") == dataset)
    others = known.df.where("node.kind = 'dataset'").select("node.name").where(F.col("name") != dataset)
    return others.unionByName(back).distinct().select(F.col("name").alias("dataset"))


def save_model(model, path: str) -> str:
    """K8: persist a fitted ``pyspark.ml`` model or pipeline."""

    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """K8: load a saved ML model or pipeline, whatever its class (``model_store`` also keeps a manifest)."""

    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())
