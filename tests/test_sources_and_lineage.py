"""Kafka decoding with dead letters, feeds, lineage over long chains, table writes, grouping sets with nulls, churn report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockroom.operators import dashboard
from stockroom.session import scratch_path
from stockroom.sinks import writers
from stockroom.sources import readers

SCHEMA = "id long, ts timestamp, partition string"


def test_every_kafka_row_is_decoded_or_a_dead_letter(spark):
    values = [b'{"id": 1, "partition": "own"}', b"{}", None, b"", b"   ", b'{"id": 2', b'{"id": "text"}', b"[1]", b'{"id": 3, "extra": {"x": 1}}', b"\xff\xfe", b"null"]
    raw = spark.createDataFrame([(v, "t", n % 2, n) for n, v in enumerate(values)], "value binary, topic string, partition int, offset long")
    good = {r.offset: (r.id, r.partition) for r in readers.decode_kafka(raw, SCHEMA).collect()}
    assert good == {0: (1, "own"), 1: (None, None), 8: (3, None)}
    bad = {r.offset: (r.value if r.value is None else bytes(r.value), r.reason) for r in readers.dead_letters(raw, SCHEMA).collect()}
    assert bad.keys() | good.keys() == set(range(len(values))) and not bad.keys() & good.keys()
    assert bad[2] == (None, "no value") and bad[3][1] == bad[4][1] == "empty value" and bad[5] == (values[5], "not the schema")
    assert readers.decode_kafka(raw.limit(0), SCHEMA).columns == ["topic", "offset", "id", "ts", "partition"]


def test_feeds_fail_or_are_skipped_as_they_say(spark):
    settings = {"bootstrap_servers": "kept"}
    path = scratch_path(spark, "feed-test")
    spark.range(3).write.parquet(path)
    feeds = [readers.Feed("a", "parquet", path=path), readers.Feed("gone", "parquet", "skip", path=f"{path}-none"), readers.Feed("odd", "ftp", "skip"), readers.Feed("k", "kafka", "skip", topic="t", options=settings)]
    frames, status = readers.read_feeds(spark, feeds)
    assert list(frames) == ["a"] and frames["a"].count() == 3
    assert {r.source: r.status for r in status.collect()} == {"a": "registered", "gone": "failed", "odd": "failed", "k": "failed"}
    assert settings == {"bootstrap_servers": "kept"}
    with pytest.raises(ValueError, match="ftp"):
        readers.read_feeds(spark, [readers.Feed("odd", "ftp")])
    with pytest.raises(ValueError, match="on_error"):
        readers.Feed("x", "csv", "ignore")

    @readers.feed_reader("numbers")
    def numbers(spark, n):
        return spark.range(n).withColumn("more", F.lit("m"))

    frames, _ = readers.read_feeds(spark, [readers.Feed("a", "parquet", path=path), readers.Feed("n", "numbers", n=2)])
    assert readers.union_sources(list(frames.values())).where("more is null").count() == 3


def lineage(spark, edges):
    rows = [(f"job{n}", "r", list(i), list(o), dt.datetime(2025, 1, 1)) for n, (i, o) in enumerate(edges)]
    return spark.createDataFrame(rows, writers.LINEAGE_SCHEMA)


def test_downstream_of_a_long_chain_takes_few_steps(spark, monkeypatch):
    made = []
    scratch = writers.ScratchTable
    monkeypatch.setattr(writers, "ScratchTable", lambda df, name: made.append(name) or scratch(df, name))
    chain = lineage(spark, [([f"d{n}"], [f"d{n + 1}"]) for n in range(10_000)])
    assert writers.downstream_of(chain, "d0").count() == 10_000
    assert len(made) <= 2 * 17


def test_downstream_with_cycles_branches_and_wide_jobs(spark):
    edges = [(["a"], ["b", "c"]), (["b"], ["a"]), (["c", "x"], ["d"]), (["z"], ["y"]), ([], ["a"]), (["d"], [])]
    found = lambda name: sorted(r.dataset for r in writers.downstream_of(lineage(spark, edges), name).collect())
    assert found("a") == ["a", "b", "c", "d"]
    assert found("c") == ["d"] and found("d") == found("unknown") == []
    wide = lineage(spark, [([f"i{n}" for n in range(3000)], [f"o{n}" for n in range(3000)])])
    assert writers.downstream_of(wide, "i7").count() == 3000


def test_whole_write_replaces_old_days_and_a_hot_day_keeps_all_rows(spark):
    path = scratch_path(spark, "write-test")
    first = spark.range(100).selectExpr("id", "date_add(DATE'2025-01-01', cast(id % 5 as int)) as date")
    writers.write_table(first, path, partition_by=["date"])
    hot = spark.range(3000).selectExpr("id", "if(id % 3 = 0, DATE'2025-01-02', date_add(DATE'2025-01-01', cast(id % 2 as int))) as date")
    writers.write_table(hot, path, partition_by=["date"])
    assert spark.read.parquet(path).count() == 3000 + 60  # the three other days stay
    writers.write_table(hot, path, partition_by=["date"], whole=True)
    assert spark.read.parquet(path).count() == 3000
    plan = hot.hint("rebalance", F.col("date"))._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" in plan


def test_grouping_sets_with_null_keys(spark):
    tx = spark.createDataFrame([(None, "r", "s", 1, 2.0), (dt.date(2025, 1, 1), None, "s", 1, 3.0), (dt.date(2025, 1, 1), "r", None, 1, 5.0)], "date date, region string, sku string, quantity int, revenue double")
    found = {(r.level, r.date, r.region, r.sku): r.revenue for r in dashboard.overview_grouping_sets(tx).collect()}
    assert found == {("date", dt.date(2025, 1, 1), None, None): 8.0, ("region", None, "r", None): 7.0, ("sku", None, None, "s"): 5.0}
