"""Sources: S1 CSV, S3 Parquet, S4 REST JSON, S5 Kafka (batch), S6 dispatch.

Readers return lazy DataFrames; nothing is pulled to the driver.  The REST
source is a Python Data Source whose partitions are pages, so executors do
the fetching in parallel (the reference fetched one payload on the driver).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BROKEN = "__broken_record"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """Header row; an explicit schema when given, inference only otherwise."""

    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.options(**options).csv(path)


# The reference's transaction table layout.
TRANSACTIONS_SCHEMA = (
    "date date, customer_id string, sku string, region string, channel string, quantity int, unit_price double, "
    "discount_pct double, promotion_flag int, inventory_on_hand int, weather_index double, holiday_flag int, "
    "revenue double, churned int"
)


def load_transactions(spark: SparkSession, path: str, fmt: str = "csv", schema: str = TRANSACTIONS_SCHEMA) -> DataFrame:
    """The reference's transactions file as a lazy, typed DataFrame.

    Adds ``row_seq`` (file order: split index, then position) so "last row"
    choices are deterministic; every operator accepts the result directly.
    """

    df = read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    return df.withColumn("row_seq", F.monotonically_increasing_id())


def read_parquet(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """S3: Parquet scan (filters and projections are pushed into it by Catalyst)."""

    return spark.read.options(**options).parquet(path)


def read_json_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S4 (landed form): JSON records already landed as files."""

    return spark.read.schema(schema).json(path)


# ---- S4: REST JSON as a Python data source -------------------------------------------------

try:  # the Python Data Source API exists from Spark 4.0
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class _Page(InputPartition):
        def __init__(self, url: str):
            self.url = url

    class RestJsonReader(DataSourceReader):
        def __init__(self, options: dict, schema: StructType):
            self.options = options
            self.schema = schema

        def partitions(self):
            urls = json.loads(self.options["urls"])
            return [_Page(u) for u in urls]

        def read(self, partition):
            import urllib.request

            timeout = float(self.options.get("timeout", "30"))
            with urllib.request.urlopen(partition.url, timeout=timeout) as resp:  # noqa: S310 (caller-supplied endpoint)
                payload = json.loads(resp.read().decode("utf-8"))
            records = payload if isinstance(payload, list) else payload.get(self.options.get("records_key", "data"), [])
            names = [f.name for f in self.schema.fields]
            for rec in records:
                yield tuple(rec.get(n) for n in names)

    class RestJsonDataSource(DataSource):
        """``spark.read.format('rest_json').schema(s).option('urls', json_list).load()``."""

        @classmethod
        def name(cls):
            return "rest_json"

        def schema(self):
            raise ValueError("rest_json needs an explicit schema")

        def reader(self, schema: StructType):
            return RestJsonReader(self.options, schema)

except ImportError:  # pragma: no cover
    RestJsonDataSource = None


def read_api(spark: SparkSession, endpoint: str, schema: StructType | str, params: dict | None = None, pages: list[dict] | None = None, timeout: float = 30) -> DataFrame:
    """GET ``endpoint`` (one partition per page of ``pages`` query params)."""

    from urllib.parse import urlencode

    if RestJsonDataSource is None:
        raise RuntimeError("Python data sources need Spark 4.0+")
    spark.dataSource.register(RestJsonDataSource)
    base = dict(params or {})
    pages = pages or [{}]
    urls = []
    for p in pages:
        q = urlencode({**base, **p})
        urls.append(f"{endpoint}?{q}" if q else endpoint)
    return spark.read.format("rest_json").schema(schema).option("urls", json.dumps(urls)).option("timeout", str(timeout)).load()


# ---- S5: Kafka (bounded batch) ---------------------------------------------------------------

def read_kafka(spark: SparkSession, topic: str, bootstrap_servers: str, value_schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """Bounded batch read of a topic; decoded when a value schema is given.

    Needs the Kafka connector on the classpath (not bundled with PySpark).
    """

    raw = (
        spark.read.format("kafka")
        .option("subscribe", topic)
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .options(**options)
        .load()
    )
    return decode_kafka(raw, value_schema) if value_schema is not None else raw


def _parsed(raw: DataFrame, value_schema: StructType | str, options: dict | None) -> DataFrame:
    """``raw`` with the parsed value (``__v``) and why it could not be parsed (``reason``, else null).

    A value is parsed once, permissively; JSON that does not fit the schema keeps its text
    in a column of its own, which the schema must not have.
    """

    schema = StructType.fromDDL(value_schema) if isinstance(value_schema, str) else value_schema
    keeps = StructType([*schema.fields, StructField(BROKEN, StringType())])
    text = F.col("value").cast("string")
    parsed = raw.withColumn("__v", F.from_json(text, keeps, {**(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    reason = F.when(F.col("value").isNull(), "no value").when(F.trim(text) == "", "empty value").when(F.col("__v").isNull() | F.col(f"__v.{BROKEN}").isNotNull(), "not the schema")
    return parsed.withColumn("reason", reason)


def decode_kafka(raw: DataFrame, value_schema: StructType | str, options: dict | None = None) -> DataFrame:
    """S5 decode stage: JSON values as typed columns, plus topic, partition, offset and timestamp where
    ``raw`` has them and the value does not.  Values that cannot be parsed are in ``dead_letters``; no row is lost."""

    good = _parsed(raw, value_schema, options).where("reason is null")
    fields = [f.name for f in good.schema["__v"].dataType.fields if f.name != BROKEN]
    meta = [c for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns and c not in fields]
    return good.select(*meta, *(F.col(f"__v.`{name}`") for name in fields))


def dead_letters(raw: DataFrame, value_schema: StructType | str, options: dict | None = None) -> DataFrame:
    """Rows of ``raw`` that ``decode_kafka`` leaves out, as they came, with the reason."""

    return _parsed(raw, value_schema, options).where("reason is not null").drop("__v")


# ---- S6: feeds -------------------------------------------------------------------------------

class Feed:
    """A named input: the kind of reader, its settings, and what an error means for the others.

    ``on_error='fail'`` raises; ``'skip'`` leaves the feed out and says so in the status.
    """

    def __init__(self, name: str, kind: str, on_error: str = "fail", **settings: Any):
        if on_error not in ("fail", "skip"):
            raise ValueError("on_error is 'fail' or 'skip'")
        self.name, self.kind, self.on_error, self.settings = name, kind, on_error, settings


FEED_READERS: dict[str, Callable[..., DataFrame]] = {}


def feed_reader(kind: str):
    """Register a reader: a function of the session and a feed's settings."""

    def keep(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FEED_READERS[kind] = read
        return read

    return keep


@feed_reader("csv")
def _csv_feed(spark: SparkSession, path: str, schema=None, options: dict | None = None) -> DataFrame:
    return read_csv(spark, path, schema, **(options or {}))


@feed_reader("parquet")
def _parquet_feed(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    return read_parquet(spark, path, **(options or {}))


@feed_reader("api")
def _api_feed(spark: SparkSession, endpoint: str, schema, options: dict | None = None) -> DataFrame:
    return read_api(spark, endpoint, schema, **(options or {}))


@feed_reader("kafka")
def _kafka_feed(spark: SparkSession, topic: str, schema=None, options: dict | None = None) -> DataFrame:
    settings = {"bootstrap_servers": "localhost:9092"} | (options or {})
    return read_kafka(spark, topic, settings.pop("bootstrap_servers"), schema, **settings)


def read_feeds(spark: SparkSession, feeds: list[Feed]) -> tuple[dict[str, DataFrame], DataFrame]:
    """One lazy frame per feed that could be opened, and (source, type, status, error) of every feed."""

    frames: dict[str, DataFrame] = {}
    status = []
    for feed in feeds:
        try:
            if feed.kind not in FEED_READERS:
                raise ValueError(f"no reader for {feed.kind!r}; there are {sorted(FEED_READERS)}")
            frames[feed.name] = FEED_READERS[feed.kind](spark, **feed.settings)
        except Exception as error:
            if feed.on_error == "fail":
                raise
            status.append((feed.name, feed.kind, "failed", str(error)))
        else:
            status.append((feed.name, feed.kind, "registered", None))
    return frames, spark.createDataFrame(status, "source string, type string, status string, error string")


def IngestionSource(name: str, kind: str, **settings: Any) -> Feed:  # noqa: N802
    """A feed whose failure is only reported."""

    return Feed(name, kind, "skip", **settings)


ingest_sources = read_feeds


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with a common layout; a column that one lacks is null there."""

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
