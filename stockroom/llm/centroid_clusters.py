"""Operator 12: Lloyd clustering with vectors sharded by dimension.

Column block b of all vectors is a shard with a table of its own.  Each round, tasks of a
shard compute exact partial squared distances of its columns to its slice of the centroids;
the partial distances of a vector are added over shards by key and the smallest sum assigns
it; then each shard adds up its own columns by cluster and so gets the next values of its
slice.  Nothing but the centroids (clusters x dimensions numbers) and a row per cluster
reaches the driver; every round's assignment is a table in the shared scratch folder.

All arithmetic is on integers: components are floor(64 * x), and a mean is floor(sum / count).

Defined results: vectors of another length, with a null, NaN or infinite component, or null
themselves are left out; so are those with a component of 2**21 or more, whose distances a
long cannot hold; a null vec_id is hashed as nothing after the colon; rows that repeat
a vec_id are vectors of their own, in the order of their components where they start a centroid;
equal distances go to the smaller number; with fewer vectors than clusters each vector
starts one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm.common import table
from stockroom.session import ScratchTable

DIMENSIONS, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
SHARDS = 4
MOST = 2**21  # components below it: squared distances of 64 dimensions stay below 2**62
CELLS_AT_ONCE = 1 << 22


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has the right length and only finite components."""

    def within(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float(MOST))), F.lit(False))

    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, within), F.lit(False))


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(row, vec_id, v) of the usable vectors, with a number for each row."""

    kept = vectors.where(usable(F.col("embedding"), dimensions))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", scaled.alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``<seed>:<vec_id>``, in that order."""

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([row.v for row in rows.select("v", key.alias("key")).orderBy("key", "v").limit(clusters).collect()], np.int64)


def partial_distances(shard: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(row, d0, d1, ...): squared distances within the shard's columns."""

    names = ["row", *(f"d{k}" for k in range(len(centroids)))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS_AT_ONCE // centroids.size)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                distances = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, distances.T)], names=names)

    return shard.mapInArrow(measure, ", ".join(f"{name} long" for name in names))


def assign(shards: list[DataFrame], slices: list[np.ndarray]) -> ScratchTable:
    """(row, cluster, distance) of the nearest centroid."""

    parts = reduce(DataFrame.unionAll, (partial_distances(shard, centroids) for shard, centroids in zip(shards, slices, strict=True)))
    names = parts.columns[1:]
    whole = parts.groupBy("row").agg(*(F.sum(name).alias(name) for name in names))
    least = F.array_min(F.array(*names))
    cluster = (F.array_position(F.array(*names), least) - 1).cast("int")
    return ScratchTable(whole.select("row", cluster.alias("cluster"), least.alias("distance")), "lloyd-assigned")


def moved(shards: list[DataFrame], slices: list[np.ndarray], assigned: DataFrame) -> list[np.ndarray]:
    """The next slice of every shard: per cluster the floor of each column's mean; empty clusters stay."""

    out = [centroids.copy() for centroids in slices]
    members = assigned.select("row", "cluster")

    def sums(number: int) -> DataFrame:
        columns = [F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(slices[number].shape[1])]
        totals = shards[number].join(members, "row").groupBy("cluster").agg(F.count("*").alias("n"), *columns)
        means = [F.expr(f"(s{j} - pmod(s{j}, n)) div n") for j in range(len(columns))]
        return totals.select(F.lit(number).alias("shard"), "cluster", F.array(*means).alias("x"))

    for row in reduce(DataFrame.unionAll, map(sums, range(len(shards)))).collect():  # a row per shard and cluster
        out[row.shard][row.cluster] = row.x
    return out


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, shards: int = SHARDS) -> DataFrame:
    """Per kept row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""

    spark = vectors.sparkSession
    rows = ScratchTable(integers(vectors, dimensions), "lloyd-vectors").df
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], vectors.select("vec_id").schema.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string"))
    bounds = [round(n * dimensions / shards) for n in range(shards + 1)]
    columns = list(zip(bounds, bounds[1:], strict=False))
    slices = [np.ascontiguousarray(centroids[:, a:b]) for a, b in columns]
    tables = [ScratchTable(rows.select("row", F.slice("v", a + 1, b - a).alias("x")), f"lloyd-shard-{n}") for n, (a, b) in enumerate(columns)]
    for _ in range(rounds):
        assigned = assign([t.df for t in tables], slices)
        slices = moved([t.df for t in tables], slices, assigned.df)
        assigned.drop()
    assigned = assign([t.df for t in tables], slices).df
    for t in tables:
        t.drop()

    inertia = {row.cluster: int(row.s) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    final = np.concatenate(slices, axis=1)
    of_cluster = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, final[k].tolist())).encode()).hexdigest()) for k in range(len(final))]
    stats = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("row", "vec_id").join(assigned, "row").join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    parts = []
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS (
  SELECT row, k, d FROM (SELECT l.row, c.k, sum((l.x - c.x) * (l.x - c.x)) AS d,
    row_number() OVER (PARTITION BY l.row ORDER BY sum((l.x - c.x) * (l.x - c.x)), c.k) AS r
    FROM cells l JOIN c{n} c ON l.j = c.j GROUP BY l.row, c.k) WHERE r = 1
)""")
        if n < ROUNDS:
            parts.append(f"""m{n} AS (
  SELECT k, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS x
  FROM (SELECT a.k, l.j, sum(l.x) AS s, count(*) AS n FROM cells l JOIN a{n} a ON l.row = a.row GROUP BY a.k, l.j)
), c{n + 1} AS (
  SELECT k, j, x FROM m{n} UNION ALL SELECT k, j, x FROM c{n} WHERE k NOT IN (SELECT k FROM m{n})
)""")
    return ", ".join(parts)


# The same rows for DuckDB: one row per vector and component.
OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {MOST})) = 0
), cells AS (
  SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept
), firsts AS (
  SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept
), c0 AS (
  SELECT f.k, l.j, l.x FROM firsts f JOIN cells l ON f.row = l.row WHERE f.k < {CLUSTERS}
), {_rounds_sql()}, hashed AS (
  SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k
)
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN kept v ON a.row = v.row JOIN hashed h ON a.k = h.k
"""
