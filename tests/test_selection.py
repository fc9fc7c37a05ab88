"""Ranks by histogram refinement against a sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.functions import selection


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    monkeypatch.setattr(selection, "ROWS_LEFT", 5)


RANKS = [0, 1, 2, 250, 499, 500, 501, 750, 999, 1000, 1001]


def check(spark, rows, schema, kinds):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = selection.select_ranks(df, {k: F.col(k) for k in kinds}, "id", dict.fromkeys(kinds, RANKS))
    place = {f.name: n for n, f in enumerate(df.schema.fields)}
    for k in kinds:
        order = sorted(((r[place[k]], r[0]) for r in rows), key=lambda r: (r[0], r[1].encode() if isinstance(r[1], str) else r[1]))
        for rank in RANKS:
            if 1 <= rank <= len(rows):
                assert got[k, rank] == order[rank - 1], (k, rank)
            else:
                assert (k, rank) not in got


def test_numbers_ties_and_heavy_tails(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(1000) * 7_000_000_000_000_000 - 2**61  # as far apart as longs allow, almost
    rows = [(int(i), float(np.exp(rng.normal(0, 20))), int(rng.integers(0, 3)), 4, int(rng.integers(-(2**63), 2**63 - 1))) for i in ids]
    check(spark, rows, "id long, tail double, few int, one int, wide long", ["tail", "few", "one", "wide"])


def test_strings(spark):
    rng = np.random.default_rng(1)
    names = list({"".join(rng.choice(list("abé"), rng.integers(0, 30))) for _ in range(1600)})[:1000]
    rows = [(name, int(rng.integers(0, 2))) for name in names]
    check(spark, rows, "id string, few int", ["few"])


def test_decimals_apart_by_less_than_a_double_tells(spark):
    from decimal import Decimal

    rows = [(i, Decimal(10**24 + (i * 37) % 1000)) for i in range(1000)]
    check(spark, rows, "id long, money decimal(38,0)", ["money"])


def test_nothing_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "id long, v int")
    assert selection.select_ranks(empty, {"v": F.col("v")}, "id", {"v": [1]}) == {}
    with pytest.raises(ValueError, match="repeats"):
        selection.select_ranks(spark.createDataFrame([(1, 1)] * 20, "id long, v int"), {"v": F.col("v")}, "id", {"v": [3]})
