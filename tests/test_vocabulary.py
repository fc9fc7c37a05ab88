"""One-hot vocabularies: whole, sorted, and an error where a table could not hold their columns."""

import pytest

from stockroom.operators import features


def test_vocabulary_is_whole_or_an_error(spark, monkeypatch):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "region string")
    assert features._vocabulary(df, "region") == ["a", "b", "c"]
    assert features._vocabulary(df.limit(0), "region") == []
    monkeypatch.setattr(features, "MOST_CATEGORIES", 3)
    assert features._vocabulary(df, "region") == ["a", "b", "c"]
    monkeypatch.setattr(features, "MOST_CATEGORIES", 2)
    with pytest.raises(ValueError, match="region has more than 2"):
        features._vocabulary(df, "region")
