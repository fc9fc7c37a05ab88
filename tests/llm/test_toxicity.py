"""Toxicity: the threshold stays where it is when the training sample is cut."""

import numpy as np
import pyarrow as pa

from stockroom.llm import toxicity


def marked_texts(n):
    rng = np.random.default_rng(0)
    plain = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), 30), rng.integers(0, 40, 30), strict=True)) for _ in range(n)]
    toxic = np.arange(n) % 10 == 0
    marked = rng.random(n) < np.where(toxic, 0.8, 0.1)  # the mark alone does not settle it
    return [t + " vilestword" if m else t for t, m in zip(plain, marked, strict=True)], toxic


def test_threshold_does_not_move_with_the_sample(spark, monkeypatch):
    texts, toxic = marked_texts(10_000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_OF_A_CLASS", 900)  # both classes reach it
    score = toxicity.learn(docs, labels).score(pa.array(texts))
    assert abs(score.mean() - 0.1) < 0.03  # calibrated: one text in ten is toxic
