"""Language model: a row without doc_id keeps the counts of its words outside the head."""

from stockroom.llm import recurrent_lm


def test_null_id_keeps_its_counts(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "HEAD", 2)
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text), (2, "one two one two seven"), (None, text)], "doc_id long, text string")
    model, counts = recurrent_lm.learn(docs.where("doc_id is not null"))
    rows = {r.doc_id: (r.n_known, r.base_score, r.score) for r in recurrent_lm.score(docs, model, counts.df).collect()}
    assert rows[None] == rows[1] and rows[1][0] == 7
