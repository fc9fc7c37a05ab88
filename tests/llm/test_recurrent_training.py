"""Language model: gradients against finite differences; rounds learn over every task's texts."""

import numpy as np

from stockroom.llm import recurrent_lm
from stockroom.llm.recurrent_lm import HIDDEN, GatedNetwork


def network(classes):
    made = GatedNetwork(classes, np.arange(1, classes + 1, dtype=float))
    for name in made.NAMES:
        setattr(made, name, getattr(made, name).astype(np.float64))
    return made


def loss(net, given, wanted, state):
    states = []
    for now in given:
        state = net.step(now, np.where((now == 0)[:, None], 0, state))[0]
        states.append(state)
    flat = np.concatenate(states)
    return -net.log_softmax(flat)[np.arange(len(flat)), wanted.ravel()].mean()


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(5)
    net = network(7)
    given, wanted = rng.integers(0, 7, (6, 3)), rng.integers(0, 7, (6, 3))
    state = rng.normal(0, 0.5, (3, HIDDEN))
    grad, _ = net.gradients(given, wanted, state)
    for name in net.NAMES:
        weights = getattr(net, name)
        for place in rng.choice(weights.size, min(12, weights.size), replace=False):
            at = np.unravel_index(place, weights.shape)
            kept, losses = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                losses.append(loss(net, given, wanted, state))
            weights[at] = kept
            assert np.isclose(grad[name][at], (losses[0] - losses[1]) / 2e-5, rtol=1e-4, atol=1e-8), name


def test_weights_round_trip():
    net = GatedNetwork(9, np.ones(9))
    again = net.with_weights(net.weights())
    assert all(np.array_equal(getattr(net, n), getattr(again, n)) for n in net.NAMES)


def test_rounds_learn_an_order_and_average_all_tasks(spark):
    """Words that follow each other in a fixed order: the trained network foresees them."""

    rows = [(i, " ".join(["red", "green", "blue"] * 60)) for i in range(6000)] + [(None, "red"), (6000, None), (6001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, counts = recurrent_lm.learn(docs.where("doc_id is not null"))
    scored = recurrent_lm.score(spark.createDataFrame([(1, " ".join(["red", "green", "blue"] * 20)), (2, " ".join(["blue", "green", "red"] * 20))], "doc_id long, text string"), model, counts.df)
    found = {row.doc_id: row.score for row in scored.collect()}
    assert found[1] > found[2] + 5


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, counts = recurrent_lm.learn(docs)
    row = recurrent_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts.df).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score < 0


def test_every_training_text_is_learned_from_once(spark, monkeypatch):
    seen = []

    def note(texts, classes, network, rate):
        seen.extend(row.text for row in texts.collect())
        return network

    monkeypatch.setattr(recurrent_lm, "train_round", note)
    recurrent_lm.learn(spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string"))
    assert sorted(seen) == sorted(f"text {i}" for i in range(200))
