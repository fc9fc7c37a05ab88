"""Language model: float32 throughout training; windows and blocks of texts change no result; classes by ending."""

import numpy as np

from stockroom.llm import recurrent_lm
from stockroom.llm.recurrent_lm import HIDDEN, Adam, Classes, GatedNetwork, Room


def test_training_stays_in_float32():
    net, adam = GatedNetwork(7, np.arange(1, 8, dtype=float)), Adam()
    net.out *= 50  # gradients over the norm of 1 are clipped
    net.train(np.random.default_rng(1).integers(0, 7, 64 * 50).astype(np.int32), 0.01, adam)
    kinds = {a.dtype for moments in (adam.first, adam.second) for a in moments.values()} | {getattr(net, name).dtype for name in net.NAMES}
    assert kinds == {np.dtype(np.float32)}


def test_arrays_used_again_change_no_gradient():
    rng, room = np.random.default_rng(2), Room()
    net = GatedNetwork(9, np.ones(9))
    for steps in (4, 4, 2):  # the last window of a stream is shorter
        given, wanted = rng.integers(0, 9, (steps, 3)), rng.integers(0, 9, (steps, 3))
        state = rng.normal(0, 0.5, (3, HIDDEN)).astype(np.float32)
        grad, after = net.gradients(given, wanted, state, room)
        again, after_again = net.gradients(given, wanted, state)
        assert np.array_equal(after, after_again) and all(np.array_equal(grad[n], again[n]) for n in net.NAMES)


def test_large_logits_are_in_range():
    net = GatedNetwork(5, np.ones(5))
    net.out *= 3000
    grad, _ = net.gradients(np.ones((3, 2), int), np.ones((3, 2), int), np.zeros((2, HIDDEN), np.float32))
    assert all(np.isfinite(g).all() for g in grad.values())
    assert np.isfinite(net.log_likelihoods(np.array([1, 2, 0]), np.array([0, 3]))).all()


def test_blocks_of_texts_are_scored_as_each_alone(monkeypatch):
    monkeypatch.setattr(recurrent_lm, "TEXTS", 3)
    rng = np.random.default_rng(3)
    net = GatedNetwork(6, np.arange(1, 7, dtype=float))
    lengths = [1, 45, 20, 21, 1, 19, 60, 2]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    tokens = rng.integers(0, 6, starts[-1]).astype(np.int32)
    plain = []
    for a, b in zip(starts, starts[1:], strict=False):
        state, total, before = np.zeros((1, HIDDEN), np.float32), 0.0, 0
        for token in tokens[a:b]:
            state = net.step(np.array([before]), state)[0]
            total += float(net.log_softmax(state)[0, token])
            before = token
        plain.append(total)
    assert np.allclose(net.log_likelihoods(tokens, starts), plain, rtol=1e-5)


def test_classes_go_by_the_last_two_characters():
    head = [(f"own{i}".encode(), 10**6 - i) for i in range(recurrent_lm.OWN_CLASSES)]
    words = ["walking", "sing.", "g", "café", "é", "été!", "...", "it's'", "x\x80"]
    classes = Classes.build(head + [(w.encode(), 5) for w in words])
    other = classes.count - 1
    tried = [w.encode() for w in words] + [b"\xff", b"a\xff", b"new", b"own3"]
    plain = [classes.words[w] if w in classes.words else classes.endings.get(Classes.ending(w), other) for w in tried]
    assert classes.of(tried).tolist() == plain
