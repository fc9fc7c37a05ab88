"""Language model: words cut from Arrow's buffer, gates beyond exp's range, blocks of steps, classes by remembered endings."""

import warnings

import numpy as np
import pyarrow as pa

from stockroom.llm import recurrent_lm
from stockroom.llm.common import bytes_of, words_of
from stockroom.llm.recurrent_lm import HIDDEN, Classes, GatedNetwork


def test_bytes_of_slices_and_empty_arrays():
    values = pa.array(["ab", "", "é", "word"], pa.large_string())
    assert bytes_of(values) == [b"ab", b"", "é".encode(), b"word"]
    assert bytes_of(values[1:3]) == [b"", "é".encode()] and bytes_of(values[:0]) == []
    assert words_of(pa.array([None, " B a ", ""])).distinct == [b"b", b"a"]


def test_gates_beyond_the_range_of_exp_are_closed_without_a_warning():
    net = GatedNetwork(3, np.ones(3))
    net.inputs[1, :HIDDEN], net.inputs[1, HIDDEN : 2 * HIDDEN] = -500, 500
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        _, gates, _ = net.step(np.array([1]), np.zeros((1, HIDDEN), np.float32))
        found = net.log_likelihoods(np.array([1, 2, 0]), np.array([0, 3]))
        net.gradients(np.array([[1], [2]]), np.array([[2], [0]]), np.zeros((1, HIDDEN), np.float32))
    assert (gates[:, :HIDDEN] == 0).all() and (gates[:, HIDDEN:] == 1).all() and np.isfinite(found).all()


def test_the_block_of_steps_changes_no_gradient(monkeypatch):
    rng = np.random.default_rng(4)
    net = GatedNetwork(8, np.ones(8))
    given, wanted = rng.integers(0, 8, (11, 5)), rng.integers(0, 8, (11, 5))
    state = rng.normal(0, 0.5, (5, HIDDEN)).astype(np.float32)
    found = []
    for block in (1, 4, 11, 50):
        monkeypatch.setattr(recurrent_lm, "BLOCK", block)
        found.append(net.gradients(given, wanted, state))
    for grad, after in found[1:]:
        assert np.allclose(after, found[0][1], atol=1e-6)
        assert all(np.allclose(grad[n], found[0][0][n], atol=1e-6) for n in net.NAMES)


def test_a_remembered_ending_is_not_taken_for_another():
    head = [(f"own{i}".encode(), 10**6 - i) for i in range(recurrent_lm.OWN_CLASSES)]
    words = ["sing", "king", "ng", "ng.", "g", "g.", "n.", ".", "é", "né", "own1", "own1."]
    classes = Classes.build([*head, *((w.encode(), 5) for w in words)])
    other = classes.count - 1
    tried = [w.encode() for w in words + words[::-1]]
    assert classes.of(tried).tolist() == [classes.words[w] if w in classes.words else classes.endings.get(Classes.ending(w), other) for w in tried]
