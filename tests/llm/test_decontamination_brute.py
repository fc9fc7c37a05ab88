"""Benchmark windows against exact similarity of every window, and texts shorter than an item."""

import numpy as np
import pyarrow as pa

from stockroom.llm import decontamination as dc


def exact(doc, item):
    """Largest weighted similarity of the item to a window of its size (the whole of a shorter text)."""

    (d,), (i,) = (dc.Prepared.of(pa.array([t])) for t in (doc,)), (dc.Prepared.of(pa.array([t])) for t in (item,))
    size, n = len(i.hashes), len(d.hashes)
    bag = dc.shingles(i.hashes, i.lengths)
    windows = [(0, n)] if n < size else [(s, s + size) for s in range(n - size + 1)]
    return max(dc.weighted_similarity(dc.shingles(d.hashes[a:b], d.lengths[a:b]), bag) for a, b in windows)


def test_recall_against_every_window():
    rng = np.random.default_rng(11)
    words = [f"w{k:03d}"[: rng.integers(2, 5)] + str(k) for k in range(500)]
    items = [" ".join(rng.choice(words, rng.integers(20, 70))) for _ in range(25)]
    index = dc.ItemIndex(list(enumerate(items)))
    due = found = 0
    for _ in range(300):
        k = rng.integers(len(items))
        copy = items[k].split()
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(len(copy))
            copy = [copy[:at] + copy[at + 1 :], [*copy[:at], "other", *copy[at + 1 :]], [*copy[:at], "more", *copy[at:]]][rng.integers(3)]
        around = [list(rng.choice(words, n)) for n in rng.integers(0, 40, 2)]
        doc = " ".join([*around[0], *copy, *around[1]])
        hits = {item: similarity for _, item, similarity, *_ in index.search(pa.array([doc]))}
        best = exact(doc, items[k])
        if best >= dc.SIMILARITY:
            due += 1
            found += k in hits and abs(hits[k] - best) < 1e-9
        else:
            assert k not in hits
    assert due > 60
    assert found / due >= 0.98


def test_text_shorter_than_the_item():
    item = " ".join(f"alpha{i}" for i in range(40))
    index = dc.ItemIndex([(7, item)])
    most = item.rsplit(" ", 1)[0]
    ((_, found, similarity, start, n, _),) = index.search(pa.array([most]))
    assert (found, start, n) == (7, 0, 39) and similarity >= 0.9
    assert list(index.search(pa.array([" ".join(item.split()[:20]), "alpha1 alpha2 alpha3", "", None]))) == []
