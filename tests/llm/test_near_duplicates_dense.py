"""A large group of texts around one text, most of them just too far apart to link."""

import numpy as np

from stockroom.llm import near_duplicates as nd


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 300))) for _ in range(2))
        b = np.union1d(b[: rng.integers(0, 30)], a[: rng.integers(0, len(a) + 1)])
        differ = np.bitwise_count((nd.parity_bits(a) ^ nd.parity_bits(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_dense_group_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 60, 110)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.integers(1, 9)):
            at = int(rng.integers(len(words)))
            words[at : at + 1] = [[], [words[at], "w3"], [f"w{rng.integers(0, 60)}"]][rng.integers(3)]
        rows.append((i, " ".join(words)))
    rows += [(3, rows[7][1]), (3, "other words than all the rest here"), (11, rows[400][1])]  # ids with several texts
    sets = [(i, frozenset(tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2))) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i != j and 100 * len(a & b) >= 90 * len(a | b):
                x, y = top(i), top(j)
                comp[max(x, y)] = min(x, y)
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert 20 < len({top(i) for i, _ in rows}) < 480
    assert {r.doc_id: r.component_id for r in found} == {i: top(i) for i, _ in rows}
