"""Spelling variants against all pairs by hand, and the parts of the search."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stockroom.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, n int, word string, form string"


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, set()
    for word, n in words.items():
        close = [w for w in words if near(word, w)]
        best = min(close, key=lambda w: (-words[w], w), default=None)
        forms[word] = (best if best and words[best] >= 10 * n else None, len(close))
    for word, (form, n_near) in forms.items():
        root = word
        while forms[root][0]:
            root = forms[root][0]
        out.add((word, form, root, words[word], n_near, words.get(form)))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*row, 1, "w", "f") for row in rows], SCHEMA)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.spelling_variants(docs).collect()}


@pytest.mark.parametrize("leaf_words", [2, 64])
def test_equals_all_pairs(spark, monkeypatch, leaf_words):
    monkeypatch.setattr(sv, "LEAF_WORDS", leaf_words)
    rng = np.random.default_rng(leaf_words)
    base = ["".join(rng.choice(list("abcdeé"), n)) for n in rng.integers(7, 10, 60)]
    texts = []
    for i in range(300):
        words = list(rng.choice(base, 40))
        for _ in range(8):  # slips of every kind, two of them for chains
            k = rng.integers(len(words))
            w, at = words[k], rng.integers(len(words[k]))
            words[k] = [w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "Q" + w[at + 1 :]][rng.integers(3)]
        texts.append((i % 250, " ".join(words)))
    chain = "chaineds " * 400 + "chainedss " * 20 + "chainedssz " * 2
    texts += [(900, chain), (901, None), (None, "Nulledid, nulledid ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ"), (902, ""), (903, "short × tiny")]
    texts += [(904, " ".join(["abcabcabc", "bcabcabca", "cabcabcab"] * 3)), (905, "x" * 5000 + " " + "x" * 4999), (905, "x" * 5000 + " " + "x" * 4999)]
    assert found(spark, texts) == expected(texts)


def test_nothing(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None), (2, "once onlyword"), (3, "")]) == set()


def test_one_edit_at_either_end_and_long_words():
    pairs = [("abcdefg", "bcdefg"), ("abcdefg", "abcdef"), ("abcdefg", "xbcdefg"), ("abcdefg", "abcdefx"), ("aaaaaaaa", "aaaaaaa")]
    unlike = [("abcdefg", "abcdefg"), ("abcdefg", "badcefg"), ("abcdefg", "gabcdef"), ("abcdefg", "abcdefghi"), ("abcdefg", "axcdefgx")]
    words = sv.Words([w for pair in pairs + unlike for w in pair])
    a = np.arange(0, 2 * len(pairs + unlike), 2)
    for left, right in ((a, a + 1), (a + 1, a)):
        assert words.one_edit(left, right).tolist() == [True] * len(pairs) + [False] * len(unlike)


def test_every_word_has_one_own_subtree_and_reaches_its_neighbours():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (500, sv.GROUPS)).astype(np.int16)
    counts[:, 8:] = 0
    cut = sv.Cut(counts[:100], 5)
    subtree, word, own = cut.reach(counts)
    home = dict(zip(word[own], subtree[own], strict=True))
    assert len(home) == own.sum() == len(counts)
    reached = set(zip(word, subtree, strict=True))
    for i in range(0, len(counts), 7):
        change = counts - counts[i]
        within = (np.maximum(change, 0).sum(axis=1) <= 1) & (np.maximum(-change, 0).sum(axis=1) <= 1)
        for j in np.flatnonzero(within):
            early, late = sorted((i, j), key=lambda k: home[k])
            assert (early, home[late]) in reached
