"""Quality counts against a plain recount, with upper case, ties and long texts."""

import re

import numpy as np
import pyarrow as pa
import pytest

from stockroom.llm import quality_rules
from stockroom.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def recount(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def judged(texts, refs=()):
    columns = quality_rules.judge(pa.array(texts, pa.string()), list(refs))
    return list(zip(*(c.to_pylist() for c in columns[:6]), strict=True))


def test_case_matters_to_repeats():
    assert judged(["The cat sat here. the cat sat there"])[0][4] == 0
    assert judged(["The Cat sat. The Cat sat."])[0][4] == recount("The Cat sat. The Cat sat.")[4] == 6


def test_random_texts_in_both_cases():
    rng = np.random.default_rng(6)
    pool = ["The", "the", "THE", "cat", "Cat", "é", "É", "#x", "a|b", "\n", "\n\n", "\t", " "]
    texts = [" ".join(rng.choice(pool, n)) for n in rng.integers(0, 200, 150)] + [None, "", " \n ", "Word word " * 30_000]
    assert judged(texts) == [recount(t) for t in texts]


@pytest.mark.parametrize("lower", [True, False])
def test_references_do_not_tell_cases_apart(spark, lower):
    ref = quality_rules.references(spark.createDataFrame([("the cat and the dog " * 60, "en")], "text string, lang string"))
    text = "the cat and the dog " * 60
    distance = quality_rules.judge(pa.array([text if lower else text.upper()]), ref)[8].to_pylist()
    assert distance == quality_rules.judge(pa.array([text]), ref)[8].to_pylist()


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: tuple(r)[1:7] for r in quality_rules.quality(docs.select("doc_id", "text"), []).drop("text").collect()}
    for r in docs.select("doc_id", "text").collect():
        assert found[r.doc_id] == recount(r.text), r.doc_id
