"""Edge cases and brute-force checks of the training-data operators on small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stockroom.llm import decontamination, html_text, language_id, near_duplicates, quality_rules, recurrent_lm, source_mix, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
LONG = " ".join(f"word{i % 97} and the{i}" for i in range(400))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", "x"),
    (2, "the cat sat on the mat and looked at the moon", "en", "a", "x"),
    (2, "the cat sat on the mat and looked at the moon", "en", "a", "x"),
    (3, None, "en", None, "x"),
    (4, "", None, "b", "x"),
    (None, "le chat est sur la table et regarde la lune", "fr", "b", "x"),
    (5, LONG, "en", "a", "x"),
    (6, LONG + " tail", "en", "a", "x"),
    (7, "le chien est sur la route et regarde le soleil", "fr", "c", "x"),
    (8, "12 34 !!", "fr", "c", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_token_files_round_trip(spark, docs, nothing, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "TEXT_BYTES", 500)
    encode = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER)).encode
    got = sorted(token_files.token_files(docs).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(nothing).count() == 0


def test_seekable_file_reads_one_document_and_finds_damage(tmp_path):
    path = tmp_path / "f.zst"
    with open(path, "wb") as f:
        writer = token_files.SeekableWriter(f)
        for doc_id in (3, None, 9):
            writer.add(doc_id, np.arange(doc_id or 1, dtype="<u4").tobytes())
        writer.finish()
    with open(path, "rb") as f:
        assert token_files.SeekableReader(f, path.stat().st_size).documents(9)[0].tolist() == list(range(9))
    data = bytearray(path.read_bytes())
    data[14] ^= 255
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):  # noqa: B017, PT011
        token_files.SeekableReader(f, len(data)).documents(3)


def test_word_split_of_slices_equals_python():
    from stockroom.llm.common import slices, words_of

    texts = ["Là É b", None, "", " x\ty\x0bz ", "Ç" * 50, "a\x85b c d"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for part in slices(batch, 0, 60):
        found = words_of(part.column(0))
        split = [[found.distinct[c] for c in found.codes[a:b]] for a, b in zip(found.starts, found.starts[1:], strict=False)]
        assert split == [words(t) for t in part.column(0).to_pylist()]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    rng = np.random.default_rng(size)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = [(i, " ".join(f"q{k}" if rng.random() < rate else w for k, w in enumerate(base))) for i, rate in enumerate(rng.choice([0, 0.004, 0.01, 0.03, 0.3], 90))]
    rows += [(100 + i, " ".join(f"v{j}" for j in rng.integers(0, 4, n))) for i, n in enumerate(rng.integers(0, 14, 60))]
    rows += [(200, None), (201, ""), (None, "w1 w2 w3"), (0, rows[0][1])]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    for _ in sets:
        moved = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], moved = comp[b], True
        if not moved:
            break
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None
        else:
            assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), comp[row.doc_id])


def test_near_duplicates_of_nothing(spark, nothing):
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_decontamination_finds_exact_and_near_items(spark, nothing):
    item = " ".join(f"alpha{i}" for i in range(40))
    near = item.replace("alpha39", "omega")
    rows = [(1, f"some words before. {item.upper()}, and after"), (2, f"x {near} y"), (3, "nothing of it here at all"), (4, None), (5, "two words"), (None, item)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {(1, 7), (2, 7), (None, 7), (5, 10)}
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [3, 4]
    assert decontamination.leaks(nothing, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_multi_index_returns_every_fingerprint_within_radius():
    rng = np.random.default_rng(0)
    stored = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = stored[:40].copy()
    for i in range(40):
        for bit in rng.choice(64, rng.integers(0, 26), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(bit)
    got = {(int(q), int(s)) for q, s, _ in zip(*decontamination.MultiIndex(stored).within(queries), strict=True)}
    distance = np.bitwise_count(queries[:, None] ^ stored[None, :])
    assert got == {(int(q), int(s)) for q, s in np.argwhere(distance <= decontamination.RADIUS)}


def test_source_mix_edge_cases(spark, docs, nothing):
    rows = source_mix.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.size == len(words(t)) or r.size >= 0 for r, (_, t, *_) in zip(rows, ROWS, strict=False))
    assert all(r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9 for r in rows)
    assert math.isclose(sum({r.source: r.target for r in rows}.values()), 1.5 * sum(r.size for r in rows))
    assert source_mix.mix(nothing).count() == 0
    assert source_mix.mixed(docs).columns == docs.columns


def test_html_main_text():
    page = "<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class='ad'>Buy, now. Long, advert.</div><article><h1>Head</h1><p>One &amp; two,\n three.<p><b>Four<br>five</article><footer>foot</footer></body>"
    assert html_text.main_text(page) == "Head\n\nOne & two, three.\n\nFour five"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p><div></p>") == ""
    assert html_text.main_text("a < b <p") == html_text.main_text("a < b <p")


def test_html_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("x", 1)]


def test_quality_counts_and_guards(spark, docs):
    rows = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality(docs.select("doc_id", "text"), []).collect()}
    assert (3, 0, 0, True, False) in rows
    text = "a b c\na b c\n\nx # %"
    one = dict(zip(quality_rules._ARROW.names, (c[0].as_py() for c in quality_rules.judge(pa.array([text]), [])), strict=True))
    assert (one["n_words"], one["word_chars"], one["n_symbols"], one["n_dup_lines"], one["n_repeat_words"]) == (9, 9, 2, 1, 6)


def test_language_id_defined_results(spark, docs, nothing):
    model = language_id.learn(docs.select("text", "lang"))
    got = {(r.doc_id, r.text): r for r in language_id.identify(docs, model).collect()}
    assert got[3, None].lang_pred == got[4, ""].lang_pred == got[8, "12 34 !!"].lang_pred == "und"
    assert got[7, ROWS[8][1]].lang_pred == "fr"
    assert got[1, ROWS[0][1]].lang_pred == "en"
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(nothing.select("text", "lang"))).collect()} == {"und"}


def test_toxicity_learns_marked_words_and_handles_nothing(spark, docs):
    rng = np.random.default_rng(0)
    plain = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), 60), rng.integers(0, 999, 60), strict=True)) for _ in range(400)]
    toxic = np.arange(400) % 4 == 0
    texts = [t + " vilestword grimmestword" if bad else t for t, bad in zip(plain, toxic, strict=True)]
    score = toxicity.fit(texts, toxic).score(pa.array([*texts, None, ""]))
    assert score[:400][toxic].min() > 0.5 > score[:400][~toxic].max()
    assert score[400] == score[401] < 0.5
    assert {r.score for r in toxicity.judge(docs, toxicity.fit(texts, np.zeros(400, bool))).collect()} == {0.0}


def test_language_model_base_score_and_state(spark, docs, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "HEAD", 5)  # so that most words go through the join
    plain = docs.select("doc_id", "text")
    model, counts = recurrent_lm.learn(plain.where("doc_id != 7"))
    seen = Counter(w for i, t, *_ in ROWS if i not in (7, None) for w in [*words(t), b"\n"])
    n, v = sum(seen.values()), len(seen)
    for row in recurrent_lm.score(plain, model, counts.df).join(plain.distinct(), "doc_id", "inner").collect():
        tokens = [*words(row.text), b"\n"]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(seen[w] > 0 for w in tokens), n)
        assert math.isclose(row.base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    tokens = (np.array([3, 1, 2, 0, 1, 0]) % model.classes.count).astype(np.int32)
    together = model.network.log_likelihoods(tokens, np.array([0, 4, 6]))  # two texts side by side
    alone = [model.network.log_likelihoods(tokens[a:b], np.array([0, b - a]))[0] for a, b in ((0, 4), (4, 6))]
    assert np.allclose(together, alone, rtol=1e-5)
