"""Token files: texts cut at once give the tokenizer's own ids, and spellings that lower-case alike are encoded once."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stockroom.llm import token_files

TEXTS = [
    "It's the cat's CAT, isn't it?! 2024 a1b2 'x' \"'s\" ... we'LL",
    "Über straße ÀÖØÞ ñandú, ça été; ÿ naïve",
    "5 × 3 ÷ 2 µ ª º – dash “quoted” İstanbul ǅ Ωmega ΣΑΣ 漢字 кот é",
    "<|endoftext|> a<|b <| |> <|startoftext|>x",
    "ctrl\x00\x1cchars\x7f \x85  nbsp em",
    " \t\n\x0b\x0c\r ",
    "",
    None,
]


@pytest.fixture
def encode():
    return token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))


def test_ids_are_the_tokenizers(encode, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_PIECES", 5)
    for _ in range(3):  # later rounds move entries between the generations
        for text, packed in zip(TEXTS, encode.payloads(pa.array(TEXTS)), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_spellings_that_lower_case_alike_are_encoded_once(encode):
    encode.payloads(pa.array(["Word, word. WORD! (word) Über über,"]))
    assert sorted(encode.young) == sorted(t.encode() for t in ("word", ",", ".", "!", "(", ")", "über"))


PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")


def test_pre_tokens_of_many_texts_are_the_patterns(encode):
    rng = random.Random(8)
    parts = ["'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'l", "'r", "s", "é", "ÿ", "a", "9", " ", "\n", "!", "\x00", "\x1c"]
    odd = ["É", "×", "漢", "<|", "|>", "<|endoftext|>", "İ", "\xa0", "²"]
    for _ in range(40):
        text = "".join(rng.choices(parts, k=rng.randrange(200))).encode()
        assert token_files.pre_tokens(text, [])[0].to_pylist() == PATTERN.findall(text)
        texts = ["".join(rng.choices(parts + odd * (i % 2), k=rng.randrange(30))) for i in range(30)]
        for own, packed in zip(texts, encode.payloads(pa.array(texts)), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == encode.tokenizer.encode(own, add_special_tokens=False).ids, own


def test_repeated_words_cost_less_than_a_python_object_each(encode):
    texts = pa.array(["the thing, and that one; it's 5 of them. " * 2000] * 10)

    def one_by_one():
        return [b"".join(map(encode.young.__getitem__, PATTERN.findall(text.lower()))) for text in texts.cast(pa.binary()).to_pylist()]

    def seconds(work):
        spent = []
        for _ in range(5):
            began = time.process_time()
            work()
            spent.append(time.process_time() - began)
        return min(spent)

    assert encode.payloads(texts) == one_by_one()
    assert seconds(lambda: encode.payloads(texts)) < 0.8 * seconds(one_by_one)
