from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm.tokens import LONG, Encoder, Memory

ALPHABET = ["a", "B", "the", "é", "ß", "Σ", "1", "'s", "'", ".", ",", "!?", "-", "_", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\0", "\x85", "\u00a0", "\u0301", "\u3000", "语", "<|endoftext|>", "§", "Ġ", "</w>"]
KINDS = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


@pytest.fixture(scope="module")
def encoders():
    return {name: Encoder(public_tokenizers.path(name), spaces) for name, spaces in KINDS}


def whole(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=4))
def test_ids_are_those_of_whole_texts(encoders, texts):
    for name, _ in KINDS:
        assert encoders[name](texts) == whole(encoders[name], texts)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoders, text):
    text = text.encode(errors="replace").decode()
    for name, _ in KINDS:
        assert encoders[name]([text]) == whole(encoders[name], [text])


def test_fast_path_is_used(encoders):
    assert all(encoders[name].simple for name, _ in KINDS)


def test_memory_stays_bounded_and_right():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True, keep=20, group_chars=50)
    texts = [f"w{i} alpha beta{chr(97 + i % 26)} gamma. delta\nepsilon{chr(97 + i % 7)}" for i in range(200)]
    assert e(texts) == whole(e, texts)
    assert len(e.inner.now) < 200 and len(e.inner.before) < 200


def test_memory_recalls_what_is_used():
    m = Memory(2)
    m.now.update({"a": 1, "b": 2, "c": 3})
    m.rotate()
    assert m.recall({"a", "z"}) == ["z"] and m.now == {"a": 1}


@pytest.mark.parametrize(("name", "spaces"), KINDS)
def test_long_pieces_are_not_remembered(name, spaces):
    e = Encoder(public_tokenizers.path(name), spaces, group_chars=10)
    texts = [f"{'ab' * 60_000}{i} x {'Q9' * 50_000}{i} y.\n{'z' * 100_000}{i}" for i in range(3)] + ["end of it"]
    assert e(texts) == whole(e, texts)
    assert max(len(k) for held in (e.inner.now, e.inner.before, e.first, e.bare, e.tails) for k in held) <= LONG


def test_capitals_in_texts_of_several_scripts():
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["Word WORD, Жук Word. ЖУК!", "WORD only word; Zed"]
    assert e(texts) == whole(e, texts)
