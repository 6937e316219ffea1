"""Pieces of texts in the token store's encoder: each different one goes to the library once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cloakwork.llm import forced_bpe, token_store

SIGNS = [
    "a", "B", "é", "the", "9", "²", "Ⅷ", "ß", "×", "漢", "😀", "…", "'", "'s", '"', ".", ",", "...", "!?", "||", "<|endoftext|>", "<|", "|>", "-", "%%%",
    " ", " ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\t", "\x1c", "\x85", " ", "　", "", ")", "]", "}", "ɏ", "ɐ", "Я", "ा",
]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_ids_are_those_of_the_library(path, library):
    draw = random.Random(3)
    texts = ["", None, "\n", "\n\n", "a\n", "\na", ".", "a.", "a.\n", "a. ", " a.", "dogs'.", "<|endoftext|>.", "x<|endoftext|.", "a\n.\nb"]
    texts += ["".join(draw.choices(SIGNS, k=draw.choice((1, 2, 5, 20, 60)))) for _ in range(3_000)]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for encoder in (token_store.Encoder(path), forced_bpe.ForcedEncoder(path)):
        for _ in range(2):  # from the library, then from memory
            ids, at = encoder.encode(pa.array(texts, pa.string()), 2)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
        ids, at = encoder.encode(pa.array([], pa.string()), 2)
        assert len(ids) == 0 and at.tolist() == [0]


def handed_over(encoder, monkeypatch):
    """Gets every text that the library is given."""
    given, batch = [], encoder._batch
    monkeypatch.setattr(encoder, "_batch", lambda texts: given.extend(texts) or batch(texts))
    return given


def test_a_word_is_encoded_once_whatever_follows_it(path, library, monkeypatch):
    encoder = token_store.Encoder(path)
    given = handed_over(encoder, monkeypatch)
    words = [f"wor{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    text = "start " + " ".join(w + t for t in ("", ".", ",", "...", ".\nStart", "%%%") for w in words)
    ids, _ = encoder.encode(pa.array([text]), None)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, given)) < 2 * sum(len(w) + 1 for w in words)


def test_what_was_met_again_is_not_forgotten(path, monkeypatch):
    encoder = token_store.Encoder(path)
    monkeypatch.setattr(token_store, "MOST_WORDS", 100)
    often = " ".join(f"oft{chr(97 + k)}" for k in range(26))
    for k in range(6):
        given = handed_over(encoder, monkeypatch)
        encoder.encode(pa.array([f"the {often} " + " ".join(f"rare{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30))]), None)
        assert k == 0 or not any("ofta" in t for t in given)
        assert len(encoder.known) <= 100 + 57
        monkeypatch.undo()
        monkeypatch.setattr(token_store, "MOST_WORDS", 100)


def test_slices_do_not_show_in_the_store(path, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [None if k % 50 == 7 else " ".join(draw.choice(["one", "two.", "three,\nFour", "fünf", "six"], int(draw.integers(0, 900)))) for k in range(200)]
    rows = pa.record_batch({"doc_id": pa.array(range(200), pa.int64()), "text": pa.array(texts, pa.string()), "source_row": pa.array(range(200), pa.int64())})
    batches = [rows.slice(k, 30) for k in range(0, 200, 30)] + [rows.slice(0, 0)]

    def made():
        out = [r for b in token_store._encode_task(path, 2)(iter(batches)) for r in b.to_pylist()]
        return [r for r in out if r["kind"] == "recipe"], sorted((r["digest"], r["body"]) for r in out if r["kind"] == "chunk")

    whole = made()
    assert [r["doc_id"] for r in whole[0]] == list(range(200))
    for slice_bytes, ids in ((1, 1), (5_000, 700), (10_000, 10**9), (10**9, 2_000)):
        monkeypatch.setattr(token_store, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(token_store, "CUT_IDS", ids)
        assert made() == whole
