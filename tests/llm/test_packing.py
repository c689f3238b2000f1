from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import packing
from paceline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


@pytest.fixture(scope="module")
def encoder():
    with open(packing.tokenizer_file(), encoding="utf-8") as file:
        return packing.WordEncoder(file.read())


def check(rows, texts, tokenizer):
    """Every id in one piece, pieces gapless in sequences of at most 2048."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return by_sequence


def test_all_documents(spark, sf_dir, documents, tokenizer):
    rows = QUERIES["op8_pack_sequences"](spark, sf_dir).collect()
    sequences = check(rows, dict(zip(documents.doc_id, documents.text, strict=True)), tokenizer)
    assert sum(r.length for r in rows) >= 0.98 * 2048 * (len(sequences) - 1)


@pytest.mark.parametrize(
    "text",
    ["", " \n", "İstanbul ΣΑΣ שׁלום Å K ﬁx ǅ", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "it's IT'S 'S o'clock' x'. ,'s", "5th, 12.5%  naïve.%% É!! x́..", "\x1c \x1d z y w 中文。 ก็. ﷺ,"],
)
def test_words_encode_as_the_text_does(text, encoder, tokenizer):
    (ids,) = encoder.encode([text.encode()])
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(encoder, tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = encoder.encode([text.encode()])
    assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_each_distinct_word_is_looked_up_once_a_call(encoder):
    class Counting(dict):
        looked_up = 0

        def get(self, key, default=None):
            self.looked_up += 1
            return super().get(key, default)

    one = packing.WordEncoder(encoder.tokenizer.to_str())
    one.known = Counting()
    texts = [b"  some words\x0b\x1cand\r\nsome more, more. "] * 50 + [b"", b" \t"]
    out = [bytes(ids) for ids in one.encode(texts)]
    assert one.known.looked_up <= 10
    (ids,) = encoder.encode(texts[:1])
    assert out == [bytes(ids)] * 50 + [b"", b""]
    assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(texts[0].decode(), add_special_tokens=False).ids


@settings(deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=60))
def test_windows_hold_every_piece_once(sizes):
    windows = packing.pack_sizes(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_differencing_evens_out():
    # The textbook case for two ways, and near equality for many.
    assert sorted(s for s, _ in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    found = packing.difference([i % 97 + 1 for i in range(400)], 10)
    assert found[0][0] - found[-1][0] <= 2


@pytest.mark.parametrize("n", [1, 127, 128, 2047, 2048, 2049, 4096, 10_000])
def test_pieces_make_up_a_document(n):
    pieces = packing.piece_lengths(n)
    assert sum(pieces) == n and all(0 < p <= 2048 for p in pieces)


def test_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert all(r.length == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert packing.pack(empty).collect() == []
