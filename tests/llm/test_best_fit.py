from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paceline.llm import best_fit, packing
from paceline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


def check(rows, texts, tokenizer, length=4096):
    """``texts``: (doc_id, text) of every document. Whole pieces, gapless sequences, nothing short is cut."""
    expected = Counter()
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            expected[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)


def by_the_rule(sizes, length):
    """The rule word for word: every open window is tried, and the sum of squares counted anew."""
    gaps, out = [], []
    for size in sizes:
        tried = []
        for window, gap in enumerate(gaps):
            if gap >= size:
                after = Counter(g for g in [*gaps[:window], gap - size, *gaps[window + 1 :]] if g)
                tried.append((sum(n * n for n in after.values()), gap, window))
        if tried:
            best = min(tried)[:2]
            out.append(best[1])
            gaps[max(w for *b, w in tried if tuple(b) == best)] -= size
        else:
            out.append(length)
            gaps.append(length - size)
    return out


def test_all_documents(spark, sf_dir, documents, tokenizer):
    rows = QUERIES["op11_pack_best_fit"](spark, sf_dir).collect()
    sequences = check(rows, list(zip(documents.doc_id, documents.text, strict=True)), tokenizer)
    assert sequences <= -(-sum(r.length for r in rows) // 4096) + 1


@given(st.lists(st.integers(1, 30), max_size=40))
@settings(max_examples=100, deadline=None)
def test_follows_the_rule(sizes):
    placed = best_fit.place(sizes, 30)
    levels, gaps = Counter(), []
    for size, (window, offset) in zip(sizes, placed, strict=True):
        assert levels[window] == offset
        gaps.append(30 - offset)
        levels[window] += size
    assert all(n <= 30 for n in levels.values())
    assert gaps == by_the_rule(sizes, 30)


def test_near_the_least_number_of_windows():
    sizes = sorted(np.random.default_rng(3).geometric(1 / 800, 6000).clip(1, 4095).tolist(), reverse=True)
    assert max(w for w, _ in best_fit.place(sizes)) + 1 <= -(-sum(sizes) // 4096) + 1


def test_many_groups(spark, tokenizer):
    texts = [(i % 7, "a b c " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check(best_fit.pack(docs, length=64, group=20).collect(), texts, tokenizer, 64)


def test_exact_fits_leave_no_gap():
    assert [w for w, _ in best_fit.place([60, 60, 40, 40], 100)] == [0, 1, 1, 0]
    assert best_fit.place([100, 100], 100) == [(0, 0), (1, 0)]
    assert best_fit.place([]) == []


def test_odd_rows(spark, odd, empty, tokenizer):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(best_fit.pack(odd).collect(), texts, tokenizer)
    assert best_fit.pack(empty).count() == 0


def test_very_long_text(spark, tokenizer):
    texts = [(1, "lorem ipsum " * 40_000), (2, "x" * 30_000), (3, None)]
    check(best_fit.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, tokenizer)
