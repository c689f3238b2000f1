from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from paceline.llm import components, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    """Per row: number of shingles and the smallest id that links reach."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(
        (str((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))
    )


def found(df, width, percent):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.linked(df, width, percent).collect())


def near_copies(seed, groups, copies, words, edits):
    """Groups of documents, each a base text with up to so many words changed, and unrelated ones among them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(words)] = word()
            rows.append(" ".join(text))
        rows.append(" ".join(base[: words // 2] + [word() for _ in range(words // 2)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "edits"), [(3, 90, 4), (5, 80, 6)])
def test_near_copies_against_all_pairs(spark, width, percent, edits):
    rows = near_copies(1, 12, 6, 120, edits) + [(900 + i, t) for i, t in near_copies(2, 10, 5, 14, 1)]
    rows = [(i + 1000 * (i >= 900), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width, percent) == brute(rows, width, percent)


def test_crowded_signatures(spark, monkeypatch):
    # Small limits send these groups through frequent classes, forests and several blocks.
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SKETCH", 1 << 14)
    rows = near_copies(3, 1, 150, 100, 5) + [(500 + i, t) for i, t in near_copies(4, 2, 60, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 3, 90) == brute(rows, 3, 90)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for frequent in (0.5, 1.5):
        for size in (9, 10, 16, 31, 64, 100, 300):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                b = a.copy()
                lost = rng.choice(len(a), ngram_join.allowed(len(a), 90), replace=False)
                b = np.unique(np.delete(b, lost))
                load = np.ones(1024, np.int64)
                both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                if both >= 0.9:
                    one, two = (ngram_join.signatures(x, load, frequent, 90) for x in (a, b))
                    assert len(np.intersect1d(one, two))


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(2))
        a = np.union1d(a, b[: rng.integers(0, 50)])
        apart = np.bitwise_count(ngram_join.parity(a) ^ ngram_join.parity(b)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, 3, 90) == brute(rows, 3, 90)
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 6]
    assert ngram_join.linked(empty).collect() == []
    assert ngram_join.one_of_each(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 199), (5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_bits_take_an_eighth_of_a_byte():
    rows = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 5000)
    byte, bit = ngram_join.bit_of(rows)
    packed = np.zeros(ngram_join.NEEDED // 8, np.uint8)
    np.bitwise_or.at(packed, byte, bit)
    assert int(np.bitwise_count(packed).sum()) == len(np.unique(rows & (ngram_join.NEEDED - 1)))
    others = np.arange(200_000)
    byte, bit = ngram_join.bit_of(others)
    assert np.array_equal((packed[byte] & bit) != 0, np.isin(others, rows & (ngram_join.NEEDED - 1)))
