from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_ranks(docs, items, kept):
    """The contract word for word: docs and items as (id, text)."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    length = sum(c.total() for _, c in counted)
    having = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 50 + (50 * c.total() * n_docs) // length if length else 50
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(plain_terms(text))
                if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for i, (score, none, doc) in enumerate(sorted(found)[:kept]):
            out.append((item, i + 1, None if none else doc, -score))
    return sorted(out, key=repr)


def ranked(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_terms(text):
    assert lexical.terms(text.encode()) == [t.encode() for t in plain_terms(text)]


def corpus(count, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    share /= share.sum()
    return [(int(i), " ".join(rng.choice(words, rng.integers(0, 40), p=share))) for i in range(count)]


@pytest.mark.parametrize(("bucket", "kept", "block"), [(16, 5, 1 << 20), (1000, 50, 1 << 20), (7, 1, 60)])
def test_against_plain_scores(spark, bucket, kept, block):
    docs = corpus(300, 1)
    # A third of all rows are copies, so the last rank is often tied.
    docs += [(1000 + i, docs[5][1]) for i in range(150)]
    items = [(i, t) for i, (_, t) in enumerate(corpus(12, 2))]
    found = lexical.rank(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
        kept,
        bucket,
        block,
    )
    assert ranked(found) == plain_ranks(docs, items, kept)


def test_bounds_leave_out_only_what_scores_less():
    rng = np.random.default_rng(4)
    for _ in range(30):
        docs, words = 200, 30
        dense = rng.integers(1, 10**6, (docs, words)) * (rng.random((docs, words)) < 0.2)
        dense[dense.sum(1) == 0, 0] = 1
        weights = np.sort(rng.integers(0, 9000, words))[::-1].copy()
        norms = np.sqrt((weights * dense.astype(float) ** 2).sum(1))
        dense, norms = dense[np.argsort(-norms)], -np.sort(-norms)
        own, codes = np.nonzero(dense)
        bounds = np.searchsorted(own, np.arange(docs + 1))
        bucket = lexical.Bucket(np.arange(docs), norms, bounds, codes, dense[own, codes])
        query = np.flatnonzero((rng.random(words) < 0.4) & (weights > 0))
        scores = dense[:, query] @ weights[query]
        zeros = np.zeros(words, np.int64)
        for least in [0, *np.quantile(scores, [0.5, 0.9, 0.99, 1]).astype(int).tolist()]:
            found = bucket.survivors(query, weights, least)
            assert set(np.flatnonzero((scores >= least) & (scores > 0))) <= set(found)
            assert (bucket.scores(found, query, weights, zeros) == scores[found]).all()
        # The bounds do rule something out.
        assert len(bucket.survivors(query, weights, int(scores.max()))) < docs / 2


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "one text"), (1, "one text"), (1, "MIXED"), (2, None), (3, ""), (None, "word id"), (4, "absent")]
    given_items = spark.createDataFrame([(*i, 1, 2.0) for i in items], "item_id long, text string, rank long, score double")
    assert ranked(lexical.rank(odd, given_items)) == plain_ranks(docs, [items[0], *items[2:]], 50)
    assert lexical.rank(empty, given_items).count() == 0
    assert lexical.rank(odd, given_items.limit(0)).count() == 0


def test_very_long_texts(spark):
    docs = [(1, "needle " + "hay " * 300_000), (2, "needle hay"), (3, "x" * 400_000), (4, "other")]
    items = [(0, "needle x hay " + "y" * 100_000)]
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(found) == plain_ranks(docs, items, 50)
