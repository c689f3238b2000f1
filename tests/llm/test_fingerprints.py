from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from paceline.llm import fingerprints as fp
from paceline.llm.queries import QUERIES


def jaccard(a, b):
    a, b = (Counter(x.encode().lower().split()) for x in (a, b))
    return (a & b).total() / max((a | b).total(), 1)


def test_edits_and_likeness(spark, sf_dir, documents):
    docs = documents.sort_values("doc_id")
    texts = docs.text.tolist()
    found = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    error = []
    for doc, text, following in zip(docs.doc_id, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == np.mean([r.fingerprint[i : i + 4] == r.edited_fingerprint[i : i + 4] for i in range(0, 256, 4)])
        error += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert abs(np.mean(error)) < 0.01 and np.mean(np.abs(error)) < 0.05


@pytest.mark.parametrize(("a", "b"), [("x y z", "x y z w"), ("a a a b", "a b b b"), ("x " * 50 + "y " * 5, "x " * 30 + "z"), ("p q", "r s")])
def test_collision_rate_is_the_similarity(a, b):
    p, q = fp.fingerprints([a.encode(), b.encode()], samples=4000)
    assert fp.likeness(p, q) == pytest.approx(jaccard(a, b), abs=0.03)


def test_neighbours_in_a_batch_do_not_matter(documents):
    texts = [t.encode() for t in documents.text[:30]]
    together = fp.fingerprints(texts)
    for i, t in enumerate(texts):
        assert (fp.fingerprints([b"other words", t])[1] == together[i]).all()


def test_gamma_quantiles():
    x = fp.gamma_quantiles()
    assert x.mean() == pytest.approx(2, abs=0.01) and x.var() == pytest.approx(2, abs=0.03)


def test_order_does_not_depend_on_ranges(spark, documents, monkeypatch):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    whole = sorted(map(str, fp.compare_edits(df).collect()))
    monkeypatch.setattr(fp, "RANGE", 7)
    assert sorted(map(str, fp.compare_edits(df.repartition(5)).collect())) == whole


def test_odd_rows(spark, odd, empty):
    rows = fp.compare_edits(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # The row without an id is first; of two rows with one id the other follows, and the last is followed by the first.
    assert by[None][0].edited_sha256 == hashlib.sha256("no id here, and yet a text"[:13].encode()).hexdigest()
    assert sum(r.near_next == 1.0 for r in by[4]) == 1
    assert by[2][0].n_chars == 0 and set(by[2][0].fingerprint) == {"0"}
    assert fp.compare_edits(empty).collect() == []
    (one,) = fp.compare_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert one.near_next == 1.0
    assert fp.add_fingerprints(odd).columns == [*odd.columns, "fingerprint"]
