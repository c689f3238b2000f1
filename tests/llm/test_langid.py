from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import langid
from paceline.llm.queries import QUERIES

WORDS = {"aa": {"the": 5, "then": 2, "this": 1, "a": 3}, "bb": {"der": 4, "dem": 1, "das": 2, "a": 1, "ää": 1}}


def brute(counts, order):
    """Probability of a character after a context, by the textbook recursion."""
    grams = [Counter() for _ in range(order)]
    before = [defaultdict(set) for _ in range(order)]
    for word, n in counts.items():
        x = "\x01" + word + "\x02"
        for end in range(1, len(x)):
            for k in range(order):
                if end - k >= 0:
                    grams[k][x[end - k : end + 1]] += n
                    if end - k - 1 >= 0:
                        before[k][x[end - k : end + 1]].add(x[end - k - 1])
    use = [{g: (n if k == order - 1 or not before[k][g] else len(before[k][g])) for g, n in grams[k].items()} for k in range(order)]
    discount = []
    for k in range(order):
        ones, twos = (sum(v == c for v in use[k].values()) for c in (1, 2))
        discount.append(min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones + twos else 0.5)

    def p(context, c):
        if len(context) < 0:
            return None
        k = len(context)
        lower = p(context[1:], c) if k else 1 / 1000
        own = {g: n for g, n in use[k].items() if g[:-1] == context}
        if not own:
            return lower
        total, d = sum(own.values()), discount[k]
        return max(own.get(context + c, 0) - d, 0) / total + sum(min(n, d) for n in own.values()) / total * lower

    return p


@pytest.mark.parametrize("word", ["the", "thesis", "der", "a", "xyz", "ää", "thendas"])
def test_probabilities_are_interpolated_kneser_ney(word):
    model = langid.fit_counts(WORDS)
    logs, size = langid.word_scores(model, [word, "other"])
    for j, lang in enumerate(model.languages):
        p, x, total = brute(WORDS[lang], langid.ORDER), "\x01" + word + "\x02", 0.0
        for end in range(1, len(x)):
            total += math.log(p(x[max(0, end - langid.ORDER + 1) : end], x[end]))
        assert logs[0, j] == pytest.approx(total, rel=1e-4)
    assert size[0] == len(word) + 1


def test_arrays_are_sorted():
    model = langid.fit_counts(WORDS)
    for keys in (*model.keys, *model.contexts):
        assert (np.diff(keys.astype(object)) > 0).all()


def test_held_out_documents(spark, sf_dir, documents):
    found = {r.doc_id: r for r in QUERIES["op9_identify_language"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    held = [(i, x) for i, x in zip(documents.doc_id, documents.lang, strict=True) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r.held_out} == {i for i, _ in held}
    assert sum(found[i].lang_pred == x for i, x in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_rows(spark, odd, empty):
    model = langid.fit(odd.where(F.col("lang").isNotNull()))
    found = langid.predict(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none
        assert r.rejected or not none
        assert (r.cross_entropy is None) == none
    assert langid.predict(empty, model).collect() == []
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_other_scripts_are_rejected(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df = spark.createDataFrame([(1, "это совсем другой язык и другое письмо " * 5)], "doc_id long, text string")
    assert langid.predict(df, model).first().rejected
