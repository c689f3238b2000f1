from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import toxicity as tx
from paceline.llm.common import held_out
from paceline.llm.queries import QUERIES


def kernel(s, t, length=tx.LENGTH, decay=tx.DECAY):
    """Sum over all pairs of equal subsequences, by enumeration."""
    total = 0.0
    for a in itertools.combinations(range(len(s)), length):
        for b in itertools.combinations(range(len(t)), length):
            if all(s[i] == t[j] and s[i].isalpha() for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize("s", ["idiot", "id.iot", "toidi", "iiddiioott", "i d i o t", "abc", "häßlich", "xidxioxtx"])
def test_kernel(s):
    for t in ("idiot", "stupid", "abcabc", "häßlich"):
        own = kernel(t, t)
        similar = (kernel(s, t) / np.sqrt(kernel(s, s) * own)) ** tx.POWER if kernel(s, s) else 0.0
        # Close calls at the floor aside.
        assert abs(similar - tx.FLOOR) > 1e-3
        similar = similar if similar >= tx.FLOOR else 0.0
        held = min(tx.NEARLY * similar**1.5 * min(kernel(s, t) / own, 1) ** tx.POWER, 1)
        one, two = tx.compare([s, "zz"], [tx.Landmark(t, tx.DECAY, tx.LENGTH)])
        assert (one[0, 0], two[0, 0]) == (pytest.approx(similar, abs=1e-4), pytest.approx(held, abs=2e-3))


def test_landmarks_of_one_length_are_compared_together(monkeypatch):
    strings = [a + b + c + d for a, b, c, d in itertools.product("abc", repeat=4)]
    landmarks = [tx.Landmark(t, tx.DECAY, tx.LENGTH) for t in ("abca", "bcab", "cabc", "aabb", "bbcc")]
    alone = [tx.compare([s], [k]) for s in strings for k in landmarks]
    calls = []
    monkeypatch.setattr(tx, "_kernel", lambda *a, f=tx._kernel: calls.append(1) or f(*a))
    similar, held = tx.compare(strings, landmarks)
    assert len(calls) == 2
    assert similar.ravel().tolist() == [float(one[0, 0]) for one, _ in alone]
    assert held.ravel().tolist() == [float(two[0, 0]) for _, two in alone]


def test_shared_letters_bound_the_similarity():
    rng = random.Random(3)
    for t in ("idiot", "moron", "disgusting", "aabbc", "häßlich", "abcdefghijklmno"):
        landmark = tx.Landmark(t, tx.DECAY, tx.LENGTH)
        for _ in range(60):
            s = "".join(rng.choice(t + "xyz ") for _ in range(rng.randrange(3, 9)))
            if own := kernel(s, s):
                similar = (kernel(s, t) / np.sqrt(own * kernel(t, t))) ** tx.POWER
                has = {c: np.array([chr(c) in s]) for c in landmark.letters}
                assert similar <= landmark.bound[landmark.shared(has)[0]] + 1e-5


def test_windows():
    assert tx.sentences("An Idiot! you i  d i \u00a0o t\n.. ok a b\nx") == [["an", "idiot"], ["i d i o t", "you"], ["ok", "a", "b"], ["x"]]
    assert all(len(w) <= tx.LONGEST for w in tx.windows("x" * 1000))
    # Ten letters, spelled with blanks, lie in one part wherever they are.
    for size in range(19, 90):
        letters = "".join(chr(0x4E00 + i) for i in range(size))
        parts = tx.windows(letters)
        assert all(any(letters[i : i + 19] in p for p in parts) for i in range(size - 18))
    assert tx.sentences("") == []


def test_neighbours_that_may_be_one_word():
    table = tx.Rows(["idiot", "stupid", "other"], 2)
    flat = "what an id iot so st up id is the green house idi ot i diot".split()
    sentence = np.array([0] * 12 + [1] * 4)
    joined = {" ".join(flat[i : i + n]) for at, n in table._joined(table.codes(flat), sentence) for i in at.tolist()}
    assert {"id iot", "st up id", "idi ot", "i diot"} <= joined
    assert not any("house" in j or "green" in j for j in joined)
    # What is left out is not as similar as neighbours must be able to be.
    for i in range(len(flat) - 1):
        text = " ".join(flat[i : i + 2])
        if sentence[i] == sentence[i + 1] and text not in joined and len(text) <= 7:
            assert tx.similarities([text], ["idiot", "stupid"]).max() < tx.JOINED


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    words = ["house", "water", "thing", "other", "green", "table", "under", "house", "going", "money", "oron", "sting"]
    texts, labels = [], []
    for i in range(400):
        found = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                k = rng.randrange(6)
                found[k] = found[k].replace(".", f" {rng.choice(['idiot', 'moron', 'stupid'])}.")
        texts.append(" ".join(found))
        labels.append(bad)
    return tx.fit_texts(texts, labels)


GAPPED = "i.d.i.o.t|i d i o t|i  d  i  o  t|stu-pid|idiiot|stuppid|id iot|mo  ron|st up id|ixdiot|morqon|stupxid"


@pytest.mark.parametrize("word", ["idiot", "moron", "stupid", *GAPPED.split("|")])
def test_gapped_insults_are_found(spark, model, word):
    df = spark.createDataFrame([(f"the house is green. what {word} says so. going under water.",), ("the house is green. oron sting.",)], "text string")
    bad, good = tx.score(df, model).collect()
    assert bad.predicted == 1 and bad.worst_sentence == 1
    assert good.predicted == 0


INSULTS = "idiot moron stupid trash scum loser clown".split()


def test_insults_with_gaps_and_insertions(spark, sf_dir):
    """Fitted as the query fits, on the largest table: no gap or insertion hides an insult, and few harmless texts are hit."""
    sf = sf_dir.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    held = held_out(F.col("doc_id"), 4)
    model = tx.fit(labels.where(~held).join(docs, "doc_id"))
    variants = []
    for w in INSULTS:
        for k in range(1, len(w)):
            variants += [w[:k] + gap + w[k:] for gap in (" ", "  ", "x", "q", "e", ".", "-")]
    rows = [(v, f"the house is green. what {v} says so. going under water.") for v in [*INSULTS, *variants]]
    scored = tx.score(spark.createDataFrame(rows, "variant string, text string"), model)
    assert [(r.variant, r.score) for r in scored.where("predicted = 0").collect()] == []
    rest = tx.score(labels.where(held).join(docs, "doc_id"), model).groupBy("toxic").agg(F.sum("predicted"), F.count("*")).collect()
    found = {r[0]: (r[1], r[2]) for r in rest}
    assert found[1][0] / found[1][1] > 0.75
    assert found[0][0] / found[0][1] < 0.016


def test_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    found = QUERIES["op7_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    ranks = sorted(rows, key=lambda r: r.score)
    bad = [k for k, r in enumerate(ranks) if r.toxic]
    n = len(bad) * (len(ranks) - len(bad))
    area = (sum(bad) - len(bad) * (len(bad) - 1) / 2) / n
    assert area > 0.6


def test_odd_rows(spark, odd, empty, model):
    rows = tx.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.worst_sentence for r in rows if r.doc_id in (1, 2, 3)} == {None}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert tx.score(empty, model).collect() == []
    untrained = tx.fit(empty.select("doc_id", "text", F.lit(1).alias("toxic")))
    assert {r.predicted for r in tx.score(odd, untrained).collect()} == {0}
