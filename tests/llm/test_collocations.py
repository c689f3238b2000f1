from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm import collocations as c
from paceline.llm.common import word_hashes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(docs, longest=3, least=10, kept=2000):
    """The contract word for word over (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + size])) for i in range(len(ws) - size + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, ws), a in candidates.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                inner = (lang, ws[i : i + size])
                if 100 * a >= 50 * f[inner]:
                    covered.add(inner)
    by_lang = {}
    for (lang, ws), a in candidates.items():
        if (lang, ws) in covered:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, ws[:k]], f[lang, ws[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    out = []
    for lang, rows in by_lang.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:kept]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


TEXTS = st.lists(st.text(alphabet="ab .\n\t\r,;A\x1cé", max_size=40), min_size=1, max_size=5)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_tokens(texts):
    texts = [t for t in texts if any(pieces(t))] or ["a"]
    data, sizes = c.normal([t.encode() for t in texts], 2)
    found = c.Tokens(data)
    spelled = [data[a:b].decode() for a, b in zip(found.start, found.end, strict=True)]
    bounds = np.searchsorted(found.end, np.cumsum(sizes)).tolist()
    assert [t != "\n" for t in spelled] == found.is_word.tolist()
    for text, a, b in zip(texts, [0, *bounds], bounds, strict=False):
        assert spelled[a:b][-2:] == ["\n", "\n"]
        runs = " ".join(spelled[a:b]).split("\n")
        assert [r.split(" ") for r in (r.strip(" ") for r in runs) if r] == [p for p in pieces(text) if p]


@pytest.mark.parametrize("segment", [3, 50, 1 << 20])
def test_equal_tokens_have_equal_hashes_wherever_they_are(monkeypatch, segment):
    monkeypatch.setattr(c, "SEGMENT", segment)
    words = ["a", "b", "ab", "ba", "aa", "aab", "aba", "baa", "\x00", "\x00\x00", "é", "a" * 300, "a" * 299 + "b"]
    picked = np.random.default_rng(2).integers(0, len(words), 500)
    found = c.Tokens("".join(f"{words[i]} " for i in picked).encode())
    for seed in (0, 1):
        by_word = {}
        for i, h in zip(picked.tolist(), found.hashes(seed).tolist(), strict=True):
            by_word.setdefault(i, set()).add(h)
        assert all(len(h) == 1 for h in by_word.values())
        assert len(set().union(*by_word.values())) == len(words)


def test_shared_hashes_do_not_mix_phrases(monkeypatch):
    """With five hashes in all most phrases collide in one of the two; they are still told apart by the other."""
    real = c.Tokens.hashes
    monkeypatch.setattr(c.Tokens, "hashes", lambda self, seed=0: real(self, seed) % np.uint64(5) if seed == 0 else real(self, seed))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": pa.array([b"a b c d e f g h a b c d e f g h \n \n"], pa.binary()), "copies": [1]})
    found = c.Parsed(batch, 2)
    everything = c.Filter(1, np.full(8, 255, np.uint8))
    rows = list(c._phrases(found, [everything], found.tokens.hashes(1), 1))
    assert sorted(rows[0][2].split(b"\n")) == [x.encode() for x in "abcdefgh"]
    assert np.frombuffer(rows[0][3], "<i8").tolist() == [2] * 8


@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(1, 3), st.integers(2, 9))
@settings(max_examples=200, deadline=None)
def test_chunks_hold_each_start_once(texts, overlap, most):
    flat = [t for text in texts for t in [*text, *[0] * overlap]]
    bounds = np.cumsum([0, *[len(t) + overlap for t in texts]])
    hashes = np.concatenate([[0], word_hashes((str(i).encode() for i in range(6)), 6)]).astype(np.uint64)
    begin, end, owner = c.cut(hashes[flat], bounds, overlap, 3, most)
    starts = [i for a, b in zip(begin, end, strict=True) for i in range(a, b)]
    assert starts == [i for a, b in zip(bounds[:-1], bounds[1:] - overlap, strict=True) for i in range(a, b)]
    assert all(bounds[o] <= a and b + overlap <= bounds[o + 1] for a, b, o in zip(begin, end, owner, strict=True))
    assert (end - begin <= most).all()


def test_equal_passages_give_equal_chunks(spark):
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 5000, 2000)]
    passage = " ".join(words)
    docs = spark.createDataFrame([(f"some words in front {passage} and behind", "en"), (f"others {passage}", "en")], "text string, lang string")
    chunks = c.dictionary(docs).collect()
    assert sum(r.words for r in chunks if r.copies == 2) > 1500
    assert sum(r.words * r.copies for r in chunks) == 2 * 2000 + 7


def corpus(seed, texts=80):
    rng = np.random.default_rng(seed)
    words = np.array(["the", "of", "new", "york", "city", "hall", "Big", "apple.", "a,", "b\n", "ü", "x\tz", "\n"])
    share = 1 / np.arange(1, len(words) + 1)
    out = [(" ".join(rng.choice(words, rng.integers(0, 60), p=share / share.sum())), ["en", "de", None, "und"][i % 4]) for i in range(texts)]
    return out + [out[3]] * 40


@pytest.mark.parametrize(("longest", "least", "kept"), [(3, 10, 2000), (3, 3, 5), (2, 10, 2000), (4, 4, 2000)])
def test_against_plain_counts(spark, monkeypatch, longest, least, kept):
    # Parts, gatherings and filters as small as the corpus, so that there are several of each.
    for name, value in (("GATHERED", 500), ("PART_HASHES", 300), ("TEXT_BYTES", 2000), ("PART_PHRASES", 40), ("TRIGGER", 4)):
        monkeypatch.setattr(c, name, value)
    docs = corpus(longest)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(6)
    assert found(c.collocations(df, longest, least, kept)) == plain(docs, longest, least, kept)


def test_a_part_is_never_held_whole():
    """Counts of the same phrases from many places, 50 MB of them, are added up in the memory of a few."""
    spelled = b"\n".join(b"some words %d" % i for i in range(2000))
    held = []

    def batches():
        for _ in range(1000):
            times = pa.array([np.ones(2000, "<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["en"]), pa.array([spelled], pa.binary()), times], ["part", "lang", "phrases", "times"])
            held.append(pa.total_allocated_bytes())

    rows = [r for b in c._added(batches(), 10) for r in b.to_pylist()]
    assert len(rows) == 2000 and rows[7] == {"lang": "en", "phrase": b"some words 7", "words": 3, "times": 1000}
    assert max(held) - held[0] < 5_000_000


def test_parts_of_phrases_are_short():
    # As many phrases as half a GB of text has; each part's rows are gathered by one task.
    assert c.phrase_parts(0) == 1
    assert 1_700_000 / c.phrase_parts(1_700_000) <= 30_000


def test_adding_up_gives_memory_back_first():
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    held = [np.ones(8_000) for _ in range(4_000)]
    del held[:-1]
    before = resident()
    assert list(c._added(iter([]), 10)) == []
    assert before - resident() > 150_000_000


def test_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "MOST_BITS", 8)
    docs = corpus(9)
    assert found(c.collocations(spark.createDataFrame(docs, "text string, lang string"))) == plain(docs)


def test_products_beyond_64_bits(spark):
    big = 10**12
    phrases = [("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, 2 * big)]
    rows = c.score(spark.createDataFrame(phrases, "lang string, phrase string, words int, times long")).collect()
    assert [r.score for r in rows] == [10**6 * (2 * big) ** 2 // (3 * big * (2 * big + 1))]


def test_odd_rows(spark, odd, empty):
    docs = [(r.text, r.lang) for r in odd.collect()]
    assert found(c.collocations(odd, least=2)) == plain(docs, least=2)
    assert c.collocations(empty).count() == 0


def test_one_word_many_times(spark):
    docs = [("word " * 100_000, "en"), ("x" * 200_000, "en"), ("word word", "de")]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert found(c.collocations(df)) == plain(docs)
