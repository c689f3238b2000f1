from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from paceline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
        failed,
    )


def test_base_measures(spark, sf_dir, documents):
    found = quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    assert len(found) == len(text)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_texts_travel_once(spark, odd):
    """The rows that go to Python hold each text in one column, and no copy of it among the others."""
    given = odd.select("doc_id", "text", "lang")
    found = quality.quality(given, references=[])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\btext#\d+", next(x for x in plan.split("\n") if "struct" in x and "Project" in x))) == 1
    assert sorted(map(repr, found.select(*given.columns).collect())) == sorted(map(repr, given.collect()))


def js(p, q):
    p, q = p / max(p.sum(), 1), np.asarray(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt((part(p) + part(q)) / 2)


def plain_verdict(data, lang, references):
    """Distances, nearest language and verdict of one text, by loops."""
    table = quality.class_table()
    classes = np.bincount([c for c in table[list(data)] if c < 7], minlength=7)[:7] if data else np.zeros(7)
    words = Counter(data.split())
    n, best = words.total(), None
    for r in references:
        hist = np.array([words[w] for w in r.words] + [n - sum(words[w] for w in r.words)], float)
        shares, class_shares = np.array([*r.words.values(), 1 - sum(r.words.values())]), r.classes
        if lang == r.lang and n > quality.OWN_SHARE * r.n_words:
            if r.n_words - n < quality.MIN_REFERENCE_WORDS:
                continue
            shares = np.array([max(s * r.n_words - h, 0) for s, h in zip(shares, hist, strict=True)])
            class_shares = np.array([max(s * r.n_chars - c, 0) for s, c in zip(class_shares, classes, strict=True)])
            shares, class_shares = shares / shares.sum(), class_shares / class_shares.sum()
        a = js(classes.astype(float), class_shares) if classes.sum() >= quality.MIN_CHARS else 0.0
        b = js(hist, shares) if n >= quality.MIN_WORDS else 0.0
        # Groups of ranks 1, 2-3, 4-7 and so on, and all other words.
        ranks = [range(2**g - 1, min(2 ** (g + 1) - 1, len(r.words))) for g in range(8)] + [[len(r.words)]]
        grouped = np.array([sum(shares[i] for i in g) for g in ranks])
        far = js(np.array([sum(hist[i] for i in g) for g in ranks]), grouped)
        chance = np.sqrt((np.count_nonzero(grouped) - 1) / (8 * max(n, 1) * np.log(2)))
        nothing = js(np.array([0.0] * (len(ranks) - 1) + [1.0]), grouped)
        limit = min(quality.GROUP_FACTOR * chance + quality.GROUP_MARGIN, quality.GROUP_CEILING * nothing)
        near = b <= quality.WORD_DISTANCE + quality.WORD_CHANCE / max(n, 1) and far <= limit
        fits = a <= quality.CLASS_DISTANCE and (n < quality.MIN_WORDS or near)
        excess = max(a / quality.CLASS_DISTANCE, b / quality.WORD_DISTANCE)
        if best is None or (fits, -excess) > (best[0], -best[1]):
            best = (fits, excess, a, b, r.lang)
    return best


def test_distances_and_verdicts(spark, sf_dir, documents):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    references = quality.language_references(df)
    counts = {lang: Counter(w for t, x in zip(documents.text, documents.lang, strict=True) if x == lang for w in WORD.findall(t)) for lang in documents.lang.unique()}
    assert [r.lang for r in references] == sorted(counts)
    for r in references:
        own = counts[r.lang]
        assert list(r.words) == [w.encode() for w, _ in sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:200]]
        assert r.words[next(iter(r.words))] == pytest.approx(max(own.values()) / own.total())
        assert r.n_words == own.total()
    rows = {x.doc_id: x for x in documents.itertuples()}
    taken_out = 0
    for r in quality.quality(df, references).collect():
        x = rows[r.doc_id]
        fits, _, a, b, nearest = plain_verdict(x.text.encode(), x.lang, references)
        assert (r.class_distance, r.word_distance) == pytest.approx((a, b))
        assert r.nearest == nearest
        assert r.kept == (not r.base_failed and fits)
        taken_out += r.n_words > quality.OWN_SHARE * counts[x.lang].total()
    assert taken_out > 3


def junk(words, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(2, 9))) for _ in range(words))


def test_junk_is_not_its_own_reference(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    # Junk with a language of its own, and chance values of the column.
    rows = [(-1, "xx", junk(300, 1)), (-2, "en", junk(300, 3)), (-3, None, junk(300, 4))]
    rows += [(-10 - i, "yy", junk(500, 5 + i)) for i in range(5)] + [(-100 - i, f"l{i}", "a few words") for i in range(50)]
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    references = quality.language_references(both)
    assert {r.lang for r in references} == {"de", "en", "es", "fr"}
    kept = {r.doc_id: r.kept for r in quality.quality(both, references).collect()}
    assert not any(k for i, k in kept.items() if i < 0)
    alone = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert {i: k for i, k in kept.items() if i >= 0} == alone


def test_a_document_is_judged_by_the_rest_of_its_language(spark, sf_dir, documents):
    english = documents[documents.lang == "en"].text.tolist()
    rows = [(i, "yy", t) for i, t in enumerate(english)] + [(-1, "yy", junk(100_000, 2))]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert not found.where("doc_id = -1").first().kept


ITALIAN = """Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita. Ahi quanto a dir
qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura. Tant' è amara che poco è più morte; ma per
trattar del ben ch' io vi trovai dirò dell' altre cose ch' io vi ho scorte. Io non so ben ridir com' io vi entrai tant' era pieno di
sonno in su quel punto che la verace via abbandonai."""


def test_texts_without_the_words_of_any_language_are_rejected(spark, sf_dir, documents):
    references = quality.language_references(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = [t.encode() for t in documents.text]
    good = [t for t, k in zip(texts, quality.judge(texts, [None] * len(texts), references)["kept"], strict=True) if k]
    rng = np.random.default_rng(3)

    def shuffled(text):
        return " ".join("".join(rng.permutation(list(w))) for w in text.decode().split()).encode()

    def letters(text):
        return b" ".join(bytes(rng.integers(97, 123, len(w)).astype(np.uint8)) for w in text.split())

    assert len(good) > 140
    assert not any(quality.judge([letters(t) for t in good], [None] * len(good), references)["kept"])
    assert np.mean(quality.judge([shuffled(t) for t in good], [None] * len(good), references)["kept"]) < 0.05
    assert not any(quality.judge([ITALIAN.encode()], ["it"], references)["kept"])


def test_own_words_at_any_length_pass(spark, sf_dir):
    references = quality.language_references(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = np.random.default_rng(4)
    for lang, _, words, _, _ in references:
        vocabulary = [w.decode() for w in words] + [f"{lang}e{i}" for i in range(2000)]
        share = [*words.values(), *[(1 - sum(words.values())) / 2000] * 2000]
        texts = [" ".join(rng.choice(vocabulary, n, p=share)).encode() for n in (50, 60, 80, 120, 300, 2000) for _ in range(50)]
        assert np.mean(quality.judge(texts, [None] * len(texts), references, class_limit=1.0)["kept"]) > 0.99


def test_odd_rows(odd, empty):
    found = quality.quality(odd).collect()
    assert len(found) == odd.count()
    assert not any(r.kept for r in found if r.n_words < 50)
    assert {r.n_words for r in found if r.doc_id in (1, 2, 3)} == {0}
    assert quality.quality(empty).collect() == []


def test_without_references_base_rules_decide(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")
    (r,) = quality.quality(df).collect()
    assert r.kept and r.nearest is None
