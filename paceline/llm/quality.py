"""Quality rules: repetition counts, and divergence of a document from references of its language.

A reference per language is counted over all documents that carry the language: shares of character classes, and
shares of its most common words. A document is compared with every reference by Jensen-Shannon distance (base 2,
0 to 1) over both histograms; it is kept when some language is near in both. A language of few documents or words is no
reference, and a document that makes up much of its language is compared with the rest of it. Histograms of few characters or words
say little, so below ``min_chars`` and ``min_words`` a distance has no vote.

Over 200 common words an honest short text is as far as one without any of them, so that distance finds words that are
used too much. Words that are missing show in the groups of common words (ranks 1, 2-3, 4-7 and so on): a text without
common words is just as far over groups, and chance spreads far less. A text is near when its distance over groups is
within ``GROUP_FACTOR`` times what chance gives at its length plus ``GROUP_MARGIN``, and always below that of a text without
common words. Some garbled texts of up to about 200 words that keep short words by luck still pass.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import WORD, chunks, interned, raw, segment_sum, stage

#: lower case, upper case, digit, sentence mark, symbol, other ASCII, other letter or sign
CLASSES = 7
MARKS = b".,;:'\"?!()-"
SYMBOLS = b"#*$%&|<>"
COMMON = 200
MIN_CHARS = 200
MIN_WORDS = 50
CLASS_DISTANCE = 0.31
WORD_DISTANCE = 0.53
# By chance short texts are further from their own language over single words, by about this over their number of words.
WORD_CHANCE = 3.0
# Limit over groups of words: so many times what chance gives, and a margin for what sets texts of a language apart.
GROUP_FACTOR = 1.9
GROUP_MARGIN = 0.05
# Share of the distance of a text without common words that no limit exceeds.
GROUP_CEILING = 0.9
# Documents and words that a language needs to be a reference, and the share of its words from which on a document is taken out of
# the reference that judges it.
MIN_DOCUMENTS = 10
MIN_REFERENCE_WORDS = 2000
OWN_SHARE = 0.02
# Distinct words that a task holds before it hands their counts on.
HELD = 150_000

REFERENCE = "lang string, kind int, word binary, n long"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " class_distance double, word_distance double, nearest string, kept boolean"
)


def class_table() -> np.ndarray:
    """Class of each byte; white space and the later bytes of a character have none (CLASSES)."""
    table = np.full(256, 5, np.uint8)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[list(MARKS)] = 3
    table[list(SYMBOLS)] = 4
    table[0x80:0xC0] = CLASSES
    table[0xC0:] = 6
    table[[0x20, *range(0x09, 0x0E)]] = CLASSES
    return table


def class_counts(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """(documents, CLASSES) counts of characters outside white space."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts), dtype=np.int64) * (CLASSES + 1), size)
    of += table[np.frombuffer(b"".join(texts), np.uint8)]
    return np.bincount(of, minlength=len(texts) * (CLASSES + 1)).reshape(len(texts), CLASSES + 1)[:, :CLASSES]


def repeated_words(codes: np.ndarray, bounds: np.ndarray, distinct: int) -> np.ndarray:
    """Per document, the words that lie in a three-word window that the document has twice or more."""
    n = len(bounds) - 1
    total = np.zeros(n, np.int64)
    if len(codes) < 3:
        return total
    doc = np.repeat(np.arange(n), np.diff(bounds))
    same = doc[2:] == doc[:-2]
    # Pairs, then triples, are renumbered before they are put together, so keys stay exact within 64 bits.
    _, pair = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1].astype(np.int64) * distinct + codes[2:], return_inverse=True)
    key = triple.astype(np.int64) * n + doc[2:]
    key[~same] = -1
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero((count[number] > 1) & same)
    hit = np.zeros(len(codes), bool)
    for shift in range(3):
        hit[twice + shift] = True
    return segment_sum(hit.astype(np.int64), bounds)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of counts ``p`` from the shares ``q``; rows without counts are at distance 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def group_limits(shares: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Largest distance over groups of words, per text length; ``shares`` has the groups and, last, all other words."""
    nothing = np.zeros((1, len(shares)))
    nothing[0, -1] = 1
    # For counts drawn from the shares, 8 n ln(2) times the squared distance is nearly chi-squared.
    chance = np.sqrt((np.count_nonzero(shares) - 1) / (8 * np.maximum(n_words, 1) * np.log(2)))
    return np.minimum(GROUP_FACTOR * chance + GROUP_MARGIN, GROUP_CEILING * js_distance(nothing, shares)[0])


class Reference(NamedTuple):
    """A language's shares of the character classes and of its most common words, and its numbers of words and characters."""

    lang: str
    classes: np.ndarray
    words: dict[bytes, float]
    n_words: int
    n_chars: int


def language_references(
    docs: DataFrame, common: int = COMMON, min_documents: int = MIN_DOCUMENTS, min_words: int = MIN_REFERENCE_WORDS
) -> list[Reference]:
    """Per language with enough documents that hold a word, and enough words: shares of the character classes, and of its
    ``common`` most frequent words.

    Counted over all documents with a language; equal counts are ordered by the word. Languages of too few documents are left out
    first, so a column of many chance values makes no more references. The driver gets a few hundred rows per language:
    the classes (kind 0), the words (1) and how many words there are (2).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = class_table(), 0
        tally: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))

        def flush() -> pa.RecordBatch:
            rows = [(lang, 1, w, n) for lang, c in tally.items() for w, n in c.items()]
            rows += [(lang, 0, bytes([i]), int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
            rows += [(lang, 2, b"", c.total()) for lang, c in tally.items()]
            tally.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))],
                names=["lang", "kind", "word", "n"],
            )

        for batch in chunks(batches):
            texts, langs = raw(batch.column("text")), batch.column("lang").to_pylist()
            for lang, text, row in zip(langs, texts, class_counts(texts, table), strict=True):
                tally[lang].update(text.split())
                classes[lang] += row
            held = sum(map(len, tally.values()))
            if held > HELD:
                yield flush()
        yield flush()

    texts = docs.where(F.col("lang").isNotNull()).select("lang", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    worded = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(WORD)).groupBy("lang").agg(F.count("*").alias("n"))
    enough = stage(worded.where(F.col("n") >= min_documents).select("lang"), "languages")
    given = texts.join(enough, "lang", "left_semi")
    counts = given.mapInArrow(count, REFERENCE).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    ranked = counts.select(
        "*",
        F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")).alias("rank"),
    )
    top = ranked.where(F.col("rank") <= max(common, CLASSES)).collect()
    totals = {r.lang: r.n for r in top if r.kind == 2 and r.n >= min_words}
    shares: dict[str, tuple[np.ndarray, dict[bytes, float]]] = {lang: (np.zeros(CLASSES), {}) for lang in totals}
    for r in sorted((r for r in top if r.lang in totals), key=lambda r: (r.lang, r.kind, -r.n, bytes(r.word))):
        classes, words = shares[r.lang]
        if r.kind == 0:
            classes[r.word[0]] = r.n
        elif r.kind == 1 and len(words) < common:
            words[bytes(r.word)] = r.n / totals[r.lang]
    return [
        Reference(lang, classes / classes.sum(), words, totals[lang], int(classes.sum()))
        for lang, (classes, words) in sorted(shares.items())
        if classes.sum() > 0 and words
    ]


def without(shares: np.ndarray, total: int, counts: np.ndarray) -> np.ndarray:
    """Shares of what is left when some of the counts are taken out; the last share is that of all else."""
    left = np.maximum(shares * total - counts, 0)
    return left / max(left.sum(), 1)


def word_groups(common: int) -> np.ndarray:
    """First places of the groups of ranks (1, 2-3, 4-7, ...) among ``common`` words, and of all other words."""
    group = np.floor(np.log2(np.arange(1, common + 1))).astype(np.int64)
    return np.flatnonzero(np.append(np.diff(group, prepend=-1) > 0, True))


def judge(
    texts: list[bytes],
    langs: list[str | None],
    references: list[Reference],
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    class_limit: float = CLASS_DISTANCE,
    word_limit: float = WORD_DISTANCE,
) -> dict[str, object]:
    """Measures and verdicts of several texts, as columns; ``langs`` are the languages whose references they helped to make."""
    n = len(texts)
    code, codes, bounds = interned([t.split() for t in texts])
    n_words = np.diff(bounds)
    classes = class_counts(texts, class_table())
    repeats = repeated_words(codes, bounds, max(len(code), 1))
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    doc = np.repeat(np.arange(n), n_words)
    best, passes = np.full(n, np.inf), np.zeros(n, bool)
    at, class_best, word_best = np.full(n, -1), np.zeros(n), np.zeros(n)
    sides = np.array([x if x is not None else "" for x in langs], object)
    for k, reference in enumerate(references):
        common = len(reference.words)
        column = np.full(max(len(code), 1), common, np.int64)
        for i, w in enumerate(reference.words):
            if w in code:
                column[code[w]] = i
        hist = np.bincount(doc * (common + 1) + column[codes], minlength=n * (common + 1)).reshape(n, common + 1)
        shares = np.fromiter(reference.words.values(), float, common)
        shares = np.append(shares, max(1 - shares.sum(), 0.0))
        starts = word_groups(common)
        in_groups = np.add.reduceat(hist, starts, axis=1)

        def compare(some, class_shares, shares, hist=hist, in_groups=in_groups, starts=starts):
            """Distances over classes, words and groups of words, and the limit of the last."""
            grouped = np.add.reduceat(shares, starts)
            limit = group_limits(grouped, n_words[some])
            return js_distance(classes[some], class_shares), js_distance(hist[some], shares), js_distance(in_groups[some], grouped), limit

        found = compare(slice(None), reference.classes, shares)
        lacking = np.zeros(n, bool)
        for i in np.flatnonzero((sides == reference.lang) & (n_words > OWN_SHARE * reference.n_words)).tolist():
            if reference.n_words - n_words[i] < MIN_REFERENCE_WORDS:
                lacking[i] = True
                continue
            rest = without(reference.classes, reference.n_chars, classes[i]), without(shares, reference.n_words, hist[i])
            for whole, own in zip(found, compare(slice(i, i + 1), *rest), strict=True):
                whole[i] = own[0]
        by_class, by_word, by_group, limit = found
        by_word[n_words < min_words] = 0.0
        by_class[classes.sum(axis=1) < min_chars] = 0.0
        # How far the worse of the two is beyond its limit: 1 at the limit.
        excess = np.maximum(by_class / class_limit, by_word / word_limit)
        near = (by_word <= word_limit + WORD_CHANCE / np.maximum(n_words, 1)) & (by_group <= limit)
        fits = (by_class <= class_limit) & ((n_words < min_words) | near)
        fits, excess = fits & ~lacking, np.where(lacking, np.inf, excess)
        # A language that fits comes before one that does not.
        nearer = (fits > passes) | ((fits == passes) & (excess < best))
        best[nearer], at[nearer], passes[nearer] = excess[nearer], k, fits[nearer]
        class_best[nearer], word_best[nearer] = by_class[nearer], by_word[nearer]
    names = [r.lang for r in references]
    return {
        "n_words": n_words,
        "word_chars": classes.sum(axis=1),
        "n_symbols": classes[:, 4],
        "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeats,
        "base_failed": failed,
        "class_distance": class_best,
        "word_distance": word_best,
        "nearest": [names[k] if k >= 0 else None for k in at],
        "kept": ~failed & (passes | (at < 0)),
    }


def quality(docs: DataFrame, references: list | None = None, **limits) -> DataFrame:
    """All columns of ``docs`` with the measures, the distances to the nearest language and the verdict ``kept``.

    Null and empty texts have no words and fail the base rules. Without any reference (no language has enough documents) the
    base rules decide alone, and so they do for a document that makes up much of every reference. Columns of the input that are named like a measure are replaced. Repeated rows each
    get their verdict. One pass over the texts per call, and one before it for the references unless given.
    """
    references = language_references(docs) if references is None else references
    fields = T.StructType.fromDDL(MEASURES)
    kept = [c for c in docs.columns if c not in fields.names]
    # The texts travel once; the other columns go apart, under names of their own places, so any may be called anything.
    others = {c: f"c{i}" for i, c in enumerate(kept) if c != "text"}
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(at) for c, at in others.items()])
    given = docs.select(row.alias("row"), lang.alias("lang"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = judge(raw(batch.column("text").cast(pa.binary())), batch.column("lang").to_pylist(), references, **limits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("text"),
                    *[pa.array(found[f]) for f in fields.names[:-2]],
                    pa.array(found["nearest"], pa.string()),
                    pa.array(found["kept"]),
                ],
                names=["row", "text", *fields.names],
            )

    schema = T.StructType([given.schema["row"], given.schema["text"], *fields.fields])
    columns = [F.col("text") if c == "text" else F.col(f"row.{others[c]}").alias(c) for c in kept]
    return given.mapInArrow(apply, schema).select(*columns, *fields.names)
