"""Document fingerprints by consistent weighted sampling.

A text is a bag of words (A-Z in lower case) weighted by their counts. For each of ``SAMPLES`` places, every word draws from
its own hash the numbers r and c (gamma with shape 2) and b (uniform); with weight w it reaches the level t = floor(ln w / r + b)
and the value ln a = ln c - r * (t - b) - r. The word of least value and its level are the sample, so two texts have equal
samples with a probability that is their generalised Jaccard similarity: the sum of smaller counts over that of larger ones.
A fingerprint keeps 16 bits of each (word, level).

Gamma draws come from tables over 16 bits of the hash, in whole units of 2^-30, and all else is integer arithmetic, so
machines and batches cannot differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import chunks, interned, mix, word_hashes, words

SAMPLES = 64
# Ranges of doc_id: documents in one, and about how many there are at most (8 MB of bounds; then they hold more documents).
RANGE = 1000
RANGES = 1 << 20
RANGES_PER_TASK = 4
KEYS_PER_TASK = 2_000_000
# Text bytes handled at a time; each is fingerprinted with its edited text.
CHUNK = 3 << 20
UNIT = 1 << 30
_DRAW_BITS = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST_ID = -(1 << 63)


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 in the middle of each of 2^16 equal parts, by bisection."""
    u = (np.arange(1 << _DRAW_BITS) + 0.5) / (1 << _DRAW_BITS)
    low, high = np.zeros(len(u)), np.full(len(u), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < u
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low


def _tables() -> tuple[np.ndarray, np.ndarray]:
    x = gamma_quantiles()
    return np.round(x * UNIT).astype(np.int64), np.round(np.log(x) * UNIT).astype(np.int64)


def sample(
    hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, codes: np.ndarray, samples: int = SAMPLES
) -> np.ndarray:
    """(texts, samples) samples of several texts. ``hashes``: of the vocabulary; ``codes`` and ``weights``: the words of each
    text, distinct inside it, and their counts; ``bounds``: where each text starts. A text without words gets 0."""
    gamma, log_gamma = _tables()
    out = np.zeros((len(bounds) - 1, samples), np.uint16)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    starts, lengths = bounds[full], (bounds[1:] - bounds[:-1])[full]
    of_text = np.repeat(np.arange(len(full)), lengths)
    many = np.flatnonzero(weights > 1)
    many_codes = codes[many]
    log_w = np.round(np.log(weights[many]) * UNIT).astype(np.int64)
    low = np.uint64((1 << _DRAW_BITS) - 1)
    steps = np.arange(1, samples + 1, dtype=np.uint64) * _STEP
    for k in range(samples):
        h = mix(hashes + steps[k])
        r = gamma[(h & low).astype(np.int64)]
        ln_c = log_gamma[((h >> np.uint64(16)) & low).astype(np.int64)]
        b = (h >> np.uint64(40)).astype(np.int64)
        # At weight 1 the level is 0: ln a = ln c + r * (b - 1), with b in parts of 2^24.
        value = (ln_c + ((r * (b - (1 << 24))) >> 24))[codes]
        level = np.zeros(len(codes), np.uint64)
        if len(many):
            rm, bm = r[many_codes], b[many_codes]
            t = (log_w + ((rm * bm) >> 24)) // np.maximum(rm, 1)
            value[many] = ln_c[many_codes] + ((rm * (bm - (1 << 24))) >> 24) - rm * t
            level[many] = t.astype(np.uint64)
        hit = np.flatnonzero(value == np.minimum.reduceat(value, starts)[of_text])
        # Of equal values the first word in the order of hashes counts.
        at = hit[np.diff(of_text[hit], prepend=-1) > 0]
        out[full, k] = (mix(hashes[codes[at]] + level[at] * _STEP) >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprints(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) samples; an empty text gets zeros."""
    code, codes, bounds = interned([words(t) for t in texts])
    if not code:
        return np.zeros((len(texts), samples), np.uint16)
    hashes = word_hashes(code, len(code))
    # Words numbered by their hash, so that a text's order does not depend on its neighbours.
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(code) + rank[codes]
    distinct, counts = np.unique(key, return_counts=True)
    own = np.concatenate([[0], np.cumsum(np.bincount(distinct // len(code), minlength=len(texts)))])
    return sample(hashes[order], counts, own, distinct % len(code), samples)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def add_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """All columns of ``docs`` with ``fingerprint``, in hexadecimal. Null texts are empty ones; those have zeros alone."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints = fingerprints(batch.column("text").to_pylist(), samples)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([p.astype(">u2").tobytes().hex() for p in prints], pa.string())],
                names=["row", "fingerprint"],
            )

    schema = T.StructType([given.schema["row"], T.StructField("fingerprint", T.StringType())])
    return given.mapInArrow(apply, schema).select("row.*", "fingerprint")


def _bounds(keys: DataFrame) -> np.ndarray:
    """The least key of each range: every so many of the keys in order, which are dealt out by value and sorted there."""
    count = keys.count()
    size = max(RANGE, -(-count // RANGES))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-past % size, batch.num_rows, size)))
            past += batch.num_rows

    dealt = keys.repartitionByRange(max(1, -(-count // KEYS_PER_TASK)), "key").sortWithinPartitions("key")
    return np.unique(dealt.mapInArrow(pick, "key long").toArrow().column("key").to_numpy())


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, last and key, so that inside a part, in order of (last, key, text), rows follow one another.

    Ids are cut into ranges at ids that occur, and the rows at a range's lower end are also the last of the range before
    it (the first range's: of the last one). So each document meets the one that follows it with a single shuffle of the
    texts and no order over the whole table in one task. Null ids come first; documents of one id in order of their texts.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    lower = _bounds(rows.select("key"))
    shared = docs.sparkSession.sparkContext.broadcast(lower)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        """Twice the range, and 1 for a key at its lower end."""
        at = np.searchsorted(shared.value, keys.to_numpy(), side="right") - 1
        return pd.Series(2 * at + (shared.value[at] == keys.to_numpy()))

    dealt = rows.withColumn("place", place("key"))
    part = F.shiftright("place", 1)
    before = F.pmod(part - 1, F.lit(max(len(lower), 1)))
    places = F.array(F.struct(part.alias("part"), F.lit(False).alias("last")))
    extra = F.array(F.struct(before.alias("part"), F.lit(True).alias("last")))
    placed = F.explode(F.when(F.col("place") % 2 == 1, F.concat(places, extra)).otherwise(places))
    dealt = dealt.select("doc_id", "text", "key", placed.alias("p")).select("doc_id", "text", "key", "p.part", "p.last")
    tasks = max(1, -(-len(lower) // RANGES_PER_TASK))
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "last", "key", "text")


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``; the other text is the next document's).

    Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null
    texts are empty ones. The last document is followed by the first, a single one by itself. Two empty texts have
    likeness 1. Only doc_id and text are read.
    """
    ordered = with_next(docs)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last one, and but those that only follow."""
        texts = [r[1] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
        prints = fingerprints([t.encode() for t in texts] + changed, samples)
        own, other = prints[pairs], prints[len(texts) :]
        following = prints[[i + 1 for i in pairs]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array([p.astype(">u2").tobytes().hex() for p in own], pa.string()),
                pa.array([p.astype(">u2").tobytes().hex() for p in other], pa.string()),
                pa.array(likeness(own, other), pa.float64()),
                pa.array(likeness(own, following), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chunks(batches, CHUNK):
            held += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "last")), strict=True)
            if len(held) > 1:
                yield emit(held)
                held = held[-1:]

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return ordered.mapInArrow(apply, schema)
