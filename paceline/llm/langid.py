"""Language identification by interpolated Kneser-Ney character models.

Words (runs of letters, in lower case) are read as their letters and an end mark; a character depends on up to
``ORDER - 1`` characters before it in the word, the start mark included. Per language, the highest order is estimated from
counts and each lower one from how many different characters precede a sequence, all with absolute discounting.

A fitted model is a few sorted arrays: for each order the 64-bit hashes of all sequences seen in any language, with
the log probability of their last character in every language, and the hashes of the contexts with their back-off
weights. A text takes the language of lowest cross-entropy per character. The temperature that turns entropies
into a confidence, and the entropy beyond which a prediction is rejected, are set on documents kept from the fit.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import chunks, interned, mix, segment_sum

ORDER = 4
# Documents per language that a model is fitted on, and as many as a fifth of that to calibrate it.
SAMPLE = 500
START, END = 1, 2
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
SCORES = "lang_pred string, score double, cross_entropy double, rejected boolean"
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Model:
    """``keys[k]``, ``values[k]``: sorted hashes and (rows, languages) log probabilities of sequences of k + 1
    characters; ``contexts[k]``, ``weights[k]``: the same for what precedes them, with log back-off weights."""

    languages: list[str]
    keys: list[np.ndarray]
    values: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    limit: float = np.inf


def _characters(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as code points with marks around them; place inside the word; bounds without the start marks."""
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    ends = np.cumsum(size)
    joined = "\x01" + "\x02\x01".join(vocabulary) + "\x02"
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(x)) - np.repeat(ends - size, size)
    return x, place, np.concatenate([[0], np.cumsum(size - 1)])


def _sequences(x: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order, the hash of the k characters that end at each position (0 where a word is too short)."""
    out, total = [], np.zeros(len(x), np.uint64)
    for k in range(order):
        total = total.copy()
        total[k:] += mix(x[: len(x) - k] * _STEP[k] + _STEP[-1 - k]) * _STEP[(k + 1) % 4]
        h = mix(total + np.uint64(k + 1))
        h[place < k] = 0
        out.append(h)
    return out


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fit_counts(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model from word counts per language."""
    languages = sorted(counts)
    grams: list[dict] = []
    for lang in languages:
        vocabulary = sorted(counts[lang])
        weight = np.fromiter((counts[lang][w] for w in vocabulary), np.float64, len(vocabulary))
        x, place, bounds = _characters(vocabulary)
        seqs = _sequences(x, place, order)
        n = np.repeat(weight, np.diff(bounds) + 1)
        per: dict[int, tuple] = {}
        for k in range(order):
            # Sequences that end at a character or end mark, with the context they follow.
            use = (place >= max(k, 1)) if k < order - 1 else (place >= k)
            h, ctx = seqs[k][use], (seqs[k - 1][np.flatnonzero(use) - 1] if k else np.zeros(use.sum(), np.uint64))
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(back, n[use], len(keys))
            if k < order - 1:
                # Lower orders count the different longer sequences; at the start of a word nothing precedes.
                longer = place[use] > k
                pairs = np.unique(np.stack([back[longer].astype(np.uint64), seqs[k + 1][use][longer]]), axis=1)[0]
                kinds = np.bincount(pairs.astype(np.int64), minlength=len(keys)).astype(float)
                c = np.where(kinds > 0, kinds, c)
            short = seqs[k - 1][use][first] if k else np.zeros(len(keys), np.uint64)
            per[k] = (keys, c, ctx[first], short)
        grams.append(per)
    model = Model(languages, [], [], [], [], np.full(len(languages), -np.log(1000.0)))
    lower_of: list[np.ndarray] = []
    for k in range(order):
        keys = _merge([g[k][0] for g in grams])
        contexts = _merge([g[k][2] for g in grams])
        values = np.zeros((len(keys), len(languages)))
        weights = np.zeros((len(contexts), len(languages)))
        shorter = np.zeros(len(keys), np.uint64)
        before = np.zeros(len(keys), np.uint64)
        for per in grams:
            own, _, ctx, short = per[k]
            at = np.searchsorted(keys, own)
            before[at], shorter[at] = ctx, short
        if k:
            lower = np.exp(lower_of[-1])[np.searchsorted(model.keys[-1], shorter)]
        else:
            lower = np.full((len(keys), len(languages)), np.exp(model.floor[0]))
        for j, per in enumerate(grams):
            own, c, ctx, _ = per[k]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones + twos else 0.5
            slot = np.searchsorted(contexts, ctx)
            total = np.bincount(slot, c, len(contexts))
            left = np.bincount(slot, np.minimum(c, discount), len(contexts))
            gamma = np.where(total > 0, left / np.maximum(total, 1e-300), 1.0)
            weights[:, j] = np.log(np.maximum(gamma, 1e-12))
            of = np.searchsorted(contexts, before)
            p = gamma[of] * lower[:, j]
            at = np.searchsorted(keys, own)
            p[at] += np.maximum(c - discount, 0) / total[slot]
            values[:, j] = np.log(np.maximum(p, 1e-30))
        model.keys.append(keys)
        model.values.append(values.astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(weights.astype(np.float32))
        lower_of.append(values)
    return model


def word_scores(model: Model, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word in every language, and the characters it stands for (end mark included)."""
    order = len(model.keys)
    x, place, bounds = _characters(vocabulary)
    seqs = _sequences(x, place, order)
    spots = np.flatnonzero(place >= 1)
    total = np.zeros((len(spots), len(model.languages)), np.float32)
    rest = np.arange(len(spots))
    for k in range(order - 1, -1, -1):
        able = place[spots[rest]] >= k
        now, later = rest[able], rest[~able]
        h = seqs[k][spots[now]]
        keys = model.keys[k]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        total[now[found]] += model.values[k][at[found]]
        missed = now[~found]
        if k:
            ctx = seqs[k - 1][spots[missed] - 1]
            contexts = model.contexts[k]
            c = np.minimum(np.searchsorted(contexts, ctx), max(len(contexts) - 1, 0))
            known = contexts[c] == ctx if len(contexts) else np.zeros(len(ctx), bool)
            total[missed[known]] += model.weights[k][c[known]]
        else:
            total[missed] += model.floor.astype(np.float32) + model.weights[0][0]
        rest = np.concatenate([missed, later])
    return segment_sum(total.astype(np.float64), bounds), np.diff(bounds)


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in every language, and its number of characters."""
    code, codes, bounds = interned([LETTERS.findall(t.lower()) for t in texts])
    if not code:
        return np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    logs, size = word_scores(model, list(code))
    n = segment_sum(size[codes], bounds)
    return -segment_sum(logs[codes], bounds) / np.maximum(n, 1)[:, None], n


def confidence(model: Model, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of the best language; evidence grows with the square root of the length, as neighbours depend."""
    gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / model.temperature
    return 1.0 / np.exp(-gap).sum(axis=1)


def calibrate(model: Model, texts: list[str], langs: list[str], quantile: float = 0.995) -> Model:
    """Set temperature (least log loss) and rejection limit (entropy that all but few right texts stay under)."""
    entropy, n = entropies(model, texts)
    known = np.flatnonzero((n > 0) & np.isin(langs, model.languages)) if len(texts) else np.zeros(0, int)
    if len(known) < 10:
        return model
    truth = np.searchsorted(model.languages, np.array(langs)[known])
    gap = (entropy[known] - entropy[known].min(axis=1, keepdims=True)) * np.sqrt(n[known])[:, None]

    def loss(t: float) -> float:
        z = -gap / t
        return -float(np.mean(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))))

    model.temperature = min(np.geomspace(0.2, 20, 40), key=loss)
    right = entropy[known].argmin(axis=1) == truth
    if right.any():
        best = entropy[known].min(axis=1)[right]
        model.limit = float(np.quantile(best, quantile)) + 0.5
    return model


def _sampled(docs: DataFrame, scale: dict[str, float], low: float, high: float) -> DataFrame:
    """Documents whose hash, a fraction of one times the scale of their language, falls between two bounds."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = F.lit(None).cast("double")
    for lang, x in scale.items():
        rows = F.when(F.col("lang") == lang, F.lit(x)).otherwise(rows)
    return docs.where((spot * rows >= low) & (spot * rows < high)).select("lang", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Fit on about ``sample`` documents per language and calibrate on about a fifth as many others.

    ``docs`` needs doc_id, lang and text; rows without a language are left out. A language with fewer documents gives
    four fifths of them to the fit. Word counts are summed in Spark; the driver gets those of the sample alone.
    """
    langs = {r.lang: r.n for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # A document's hash, scaled so that the fit of each language ends at `sample`.
    scale = {lang: n * sample / min(float(sample), 0.8 * n) for lang, n in langs.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = defaultdict(Counter)
        for batch in chunks(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tally[lang].update(LETTERS.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in tally.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["lang", "word", "n"],
        )

    picked = _sampled(docs, scale, 0.0, float(sample))
    words = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    table = words.toArrow()
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang, {})[word] = n
    if not counts:
        return Model([], [], [], [], [], np.zeros(0))
    model = fit_counts(counts, order)
    held = _sampled(docs, scale, float(sample), sample * 1.25).toArrow()
    return calibrate(model, held.column("text").to_pylist(), held.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    A null text, an empty one and one without a letter get ``und``, score 0, a null entropy, and are rejected. Equal
    entropies: the language first in the alphabet. Without any learned language every text gets ``und``. Columns of
    the input with these names are replaced; other columns may have any name.
    """
    fields = T.StructType.fromDDL(SCORES)
    kept = [c for c in docs.columns if c not in fields.names]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            entropy, n = entropies(model, texts)
            none = n == 0 if model.languages else np.ones(len(texts), bool)
            best = entropy.argmin(axis=1) if model.languages else np.zeros(len(texts), int)
            least = entropy[np.arange(len(texts)), best] if model.languages else np.zeros(len(texts))
            sure = confidence(model, entropy, n) if model.languages else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([UNKNOWN if none[i] else model.languages[best[i]] for i in range(len(texts))], pa.string()),
                    pa.array(np.where(none, 0.0, sure)),
                    pa.array(least, pa.float64(), mask=none),
                    pa.array(none | (least > model.limit)),
                ],
                names=["row", *fields.names],
            )

    return given.mapInArrow(apply, T.StructType([given.schema["row"], *fields.fields])).select("row.*", *fields.names)
