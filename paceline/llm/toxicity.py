"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel counts common subsequences of ``LENGTH`` characters, each weighted by ``DECAY`` to the power of the stretch that
it covers in both strings (characters that are not letters only widen it), and is divided by the root of both strings' own
values. So a word that is written with gaps or inserted characters stays near the plain one.

Landmarks are chosen among the words of labelled sentences: those that mark toxic texts most surely, for each of these the
harmless word most like it. A sentence's similarity to a landmark is that of its most similar window, and
the Nystrom map (inverse root of the landmarks' own kernel matrix) makes them features of a linear machine. A second feature
per marking landmark joins the similarity with the share of the landmark that the window holds, and stops growing early: a marking
word with one letter put in counts nearly as much as the plain one, a word that only resembles it far less. Windows are
words, runs of single characters, and neighbouring words that may be one marking word in pieces.

Labels belong to texts, not to sentences: training alternates between picking, in every labelled text, the few sentences that
the machine finds worst, which then carry the text's label, and fitting again. Marking words with a letter put in train along
as toxic sentences. A text scores as its worst sentence, turned into a probability by a logistic fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import chunks, worker_state

LENGTH = 3
DECAY = 0.9
# Power of the normalised kernel, which is a kernel again: far-off words fall behind near ones.
POWER = 2
COST = 10.0
# Weight of a marking word with a letter put in, beside 1 for a harmless and 2 for a toxic sentence.
ALTERED = 8.0
MARKING = 24
# Landmarks are no more alike than this, so that every family of words gets some; harmless words less like one are no matter.
ALIKE = 0.42
CLOSE = 0.2
COMMON = 0
# Share of the labelled texts that must be toxic ones with a word, for it to be a landmark.
MARKED = 0.002
# Share of the texts with a landmark that are toxic ones.
SURE = 0.6
# Labelled documents that the machine is fitted on.
SAMPLE = 4000
# Distinct windows that a Python worker remembers (about 250 bytes each).
REMEMBERED = 800_000
THRESHOLD = 0.3
# Longer windows are cut into parts of this many characters, one every ``STEP``: ten letters with blanks between lie in one of them.
LONGEST = 24
STEP = 5
# Letters of a landmark that its bound tells apart.
MOST_LETTERS = 10
# Windows of sentences whose values are gathered at a time.
AT_ONCE = 50_000
# Windows are handled together by length: from one of these to below the next.
WIDTHS = (1, 5, 7, 9, 11, 14, 18, LONGEST + 1)
# The product of similarity and share held is multiplied by this, so that a word with one letter put in comes near 1.
NEARLY = 4.0
# Strings whose kernel values are computed at a time.
TOGETHER = 2048
# Similarities below this count as none, so that what a window's letters rule out need not be computed.
FLOOR = 0.1
# Neighbouring words are also read as one if they have at most this many letters more than a marking landmark, and letters in common
# that allow this similarity.
EXTRA = 1
JOINED = 0.7
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
EDGE = ".,;:!?\"'()[]{}<>*#%&$|"


def windows(sentence: str) -> list[str]:
    """Runs of three or more single characters as one window each, and words without marks at their edges, in order."""
    parts, found = sentence.split(), []
    if parts and len(min(parts, key=len)) == 1 and (spelled := SPELLED.findall(sentence)):
        found = [" ".join(run.split()) for run in spelled]
        parts = SPELLED.sub(" ", sentence).split()
    found += [bare for word in parts if (bare := word.strip(EDGE))]
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in (range(0, len(w) - LONGEST + STEP, STEP) if len(w) > LONGEST else (0,))]


def sentences(text: str) -> list[list[str]]:
    """Windows of each sentence that has any, in lower case."""
    return [found for part in SENTENCE.split(text.lower()) if (found := windows(part))]


def _kernel(match: np.ndarray, decay: float, length: int) -> np.ndarray:
    """Kernel values from ``match[j, i]`` (strings): where place i of a string has the character at place j of the other string.

    A string's value is the same whatever strings it comes with.
    """
    fade, step = np.float32(decay), np.float32(decay * decay)
    ends = match * step
    for _ in range(length - 1):
        # What ends in front of a place of the string, by the place of the other, and then in front of that one too.
        before = np.zeros_like(match)
        for i in range(1, match.shape[1]):
            np.multiply(before[:, i - 1], fade, out=before[:, i])
            before[:, i] += ends[:, i - 1]
        for j in range(1, len(match)):
            before[j] += before[j - 1] * fade
        ends[0] = 0
        np.multiply(before[:-1], match[1:], out=ends[1:])
        ends *= step
    return ends.sum(axis=(0, 1))


class Landmark:
    """A landmark's characters, own kernel value, letters, and a bound on any window's similarity by the letters it shares.

    Only subsequences of shared letters count, so the similarity is at most the length of the landmark's own feature vector
    over these, by Cauchy and Schwarz, over its whole length.
    """

    def __init__(self, text: str, decay: float, length: int) -> None:
        x = _characters([text], len(text)).T
        self.text, self.codes = text, _spelled(text)
        self.own = float(_kernel(_match_self(x), decay, length)[0])
        self.letters = sorted({c for c in self.codes if c < 0x110000})[:MOST_LETTERS]
        count = len(self.letters)
        bit = {c: 1 << i for i, c in enumerate(self.letters)}
        masks = np.arange(1 << count)
        # A letter beyond the listed ones counts as shared.
        shown = np.array([[True if c not in bit else bool(m & bit[c]) for c in x[:, 0].tolist()] for m in masks])
        parts = np.where(shown.T, x, 0).astype(np.uint32)
        norms = _kernel(_match_self(parts), decay, length) if len(text) >= length else np.zeros(len(masks))
        self.bound = (np.sqrt(np.maximum(norms, 0) / max(self.own, 1e-30)) ** POWER * 1.0001).astype(np.float32)

    def shared(self, has: dict[int, np.ndarray]) -> np.ndarray:
        """For each string, which of the letters it has, as bits."""
        return sum((has[c].astype(np.int64) << i for i, c in enumerate(self.letters)), np.zeros(1, np.int64))


def similarities(strings: list[str], landmarks: list[str], decay: float = DECAY, length: int = LENGTH) -> np.ndarray:
    """(strings, landmarks) normalised kernel values to the power ``POWER``; those below ``FLOOR`` are 0."""
    return compare(strings, [Landmark(t, decay, length) for t in landmarks], decay, length)[0]


def compare(strings: list[str], landmarks: list[Landmark], decay: float = DECAY, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Similarities, and for each landmark whether a string may be it with something put in (0 to 1).

    A similarity falls with all else that is in a string; the share held (the kernel over the landmark's own value, at most 1)
    does not, but long strings hold much by chance. The second value is their product, with the exponents and the factor
    below, at most 1. Both are 0 where the similarity is below ``FLOOR``, as it is for strings shorter than the
    subsequences; a bound by the letters that string and landmark share tells for most.
    """
    out, held = (np.zeros((len(strings), len(landmarks)), np.float32) for _ in range(2))
    known = [(j, k) for j, k in enumerate(landmarks) if k.own > 0]
    if not known:
        return out, held
    letters = sorted({c for _, k in known for c in k.letters})
    # A landmark's letters as bits, added up by a product with what a string has of all letters.
    bits = np.zeros((len(letters), len(known)), np.float32)
    for column, (_, k) in enumerate(known):
        for i, c in enumerate(k.letters):
            bits[letters.index(c), column] = 1 << i
    # Landmarks of one length are compared together.
    by_size: dict[int, list[int]] = {}
    for column, (_, k) in enumerate(known):
        by_size.setdefault(len(k.codes), []).append(column)
    codes = {n: np.array([known[c][1].codes for c in columns], np.uint32) for n, columns in by_size.items()}
    place, own = np.array([j for j, _ in known]), np.array([k.own for _, k in known])
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    for low, high in zip(WIDTHS[:-1], WIDTHS[1:], strict=True):
        at = np.flatnonzero((sizes >= max(low, length)) & (sizes < high))
        for i in range(0, len(at), 8192):
            some = at[i : i + 8192]
            # Blanks at the end match nothing.
            x = np.ascontiguousarray(_characters([strings[k].ljust(high - 1) for k in some], high - 1).T)
            shared = (np.array([(x == c).any(axis=0) for c in letters], np.float32).T @ bits).astype(np.int64)
            like = np.array([k.bound[shared[:, column]] >= FLOOR for column, (_, k) in enumerate(known)])
            wanted = np.flatnonzero(like.any(axis=0))
            norm = np.zeros(len(some), np.float32)
            for part in _parts(wanted):
                norm[part] = _kernel(_match_self(x[:, part]), decay, length)
            for n, columns in by_size.items():
                which, near = np.nonzero(like[columns] & (norm > 0))
                for pairs in _parts(np.arange(len(which))):
                    column, row = np.array(columns)[which[pairs]], near[pairs]
                    spelled = codes[n][which[pairs]].T
                    values = _kernel((x[:, row] == spelled[:, None]).astype(np.float32), decay, length)
                    similar = (values / np.sqrt(norm[row] * own[column])) ** POWER
                    keep = similar >= FLOOR
                    out[some[row[keep]], place[column[keep]]] = similar[keep]
                    whole = np.minimum(values[keep] / own[column[keep]], 1) ** POWER
                    held[some[row[keep]], place[column[keep]]] = np.minimum(NEARLY * similar[keep] ** 1.5 * whole, 1)
    return out, held


def _parts(at: np.ndarray) -> list[np.ndarray]:
    return [at[i : i + TOGETHER] for i in range(0, len(at), TOGETHER)]


def _spelled(landmark: str) -> list[int]:
    """Code points of a landmark; one that no text has where it has no letter."""
    return [ord(c) if c.isalpha() else 0x110000 for c in landmark]


def _characters(strings: list[str], size: int) -> np.ndarray:
    """Code points, one string a row; 0 where there is no letter."""
    x = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
    kinds, back = np.unique(x, return_inverse=True)
    letters = np.array([k if chr(k).isalpha() else 0 for k in kinds.tolist()], np.uint32)
    return letters[back].reshape(x.shape)


def _match_self(x: np.ndarray) -> np.ndarray:
    """Which places of a string, one a column, have equal letters."""
    return ((x == x[:, None]) & (x > 0)).astype(np.float32)


@dataclass
class Model:
    """Landmarks, the first ``marking`` of which mark toxic texts; ``weights`` and ``bias`` of the machine, the Nystrom map
    included, for similarities and for shares held; slope and shift of the logistic."""

    landmarks: list[str]
    marking: int
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


class Rows:
    """What windows have in common with the landmarks, remembered by window; at most about ``REMEMBERED`` are held."""

    def __init__(self, landmarks: list[str], marking: int = 0) -> None:
        self.landmarks = [Landmark(t, DECAY, LENGTH) for t in landmarks]
        # Only marking landmarks have the second feature.
        self.marking, self.width = marking, len(landmarks) + marking
        self.marks = [k for k in self.landmarks[:marking] if k.own > 0]
        letters = sorted({c for k in self.marks for c in k.letters})[:32]
        self.bit = {c: 1 << i for i, c in enumerate(letters)}
        # The bits of each landmark's own letters from those of all, by halves.
        self.own: list[list[np.ndarray]] = []
        for k in self.marks:
            halves = []
            for half in range(2):
                table = np.zeros(1 << 16, np.int32)
                for i, c in enumerate(k.letters):
                    place = letters.index(c) - 16 * half if c in self.bit else -1
                    if 0 <= place < 16:
                        table |= np.where(np.arange(1 << 16) >> place & 1, 1 << i, 0).astype(np.int32)
                    elif c not in self.bit:
                        table |= 1 << i
                halves.append(table)
            self.own.append(halves)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        # Most windows are like no landmark and share the first row, of zeros.
        self.rows, self.used = np.zeros((1024, self.width), np.float32), 1
        self.row, self.has, self.size = (np.zeros(1024, np.int64) for _ in range(3))

    def codes(self, flat: list[str]) -> np.ndarray:
        """Numbers of windows, for ``row``, ``has`` and ``size``."""
        code, known = self.code, len(self.code)
        out = np.fromiter(map(code.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            out[missing] = [code.setdefault(flat[i], len(code)) for i in missing.tolist()]
            new = list(islice(reversed(code), len(code) - known))[::-1]
            similar, nearly = compare(new, self.landmarks)
            like = np.flatnonzero(similar.any(axis=1))
            used = self.used + len(like)
            for name, held, wanted in (("rows", self.used, used), *((n, known, len(code)) for n in ("row", "has", "size"))):
                self._grow(name, held, wanted)
            self.rows[self.used : used] = np.concatenate([similar[like], nearly[like, : self.marking]], axis=1)
            self.row[known + like] = np.arange(self.used, used)
            self.used = used
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.size[known : len(code)] = size
            letters = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds, back = np.unique(letters, return_inverse=True)
            bits = np.array([self.bit.get(k, 0) for k in kinds.tolist()], np.int64)[back]
            self.has[known : len(code)] = np.bitwise_or.reduceat(bits, np.cumsum(size) - size)
        return out

    def _grow(self, name: str, held: int, wanted: int) -> None:
        old = getattr(self, name)
        if wanted > len(old):
            grown = np.zeros((max(wanted, 2 * len(old)), *old.shape[1:]), old.dtype)
            grown[:held] = old[:held]
            setattr(self, name, grown)

    def _raise(self, out: np.ndarray, sentence: np.ndarray, codes: np.ndarray) -> None:
        """Raise what each sentence has to the values of its windows; sentences come in order."""
        row = self.row[codes]
        hit = np.flatnonzero(row)
        if len(hit):
            starts = np.flatnonzero(np.diff(sentence[hit], prepend=-1))
            own = sentence[hit[starts]]
            out[own] = np.maximum(out[own], np.maximum.reduceat(self.rows[row[hit]], starts, axis=0))

    def _joined(self, codes: np.ndarray, sentence: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(first places, number) of neighbouring words that may be one marking landmark in pieces, by length and letters."""
        out = []
        has, size = self.has[codes], self.size[codes]
        for n in (2, 3):
            at = np.flatnonzero(sentence[n - 1 :] == sentence[: len(sentence) - n + 1]) if len(codes) >= n else np.zeros(0, np.int64)
            if not len(at) or not self.marks:
                continue
            letters = sum(size[at + k] for k in range(n))
            at = at[(letters >= LENGTH) & (letters <= max(len(k.text) for k in self.marks) + EXTRA)]
            letters = sum(size[at + k] for k in range(n))
            held = has[at]
            for k in range(1, n):
                held = held | has[at + k]
            low, high = held & 0xFFFF, held >> 16
            fits = np.zeros(len(at), bool)
            for mark, (first, second) in zip(self.marks, self.own, strict=True):
                fits |= (letters <= len(mark.text) + EXTRA) & (mark.bound[first[low] | second[high]] >= JOINED)
            out.append((at[fits], n))
        return out

    def of_sentences(self, found: list[list[str]]) -> np.ndarray:
        """(sentences, features): the most that a window of a sentence has of each; a sentence has one window at least."""
        out = np.zeros((len(found), self.width), np.float32)
        ends = np.cumsum([len(ws) for ws in found])
        start = 0
        while start < len(found):
            past = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, past + AT_ONCE, side="right")))
            out[start:end] = self._of_some(found[start:end])
            start = end
        return out

    def _of_some(self, found: list[list[str]]) -> np.ndarray:
        if len(self.code) > REMEMBERED:
            self.clear()
        flat = [w for ws in found for w in ws]
        size = np.fromiter(map(len, found), np.int64, len(found))
        codes = self.codes(flat)
        sentence = np.repeat(np.arange(len(found)), size)
        out = np.zeros((len(found), self.width), np.float32)
        self._raise(out, sentence, codes)
        for at, n in self._joined(codes, sentence):
            self._raise(out, sentence[at], self.codes([" ".join(flat[i : i + n]) for i in at.tolist()]))
        return out


def choose_landmarks(
    texts: list[list[list[str]]], toxic: np.ndarray, marking: int = MARKING, common: int = COMMON
) -> tuple[list[str], int]:
    """The landmarks, and how many of them, the first ones, mark toxic texts: windows whose share of toxic texts is surely above the average (by a normal score); for each of them the harmless
    window that is most like it, so that the machine can tell them apart; and ``common`` of the most common windows."""
    in_toxic, in_all, seen = Counter(), Counter(), set()
    for found, bad in zip(texts, toxic, strict=True):
        # A copy, near or exact, of a text before it is no further witness.
        long = [hash(tuple(s)) for s in found if len(s) >= 4]
        copied = sum(h in seen for h in long)
        seen.update(long)
        if 2 * copied > len(long):
            continue
        own = {w for s in found for w in s if len(w) >= LENGTH and any(c.isalpha() for c in w)}
        in_all.update(own)
        if bad:
            in_toxic.update(own)
    rate = toxic.mean() if len(toxic) else 0.0
    scored = []
    for w, n in in_toxic.items():
        total = in_all[w]
        z = (n - rate * total) / np.sqrt(max(rate * (1 - rate) * total, 1e-9))
        if n >= max(3, MARKED * len(texts)) and n >= SURE * total and z >= 5:
            scored.append((-z, w))
    ranked = [w for _, w in sorted(scored)[: 10 * marking]]
    alike = similarities(ranked, ranked) if ranked else np.zeros((0, 0))
    picked: list[int] = []
    for k in range(len(ranked)):
        if len(picked) < marking and (alike[k, picked] < ALIKE).all():
            picked.append(k)
    chosen = [ranked[k] for k in picked]
    often = max(3, MARKED * len(texts))
    harmless = [w for w, n in sorted(in_all.items()) if n >= often and in_toxic[w] < 0.5 * n and w not in chosen]
    if chosen and harmless:
        near = similarities(harmless, chosen)
        chosen += sorted({harmless[i] for i, close in zip(near.argmax(axis=0), near.max(axis=0), strict=True) if close >= CLOSE})
    rest = sorted(((-n, w) for w, n in in_all.items() if w not in chosen))
    return chosen + [w for _, w in rest[:common]], len(picked)


def _support_vector(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge linear machine, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(30):
        inside = y * (z @ w) < 1
        c = cost * weight * inside
        gradient = ridge @ w - z.T @ (c * (y - z @ w))
        step = np.linalg.solve(ridge + (z * c[:, None]).T @ z, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(f: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability, with Platt's smoothed targets, by damped Newton steps."""
    up, down = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.array([1.0, np.log((up + 1) / (down + 1))])
    z = np.column_stack([f, np.ones(len(f))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (target - p) - 1e-6 * a)
        a += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a[0], 1e-6)), float(a[1])


def altered(word: str) -> list[str]:
    """A word with a letter that it does not have, or a blank, put in at each place."""
    foreign = next(c for c in "xqzjkvwybfghmnpcdu" if c not in word)
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (foreign, " ")]


def fit_texts(texts: list[str], toxic: list[bool], rounds: int = 4, worst: int = 3) -> Model:
    """A machine from texts and their labels."""
    found = [sentences(t) for t in texts]
    labels = np.array(toxic, bool)
    landmarks, marking = choose_landmarks(found, labels)
    if not landmarks or labels.all() or not labels.any():
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
        return Model(landmarks, marking, np.zeros(len(landmarks) + marking), 0.0, 1.0, float(np.log(share / (1 - share))))
    values, vectors = np.linalg.eigh(similarities(landmarks, landmarks).astype(np.float64))
    # The second features stay as they are.
    root = np.eye(len(landmarks) + marking, dtype=np.float32)
    root[: len(landmarks), : len(landmarks)] = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    table = Rows(landmarks, marking)
    # All sentences in one call, as one for each text would cost far more.
    every = table.of_sentences([s for f in found for s in f]) @ root
    ends = np.cumsum([len(f) for f in found])
    bags = [every[b - len(f) : b] for f, b in zip(found, ends.tolist(), strict=True)]
    full = [i for i, b in enumerate(bags) if len(b)]
    x, y = np.array([bags[i].max(axis=0) for i in full]), np.where(labels[full], 1.0, -1.0)
    weights, bias = _support_vector(x, y, np.where(y > 0, 2.0, 1.0))
    # Marking words with a letter put in are toxic sentences of their own, as labelled texts may hold none.
    more = table.of_sentences([[v] for w in landmarks[:marking] for v in altered(w)]) @ root
    for _ in range(rounds):
        picked, signs = [more], [1.0] * len(more)
        for i in full:
            f = bags[i] @ weights + bias
            top = np.argsort(-f, kind="stable")[:worst]
            picked.append(bags[i][top])
            signs += [1.0 if labels[i] else -1.0] * len(top)
        y = np.array(signs)
        weight = np.where(y > 0, 2.0, 1.0)
        weight[: len(more)] = ALTERED
        weights, bias = _support_vector(np.concatenate(picked), y, weight)
    f = np.array([(b @ weights + bias).max() if len(b) else 0.0 for b in bags])
    empty = np.array([not len(b) for b in bags])
    f[empty] = f[~empty].min() if not empty.all() else 0.0
    slope, shift = _logistic(f, labels)
    return Model(landmarks, marking, root @ weights, bias, slope, shift)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` rows of ``labelled`` (doc_id, text, toxic), picked by a hash of the id."""
    rows = labelled.where(F.col("toxic").isNotNull())
    share = sample / max(rows.count(), 1)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30)))
    columns = [F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") == 1).alias("toxic")]
    table = picked.select(*columns, F.xxhash64("doc_id").alias("h")).toArrow()
    table = table.sort_by([("h", "ascending"), ("text", "ascending")])
    return fit_texts(table.column("text").to_pylist(), table.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1), predicted (1 from ``threshold`` on) and the number of the worst sentence.

    Whole texts are read. Null and empty texts, and those without a window, score as the mildest text would: their worst
    sentence is null. Equal sentences: the first. Columns of the input with these names are replaced; others may have any name.
    """
    made = "score double, predicted int, worst_sentence int"
    fields = T.StructType.fromDDL(made)
    kept = [c for c in docs.columns if c not in fields.names]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state("rows-" + "/".join(model.landmarks), lambda: Rows(model.landmarks, model.marking))
        for batch in chunks(batches):
            texts = [sentences(t) for t in batch.column("text").to_pylist()]
            size = np.array([len(s) for s in texts])
            f = table.of_sentences([s for found in texts for s in found]).astype(np.float64) @ model.weights + model.bias
            least = np.full(len(texts), -10.0)
            place = np.zeros(len(texts), np.int64)
            ends = np.cumsum(size)
            for i in np.flatnonzero(size):
                own = f[ends[i] - size[i] : ends[i]]
                place[i] = own.argmax()
                least[i] = own[place[i]]
            p = 1 / (1 + np.exp(-np.clip(model.slope * least + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(p),
                    pa.array((p >= threshold).astype(np.int32)),
                    pa.array(place.astype(np.int32), mask=size == 0),
                ],
                names=["row", *fields.names],
            )

    return given.mapInArrow(apply, T.StructType([given.schema["row"], *fields.fields])).select("row.*", *fields.names)
