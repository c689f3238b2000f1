"""Secrets in text: three fixed patterns, and strings that a randomness test battery takes for key material.

A candidate is a maximal run of key characters; a run that no alphabet holds, or with a word between its signs as paths have, is
also cut at its signs, and parts that are long enough are candidates beside the whole. Of candidates that overlap and pass, the
narrowest is reported. A candidate's alphabet is inferred (decimal, hex, letters of one case, base 32, 36, 62, 64 and 64 for
URLs), and its characters, as numbers in that alphabet, go through four tests: chi-squared uniformity over the
alphabet, the same over kinds of characters (capitals, small letters, digits, signs), runs above and below the
middle, and serial correlation. Fisher's method joins them into ``p_random``; a random string gets a small value
as rarely as the value says.

That a string passes does not make it a secret, as short strings pass easily. So each candidate is also tested against
the opposite hypothesis, that its characters follow the corpus's own letter frequencies: ``p_text`` is the chance that
such a string of this length would look as even. It shrinks with length. Over all documents, within each octave of
length, Benjamini and Hochberg's procedure picks the largest threshold on ``p_text`` that keeps the expected share of
ordinary strings among the reported ones under ``rate``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import chunks, raw, stage, tree_sum

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Parts of a run with signs: as the two kinds of base 64 cut it, and plain letters and digits.
PARTS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9]{16,}={0,2}"))
WORDS_OF_ASSIGN = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

# Alphabets in the order of their digits.
ALPHABETS = {
    "decimal": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
P_RANDOM = 0.001
RATE = 0.01
_SPAN = "struct<kind:int,start:int,end:int>"
_TRIAL = "struct<start:int,end:int,encoding:int,size:int,chi:double,p_random:double>"
FOUND = f"base array<{_SPAN}>, trials array<{_TRIAL}>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost matches that do not overlap within a kind, long enough."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _spans_and_candidates(text: str, data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The same spans, looked for only where a cheap search finds what they need, and the candidates."""
    spans, found = [], []
    low = data.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in data:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for run in LONG.finditer(text):
        # A run of hex digits this long lies inside one long run.
        spans += [(2, m.start(), m.end()) for m in HEX.finditer(text, run.start(), run.end())]
        for m in CANDIDATE.finditer(text, run.start(), run.end()):
            found += _held(text, m.start(), m.end())
    return sorted(spans, key=lambda s: (s[1], s[0])), found


def infer(word: str) -> int:
    """Position in ALPHABETS of the smallest alphabet that holds a string's characters, padding aside; -1: none.

    Case and digits decide: letters a-f alone are not taken for hex, nor capitals without a digit for base 32.
    """
    word = word.rstrip("=")
    has = set(word)
    digit, lower, upper = (any(c in has for c in cs) for cs in ("0123456789", ALPHABETS["base36"][10:], ALPHABETS["base32"][:26]))
    for position, (name, alphabet) in enumerate(ALPHABETS.items()):
        if has <= set(alphabet):
            if name in ("hex", "HEX") and not (digit and (lower or upper)):
                continue
            if name in ("base32", "base36") and not digit:
                continue
            return position
    return -1


# A stretch between signs that looks like a word: four or more letters of one case, or with a capital in front.
WORDLIKE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{3,}[a-z]|[A-Z]{4,})(?![A-Za-z0-9])")


def _held(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run, if some alphabet holds it, and its parts, if none does or there are words in it.

    A key in a path is so tested without the path. A key of base 64 that has signs of its own stays whole.
    """
    whole = [(start, end)] if infer(text[start:end]) >= 0 else []
    if whole and not WORDLIKE.search(text[start:end]):
        return whole
    return sorted({*whole, *(m.span() for part in PARTS for m in part.finditer(text, start, end))})


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


def battery(words: list[str], encodings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chi-squared statistic over the alphabet, joint p of all tests) of each string in its alphabet."""
    if not words:
        return np.zeros(0), np.zeros(0)
    tables = np.full((len(ALPHABETS), 256), -1, np.int64)
    for i, alphabet in enumerate(ALPHABETS.values()):
        tables[i, list(alphabet.encode())] = np.arange(len(alphabet))
    sizes = np.array([len(a) for a in ALPHABETS.values()])
    kind_of = np.full(256, 3)
    for i, cs in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")):
        kind_of[list(cs.encode())] = i
    kind_share = np.array([np.bincount(kind_of[list(a.encode())], minlength=4) / len(a) for a in ALPHABETS.values()])

    bare = [w.rstrip("=").encode() for w in words]
    n = np.array([len(b) for b in bare])
    x = np.frombuffer(b"".join(bare), np.uint8)
    of = np.repeat(np.arange(len(words)), n)
    value = tables[encodings[of], x]
    k = sizes[encodings]
    counts = np.bincount(of * 64 + value, minlength=len(words) * 64).reshape(-1, 64)
    expected = n / k
    chi = (counts.astype(float) ** 2).sum(axis=1) / expected - n
    spread = np.sqrt(2 * (k - 1) * (n - 1) / n)
    p_even = _upper_tail((chi - (k - 1)) / spread)

    kinds = np.bincount(of * 4 + kind_of[x], minlength=len(words) * 4).reshape(-1, 4)
    share = kind_share[encodings]
    want = share * n[:, None]
    kind_chi = np.where(share > 0, (kinds - want) ** 2 / np.maximum(want, 1e-9), 0.0).sum(axis=1)
    free = np.maximum((share > 0).sum(axis=1) - 1, 1)
    # Wilson and Hilferty: the cube root of a chi-squared value is nearly normal.
    p_kinds = _upper_tail((np.cbrt(kind_chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))
    p_kinds = np.where((share > 0).sum(axis=1) > 1, p_kinds, 0.5)

    high = (value * 2 >= k[of]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    change = np.zeros(len(x), np.int64)
    change[1:] = high[1:] != high[:-1]
    change[starts] = 1
    runs = np.add.reduceat(change, starts)
    n1 = np.add.reduceat(high, starts).astype(float)
    n2 = n - n1
    mean = 1 + 2 * n1 * n2 / n
    var = np.maximum(2 * n1 * n2 * (2 * n1 * n2 - n) / (n**2 * (n - 1.0)), 1e-9)
    one_sided = (n1 == 0) | (n2 == 0)
    p_runs = np.where(one_sided, 0.5 ** (n - 1.0), 2 * _upper_tail(np.abs(runs - mean) / np.sqrt(var)))

    centre = value - (np.add.reduceat(value, starts) / n)[of]
    product = np.zeros(len(x))
    product[1:] = centre[1:] * centre[:-1]
    product[starts] = 0
    energy = np.add.reduceat(centre**2, starts)
    serial = np.where(energy > 0, np.add.reduceat(product, starts) / np.maximum(energy, 1e-9), 1.0)
    p_serial = 2 * _upper_tail(np.abs(serial + 1 / n) * np.sqrt(n))

    logs = -2 * np.log(np.clip(np.stack([p_even, p_kinds, p_runs, p_serial]), 1e-300, 1)).sum(axis=0)
    half = logs / 2
    joint = np.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6)
    return chi, joint


def unevenness(histogram: np.ndarray) -> list[float]:
    """Per alphabet, how far the corpus's characters are from even: sum of (p - 1/k)^2 * k over the alphabet."""
    out = []
    for alphabet in ALPHABETS.values():
        counts = histogram[list(alphabet.encode())].astype(float)
        p = counts / counts.sum() if counts.sum() else np.full(len(alphabet), 1 / len(alphabet))
        out.append(float(((p - 1 / len(alphabet)) ** 2).sum() * len(alphabet)))
    return out


def _p_text(trial: Column, uneven: list[float]) -> Column:
    """Chance of a chi-squared value this low if characters followed the corpus (normal approximation)."""
    k = F.element_at(F.array(*[F.lit(float(len(a))) for a in ALPHABETS.values()]), trial["encoding"] + 1)
    d = F.element_at(F.array(*[F.lit(x) for x in uneven]), trial["encoding"] + 1) * trial["size"]
    z = (trial["chi"] - (k - 1 + d)) / F.sqrt(2 * (k - 1) + 4 * d)
    # A smooth bound on the normal's lower tail, in one expression.
    t = 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = F.greatest(0.5 * poly * F.exp(-z * z / 2), F.lit(1e-30))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _octave(trial: Column) -> Column:
    return F.floor(F.log2(trial["size"].cast("double"))).cast("int")


def thresholds(found: DataFrame, uneven: list[float], rate: float = RATE) -> dict[int, float]:
    """Per octave of length, the largest p_text that is reported.

    Only counts per tenth of a decade leave the tasks; a bin counts in full only if its upper end qualifies, so the
    rate holds as it would for single values.
    """
    trial = F.col("t")
    p = _p_text(trial, uneven)
    bins = (
        found.select(F.explode("trials").alias("t"))
        .select(_octave(trial).alias("octave"), F.ceil(F.log10(p) * 10).cast("int").alias("bin"))
        .groupBy("octave", "bin")
        .count()
        .collect()
    )
    out: dict[int, float] = {}
    for octave in {r.octave for r in bins}:
        own = sorted((r.bin, r["count"]) for r in bins if r.octave == octave)
        total, below, best = sum(n for _, n in own), 0, 0.0
        for edge, n in own:
            below += n
            if 10 ** (edge / 10) * total <= rate * below:
                best = 10 ** (edge / 10)
        out[octave] = best
    return out


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, the text if wanted, with the fixed patterns' spans (``base``) and the tested candidates."""
    kept = [c for c in docs.columns if c not in ("base", "trials", "passing", "spans") and (keep_text or c != "text")]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    fields = T.StructType.fromDDL(FOUND)
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    trial_type = pa.list_(
        pa.struct(
            [(c, pa.int32()) for c in ("start", "end", "encoding", "size")] + [(c, pa.float64()) for c in ("chi", "p_random")]
        )
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            bases, tried, words, where = [], [[] for _ in texts], [], []
            for i, (text, data) in enumerate(zip(texts, raw(batch.column("text").cast(pa.binary())), strict=True)):
                spans, candidates = _spans_and_candidates(text, data)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                for a, b in candidates:
                    if (encoding := infer(text[a:b])) >= 0:
                        words.append(text[a:b])
                        where.append((i, a, b, encoding))
            chi, joint = battery(words, np.array([w[3] for w in where], np.int64))
            for (i, a, b, encoding), word, c, p in zip(where, words, chi, joint, strict=True):
                size = len(word.rstrip("="))
                tried[i].append({"start": a, "end": b, "encoding": encoding, "size": size, "chi": c, "p_random": p})
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(bases, base_type), pa.array(tried, trial_type)], names=["row", "base", "trials"]
            )

    return given.mapInArrow(apply, T.StructType([given.schema["row"], *fields.fields])).select("row.*", "base", "trials")


def _histogram(docs: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(256, np.int64)
        for batch in chunks(batches):
            total += np.bincount(np.frombuffer(b"".join(raw(batch.column("text"))), np.uint8), minlength=256)
        return total

    return tree_sum(docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")), count, (256,), np.int64)


def _passing(uneven: list[float], limits: dict[int, float], p_random: float) -> Column:
    """Candidates that pass, with their ``p_text``, without those that a fixed pattern covers."""
    covered = lambda t: F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))
    limit = lambda t: F.coalesce(
        *[F.when(_octave(t) == o, F.lit(x)) for o, x in sorted(limits.items())], F.lit(0.0)
    )
    good = F.filter("trials", lambda t: (t["p_random"] >= p_random) & (_p_text(t, uneven) <= limit(t)) & ~covered(t))
    return F.transform(good, lambda t: F.struct(_p_text(t, uneven).alias("p"), t["start"].alias("start"), t["end"].alias("end")))


def _reported() -> Column:
    """Of the candidates in ``passing`` that overlap, the shortest, as spans of the fourth kind.

    Of equally long ones that of the smaller ``p_text`` counts, then the first.
    """
    rank = lambda t: F.struct(t["end"] - t["start"], t["p"], t["start"])
    beaten = lambda t: F.exists(
        "passing", lambda u: (u["start"] < t["end"]) & (t["start"] < u["end"]) & (rank(u) < rank(t))
    )
    best = F.filter("passing", lambda t: ~beaten(t))
    return F.transform(best, lambda t: F.struct(F.lit(3).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))


def find_secrets(
    docs: DataFrame, rate: float = RATE, p_random: float = P_RANDOM, keep_text: bool = False
) -> DataFrame:
    """All columns of ``docs`` (the text if wanted) with ``base`` (spans of the fixed patterns) and ``spans`` (with the method's).

    A span is (kind, start, end): the position of its kind in KINDS, code points, end exclusive; arrays are ordered by
    start, then kind. Null and empty texts have no spans. Without any candidate nothing but the base is reported.
    Repeated rows are scanned alike, and each counts in the corpus's frequencies and candidates. Columns of the input named
    base, spans, trials or passing are replaced or left out. Three passes: letter
    frequencies, the scan (its findings are written to the scratch folder), and the thresholds over the findings.
    """
    uneven = unevenness(_histogram(docs))
    found = stage(scan(docs, keep_text), "secret-findings")
    limits = thresholds(found, uneven, rate)
    found = found.withColumn("passing", _passing(uneven, limits, p_random))
    both = F.concat(F.col("base"), _reported())
    in_order = lambda *names: lambda s: F.struct(*[s[c].alias(c) for c in names])
    keyed = F.array_sort(F.transform(both, in_order("start", "kind", "end")))
    ordered = F.transform(keyed, in_order("kind", "start", "end"))
    return found.withColumn("spans", ordered).drop("trials", "passing")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    text = lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with every secret in the text masked, and ``n_chars``, if there, counted anew.

    Texts without a secret, null ones among them, stay as they are, and so do all other columns, whatever they are called.
    Repeated rows stay repeated. No rows: no rows.
    """
    own = [c if c in ("text", "n_chars") else f"_{i}" for i, c in enumerate(docs.columns)]
    found = find_secrets(docs.toDF(*own), keep_text=True)
    some = F.size("spans") > 0
    masked = found.withColumn("text", F.when(some, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(some, counted).otherwise(F.col("n_chars")))
    return masked.select(*own).toDF(*docs.columns)


def digest(text: str) -> str:
    """The base spans of one text as the digest of the contract, for tests."""
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base_spans(text))
    return hashlib.sha256(joined.encode()).hexdigest()


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by a mask."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        # A span that begins before the last one ended only moves its end.
        fresh = F.concat(state["done"], gap, F.lit(mask))
        return F.struct(
            F.when(s["start"] >= state["at"], fresh).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    end = F.aggregate(spans, start, step)
    return F.concat(end["done"], F.substring(text, end["at"] + 1, F.length(text)))
