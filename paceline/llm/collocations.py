"""Mine phrases whose words occur together more often than apart, counted over a prefix-free parse of the corpus.

A text is a run of words and marks (a mark where a piece ends). A place where the hash of the next ``longest - 1`` tokens
is 0 modulo ``TRIGGER`` ends a chunk and begins the next, so chunks depend on content alone, equal passages give equal chunks
wherever they stand, and neighbouring chunks overlap by ``longest - 1`` tokens. Each text ends in as many marks, which
close its last chunk. Distinct chunks form the dictionary, with the number of times each is parsed. A phrase that begins
in front of the closing overlap lies inside its chunk and is counted there, times the chunk's copies; a phrase inside the
overlap begins the next chunk and is counted in that one alone.

Counting goes by length. Hashes of phrases are counted first, as sorted arrays that are cut by hash into parts, and a bit filter
keeps those that occur often enough; a phrase is looked at only if both phrases one word shorter pass. Hashes and filters may let
too much through, never too little. What passes is then spelled out and counted by its words; only inside a task's
few megabytes are its occurrences gathered by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import chunks, forget_unused, mix, raw, stage, tree_sum, word_hashes

LONGEST = 3
LEAST = 10
KEPT = 2000
# A candidate is dropped for a longer one that has this share of its occurrences, in percent.
COVERED = 50
# Words from one trigger to the next, on average, and at most.
TRIGGER = 32
MOST = 256
# Hashes that a task gathers before it counts them, and that a part holds, and phrases that a part holds.
GATHERED = 4_000_000
PART_HASHES = 2_000_000
PART_PHRASES = 25_000
# Rows of a batch of counted phrases.
ROWS_OUT = 20_000
# Bytes of chunks that are counted at a time, and bytes that are hashed at a time.
TEXT_BYTES = 8 << 20
SEGMENT = 1 << 20
# Bits of a filter for each phrase that passes, and at most (64 MB); beyond that it passes more.
FILTER_BITS = 16
MOST_BITS = 1 << 29
# Parts in which a language's candidates are ranked before the last ranking.
RANKED_PARTS = 32
MARK = b"\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_BASE = 0x5851F42D4C957F2D

# The signs between pieces become marks, a tab a space.
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", MARK * 10 + b" ")
_BLANK = b".,;:!?\n\x0b\x0c\r\t "


def normal(texts: list[bytes], closing: int) -> tuple[bytes, np.ndarray]:
    """Texts that hold a word, A-Z in lower case, as words and marks with one space after each, and the number of bytes of each.

    A text ends in ``closing`` marks.
    """
    ending = MARK * closing
    spaced = [(t.lower().translate(_FOLD) + ending).replace(MARK, b" \n ") for t in texts]
    data = np.frombuffer(b"".join(spaced), np.uint8)
    space = data == 0x20
    # A space stays if there is none in front of it.
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = np.cumsum([0, *map(len, spaced[:-1])])
    return data[keep].tobytes(), np.add.reduceat(keep, starts, dtype=np.int64)


class Tokens:
    """Words and marks in bytes that hold one space after each."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.bytes = np.frombuffer(data, np.uint8)
        self.end = np.flatnonzero(self.bytes == 0x20)
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64)
        self.is_word = self.bytes[self.start] != MARK[0]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit polynomial of each token's bytes, for all tokens of a segment at once from one running sum."""
        out = np.zeros(len(self.end), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(self.data), SEGMENT)), len(out)))
        longest = max((int(self.end[j - 1] - self.start[i]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)), default=0)
        values = mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * (seed + 1)))
        base = _BASE + 8 * seed
        power, inverse = (_powers(b, longest + 1) for b in (base, pow(base, -1, 1 << 64)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low = int(self.start[i])
            part = values[self.bytes[low : int(self.end[j - 1])]]
            part *= power[: len(part)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            first = self.start[i:j] - low
            out[i:j] = (sums[self.end[i:j] - low] - sums[first]) * inverse[first]
        return mix(out + (self.end - self.start).astype(np.uint64) * _STEP)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cut(hashes: np.ndarray, bounds: np.ndarray, overlap: int, trigger: int = TRIGGER, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of some texts as (start, end, text): chunk i is the tokens start[i] to end[i] + overlap.

    ``bounds`` are the texts' first tokens and the end of the last; a text ends in ``overlap`` marks and has more tokens than these.
    """
    window = np.full(len(hashes) - overlap + 1, overlap, np.uint64)
    for i in range(overlap):
        window = mix(window * _STEP + hashes[i : i + len(window)])
    ends = window % np.uint64(trigger) == 0
    first, last = bounds[:-1], bounds[1:] - overlap
    for i in range(overlap):
        inner = last + i
        ends[inner[inner < len(ends)]] = False
    ends[last] = True
    # No chunk ends where its text begins.
    ends[first] = False
    end = np.flatnonzero(ends)
    owner = np.searchsorted(bounds, end, side="right") - 1
    start = np.maximum(np.concatenate([[0], end[:-1]]), first[owner])
    # Stretches without a trigger are cut all the same.
    pieces = -(-(end - start) // most)
    which = np.repeat(np.arange(len(end)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = start[which] + step * most
    return begin, np.minimum(begin + most, end[which]), owner[which]


def _parse(docs: DataFrame, overlap: int) -> DataFrame:
    """Every chunk of every text: lang, text, and the number of its words before the closing overlap."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = raw(batch.column("text"))
            kept = [i for i, t in enumerate(texts) if t.translate(None, _BLANK)]
            if not kept:
                continue
            data, sizes = normal([texts[i] for i in kept], overlap)
            found = Tokens(data)
            bounds = np.concatenate([[0], np.searchsorted(found.end, np.cumsum(sizes))])
            begin, end, owner = cut(found.hashes(), bounds, overlap)
            words = np.concatenate([[0], np.cumsum(found.is_word)])
            spans = zip(found.start[begin].tolist(), found.end[end + overlap - 1].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(np.array(kept)[owner])),
                    pa.array([data[a:b] for a, b in spans], pa.binary()),
                    pa.array(words[end] - words[begin]),
                ],
                names=["lang", "text", "words"],
            )

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text)
    return given.mapInArrow(apply, "lang string, text binary, words long")


def dictionary(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Distinct chunks of a language with their number of copies: lang, text, words, copies."""
    found = _parse(docs, longest - 1)
    return found.groupBy("lang", "text").agg(F.first("words").alias("words"), F.count("*").alias("copies"))


class Filter:
    """Bits for a set of hashes, ``size`` of them; others pass now and then."""

    def __init__(self, parts: int, bits: np.ndarray, size: int = 0) -> None:
        self.parts, self.bits, self.size = parts, bits, size

    @staticmethod
    def places(named: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(named)
        return x & np.uint64(size - 1), (x >> np.uint64(32)) & np.uint64(size - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        named = part_names(hashes, self.parts)
        ok = np.ones(len(named), bool)
        for place in self.places(named, len(self.bits) * 8):
            ok &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def part_names(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A part (upper half) by the upper bits of a hash, and its lower bits. Hashes may share a name."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (hashes & _LOW)


class Parsed:
    """The phrases of some chunks: hashes by number of words, at all tokens of the chunks one after another.

    A phrase's hash holds its language.
    """

    def __init__(self, batch: pa.RecordBatch, overlap: int, seed: int = 0) -> None:
        self.tokens = Tokens(b"".join(t + b" " for t in raw(batch.column("text"))))
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.searchsorted(self.tokens.end, np.cumsum(sizes))
        self.chunk = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.copies = batch.column("copies").to_numpy()
        owned = np.arange(len(self.chunk)) < (ends - overlap)[self.chunk]
        named = batch.column("lang").dictionary_encode()
        self.langs, self.lang = named.dictionary.to_pylist(), named.indices.to_numpy()
        salt = word_hashes((x.encode() for x in self.langs), len(self.langs), seed)
        self.is_word = self.tokens.is_word
        self.hashes = [mix(self.tokens.hashes(seed) ^ salt[self.lang][self.chunk])]
        self.valid = [owned & self.is_word]

    def times(self, begins: np.ndarray) -> np.ndarray:
        """How often the chunks of these tokens were parsed."""
        return self.copies[self.chunk[begins]]

    def extend(self, passes: Filter) -> None:
        """One word more: what begins at a token and ends before its chunk does, if both shorter phrases pass."""
        shorter = self.hashes[-1]
        n = len(self.hashes)
        begins = np.flatnonzero(self.valid[-1])
        begins = begins[self.is_word[begins + n]]
        begins = begins[passes.passes(shorter[begins])]
        begins = begins[passes.passes(shorter[begins + 1])]
        valid = np.zeros(len(shorter), bool)
        valid[begins] = True
        self.hashes.append(longer(shorter, self.hashes[0], n))
        self.valid.append(valid)


def longer(phrases: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of phrases of ``n`` words and the word after each."""
    out = np.zeros(len(phrases), np.uint64)
    out[:-n] = mix(phrases[:-n] * _STEP + words[n:])
    return out


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their weights; most weights are 1."""
    distinct, total = np.unique(keys, return_counts=True)
    more = np.flatnonzero(weights > 1)
    np.add.at(total, np.searchsorted(distinct, keys[more]), weights[more] - 1)
    return distinct, total


def _frequent(chunked: DataFrame, filters: list[Filter], total: int, overlap: int, least: int) -> Filter:
    """A filter for the phrases, one word longer than those of the last filter, that occur ``least`` times or more."""
    parts = min(max(1, -(-total // PART_HASHES)), 1 << 31)
    shared = chunked.sparkSession.sparkContext.broadcast([(f.parts, f.bits) for f in filters])
    # Counts only need to tell whether they reach the least, so a sum of capped counts will do.
    kind = np.uint8 if least < 256 else np.int64

    def packed(keys: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
        distinct, total = counted(np.concatenate(keys), np.concatenate(weights))
        part = (distinct >> np.uint64(32)).astype(np.int64)
        low, capped = (distinct & _LOW).astype("<u4"), np.minimum(total, least).astype(kind)
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        cuts = list(zip(starts, [*starts[1:], len(part)], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts]),
                pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([capped[a:b].tobytes() for a, b in cuts], pa.binary()),
            ],
            names=["part", "hashes", "counts"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = [Filter(*f) for f in shared.value]
        keys, weights, held = [], [], 0
        for batch in chunks(batches, TEXT_BYTES):
            found = Parsed(batch, overlap)
            for f in passed:
                found.extend(f)
            begins = np.flatnonzero(found.valid[-1])
            keys.append(part_names(found.hashes[-1][begins], parts))
            weights.append(np.minimum(found.times(begins), least).astype(kind))
            held += len(keys[-1])
            if held > GATHERED:
                yield packed(keys, weights)
                keys, weights, held = [], [], 0
        if held:
            yield packed(keys, weights)

    def reach(key: tuple, table: pa.Table) -> pa.Table:
        forget_unused()
        low = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, kind) for x in table.column("counts").to_pylist()]).astype(np.int64)
        by = np.argsort(low, kind="stable")
        low = low[by]
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        often = low[starts][np.add.reduceat(counts[by], starts) >= least]
        return pa.table(
            {"part": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(often)], pa.int64()), "hashes": pa.array([often.tobytes()], pa.binary())}
        )

    found = chunked.select("lang", "text", "copies").mapInArrow(gather, "part long, hashes binary, counts binary")
    often = stage(found.groupBy("part").applyInArrow(reach, "part long, size long, hashes binary"), "frequent")
    passing = often.agg(F.sum("size")).first()[0] or 0
    size = min(max(1 << 16, 1 << (FILTER_BITS * passing).bit_length()), MOST_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for part, low in zip(batch.column("part").to_pylist(), raw(batch.column("hashes")), strict=True):
                named = np.uint64(part << 32) | np.frombuffer(low, "<u4").astype(np.uint64)
                for place in Filter.places(named, size):
                    np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return out

    return Filter(parts, tree_sum(often.select("part", "hashes"), bits, (size // 8,), np.uint8, np.bitwise_or), passing)


def _phrases(found: Parsed, passed: list[Filter], other: np.ndarray, parts: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """The phrases that pass, with their counts, by part and language; ``other`` are the words' hashes by another seed."""
    words, tokens = other, found.tokens
    for n, f in enumerate(passed):
        begins = np.flatnonzero(found.valid[n])
        key = found.hashes[n][begins]
        ok = f.passes(key)
        begins, key, check = begins[ok], key[ok], other[begins[ok]]
        if n + 1 < len(passed):
            other = longer(other, words, n + 1)
        if not len(begins):
            continue
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=~key[order[:1]]) != 0
        if (np.diff(check[order], prepend=check[order[:1]])[~new] != 0).any():
            # Phrases that share a hash are told apart by the other.
            order = np.lexsort((check, key))
            new = np.diff(key[order], prepend=~key[order[:1]]) != 0
            new |= np.diff(check[order], prepend=check[order[:1]]) != 0
        starts = np.flatnonzero(new)
        total = np.add.reduceat(found.times(begins[order]), starts)
        first = begins[order[starts]]
        part = (part_names(key[order[starts]], parts) >> np.uint64(32)).astype(np.int64)
        lang = found.lang[found.chunk[first]]
        by = np.lexsort((lang, part))
        first, total, part, lang = first[by], total[by], part[by], lang[by]
        spans = zip(tokens.start[first].tolist(), tokens.end[first + n].tolist(), strict=True)
        spelled = [tokens.data[a:b] for a, b in spans]
        runs = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0)).tolist()
        for a, b in zip(runs, [*runs[1:], len(first)], strict=True):
            yield int(part[a]), found.langs[lang[a]], b"\n".join(spelled[a:b]), total[a:b].astype("<i8").tobytes()


def _added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a part with the sums of their counts, if these reach the least: lang, phrase, words, times.

    A phrase comes once from every few megabytes of chunks, so a part's rows grow with the corpus and are never held together.
    """
    forget_unused()
    total: dict[str, dict[bytes, int]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            lang, phrases, times = (batch.column(c)[i].as_py() for c in ("lang", "phrases", "times"))
            sums = total.setdefault(lang, {})
            for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(times, "<i8").tolist(), strict=True):
                sums[phrase] = sums.get(phrase, 0) + n
    kinds = {"lang": pa.string(), "phrase": pa.binary(), "words": pa.int32(), "times": pa.int64()}
    often = ((lang, p, p.count(b" ") + 1, n) for lang, sums in total.items() for p, n in sums.items() if n >= least)
    while rows := list(islice(often, ROWS_OUT)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def phrase_parts(total: int) -> int:
    """Parts for so many phrases. A part's rows come to Python in batches of 10,000 rows, so these must be short."""
    return max(1, -(-total // PART_PHRASES))


def count_phrases(chunked: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """Phrases of up to ``longest`` words that occur ``least`` times or more: lang, phrase, words, times."""
    overlap = longest - 1
    total = chunked.agg(F.sum("words")).first()[0] or 0
    filters: list[Filter] = []
    for _ in range(longest):
        filters.append(_frequent(chunked, filters, total, overlap, least))
    parts = phrase_parts(sum(f.size for f in filters))
    shared = chunked.sparkSession.sparkContext.broadcast([(f.parts, f.bits) for f in filters])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = [Filter(*f) for f in shared.value]
        kinds = {"part": pa.int64(), "lang": pa.string(), "phrases": pa.binary(), "times": pa.binary()}
        for batch in chunks(batches, TEXT_BYTES):
            found = Parsed(batch, overlap)
            for f in passed[:-1]:
                found.extend(f)
            rows = list(_phrases(found, passed, found.tokens.hashes(1), parts))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(batches, least)

    rows = chunked.select("lang", "text", "copies").mapInArrow(gather, "part long, lang string, phrases binary, times binary")
    exact = rows.groupBy("part").applyInArrow(add, "lang string, phrase binary, words int, times long")
    return exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "times")


def _exact(column: str) -> Column:
    """A count as a decimal, so that products beyond 64 bits are exact."""
    return F.col(column).cast("decimal(15,0)")


def score(phrases: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut: lang, phrase, words, a, l, r, score."""
    words = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select(
        "lang", "phrase", "words", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    cuts = cuts.withColumn("front", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("back", F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    for side, name in (("front", "l"), ("back", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("times").alias(name)), ["lang", side])
    product = F.lit(1_000_000).cast("decimal(7,0)") * _exact("a") * _exact("a")
    scored = cuts.withColumn("above", product).withColumn("below", _exact("l") * _exact("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("lowest")
    best = scored.groupBy("lang", "phrase", "words", "a").agg(lowest)
    return best.select("lang", "phrase", "words", "a", "lowest.l", "lowest.r", "lowest.score")


def not_covered(candidates: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates but those inside a longer candidate that has at least ``COVERED`` percent of their occurrences."""
    words = F.split("phrase", " ")
    longer = candidates.where("words > 2")
    inner = longer.select("lang", F.col("a").alias("most"), F.col("words").alias("of"), words.alias("all"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("of") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("of") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("all", F.col("at"), F.col("size")), " ").alias("phrase"), "most")
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    joined = candidates.join(inner, ["lang", "phrase"], "left")
    return joined.where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("a"))).drop("most")


def _ranked(found: DataFrame, kept: int, *by: str) -> DataFrame:
    order = Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, kept: int = KEPT) -> DataFrame:
    """The ``kept`` highest-scoring phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs text and lang; other columns are ignored, and so is doc_id: repeated rows count as often as they occur. A null
    language is ``und``; a null, empty or blank text has no words. Equal scores are ranked by falling count, then
    by the phrase's bytes. No documents, or no phrase that is frequent enough: no rows.
    """
    chunked = stage(dictionary(docs, longest), "dictionary")
    phrases = stage(count_phrases(chunked, longest, least), "phrases")
    found = not_covered(score(phrases), longest)
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    best = _ranked(_ranked(parts, kept, "part").drop("rank", "part"), kept)
    sizes = chunked.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))),
words AS (SELECT piece, lang, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM pieces),
runs AS (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3
  FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
sizes AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE p.f >= 10
    AND NOT EXISTS (
      SELECT 1 FROM f3 t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f
        AND ((t.w1 = p.w1 AND t.w2 = p.w2) OR (t.w2 = p.w1 AND t.w3 = p.w2)))
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 1, p.f, x.f, y.f
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, 2, p.f, x.f, y.f
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""
