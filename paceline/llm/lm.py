"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z in lower case) and one end per text. The ``CLASSES * WIDTH`` most frequent training tokens are modelled
words, ordered by count and cut into classes; all other tokens form one more class. A token's probability is that of its class
given the two tokens before it, times that of the word given the class and the same history.

The words of the last class, all that are left of the vocabulary, are the leaves of a tree with ``BRANCH`` ways at each node, which
the bits of a word's hash lead through; its levels follow the number of words. Each node is a softmax over its ways given the
words before, whichever they are: the ways' smoothed counts, times the hashed features of the word before and of both, with
weights from one step of iterative scaling over all training tokens of that class. In a leaf a word has the smoothed share
(c + 1) / (n + v + 1) of the n tokens and v distinct ones there, which leaves room for unknown ones.

Both softmax layers sum the weights of hashed features: the token before (2-gram), both tokens (3-gram), the one before
the last alone (skip), and a bias that starts at the log counts. Training sees every training token: equal (history,
token) events are counted over all documents, and each round sends the weights to the tasks, sums expected feature counts
over all events in a tree, and moves each weight along its gradient, scaled by the feature's expected count.

Documents are read once. They are kept as blocks of word numbers in the scratch folder; only a block's distinct words meet
the corpus counts in a shuffle, and a word comes at most once a block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import chunks, give_back, mix, raw, segment_sum, stage, tree_sum, words

CLASSES = 16
WIDTH = 32
SLOTS = 1 << 14
ROUNDS = 6
RATE = 0.4
LARGEST_STEP = 1.3
SMOOTH = 4.0
# Text bytes of a block, and events that a training task takes.
BLOCK_BYTES = 6 << 20
EVENTS_PER_TASK = 600_000
BATCH = 1 << 15
REST_BATCH = 1 << 18
# Ways of a node of the tree of all other words, words of a leaf that are enough, most levels, and most weight slots of the tree.
BRANCH = 32
LEAF_WORDS = 64
MOST_LEVELS = 4
REST_SLOTS = 1 << 15
# Blocks that a task counts features of the tree in; each task hands on 256 bytes a slot.
REST_BLOCKS = 8
# Counts that a feature of the tree needs to tell something, and the share of a step that it takes.
REST_SMOOTH = 3.0
REST_RATE = 0.7
END = b"\n"
_BITS = 11
_START = 0x9E3779B97F4A7C15

BLOCKS = "block long, doc_id array<long>, held array<boolean>, sizes array<long>, hashes binary, trained binary, codes binary"


def _hash(vocabulary) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64).view(np.int64)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held, text) as blocks: distinct words by hash, with training counts, and each document's words."""
    code: dict[bytes, int] = {END: 0}
    parts: list[np.ndarray] = []
    ids: list = []
    held: list[bool] = []
    sizes: list[int] = []
    size, number = 0, 0
    base = TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        codes = np.concatenate(parts)
        learns = np.repeat(~np.array(held), sizes)
        trained = np.bincount(codes[learns], minlength=len(code))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([base + number]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([_hash(code).tobytes()], pa.binary()),
                pa.array([trained.astype(np.int64).tobytes()], pa.binary()),
                pa.array([pa.compress(codes.astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary()),
            ],
            names=[f.split()[0] for f in BLOCKS.split(", ")],
        )

    for batch in chunks(batches):
        for doc, out, text in zip(
            batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), raw(batch.column("text")), strict=True
        ):
            own = words(text)
            codes = np.fromiter((code.setdefault(w, len(code)) for w in own), np.int32, len(own))
            parts.append(np.append(codes, np.int32(0)))
            ids.append(doc)
            held.append(out)
            sizes.append(len(own) + 1)
            size += len(text) + 1
            if size >= BLOCK_BYTES:
                yield block()
                code, parts, ids, held, sizes, size, number = {END: 0}, [], [], [], [], 0, number + 1
    if ids:
        yield block()


def _codes(block: dict) -> np.ndarray:
    sizes = sum(block["sizes"])
    return np.frombuffer(pa.decompress(block["codes"], decompressed_size=4 * sizes, codec="zstd"), np.int32)


def _one_by_one(batches: Iterator[pa.RecordBatch] | list[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks as dictionaries; a batch may hold many of them, so only one at a time becomes Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _one_by_one(batches):
        word = np.frombuffer(block["hashes"], np.int64)
        trained = np.frombuffer(block["trained"], np.int64)
        columns = [np.full(len(word), block["block"]), np.arange(len(word)), word, trained]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "pos", "word", "own"])


@dataclass
class Model:
    """``top``: hashes of the modelled words by falling count. Weights: class layer (slots, classes + 1), word layer
    (slots, width), and their biases. ``rest_total`` = N' + V' + 1."""

    top: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_weights: np.ndarray
    word_weights: np.ndarray
    tokens: int
    distinct: int
    rest_total: int

    @property
    def rest(self) -> int:
        """Number of the token that stands for all words that are not modelled; the next one is the start of a text."""
        return len(self.top)


def start_model(top: list[tuple[int, int]], tokens: int, distinct: int, classes: int, width: int, slots: int) -> Model:
    """Weights that give each token its share in training, whatever its history."""
    counts = np.array([n for _, n in top], np.float64)
    grid = np.zeros((classes, width))
    grid.reshape(-1)[: len(top)] = counts
    rest = tokens - int(counts.sum())
    with np.errstate(divide="ignore"):
        class_bias = np.log(np.append(grid.sum(axis=1), max(rest, 0.5 if tokens else 1.0)))
        word_bias = np.log(grid)
    return Model(
        np.array([w for w, _ in top], np.int64),
        np.maximum(class_bias, -1e4).astype(np.float32),
        np.maximum(word_bias, -1e4).astype(np.float32),
        np.zeros((slots, classes + 1), np.float32),
        np.zeros((slots, width), np.float32),
        tokens,
        distinct,
        rest + distinct - len(top) + 1,
    )


def _numbers(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Model number of each word of a block."""
    order = np.argsort(model.top)
    at = np.searchsorted(model.top[order], hashes)
    at = np.minimum(at, max(len(order) - 1, 0))
    hit = model.top[order][at] == hashes if len(order) else np.zeros(len(hashes), bool)
    return np.where(hit, order[at] if len(order) else 0, model.rest).astype(np.int64)


def _events(model: Model, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token with the two before it in its text, as one number."""
    start = model.rest + 1
    first = np.cumsum(sizes) - sizes
    one = np.empty_like(numbers)
    one[1:] = numbers[:-1]
    one[first] = start
    two = np.empty_like(numbers)
    two[1:] = one[:-1]
    two[first] = start
    return (two << (2 * _BITS)) | (one << _BITS) | numbers


def _parts(events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _BITS) - 1
    return events >> (2 * _BITS), (events >> _BITS) & mask, events & mask


def _slots(two: np.ndarray, one: np.ndarray, slots: int, layer: np.ndarray | int) -> np.ndarray:
    """(features, events) slots of the hashed features; ``layer`` keeps the layers (and classes) apart."""
    keys = np.stack([one, two, (two << _BITS) | one])
    kind = np.arange(3)[:, None]
    return (mix(((keys << 16) | (np.asarray(layer) << 2) | kind).astype(np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


def _softmax(weights: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = bias + weights[at[0]] + weights[at[1]] + weights[at[2]]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def event_logs(model: Model, events: np.ndarray) -> np.ndarray:
    """log10 of each event's probability; for a token of the last class, of that class."""
    width, classes = model.word_weights.shape[1], len(model.class_bias) - 1
    out = np.empty(len(events))
    for i in range(0, len(events), BATCH):
        two, one, token = _parts(events[i : i + BATCH])
        known = token < model.rest
        cls = np.where(known, token // width, classes)
        p = _softmax(model.class_weights, _slots(two, one, len(model.class_weights), 0), model.class_bias)
        p = p[np.arange(len(cls)), cls].astype(np.float64)
        k = np.flatnonzero(known)
        if len(k):
            at = _slots(two[k], one[k], len(model.word_weights), cls[k] + 1)
            q = _softmax(model.word_weights, at, model.word_bias[cls[k]])
            p[k] *= q[np.arange(len(k)), token[k] % width]
        out[i : i + BATCH] = np.log10(np.maximum(p, 1e-300))
    return out


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows of values to the rows ``at`` of a total, each feature in turn."""
    for slots in at:
        order = np.argsort(slots, kind="stable")
        ordered = slots[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        total[ordered[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _feature_counts(model: Model, events: np.ndarray, n: np.ndarray, gap: np.ndarray, size: np.ndarray) -> None:
    """Add, for every feature, observed minus expected counts to ``gap`` and expected ones to ``size``."""
    slots, width, classes = len(model.class_weights), model.word_weights.shape[1], len(model.class_bias) - 1
    for i in range(0, len(events), BATCH):
        two, one, token = _parts(events[i : i + BATCH])
        count = n[i : i + BATCH].astype(np.float32)
        known = token < model.rest
        cls = np.where(known, token // width, classes)
        for layer, pick, target in ((0, slice(None), cls), (1, np.flatnonzero(known), token % width)):
            if layer and not len(pick):
                continue
            own, t, c = (cls + 1)[pick], target[pick], count[pick]
            at = _slots(two[pick], one[pick], slots, own if layer else 0)
            weights = model.word_weights if layer else model.class_weights
            bias = model.word_bias[own - 1] if layer else model.class_bias
            p = _softmax(weights, at, bias) * c[:, None]
            columns = slice(classes + 1, None) if layer else slice(0, classes + 1)
            _add_rows(size[:, columns], at, p)
            p *= -1
            p[np.arange(len(t)), t] += c
            _add_rows(gap[:, columns], at, p)


def train(model: Model, events: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Improve a model over counted events (event, n); every round uses all of them."""
    total = events.count()
    if not total or not len(model.top):
        return model
    dealt = events.coalesce(max(1, -(-total // EVENTS_PER_TASK)))
    slots, wide = len(model.class_weights), len(model.class_bias) + model.word_weights.shape[1]
    for _ in range(rounds):
        shared = events.sparkSession.sparkContext.broadcast(vars(model))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> np.ndarray:
            out, model = np.zeros((2, slots, wide), np.float32), Model(**shared.value)
            for batch in batches:
                event, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("event", "n"))
                _feature_counts(model, event, n, out[0], out[1])
            return out

        gap, size = tree_sum(dealt, count, (2, slots, wide), np.float32)
        # The gradient, less a pull to zero, over a bound on its slope: features of an event share the step.
        step = np.clip(rate * gap / (size + SMOOTH), -LARGEST_STEP, LARGEST_STEP)
        classes = len(model.class_bias)
        model.class_weights += step[:, :classes]
        model.word_weights += step[:, classes:]
        shared.unpersist()
    return model


@dataclass
class Corpus:
    """Blocks of documents, and for each distinct word of each block its count over all training texts."""

    blocks: DataFrame
    counts: DataFrame


def read_corpus(docs: DataFrame) -> Corpus:
    """``docs``: doc_id, held (boolean), text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    blocks = stage(docs.select(F.col("doc_id").cast("long"), "held", text).mapInArrow(_to_blocks, BLOCKS), "blocks")
    rows = blocks.select("block", "hashes", "trained").mapInArrow(_word_rows, "block long, pos long, word long, own long")
    word = Window.partitionBy("word")
    counted = rows.select(
        "block",
        F.col("pos").cast("int"),
        "word",
        F.sum("own").over(word).alias("total"),
        (F.min("block").over(word) == F.col("block")).alias("first"),
    )
    return Corpus(blocks, stage(counted, "word-counts"))


def fit(corpus: Corpus, classes: int = CLASSES, width: int = WIDTH, slots: int = SLOTS, rounds: int = ROUNDS) -> Model:
    """Learn from all documents that are not held out."""
    once = corpus.counts.where(F.col("first") & (F.col("total") > 0))
    size = once.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = once.orderBy(F.desc("total"), "word").limit(classes * width).select("word", "total").collect()
    model = start_model([(r.word, r.total) for r in top], size.n, size.v, classes, width, slots)
    shared = corpus.blocks.sparkSession.sparkContext.broadcast(vars(model))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for block in _one_by_one(batches):
            sizes = np.array(block["sizes"], np.int64)
            numbers = _numbers(model, np.frombuffer(block["hashes"], np.int64))[_codes(block)]
            learns = np.repeat(~np.array(block["held"], bool), sizes)
            event, n = np.unique(_events(model, numbers, sizes)[learns], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(event), pa.array(n)], names=["event", "n"])

    counted = corpus.blocks.select("held", "sizes", "hashes", "codes").mapInArrow(events, "event long, n long")
    counted = stage(counted.groupBy("event").agg(F.sum("n").alias("n")), "events")
    return train(model, counted, rounds)


@dataclass
class Rest:
    """The tree of all words that are not modelled by themselves: counts, words and one unknown word of each leaf; weights (slots, BRANCH)."""

    leaves: np.ndarray
    weights: np.ndarray

    @property
    def levels(self) -> int:
        return (len(self.leaves).bit_length() - 1) // (BRANCH.bit_length() - 1)

    def shares(self, level: int) -> np.ndarray:
        """The ways' smoothed shares of each node of a level."""
        ways = self.leaves.reshape(BRANCH**level, BRANCH, -1).sum(axis=2, dtype=np.float64)
        return (ways / ways.sum(axis=1, keepdims=True)).astype(np.float32)

    def leaf(self, words: np.ndarray) -> np.ndarray:
        """Number of each word's leaf; its digits are the way to it."""
        return (mix(words.view(np.uint64)) & np.uint64(len(self.leaves) - 1)).astype(np.int64)

    def steps(self, leaf: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of a level on the way to a leaf, and the way that is taken there."""
        node, way = np.divmod(leaf // BRANCH ** (self.levels - 1 - level), BRANCH)
        return node, way


def _rest_slots(two: np.ndarray, one: np.ndarray, node: np.ndarray, level: int, slots: int) -> np.ndarray:
    """(features, tokens) slots of the word before and of both words, at a node."""
    place = mix((node + BRANCH**level).astype(np.uint64) * np.uint64(_START))
    keys = np.stack([mix(one ^ place), mix(mix(two + place) ^ one)])
    return (keys & np.uint64(slots - 1)).astype(np.int64)


def _rest_events(model: Model, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a block's tokens of the last class are, their words, and the two words before each, by hash."""
    hashes, codes, sizes = np.frombuffer(block["hashes"], np.int64), _codes(block), np.array(block["sizes"], np.int64)
    at = np.flatnonzero((_numbers(model, hashes) == model.rest)[codes])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)[at]

    def before(n: int) -> np.ndarray:
        found = hashes[codes[np.maximum(at - n, 0)]].view(np.uint64)
        return np.where(at - n >= first, found, np.uint64(_START))

    return at, hashes[codes[at]], before(1), before(2)


def rest_logs(rest: Rest, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 of the probability of each word's leaf after the two words before it."""
    out = np.zeros(len(words))
    for level in range(rest.levels):
        with np.errstate(divide="ignore"):
            bias = np.log(rest.shares(level))
        for i in range(0, len(words), BATCH):
            own = slice(i, i + BATCH)
            node, way = rest.steps(rest.leaf(words[own]), level)
            at = _rest_slots(two[own], one[own], node, level, len(rest.weights))
            z = bias[node] + rest.weights[at[0]] + rest.weights[at[1]]
            out[own] += (z[np.arange(len(way)), way] - np.log(np.exp(z).sum(axis=1, dtype=np.float64))) / np.log(10)
    return out


def _rest_counts(rest: Rest, words: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> None:
    """Add, for every way and slot, the observed counts, and those that the ways' smoothed shares give."""
    slots = seen.shape[1]
    for level in range(rest.levels):
        shares = np.ascontiguousarray(rest.shares(level).T)
        for i in range(0, len(words), REST_BATCH):
            own = slice(i, i + REST_BATCH)
            node, way = rest.steps(rest.leaf(words[own]), level)
            for at in _rest_slots(two[own], one[own], node, level, slots):
                np.add.at(seen.reshape(-1), way * slots + at, np.float32(1))
                if not level:
                    expected += shares * np.bincount(at, minlength=slots).astype(np.float32)
                    continue
                for w in range(BRANCH):
                    expected[w] += np.bincount(at, shares[w][node], slots)


def fit_rest(corpus: Corpus, model: Model, slots: int = REST_SLOTS) -> Rest:
    """The tree of all training words that ``model`` leaves to its last class. Its levels and slots follow their number."""
    number = model.distinct - len(model.top)
    levels = next((d for d in range(MOST_LEVELS) if LEAF_WORDS * BRANCH**d >= number), MOST_LEVELS)
    top, leaves = model.top, BRANCH**levels
    rest = Rest(np.ones(leaves, np.int64), np.zeros((1, BRANCH), np.float32))

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(leaves, np.int64)
        for batch in batches:
            words, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "total"))
            own = ~np.isin(words, top)
            np.add.at(out, rest.leaf(words[own]), total[own] + 1)
        return out

    once = corpus.counts.where(F.col("first") & (F.col("total") > 0)).select("word", "total")
    rest.leaves = rest.leaves + tree_sum(once, fill, (leaves,), np.int64)
    if not levels:
        return rest
    size = min(slots, 1 << (number // 4).bit_length())
    shared = corpus.blocks.sparkSession.sparkContext.broadcast((vars(model), rest.leaves))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        own, leaves = shared.value
        model, rest = Model(**own), Rest(leaves, np.zeros((size, BRANCH), np.float32))
        out = np.zeros((2, BRANCH, size), np.float32)
        for block in _one_by_one(batches):
            at, words, one, two = _rest_events(model, block)
            learns = np.repeat(~np.array(block["held"], bool), block["sizes"])[at]
            _rest_counts(rest, words[learns], one[learns], two[learns], out[0], out[1])
        return out

    dealt = corpus.blocks.select("held", "sizes", "hashes", "codes").coalesce(max(1, -(-corpus.blocks.count() // REST_BLOCKS)))
    seen, expected = tree_sum(dealt, count, (2, BRANCH, size), np.float32)
    shared.destroy()
    rest.weights = np.float32(REST_RATE) * np.log((seen + REST_SMOOTH) / (expected + REST_SMOOTH)).T.copy()
    return rest


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(corpus: Corpus, model: Model, rest: Rest | None = None) -> DataFrame:
    """Every document with its size, known tokens, and log10 probabilities by smoothed counts and by the model.

    Without a tree all words of the last class have their smoothed shares, whatever comes before them.
    """
    rest = rest or Rest(np.array([model.rest_total]), np.zeros((1, BRANCH), np.float32))
    shared = corpus.blocks.sparkSession.sparkContext.broadcast((vars(model), vars(rest)))

    def apply(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        model, rest = Model(**shared.value[0]), Rest(**shared.value[1])
        out = []
        totals = counts.column("total").to_numpy()
        position = counts.column("pos").to_numpy()
        for block in _one_by_one(blocks.to_batches()):
            sizes = np.array(block["sizes"], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            hashes = np.frombuffer(block["hashes"], np.int64)
            codes = _codes(block)
            c = np.zeros(len(hashes), np.int64)
            c[position] = totals
            numbers = _numbers(model, hashes)
            base = np.log10((c + 1.0) / (model.tokens + model.distinct + 1))
            inside = np.where(numbers == model.rest, np.log10((c + 1.0) / rest.leaves[rest.leaf(hashes)]), 0.0)
            unique, back = np.unique(_events(model, numbers[codes], sizes), return_inverse=True)
            logs = event_logs(model, unique)[back] + inside[codes]
            at, *own = _rest_events(model, block)
            logs[at] += rest_logs(rest, *own)
            n = len(sizes)
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(block["doc_id"], pa.int64()),
                        "held_out": pa.array(block["held"], pa.bool_()),
                        "n_tokens": pa.array(sizes),
                        "n_known": pa.array(segment_sum((c > 0).astype(np.int64)[codes], bounds)),
                        "train_tokens": pa.array(np.full(n, model.tokens, np.int64)),
                        "base_score": pa.array(segment_sum(base[codes], bounds)),
                        "score": pa.array(segment_sum(logs, bounds)),
                    }
                )
            )
        return pa.concat_tables(out)

    # Only counts of words that training texts hold have something to say; others are 0.
    counts = corpus.counts.where(F.col("total") > 0).select("block", "pos", "total")
    return corpus.blocks.drop("trained").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(apply, SCORED)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, held, text) that are not held out, and score all of them.

    Per row: doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score and
    score. Null and empty texts are their end alone. Repeated rows are scored alike and each counts in training. Nothing to
    train on: every token has probability 1, as the smoothed counts say. Words are told apart by a 64-bit hash.
    """
    corpus = read_corpus(docs)
    model = fit(corpus, **options)
    rest = fit_rest(corpus, model)
    # Scoring shuffles the blocks; what counting and training have shuffled is done with.
    give_back(docs.sparkSession)
    return score(corpus, model, rest)
