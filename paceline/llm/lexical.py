"""Rank documents for text queries by exact integer scores, with buckets of impact vectors by length.

A document is a sparse vector: for each term the share of the score that its occurrences earn, its impact. Coordinates are scaled by
the square root of the term's weight on both sides, so that the score of a query is an inner product and the length of a
vector says how much it can score at all. Vectors are ordered by length over the whole corpus and cut into buckets of
near-equal lengths. For a query whose worst kept document scores ``s``,

* a bucket is left out if the product of the query's length and that of the bucket's longest vector is below ``s``,
  and so is the tail of a bucket from the first vector that is too short (Cauchy-Schwarz);
* inside a bucket each coordinate is at most the largest impact of its term there. The query's terms are taken by falling
  weight until the coordinate bounds of the others add up to less than ``s``; a document is a survivor if its exact share for
  the terms taken, plus the smaller of the others' coordinate bounds and their Cauchy-Schwarz bound, reaches ``s``;
* survivors are scored anew on all terms, in integers.

The bounds leave out only what cannot reach the kept documents, ties included. The longest vectors are searched first, by
themselves, and give every task a first ``s`` for each query. Only terms that some query of a block holds are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import chunks, raw, segment_sum, stage, tree_sum

KEPT = 50
# Vectors that are compared with the queries at a time, and about as many are searched first.
BUCKET = 8192
# Entries of vectors in a bucket at most, unless one vector has more, and entries that are scored at a time.
ENTRIES = 4 << 20
AT_ONCE = 1 << 20
# Bytes of query text whose terms and weights go to every task; more queries take another pass over the documents.
BLOCK_BYTES = 8 << 20
# Parts in which a query's best documents of all tasks are ranked before the last ranking.
PARTS = 32
# What floating-point bounds may lose to rounding.
SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max

# Letters and digits of ASCII and all else beyond it are terms; other ASCII parts them.
_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c if c in _KEEP else 0x20 for c in range(256)).lower()


def terms(data: bytes) -> list[bytes]:
    """Maximal runs of term characters, A-Z in lower case."""
    return data.translate(_FOLD).split()


def weight(documents: int, having: int) -> int:
    """Weight of a term that ``having`` of the documents hold; never negative."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(tf: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of terms that occur ``tf`` times in documents of these numbers of terms."""
    m = 50 + (50 * sizes * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Queries:
    """A block of queries: their terms by number, and for each query its terms by falling weight."""

    def __init__(self, texts: list[bytes]) -> None:
        found = [sorted(set(terms(t))) for t in texts]
        self.vocabulary = sorted(set(chain.from_iterable(found)))
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.terms = [np.array([number[t] for t in ts], np.int64) for ts in found]
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, weights: np.ndarray) -> None:
        self.weights = weights
        # A term that every document holds weighs nothing and decides nothing.
        self.terms = [ts[weights[ts] > 0] for ts in self.terms]
        self.terms = [ts[np.argsort(-weights[ts], kind="stable")] for ts in self.terms]


class Bucket:
    """Vectors by falling length, by document and by term."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, bounds: np.ndarray, codes: np.ndarray, impact: np.ndarray) -> None:
        self.ids, self.norms, self.bounds, self.codes, self.impact = ids, norms, bounds, codes, impact
        by = np.argsort(codes, kind="stable")
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        self.owner, self.by_term = owner[by], impact[by]
        ordered = codes[by]
        self.start = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.end = np.append(self.start[1:], len(ordered))
        self.held = ordered[self.start]
        self.most = np.maximum.reduceat(self.by_term, self.start) if len(ordered) else self.by_term

    def survivors(self, query: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Positions of all vectors that may score ``least`` or more, and above 0, for a query."""
        size = math.sqrt(int(weights[query].sum())) * SLACK
        # Vectors that are long enough; none is if the longest is not.
        enough = len(self.norms) - np.searchsorted(self.norms[::-1], least / size if size else math.inf)
        at = np.searchsorted(self.held, query)
        at[at == len(self.held)] = 0
        here = self.held[at] == query
        if not enough or not here.any():
            return np.zeros(0, np.int64)
        w, at = weights[query[here]], at[here]
        rest_bound = np.append(np.cumsum((w * self.most[at])[::-1])[::-1], 0)
        rest_size = np.sqrt(np.append(np.cumsum(w[::-1])[::-1], 0))
        # The terms after these cannot reach the least score by themselves.
        taken = int(np.count_nonzero(rest_bound >= max(least, 1)))
        share = np.zeros(len(self.ids), np.int64)
        for i in range(taken):
            held = slice(self.start[at[i]], self.end[at[i]])
            share[self.owner[held]] += w[i] * self.by_term[held]
        others = np.minimum(rest_bound[taken], rest_size[taken] * self.norms * SLACK + 1)
        found = np.flatnonzero((share > 0) & (share + others >= least))
        return found[found < enough]

    def parts(self, found: np.ndarray) -> list[np.ndarray]:
        """Survivors in parts of about ``AT_ONCE`` entries."""
        entries = np.cumsum(self.bounds[found + 1] - self.bounds[found])
        steps = range(AT_ONCE, int(entries[-1]) + 1, AT_ONCE) if len(found) else []
        return [part for part in np.split(found, np.searchsorted(entries, steps)) if len(part)]

    def scores(self, found: np.ndarray, query: np.ndarray, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some vectors; ``dense`` is an array of zeros, and is one again afterwards."""
        lengths = self.bounds[found + 1] - self.bounds[found]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(self.bounds[found] - cuts[:-1], lengths) + np.arange(cuts[-1])
        dense[query] = weights[query]
        total = segment_sum(dense[self.codes[where]] * self.impact[where], cuts)
        dense[query] = 0
        return total


class Best:
    """The highest-scoring documents of each query that a task has met, equal scores by ascending id."""

    def __init__(self, least: np.ndarray, kept: int) -> None:
        self.least, self.kept = least.copy(), kept
        self.scores = [np.zeros(0, np.int64) for _ in least]
        self.ids = [np.zeros(0, np.int64) for _ in least]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        first = np.lexsort((ids, -scores))[: self.kept]
        self.scores[q], self.ids[q] = scores[first], ids[first]
        if len(first) == self.kept:
            self.least[q] = max(self.least[q], self.scores[q][-1])


def _index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Every document's number of terms, and its counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in chunks(batches):
            lists = [terms(t) for t in raw(batch.column("text"))]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            codes = np.fromiter(map(number.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(lists)), sizes)[codes >= 0]
            both, counts = np.unique(owner * len(number) + codes[codes >= 0], return_counts=True)
            owner, codes = np.divmod(both, max(len(number), 1))
            bounds = pa.array(np.searchsorted(owner, np.arange(len(lists) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(bounds, pa.array(codes, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "size", "codes", "counts"],
            )

    given = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return given.mapInArrow(apply, "doc_id long, size long, codes array<int>, counts array<int>")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _bounds(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def _statistics(index: DataFrame, terms_: int) -> tuple[np.ndarray, int, int]:
    """How many documents hold each term, how many have terms at all, and how many terms they have."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(terms_ + 2, np.int64)
        for batch in batches:
            total[:terms_] += np.bincount(_flat(batch.column("codes")), minlength=terms_)
            sizes = batch.column("size").to_numpy()
            total[terms_:] += np.count_nonzero(sizes), sizes.sum()
        return total

    total = tree_sum(index, count, (terms_ + 2,), np.int64)
    return total[:terms_], int(total[-2]), int(total[-1])


def _vectors(index: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """Impact vectors of the documents that hold a term that weighs something, with their lengths."""
    shared = index.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            codes, counts, bounds = (f(batch.column(c)) for f, c in ((_flat, "codes"), (_flat, "counts"), (_bounds, "codes")))
            sizes = np.repeat(batch.column("size").to_numpy(), np.diff(bounds))
            impact = impacts(counts, sizes, documents, max(length, 1))
            norms = np.sqrt(segment_sum(weights[codes] * impact.astype(float) ** 2, bounds))
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(norms),
                    batch.column("codes"),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(impact, pa.int32())),
                ],
                names=["doc_id", "norm", "codes", "impact"],
            )
            yield made.filter(pa.array(norms > 0))

    return index.mapInArrow(apply, "doc_id long, norm double, codes array<int>, impact array<int>")


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Bucket]:
    def made(parts: list[pa.RecordBatch]) -> Bucket:
        table = pa.Table.from_batches(parts).sort_by([("norm", "descending")]).combine_chunks()
        columns = [table.column(c).combine_chunks() for c in ("codes", "impact")]
        codes, impact = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns)
        ids = table.column("doc_id").fill_null(_LAST).to_numpy()
        return Bucket(ids, table.column("norm").to_numpy(), _bounds(codes), _flat(codes), _flat(impact))

    waiting: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        bounds, start = _bounds(batch.column("codes")), 0
        while start < batch.num_rows:
            room = np.searchsorted(bounds, bounds[start] + ENTRIES - entries, side="right") - 1
            end = min(start + size - rows, int(room), batch.num_rows)
            if end > start or not rows:
                end = max(end, start + 1)
                waiting.append(batch.slice(start, end - start))
                rows += end - start
                entries += int(bounds[end] - bounds[start])
                start = end
            else:
                yield made(waiting)
                waiting, rows, entries = [], 0, 0
    if rows:
        yield made(waiting)


def _search(vectors: DataFrame, queries: Queries, least: np.ndarray, kept: int, bucket: int) -> DataFrame:
    """Each task's best documents of each query: query, doc_id (null: the largest number), score."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries.terms, queries.weights, least))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, least = shared.value
        best, dense = Best(least, kept), np.zeros(len(weights), np.int64)
        for b in _buckets(batches, bucket):
            for q, query in enumerate(wanted):
                found = b.survivors(query, weights, int(best.least[q]))
                for some in b.parts(found):
                    scores = b.scores(some, query, weights, dense)
                    good = scores >= max(int(best.least[q]), 1)
                    best.add(q, scores[good], b.ids[some[good]])
        sizes = [len(s) for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(wanted)), sizes), pa.int64()),
                pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()),
                pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64()),
            ],
            names=["query", "doc_id", "score"],
        )

    return vectors.mapInArrow(apply, "query long, doc_id long, score long")


def _ranked(found: DataFrame, kept: int, *by: str) -> DataFrame:
    order = Window.partitionBy("query", *by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def _best(found: DataFrame, kept: int) -> DataFrame:
    """The best of all tasks, ranked in parts first: a query may have a few rows from each of very many tasks."""
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    return _ranked(_ranked(parts, kept, "part").drop("rank", "part"), kept)


def _rank_block(docs: DataFrame, items: list, kept: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([bytes(r["text"]) for r in items])
    index = stage(_index(docs, queries.vocabulary), "index")
    having, documents, length = _statistics(index, len(queries.vocabulary))
    queries.weigh(np.array([weight(documents, int(n)) for n in having], np.int64))
    vectors = _vectors(index, queries.weights, documents, length)
    # Vectors of one length, such as those of copies, are spread by their hash.
    order = [F.desc("norm"), F.xxhash64("doc_id", "codes", "impact")]
    vectors = stage(vectors.repartitionByRange(*order).sortWithinPartitions(F.desc("norm")), "vectors")
    first = max(0.0, 1 - bucket / max(documents, 1))
    bound = vectors.agg(F.percentile_approx("norm", first)).first()[0]
    least = np.zeros(len(items), np.int64)
    if bound is not None:
        longest = _search(vectors.where(F.col("norm") >= bound), queries, least, kept, bucket)
        for row in _best(longest, kept).where(F.col("rank") == kept).select("query", "score").collect():
            least[row["query"]] = row["score"]
    best = _best(_search(vectors, queries, least, kept, bucket), kept)
    numbers = pa.table({"query": range(len(items)), "item_id": pa.array([r["item_id"] for r in items], pa.int64())})
    named = best.join(spark.createDataFrame(numbers), "query")
    doc_id = F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")


def rank(docs: DataFrame, items: DataFrame, kept: int = KEPT, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``kept`` highest-scoring documents of each item, those with a score above 0: item_id, rank, doc_id, score.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. A null or empty text has no terms: such a
    document still is no match, and such an item has no rows. Repeated documents each take a rank. Equal scores are
    ranked by ascending doc_id, a null id last. Repeated rows of ``items`` are one item; rows of one item_id and
    different texts are ranked apart. Without documents or items there are no rows.

    Items go to the driver and the tasks in blocks of about ``block_bytes`` of text, one pass over the documents each.
    """
    given = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    given = given.distinct()
    total = given.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    ranked = [_rank_block(docs, given.where(block == b).collect(), kept, bucket) for b in range(blocks)]
    return reduce(DataFrame.unionByName, ranked)


OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, total GROUP BY term, docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""
