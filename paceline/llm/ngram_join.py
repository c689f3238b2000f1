"""Jaccard self-join on word shingles by token-combination prefixes.

A document's tokens are the hashes of its distinct shingles, ordered from rare to frequent by a fixed-size count
sketch over all documents. Tokens are put into classes: the rare ones are one class, indexed token by token; the frequent
ones fall into ``classes(size)`` classes by their hash, indexed by pairs of tokens of a class. A document at a
Jaccard similarity of ``t`` or more to another has at most ``(1 - t) * size`` tokens that the other lacks. Losing a rare token
costs one signature; a class of n frequent tokens keeps a pair until n - 1 of its tokens are lost. So the prefix is extended
until rare tokens plus (n - 1) over the classes exceed that number. Of two similar documents, the one whose prefix ends first
in the common order then shares a signature with the other, whose prefix reaches at least as far.

Candidates of a signature pass a length test and a bitmap test (parity bits of both sets differ in at most as many places
as the sets do), both free of false negatives. In a signature with many documents only a spanning forest of the
passing pairs is handed on at first; verified links are joined to components; then all passing pairs between
different components follow. So a group of near copies costs links in proportion to its size, and none is lost
between different components. Every pair handed on is verified on the whole sets.

Documents with equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import chunks, interned, keep, mix, raw, stage, tree_sum, word_hashes, words
from paceline.llm.components import components

SHINGLE = 5
PERCENT = 80
SKETCH = 1 << 20
PARITY_WORDS = 8
# Signatures with more documents hand on a forest first; blocks of this many are compared at a time.
CROWD = 32
BLOCK = 2048
# Rows that a task remembers, to ship the text of repeated ones once.
MET = 200_000
# Bits of the filter that picks the documents whose sets are needed.
NEEDED = 1 << 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    code, codes, bounds = interned([words(t) for t in texts])
    h = word_hashes(code, len(code))[codes]
    total = len(codes)
    x = np.full(max(total - width + 1, 0), np.uint64(width))
    for i in range(width):
        x = mix(x * _A + h[i : i + len(x)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(x[a : b - width + 1]))
        elif b > a:
            one = np.full(1, np.uint64(b - a))
            for i in range(a, b):
                one = mix(one * _A + h[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set, from a hash of all its tokens."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def allowed(size: int, percent: int = PERCENT) -> int:
    """Tokens that a set of this size may have beside those it shares with a similar one."""
    return size - -(-percent * size // 100)


def schemes(size: int, percent: int = PERCENT) -> list[int]:
    """Size classes (powers of two) that hold this size or that of a possible partner."""
    low, high = -(-percent * size // 100), 100 * size // percent
    return list(range(low.bit_length() - 1, high.bit_length()))


def classes(scheme: int, percent: int = PERCENT) -> int:
    """Classes of frequent tokens in a size class, so that a prefix has a few tokens of each."""
    return max(1, (1 << scheme) * (100 - percent) // 160)


def signatures(tokens: np.ndarray, load: np.ndarray, frequent: float, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set. Sets this small that they are similar to equal ones alone have none."""
    size = len(tokens)
    spare = allowed(size, percent)
    # The nearest different set has one token more; equal sets are one node already.
    if 100 * size < percent * (size + 1):
        return np.zeros(0, np.uint64)
    need = spare + 1
    count = load[(tokens & np.uint64(len(load) - 1)).astype(np.int64)]
    order = np.lexsort((tokens, count))
    ordered = tokens[order]
    rare = int(np.searchsorted(count[order], frequent))
    out = []
    for scheme in schemes(size, percent):
        tag = np.uint64((scheme + 1) * int(_C) & (1 << 64) - 1)
        out.append(mix(ordered[: min(rare, need)] * _A + tag))
        if rare >= need:
            continue
        rest = ordered[rare:]
        cls = ((rest >> np.uint64(40)) % np.uint64(classes(scheme, percent))).astype(np.int64)
        by = np.argsort(cls, kind="stable")
        sorted_cls = cls[by]
        first = np.ones(len(rest), bool)
        first[by[1:]] = sorted_cls[1:] != sorted_cls[:-1]
        gained = np.cumsum(~first)
        reached = np.flatnonzero(gained >= need - rare)
        if len(reached):
            rest, cls = rest[: reached[0] + 1], cls[: reached[0] + 1]
        else:
            # Two documents that both run out of tokens share one of their first tokens, as in a plain prefix.
            out.append(mix(ordered[:need] * _B + tag))
        by = np.lexsort((rest, cls))
        rest, cls = rest[by], cls[by]
        for step in range(1, len(rest)):
            same = cls[step:] == cls[:-step]
            if not same.any():
                break
            out.append(mix(mix(rest[:-step][same] * _A + tag) + rest[step:][same]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens falls on i. Two sets' bits differ in at most as many places as the sets."""
    bits = PARITY_WORDS * 64
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_different(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Largest symmetric difference of similar sets of these sizes."""
    both = a + b
    return both - 2 * -(-percent * both // (100 + percent))


def _sketch(texts: DataFrame, width: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SKETCH, np.int64)
        for batch in chunks(batches):
            sets = shingle_sets(raw(batch.column("text")), width)
            total += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        return total

    return tree_sum(texts.select("text"), count, (SKETCH,), np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values.astype(np.uint64))))


def _index(texts: DataFrame, load: np.ndarray, width: int, percent: int) -> DataFrame:
    """Every document with its set's size, node, signatures and parity bits."""
    shared = texts.sparkSession.sparkContext.broadcast(load)
    mean = float(load.mean())
    frequent = mean + 6 * mean**0.5 + 32

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for batch in chunks(batches):
            sets = shingle_sets(raw(batch.column("text")), width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            signed = [signatures(s, load, frequent, percent) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    batch.column("row_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    _lists(signed),
                    _lists([parity(s) for s in sets]),
                ],
                names=["doc_id", "text_hash", "row_hash", "n_shingles", "node", "signatures", "parity"],
            )

    made = "n_shingles long, node long, signatures array<long>, parity array<long>"
    schema = T.StructType([*texts.select("doc_id", "text_hash", "row_hash").schema.fields, *T.StructType.fromDDL(made).fields])
    return texts.mapInArrow(apply, schema)


#: Of a pair that the tests rule out.
FAR = 65535


def distances(n, bits, label, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """(left, right) places in which the bitmaps differ, FAR where a pair fails a test or is in one component."""
    out = np.empty((len(left), len(right)), np.uint16)
    for i in range(0, len(left), 64):
        some = left[i : i + 64]
        apart = np.bitwise_count(bits[some][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.uint16)
        a, b = n[some][:, None], n[right][None, :]
        ok = (label[some][:, None] != label[right][None, :]) & (apart <= most_different(a, b, percent))
        ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        out[i : i + 64] = np.where(ok, apart, FAR)
    return out


def nearest_forest(apart: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(2, pairs) that span what the passing pairs connect, the nearest pairs first (Boruvka's steps)."""
    nodes = np.union1d(left, right)
    l, r = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    comp = np.unique(label[nodes], return_inverse=True)[1].astype(np.int64)
    out = []
    while True:
        apart[comp[l][:, None] == comp[r][None, :]] = FAR
        j, i = apart.argmin(axis=1), apart.argmin(axis=0)
        value = np.concatenate([apart[np.arange(len(l)), j], apart[i, np.arange(len(r))]])
        one, two = np.concatenate([l, l[i]]), np.concatenate([r[j], r])
        asked = comp[np.concatenate([l, r])]
        order = np.lexsort((two, one, value))
        order = order[value[order] < FAR]
        if not len(order):
            break
        first = order[np.unique(asked[order], return_index=True)[1]]
        up = np.arange(comp.max() + 1)
        for x, y in zip(comp[one[first]].tolist(), comp[two[first]].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up != up[up]).any():
            up = up[up]
        comp = up[comp]
        out.append(np.stack([nodes[one[first]], nodes[two[first]]]))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)


def _passing(size, bits, label, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of the row pairs i, j, those that the length and bitmap tests leave, in different components."""
    a, b = size[i], size[j]
    ok = (label[i] != label[j]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    i, j = i[ok], j[ok]
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    fits = apart <= most_different(size[i], size[j], percent)
    return np.stack([i[fits], j[fits]])


def _candidates(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b), a < b, that share a signature and pass both tests, in different components.

    ``rows``: key, side, node, n, parity, label, crowd, sorted by key inside the partition. With ``forest``, keys of
    more than ``CROWD`` rows give only a spanning forest of their passing pairs, the nearest ones.
    """

    def group(table: dict[str, np.ndarray], start: int, end: int) -> np.ndarray:
        side = table["side"][start:end]
        left, right = np.flatnonzero(side < 2) + start, np.flatnonzero(side != 1) + start
        apart = distances(table["n"], table["bits"], table["label"], left, right, percent)
        if side[0] == 0:
            # Within one block each pair is met once; across two blocks every pair is.
            apart[left[:, None] >= right[None, :]] = FAR
        if forest and end - start > CROWD:
            return nearest_forest(apart, left, right, table["label"])
        i, j = np.nonzero(apart < FAR)
        return np.stack([left[i], right[j]])

    def pairs(table: dict[str, np.ndarray], last: int) -> pa.RecordBatch:
        key = table["key"][:last]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if last else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], last)
        found = []
        # Small groups all at once: rows d apart with one key.
        small = np.repeat((ends - cuts <= CROWD) & (table["side"][cuts] == 0), ends - cuts)
        for d in range(1, CROWD):
            i = np.flatnonzero(small[: last - d] & (key[: last - d] == key[d:])) if last > d else np.zeros(0, np.int64)
            if not len(i):
                break
            found.append(_passing(table["n"], table["bits"], table["label"], i, i + d, percent))
        for c, e in zip(cuts.tolist(), ends.tolist(), strict=True):
            if not small[c]:
                found.append(group(table, c, e))
        ij = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        a, b = table["node"][ij[0]], table["node"][ij[1]]
        na, nb = table["n"][ij[0]], table["n"][ij[1]]
        swap = a > b
        columns = [np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)]
        unique = np.unique(np.stack(columns), axis=1) if len(a) else np.zeros((4, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in unique], names=["a", "b", "na", "nb"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "left", "right")])
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "n", "label")}
            bits = batch.column("parity").flatten().to_numpy(zero_copy_only=False)
            now |= {"sig": keys, "bits": bits.view(np.uint64).reshape(-1, PARITY_WORDS)}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]], axis=1 if c == "sig" else 0) for c in now}
            k = now["sig"]
            new = np.append(True, (k[:, 1:] != k[:, :-1]).any(axis=0))
            now["key"] = np.cumsum(new)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield pairs(now, last)
            held = {c: v[..., last:] if c == "sig" else v[last:] for c, v in now.items() if c != "key"}
        if held is not None:
            held["key"] = np.zeros(len(held["node"]), np.int64)
            yield pairs(held, len(held["node"]))

    return rows.mapInArrow(apply, "a long, b long, na long, nb long").distinct()


def _laid_out(shared: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of every signature, dealt so that no task needs more than two blocks of a crowded one together."""
    rows = shared.join(nodes.select("node", F.col("n_shingles").alias("n"), "parity"), "node")
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    # side 0: inside a block; 1 and 2: the lower and the higher block of a pair.
    spread = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            F.least("own", o).alias("left"),
            F.greatest("own", o).alias("right"),
            F.when(o == F.col("own"), 0).when(F.col("own") < o, 1).otherwise(2).alias("side"),
        ),
    )
    rows = rows.select("sig", "node", "n", "parity", "label", F.explode(spread).alias("s")).select("*", "s.*").drop("s")
    return rows


def _near(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    dealt = rows.repartition("sig", "left", "right").sortWithinPartitions("sig", "left", "right", "side", "node")
    return _candidates(dealt, percent, forest)


def bit_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each row's hash in the filter."""
    at = rows & (NEEDED - 1)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _picked(named: DataFrame, texts: DataFrame) -> DataFrame:
    """(row_hash, packed, as_a, as_b) of the rows at the ends of pairs (and of a few others), the text compressed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        # Eight bits a byte from the start: a byte each would be 32 MB a task.
        bits = np.zeros((2, NEEDED // 8), np.uint8)
        for batch in batches:
            for end in (0, 1):
                byte, bit = bit_of(batch.column(end).to_numpy(zero_copy_only=False))
                np.bitwise_or.at(bits[end], byte, bit)
        return bits

    marks = tree_sum(named.select("row_a", "row_b"), mark, (2, NEEDED // 8), np.uint8, np.bitwise_or)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, met = shared.value, set()
        for batch in chunks(batches):
            row = batch.column("row_hash").to_numpy(zero_copy_only=False)
            byte, bit = bit_of(row)
            ends = (marked[:, byte] & bit) != 0
            for i in np.flatnonzero(ends.any(axis=0)).tolist():
                # A row that the task has met before goes nowhere.
                if row[i] in met:
                    ends[:, i] = False
                met.add(row[i])
            if len(met) > MET:
                met.clear()
            hit = pa.array(ends.any(axis=0))
            packed = [pack_text(t) for t in raw(batch.column("text").filter(hit))]
            columns = [batch.column("row_hash"), pa.array(ends[0]), pa.array(ends[1])]
            yield pa.RecordBatch.from_arrays(
                [*(c.filter(hit) for c in columns), pa.array(packed, pa.binary())],
                names=["row_hash", "as_a", "as_b", "packed"],
            )

    schema = "row_hash long, as_a boolean, as_b boolean, packed binary"
    return texts.select("row_hash", "text").mapInArrow(pick, schema)


def pack_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(text, asbytes=True)


def unpack_text(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among candidate pairs, by the whole sets of both.

    Compressed texts travel rather than sets: they are a third as large. Pairs are named by the rows of their ends, two
    numbers each; while these are few, Spark sends them to the texts instead of the texts to them.
    """
    rows = nodes.select("node", "row_hash")
    end = lambda name: rows.select(F.col("node").alias(name), F.col("row_hash").alias(f"row_{name}"))
    named = stage(pairs.join(end("a"), "a").join(end("b"), "b").select("row_a", "row_b"), "named-pairs")
    picked = stage(_picked(named, texts), "picked")
    text = lambda name: picked.where(f"as_{name}").select(
        F.col("row_hash").alias(f"row_{name}"), F.col("packed").alias(f"text_{name}")
    )
    ready = named.join(text("b"), "row_b").join(text("a"), "row_a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in batches:
            linked = []
            for row, left, right in zip(*(batch.column(c) for c in ("row_a", "text_a", "text_b")), strict=True):
                if last is None or row.as_py() != last:
                    last, (tokens,) = row.as_py(), shingle_sets([unpack_text(left.as_py())], width)
                (other,) = shingle_sets([unpack_text(right.as_py())], width)
                both = len(np.intersect1d(tokens, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(tokens) + len(other) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(keep) for c in ("row_a", "row_b")], names=["row_a", "row_b"]
            )

    found = ready.select("row_a", "row_b", "text_a", "text_b").mapInArrow(verify, "row_a long, row_b long").distinct()
    found = stage(found, "found")
    return found.join(end("a"), "row_a").join(end("b"), "row_b").select("a", "b")


def linked(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, root and component_id, the smallest doc_id that links reach.

    Two documents link when their sets of shingles of ``width`` words (A-Z in lower case; the whole sequence where there are
    fewer) have a Jaccard similarity of ``percent`` / 100 or more. Null and empty texts and those without a word have no
    shingles, link with nothing and are components of their own id, also when an id repeats. Rows of null id take part; a
    component of nothing but them has a null id. Repeated rows link with each other. ``docs`` needs doc_id and text; other
    columns are not read.
    ``root`` names the component of a row with shingles, and is null without.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = texts.withColumn("row_hash", F.xxhash64("doc_id", "text_hash"))
    # Each step leaves one table; what it has staged and shuffled for itself, texts among it, is deleted with it, and the
    # tables when the last step that reads them is done.
    spark = docs.sparkSession
    index = keep(spark, "index", lambda: _index(texts, _sketch(texts, width), width, percent))
    named = keep(spark, "named", lambda: index.table.select("doc_id", "text_hash", "n_shingles", "node")).table
    first = [F.first(c).alias(c) for c in ("n_shingles", "row_hash", "signatures", "parity")]
    nodes = keep(spark, "nodes", lambda: index.table.where(F.col("node").isNotNull()).groupBy("node").agg(*first))
    index.release()
    rows = nodes.table.select(F.explode("signatures").alias("sig"), "node")
    crowds = rows.groupBy("sig").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1)
    shared = keep(spark, "shared", lambda: rows.join(crowds, "sig"))

    pairs = keep(spark, "pairs", lambda: _near(_laid_out(shared.table, nodes.table, None), percent, forest=True))
    links = [keep(spark, "links", lambda: _verified(pairs.table, nodes.table, texts, width, percent))]
    crowded = shared.table.where(F.col("crowd") > CROWD)
    if not crowded.isEmpty():
        joined = keep(spark, "joined", lambda: components(links[0].table))

        def rest() -> DataFrame:
            near = _near(_laid_out(crowded, nodes.table, joined.table), percent, forest=False)
            return near.join(pairs.table, ["a", "b"], "left_anti")

        more = keep(spark, "more-pairs", rest)
        joined.release()
        if not more.table.isEmpty():
            links.append(keep(spark, "more-links", lambda: _verified(more.table, nodes.table, texts, width, percent)))
        more.release()
    for done in (shared, pairs, nodes):
        done.release()
    roots = keep(spark, "roots", lambda: components(reduce(DataFrame.union, [k.table for k in links]))).table
    for done in links:
        done.release()
    rooted = named.join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rooted.join(smallest, "root", "left").select("doc_id", "text_hash", "n_shingles", "root", own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, one with its smallest id (a null id comes last); wordless rows all stay.

    All columns of ``docs``, of any name, are kept. No rows: no rows.
    """
    found = linked(docs, width, percent).where(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("m"))
    best = best.select(F.struct(F.col("m.doc_id").alias("id"), F.col("m.text_hash").alias("h")).alias("key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col("doc_id").alias("id"), F.xxhash64(text.cast("binary")).alias("h")).alias("key"),
        text.rlike(r"[^\x20\x09-\x0D]").alias("worded"),
    )
    # Rows alike in id and text are one; the join and the grouping share one shuffle.
    kept = rows.where("worded").join(best, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return rows.where("NOT worded").select("row.*").unionByName(kept.select("row.*"))


OP10_SQL = r"""
WITH RECURSIVE listed AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
    ) AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 3
            THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s
    FROM listed
), sized AS (
    SELECT doc_id, s, len(s) AS n FROM sets
), tokens AS (
    SELECT doc_id, n, unnest(s) AS t FROM sized
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM sized
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.m AS component_id
FROM sized s JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) r ON s.doc_id = r.a
"""
