"""Helpers that several text operators share: reading, staging, words, batches and bounded sums."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
import types
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.session import release, scratch, scratch_path
from paceline.sources.tables import stage as stage

# Text bytes that a task handles at a time; a single longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
# Rows of a batch on the way to Python where memory is short (see ``small_batches``).
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Seconds after which a Python worker drops what it has not used.
UNUSED_S = 5.0
WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = 0x9E3779B97F4A7C15


class Kept(NamedTuple):
    """A table in the scratch folder, which can be given back."""

    table: DataFrame
    folder: str

    def release(self) -> None:
        """Delete it; nothing that reads it may be used afterwards."""
        release(self.table.sparkSession, [self.folder])


def keep(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> Kept:
    """Write what ``make`` returns to the scratch folder, and delete whatever else was staged or shuffled on the way."""
    path = scratch_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
        schema = df.schema
    del df
    give_back(spark)
    return Kept(spark.read.schema(schema).parquet(path), path.rpartition("/")[0])


def give_back(spark: SparkSession) -> None:
    """Delete the files of shuffles that no plan needs any more.

    Spark deletes them when the driver has collected the plan that they belong to, which a driver with memory to spare does late or
    never; so it is asked to.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> SparkSession:
    """A session of the same settings, but few rows a batch on the way to Python; the caller's keeps its own.

    Spark's batches hold 10,000 rows whatever their size: some 25 MB of text, which every running task has outside of its heap
    and once more in its Python worker.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    rows = min(int(spark.conf.get(BATCH_SETTING)) or BATCH_ROWS, BATCH_ROWS)
    own.conf.set(BATCH_SETTING, rows)
    return own


def corpus(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether a document is kept from training, by the CRC-32 of its id as text; an id of null is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def words(data: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, A-Z in lower case.

    ``bytes.split`` cuts at exactly these six bytes, and ``bytes.lower`` changes A-Z alone.
    """
    return data.lower().split()


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``limit`` bytes of text at most."""
    forget_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, end - start)
            done, start = int(size[end - 1]), end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(vocabulary: Iterable[bytes], count: int, seed: int = 0) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, count)


def interned(lists: list[list]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Words of several documents as (word -> code, codes in order, start of each document)."""
    code: dict = {}
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    codes = np.fromiter((code.setdefault(w, len(code)) for ws in lists for w in ws), np.int64, int(bounds[-1]))
    return code, codes, bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds; an empty segment gives 0 (``reduceat`` alone would not)."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def _states() -> dict:
    """What this Python worker keeps between tasks, by name, with the time of its last use.

    Task functions come with their code and have no module of their own that would outlive a task, so it is kept in a
    module that is made for it.
    """
    return vars(sys.modules.setdefault("paceline_worker_state", types.ModuleType("paceline_worker_state")))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Something costly that a Python worker makes once and keeps for its later tasks; ``name`` must fix its value."""
    states = _states()
    made = states[name][1] if name in states else make()
    states[name] = (time.monotonic(), made)
    return made


def forget_unused() -> None:
    """Drop what earlier steps have left in this worker, and give free memory back. Every task that reads texts or gathers counts calls this first.

    Freed memory otherwise stays with the worker, scattered, and adds to what the executor's next step needs.
    """
    states, now = _states(), time.monotonic()
    unused = [n for n, s in states.items() if isinstance(s, tuple) and now - s[0] > UNUSED_S]
    for name in unused:
        del states[name]
    if unused:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tree_sum(
    df: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    shape: tuple,
    dtype,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add,
) -> np.ndarray:
    """One fixed-size array per task, added up (or else combined) in a tree; few partial results reach the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"a": [np.ascontiguousarray(partial(batches), dtype).tobytes()]})

    def add(a, b):
        if a is None or b is None:
            return b if a is None else a
        return combine(np.frombuffer(a, dtype), np.frombuffer(b, dtype)).tobytes()

    parts = df.mapInArrow(one, T.StructType([T.StructField("a", T.BinaryType())])).rdd.map(lambda r: bytes(r[0]))
    total = parts.treeAggregate(None, add, add, depth=3)
    return np.zeros(shape, dtype) if total is None else np.frombuffer(total, dtype).reshape(shape).copy()
