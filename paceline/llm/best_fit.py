"""Pack token sequences into as few windows as possible by the sum-of-squares rule.

A document becomes token ids and an end id. One longer than a window is cut into whole windows, each a sequence of its
own, and a rest; nothing else is cut. The documents are dealt into groups of about ``GROUP`` by a hash, and in a group
the rests are placed one by one, longest first. For each gap size h, let N(h) be the number of open windows with h places left.
A rest goes into the open window that makes the sum of N(h) squared smallest, the fuller one of two that do; only where none
has room is a new one opened. So window levels stay spread over all sizes and some window nearly always has a gap that fits.

The counts N are an array of one number per gap, whatever the group holds, and one placement is a few array operations on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import stage
from paceline.llm.packing import encode, tokenizer_file

LENGTH = 4096
# Documents that are packed together; each group may leave one window half empty. A group takes about 0.1 s.
GROUP = 8192
_NO_ROOM = np.iinfo(np.int64).max

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def place(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(window, offset) of each size (1 to ``length``), taken in the order given; windows are numbered as they open."""
    count = np.zeros(length + 1, np.int64)
    open_with: dict[int, list[int]] = {}
    out, opened = [], 0
    for size in sizes:
        # Change of the sum when the piece goes into a window with gap size, size + 1, ...: one window less with that
        # gap, one more with what is left of it. A window without a gap is not open any more and counts nothing.
        gaps = count[size:length]
        change = count[: length - size] - gaps + 1
        change *= 2
        if len(change):
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = _NO_ROOM
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] != _NO_ROOM:
            gap = size + best
            window = open_with[gap].pop()
            count[gap] -= 1
        else:
            gap, window = length, opened
            opened += 1
        out.append((window, length - gap))
        if gap > size:
            open_with.setdefault(gap - size, []).append(window)
            count[gap - size] += 1
    return out


def pack(docs: DataFrame, definition: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text; ``definition`` is a tokenizer file's content. Null and empty texts are their end id alone.
    Repeated rows, and rows of one doc_id, are documents of their own. No rows: no pieces. Other columns are ignored.
    Sequence ids are unique, not consecutive: the group's number times 2^32, and a number inside it. Groups are dealt by a hash
    of doc_id and row, so one id that fills the table spreads too. Ties of length are taken by doc_id, then row.
    """
    if definition is None:
        with open(tokenizer_file(), encoding="utf-8") as file:
            definition = file.read()
    # With a grain as long as a window, the encoder cuts whole windows and one rest.
    encoded = stage(encode(docs, definition, length, length).withColumn("row", F.monotonically_increasing_id()), "encoded")
    groups = max(1, -(-encoded.count() // group))
    dealt = encoded.withColumn("group", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)))

    def pack_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        base = key[0].as_py() << 32
        ids = table.column("doc_id").to_pylist()
        out, rests = [], []
        for doc, total, crcs in zip(ids, table.column("doc_tokens").to_pylist(), table.column("crcs").to_pylist(), strict=True):
            whole, rest = divmod(total, length)
            first = base + len(out)
            out.extend([(doc, i, i * length, length, crcs[i], first + i, 0) for i in range(whole)])
            if rest:
                rests.append((rest, doc, whole, crcs[-1]))
        base += len(out)
        rests.sort(key=lambda r: -r[0])
        for (size, doc, piece, crc), (window, offset) in zip(rests, place([r[0] for r in rests], length), strict=True):
            out.append((doc, piece, piece * length, size, crc, base + window, offset))
        fields = [f.split() for f in PIECES.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32()}
        return pa.table({name: pa.array([r[i] for r in out], types[kind]) for i, (name, kind) in enumerate(fields)})

    # Rows are few bytes but work for the task: a task for every group.
    return dealt.repartition(groups, "group").groupBy("group").applyInArrow(pack_group, PIECES)
