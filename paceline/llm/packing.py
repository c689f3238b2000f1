"""Pack token sequences into windows of fixed length with Karmarkar and Karp's differencing.

A document becomes token ids and an end id. As many whole windows as it holds are cut off its front; each is a sequence
of its own. What is left, shorter than a window, is cut once more at a multiple of ``GRAIN``, so that there are long
and short pieces. Documents are dealt into groups of about ``GROUP`` by a hash, and the pieces of a group go into as
many windows as their sum needs: multiway differencing keeps one partial partition per piece, takes the two with
the largest difference between their fullest and emptiest window, and joins them fullest to emptiest, until one
partition is left. If a window exceeds its length, the count of windows rises and differencing starts again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import compress, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks, raw, stage, worker_state

LENGTH = 2048
GRAIN = 128
GROUP = 500
GROUPS_PER_TASK = 32
END_ID = 1
# Marks that are looked for at the end of a word.
MARKS = b".,;:!?%$#&*|"
MARK_BYTES = frozenset(MARKS)
# Words whose ids a Python worker remembers (about 200 bytes each), and words per call of the tokenizer.
REMEMBERED = 1_000_000
AT_ONCE = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _core(word: bytes) -> bytes | None:
    """A word without the marks at its end, if these are a piece of their own for sure: after a letter or digit."""
    core = word.rstrip(MARKS)
    if not core or b"<|" in word:
        return None
    last = core[-1:]
    return core if last.isalnum() or last > b"\x7f" and core.decode()[-1].isalpha() else None


class WordEncoder:
    """Ids of words as bytes, remembered by word in lower case (which the tokenizer makes of them anyway).

    This tokenizer never joins what white space parts, nor letters with the marks after them, so a text's ids are its words'
    ids in order, and a word's those of its letters and of the marks at its end. A word of letters alone is one piece to the
    tokenizer, whose last id, and no other, ends a piece: so unknown words go through it many at a time, parted by spaces.
    """

    def __init__(self, definition: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_whole(self, new: list[bytes]) -> None:
        """Ids of words that are not taken apart first."""
        texts = [w.decode() for w in new]
        letters = [t.isalpha() for t in texts]
        known = self.known
        for w, t in compress(zip(new, texts, strict=True), [not x for x in letters]):
            known[w] = self._ids(t).tobytes()
        new, texts = list(compress(new, letters)), list(compress(texts, letters))
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            ids = self._ids(" ".join(texts[i : i + AT_ONCE]))
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                known.update(zip(some, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                # A letter that normalisation takes apart makes more pieces than words.
                known.update((w, self._ids(w.decode()).tobytes()) for w in some)

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        marked = {w: core for w in new if w[-1] in MARK_BYTES and (core := _core(w))}
        # A set minus a dictionary's keys would walk over all that is known.
        parts = {*marked.values(), *(w[len(core) :] for w, core in marked.items())}
        parts.update(filterfalse(marked.__contains__, new))
        self._learn_whole(list(filterfalse(known.__contains__, parts)))
        for w, core in marked.items():
            known[w] = known[core] + known[w[len(core) :]]

    def encode(self, texts: list[bytes]) -> Iterator[memoryview]:
        """Little-endian unsigned 32-bit ids of each text.

        Words are told apart by Arrow, so each distinct one of these texts is looked up once, and ids are put in order in arrays.
        """
        if len(self.known) > self.remembered:
            self.known.clear()
        # The names of special tokens count in lower case alone, so a text that may hold one keeps its case.
        given = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary()).view(pa.large_string())
        # This parts at the same six bytes as ``bytes.split``, and may leave an empty word at an end.
        lists = pc.ascii_split_whitespace(given)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self.known[b""] = b""
        found = list(map(self.known.get, words))
        if None in found:
            unknown = [i for i, ids in enumerate(found) if ids is None]
            self._learn({words[i] for i in unknown})
            for i in unknown:
                found[i] = self.known[words[i]]
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, counts = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.append(0, np.cumsum(counts))
        place = np.repeat(starts - ends[:-1], counts)
        place += np.arange(len(place))
        data = memoryview(np.frombuffer(b"".join(found), "<u4")[place].tobytes())
        bounds = (ends[lists.offsets.to_numpy()] * 4).tolist()
        yield from (data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def piece_lengths(n: int, length: int = LENGTH, grain: int = GRAIN) -> list[int]:
    """Whole windows, then the rest in two parts of which the first is a multiple of ``grain``."""
    rest = n % length
    return [length] * (n // length) + [p for p in (rest - rest % grain, rest % grain) if p]


def encode(docs: DataFrame, definition: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Per document: its number of tokens and the CRC-32 of each piece; the ids stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"words-{zlib.crc32(shared.value.encode())}", lambda: WordEncoder(shared.value))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in chunks(batches):
            sizes, crcs = [], []
            for ids in encoder.encode(raw(batch.column("text"))):
                data = memoryview(bytes(ids) + end)
                at, own = 0, []
                for p in piece_lengths(len(data) // 4, length, grain):
                    own.append(zlib.crc32(data[at * 4 : (at + p) * 4]))
                    at += p
                sizes.append(at)
                crcs.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "crcs"],
            )

    given = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return given.mapInArrow(apply, "doc_id long, doc_tokens long, crcs array<long>")


def difference(sizes: list[int], windows: int) -> list[tuple[int, object]]:
    """One partition of all pieces into at most ``windows`` non-empty windows, fullest first.

    A window is (sum, tree of pieces); a partial partition lists its windows that are not empty, fullest first.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # The fullest of one meet the emptiest of the other; where one side is empty, the other stays as it is.
        shared = max(0, len(a) + len(b) - windows)
        joined = a[: len(a) - shared] + b[: len(b) - shared]
        for j in range(len(a) - shared, len(a)):
            x, y = a[j], b[windows - 1 - j]
            joined.append((x[0] + y[0], (x[1], y[1])))
        joined.sort(key=lambda w: -w[0])
        least = joined[-1][0] if len(joined) == windows else 0
        heapq.heappush(heap, (least - joined[0][0], made, joined))
        made += 1
    return heap[0][2] if heap else []


def pieces_of(tree: object) -> list[int]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo.extend(node)
        else:
            out.append(node)
    return sorted(out)


def pack_sizes(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Windows of at most ``length``, each a list of positions in ``sizes``."""
    windows = -(-sum(sizes) // length)
    while True:
        found = difference(sizes, windows)
        if not found or found[0][0] <= length:
            return [pieces_of(tree) for _, tree in found]
        windows += max(1, windows // 200)


def pack(docs: DataFrame, definition: str | None = None, length: int = LENGTH, grain: int = GRAIN, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; ``definition`` is a tokenizer file's content. Null and empty texts are their end id alone.
    Repeated rows are documents of their own. No rows: no pieces. Sequence ids are unique, not consecutive: the
    group's number times 2^32, and a number inside it. Groups are dealt by a hash of doc_id and row, so one id that fills
    the table spreads too; a group's result depends on its rows alone, in a fixed order.
    """
    if definition is None:
        with open(tokenizer_file(), encoding="utf-8") as file:
            definition = file.read()
    encoded = stage(encode(docs, definition, length, grain).withColumn("row", F.monotonically_increasing_id()), "encoded")
    groups = max(1, -(-encoded.count() // group))
    dealt = encoded.withColumn("group", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)))

    def place(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(table.column(c).to_pylist() for c in ("doc_id", "row", "doc_tokens", "crcs")), strict=True),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )
        number, out, short = 0, [], []
        base = key[0].as_py() << 32
        for doc, _, total, crcs in rows:
            start = 0
            for size, crc in zip(piece_lengths(total, length, grain), crcs, strict=True):
                if size == length:
                    out.append((doc, start, size, crc, total, base + number, 0))
                    number += 1
                else:
                    short.append((doc, start, size, crc, total))
                start += size
        for window in pack_sizes([p[2] for p in short], length):
            offset = 0
            for i in window:
                out.append((*short[i], base + number, offset))
                offset += short[i][2]
            number += 1
        names = [f.split()[0] for f in PIECES.split(", ")]
        return pa.table({name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate(names)})

    # Rows are few bytes but work for the task, so the number of tasks follows the groups, not the bytes.
    dealt = dealt.repartition(max(1, -(-groups // GROUPS_PER_TASK)), "group")
    return dealt.groupBy("group").applyInArrow(place, PIECES)
