"""Packing documents into sequences by minimum bin slack.

Whole windows are cut from the front of a long document. What remains of each document, less
than one window, is gathered up to a bound; then each sequence is filled by a subset-sum
search over the multiset of remaining lengths: Python integers serve as bitsets of reachable
sums, lengths come with binary-split counts, and the counts that reach the best sum are read
back from the steps.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers
from .tokens import default_vocabulary, encoder

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in PIECES.split(", ")])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum that is at most ``capacity``.

    ``counts`` holds how many pieces of each length (1 to capacity) there are. One piece of
    the largest length is always taken, so that no length is put off to the end.
    """
    lengths = sorted((n for n in counts if counts[n]), reverse=True)
    if not lengths:
        return {}
    largest = lengths[0]
    room = capacity - largest
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        left = min(counts[n] - (n == largest), room // n)
        share = 1
        while left > 0 and not reach >> room:
            k = min(share, left)
            steps.append((n, k, reach))
            reach |= (reach << n * k) & mask
            left -= k
            share *= 2
        if reach >> room:
            break
    best, taken = reach.bit_length() - 1, {largest: 1}
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            best -= n * k
            taken[n] = taken.get(n, 0) + k
    return taken


def _powers(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


class _Packer:
    """Packs one task's documents; holds at most ``gathered`` remainders at a time."""

    def __init__(self, capacity: int, gathered: int, first_sequence: int):
        self.capacity, self.gathered, self.sequence = capacity, gathered, first_sequence
        self.rests, self.held, self.out = defaultdict(list), 0, []

    def _piece(self, doc, ids, total, start, length, offset):
        part = memoryview(ids)[4 * start:4 * (start + length)]
        self.out.append((doc, start, length, zlib.crc32(part), total, self.sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self._piece(doc, ids, total, start, self.capacity, 0)
            self.sequence += 1
        if total > whole:
            # Only the remainder's bytes are held; the document is let go.
            self.rests[total - whole].append((doc, ids[4 * whole:], total, whole))
            self.held += 1
            if self.held >= self.gathered:
                self.pack(self.gathered // 8)

    def _place(self, rest, start, length, offset):
        doc, ids, total, whole = rest
        part = memoryview(ids)[4 * start:4 * (start + length)]
        self.out.append((doc, whole + start, length, zlib.crc32(part), total, self.sequence, offset))

    def pack(self, keep: int) -> None:
        """Fill sequences until few remainders are left. At the end (``keep`` 0) the rest of
        under four windows is cut into whole windows and sequences of powers of two, which
        need no padding."""
        counts = {n: len(r) for n, r in self.rests.items()}
        words = sum(n * c for n, c in counts.items())
        while self.held > keep and words >= (1 if keep else 4) * self.capacity:
            offset = 0
            for n, k in fullest(counts, self.capacity).items():
                for _ in range(k):
                    self._place(self.rests[n].pop(), 0, n, offset)
                    offset += n
                counts[n] -= k
                if not counts[n]:
                    del counts[n], self.rests[n]
                self.held -= k
            words -= offset
            self.sequence += 1
        if keep or not words:
            return
        rests = [r for n in sorted(self.rests, reverse=True) for r in self.rests[n]]
        self.rests.clear()
        self.held, at, used = 0, 0, 0
        for size in [self.capacity] * (words // self.capacity) + _powers(words % self.capacity):
            offset = 0
            while offset < size:
                left = len(rests[at][1]) // 4 - used
                n = min(left, size - offset)
                self._place(rests[at], used, n, offset)
                offset, used = offset + n, used + n
                if n == left:
                    at, used = at + 1, 0
            self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[] for _ in _ARROW]
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                   vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048,
                   gathered: int = 4096) -> DataFrame:
    """One row per piece: where ids ``start`` to ``start + length`` of a document lie.

    Each scan task packs its own documents, so no text and no id is shuffled; it holds
    ``gathered`` remainders of under ``capacity`` ids each. Sequences are numbered by task.
    A task pads only what its bins lack, and ends in sequences of powers of two.

    A null or empty text is one piece with the end id. Null ids and repeated rows are packed
    like others; an empty table gives no rows. Other columns are not read.
    """
    prepare_workers(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary).encode, end_id.to_bytes(4, "little")
        packer = _Packer(capacity, gathered, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, encode(text.as_py()) + end)
            yield packer.batch()
        packer.pack(0)
        yield packer.batch()

    rows = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return rows.mapInArrow(run, PIECES)
