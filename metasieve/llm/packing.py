"""Sum-of-squares online packing of documents into training windows.

Each task packs its own documents as they come. A document longer than a window
first fills whole windows; what is left goes to the fill level (or to a new
window) that makes the sum of squared counts of partially filled windows least,
with the counts kept in an array by level. When too many windows are open, and
at the end, the emptiest ones are cut up to fill the fullest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts_to_python, trimmed
from .text_codec import ChunkCoder


class Packer:
    """Packs the pieces of one task; :meth:`add` and :meth:`finish` yield closed windows.

    A piece is ``(doc, start, ids)``, where ``ids`` holds 4 bytes a token and
    ``doc`` is whatever the caller wants back; a window is a list of pieces.
    """

    def __init__(self, capacity: int, most_open: int = 512):
        self.capacity, self.most_open = capacity, most_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def add(self, doc, ids: bytes) -> Iterator[list]:
        size, step, at = len(ids) // 4, self.capacity, 0
        while size - at >= step:
            yield [(doc, at, ids[4 * at : 4 * (at + step)])]
            at += step
        if at < size:
            yield from self._place((doc, at, ids[4 * at :]), size - at)
            if self.n_open > self.most_open:
                yield from self._merge(self.most_open // 2)

    def _place(self, piece: tuple, size: int) -> Iterator[list]:
        """Puts a piece where the squares grow least; of equals, into the fullest window."""
        n, room = self.counts, self.capacity - size
        used = n[: room + 1] > 0
        used[0] = True
        # from level h to h + size the squares grow by 2 (n[h + size] - n[h]) + 2
        grow = 2 * n[size:] + 2
        grow[1:] -= 2 * n[1 : room + 1]
        # a window that is new lowers no count, one that gets full raises none
        grow[0] = 2 * n[size] + 1
        grow[room] = 1 - 2 * n[room]
        cost = np.where(used, grow, np.iinfo(np.int64).max)
        level = room - int(np.argmin(cost[::-1]))
        if level:
            window = self.open[level].pop()
            n[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        self._put(window, level + size)
        if level + size == self.capacity:
            yield window

    def _put(self, window: list, level: int) -> None:
        if level < self.capacity:
            self.open[level].append(window)
            self.counts[level] += 1
            self.n_open += 1

    def _merge(self, most: int) -> Iterator[list]:
        """Cuts up the emptiest windows to fill the fullest, until ``most`` are open."""
        levels = sorted(((h, w) for h, ws in self.open.items() for w in ws), key=lambda x: x[0])
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        lo, hi = 0, len(levels) - 1
        fills, windows = [h for h, _ in levels], [w for _, w in levels]
        while lo < hi and hi - lo + 1 > most:
            doc, start, ids = windows[lo].pop()
            room, size = self.capacity - fills[hi], len(ids) // 4
            take = min(room, size)
            if take < size:
                windows[lo].append((doc, start, ids[: 4 * (size - take)]))
            windows[hi].append((doc, start + size - take, ids[4 * (size - take) :]))
            fills[lo] -= take
            fills[hi] += take
            if fills[hi] == self.capacity:
                yield windows[hi]
                hi -= 1
            if not fills[lo]:
                lo += 1
        for i in range(lo, hi + 1):
            self._put(windows[i], fills[i])

    def finish(self) -> Iterator[list]:
        """Merges until one window at most is not full, then closes it."""
        yield from self._merge(1)
        for windows in self.open.values():
            yield from windows
        self.open.clear()


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packing(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, packer = ChunkCoder(path, ids=True), Packer(capacity)
        sequence = TaskContext.get().partitionId() << 36
        rows, held, id_type = [], 0, pa.int64()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def take(windows: Iterator[list]) -> None:
            nonlocal sequence, held
            for window in windows:
                at = 0
                for (doc, total), start, ids in window:
                    n = len(ids) // 4
                    rows.append((doc, start, n, ids, total, sequence, at))
                    at += n
                held += 4 * at
                sequence += 1

        for b in batches:
            id_type = b.schema.field(0).type
            keys = b.column(0).to_pylist()
            for key, ids in zip(keys, c.encode([t.as_py() or "" for t in b.column(1)]), strict=True):
                ids += end
                take(packer.add((key, len(ids) // 4), ids))
                if held > 4 << 20:
                    yield flush()
                    rows, held = [], 0
        take(packer.finish())
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its text's ids (null or empty: none) followed by ``end_id``.
    Returns its pieces: ``id_col, start, length, ids`` (4 bytes a token, little
    endian), ``doc_tokens, sequence_id, offset``. Every token lies in one piece,
    the offsets of a sequence have no gap, and in each task all sequences but
    one are full. Rows with null or repeated ids are documents of their own.
    Other columns are not read; an empty table gives an empty one.

    There is no shuffle: a task packs the rows that it scans and numbers its
    sequences within its partition, so a repeated task gives the same rows. A
    task holds 512 open windows at most, whatever the lengths.
    """
    texts_to_python(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(_packing(tokenizer_path, capacity, end_id)), f"id {id_type}, {PIECES}").withColumnRenamed("id", id_col)
