"""Sum-of-squares online packing of token ids into windows (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006).

A level array counts the partially filled windows of each fill level. A document joins the window at the level that
makes the sum of the squared counts smallest, or opens a new one. What exceeds a window is cut off in whole windows
first. Each task packs the documents that it reads, as they come: no shuffle, and no state but its open windows. When
those are too many, and at the end of the task, their pieces are strung together and cut into full windows; the tail of
the last one becomes windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import trimmed
from loomwright.llm.tokens import END, codec, crc_of

WINDOW = 4096
#: Open windows of a task: what bounds its memory.
OPEN = 2048
Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class SumOfSquares:
    """place() and flush() return the windows that are done, each a list of pieces."""

    def __init__(self, size: int = WINDOW, most_open: int = OPEN):
        self.size, self.most_open = size, most_open
        self.clear()

    def clear(self) -> None:
        self.counts = np.zeros(self.size + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.size)]
        self.open = 0

    def level_for(self, n: int) -> int:
        """The fill level for a piece of n ids: 0 is a new window. Of equal levels the fullest."""
        last = self.size - n
        before, after = self.counts[1 : last + 1], self.counts[n + 1 : self.size + 1]
        change = 2 * (after - before) + 2
        if last >= 1:
            change[-1] = 1 - 2 * before[-1]  # the window is full and counts no longer
            change[before == 0] = np.iinfo(np.int64).max
            best = last - 1 - int(np.argmin(change[::-1]))
            if change[best] < 2 * self.counts[n] + 1:
                return best + 1
        return 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        doc_id, start, ids, total = piece
        whole = len(ids) - len(ids) % self.size
        done = [[(doc_id, start + at, ids[at : at + self.size], total)] for at in range(0, whole, self.size)]
        ids, start, n = ids[whole:], start + whole, len(ids) - whole
        if not n:
            return done
        level = self.level_for(n)
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            window = []
        window.append((doc_id, start, ids, total))
        if level + n == self.size:
            return [*done, window]
        self.windows[level + n].append(window)
        self.counts[level + n] += 1
        self.open += 1
        return done + (self.strung() if self.open > self.most_open else [])

    def strung(self, last: bool = False) -> list[list[Piece]]:
        """All open windows' pieces, cut into full windows; the rest stays open, or ends in powers of two."""
        pieces = [p for level in self.windows for window in level for p in window]
        self.clear()
        left = sum(len(p[2]) for p in pieces)
        done, window, room = [], [], 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size or not last else 1 << (left.bit_length() - 1)
                    window = []
                    done.append(window)
                n = min(room, len(ids))
                window.append((doc_id, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
        if room:
            self.windows[self.size - room].append(done.pop())
            self.counts[self.size - room] = self.open = 1
        return done


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, size: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document of docs in windows of `size` ids; with_ids adds the ids, as array<int>.

    A null or empty text is the end id alone. Rows that repeat are documents of their own; a null doc_id stays null.
    Other columns are not read. An empty table gives an empty result. Sequence numbers are unique, not consecutive.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = SumOfSquares(size), TaskContext.get().partitionId() << 33
        columns: list[list] = [[] for _ in range(8)]

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in columns[:7]] + [pa.array(columns[7], pa.list_(pa.int32()))] * with_ids
            for x in columns:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        def put(windows: list[list[Piece]]) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for doc_id, start, ids, total in window:
                    row = (doc_id, start, len(ids), crc_of(ids), total, number, offset, ids)
                    for column, value in zip(columns[: 7 + with_ids], row[: 7 + with_ids], strict=True):
                        column.append(value)
                    offset += len(ids)
                number += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), codec(tokenizer).encode(part.column(1).to_pylist(), end), strict=True):
                    put(packer.place((doc_id, 0, ids, len(ids))))
                if len(columns[0]) > 20_000 or with_ids:
                    yield batch_of()
        put(packer.strung(last=True))
        yield batch_of()
        trimmed()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(over, SCHEMA + ", ids array<int>" * with_ids)
