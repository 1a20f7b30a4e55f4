"""Packing into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; what remains is placed, longest piece first, into the open
window whose free room is the tightest that still holds it.  A segment tree indexed by free room finds that
window in O(log window).  Every scan task packs what it reads in bounded rounds and carries windows that still
have room into the next round, so nothing is shuffled, no key is hot, and padding remains only in the few
windows that are open when a task ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, ship, tidied
from .vocab import Codec, VocabFile

ship(__name__)

#: Pieces that a packing round holds before it closes full windows.
ROUND_PIECES = 8192
#: Tokens that a packing round holds at most (4 bytes each), besides one document.
ROUND_TOKENS = 3_000_000
#: A window with this free room or less is closed at a round's end; others are packed again.
CLOSE_ROOM = 8


class RoomTree:
    """Open windows by free room 0..size: a segment tree over the rooms whose leaves are stacks of windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        k = room + self.leaves
        while k:
            self.held[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of need or more."""
        k = need + self.leaves
        if not self.held[k]:
            while k > 1 and (k & 1 or not self.held[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.held[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            self.held[k] -= 1
            k >>= 1
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[tuple[int, int]], list[int]]:
    """For each length its (window, offset), and the free room of each window.  Equal lengths keep their order."""
    tree, rooms = RoomTree(size), []
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.take(n)
        room, window = found if found else (size, len(rooms))
        if not found:
            rooms.append(size)
        placed[i] = (window, size - room)
        rooms[window] = room - n
        if room - n:
            tree.add(room - n, window)
    return placed, rooms


def pack(docs: DataFrame, vocab_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows, also with the same id, are packed each.  Further
    columns are left out; an empty table gives no rows; a null id stays null.  sequence_id holds the task's
    number in the upper and a running number in the lower 32 bits: equal input splits give equal results, also
    when a lost task runs again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(VocabFile.load(vocab_path).plain())  # bounded by the file
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        codec = Codec.of(VocabFile(*sent.value))
        base, given = TaskContext.get().partitionId() << 32, 0
        types = None
        full: list[tuple] = []  # whole windows
        parts: list[tuple] = []  # pieces that wait for a window
        tokens = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [types, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=columns)

        def close(last: bool) -> tuple[list[tuple], list[tuple]]:
            nonlocal given
            rows = []
            for piece in full:
                rows.append((*piece, base + given, 0))
                given += 1
            placed, rooms = best_fit_decreasing([p[2] for p in parts], window)
            name: dict[int, int] = {}
            stay = []
            for piece, (w, offset) in zip(parts, placed):
                if rooms[w] > CLOSE_ROOM and not last:
                    stay.append(piece)
                    continue
                if w not in name:
                    name[w] = base + given
                    given += 1
                rows.append((*piece, name[w], offset))
            return rows, stay

        for batch in batches:
            types = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                key = key.as_py()
                ids = np.append(codec.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for start in range(0, n, window):
                    piece = ids[start : start + window]
                    (full if len(piece) == window else parts).append((key, start, len(piece), piece.tobytes(), n))
                tokens += n
                if len(parts) >= ROUND_PIECES or tokens >= ROUND_TOKENS:
                    rows, parts = close(False)
                    full, tokens = [], sum(p[2] for p in parts)
                    for i in range(0, len(rows), 2000):
                        yield batch_of(rows[i : i + 2000])
                    if len(parts) >= ROUND_PIECES // 2 or tokens >= ROUND_TOKENS // 2:  # nothing fits: close what there is
                        rows, _ = close(True)
                        parts, tokens = [], 0
                        for i in range(0, len(rows), 2000):
                            yield batch_of(rows[i : i + 2000])
        if full or parts:
            rows, _ = close(True)
            for i in range(0, len(rows), 2000):
                yield batch_of(rows[i : i + 2000])

    return only(docs, id_col, text_col).mapInArrow(tidied(run, True), f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
