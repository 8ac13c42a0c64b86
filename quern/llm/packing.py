"""Packing into sequences of fixed length: bounded-space online best fit, then a merge of what is left open."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
#: Partitions whose open windows meet in one task of the merge: at most GROUP * open_windows * size ids.
GROUP = 16
#: Room that one partition's sequence numbers get.
STRIDE = 1 << 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Open windows of `size` ids. A piece is (document's key, its start there, its ids, the document's tokens)."""

    def __init__(self, size: int, open_windows: int, slack: int, first: int) -> None:
        self.size, self.most, self.slack, self.next = size, open_windows, slack, first
        self.windows: list[list] = []
        self.room: list[int] = []

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Places a document's ids; yields the windows (lists of pieces) that this closes.

        Whole windows are cut off a long document. The rest goes where it fits best. If it fits nowhere and no further
        window may open, the fullest one is emitted, topped up with the head of the rest where more than `slack` is free.
        """
        while len(ids):
            if len(ids) >= self.size:
                yield [(key, start, ids[: self.size], total)]
                start, ids = start + self.size, ids[self.size :]
                continue
            fits = [(room, i) for i, room in enumerate(self.room) if room >= len(ids)]
            if fits:
                i = min(fits)[1]
                self.windows[i].append((key, start, ids, total))
                self.room[i] -= len(ids)
                if self.room[i] <= self.slack:
                    yield self._close(i)
                return
            if len(self.windows) < self.most:
                self.windows.append([(key, start, ids, total)])
                self.room.append(self.size - len(ids))
                return
            i = int(np.argmin(self.room))
            if (room := self.room[i]) > self.slack:
                self.windows[i].append((key, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            yield self._close(i)

    def _close(self, i: int) -> list:
        self.room.pop(i)
        return self.windows.pop(i)

    def number(self) -> int:
        self.next += 1
        return self.next - 1


def _rows(window: list, number: int) -> Iterator[tuple]:
    offset = 0
    for key, start, ids, total in window:
        yield (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset)
        offset += len(ids)


def _halves(window: list) -> Iterator[list]:
    """Cuts a window's ids into runs whose lengths are powers of two, the longest first: such sequences need no padding."""
    left, held = sum(len(x[2]) for x in window), list(window)
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        run = []
        while need:
            key, start, ids, total = held.pop(0)
            if len(ids) > need:
                held.insert(0, (key, start + need, ids[need:], total))
                ids = ids[:need]
            run.append((key, start, ids, total))
            need -= len(ids)
        yield run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 2, vocabulary: str = VOCABULARY, open_windows: int = 32, slack: int = 8) -> DataFrame:
    """One row per piece (PIECE): where each run of a document's ids lies.

    A document's ids are its text's under `vocabulary`, then end_id; null and empty texts have end_id alone. Every row of
    docs is packed, repeated ones each for itself; a null doc_id stays null. No rows: no pieces. A sequence is full, or
    lacks up to `slack` ids, or has a power of two for its length. Each input partition keeps at most `open_windows`
    windows open; what is open at its end is merged with GROUP - 1 other partitions' in one small task. Sequence ids are
    unique, and a partition that runs again after a loss packs the same rows in the same way.
    """
    shape = f"{PIECE}, ids binary, part long"
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def frame(rows: list) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return found.astype({"doc_id": "Int64"})

    def online(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary)
        packer, end = Packer(size, open_windows, slack, part * STRIDE), np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([encode(value), end]) if value else end
                for window in packer.add(None if pd.isna(key) else int(key), 0, ids, len(ids)):
                    rows += _rows(window, packer.number())
            yield frame(rows).assign(ids=None, part=part)
        left = [(*row, piece[2].astype("<u4").tobytes()) for n, window in enumerate(packer.windows) for row, piece in zip(_rows(window, n), window, strict=True)]
        yield frame([x[:7] for x in left]).assign(ids=[x[7] for x in left], part=part)

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["part", "sequence_id", "offset"])
        packer = Packer(size, open_windows, slack, (key[0] + 1) * -STRIDE)
        pieces = [(None if pd.isna(a) else int(a), int(b), np.frombuffer(c, "<u4"), int(d)) for a, b, c, d in zip(left["doc_id"], left["start"], left["ids"], left["doc_tokens"], strict=True)]
        rows: list[tuple] = []
        for piece in sorted(pieces, key=lambda x: -len(x[2])):
            for window in packer.add(*piece):
                rows += _rows(window, packer.number())
        windows, packer.windows, packer.room = packer.windows, [], []
        for piece in [x for window in windows for x in window]:  # the last open ones are filled to the brim in turn
            while len(piece[2]):
                if not packer.windows:
                    packer.windows, packer.room = [[]], [size]
                head = piece[2][: packer.room[0]]
                packer.windows[0].append((piece[0], piece[1], head, piece[3]))
                packer.room[0] -= len(head)
                piece = (piece[0], piece[1] + len(head), piece[2][len(head) :], piece[3])
                if not packer.room[0]:
                    rows += _rows(packer._close(0), packer.number())
        for window in packer.windows:
            for run in _halves(window):
                rows += _rows(run, packer.number())
        return frame(rows)

    placed = written(table.mapInPandas(online, shape), "pack")
    names = [x.split()[0] for x in PIECE.split(", ")]
    left = placed.where(F.col("ids").isNotNull()).withColumn("team", F.floor(F.col("part") / GROUP))
    return placed.where(F.col("ids").isNull()).select(names).unionByName(left.groupBy("team").applyInPandas(merge, PIECE))
