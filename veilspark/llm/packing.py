"""Operator 1, packing: bounded-space online best fit.

Every partition of the input is packed on its own, in one pass, with a fixed
number of open windows.  A document is tokenised, ended by ``end_id`` and cut
at the window size; its full windows leave at once and the remainder goes to
the open window that it fits best (least free space left).  When none fits, a
window is opened; when all are open already, the fullest is emitted to make
room.  What is open at the end of a partition is written with its ids, and
the leftovers of ``merge_partitions`` partitions are merged: their pieces are
laid one after the other and cut at the window size, so that a merge group
has one short sequence at most.

Memory: ``open_windows`` windows a task, ``merge_partitions * open_windows``
windows a merge group, whatever the input.  The pieces of the first pass are
written to a table before they are read twice (emitted pieces, leftovers), so
that a replayed task can't pack differently for the two readers.

Defined results: a null text counts as empty, an empty text is the single
``end_id``; null or repeated doc_ids are packed like any others; an empty
table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, shipped, tidied, written
from .tokens import ChunkTokenizer

WINDOW = 2048
OPEN_WINDOWS = 128
MERGE_PARTITIONS = 16
END_ID = 1
#: sequence ids of merged leftovers start here; others are partition << 32 | number
MERGED = 1 << 62

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


class OpenWindows:
    """The open windows of one partition, sorted by free space."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # (free tokens, window number)
        self.content: dict[int, list] = {}
        self.numbers = 0

    def new(self) -> int:
        self.numbers += 1
        return self.numbers - 1

    def place(self, piece, size: int):
        """Put a piece of ``size`` tokens; yields windows that leave as (number, pieces)."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, number = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                yield fullest, self.content.pop(fullest)
            free, number = self.window, self.new()
            self.content[number] = []
        self.content[number].append((piece, size))
        if free == size:
            yield number, self.content.pop(number)
        else:
            insort(self.free, (free - size, number))

    def rest(self):
        for _, number in sorted(self.free, key=lambda x: x[1]):
            yield number, self.content[number]


def _pack_partition(tokenizer_path: str, window: int, most: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        schema = arrow_schema(PIECES)
        base = TaskContext.get().partitionId() << 32
        encode = ChunkTokenizer.shared(tokenizer_path).encode_batch
        end = end_id.to_bytes(4, "little")
        opened = OpenWindows(window, most)
        out: list[tuple] = []

        def emit(number: int, pieces: list, keep: bool) -> None:
            offset = 0
            for (doc_id, start, raw, total), size in pieces:
                out.append((doc_id, start, size, zlib.crc32(raw), total, base | number, offset, raw if keep else None))
                offset += size

        def flush():
            batch = arrow_batch(zip(*out), schema)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    size = min(window, total - start)
                    piece = (doc_id, start, raw[4 * start:4 * (start + size)], total)
                    if size == window:
                        emit(opened.new(), [(piece, size)], False)
                    else:
                        for number, pieces in opened.place(piece, size):
                            emit(number, pieces, False)
                if len(out) >= 20_000:
                    yield flush()
            if out:
                yield flush()
        for number, pieces in opened.rest():
            emit(number, pieces, True)
        if out:
            yield flush()

    return run


def _merge_group(window: int):
    def run(key, pdf):
        import pandas as pd

        group = key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])
        rows, number, used = [], 0, 0
        pdf = pdf.sort_values(["sequence_id", "offset"], kind="stable")
        for doc_id, start, raw, total in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"]):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            at, size = 0, len(raw) // 4
            while at < size:
                take = min(size - at, window - used)
                part = raw[4 * at:4 * (at + take)]
                rows.append((doc_id, start + at, take, zlib.crc32(part), total, MERGED | group << 32 | number, used))
                at, used = at + take, used + take
                if used == window:
                    number, used = number + 1, 0
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         merge_partitions: int = MERGE_PARTITIONS, end_id: int = END_ID) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of
    sequences of at most ``window`` tokens; each token of each document is in one piece."""
    shipped(docs.sparkSession)
    first = written(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            tidied(_pack_partition(tokenizer_path, window, open_windows, end_id)), PIECES),
        "pack")
    done = first.where("ids IS NULL").drop("ids")
    group = F.shiftright("sequence_id", 32).cast("long")
    merged = (
        first.where("ids IS NOT NULL")
        .withColumn("merge_group", F.floor(group / merge_partitions).cast("long"))
        .groupBy("merge_group")
        .applyInPandas(_merge_group(window), PIECES.rpartition(",")[0])
    )
    return done.unionByName(merged)
