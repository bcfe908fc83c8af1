"""Which of very many hashes occur at least twice, and where.

Used where a job makes far more hashes than rows: a row per hash would cost
several times its bytes in the shuffle.  Tasks work in lots.  Inside a lot,
hashes that occur twice are known to be shared and leave at once, as packed
(hash, owner) pairs dealt round; of every hash one entry goes to the packed
block of its bucket.  A bucket's reader sorts its entries and reports those
whose hash came from more than one lot.  So however many owners share a hash,
a reader holds at most one entry a lot for it, and the number of buckets
follows the expected number of hashes.

An entry is a 64-bit hash with a 16-bit check, both of which must agree, and
an owner; blocks name their owners once, and checks that are all zero not at
all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from .byte_hash import mix
from .common import arrow_batch, arrow_schema, tidied

BLOCKS = "part int, known int, hashes binary, checks binary, owners binary, names binary"
SHARED = "hash long, owner long"
LOT = 300_000
PER_BUCKET = 1_000_000


def bucket_count(spark, expected: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / PER_BUCKET))


def _block(part: int, known: int, hashes, checks, owners):
    names, index = np.unique(owners, return_inverse=True)
    return (part, known, hashes.tobytes(), checks.tobytes() if checks.any() else b"", index.astype("<u4" if len(names) > 65535 else "<u2").tobytes(),
            names.tobytes())


def _first_turn() -> int:
    """Where a task's known blocks begin in the round of buckets: tasks differ, so a
    bucket isn't given the first block of all of them."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return int(mix(np.array([task.partitionId() + 1 if task else 0], np.uint64))[0] >> np.uint64(16))


def blocks(lots, buckets: int):
    """Arrow batches of ``BLOCKS`` from lots of (hash uint64, check uint16, owner int64) arrays; an
    entry that stands twice in a lot for one owner is one that occurs twice there."""
    schema, turn = arrow_schema(BLOCKS), _first_turn()
    for hashes, checks, owners in lots:
        order = np.lexsort((owners, checks, hashes))
        hashes, checks, owners = hashes[order], checks[order], owners[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(hashes)))
        several = np.repeat(size > 1, size)
        rows = []
        if several.any():
            rows.append(_block(turn % buckets, 1, hashes[several], checks[several], owners[several]))
            turn += 1
        # one entry a hash; the owner -1 says that its owners are known already
        hashes, checks, owners = hashes[begin], checks[begin], np.where(size > 1, -1, owners[begin])
        part = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = order[edges[b]:edges[b + 1]]
            if len(at):
                rows.append(_block(b, 0, hashes[at], checks[at], owners[at]))
        if rows:
            yield arrow_batch(zip(*rows), schema)


def _read(row):
    _, _, hashes, checks, owners, names = (x.as_py() for x in row)
    names = np.frombuffer(names, np.int64)
    index = np.frombuffer(owners, "<u4" if len(names) > 65535 else "<u2")
    hashes = np.frombuffer(hashes, np.uint64)
    return hashes, np.frombuffer(checks, np.uint16) if checks else np.zeros(len(hashes), np.uint16), names[index]


def _shared(batches):
    schema, held = arrow_schema(SHARED), []

    def out(hashes, owners):
        for i in range(0, len(hashes), 200_000):
            yield arrow_batch([hashes[i:i + 200_000].view(np.int64), owners[i:i + 200_000]], schema)

    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i] for c in batch.columns]
            hashes, checks, owners = _read(row)
            if row[1].as_py():
                yield from out(hashes, owners)
            else:
                held.append((hashes, checks, owners))
    if not held:
        return
    hashes, checks, owners = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((checks, hashes))
    hashes, checks, owners = hashes[order], checks[order], owners[order]
    same = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    twice = np.zeros(len(hashes), bool)
    twice[1:] = same
    twice[:-1] |= same
    twice &= owners != -1
    yield from out(hashes[twice], owners[twice])


def shared(packed: DataFrame, buckets: int) -> DataFrame:
    """``(hash, owner)`` of each hash that occurs at least twice; a pair may stand repeatedly."""
    return packed.repartition(buckets, "part").mapInArrow(tidied(_shared), SHARED)
