"""Operator 8, nearest neighbours by randomly rotated one-bit codes.

Index: k-means centres are fitted on a bounded sample (``SAMPLE`` vectors, the
smallest by hash); every vector goes to its nearest centre's cell and is coded
there: residual to the centre, normalised, turned by one random rotation, one
sign bit a dimension, packed, with two correction scalars (the residual's
length and the inner product of code and residual).

Search: a query scans the ``PROBE_SHARE`` nearest of the cells (more where they
hold few vectors).  The packed bits estimate its inner products with all their
vectors, and the scalars turn them into squared distances with an error bound
of ``EPSILON`` standard deviations.  Vectors whose lower bound is at most the
k-th smallest upper bound of the block are reranked with exact double-precision
distances, so ties and copies are ordered exactly.  The best of every block
meet per query.

Scale: small cells share a block and large ones are cut into blocks of about
``BLOCK`` rows by their counts, so a vector that a third of all rows repeat
fills several blocks.  Queries visit the blocks of their cells: rows are dealt
by block and sorted so that a block's vectors come before its queries, which
then stream past them; the index is shuffled once, whatever the number of
queries.  No side is broadcast; the centres (``MOST_CELLS`` at most) travel
with the tasks.

Defined results: null, empty or zero vectors, those with null or non-finite
components, those without vec_id and those whose length is not the most
frequent one take no part; every row whose vec_id ``every`` divides is a query
of its own, also where several rows share a vec_id, and only that row is no
candidate for it; repeated rows are candidates each (equal queries are searched
once and answered as often as they stand); an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, shipped, tidied, written

K = 10
EVERY = 100
SAMPLE = 20_000
MOST_CELLS = 1024
PROBE_SHARE = 0.9
EPSILON = 2.5
BLOCK = 16_000
SEED = 11


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's k-means from a random start; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_cells(sample, centres, 1)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres ** 2).sum(1)[None, :] - 2 * vectors @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centres: np.ndarray, cell: np.ndarray, turn: np.ndarray):
    """Packed sign bits, residual lengths and code inner products."""
    rest = vectors - centres[cell]
    length = np.sqrt((rest ** 2).sum(1))
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / math.sqrt(vectors.shape[1])


def probed(queries: np.ndarray, centres: np.ndarray, counts: np.ndarray, share: float, k: int) -> np.ndarray:
    """Which cells each query scans (queries by cells)."""
    near = nearest_cells(queries, centres, len(centres))
    enough = np.cumsum(counts[near], axis=1) - counts[near] < min(4 * k, counts.sum())
    enough[:, :math.ceil(share * len(centres))] = True
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, near, enough, axis=1)
    return out & (counts > 0)


def bounds(bits, length, inner, cell, queries, centres, turn, epsilon: float):
    """Lower and upper bounds of squared distances, vectors by queries, from codes alone."""
    dim = len(turn)
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    # <code, turned (query - centre)> for each vector's own centre
    product = signs @ (queries @ turn.T).T.astype(np.float32)
    product = product - (signs * (centres @ turn.T).astype(np.float32)[cell]).sum(1)[:, None]
    size = ((queries ** 2).sum(1)[None, :] - 2 * centres @ queries.T + (centres ** 2).sum(1)[:, None]).clip(0)[cell]
    inner = np.maximum(inner, 1e-9)[:, None]
    middle = (length ** 2)[:, None] + size - 2 * length[:, None] * product / inner
    error = 2 * length[:, None] * np.sqrt(size) * (
        epsilon * np.sqrt(np.maximum(1 - inner ** 2, 0)) / inner / math.sqrt(max(dim - 1, 1)))
    error += 1e-5 * ((length ** 2)[:, None] + size)  # single-precision products
    return middle - error, middle + error


def search_block(rows, ids, vectors, cell, bits, length, inner, centres, counts, turn, query_rows, queries, k: int = K,
                 share: float = PROBE_SHARE, epsilon: float = EPSILON):
    """(query row, vec_id, distance) of the k nearest of one block per query, ties to smaller ids."""
    out = []
    step = max(1, 2_000_000 // max(len(ids), 1))
    for i in range(0, len(query_rows), step):
        q_rows, q = query_rows[i:i + step], queries[i:i + step]
        low, high = bounds(bits, length, inner, cell, q, centres, turn, epsilon)
        out_of_reach = (rows[:, None] == q_rows[None, :]) | ~probed(q, centres, counts, share, k)[:, cell].T
        high[out_of_reach] = np.inf
        reach = np.partition(high, k - 1, axis=0)[k - 1] if len(ids) > k else np.full(len(q_rows), np.inf)
        at, which = np.nonzero((low <= reach[None, :]) & ~out_of_reach)
        score = np.empty(len(at))
        for j in range(0, len(at), 100_000):
            part = vectors[at[j:j + 100_000]] - q[which[j:j + 100_000]]
            score[j:j + 100_000] = np.sqrt((part * part).sum(1))
        order = np.lexsort((ids[at], score, which))
        at, which, score = at[order], which[order], score[order]
        first = np.searchsorted(which, np.arange(len(q_rows)))
        best = np.arange(len(which)) - first[which] < k
        out.append((q_rows[which[best]], ids[at[best]], score[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def lay_out(counts: np.ndarray, rows: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // rows)), 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > rows:
            block, held = block + 1, 0
        first[cell] = block
        if parts[cell] > 1:
            block, held = block + parts[cell], 0
        else:
            held += n
    return first, parts


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a double matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


#: a block's vectors (kind 0) and the queries that visit it (kind 1, without code)
_DEALT = ("block int, kind int, row long, vec_id long, v array<double>, cell int, bits binary, length double, inner double")
_FOUND = "row long, vec_id long, score double"


def _dealt_schema():
    import pyarrow as pa

    return pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()),
                      ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("bits", pa.binary()),
                      ("length", pa.float64()), ("inner", pa.float64())])


def _index(centres, turn, first, parts):
    def run(batches):
        schema = _dealt_schema()
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, salt = _matrix(batch.column("v")), batch.column("salt").to_numpy()
            cell = nearest_cells(vectors, centres, 1)[:, 0]
            bits, length, inner = encode(vectors, centres, cell, turn)
            yield arrow_batch([first[cell] + salt % parts[cell], np.zeros(len(cell)), batch.column("row"), batch.column("vec_id"),
                               batch.column("v"), cell, [b.tobytes() for b in bits], length, inner], schema)

    return run


def _cells_of(centres):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                n = np.bincount(nearest_cells(_matrix(batch.column(0)), centres, 1)[:, 0], minlength=len(centres))
                yield arrow_batch([np.arange(len(n)), n], pa.schema([("cell", pa.int32()), ("n", pa.int64())]))

    return run


def _visits(centres, counts, first, parts, share, k):
    def run(batches):
        schema = _dealt_schema()
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column("row").to_numpy(), _matrix(batch.column("v"))
            rows = []
            for i, cells in enumerate(probed(vectors, centres, counts, share, k)):
                of = {int(first[c]) + j for c in np.flatnonzero(cells) for j in range(parts[c])}
                rows += [(b, 1, int(own[i]), None, vectors[i], None, None, None, None) for b in sorted(of)]
                if len(rows) >= 5_000:
                    yield arrow_batch(zip(*rows), schema)
                    rows = []
            if rows:
                yield arrow_batch(zip(*rows), schema)

    return run


def _search(centres, counts, turn, k, share, epsilon):
    """Queries against their block's vectors; rows are sorted by block and kind."""
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        held, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
                part = batch.slice(i, j - i)
                if block[i] != held:
                    held, parts, index = block[i], [], None
                if kind[i] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if index is None:
                    own = {n: pa.concat_arrays([p.column(n) for p in parts]) for n in parts[0].schema.names}
                    bits = np.frombuffer(b"".join(own["bits"].to_pylist()), np.uint8).reshape(len(own["bits"]), -1)
                    index = (own["row"].to_numpy(), own["vec_id"].to_numpy(), _matrix(own["v"]), own["cell"].to_numpy(), bits,
                             own["length"].to_numpy(), own["inner"].to_numpy())
                found = search_block(*index, centres, counts, turn, part.column("row").to_numpy(), _matrix(part.column("v")),
                                     k, share, epsilon)
                yield arrow_batch(found, schema)

    return run


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (top["d"] if top else 0))


def neighbours(rows: DataFrame, k: int = K, every: int = EVERY, share: float = PROBE_SHARE,
               epsilon: float = EPSILON) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id ``every`` divides."""
    spark = shipped(rows.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = written(valid_vectors(rows).withColumn("salt", F.abs(F.xxhash64("vec_id", "v") % 1_000_003))
                    .withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = valid.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = np.array([r[0] for r in valid.orderBy(F.xxhash64("v", "vec_id")).limit(SAMPLE).select("v").collect()])
    centres = fit_centres(sample, max(1, min(MOST_CELLS, round(math.sqrt(total) / 4))))
    turn = rotation(centres.shape[1])
    counts = np.zeros(len(centres), np.int64)  # one number a cell
    for cell, n in valid.select("v").mapInArrow(_cells_of(centres), "cell int, n long").groupBy("cell").agg(
            F.sum("n")).collect():
        counts[cell] = n
    first, parts = lay_out(counts)
    # equal query rows have equal answers: each finds the others at distance 0
    queries = written(valid.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "queries")
    index = valid.mapInArrow(tidied(_index(centres, turn, first, parts)), _DEALT)
    visits = queries.select("row", "v").mapInArrow(tidied(_visits(centres, counts, first, parts, share, k)), _DEALT)
    found = index.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        tidied(_search(centres, counts, turn, k, share, epsilon)), _FOUND)
    best = F.row_number().over(W.partitionBy("row").orderBy("score", "vec_id"))
    answers = found.withColumn("rank", best).where(F.col("rank") <= k)
    asked = queries.select("row", F.col("vec_id").alias("query_id"), F.expr("explode(sequence(1L, copies))").alias("copy"))
    return answers.join(asked, "row").select("query_id", "rank", "vec_id", "score")
