"""Operator 11, cross-tokenizer alignment at white-space anchors.

Every text is tokenised in full by two public tokenizers, A on space + text
and B on the text (it adds that space).  Anchors cut the two token rows into
windows whose alignments are memoised by their id tuples (``token_windows``).
Inside a window, offsets where tokens of both sides end cut groups; the tokens
of a group are linked, all of A's with all of B's.  How many documents link an
id pair is counted over the corpus, and each document is told how often its
links are their A id's most common one.

Plan: tasks cut their documents into lots of about ``lot_bytes`` of text.  A
document leaves as a packed list of its windows, a lot as one row with its
distinct id pairs, their numbers of documents and the pairs of each window.
Counts are joined to the lots' distinct pairs, not to documents, and go back
to their lot, where the documents' sums are taken in one streamed pass.  A
very common pair stands once in each lot, whatever the number of its links.
Nothing is broadcast but the vocabularies' paths, which every executor must
hold.

Defined results: null or empty texts, and texts that either side doesn't
spell byte for byte, have no tokens: zeros and an empty digest.  Documents
with equal ids are aligned and counted row by row; null ids are kept; a very
long text is one document of its lot; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, shipped, tidied, written
from .words import text_slices

LOT_BYTES = 24_000_000

#: kind 0 holds a pair's count, kind 1 a lot, kind 2 a document
LAID = ("lot long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "windows binary, numbers binary, flat binary, pairs array<long>, docs array<long>")
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _packed(values) -> bytes:
    """Whole numbers as bytes, in one byte each where they fit."""
    import numpy as np

    values = np.asarray(values)
    return values.astype(np.uint8 if len(values) and values.max() < 256 else "<u4").tobytes()


def _unpacked(data: bytes, n: int):
    import numpy as np

    return np.frombuffer(data, np.uint8 if len(data) == n else "<u4")


class _Lot:
    """What a lot knows of its windows and pairs so far."""

    def __init__(self, windows):
        self.windows = windows
        self.bytes = 0
        self.used, self.pairs, self.docs = [], [], []

    def _pairs_of(self, window):
        from .token_windows import ranges

        ends = self.windows.ends
        sizes = ends[window + 1] - ends[window]
        return sizes, self.windows.pairs[ranges(sizes) + ends[window].repeat(sizes)]

    def add(self, of_doc, window):
        """Distinct (document, window) of some documents: count the documents of each pair."""
        import numpy as np

        sizes, pairs = self._pairs_of(window)
        held = np.unique(np.repeat(of_doc, sizes) << 32 | pairs) & 0xFFFFFFFF
        held.sort()
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        self.pairs.append(held[first])
        self.docs.append(np.diff(np.append(first, len(held))))
        self.used.append(np.unique(window))

    def row(self, lot: int):
        import numpy as np

        used = np.unique(np.concatenate(self.used))
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        docs = np.bincount(at, np.concatenate(self.docs)).astype(np.int64)
        sizes, own = self._pairs_of(used)
        return (lot, 1, *[None] * 7, used.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
                np.searchsorted(pairs, own).astype("<u4").tobytes(), pairs, docs)


def _aligner(ranks: str, model: str, lot_bytes: int, with_groups: bool):
    def align(batches):
        import numpy as np
        from pyspark import TaskContext

        from . import token_windows as tw

        schema = arrow_schema(LAID)
        tokenizers = tw.TwoTokenizers.shared(ranks, model)
        windows = tw.Windows(tokenizers)
        first = TaskContext.get().partitionId() << 32
        number, lot = 0, _Lot(windows)

        for part in text_slices(batches, "text", min(2_000_000, lot_bytes)):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            encoded = tokenizers.encode(texts)
            found = [i for i, e in enumerate(encoded) if e]
            rows = [(first | number, 2, d, 0, 0, 0, 0, "", "" if with_groups else None, *[None] * 5)
                    for d, e in zip(ids, encoded) if not e]
            if found:
                keys, counts = tw.cut_windows([encoded[i] for i in found], tokenizers)
                windows.learn(keys)
                window = np.fromiter(map(windows.__getitem__, keys), np.int64, len(keys))
                of = np.repeat(np.arange(len(found)), counts)
                distinct, times = np.unique(of << 32 | window, return_counts=True)
                of_doc, own = distinct >> 32, distinct & 0xFFFFFFFF
                lot.add(of_doc, own)
                edges = np.searchsorted(of_doc, np.arange(len(found) + 1)).tolist()
                starts = np.cumsum(counts) - counts
                groups, links = (np.add.reduceat(x[window], starts).tolist() for x in (windows.groups, windows.links))
                text_of, begun = list(map(windows.text.__getitem__, window.tolist())), 0
                for k, i in enumerate(found):
                    text = "".join(text_of[begun:begun + counts[k]])[:-1]
                    begun += counts[k]
                    a, b = encoded[i]
                    rows.append((first | number, 2, ids[i], len(a) // 2, len(b) // 2, groups[k], links[k],
                                 hashlib.sha256(text.encode()).hexdigest(), text if with_groups else None,
                                 own[edges[k]:edges[k + 1]].astype("<u4").tobytes(), _packed(times[edges[k]:edges[k + 1]]),
                                 None, None, None))
            lot.bytes += part.column("text").nbytes
            if lot.bytes >= lot_bytes or len(windows) > tw.MOST_WINDOWS:
                if lot.used:
                    rows.append(lot.row(first | number))
                if len(windows) > tw.MOST_WINDOWS:
                    windows.forget()
                number, lot = number + 1, _Lot(windows)
            if rows:
                yield arrow_batch(zip(*rows), schema)
        if lot.used:
            yield arrow_batch(zip(lot.row(first | number)), schema)

    return tidied(align)


def _sums(batches):
    """Documents with the sums of their links' counts, from rows sorted by lot and kind."""
    import numpy as np
    import pyarrow as pa

    schema = arrow_schema(COUNTED)
    held, counts, best = None, [], []
    names = count = most = None
    for batch in batches:
        lots, kinds = batch.column("lot").to_numpy(), batch.column("kind").to_numpy()
        if not len(lots):
            continue
        change = np.flatnonzero((np.diff(lots) != 0) | (np.diff(kinds) != 0)) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), len(lots)]):
            part = batch.slice(i, j - i)
            if lots[i] != held:
                held, counts, best = lots[i], [], []
                names = count = most = np.zeros(0, np.int64)
            if kinds[i] == 0:
                at = part.column("at").to_numpy()
                counts.append((at, part.column("n").to_numpy()))
                best.append(part.column("best").to_numpy(zero_copy_only=False))
            elif kinds[i] == 1:
                at, n = (np.concatenate(x) for x in zip(*counts))
                per_pair, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                per_pair[at], is_best[at] = n, np.concatenate(best)
                flat = np.frombuffer(part.column("flat")[0].as_py(), "<u4")
                ends = np.cumsum(np.frombuffer(part.column("numbers")[0].as_py(), "<u4").astype(np.int64))
                names = np.frombuffer(part.column("windows")[0].as_py(), "<u4")
                count, most = (np.diff(np.concatenate([[0], np.cumsum(x[flat])])[np.concatenate([[0], ends])])
                               for x in (per_pair, is_best))
            else:
                sums = []
                for own, times in zip(part.column("windows").to_pylist(), part.column("numbers").to_pylist()):
                    own = np.frombuffer(own or b"", "<u4")
                    times = _unpacked(times or b"", len(own)).astype(np.int64)
                    at = np.searchsorted(names, own)
                    sums.append((int((most[at] * times).sum()), int((count[at] * times).sum())) if len(own) else (0, 0))
                n_best, count_sum = (pa.array(x, pa.int64()) for x in zip(*sums))
                kept = {f.name: part.column(f.name) for f in schema if f.name in part.schema.names}
                kept |= {"n_best": n_best, "count_sum": count_sum}
                yield pa.RecordBatch.from_arrays([kept[f.name] for f in schema], schema=schema)


def lay(docs: DataFrame, ranks: str, model: str, lot_bytes: int = LOT_BYTES, groups: bool = False) -> DataFrame:
    """Documents and lots, written: what the other functions read."""
    shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_aligner(ranks, model, lot_bytes, groups), LAID), "aligned")


def pair_counts(laid: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that link each id pair (A id * 65536 + B id), and whether no other has more for the A id."""
    counts = (laid.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n")))
    # an A id has at most as many pairs as B has ids
    of_a = W.partitionBy(F.shiftright("pair", 16))
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignments(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups``: the alignment itself, groups as ``a1,a2|b1;a3|b2,b3``."""
    return lay(docs, ranks, model, groups=True).where("kind = 2").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def counted(docs: DataFrame, ranks: str, model: str, lot_bytes: int = LOT_BYTES, groups: bool = False) -> DataFrame:
    """Each document's alignment with the corpus counts of its links."""
    laid = lay(docs, ranks, model, lot_bytes, groups)
    asked = laid.where("kind = 1").select("lot", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(laid), "pair").select("lot", F.lit(0).alias("kind"), "at", "n", "best")
    rest = laid.drop("pairs", "docs").withColumns(
        {"at": F.lit(None).cast("int"), "n": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")})
    rows = rest.unionByName(answers, allowMissingColumns=True)
    return rows.repartition("lot").sortWithinPartitions("lot", "kind").mapInArrow(tidied(_sums), COUNTED)


def digest(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    return counted(docs, ranks, model).drop("groups")
