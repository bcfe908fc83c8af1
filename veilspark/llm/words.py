"""Words of UTF-8 texts for operators 12 and 13, cut from bytes.

A-Z are lower-cased; a word is a run of digits, lower-case letters and
anything beyond ASCII.  Every byte of a character beyond ASCII is at least
0x80, so cutting bytes gives the words that cutting characters gives.
"""

from __future__ import annotations

#: the words as a regular expression, after lower-casing
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the words in a text whose case is kept
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = bytes(b if b >= 128 or chr(b) in "0123456789" + LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32
              for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text; null has none."""
    return data.translate(_FOLD).split() if data else []


def text_slices(batches, column: str, most_bytes: int = 4_000_000):
    """Slices of Arrow batches with about ``most_bytes`` of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 16)
        at = 0
        while at < batch.num_rows:
            begun = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begun + most_bytes, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def bytes_of(column) -> list:
    """A string column's texts as bytes."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
