"""CRC-32 of word n-grams from the running CRCs of a normalised text.

A text is normalised to its words with one space before each, and scanned
once; the CRC after each word is kept.  With the CRCs of two prefixes,
``crc(prefix B) = shift(crc(prefix A), n) ^ crc(the n bytes between)``, where
``shift`` appends n zero bytes: a linear map of 32 bits over GF(2).  Shifting
the shorter prefix's CRC and cancelling it leaves the CRC of the bytes between,
so every n-gram costs one shift, however long it is.
"""

from __future__ import annotations

from itertools import accumulate
from zlib import crc32

import numpy as np

#: the reflected CRC-32 polynomial (fixed value)
POLYNOMIAL = 0xEDB88320
#: shifts by up to this many bytes have a table each; longer ones go by powers of two
NEAR = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_STEP = _byte_table()


def _one_byte(crcs: np.ndarray) -> np.ndarray:
    return (crcs >> np.uint32(8)) ^ _STEP[crcs & np.uint32(255)]


def _through(tables: np.ndarray, crcs: np.ndarray, at=None) -> np.ndarray:
    """Apply a linear map given as the images of each byte in each of four places.

    With ``at``, ``tables`` holds many maps and ``at`` names one for each CRC.
    """
    flat = tables.reshape(-1)
    base = 0 if at is None else at * 1024
    out = None
    for place, byte in enumerate(np.ascontiguousarray(crcs).view(np.uint8).reshape(-1, 4).T):
        got = flat.take(base + (byte.astype(np.int64) + 256 * place))
        out = got if out is None else out ^ got
    return out


_IDENTITY = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])


def _near_tables() -> np.ndarray:
    tables = [_IDENTITY]
    for _ in range(NEAR):
        tables.append(_one_byte(tables[-1]))
    return np.stack(tables)


def _power_tables(count: int = 40) -> list[np.ndarray]:
    tables = [_one_byte(_IDENTITY)]
    while len(tables) < count:
        tables.append(np.stack([_through(tables[-1], row) for row in tables[-1]]))
    return tables


_near = _powers = None


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes as ``lengths`` says, one length each."""
    global _near, _powers
    if _near is None:
        _near, _powers = _near_tables(), _power_tables()
    far = lengths > NEAR
    out = _through(_near, crcs, np.where(far, 0, lengths))
    if far.any():
        some, left, k = out[far], lengths[far], 0
        while left.any():
            odd = (left & 1).astype(bool)
            some[odd] = _through(_powers[k], some[odd])
            left, k = left >> 1, k + 1
        out[far] = some
    return out


def ngram_crcs(words: list[bytes], counts: np.ndarray, most: int):
    """CRCs of the n-grams of 1 to ``most`` words of texts laid one after the other.

    ``counts`` are the texts' numbers of words.  Gives, for each n, the CRCs of
    the n-grams by first word, and which first words have one inside their text.
    """
    n = len(words)
    after = np.fromiter(accumulate([b" " + w for w in words], lambda crc, w: crc32(w, crc), initial=0), np.uint32, n + 1)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes)
    # the prefix that ends with the space before each word
    begin = _one_byte(after[:-1]) ^ np.uint32(crc32(b" "))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the text's end
    for size in range(1, most + 1):
        first = np.flatnonzero(left >= size)
        last = first + size - 1
        yield first, after[last + 1] ^ shift(begin[first], ends[last] - (ends[first] - sizes[first]) - 1)
