"""Two tokenisations of one text, cut into windows at white-space anchors.

Both vocabularies write a word's space into the token that follows it.  After
full tokenisation, a byte offset where a space-marked token of either side
begins and both sides' tokens end is an anchor; the tokens between two anchors
are a window, a pair of id tuples.  Windows repeat from text to text as words
do, so the alignment inside a window is worked out once for a pair of tuples.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: bounds of a worker's memory: texts' chunks and windows that are remembered
MOST_CHUNKS = 250_000
MOST_WINDOWS = 300_000
LONGEST_KEPT = 200
ID = np.dtype("<u2")
#: parts two id strings; no vocabulary of 16-bit ids here reaches it
SEPARATOR = b"\xff\xff"
#: a single space between two characters that aren't white space
CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut at single spaces between characters that aren't white space.

    No token of either vocabulary reaches from before such a space to behind
    it, so the chunks' tokens, each chunk with its space, are the text's.
    """
    if text.replace("\n", "").isprintable() and "\n " not in text and " \n" not in text:
        parts = text.split(" ")
        if "" not in parts:
            return parts
    return CUT.split(text)


class TwoTokenizers:
    """Byte-level BPE (A) and piece BPE (B), with a bounded memory of chunks."""

    _shared: dict = {}

    @classmethod
    def shared(cls, ranks: str, model: str) -> "TwoTokenizers":
        """One instance for all tasks of a Python worker."""
        if (ranks, model) not in cls._shared:
            cls._shared[ranks, model] = cls(ranks, model)
        return cls._shared[ranks, model]

    def __init__(self, ranks: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        byte_bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.encode_a = byte_bpe.encode_ordinary
        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.encode_b = lambda texts: pieces.encode(texts, num_threads=1)
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_a[rank] = token
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) or pieces.is_unknown(i)
                        else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 0xFFFF or any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("ids must fit 16 bits, and a space must stand at a piece's start only")
        self.length = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.spaced = [np.array([t[:1] == b" " for t in side]) for side in (self.bytes_a, self.bytes_b)]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.misspelled: set[str] = set()

    def _learn(self, missing) -> None:
        plain, odd = [], []
        for c in missing:
            (odd if not c or c[0].isspace() or c[-1].isspace() else plain).append(c)
        for i in range(0, len(plain), 2000):
            some = plain[i:i + 2000]
            if not self._learn_row(some, [self.encode_a(" " + " ".join(some)), self.encode_b([" ".join(some)])[0]]):
                odd += some
        for c in odd:
            if not self._learn_row([c], [self.encode_a(" " + c), self.encode_b([c])[0]]):
                self.known[c] = (b"", b"")
                self.misspelled.add(c)

    def _learn_row(self, some: list[str], ids) -> bool:
        """Keep chunks' parts of the ids of all of them in a row, if both sides spell them byte for byte."""
        data = (" " + " ".join(some)).encode()
        if any(b"".join(map(names.__getitem__, own)) != data for names, own in zip((self.bytes_a, self.bytes_b), ids)):
            return False
        stops = np.cumsum([len(c.encode()) + 1 for c in some])
        cut, raw = [], []
        for lengths, own in zip(self.length, ids):
            own = np.array(own, np.int64)
            ends = np.cumsum(lengths[own])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return False
            cut.append([0, *(2 * (at + 1)).tolist()])
            raw.append(own.astype(ID).tobytes())
        a, b = raw
        for c, i, j, x, y in zip(some, cut[0], cut[0][1:], cut[1], cut[1][1:]):
            self.known[c] = a[i:j], b[x:y]
        return True

    def encode(self, texts) -> list[tuple[bytes, bytes] | None]:
        """Per text the ids of both sides as bytes; None if it is null, empty or not spelled by both."""
        parts = [chunks(t) if t else () for t in texts]
        if len(self.known) > MOST_CHUNKS:
            self.known.clear()
            self.misspelled.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.known.keys())
        self._learn(new)
        out = []
        for p in parts:
            if p and self.misspelled.isdisjoint(p):
                a, b = zip(*map(self.known.__getitem__, p))
                out.append((b"".join(a), b"".join(b)))
            else:
                out.append(None)
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.known[c]
                self.misspelled.discard(c)
        return out


def ranges(sizes):
    """0 .. size - 1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Windows(dict):
    """Window (both sides' id strings) to its number, and what its alignment holds."""

    def __init__(self, tokenizers: TwoTokenizers):
        super().__init__()
        self.length = tokenizers.length
        # an id's decimal, followed by what may stand behind it
        self.spelled = np.array([f"{i}{after}" for after in ",|;" for i in range(0x10000)], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.text: list[str] = []
        self.groups = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        #: the id pairs that each window links (A id << 16 | B id), one for a link
        self.pairs = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def learn(self, keys) -> None:
        """Align the windows not seen yet, all in one go."""
        new = list(set(keys) - self.keys())
        for i in range(0, len(new), 50_000):
            self._align(new[i:i + 50_000])

    def _align(self, new: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(new), ID).astype(np.int64)
        sizes = np.array([len(k) // 2 for k in new])
        window = np.repeat(np.arange(len(new)), sizes)
        parts = np.flatnonzero(ids == 0xFFFF)  # one a window: before it A's ids, behind it B's
        is_b = np.arange(len(ids)) > parts[window]
        side = [(ids[m], window[m]) for m in (~is_b & (ids != 0xFFFF), is_b)]
        ends = [np.cumsum(n[own]) for n, (own, _) in zip(self.length, side)]
        # a window's sides have as many bytes, so offsets of the laid-out row agree
        shared = np.zeros(int(ends[0][-1]) + 1, bool)
        shared[ends[0]] = True
        also = np.zeros_like(shared)
        also[ends[1]] = True
        shared &= also
        group = [np.searchsorted(np.flatnonzero(shared), e) for e in ends]
        n_groups = int(shared.sum())
        n_a, n_b = (np.bincount(g, minlength=n_groups) for g in group)
        (a, window_a), (b, _) = side
        of = np.zeros(n_groups, np.int64)
        of[group[0]] = window_a
        # all of a group's A tokens with all of its B tokens
        times = n_b[group[0]]
        first_b = np.cumsum(n_b) - n_b
        pairs = np.repeat(a, times) << 16 | b[np.repeat(first_b[group[0]], times) + ranges(times)]
        links = np.bincount(of, n_a * n_b, len(new)).astype(np.int64)
        # tokens in the order of the digest's text: by group, A before B
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        spell = np.concatenate([np.where(last[0], a + 0x10000, a), np.where(last[1], b + 0x20000, b)])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        text = self.spelled[spell[order]].tolist()
        stops = np.cumsum(sizes - 1).tolist()
        self.text += ["".join(text[i:j]) for i, j in zip([0, *stops], stops)]
        number = len(self)
        self.update(zip(new, range(number, number + len(new))))
        self.groups = np.append(self.groups, np.bincount(of, minlength=len(new)))
        self.links = np.append(self.links, links)
        self.pairs = np.append(self.pairs, pairs.astype(np.uint32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(links))


def cut_windows(encoded, tokenizers: TwoTokenizers):
    """Windows of encoded texts laid one after the other: their keys, and how many each text has."""
    raw = [b"".join([e[side] for e in encoded]) for side in (0, 1)]
    ids = [np.frombuffer(r, ID) for r in raw]
    begin = []
    for side in (0, 1):
        sizes = tokenizers.length[side][ids[side]]
        begin.append(np.cumsum(sizes) - sizes)
    total = int(begin[0][-1] + tokenizers.length[0][ids[0][-1]]) if len(ids[0]) else 0
    marked = np.zeros(total + 1, bool)
    marked[begin[1][tokenizers.spaced[1][ids[1]]]] = True
    # token numbers where texts begin: an anchor in any case
    firsts = np.cumsum([0] + [len(e[0]) // 2 for e in encoded])
    opens = tokenizers.spaced[0][ids[0]] & marked[begin[0]]
    opens[firsts[:-1]] = True
    at_a = np.flatnonzero(opens)
    at_b = np.searchsorted(begin[1], begin[0][at_a])
    per_text = np.diff(np.searchsorted(at_a, firsts))
    a, b = raw
    stops_a, stops_b = (2 * np.append(at_a[1:], len(ids[0]))).tolist(), (2 * np.append(at_b[1:], len(ids[1]))).tolist()
    keys = [a[i:j] + SEPARATOR + b[x:y] for i, j, x, y in zip((2 * at_a).tolist(), stops_a, (2 * at_b).tolist(), stops_b)]
    return keys, per_text
