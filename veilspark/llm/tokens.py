"""Tokenising whole texts through a bounded cache of chunks.

The public word BPE lower-cases, splits on a fixed pattern and never joins
across white space, so a text's ids are those of its space-separated chunks
in order, and a chunk's ids are those of its pattern pieces.  Chunks repeat
far more than texts; only chunks not seen lately reach the tokenizer, many in
one call.  Texts that hold a special token's string go to it whole.
"""

from __future__ import annotations

import os
from array import array

#: entries after which a cache is emptied; bounds a worker's memory
MOST_CHUNKS = 400_000
MOST_PIECES = 300_000
#: the pre-tokenizer's pattern as its public vocabulary file states it (fixed value)
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    _shared: dict = {}

    @classmethod
    def shared(cls, path: str) -> "ChunkTokenizer":
        """One tokenizer and cache for all tasks of a Python worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable bytes spell themselves, others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.spelled = {b: 256 + i for i, b in enumerate(others)}
        self.split = regex.compile(PIECE).findall
        self.merge = self.tok.model.tokenize
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_piece(self, piece: str) -> bytes:
        """A piece is pre-tokenised already: only the merges are left to do."""
        if not (piece.isascii() and piece.isalpha()):
            spelled = piece.encode().decode("latin-1").translate(self.spelled)
        else:
            spelled = piece
        raw = self.pieces[piece] = array("I", [t.id for t in self.merge(spelled)]).tobytes()
        return raw

    def _learn(self, missing) -> None:
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        known, piece_of, learn = self.chunks, self.pieces.get, self._learn_piece
        others = []
        for chunk in missing:
            # ASCII and the Latin letters after it: Python's rules for case and
            # letters are the tokenizer's there; other scripts are left to it
            if not chunk.isascii() and (max(chunk) >= "\u0180" or "\u0130" in chunk):
                others.append(chunk)
                continue
            low = chunk.lower()
            if low.isalpha():  # letters only: one piece
                known[chunk] = piece_of(low) or learn(low)
                continue
            word, mark = low[:-1], low[-1:]
            if word.isalpha() and mark in ".,;:!?":
                known[chunk] = (piece_of(word) or learn(word)) + (piece_of(mark) or learn(mark))
            else:
                known[chunk] = b"".join([piece_of(p) or learn(p) for p in self.split(low)])
        for i in range(0, len(others), 1000):
            some = others[i:i + 1000]
            for chunk, got in zip(some, self.tok.encode_batch(some, add_special_tokens=False)):
                known[chunk] = array("I", got.ids).tobytes()

    def encode_batch(self, texts, lot: int = 256):
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        texts = texts.to_pylist() if hasattr(texts, "to_pylist") else list(texts)
        for i in range(0, len(texts), lot):
            some = [t or "" for t in texts[i:i + lot]]
            whole = {j for j, t in enumerate(some) if "<|" in t and any(s in t for s in self.special)}
            parts = [[] if j in whole else t.replace("\n", " ").split(" ") for j, t in enumerate(some)]
            if len(self.chunks) > MOST_CHUNKS:
                self.chunks.clear()
            known = self.chunks
            # each chunk is looked up once; what was missing is filled in afterwards
            found = [list(map(known.get, p)) for p in parts]
            self._learn({c for p, f in zip(parts, found) for c, raw in zip(p, f) if raw is None})
            for j, (p, f) in enumerate(zip(parts, found)):
                if j in whole:
                    yield self._raw(some[j])
                else:
                    yield b"".join([known[c] if raw is None else raw for c, raw in zip(p, f)] if None in f else f)
