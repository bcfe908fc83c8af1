"""Operator 13, benchmark decontamination: one Aho-Corasick automaton.

The texts of a benchmark are normalised to words, and every window of ``size``
consecutive words (an item of fewer words is one window) becomes a pattern of
one automaton.  A document is normalised the same way and run through the
automaton once; what is found is reported as spans of the original text, in
code points, with the items it belongs to.

A word is written as a few symbols (its number's digits, each place with an
alphabet of its own), so a state has at most 64 successors however large the
benchmark's vocabulary; a word that the benchmark doesn't hold is one symbol
that leads back to the root.

Size: documents are only scanned, never shuffled.  The automaton is shipped to
the Python workers, so its size is checked first: up to ``most_windows``
(window, item) pairs and ``most_bytes`` of window text make one automaton.  A
larger benchmark is dealt over several by a hash of window and item, and the
documents pass through one after the other with what was found so far, written
in between.

Defined results: null and empty texts have no words and are never hit; a null
item_id's windows mark words but name no item; rows with the same item_id are
one item; documents with equal ids are judged row by row; without items, or
with items without words, nothing is hit; an empty table gives no row; other
columns are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, tidied, written
from .words import LOWER, UPPER, WORD, WORD_ANY_CASE, bytes_of, text_slices, words_of

SIZE = 10
MOST_WINDOWS = 200_000
MOST_BYTES = 24_000_000
PLACES = 64

FOUND = ("doc_id long, text string, n_words long, n_hit long, hits array<struct<first:int,last:int>>, "
         "spans array<struct<start:int,end:int>>, item_ids array<string>")


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct ``(window, item_id)`` of a benchmark, words joined by a space."""
    words = F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'({WORD})', 0)")
    cut = F.expr(f"transform(sequence(1, greatest(size(words) - {size - 1}, 1)), i -> array_join(slice(words, i, {size}), ' '))")
    return (items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
            .where(F.size("words") > 0)
            .select("item_id", F.explode(cut).alias("window")).distinct())


class Windows:
    """The automaton over some windows, as a Python worker holds it."""

    _held: dict = {}

    @classmethod
    def shared(cls, name: str, rows) -> "Windows":
        """One automaton for all tasks of a Python worker."""
        if name not in cls._held:
            cls._held.clear()
            cls._held[name] = cls(rows)
        return cls._held[name]

    def __init__(self, rows):
        import ahocorasick

        windows = [(window.encode().split(b" "), items) for window, items in rows]
        vocabulary = sorted({w for words, _ in windows for w in words})
        places = 1
        while PLACES ** places < len(vocabulary):
            places += 1
        self.symbols = {w: "".join(chr(1 + PLACES * k + n // PLACES ** k % PLACES) for k in range(places))
                        for n, w in enumerate(vocabulary)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.lengths, self.items = [], []
        for n, (words, items) in enumerate(windows):
            self.automaton.add_word("".join(map(self.symbols.__getitem__, words)), n)
            self.lengths.append(len(words))
            self.items.append(items)
        self.automaton.make_automaton()
        self.empty = not windows

    def occurrences(self, words):
        """``(first word, last word, window)`` of each occurrence, by last word."""
        if self.empty or not words:
            return []
        symbols, unknown = self.symbols.get, "\0"
        found = list(self.automaton.iter("".join([symbols(w, unknown) for w in words])))
        if not found:
            return found
        # symbols are numbered, words are wanted: the word that ends with each symbol
        ends, at = {}, -1
        for k, w in enumerate(words):
            at += len(symbols(w, unknown))
            ends[at] = k
        return [(ends[e] - self.lengths[n] + 1, ends[e], n) for e, n in found]


def runs(intervals):
    """Closed intervals of words merged where they overlap or touch."""
    out: list[list[int]] = []
    for first, last in sorted(intervals):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def word_spans(text: str, merged):
    """Code-point spans of runs of words."""
    if not merged:
        return []
    at = [m.span() for m in re.finditer(WORD_ANY_CASE, text)]
    return [{"start": at[first][0], "end": at[last][1]} for first, last in merged]


def _scanner(name: str, rows, last: bool, schema):
    def scan(batches):
        import pyarrow as pa

        held = Windows.shared(name, rows.value)
        for part in text_slices(batches, "text"):
            texts, columns = part.column("text"), part.schema.names
            before = part.column("hits").to_pylist() if "hits" in columns else [None] * part.num_rows
            named = part.column("item_ids").to_pylist() if "item_ids" in columns else [None] * part.num_rows
            n_words, n_hit, hits, spans, item_ids = [], [], [], [], []
            for i, data in enumerate(bytes_of(texts)):
                words = words_of(data)
                found = held.occurrences(words)
                merged, items = runs([(h["first"], h["last"]) for h in before[i] or ()] + [f[:2] for f in found]), set(named[i] or ())
                for n in {f[2] for f in found}:
                    items.update(held.items[n])
                n_words.append(len(words))
                n_hit.append(sum(b - a + 1 for a, b in merged))
                hits.append([{"first": a, "last": b} for a, b in merged])
                spans.append(word_spans(data.decode(), merged) if last and merged else [])
                item_ids.append(sorted(items))
            text = pa.nulls(part.num_rows, pa.string()) if last else texts
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), text] + [pa.array(c, t.type) for c, t in zip((n_words, n_hit, hits, spans, item_ids), list(schema)[2:])],
                schema=schema)

    return tidied(scan)


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, most_windows: int = MOST_WINDOWS,
         most_bytes: int = MOST_BYTES) -> DataFrame:
    """Each document's hit words: ``doc_id, n_words, n_hit, spans, item_ids``.

    ``spans`` are the runs of hit words as code-point offsets of the original
    text, ``item_ids`` the items (as strings, sorted) with a window in it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = shipped(docs.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(FOUND))
    windows = written(item_windows(items, size), "benchmark-windows")
    total = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("b")).first()
    parts = max(1, math.ceil(total["n"] / most_windows), math.ceil(total["b"] / most_bytes))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for part in range(parts):
        # at most most_windows pairs (give or take the hash) reach the driver at once
        rows = spark.sparkContext.broadcast([
            (r["window"], r["items"]) for r in
            windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)) == part)
            .groupBy("window").agg(F.collect_list("item_id").alias("items")).collect()])
        last = part == parts - 1
        found = found.mapInArrow(_scanner(uuid.uuid4().hex, rows, last, schema), FOUND)
        if not last:
            found = written(found, "decontaminate")
    return found.select("doc_id", "n_words", "n_hit", "spans", "item_ids")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The counts and the digest of the items of each document."""
    return find(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
