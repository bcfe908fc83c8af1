"""Operator 10, n-gram Jaccard join by universe partitioning.

Two documents link when their sets of word shingles have a Jaccard similarity
of 3/4 or more.  The universe of shingles is hashed into segments, as many as
the pair's size band says.  Sets of sizes a and b that link differ in at most
(a + b) / 7 shingles, a difference changes one segment, so by the pigeonhole
principle all but that many segments are equal in both.

* Size bands are powers of two; a pair belongs to the band of its larger set, so
  a set indexes its own band and, if a larger partner can lie there, the next.
* Allocation (``plan``): a band is indexed by subsets (a segment's whole
  content, one signature, one difference outweighed) or by one-deletion
  neighbourhoods (the content and the content less each shingle, two
  differences outweighed), whichever has the lower cost of signatures plus
  expected accidental matches.
* With subsets, a set that may differ in D segments signs its D + 1 best
  segments in one global order: first those with most shingles that are not
  known as common, then larger ones, then by hash.  If two sets of segments
  have all but D in common, their first D + 1 in any common order meet, so no
  pair is lost; passages that many documents share come last.  The list of
  common shingles comes from a bounded sample and only steers the order.
* Every candidate pair is verified on the full sets.

Documents with equal sets are one node from the start (a digest of the set), so
copies never meet as pairs.  Signatures that stand alone are sieved out in
packed form (``sieve``).  Nodes that share a signature are first tried against
the smallest node of each signature; what links is united.  Then all nodes that
share a signature but not yet a component are compared: pair by pair where a
signature has up to ``SMALL_GROUP`` nodes; the nodes of larger signatures whose
smallest nodes are one component are cut into blocks of about ``BLOCK_NODES``, and
each pair of blocks is intersected at once as a matrix product, from which only a
forest of links between components leaves.  So a large group of near copies costs a
star and a few products, its pairs never become rows, and no link between
components is missed.

Most nodes that meet share a signature by accident, the more the larger the
corpus.  A set's *sketch* has a bit for each of some places, 2 to 4 a shingle,
that says whether an odd number of its shingles fall there.  A shingle in one set
only turns one bit over, so two sketches differ in at most as many bits as the
sets in shingles, and sets whose sketches differ in more than (a + b) / 7 bits don't
link.  Only texts of nodes whose sketches allow a link are looked up,
packed and shuffled; every step's tables and shuffles are deleted when no later
step reads them.

Digests of sets and shingles are 64 bits (accidental equality: about one pair
in a corpus of 6e9 distinct sets).

Defined results: null or empty text, or one without words: empty set, linked
with nothing, its own component; fewer words than a shingle: one shingle;
repeated rows are copies; null doc_ids are members but never name a component
unless all are null; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.gazetteer import key_filter, passes
from ..session import scratch
from . import sieve
from .byte_hash import mix, prefix_sums, slices
from .common import WORD, arrow_batch, arrow_schema, rows_of, shipped, text_or_empty, tidied, written

WORDS = 5
#: similarity 3/4: sets of sizes a and b link if they share 3/7 of a + b, so differ in 1/7
SHARE_DIFFERING = 7
#: sample for the list of common shingles: documents, or one of so many if that is more, least count, longest list
SAMPLE_DOCS, SAMPLE_ONE_OF, SAMPLE_COUNT, MOST_COMMON = 4000, 64, 3, 200_000
#: cost model: sets of a band, and the chance that a set holds a given shingle of another
COST_SETS, COST_SHARED = 20_000, 0.002
LOT_BYTES = 1 << 18
#: nodes of a signature up to which its open pairs are formed one by one; nodes of a block beyond
SMALL_GROUP, BLOCK_NODES, BLOCK_SHINGLES = 16, 512, 8192
LEAST_BITS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)

MEMBERS = "rid long, doc_id long, n_shingles long, node long, sketch binary"
PAIRS = "a long, b long"
BLOCK = "cluster long, i long, j long, node long, component long"


# --- sets --------------------------------------------------------------------

def shingle_sets(texts: list[bytes], words: int = WORDS):
    """(owner, hash) of the distinct shingles of each text, sorted by owner then hash."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # a space between texts: words end with their text
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = _SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    word = slices(prefix_sums(data), start, end)
    owner = np.searchsorted(begins, start, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = np.zeros(0, np.uint64)
    if len(word) >= words:
        whole = word[: len(word) - words + 1].copy()
        for i in range(1, words):
            whole = whole * _STEP + word[i: len(word) - words + 1 + i]
        inside = owner[: len(whole)] == owner[words - 1:]
        whole, owners = mix(whole[inside]), owner[: len(inside)][inside]
    else:
        owners = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        one = np.full(len(short), 0xABCD, np.uint64)
        for i in range(words - 1):
            more = i < count[short]
            one[more] = one[more] * _STEP + word[first[short[more]] + i] + np.uint64(1)
        whole, owners = np.concatenate([whole, mix(one)]), np.concatenate([owners, short])
    order = np.lexsort((whole, owners))
    whole, owners = whole[order], owners[order]
    new = np.ones(len(whole), bool)
    new[1:] = (whole[1:] != whole[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], whole[new]


def _sizes_and_nodes(owner, hashes, n_texts: int):
    """Set sizes and 64-bit set digests (independent of order) per text."""
    size = np.bincount(owner, minlength=n_texts)
    total = np.zeros(n_texts, np.uint64)
    np.add.at(total, owner, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return size, mix(total + size.astype(np.uint64) * _STEP).view(np.int64)


# --- sketches ----------------------------------------------------------------

def sketches(owner, hashes, size) -> list[bytes]:
    """The sketch of each set; its number of bits is a power of two that follows the set's size."""
    bits = np.array([max(LEAST_BITS, 2 << int(n).bit_length()) for n in size], np.int64)
    begins = np.concatenate([[0], np.cumsum(bits)])
    place = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & (bits[owner] - 1).astype(np.uint64)
    odd = np.bincount(begins[owner] + place.astype(np.int64), minlength=begins[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[x // 8:y // 8] for x, y in zip(begins, begins[1:])]


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer one is folded to the shorter one's length."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


# --- signatures --------------------------------------------------------------

def most_differing(size: int, band: int) -> int:
    """Most differences between a set of this size and one it links with in this band."""
    top = (2 << band) - 1
    return (size + min(size * 4 // 3, top)) // SHARE_DIFFERING


def bands(size: int) -> list[int]:
    own = size.bit_length() - 1
    return [own, own + 1] if size * 4 // 3 >= 2 << own else [own]


def plan(band: int, sets: int = COST_SETS, shared: float = COST_SHARED) -> tuple[str, int]:
    """(scheme, number of segments) of least cost for a band's largest sets."""
    size = (2 << band) - 1
    d = most_differing(size, band)

    def match(held: int) -> float:
        """Cost of a signature of ``held`` shingles: its row and its accidental matches."""
        return 1 + sets * shared ** max(held, 0)

    def spread(mean: float):
        """(shingles, share of segments) from most to fewest, Poisson."""
        chance, out = math.exp(-mean), []
        for k in range(int(4 * mean) + 10):
            out.append((k, chance))
            chance *= mean / (k + 1)
        return out[::-1]

    subsets, left, by_subsets = 1 << band, float(d + 1), 0.0
    for k, share in spread(size / subsets):  # the D + 1 best ones sign
        by_subsets += min(left, share * subsets) * match(k)
        left -= min(left, share * subsets)
    by_subsets += left * match(0)
    halves = d // 2 + 1
    by_deletions = halves * sum(share * (match(k) + k * match(k - 1)) for k, share in spread(size / halves))
    return ("subsets", subsets) if by_subsets <= by_deletions else ("deletions", halves)


def signatures(hashes: np.ndarray, common: np.ndarray, schemes=None) -> np.ndarray:
    """64-bit signatures of one set (distinct shingle hashes)."""
    size = len(hashes)
    if not size:
        return np.zeros(0, np.uint64)
    rare = np.ones(size, bool) if not len(common) else (
        common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes)
    value = mix(hashes + np.uint64(0x632BE59BD9B4E019))
    out = []
    for band in bands(size):
        scheme, segments = (schemes or plan_of)(band)
        place = (mix(hashes ^ np.uint64(band + 1)) % np.uint64(segments)).astype(np.int64)
        content = np.zeros(segments, np.uint64)
        np.add.at(content, place, value)
        number = np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 40)
        d = most_differing(size, band)
        if scheme == "subsets":
            held = np.bincount(place, minlength=segments)
            held_rare = np.bincount(place[rare], minlength=segments)
            sign = mix(content + mix(number))
            order = np.lexsort((sign, -held, -held_rare))
            out.append(sign[order[: d + 1]])
        else:
            out.append(mix(content + mix(number)))
            out.append(mix(content[place] - value + mix(number[place])))
    return np.unique(np.concatenate(out))


_plans: dict[int, tuple[str, int]] = {}


def plan_of(band: int) -> tuple[str, int]:
    if band not in _plans:
        _plans[band] = plan(band)
    return _plans[band]


# --- tasks -------------------------------------------------------------------

def _lots(batches):
    """Lists of (other columns, text bytes) of about ``LOT_BYTES``; the text is the last column."""
    lot, size = [], 0
    for *keys, text in rows_of(batches):
        raw = text.encode()
        lot.append((keys, raw))
        size += len(raw)
        if size >= LOT_BYTES:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _members(words: int):
    def run(batches):
        schema = arrow_schema(MEMBERS)
        for lot in _lots(batches):
            owner, hashes = shingle_sets([t for _, t in lot], words)
            size, node = _sizes_and_nodes(owner, hashes, len(lot))
            first = {n: i for i, n in enumerate(node.tolist()) if size[i]}  # copies are sketched once a lot
            sketch = [x if first.get(n) == i else None for i, (n, x) in enumerate(zip(node.tolist(), sketches(owner, hashes, size)))]
            yield arrow_batch([*zip(*(keys for keys, _ in lot)), size, node, sketch], schema)

    return run


def _pack(batches):
    import zstandard

    schema, packer = arrow_schema("rid long, z binary"), zstandard.ZstdCompressor(level=6)
    for lot in _lots(batches):
        yield arrow_batch([[rid for (rid,), _ in lot], [packer.compress(text) for _, text in lot]], schema)


def _near(batches):
    """The pairs whose sketches allow a link."""
    schema = arrow_schema(PAIRS)
    for batch in batches:
        near = [(a, b) for a, b, size_a, size_b, x, y in rows_of([batch]) if SHARE_DIFFERING * bits_apart(x, y) <= size_a + size_b]
        if near:
            yield arrow_batch(zip(*near), schema)


def _sample(words: int):
    def run(batches):
        schema = arrow_schema("node long, shingle long")
        for lot in _lots(batches):
            owner, hashes = shingle_sets([t for _, t in lot], words)
            _, node = _sizes_and_nodes(owner, hashes, len(lot))
            yield arrow_batch([node[owner], hashes.view(np.int64)], schema)

    return run


def _sign(words: int, buckets: int, common: np.ndarray, schemes=None):
    def run(batches):
        def lots():
            held, total = [], 0
            for lot in _lots(batches):
                owner, hashes = shingle_sets([t for _, t in lot], words)
                size, node = _sizes_and_nodes(owner, hashes, len(lot))
                edges = np.concatenate([[0], np.cumsum(size)])
                seen = set()
                for i in range(len(lot)):
                    if not size[i] or node[i] in seen:  # copies sign once a lot
                        continue
                    seen.add(node[i])
                    sign = signatures(hashes[edges[i]:edges[i + 1]], common, schemes)
                    held.append((sign, node[i]))
                    total += len(sign)
                if total >= sieve.LOT:
                    yield gathered(held)
                    held, total = [], 0
            if held:
                yield gathered(held)

        def gathered(held):
            sign = np.concatenate([s for s, _ in held])
            owner = np.repeat(np.array([n for _, n in held], np.int64), [len(s) for s, _ in held])
            order = np.lexsort((owner, sign))
            sign, owner = sign[order], owner[order]
            new = np.ones(len(sign), bool)
            new[1:] = (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])
            return sign[new], np.zeros(new.sum(), np.uint16), owner[new]

        yield from sieve.blocks(lots(), buckets)

    return run


def _verify(words: int):
    def run(batches):
        import zstandard

        schema, unpacker = arrow_schema(PAIRS), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                a, b, za, zb = (c.to_pylist() for c in batch.slice(i, 200).columns)
                texts = {n: z for n, z in [*zip(a, za), *zip(b, zb)]}
                place = {n: j for j, n in enumerate(texts)}
                owner, hashes = shingle_sets([unpacker.decompress(z) for z in texts.values()], words)
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                keep = []
                for x, y in zip(a, b):
                    x_, y_ = (hashes[edges[place[n]]:edges[place[n] + 1]] for n in (x, y))
                    shared = len(np.intersect1d(x_, y_, assume_unique=True))
                    keep.append(100 * shared >= 75 * (len(x_) + len(y_) - shared))
                keep = np.array(keep)
                if keep.any():
                    yield arrow_batch([np.array(a)[keep], np.array(b)[keep]], schema)

    return run


# --- the join ----------------------------------------------------------------

def _common_shingles(texts: DataFrame, rows: int, words: int) -> np.ndarray:
    if not rows:
        return np.zeros(0, np.uint64)
    some = texts.sample(fraction=min(1.0, max(SAMPLE_DOCS / rows, 1 / SAMPLE_ONE_OF)), seed=7)
    counted = some.mapInArrow(tidied(_sample(words)), "node long, shingle long").distinct().groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_COUNT)
    found = [r[0] for r in counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _in_ratio():
    return (4 * F.col("size_a") >= 3 * F.col("size_b")) & (4 * F.col("size_b") >= 3 * F.col("size_a"))


def components(docs: DataFrame, words: int = WORDS, schemes=None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    return _components(docs, words, schemes).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, words: int, schemes=None) -> DataFrame:
    """Also ``rid``, which equal rows share, and ``first_rid``, the rid of the document that
    names the component."""
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    members = written(rows.mapInArrow(tidied(_members(words)), MEMBERS), "members")
    count, total = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    with scratch(spark) as paths:
        labels = written(_labels(spark, rows.select("rid", "text"), members, count, total, words, schemes), "labels")
        paths.pop()  # this table stays
    grouped = members.drop("sketch").join(labels, "node", "left").withColumn(
        "c", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    least = grouped.where("c IS NOT NULL").groupBy("c").agg(
        F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))["rid"].alias("first_rid"))
    return grouped.join(least, "c", "left").select(
        "rid", "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "first_rid")


def _labels(spark, texts, members, rows, total, words, schemes) -> DataFrame:
    """``node, component`` of the nodes that have links; ``texts`` are ``rid, text``."""
    buckets = sieve.bucket_count(spark, 0.5 * total)
    common = _common_shingles(texts.select("text"), rows, words)
    signed = texts.select("text").mapInArrow(tidied(_sign(words, buckets, common, schemes)), sieve.BLOCKS)
    # a table, so that the blocks are read once and deleted before the next shuffle
    met = written(sieve.shared(signed, buckets), "shared").distinct()
    # a signature that only copies of one set have leaves here
    lone = met.groupBy("hash").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high")
    met = written(met.join(lone, "hash").select("hash", F.col("owner").alias("node"), "low"), "met")

    nodes = met.select("node").distinct()
    sets = written(members.where("n_shingles > 0").join(nodes, "node").groupBy("node").agg(
        F.min("n_shingles").alias("size"), F.min("rid").alias("rid"), F.first("sketch", ignorenulls=True).alias("sketch")), "sets")
    star = written(_close(met.where("node <> low").select(
        F.col("low").alias("a"), F.col("node").alias("b")).distinct(), sets), "star")
    linked = written(_linked(star, _packed(texts, sets, _ends(star)), words), "linked")
    label = connected_components(linked, nodes, "a", "b")

    # what shares a signature but not yet a component
    named = met.join(label.withColumnRenamed("vertex", "node"), "node").join(sets.select("node", "size"), "node")
    mixed = named.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                      F.count(F.lit(1)).alias("n")).where("x < y").select("hash", "n")
    open_ = written(named.join(mixed, "hash").select("hash", "node", "low", "component", "size", "n"), "open")
    rest = written(_close(_few(open_.where(F.col("n") <= SMALL_GROUP)).join(star, ["a", "b"], "left_anti"), sets), "rest")
    large = open_.where(F.col("n") > SMALL_GROUP)
    if large.limit(1).count():
        blocks = written(_many(large, sets, label), "blocks")
        zs = _packed(texts, sets, _ends(rest).unionByName(blocks.select("node")))
        more = _linked(rest, zs, words).unionByName(
            blocks.join(zs, "node").groupBy("cluster", "i", "j").applyInPandas(_block_links(words), PAIRS))
    else:
        more = _linked(rest, _packed(texts, sets, _ends(rest)), words)
    united = connected_components(linked.unionByName(written(more, "more")), nodes, "a", "b")
    return united.select(F.col("vertex").alias("node"), "component")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _packed(texts: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, z``: a packed text of each of the nodes.  Of the other texts only those leave their
    task that a Bloom filter lets through."""
    asked = written(sets.select("node", "rid").join(nodes, "node", "left_semi"), "asked")
    found = passes(texts, "rid", *key_filter(asked, "rid")).mapInArrow(tidied(_pack), "rid long, z binary")
    return written(asked.join(found, "rid").groupBy("node").agg(F.first("z").alias("z")), "texts")


def _few(open_: DataFrame) -> DataFrame:
    """Pairs of nodes that small signatures share."""
    left = open_.select("hash", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("size").alias("size_a"))
    right = open_.select("hash", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("size").alias("size_b"))
    return left.join(right, "hash").where((F.col("ca") < F.col("cb")) & _in_ratio()).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _many(large: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """Blocks of nodes of large signatures, of each those nodes whose sketches allow a link there.

    Signatures whose smallest nodes are one component are one cluster.  Near copies have few such
    components, and unlike a closure over shared nodes it doesn't chain signatures that meet by accident."""
    held = large.select("low", "node", "component").distinct().join(
        label.select(F.col("vertex").alias("low"), F.col("component").alias("cluster")), "low").select(
        "cluster", "node", "component").distinct()
    blocks = held.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = held.join(blocks, "cluster").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         "node", "component")
    return dealt.join(sets.select("node", "size", "sketch"), "node").groupBy("cluster", "i", "j").applyInPandas(_block_near, BLOCK)


def _block_near(pdf):
    """The nodes of a block that some other component's node may link with, by their sketches."""
    size, component = pdf["size"].to_numpy(), pdf["component"].to_numpy()
    bits = np.array([8 * len(x) for x in pdf["sketch"]])
    near = np.zeros(len(pdf), bool)
    for m in np.unique(bits).tolist():
        at = np.flatnonzero((bits == m) | (bits == 2 * m))  # sets of other lengths differ too much in size
        if len(at) < 2:
            continue
        both = np.stack([_folded(pdf["sketch"].iloc[k], m // 8) for k in at])
        alike = np.zeros((len(at), len(at)), np.float32)
        for first in range(0, m // 8, BLOCK_SHINGLES // 8):
            signs = np.unpackbits(both[:, first:first + BLOCK_SHINGLES // 8], axis=1).astype(np.float32) * 2 - 1
            alike += signs @ signs.T
        s, c, own = size[at], component[at], bits[at] == m
        link = (SHARE_DIFFERING * (m - alike) <= 2 * (s[:, None] + s[None, :])) & (c[:, None] != c[None, :])
        link &= (4 * s[:, None] >= 3 * s[None, :]) & (4 * s[None, :] >= 3 * s[:, None]) & (own[:, None] | own[None, :])
        near[at] |= link.any(axis=1)
    return pdf.loc[near, ["cluster", "i", "j", "node", "component"]]


def _folded(sketch: bytes, length: int):
    x = np.frombuffer(sketch, np.uint8)
    return x if len(x) == length else x[:length] ^ x[length:]


def _block_links(words: int):
    def run(pdf):
        import pandas as pd
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        node, component = pdf["node"].to_numpy(), pdf["component"].to_numpy()
        owner, hashes = shingle_sets([unpacker.decompress(z) for z in pdf["z"]], words)
        size = np.bincount(owner, minlength=len(node)).astype(np.float32)
        _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)  # a shingle of one node is in no intersection
        rank = np.full(len(count), -1)
        rank[shared] = np.arange(len(shared))
        column = rank[column]
        owner, column = owner[column >= 0], column[column >= 0]
        both = np.zeros((len(node), len(node)), np.float32)
        for at in range(0, len(shared), BLOCK_SHINGLES):
            here = (column >= at) & (column < at + BLOCK_SHINGLES)
            held = np.zeros((len(node), BLOCK_SHINGLES), np.float32)
            held[owner[here], column[here] - at] = 1
            both += held @ held.T
        link = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
        x, y = np.nonzero(link & (component[:, None] < component[None, :]))
        names, component = np.unique(component, return_inverse=True)
        x, y = _forest(x, y, component, len(names))
        return pd.DataFrame({"a": node[x], "b": node[y]})

    return run


def _forest(x, y, component, n: int):
    """Those of the links ``x, y`` that are needed to unite what all of them unite; ``component`` is in 0..n-1."""
    by_pair = np.full((n, n), -1)
    by_pair[component[x], component[y]] = by_pair[component[y], component[x]] = np.arange(len(x))
    unseen, keep = np.ones(n, bool), []
    for root in range(n):
        todo = [root] if unseen[root] else []
        unseen[root] = False
        while todo:
            link = by_pair[todo.pop()]
            new = np.flatnonzero((link >= 0) & unseen)
            unseen[new] = False
            keep += link[new].tolist()
            todo += new.tolist()
    return x[keep], y[keep]


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("y")), "b"))
    return both.where(_in_ratio()).select("a", "b", "size_a", "size_b", "x", "y").mapInArrow(tidied(_near), PAIRS)


def _linked(pairs: DataFrame, zs: DataFrame, words: int) -> DataFrame:
    """The pairs that link, verified on the full sets."""
    # the texts of a travel on to the second join: a star's centre repeats there and compresses
    both = (pairs.join(zs.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
            .join(zs.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b"))
    return both.select("a", "b", "za", "zb").mapInArrow(tidied(_verify(words)), PAIRS)


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns.
    Documents with empty sets or null ids all stay; of repeated rows one stays."""
    rid = "_rid"
    while rid in {c.lower() for c in docs.columns}:  # a column of the user's
        rid += "_"
    marked = docs.withColumn(rid, F.xxhash64(F.col("doc_id").cast("long"), text_or_empty("text")))
    stay = _components(docs, words).where("first_rid IS NOT NULL").select(F.col("first_rid").alias(rid)).distinct()
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = marked.where(worded).join(stay, rid, "left_semi").dropDuplicates([rid])
    return one.unionByName(marked.where(~worded)).drop(rid)
