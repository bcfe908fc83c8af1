"""Tokenizer alignment, importance resampling and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import align, decontaminate, resample
from veilspark.llm.common import table
from veilspark.llm.crc_ngrams import ngram_crcs
from veilspark.llm.queries import tokenizer_path
from veilspark.llm.token_windows import TwoTokenizers, chunks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words long, rank string, pair long, lot int, window string, copies int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, parts=3):
    """Documents with extra columns whose names the operators also use."""
    made = [(i, t, 1, "x", 2, 3, "w", 4) for i, t in rows]
    return spark.createDataFrame(made, DOCS).repartition(parts) if made else spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


ODD = "ab '\t\n\r\x0b\x0c\x1c\x85 　 .12éß中́٣<|endoftext|>'s'll▁\x00\U0001F600 "


def odd_texts(seed, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(1, most))) for _ in range(n)]


# --- alignment -------------------------------------------------------------------

@pytest.fixture(scope="module")
def both():
    """The two tokenizers as their public libraries load them, and their tokens' bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if i < 50256}
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode() for n in names]

    def encode(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        data = (" " + text).encode()
        right = b"".join(bytes_a[i] for i in ids_a) == data and b"".join(bytes_b[i] for i in ids_b) == data
        return ([(i, len(bytes_a[i])) for i in ids_a], [(i, len(bytes_b[i])) for i in ids_b]) if right else None

    return encode


def plain_groups(a, b):
    ends = [np.cumsum([n for _, n in side]).tolist() for side in (a, b)]
    groups, i, j, begun = [], 0, 0, (0, 0)
    while i < len(a):
        if ends[0][i] == ends[1][j]:
            groups.append(([t for t, _ in a[begun[0]:i + 1]], [t for t, _ in b[begun[1]:j + 1]]))
            i, j = i + 1, j + 1
            begun = i, j
        elif ends[0][i] < ends[1][j]:
            i += 1
        else:
            j += 1
    return groups


def plain_alignment(texts, encode):
    held = [plain_groups(*e) if e else [] for e in map(encode, texts)]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in held]
    counts = Counter(p for own in links for p in set(own))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups, own in zip(held, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own),
                    sum(counts[p] == most[p[0]] for p in own), sum(counts[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_chunked_tokens_are_those_of_whole_texts(both):
    tokenizers = TwoTokenizers(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts(3, 3000) + [" a", "a ", " ", "a  b", "x\n \ny", "a\n b", "x" * 50_000, "wörd " * 3000]
    for text, got in zip(texts, tokenizers.encode(texts)):
        want = both(text)
        if want is None:
            assert got is None, repr(text)
        else:
            assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[i for i, _ in side] for side in want], repr(text)


def test_chunks_rejoin():
    for text in odd_texts(4, 2000):
        assert " ".join(chunks(text)) == text


@pytest.mark.parametrize("lot_bytes", [60, 5000, align.LOT_BYTES])
def test_alignment_matches_plain_python(spark, both, lot_bytes):
    rng = random.Random(lot_bytes)
    stock = ["the", "tokenizer", "naïve", "Übergröße", "x1y2", "don't", "中文", "a\nb", "'s", "unbelievably", "<|endoftext|>", "\U0001F600!"]
    rows = [(1, None), (2, ""), (3, "the the the"), (3, "the the the"), (None, "null id"), (4, "has ▁ inside"), (5, " lead"), (6, "trail  "),
            (7, "word " * 4000)]
    rows += [(10 + i, " ".join(rng.choice(stock) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(odd_texts(5, 60, 40))]
    got = align.counted(docs_of(spark, rows), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), lot_bytes)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *r) for (i, _), r in zip(rows, plain_alignment([t for _, t in rows], both))]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_alignment_of_the_small_corpus(spark, both):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, *r) for (i, _), r in zip(rows, plain_alignment([t for _, t in rows], both))]
    got = align.digest(docs.repartition(5), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_alignment_gives_the_groups_and_takes_an_empty_table(spark):
    paths = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model")
    row = align.alignments(docs_of(spark, [(1, "hello tokenizers")], 1), *paths).first()
    assert row.groups.count(";") == row.n_groups - 1 and row.groups.count("|") == row.n_groups
    assert align.digest(docs_of(spark, []), *paths).count() == 0


# --- resampling ------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(5))
def test_ngram_crcs_match_zlib(seed):
    rng = random.Random(seed)
    texts = [[bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 255, 256, 257, 2000]))) for _ in range(rng.choice([0, 1, 2, 3, 40]))]
             for _ in range(12)]
    flat = [w for t in texts for w in t]
    for n, (_, crcs) in enumerate(ngram_crcs(flat, np.array([len(t) for t in texts]), 4), 1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(t[i:i + n])) for t in texts for i in range(len(t) - n + 1)]


def plain_resample(rows, target, percent=5, seed=42, least=20):
    def bag(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bags = [bag(t) for _, t in rows]
    s, t = Counter(b for x in bags for b in x), Counter(b for x in target for b in bag(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (i, text), own in zip(rows, bags):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_matches_plain_python(spark, monkeypatch):
    monkeypatch.setattr(resample, "LOT", 7)
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(1, None), (2, ""), (3, "few words"), (None, " ".join(stock)), (4, "LONG Word, " * 3000)]
    rows += [(10 + i, rng.choice([" ", "--", "\n"]).join(rng.choice(stock) for _ in range(rng.randint(10, 60)))) for i in range(150)]
    rows += [(500, " ".join(stock[:30]))] * 40  # equal rows
    target = [" ".join(rng.choice(stock[:20]) for _ in range(40)) for _ in range(10)] + [None, ""]
    for percent in (5, 60, 100):
        got = resample.resample(docs_of(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs_of(spark, []), none).count() == 0
    rows = [(i, f"word{i} " * 30) for i in range(40)]
    assert sorted(map(tuple, resample.resample(docs_of(spark, rows), none).collect()), key=str) == plain_resample(rows, [])
    assert resample.draw(docs_of(spark, rows), none).count() == 2


# --- decontamination ---------------------------------------------------------------

def plain_hits(text, items, size=10):
    w = words(text)
    hit, found = set(), set()
    for item, own in items:
        own = words(own)
        if not own:
            continue
        n = min(size, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
        at = [i for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows]
        hit.update(k for i in at for k in range(i, i + n))
        if at and item is not None:
            found.add(str(item))
    return len(w), len(hit), hit, sorted(found)


@pytest.mark.parametrize("most_windows,most_bytes", [(decontaminate.MOST_WINDOWS, decontaminate.MOST_BYTES), (40, 10_000_000), (10_000, 2000)])
def test_decontamination_matches_plain_python(spark, most_windows, most_bytes):
    rng = random.Random(most_windows)
    stock = ["a", "b", "cé", "D", "9", "ä中"]

    def noise(n):
        return "".join(rng.choice(stock) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))

    items = [(i, noise(rng.randint(12, 30))) for i in range(8)] + [(20, "b D"), (21, "cé cé cé a"), (22, None), (23, "..."), (20, "9 9 9 9"),
                                                                  (None, "D D D D D")]
    rows = [(1, None), (2, ""), (3, "!?"), (4, "a"), (5, "b, d"), (5, "b, d"), (None, "b d"), (6, "z " * 5000 + items[0][1])]
    rows += [(10 + i, noise(rng.randint(0, 30)) + rng.choice(items[:8])[1] * rng.randint(0, 2) + noise(rng.randint(0, 30))) for i in range(60)]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n_words int")
    got = decontaminate.find(docs_of(spark, rows), bench, most_windows=most_windows, most_bytes=most_bytes).collect()
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[i].append(t)
    assert len(got) == len(rows)
    for r in got:
        for text in by_text[r.doc_id][:1]:
            n, n_hit, hit, found = plain_hits(text, items)
            assert (r.n_words, r.n_hit, r.item_ids) == (n, n_hit, found)
            at = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
            covered = {k for k, (a, b) in enumerate(at) if any(s.start <= a and b <= s.end for s in r.spans)}
            assert covered == hit


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.digest(docs_of(spark, [(1, "some words here"), (2, None)]), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(3, 0, 0, False), (0, 0, 0, False)]
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontaminate.digest(docs_of(spark, []), bench).count() == 0
