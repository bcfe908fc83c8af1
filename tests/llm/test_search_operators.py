"""Repeated passages, Jaccard join, nearest neighbours, chat formatting and licences against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import ann, chat, jaccard, licenses, suffix_dedup
from veilspark.llm.chat_template import TemplateError, compile_template, fold, parse
from veilspark.llm.queries import op7_license_scans

DOCS = "doc_id long, text string, key long, hash string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(parts)


# --- repeated passages -------------------------------------------------------

def plain_removal(rows, depth):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + depth] for t in texts for p in range(len(t) - depth + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone, upto = bytearray(len(t)), 0
        for p in range(len(t) - depth + 1):
            if seen[t[p:p + depth]] > 1:
                for x in range(max(p, upto), p + depth):
                    gone[x] = 1
                upto = p + depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for x, g in enumerate(gone) if g and not (x and gone[x - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth,digit", [(200, 100), (30, 12)])
def test_repeated_passages_match_plain_python(spark, depth, digit, monkeypatch):
    rng = random.Random(depth)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    long, short, line = noise(500), noise(depth - 10), noise(depth + 30)
    rows = [(1, None), (2, ""), (3, noise(100) + long + noise(50)), (4, long), (5, noise(33) + long[100:400] + noise(9)),
            (6, short + noise(5)), (7, noise(5) + short), (8, line + noise(3) + line), (9, "a" * 1000), (10, "ab" * 400),
            (11, "a" * (depth - 1)), (12, "x" * depth), (13, "x" * depth), (16, long), (16, long), (None, line)]
    rows += [(100 + i, long[:i] + noise(60) + long[i:]) for i in range(0, 500, 61)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), depth, digit).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(rows, depth)


def test_known_blocks_spread_over_the_buckets(spark):
    from veilspark.llm import sieve

    def one_lot(batches):
        for _ in batches:
            pass
        hashes = np.array([7, 7, 9], np.uint64)
        yield from sieve.blocks([(hashes, np.zeros(3, np.uint16), np.array([1, 2, 3]))], 64)

    known = spark.range(0, 200, 1, 200).mapInArrow(one_lot, sieve.BLOCKS).where("known = 1").groupBy("part").count().collect()
    assert sum(r["count"] for r in known) == 200
    assert len(known) > 40 and max(r["count"] for r in known) < 20


def test_a_row_repeated_in_many_tasks_keeps_short_lists(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    df = spark.createDataFrame([(1, text)] * 600, "doc_id long, text string").repartition(60)
    rows = suffix_dedup.remove_repeats(df).collect()
    assert len(rows) == 600 and {(r.n_bytes, r.n_removed, r.n_spans) for r in rows} == {(3000, 3000, 1)}


def test_long_texts_are_cut_into_overlapping_segments():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(3 * suffix_dedup.SEGMENT // 2))
    parts = list(suffix_dedup._segments(text, 200))
    starts = [at + p for at, part in parts for p in (0, len(part) - 200)]
    assert starts == [0, suffix_dedup.SEGMENT - 1, suffix_dedup.SEGMENT, len(text) - 200]


def test_no_documents_no_rows(spark):
    empty = docs_of(spark, [(1, "x")]).where("false")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


# --- Jaccard join ------------------------------------------------------------

def plain_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def plain_components(rows):
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "one two three four five"), (7, "one two three four five"),
            (7, "x y z"), (None, "a b"), (None, "lone text here"), (9, "é É é")]
    for n in [*range(1, 40, 2), 60, 100, 300, 700]:
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(6):
            text = base[:]
            for _ in range(rng.randint(0, max(1, n // 12))):
                text[rng.randrange(n)] = rng.choice(words)
            if rng.random() < 0.4:
                text = text[:max(1, int(n * rng.uniform(0.7, 1)))]
            rows.append((100 + len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("scheme", ["cheapest", "deletions"])
def test_components_match_all_pairs(spark, scheme):
    def forced(band):
        return "deletions", jaccard.most_differing((2 << band) - 1, band) // 2 + 1

    rows = near_copies(1)
    got = jaccard.components(docs_of(spark, rows), schemes=forced if scheme == "deletions" else None).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_components(rows), key=str)


def test_large_signatures_are_compared_by_blocks(spark, monkeypatch):
    """Many near copies around the threshold: neither one component nor none."""
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 2)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        text = base[:]
        for _ in range(rng.randint(2, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    want = plain_components(rows)
    assert 1 < len({c for *_, c in want}) < 120
    assert sorted(map(tuple, jaccard.components(docs_of(spark, rows)).collect())) == sorted(want)


def test_one_document_of_each_component_stays(spark):
    rows = near_copies(2)
    out = jaccard.keep_one(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "hash"]
    got = [r.doc_id for r in out.collect()]
    want = plain_components(rows)
    named = {c for _, n, c in want if n and c is not None}
    assert sorted(d for d in got if d is not None and d not in (2, 3, 1)) == sorted(named - {None})
    assert {1, 2, 3} <= set(got)
    named = docs_of(spark, rows).withColumn("_rid", F.lit("mine"))
    kept = jaccard.keep_one(named)
    assert kept.columns == named.columns and {r["_rid"] for r in kept.collect()} == {"mine"}


def test_most_differing_bounds_every_linked_pair():
    for a in range(1, 200):
        for b in range(a, a * 4 // 3 + 1):
            band = b.bit_length() - 1
            needed = -(-3 * (a + b) // 7)
            assert band in jaccard.bands(a) and band in jaccard.bands(b)
            assert a + b - 2 * needed <= min(jaccard.most_differing(a, band), jaccard.most_differing(b, band))


# --- nearest neighbours ------------------------------------------------------

def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(900)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] * 8), (1400, [1.0]), (None, same),
           (1600, [float("inf")] * 8), (1700, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    vectors = np.array([v for _, v in rows])
    assert set(got) == {i for i in range(0, 900, 100)}
    hits = 0
    for q in got:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(900) if i != q)[:10]
        found = [got[q][i] for i in range(1, 11)]
        assert found == sorted(found) and all(s == d[i] for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_recall_with_skipped_cells(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((6400, 16))
    cells = round(math.sqrt(len(v)) / 4)
    centres = ann.fit_centres(v, cells)
    counts = np.bincount(ann.nearest_cells(v, centres, 1)[:, 0], minlength=cells)
    assert not ann.probed(v[::100], centres, counts, ann.PROBE_SHARE, ann.K).all(axis=1).any()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = Counter()
    for r in ann.neighbours(df).collect():
        d = np.sqrt(((v - v[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        assert math.isclose(r.score, d[r.vec_id])
        got[r.query_id] += r.vec_id in np.argsort(d)[:10]
    assert set(got) == set(range(0, 6400, 100)) and sum(got.values()) >= 0.95 * 10 * 64


def test_every_row_of_a_repeated_id_is_answered(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100, rng.standard_normal(8).tolist()) for _ in range(3)] + [(100, rows[5][1])] * 2 + [(5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, share=1.0).collect())
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((math.sqrt(((np.array(v) - np.array(x)) ** 2).sum()), j) for k, (j, x) in enumerate(rows) if k != i)[:10]
            want.update((q, n, j, d) for n, (d, j) in enumerate(near, 1))
    assert got == want and sum(got.values()) == 10 * 6


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in ann.neighbours(df).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ann.neighbours(df.where("false")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centres, turn = ann.fit_centres(v, 10), ann.rotation(64)
    cell = ann.nearest_cells(v, centres, 1)[:, 0]
    low, high = ann.bounds(*ann.encode(v, centres, cell, turn), cell, q, centres, turn, 3.0)
    d = ((v[:, None] - q[None]) ** 2).sum(2)
    assert ((low <= d) & (d <= high)).mean() > 0.98


# --- chat formatting ---------------------------------------------------------

def test_round_trip_with_control_strings(spark):
    rows = [(1, 0, "system", "be <|im_start|>kind"), (1, 1, "user", "<|"), (1, 2, "assistant", "a<\\|b<\\\\|c\n"),
            (2, 0, "assistant", None), (2, 1, "as\nsist\\n<|im_end|>", "x"), (None, None, None, None), (3, 1, "user", "late"),
            (3, 0, "assistant", "é" * 5000), (3, 1, "user", "late"), (4, 0, "user", "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


def test_escapes_reverse():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("<\\|\nna") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_line(chat.escape_line(text)) == text and "\n" not in chat.escape_line(text)


def test_template_folds_constants_and_is_sandboxed():
    tree = fold(parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}{{ 'd' }}{% endif %}", chat.FILTERS), chat.FILTERS)
    assert len(tree) == 1 and tree[0].expr.value == "abCd"
    source = ("<{% for m in messages %}{{ loop.index }}{% if not loop.last and m.role != 'x' %}{% generation %}{{ m.content }}"
              "{% endgeneration %},{% elif loop.first %}?{% endif %}{% endfor %}>{# note #}")
    got = list(compile_template(source, chat.FILTERS).stream(iter([{"role": "u", "content": "hi"}, {"role": "x", "content": "no"}])))
    assert "".join(t for t, _ in got) == "<1hi,2>" and got[1][1] == [(1, 3)]
    for bad in ("{{ m.__class__ }}", "{{ open('x') }}", "{% for m in files %}{% endfor %}", "{{ x | nosuch }}", "{% if 1 %}",
                "{{ 'a' 'b' }}", "{% include x %}"):
        with pytest.raises(TemplateError):
            compile_template(bad, chat.FILTERS)


# --- licences ----------------------------------------------------------------

def test_licences_and_inheritance(spark):
    files = [(1, "p/LICENSE", True, "Released under the MIT License."), (2, "p/q/a.txt", False, "prose. nothing here"),
             (3, "p/q/r/b.txt", False, "Intro.\nLicensed under the Apache License, Version 2.0. more"), (4, "p/q/r/LICENSE", True,
             "x\nThis work is licensed under the GNU General Public License, version 3."), (5, "p/q/r/s/c.txt", False, None),
             (6, "z/d.txt", False, ""), (7, None, False, "Released under the MIT License."), (8, "p/q/copyright.txt", False,
             "A licensed driver took the long way home through quite another town.")]
    df = spark.createDataFrame([(*f, "u") for f in files], "file_id long, path string, is_licence_file boolean, text string, unit string")
    got = {r.file_id: r for r in licenses.scan(df, licenses.default_templates(spark)).collect()}
    assert {i: got[i].license for i in got} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: None, 7: "MIT",
                                                8: "MIT"}
    assert got[2].inherited_from == "p/" and got[5].inherited_from == "p/q/r/" and got[3].inherited_from is None
    assert math.isclose(got[1].own_cosine, 1.0) and got[8].own_license is None
    assert licenses.scan(df.where("false"), licenses.default_templates(spark)).count() == 0


def test_licences_without_a_cue_word(spark):
    mit = ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated '
           'documentation files (the "Software"), to deal')
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    prose = "The river ran past the old mill. Nobody had been there all week, or reserved a boat."
    files = [(1, "a/x.txt", False, "Intro here. All rights reserved."), (2, "b/x.txt", False, f"{prose}\n{mit}"),
             (3, "c/LICENSE", True, f"Copyright 2020 Some One. All rights reserved.\n\n{bsd}"), (4, "c/d/x.txt", False, prose),
             (5, "c/y.txt", False, "All rights reserved."), (6, "e/x.txt", False, prose)]
    df = spark.createDataFrame(files, "file_id long, path string, is_licence_file boolean, text string")
    got = {r.file_id: r for r in licenses.scan(df, licenses.default_templates(spark)).collect()}
    assert {i: got[i].own_license for i in got} == {1: "proprietary", 2: "MIT", 3: "BSD-family", 4: None, 5: "proprietary", 6: None}
    assert (got[4].license, got[4].inherited_from, got[5].inherited_from) == ("BSD-family", "c/", None)
    assert got[1].n_candidates == 1 and got[3].n_candidates >= 2 and got[6].n_candidates == 0


def plain_licences(files, templates, least):
    """Every sentence of every file against every template, no filter; folders walked up one by one."""
    words = [(i, p, lf, [Counter(re.findall(licenses.TOKEN, u.lower())) for u in re.split(licenses.SENTENCE_END, t)]
              if t is not None else []) for i, p, lf, t in files]
    total, df = sum(len(us) for *_, us in words), Counter(k for *_, us in words for u in us for k in u)

    def unit(tf):
        w = {k: n * (math.log((1 + total) / (1 + df[k])) + 1) for k, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {k: x / norm for k, x in w.items()} if norm else {}

    models = [(name, unit(Counter(re.findall(licenses.TOKEN, t.lower())))) for name, t in templates]
    own, held = {}, {}
    for i, p, lf, us in words:
        hits = []
        for u in map(unit, us):
            best = min((-round(sum(x * m[k] for k, x in u.items() if k in m), 9), name) for name, m in models)
            if -best[0] >= least:
                hits.append((best[1] == licenses.RESERVED, *best))
        own[i] = (len(hits), min(hits)[1:] if hits else None)
        if lf and hits:
            folder = p[:p.rindex("/") + 1]
            held[folder] = min(held.get(folder, (1.0, "", "")), (*own[i][1], p))
    out = {}
    for i, p, *_ in words:
        n, best = own[i]
        up = [p[:k + 1] for k, c in enumerate(p) if c == "/"] if best is None else []
        near = max((f for f in up if f in held), key=len, default=None)
        out[i] = (n, best and best[1], near, best[1] if best else held[near][1] if near else None)
    return out


def test_licence_query_matches_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    files = [tuple(r) for r in licenses.document_files(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    got = {r.doc_id: (r.n_candidates, r.own_license, r.inherited_from, r.license)
           for r in op7_license_scans(spark, sf).collect()}
    assert got == plain_licences(files, licenses.TEMPLATES, licenses.LEAST_COSINE)
    assert sum(r[1] == "proprietary" for r in got.values()) == 3
