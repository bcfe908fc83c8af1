"""The pipeline's stages, each held against plain Python on its own input, and the guard of the entry."""

import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from test_search_operators import plain_components
from test_text_operators import WORD, check_packing, plain_spans, plain_stats, plain_targets
from veilspark.llm import queries as llm_queries
from veilspark.llm.common import table, written

sys.path.insert(0, str(Path(corpus_pipeline.__file__).parent / "tools"))
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_match_plain_python(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), "test")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "quality_rules":
            labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
            stay = {i for i, _ in rows_of(docs)}
            for i, text in rows_of(before):
                n, _, _, _, rep = plain_stats(text)
                if n < 50 or 100 * rep > 50 * n:
                    assert i not in stay
                elif labels.get(i) == 1:
                    assert i in stay
        elif name == "near_duplicates":
            inputs = rows_of(before)
            want = {c for _, n, c in plain_components(inputs) if n}
            assert sorted(i for i, _ in rows_of(docs)) == sorted(want)
        elif name == "pii":
            source = dict(rows_of(before))
            for i, text in rows_of(docs):
                spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in plain_spans(source[i])))
                assert bool(spans) <= (text != source[i])
                for s, e in spans:
                    assert source[i][s:e] not in text
                assert plain_spans(re.sub(r"\[[A-Z_]+\]", " ", text)) == []
        elif name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before.collect():
                sizes[r.source] += len(WORD.findall(r.text or ""))
            copies = Counter(r.doc_id for r in docs.collect())
            largest = max(len(WORD.findall(r.text or "")) for r in before.collect())
            for r in docs.collect():
                taken[r.source] += len(WORD.findall(r.text or ""))
            assert max(copies.values()) <= 3
            for s, t in plain_targets(dict(sizes)).items():
                assert abs(taken[s] - t) <= largest
        else:
            # copies of a document are packed each: tell them apart by number
            pieces, turn = docs.collect(), Counter()
            text = dict(rows_of(before))
            copies = Counter(i for i, _ in rows_of(before))
            assert sum(p.length for p in pieces) == sum(n * next(p.doc_tokens for p in pieces if p.doc_id == i)
                                                        for i, n in copies.items())
            single = [(i, text[i]) for i, n in copies.items() if n == 1]
            check = [p for p in pieces if copies[p.doc_id] == 1]
            whole = defaultdict(int)
            for p in pieces:
                whole[p.sequence_id] += p.length
            assert max(whole.values()) <= 2048
            for i, t in single[:40]:
                mine = [p for p in check if p.doc_id == i]
                moved = [p.__class__(**{**p.asDict(), "sequence_id": k, "offset": 0}) for k, p in enumerate(mine)]
                check_packing([(i, t)], moved, 2048)
            del turn


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    info = compare(spark, duck(SF), name, llm_queries.queries()[name], llm_queries.oracle_sql()[name], SF)
    assert info["ok"] is True, info


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_entry_has_the_queries_and_works_without_these_folders(tmp_path):
    top = Path(corpus_pipeline.__file__).parent
    code = ("import __spark_entry__ as e; q = e.queries(); print(len([k for k in q if k.startswith('op')]), 'pipeline' in q,"
            " set(e.oracle_sql()) <= set(q))")
    got = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, check=True)
    assert got.stdout.split() == ["13", "True", "True"]
    bare = tmp_path / "bare"
    bare.mkdir()
    for item in top.iterdir():
        if item.name not in ("corpus_pipeline.py", "veilspark", "tests", ".git"):
            (bare / item.name).symlink_to(item)
    (bare / "veilspark").mkdir()
    for item in (top / "veilspark").iterdir():
        if item.name != "llm":
            (bare / "veilspark" / item.name).symlink_to(item)
    (bare / "__spark_entry__.py").unlink()
    (bare / "__spark_entry__.py").write_text((top / "__spark_entry__.py").read_text())
    got = subprocess.run([sys.executable, "-c", code], cwd=bare, capture_output=True, text=True, check=True)
    assert got.stdout.split() == ["0", "False", "True"]


def test_chunks_are_looked_up_once():
    import public_tokenizers

    from veilspark.llm.tokens import ChunkTokenizer

    class OnePass(dict):
        def keys(self):
            raise AssertionError("a set of all chunks is built beside the lookup")

    tok = ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    tok.chunks = OnePass()
    texts = ["The cat sat. The Cat", None, "", " two  blanks\nand a line, 你好 12 it's", "The cat <|endoftext|> sat"] * 2 + ["new here: cat"]
    for lot in (1, 3, 256):
        assert list(tok.encode_batch(texts, lot)) == [tok._raw(t or "") for t in texts]
