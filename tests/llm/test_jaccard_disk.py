"""What the Jaccard join puts on disk: sketches instead of texts, and no table or shuffle longer than it is read."""

import os
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_search_operators import docs_of, near_copies, plain_components
from veilspark.llm import jaccard
from veilspark.llm.common import written
from veilspark.session import ensure_checkpoint_dir


def text(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_sketches_differ_in_no_more_bits_than_their_sets_in_shingles():
    rng = random.Random(4)
    texts = [t.encode() for _, t in near_copies(3) if t] + [b"", b" "]
    texts += [text(rng, n).encode() for n in (1, 5, 36, 131, 900)]
    owner, hashes = jaccard.shingle_sets(texts)
    size = np.bincount(owner, minlength=len(texts))
    sketch = jaccard.sketches(owner, hashes, size)
    sets = [set(hashes[owner == i].tolist()) for i in range(len(texts))]
    apart = 0
    for i, a in enumerate(sets):
        assert len(sketch[i]) * 8 == max(64, 4 << (max(len(a), 1).bit_length() - 1))
        for j, b in enumerate(sets):
            bits = jaccard.bits_apart(sketch[i], sketch[j])
            assert bits == jaccard.bits_apart(sketch[j], sketch[i]) <= len(a ^ b)
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                assert jaccard.SHARE_DIFFERING * bits <= len(a) + len(b)
            elif len(a) > 50 and len(b) > 50 and not a & b:
                apart += jaccard.SHARE_DIFFERING * bits > len(a) + len(b)
    assert apart > 100  # sets with nothing in common are told apart


def test_only_texts_that_may_link_are_looked_up(spark, monkeypatch):
    tables = {}

    def counted(df, tag):
        out = written(df, tag)
        tables.setdefault(tag, []).append(out.count())
        assert tag == "texts" or "z" not in out.columns
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "SAMPLE_COUNT", 1000)  # the passage isn't known as common
    rng = random.Random(5)
    passage = text(rng, 60)
    rows = [(i, f"{text(rng, 60)} {passage} {text(rng, 60)}") for i in range(50)]
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1] + " at the end")]
    got = jaccard.components(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))
    assert tables["met"][0] > 100 and tables["sets"][0] > 40  # the passage's signatures meet
    assert sum(tables["texts"]) < 10 and sum(tables["star"] + tables["rest"]) < 10


def test_signatures_that_overlap_by_chance_make_no_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 20)
    chain = [(h, n, h * 19, n, 100) for h in range(20) for n in range(h * 19, h * 19 + 20)]
    large = spark.createDataFrame(chain, "hash long, node long, low long, component long, size long")
    sets = large.select("node", "size").distinct().withColumn("sketch", F.lit(bytes(64)))
    label = sets.select(F.col("node").alias("vertex"), F.col("node").alias("component"))
    assert jaccard._many(large, sets, label).count() == 400
    with_one_component = large.withColumn("component", F.lit(1).cast("long"))
    assert jaccard._many(with_one_component, sets, label).count() == 0
    lows_are_one = label.withColumn("component", F.when(F.col("vertex") % 19 == 0, 0).otherwise(F.col("vertex")).cast("long"))
    assert jaccard._many(large, sets, lows_are_one).select("cluster").distinct().count() == 1


def test_a_block_yields_a_forest_of_links():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        component = rng.permutation(np.repeat(np.arange(n), 3))
        x, y = (rng.integers(0, 3 * n, 2 * n) for _ in range(2))
        x, y = (z[component[x] != component[y]] for z in (x, y))

        def united(x, y):
            label = np.arange(n)
            for _ in range(n):
                for a, b in zip(component[x], component[y]):
                    label[[a, b]] = label[[a, b]].min()
            return label.tolist()

        kept = jaccard._forest(x, y, component, n)
        assert set(zip(*kept)) <= set(zip(x, y)) and len(kept[0]) == n - len(set(united(x, y)))
        assert united(*kept) == united(x, y)


@pytest.mark.parametrize("limit", [64, 8192])
def test_blocks_keep_nodes_whose_sketches_allow_a_link(monkeypatch, limit):
    import pandas as pd

    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", limit)
    texts = [t.encode() for _, t in near_copies(6) if t and t.strip()]
    owner, hashes = jaccard.shingle_sets(texts)
    size = np.bincount(owner, minlength=len(texts))
    sketch = jaccard.sketches(owner, hashes, size)
    n = len(texts)
    component = [i // 2 for i in range(n)]
    pdf = pd.DataFrame({"cluster": 0, "i": 0, "j": 0, "node": range(n), "component": component, "size": size, "sketch": sketch})
    want = [i for i in range(n) if any(
        component[i] != component[j] and 4 * min(size[i], size[j]) >= 3 * max(size[i], size[j])
        and 7 * jaccard.bits_apart(sketch[i], sketch[j]) <= size[i] + size[j] for j in range(n))]
    assert 0 < len(want) < n and jaccard._block_near(pdf)["node"].tolist() == want


def test_tables_and_shuffles_are_deleted(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        files = disk.getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {x for x in names if x.startswith("shuffle_")}

    def tables():
        return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))

    known, there = shuffle_files(), tables()
    rows = near_copies(7)
    kept = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    until = time.time() + 20
    while shuffle_files() - known and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files() - known and kept.count() == 7
    out = jaccard.components(docs_of(spark, rows))
    assert sorted(x.rsplit("-", 1)[0] for x in tables() - there) == ["llm-labels", "llm-members", "llm-test"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain_components(rows), key=str)


def test_the_pipelines_near_duplicate_stage_leaves_no_texts(spark):
    def tables():
        top = ensure_checkpoint_dir(spark).removeprefix("file:")
        return {f"{top}/{x}" for x in os.listdir(top)}

    there, rng = tables(), random.Random(8)
    texts = [text(rng, 200) for _ in range(60)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate([*texts, *(f"{t} more" for t in texts[:20])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(60)) and out.columns == docs.columns
    left = tables() - there
    assert left and all(not {"z", "text"} & set(spark.read.parquet(x).columns) for x in left)
    assert sum(f.stat().st_size for x in left for f in Path(x).rglob("*.parquet")) < sum(len(t) for _, t, *_ in rows) / 3
