"""Compact graph statistics against brute-force pair enumeration."""

import math
from collections import Counter

import pytest

import brute
from veilspark.config import VeilConfig
from veilspark.functions.patterns import PatternRegistry
from veilspark.operators import analyze as A
from veilspark.operators import graph as G
from veilspark.operators.cells import to_cells
from veilspark.sources.tables import ADDRESS_PATTERN

ROWS = [
    (0, "John Smith", "john@example.com", "(555) 123-4567", "123-45-6789", "12 Oak Street 90210", "VIP"),
    (1, "Sarah", "sarah@test.org", "555.987.6543", "", "9 Elm Road", "call 555-222-3333 or a@b.io"),
    (2, "Mike", "", "", "987-65-4321", "", ""),
    (3, "", "", "", "", "", "zip 12345 ip 10.1.1.1"),
    (4, "", "", "", "", "77 Pine Avenue", ""),
    (5, "Lone", "", "", "", "", "nothing"),
]
COLS = ["name", "email", "phone", "ssn", "address", "notes"]


@pytest.fixture(scope="module")
def graph(spark):
    cfg = VeilConfig(registry=PatternRegistry.default().with_patterns([ADDRESS_PATTERN]))
    df = spark.createDataFrame(ROWS, "row_index long, " + ", ".join(f"{c} string" for c in COLS))
    framed = A.span_frame(to_cells(df, "row_index", COLS), cfg)
    ent = A.entities_from_spans(framed, cfg)
    edges = G.explicit_edges(A.proximity_pairs(framed, cfg, 100), cfg)
    rct = G.cell_type_counts(ent)
    rows = [r.asDict() for r in ent.orderBy("row_index", "column_ordinal", "span_ord").collect()]
    return cfg, ent, edges, rct, rows


def test_edge_counts_and_weights(graph):
    cfg, ent, edges, rct, rows = graph
    bf = brute.graph_edges(rows)
    tot = {r.edge_type: r for r in G.edge_class_totals(rct, edges, cfg).collect()}
    assert {k: v.cnt for k, v in tot.items()} == dict(Counter(t for t, _ in bf.values()))
    stats = G.edge_weight_stats(G.edge_class_totals(rct, edges, cfg)).first()
    ws = [w for _, w in bf.values()]
    mean = sum(ws) / len(ws)
    assert stats.total_edges == len(ws)
    assert math.isclose(stats.mean_weight, mean, abs_tol=1e-9)
    assert math.isclose(stats.std_weight, math.sqrt(sum((w - mean) ** 2 for w in ws) / len(ws)), abs_tol=1e-8)
    assert math.isclose(stats.min_weight, min(ws)) and math.isclose(stats.max_weight, max(ws))


def test_explicit_edges_match(graph):
    cfg, ent, edges, rct, rows = graph
    ids = [G_id(r) for r in rows]
    bf = brute.graph_edges(rows)
    exp = {(ids[i], ids[j]): t for (i, j), (t, _w) in bf.items() if t in ("proximity",)
           or (t == "semantic" and rows[i]["row_index"] == rows[j]["row_index"]
               and rows[i]["column_ordinal"] == rows[j]["column_ordinal"]
               and abs(rows[i]["start_pos"] - rows[j]["start_pos"]) <= 100)}
    got = {(e.src, e.dst): e.edge_type for e in edges.collect()}
    assert got == exp


def G_id(r):
    return f"{r['pii_type']}_{r['row_index']}_{r['column_ordinal']}_{r['span_ord']}"


def test_degree(graph):
    cfg, ent, edges, rct, rows = graph
    bf = brute.graph_edges(rows)
    deg = Counter()
    for i, j in bf:
        deg[i] += 1
        deg[j] += 1
    got = {r.node_id: (r.degree, r.degree_centrality) for r in G.degree_centrality(ent, rct, cfg).collect()}
    n = len(rows)
    for i, r in enumerate(rows):
        d, c = got[G_id(r)]
        assert d == deg[i]
        assert math.isclose(c, deg[i] / (n - 1), abs_tol=1e-9)


def test_components_and_clusters(graph):
    cfg, ent, edges, rct, rows = graph
    bf = brute.graph_edges(rows)
    labels = brute.components(len(rows), bf)
    membership, summary = G.components(ent, rct, cfg)
    got = {r.node_id: r.component_id for r in membership.collect()}
    ids = [G_id(r) for r in rows]
    for i in range(len(rows)):
        assert got[ids[i]] == ids[labels[i]]          # component id = its first node
    sizes = Counter(labels)
    order = sorted(set(labels))
    summ = {r.component_id: (r.size, r.cluster_rank) for r in summary.collect()}
    for rank, root in enumerate(order):
        assert summ[ids[root]] == (sizes[root], rank)
    level = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
    cl = {r.component_id: r for r in G.risk_clusters(ent, rct, cfg).collect()}
    for root in order:
        members = [rows[i] for i in range(len(rows)) if labels[i] == root]
        if len(members) < 2:
            assert ids[root] not in cl
            continue
        sc = [level[m["risk_level"]] for m in members]
        avg, mx = sum(sc) / len(sc), max(sc)
        div = len({m["pii_type"] for m in members}) / len(members)
        overall = min(1.0, 0.4 * avg + 0.3 * mx + 0.2 * div + 0.1 * min(1.0, len(members) / 5.0))
        c = cl[ids[root]]
        assert c.size == len(members)
        assert math.isclose(c.overall_risk, overall, abs_tol=1e-8)


def test_distributed_components_match_union_find(spark):
    from veilspark.operators.components import connected_components

    pairs = [(1, 2), (2, 3), (4, 5), (6, 6), (7, 3), (10, 11), (11, 12), (12, 10)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.vertex: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10}


def test_long_path_is_one_component(spark):
    from veilspark.operators.components import connected_components

    n = 300
    order = [(7 * i) % n for i in range(n)]  # neighbours are far apart in id order
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src long, dst long")
    got = connected_components(e).collect()
    assert len(got) == n and {r.component for r in got} == {0}


def test_pair_counts_do_not_overflow(spark):
    big = 10_000_000_000
    rct = spark.createDataFrame([(0, 0, "email_address", big), (0, 1, "person_name", big + 1)],
                                "row_index long, column_ordinal int, pii_type string, n long")
    got = {r.column_ordinal: int(r.column_edges) for r in G.column_edge_counts(rct).collect()}
    assert got == {}  # every pair of a column is in its row here
    sem = {(r.type_a, r.type_b): int(r.edges) for r in G.semantic_edge_counts(rct).collect()}
    assert sem == {("email_address", "person_name"): big * (big + 1)}
    split = spark.createDataFrame([(0, 0, "zip_code", big), (1, 0, "zip_code", big + 3)],
                                  "row_index long, column_ordinal int, pii_type string, n long")
    assert [int(r.column_edges) for r in G.column_edge_counts(split).collect()] == [big * (big + 3)]


def test_empty_graph(spark):
    cfg = VeilConfig()
    df = spark.createDataFrame([(0, "nothing here")], "row_index long, text string")
    framed = A.span_frame(to_cells(df, "row_index", ["text"]), cfg)
    ent = A.entities_from_spans(framed, cfg)
    rct = G.cell_type_counts(ent)
    edges = G.explicit_edges(A.proximity_pairs(framed, cfg, 100), cfg)
    assert G.edge_class_totals(rct, edges, cfg).count() == 0
    assert G.risk_clusters(ent, rct, cfg).count() == 0


def test_eigenvector_matches_power_iteration(graph):
    cfg, ent, edges, rct, rows = graph
    bf = brute.graph_edges(rows)
    n = len(rows)
    nbrs = [[] for _ in range(n)]
    for i, j in bf:
        nbrs[i].append(j)
        nbrs[j].append(i)
    x = [1.0 / n] * n
    for _ in range(1000):
        last = x
        x = list(last)
        for v in range(n):
            for u in nbrs[v]:
                x[u] += last[v]
        norm = math.sqrt(sum(z * z for z in x)) or 1.0
        x = [z / norm for z in x]
        if sum(abs(a - b) for a, b in zip(x, last)) < n * 1e-6:
            break
    got = {r.node_id: r.eigenvector_centrality for r in G.eigenvector_centrality(ent, rct, cfg).collect()}
    for i, r in enumerate(rows):
        assert math.isclose(got[G_id(r)], x[i], abs_tol=1e-6)


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(spark, rows):
    return spark.createDataFrame(rows, "row_index long, column_ordinal int, pii_type string, n long")


def test_column_edges_are_counted_without_a_join(graph, spark):
    cfg, ent, edges, rct, rows = graph
    ids = {i: r["column_ordinal"] for i, r in enumerate(rows)}
    exp = Counter(ids[i] for (i, _j), (t, _w) in brute.graph_edges(rows).items() if t == "column_co_occurrence")
    got = G.column_edge_counts(rct, cfg)
    assert {r.column_ordinal: int(r.column_edges) for r in got.collect()} == exp
    # a join of the counts was a broadcast through the driver: their compressed files look small
    assert "Join" not in _executed(got)
    # keys that repeat, and a key that is null
    cells = [(0, 0, "email_address", 1), (0, 0, "email_address", 1), (0, 0, "person_name", 1), (1, 0, "person_name", 2),
             (None, 0, "zip_code", 1)]
    # 15 pairs of 6, less 2 * 3 semantic and the 3 - 2 and 1 others in one cell
    assert [int(r.column_edges) for r in G.column_edge_counts(_counted(spark, cells)).collect()] == [15 - 6 - 1 - 1]


def test_degrees_never_broadcast_the_entities(graph):
    cfg, ent, edges, rct, rows = graph
    plan = _executed(G.degree_centrality(ent, rct, cfg))
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan  # the one: columns times types rows


def test_whole_graph_broadcasts_types_only(graph):
    cfg, ent, edges, rct, rows = graph
    bf = brute.graph_edges(rows)
    pairs = A.proximity_pairs(A.skeleton(ent_frame(graph)), cfg, cfg.graph_window)
    whole = G.graph_edges(pairs, rct, cfg)
    got = Counter()
    for r in whole.collect():
        got[r.edge_type] += int(r.edges)
    assert got == Counter(t for t, _w in bf.values())
    joined = [line for line in _executed(whole).splitlines() if "Join" in line]
    assert joined and all("type_" in line or "a#" in line or "b#" in line for line in joined)
    assert not any("row_index" in line or "column_ordinal" in line for line in joined)


def ent_frame(graph):
    cfg, ent, *_ = graph
    df = ent.sparkSession.createDataFrame(ROWS, "row_index long, " + ", ".join(f"{c} string" for c in COLS))
    return A.span_frame(to_cells(df, "row_index", COLS), cfg)


def test_row_edges_take_one_aggregation(graph, spark):
    cfg, ent, edges, rct, rows = graph
    exp = Counter(rows[i]["row_index"] for (i, _j), (t, _w) in brute.graph_edges(rows).items() if t == "row_co_occurrence")
    got = G.row_edge_counts(rct, edges, cfg)
    assert {r.row_index: int(r.row_edges) for r in got.collect()} == exp
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sum(line.lstrip(" :+-").startswith("Aggregate [row_index") for line in plan.splitlines()) <= 2
    counts = _counted(spark, [(7, 0, "email_address", 1), (7, 1, "person_name", 2), (7, 1, "person_name", 1), (None, 0, "zip_code", 3)])
    none = edges.where("false")
    assert {r.row_index: int(r.row_edges) for r in G.row_edge_counts(counts, none).collect()} == {7: 6 - 3, None: 3}
