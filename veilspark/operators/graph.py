"""Entity graph over analysed entities, kept in compact form.

Edge classes (same precedence as the reference: a semantic edge overwrites
a proximity edge, row and column co-occurrence only fill missing edges):

* proximity   pairs in one cell whose starts are <= 100 apart (explicit rows)
* semantic    every pair of entities whose types are a semantic pair
* row         every other pair in one row         (weight 0.3)
* column      every other pair in one column      (weight 0.2)

Semantic, row and column edges form cliques/bicliques over whole rows,
columns and types.  Listing them pair by pair is quadratic in the data (a
column of a billion entities would hold 5e17 edges), so they are never
materialised: edge counts, weight moments, degrees and connected
components are computed exactly from grouped counts, and only the bounded
proximity pairs are explicit rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions import risk as R
from ..functions.patterns import (
    CLUSTER_SIZE_NORM,
    CLUSTER_WEIGHTS,
    COLUMN_EDGE_WEIGHT,
    NODE_TEXT_LEN,
    ROW_EDGE_WEIGHT,
    semantic_entries,
)
from ..session import materialize
from .components import connected_components

STATS_DIGITS = 9


def node_id(t, r, c, o):
    return F.concat_ws("_", t, r.cast("string"), c.cast("string"), o.cast("string"))


def nodes(ent: DataFrame) -> DataFrame:
    """One node per entity; id ``<type>_<row>_<column ordinal>_<span ordinal>``."""
    return ent.select(
        node_id(F.col("pii_type"), F.col("row_index"), F.col("column_ordinal"), F.col("span_ord")).alias("node_id"),
        "pii_type",
        F.substring("text", 1, NODE_TEXT_LEN).alias("text"),
        "confidence", "risk_level", "row_index", "column_ordinal", "column_name", "span_ord", "detection_method",
    )


def _typed_edges(pairs: DataFrame, cfg: VeilConfig) -> DataFrame:
    w_prox = F.greatest(F.lit(0.1), F.lit(1.0) - F.col("distance") / F.lit(float(cfg.graph_window)))
    sem = R.semantic_weight(F.col("src_type"), F.col("dst_type"))
    is_sem = sem.isNotNull() & (sem >= cfg.min_edge_weight)
    return (
        pairs.where(w_prox >= cfg.min_edge_weight)
        .select(
            node_id(F.col("src_type"), F.col("row_index"), F.col("column_ordinal"), F.col("src_ord")).alias("src"),
            node_id(F.col("dst_type"), F.col("row_index"), F.col("column_ordinal"), F.col("dst_ord")).alias("dst"),
            F.when(is_sem, sem).otherwise(w_prox).alias("weight"),
            F.when(is_sem, F.lit("semantic")).otherwise(F.lit("proximity")).alias("edge_type"),
            F.col("distance").cast("int").alias("distance"),
            "row_index", "column_ordinal",
            F.least("src_type", "dst_type").alias("type_a"), F.greatest("src_type", "dst_type").alias("type_b"),
        )
    )


def explicit_edges(pairs: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Proximity pairs as edges, with the semantic overwrite applied
    (weight and type replaced, distance kept)."""
    return _typed_edges(pairs, cfg).drop("type_a", "type_b")


def graph_edges(pairs: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """The whole graph in one frame: ``src, dst, edge_type, weight, distance, edges``.

    Pairs in proximity are rows of their own (``edges`` 1).  The other edges
    form cliques of a row or column and bicliques of two types; each is one
    hub row with its number of edges after precedence (semantic, proximity,
    row, column), so that every edge of the graph is counted exactly once.
    """
    near = _typed_edges(pairs, cfg)
    listed = near.select("src", "dst", "edge_type", "weight", "distance", F.lit(1).cast(BIG).alias("edges"))

    def hubs(frame, a, b, edge_type, weight, count):
        return frame.select(a.alias("src"), b.alias("dst"), F.lit(edge_type).alias("edge_type"), weight.alias("weight"),
                            F.lit(None).cast("int").alias("distance"), count.cast(BIG).alias("edges"))

    row = F.concat(F.lit("row_"), F.col("row_index").cast("string"))
    column = F.concat(F.lit("column_"), F.col("column_ordinal").cast("string"))
    # semantic pairs that are listed already are taken from their types' hub
    seen = near.where(F.col("edge_type") == "semantic").groupBy("type_a", "type_b").agg(F.count("*").alias("seen"))
    semantic = semantic_edge_counts(rct, cfg).join(F.broadcast(seen), ["type_a", "type_b"], "left").withColumn(
        "left", (F.col("edges") - F.coalesce("seen", F.lit(0))).cast(BIG))
    return (listed
            .unionByName(hubs(semantic.where(F.col("left") > 0), F.concat(F.lit("type_"), F.col("type_a")),
                              F.concat(F.lit("type_"), F.col("type_b")), "semantic", F.col("weight"), F.col("left")))
            .unionByName(hubs(row_edge_counts(rct, near, cfg), row, row, "row_co_occurrence", F.lit(ROW_EDGE_WEIGHT),
                              F.col("row_edges")))
            .unionByName(hubs(column_edge_counts(rct, cfg), column, column, "column_co_occurrence",
                              F.lit(COLUMN_EDGE_WEIGHT), F.col("column_edges"))))


def cell_type_counts(ent: DataFrame) -> DataFrame:
    """``row_index, column_ordinal, pii_type, n``: the only input the count
    formulas and the hub graph need (far smaller than the entity table)."""
    return ent.groupBy("row_index", "column_ordinal", "pii_type").agg(F.count(F.lit(1)).alias("n"))


def span_type_counts(framed: DataFrame) -> DataFrame:
    """Same counts cell by cell, without a shuffle: keys repeat if several cells have one row and column."""
    counted = F.expr("transform(array_distinct(spans.pii_type), t -> named_struct('pii_type', t, 'n', "
                     "CAST(size(filter(spans.pii_type, x -> x = t)) AS BIGINT)))")
    return framed.select("row_index", "column_ordinal", F.inline(counted))


def row_vectors(rct: DataFrame) -> DataFrame:
    """``row_index, items``: a row's counts by column and type, sorted.

    ``rct`` may hold a key several times.  One exchange by row serves both
    aggregations; a row has at most columns times types items."""
    merged = rct.repartition("row_index").groupBy("row_index", "column_ordinal", "pii_type").agg(F.sum("n").alias("n"))
    item = F.struct(F.col("column_ordinal").alias("c"), F.col("pii_type").alias("t"), "n")
    return merged.groupBy("row_index").agg(F.array_sort(F.collect_list(item)).alias("items"))


def row_patterns(vectors: DataFrame) -> DataFrame:
    """``items, rows``: the distinct row vectors and how many rows have each.

    Rows with the same vector are alike in everything the graph's totals,
    components and centralities ask for, so these work on patterns.  The
    table is written: it is read several times."""
    return materialize(vectors.groupBy("items").agg(F.count(F.lit(1)).alias("rows")), "patterns")


def column_totals(patterns: DataFrame) -> DataFrame:
    """``c, t, n``: entities by column and type (at most columns times types rows)."""
    each = patterns.select("rows", F.inline("items"))
    return each.groupBy("c", "t").agg(F.sum(F.col("n") * F.col("rows")).alias("n"))


def _partners_sql(t: str, min_w: float) -> str:
    """SQL text: the types that ``t`` has a semantic edge to."""
    from ..functions.spans import sql_str

    others: dict[str, list[str]] = {}
    for a, b, w in semantic_entries():
        if w >= min_w:
            others.setdefault(a, []).append(b)
            others.setdefault(b, []).append(a)
    none = "cast(array() as array<string>)"
    cases = " ".join(f"WHEN {sql_str(a)} THEN array({', '.join(map(sql_str, bs))})" for a, bs in sorted(others.items()))
    return f"CASE {t} {cases} ELSE {none} END" if cases else none


def cell_type_counts_from_spans(framed: DataFrame) -> DataFrame:
    """Same counts straight from the span frame (``row_index, column_ordinal,
    spans``): only the span types are needed, not the risk analysis."""
    return (framed.select("row_index", "column_ordinal", F.explode("spans.pii_type").alias("pii_type"))
            .groupBy("row_index", "column_ordinal", "pii_type").agg(F.count(F.lit(1)).alias("n")))


def _semantic_pairs(spark: SparkSession, min_w: float) -> DataFrame:
    rows = [(a, b, float(w)) for a, b, w in semantic_entries() if w >= min_w]
    return spark.createDataFrame(rows, "a string, b string, w double")


def _semantic_terms(items, min_w: float) -> dict:
    """Semantic pair count and weight moments inside one group, from its
    per-type counts ``items`` (array<struct<t, n>>, a column reference):
    sum over the (constant) semantic pairs of n_A * n_B.  Built as SQL text."""
    from ..functions.spans import _var, sql_of, sql_str

    it = sql_of(items)

    def count(t):
        a, x = _var("a"), _var("x")
        return (f"CAST(aggregate(filter({it}, {x} -> {x}.t = {sql_str(t)}), 0L, ({a}, {x}) -> {a} + {x}.n) "
                f"AS DECIMAL(19,0))")

    ks, ws = [], []
    for a, b, w in semantic_entries():
        if w >= min_w:
            ks.append(f"CAST({count(a)} * {count(b)} AS DECIMAL(38,0))")
            ws.append(float(w))
    if not ks:
        return {"cnt": F.lit(0).cast("decimal(38,0)"), "sw": F.lit(0.0), "sw2": F.lit(0.0),
                "wmin": F.lit(None).cast("double"), "wmax": F.lit(None).cast("double")}
    # bind every pair count once: k_i are fields of one struct
    v = _var("v")
    packed = "named_struct(" + ", ".join(f"'k{i}', {k}" for i, k in enumerate(ks)) + ")"

    def over(body):
        return F.expr(f"element_at(transform(array({packed}), {v} -> {body}), 1)")

    cnt = " + ".join(f"{v}.k{i}" for i in range(len(ks)))
    sw = " + ".join(f"{v}.k{i} * {w!r}D" for i, w in enumerate(ws))
    sw2 = " + ".join(f"{v}.k{i} * {w * w!r}D" for i, w in enumerate(ws))
    wlist = ", ".join(f"CASE WHEN {v}.k{i} > 0 THEN {w!r}D END" for i, w in enumerate(ws))
    pick = (lambda fn: f"{fn}({wlist})") if len(ws) > 1 else (lambda fn: wlist)
    return {"cnt": over(cnt), "sw": over(sw), "sw2": over(sw2), "wmin": over(pick("least")),
            "wmax": over(pick("greatest"))}


BIG = "decimal(38,0)"


def _big(n):
    """A count as an exact decimal, so that products of counts cannot overflow."""
    return n.cast("decimal(19,0)")


def _pairs(n):
    """``n * (n - 1) / 2``, exact: the even factor is halved before multiplying."""
    even = n.bitwiseAND(F.lit(1).cast("long")) == 0
    return F.when(even, _big(F.shiftright(n, 1)) * _big(n - 1)).otherwise(
        _big(n) * _big(F.shiftright(n - 1, 1))).cast(BIG)


def edge_class_totals(rct: DataFrame, edges: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """``edge_type, cnt, sw, sw2, wmin, wmax`` per edge class, exact, from
    grouped counts ``rct`` (no pair listing).

    One exchange by row gives the row patterns; row pairs, cell pairs and
    their semantic parts are sums over patterns, column pairs and global
    semantic pairs over the column totals (columns times types rows).
    """
    mw = cfg.min_edge_weight
    patterns = row_patterns(row_vectors(rct))
    n = F.expr("aggregate(items, 0L, (a, x) -> a + x.n)")
    none = {"sw": F.lit(None).cast("double"), "sw2": F.lit(None).cast("double"), "wmin": F.lit(None).cast("double"),
            "wmax": F.lit(None).cast("double")}

    def level(name, frame, times=None):
        """Pairs and semantic pairs of a frame with ``items``, summed."""
        terms = _semantic_terms(F.col("items"), mw)
        times = F.lit(1) if times is None else F.col(times)
        return (frame.select((_pairs(n) * _big(times)).cast(BIG).alias("p"), (terms["cnt"] * _big(times)).cast(BIG).alias("s"))
                .agg(F.coalesce(F.sum("p"), F.lit(0)).cast(BIG).alias("pairs"), F.coalesce(F.sum("s"), F.lit(0)).cast(BIG).alias("sem"))
                .select(F.lit(name).alias("level"), "pairs", "sem", *[v.alias(k) for k, v in none.items()]))

    cells = patterns.select("rows", F.inline(F.expr(
        "transform(array_distinct(transform(items, x -> x.c)), k -> named_struct('c', k, 'items', filter(items, x -> x.c = k)))")))
    totals = column_totals(patterns)
    item = F.struct("t", "n")
    columns = totals.groupBy("c").agg(F.collect_list(item).alias("items"))
    all_types = totals.groupBy("t").agg(F.sum("n").alias("n")).agg(F.collect_list(item).alias("items"))
    gs = _semantic_terms(F.col("items"), mw)
    parts = (level("row", patterns, "rows").unionByName(level("cell", cells, "rows")).unionByName(level("column", columns))
             .unionByName(all_types.select(F.lit("all").alias("level"), F.lit(0).cast(BIG).alias("pairs"), gs["cnt"].cast(BIG).alias("sem"),
                                           *[gs[k].alias(k) for k in none]))
             .unionByName(edges.where(F.col("edge_type") == "proximity").agg(
                 F.count(F.lit(1)).cast(BIG).alias("pairs"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("sw"),
                 F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("sw2"),
                 F.min("weight").alias("wmin"), F.max("weight").alias("wmax"),
             ).select(F.lit("near").alias("level"), "pairs", F.lit(0).cast(BIG).alias("sem"), *none)))

    def of(name, column):
        return F.max(F.when(F.col("level") == name, F.col(column)))

    one = parts.agg(
        (of("row", "pairs") - of("row", "sem") - of("near", "pairs")).cast(BIG).alias("in_rows"),
        (of("column", "pairs") - of("column", "sem") - of("cell", "pairs") + of("cell", "sem")).cast(BIG).alias("in_columns"),
        *[of(name, k).alias(f"{name}_{k}") for name in ("all", "near") for k in ("pairs", "sem", *none)])

    def given(edge_type, count, name):
        return F.struct(F.lit(edge_type).alias("edge_type"), F.col(count).alias("cnt"), *[F.col(f"{name}_{k}").alias(k) for k in none])

    def constant(edge_type, count, w):
        return F.struct(F.lit(edge_type).alias("edge_type"), F.col(count).alias("cnt"), (F.lit(w) * F.col(count)).alias("sw"),
                        (F.lit(w * w) * F.col(count)).alias("sw2"), F.lit(w).alias("wmin"), F.lit(w).alias("wmax"))

    return one.select(F.inline(F.array(
        given("semantic", "all_sem", "all"), given("proximity", "near_pairs", "near"),
        constant("row_co_occurrence", "in_rows", ROW_EDGE_WEIGHT),
        constant("column_co_occurrence", "in_columns", COLUMN_EDGE_WEIGHT)))).where(F.col("cnt") > 0)


def edge_type_counts(totals: DataFrame) -> DataFrame:
    return totals.select("edge_type", F.col("cnt").alias("count"))


def edge_weight_stats(totals: DataFrame) -> DataFrame:
    """Mean, population std, min and max of all edge weights."""
    # centred: squared deviations inside each class plus those of the class means
    n = F.col("cnt").cast("double")
    mine = F.col("sw") / n
    inside = F.when(F.col("wmin") == F.col("wmax"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("sw2") - F.col("sw") * mine))
    overall = totals.agg(F.sum("sw") / F.sum(n)).scalar()
    agg = totals.agg(
        F.sum("cnt").alias("m"), F.sum("sw").alias("sw"),
        F.sum(inside + n * (mine - overall) * (mine - overall)).alias("squares"),
        F.min("wmin").alias("wmin"), F.max("wmax").alias("wmax"),
    )
    m = F.col("m").cast("double")
    mean = F.col("sw") / m
    var = F.greatest(F.lit(0.0), F.col("squares") / m)
    return agg.select(
        F.col("m").alias("total_edges"),
        F.round(mean, STATS_DIGITS).alias("mean_weight"),
        F.round(F.sqrt(var), STATS_DIGITS).alias("std_weight"),
        F.round("wmin", STATS_DIGITS).alias("min_weight"),
        F.round("wmax", STATS_DIGITS).alias("max_weight"),
    )


def _column_base(totals: DataFrame, value: str, min_w: float) -> DataFrame:
    """``c, t, base``: what a column and the types give to ``|row U column U
    partners|``: the column's sum plus the partner types' sums outside of it.
    ``totals`` holds ``c, t`` and the sums (columns times types rows at most)."""
    from pyspark.sql import Window

    # a column's sums by type stand beside each of its rows; all types' in one array
    own = Window.partitionBy("c")
    of_types = totals.groupBy("t").agg(F.sum(value).alias("v")).agg(F.collect_list(F.struct("t", "v")).alias("a")).scalar()
    wide = totals.select("c", "t", F.collect_list(F.struct("t", F.col(value).alias("v"))).over(own).alias("mine"),
                         of_types.alias("every"))
    kind = totals.schema[value].dataType.simpleString()
    zero = f"CAST(0 AS {kind})"
    partners = _partners_sql("t", min_w)

    def total(name, only):
        return f"aggregate(filter({name}, x -> {only}), {zero}, (a, x) -> CAST(a + x.v AS {kind}))"

    base = f"{total('mine', 'true')} + {total('every', f'array_contains({partners}, x.t)')} - {total('mine', f'array_contains({partners}, x.t)')}"
    return wide.select("c", "t", F.expr(base).alias("base"))


def _inside_row(value: str, kind: str, min_w: float) -> str:
    """SQL text for an item ``i`` of ``items``: what the rest of its row adds to
    its column's base (row minus cell, less the partners counted there)."""
    partners = _partners_sql("i.t", min_w)
    return (f"aggregate(items, CAST(0 AS {kind}), (a, y) -> CAST(a + CASE WHEN y.c = i.c OR array_contains({partners}, y.t) "
            f"THEN CAST(0 AS {kind}) ELSE {value} END AS {kind}))")


def degree_table(rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Degree per (row, column, type) -- every entity with the same key has
    the same neighbourhood: ``|row U column U semantic partners| - 1``.

    What lies in the entity's column, or is a partner type anywhere, comes
    from the column totals; the rest of its row from the row's own vector."""
    vectors = materialize(row_vectors(rct), "rows")
    base = _column_base(column_totals(row_patterns(vectors)), "n", cfg.min_edge_weight)
    inside = F.expr(f"transform(items, i -> named_struct('c', i.c, 't', i.t, 'inside', {_inside_row('y.n', 'BIGINT', cfg.min_edge_weight)}))")
    each = vectors.select("row_index", F.inline(inside))
    return each.join(F.broadcast(base), ["c", "t"]).select(  # columns times types rows
        "row_index", F.col("c").alias("column_ordinal"), F.col("t").alias("pii_type"),
        (F.col("base") + F.col("inside") - 1).cast("long").alias("degree"))


def _identified(ent: DataFrame) -> DataFrame:
    """Entities or risk rows with their node id."""
    if "text" in ent.columns:
        return nodes(ent)
    return ent.withColumn("node_id", node_id(F.col("pii_type"), F.col("row_index"), F.col("column_ordinal"), F.col("span_ord")))


def degree_centrality(ent: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """``degree / (n - 1)`` per node (n = number of nodes)."""
    d = degree_table(rct, cfg)
    n = rct.agg(F.sum("n").alias("n")).scalar()  # scalar subquery: the node count
    # both sides are exploded from small compressed files, which the planner would take for small tables and broadcast
    nd = _identified(ent).join(d.hint("merge"), ["row_index", "column_ordinal", "pii_type"])
    cent = F.when(n > 1, F.col("degree") / (n - 1))
    return nd.select("node_id", "pii_type", "row_index", "column_name", "degree",
                     F.round(cent, STATS_DIGITS).alias("degree_centrality"))


#: hub graphs up to this many links times vertices are solved in one expression
HUB_STEPS = 1_000_000


def component_labels(rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """``column_ordinal -> hub component`` on the small hub graph.

    Every entity joins its row, its column and (when its type has a present
    semantic partner) its type.  Rows link the columns they touch and types
    link their partner types, so the component of an entity is the
    component of its column in a graph whose vertices are columns and
    types.  Its links are counted: a small hub graph (any table of some
    hundred columns) is folded link by link in one expression, a larger one
    goes through :func:`connected_components`.
    """
    patterns = row_patterns(row_vectors(rct))
    partners = _partners_sql("t", cfg.min_edge_weight)
    hub = "concat('c:', {})".format
    chain = ("transform(slice(k, 2, greatest(size(k) - 1, 0)), (c, i) -> named_struct('src', " + hub("k[i]") + ", 'dst', " + hub("c") + "))")
    columns = patterns.select(F.expr("array_sort(array_distinct(transform(items, x -> x.c)))").alias("k")).distinct()
    present = column_totals(patterns).select("c", "t")
    types = F.broadcast(present.agg(F.collect_set("t").alias("types")))  # one row, one entry a type
    live = present.join(types).withColumn("live", F.expr(f"filter({partners}, p -> array_contains(types, p))"))
    links = (columns.select(F.inline(F.expr(chain)))
             .unionByName(live.where(F.size("live") > 0).select(F.expr(hub("c")).alias("src"), F.expr("concat('t:', t)").alias("dst")))
             .unionByName(live.select(F.expr("concat('t:', t)").alias("src"), F.explode("live").alias("p"))
                          .select("src", F.expr("concat('t:', p)").alias("dst"))))
    links = materialize(links.distinct(), "hub-links")
    vertices = materialize(present.select(F.expr(hub("c")).alias("v")).unionByName(links.select(F.col("src").alias("v"))).unionByName(
        links.select(F.col("dst").alias("v"))).distinct(), "hub-vertices")
    if links.count() * vertices.count() <= HUB_STEPS:
        # every link merges the labels of its two ends; after the last one the labels are the components
        start = vertices.agg(F.collect_list(F.struct("v", F.col("v").alias("root"))).alias("a")).scalar()
        root = "element_at(filter(a, x -> x.v = e.{}), 1).root"
        merged = (f"transform(array(named_struct('p', {root.format('src')}, 'q', {root.format('dst')})), m -> transform(a, x -> "
                  f"named_struct('v', x.v, 'root', CASE WHEN x.root IN (m.p, m.q) THEN least(m.p, m.q) ELSE x.root END)))[0]")
        row = links.agg(F.collect_list(F.struct("src", "dst")).alias("links")).select("links", start.alias("labels"))
        labels = row.select(F.inline(F.expr(f"aggregate(links, labels, (a, e) -> {merged})"))).select(
            F.col("v").alias("vertex"), F.col("root").alias("component"))
    else:
        labels = connected_components(links, vertices)
    return labels.where(F.col("vertex").startswith("c:")).select(
        F.substring_index("vertex", ":", -1).cast("int").alias("column_ordinal"), F.col("component").alias("hub")
    )


def column_states(ent: DataFrame) -> DataFrame:
    """One row a column: entities, their level scores, types and the first entity in entity order."""
    score = R.level_score(F.col("risk_level")) if "risk_level" in ent.columns else F.lit(None).cast("double")
    return ent.groupBy("column_ordinal").agg(
        F.count(F.lit(1)).alias("size"), F.sum(score).alias("scores"), F.max(score).alias("most"),
        F.collect_set("pii_type").alias("types"),
        F.min(F.struct("row_index", "column_ordinal", "span_ord", "pii_type")).alias("f"))


def _summaries(ent: DataFrame, rct: DataFrame, cfg: VeilConfig, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Column labels, and per component its size, scores, types, first node and rank (one row a column at most)."""
    from pyspark.sql import Window

    labels = component_labels(rct, cfg) if labels is None else labels
    merged = column_states(ent).join(F.broadcast(labels), "column_ordinal").groupBy("hub").agg(
        F.sum("size").alias("size"), F.sum("scores").alias("scores"), F.max("most").alias("most"),
        F.size(F.array_distinct(F.flatten(F.collect_list("types")))).alias("n_types"), F.min("f").alias("f"))
    # a component is a set of columns, so a global order is cheap
    w = Window.orderBy(F.col("f.row_index"), F.col("f.column_ordinal"), F.col("f.span_ord"))
    first = node_id(F.col("f.pii_type"), F.col("f.row_index"), F.col("f.column_ordinal"), F.col("f.span_ord"))
    return labels, merged.select("hub", first.alias("component_id"), "size", (F.row_number().over(w) - 1).alias("cluster_rank"),
                                 "scores", "most", "n_types")


def components(ent: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT,
               labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (membership, summary); ``labels`` saves working out :func:`component_labels` again.

    membership: ``node_id, row_index, column_ordinal, span_ord, component_id``
    summary:    ``component_id, size, cluster_rank``
    The component id is the node id of the component's first entity in
    entity order (row, column ordinal, span ordinal); ``cluster_rank`` is
    the position of the component in that order (0-based).
    """
    labels, summary = _summaries(ent, rct, cfg, labels)
    of_column = labels.join(summary.select("hub", "component_id"), "hub").drop("hub")  # one row a column
    membership = _identified(ent).join(F.broadcast(of_column), "column_ordinal")
    return membership, summary.select("component_id", "size", "cluster_rank")


def cluster_members(ent: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT, labels: DataFrame | None = None) -> DataFrame:
    """Entities of each component as rows: component, its rank, and the entity's node id,
    type, text preview, risk level and confidence."""
    membership, summary = components(ent, rct, cfg, labels)
    return membership.join(summary.select("component_id", "cluster_rank"), "component_id").select(
        "component_id", "cluster_rank", "node_id", "pii_type", F.col("text").alias("text_preview"), "risk_level",
        "confidence")


def risk_clusters(ent: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT, labels: DataFrame | None = None) -> DataFrame:
    """Components with at least two entities, scored:
    ``min(1, 0.4*avg + 0.3*max + 0.2*diversity + 0.1*min(1, size/5))``.
    Entities are only aggregated by column; components merge those states."""
    summary = _summaries(ent, rct, cfg, labels)[1].where(F.col("size") >= 2)
    wa, wm, wd, ws = CLUSTER_WEIGHTS
    mean = F.col("scores") / F.col("size")
    div = F.col("n_types") / F.col("size")
    overall = F.least(
        F.lit(1.0),
        F.lit(wa) * mean + F.lit(wm) * F.col("most") + F.lit(wd) * div
        + F.lit(ws) * F.least(F.lit(1.0), F.col("size") / F.lit(CLUSTER_SIZE_NORM)),
    )
    return summary.select(
        F.col("cluster_rank").alias("cluster_id"), "component_id", "size",
        F.round(mean, STATS_DIGITS).alias("average_risk_score"),
        F.round("most", STATS_DIGITS).alias("max_risk_score"),
        F.round(div, STATS_DIGITS).alias("type_diversity"),
        F.round(overall, STATS_DIGITS).alias("overall_risk"),
    )


def graph_metrics(ent: DataFrame, rct: DataFrame, totals: DataFrame, cfg: VeilConfig = DEFAULT,
                  labels: DataFrame | None = None) -> DataFrame:
    _, summary = components(ent, rct, cfg, labels)
    none = F.lit(None).cast("long")
    found = summary.agg(F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("parts"), F.max("size").alias("largest")).select(
        "nodes", "parts", "largest", none.cast(BIG).alias("edges")).unionByName(
        totals.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast(BIG).alias("edges")).select(
            none.alias("nodes"), none.alias("parts"), none.alias("largest"), "edges"))
    one = found.agg(F.max("nodes").alias("nodes"), F.max("parts").alias("parts"), F.max("largest").alias("largest"),
                    F.max("edges").alias("edges"))
    n = F.coalesce("nodes", F.lit(0))
    return one.select(
        n.alias("num_nodes"), F.col("edges").alias("num_edges"),
        F.round(F.when(n > 1, F.lit(2.0) * F.col("edges").cast("double") / (n.cast("double") * (n - 1))).otherwise(F.lit(0.0)),
                STATS_DIGITS).alias("density"),
        (F.col("parts") == 1).alias("is_connected"), F.col("parts").alias("n_components"),
        F.col("largest").alias("largest_component_size"))


def eigenvector_centrality(ent: DataFrame, rct: DataFrame, cfg: VeilConfig = DEFAULT, max_iter: int = 1000,
                           tol: float = 1e-6) -> DataFrame:
    """Unweighted eigenvector centrality by power iteration on ``A + I``.

    Nodes of one column and type in rows with the same vector have the same
    value at every step, so the iteration runs over row patterns: a pattern
    holds one value an item.  A product ``A x`` takes the column totals
    (columns times types numbers) and the pattern's own items; no vector is
    shuffled.  Each round is written into the shared checkpoint folder.
    Stops when the L1 change is below ``n * tol``; ``converged`` reports
    whether that happened within ``max_iter``.
    """
    mw = cfg.min_edge_weight
    vectors = materialize(row_vectors(rct), "rows")
    patterns = row_patterns(vectors)
    n_nodes = patterns.agg(F.sum(F.expr("rows * aggregate(items, 0L, (a, x) -> a + x.n)"))).first()[0] or 0
    first = 1.0 / max(n_nodes, 1)

    def with_values(x: str, last: str):
        return F.expr(f"transform(items, i -> named_struct('c', i.c, 't', i.t, 'n', i.n, 'x', {x}, 'last', {last}))")

    state = materialize(patterns.select("rows", F.col("items").alias("pattern"),
                                        with_values(f"{first!r}D", "0D").alias("items")), "vector")
    converged, rounds = n_nodes == 0, 0
    while not converged and rounds < max_iter:
        rounds += 1
        sums = state.select("rows", F.inline("items")).groupBy("c", "t").agg(
            F.sum(F.col("rows") * F.col("n") * F.col("x")).alias("v"))
        base = _column_base(sums, "v", mw).agg(F.collect_list(F.struct("c", "t", "base")).alias("b")).scalar()
        given = "filter(base, b -> b.c = i.c AND b.t = i.t)[0].base"
        product = f"{given} + {_inside_row('y.n * y.x', 'DOUBLE', mw)}"
        raw = materialize(state.select("rows", "pattern", "items", base.alias("base")).select(
            "rows", "pattern", with_values(product, "i.x").alias("items")), "product")
        each = raw.select("rows", F.inline("items"))
        norm = math.sqrt(each.agg(F.sum(F.col("rows") * F.col("n") * F.col("x") * F.col("x"))).first()[0] or 0.0) or 1.0
        delta = each.agg(F.sum(F.col("rows") * F.col("n") * F.abs(F.col("x") / norm - F.col("last")))).first()[0] or 0.0
        state = raw.withColumn("items", with_values(f"i.x / {norm!r}D", "i.last"))
        converged = delta < n_nodes * tol
    values = vectors.join(state.select(F.col("pattern").alias("items"), F.expr("transform(items, i -> struct(i.c, i.t, i.x))").alias("v")),
                          "items").select("row_index", F.inline("v"))
    of_key = values.select("row_index", F.col("c").alias("column_ordinal"), F.col("t").alias("pii_type"), "x")
    # never broadcast: see degree_centrality
    out = _identified(ent).join(of_key.hint("merge"), ["row_index", "column_ordinal", "pii_type"])
    return out.select("node_id", "pii_type", "row_index", "column_name",
                      F.round("x", STATS_DIGITS).alias("eigenvector_centrality"),
                      F.lit(converged).alias("converged"), F.lit(rounds).alias("iterations"))


def _type_sums(min_w: float) -> dict[str, Column]:
    """``n`` and one sum for each type that has a semantic partner: a group's
    pairs and semantic pairs follow from these few longs, without a join."""
    types = sorted({t for a, b, w in semantic_entries() if w >= min_w for t in (a, b)})
    return {"n": F.sum("n")} | {f"n_{t}": F.sum(F.when(F.col("pii_type") == t, F.col("n")).otherwise(0)) for t in types}


def _semantic_of_sums(min_w: float) -> Column:
    """Semantic pairs of a group from its :func:`_type_sums`."""
    count = F.lit(0).cast(BIG)
    for a, b, w in semantic_entries():
        if w >= min_w:
            count = (count + _big(F.col(f"n_{a}")) * _big(F.col(f"n_{b}"))).cast(BIG)
    return count


def row_edge_counts(rct: DataFrame, edges: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Row co-occurrence edges per row: pairs in the row that hold no
    semantic or proximity edge (the anti-join of the reference, by counts).

    Counts and proximity pairs meet in one aggregation of a few longs a row."""
    mw = cfg.min_edge_weight
    sums = _type_sums(mw)
    near = edges.where(F.col("edge_type") == "proximity").select(
        "row_index", F.lit(None).cast("string").alias("pii_type"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("p"))
    each = rct.select("row_index", "pii_type", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("p")).unionByName(near)
    rows = each.groupBy("row_index").agg(*[v.alias(k) for k, v in sums.items()], F.sum("p").alias("p"))
    # entities without a row index have no row to be compared in
    taken = F.when(F.col("row_index").isNotNull(), _semantic_of_sums(mw) + F.col("p")).otherwise(0)
    return rows.select("row_index", (_pairs(F.col("n")) - taken).cast(BIG).alias("row_edges")).where(F.col("row_edges") > 0)


def column_edge_counts(rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Column co-occurrence edges per column: same-column pairs that are not
    semantic and not in the same row.

    Cells are merged to a few longs each, and these to a few numbers a column."""
    mw = cfg.min_edge_weight
    sums = _type_sums(mw)
    cells = rct.groupBy("row_index", "column_ordinal").agg(*[v.alias(k) for k, v in sums.items()])
    inside = _pairs(F.col("n")) - F.when(F.col("row_index").isNotNull(), _semantic_of_sums(mw)).otherwise(0)
    columns = cells.withColumn("inside", inside.cast(BIG)).groupBy("column_ordinal").agg(
        *[F.sum(k).alias(k) for k in sums], F.sum("inside").cast(BIG).alias("inside"))
    cnt = (_pairs(F.col("n")) - _semantic_of_sums(mw) - F.col("inside")).cast(BIG)
    return columns.select("column_ordinal", cnt.alias("column_edges")).where(F.col("column_edges") > 0)


def semantic_edge_counts(rct: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Semantic edges per type pair: every A entity with every B entity."""
    sem = _semantic_pairs(rct.sparkSession, cfg.min_edge_weight)
    g = rct.groupBy("pii_type").agg(F.sum("n").alias("n"))
    j = (sem.join(g.select(F.col("pii_type").alias("a"), F.col("n").alias("na")), "a")
         .join(g.select(F.col("pii_type").alias("b"), F.col("n").alias("nb")), "b"))
    return j.select(F.col("a").alias("type_a"), F.col("b").alias("type_b"),
                    (_big(F.col("na")) * _big(F.col("nb"))).cast(BIG).alias("edges"), F.col("w").alias("weight"))
