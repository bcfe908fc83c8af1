"""Summaries and compliance reports over analysed entities.

All are aggregations with map-side partial aggregation; the number of
groups is bounded by small domains (types, risk levels, columns,
regulations, data sets), so no group ever holds unbounded state: lists of
entities are never collected, only counts and distinct type names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions.patterns import COMPLIANCE_TIERS, COMPLIANCE_WEIGHTS, REGULATIONS
from .detect import bind_column, kept_spans

HIGH_LEVELS = ("high", "critical")
RISK_LEVELS = ("low", "medium", "high", "critical")
ENTITY_ORDER = ("row_index", "column_ordinal", "span_ord")


def sorted_join(col, sep=","):
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def summary(ent: DataFrame) -> DataFrame:
    return ent.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.countDistinct("pii_type").alias("n_types"),
        F.coalesce(sorted_join("pii_type"), F.lit("")).alias("pii_types_detected"),
        F.coalesce(sorted_join("detection_method"), F.lit("")).alias("detection_methods"),
    )


def distribution(ent: DataFrame, col: str) -> DataFrame:
    return ent.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def risk_ratio(ent: DataFrame) -> DataFrame:
    hi = F.sum(F.col("risk_level").isin(*HIGH_LEVELS).cast("long"))
    return ent.agg(F.count(F.lit(1)).alias("total"), F.coalesce(hi, F.lit(0)).alias("high_risk_count")).select(
        "total", "high_risk_count",
        (F.col("high_risk_count") / F.greatest(F.col("total"), F.lit(1))).alias("high_risk_ratio"),
    )


def regulations_frame(spark: SparkSession) -> DataFrame:
    rows = [(i, name, t, req) for i, (name, types, req) in enumerate(REGULATIONS) for t in types]
    return spark.createDataFrame(rows, "reg_order int, regulation string, pii_type string, requirements string")


def regulation_impact(ent: DataFrame) -> DataFrame:
    """Per regulation: detected types it covers and how many entities."""
    regs = F.broadcast(regulations_frame(ent.sparkSession))
    per_type = ent.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"))
    j = regs.join(per_type, "pii_type", "left")
    return j.groupBy("reg_order", "regulation", "requirements").agg(
        F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("pii_type")))), ","),
                   F.lit("")).alias("affected_pii_types"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_entities"),
    ).select("regulation", "affected_pii_types", "n_entities", (F.col("n_entities") > 0).alias("affected"),
             "requirements")


def compliance_score_col(counts_by_level: dict[str, F.Column], total: F.Column) -> F.Column:
    weighted = None
    for level, w in COMPLIANCE_WEIGHTS:
        term = counts_by_level[level] * F.lit(w)
        weighted = term if weighted is None else weighted + term
    return F.when(total > 0, weighted / total * F.lit(100.0)).otherwise(F.lit(0.0))


def _recommended(score: F.Column) -> F.Column:
    """Recommendations of a score's tier, joined by `` | ``."""
    tier = None
    for thr, recs in COMPLIANCE_TIERS:
        val = F.lit(" | ".join(recs))
        if thr is None:
            tier = tier.otherwise(val)
        else:
            tier = F.when(score > thr, val) if tier is None else tier.when(score > thr, val)
    return tier


def compliance(ent: DataFrame) -> DataFrame:
    lv = {lvl: F.coalesce(F.sum((F.col("risk_level") == lvl).cast("long")), F.lit(0)) for lvl in RISK_LEVELS}
    agg = ent.agg(F.count(F.lit(1)).alias("total"), *[lv[k].alias(f"n_{k}") for k in RISK_LEVELS])
    score = compliance_score_col({k: F.col(f"n_{k}") for k in RISK_LEVELS}, F.col("total"))
    out = agg.withColumn("risk_score", score)
    tier = _recommended(F.col("risk_score"))
    return out.select(
        F.col("total").alias("total_pii_entities"),
        F.round("risk_score", 6).alias("risk_score"),
        F.split(tier, r" \| ").getItem(0).alias("tier"),
        tier.alias("recommendations"),
    )


def compliance_document(ent: DataFrame, timestamp: str) -> DataFrame:
    """The compliance report as one row: time, totals, score, the regulations
    that detected types fall under, high-risk entities by type and the
    recommendations.

    One pass over the entities: they are counted by type and level, and the
    report is computed from the list of these counts, which is as long as
    there are types.  No entities: score 0, empty lists, the lowest tier."""
    level = {k: F.sum((F.col("risk_level") == k).cast("long")).alias(f"n_{k}") for k in RISK_LEVELS}
    by_type = ent.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"), *level.values())
    high = F.col("n_high") + F.col("n_critical")
    one = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in RISK_LEVELS],
        F.array_sort(F.collect_list(F.struct("pii_type", "n", high.alias("high")))).alias("types"))
    scored = one.withColumn("score", compliance_score_col({k: F.col(f"n_{k}") for k in RISK_LEVELS}, F.col("total")))

    def regulation(name: str, types: list[str], requirements: str) -> F.Column:
        under = F.filter("types", lambda t: t["pii_type"].isin(*types))
        return F.struct(
            F.lit(name).alias("regulation"), F.transform(under, lambda t: t["pii_type"]).alias("affected_pii_types"),
            F.aggregate(under, F.lit(0).cast("long"), lambda n, t: n + t["n"]).alias("n_entities"),
            F.lit(requirements).alias("requirements"))

    regulations = F.array(*[regulation(*r) for r in REGULATIONS])
    return scored.select(
        F.lit(timestamp).alias("timestamp"),
        F.col("total").alias("total_pii_entities"),
        F.round("score", 6).alias("risk_score"),
        F.filter(regulations, lambda r: F.size(r["affected_pii_types"]) > 0).alias("affected_regulations"),
        F.transform(F.filter("types", lambda t: t["high"] > 0), lambda t: F.struct(
            t["pii_type"].alias("pii_type"), t["high"].alias("count"))).alias("high_risk_by_type"),
        F.split(_recommended(F.col("score")), r" \| ").alias("recommendations"),
    )


def batch_comparison(tagged: DataFrame) -> DataFrame:
    """Per data set: entities, type diversity, high-risk count."""
    return tagged.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.countDistinct("pii_type").alias("n_types"),
        F.coalesce(F.sum(F.col("risk_level").isin(*HIGH_LEVELS).cast("long")), F.lit(0)).alias("high_risk_count"),
    )


def risk_heatmap(tagged: DataFrame) -> DataFrame:
    """Data set x risk level counts (pivot with the level list fixed, so
    Spark needs no extra pass to find the pivot values)."""
    p = tagged.groupBy("dataset").pivot("risk_level", list(RISK_LEVELS)).agg(F.count(F.lit(1)))
    return p.select("dataset", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in RISK_LEVELS])


def high_risk(ent: DataFrame) -> DataFrame:
    return ent.where(F.col("risk_level").isin(*HIGH_LEVELS))


def top_per_type(ent: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` entities of each type in entity order.  ``row_number <= k``
    is planned as a per-partition group limit before the shuffle, so a type
    holding most rows sends only ``k`` rows per partition."""
    w = Window.partitionBy("pii_type").orderBy(*ENTITY_ORDER)
    return ent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_k(ent: DataFrame, k: int = 5) -> DataFrame:
    return ent.orderBy(*ENTITY_ORDER).limit(k)


def column_profile(cells: DataFrame, cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Per column: non-empty cells, cells with personal data, entities, types.

    One scan: a cell is one row here, with the types of its spans, so cells
    with a span are counted, not told apart by row index.  What is gathered
    per column are sets of types that occur together in a cell."""
    types = F.transform(kept_spans(F.col("cell_text"), cfg), lambda s: s["pii_type"])
    found = bind_column(cells.select("column_ordinal", "column_name", "cell_text"), "types", types)
    kinds = F.collect_set(F.when(F.size("types") > 0, F.array_sort(F.array_distinct("types"))))
    return found.groupBy("column_ordinal", "column_name").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.sum((F.size("types") > 0).cast("long")).alias("n_cells_with_pii"),
        F.sum(F.size("types").cast("long")).alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(kinds))), ",").alias("pii_types"),
    ).drop("column_ordinal")


def observe_run(ent: DataFrame, name: str = "veil_run"):
    """Attach run metrics (entities, high-risk entities, distinct types) that
    Spark collects while the frame is written; read them from the returned
    ``Observation`` after the action.  No extra pass over the data."""
    from pyspark.sql import Observation

    obs = Observation(name)
    observed = ent.observe(
        obs,
        F.count(F.lit(1)).alias("entities"),
        F.sum(F.col("risk_level").isin(*HIGH_LEVELS).cast("long")).alias("high_risk"),
        # DISTINCT is not allowed in observed metrics; the type set is small
        F.size(F.collect_set("pii_type")).alias("types"),
    )
    return observed, obs


def sample_nodes(nodes: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Opt-in reproducible sample of graph nodes, e.g. for drawing a large
    graph (never used by the exact statistics)."""
    return nodes.sample(withReplacement=False, fraction=fraction, seed=seed)
