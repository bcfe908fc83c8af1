"""End-to-end table job: detect, mask, assess, graph, report.

``process_table`` wires the operators into one lazy plan per output.  The
span frame (one regex pass per cell) is the shared input of entities,
masking-free analysis, proximity pairs and the graph, so it is persisted
once; every output is a DataFrame that Spark computes on demand.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..operators import analyze as A
from ..operators import graph as G
from ..operators import report as RP
from ..operators.cells import to_cells
from ..operators.mask import mask_table
from ..session import materialize, scratch
from ..sources import sinks
from ..sources.csv import BAD_RECORD, read_csv_indexed


@dataclass
class TableResult:
    cells: DataFrame
    entities: DataFrame
    masked: DataFrame
    edges: DataFrame
    counts: DataFrame
    cfg: VeilConfig = field(default=DEFAULT)
    persisted: tuple[DataFrame, ...] = ()

    # summaries -----------------------------------------------------------
    def summary(self) -> DataFrame:
        return RP.summary(self.entities)

    def risk_distribution(self) -> DataFrame:
        return RP.distribution(self.entities, "risk_level")

    def high_risk_entities(self) -> DataFrame:
        return RP.high_risk(self.entities)

    def compliance(self) -> DataFrame:
        return RP.compliance(self.entities)

    def compliance_document(self, timestamp: str) -> DataFrame:
        return RP.compliance_document(self.entities, timestamp)

    def regulation_impact(self) -> DataFrame:
        return RP.regulation_impact(self.entities)

    # graph ---------------------------------------------------------------
    def nodes(self) -> DataFrame:
        return G.nodes(self.entities)

    @cached_property
    def _totals(self) -> DataFrame:
        """Written once (four rows), as the component labels (a row a column)."""
        return materialize(G.edge_class_totals(self.counts, self.edges, self.cfg), "edge-totals")

    @cached_property
    def _labels(self) -> DataFrame:
        return materialize(G.component_labels(self.counts, self.cfg), "hub-components")

    def edge_totals(self) -> DataFrame:
        return self._totals

    def clusters(self) -> DataFrame:
        return G.risk_clusters(self.entities, self.counts, self.cfg, self._labels)

    def cluster_members(self) -> DataFrame:
        return G.cluster_members(self.entities, self.counts, self.cfg, self._labels)

    def release(self) -> None:
        """Give back what the frames keep on the executors."""
        for df in self.persisted:
            df.unpersist()

    def graph_metrics(self) -> DataFrame:
        return G.graph_metrics(self.entities, self.counts, self.edge_totals(), self.cfg, self._labels)

    def degree_centrality(self) -> DataFrame:
        return G.degree_centrality(self.entities, self.counts, self.cfg)

    def report(self, timestamp: str) -> DataFrame:
        """One-row report: summary, risk distribution, graph metrics,
        compliance and regulations as nested structs (``to_json`` ready).
        ``timestamp`` is a parameter so that reruns are reproducible."""
        def many(df: DataFrame):   # small frames only (<= 4 rows each here)
            return df.agg(F.collect_list(F.struct(*df.columns))).scalar()

        def single(df: DataFrame):
            return df.select(F.struct(*df.columns)).scalar()

        spark = self.entities.sparkSession
        return spark.range(1).select(
            single(self.summary()).alias("summary"),
            many(self.risk_distribution()).alias("risk_distribution"),
            single(self.graph_metrics()).alias("graph"),
            single(self.compliance()).alias("compliance"),
            many(self.regulation_impact()).alias("regulations"),
            many(self.edge_totals().select("edge_type", F.col("cnt").alias("count"))).alias("edge_types"),
            F.lit(timestamp).alias("timestamp"),
        )


def process_table(df: DataFrame, key: str = "row_index", columns: list[str] | None = None,
                  cfg: VeilConfig = DEFAULT) -> TableResult:
    cols = columns if columns is not None else [c for c in df.columns if c != key]
    cells = to_cells(df, key, cols)
    framed = A.span_frame(cells, cfg).persist()
    entities = A.entities_from_spans(framed, cfg)
    edges = G.explicit_edges(A.proximity_pairs(framed, cfg, cfg.graph_window), cfg)
    counts = G.cell_type_counts_from_spans(framed).persist()
    masked = mask_table(df, key, cols, cfg)
    return TableResult(cells, entities, masked, edges, counts, cfg, (framed, counts))


def process_csv(spark: SparkSession, path: str, output_dir: str | None = None, cfg: VeilConfig = DEFAULT,
                max_size_mb: float | None = None, timestamp: str = "", multiline: bool = False) -> TableResult:
    """CSV in, masked CSV + entity JSON + report JSON + compliance JSON + high-risk
    entities in a folder a type + graph tables out.

    The graph's row, column and semantic edges are cliques: they are written
    as one hub row a row, column and type pair with its exact edge count, beside
    the listed same-cell pairs."""
    table = read_csv_indexed(spark, path, max_size_mb, multiline=multiline)
    # the raw text of a row that does not fit the header is one more cell: its
    # entities count, and it is written masked to the errors, not to the table
    key, *columns, bad = table.columns
    table = table.withColumn(bad, F.coalesce(bad, F.lit("")))
    result = process_table(table, key, [*columns, bad], cfg)
    if output_dir:
        base = output_dir.rstrip("/")
        sinks.write_masked_csv(result.masked, f"{base}/masked", drop=(key, bad))
        sinks.write_json(result.masked.where(F.col(bad) != "").select(F.col(key).alias("row_index"), F.col(bad).alias(BAD_RECORD)), f"{base}/errors")
        sinks.write_json(result.entities, f"{base}/entities")
        sinks.write_json(result.report(timestamp), f"{base}/report")
        sinks.write_json(result.compliance_document(timestamp), f"{base}/compliance")
        sinks.write_json_by(result.high_risk_entities(), "pii_type", f"{base}/high_risk")
        sinks.write_tables({
            "nodes": result.nodes(), "edges": result.edges, "clusters": result.clusters(),
            "cluster_members": result.cluster_members(),
            "semantic_hubs": G.semantic_edge_counts(result.counts, cfg),
            "row_hubs": G.row_edge_counts(result.counts, result.edges, cfg),
            "column_hubs": G.column_edge_counts(result.counts, cfg)}, f"{base}/graph")
        result.release()
    return result


def csv_job(spark: SparkSession, path: str, output_dir: str, cfg: VeilConfig = DEFAULT,
            max_size_mb: float | None = None, timestamp: str = "", multiline: bool = False) -> Row:
    """``process_csv`` as a whole job: everything is written to ``output_dir``, nothing
    is left in the shared folder, and the written report (one row) comes back."""
    with scratch(spark):
        process_csv(spark, path, output_dir, cfg, max_size_mb, timestamp, multiline)
    return spark.read.json(f"{output_dir.rstrip('/')}/report").first()
