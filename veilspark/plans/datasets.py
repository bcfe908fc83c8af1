"""The data sets the registered queries run on, for Spark and for SQL.

* ``docs``   -- ``documents`` (key ``doc_id``; columns text, lang, source)
* ``pages``  -- ``pages`` (key ``page_id``; columns url, html)
* ``people`` -- contact table derived from ``customer`` (see sources.tables)
* ``channels`` -- one contact channel a customer, whose graph has several components

Each data set is read whole; the regex work is spread over all cores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import VeilConfig
from ..functions.patterns import SPAN_PATTERNS, PatternRegistry
from ..operators.cells import to_cells
from ..sources.tables import (
    ADDRESS_PATTERN,
    CHANNEL_EXPRS,
    CHANNEL_SQL,
    PEOPLE_EXPRS,
    PEOPLE_SQL,
    channels,
    people,
    spread,
    table,
)

#: data sets derived from a given table: their frame and their SQL
DERIVED = {"people": (people, PEOPLE_SQL), "channels": (channels, CHANNEL_SQL)}


@dataclass(frozen=True)
class Dataset:
    name: str
    source: str          # table / view name in SQL
    key: str
    columns: tuple[str, ...]
    extra_patterns: tuple = ()

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.name in DERIVED:
            df = DERIVED[self.name][0](spark, sf_dir)
        else:
            df = table(spark, sf_dir, self.source).selectExpr(f"{self.key} AS row_index", *self.columns)
        return spread(df)

    def cells(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_cells(self.frame(spark, sf_dir), "row_index", list(self.columns))

    def registry(self) -> PatternRegistry:
        return PatternRegistry.default().with_patterns(self.extra_patterns)

    def config(self) -> VeilConfig:
        return VeilConfig(registry=self.registry())

    def patterns(self):
        return list(SPAN_PATTERNS) + list(self.extra_patterns)

    def sql_source(self) -> str:
        """SQL for the keyed source rows (DuckDB)."""
        return f"({DERIVED[self.name][1]})" if self.name in DERIVED else self.source

    def sql_key(self) -> str:
        return "row_index" if self.name in DERIVED else self.key


DOCS = Dataset("docs", "documents", "doc_id", ("text", "lang", "source"))
PAGES = Dataset("pages", "pages", "page_id", ("url", "html"))
PEOPLE = Dataset(
    "people", "customer", "row_index",
    tuple(a for a, _ in PEOPLE_EXPRS if a != "row_index"),
    (ADDRESS_PATTERN,),
)
CHANNELS = Dataset("channels", "customer", "row_index", tuple(a for a, _ in CHANNEL_EXPRS if a != "row_index"))
ALL = {d.name: d for d in (DOCS, PAGES, PEOPLE, CHANNELS)}
