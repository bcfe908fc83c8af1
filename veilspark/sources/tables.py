"""Readers for the parquet test tables and tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A customer-contact table derived from ``customer`` with plain SQL that
# Spark and DuckDB evaluate identically.  It gives the table operators
# (masking, proximity, graph, compliance) cells holding every regex type.

PEOPLE_EXPRS = [
    ("row_index", "c_custkey"),
    ("full_name", "c_name"),
    ("email", "lower(replace(c_name, '#', '.')) || '@example.com'"),
    ("phone", "'(' || CAST(200 + c_custkey % 800 AS STRING) || ') ' || "
              "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || "
              "lpad(CAST((c_custkey * 7) % 10000 AS STRING), 4, '0')"),
    ("ssn", "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || "
            "lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || "
            "lpad(CAST((c_custkey * 13) % 10000 AS STRING), 4, '0')"),
    ("card", "'4' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' ' || "
             "lpad(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 10000 AS STRING), 4, '0') || ' ' || "
             "lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0') || ' ' || "
             "lpad(CAST(c_nationkey * 100 AS STRING), 4, '0')"),
    ("dob", "CAST(1 + c_custkey % 12 AS STRING) || '/' || CAST(1 + c_custkey % 28 AS STRING) || '/' || "
            "CAST(1940 + c_custkey % 60 AS STRING)"),
    ("notes", "'Segment ' || c_mktsegment || ' zip ' || "
              "lpad(CAST((c_custkey * 97) % 100000 AS STRING), 5, '0') || "
              "' host 10.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 256 AS STRING) || '.' || "
              "CAST((c_custkey * 3) % 256 AS STRING) || "
              "CASE WHEN c_custkey % 5 = 0 THEN ' password: pw' || CAST(c_custkey AS STRING) || 'x.' ELSE '' END || "
              "CASE WHEN c_custkey % 7 = 0 THEN ' api_key=k' || lpad(CAST(c_custkey AS STRING), 24, '0') ELSE '' END || "
              "CASE WHEN c_custkey % 3 = 0 THEN ' reach ' || lower(replace(c_name, '#', '_')) || "
              "'@corp.example.org or 555 ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' ' || "
              "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE '' END"),
    ("address", "CAST(1 + c_custkey % 9999 AS STRING) || ' ' || "
                "CASE c_custkey % 4 WHEN 0 THEN 'Oak' WHEN 1 THEN 'Elm' WHEN 2 THEN 'Pine' ELSE 'Cedar' END || "
                "' Street'"),
    ("segment", "c_mktsegment"),
]

# Street addresses have no built-in detector; the table jobs register this
# user pattern (the documented way to add a type).
ADDRESS_PATTERN = ("physical_address", r"\b\d{1,5} [A-Z][a-z]+ (?:Street|Avenue|Road)\b", "")

# The same projection as SQL text, for engines that only take SQL.
PEOPLE_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in PEOPLE_EXPRS) + " FROM customer"


# One channel a customer: the columns never meet in a row and their types have
# no semantic partner, so the entity graph has a component a column and one
# single entity.
CHANNEL_EXPRS = [
    ("row_index", "c_custkey"),
    ("area", "CASE WHEN c_custkey % 4 = 0 THEN 'zip ' || lpad(CAST((c_custkey * 97) % 100000 AS STRING), 5, '0') ELSE '' END"),
    ("host", "CASE WHEN c_custkey % 4 = 1 THEN 'hosts 10.1.' || CAST(c_nationkey AS STRING) || '.' || CAST(c_custkey % 256 AS STRING) || "
             "' and 10.2.0.' || CAST(c_custkey % 256 AS STRING) ELSE '' END"),
    ("token", "CASE WHEN c_custkey % 4 = 2 THEN 'api_key=k' || lpad(CAST(c_custkey AS STRING), 24, '0') ELSE '' END"),
    ("backup", "CASE WHEN c_custkey % 8 = 6 THEN 'api_key=b' || lpad(CAST(c_custkey AS STRING), 24, '0') ELSE '' END"),
    ("lone", "CASE WHEN c_custkey = 3 THEN 'password: only-one-here' ELSE '' END"),
]
CHANNEL_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in CHANNEL_EXPRS) + " FROM customer"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {a}" for a, e in CHANNEL_EXPRS))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived contact table: one row per customer, all columns strings
    except the ``row_index`` key."""
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {a}" for a, e in PEOPLE_EXPRS))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regex scans) enough tasks.

    A scan yields one task per row group; a file written as one row group
    is read by one core.  When the plan has fewer partitions than the
    cluster has cores, rows are dealt round-robin to that many partitions
    (an explicit count, so adaptive execution keeps it).  On large inputs
    the scan already has more splits than cores and this is a no-op.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
