"""Operator 5, URL filters [native]: expand, match on hash prefixes, confirm.

A URL is expanded into host suffixes (whole labels) and path prefixes (cut
after a slash).  A rule is filed under its host and its path up to the last
slash.  Both sides carry a short hash prefix of that expression, the
equi-join runs on it, and a candidate counts only if the full SHA-256 digests
agree and the URL's path starts with the rule's whole path.  Of the rules
that fit, the longest (host, then path) decides; with equal ones, block.

Expansion is bounded by the rules, not by a cap on URLs: only label counts
and path depths that some rule has are generated.  A hot host or path meets
its rule in ``salts`` places: expansions carry a salt and rules are repeated
once a salt, so no key is one task's; where the rules are small the planner
broadcasts them by their measured size.

Defined results: null URL or none with ``://``: empty host and path; such
pages and pages no rule fits get a null rule and the default verdict; repeated
rows and null page_ids each keep their row; null rules parts are empty; an
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: (host, path, verdict) of the registered query (fixed values)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"


def host_of(url):
    has = F.instr(url, "://") > 0
    after = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1)
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(F.lit(""))


def path_of(url):
    # what follows the host starts where the host ends
    has = F.instr(url, "://") > 0
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    rest = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)
    return F.when(has, rest).otherwise(F.lit(""))


def _hash_prefix(digest):
    """The first 32 bits of a SHA-256 hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, salts: int = SALTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page; ``rules`` has ``host, path, verdict``."""
    filed = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
                         F.col("verdict").alias("r_verdict"))
    filed = (filed
             .withColumn("r_dir", F.regexp_extract("r_path", r"^((?:[^/]*/)*)", 1))
             .withColumn("r_labels", F.size(F.split("r_host", r"\.")))
             .withColumn("r_depth", F.size(F.split("r_dir", "/")) - 1)
             .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_dir"), 256)))
    # two numbers a shape, one shape for each (label count, depth) that a rule has
    shapes = [(r[0], r[1]) for r in filed.select("r_labels", "r_depth").distinct().collect()]
    filed = (filed.withColumn("prefix", _hash_prefix(F.col("r_digest")))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))

    url = F.coalesce(F.col("url"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).select(
        "page_id", "host", "path")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    expressions = [
        F.when((F.size(labels) >= n) & (F.size(parts) > d), F.concat_ws(
            "\n", F.concat_ws(".", F.slice(labels, F.size(labels) - (n - 1), n)),
            F.concat(F.concat_ws("/", F.slice(parts, 1, d)), F.lit("/")) if d else F.lit("")))
        for n, d in sorted(shapes)
    ] or [F.lit(None).cast("string")]
    # pages that look alike to every rule are judged once
    kinds = base.select("host", "path").distinct()
    cut = kinds.select("host", "path", F.explode(F.array_compact(F.array(*expressions))).alias("e"))
    cut = cut.withColumn("digest", F.sha2("e", 256)).withColumn("prefix", _hash_prefix(F.col("digest"))).withColumn(
        "salt", F.pmod(F.hash("host", "path"), F.lit(salts)))
    fits = cut.join(filed, ["prefix", "salt"]).where(
        (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"),
                    (F.col("r_verdict") == "block").alias("c"))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank)
        .alias("best"))
    return base.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")
