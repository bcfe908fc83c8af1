"""Operator 7, licence scans: sparse TF-IDF cosine to templates, then inheritance.

Every sentence of every whole text is compared with every template: tokens are
weighted by TF-IDF over all sentences of the corpus, and the template of
highest cosine is taken from ``LEAST_COSINE`` on (ties: by name).  A sentence
that reaches it is a header candidate.  A file's own licence is that of its
best candidate; a bare reservation of rights (``RESERVED``), which also stands
above grants, decides only in files without another candidate.  Files without a
licence inherit from the nearest ancestor directory that holds a licence file:
paths are expanded into their ancestor directories and joined to the
directories' licences.

Sentences that can't reach the least cosine are left out by an exact bound: of a
template's tokens, the most frequent ones whose squared weights sum to less than
the square of the least cosine are left out, the others are its *rare* ones; by
Cauchy-Schwarz a sentence without any of them stays below that cosine.

Scale: token counts are combined in the scan's stage; sentences leave it only
where they hold a rare token; distinct ones are pre-aggregated and scored once
by equi-joins on tokens, so a header that a third of all files carry is one row
a task; directories carry one row each.  The rare tokens (a few dozen words of
the templates) are a scalar subquery; no side is broadcast by hand.

Defined results: null text or path: no candidate, no ancestor; rows of equal id
and path keep their rows and share their candidates; a directory's best licence file decides (cosine, then
name, then path); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_COSINE = 0.6
#: cosines are rounded to nine digits; the bound leaves that much room
ROOM = 1e-8
#: what ends a sentence, and a token (fixed values of this operator)
SENTENCE_END = r"\n|(?<=[.!?])\x20"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
RESERVED = "proprietary"
#: header texts in plain words, one or more a licence (fixed values of this operator); the BSD licences
#: share their first sentence, which alone doesn't tell them apart
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License, Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy, MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("BSD-family", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met:"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    (RESERVED, "Copyright, all rights reserved, proprietary license."),
    (RESERVED, "All rights reserved."),
]


def _tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _weights(units: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """``key, token, idf, w``, ``w`` with unit norm per key."""
    tf = units.select(key, F.explode(_tokens(F.col("unit"))).alias("token")).groupBy(key, "token").agg(
        F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "token").select(key, "token", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "token", "idf", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``files`` has ``file_id, path, is_licence_file, text``; gives ``file_id, path, n_candidates, own_license,
    own_cosine, inherited_from, license``."""
    # outer: explode would evaluate its input twice, in a filter of its own too
    said = files.select("file_id", "path", F.explode_outer(F.split("text", SENTENCE_END)).alias("unit"))
    models = templates.select(F.monotonically_increasing_id().alias("model"), "license", F.col("template").alias("unit"))
    df = said.select(F.explode_outer(F.array_distinct(_tokens(F.col("unit")))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df"))
    total = files.where("text IS NOT NULL").agg(
        F.coalesce(F.sum(F.size(F.split("text", SENTENCE_END))), F.lit(0))).scalar()  # a scalar subquery
    known = df.unionByName(models.select(F.explode(_tokens(F.col("unit"))).alias("token"), F.lit(0).alias("df")))
    idf = known.groupBy("token").agg(F.sum("df").alias("df")).select(
        "token", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = _weights(models, "model", idf)
    upto = F.sum(F.col("w") * F.col("w")).over(
        W.partitionBy("model").orderBy("idf", "token").rowsBetween(W.unboundedPreceding, 0))
    rare = weighed.withColumn("upto", upto).where(
        F.col("upto") >= max(least - ROOM, 0.0) ** 2 - ROOM).agg(F.collect_set("token")).scalar()
    units = said.where(F.arrays_overlap(_tokens(F.col("unit")), rare))
    kinds = units.select("unit").distinct()
    have = _weights(kinds, "unit", idf)
    want = weighed.join(models.select("model", "license"), "model")
    cosine = have.join(want.select("model", "license", "token", F.col("w").alias("v")), "token").groupBy(
        "unit", "license", "model").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("cosine"))
    best = cosine.where(F.col("cosine") >= least).groupBy("unit").agg(
        F.min(F.struct((-F.col("cosine")).alias("rank"), "license")).alias("best"))
    found = units.join(best, "unit").groupBy("file_id", "path").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min(F.struct((F.col("best.license") == RESERVED).alias("bare"), "best.rank", "best.license")).alias("best"))
    # null-safe: a null path is a path of its own here
    own = files.select("file_id", "path", "is_licence_file").alias("f").join(
        found.alias("o"), F.col("f.file_id").eqNullSafe(F.col("o.file_id")) & F.col("f.path").eqNullSafe(F.col("o.path")),
        "left").select("f.file_id", "f.path", "is_licence_file", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                       "best")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    held = own.where("is_licence_file AND best IS NOT NULL").groupBy(folder.alias("folder")).agg(
        F.min(F.struct(F.col("best.rank"), F.col("best.license"), F.col("path"))).alias("b")).select(
        "folder", F.col("b.license").alias("held"))
    lacking = own.where("best IS NULL").select("file_id", "path", folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    ancestors = lacking.where("path IS NOT NULL").select("file_id", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))
    )).alias("folder"))
    near = ancestors.join(held, "folder").groupBy("file_id", "path").agg(
        F.max(F.struct(F.length("folder").alias("l"), "folder", "held")).alias("near"))
    return own.alias("o").join(near.alias("n"), F.col("o.file_id").eqNullSafe(F.col("n.file_id"))
                               & (F.col("o.path") == F.col("n.path")), "left").select(
        "o.file_id", "o.path", "n_candidates", F.col("best.license").alias("own_license"),
        F.round(-F.col("best.rank"), 6).alias("own_cosine"), F.col("near.folder").alias("inherited_from"),
        F.coalesce("best.license", "near.held").alias("license"))


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, template string").coalesce(1)


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as files: folders by source, language and hundreds of ids; each tenth id is a
    licence file, each fiftieth one of the folder above."""
    i = F.col("doc_id")
    shard = F.floor(i / 100).cast("string")
    parts = F.when(i % 50 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", shard))
    name = F.when(i % 10 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    return docs.select(i.cast("long").alias("file_id"), F.concat(parts, F.lit("/"), name).alias("path"),
                       F.coalesce(i % 10 == 0, F.lit(False)).alias("is_licence_file"), "text")
