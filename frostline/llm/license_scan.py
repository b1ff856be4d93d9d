"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Method: a file's candidates are its header lines (those that speak of licences) and, if it is a licence file (by its
name, or a text of at most ``Settings.file_words`` words), its whole text. Tokens weigh by inverse document frequency
over all files, every token counted; one in fewer than ``RARE`` of the files weighs like one in that share, so that names
and numbers weigh the same in a table of any size. Candidate and template vectors are sparse rows ``(token, weight)``, joined on the token; the template of the highest cosine is the file's
licence if it reaches ``Settings.cosine``. A licence file speaks for its directory. A file without a licence of its own
inherits from the nearest directory above it that has one; directories, not files, are joined with their ancestors, so a
directory that holds a third of all files is one row, and Spark splits the join that brings its answer to the files.

Only DataFrame functions are used. The templates are a fixed list; only their rows and weights are broadcast by request.
The counts of all tokens are combined before they are shuffled, and joined to the candidates by token.

Defined results: null and empty texts have no licence of their own; a null path inherits nothing. Ties of the cosine: the
first licence by name; several licence files in a directory: the highest cosine, then the first path. Repeated rows and
equal paths are judged each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import named, stored

# Licence names and the notices that stand for them.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}
SPEAKS = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|creative commons"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Share of files below which a token weighs no more.
RARE = 0.001
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.6
    file_words: int = 60


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_counts() -> list[tuple[str, int, Counter]]:
    return [(name, i, Counter(re.findall(TOKEN, t.lower()))) for name, texts in sorted(TEMPLATES.items()) for i, t in enumerate(texts)]


def parent(path: Column) -> Column:
    """The directory of a path; the empty text for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def candidates(files: DataFrame, key: str, path: str, text: str, settings: Settings) -> DataFrame:
    """``(row, key, path, is_file, found)``, written once: all files and their candidates."""
    body = F.coalesce(named(text), F.lit(""))
    short = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).between(1, settings.file_words)
    is_file = F.coalesce(named(path).rlike(FILE_NAME), F.lit(False)) | short
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(SPEAKS))
    found = F.when(body.rlike(SPEAKS), F.concat(F.transform(lines, tokens), F.when(is_file, F.array(tokens(body))).otherwise(F.array().cast("array<array<string>>"))))
    return stored(files.select(
        F.monotonically_increasing_id().alias("row"), named(key).alias("key"), named(path).alias("path"), is_file.alias("is_file"),
        found.alias("found"),
    ), "license-candidates")


def file_counts(files: DataFrame, text: str) -> DataFrame:
    """``(token, files)``: in how many files each token stands."""
    each = files.select(F.explode(F.array_distinct(tokens(named(text)))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("files"))


def own_licences(rows: DataFrame, files: DataFrame, text: str, settings: Settings) -> DataFrame:
    """``(row, best)`` with ``best`` the struct ``cosine, licence`` of each row's best candidate."""
    spark = rows.sparkSession
    n = rows.count()
    most = math.log(1 / RARE) + 1.0
    each = rows.where(F.size("found") > 0).select("row", F.posexplode("found").alias("place", "tokens"))
    terms = each.select("row", "place", F.explode("tokens").alias("token")).groupBy("row", "place", "token").agg(F.count("*").alias("n"))
    vocabulary = sorted({t for _, _, c in template_counts() for t in c})
    wanted = terms.select("token").distinct().unionByName(spark.createDataFrame([(t,) for t in vocabulary], "token string")).distinct()
    counts = stored(file_counts(files, text).join(wanted, "token", "left_semi"), "license-tokens")
    counted = {r["token"]: r["files"] for r in counts.where(F.col("token").isin(vocabulary)).collect()}
    idf = lambda t: min(math.log((1 + n) / (1 + counted.get(t, 0))) + 1.0, most)
    listed = []
    for name, i, c in template_counts():
        norm = math.sqrt(sum((k * idf(t)) ** 2 for t, k in c.items()))
        listed += [(t, name, i, k * idf(t) / norm) for t, k in c.items()]
    templates = spark.createDataFrame(listed, "token string, licence string, version int, share double")
    weights = counts.select("token", F.least(F.log((1 + n) / (1 + F.col("files"))) + 1.0, F.lit(most)).alias("idf"))
    terms = terms.join(weights, "token").withColumn("weight", F.col("n") * F.col("idf"))
    norms = terms.groupBy("row", "place").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = terms.join(F.broadcast(templates), "token").groupBy("row", "place", "licence", "version").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    scored = dots.join(norms, ["row", "place"]).select("row", "licence", cosine.alias("cosine")).where(F.col("cosine") >= settings.cosine)
    return scored.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("best")).select(
        "row", F.struct((-F.col("best.less")).alias("cosine"), F.col("best.licence").alias("licence")).alias("best"))


def inherited(rows: DataFrame) -> DataFrame:
    """``(dir, licence, source)``: for every directory the licence of the nearest one, itself included, that has one.
    ``rows``: ``(dir, path, is_file, best)``."""
    speaks = rows.where("is_file and best is not null and dir is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("best.cosine")).alias("less"), "path", F.col("best.licence").alias("licence"))).alias("b")
    ).select(F.col("dir").alias("above"), F.col("b.licence").alias("licence"), F.col("b.path").alias("source"))
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = rows.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(F.array_distinct(chain)).alias("depth", "above"))
    nearest = F.max_by(F.struct("licence", "source"), F.col("depth")).alias("n")
    return above.join(speaks, "above").groupBy("dir").agg(nearest).select("dir", "n.licence", "n.source")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per file: key, ``path``, ``licence`` and ``cosine`` of its own, ``inherited`` and ``inherited_from``."""
    rows = candidates(files, key, path, text, settings)
    own = rows.select("row", "key", "path", "is_file", parent(F.col("path")).alias("dir")).join(own_licences(rows, files, text, settings), "row", "left")
    own = stored(own, "own-licences")
    from_above = inherited(own).withColumnsRenamed({"licence": "inherited", "source": "inherited_from"})
    bare = F.col("best").isNull()
    return own.join(from_above, "dir", "left").select(
        F.col("key").alias(key), "path", F.col("best.licence").alias("licence"), F.col("best.cosine").alias("cosine"),
        F.when(bare, F.col("inherited")).alias("inherited"), F.when(bare, F.col("inherited_from")).alias("inherited_from"),
    )
