"""Bundles: named sets of files by patterns, with where they go and how large they are.

A bundle table is configuration: (bundle, pattern, destination, size_gb, description). A
pattern is a path below the store's root; * stands for any part of a name, ** for names and
folders, {budget} and {encoder} for what a request narrows it to (any, if it doesn't).
Sets name bundles or other sets.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import alias_closure


@dataclass(frozen=True)
class Bundle:
    """Patterns of one bundle, the folder it goes to, its size as stated and what it is."""

    patterns: tuple[str, ...]
    destination: str
    size_gb: float
    description: str = ""


def resolved(bundles: Mapping[str, Bundle], sets: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> list[str]:
    """The bundles that names of bundles and sets stand for, each once, in order; unknown names and circles are errors."""
    found = {b for name in wanted for b in alias_closure({k: list(v) for k, v in sets.items()}, name)}
    if lost := sorted(found - set(bundles)):
        raise ValueError(f"unknown bundles {lost}; known are {sorted(bundles)} and the sets {sorted(sets)}")
    return sorted(found)


def narrowed(pattern: str, budget: int | None = None, encoder: str | None = None) -> str:
    """The pattern with what is asked for in the place of {budget} and {encoder}."""
    return pattern.replace("{budget}", "*" if budget is None else str(budget)).replace("{encoder}", "*" if encoder is None else encoder)


def expression(pattern: str) -> str:
    """A regular expression for whole paths."""
    parts = re.split(r"(\*\*|\*)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"


def fixed_folders(pattern: str) -> list[str]:
    """The folders before the first wildcard."""
    whole = pattern.split("*")[0].split("/")[:-1] if "*" in pattern else pattern.split("/")[:-1]
    return whole


def bundle_table(spark: SparkSession, bundles: Mapping[str, Bundle], names: Sequence[str], budget: int | None = None, encoder: str | None = None) -> DataFrame:
    """(bundle, pattern, prefix, depth, destination, size_gb, description): a row a pattern."""
    rows = []
    for name in names:
        for p in bundles[name].patterns:
            made = narrowed(p, budget, encoder)
            folders = fixed_folders(made)
            rows.append((name, expression(made), "/".join(folders), len(folders), bundles[name].destination, bundles[name].size_gb, bundles[name].description))
    return spark.createDataFrame(rows, "bundle string, pattern string, prefix string, depth int, destination string, size_gb double, description string")


def bundle_members(listing: DataFrame, table: DataFrame) -> DataFrame:
    """(bundle, path, bytes, target) of the files of a listing (path, bytes) that belong to bundles.

    Patterns meet paths by an equi-join on their fixed folders, one for each number of
    folders that patterns have, and are matched only then. target is the path below the
    destination, from the pattern's fixed folders on. A file that two patterns of a bundle
    hold is there once.
    """
    # As many as patterns have numbers of folders, which is configuration.
    depths = [r["depth"] for r in table.select("depth").distinct().orderBy("depth").collect()]
    folders = F.split("path", "/")
    starts = F.array(*[F.struct(F.lit(d).alias("depth"), F.array_join(F.slice(folders, 1, d), "/").alias("prefix")) for d in depths])
    each = listing.select("path", "bytes", F.explode(F.filter(starts, lambda s: s["depth"] < F.size(folders))).alias("s")).select("path", "bytes", "s.depth", "s.prefix")
    met = each.join(F.broadcast(table), ["depth", "prefix"]).where(F.expr("rlike(path, pattern)"))
    rest = F.when(F.col("depth") > 0, F.expr("substring(path, length(prefix) + 2)")).otherwise(F.col("path"))
    target = F.concat_ws("/", F.rtrim(F.col("destination"), F.lit("/")), rest)
    return met.select("bundle", "path", "bytes", target.alias("target")).groupBy("bundle", "path").agg(F.min("bytes").alias("bytes"), F.min("target").alias("target"))


def bundle_sizes(members: DataFrame, table: DataFrame) -> DataFrame:
    """(bundle, files, bytes, size_gb): what a listing holds of each bundle, beside what the table states; a bundle without a file is an error."""
    stated = table.groupBy("bundle").agg(F.min("size_gb").alias("size_gb"))
    held = members.groupBy("bundle").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    lost = F.when(F.col("files").isNull(), F.raise_error(F.concat(F.lit("no file of "), F.col("bundle"))).cast("long")).otherwise(F.col("files"))
    return stated.join(held, "bundle", "left").select("bundle", lost.alias("files"), "bytes", "size_gb")
