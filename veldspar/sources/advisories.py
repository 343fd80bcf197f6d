"""Packages looked up in a table of advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(packages: DataFrame, advisories: DataFrame | None) -> DataFrame:
    """(package, status, n_advisories): ``disabled`` without ``advisories`` (package, advisory), else ``ok``."""
    p = packages.where("package <> ''").distinct()
    if advisories is None:
        return p.select("package", F.lit("disabled").alias("status"), F.lit(0).alias("n_advisories"))
    n = advisories.where("package is not null").groupBy("package").agg(F.count_distinct("advisory").cast("int").alias("n"))
    return p.join(n, "package", "left").select("package", F.lit("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n_advisories"))
