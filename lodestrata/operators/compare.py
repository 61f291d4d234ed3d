"""Manifests and comparison of directories by content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import ignore

MANIFEST = "manifest.json"


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of (path, content), the manifest itself left out."""
    return files.where(F.col("path") != MANIFEST).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) where two manifests differ: missing, extra, or changed."""
    both = expected.select("path", F.col("sha256").alias("a")).join(actual.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def missing(required: DataFrame, found: DataFrame, rules: Sequence[ignore.Rule] = (), include: Sequence[str] = ()) -> DataFrame:
    """(path, reason) of the required paths that weren't found: what filtered them out, or that they can't be read."""
    path = F.col("path")
    reason = F.when(~ignore.included_column(include, path), "does not match the include patterns").when(ignore.hidden_column(rules, path, False), "excluded by ignore rules")
    return required.select("path").distinct().join(found.select("path"), "path", "left_anti").select("path", reason.otherwise("not there, or a link that isn't followed").alias("reason"))


def first(found: DataFrame, most: int = 50) -> DataFrame:
    """(n, line): the first `most` differences in order of path, and a last line that tells how many more there are."""
    line = F.concat("status", F.lit(": "), "path")
    kept = found.orderBy("path").limit(most).withColumn("n", F.row_number().over(Window.orderBy("path"))).select("n", line.alias("line"))
    more = found.agg((F.count("*") - most).alias("more")).where("more > 0")
    return kept.unionByName(more.select(F.lit(most + 1).alias("n"), F.concat(F.lit("... and "), "more", F.lit(" more")).alias("line")))


def report(found: DataFrame, most: int = 50) -> list[str]:
    """The same as lines, on the driver."""
    return [r.line for r in first(found, most).orderBy("n").collect()]
