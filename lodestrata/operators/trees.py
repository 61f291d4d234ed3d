"""Trees of paths as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import ignore


def structure(paths: DataFrame) -> DataFrame:
    """(key, line): the lines of the tree of (path, is_dir); sorted by `key` they read from top to bottom.

    Names sort by themselves within their directory, files and directories alike.
    """
    clean = paths.where("path not in ('', '.')")
    above = clean.select(F.explode(ignore.ancestors(F.col("path"))).alias("path"), F.lit(True).alias("is_dir"))
    # A path that is both is shown as a directory.
    every = clean.select("path", "is_dir").unionByName(above).groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    parts = F.split("path", "/")
    line = F.concat(F.repeat(F.lit("  "), F.size(parts) - 1), F.element_at(parts, -1), F.when(F.col("is_dir"), "/").otherwise(""))
    return every.select(parts.alias("key"), line.alias("line"))


def with_tokens(counts: DataFrame) -> DataFrame:
    """(key, line) of the tree of (path, n_tokens): directories first, then files with their counts."""
    above = counts.select(F.explode(ignore.ancestors(F.col("path"))).alias("path")).distinct().withColumn("n_tokens", F.lit(None).cast("long"))
    every = counts.select("path", "n_tokens").unionByName(above)
    parts = F.split("path", "/")
    depth = F.size(parts)
    rank = F.transform(parts, lambda p, k: F.struct(F.when((k == depth - 1) & F.col("n_tokens").isNotNull(), 1).otherwise(0).alias("is_file"), p.alias("name")))
    shown = F.when(F.col("n_tokens").isNull(), "/").otherwise(F.concat(F.lit(" ("), F.format_number("n_tokens", 0), F.lit(")")))
    return every.select(rank.alias("key"), F.concat(F.repeat(F.lit("  "), depth - 1), F.element_at(parts, -1), shown).alias("line"))


def lines(tree: DataFrame) -> list[str]:
    """The lines in order, for an artifact's prefix."""
    return [r.line for r in tree.orderBy("key").toLocalIterator()]
