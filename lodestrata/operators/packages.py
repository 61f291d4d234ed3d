"""Packages and modules: discovery, collisions, the package tree, totals and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import names

ROOT = "__root__"


def modules(paths: DataFrame) -> DataFrame:
    """(module, package, path, is_package, source) of Python files (path, source)."""
    python = paths.where(F.col("path").endswith(".py"))
    module = names.module_name(F.col("path"))
    return python.select(module.alias("module"), names.package_of(module).alias("package"), "path", F.col("path").rlike(r"(^|/)__init__\.py$").alias("is_package"), "source")


def collisions(found: DataFrame) -> DataFrame:
    """Modules that several sources have: an error for skeletons."""
    return found.groupBy("module").agg(F.count("*").alias("n_sources")).where("n_sources > 1")


def package_tree(found: DataFrame) -> DataFrame:
    """(name, subpackages, modules) of every package, and of those above it up to the root."""
    plain = found.where("not is_package").select("module", "package")
    own = found.where("is_package").select(F.col("module").alias("name"))
    named = plain.where(F.col("package") != ROOT).select(F.col("package").alias("name")).unionByName(own).distinct()
    every = named.select(F.explode(names.prefixes(F.col("name"))).alias("name")).distinct()
    below = every.select(names.package_of(F.col("name")).alias("name"), F.col("name").alias("child")).groupBy("name").agg(F.sort_array(F.collect_set("child")).alias("subpackages"))
    held = plain.groupBy(F.col("package").alias("name")).agg(F.sort_array(F.collect_set("module")).alias("modules"))
    none = F.array().cast("array<string>")
    root = found.sparkSession.range(1).select(F.lit(ROOT).alias("name"))
    tree = every.unionByName(root).join(below, "name", "left").join(held, "name", "left")
    return tree.select("name", F.coalesce("subpackages", none).alias("subpackages"), F.coalesce("modules", none).alias("modules"))


def totals(symbols: DataFrame) -> DataFrame:
    """Modules, classes and functions, methods of top-level classes among the latter."""
    methods = F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c["methods"]))
    return symbols.agg(
        F.count("*").alias("total_modules"),
        F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("total_classes"),
        F.coalesce(F.sum(F.size("functions") + methods), F.lit(0)).alias("total_functions"),
    )


def find(symbols: DataFrame, kind: str, name: str) -> DataFrame:
    """(module, line) of the classes or functions (kind) of that name."""
    return symbols.select("module", F.explode(kind).alias("s")).where(F.col("s.name") == name).select("module", F.col("s.line").alias("line"))


def get(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The row of the module (column module) or package (column name) of that name, if there is one; sources with the name give a row each."""
    return rows.where(F.col(column) == name)
