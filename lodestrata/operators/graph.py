"""Import graphs: edges, what can't be resolved, and closures in both directions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import names


def cut(df: DataFrame) -> DataFrame:
    """Lineage is cut in the folder that the cluster names; only on one machine, where none is set, in a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def edges(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, target, resolved, is_local) of each distinct import.

    parsed: (module, is_package, edges). `from m import x` counts as an import of m, and of m.x if that
    is a module; `from . import x` as one of the sibling x.
    """
    each = parsed.select("module", "is_package", F.explode("edges").alias("e"))
    # A module's package is its own name or the name without its last part; level 1 starts there.
    package = F.when(F.col("is_package"), F.col("module")).otherwise(F.when(names.package_of(F.col("module")) == "__root__", "").otherwise(names.package_of(F.col("module"))))
    parts = F.filter(F.split(package, r"\."), lambda p: p != "")
    up = F.col("e.level") - 1
    above = F.raise_error(F.concat(F.lit("a relative import leads above the top: "), F.col("module"))).cast("string")
    base = F.when(F.col("e.level") == 0, "").when(up > F.size(parts), above).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "."))
    full = lambda *x: F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in x]), lambda p: p != ""), ".")
    each = each.withColumn("base", base)
    star = F.col("e.name") == "*"
    # All targets of an import in one pass, for each pass parses anew; `sure` ones count whether or not they are modules.
    target = lambda name, sure: F.struct(name.alias("target"), F.lit(sure).alias("sure"))
    none = F.array().cast("array<struct<target: string, sure: boolean>>")
    whole = F.array(target(full(F.col("base"), F.col("e.module")), True))
    maybe = F.array(target(full(F.col("base"), F.col("e.module"), F.col("e.name")), False))
    sibling = F.array(target(full(F.col("base"), F.col("e.name")), True))
    made = F.when(~F.col("e.is_from"), F.array(target(F.col("e.name"), True))).when(F.col("e.module").isNotNull() & star, whole).when(F.col("e.module").isNotNull(), F.concat(whole, maybe)).when(~star, sibling).otherwise(none)
    found = each.select("module", F.explode(made).alias("t")).groupBy("module", "t.target").agg(F.max("t.sure").alias("sure"))
    known = modules.select(F.col("module").alias("target"))
    found = found.join(known.distinct().withColumn("resolved", F.lit(True)), "target", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    found = found.where(F.col("sure") | F.col("resolved")).drop("sure")
    tops = modules.select(F.split_part("module", F.lit("."), F.lit(1)).alias("top")).distinct().withColumn("is_local", F.lit(True))
    found = found.withColumn("top", F.split_part("target", F.lit("."), F.lit(1))).join(tops, "top", "left")
    return found.select("module", "target", "resolved", F.coalesce("is_local", F.lit(False)).alias("is_local"))


def unresolved(imports: DataFrame) -> DataFrame:
    """Imports of local names that aren't there: errors."""
    return imports.where(~F.col("resolved") & F.col("is_local")).select("module", "target")


def reverse_index(imports: DataFrame) -> DataFrame:
    """(target, importers): who imports each module."""
    return imports.where("resolved").groupBy("target").agg(F.sort_array(F.collect_set("module")).alias("importers"))


def closure(start: DataFrame, links: DataFrame, key: str = "module") -> DataFrame:
    """(key, depth, parent): all that can be reached from `start` (key) along `links` (src, dst), breadth first.

    Each round joins only the newest nodes with the links and drops those seen, which are one table, cut anew each round.
    Links are cut once, as they lie for the join. The depth is the least; of several parents the least.
    """
    kind = links.schema["src"].dataType
    links = cut(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    newest = seen = cut(start.select(F.col(key).alias("node")).where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")))
    depth = 0
    while True:
        depth += 1
        step = newest.join(links, newest["node"] == links["src"]).groupBy(links["dst"].alias("node")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent"))
        newest = cut(step.join(seen.select("node"), "node", "left_anti").select("node", "depth", "parent"))
        if newest.isEmpty():
            return seen.withColumnRenamed("node", key)
        seen = cut(seen.unionByName(newest))


def forward_closure(start: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that `start` needs, the packages above each of them included."""
    inside = modules.select("module", "is_package").withColumn("above", F.explode(names.prefixes(F.col("module"))))
    packages = modules.where("is_package").select(F.col("module").alias("above"))
    above = inside.where("above <> module").join(packages, "above", "left_semi").select(F.col("module").alias("src"), F.col("above").alias("dst"))
    return closure(start, imports.where("resolved").select(F.col("module").alias("src"), F.col("target").alias("dst")).unionByName(above))


def reverse_closure(target: str, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that need the target, or anything below it."""
    start = modules.where((F.col("module") == target) | F.startswith("module", F.lit(f"{target}."))).select("module")
    return closure(start, imports.where("resolved").select(F.col("target").alias("src"), F.col("module").alias("dst")))


def chain(reached: DataFrame, node: str, key: str = "module") -> list[str]:
    """How the closure came to a node, from the start; for messages."""
    out = [node]
    while (row := reached.where(F.col(key) == out[-1]).select("parent").first()) is not None and row[0] is not None:
        out.append(row[0])
    return out[::-1]
