"""A source tree made of the driver's tables, so that every operator can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of tables that are dealt out, also while a cluster's executors are still joining.
LEAST_TASKS = 24
ENDS = (".md", ".txt", ".json", ".py", ".log")
#: The same tree in SQL.
FILES_SQL = """files AS (
    SELECT doc_id, lang || '/' || source || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 9, '0')
        || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.json' WHEN 3 THEN '.py' ELSE '.log' END AS path,
        lang AS dir1, lang || '/' || source AS dir2, text AS content, octet_length(encode(text)) AS size_bytes FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out in turn to several tasks a core: a table of few bytes is read by one task, though each of its rows may be long work."""
    return rows.repartition(max(LEAST_TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content, size_bytes): a file for each document."""
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), end)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


PYTHON = r'''concat('"""', 'Customer ', c_name, '.', '\n\nMore of it.\n"""\nimport os\nfrom pkg.nation_', c_nationkey, ' import thing, other\n\nLIMIT = ', c_custkey,
'\n_hidden = 1\n\n\n@dataclass(frozen=True)\nclass C', c_custkey, '(BaseModel):\n    """Of nation ', c_nationkey, '."""\n    size: int = ', c_nationkey,
'\n\n    def area(self, scale: float = 2.0) -> float:\n        return ', c_custkey, '\n\n\nasync def f', c_custkey, '(a, /, b: str, *rest, c=', c_nationkey, ', **more) -> int:\n    return 1\n')'''


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_nationkey, c_name, module, content): a Python module for each customer."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    return spread(rows).withColumn("module", F.expr("concat('pkg.customer_', c_custkey)")).withColumn("content", F.expr(PYTHON))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): a module for each customer, in the package of its nation, in that of its region."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clean = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))
    return joined.select(F.concat_ws("/", clean("r_name"), clean("n_name"), F.concat(clean("c_name"), F.lit(".py"))).alias("path"), F.lit(0).alias("source"))


MODULES_SQL = """modules AS (
    SELECT lower(regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g')) AS p1,
        lower(regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g')) || '.' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) AS p2,
        lower(regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g')) || '.' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) || '.' || lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')) AS module
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, target, resolved, is_local): document n imports n / 2 and n / 3; odd ones a local module that isn't there."""
    ids = table(spark, sf_dir, "documents").select("doc_id").where("doc_id is not null").distinct()
    each = ids.select("doc_id", F.explode(F.array(F.expr("doc_id div 2"), F.expr("doc_id div 3"))).alias("to")).where("to <> doc_id")
    made = each.join(ids.select(F.col("doc_id").alias("to"), F.lit(True).alias("resolved")), "to", "left")
    name = lambda c: F.concat(F.lit("docs.d"), F.col(c).cast("string"))
    found = made.select(name("doc_id").alias("module"), name("to").alias("target"), F.coalesce("resolved", F.lit(False)).alias("resolved"), F.lit(True).alias("is_local"))
    lost = ids.where("doc_id % 2 = 1").select(name("doc_id").alias("module"), F.concat(F.lit("docs.gone"), F.col("doc_id").cast("string")).alias("target"), F.lit(False).alias("resolved"), (F.col("doc_id") % 3 > 0).alias("is_local"))
    return found.distinct().unionByName(lost)


def documents_as_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, is_package): a module for each document, and the package that holds them."""
    ids = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.expr("concat('docs.d', doc_id)").alias("module"), F.lit(False).alias("is_package")).distinct()
    return ids.unionByName(spark.range(1).select(F.lit("docs").alias("module"), F.lit(True).alias("is_package")))


IMPORTS_SQL = """ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
pairs AS (SELECT doc_id, doc_id // 2 AS dst FROM ids UNION SELECT doc_id, doc_id // 3 FROM ids),
links AS (SELECT DISTINCT 'docs.d' || p.doc_id AS src, 'docs.d' || p.dst AS dst, i.doc_id IS NOT NULL AS resolved FROM pairs p LEFT JOIN ids i ON i.doc_id = p.dst WHERE p.dst <> p.doc_id)"""
