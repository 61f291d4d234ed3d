"""A training corpus from raw documents: five stages, each applying one operator.

Each stage takes (spark, docs, sf_dir), with sf_dir the folder of the other tables, and works on
every row its predecessor kept. All but the last return the columns of documents. A stage's rows
are written as Parquet and read again before the next one runs, so a lost executor costs no more
than the stage at hand; what the next one has read is deleted then, so only the last stage's rows stay in the
shared folder. SQL can't express the fitted and hashed decisions, so there is none.

Defined results: an empty table, or one of which a stage keeps nothing, gives no rows. Documents of a null or empty
text go in the first stage. A null doc_id passes all stages (near duplicates aren't sought among such rows); rows of
equal doc_id and text stay or go together; other columns, whatever their names, pass through all stages but the last.
Texts count to their end, however long. Without labels, declared languages or benchmark the stage that needs them
rejects nothing for want of them. Ties are each operator's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontaminate, language, neardup, quality
from lodestrata.llm.session import delete, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds poor or toxic."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language, or of another than they declare."""
    return language.keep_known(docs, language.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a long span with a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, decoded again for comparison."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
