"""A bounded, repeatable sample of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.session import fresh

#: Rows of a stratum that are ranked for each that is wanted, and besides; by hash, so hardly ever are too few left.
TIMES, BESIDES = 3, 200


def strata(labelled: DataFrame, key: str, by: list[str], most: int) -> DataFrame:
    """At most `most` rows of each combination of `by`, those whose key hashes lowest; nulls are left out.

    A stratum's size says how low hashes must be to be ranked at all, so one task never ranks a whole stratum.
    """
    n, low, rank = (fresh(x, labelled.columns) for x in ("n", "low", "rank"))
    sound = labelled.na.drop(subset=[key, *by])
    sizes = sound.groupBy(*by).agg(F.count("*").alias(n))
    hashed = sound.withColumn(low, F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))).join(sizes, by)
    few = hashed.where(F.col(low) * F.col(n) < TIMES * most + BESIDES)
    order = Window.partitionBy(*by).orderBy(low, key)
    return few.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most).drop(n, low, rank)
