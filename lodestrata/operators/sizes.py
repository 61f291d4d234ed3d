"""Splitting and fitting to a budget: folds over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TooLarge(ValueError):
    """One block alone is larger than a part may be."""


def next_fit(blocks: DataFrame, limit: int, first: int = 0, later: int = 0, end: int = 0) -> DataFrame:
    """(path, size, part): blocks in order of path fill one part after another.

    A part holds a prefix (`first` or `later`), its blocks and a suffix (`end`). The fold is sequential by
    nature, and over sizes alone: only (path, size) goes through it, in one sorted partition.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = 1, 0
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                room = limit - (first if part == 1 else later) - end
                if used and used + size > room:
                    part, used, room = part + 1, 0, limit - later - end
                if not used and size > room:
                    raise TooLarge(f"{path} alone exceeds the limit of a part")
                used += size
                out.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["path", "size", "part"])

    ordered = blocks.select("path", F.col("size").cast("long")).repartition(1).sortWithinPartitions("path")
    return ordered.mapInArrow(fold, "path string, size long, part int")


def downgrades(candidates: DataFrame, over: int) -> DataFrame:
    """The fewest of (path, savings), the largest savings first and paths in order, that save `over`.

    Ranges of savings are summed first, and only those that are needed are ordered row by row, each beside what all
    larger ones save; so no task sorts more than a range.
    """
    sound = candidates.where("savings > 0").select("path", "savings")
    width = F.floor(F.log2("savings") * 4).cast("int")  # four ranges for each doubling
    ranged = sound.withColumn("range", width)
    sums = ranged.groupBy("range").agg(F.sum("savings").alias("whole"))
    before = F.coalesce(F.sum("whole").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = sums.withColumn("before", before).where(F.col("before") < over).select("range", "before")
    inside = Window.partitionBy("range").orderBy(F.desc("savings"), "path").rowsBetween(Window.unboundedPreceding, 0)
    saved = ranged.join(F.broadcast(needed), "range").withColumn("saved", F.col("before") + F.sum("savings").over(inside))
    return saved.where(F.col("saved") - F.col("savings") < over).select("path", "savings", "saved")


def largest(files: DataFrame, most: int) -> DataFrame:
    """The `most` largest of (path, size_bytes), paths in order among equal ones."""
    return files.select("path", "size_bytes").orderBy(F.desc("size_bytes"), "path").limit(most)
