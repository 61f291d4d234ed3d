"""Exact top-k search: the nearest vectors of each query among all vectors, by cosine.

Vectors are packed into shards of SHARD rows, queries into shards of QUERIES rows, as they are, and
scaled to length 1 where they're used. Every query shard meets every shard in a tile: matrix products
of STRIP columns at a time, whose k best are selected at once. Tiles' lists are merged in a tree,
MERGE lists at a time, so no task ever holds more than two shards or a few lists, whatever the number
of vectors. Scores are rounded to DIGITS places, so that equal vectors tie whatever the order in which
a product was summed; ties go to the smaller vec_id.

Defined results: null vectors, empty ones, ones with nulls or numbers that aren't finite, zero vectors,
and rows without vec_id are neither queries nor results. Vectors are compared within equal lengths
only, however long. Of rows that repeat a vec_id the least vector counts; a query's vector is taken from the
queries, so it may differ from that of its id in the table. A query with fewer than k others has
fewer results; an empty table, or no query, has none. A vector isn't its own neighbour. Other columns
of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestrata.llm.session import cut, tuned

K = 10
SHARD = 4096
QUERIES = 4096
STRIP = 1024
DIGITS = 12
MERGE = 8
PACKED = "size int, q int, ids binary, vectors binary"
TILED = "size int, q int, other int, ids binary, lists binary, scores binary"
SCHEMA = "vec_id long, rank int, neighbour_id long, score double"


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, in order; ids < 0 are empty places."""
    if scores.shape[1] > 4 * k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        # Ties with the last place are kept until ids decide.
        width = max(k, int((scores >= least).sum(axis=1).max()))
        at = np.argpartition(-scores, min(width, scores.shape[1]) - 1, axis=1)[:, :width]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _unit(packed: bytes, size: int, wide: bool) -> np.ndarray:
    v = np.frombuffer(packed, np.float64 if wide else np.float32).reshape(-1, size).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _tile(queries: dict, others: dict, k: int, wide: bool) -> tuple[bytes, bytes]:
    """(lists, scores): for each query of one shard, the k best vectors of another, packed."""
    size = queries["size"]
    a, b = np.frombuffer(queries["ids"], np.int64), np.frombuffer(others["other_ids"], np.int64)
    left, right = _unit(queries["vectors"], size, wide), _unit(others["others"], size, wide)
    made = []
    for at in range(0, len(b), STRIP):
        scores, ids = np.round(left @ right[at : at + STRIP].T, DIGITS), b[at : at + STRIP]
        own = a[:, None] == ids[None, :]
        scores[own] = -np.inf
        made.append(best(np.where(own, -1, ids[None, :]), scores, k))
    found, values = best(*(np.concatenate(x, axis=1) for x in zip(*made, strict=True)), k)
    return found.tobytes(), values.tobytes()


def _merge(table: pa.Table, k: int) -> tuple[bytes, bytes, bytes]:
    rows = table.to_pylist()
    n = len(rows[0]["ids"]) // 8
    ids = np.concatenate([np.frombuffer(r["lists"], np.int64).reshape(n, -1) for r in rows], axis=1)
    scores = np.concatenate([np.frombuffer(r["scores"]).reshape(n, -1) for r in rows], axis=1)
    found, values = best(ids, scores, k)
    return rows[0]["ids"], found.tobytes(), values.tobytes()


def _sound(rows: DataFrame) -> DataFrame:
    """(vec_id, v, size) of the rows that can be compared, one for each id."""
    vectors = rows.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    vectors = vectors.where("vec_id is not null and v is not null").where(sound)
    return vectors.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))


def _shards(vectors: DataFrame, rows: int, wide: bool) -> tuple[DataFrame, dict[int, int]]:
    """Shards of about that many rows, written to the shared folder; how many there are of each length of vectors."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        flat = pc.list_flatten(table.column("v")).combine_chunks().to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        kind = np.float64 if wide else np.float32
        return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "q": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([flat.astype(kind).tobytes()], pa.binary())})

    number = {size: -(-n // rows) for size, n in vectors.groupBy("size").count().collect()}
    if not number:
        return vectors.sparkSession.createDataFrame([], PACKED), {}
    of = F.create_map(*[F.lit(x) for pair in sorted(number.items()) for x in pair])[F.col("size")]
    numbered = vectors.withColumn("q", F.pmod(F.xxhash64("vec_id"), of).cast("int"))
    return cut(numbered.groupBy("size", "q").applyInArrow(pack, PACKED)), number


def search(embeddings: DataFrame, queries: DataFrame | None = None, k: int = K, shard: int = SHARD) -> DataFrame:
    """(vec_id, rank, neighbour_id, score): for every query, the k nearest of all others.

    queries: rows with (vec_id, embedding); every row of the table is a query where they're left out.
    """
    tuned(embeddings.sparkSession)
    wide = any(not isinstance(rows.schema["embedding"].dataType.elementType, FloatType) for rows in (embeddings, queries) if rows is not None)
    packed, number = _shards(_sound(embeddings), shard, wide)
    asked = packed if queries is None else _shards(_sound(queries), min(shard, QUERIES), wide)[0]
    if not number:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lists, scores = _tile(r, r, k, wide)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]], pa.int32()) for c in ("size", "q", "other")), *(pa.array([x], pa.binary()) for x in (r["ids"], lists, scores))], names=["size", "q", "other", "ids", "lists", "scores"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table([*(pa.array([x.as_py()], pa.int32()) for x in key), *(pa.array([x], pa.binary()) for x in _merge(table, k))], names=["size", "q", "other", "ids", "lists", "scores"])

    # A query shard names the shards it has yet to meet; each meets it where that shard is, so a tile's task reads two shards.
    of = F.create_map(*[F.lit(x) for pair in sorted(number.items()) for x in pair])[F.col("size")]
    meets = asked.where(of.isNotNull()).withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    work = meets.join(packed.select("size", F.col("q").alias("other"), F.col("ids").alias("other_ids"), F.col("vectors").alias("others")), ["size", "other"])
    lists = work.mapInArrow(tiles, TILED)
    width = max(number.values())
    while width > 1:
        lists = lists.withColumn("other", F.floor(F.col("other") / MERGE).cast("int")).groupBy("size", "q", "other").applyInArrow(merged, TILED)
        width = -(-width // MERGE)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                found, scores = np.frombuffer(r["lists"], np.int64).reshape(len(ids), -1), np.frombuffer(r["scores"]).reshape(len(ids), -1)
                real = np.isfinite(scores)
                rank = np.broadcast_to(np.arange(1, found.shape[1] + 1, dtype=np.int32), found.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], found.shape)[real]), pa.array(rank[real]), pa.array(found[real]), pa.array(scores[real])], names=["vec_id", "rank", "neighbour_id", "score"])

    return lists.mapInArrow(unpack, SCHEMA)


def search_sql(k: int = K, asked: str = "TRUE") -> str:
    """The same in SQL, for vectors of one length without nulls and queries `asked` of the rows a; scores rounded to 9 places."""
    return f"""
WITH unit AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
scored AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_inner_product(a.v, b.v) / (a.n * b.n) AS s FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE {asked}),
ranked AS (SELECT vec_id, neighbour_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS r FROM scored)
SELECT vec_id, CAST(r AS INTEGER) AS "rank", neighbour_id, round(s, 9) AS score FROM ranked WHERE r <= {k}
"""
