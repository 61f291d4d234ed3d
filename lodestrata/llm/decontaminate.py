"""Benchmark decontamination by winnowing.

Texts are reduced to their letters, digits and non-ASCII characters in lower case, as UTF-8 bytes
(so case, spacing and punctuation don't hide a copy). Of each window of WINDOW consecutive K-grams
the least hash is kept as a fingerprint. Fingerprints of documents and benchmark items are
joined, and each hit is extended along its diagonal to the whole runs of equal bytes. Any shared
span of at least SPAN = K + WINDOW - 1 bytes contains a whole window, so it is always found; spans
that are shorter aren't reported.

If the benchmark's text is under BROADCAST_BYTES, its index goes to every worker and one pass over
the documents does it all; beyond that, fingerprints are joined by a shuffle, hits are gathered for each pair of texts,
and each such pair is fetched once, by hashes of the texts. Both ways extend hits on the texts themselves, with the same result.

Defined results: null texts, and texts with under SPAN such bytes, on either side, give no spans.
Items or documents that repeat give a row for each. An empty table of either side gives no rows, and with an empty
benchmark all documents stay. Rows with a null doc_id or item_id are searched as any other. Texts are searched to
their end, however long; of texts that repeat themselves, each shift at which they agree gives its own spans. Of
equal hashes in a window all are kept. Offsets count bytes of the reduced texts. Other columns, whatever
their names, are ignored by `find` and passed through by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm.session import fresh, tuned

K, WINDOW = 24, 25
SPAN = K + WINDOW - 1
BROADCAST_BYTES = 64 << 20
_NEVER = np.uint32(0xFFFFFFFF)
_TABLE_BITS = 22
#: Hits that are looked at together, about.
HITS = 1 << 20
SCHEMA = "doc_id long, item_id long, doc_start long, doc_end long, item_start long"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of that width."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def reduced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = textkit.CLASSES[data] == textkit.WORD
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def winnow(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the fingerprints of reduced texts that lie one after another."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    n = len(data) - K + 1
    if n < WINDOW:
        return none
    sums = textkit.prefix(data)
    h = (((sums[K:] - sums[:-K]) * textkit.powers(len(sums))[1][:n]) >> np.uint64(32)).astype(np.uint32)
    for edge in offsets[1:-1]:  # K-grams over two texts
        h[max(0, edge - K + 1) : edge] = _NEVER
    least = _slide(h, WINDOW, np.minimum)
    # A K-gram is chosen if it is the least of some window that holds it.
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 : n] = least
    at = np.flatnonzero((_slide(padded, WINDOW, np.maximum) == h) & (h != _NEVER))
    return at, h[at]


class Index:
    """A benchmark's fingerprints and reduced texts."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        self.ids, self.items, at, prints, of = ids, [], [], [], []
        for _, data, offsets in textkit.chunks(texts):
            data, offsets = reduced(data, offsets)
            position, h = winnow(data, offsets)
            item = np.searchsorted(offsets, position, "right") - 1
            of.append(item + len(self.items))
            at.append(position - offsets[item])
            prints.append(h)
            self.items += [data[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if prints:
            h = np.concatenate(prints)
            order = np.argsort(h, kind="stable")
            self.prints, self.of, self.at = h[order], np.concatenate(of)[order], np.concatenate(at)[order]
        else:
            self.prints, self.of, self.at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.prints >> np.uint32(32 - _TABLE_BITS)] = True

    def hits(self, position: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, position in the item) of the hits, about HITS of them at a time."""
        maybe = self.table[h >> np.uint32(32 - _TABLE_BITS)]
        position, h = position[maybe], h[maybe]
        low = np.searchsorted(self.prints, h, "left")
        count = np.searchsorted(self.prints, h, "right") - low
        position, low, count = position[count > 0], low[count > 0], count[count > 0]
        total = np.cumsum(count)
        at = 0
        while at < len(count):
            end = max(at + 1, int(np.searchsorted(total, total[at] - count[at] + HITS, "right")))
            some = count[at:end]
            entry = np.repeat(low[at:end] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            yield np.repeat(position[at:end], some), self.of[entry], self.at[entry]
            at = end


def spans(text: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(start, end, start in the item) of runs of SPAN or more equal bytes, where the item's start lies at `shift`."""
    a, b = max(0, shift), min(len(text), shift + len(item))
    if b - a < SPAN:
        return []
    same = np.concatenate([[False], text[a:b] == item[a - shift : b - shift], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a + int(s), a + int(e), a + int(s) - shift) for s, e in edges.reshape(-1, 2) if e - s >= SPAN]


def search(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, start in the item) of each span that a text shares with an item."""
    for first, data, offsets in textkit.chunks(texts):
        data, offsets = reduced(data, offsets)
        position, h = winnow(data, offsets)
        seen: set[tuple[int, int, int]] = set()
        for p, item, q in index.hits(position, h):
            row = np.searchsorted(offsets, p, "right") - 1
            for key in map(tuple, np.unique(np.stack([row, item, p - offsets[row] - q], axis=1), axis=0).tolist()):
                if key not in seen:
                    seen.add(key)
                    for start, end, inside in spans(data[offsets[key[0]] : offsets[key[0] + 1]], index.items[key[1]], key[2]):
                        yield first + key[0], key[1], start, end, inside


def small_index(benchmark: DataFrame, most: int = BROADCAST_BYTES) -> Index | None:
    """The benchmark's index, or None if its text is larger than may be broadcast."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most:
        return None
    rows = items.orderBy("item_id", "text").toArrow()
    return Index(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks())


def _hashed(rows: DataFrame, key: str, high: str) -> DataFrame:
    """The rows with two hashes of their text; where its spans matter, texts themselves decide."""
    return rows.withColumns({key: F.xxhash64("text"), high: F.xxhash64(F.lit(1), "text")})


def _shuffled(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, high, text, shifts, item_id, item) for texts (id, text) of both sides that share fingerprints, by a join of those."""

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textkit.chunks(batch.column("text")):
                data, offsets = reduced(data, offsets)
                at, h = winnow(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                of = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(of), batch.column("high").take(of), pa.array(h.astype(np.int64)), pa.array(at - offsets[row])], names=["key", "high", "h", "at"])

    sides = [_hashed(side.where("text is not null"), "key", "high") for side in (documents, benchmark)]
    texts, items = (side.select("key", "high", "text").mapInArrow(fingerprints, "key long, high long, h long, at long") for side in sides)
    hits = texts.withColumnRenamed("at", "p").join(items.withColumnsRenamed({"key": "item_key", "high": "item_high", "at": "q"}), "h")
    pairs = hits.groupBy("key", "high", "item_key", "item_high").agg(F.collect_set(F.col("p") - F.col("q")).alias("shifts"))
    named = sides[1].withColumnsRenamed({"id": "item_id", "text": "item", "key": "item_key", "high": "item_high"})
    return pairs.join(named, ["item_key", "item_high"]).join(sides[0], ["key", "high"])


def _texts(column: pa.Array) -> list[np.ndarray]:
    made = []
    for _, data, offsets in textkit.chunks(column):
        data, offsets = reduced(data, offsets)
        made += [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return made


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_start", "doc_end", "item_start"])


def find(documents: DataFrame, benchmark: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, item_start) of every shared span of SPAN bytes or more."""
    context = tuned(documents.sparkSession).sparkContext
    if (index := small_index(benchmark, most)) is None:

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, item, shifts, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "shifts")), _texts(batch.column("text")), _texts(batch.column("item")), strict=True):
                    rows += [(doc, item, *x) for shift in shifts for x in spans(a, b, shift)]
                yield _rows(rows)

        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        both = _shuffled(docs, benchmark.select(F.col("item_id").cast("long").alias("id"), "text"))
        return both.select("doc_id", "item_id", "shifts", "text", "item").mapInArrow(compare, SCHEMA)
    shared = context.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[row], shared.value.ids[item], start, end, inside) for row, item, start, end, inside in search(batch.column("text"), shared.value)]
            yield _rows(rows)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_clean(documents: DataFrame, benchmark: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that share no such span with the benchmark, with all their columns."""
    context = tuned(documents.sparkSession).sparkContext
    if (index := small_index(benchmark, most)) is None:

        def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = zip(batch.column("shifts").to_pylist(), _texts(batch.column("text")), _texts(batch.column("item")), strict=True)
                yield batch.select(["key", "high"]).filter(pa.array([any(spans(a, b, shift) for shift in shifts) for shifts, a, b in sides], pa.bool_()))

        both = _shuffled(documents.select("text"), benchmark.select(F.col("item_id").cast("long").alias("id"), "text"))
        gone = both.select("key", "high", "shifts", "text", "item").mapInArrow(shares, "key long, high long").distinct()
        key, high = fresh("key", documents.columns), fresh("high", documents.columns)
        gone = gone.withColumnsRenamed({"key": key, "high": high})
        return documents.join(gone, (F.xxhash64(documents["text"]) == F.col(key)) & (F.xxhash64(F.lit(1), documents["text"]) == F.col(high)), "left_anti")
    shared = context.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in search(batch.column("text"), shared.value):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
