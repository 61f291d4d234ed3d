"""Stupid-backoff language-model scores of documents, under the corpus's own n-gram counts.

Tokens are runs of anything but ASCII white space, in lower case. A token's score is
count(n-gram) / count(history) for the longest n-gram, up to ORDER, that the corpus has (the
document itself included), times ALPHA for each order given up; single tokens score count / all tokens.
A document's score is the sum of its tokens' logarithms.

All documents are hashed into blocks of about BLOCK_BYTES. A block explodes its texts into
n-grams and sends each distinct one once, as a hash with its count, to the count table's
partition that the hash names; the partition adds up what all blocks sent, and answers each
block with the counts of what it sent, in the order sent. So a row of the shuffle carries
thousands of n-grams, whatever the size of the corpus. Higher orders follow in rounds: an n-gram
whose prefix or suffix occurs once in the corpus occurs once itself, so it counts 1 without being sent.

Defined results: null and empty texts have 0 tokens, score 0 and no mean. Rows are scored one by one, so
repeated rows, or ids, count and score as often as they occur; a null doc_id is scored as any other.
N-grams are told apart by 56 bits of a hash. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm.session import cut, tuned

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20
TOGETHER = 32
#: Of text for each partition of the count table, at most.
PART_BYTES = 32 << 20
SENT = "part int, block long, n int, width int, size int, hashes binary, counts binary"
ANSWER = "block long, n int, part int, counts binary"
SCORED = "doc_id long, n_tokens long, known double, unigrams long"


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; 255 stands for those of 32 bits that follow all bytes, in order."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def unpack_counts(packed: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, np.uint32, offset=size)
    return counts


def pack_hashes(sorted_hashes: np.ndarray) -> tuple[int, bytes]:
    """(bytes for each, differences of rising numbers); bytes of one weight lie together, for the high ones compress."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return width, zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_hashes(packed: bytes, width: int, size: int) -> np.ndarray:
    gaps = np.zeros((size, 8), np.uint8)
    planes = zstandard.ZstdDecompressor().decompress(packed, max_output_size=width * size)
    gaps[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, piece): texts of one block that lie together, as one compressed table."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        table = pa.Table.from_batches([batch.select(["doc_id", "text"])]).take(pa.array(order))
        edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]])) if len(block) else []
        made = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=options) as writer:
                writer.write_table(table.slice(a, b - a).combine_chunks())
            made.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(block[order][edges[:-1]] if len(block) else [], pa.int64()), pa.array(made, pa.binary())], names=["block", "piece"])


def unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("piece")])


class Block:
    """The tokens of a block's texts, and the counts of its n-grams as far as they are known."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        hashes, rows, self.rows, base = [], [], len(texts), 0
        for chunk in texts.chunks:
            for first, data, offsets in textkit.chunks(chunk):
                start, end, _, text = textkit.tokens(data, offsets, textkit.SOLID)
                if len(start):
                    hashes.append(textkit.span_hash(textkit.prefix(data), start, end))
                    rows.append(text + first + base)
            base += len(chunk)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.counts: dict[int, np.ndarray] = {}

    def inside(self, n: int) -> np.ndarray:
        """For each token with n - 1 more after it in the block, whether they are of one text."""
        return self.row[n - 1 :] == self.row[: max(0, len(self.row) - n + 1)]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the last token) of the n-grams that may occur more than once, as far as is known."""
        if n == 1:
            return self.h, np.arange(len(self.h))
        if len(self.h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        use = self.inside(n)
        if (lower := self.counts.get(n - 1)) is not None and n > 2:
            use &= (lower[n - 1 :] > 1) & (lower[n - 2 : -1] > 1)
        start = np.flatnonzero(use)
        out = self.h[start]
        for k in range(1, n):
            out = out * np.uint64(textkit.BASE) + self.h[start + k]
        return textkit.mix(out), start + n - 1

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rising distinct hashes, counts, for each n-gram its place among them, its last token)."""
        h, last = self.grams(n)
        order = np.argsort(h, kind="stable")
        rising = h[order] >> np.uint64(8)
        new = np.ones(len(h), bool)
        new[1:] = rising[1:] != rising[:-1]
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        return rising[begin], np.diff(np.append(begin, len(h))), at, last

    def learn(self, answers: pa.Table, most: int) -> None:
        """Takes the answers for the orders up to `most`; there are none where nothing had to be sent."""
        for n in range(1, most + 1):
            mine = answers.filter(pc.equal(answers.column("n"), n)).sort_by("part").column("counts").to_pylist()
            hashes, _, at, last = self.distinct(n)
            sizes = [int.from_bytes(x[:4], "little") for x in mine]
            found = np.concatenate([unpack_counts(x[4:], s) for x, s in zip(mine, sizes, strict=True)] or [np.zeros(0, np.int64)])
            assert len(found) == len(hashes), "an answer is missing"
            self.counts[n] = np.zeros(len(self.h), np.int64)
            self.counts[n][n - 1 :] = self.inside(n)  # those not sent occur once
            self.counts[n][last] = found[at]


def _send(block: int, made: Block, orders: list[int], parts: int) -> pa.Table:
    rows = []
    for n in orders:
        hashes, counts, _, _ = made.distinct(n)
        part = ((hashes >> np.uint64(24)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(edges)):
            a, b = edges[k], edges[k + 1]
            width, packed = pack_hashes(hashes[a:b])
            rows.append((int(k), block, n, width, int(b - a), packed, pack_counts(counts[a:b])))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "block", "n", "width", "size", "hashes", "counts"])


def _tally(sent: pa.Table) -> pa.Table:
    """One partition of the count table: totals of all blocks, and an answer to each of them."""
    out = []
    for n in sorted(set(sent.column("n").to_pylist())):
        rows = sent.filter(pc.equal(sent.column("n"), n)).to_pylist()
        hashes = np.concatenate([unpack_hashes(r["hashes"], r["width"], r["size"]) for r in rows])
        counts = np.concatenate([unpack_counts(r["counts"], r["size"]) for r in rows])
        order = np.argsort(hashes, kind="stable")
        rising = hashes[order]
        begin = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]]))
        total = np.add.reduceat(counts[order], begin)
        mine = np.empty(len(hashes), np.int64)
        mine[order] = np.repeat(total, np.diff(np.append(begin, len(hashes))))
        last = 0
        for r in rows:
            size = r["size"]
            out.append((r["block"], n, r["part"], size.to_bytes(4, "little") + pack_counts(mine[last : last + size])))
            last += size
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["block", "n", "part", "counts"])


def _score(ids: pa.ChunkedArray, made: Block, order: int) -> pa.Table:
    """Sums of what is known without the number of all tokens, and how often that is needed."""
    total, unigrams = np.zeros(made.rows), np.zeros(made.rows, np.int64)
    count = np.bincount(made.row, minlength=made.rows)
    if len(made.h):
        length = np.arange(len(made.h)) - np.searchsorted(made.row, made.row)  # tokens before, in the text
        left = np.ones(len(made.h), bool)
        value = np.zeros(len(made.h))
        for n in range(order, 0, -1):
            c = made.counts.get(n, np.zeros(len(made.h), np.int64))
            here = left & (c > 0) & (length >= n - 1)
            value[here] = np.log(c[here]) + math.log(ALPHA) * (np.minimum(length[here], order - 1) - (n - 1))
            if n > 1:
                value[here] -= np.log(made.counts[n - 1][np.flatnonzero(here) - 1])
            else:
                unigrams = np.bincount(made.row[here], minlength=made.rows)
            left &= ~here
        total = np.bincount(made.row, value, minlength=made.rows)
    return pa.table([ids.cast(pa.int64()), pa.array(count), pa.array(total), pa.array(unigrams)], names=["doc_id", "n_tokens", "known", "unigrams"])


def score(documents: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every document."""
    spark = tuned(documents.sparkSession)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    # Neighbouring ids share a block, so that pieces of the shuffle hold many texts.
    near = F.coalesce(F.floor(F.col("doc_id") / TOGETHER), F.xxhash64("text"))
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn("block", F.pmod(F.xxhash64(near), F.lit(blocks)).cast("long"))
    texts = rows.mapInArrow(pieces, "block long, piece binary").groupBy("block")

    def first(orders: list[int]) -> Callable:
        return lambda key, table: _send(key[0].as_py(), Block(unpacked(table).column("text")), orders, parts)

    def later(orders: list[int]) -> Callable:
        def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            made = Block(unpacked(table).column("text"))
            made.learn(answers, orders[0] - 1)
            return _send(key[0].as_py(), made, orders, parts)

        return run

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpacked(table)
        made = Block(table.column("text"))
        made.learn(answers, order)
        return _score(table.column("doc_id"), made, order)

    known: DataFrame | None = None
    for orders in [[n for n in (1, 2) if n <= order], *([n] for n in range(3, order + 1))]:
        sent = texts.applyInArrow(first(orders), SENT) if known is None else texts.cogroup(known.groupBy("block")).applyInArrow(later(orders), SENT)
        answers = sent.groupBy("part").applyInArrow(_tally, ANSWER)
        known = answers if known is None else known.unionByName(answers)
    scored = cut(texts.cogroup(known.groupBy("block")).applyInArrow(finish, SCORED))
    everything = scored.agg(F.sum("n_tokens")).first()[0] or 0
    log_score = F.col("known") - F.col("unigrams") * math.log(everything or 1)
    return scored.select("doc_id", "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score"))
