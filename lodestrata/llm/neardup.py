"""Near-duplicate groups: MinHash signatures in an LSH forest.

A document's shingles are its runs of SHINGLE words in lower case (of all its words, if fewer).
LANES hash functions give the least value each; a byte of each makes the signature, with a second byte of the
lanes that lead an order. TREES orders of all signatures are made by rotating them. Neighbours in an order are
candidates if they share a prefix of LEAST_DEPTH lanes, by both their bytes: a run of rows with such a common prefix.
The prefixes alone are sorted first; only rows that share theirs with another go on, with whole labels (the turned signatures). All orders
together are one table, which is partitioned by ranges and sorted, so a prefix that many rows share is split by the
lanes that follow, and a task has about ROWS rows whatever they are.
Runs of up to CROWD rows are compared all with all where they lie. In longer ones, and in those that
reach the end of a task's range, neighbours are compared as they stream by, each with the WINDOW rows
that share most lanes with it; then only rows of different groups are compared with one another, in
tiles of CROWD by CROWD rows that are spread over tasks. So no pair of a run goes unexamined but those
whose rows are linked already, and no task holds more than two blocks.

Whole signatures decide: candidates whose estimated similarity is at least ACCEPT are linked, and linked
documents form groups (connected components). Equal signatures are merged before, so exact copies cost a row
for all of them. SIMILARITY is the Jaccard similarity that counts as a near copy; ACCEPT lies a standard
error below, since a signature only estimates it.

Defined results: a null text, or one without words, is in a group of its own and stays. Rows with a null
doc_id are left out of groups and stay in `keep_one`. Rows of equal doc_id and text are one document; they
give one row in `groups`, and stay or go together in `keep_one`. Rows that repeat a doc_id with another
text are documents of their own. The least doc_id of a group stays; of several texts of that id in the group,
the one whose hash is least. An empty table has no groups. Texts count to their end, however long. Other
columns are ignored, whatever their names, and passed through by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import textkit
from lodestrata.llm.session import cut, fresh, tuned

SHINGLE = 3
LANES = 120
TREES = 20
STEP = LANES // TREES
LEAST_DEPTH = 3
REGION = 64
BLOCK = 1024
#: Bytes of a signature: of its lanes, and the second ones of lanes that lead an order.
SIGNATURE = LANES + TREES * LEAST_DEPTH
#: Rows of labels for each task (of prefixes ten times as many), at least so many together in Python, and of a run that is compared in one task.
ROWS, TOGETHER, CROWD = 100_000, 20_000, 4096
WINDOW = 8
SIMILARITY = 0.5
ACCEPT = SIMILARITY - 0.045

_rng = np.random.default_rng(4242)
_FLIP = _rng.integers(0, 1 << 32, LANES, dtype=np.uint64).astype(np.uint32)
_TIMES = _rng.integers(0, 1 << 31, LANES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


_LEADING = (np.arange(TREES)[:, None] * STEP + np.arange(LEAST_DEPTH)).ravel()


def signatures(texts: pa.Array) -> list[bytes | None]:
    """The signature of each text; None if it has no words."""
    out: list[bytes | None] = [None] * len(texts)
    for first, data, offsets in textkit.chunks(texts):
        start, end, kinds, text = textkit.tokens(data, offsets)
        words = kinds == textkit.WORD
        start, end, text = start[words], end[words], text[words]
        if not len(start):
            continue
        h = textkit.span_hash(textkit.prefix(data), start, end)
        shingle, of = textkit.grams(h, text, SHINGLE)
        count = np.bincount(text, minlength=len(offsets) - 1)
        for n in range(1, SHINGLE):
            if (count == n).any():
                few, row = textkit.grams(h, text, n)
                short = count[row] == n
                shingle, of = np.concatenate([shingle, few[short]]), np.concatenate([of, row[short]])
        order = np.argsort(of, kind="stable")
        of, key = of[order], (shingle[order] >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        least = np.empty((len(begin), LANES), np.uint32)
        value = np.empty_like(key)
        for lane in range(LANES):
            np.bitwise_xor(key, _FLIP[lane], out=value)
            np.multiply(value, _TIMES[lane], out=value)
            least[:, lane] = np.minimum.reduceat(value, begin)
        least *= np.uint32(0x9E3779B1)
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA77)
        lanes = np.concatenate([(least >> np.uint32(24)).astype(np.uint8), (least[:, _LEADING] >> np.uint32(16)).astype(np.uint8)], axis=1)
        for row, lane in zip(of[begin], lanes, strict=True):
            out[first + row] = lane.tobytes()
    return out


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of signatures; bytes agree by chance once in 256."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def candidates(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pairs of rows to compare, and the runs (first, last) of more than REGION rows, to be compared all with all.

    key: the prefixes of sorted rows.
    """
    near = np.flatnonzero(key[1:] == key[:-1])
    if not len(near):
        return near, near, []
    breaks = np.flatnonzero(np.diff(near) > 1)
    runs = np.stack([near[np.concatenate([[0], breaks + 1])], near[np.concatenate([breaks, [len(near) - 1]])] + 1], axis=1)
    size = runs[:, 1] - runs[:, 0] + 1
    left, right = [], []
    for n in np.unique(size[size <= REGION]):
        i, j = np.triu_indices(n, 1)
        low = runs[size == n, :1]
        left.append((low + i).ravel())
        right.append((low + j).ravel())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), [(int(a), int(b)) for a, b in runs[size > REGION]]


def linked(lanes: np.ndarray, of: np.ndarray | None = None, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join what all links would join that rows, compared all with all, have.

    of: for each row the least row that it is linked to from before. split: only rows before it are compared with those after it.
    """
    n = len(lanes)
    least = math.ceil(LANES * (ACCEPT * (1 - 1 / 256) + 1 / 256))  # lanes that agree, as in similar()
    columns = np.ascontiguousarray(lanes.T)
    of = np.arange(n) if of is None else of
    left, right = [], []
    for a in range(0, n if split is None else split, BLOCK):
        ends = min(a + BLOCK, n if split is None else split)
        for b in range(a if split is None else split, n, BLOCK):
            top, side = of[a:ends], of[b : b + BLOCK]
            if (top == top[0]).all() and (side == top[0]).all():
                continue
            agree = np.zeros((len(top), len(side)), np.uint8)
            for lane in columns:
                agree += lane[a:ends, None] == lane[None, b : b + BLOCK]
            i, j = np.nonzero(agree >= least)
            i, j = i + a, j + b
            while len(differ := np.flatnonzero(of[i] != of[j])):
                i, j = i[differ], j[differ]
                _, first = np.unique(of[i], return_index=True)
                left.append(i[first])
                right.append(j[first])
                roots = _roots(of[i[first]].tolist(), of[j[first]].tolist())
                to = np.arange(n)
                to[list(roots)] = list(roots.values())
                of = to[of]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _roots(left: list[int], right: list[int]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _compared(key: np.ndarray, lanes: np.ndarray, node: np.ndarray, crowd: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    """Links of whole runs, each compared all with all, and the runs (first, end) of more than `crowd` rows, which aren't."""
    i, j, large = candidates(key)
    keep = np.concatenate([np.zeros(0, bool), *(similar(lanes[i[k : k + 50_000]], lanes[j[k : k + 50_000]]) >= ACCEPT for k in range(0, len(i), 50_000))])
    found = [(node[i[keep]], node[j[keep]])]
    for low, high in large:
        if high - low < crowd:
            a, b = linked(lanes[low : high + 1])
            found.append((node[a + low], node[b + low]))
    return found, [(low, high + 1) for low, high in large if high - low >= crowd]


def _streamed(lanes: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of rows of one run with the WINDOW rows that follow."""
    found = []
    for k in range(1, min(WINDOW, len(node) - 1) + 1):
        near = similar(lanes[k:], lanes[:-k]) >= ACCEPT
        found.append((node[k:][near], node[:-k][near]))
    return found


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """(prefixes, lanes, nodes) of at least TOGETHER labels at a time, but for the last."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield _arrays(held)
            held, rows = [], 0
    if rows:
        yield _arrays(held)


def _arrays(batches: list[pa.RecordBatch]) -> Rows:
    table = pa.Table.from_batches(batches)
    lead = 1 + 2 * LEAST_DEPTH
    label = np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint8).reshape(-1, LANES + 1 + LEAST_DEPTH)
    key = label[:, :lead].astype(np.int64) @ (1 << 8 * np.arange(lead - 1, -1, -1, dtype=np.int64))
    return key, np.concatenate([label[:, 1:lead:2], label[:, lead:]], axis=1), table.column("node").to_numpy()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, node) for each tree and signature: the tree's number and both bytes of the lanes that lead, as one number."""
    for batch in batches:
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE).astype(np.int64)
        key = np.repeat(np.arange(TREES)[None, :], len(signature), axis=0)
        for k in range(LEAST_DEPTH):
            key = key << 16 | signature[:, _LEADING[k::LEAST_DEPTH]] << 8 | signature[:, LANES + k :: LEAST_DEPTH]
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), TREES))], names=["prefix", "node"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of sorted prefixes, the rows whose prefix a neighbour has, and the first and the last row."""
    key, node, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key, node = np.concatenate([key, batch.column("prefix").to_numpy()]), np.concatenate([node, batch.column("node").to_numpy()])
        if len(key) < 2:
            continue
        same = key[1:] == key[:-1]
        stay = np.append(same, False)
        stay[1:] |= same
        stay[0] |= before is None or before == key[0]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][stay[:-1]]), pa.array(node[:-1][stay[:-1]])], names=["prefix", "node"])
        before, key, node = key[-2], key[-1:], node[-1:]
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["prefix", "node"])


def _links(batches: Iterator[pa.RecordBatch], crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """Of one range of sorted labels: links (u, v), and rows u of runs whose members are yet to be compared."""

    def sent(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        roots = _roots(*(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]).tolist() for k in (0, 1)))
        pairs = [(a, b) for a, b in roots.items() if a != b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()), pa.nulls(len(pairs), pa.int64())], names=["u", "v", "run"])

    def waiting(key: int, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.nulls(len(node), pa.int64()), pa.array(np.full(len(node), key), pa.int64())], names=["u", "v", "run"])

    held: Rows = np.zeros(0, np.int64), np.zeros((0, LANES), np.uint8), np.zeros(0, np.int64)
    opening = True  # whether the first row held is of the range's first run, which may begin before it
    over = 0  # rows at the front that went out as waiting already; they're held for the window only
    for more in _batched(batches):
        held = key, lanes, node = tuple(np.concatenate(x) for x in zip(held, more, strict=True))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        # The first run, if it is to wait, and the last run, which may go on.
        first = begin[1] if len(begin) > 1 else 0
        if first and (opening or over):
            yield waiting(key[0], node[over:first])
            yield sent(_streamed(lanes[:first], node[:first]))
            held = key, lanes, node = key[first:], lanes[first:], node[first:]
            begin = begin[1:] - first
            opening, over = False, 0
        if last := begin[-1]:
            found, crowds = _compared(key[:last], lanes[:last], node[:last], crowd)
            for a, b in crowds:
                yield waiting(key[a], node[a:b])
                found += _streamed(lanes[a:b], node[a:b])
            yield sent(found)
            held = key, lanes, node = key[last:], lanes[last:], node[last:]
        if len(node) > crowd:
            yield waiting(key[0], node[over:])
            yield sent(_streamed(lanes, node))
            held = key[-WINDOW:], lanes[-WINDOW:], node[-WINDOW:]
            over = len(held[0])
    key, lanes, node = held
    if len(node):
        yield waiting(key[0], node[over:])
        yield sent(_streamed(lanes, node))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between two blocks of one run, or within one."""
    rows = rows.sort_by([("block", "ascending"), ("root", "ascending"), ("node", "ascending")])
    block, node = rows.column("block").to_numpy(), rows.column("node").to_numpy()
    lanes = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, SIGNATURE)[:, :LANES]
    _, first, at = np.unique(rows.column("root").to_numpy(), return_index=True, return_inverse=True)
    same = key[1].as_py() == key[2].as_py()
    split = None if same else int(np.searchsorted(block, key[2].as_py()))
    u, v = (np.zeros(0, np.int64),) * 2 if split in (0, len(node)) else linked(lanes, first[at], split)
    return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node of the edges (u, v) but the least of its component, that least node.

    Large-star and small-star steps alternate until nothing changes; the rounds grow with the logarithm of the longest path.
    """

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = star(large).select("u", "v", "m")
        down = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        if (now := state(edges)) == before:
            return edges
        before = now


def _forest(nodes: DataFrame, rows: int, crowd: int) -> DataFrame:
    """(u, v): for each node that is linked, but the least of its component, that least node."""
    count = nodes.count() * TREES
    prefixes = nodes.select("node", "signature").mapInArrow(_prefixes, "prefix long, node long")
    ranges = prefixes.repartitionByRange(max(1, math.ceil(count / (10 * rows))), "prefix", "node").sortWithinPartitions("prefix", "node")
    met = cut(ranges.mapInArrow(_meeting, "prefix long, node long"))
    tree = F.shiftright("prefix", 16 * LEAST_DEPTH).cast("int")
    labels = met.join(nodes.select("node", "signature"), "node").select(
        F.concat(
            F.unhex(F.lpad(F.hex("prefix"), 2 + 4 * LEAST_DEPTH, "0")),
            F.substring("signature", tree * STEP + LEAST_DEPTH + 1, LANES - LEAST_DEPTH - tree * STEP),
            F.substring("signature", F.lit(1), tree * STEP),
        ).alias("label"),
        "node",
    )
    ordered = labels.repartitionByRange(max(1, math.ceil(met.count() / rows)), "label").sortWithinPartitions("label")
    found = cut(ordered.mapInArrow(lambda batches: _links(batches, crowd), "u long, v long, run long"))
    roots = components(found.where("run is null").select("u", "v"))
    waiting = found.where("run is not null").select(F.col("u").alias("node"), "run")
    waiting = waiting.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    waiting = cut(waiting)
    runs = waiting.groupBy("run").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    spread = waiting.join(runs.select("run", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "run").join(nodes.select("node", "signature"), "node")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.groupBy("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = cut(tiles.applyInArrow(_tile, "u long, v long"))
    return roots if more.isEmpty() else components(roots.unionByName(more))


def groups(documents: DataFrame, rows: int = ROWS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, group_id, links, keep): group_id is the least doc_id of the group, and that document is kept; links counts the group's other documents."""
    return _grouped(documents, rows, crowd).select("doc_id", "group_id", "links", "keep")


def _grouped(documents: DataFrame, rows: int, crowd: int) -> DataFrame:
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(signatures(batch.column("text")), pa.binary())], names=["doc_id", "h", "signature"])

    made = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, h long, signature binary")
    signed = cut(made.groupBy("doc_id", "h").agg(F.min("signature").alias("signature")))
    worded = signed.where("signature is not null")
    first = F.min(F.struct("doc_id", "h")).alias("first")
    nodes = cut(worded.groupBy("signature").agg(first, F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    roots = _forest(nodes, rows, crowd)
    placed = nodes.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = placed.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    found = worded.join(placed.select("signature", "root"), "signature").join(whole, "root")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    found = found.select("doc_id", "h", F.col("first.doc_id").alias("group_id"), (F.col("n") - 1).alias("links"), kept.alias("keep"))
    alone = signed.where("signature is null").select("doc_id", "h", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("keep"))
    return found.unionByName(alone)


def keep_one(documents: DataFrame, rows: int = ROWS, crowd: int = CROWD) -> DataFrame:
    """The documents without all but one of each group, with all their columns."""
    gone, h = fresh("gone", documents.columns), fresh("h", documents.columns)
    dropped = _grouped(documents, rows, crowd).where("not keep").select(F.col("doc_id").alias(gone), F.col("h").alias(h))
    same = (documents["doc_id"].cast("long") == F.col(gone)) & (F.xxhash64(documents["text"]) == F.col(h))
    return documents.join(dropped, same, "left_anti")
