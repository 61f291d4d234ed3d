"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so it marks a
certain cut: what lies left and right of it is encoded independently and concatenated. Texts are
cut twice. First at forced pairs where the pre-tokenizer's pattern cuts whatever surrounds them, so
that a fragment needs nothing of its surroundings: a worker keeps the ids of such fragments in a bounded cache, and
a text costs one lookup a fragment and one concatenation. Fragments that aren't kept are split by the pattern, and their
pieces are cut at every forced pair inside them; what is left is merged here: short ones many at once, in rounds of array
operations that merge one pair in each; long ones with a heap, in n log n steps for n bytes.

Vocabularies are read from files whose path is a parameter (ranks: base64 token and id a line).
They're small, fixed, and broadcast. They must hold all single bytes.

Defined results: a null text has null ids and a null count; an empty text has none and 0. Ids that are null, or aren't in the
vocabulary, decode to null; bytes that aren't UTF-8 decode with replacement characters. Pairs of equal rank are merged from the left.
Texts and runs of any length, of whatever characters, are encoded whole. An empty table gives no rows. Repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.session import tuned

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 300_000
#: Fragments with more characters aren't kept, so the cache's memory is bounded.
CACHED_CHARS = 64
#: Bytes of what is merged in rounds, at most; and characters of texts that are encoded together, at least.
SHORT, TOGETHER = 64, 1 << 20
NEVER = np.iinfo(np.int32).max
SCHEMA = "doc_id long, ids array<int>, n_tokens long"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def forced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """forced[a, b] is True if byte a is never followed by byte b inside a token."""
    forced = np.ones((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            forced[b[:-1], b[1:]] = False
    return forced


def merge_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of what two tokens make together, by rank << 32 | rank; pairs that make no token are left out."""
    pairs = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
    return pairs


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merges the leftmost pair of least rank until none is left, with a heap of (rank, place) and lists of what comes before and after."""
    n, get = len(ids), pairs.get
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [r << 32 | k for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        rank, k = top >> 32, top & 0xFFFFFFFF
        if ids[k] < 0 or (j := after[k]) >= n or get(ids[k] << 32 | ids[j]) != rank:
            continue  # what was here has changed
        ids[k], ids[j] = rank, -1
        after[k] = end = after[j]
        if end < n:
            before[end] = k
            if (r := get(rank << 32 | ids[end])) is not None:
                heappush(heap, r << 32 | k)
        if (i := before[k]) >= 0 and (r := get(ids[i] << 32 | rank)) is not None:
            heappush(heap, r << 32 | i)
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes and decodes with one vocabulary; keeps fragments it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.forced = forced_pairs(ranks)
        self.cache: dict[str, bytes] = {}
        self.ranks, self.pairs = ranks, merge_pairs(ranks)
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # White space as Unicode defines it, without the separators 0x1C to 0x1F.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.fragments = self._certain_cuts()
        size = max(ranks.values()) + 1
        self.tokens = [None] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _certain_cuts(self) -> re.Pattern:
        """What finds the fragments: cuts where both the pattern always cuts and the byte pair is forced.

        Those are between a letter and an ASCII character that is neither letter nor digit, and
        between a character that isn't white space and white space.
        """
        ends = lambda c, x: self.forced[c.encode()[-1], ord(x)]
        known = [c for c in map(chr, range(0x3000)) if not c.isspace()]
        before = [c for c in known if ends(c, " ")]
        space = "".join(w for w in " \t\n\r\v\f" if all(ends(c, w) for c in before))
        letters = [c for c in before if c.isalpha()]
        after = [x for x in map(chr, range(33, 127)) if not x.isalnum() and all(ends(c, x) for c in letters)]
        if not space or not letters:
            return re.compile("(?s:.+)")
        b, l, a = ("".join(map(re.escape, x)) for x in (before, letters, after))
        return re.compile(rf"[{space}]*[{l}]+(?=[{a}{space}]|\Z)|[{space}]*(?:[{b}]+|[^{b}{space}]+[{space}]*)+|[{space}]+")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each two tokens make together; NEVER if they make none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], NEVER) if len(self.keys) else np.full(len(key), NEVER)

    def _rounds(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of fragments that lie one after another: in each round, each merges its leftmost pair of least rank."""
        number = np.arange(len(size))
        rank = np.full(len(ids), NEVER, np.int32)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begin)
            busy = least < NEVER
            if 2 * busy.sum() <= len(busy):  # those that are through leave
                own = np.repeat(busy, size)
                done.append((number[~busy], size[~busy], ids[~own]))
                ids, rank, number, size, least = ids[own], rank[own], number[busy], size[busy], least[busy]
                if not len(size):
                    break
                begin, busy = np.cumsum(size) - size, np.ones(len(size), bool)
            of = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero((rank == least[of]) & (rank < NEVER))
            first = np.ones(len(at), bool)
            first[1:] = of[at[1:]] != of[at[:-1]]
            at = at[first]
            mine = of[at]
            ids[at] = least[mine]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            rank[at] = NEVER
            last = at + 2 < begin[mine] + size[mine]
            rank[at[last]] = self._ranks(ids[at[last]], ids[at[last] + 2])
            inner = at > begin[mine]
            rank[at[inner] - 1] = self._ranks(ids[at[inner] - 1], ids[at[inner]])
            ids, rank = ids[stay], rank[stay]
            size = size.copy()
            size[mine] -= 1
        number, size, ids = (np.concatenate([x[k] for x in done]) for k in range(3))
        order = np.argsort(number, kind="stable")
        begin, size_in_order = np.cumsum(size) - size, size[order]
        take = np.repeat(begin[order] - (np.cumsum(size_in_order) - size_in_order), size_in_order) + np.arange(len(ids))
        return ids[take], size_in_order

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece of the pattern."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        start = np.ones(len(data), bool)
        start[1:] = self.forced[data[:-1], data[1:]]
        start[ends[:-1]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(data)))
        ids = self.single[data]
        count = np.empty(len(size), np.int64)
        short = size <= SHORT
        own = np.repeat(short, size)
        made = np.empty(len(data), np.int32)  # the ids of a fragment, where its bytes begin
        if short.any():
            few, count[short] = self._rounds(ids[own], size[short])
            place = np.repeat(begin[short] - (np.cumsum(count[short]) - count[short]), count[short]) + np.arange(len(few))
            made[place] = few
        for k in np.flatnonzero(~short):
            long = merge_long(ids[begin[k] : begin[k] + size[k]].tolist(), self.pairs)
            made[begin[k] : begin[k] + len(long)], count[k] = long, len(long)
        total = np.concatenate([[0], np.cumsum(count)])
        packed = made[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        cuts = total[np.searchsorted(begin, np.concatenate([[0], ends]))]
        whole = packed.tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _missing(self, fragments: set[str]) -> dict[str, bytes]:
        """The packed ids of fragments that aren't kept; short ones are from now on."""
        split = {x: [p.encode() for p in self.pattern.findall(x)] for x in fragments}
        ids: dict[bytes, bytes] = {}
        for pieces in split.values():
            for piece in pieces:
                if piece not in ids:
                    whole = self.ranks.get(piece)
                    ids[piece] = b"" if whole is None else whole.to_bytes(4, sys.byteorder)
        rest = [piece for piece, known in ids.items() if not known]
        ids.update(zip(rest, self.merged(rest), strict=True))
        found = {x: b"".join([ids[p] for p in pieces]) for x, pieces in split.items()}
        if len(self.cache) + len(found) > CACHE_ENTRIES:
            self.cache = {}
        self.cache.update((x, made) for x, made in found.items() if len(x) <= CACHED_CHARS)
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as packed 32-bit integers; None for None."""
        out: list[bytes | None] = []
        held: list[list[str] | None] = []
        chars = 0
        for k, text in enumerate(texts):
            held.append(None if text is None else self.fragments.findall(text))
            chars += len(text or "")
            if chars >= TOGETHER or k == len(texts) - 1:
                unknown = {x for fragments in held if fragments for x in fragments if x not in self.cache}
                kept = self.cache  # the one that holds what isn't unknown, though it may be replaced
                found = self._missing(unknown)
                out += [None if fragments is None else b"".join([kept.get(x) or found[x] for x in fragments]) for fragments in held]
                held, chars = [], 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str | None:
        parts = []
        for i in ids:
            if i is None or not 0 <= i < len(self.tokens) or self.tokens[i] is None:
                return None
            parts.append(self.tokens[i])
        return b"".join(parts).decode("utf-8", "replace")



_encoders: dict[tuple, Encoder] = {}


def _shared(shared) -> Encoder:
    """One encoder for each broadcast vocabulary in a worker, so that its cache lasts."""
    if (key := shared.value[2]) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value[0], shared.value[1])
    return _encoders[key]


def _broadcast(spark: SparkSession, path: str, pattern: str):
    return tuned(spark).sparkContext.broadcast((read_ranks(path), pattern, (path, pattern)))


def encoded(texts: pa.Array, encoder: Encoder) -> tuple[pa.Array, pa.Array]:
    """(ids, count) of each text."""
    packed = encoder.encode_all(texts.to_pylist())
    count = np.array([0 if x is None else len(x) // 4 for x in packed], np.int64)
    gone = np.array([x is None for x in packed], bool)
    ids = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32))
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), mask=np.append(gone, False))
    return pa.ListArray.from_arrays(offsets, ids), pa.array(count, mask=gone)


def encode(documents: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document."""
    shared = _broadcast(documents.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared(shared)
        for batch in batches:
            ids, count = encoded(batch.column("text"), encoder)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, count], names=["doc_id", "ids", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def decode(encodings: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of ids."""
    shared = _broadcast(encodings.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared(shared)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encodings.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, exact): every text encoded, and decoded again from its ids for comparison."""
    shared = _broadcast(documents.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _shared(shared)
        table = np.array([b"" if x is None else x for x in encoder.tokens], object)
        for batch in batches:
            texts = batch.column("text")
            ids, count = encoded(texts, encoder)
            flat, bounds = ids.values.to_numpy(), np.concatenate([[0], np.cumsum(count.fill_null(0).to_numpy())])
            size, exact = [], []
            for text, a, b in zip(texts.to_pylist(), bounds[:-1], bounds[1:], strict=True):
                back = None if text is None else b"".join(table[flat[a:b]])
                size.append(None if back is None else len(back))
                exact.append(None if back is None else back == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, count, pa.array(size, pa.int64()), pa.array(exact, pa.bool_())], names=["doc_id", "ids", "n_tokens", "n_bytes", "exact"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + ", n_bytes long, exact boolean")
