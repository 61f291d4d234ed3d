"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; letters (and the marks that join them) of any script do, a to z their
own, all others by their code points one of SYMBOLS - 27, which neighbours in an alphabet don't share. A trigram is bound from its letters' vectors, the
first permuted twice (rotated), the second once, multiplied element by element; a text is the sum
(bundle) of its trigrams' vectors. Languages' prototypes are bundles of labelled documents, each
document at equal weight. A document's language is that of the prototype with the largest cosine.

Rejected are documents whose best cosine is under LEAST_COSINE, and those whose declared language
has a prototype with less than half the best one's cosine, by more than MARGIN: texts that merely
quote another language stay.

Defined results: null texts, and texts with no trigram of letters, have a null language and are
rejected, for there is nothing to know them by. A document that declares no language, or one
without a prototype, is judged by its best cosine alone. Equal cosines: the first language in
alphabetical order. Without any labelled document there are no prototypes; then every language
is null and nothing is rejected. At most MOST_LANGUAGES declared languages get a prototype, those of most documents (of
as many, the first in alphabetical order), so that what goes to the workers is bounded. Texts count to their end, however
long. An empty table gives no rows. Repeated rows give repeated, equal rows. Other columns are
ignored by `identify` and passed through by `keep_known`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import sampling, textkit
from lodestrata.llm.session import tuned

DIMENSIONS = 1024
SYMBOLS = 512
MOST_PER_LANGUAGE, MOST_LANGUAGES = 1000, 500
#: Short texts lie far from every prototype; unrelated vectors' cosine is about 0.03.
LEAST_COSINE = 0.05
MARGIN = 0.1
BLOCK = 256
SCHEMA = "doc_id long, declared string, language string, cosine double, keep boolean"

_LETTERS = np.random.default_rng(99).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))
_FIRST, _SECOND, _THIRD = np.roll(_LETTERS, 2, axis=1), np.roll(_LETTERS, 1, axis=1), _LETTERS
#: Bits of a symbol in a trigram's number, and symbols of a block up to which all trigrams of them are counted in a table.
BITS, DENSE = 10, 96
#: Distinct trigrams that are counted at once, at most.
TOGETHER = 8192


@cache
def _codes() -> np.ndarray:
    """The symbol of each code point: a to z are 1 to 26, other letters and marks the rest, everything else a space."""
    codes = np.zeros(sys.maxunicode + 1, np.uint16)
    letters = np.array([c for c in range(128, sys.maxunicode + 1) if category(chr(c))[0] in "LM"])
    codes[letters] = 27 + letters % (SYMBOLS - 27)
    codes[97:123] = np.arange(1, 27)
    return codes


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each begins) of UTF-8 bytes."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[begin]
    points = lead.astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        mine = np.flatnonzero((lead >= low) & (lead < high))
        value = (lead[mine] & mask).astype(np.int32)
        for k in range(1, size):
            value = value << 6 | (padded[begin[mine] + k] & 0x3F)
        points[mine] = value
    return points, begin


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, trigram, row within these) of pieces of the batch."""
    for first, data, offsets in textkit.chunks(texts):
        n = len(offsets) - 1
        points, begin = _points(data)
        code = _codes()[points]
        row = (np.searchsorted(offsets, begin, "right") - 1).astype(np.int32)
        if len(code):
            use = np.ones(len(code), bool)
            use[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
            code, row = code[use].astype(np.int32), row[use]
        if len(code) < 3:
            yield first, n, np.zeros(0, np.int32), np.zeros(0, np.int32)
            continue
        three = (code[:-2] << (2 * BITS)) | (code[1:-1] << BITS) | code[2:]
        use = (row[:-2] == row[2:]) & (code[1:-1] != 0)
        yield first, n, three[use], row[:-2][use]


def _numbered(trigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams, for each its place among them)."""
    letters = [(trigram >> (k * BITS)) & ((1 << BITS) - 1) for k in (2, 1, 0)]
    symbols = np.flatnonzero(sum(np.bincount(x, minlength=SYMBOLS) for x in letters))
    if (m := len(symbols)) > DENSE:
        return np.unique(trigram, return_inverse=True)
    small = np.zeros(SYMBOLS, np.int32)
    small[symbols] = np.arange(m)
    number = (small[letters[0]] * m + small[letters[1]]) * m + small[letters[2]]
    used = np.flatnonzero(np.bincount(number, minlength=m**3))
    at = np.empty(m**3, np.int32)
    at[used] = np.arange(len(used))
    return symbols[used // (m * m)] << (2 * BITS) | symbols[used // m % m] << BITS | symbols[used % m], at[number]


def bundles(trigram: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The vector of each of n texts."""
    out = np.zeros((n, DIMENSIONS), np.float32)
    bounds = np.searchsorted(row, np.arange(0, n + BLOCK, BLOCK))
    for k, a in enumerate(range(0, n, BLOCK)):
        mine, of = trigram[bounds[k] : bounds[k + 1]], row[bounds[k] : bounds[k + 1]].astype(np.int64) - a
        rows = min(BLOCK, n - a)
        if not len(mine):
            continue
        distinct, at = _numbered(mine)
        for low in range(0, len(distinct), TOGETHER):  # of a very long text there may be many
            high = min(len(distinct), low + TOGETHER)
            here = (at >= low) & (at < high) if high - low < len(distinct) else slice(None)
            counts = np.bincount(of[here] * (high - low) + at[here] - low, minlength=rows * (high - low)).reshape(rows, high - low).astype(np.float32)
            some = distinct[low:high]
            bound = _FIRST[some >> (2 * BITS)] * _SECOND[(some >> BITS) & ((1 << BITS) - 1)] * _THIRD[some & ((1 << BITS) - 1)]
            out[a : a + rows] += counts @ bound
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1, norm)


def fit(documents: DataFrame, most: int = MOST_PER_LANGUAGE) -> dict:
    """The prototype of each declared language, from at most `most` of its documents."""
    tuned(documents.sparkSession)
    written = documents.where("text is not null and lang is not null").select("doc_id", "lang").distinct()
    common = written.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).select("lang")
    chosen = sampling.strata(written.join(F.broadcast(common), "lang"), "doc_id", ["lang"], most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, n, trigram, row in trigrams(batch.column("text")):
                unit = _unit(bundles(trigram, row, n))
                for lang in set(langs[first : first + n]):
                    total[lang] = total.get(lang, 0) + unit[langs[first : first + n] == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "vector"])

    # Bounded by `most` for each of MOST_LANGUAGES languages.
    texts = documents.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    made: dict[str, np.ndarray] = {}
    for lang, vector in texts.mapInArrow(run, "lang string, vector binary").collect():
        made[lang] = made.get(lang, 0) + np.frombuffer(vector)
    names = sorted(x for x in made if np.any(made[x]))
    return {"names": names, "vectors": _unit(np.array([made[x] for x in names])).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)}


def judge(texts: pa.Array, declared: list, model: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """(language, cosine, whether it is kept) of each text."""
    names, best, keep = [None] * len(texts), np.full(len(texts), np.nan), np.ones(len(texts), bool)
    if not model["names"]:
        return names, best, keep
    known = {name: k for k, name in enumerate(model["names"])}
    for first, n, trigram, row in trigrams(texts):
        cosine = (_unit(bundles(trigram, row, n)) @ model["vectors"].T).astype(np.float64)
        some = np.bincount(row, minlength=n) > 0
        top = cosine.argmax(axis=1)
        for i in range(n):
            if not some[i]:
                keep[first + i] = False
                continue
            names[first + i], best[first + i] = model["names"][top[i]], cosine[i, top[i]]
            own = known.get(declared[first + i], top[i])
            most = cosine[i, top[i]]
            keep[first + i] = most >= LEAST_COSINE and cosine[i, own] >= min(most / 2, most - MARGIN)
    return names, best, keep


def identify(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, declared, language, cosine, keep) of every document."""
    shared = tuned(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, best, keep = judge(batch.column("text"), batch.column("lang").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(names, pa.string()), pa.array(best, mask=np.isnan(best)), pa.array(keep)], names=["doc_id", "declared", "language", "cosine", "keep"])

    return documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, SCHEMA)


def keep_known(documents: DataFrame, model: dict) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    shared = tuned(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column("text"), batch.column("lang").to_pylist(), shared.value)[2]))

    return documents.mapInArrow(run, documents.schema)
