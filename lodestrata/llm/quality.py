"""Quality classifier: a linear SVM over Naive Bayes features (NBSVM).

Features are indicators of hashed word and punctuation unigrams and bigrams of a whole text; a
token that repeats the one before it gives one shared feature. Each indicator is scaled by its
log-count ratio between the classes, and a hinge-loss linear model is fitted on the scaled
indicators by dual coordinate descent. Two heads are fitted: quality, and toxicity. A document
is kept if the first finds it good and the second doesn't find it toxic. Where a head divides is
learned from sampled documents held out from a fit of its own: it rejects CLEAN_LOST of the clean ones.

Defined results: a null text, or one without tokens, isn't kept and has null scores. A null
doc_id passes through. Repeated rows give repeated, equal rows. Labels that contradict one
another count as poor and toxic. With labels of one class only, or none, a head decides nothing
(score null) and rejects nothing. A label over 0 is good, or toxic; rows of which either label is null aren't fitted on.
A score equal to a threshold isn't over it. Texts count to their end, however long. An empty table gives no rows. Other
columns of either table are ignored by `classify` and passed through by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import sampling, textkit
from lodestrata.llm.session import tuned

BITS = 21
MOST_PER_CLASS = 4000
EPOCHS = 12
#: Added to every count of a feature in a class, so that features of few documents weigh little; and the most that one document can add to a weight.
SMOOTHING, COST = 3.0, 0.01
#: One of so many sampled documents is held out for thresholds, which reject this share of the clean ones (quality 1, not toxic).
HELD_OUT, CLEAN_LOST = 5, 0.01
_REPEAT = np.uint64(0x5EED)
SCHEMA = "doc_id long, quality_score double, toxicity_score double, keep boolean"


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, feature, row within these, tokens of each row) of pieces of the batch; each feature once a text.

    wanted: a mask of the features that matter.
    """
    for first, data, offsets in textkit.chunks(texts):
        start, end, _, text = textkit.tokens(data, offsets)
        n = len(offsets) - 1
        if not len(start):
            yield first, n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
            continue
        h = textkit.span_hash(textkit.prefix(data), start, end)
        pairs, of = textkit.grams(h, text, 2)
        again = (h[1:] == h[:-1])[text[1:] == text[:-1]]
        pairs[again] = textkit.mix(np.full(1, _REPEAT))[0]
        feature = (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
        row = np.concatenate([text, of])
        if wanted is not None:
            use = wanted[feature]
            feature, row = feature[use], row[use]
        once = np.unique((row << BITS) | feature)
        yield first, n, once & ((1 << BITS) - 1), once >> BITS, np.bincount(text, minlength=n)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed: list[bytes] = []
        for _, n, feature, row, _ in features(batch.column("text")):
            cuts = np.searchsorted(row, np.arange(n + 1))
            small = feature.astype(np.int32)
            packed += [small[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["quality", "toxic", "features"])


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights over the scaled indicators, and the bias, that minimise the L2-regularised hinge loss (dual coordinate descent)."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([scale[r] @ scale[r] + 1 for r in rows])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            row, values = rows[i], scale[rows[i]]
            gradient = y[i] * (w[row] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[row] += step * values
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def head(rows: list[np.ndarray], positive: np.ndarray, size: int) -> tuple[np.ndarray, float] | None:
    """Weight of each feature, log-count ratio included, and the bias; None if a class has no rows."""
    if positive.all() or not positive.any():
        return None
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for row, good in zip(rows, positive, strict=True):  # each feature once a row
        (p if good else q)[row] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    y = np.where(positive, 1.0, -1.0)
    cost = COST * np.where(positive, len(y) / (2 * positive.sum()), len(y) / (2 * (~positive).sum()))
    w, bias = dual_descent(rows, ratio, y, cost)
    return w * ratio, bias


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> dict:
    """Both heads, fitted on at most `most` labelled documents of each combination of the two labels."""
    tuned(documents.sparkSession)
    ours = labels.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = sampling.strata(ours, "doc_id", ["quality", "toxic"], most)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    # The sample is bounded by `most` for each combination, so it is small at every size of the input.
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality", "toxic")
    found = labelled.select("text", "quality", "toxic").mapInArrow(_feature_rows, "quality int, toxic int, features binary").toArrow()
    good = np.array(found.column("quality").to_pylist(), dtype=float) > 0
    toxic = np.array(found.column("toxic").to_pylist(), dtype=float) > 0
    # Features that occur are numbered, so that nothing is as long as the table of all.
    number = np.zeros(1 << BITS, np.int32)
    for x in found.column("features"):
        number[np.frombuffer(x.as_buffer(), np.int32)] = 1
    kept = np.flatnonzero(number)
    number[kept] = np.arange(len(kept))
    rows = [number[np.frombuffer(x.as_buffer(), np.int32)] for x in found.column("features")]
    del found, number
    order = np.lexsort([[len(r) for r in rows], [int(r.astype(np.int64).sum()) for r in rows]]) if rows else np.zeros(0, np.int64)
    rows, good, toxic = [rows[i] for i in order], good[order], toxic[order]
    weights, bias, known, over = np.zeros((1 << BITS, 2), np.float32), np.zeros(2), [False, False], [0.0, 0.0]
    for k, positive in enumerate((good, toxic)):
        if rows and (made := head(rows, positive, len(kept))) is not None:
            weights[kept, k], bias[k], known[k] = made[0], made[1], True
            over[k] = threshold(rows, positive, good & ~toxic, len(kept), CLEAN_LOST if k == 0 else 1 - CLEAN_LOST)
    return {"weights": weights, "bias": bias, "known": known, "mask": weights.any(axis=1), "over": over}


def threshold(rows: list[np.ndarray], positive: np.ndarray, clean: np.ndarray, size: int, share: float) -> float:
    """The score below which that share of clean documents lie that a head wasn't fitted on; 0 if none can be held out."""
    out = np.arange(len(rows)) % HELD_OUT == 0
    if not (out & clean).any() or (made := head([rows[i] for i in np.flatnonzero(~out)], positive[~out], size)) is None:
        return 0.0
    return float(np.quantile([made[0][rows[i]].sum() + made[1] for i in np.flatnonzero(out & clean)], share))


def scores(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of both heads, number of tokens, whether each is kept) of a batch's texts."""
    out, count = np.zeros((len(texts), 2)), np.zeros(len(texts), np.int64)
    for first, n, feature, row, tokens in features(texts, model["mask"]):
        for k in (0, 1):
            out[first : first + n, k] = np.bincount(row, model["weights"][feature, k], minlength=n) + model["bias"][k]
        count[first : first + n] = tokens
    good = (out[:, 0] > model["over"][0]) | (not model["known"][0])
    toxic = (out[:, 1] > model["over"][1]) & model["known"][1]
    return out, count, (count > 0) & good & ~toxic


def classify(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, quality_score, toxicity_score, keep) of every document."""
    shared = tuned(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found, count, keep = scores(batch.column("text"), model)
            heads = [pa.array(found[:, k], mask=(count == 0) | (not model["known"][k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *heads, pa.array(keep)], names=["doc_id", "quality_score", "toxicity_score", "keep"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, model: dict) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    shared = tuned(documents.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text"), model)[2]))

    return documents.mapInArrow(run, documents.schema)
