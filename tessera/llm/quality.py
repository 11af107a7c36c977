"""Quality by ordinal regression on hashed text.

Graded ratings (0 toxic, 1 poor, 2 good) are fitted by a cumulative-link
model: P(grade <= k) = sigmoid(threshold_k - score), with one weight vector
over hashed features for all grades and ordered thresholds.  The result is the
expected grade and the probability of the best grade; documents are selected
by the latter.

Features are the distinct words and word stems of the whole text and a few ratios in bins
(repeated neighbours, distinct words, symbols, capitals), all hashed to one
space.  The model is fitted on at most ``SAMPLE`` labelled documents, chosen by
hash of their id; their hashed features go to the driver.  Every document is
scored, without a shuffle.

Defined results: null or empty text has only the features of an empty text.
Texts are read whole, however long.  Labels with a null id or quality are ignored; of several labels of a document
the lowest grade counts.  Without labels all scores are 0 and every document
has the prior's expected grade and is kept.  Repeated rows get equal scores;
an empty table gives no rows.  Other columns pass through; those of the result
replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.suffix_dedup import result_schema, with_columns
from tessera.llm.token_counts import batches_of

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 10_000
#: log2 of the number of hashed features.
BITS = 18
#: A feature counts if so many documents of the sample have it, and one in so many.
LEAST, RARE = 4, 500
#: Documents with at least this probability of the best grade are kept.
KEEP = 0.5
GRADES = 3
#: Leading bytes of longer words that are features too.
STEMS = (4, 5)
#: The first features are ratios and runs of symbols; each counts as ``EMPHASIS`` words.
SHAPES = 256
EMPHASIS = 8.0
RIDGE = 5e-4
STEPS = 200

_SYMBOL = np.array([chr(i) in "*$#%&|@~^=+<>{}[]\\_!" for i in range(128)] + [False] * 128)


def _bins(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Ratios in twelve bins, finer towards 0."""
    return np.ceil(12 * np.sqrt(part / np.maximum(whole, 1))).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, and where each document's begin."""
    n = len(offsets) - 1
    lower = K.lower_ascii(data)
    starts, ends, first = K.segment(lower, offsets, K.PUNCTUATION)
    hashes = K.word_hashes(lower, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    per = lambda mask, bounds: np.diff(np.append(0, np.cumsum(mask))[bounds])
    words = np.diff(first)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) if len(hashes) else np.zeros(0, bool)
    upper, symbol = (data >= 0x41) & (data <= 0x5A), _SYMBOL[data]
    letters = ~K.PUNCTUATION[data]
    distinct_key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))) >> np.uint64(40)
    distinct = np.bincount(distinct_key.astype(np.int64), minlength=n)
    ratios = [
        _bins(per(again, first), words),
        _bins(distinct, words),
        _bins(per(symbol, offsets), np.diff(offsets)),
        _bins(per(upper, offsets), per(letters, offsets)),
        np.minimum(12, np.log2(1 + words).astype(np.int64)),
    ]
    mask = np.uint64((1 << BITS) - 1)
    stems = []
    for k in STEMS:
        long = ends - starts > k
        stems.append((doc[long].astype(np.uint64) << np.uint64(BITS)) | (K.word_hashes(lower, starts[long], starts[long] + k) + np.uint64(k) & mask | np.uint64(SHAPES)))
    word = (doc.astype(np.uint64) << np.uint64(BITS)) | np.maximum(hashes & mask, np.uint64(SHAPES))
    shape = [(np.arange(n, dtype=np.uint64) << np.uint64(BITS)) | (np.uint64(16 * i) + r.astype(np.uint64)) for i, r in enumerate(ratios)]
    starts, ends, first = K.segment(data, offsets, ~_SYMBOL)
    runs = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << np.uint64(BITS)
    runs |= np.uint64(SHAPES // 2) + K.word_hashes(data, starts, np.minimum(ends, starts + 3)) % np.uint64(SHAPES // 2)
    keys = np.unique(np.concatenate([word, *stems, *shape, runs]))
    return (keys & mask).astype(np.int64), np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def judge(self, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the best grade."""
        score = _sums(self.weights[index] * _values(index), bounds)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        return above.sum(axis=1), above[:, -1]


def _values(index: np.ndarray) -> np.ndarray:
    return np.where(index < SHAPES, EMPHASIS, 1.0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(index: np.ndarray, bounds: np.ndarray, grade: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by Adam over all documents at once."""
    n, size = len(grade), 1 << BITS
    if not n:
        return Model(np.zeros(size), np.full(GRADES - 1, -1.0))
    often = np.bincount(index, minlength=size) >= min(n, max(LEAST, n // RARE))
    known = np.flatnonzero(often)
    use = often[index]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))[use]
    column = (np.cumsum(often) - 1).astype(np.int32)[index[use]]
    value = _values(known)
    edges = np.searchsorted(row, np.arange(n + 1))
    # classes count alike, so that rare ones are not passed over
    count = np.bincount(grade, minlength=GRADES)
    weight = (n / (np.count_nonzero(count) * np.maximum(count, 1)))[grade] ** 0.5
    weight /= weight.sum()
    # thresholds: the first, and positive steps by their logarithms
    x = np.zeros(len(known) + GRADES - 1)
    x[len(known)] = -2.0
    m, v, rate = np.zeros_like(x), np.zeros_like(x), 0.05
    for step in range(1, STEPS + 1):
        w, theta = x[: len(known)], np.cumsum(np.append(x[len(known)], np.exp(x[len(known) + 1 :])))
        score = _sums((w * value)[column], edges)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -50, 50)))
        cdf = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        at = np.arange(n)
        p = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-12)
        d_score = weight * (slope[at, grade + 1] - slope[at, grade]) / p
        d_theta = np.zeros(GRADES + 1)
        np.add.at(d_theta, grade + 1, -weight * slope[at, grade + 1] / p)
        np.add.at(d_theta, grade, weight * slope[at, grade] / p)
        d_theta = d_theta[1:GRADES]
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(column, weights=d_score[row], minlength=len(known)) * value + RIDGE * w,
            [tail[0]],
            tail[1:] * np.exp(x[len(known) + 1 :]),
        ])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size)
    weights[known] = x[: len(known)]
    return Model(weights, np.cumsum(np.append(x[len(known)], np.exp(x[len(known) + 1 :]))))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled documents."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded table, so it may be broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batches_of(whole)):
            index, bounds = features(*K.text_buffer(batch.column("text")))
            packed = [index[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "packed": pa.array(packed, pa.binary())})

    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = labelled.mapInArrow(extract, "doc_id long, grade int, packed binary").orderBy("doc_id", "packed").limit(sample).collect()
    rows = list({(r.packed, r.grade): r for r in rows}.values())  # copies count once
    index = [np.frombuffer(r.packed, np.int32) for r in rows]
    bounds = np.append(0, np.cumsum([len(x) for x in index])).astype(np.int64)
    return fit(np.concatenate(index) if index else np.zeros(0, np.int64), bounds, np.array([r.grade for r in rows], np.int64))


RESULT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def judge(docs: DataFrame, model: Model, keep: float = KEEP, keep_text: bool = True) -> DataFrame:
    """docs with expected_grade, p_good (probability of the best grade) and kept."""
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, thresholds)
        for batch in (part for whole in batches for part in batches_of(whole)):
            expected, good = own.judge(*features(*K.text_buffer(batch.column("text"))))
            columns = {"expected_grade": pa.array(expected), "p_good": pa.array(good), "kept": pa.array(good >= keep)}
            table = pa.Table.from_batches([batch])
            yield from with_columns(table if keep_text else table.drop_columns(["text"]), columns).to_batches()

    schema = result_schema(docs, RESULT)
    return docs.mapInArrow(score, schema if keep_text else T.StructType([f for f in schema if f.name != "text"]))
