"""Quality classifier: naive Bayes support vectors."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import hashed_sample, releasing, table

#: Features are hashed to numbers of so many bits.
BITS = 18
DIMS = 1 << BITS
#: Byte n-grams of these lengths are features.
GRAMS = (1, 2, 3)
#: Labelled documents that the model is fitted on at most: those whose ids hash lowest.
SAMPLE_ROWS = 6000
#: Bytes of features that the model is fitted on at most: rows beyond them, in the order of hashes, are left out.
SAMPLE_BYTES = 1 << 26
#: Cost of a violated margin (of the smaller class more, in inverse proportion), rounds over the sample, folds for the scale.
COST, ROUNDS, FOLDS = 1.0, 15, 3
#: Documents that score this or more are predicted to be of quality 1.
THRESHOLD = 0.3
#: Bytes of a text looked at in one step.
BLOCK = 1 << 20


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def features(text: str | None) -> np.ndarray:
    """Indicators of a text's byte n-grams and of how much of it repeats, as sorted hash numbers below DIMS."""
    raw = (text or "").encode()
    found = []
    for n in GRAMS:
        own = [np.zeros(0, np.uint32)]
        for at in range(0, len(raw) - n + 1, BLOCK):
            part = np.frombuffer(raw, np.uint8, min(BLOCK + n - 1, len(raw) - at), at).astype(np.uint32)
            gram = part[: len(part) - n + 1].copy()
            for k in range(1, n):
                gram = gram << np.uint32(8) | part[k : len(part) - n + 1 + k]
            own.append(_distinct(gram))
        found.append(_distinct(np.concatenate(own)) if len(own) > 2 else own[-1])
    words = raw.split()
    length = len(words).bit_length()
    shape = [(1, length)]
    if words:
        same = sum(map(bytes.__eq__, words, words[1:]))
        shape += [(2, length // 2, 16 * len(set(words)) // len(words)), (3, 16 * same // len(words)), (4, int(16 * len(found[-1]) / (len(raw) + 1)), length // 2)]
    marks = [zlib.crc32(bytes(s)) for s in shape]
    hashed = [(grams + np.uint32(n << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS) for n, grams in zip(GRAMS, found, strict=True)]
    return _distinct(np.concatenate([*hashed, np.array(marks, np.uint32) >> np.uint32(32 - BITS)]))


@dataclass
class Model:
    """Margin: bias + sum of weights over a text's features / their norm; score: its logistic, scaled by slope and shift."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        r = self.ratios[features]
        return float(self.weights[features] @ r / max(math.sqrt(float(r @ r)), 1e-9) + self.bias)

    def score(self, features: np.ndarray) -> float:
        z = self.slope * self.margin(features) + self.shift
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(max(z, -700)) / (1 + math.exp(max(z, -700)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)), with p and q one more than the rows of either class that have a feature."""
    p, q = np.ones(DIMS), np.ones(DIMS)
    for row, g in zip(rows, good, strict=True):
        (p if g else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(values: list[np.ndarray], rows: list[np.ndarray], good: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model of least hinge loss: one dual variable at a time is set to its best value."""
    rng, n = np.random.default_rng(seed), len(rows)
    sign = np.where(good, 1.0, -1.0)
    cost = np.where(good, COST * max(1.0, (~good).sum() / max(1, good.sum())), COST * max(1.0, good.sum() / max(1, (~good).sum())))
    square = np.array([v @ v + 1 for v in values])
    weights, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(n)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(n):
            row, value = rows[i], values[i]
            slack = sign[i] * (weights[row] @ value + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * sign[i]:
                weights[row] += step * value
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def scale(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits margins best (Platt), by Newton's method."""
    p, n = good.sum(), (~good).sum()
    want = np.where(good, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        y = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (y * (1 - y))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (want - y) - 1e-6 * at)
        at = at + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """The model of labelled texts, given as their features. Its scale is fitted on margins of folds left out.

    With one class only, or none, every score is that class's smoothed share.
    """
    if not len(good) or not good.any() or good.all():
        share = (good.sum() + 0.5) / (len(good) + 1)
        return Model(np.zeros(DIMS, np.float32), np.zeros(DIMS, np.float32), 0.0, 0.0, math.log(share / (1 - share)))

    def trained(own: np.ndarray) -> Model:
        ratios = log_count_ratios([rows[i] for i in own], good[own])
        values = [ratios[rows[i]] for i in own]
        values = [v / max(math.sqrt(float(v @ v)), 1e-9) for v in values]
        weights, bias = dual_coordinate_descent(values, [rows[i] for i in own], good[own])
        return Model(weights, ratios, bias, 1.0, 0.0)

    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        part = trained(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    model = trained(np.arange(len(rows)))
    model.slope, model.shift = scale(margins, good)
    if model.slope <= 0:
        model.slope, model.shift = 0.0, math.log(good.mean() / (1 - good.mean()))
    model.weights, model.ratios = model.weights.astype(np.float32), model.ratios.astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    """Ids that are never learned from. A null id is not held out, but there are no labels for it either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@releasing
def _features_of(batches):
    for batch in batches:
        found = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "features", "quality"])


@releasing
def _fitted(batches, most: int):
    """The model of a sample (doc_id, features, quality) as one row."""
    rows, good, size = [], [], 0
    for batch in batches:
        for found, quality in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            found = found.as_py()
            size += len(found)
            if size <= most:
                rows.append(np.frombuffer(found, np.uint32))
                good.append(quality == 1)
    model = fit(rows, np.array(good, bool))
    values = [[model.weights.astype(np.float32).tobytes()], [model.ratios.astype(np.float32).tobytes()], [model.bias], [model.slope], [model.shift]]
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["weights", "ratios", "bias", "slope", "shift"])


def fit_on_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labelled documents that are not held out, at most SAMPLE_ROWS and SAMPLE_BYTES.

    Labels of an id that disagree count as 0; of rows that repeat an id, the one of the least features (as bytes) is
    used. Null texts count as empty; labels without a document, of a null id or other than 0 and 1 are ignored. Without
    labels every score is 0.5. The model is fitted in one task, and only its weights, 2 MB, come to the driver.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = hashed_sample(known, "doc_id", known.count(), SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    rows = (
        sample.mapInArrow(_features_of, "doc_id bigint, features binary, quality int")
        .groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select("doc_id", "features", "quality")
    )
    fitted = rows.mapInArrow(partial(_fitted, most=SAMPLE_BYTES), "weights binary, ratios binary, bias double, slope double, shift double").first()
    if fitted is None:  # no rows, no task
        return fit([], np.zeros(0, bool))
    return Model(np.frombuffer(fitted.weights, np.float32), np.frombuffer(fitted.ratios, np.float32), fitted.bias, fitted.slope, fitted.shift)


@releasing
def _scored(batches, model: Model):
    for batch in batches:
        scores = np.array([model.score(features(t.as_py())) for t in batch.column(1)], float)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
        )


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, for every row, one by one: repeated rows score alike, an empty table
    gives none. A null text scores as an empty one; a null id isn't held out; other columns are ignored."""
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        partial(_scored, model=model), "doc_id bigint, held_out boolean, score double, predicted int"
    )


@releasing
def _good_rows(batches, model: Model, at: int):
    for batch in batches:
        yield batch.filter(pa.array([model.score(features(t.as_py())) >= THRESHOLD for t in batch.column(at)], pa.bool_()))


def drop_poor(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the rows predicted to be poor; columns as they were. It moves no rows between executors. Null texts
    score as empty ones; repeated rows stay or go together; an empty table gives none."""
    return docs.mapInArrow(partial(_good_rows, model=model, at=docs.columns.index("text")), docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_on_documents(docs, table(spark, sf_dir, "labels")))
