"""Quality classifier: naive Bayes support vectors over byte n-grams.

Features are indicators of the byte 2-, 3- and 4-grams of the whole text (hashed into a fixed number of places), each
scaled by its class log-count ratio, the row scaled to length one. A linear hinge-loss model is fitted to them by dual coordinate
descent, and a logistic curve over rows kept out of that fit turns margins into scores; it knows how short
a row is, as few n-grams can say less. The fit uses a bounded
sample of the labelled rows, by order of a hash of the id: ``max_rows`` of them, and fewer where their features exceed ``max_bytes``. It runs in one task
on an executor, so the driver gets the model alone; scoring covers every row of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import written

#: Places for features: 2-grams have one each, 3- and 4-grams share the others by hash.
PLACES = 1 << 18
#: Bytes of one text looked at together.
SLICE = 1 << 20
#: Length, of log-count ratios before scaling, that counts as one unit of shortness.
SHORT = 30.0


def places(text: bytes, table: np.ndarray) -> np.ndarray:
    """The different feature places of a text, ascending. ``table`` is a cleared boolean array of PLACES, left cleared."""
    for at in range(0, max(len(text) - 1, 0), SLICE):
        b = np.frombuffer(text, dtype=np.uint8, count=min(SLICE + 3, len(text) - at), offset=at).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        four = three[:-1] << np.uint32(8) | b[3:]
        table[two] = True
        table[(1 << 16) + (three * np.uint32(2654435761) >> np.uint32(16))] = True
        table[(1 << 17) + (four * np.uint32(2246822519) >> np.uint32(15))] = True
    found = np.flatnonzero(table).astype(np.int32)
    table[found] = False
    return found


@dataclass
class Model:
    """Weights folded into the ratios, squared ratios for the row's length, and the logistic curve; 2 MB."""

    weights: np.ndarray
    squares: np.ndarray
    curve: np.ndarray

    def evidence(self, found: np.ndarray) -> tuple[float, float, float]:
        """The margin of a row's places, how short the row is (one over its length before scaling, by SHORT), and 1; 0, 0 and 1 where no place counts."""
        length = np.sqrt(self.squares[found].sum(dtype=np.float64))
        return (float(self.weights[found].sum(dtype=np.float64) / length), float(SHORT / length), 1.0) if length > 0 else (0.0, 0.0, 1.0)

    def score(self, rows: Iterable[np.ndarray]) -> np.ndarray:
        """Scores from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(np.array([self.evidence(r) for r in rows]).reshape(-1, 3) @ self.curve, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) for each place; p and q are smoothed counts of rows of the two classes. 0 where no row counts."""
    q, p = counts = np.zeros((2, PLACES))
    for r, y in zip(rows, labels, strict=True):
        counts[y][r] += 1  # a row holds a place once
    ratio = np.log((p + smooth) / (p + smooth).sum()) - np.log((q + smooth) / (q + smooth).sum())
    return np.where(p + q > 0, ratio, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1 hinge-loss model (Hsieh et al. 2008); the bias is a constant feature of 1."""
    w, bias, alpha, y = np.zeros(PLACES), 0.0, np.zeros(len(rows)), np.where(labels == 1, 1.0, -1.0)
    diagonal, order = np.array([v @ v + 1 for v in values]), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                now = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
                step = (now - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = now
        if worst < 0.01:
            break
    return w, bias


def logistic(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic curve over rows of evidence, by Newton steps on Platt's smoothed targets."""
    positive = labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(theta)), x.T @ (p - target) + ridge * theta)
        theta -= step
        if abs(step).max() < 1e-8:
            break
    return theta


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, *, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> Model:
    """The model of sampled rows; every fifth row shapes the logistic curve only. Without two classes: a constant score, the smoothed share of label 1."""
    fold = np.arange(len(rows)) % 5 == 4
    if min(sum(labels[~fold] == 1), sum(labels[~fold] == 0)) == 0 or len(set(labels[fold])) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32), np.array([0.0, 0.0, np.log(share / (1 - share))]))
    own, y = [r for r, f in zip(rows, fold, strict=True) if not f], labels[~fold]
    ratio = log_count_ratios(own, y)
    values = [(v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32) for v in (ratio[r] for r in own)]
    w, _ = dual_coordinate_descent(own, values, y, cost, epochs, seed)
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), np.zeros(3))
    model.curve = logistic(np.array([model.evidence(r) for r, f in zip(rows, fold, strict=True) if f]), labels[fold])
    return model


def features(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``places``, the packed 32-bit feature places of each whole text."""
    at = docs.columns.index(text_col)
    fields = [T.StructField("places", T.BinaryType()) if f.name == text_col else f for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(PLACES, dtype=bool)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([places(t.as_py() or b"", table).astype("<i4").tobytes() for t in columns[at].cast(pa.binary())], type=pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000, max_bytes: int = 96 << 20, **options) -> Model:
    """Fit on up to ``max_rows`` labelled ids, by order of a hash of the id, and up to ``max_bytes`` of their packed features: on the same rows in each run.

    Rows with a null id or a label other than 0 and 1 aren't used. Of several labels of an id the largest counts, of several texts the least.
    A very long text counts whole; its features are bounded by PLACES.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    joined = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col)).join(F.broadcast(sample), id_col)
    one = joined.groupBy(id_col, "__label").agg(F.min(text_col).alias(text_col))
    found = written(features(one.select(F.xxhash64(id_col).alias("at"), id_col, "__label", text_col), text_col=text_col), "svm-sample")
    upto, size = 0, 0
    sizes = found.orderBy("at", id_col).select(F.octet_length("places")).limit(max_rows).collect()
    while upto < len(sizes) and (size := size + sizes[upto][0]) <= max_bytes:
        upto += 1
    if not upto:
        return fit_rows([], np.empty(0, dtype=int), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # bounded by max_bytes
        rows = [np.frombuffer(r.as_buffer(), dtype="<i4") for b in parts for r in b.column(1)]  # views of the batches' own memory
        model = fit_rows(rows, np.array([y for b in parts for y in b.column(0).to_pylist()], dtype=int), **options)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], type=pa.binary()) for x in (model.weights, model.squares, model.curve)], names=["weights", "squares", "curve"])

    bounded = found.orderBy("at", id_col).limit(upto).select("__label", "places").coalesce(1)
    row = bounded.mapInArrow(run, "weights binary, squares binary, curve binary").first()
    return Model(np.frombuffer(row["weights"], np.float32), np.frombuffer(row["squares"], np.float32), np.frombuffer(row["curve"], np.float64))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """``id_col``, the columns ``extra`` and the score ``out_col`` for every row; one pass without a shuffle.

    Null and empty texts have no n-grams: their score is that of the curve's constant. Null ids and repeated rows stay; an
    empty table gives no rows. Columns not named don't pass, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(id_col, *(c for c in extra if c != text_col), text_col)
    passed = len(docs.columns) - (text_col not in extra)
    schema = T.StructType([*docs.schema.fields[:passed], T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, np.zeros(PLACES, dtype=bool)
        for batch in batches:
            scores = m.score(places(t.as_py() or b"", table) for t in batch.columns[-1].cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)
