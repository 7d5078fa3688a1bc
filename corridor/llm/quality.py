"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import bounded, fold, settled, text_hash, without

#: Labelled rows that are fitted, at most; chosen by a hash of doc_id. Everything else covers all rows.
MAX_LABELLED = 200_000
FEATURES, RIDGE, SEED = 256, 1e-3, 42
THRESHOLD = 0.7
#: Ends of the bins of raw scores in which labels are summed for the calibration.
BINS = np.linspace(-0.5, 1.5, 401)


def _classes() -> np.ndarray:
    """For each byte, which of the counted classes it is in."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ".,;:'\"()-", " \t\n\r\x0b\x0c"]
    table = np.zeros((256, len(groups) + 1))
    for k, chars in enumerate(groups):
        table[[ord(c) for c in chars], k] = 1
    table[128:, len(groups)] = 1
    return table


CLASSES = _classes()


def statistics(data: bytes) -> list[float]:
    """Numbers of one text, each of bounded size: lengths in logarithms, shares of byte classes, and repetition."""
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(words)
    common = Counter(words).most_common(1)[0][1] if m else 0
    same = sum(map(bytes.__eq__, words, words[1:]))
    letters = counts[0] + counts[1]
    return [
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        min(sum(map(len, words)) / m, 40) / 10 if m else 0,
        counts[0] / letters if letters else 0,
        *(counts[k] / n if n else 0 for k in range(2, 8)),
        len(set(words)) / m if m else 0,
        common / m if m else 0,
        same / m if m else 0,
        1 - len(set(lines)) / len(lines) if lines else 0,
        len(lines) / (m + 1),
    ]


N_STATISTICS = 15


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([statistics(x or b"") for x in data], index=data.index)

    return run(text.cast("binary"))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """An approximation of a Gaussian kernel of unit width, after scaling each statistic; and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.weights + self.shift)
        return np.concatenate([f, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), N_STATISTICS)


def isotonic(knots: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing levels that fit shares ones/rows best."""
    pools: list[list[float]] = []
    for i, (a, n) in enumerate(zip(ones, rows, strict=True)):
        pools.append([a, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + a2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), a / n) for a, n, k in pools])


def fit(labelled: DataFrame) -> Model | None:
    """``labelled``: x (statistics), y (0 to 1), calib (boolean). Gram matrices are summed by partition, then added.

    Rows with calib false give the normal equations; the others give the calibration. None without labelled rows.
    """
    spread = labelled.where("not calib").select(*[F.struct(F.avg(c), F.stddev_pop(c)) for c in (F.col("x")[k] for k in range(N_STATISTICS))]).first()
    if spread is None or spread[0][0] is None:
        return None
    mean, scale = (np.array([s[k] for s in spread]) for k in (0, 1))
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS / 2)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    blank = Model(mean, np.where(scale > 1e-9, scale, 1), weights, shift, np.zeros(FEATURES + 1), BINS[:1], BINS[:1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            f = blank.features(_matrix(b.column(0)))
            total += f.T @ np.concatenate([f, b.column(1).to_numpy(zero_copy_only=False)[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "v"])

    parts = labelled.where("not calib").select("x", "y").coalesce(16).mapInArrow(sums, "k int, v array<double>")
    added = parts.groupBy("k").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(FEATURES + 2)]).orderBy("k").collect()
    total = np.array([r[1:] for r in added], float)
    gram, rhs = total[:, :-1], total[:, -1]
    n = gram[-1, -1]
    beta = np.linalg.solve(gram + RIDGE * n * np.diag([1.0] * FEATURES + [1e-9]) / FEATURES, rhs)
    fitted = Model(blank.mean, blank.scale, weights, shift, beta, BINS[:1], BINS[:1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip(np.searchsorted(BINS, fitted.raw(_matrix(b.column(0)))), 0, len(BINS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(1)], ["bin", "y"])

    counted = labelled.where("calib").select("x", "y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    if not counted:
        return Model(blank.mean, blank.scale, weights, shift, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    at, ones, rows = (np.array([r[k] for r in counted], float) for k in range(3))
    knots = BINS[at.astype(int)]
    return Model(blank.mean, blank.scale, weights, shift, beta, knots, isotonic(knots, ones, rows))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from the statistics of its whole text alone.

    Labels (doc_id, quality) teach only where crc32(doc_id) mod 4 is not 2; a doc_id labelled more than once counts
    with its mean, null labels and ids not at all. A null text has the statistics of the empty one. Without a label to
    learn from, every score is 1: nothing speaks against a document. Repeated rows are scored alike.
    """
    return _scored(docs, labels).drop("text_hash")


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = settled(docs.select("doc_id", statistics_of(F.col("text")).alias("x"), text_hash(F.col("text")).alias("text_hash")))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    marks = settled(bounded(marks.where(fold(F.col("doc_id"), 4) != 2), MAX_LABELLED, "doc_id"))
    calib = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(4)) == 0
    model = fit(settled(known.join(marks, "doc_id").select("x", "y", calib.alias("calib"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(1))) if model else np.ones(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score)], ["doc_id", "text_hash", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = known.mapInArrow(run, f"doc_id {kind}, text_hash long, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "text_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, each by its own text."""
    return without(docs, _scored(docs, labels).where("predicted = 0"))
