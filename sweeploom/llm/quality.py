"""Quality classifier: regularised quadratic discriminant analysis.

A document is described by a few statistics of its whole text, transformed to
be roughly normal.  Each class has a mean and a covariance over all labelled
rows that may be learnt from; covariances shrink towards the pooled one and
towards a multiple of the identity.  The score comes from the difference of
the two log densities, with Mahalanobis distances solved by Cholesky factors
that are computed once and shipped with the task, and is calibrated on the
same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common

THRESHOLD = 0.3
SHRINK_POOLED = 0.1
SHRINK_SPHERE = 0.02
# The log-density difference enters the calibration in cells of this width.
CELL = 1 / 64

NAMES = (
    "words", "word_length", "upper", "digits", "symbols", "bars", "stops", "lines",
    "repeats", "distinct", "heavy", "spread",
)

_CODE = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 bar, 5 sentence mark, 6 line end
_CODE[0x41:0x5B] = 1
_CODE[0x30:0x3A] = 2
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~":
    _CODE[_c] = 3
_CODE[ord("|")] = 4
_CODE[ord(".")] = _CODE[ord(",")] = 5
_CODE[0x0A] = 6


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text gives zeros."""
    n = len(ends) - 1
    size = np.maximum(np.diff(ends), 1).astype(float)
    code = _CODE[data]
    owner = np.repeat(np.arange(n), np.diff(ends))

    def count(k: int) -> np.ndarray:
        return np.bincount(owner[code == k], minlength=n).astype(float)

    low = common.lower_ascii(data)
    start, end, own = common.word_spans(data, ends)
    words = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(words, 1)
    letters = np.bincount(own, end - start, minlength=n)
    sums = common.prefix_sums(low)
    word = common.span_hashes(sums, start, end)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (own[1:] == own[:-1])
    order = np.lexsort((word, own))
    fresh = np.ones(len(word), bool)
    a, o = word[order], own[order]
    fresh[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n).astype(float)
    # Words that end in a symbol, and the share of the longest words' bytes.
    heavy = np.bincount(own[code[end - 1] == 3], minlength=n).astype(float) if len(end) else np.zeros(n)
    squares = np.bincount(own, (end - start).astype(float) ** 2, minlength=n)
    mean = letters / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    # Zipf-like decay of distinct words is taken out by the length itself.
    out = np.column_stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.sqrt(count(1) / size),
            np.sqrt(count(2) / size),
            np.sqrt(count(3) / size),
            np.sqrt(count(4) / size),
            np.sqrt(count(5) / some),
            np.log1p(100 * count(6) / some),
            np.sqrt(np.bincount(own[same], minlength=n) / some),
            np.log((distinct + 1) / (words + 1)),
            np.sqrt(heavy / some),
            np.log1p(spread),
        ]
    )
    return out


def described(docs: DataFrame, keep) -> DataFrame:
    """``keep`` columns and ``stats``, an array of doubles.  A NULL text counts as empty."""

    def run(column):
        import pyarrow as pa

        rows = np.zeros((len(column), len(NAMES)))
        for lo, hi, data, ends in common.parts(column):
            rows[lo:hi] = statistics(data, ends)
        flat = pa.array(rows.reshape(-1))
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32)), flat)]

    return common.with_text_results(docs, keep, [T.StructField("stats", T.ArrayType(T.DoubleType()))], run)


class Discriminant:
    """Means, Cholesky factors and calibration; ``flat`` where a class is missing."""

    def __init__(self, counts, sums, products) -> None:
        d = len(NAMES)
        self.flat = None
        self.line = np.array([0.0, 1.0])
        if min(counts) < 2:
            self.flat = (counts[1] + 1) / (sum(counts) + 2)
            return
        mean = [s / c for s, c in zip(sums, counts)]
        cov = [p / c - np.outer(m, m) for p, c, m in zip(products, counts, mean)]
        pooled = sum(c * v for c, v in zip(counts, cov)) / sum(counts)
        sphere = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
        self.mean, self.factor, self.log_det = mean, [], []
        for v in cov:
            v = (1 - SHRINK_POOLED - SHRINK_SPHERE) * v + SHRINK_POOLED * pooled + SHRINK_SPHERE * sphere
            lower = np.linalg.cholesky(v)
            # The inverse factor turns a batch of distances into one product.
            self.factor.append(np.linalg.inv(lower))
            self.log_det.append(2 * np.log(np.diag(lower)).sum())
        self.prior = np.log(counts[1] / counts[0])

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Compressed difference of log densities, class 1 over class 0."""
        log_density = []
        for m, f, d in zip(self.mean, self.factor, self.log_det):
            z = (x - m) @ f.T
            log_density.append(-0.5 * ((z * z).sum(axis=1) + d))
        return np.arcsinh(log_density[1] - log_density[0] + self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * self.ratio(x), -40, 40)))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on every labelled row outside the held-out fold.

    Sums of statistics and of their products are folded in tasks and by a
    grouped sum, so the driver sees 2 * (1 + d + d^2) numbers at any size.
    """
    d = len(NAMES)
    rows = stats.join(common.labelled(labels, "quality"), "doc_id").select("stats", "label")

    def fold(batches):
        import pyarrow as pa

        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([0, 1], total.shape[1])),
                pa.array(np.tile(np.arange(total.shape[1]), 2)),
                pa.array(total.reshape(-1)),
            ],
            names=["label", "place", "value"],
        )

    folded = rows.mapInArrow(fold, "label long, place long, value double")
    found = folded.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in found:
        total[r["label"], r["place"]] = r["value"]
    model = Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))
    if model.flat is None:
        model.line = _calibration(rows, model)
    return model


def _calibration(rows: DataFrame, model: Discriminant) -> np.ndarray:
    """Intercept and slope from counts of labels by cell of the ratio (at most a few thousand cells)."""

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            cell = np.rint(np.clip(model.ratio(_matrix(batch.column(0))), -32, 32) / CELL).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "label"])

    counts = rows.mapInArrow(cells, "cell long, label int").groupBy("cell", "label").count().collect()
    x = np.array([r["cell"] * CELL for r in counts])
    return common.logistic_fit(x[:, None], np.array([r["label"] for r in counts]), np.array([r["count"] for r in counts], float))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def score(stats: DataFrame, model: Discriminant, keep) -> DataFrame:
    """``keep`` columns with score and predicted; 1 means good."""
    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    names = schema.names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array(model.score(_matrix(batch.column(0))))
            yield pa.RecordBatch.from_arrays([batch.column(1 + i) for i in range(len(keep))] + [found], names=names)

    taken = stats.select("stats", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)])
    out = taken.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = common.stored(described(docs, ["doc_id"]), "quality-stats")
    model = train(stats, common.table(spark, sf_dir, "labels"))
    out = score(stats, model, ["doc_id"])
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
