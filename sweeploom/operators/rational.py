"""Rational fits of sweeps: fixed poles, per-block least squares, scoring and
response-conditioned coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Samples of a group that one slice may hold, and triangles folded at once.
SLICE_ROWS = 4_096
FOLD_FAN_IN = 256
_PIECE = 2_000_000


def fixed_poles(low: float, high: float, count: int, damping: float) -> tuple[np.ndarray, float]:
    """Log-spaced conjugate pole pairs over the scaled band, and the scale."""
    scale = math.sqrt(low * high)
    start = max(low / scale, 1e-6)
    stop = max(high / scale, start * 1.01)
    pairs = count // 2
    found: list[complex] = []
    if pairs:
        spacing = np.logspace(math.log10(0.75 * start), math.log10(1.25 * stop), pairs)
        found = [complex(-damping * w, sign * w) for w in spacing for sign in (1, -1)]
    if count % 2:
        found.append(complex(-math.sqrt(start * stop), 0.0))
    return np.array(found, dtype=complex), scale


def band(rows: DataFrame, axis: str = "freq_hz") -> tuple[float, float]:
    """Smallest and largest positive frequency (one aggregate row)."""
    row = rows.where(F.col(axis) > 0).agg(F.min(axis), F.max(axis)).first()
    if row[0] is None:
        raise ValueError("no positive frequency")
    return float(row[0]), float(row[1])


def basis(freq: np.ndarray, poles: np.ndarray, scale: float) -> np.ndarray:
    s = 1j * np.asarray(freq, dtype=float)[:, None] / scale
    return np.concatenate([np.ones_like(s), 1.0 / (s - poles[None, :])], axis=1)


def basis_columns(freq: Column, poles: np.ndarray, scale: float) -> Column:
    """ARRAY<STRUCT<re, im>> of the basis, JVM-side."""
    w = freq / F.lit(scale)
    cells = [F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))]
    for p in poles:
        # 1 / (jw - p), with jw - p = a + jb
        a, b = F.lit(-float(p.real)), w - F.lit(float(p.imag))
        norm = a * a + b * b
        cells.append(F.struct((a / norm).alias("re"), (-b / norm).alias("im")))
    return F.array(*cells)


def fit(
    rows: DataFrame,
    keys: Sequence[str],
    poles: np.ndarray,
    scale: float,
    ridge: float = 0.0,
    axis: str = "freq_hz",
    re: str = "re",
    im: str = "im",
    weight: str | None = None,
) -> DataFrame:
    """Weighted ridge fit per group: ``keys, coef_re ARRAY, coef_im ARRAY``.

    A group is cut into slices of bounded length.  Each slice shrinks to the
    triangle of a QR factorisation of [basis, response] (not to squared normal
    equations, which lose digits); the triangles of a group are folded a few
    hundred at a time until one is left.  Slices are factorised as stacked
    matrices, many groups per call.
    """
    size = len(poles) + 1
    names = list(keys)
    data = rows.where(F.col(axis) > 0).select(
        *names,
        F.col(axis).cast("double").alias("f"),
        F.col(re).cast("double").alias("a"),
        F.col(im).cast("double").alias("b"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
    )
    longest = data.groupBy(*names).count().agg(F.max("count").alias("m")).first()["m"] or 0
    lanes = max(1, -(-longest // SLICE_ROWS))

    @F.pandas_udf("array<double>")
    def triangle(samples: pd.Series) -> pd.Series:
        def stack(part):
            n = max(len(v) for v in part)
            cube = np.zeros((len(part), n, 4))
            for k, v in enumerate(part):
                cube[k, : len(v)] = [(s["f"], s["a"], s["b"], s["w"]) for s in v]
            f, y, w = cube[:, :, 0], cube[:, :, 1] + 1j * cube[:, :, 2], np.sqrt(cube[:, :, 3])
            flat = basis(f.reshape(-1), poles, scale).reshape(*f.shape, size)
            return np.concatenate([flat, y[:, :, None]], axis=2) * w[:, :, None]

        return _in_pieces(samples, lambda v: len(v) * (size + 1), lambda part: _pack(_upper(stack(part), size + 1)))

    @F.pandas_udf("array<double>")
    def fold(parts: pd.Series) -> pd.Series:
        def stack(part):
            n = max(len(v) for v in part) * (size + 1)
            cube = np.zeros((len(part), n, size + 1), dtype=complex)
            for k, v in enumerate(part):
                rows_ = _unpack(np.stack(list(v)), size + 1).reshape(-1, size + 1)
                cube[k, : len(rows_)] = rows_
            return cube

        return _in_pieces(parts, lambda v: len(v) * (size + 1) ** 2, lambda part: _pack(_upper(stack(part), size + 1)))

    @F.pandas_udf("array<double>")
    def solve(triangles: pd.Series) -> pd.Series:
        def work(part):
            full = _unpack(np.stack(list(part)), size + 1)
            if ridge > 0:
                extra = np.zeros((len(full), size, size + 1), dtype=complex)
                extra[:, range(size), range(size)] = math.sqrt(ridge)
                full = _upper(np.concatenate([full, extra], axis=1), size + 1)
            r, y = full[:, :size, :size], full[:, :size, size]
            diagonal = np.abs(np.diagonal(r, axis1=1, axis2=2))
            sound = diagonal.min(axis=1) > 1e-13 * np.maximum(diagonal.max(axis=1), 1e-300)
            out = np.zeros_like(y)
            if sound.any():
                out[sound] = np.linalg.solve(r[sound], y[sound][:, :, None])[:, :, 0]
            for k in np.nonzero(~sound)[0]:  # fewer samples than coefficients: least norm
                out[k] = np.linalg.lstsq(full[k, :, :size], full[k, :, size], rcond=None)[0]
            return list(np.concatenate([out.real, out.imag], axis=1))

        return _in_pieces(triangles, len, work)

    if lanes > 1:
        # Copies of a sample would share a slice: they become one weighted sample.
        data = data.groupBy(*names, "f", "a", "b").agg(F.sum("w").alias("w"))
    lane = F.pmod(F.xxhash64("f", "a", "b"), F.lit(lanes)) if lanes > 1 else F.lit(0)
    sliced = data.groupBy(*names, lane.alias("__lane")).agg(F.collect_list(F.struct("f", "a", "b", "w")).alias("s"))
    state = sliced.select(*names, "__lane", triangle("s").alias("t"))
    while lanes > 1:
        lanes = -(-lanes // FOLD_FAN_IN)
        state = (
            state.withColumn("__lane", F.pmod("__lane", F.lit(lanes)))
            .groupBy(*names, "__lane")
            .agg(F.collect_list("t").alias("s"))
            .select(*names, "__lane", fold("s").alias("t"))
        )
    solved = state.select(*names, solve("t").alias("c"))
    return solved.select(*names, F.slice("c", 1, size).alias("coef_re"), F.slice("c", size + 1, size).alias("coef_im"))


def _upper(stack: np.ndarray, size: int) -> np.ndarray:
    """R factors (G, size, size) of stacked matrices with ``size`` columns."""
    if stack.shape[1] < size:
        pad = np.zeros((len(stack), size - stack.shape[1], size), dtype=complex)
        stack = np.concatenate([stack, pad], axis=1)
    return np.linalg.qr(stack, mode="r")


def _pack(stack: np.ndarray) -> list:
    flat = stack.reshape(len(stack), -1)
    return list(np.concatenate([flat.real, flat.imag], axis=1))


def _unpack(flat: np.ndarray, size: int) -> np.ndarray:
    half = size * size
    return (flat[:, :half] + 1j * flat[:, half:]).reshape(-1, size, size)


def _in_pieces(values: pd.Series, weight, work) -> pd.Series:
    """Apply ``work`` to runs of similar size whose padded total stays bounded."""
    if not len(values):
        return pd.Series([], dtype=object)
    sizes = np.array([weight(v) for v in values])
    order = np.argsort(sizes, kind="stable")
    out = np.empty(len(values), dtype=object)
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= _PIECE:
            stop += 1
        picked = order[start:stop]
        for at, result in zip(picked, work([values.iloc[k] for k in picked])):
            out[at] = result
        start = stop
    return pd.Series(list(out), index=values.index, dtype=object)


def evaluate(samples: DataFrame, coefficients: DataFrame, keys: Sequence[str], poles: np.ndarray, scale: float, axis: str = "freq_hz") -> DataFrame:
    """``fit_re, fit_im`` of each sample from the coefficients of its group."""
    joined = samples.join(coefficients, list(keys))
    b = basis_columns(F.col(axis), poles, scale)
    terms = F.zip_with(
        F.arrays_zip(F.col("coef_re").alias("re"), F.col("coef_im").alias("im")),
        b,
        lambda c, x: F.struct(
            (c["re"] * x["re"] - c["im"] * x["im"]).alias("re"),
            (c["re"] * x["im"] + c["im"] * x["re"]).alias("im"),
        ),
    )
    with_terms = joined.withColumn("__t", terms)
    total = lambda part: F.aggregate("__t", F.lit(0.0), lambda acc, t: acc + t[part])
    return (
        with_terms.withColumn("fit_re", total("re")).withColumn("fit_im", total("im")).drop("__t", "coef_re", "coef_im")
    )


def flatten(coefficients: DataFrame, block: Sequence[str], label: str) -> DataFrame:
    """One row per block: real parts of all labels in order, then imaginary parts."""
    grouped = coefficients.groupBy(*block).agg(
        F.array_sort(F.collect_list(F.struct(label, "coef_re", "coef_im"))).alias("c")
    )
    return grouped.select(
        *block,
        F.concat(
            F.flatten(F.transform("c", lambda x: x["coef_re"])), F.flatten(F.transform("c", lambda x: x["coef_im"]))
        ).alias("coefficients"),
        F.transform("c", lambda x: x[label]).alias("labels"),
    )


def unflatten(rows: DataFrame, block: Sequence[str], label: str, size: int) -> DataFrame:
    """Inverse of :func:`flatten`."""
    half = F.size("labels") * size
    picked = rows.select(*block, F.posexplode("labels").alias("__i", label), "coefficients", half.alias("__h"))
    return picked.select(
        *block,
        label,
        F.slice("coefficients", F.col("__i") * size + 1, size).alias("coef_re"),
        F.slice("coefficients", F.col("__h") + F.col("__i") * size + 1, size).alias("coef_im"),
    )


def conditioning(
    rows: DataFrame, poles: np.ndarray, scale: float, ridge: float = 0.0, axis: str = "freq_hz", weight: str | None = None
) -> tuple[np.ndarray, np.ndarray, dict]:
    """Encoder and decoder whose Euclidean error is the response error.

    R of the basis over all rows: one small triangle per Arrow batch, folded per
    partition lane on the executors; only the lane triangles reach the driver.
    """
    size = len(poles) + 1
    data = rows.where(F.col(axis) > 0).select(
        F.col(axis).alias("__f"), (F.col(weight) if weight else F.lit(1.0)).alias("__w")
    )

    def triangles(batches):
        held = np.zeros((0, size), dtype=complex)
        count = 0
        for pdf in batches:
            b = basis(pdf["__f"].to_numpy(), poles, scale) * np.sqrt(pdf["__w"].to_numpy())[:, None]
            held = np.linalg.qr(np.vstack([held, b]), mode="r")
            count += len(pdf)
        if count:
            flat = held.reshape(-1)
            yield pd.DataFrame(
                {"lane": [0], "n": [count], "re": [flat.real.copy()], "im": [flat.imag.copy()]}
            )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.concatenate(
            [(np.array(a) + 1j * np.array(b)).reshape(-1, size) for a, b in zip(pdf["re"], pdf["im"])]
        )
        flat = np.linalg.qr(stack, mode="r").reshape(-1)
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "re": [flat.real], "im": [flat.imag]})

    schema = "lane int, n long, re array<double>, im array<double>"
    parts = data.mapInPandas(triangles, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    lanes = parts.groupBy("lane").applyInPandas(fold, "n long, re array<double>, im array<double>").collect()
    if not lanes:
        raise ValueError("no positive frequency")
    count = sum(r["n"] for r in lanes)
    response = np.concatenate([(np.array(r["re"]) + 1j * np.array(r["im"])).reshape(-1, size) for r in lanes])
    stack = np.vstack([response, math.sqrt(ridge) * np.eye(size)]) if ridge > 0 else response
    rank = int(np.linalg.matrix_rank(stack))
    if rank < size:
        raise ValueError(f"the basis has rank {rank} of {size} on these frequencies")
    upper = np.linalg.qr(stack, mode="r")
    encoder = upper.T
    decoder = np.linalg.inv(encoder)
    facts = {
        "frequency_rows": count,
        "coefficient_count": size,
        "rank": rank,
        "basis_condition_number": float(np.linalg.cond(response)),
        "conditioning_matrix_condition_number": float(np.linalg.cond(stack)),
        "decoder_condition_number": float(np.linalg.cond(decoder)),
    }
    return encoder, decoder, facts


def transform_coefficients(coefficients: DataFrame, keys: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """Multiply each coefficient row by a complex matrix from the right."""
    re_cols, im_cols = [], []
    for j in range(matrix.shape[1]):
        re = im = F.lit(0.0)
        for i in range(matrix.shape[0]):
            a, b = F.lit(float(matrix[i, j].real)), F.lit(float(matrix[i, j].imag))
            x, y = F.get("coef_re", F.lit(i)), F.get("coef_im", F.lit(i))
            re, im = re + (x * a - y * b), im + (x * b + y * a)
        re_cols.append(re)
        im_cols.append(im)
    return coefficients.select(*keys, F.array(*re_cols).alias("coef_re"), F.array(*im_cols).alias("coef_im"))


def real_form(matrix: np.ndarray, labels: int) -> np.ndarray:
    """Real equivalent of the transform on the flattened coefficient row."""
    block = np.kron(np.eye(labels), matrix)
    return np.block([[block.real, block.imag], [-block.imag, block.real]])
