"""Complex matrices as real arrays.

A matrix of N ports is ARRAY<DOUBLE> of length 2*N*N: all real parts in row
order, then all imaginary parts.  Two-port results that have a closed form are
column expressions; general N runs on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TINY_SIGMA = 1e-300


def port_numbers(label: Column) -> Column:
    """STRUCT<row, col> of an entry label: ``S21``, or ``S12_3`` / ``S12,3``
    style labels for ten ports and more."""
    wide = r"^[A-Za-z]+(\d+)[_,](\d+)$"
    short = r"^[A-Za-z]+(\d)(\d)$"
    row = F.when(label.rlike(wide), F.regexp_extract(label, wide, 1)).when(
        label.rlike(short), F.regexp_extract(label, short, 1)
    )
    col = F.when(label.rlike(wide), F.regexp_extract(label, wide, 2)).when(
        label.rlike(short), F.regexp_extract(label, short, 2)
    )
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def largest_singular_2x2(m: Column) -> Column:
    """Largest singular value of a 2x2 matrix; the discriminant is a sum of
    squares, so near-unitary matrices lose no digits."""
    re = [m[i] for i in range(4)]
    im = [m[i + 4] for i in range(4)]
    sq = [r * r + i * i for r, i in zip(re, im)]
    total = sq[0] + sq[1] + sq[2] + sq[3]
    # conj(a)*b + conj(c)*d
    cross_re = re[0] * re[1] + im[0] * im[1] + re[2] * re[3] + im[2] * im[3]
    cross_im = re[0] * im[1] - im[0] * re[1] + re[2] * im[3] - im[2] * re[3]
    gap = sq[0] + sq[2] - sq[1] - sq[3]
    root = F.sqrt(gap * gap + F.lit(4.0) * (cross_re * cross_re + cross_im * cross_im))
    return F.sqrt((total + root) / F.lit(2.0))


def to_matrices(values: pd.Series) -> np.ndarray:
    """Stack a batch of equally sized arrays into complex (n, N, N)."""
    flat = np.stack(list(values)).astype(float)
    half = flat.shape[1] // 2
    ports = int(round(half**0.5))
    return (flat[:, :half] + 1j * flat[:, half:]).reshape(-1, ports, ports)


def from_matrices(stack: np.ndarray) -> list[np.ndarray]:
    flat = stack.reshape(len(stack), -1)
    return list(np.concatenate([flat.real, flat.imag], axis=1))


def by_size(values: pd.Series, work) -> pd.Series:
    """Apply ``work`` to the rows of each matrix size; NULL stays NULL."""
    if not len(values):
        return pd.Series([], dtype=object)
    if not values.isna().any() and values.map(len).nunique() == 1:
        return pd.Series(list(work(to_matrices(values))), index=values.index, dtype=object)
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    sizes = values.map(lambda v: None if v is None else len(v))
    for _size, rows in values.groupby(sizes):
        out.loc[rows.index] = pd.Series(list(work(to_matrices(rows))), index=rows.index, dtype=object)
    return out


@F.pandas_udf(DoubleType())
def largest_singular(m: pd.Series) -> pd.Series:
    return by_size(m, lambda s: np.linalg.svd(s, compute_uv=False)[:, 0]).astype(float)


CONDITIONING = StructType([StructField("condition", DoubleType()), StructField("smallest", DoubleType())])


@F.pandas_udf(CONDITIONING)
def identity_plus_conditioning(m: pd.Series) -> pd.DataFrame:
    """Condition number and smallest singular value of I + S."""

    def work(stack):
        sigma = np.linalg.svd(np.eye(stack.shape[1]) + stack, compute_uv=False)
        return np.column_stack([sigma[:, 0] / np.maximum(sigma[:, -1], np.finfo(float).tiny), sigma[:, -1]])

    done = by_size(m, work)
    return pd.DataFrame(
        {
            "condition": [np.nan if v is None else float(v[0]) for v in done],
            "smallest": [np.nan if v is None else float(v[1]) for v in done],
        }
    )


def _right_divide(rhs: np.ndarray, lhs: np.ndarray) -> np.ndarray:
    """rhs * inverse(lhs), least squares where lhs is singular."""
    try:
        return np.linalg.solve(lhs.swapaxes(1, 2), rhs.swapaxes(1, 2)).swapaxes(1, 2)
    except np.linalg.LinAlgError:
        return rhs @ np.linalg.pinv(lhs)


def s_to_y_stack(s: np.ndarray, z0: float) -> np.ndarray:
    unit = np.eye(s.shape[1])
    return _right_divide(unit - s, unit + s) / z0


def y_to_s_stack(y: np.ndarray, z0: float) -> np.ndarray:
    unit = np.eye(y.shape[1])
    return _right_divide(unit - z0 * y, unit + z0 * y)


def s_to_y(matrix: Column, z0: float = 50.0) -> Column:
    @F.pandas_udf("array<double>")
    def convert(m: pd.Series) -> pd.Series:
        return by_size(m, lambda s: from_matrices(s_to_y_stack(s, z0)))

    return convert(matrix)


def y_to_s(matrix: Column, z0: float = 50.0) -> Column:
    @F.pandas_udf("array<double>")
    def convert(m: pd.Series) -> pd.Series:
        return by_size(m, lambda y: from_matrices(y_to_s_stack(y, z0)))

    return convert(matrix)


def s_to_y_2x2(m: Column, z0: float = 50.0) -> Column:
    """Closed form of (I - S)(I + S)^-1 / z0 for two ports, JVM-side."""
    a, b, c, d = [(m[i], m[i + 4]) for i in range(4)]

    def mul(x, y):
        return x[0] * y[0] - x[1] * y[1], x[0] * y[1] + x[1] * y[0]

    def add(x, y):
        return x[0] + y[0], x[1] + y[1]

    def neg(x):
        return -x[0], -x[1]

    one = (F.lit(1.0), F.lit(0.0))
    bc = mul(b, c)
    det = add(mul(add(one, a), add(one, d)), neg(bc))
    scale = F.lit(z0) * (det[0] * det[0] + det[1] * det[1])
    tops = [
        add(mul(add(one, neg(a)), add(one, d)), bc),
        mul((F.lit(-2.0), F.lit(0.0)), b),
        mul((F.lit(-2.0), F.lit(0.0)), c),
        add(mul(add(one, a), add(one, neg(d))), bc),
    ]
    quotients = [
        ((t[0] * det[0] + t[1] * det[1]) / scale, (t[1] * det[0] - t[0] * det[1]) / scale) for t in tops
    ]
    return F.array(*[q[0] for q in quotients], *[q[1] for q in quotients])


def passivity(sigma: Column, tolerance: float = 1e-6) -> Column:
    """STRUCT<limit, passive, excess, margin_db>."""
    limit = F.lit(1.0 + tolerance)
    return F.struct(
        limit.alias("limit"),
        (sigma <= limit).alias("passive"),
        F.greatest(F.lit(0.0), sigma - limit).alias("excess"),
        (F.lit(-20.0) * F.log10(F.greatest(sigma, F.lit(TINY_SIGMA)))).alias("margin_db"),
    )


def assemble(cells: Column) -> Column:
    """Matrix array from ARRAY<STRUCT<row, col, re, im>> of one sample."""
    ordered = F.array_sort(cells)
    return F.concat(F.transform(ordered, lambda c: c["re"]), F.transform(ordered, lambda c: c["im"]))


def frequency_features(freq_hz: Column, transform: str = "log") -> list[Column]:
    logged = F.log10(F.greatest(freq_hz, F.lit(1.0)))
    if transform == "log":
        return [logged]
    if transform == "linear":
        return [freq_hz]
    if transform == "log-linear":
        return [logged, freq_hz]
    raise ValueError(f"unknown frequency transform {transform!r}")
