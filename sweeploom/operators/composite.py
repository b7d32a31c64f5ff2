"""Models of rational coefficients, from the parameters to the response of the device.

A network gives the coefficients of all labels in conditioned coordinates; a
decoder brings them back, fixed poles turn them into a response, and a coarse
response may be added.  One pass over Arrow batches does all of it and the
largest singular value of the sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import metrics
from .dense import DenseModel, project_outputs
from .rational import basis

# A coarse response counts as reciprocal up to this difference.
EXACTLY_RECIPROCAL = 1e-12


@dataclass
class CoefficientModel:
    """``network`` gives real parts of all labels (label by label, term by term), then imaginary parts."""

    network: DenseModel
    poles: np.ndarray
    scale: float
    decoder: np.ndarray
    ports: int
    response_scale: float = 1.0

    def respond(self, x: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Matrices, one per row of parameters and frequency."""
        flat = self.network.predict(x)
        half, terms = flat.shape[1] // 2, len(self.poles) + 1
        coordinates = (flat[:, :half] + 1j * flat[:, half:]).reshape(len(x), -1, terms)
        values = np.einsum("nlt,nt->nl", coordinates @ self.decoder, basis(freq, self.poles, self.scale))
        return values.reshape(len(x), self.ports, self.ports)


def coefficient_reciprocity(ports: int, terms: int) -> np.ndarray:
    """Averages the coefficients of Sij with those of Sji in the network's outputs."""
    n2 = ports * ports
    swap = np.eye(n2)[[(k % ports) * ports + k // ports for k in range(n2)]]
    return np.kron(np.eye(2), np.kron(0.5 * (np.eye(n2) + swap), np.eye(terms)))


def largest_asymmetry(rows: DataFrame, ports: int, re: str, im: str) -> float | None:
    """Largest |Sij - Sji| of flattened matrices; None without rows, 0 for one port."""
    found = F.lit(0.0)
    for i in range(ports):
        for j in range(i):
            a, b = i * ports + j, j * ports + i
            found = F.greatest(found, F.hypot(F.get(re, F.lit(a)) - F.get(re, F.lit(b)), F.get(im, F.lit(a)) - F.get(im, F.lit(b))))
    return rows.agg(F.max(found).alias("m")).first()["m"]


def reciprocity_wanted(mode: str, measured: bool, residual: bool, coarse_asymmetry: float | None) -> bool:
    """Whether the outputs are made reciprocal.

    ``auto`` follows the measured data, ``enforce`` and ``off`` decide by
    themselves.  A residual over a coarse response stays reciprocal only if the
    coarse response is; ``enforce`` is an error otherwise.
    """
    if mode not in ("auto", "enforce", "off"):
        raise ValueError(f"unknown reciprocity mode {mode!r}")
    asked = mode == "enforce" or (mode == "auto" and measured)
    if not asked or not residual or (coarse_asymmetry is not None and coarse_asymmetry <= EXACTLY_RECIPROCAL):
        return asked
    if mode == "enforce":
        raise ValueError("the coarse response is not reciprocal, so its sum with the residual cannot be")
    return False


def enforce_reciprocity(model: CoefficientModel) -> CoefficientModel:
    """Fold the average of Sij and Sji into the last layer of the network."""
    project_outputs(model.network, coefficient_reciprocity(model.ports, len(model.poles) + 1))
    return model


def responses(rows: DataFrame, model: CoefficientModel, x: str = "x", axis: str = "freq_hz", coarse: tuple[str, str] | None = None) -> DataFrame:
    """Add ``fit_re``, ``fit_im`` (flattened matrices) and ``sigma`` of the whole response."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.network.x_mean)

    @F.pandas_udf("fit_re array<double>, fit_im array<double>, sigma double")
    def respond(*columns: pd.Series) -> pd.DataFrame:
        if not len(columns[0]):
            return pd.DataFrame({"fit_re": [], "fit_im": [], "sigma": []})
        m = shared.value
        made = m.respond(np.column_stack([c.to_numpy(dtype=float) for c in columns[:width]]), columns[width].to_numpy(dtype=float))
        if coarse:
            re, im = (np.stack(c.to_numpy()).astype(float) for c in columns[width + 1 :])
            made = made + (re + 1j * im).reshape(made.shape)
        made = made * m.response_scale
        sigma = np.linalg.svd(made, compute_uv=False)[:, 0]
        flat = made.reshape(len(made), -1)
        return pd.DataFrame({"fit_re": list(flat.real), "fit_im": list(flat.imag), "sigma": sigma})

    inputs = [F.get(x, F.lit(k)).cast("double") for k in range(width)]
    out = rows.withColumn("__r", respond(*inputs, F.col(axis), *[F.col(c) for c in coarse or ()]))
    return out.select(*rows.columns, "__r.*")


def score(rows: DataFrame, by: list[str], re: str = "re", im: str = "im", tolerance: float = 1e-6, weight: Column | None = None) -> DataFrame:
    """Error metrics of all matrix entries per group, and the passivity of the whole response."""
    entries = rows.select(*by, F.explode(F.arrays_zip(F.col(re).alias("a"), F.col(im).alias("b"), F.col("fit_re").alias("c"), F.col("fit_im").alias("d"))).alias("e"))
    errors = metrics.verification_metrics(entries.select(*by, "e.*"), by, ["a", "b"], ["c", "d"], weight)
    passive = rows.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if(F.col("sigma") > 1.0 + tolerance).alias("nonpassive"), F.max("sigma").alias("max_sigma")
    )
    return errors.join(passive, by) if by else errors.crossJoin(F.broadcast(passive))  # one row each
