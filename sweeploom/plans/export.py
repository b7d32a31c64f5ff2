"""Sampled-grid export: parameter grid times frequencies, scored and ready to write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.complexmath import frequency_features
from ..operators import align, dense


def sampled_grid(
    parameters: DataFrame, freqs: DataFrame, names: Sequence[str], model, labels: Sequence[str], transform: str = "log", dc: DataFrame | None = None
) -> DataFrame:
    """Predicted response on every grid point; a zero-Hz row is always there.

    ``parameters``: record_id and one column per name.  ``freqs``: freq_hz.
    The product is the size of the result; ``freqs`` is the small side.
    """
    zero = parameters.sparkSession.range(1).select(F.lit(0.0).alias("freq_hz"))
    axis = freqs.select("freq_hz").unionByName(zero).distinct()
    grid = parameters.crossJoin(axis)
    x = F.array(*[F.col(n) for n in names], *frequency_features(F.col("freq_hz"), transform))
    scored = dense.predict(grid.withColumn("x", x), model)
    half = len(labels)
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.get("prediction", F.lit(k)).alias("re"), F.get("prediction", F.lit(k + half)).alias("im"))
            for k, label in enumerate(labels)
        ]
    )
    long = scored.select("record_id", *names, "freq_hz", F.explode(cells).alias("c")).select("record_id", *names, "freq_hz", "c.*")
    return long if dc is None else align.with_dc(long, dc, ["record_id"], "freq_hz", ["re", "im"])
