"""Trial tables: eligibility, ranking, progress, sweep diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered


def eligible(
    violations: Column,
    sigma: Column,
    require_passive: bool = False,
    max_violations: int | None = None,
    max_sigma: float | None = None,
) -> Column:
    """Acceptance by passivity; a missing figure fails a rule that needs it."""
    ok = F.lit(True)
    if require_passive:
        ok = ok & F.coalesce(violations == 0, F.lit(False))
    if max_violations is not None:
        ok = ok & F.coalesce(violations <= max_violations, F.lit(False))
    if max_sigma is not None:
        ok = ok & F.coalesce(sigma <= max_sigma, F.lit(False))
    return ok


def best_trials(trials: DataFrame, metric: str, accept: Column, by: Sequence[str] = (), trial: str = "trial") -> DataFrame:
    """Best eligible and best available trial, per group; grouped ``min_by``."""
    order = F.struct(F.col(metric), F.col(trial))
    usable = F.col(metric).isNotNull()
    return trials.groupBy(*by).agg(
        F.count("*").alias("trials"),
        F.count_if(accept & usable).alias("eligible"),
        F.min_by(trial, F.when(accept & usable, order)).alias("best_trial"),
        F.min(F.when(accept & usable, F.col(metric))).alias("best_metric"),
        F.min_by(trial, F.when(usable, order)).alias("best_available"),
    )


def rerank(trials: DataFrame, metric: str, accept: Column, by: Sequence[str] = (), trial: str = "trial", chunk: Column | None = None) -> DataFrame:
    """Rank: eligible first, then metric, then trial number.

    Chunks of the metric's magnitude keep a large group off a single task.
    """
    # NaN sorts behind every number, so it takes the last chunk, as NULL does.
    known = F.when(~F.isnan(F.col(metric)), F.col(metric))
    size = F.least(F.greatest(F.abs(known), F.lit(1e-300)), F.lit(1e300))
    level = F.floor(F.log2(size) * F.lit(64.0)).cast("long") + F.lit(80_000)
    signed = F.when(known == 0.0, F.lit(0)).when(known > 0.0, level).when(known < 0.0, -level)
    if chunk is None:
        chunk = F.col("__late") * F.lit(1_000_000) + F.coalesce(signed, F.lit(400_000))
    data = trials.withColumn("eligible", accept & known.isNotNull()).withColumn(
        "__late", F.when(F.col("eligible"), 0).otherwise(1)
    ).withColumn("__null", F.col(metric).isNull())
    return ordered.number_rows(data, list(by), ["__late", "__null", metric, trial], chunk, "rank").drop("__late", "__null")


def best_so_far(trials: DataFrame, metric: str, accept: Column, by: Sequence[str], order: str, chunk: Column | None = None) -> DataFrame:
    """Running minimum of the eligible metric and whether the trial promotes it."""
    chunk = ordered.index_chunk(F.col(order)) if chunk is None else chunk
    tagged = trials.withColumn("__m", F.when(accept, F.col(metric)))
    run = ordered.running_min(tagged, by, [order], chunk, "best_metric", F.col("__m"))
    prior = ordered.previous(run, by, [order], chunk, {"__before": "best_metric"})
    return prior.withColumn(
        "promoted", F.col("__m").isNotNull() & (F.col("__before").isNull() | (F.col("__m") < F.col("__before")))
    ).drop("__m", "__before")


def category_counts(trials: DataFrame, by: Sequence[str], category: str, order: str, chunk: Column | None = None) -> DataFrame:
    """How often the category was tried up to each trial."""
    chunk = ordered.index_chunk(F.col(order)) if chunk is None else chunk
    return ordered.number_rows(trials, [*by, category], [order], chunk, "category_count")


def improvement(rounds: DataFrame, by: Sequence[str], order: str, metric: str, chunk: Column | None = None) -> DataFrame:
    """(previous - current) / previous over rounds."""
    chunk = ordered.index_chunk(F.col(order)) if chunk is None else chunk
    out = ordered.previous(rounds, by, [order], chunk, {"previous": metric})
    return out.withColumn(
        "improvement", F.when(F.col("previous") > 0, (F.col("previous") - F.col(metric)) / F.col("previous"))
    )


def sweep_diagnostics(trials: DataFrame, settings: Sequence[str], metric: str, passive: Column) -> DataFrame:
    """Statistics per setting value, over passive trials and over all (``all_``)."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("setting"), F.col(s).cast("string").alias("value")) for s in settings]
    )
    rows = trials.select(F.explode(pairs).alias("s"), F.col(metric).alias("__m"), passive.alias("__p"))
    good = F.when(F.col("__p"), F.col("__m"))
    return rows.groupBy(F.col("s.setting").alias("setting"), F.col("s.value").alias("value")).agg(
        F.count(good).alias("trials"),
        F.avg(good).alias("mean"),
        F.min(good).alias("minimum"),
        F.max(good).alias("maximum"),
        F.count("__m").alias("all_trials"),
        F.avg("__m").alias("all_mean"),
        F.min("__m").alias("all_minimum"),
        F.max("__m").alias("all_maximum"),
    )


def progress(losses: DataFrame, by: Sequence[str], epoch: str, loss: str) -> DataFrame:
    """First, last and best loss of each run; the earliest epoch wins a tie."""
    return losses.groupBy(*by).agg(
        F.count("*").alias("epochs"),
        F.min_by(loss, epoch).alias("first_loss"),
        F.max_by(loss, epoch).alias("last_loss"),
        F.min(loss).alias("best_loss"),
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"),
    )


def first_n(rows: DataFrame, ordinal: str, count: int) -> DataFrame:
    """First rows of a product by ordinal (bounded top-k)."""
    return rows.orderBy(ordinal).limit(count)


def seeded_sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows without replacement, decided by a hash of seed and key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(count)


def worst_blocks(metrics: DataFrame, score: str, ties: Sequence[str], count: int) -> DataFrame:
    """Blocks with the largest score."""
    return metrics.orderBy(F.col(score).desc(), *ties).limit(count)
