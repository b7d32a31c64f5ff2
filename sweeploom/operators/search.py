"""Trial sweeps, each trial a fit on all rows, and adaptive choice of the next trial."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed, small_rows
from . import acquire

# A sweep is planned by hand or by budget; more trials than this are an error.
MOST_TRIALS = 10_000
TRIAL_NOISE = 1e-4
TRIAL_SCHEMA = (
    "trial int, trial_seed long, status int, metric double, violations long, max_sigma double, message string"
)


def valid_modes(candidates: DataFrame, has_coarse_model: bool) -> DataFrame:
    """Plain models take no coarse input, prior-input needs it, and both other
    modes need a coarse model."""
    mode, coarse = F.col("mode"), F.col("include_coarse_input")
    ok = F.when(mode == "plain", ~coarse).when(mode == "prior-input", coarse).otherwise(F.lit(True))
    return candidates.where(ok & (F.lit(has_coarse_model) | (mode == "plain")))


def run_trials(
    trials: DataFrame, fit: Callable[[dict, int, DataFrame], dict], data: DataFrame, seed: int = 1234, seed_mode: str = "fixed", most: int = MOST_TRIALS
) -> DataFrame:
    """Fit every candidate on all of ``data``, one after another; a failed trial is kept with status 2.

    ``fit(candidate, seed, data)`` runs its own jobs over the distributed rows and
    returns metric, violations and max_sigma; only those reach the driver.  A sweep
    is a budget of trials, so ``most`` bounds the plan, never the data.
    """
    spark = trials.sparkSession
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for row in small_rows(trials.select("trial", "candidate").orderBy("trial"), most, "sweep"):
        own_seed = int(seed + (row["trial"] if seed_mode == "indexed" else 0))
        try:
            got = fit(json.loads(row["candidate"]), own_seed, data)
            made = (0, float(got["metric"]), got.get("violations"), got.get("max_sigma"), None)
        except Exception as problem:  # a failed trial is a result
            made = (2, None, None, None, f"{type(problem).__name__}: {problem}"[:2_000])
        out.append((row["trial"], own_seed, *made))
    data.unpersist()
    return spark.createDataFrame(out, TRIAL_SCHEMA)


def ridge_fit(data: DataFrame, terms: Sequence[Column], target: Column, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights of a ridge regression from one row of sums over all rows, and the root mean square error."""
    n = len(terms)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = data.agg(
        *[F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(t * target).alias(f"b{i}") for i, t in enumerate(terms)]
    ).first()
    gram = np.zeros((n, n))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    weights = np.linalg.solve(gram + ridge * np.eye(n), np.array([sums[f"b{i}"] for i in range(n)]))
    error = sum((t * F.lit(float(w)) for t, w in zip(terms, weights)), -target)
    return weights, float(data.agg(F.sqrt(F.avg(error * error))).first()[0])


def features(candidates: DataFrame, numeric: Sequence[str], logged: Sequence[str], categories: dict[str, Sequence[str]]) -> DataFrame:
    """Add ``p``: numeric settings scaled to [0, 1] (log where named), categories one-hot."""
    spans = candidates.agg(
        *[F.min(_axis(n, logged)).alias(f"lo_{n}") for n in numeric], *[F.max(_axis(n, logged)).alias(f"hi_{n}") for n in numeric]
    ).first()
    parts = []
    for n in numeric:
        lo, hi = float(spans[f"lo_{n}"]), float(spans[f"hi_{n}"])
        parts.append((_axis(n, logged) - lo) / (hi - lo) if hi > lo else F.lit(0.5))
    for name, values in categories.items():
        parts += [F.when(F.col(name) == v, 1.0).otherwise(0.0) for v in values]
    return candidates.withColumn("p", F.array(*parts))


def _axis(name: str, logged: Sequence[str]) -> Column:
    return F.log(F.col(name).cast("double")) if name in logged else F.col(name).cast("double")


def objective(trials: DataFrame, accept: Column) -> DataFrame:
    """Feasible trials by metric; infeasible ones behind them by violation."""
    worst = trials.agg(F.max(F.when(accept, F.col("metric"))).alias("w")).first()["w"]
    base = 0.0 if worst is None else float(worst)
    burden = F.log1p(F.coalesce("violations", F.lit(0)).cast("double")) + F.greatest(
        F.lit(0.0), F.coalesce("max_sigma", F.lit(1.0)) - 1.0
    )
    return trials.withColumn("objective", F.when(accept, F.col("metric")).otherwise(F.lit(base) + burden + F.lit(1e-9)))


def next_trial(
    candidates: DataFrame,
    trials: DataFrame,
    categories: dict[str, Sequence[str]],
    accept: Column,
    initial: int = 6,
    exploration: float = 1.5,
    balance: float = 0.5,
    max_trials: int | None = None,
) -> dict:
    """Choose the next candidate.

    ``candidates``: id, p and category columns.  ``trials``: id, p, category
    columns, metric, violations, max_sigma.  Until enough trials ran, levels
    tried least come first, then the candidate furthest from all trials; later
    the lower confidence bound decides among the levels that the balance allows.
    """
    open_ = candidates.join(trials.select("id"), "id", "left_anti")
    done = trials.count()
    initial = max(initial, *[len(v) for v in categories.values()]) if categories else initial
    if max_trials is not None:
        initial = min(initial, max_trials)
    counts = {}
    for name, values in categories.items():
        seen = {r[name]: r["count"] for r in trials.groupBy(name).count().collect()}
        counts[name] = {v: int(seen.get(v, 0)) for v in values}
    existing = trials.select("id", "p")
    if done < initial:
        load = F.lit(0)
        unseen = F.lit(0)
        for name, tally in counts.items():
            low = min(tally.values())
            level = F.coalesce(F.try_element_at(F.create_map(*[x for v, n in tally.items() for x in (F.lit(v), F.lit(n))]), F.col(name)), F.lit(0))
            unseen = unseen + F.when(level == 0, 0).otherwise(1)
            load = load + (level - low)
        ranked = open_.withColumn("__u", unseen).withColumn("__l", load)
        best = ranked.agg(F.min(F.struct("__u", "__l")).alias("b")).first()["b"]
        pool = ranked.where((F.col("__u") == best["__u"]) & (F.col("__l") == best["__l"]))
        pick = acquire.greedy(pool, existing if done else None, ["coverage"])
        return {"id": pick[0]["id"], "stage": "initial_maximin", "predicted_objective": None}
    pool = open_
    for name, tally in counts.items():
        floor = balance * (done + 1) / len(tally)
        behind = [v for v, n in tally.items() if n < int(floor)]
        if behind:
            narrowed = pool.where(F.col(name).isin(*behind))
            pool = pool if narrowed.isEmpty() else narrowed
    # Trials of one point count as their mean, whose noise their number divides: the posterior is
    # the same, and the likelihood differs by a factor that the lengths do not change.
    judged_trials = checkpointed(objective(trials, accept).select("p", "objective"))
    facts = judged_trials.agg(F.avg("objective").alias("mean"), F.stddev_pop("objective").alias("std")).first()
    mean, spread = float(facts["mean"]), max(float(facts["std"]), 1e-12)
    # A trial without objective says nothing about its point.
    scored = checkpointed(judged_trials.where(F.col("objective").isNotNull()).groupBy("p").agg(F.avg("objective").alias("objective"), F.count("*").alias("n")))
    few = scored.count() <= acquire.DENSE_POINTS
    drawn = scored if few else scored.orderBy(F.xxhash64("p"), "p").limit(acquire.DENSE_POINTS)
    rows = drawn.orderBy("p").collect()  # at most DENSE_POINTS
    x = np.array([r["p"] for r in rows])
    y = np.array([r["objective"] for r in rows], dtype=float)
    repeats = np.array([r["n"] for r in rows])
    best_model = None
    for s in acquire.LENGTH_SCALES:
        model = acquire.build(x, (y - mean) / spread, mean, spread, np.full(x.shape[1], s), TRIAL_NOISE, repeats)
        if best_model is None or model.likelihood > best_model.likelihood:
            best_model = model
    if not few:
        observed = scored.select("p", ((F.col("objective") - mean) / spread).alias("t"), "n")
        best_model = acquire.LargeErrorModel(observed, mean, spread, best_model.scales, TRIAL_NOISE)
    # Candidates of one point have one bound, and the smallest id wins.
    judged = acquire.posterior(pool.groupBy("p").agg(F.min("id").alias("id")), best_model)
    row = (
        judged.withColumn("bound", F.col("log_mean") - F.lit(exploration) * F.col("log_std"))
        .orderBy("bound", "id")
        .limit(1)
        .first()
    )
    return {"id": row["id"], "stage": "gp_lcb", "predicted_objective": row["log_mean"]}
