"""Choosing additional points end to end: error regions in, suggested points out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.units import to_unit
from ..operators import acquire, designs, inventory, metrics
from ..session import checkpointed

# Size of the candidate pool.
POOL_FACTOR, POOL_MINIMUM = 200, 1000


def candidate_table(spark, domain: Sequence[dict], count: int, places: int, occupied: DataFrame | None, method: str = "halton", seed: int = 0) -> DataFrame:
    """``id, p`` and values of unique, unoccupied points on the output grid."""
    pool = max(POOL_MINIMUM, POOL_FACTOR * count)
    names = [d["name"] for d in domain]
    points = designs.on_grid(designs.unit_points(spark, method, pool, len(domain), seed), domain, places)
    free = inventory.keep_first(points.select("row", *names), names, "row")
    if occupied is not None:
        free = inventory.unoccupied(free, occupied, names, "row")
    coords = [
        to_unit(F.col(d["name"]), F.lit(float(d["lower"])), F.lit(float(d["upper"])), F.lit(d.get("scale", "linear")))
        for d in domain
    ]
    return free.select(F.col("row").alias("id"), F.array(*coords).alias("p"), *names)


def growth_plan(regions: DataFrame, existing: DataFrame, wanted: int, dimensions: int, enabled: bool = True) -> dict:
    """How many verification points the milestones of the training inventory ask for."""
    training, observed = existing.where("dataset = 'train'").count(), regions.count()
    plan = acquire.verification_growth(F.lit(training), F.lit(observed), F.lit(wanted), dimensions, enabled)
    return regions.sparkSession.range(1).select(plan.alias("p")).first()["p"].asDict()


def suggest(
    regions: DataFrame,
    existing: DataFrame,
    domain: Sequence[dict],
    places: int,
    target: float | None = None,
    method: str = "hybrid",
    count: int | None = None,
    previous: DataFrame | None = None,
    grow: bool = True,
) -> DataFrame:
    """Suggested points with values and provenance.

    ``regions``: source_index, one unit coordinate per parameter name, score.
    ``existing``: one value column per parameter and ``dataset``.  ``previous``:
    regions of the round before, whose error tells how the last points helped.
    With ``grow`` the verification points that the milestones ask for follow the
    training points; they are chosen by coverage.  Every point bears the nearest
    error region, its score and its distance.
    """
    spark = regions.sparkSession
    names = [d["name"] for d in domain]
    dims = len(names)
    training = existing.where("dataset = 'train'").count()
    before = metrics.region_summary(previous).first() if previous is not None else None
    earlier = F.lit(before["rms"]) if before is not None else None
    advice = acquire.recommend(metrics.region_summary(regions), dims, F.lit(training), target, earlier)
    weighted = advice.withColumn("exploration", acquire.exploration_weight(F.col("stage"), F.col("regions"), dims)).first()
    wanted = weighted["recommended_count"] if count is None else count
    added = growth_plan(regions, existing, wanted, dims, grow)["additional_verification_count"]
    candidates = candidate_table(spark, domain, max(wanted + added, 1), places, existing.select(*names))
    coords = [
        to_unit(F.col(d["name"]), F.lit(float(d["lower"])), F.lit(float(d["upper"])), F.lit(d.get("scale", "linear")))
        for d in domain
    ]
    old = existing.select(F.xxhash64(*names).alias("id"), F.array(*coords).alias("p"))
    numbered = regions.withColumn("id", F.xxhash64("source_index"))
    model = None
    table, focus = candidates, None
    if method == "error-distance":
        table = acquire.focus(candidates, numbered, names)
        steps, focus = ["error-distance"] * wanted, "focus"
    else:
        model = acquire.fit_error_model(regions, names)
        if method == "hybrid":
            regime = acquire.hybrid_regime(dims, weighted["regions"], weighted["target_ratio"], weighted["latest_improvement_fraction"])
            steps = acquire.hybrid_schedule(acquire.hybrid_allocation(wanted, regime))
        else:
            steps = ["gp-ucb"] * wanted
    chosen = acquire.greedy(table, old, [*steps, *["coverage"] * added], model, focus, exploration=weighted["exploration"])
    picked = checkpointed(acquire.suggested(spark, chosen, method))
    near = acquire.nearest_region(picked.select(F.col("candidate_id").alias("id"), F.col("unit_point").alias("p")), numbered, names)
    met = near.join(numbered.select(F.col("id").alias("neighbour"), "source_index", "score"), "neighbour").select(
        F.col("id").alias("candidate_id"), F.col("source_index").alias("nearest_error_source_index"),
        F.col("score").alias("fit_error_score"), F.col("distance").alias("nearest_error_distance"),
    )
    sequence = F.col("additional_sequence")
    out = picked.join(met, "candidate_id", "left").join(candidates.select(F.col("id").alias("candidate_id"), *names), "candidate_id")
    return out.select(
        sequence.alias("point_index"), F.when(sequence <= wanted, "train").otherwise("verification").alias("dataset"),
        F.lit("additional").alias("point_origin"), F.lit(f"{'targeted' if method == 'error-distance' else method}-halton").alias("method"),
        *[c for c in picked.columns if c != "candidate_id"], "candidate_id",
        "fit_error_score", "nearest_error_source_index", "nearest_error_distance", *names,
    )
