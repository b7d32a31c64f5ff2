"""Designs, alignment, fits, scoring and acquisition over the tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F


from ...operators import acquire, align, composite, dense, designs, metrics, ordered, quality, rational, search
from ...session import checkpointed
from ..export import sampled_grid
from ..extend import extended_inventory, fitting_places
from ..suggest import suggest
from .base import RESPONSE_SQL, SAMPLES_SQL, SIGMA_SQL, query, r, response, samples, table, two_port
from .inventories import ERROR_REGION_SQL, _regions

# --- designs ---------------------------------------------------------------------

RADICAL_SQL = """
RECURSIVE h AS (
  SELECT o_orderkey, b, o_orderkey + 1 AS rest, 1.0::DOUBLE / b AS f, 0.0::DOUBLE AS v FROM orders, (VALUES (2), (3), (5)) AS t(b)
  UNION ALL SELECT o_orderkey, b, rest // b, f / b, v + (rest % b) * f FROM h WHERE rest > 0)"""


@query(
    "halton_design",
    f"WITH {RADICAL_SQL} SELECT o_orderkey, round(max(v) FILTER (b = 2), 9) AS u0, round(max(v) FILTER (b = 3), 9) AS u1, round(max(v) FILTER (b = 5), 9) AS u2 FROM h GROUP BY o_orderkey",
)
def halton_design(spark, folder):
    """A point per order, numbered by its key."""
    o = table(spark, folder, "orders").select("o_orderkey")
    out = designs.halton(o, "o_orderkey", 3)
    return out.select("o_orderkey", *[r(f"u{d}", 9).alias(f"u{d}") for d in range(3)])


@query(
    "sobol_strata",
    """WITH RECURSIVE a AS (SELECT 0 AS axis UNION ALL SELECT axis + 1 FROM a WHERE axis < 39), n AS (SELECT count(DISTINCT p_partkey) AS n FROM part)
    SELECT axis, CAST(power(2, floor(log2(n))) AS BIGINT) AS points, CAST(power(2, floor(log2(n))) AS BIGINT) AS cells FROM a, n""",
)
def sobol_strata(spark, folder):
    """Of the first 2^k parts every interval of length 2^-k holds one point, on each of 40 axes."""
    axes = 40
    keys = table(spark, folder, "part").select("p_partkey").distinct()
    numbered = ordered.global_index(keys, ["p_partkey"], ordered.index_chunk(F.col("p_partkey")), "n")
    numbered = numbered.withColumn("i", F.col("n") - 1)
    size = numbered.agg(F.pow(F.lit(2), F.floor(F.log2(F.count("*")))).cast("long").alias("size"))
    # A few bytes a row here are forty rows below; a counted repartition is not merged for being small.
    dealt = numbered.join(F.broadcast(size), F.col("i") < F.col("size")).repartition(4 * spark.sparkContext.defaultParallelism, "i")
    points = designs.sobol(dealt, "i", axes)
    cells = F.array(*[F.floor(F.col(f"u{d}") * F.col("size")) for d in range(axes)])
    spread = points.select("size", F.posexplode(cells).alias("axis", "cell"))
    return spread.groupBy("axis").agg(F.count("*").alias("points"), F.count_distinct("cell").alias("cells"))


@query("sobol_design")
def sobol_design(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey")
    return designs.sobol(o, "o_orderkey", 4)


@query(
    "latin_hypercube_strata",
    "SELECT count(*) AS points, count(*) AS strata_0, count(*) AS strata_1 FROM orders",
)
def latin_hypercube_strata(spark, folder):
    """Every stratum of both axes is hit exactly once."""
    o = table(spark, folder, "orders").select("o_orderkey")
    n = o.count()
    lhs = designs.latin_hypercube(o, "o_orderkey", n, 2, seed=5)
    return lhs.agg(
        F.count("*").alias("points"),
        F.count_distinct(F.floor(F.col("u0") * n)).alias("strata_0"),
        F.count_distinct(F.floor(F.col("u1") * n)).alias("strata_1"),
    )


@query("maximin_design")
def maximin_design(spark, folder):
    """The best of several designs with one point per supplier."""
    s = table(spark, folder, "supplier").select("s_suppkey")
    return designs.maximin_latin_hypercube(s, "s_suppkey", s.count(), 2, seed=3)


@query(
    "unique_design_points",
    "SELECT count(*) AS points, count(*) AS distinct_points FROM supplier",
)
def unique_design_points(spark, folder):
    """As many distinct rounded points as suppliers, none of them occupied."""
    n = table(spark, folder, "supplier").count()
    domain = [{"name": "w", "lower": 0.0, "upper": 0.05, "unit_scale": 1e-3}, {"name": "l", "lower": 1.0, "upper": 100.0, "scale": "log"}]
    taken = spark.createDataFrame([(0.0, 1.0)], "w double, l double")
    out = designs.unique_points(spark, "halton", n, domain, 1, occupied=taken)
    return out.agg(F.count("*").alias("points"), F.count_distinct("w", "l").alias("distinct_points"))


@query(
    "parameter_frequency_product",
    "SELECT p_brand, t.f AS freq_hz, count(*) AS parts FROM part, (SELECT DISTINCT l_linenumber * 1e9 AS f FROM lineitem) t GROUP BY ALL",
)
def parameter_frequency_product(spark, folder):
    freqs = table(spark, folder, "lineitem").select((F.col("l_linenumber") * F.lit(1e9)).alias("freq_hz")).distinct()
    brands = table(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    return designs.product(brands, freqs)


@query("candidate_pool")
def candidate_pool(spark, folder):
    """Distinct trial candidates over ranges and categories, four per supplier."""
    n = 4 * table(spark, folder, "supplier").count()
    ranges = [{"name": "learning_rate", "lower": 1e-4, "upper": 1e-2, "scale": "log"}, {"name": "batch_size", "lower": 16, "upper": 512, "integer": True}]
    return designs.candidate_pool(spark, n, ranges, {"activation": ["tanh", "relu"]}, seed=19)


# --- alignment ---------------------------------------------------------------------


@query(
    "matched_occurrences",
    """WITH f AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0),
    c AS (SELECT o_orderkey AS coarse_id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
    SELECT f.o_orderkey, c.coarse_id FROM f LEFT JOIN c USING (o_custkey, n)""",
)
def matched_occurrences(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("w"))
    out = align.match_occurrences(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["w"], "o_orderkey", "o_orderkey")
    return out.select("o_orderkey", "coarse_id")


@query(
    "interpolated_values",
    """WITH c AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value FROM events WHERE event_id % 2 = 0), s AS (SELECT user_id, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    f AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events), j AS (SELECT f.event_id, f.t, s.t AS t1, s.value AS v1, s.t2, s.v2 FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.t >= s.t)
    SELECT event_id, t1 IS NOT NULL AND (t = t1 OR t2 IS NOT NULL) AS covered, CASE WHEN t = t1 THEN round(v1, 4) WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN round(v1 + (v2 - v1) * (t - t1) / (t2 - t1), 4) END AS coarse_value FROM j""",
)
def interpolated_values(spark, folder):
    """Values of every second event interpolated at the time of all events."""
    e = table(spark, folder, "events").select(
        "event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value"
    )
    out = align.interpolate(
        e.where("event_id % 2 = 0"), e.select("event_id", "user_id", "t"), ["user_id"], "t", ["value"], ordered.value_chunk(F.col("t"), 86400.0), ["event_id"]
    )
    return out.select("event_id", "covered", F.when(F.col("covered"), r("coarse_value", 4)).alias("coarse_value"))


@query(
    "zero_frequency_values",
    f"""WITH {RESPONSE_SQL}, d AS (SELECT record_id, label, avg(re) AS dre FROM response WHERE freq_idx > 0 GROUP BY ALL)
    SELECT record_id, freq_idx, r.label, round(CASE WHEN freq_hz = 0 THEN coalesce(dre, re) ELSE re END, 6) AS re FROM response r LEFT JOIN d USING (record_id, label)""",
)
def zero_frequency_values(spark, folder):
    """Zero-frequency rows take the block's DC prediction."""
    resp = response(spark, folder)
    dc = align.positive_rows(resp).groupBy("record_id", "label").agg(F.avg("re").alias("re"))
    out = align.with_dc(resp, dc, ["record_id"], "freq_hz", ["re"])
    return out.select("record_id", "freq_idx", "label", r("re").alias("re"))


@query(
    "usable_dc_matrices",
    f"WITH {SIGMA_SQL} SELECT record_id, round(avg(ar), 6) AS s11, round(avg(br), 6) AS s12, count(*) AS dc_rows FROM sigma JOIN m USING (record_id, freq_idx) WHERE sigma.freq_hz = 0 AND s <= 1 + 1e-6 GROUP BY record_id",
)
def usable_dc_matrices(spark, folder):
    rows = quality.passivity_rows(two_port(spark, folder), two_port=True)
    dc = align.dc_matrices(align.usable_dc(rows), ["record_id"])
    return dc.select("record_id", r(F.col("dc_matrix")[0]).alias("s11"), r(F.col("dc_matrix")[1]).alias("s12"), "dc_rows")


@query(
    "fit_features",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, round(log10(greatest((l_linenumber - 1) * 1e9, 1.0)), 9) AS x1, round(l_extendedprice - l_quantity * 1000, 4) AS y0 FROM samples WHERE l_linenumber > 1""",
)
def fit_features(spark, folder):
    s = samples(spark, folder).select(
        "l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) * F.lit(1e9)).alias("f"), "l_discount", "l_extendedprice", (F.col("l_quantity") * 1000).alias("coarse")
    )
    out = align.features(s, ["l_discount"], "f", ["l_extendedprice"], ["coarse"], residual=True, keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r(F.col("x")[1], 9).alias("x1"), r(F.col("y")[0], 4).alias("y0"))


@query(
    "column_scalers",
    """WITH s AS (SELECT stddev_pop(l_quantity) AS q, stddev_pop(l_tax) AS t, avg(l_quantity) AS mq, avg(l_tax) AS mt FROM lineitem), f AS (SELECT *, (q + t) / 2 AS fl FROM s)
    SELECT 'quantity' AS "column", round(mq, 6) AS mean, round(q, 6) AS std, FALSE AS floored FROM f UNION ALL SELECT 'tax', round(mt, 6), round(t, 6), FALSE FROM f UNION ALL SELECT 'flat', 7.0::DOUBLE, round(fl, 6), TRUE FROM f""",
)
def column_scalers(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.lit(7.0).alias("flat"))
    out = align.standardizer(rows, ["quantity", "tax", "flat"])
    return out.select("column", r("mean").alias("mean"), r("std").alias("std"), "floored")


@query(
    "common_scaler",
    """SELECT c AS "column", round(m, 6) AS mean, round(s, 6) AS std FROM (SELECT 'quantity' AS c, avg(l_quantity) AS m, sqrt((var_pop(l_quantity) + var_pop(l_tax)) / 2) AS s FROM lineitem UNION ALL SELECT 'tax', avg(l_tax), sqrt((var_pop(l_quantity) + var_pop(l_tax)) / 2) FROM lineitem)""",
)
def common_scaler(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return align.common_rms_scale(rows, ["quantity", "tax"]).select("column", r("mean").alias("mean"), r("std").alias("std"))


@query(
    "value_statistics",
    """SELECT c_mktsegment, count(*) AS finite_values, round(min(c_acctbal), 6) AS minimum, round(max(c_acctbal), 6) AS maximum, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std, round(sqrt(avg(c_acctbal * c_acctbal)), 6) AS rms, round(quantile_cont(c_acctbal, 0.5), 6) AS median FROM customer GROUP BY c_mktsegment""",
)
def value_statistics(spark, folder):
    out = align.value_stats(table(spark, folder, "customer"), F.col("c_acctbal"), ["c_mktsegment"])
    return out.select("c_mktsegment", "finite_values", *[r(c).alias(c) for c in ("minimum", "maximum", "mean", "std", "rms", "median")])


@query(
    "blank_template",
    f"WITH {SAMPLES_SQL} SELECT o.k AS record_id, f.f AS freq_hz, l.label, 0.0::DOUBLE AS re, 0.0::DOUBLE AS im FROM (SELECT DISTINCT l_orderkey AS k FROM samples) o, (SELECT DISTINCT l_linenumber * 1e9 AS f FROM lineitem) f, (VALUES ('S11'), ('S21')) AS l(label)",
)
def blank_template(spark, folder):
    lines = table(spark, folder, "lineitem")
    block = lines.select(F.col("l_orderkey").alias("record_id")).distinct()
    freqs = lines.select((F.col("l_linenumber") * F.lit(1e9)).alias("freq_hz")).distinct()
    return align.blank_template(block, freqs, spark.createDataFrame([("S11",), ("S21",)], "label string"))


# --- rational fits -------------------------------------------------------------------


def _sweeps(spark, folder):
    """Orders as sweeps: price over line number, damped by tax in the imaginary part."""
    s = samples(spark, folder)
    # A fit reads them for the band, the longest sweep and the triangles; stored, they are drawn once.
    return checkpointed(s.select(
        F.col("l_orderkey").alias("record_id"),
        F.lit("S11").alias("label"),
        (F.col("l_linenumber") * F.lit(1e9)).alias("freq_hz"),
        (F.col("l_extendedprice") / 1e5).alias("re"),
        F.col("l_tax").alias("im"),
    ))


@query(
    "fixed_poles",
    """WITH b AS (SELECT min(l_linenumber) * 1e9 AS lo, max(l_linenumber) * 1e9 AS hi FROM lineitem), s AS (SELECT sqrt(lo * hi) AS sc, lo / sqrt(lo * hi) AS x1, hi / sqrt(lo * hi) AS x2 FROM b)
    SELECT k, round(-0.05 * x1 * 0.75 * power(x2 * 1.25 / (x1 * 0.75), k), 9) AS re, round(x1 * 0.75 * power(x2 * 1.25 / (x1 * 0.75), k), 9) AS im, round(sc, 3) AS scale FROM s, (VALUES (0), (1)) AS t(k)""",
)
def fixed_poles(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_linenumber") * F.lit(1e9)).alias("freq_hz"))
    poles, scale = rational.fixed_poles(*rational.band(rows), 4, 0.05)
    shown = [(k, float(poles[2 * k].real), float(poles[2 * k].imag), scale) for k in range(2)]
    return spark.createDataFrame(shown, "k int, re double, im double, scale double").select("k", r("re", 9).alias("re"), r("im", 9).alias("im"), r("scale", 3).alias("scale"))


@query(
    "single_pole_fits",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT sqrt(min(l_linenumber) * max(l_linenumber)) * 1e9 AS sc, sqrt((min(l_linenumber) * 1e9 / (sqrt(min(l_linenumber) * max(l_linenumber)) * 1e9)) * (max(l_linenumber) * 1e9 / (sqrt(min(l_linenumber) * max(l_linenumber)) * 1e9))) AS p FROM lineitem),
    b AS (SELECT l_orderkey AS k, l_extendedprice / 1e5 AS yr, l_tax AS yi, p / (p * p + power(l_linenumber * 1e9 / sc, 2)) AS br, -(l_linenumber * 1e9 / sc) / (p * p + power(l_linenumber * 1e9 / sc, 2)) AS bi FROM samples, c),
    n AS (SELECT k, count(*) + 0.01 AS a, sum(br) AS b, sum(bi) AS bb, sum(br * br + bi * bi) + 0.01 AS d, sum(yr) AS r0, sum(yi) AS i0, sum(br * yr + bi * yi) AS r1, sum(br * yi - bi * yr) AS i1 FROM b GROUP BY k)
    SELECT k AS record_id, round((d * r0 - (b * r1 - bb * i1)) / (a * d - b * b - bb * bb), 6) AS c0_re, round((a * r1 - (b * r0 + bb * i0)) / (a * d - b * b - bb * bb), 6) AS c1_re FROM n""",
)
def single_pole_fits(spark, folder):
    """Ridge fit of one real pole per sweep against the normal equations."""
    s = _sweeps(spark, folder)
    poles, scale = rational.fixed_poles(*rational.band(s), 1, 0.05)
    c = rational.fit(s, ["record_id"], poles, scale, ridge=0.01)
    return c.select("record_id", r(F.col("coef_re")[0]).alias("c0_re"), r(F.col("coef_re")[1]).alias("c1_re"))


@query("rational_stage")
def rational_stage(spark, folder):
    """Four-pole fits evaluated on their own grid: error of the rational stage."""
    s = _sweeps(spark, folder)
    poles, scale = rational.fixed_poles(*rational.band(s), 4, 0.05)
    c = rational.fit(s, ["record_id", "label"], poles, scale, ridge=1e-6)
    scored = rational.evaluate(s, c, ["record_id", "label"], poles, scale)
    return metrics.verification_metrics(scored, ["label"], ["re", "im"], ["fit_re", "fit_im"])


def _fixed_coefficients():
    """A linear network of fixed weights over two parameters, one real pole, two ports."""
    k, i = np.meshgrid(np.arange(16), np.arange(2))
    weights = ((7 * i + 3 * k) % 11 - 5) / 40.0
    bias = ((5 * np.arange(16)) % 7 - 3) / 60.0
    network = dense.DenseModel([weights], [bias], "tanh", np.zeros(2), np.ones(2), np.zeros(16), np.ones(16))
    return composite.CoefficientModel(network, np.array([-0.5 + 0j]), 3e9, np.array([[1.0, 0.0], [0.25, 0.5]], complex), 2)


def _composite_sql() -> str:
    """The same model term by term: coefficients, decoder, pole, coarse response, singular value."""
    model = composite.enforce_reciprocity(_fixed_coefficients())
    w, b = model.network.weights[0], model.network.biases[0]
    linear = lambda k: f"(l_quantity / 48.0 * {float(w[0, k])!r}::DOUBLE + l_discount * 10 * {float(w[1, k])!r}::DOUBLE + {float(b[k])!r}::DOUBLE)"
    parts = []
    for n, label in enumerate(("a", "b", "c", "d")):
        (r0, r1), (i0, i1) = ([linear(h + 2 * n + t) for t in (0, 1)] for h in (0, 8))
        # The decoder: first coefficient p + q / 4, second q / 2.
        c = [f"({r0} + 0.25 * {r1})", f"(0.5 * {r1})", f"({i0} + 0.25 * {i1})", f"(0.5 * {i1})"]
        coarse = "l_tax" if label in "ad" else "0.5 * l_tax"
        parts.append(f"{c[0]} + {c[1]} * gr - {c[3]} * gi + {coarse} AS {label}r, {c[2]} + {c[1]} * gi + {c[3]} * gr AS {label}i")
    return f"""{SAMPLES_SQL},
    g AS (SELECT *, (l_linenumber - 1) / 3.0::DOUBLE AS f FROM samples),
    h AS (SELECT *, 0.5 / (0.25 + f * f) AS gr, -f / (0.25 + f * f) AS gi FROM g),
    fitted AS (SELECT l_discount AS t11, l_tax AS u11, l_quantity / 48.0 AS t12, l_tax AS u12, l_quantity / 49.0 AS t21, l_discount AS u21, l_tax AS t22, l_discount AS u22, {', '.join(parts)} FROM h),
    errors AS (SELECT unnest([power(ar - t11, 2) + power(ai - u11, 2), power(br - t12, 2) + power(bi - u12, 2), power(cr - t21, 2) + power(ci - u21, 2), power(dr - t22, 2) + power(di - u22, 2)]) AS e FROM fitted),
    sigma AS (SELECT sqrt((ar*ar+ai*ai+br*br+bi*bi+cr*cr+ci*ci+dr*dr+di*di + sqrt(power(ar*ar+ai*ai+cr*cr+ci*ci-br*br-bi*bi-dr*dr-di*di, 2)
      + 4 * (power(ar*br+ai*bi+cr*dr+ci*di, 2) + power(ar*bi-ai*br+cr*di-ci*dr, 2)))) / 2) AS s, hypot_(br - cr, bi - ci) AS asymmetry FROM fitted)""".replace("hypot_(br - cr, bi - ci)", "sqrt(power(br - cr, 2) + power(bi - ci, 2))")


@query(
    "composite_scores",
    f"""WITH {_composite_sql()} SELECT (SELECT count(*) FROM errors) AS rows, (SELECT round(sqrt(avg(e)), 9) FROM errors) AS rmse_abs, (SELECT round(sqrt(max(e)), 9) FROM errors) AS max_abs,
    (SELECT count(*) FROM sigma WHERE s > 1 + 1e-6) AS nonpassive, (SELECT round(max(s), 9) FROM sigma) AS max_sigma, (SELECT max(asymmetry) <= 1e-9 FROM sigma) AS reciprocal""",
)
def composite_scores(spark, folder):
    """A coefficient network with fixed weights over a coarse response, scored end to end."""
    model = _fixed_coefficients()
    rows = two_port(
        spark, folder,
        F.array(F.col("l_quantity") / 48.0, F.col("l_discount") * 10).alias("x"),
        F.array(F.col("l_tax"), 0.5 * F.col("l_tax"), 0.5 * F.col("l_tax"), F.col("l_tax")).alias("coarse_re"),
    ).withColumn("coarse_im", F.array(*[F.lit(0.0)] * 4))
    rows = rows.withColumns({"re": F.slice("matrix", 1, 4), "im": F.slice("matrix", 5, 4)})
    if composite.reciprocity_wanted("enforce", False, True, composite.largest_asymmetry(rows, 2, "coarse_re", "coarse_im")):
        composite.enforce_reciprocity(model)
    fitted = composite.responses(rows, model, coarse=("coarse_re", "coarse_im"))
    out = composite.score(fitted, [])
    even = composite.largest_asymmetry(fitted, 2, "fit_re", "fit_im")
    return out.select(
        "rows", r("rmse_abs", 9).alias("rmse_abs"), r("max_abs", 9).alias("max_abs"), "nonpassive", r("max_sigma", 9).alias("max_sigma"),
        F.lit(even is not None and even <= 1e-9).alias("reciprocal"),
    )


@query("flattened_coefficients")
def flattened_coefficients(spark, folder):
    """Coefficient rows, flattened per block and restored."""
    s = _sweeps(spark, folder)
    poles, scale = rational.fixed_poles(*rational.band(s), 2, 0.05)
    c = rational.fit(s, ["record_id", "label"], poles, scale, ridge=1e-6)
    flat = rational.flatten(c, ["record_id"], "label")
    return rational.unflatten(flat, ["record_id"], "label", len(poles) + 1)


@query("response_coordinates")
def response_coordinates(spark, folder):
    """Coefficients in coordinates whose length is the response error."""
    s = _sweeps(spark, folder)
    poles, scale = rational.fixed_poles(*rational.band(s), 2, 0.05)
    encoder, _, _ = rational.conditioning(s, poles, scale, ridge=1e-6)
    c = rational.fit(s, ["record_id", "label"], poles, scale, ridge=1e-6)
    return rational.transform_coefficients(c, ["record_id", "label"], encoder)


# --- dense fits -----------------------------------------------------------------------


EXTENSION_SQL = """
old AS (SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, round(c_acctbal / 1000, 1) FROM customer)),
wanted AS (SELECT count(*) AS n FROM supplier),
slab AS (SELECT * FROM (VALUES (0, 'w above', 6.0::DOUBLE / 30), (1, 'l below', 24.0::DOUBLE / 30 * 2 / 15), (2, 'l above', 24.0::DOUBLE / 30 * 2 / 15)) AS t(k, slab, share)),
part_ AS (SELECT k, slab, n, n * share / (SELECT sum(share) FROM slab) AS wish FROM slab, wanted),
rest AS (SELECT *, n - sum(floor(wish)) OVER () AS missing, row_number() OVER (ORDER BY floor(wish) - wish, k) AS up FROM part_)"""


@query(
    "extension_inventory",
    f"""WITH {EXTENSION_SQL}
    SELECT slab, CAST(floor(wish) + CASE WHEN up <= missing THEN 1 ELSE 0 END AS BIGINT) AS points, CAST(floor(wish) + CASE WHEN up <= missing THEN 1 ELSE 0 END AS BIGINT) AS inside, TRUE AS behind_old FROM rest
    UNION ALL SELECT 'old', n, n, FALSE FROM old
    UNION ALL SELECT 'verification', CAST(floor(n / 4) AS BIGINT), CAST(floor(n / 4) AS BIGINT), TRUE FROM wanted
    UNION ALL SELECT 'numbered', old.n + wanted.n, old.n + wanted.n, FALSE FROM old, wanted""",
)
def extension_inventory(spark, folder):
    """Customers' points and as many new ones as there are suppliers, beyond the old ranges of both axes.

    New points lie on the grid of one decimal, or on the next finer one that has room for all of them.
    """
    old = [{"name": "w", "lower": 0.0, "upper": 24.0}, {"name": "l", "lower": -1.0, "upper": 10.0}]
    new = [{"name": "w", "lower": 0.0, "upper": 30.0}, {"name": "l", "lower": -3.0, "upper": 12.0}]
    known = table(spark, folder, "customer").groupBy(
        F.col("c_nationkey").cast("double").alias("w"), F.round(F.col("c_acctbal") / 1000, 1).alias("l")
    ).agg(F.min("c_custkey").alias("row"))
    count = table(spark, folder, "supplier").count()
    out = extended_inventory(known.withColumn("dataset", F.lit("train")), old, new, count, count // 4, fitting_places(old, new, count, 1), "halton")
    w, l = F.col("w"), F.col("l")  # noqa: E741
    inside = (
        F.when(F.col("slab") == "w above", (w > 24) & (w <= 30) & l.between(-3, 12))
        .when(F.col("slab") == "l below", w.between(0, 24) & (l >= -3) & (l < -1))
        .when(F.col("slab") == "l above", w.between(0, 24) & (l > 10) & (l <= 12))
        .otherwise(w.between(0, 24) & l.between(-1, 10))
    )
    old_rows = F.lit(known.count())
    named = out.select(F.coalesce("slab", F.lit("old")).alias("slab"), "dataset", "w", "l", "point_index", inside.alias("in"))
    facts = [
        F.count_distinct("w", "l").alias("points"), F.count_if("in").alias("inside"),
        (F.min("point_index") > old_rows).alias("behind_old"),
    ]
    checks = named.where("dataset = 'verification'").groupBy(F.lit("verification").alias("slab")).agg(*facts)
    numbered = named.agg(
        F.lit("numbered").alias("slab"), F.count_distinct("point_index").alias("points"), F.max("point_index").alias("inside"), F.lit(False).alias("behind_old")
    )
    return named.groupBy("slab").agg(*facts).unionByName(checks).unionByName(numbered)


def _training(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linestatus", "l_orderkey")
    q = F.col("l_quantity") / 48.0
    x = F.array(q, F.col("l_discount") * 10)
    y = F.array(q * 0.5, q * 0.2, q * 0.2, F.col("l_discount"), q * 0.0, q * 0.1, q * 0.1, F.col("l_discount"))
    return lines.select("l_orderkey", x.alias("x"), y.alias("y"), "l_linestatus")


def _model(spark, folder, **options):
    data = _training(spark, folder).where("l_linestatus = 'F'").select("x", "y")
    return dense.fit(data, [6], learning_rate=0.05, seed=7, **options)


@query("dense_fit_history")
def dense_fit_history(spark, folder):
    """Loss of a data-parallel fit, step by step."""
    model = _model(spark, folder)
    return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in model.history], "step int, loss double, judged double")


@query("dense_predictions")
def dense_predictions(spark, folder):
    """Verification rows scored with the broadcast model, and their error."""
    model = _model(spark, folder)
    scored = dense.predict(_training(spark, folder).where("l_linestatus = 'O'"), model)
    long = scored.select(
        "l_orderkey", F.explode(F.arrays_zip(F.col("y").alias("t"), F.col("prediction").alias("p"))).alias("e")
    ).select("l_orderkey", F.col("e.t").alias("t"), F.col("e.p").alias("p"))
    return metrics.verification_metrics(long, [], ["t"], ["p"])


@query("passivity_penalised_fit", "SELECT count(*) AS rows, TRUE AS passive FROM lineitem")
def passivity_penalised_fit(spark, folder):
    """Fit with a passivity penalty, then contraction of what is left."""
    model = _model(spark, folder, passivity_target=0.4, passivity_penalty=1.0)
    scored = dense.predict(_training(spark, folder), model)
    factor = dense.contraction(scored, margin=0.02)
    dense.project_outputs(model, dense.reciprocity_projection(2))
    dense.project_outputs(model, factor * np.eye(8))
    again = dense.predict(_training(spark, folder), model)
    sigma = again.select(quality.largest_singular(F.col("prediction")).alias("s"))
    return sigma.agg(F.count("*").alias("rows"), (F.max("s") <= 1.0).alias("passive"))


@query("composite_passivity_fit", "SELECT count(*) AS rows, TRUE AS passive, TRUE AS learned, TRUE AS milder FROM lineitem")
def composite_passivity_fit(spark, folder):
    """A residual over a coarse response, fitted under the passivity of their sum."""
    q = F.col("l_quantity") / 48.0
    coarse = F.array(q * 0.4, *[F.lit(0.0)] * 6, q * 0.1)
    rows = table(spark, folder, "lineitem").select(
        "l_linestatus", F.array(q, F.col("l_discount") * 10).alias("x"), coarse.alias("coarse"),
        F.array(q * 0.1, q * 0.2, q * 0.2, F.col("l_discount"), q * 0.0, q * 0.1, q * 0.1, F.col("l_discount") * 0.5).alias("y"),
    )
    learn = rows.where("l_linestatus = 'F'")
    options = {"epochs": 60, "learning_rate": 0.05, "seed": 7, "coarse": "coarse"}
    plain = dense.fit(learn, [6], **options)
    held = dense.fit(learn, [6], passivity_target=0.4, passivity_penalty=1.0, **options)

    def largest(model):
        response = dense.compose(F.col("prediction"), F.col("coarse"), "residual")
        return dense.predict(rows, model).withColumn("response", response)

    worst = [largest(m).agg(F.max(quality.largest_singular(F.col("response")))).first()[0] for m in (plain, held)]
    factor = dense.contraction(largest(held), "response", margin=0.02)
    scaled = largest(held).select((quality.largest_singular(F.col("response")) * F.lit(factor)).alias("s"))
    return scaled.agg(
        F.count("*").alias("rows"), (F.max("s") <= 1.0).alias("passive"),
        F.lit(held.history[-1][1] < held.history[0][1]).alias("learned"), F.lit(worst[1] < worst[0]).alias("milder"),
    )


@query(
    "composite_response",
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount + l_tax) * 0.9, 9) AS residual, round(l_discount * 0.9, 9) AS plain FROM lineitem""",
)
def composite_response(spark, folder):
    lines = table(spark, folder, "lineitem")
    p, c = F.array("l_discount"), F.array("l_tax")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(dense.compose(p, c, "residual", 0.9)[0], 9).alias("residual"),
        r(dense.compose(p, c, "plain", 0.9)[0], 9).alias("plain"),
    )


@query(
    "branch_conductances",
    f"""WITH {SIGMA_SQL}, d AS (SELECT *, (1+ar)*(1+dr) - ai*di - (br*cr - bi*ci) AS er, (1+ar)*di + ai*(1+dr) - (br*ci + bi*cr) AS ei FROM m WHERE freq_hz = 0),
    y AS (SELECT record_id, er*er+ei*ei AS q, er, ei, (1-ar)*(1+dr)+ai*di+br*cr-bi*ci AS pr, (1-ar)*di-ai*(1+dr)+br*ci+bi*cr AS pi, (1+ar)*(1-dr)+ai*di+br*cr-bi*ci AS sr, -(1+ar)*di+ai*(1-dr)+br*ci+bi*cr AS si FROM d),
    g AS (SELECT record_id, ((pr*er+pi*ei)/(50*q) + (sr*er+si*ei)/(50*q) + 2*((2*br*er+2*bi*ei)/(50*q) + (2*cr*er+2*ci*ei)/(50*q))/2) / 4 AS g FROM y JOIN d USING (record_id, er, ei))
    SELECT record_id, round(CASE WHEN greatest(g, 0) < 1e-9 THEN 1e-12 ELSE g END, 9) AS conductance, greatest(g, 0) < 1e-9 AS is_open FROM g""",
)
def branch_conductances(spark, folder):
    """One branch between the ports, from the zero-frequency matrices."""
    dc = align.zero_rows(two_port(spark, folder))
    out = dense.conductances(dc, ["record_id"], 2, [(1, 2)])
    return out.select("record_id", r("conductance", 9).alias("conductance"), "is_open")


@query("dc_regression")
def dc_regression(spark, folder):
    """Log conductance of each block from its parameters."""
    dc = align.zero_rows(two_port(spark, folder))
    g = dense.conductances(dc, ["record_id"], 2, [(1, None), (2, None)])
    wide = g.groupBy("record_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("branch", "log_conductance"))), lambda b: b["log_conductance"]).alias("y")
    )
    x = samples(spark, folder).groupBy(F.col("l_orderkey").alias("record_id")).agg(
        F.array((F.min("l_quantity") / 48.0), F.max("l_tax")).alias("x")
    )
    model = dense.fit(wide.join(x, "record_id"), [4], learning_rate=0.05, seed=3)
    return dense.predict(x, model).select("record_id", F.col("prediction")[0].alias("log_g1"), F.col("prediction")[1].alias("log_g2"))


@query(
    "valid_candidates",
    """WITH c AS (SELECT p_partkey, ['plain','residual','prior-input'][(p_partkey % 3) + 1] AS mode, p_size % 2 = 0 AS coarse FROM part) SELECT p_partkey FROM c WHERE CASE mode WHEN 'plain' THEN NOT coarse WHEN 'prior-input' THEN coarse ELSE TRUE END""",
)
def valid_candidates(spark, folder):
    mode = F.element_at(F.array(F.lit("plain"), F.lit("residual"), F.lit("prior-input")), (F.col("p_partkey") % 3 + 1).cast("int"))
    c = table(spark, folder, "part").select("p_partkey", mode.alias("mode"), (F.col("p_size") % 2 == 0).alias("include_coarse_input"))
    return search.valid_modes(c, True).select("p_partkey")


def _ridge(candidate, seed, data):
    terms = [F.lit(1.0), F.pow("q", F.lit(float(candidate["power"])))]
    _, rmse = search.ridge_fit(data, terms, F.col("p"), candidate["ridge"])
    return {"metric": rmse, "violations": 0, "max_sigma": 1.0}


@query(
    "trial_sweep",
    """WITH c AS (SELECT * FROM (VALUES (1, 1.0::DOUBLE, 0.5::DOUBLE), (3, 2.0, 100.0), (4, 0.5, 0.0)) AS t(trial, power, ridge)),
    g AS (SELECT trial, ridge, pow(l_quantity, power) AS x, l_extendedprice AS y FROM lineitem, c),
    s AS (SELECT trial, count(*) + any_value(ridge) AS n, sum(x) AS sx, sum(x * x) + any_value(ridge) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM g GROUP BY trial),
    w AS (SELECT trial, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM s)
    SELECT trial, 0 AS status, round(sqrt(avg(power(a + b * x - y, 2))), 3) AS metric FROM g JOIN w USING (trial) GROUP BY trial UNION ALL SELECT 2, 2, NULL""",
)
def trial_sweep(spark, folder):
    """Every candidate is fitted on all rows; the incomplete candidate is kept with status 2."""
    data = table(spark, folder, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    plan = [{"power": 1, "ridge": 0.5}, {"power": 1}, {"power": 2, "ridge": 100.0}, {"power": 0.5, "ridge": 0.0}]
    candidates = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(plan, 1)], "trial int, candidate string")
    out = search.run_trials(candidates, _ridge, data)
    return out.select("trial", "status", r("metric", 3).alias("metric"))


# --- acquisition ------------------------------------------------------------------------


def _unit_regions(spark, folder):
    """Brands as error regions: mean price and size in the unit square."""
    g = _regions(spark, folder).groupBy("source_index").agg(F.avg("u0").alias("u0"), F.max("score").alias("score"))
    sizes = table(spark, folder, "part").groupBy(F.col("p_brand").alias("source_index")).agg((F.avg("p_size") / 50.0).alias("u1"))
    return g.join(sizes, "source_index").withColumn("id", F.regexp_extract("source_index", r"(\d+)", 1).cast("long"))


def _candidates(spark, folder):
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000.0, F.col("s_nationkey") / 25.0).alias("p")
    )


def _existing(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 10000.0, F.col("c_nationkey") / 25.0).alias("p")
    )


@query("error_posterior")
def error_posterior(spark, folder):
    model = acquire.fit_error_model(_unit_regions(spark, folder), ["u0", "u1"])
    return acquire.posterior(_candidates(spark, folder), model).select("id", "log_mean", "log_std")


@query(
    "error_model_residuals",
    "SELECT p_size, p_brand, TRUE AS solved FROM part GROUP BY p_size, p_brand",
)
def error_model_residuals(spark, folder):
    """Sizes and brands as error points, solved without a matrix: every row of the system holds.

    Kernel times weights is the posterior mean of the standardised targets; noise
    times weight makes up the rest of a target.
    """
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("double") / 55.0
    rows = table(spark, folder, "part").groupBy("p_size", "p_brand").agg(F.max("p_retailprice").alias("score"))
    rows = rows.withColumns({"u0": F.col("p_size") / 50.0, "u1": number})
    noise = 1e-3
    model = acquire.fit_error_model(rows, ["u0", "u1"], noise=noise, length_scale=0.12, dense_points=50)
    on_grid = F.array(*[F.rint(F.col(u) * 1e12) / 1e12 for u in ("u0", "u1")])
    scored = acquire.posterior(rows.select("p_size", "p_brand", "score", on_grid.alias("p")), model)
    met = scored.join(model.weights(), "p")
    left = (F.col("log_mean") - F.log("score")) / F.lit(model.spread) + F.lit(noise) * F.col("weight")
    sure = F.col("log_std") <= F.lit(model.spread * noise**0.5 * 1.0001)
    return met.select("p_size", "p_brand", ((F.abs(left) < 1e-6) & sure).alias("solved"))


@query(
    "nearest_error_regions",
    f"""WITH {ERROR_REGION_SQL}, rg AS (SELECT CAST(regexp_extract(source_index, '(\\d+)', 1) AS BIGINT) AS id, [avg(u0), any_value(u1)] AS p FROM g JOIN (SELECT p_brand, avg(p_size) / 50.0 AS u1 FROM part GROUP BY p_brand) ON p_brand = source_index GROUP BY source_index),
    d AS (SELECT s_suppkey AS id, rg.id AS neighbour, list_distance(rg.p, [s_acctbal / 10000.0, s_nationkey / 25.0]) AS d FROM supplier, rg) SELECT id, arg_min(neighbour, (d, neighbour)) AS neighbour, round(min(d), 6) AS distance FROM d GROUP BY id""",
)
def nearest_error_regions(spark, folder):
    out = acquire.nearest_region(_candidates(spark, folder), _unit_regions(spark, folder), ["u0", "u1"])
    return out.select("id", "neighbour", r("distance").alias("distance"))


@query(
    "error_focus",
    f"""WITH {ERROR_REGION_SQL}, rg AS (SELECT source_index, max(score) AS score, [avg(u0), any_value(u1)] AS p FROM g JOIN (SELECT p_brand, avg(p_size) / 50.0 AS u1 FROM part GROUP BY p_brand) ON p_brand = source_index GROUP BY source_index)
    SELECT s_suppkey AS id, round(sum(score * exp(-0.5 * power(list_distance(rg.p, [s_acctbal / 10000.0, s_nationkey / 25.0]), 2) / (0.25 * 0.25))), 3) AS focus FROM supplier, rg GROUP BY s_suppkey""",
)
def error_focus(spark, folder):
    out = acquire.focus(_candidates(spark, folder), _unit_regions(spark, folder), ["u0", "u1"])
    return out.select("id", r("focus", 3).alias("focus"))


HYBRID_SQL = """
RECURSIVE share AS (SELECT r.regime, k.k, CASE k.k WHEN 0 THEN r.e WHEN 1 THEN r.u ELSE r.c END AS share FROM
    (VALUES ('sparse-error-observations', 0.35::DOUBLE, 0.35::DOUBLE, 0.30::DOUBLE), ('plateau', 0.40, 0.25, 0.35),
     ('far-from-target', 0.60, 0.20, 0.20), ('near-target', 0.45, 0.25, 0.30), ('balanced', 0.50, 0.25, 0.25)) AS r(regime, e, u, c),
    (VALUES (0), (1), (2)) AS k(k)),
counts AS (SELECT DISTINCT count(*) % 61 AS n FROM orders GROUP BY o_custkey UNION SELECT DISTINCT p_partkey % 61 FROM part),
base AS (SELECT n, regime, k, n * share AS wish, greatest(floor(n * share), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS base FROM counts, share),
ranked AS (SELECT *, n - sum(base) OVER (PARTITION BY n, regime) AS missing,
    row_number() OVER (PARTITION BY n, regime ORDER BY base - wish, k) AS up,
    row_number() OVER (PARTITION BY n, regime ORDER BY base > 1 DESC, base - wish DESC, k) AS down FROM base),
given AS (SELECT n, regime, k, CAST(base + CASE WHEN up <= missing THEN 1 ELSE 0 END - CASE WHEN down <= -missing THEN 1 ELSE 0 END AS BIGINT) AS g FROM ranked),
wide AS (SELECT n, regime, max(g) FILTER (k = 0) AS e, max(g) FILTER (k = 1) AS u, max(g) FILTER (k = 2) AS c FROM given GROUP BY n, regime),
steps AS (SELECT n, regime, e, u, c, 0 AS step, 0 AS de, 0 AS du, 0 AS dc, '' AS plan FROM wide
    UNION ALL SELECT n, regime, e, u, c, step + 1, de + (pick = 'e')::INT, du + (pick = 'u')::INT, dc + (pick = 'c')::INT, plan || pick FROM (
      SELECT *, CASE WHEN be >= bu AND be >= bc THEN 'e' WHEN bu >= bc THEN 'u' ELSE 'c' END AS pick FROM (
        SELECT *, CASE WHEN de < e THEN e * (step + 1) - n * de ELSE -1000000 END AS be, CASE WHEN du < u THEN u * (step + 1) - n * du ELSE -1000000 END AS bu,
          CASE WHEN dc < c THEN c * (step + 1) - n * dc ELSE -1000000 END AS bc FROM steps WHERE step < n)))"""


@query("hybrid_schedules", f"WITH {HYBRID_SQL} SELECT n, regime, plan FROM steps WHERE step = n")
def hybrid_schedules(spark, folder):
    """Order of the kinds for every regime and batch size that the orders and parts give."""
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg((F.count("*") % 61).alias("n")).select("n")
    sizes = per_customer.unionByName(table(spark, folder, "part").select((F.col("p_partkey") % 61).alias("n"))).distinct()
    regimes = F.explode(F.array(*[F.lit(name) for name in acquire.HYBRID_SHARES]))
    plans = sizes.withColumn("regime", regimes).withColumn("kinds", acquire.hybrid_plan(F.col("n"), F.col("regime")))
    return plans.select("n", "regime", F.array_join(F.transform("kinds", lambda k: F.substring(k, 1, 1)), "").alias("plan"))


@query("ucb_batch")
def ucb_batch(spark, folder):
    """Four points by upper confidence bound and distance to existing points."""
    model = acquire.fit_error_model(_unit_regions(spark, folder), ["u0", "u1"])
    chosen = acquire.greedy(_candidates(spark, folder), _existing(spark, folder), ["gp-ucb"] * 4, model, exploration=1.5)
    return acquire.suggested(spark, chosen, "gp-ucb")


@query("hybrid_batch")
def hybrid_batch(spark, folder):
    """A mixture of exploitation, uncertainty and coverage points."""
    regions = _unit_regions(spark, folder)
    model = acquire.fit_error_model(regions, ["u0", "u1"])
    regime = acquire.hybrid_regime(2, regions.count(), None, None)
    plan = acquire.hybrid_schedule(acquire.hybrid_allocation(4, regime))
    chosen = acquire.greedy(_candidates(spark, folder), _existing(spark, folder), plan, model)
    return acquire.suggested(spark, chosen, "hybrid")


@query("hybrid_diagnostics")
def hybrid_diagnostics(spark, folder):
    model = acquire.fit_error_model(_unit_regions(spark, folder), ["u0", "u1"])
    return acquire.hybrid_diagnostics(acquire.posterior(_candidates(spark, folder), model))


@query("error_distance_batch")
def error_distance_batch(spark, folder):
    focused = acquire.focus(_candidates(spark, folder), _unit_regions(spark, folder), ["u0", "u1"])
    chosen = acquire.greedy(focused, _existing(spark, folder), ["error-distance"] * 3, focus_column="focus", min_distance=0.01)
    return acquire.suggested(spark, chosen, "error-distance")


@query(
    "recommended_count",
    f"""WITH {ERROR_REGION_SQL}, s AS (SELECT sqrt(avg(score * score)) AS rms, count(*) AS n FROM g) SELECT round(rms, 4) AS rms, CASE WHEN rms / 10000 <= 1 THEN 0 WHEN rms / 10000 >= 4 THEN 12 WHEN rms / 10000 >= 2 THEN 8 ELSE CASE WHEN n < 12 THEN 8 ELSE 6 END END AS recommended_count,
      CASE WHEN rms / 10000 <= 1 THEN 'target-met' WHEN rms / 10000 >= 4 THEN 'far-from-target' WHEN rms / 10000 >= 2 THEN 'above-target' ELSE 'near-target' END AS stage FROM s""",
)
def recommended_count(spark, folder):
    s = metrics.region_summary(_regions(spark, folder))
    out = acquire.recommend(s, 4, F.lit(500), target=10000.0)
    return out.select(r("rms", 4).alias("rms"), "recommended_count", "stage")


@query(
    "verification_growth",
    """WITH t AS (SELECT c_nationkey, count(*) FILTER (c_custkey % 3 <> 0) AS training, count(*) FILTER (c_custkey % 3 = 0) AS observed FROM customer GROUP BY c_nationkey), p AS (SELECT *, training + 5 AS projected, greatest(0, floor((training + 5 - 24) / 12.0)) AS ms FROM t)
    SELECT c_nationkey, CAST(ms AS BIGINT) AS milestones, CAST(8 + ms * 4 AS BIGINT) AS target, CASE WHEN projected >= 24 THEN CAST(least(greatest(0, 8 + ms * 4 - observed), 8) AS BIGINT) ELSE 0 END AS added FROM p""",
)
def verification_growth(spark, folder):
    c = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_custkey") % 3 != 0).alias("training"), F.count_if(F.col("c_custkey") % 3 == 0).alias("observed")
    )
    plan = acquire.verification_growth(F.col("training"), F.col("observed"), F.lit(5), 6)
    return c.select("c_nationkey", plan.alias("p")).select(
        "c_nationkey", F.col("p.completed_growth_milestones").alias("milestones"), F.col("p.target_verification_count").alias("target"), F.col("p.additional_verification_count").alias("added")
    )


@query(
    "suggestion_provenance",
    f"""WITH {ERROR_REGION_SQL}, s AS (SELECT sqrt(avg(score * score)) AS rms, count(*) AS n FROM (SELECT max(score) AS score FROM g GROUP BY source_index)),
    t AS (SELECT count(*) AS training FROM supplier),
    c AS (SELECT training, n, CASE WHEN rms / 2000 <= 1 THEN 0 WHEN training < 12 OR n < 12 THEN greatest(4, CASE WHEN rms / 2000 >= 4 THEN 6 ELSE 4 END) WHEN rms / 2000 >= 4 THEN 6 WHEN rms / 2000 >= 2 THEN 4 ELSE 4 END AS wanted FROM s, t),
    m AS (SELECT *, training + wanted AS projected, greatest(0, floor((training + wanted - 12) / 4.0)) AS milestones FROM c)
    SELECT CAST(wanted AS BIGINT) AS training, CAST(CASE WHEN projected >= 12 THEN least(greatest(0, 6 + 2 * milestones - n), 6) ELSE 0 END AS BIGINT) AS verification, TRUE AS free, TRUE AS nearest FROM m""",
)
def suggestion_provenance(spark, folder):
    """How many points of each split are suggested, that none is taken, and that the nearest error region is named."""
    # Sums of doubles may end otherwise when a job runs again, so both sides read the same scores.
    regions = checkpointed(_unit_regions(spark, folder))
    out = _suggested(spark, folder, regions)
    taken = _known_points(spark, folder).select("w", "l")
    distance = F.hypot(F.col("unit_point")[0] - F.col("u0"), F.col("unit_point")[1] - F.col("u1"))
    # Each suggestion against every region: a few rows against one row a brand.
    pairs_ = regions.withColumn("all", F.lit(1)).join(F.broadcast(out.withColumn("all", F.lit(1)).drop("score")), "all")
    least = pairs_.groupBy("point_index").agg(F.min(distance).alias("least"), F.max(F.when(F.col("source_index") == F.col("nearest_error_source_index"), F.col("score"))).alias("score"))
    right = (F.abs(F.col("least") - F.col("nearest_error_distance")) < 1e-9) & (F.col("score") == F.col("fit_error_score"))
    facts = out.join(least, "point_index").agg(
        F.count_if(F.col("dataset") == "train").alias("training"), F.count_if(F.col("dataset") == "verification").alias("verification"), F.every(right).alias("nearest")
    )
    clash = out.join(taken, ["w", "l"], "left_semi").agg((F.count("*") == 0).alias("free"))
    return facts.crossJoin(clash).select("training", "verification", "free", F.coalesce("nearest", F.lit(True)).alias("nearest"))  # one row each


def _known_points(spark, folder):
    return _candidates(spark, folder).select(
        F.round(F.col("p")[0], 2).alias("w"), F.round(F.col("p")[1], 2).alias("l"), F.lit("train").alias("dataset")
    )


@query("suggested_points")
def suggested_points(spark, folder):
    """Recommendation, candidate pool, error model and greedy batch in one go."""
    return _suggested(spark, folder, checkpointed(_unit_regions(spark, folder)))


def _suggested(spark, folder, regions):
    regions = regions.select("source_index", F.col("u0").alias("w"), F.col("u1").alias("l"), "score")
    domain = [{"name": "w", "lower": 0.0, "upper": 1.0}, {"name": "l", "lower": 0.0, "upper": 1.0}]
    return suggest(regions, _known_points(spark, folder), domain, 2, target=2000.0)


@query("sampled_grid_export")
def sampled_grid_export(spark, folder):
    """Suppliers as parameter points times line frequencies, scored by a fitted model."""
    resp = response(spark, folder)
    nation = samples(spark, folder).groupBy(F.col("l_orderkey").alias("record_id")).agg((F.min("l_suppkey") % 25).cast("double").alias("w"))
    rows = align.positive_rows(resp).where("label IN ('S11', 'S21')").groupBy("record_id", "freq_hz").agg(
        F.max(F.when(F.col("label") == "S11", F.col("re"))).alias("a"), F.max(F.when(F.col("label") == "S21", F.col("re"))).alias("b"),
        F.max(F.when(F.col("label") == "S11", F.col("im"))).alias("c"), F.max(F.when(F.col("label") == "S21", F.col("im"))).alias("d"),
    ).join(nation, "record_id")
    model = dense.fit(align.features(rows, ["w"], "freq_hz", ["a", "b", "c", "d"]), [4], learning_rate=0.05, seed=1)
    points = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").cast("double").alias("w"))
    freqs = resp.select("freq_hz").distinct()
    return sampled_grid(points, freqs, ["w"], model, ["S11", "S21"])


@query(
    "coarse_model_on_fine_rows",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, round(l_extendedprice - (2 * l_quantity + 3 * l_tax), 6) AS residual FROM samples""",
)
def coarse_model_on_fine_rows(spark, folder):
    """A coarse model evaluated at every fine sample and matched one to one."""
    s = samples(spark, folder)
    fine = s.select("l_orderkey", "l_linenumber", "l_extendedprice", F.array("l_quantity", "l_tax").alias("x"))
    line = dense.DenseModel([np.array([[2.0], [3.0]])], [np.zeros(1)], "tanh", np.zeros(2), np.ones(2), np.zeros(1), np.ones(1))
    coarse = dense.predict(fine.select("l_orderkey", "l_linenumber", "x"), line).select("l_orderkey", "l_linenumber", F.col("prediction")[0].alias("c"))
    out = fine.join(coarse, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r(F.col("l_extendedprice") - F.col("c")).alias("residual"))


@query("next_trial")
def next_trial(spark, folder):
    """The next setting to try: parts as candidates, some of them tried already."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rate"), "p_type")
    types = [row["p_type"] for row in parts.select("p_type").distinct().orderBy("p_type").collect()]
    pool = search.features(parts, ["rate"], ["rate"], {"p_type": types})
    tried = pool.where("id % 97 = 0").withColumn("metric", F.abs(F.col("rate") - 950.0)).withColumn("violations", F.lit(0)).withColumn("max_sigma", F.lit(1.0))
    chosen = search.next_trial(pool, tried, {"p_type": types}, F.lit(True))
    return pool.where(F.col("id") == int(chosen["id"])).select("id", "rate", "p_type", F.lit(chosen["stage"]).alias("stage"))
