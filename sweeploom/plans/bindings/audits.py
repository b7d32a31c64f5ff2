"""Quality rules, coverage, grids, duplicates and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.complexmath import largest_singular
from ...operators import align, coverage, grids, inventory, ordered, pairs, quality
from ...session import checkpointed, stored
from ..audit import audit
from .base import RESPONSE_SQL, SAMPLES_SQL, SIGMA_SQL, query, r, response, samples, table, two_port


@query(
    "axis_order_breaks",
    f"""WITH {SAMPLES_SQL}, o AS (SELECT l_orderkey, l_linenumber, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM samples)
    SELECT l_orderkey, count(*) AS breaks, min(l_linenumber) AS first_break FROM o WHERE d <= 0.001 GROUP BY l_orderkey""",
)
def axis_order_breaks(spark, folder):
    broken = quality.axis_breaks(samples(spark, folder), ["l_orderkey"], "l_linenumber", "l_extendedprice")
    return broken.groupBy("l_orderkey").agg(F.count("*").alias("breaks"), F.min("l_linenumber").alias("first_break"))


@query(
    "event_axis_breaks",
    """WITH o AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, count(*) AS breaks, round(min(value), 6) AS lowest FROM o WHERE value - p <= 0 GROUP BY user_id""",
)
def event_axis_breaks(spark, folder):
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    broken = quality.axis_breaks(e, ["user_id"], "ts", "value", 0.0, ordered.time_chunk(F.col("ts")), ["event_id"])
    return broken.groupBy("user_id").agg(F.count("*").alias("breaks"), r(F.min("value")).alias("lowest"))


@query(
    "largest_singular_values",
    f"WITH {SIGMA_SQL} SELECT record_id, freq_idx, round(s, 6) AS sigma, round(recip, 6) AS reciprocity, round(greatest(0, s - (1 + 1e-6)), 6) AS excess, round(-20 * log10(greatest(s, 1e-300)), 6) AS margin_db, s <= 1 + 1e-6 AS passive FROM sigma",
)
def largest_singular_values(spark, folder):
    rows = quality.passivity_rows(two_port(spark, folder), two_port=True)
    return rows.select(
        "record_id", "freq_idx", r("max_singular_value").alias("sigma"), r("reciprocity_max_abs_error").alias("reciprocity"),
        r("passivity_excess").alias("excess"), r("passivity_margin_db").alias("margin_db"), "passive",
    )


@query(
    "singular_values_any_port",
    f"WITH {SIGMA_SQL} SELECT record_id, freq_idx, round(s, 6) AS sigma FROM sigma",
)
def singular_values_any_port(spark, folder):
    """From the long table: matrices assembled by label, SVD on Arrow batches."""
    m = quality.matrices(response(spark, folder))
    return m.select("record_id", "freq_idx", r(largest_singular(F.col("matrix"))).alias("sigma"))


@query(
    "block_summaries",
    f"""WITH {SIGMA_SQL} SELECT record_id, count(*) AS frequency_rows, min(freq_hz) AS minimum_frequency_hz, max(freq_hz) AS maximum_frequency_hz,
      count(*) FILTER (freq_hz = 0) AS dc_rows, round(max(s), 6) AS max_singular_value, arg_max(freq_hz, (s, -freq_idx)) AS worst_passivity_frequency_hz,
      count(*) FILTER (s > 1 + 1e-6) AS passivity_violating_rows, round(max(recip), 6) AS max_reciprocity_abs_error FROM sigma GROUP BY record_id""",
)
def block_summaries(spark, folder):
    s = quality.block_summary(quality.passivity_rows(two_port(spark, folder), two_port=True))
    return s.withColumn("max_singular_value", r("max_singular_value")).withColumn(
        "max_reciprocity_abs_error", r("max_reciprocity_abs_error")
    )


@query(
    "passivity_totals",
    f"WITH {SIGMA_SQL} SELECT count(*) AS points, count(*) FILTER (s > 1 + 1e-6) AS violating_points, round(max(s), 6) AS max_singular_value FROM sigma",
)
def passivity_totals(spark, folder):
    t = quality.passivity_summary(quality.passivity_rows(two_port(spark, folder), two_port=True))
    return t.withColumn("max_singular_value", r("max_singular_value"))


@query(
    "worst_violations",
    f"WITH {SIGMA_SQL} SELECT record_id, freq_idx, round(s, 6) AS sigma FROM sigma WHERE s > 1 + 1e-6 ORDER BY s DESC, record_id, freq_idx LIMIT 20",
)
def worst_violations(spark, folder):
    rows = quality.passivity_rows(two_port(spark, folder), two_port=True)
    return quality.worst_samples(rows).select("record_id", "freq_idx", r("max_singular_value").alias("sigma"))


@query(
    "worst_row_overall",
    f"WITH {SIGMA_SQL} SELECT arg_max(record_id, (s, -record_id, -freq_idx)) AS record_id, round(max(s), 6) AS sigma FROM sigma",
)
def worst_row_overall(spark, folder):
    rows = quality.passivity_rows(two_port(spark, folder), two_port=True)
    key = F.struct("max_singular_value", -F.col("record_id"), -F.col("freq_idx"))
    return rows.agg(F.max_by("record_id", key).alias("record_id"), r(F.max("max_singular_value")).alias("sigma"))


@query(
    "reciprocity_totals",
    f"""WITH {SIGMA_SQL} SELECT round(max(recip), 6) AS max_abs_error, round(max(recip) / greatest(max(greatest(sqrt(br*br+bi*bi), sqrt(cr*cr+ci*ci))), 1e-12), 6) AS relative_error
    FROM sigma JOIN m USING (record_id, freq_idx)""",
)
def reciprocity_totals(spark, folder):
    p = quality.reciprocity_pairs(response(spark, folder), ["record_id", "freq_idx"])
    return quality.reciprocity_summary(p).select(r("max_abs_error").alias("max_abs_error"), r("relative_error").alias("relative_error"))


@query(
    "reciprocal_projection",
    f"""WITH {RESPONSE_SQL}, p AS (SELECT record_id, freq_idx, label, re, im, CASE WHEN label IN ('S12', 'S21') THEN 'S12' ELSE label END AS pair FROM response)
    SELECT record_id, freq_idx, label, round(avg(re) OVER w, 6) AS re, round(avg(im) OVER w, 6) AS im FROM p WINDOW w AS (PARTITION BY record_id, freq_idx, pair)""",
)
def reciprocal_projection(spark, folder):
    out = quality.reciprocal_projection(response(spark, folder), ["record_id", "freq_idx"])
    return out.select("record_id", "freq_idx", "label", r("re").alias("re"), r("im").alias("im"))


@query(
    "conditioning_of_admittance",
    f"""WITH {SIGMA_SQL}, i AS (SELECT record_id, 1 + ar AS ar, ai, br, bi, cr, ci, 1 + dr AS dr, di FROM m),
    t AS (SELECT record_id, sqrt((ar*ar+ai*ai+br*br+bi*bi+cr*cr+ci*ci+dr*dr+di*di + sqrt(power(ar*ar+ai*ai+cr*cr+ci*ci-br*br-bi*bi-dr*dr-di*di, 2) + 4 * (power(ar*br+ai*bi+cr*dr+ci*di, 2) + power(ar*bi-ai*br+cr*di-ci*dr, 2)))) / 2) AS s1,
      sqrt(power(ar*dr-ai*di-br*cr+bi*ci, 2) + power(ar*di+ai*dr-br*ci-bi*cr, 2)) AS det FROM i)
    SELECT round(max(s1 * s1 / det), 4) AS max_condition, round(min(det / s1), 6) AS min_singular FROM t""",
)
def conditioning_of_admittance(spark, folder):
    """Largest condition number and smallest singular value of I + S."""
    from ...functions.complexmath import identity_plus_conditioning

    c = two_port(spark, folder).withColumn("c", identity_plus_conditioning(F.col("matrix")))
    return c.agg(
        r(F.max("c.condition"), 4).alias("max_condition"),
        r(F.min("c.smallest")).alias("min_singular"),
    )


COVERAGE_SQL = """
v AS (SELECT l_returnflag AS dataset_kind, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'verification' END AS role, p.parameter, p.value
  FROM lineitem, LATERAL (VALUES ('quantity', l_quantity + CASE WHEN l_linestatus = 'O' AND l_orderkey % 100 = 0 THEN 5 ELSE 0 END), ('discount', l_discount), ('tax', l_tax)) AS p(parameter, value)),
tr AS (SELECT dataset_kind, parameter, min(value) AS lo, max(value) AS hi FROM v WHERE role = 'train' GROUP BY ALL)"""


def _values(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_quantity", "l_discount", "l_tax"
    )
    bump = F.when((F.col("l_linestatus") == "O") & (F.col("l_orderkey") % 100 == 0), 5).otherwise(0)
    pairs_ = F.array(
        F.struct(F.lit("quantity").alias("parameter"), (F.col("l_quantity") + bump).alias("value")),
        F.struct(F.lit("discount").alias("parameter"), F.col("l_discount").alias("value")),
        F.struct(F.lit("tax").alias("parameter"), F.col("l_tax").alias("value")),
    )
    return lines.select(
        F.col("l_returnflag").alias("dataset_kind"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("verification").alias("role"),
        F.explode(pairs_).alias("p"),
    ).select("dataset_kind", "role", "p.*")


@query(
    "parameter_coverage",
    f"""WITH {COVERAGE_SQL}, a AS (SELECT v.dataset_kind, v.parameter, role, min(value) AS minimum_base_units, max(value) AS maximum_base_units, count(DISTINCT value) AS unique_values,
      count(*) AS blocks, count(*) FILTER (value < lo OR value > hi) AS o
    FROM v JOIN tr ON v.dataset_kind = tr.dataset_kind AND v.parameter = tr.parameter GROUP BY v.dataset_kind, v.parameter, role)
    SELECT dataset_kind, parameter, role, minimum_base_units, maximum_base_units, unique_values, blocks, CASE WHEN role = 'verification' THEN o END AS outside FROM a""",
)
def parameter_coverage(spark, folder):
    c = coverage.coverage(_values(spark, folder))
    return c.select(
        "dataset_kind", "parameter", "role", "minimum_base_units", "maximum_base_units", "unique_values", "blocks",
        F.col("verification_outside_coverage").alias("outside"),
    )


@query(
    "declared_coverage",
    f"""WITH {COVERAGE_SQL}, d AS (SELECT * FROM (VALUES ('quantity', 5.0, 45.0), ('discount', 0.0, 0.08)) AS t(parameter, lo, hi))
    SELECT dataset_kind, v.parameter, CASE WHEN d.lo IS NOT NULL THEN 'geometry_generation_json' ELSE 'observed_training_extrema' END AS coverage_basis,
      count(*) FILTER (value < coalesce(d.lo, t2.lo) OR value > coalesce(d.hi, t2.hi)) AS outside
    FROM v LEFT JOIN d USING (parameter) JOIN (SELECT dataset_kind AS k, parameter AS q, lo, hi FROM tr) t2 ON t2.k = dataset_kind AND t2.q = v.parameter
    WHERE role = 'verification' GROUP BY ALL""",
)
def declared_coverage(spark, folder):
    domain = spark.createDataFrame([("quantity", 5.0, 45.0), ("discount", 0.0, 0.08)], "name_key string, lower double, upper double")
    values = _values(spark, folder).withColumn("name_key", F.col("parameter"))
    joined = coverage.with_domain(values, domain.withColumn("unit", F.lit("")))
    c = coverage.coverage(joined).where("role = 'verification'")
    return c.select("dataset_kind", "parameter", "coverage_basis", F.col("verification_outside_coverage").alias("outside"))


@query(
    "coarse_range_check",
    """WITH v AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'coarse' ELSE 'fine' END AS k, CASE WHEN l_returnflag = 'A' THEN least(l_quantity, 49) ELSE l_quantity END AS l_quantity, l_tax FROM lineitem)
    SELECT parameter, min(value) FILTER (k = 'fine') AS fine_min, max(value) FILTER (k = 'fine') AS fine_max, min(value) FILTER (k = 'coarse') AS coarse_min, max(value) FILTER (k = 'coarse') AS coarse_max,
      min(value) FILTER (k = 'fine') < min(value) FILTER (k = 'coarse') OR max(value) FILTER (k = 'fine') > max(value) FILTER (k = 'coarse') AS outside
    FROM (SELECT k, 'quantity' AS parameter, l_quantity AS value FROM v UNION ALL SELECT k, 'tax', l_tax FROM v) GROUP BY parameter""",
)
def coarse_range_check(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "l_quantity", F.when(F.col("l_returnflag") == "A", F.least("l_quantity", F.lit(49.0))).otherwise(F.col("l_quantity"))
    )
    pairs_ = F.array(
        F.struct(F.lit("quantity").alias("parameter"), F.col("l_quantity").alias("value")),
        F.struct(F.lit("tax").alias("parameter"), F.col("l_tax").alias("value")),
    )
    values = lines.select(
        F.when(F.col("l_returnflag") == "A", "coarse").otherwise("fine").alias("dataset_kind"),
        F.lit("train").alias("role"),
        F.explode(pairs_).alias("p"),
    ).select("dataset_kind", "role", "p.*")
    return coverage.coarse_coverage(values)


@query(
    "unit_interpretation",
    """WITH v AS (SELECT c_mktsegment AS source_file, 'w' AS name_key, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal / 1000 ELSE c_acctbal END AS x, c_custkey % 7 = 0 AS explicit FROM customer),
    s AS (SELECT source_file, count(*) FILTER (NOT explicit) AS unitless_value_count, count(*) FILTER (explicit) AS explicit_unit_value_count,
      count(*) FILTER (NOT explicit AND x BETWEEN 0 AND 9) AS base_units_inside, count(*) FILTER (NOT explicit AND x * 1e-3 BETWEEN 0 AND 9) AS parameter_units_inside,
      sum(CASE WHEN NOT explicit THEN CASE WHEN x < 0 THEN -x WHEN x > 9 THEN x - 9 ELSE 0 END END) AS db, sum(CASE WHEN NOT explicit THEN CASE WHEN x * 1e-3 < 0 THEN -x * 1e-3 WHEN x * 1e-3 > 9 THEN x * 1e-3 - 9 ELSE 0 END END) AS dp FROM v GROUP BY source_file)
    SELECT source_file, unitless_value_count, explicit_unit_value_count, base_units_inside, parameter_units_inside,
      CASE WHEN parameter_units_inside > base_units_inside OR (parameter_units_inside = base_units_inside AND dp <= db) THEN 'parameter-units' ELSE 'base-units' END AS selected_interpretation FROM s""",
)
def unit_interpretation(spark, folder):
    c = table(spark, folder, "customer")
    x = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_acctbal") / 1000).otherwise(F.col("c_acctbal"))
    token = F.concat(x.cast("string"), F.when(F.col("c_custkey") % 7 == 0, "mm").otherwise(""))
    rows = c.select(F.col("c_mktsegment").alias("source_file"), F.lit("w").alias("name_key"), token.alias("token"))
    domain = spark.createDataFrame([("w", 0.0, 9.0, "mm")], "name_key string, lower double, upper double, unit string")
    out = coverage.interpretation(coverage.with_domain(rows, domain))
    return out.select(
        "source_file", "unitless_value_count", "explicit_unit_value_count", "base_units_inside", "parameter_units_inside", "selected_interpretation"
    )


@query(
    "point_file_interpretation",
    """WITH v AS (SELECT p_brand, count(*) FILTER (p_retailprice BETWEEN 950 AND 1000) AS pu, count(*) FILTER (p_size * 30.0 BETWEEN 950 AND 1000) AS bu FROM part GROUP BY p_brand)
    SELECT p_brand, CASE WHEN bu > pu THEN 'base-units' ELSE 'parameter-units' END AS selected_interpretation FROM v""",
)
def point_file_interpretation(spark, folder):
    out = coverage.point_interpretation(
        table(spark, folder, "part"),
        {"parameter-units": F.col("p_retailprice").between(950, 1000), "base-units": (F.col("p_size") * 30.0).between(950, 1000)},
        ["p_brand"],
    )
    return out.select("p_brand", "selected_interpretation")


@query(
    "frequency_grids",
    f"""WITH {SAMPLES_SQL}, g AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS grid FROM samples GROUP BY l_orderkey),
    d AS (SELECT grid, row_number() OVER (ORDER BY min(l_orderkey)) AS grid_id, count(*) AS blocks FROM g GROUP BY grid)
    SELECT grid_id, blocks, len(grid) AS rows, list_min(grid) * 1e9 AS lowest, list_max(grid) * 1e9 AS highest FROM d""",
)
def frequency_grids(spark, folder):
    """Grid ids over the line numbers of each order (gaps make different grids)."""
    s = samples(spark, folder).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * F.lit(1e9)).alias("f"))
    indexed = ordered.number_rows(s, ["l_orderkey"], ["l_linenumber"], ordered.index_chunk(F.col("l_linenumber")), "i")
    indexed = checkpointed(indexed.withColumn("i", F.col("i") - 1).withColumn("ordinal", F.col("l_orderkey")))
    ids = grids.grid_ids(indexed, "l_orderkey", "ordinal", "i", "f")
    out = ids.groupBy("grid_id").agg(
        F.count("*").alias("blocks"),
        F.first("rows").alias("rows"),
        F.first("minimum_frequency_hz").alias("lowest"),
        F.first("maximum_frequency_hz").alias("highest"),
    )
    return out


@query(
    "near_duplicate_points",
    """WITH RECURSIVE v AS (SELECT p_partkey AS id, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part),
    d AS (SELECT min(id) AS id, a, b FROM v GROUP BY a, b),
    e AS (SELECT x.id AS i, y.id AS j FROM d x JOIN d y ON x.b = y.b AND abs(x.a - y.a) <= 0.35),
    w AS (SELECT i, j FROM e UNION SELECT w.i, e.j FROM w JOIN e ON w.j = e.i),
    l AS (SELECT i AS id, min(j) AS root FROM w GROUP BY i)
    SELECT v.id, l.root AS group_id FROM v JOIN d ON v.a = d.a AND v.b = d.b JOIN l ON l.id = d.id""",
)
def near_duplicate_points(spark, folder):
    """Closure of closeness over price (0.35) and size (exact)."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return pairs.near_duplicate_groups(p, ["a", "b"], "id", 0.0, 0.35)


@query(
    "duplicate_response_differences",
    f"""WITH {SAMPLES_SQL}, h AS (SELECT l_orderkey, count(*) AS n FROM samples GROUP BY l_orderkey),
    g AS (SELECT o_custkey, l_orderkey, min(l_orderkey) OVER (PARTITION BY o_custkey) AS root FROM h JOIN orders ON o_orderkey = l_orderkey),
    p AS (SELECT root AS lk, l_orderkey AS rk FROM g WHERE root <> l_orderkey),
    a AS (SELECT lk, rk, s.l_linenumber AS ln, s.l_extendedprice AS x FROM p JOIN samples s ON s.l_orderkey = lk),
    b AS (SELECT lk, rk, s.l_linenumber AS ln, s.l_extendedprice AS y FROM p JOIN samples s ON s.l_orderkey = rk),
    j AS (SELECT coalesce(a.lk, b.lk) AS left_key, coalesce(a.rk, b.rk) AS right_key, x, y FROM a FULL JOIN b ON a.lk = b.lk AND a.rk = b.rk AND a.ln = b.ln)
    SELECT left_key, right_key, count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS grid_match,
      CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL) = 0 THEN round(sqrt(avg((x - y) * (x - y))), 4) END AS rmse,
      CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL) = 0 THEN round(max(abs(x - y)), 4) END AS max_abs,
      CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL) = 0 THEN round(sqrt(avg((x - y) * (x - y))) / greatest(sqrt(avg(x * x)), sqrt(avg(y * y)), 1e-15), 6) END AS relative_rmse
    FROM j GROUP BY ALL""",
)
def duplicate_response_differences(spark, folder):
    """Orders of one customer as a duplicate group: the first against each other."""
    s = samples(spark, folder).withColumn("f", F.col("l_linenumber") * F.lit(1e9))
    used = s.select("l_orderkey").distinct()
    o = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(used, "l_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("l_orderkey").alias("group_id"))
    stars = pairs.group_pairs(o.join(first, "o_custkey"), "l_orderkey")
    d = pairs.aligned_difference(stars, s, "l_orderkey", "l_linenumber", "f", ["l_extendedprice"])
    return d.select("left_key", "right_key", "grid_match", r("rmse", 4).alias("rmse"), r("max_abs", 4).alias("max_abs"), r("relative_rmse").alias("relative_rmse"))


VECTOR_SQL = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p, label FROM embeddings)"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p"), "label"
    )


NEIGHBOUR_SQL = f"""WITH {VECTOR_SQL}, d AS (SELECT a.id, b.id AS neighbour, list_distance(a.p, b.p) AS distance FROM v a JOIN v b ON a.id <> b.id),
  n AS (SELECT id, arg_min(neighbour, (distance, neighbour)) AS neighbour, min(distance) AS distance FROM d GROUP BY id)"""


@query("nearest_neighbours", NEIGHBOUR_SQL + " SELECT id, neighbour, round(distance, 6) AS distance FROM n")
def nearest_neighbours(spark, folder):
    v = _vectors(spark, folder).select("id", "p")
    return pairs.nearest(v, v, exclude_self=True).withColumn("distance", r("distance"))


@query(
    "minimum_pair_distance",
    f"WITH {VECTOR_SQL} SELECT round(min(list_distance(a.p, b.p)), 6) AS minimum_distance FROM v a JOIN v b ON a.id < b.id",
)
def minimum_pair_distance(spark, folder):
    v = _vectors(spark, folder).select("id", "p")
    return pairs.minimum_pair_distance(v).select(r("minimum_distance").alias("minimum_distance"))


@query(
    "distance_to_existing",
    f"WITH {VECTOR_SQL} SELECT a.id, round(min(list_distance(a.p, b.p)), 6) AS distance FROM v a, v b WHERE a.label < 3 AND b.label >= 3 GROUP BY a.id",
)
def distance_to_existing(spark, folder):
    v = _vectors(spark, folder)
    out = pairs.distance_to_existing(v.where("label < 3").select("id", "p"), v.where("label >= 3").select("id", "p"), 64)
    return out.select("id", r("distance").alias("distance"))


@query(
    "separated_candidates",
    f"WITH {VECTOR_SQL}, n AS (SELECT a.id, min(list_distance(a.p, b.p)) AS distance FROM v a, v b WHERE a.label < 3 AND b.label >= 3 GROUP BY a.id) SELECT id FROM n WHERE distance >= 1.0",
)
def separated_candidates(spark, folder):
    """Candidates at least a minimum distance away from existing points."""
    v = _vectors(spark, folder)
    out = pairs.distance_to_existing(v.where("label < 3").select("id", "p"), v.where("label >= 3").select("id", "p"), 64)
    return out.where("distance >= 1.0").select("id")


@query(
    "neighbour_jumps",
    NEIGHBOUR_SQL
    + """, u AS (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, min(id) AS left_key, arg_min(neighbour, id) AS right_key, min(distance) AS distance FROM n GROUP BY 1, 2),
    q AS (SELECT u.*, v.label AS kind FROM u JOIN v ON v.id = u.left_key), m AS (SELECT kind, quantile_cont(distance, 0.5) AS med FROM q GROUP BY kind)
    SELECT left_key, right_key, q.kind, round(distance, 6) AS relative_rmse, round(greatest(0.05, 1.05 * greatest(med, 1e-15)), 6) AS outlier_threshold, distance > greatest(0.05, 1.05 * greatest(med, 1e-15)) AS response_jump_outlier FROM q JOIN m ON m.kind = q.kind""",
)
def neighbour_jumps(spark, folder):
    """Neighbour pairs, once each, against the typical distance of their label."""
    v = _vectors(spark, folder)
    once = pairs.unordered_pairs(pairs.nearest(v.select("id", "p"), v.select("id", "p"), exclude_self=True))
    kinds = v.select(F.col("id").alias("left_key"), F.col("label").alias("kind"))
    rows = once.join(kinds, "left_key").withColumnRenamed("distance", "relative_rmse")
    out = pairs.neighbour_outliers(rows, ["kind"], factor=1.05)
    return out.select("left_key", "right_key", "kind", r("relative_rmse").alias("relative_rmse"), r("outlier_threshold").alias("outlier_threshold"), "response_jump_outlier")


@query(
    "label_sets",
    """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS labels, min(event_id) AS first_seen FROM events GROUP BY user_id)
    SELECT labels, count(*) AS blocks FROM s GROUP BY labels ORDER BY count(*) DESC, min(first_seen) LIMIT 1""",
)
def label_sets(spark, folder):
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("label"), F.col("event_id").alias("ordinal")
    )
    return quality.common_label_set(e)


@query(
    "label_set_differences",
    """WITH s AS (SELECT user_id AS record_id, list_distinct(list(event_type)) AS ls FROM events GROUP BY user_id),
    x AS (SELECT list_sort(list_distinct(list(event_type))) AS ex FROM events WHERE event_type <> 'error'),
    d AS (SELECT record_id, list_filter(ex, lambda e: NOT list_contains(ls, e)) AS missing, list_sort(list_filter(ls, lambda e: NOT list_contains(ex, e))) AS extra FROM s, x)
    SELECT record_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM d WHERE len(missing) > 0 OR len(extra) > 0""",
)
def label_set_differences(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("label"), "value")
    expected = e.where("label <> 'error'").select("label").distinct()
    d = quality.label_differences(e, expected)
    return d.select("record_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query(
    "labels_of_all_blocks",
    """SELECT event_type AS label FROM events GROUP BY event_type HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)""",
)
def labels_of_all_blocks(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.col("event_type").alias("label"))
    return quality.labels_in_every_block(e, ["user_id"])


@query(
    "impedance_consistency",
    """WITH f AS (SELECT count(DISTINCT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey % 2 + 50.0 END) AS v, count(*) FILTER (s_suppkey % 10 = 0) AS m FROM supplier)
    SELECT 'INCONSISTENT_REFERENCE_IMPEDANCE' AS code, 'ERROR' AS severity FROM f WHERE v > 1 UNION ALL SELECT 'MISSING_REFERENCE_IMPEDANCE', 'WARNING' FROM f WHERE m > 0""",
)
def impedance_consistency(spark, folder):
    z = F.when(F.col("s_suppkey") % 10 != 0, F.col("s_nationkey") % 2 + 50.0)
    return quality.impedance_issues(table(spark, folder, "supplier").select(z.alias("reference_impedance_ohm"))).select("code", "severity")


@query(
    "issue_reasons",
    """WITH i AS (SELECT 'part' || CAST(user_id % 2 AS VARCHAR) || '.txt' AS file, event_id, CASE WHEN event_type IN ('error', 'click') THEN 'ERROR' ELSE 'WARNING' END AS severity,
        CASE event_type WHEN 'error' THEN 'NEGATIVE_FREQUENCY' WHEN 'click' THEN 'NONFINITE_SPARAM' ELSE event_type END AS code,
        'value ' || CAST(CAST(floor(value / 10) AS INT) AS VARCHAR) AS message,
        'fine, part' || CAST(user_id % 2 AS VARCHAR) || '.txt, block ' || CAST(event_id // 3 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN ', ' || CAST(event_id * 1000 AS VARCHAR) || ' Hz' ELSE '' END AS place FROM events),
    m AS (SELECT severity, code, message, min((file, event_id)) AS f FROM i GROUP BY ALL),
    p AS (SELECT severity, code, place, min((file, event_id)) AS f FROM i GROUP BY ALL),
    mk AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY f) AS rk FROM m),
    pk AS (SELECT *, row_number() OVER (PARTITION BY severity, code ORDER BY f) AS rk FROM p),
    ml AS (SELECT severity, code, string_agg(message, '|' ORDER BY rk) FILTER (rk <= 5) AS messages, arg_min(message, rk) AS reason, greatest(0, count(*) - 5) AS more_messages FROM mk GROUP BY ALL),
    pl AS (SELECT severity, code, string_agg(place, '|' ORDER BY rk) FILTER (rk <= 5) AS places, greatest(0, count(*) - 5) AS more_places FROM pk GROUP BY ALL),
    n AS (SELECT severity, code, count(*) AS count FROM i GROUP BY ALL)
    SELECT severity, code, count, reason, messages, places, more_messages, more_places, code IN ('NEGATIVE_FREQUENCY', 'NONFINITE_SPARAM') AS advised FROM n JOIN ml USING (severity, code) JOIN pl USING (severity, code)""",
)
def issue_reasons(spark, folder):
    """Events as issues of two files: first messages and places in the order of files and blocks."""
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    issues = e.select(
        F.concat(F.lit("/data/part"), (F.col("user_id") % 2).cast("string"), F.lit(".txt")).alias("source_file"),
        F.col("event_id").alias("at"), F.call_function("div", F.col("event_id"), F.lit(3).cast("long")).alias("source_index"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 1000.0).alias("frequency_hz"), F.lit("fine").alias("dataset_kind"),
        F.when(kind.isin("error", "click"), "ERROR").otherwise("WARNING").alias("severity"),
        F.when(kind == "error", "NEGATIVE_FREQUENCY").when(kind == "click", "NONFINITE_SPARAM").otherwise(kind).alias("code"),
        F.concat(F.lit("value "), F.floor(F.col("value") / 10).cast("int").cast("string")).alias("message"),
    )
    out = quality.issue_reasons(issues.withColumn("ordinal", F.struct("source_file", "at")))
    return out.select(
        "severity", "code", "count", "reason", F.array_join("representative_messages", "|").alias("messages"),
        F.array_join("affected_examples", "|").alias("places"), F.col("additional_message_count").alias("more_messages"),
        F.col("additional_location_count").alias("more_places"), (F.col("recommendation") != quality.OTHER_ADVICE).alias("advised"),
    )


@query(
    "audit_verdict",
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) FILTER (o_orderstatus = 'P') AS warnings, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'FAIL' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'WARNING' ELSE 'PASS' END AS verdict FROM orders""",
)
def audit_verdict(spark, folder):
    o = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "ERROR").when(F.col("o_orderstatus") == "P", "WARNING").otherwise("NOTE").alias("severity")
    )
    return quality.verdict(o)


@query(
    "issue_extract",
    "SELECT event_id, event_type AS code FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 80",
)
def issue_extract(spark, folder):
    """The shortened issue list of a report."""
    e = table(spark, folder, "events").where("event_type = 'error'")
    return e.orderBy(F.col("value").desc(), "event_id").limit(80).select("event_id", F.col("event_type").alias("code"))


@query(
    "seeded_holdout",
    """SELECT count(*) AS blocks, CAST(round(count(*) * 0.2) AS BIGINT) AS verification FROM customer""",
)
def seeded_holdout(spark, folder):
    """Hold-out of whole blocks when no block is labelled for training."""
    c = table(spark, folder, "customer").select("c_custkey", F.lit("unlabelled").alias("split"))
    out = inventory.holdout(c, "c_custkey", F.col("split"))
    return out.agg(F.count("*").alias("blocks"), F.count_if(F.col("role") == "verification").alias("verification"))


@query(
    "labelled_roles",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'verification' ELSE 'unassigned' END AS role, count(*) AS blocks FROM orders GROUP BY 1""",
)
def labelled_roles(spark, folder):
    label = F.when(F.col("o_orderstatus") == "F", "training").when(F.col("o_orderstatus") == "O", "verify").otherwise("odd")
    out = inventory.holdout(table(spark, folder, "orders").select("o_orderkey", label.alias("split")), "o_orderkey", F.col("split"))
    return out.groupBy("role").agg(F.count("*").alias("blocks"))


@query(
    "split_rules",
    """WITH f AS (SELECT count(*) FILTER (o_orderstatus = 'P') AS u FROM orders) SELECT 'UNASSIGNED_BLOCKS' AS code, 'ERROR' AS severity FROM f WHERE u > 0""",
)
def split_rules(spark, folder):
    role = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "verification").otherwise("unassigned")
    b = table(spark, folder, "orders").select(F.lit("fine").alias("dataset_kind"), role.alias("role"))
    return quality.role_issues(b).select("code", "severity")


@query(
    "sweep_profile",
    f"""WITH {RESPONSE_SQL}, b AS (SELECT record_id, max(l_linestatus) AS s FROM response GROUP BY record_id)
    SELECT (SELECT count(*) FROM b) AS blocks, (SELECT count(*) FROM b WHERE s = 'F') AS train_blocks, (SELECT count(*) FROM b WHERE s <> 'F') AS verification_blocks,
      'S11,S12,S21,S22' AS labels, min(freq_hz) AS minimum_frequency_hz, max(freq_hz) AS maximum_frequency_hz FROM response""",
)
def sweep_profile(spark, folder):
    resp = response(spark, folder)
    block = samples(spark, folder, "l_linestatus").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("s")).select(
        F.when(F.col("s") == "F", "train").otherwise("verification").alias("role")
    )
    return align.profile(resp, block).withColumn("labels", F.array_join("labels", ","))


def audit_tables(spark, folder):
    """Audit inputs from the tables: orders as two-port sweeps with three parameters."""
    # Four rows are made of each stored one whenever they are read; only the one is on disk.
    rows = stored(samples(spark, folder, "l_linestatus").drop("l_partkey", "l_shipdate"), "samples")
    resp = response(spark, folder, rows=rows).drop("l_linestatus")
    block = (
        rows.groupBy("l_orderkey")
        .agg(
            F.min("l_extendedprice").alias("w"),
            F.max("l_quantity").alias("h"),
            F.max("l_linestatus").alias("s"),
            F.min("l_suppkey").alias("k"),
        )
        .select(
            F.col("l_orderkey").alias("record_id"),
            F.col("l_orderkey").alias("ordinal"),
            F.lit("fine").alias("dataset_kind"),
            F.when(F.col("s") == "F", "train").otherwise("verification").alias("role"),
            F.lit("orders").alias("source_file"),
            F.col("l_orderkey").cast("int").alias("source_index"),
            F.create_map(F.lit("W"), F.col("w").cast("string"), F.lit("H"), F.col("h").cast("string")).alias("params"),
            F.lit(50.0).alias("reference_impedance_ohm"),
        )
    )
    return block, resp


@query("audit_issues")
def audit_issues(spark, folder):
    """The whole audit: every rule over every order, grouped into reasons."""
    block, resp = audit_tables(spark, folder)
    out = audit(stored(block, "blocks"), resp, ["W", "H"])
    return out["reasons"].select("severity", "code", "count", "reason")


@query(
    "structure_issues",
    f"""WITH {SAMPLES_SQL}, c AS (SELECT l_orderkey, count(*) AS n FROM samples GROUP BY l_orderkey)
    SELECT 'SPARAM_LENGTH_MISMATCH' AS code, l_orderkey AS source_index FROM samples GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity >= 3) NOT IN (0, count(*))
    UNION ALL SELECT 'SPARAM_COLUMN_MISMATCH', l_orderkey FROM samples GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity >= 3) = 0
    UNION ALL SELECT 'NONFINITE_SPARAM', l_orderkey FROM samples GROUP BY l_orderkey HAVING count(*) FILTER (l_tax = 0.08 AND l_discount = 0.1) > 0""",
)
def structure_issues(spark, folder):
    """Injected faults: S11 missing on small quantities, S22 not a number on some rows."""
    resp = response(spark, folder, "l_quantity", "l_tax", "l_discount").drop("l_linestatus")
    faulty = resp.where("NOT (label = 'S11' AND l_quantity < 3)").withColumn(
        "re", F.when((F.col("label") == "S22") & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1), F.lit(float("nan"))).otherwise(F.col("re"))
    )
    faulty = checkpointed(faulty.drop("l_quantity", "l_tax", "l_discount"))
    block = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct().select(
        "record_id", F.lit("fine").alias("dataset_kind"), F.lit("train").alias("role"), F.lit("orders").alias("source_file"),
        F.col("record_id").cast("int").alias("source_index"),
    )
    block = checkpointed(block)
    expected = spark.createDataFrame([("S11",), ("S12",), ("S21",), ("S22",)], "label string")
    return quality.structure_issues(faulty, block, expected).select("code", F.col("source_index").cast("long").alias("source_index"))
