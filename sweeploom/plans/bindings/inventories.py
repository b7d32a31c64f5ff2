"""Error metrics, inventories, trials, settings and logs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import logtext
from ...functions.complexmath import port_numbers
from ...functions.units import csv_number, in_unit_cube, to_unit
from ...operators import inventory, metrics, ordered, settings, solverlogs, trials
from ...sources import artifacts, tabular
from .base import RESPONSE_SQL, SAMPLES_SQL, query, r, response, samples, table
from .scalars import GRID_SQL, keyed_lines

# --- truth against prediction ---------------------------------------------------

ERROR_SQL = """
e AS (SELECT l_orderkey, l_linenumber, p_brand, p_size, p_retailprice, l_quantity * p_retailprice AS truth, l_extendedprice AS pred FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT *, abs(pred - truth) AS err, CASE WHEN abs(truth) > 1e-12 AND abs(pred) > 1e-12 THEN 20 * log10(abs(pred) / abs(truth)) END AS db, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 2.0 WHEN p_brand LIKE 'Brand#1%' THEN 0.5 ELSE 1.0 END AS w FROM e)"""


def errors(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    brand = F.col("p_brand")
    weight = F.when(brand.isin("Brand#1", "Brand#2", "Brand#3"), 2.0).when(brand.startswith("Brand#1"), 0.5).otherwise(1.0)
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey", "l_linenumber", "p_brand", "p_size", "p_retailprice",
        (F.col("l_quantity") * F.col("p_retailprice")).alias("truth"),
        F.col("l_extendedprice").alias("pred"),
        weight.alias("w"),
    )


METRIC_COLUMNS = ["rmse_abs", "mean_abs", "max_abs", "evm_pct", "evm_db", "rmse_db", "max_abs_db", "weighted_rmse_abs", "weighted_evm_rms"]
METRIC_SQL = """count(*) AS rows, round(sqrt(avg(err * err)), 4) AS rmse_abs, round(avg(err), 4) AS mean_abs, round(max(err), 4) AS max_abs,
  round(100 * sqrt(sum(err * err) / sum(truth * truth)), 4) AS evm_pct, round(20 * log10(sqrt(sum(err * err) / sum(truth * truth))), 4) AS evm_db,
  round(sqrt(avg(db * db)), 4) AS rmse_db, round(max(abs(db)), 4) AS max_abs_db, round(sqrt(sum(w * err * err) / sum(w)), 4) AS weighted_rmse_abs,
  round(sqrt(sum(w * err * err) / sum(w * truth * truth)), 4) AS weighted_evm_rms"""


def _shown(df, by):
    return df.select(*by, "rows", *[r(c, 4).alias(c) for c in METRIC_COLUMNS])


@query("verification_metrics", f"WITH {ERROR_SQL} SELECT p_brand, {METRIC_SQL} FROM f GROUP BY p_brand")
def verification_metrics(spark, folder):
    m = metrics.verification_metrics(errors(spark, folder), ["p_brand"], ["truth"], ["pred"], F.col("w"))
    return _shown(m, ["p_brand"])


@query("global_metrics", f"WITH {ERROR_SQL} SELECT {METRIC_SQL} FROM f")
def global_metrics(spark, folder):
    return _shown(metrics.verification_metrics(errors(spark, folder), [], ["truth"], ["pred"], F.col("w")), [])


@query(
    "weighted_rules",
    """WITH b AS (SELECT DISTINCT p_brand FROM part), w AS (SELECT p_brand, CAST(CASE WHEN p_brand = 'Brand#12' THEN 4.0 WHEN p_brand LIKE 'Brand#1%' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM b),
    n AS (SELECT p_partkey, weight FROM part JOIN w USING (p_brand)) SELECT p_partkey, weight, round(weight / (SELECT avg(weight) FROM n), 6) AS normalized_weight FROM n""",
)
def weighted_rules(spark, folder):
    """Rules in order, the later one wins; weights normalised to mean one."""
    rules = spark.createDataFrame(
        [(0, "brand#*", 1.0), (1, "brand#1*", 0.5), (2, "brand#12", 4.0)], "ordinal int, selector string, rule_weight double"
    )
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    hit = metrics.label_selector(F.col("selector"), F.col("p_brand"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    weighted = metrics.apply_rules(parts, rules, hit, ["p_brand"])
    return metrics.normalise_weights(weighted, "weight").select("p_partkey", "weight", r("normalized_weight").alias("normalized_weight"))


@query(
    "label_and_band_weights",
    f"""WITH {RESPONSE_SQL} SELECT label, freq_hz, CAST(CASE WHEN label IN ('S11', 'S22') THEN 1.0 WHEN label = 'S21' THEN 0.8 ELSE 0.2 END AS DOUBLE) AS label_weight,
      CAST(CASE WHEN freq_hz = 5e9 THEN 5.0 WHEN freq_hz BETWEEN 2e9 AND 4e9 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS band_weight, count(*) AS rows FROM response GROUP BY ALL""",
)
def label_and_band_weights(spark, folder):
    labels_ = spark.createDataFrame(
        [(0, "offdiag", 0.2), (1, "diag", 1.0), (2, "row2", 0.8), (3, "S22,S11", 1.0)], "ordinal int, selector string, rule_weight double"
    )
    bands = spark.createDataFrame(
        [(0, 2e9, 4e9, 2.0), (1, 5e9, 5e9, 5.0)], "ordinal int, low double, high double, rule_weight double"
    )
    tally = response(spark, folder).groupBy("label", "freq_hz").agg(F.count("*").alias("rows"))
    port = port_numbers(F.col("label"))
    one = metrics.apply_rules(
        tally, labels_, metrics.label_selector(F.col("selector"), F.col("label"), port["row"], port["col"]), ["label"]
    ).withColumnRenamed("weight", "label_weight")
    two = metrics.apply_rules(one, bands, metrics.frequency_selector(F.col("low"), F.col("high"), F.col("freq_hz")), ["freq_hz"])
    return two.select("label", "freq_hz", "label_weight", F.col("weight").alias("band_weight"), "rows")


@query(
    "position_match",
    f"""WITH {SAMPLES_SQL}, a AS (SELECT l_orderkey AS k, l_linenumber AS i, l_extendedprice AS x FROM samples WHERE l_orderkey % 2 = 0), b AS (SELECT l_orderkey - 1 AS k, l_linenumber AS i, l_extendedprice AS y FROM samples WHERE l_orderkey % 2 = 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.i, b.i) AS i, round(x, 2) AS truth_x, round(y, 2) AS pred_x, x IS NOT NULL AND y IS NOT NULL AS grid_ok FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i""",
)
def position_match(spark, folder):
    s = samples(spark, folder).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") * F.lit(1e9)).alias("f"), F.col("l_extendedprice").alias("x")
    )
    even, odd = s.where("k % 2 = 0"), s.where("k % 2 = 1").withColumn("k", F.col("k") - 1)
    m = metrics.match_positions(even, odd, ["k", "i"], "f", ["x"])
    return m.select("k", "i", r("truth_x", 2).alias("truth_x"), r("pred_x", 2).alias("pred_x"), "grid_ok")


def _regions(spark, folder):
    e = errors(spark, folder).withColumn("err", F.abs(F.col("pred") - F.col("truth")))
    e = e.withColumn("u0", to_unit(F.col("p_retailprice"), F.lit(900.0), F.lit(1100.0), F.lit("linear"))).withColumn(
        "o", F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    return metrics.error_regions(e, "p_brand", ["u0"], "rmse_abs", "err", "l_linenumber", metrics.effective_weight(F.col("w"), F.lit(1.0)), "o")


ERROR_REGION_SQL = f"""{ERROR_SQL}, u AS (SELECT p_brand AS source_index, round_even((p_retailprice - 900.0) / 200.0 * 1e12, 0) / 1e12 AS u0, err, w FROM f),
g AS (SELECT source_index, u0, sqrt(sum(w * err * err) / sum(w)) AS score, max(err) AS worst, count(*) AS row_count FROM u GROUP BY source_index, u0)"""


@query(
    "error_regions",
    f"WITH {ERROR_REGION_SQL} SELECT source_index, round(u0, 9) AS u0, round(score, 4) AS score, round(worst, 4) AS worst_sparam_score, row_count FROM g",
)
def error_regions(spark, folder):
    g = _regions(spark, folder)
    return g.select("source_index", r("u0", 9).alias("u0"), r("score", 4).alias("score"), r("worst_sparam_score", 4).alias("worst_sparam_score"), "row_count")


@query(
    "ranked_regions",
    f"WITH {ERROR_REGION_SQL} SELECT source_index, round(u0, 9) AS u0, row_number() OVER (ORDER BY round(score, 6) DESC, source_index, u0) AS rank FROM g",
)
def ranked_regions(spark, folder):
    g = _regions(spark, folder).withColumn("score", r("score"))
    return metrics.ranked(g, "score", ["source_index", "u0"]).select("source_index", r("u0", 9).alias("u0"), "rank")


@query(
    "region_summary",
    f"WITH {ERROR_REGION_SQL} SELECT source_index, round(sqrt(avg(score * score)), 4) AS rms, round(quantile_cont(score, 0.5), 4) AS median, round(quantile_cont(score, 0.9), 4) AS p90, round(max(score), 4) AS max, count(*) AS regions FROM g GROUP BY source_index",
)
def region_summary(spark, folder):
    s = metrics.region_summary(_regions(spark, folder), ["source_index"])
    return s.select("source_index", *[r(c, 4).alias(c) for c in ("rms", "median", "p90", "max")], "regions")


@query(
    "automatic_metric",
    "SELECT CASE WHEN count(*) FILTER (c_acctbal > 99999) > 0 THEN 'evm_pct' WHEN count(*) FILTER (c_nationkey = 3) > 0 THEN 'rmse_abs' ELSE 'max_abs' END AS metric FROM customer",
)
def automatic_metric(spark, folder):
    m = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 99999, "1").otherwise("").alias("evm_pct"),
        F.when(F.col("c_nationkey") == 3, "2").otherwise(" ").alias("rmse_abs"),
        F.lit("3").alias("max_abs"),
    )
    return metrics.choose_metric(m)


@query(
    "usable_metric_rows",
    """WITH e AS (SELECT event_id, event_id % 5 <> 0 AS has, event_id % 7 <> 0 AS complete, event_id % 11 <> 0 AS parsed, value BETWEEN 1 AND 40 AS inside FROM events)
    SELECT count(*) FILTER (has) AS usable_metric_rows, count(*) FILTER (has AND complete) AS complete_parameter_rows, count(*) FILTER (has AND complete AND parsed) AS parsed_parameter_rows,
      count(*) FILTER (has AND complete AND parsed AND inside) AS accepted_rows,
      (SELECT array_to_string(list(s ORDER BY s), ',') FROM (SELECT CAST(event_id AS VARCHAR) AS s FROM e WHERE has AND complete AND NOT parsed ORDER BY s LIMIT 3)) AS invalid_samples,
      (SELECT array_to_string(list(s ORDER BY s), ',') FROM (SELECT CAST(event_id AS VARCHAR) AS s FROM e WHERE has AND complete AND parsed AND NOT inside ORDER BY s LIMIT 3)) AS outside_samples FROM e""",
)
def usable_metric_rows(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    token = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("value").cast("string"))
    u = to_unit(csv_number(token), F.lit(1.0), F.lit(40.0), F.lit("linear"))
    flagged = metrics.usable_rows(e, F.when(F.col("event_id") % 5 != 0, F.col("value")), [token], [u])
    out = metrics.stage_counts(flagged, F.col("event_id").cast("string"))
    return out.withColumn("invalid_samples", F.array_join("invalid_samples", ",")).withColumn("outside_samples", F.array_join("outside_samples", ","))


# --- inventories -----------------------------------------------------------------


def _points(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag")
    keyed = keyed_lines(lines)
    order = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") % 10_000
    return keyed.select(
        "price_key", "discount_key", F.when(F.col("l_linestatus") == "F", "train").otherwise("verification").alias("dataset"),
        F.col("l_returnflag").alias("source"), order.alias("position"),
    )


POINTS_SQL = GRID_SQL + """, pts AS (SELECT price_key, discount_key, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'verification' END AS dataset, l_returnflag AS source,
  (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS position FROM k)"""
KEY = ["price_key", "discount_key"]


@query(
    "keep_first_points",
    f"WITH {POINTS_SQL} SELECT price_key, discount_key, arg_min(dataset, position) AS dataset, min(position) AS position FROM pts GROUP BY price_key, discount_key",
)
def keep_first_points(spark, folder):
    return inventory.keep_first(_points(spark, folder), KEY, "position").select(*KEY, "dataset", "position")


@query(
    "training_wins",
    f"WITH {POINTS_SQL} SELECT price_key, discount_key, CASE WHEN bool_or(dataset = 'train') THEN 'train' ELSE 'verification' END AS dataset, arg_min(source, (dataset, position)) AS source, min(position) AS position FROM pts GROUP BY price_key, discount_key",
)
def training_wins(spark, folder):
    out = inventory.training_wins(_points(spark, folder).withColumn("p", F.col("position")).withColumnRenamed("position", "row_order"), KEY, "dataset", "row_order")
    return out.select(*KEY, "dataset", "source", "position")


@query(
    "cleanup_counts",
    f"""WITH {POINTS_SQL}, o AS (SELECT *, min(position) OVER k AS first, min(CASE WHEN dataset = 'train' THEN position END) OVER k AS ft FROM pts WINDOW k AS (PARTITION BY price_key, discount_key))
    SELECT count(*) FILTER (dataset = CASE WHEN ft < position THEN 'train' ELSE 'verification' END) AS same_split_duplicates_removed,
      count(*) FILTER (dataset <> CASE WHEN ft < position THEN 'train' ELSE 'verification' END) AS cross_split_duplicates_removed FROM o WHERE position <> first""",
)
def cleanup_counts(spark, folder):
    return inventory.cleanup_counts(_points(spark, folder), KEY, "dataset", "position")


@query(
    "split_conflicts",
    f"""WITH {POINTS_SQL}, f AS (SELECT price_key, discount_key, arg_min(dataset, position) AS fd, arg_min(source, position) AS fs, min(position) AS fp FROM pts GROUP BY 1, 2)
    SELECT price_key, discount_key, fd AS first_dataset, fs AS first_source, dataset AS conflicting_dataset, source AS conflicting_source, count(*) AS conflicts
    FROM pts JOIN f USING (price_key, discount_key) WHERE position > fp AND dataset <> fd GROUP BY ALL""",
)
def split_conflicts(spark, folder):
    c = inventory.cross_split_conflicts(_points(spark, folder), KEY, "dataset", "source", "position")
    return c.groupBy(*KEY, "first_dataset", "first_source", "conflicting_dataset", "conflicting_source").agg(F.count("*").alias("conflicts"))


@query(
    "accumulated_inventory",
    f"""WITH {POINTS_SQL}, o AS (SELECT *, CASE source WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS part FROM pts)
    SELECT dataset, source, count(*) AS points FROM (SELECT price_key, discount_key, arg_min(dataset, (dataset, part, position)) AS dataset, arg_min(source, (dataset, part, position)) AS source FROM o GROUP BY 1, 2) GROUP BY ALL""",
)
def accumulated_inventory(spark, folder):
    """Existing, then observed, then additional points; training wins conflicts."""
    p = _points(spark, folder)
    out = inventory.accumulate([p.where(F.col("source") == s) for s in ("A", "N", "R")], KEY, "dataset", "position")
    return out.groupBy("dataset", "source").agg(F.count("*").alias("points"))


@query(
    "new_point_duplicates",
    f"""WITH {POINTS_SQL}, b AS (SELECT price_key, discount_key, count(*) AS n FROM pts WHERE source = 'R' GROUP BY 1, 2), t AS (SELECT DISTINCT price_key, discount_key FROM pts WHERE source <> 'R')
    SELECT b.price_key, b.discount_key, n, t.price_key IS NOT NULL AS taken FROM b LEFT JOIN t USING (price_key, discount_key) WHERE n > 1 OR t.price_key IS NOT NULL""",
)
def new_point_duplicates(spark, folder):
    p = _points(spark, folder)
    return inventory.new_duplicates(p.where("source = 'R'"), p.where("source != 'R'"), KEY)


@query(
    "unoccupied_candidates",
    f"""WITH {POINTS_SQL} SELECT price_key, discount_key, min(position) AS position FROM pts WHERE source = 'R' AND (price_key, discount_key) NOT IN (SELECT (price_key, discount_key) FROM pts WHERE source <> 'R') GROUP BY 1, 2""",
)
def unoccupied_candidates(spark, folder):
    p = _points(spark, folder)
    return inventory.unoccupied(p.where("source = 'R'").select(*KEY, "position"), p.where("source != 'R'"), KEY, "position")


@query(
    "leaked_documents",
    """WITH d AS (SELECT doc_id, md5(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS train FROM documents) SELECT doc_id FROM d WHERE NOT train AND h IN (SELECT h FROM d WHERE train)""",
)
def leaked_documents(spark, folder):
    """Unlabelled documents whose whole text occurs among labelled ones."""
    d = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("h"))
    labelled = table(spark, folder, "labels").select("doc_id")
    train = d.join(labelled, "doc_id", "left_semi")
    return inventory.leaked(d.join(labelled, "doc_id", "left_anti"), train, ["h"]).select("doc_id")


@query(
    "verification_observations",
    f"""WITH {POINTS_SQL} SELECT price_key, discount_key FROM pts WHERE dataset = 'verification' UNION SELECT price_key, discount_key FROM pts WHERE source = 'R' EXCEPT SELECT price_key, discount_key FROM pts WHERE dataset = 'train'""",
)
def verification_observations(spark, folder):
    p = _points(spark, folder)
    return inventory.verification_observations(p.where("dataset = 'verification'"), p.where("source = 'R'"), p.where("dataset = 'train'"), KEY)


@query(
    "split_overlap",
    f"WITH {POINTS_SQL} SELECT price_key, discount_key FROM pts WHERE dataset = 'verification' INTERSECT SELECT price_key, discount_key FROM pts WHERE dataset = 'train'",
)
def split_overlap(spark, folder):
    return inventory.split_overlap(_points(spark, folder), KEY, "dataset")


@query(
    "split_integrity",
    f"""WITH {POINTS_SQL}, gr AS (SELECT count(*) AS n, count(*) FILTER (dataset = 'train') AS t, count(*) FILTER (dataset <> 'train') AS v FROM pts GROUP BY price_key, discount_key)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_geometries, CAST(sum(t) AS BIGINT) AS train, CAST(sum(v) AS BIGINT) AS verification, count(*) FILTER (t > 0 AND v > 0) AS train_verification_overlap FROM gr""",
)
def split_integrity(spark, folder):
    return inventory.split_integrity(_points(spark, folder), KEY, "dataset")


@query(
    "inventory_counts",
    f"""WITH {POINTS_SQL}, gr AS (SELECT bool_or(dataset = 'train') AS t FROM pts GROUP BY price_key, discount_key) SELECT count(*) FILTER (t) AS training, count(*) FILTER (NOT t) AS verification FROM gr""",
)
def inventory_counts(spark, folder):
    return inventory.inventory_counts(_points(spark, folder), KEY, "dataset")


@query(
    "constraint_violations",
    f"""WITH {POINTS_SQL}, gr AS (SELECT count(*) AS n, bool_or(dataset = 'train') AND bool_or(dataset <> 'train') AS in_both FROM pts GROUP BY price_key, discount_key)
    SELECT 'in_domain' AS rule, count(*) AS rows FROM pts WHERE discount_key = '100mm' HAVING count(*) > 0
    UNION ALL SELECT 'role_matches_file', count(*) FROM pts WHERE source = 'N' AND dataset = 'train' HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_key', CAST(sum(n) AS BIGINT) FROM gr WHERE n > 1 UNION ALL SELECT 'split_overlap', count(*) FROM gr WHERE in_both""",
)
def constraint_violations(spark, folder):
    checks = {
        "in_domain": F.col("discount_key") != "100mm",
        "role_matches_file": ~((F.col("source") == "N") & (F.col("dataset") == "train")),
    }
    return inventory.constraint_violations(_points(spark, folder), KEY, checks, "dataset")


@query(
    "extension_precondition",
    "SELECT 'inside_original_domain' AS rule, count(*) AS rows FROM part WHERE p_retailprice < 905 OR p_retailprice > 990 HAVING count(*) > 0",
)
def extension_precondition(spark, folder):
    """Rows outside the original domain, before a range is extended."""
    p = table(spark, folder, "part").select("p_partkey", to_unit(F.col("p_retailprice"), F.lit(905.0), F.lit(990.0), F.lit("linear")).alias("u"))
    return inventory.constraint_violations(p, ["p_partkey"], {"inside_original_domain": in_unit_cube(F.array("u"))})


@query(
    "rounded_unique_points",
    """WITH k AS (SELECT c_custkey, CAST(round_even(c_acctbal / 10000.0 / 0.01, 0) AS BIGINT) AS a FROM customer) SELECT min(c_custkey) AS c_custkey FROM k GROUP BY a""",
)
def rounded_unique_points(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 10000.0).alias("u"))
    return inventory.rounded_unique(c, ["u"], "c_custkey", 0.01).select("c_custkey")


@query(
    "numbered_points",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS point_index, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) END AS train_sequence,
      CASE WHEN o_orderstatus <> 'F' THEN row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) END AS verification_sequence FROM orders""",
)
def numbered_points(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "train").otherwise("verification").alias("dataset"))
    out = inventory.number_points(o, "o_orderkey", "dataset", ordered.index_chunk(F.col("o_orderkey"), 4096))
    return out.select("o_orderkey", "point_index", "train_sequence", "verification_sequence")


@query(
    "head_split",
    """WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN i <= n - 20 THEN 'train' ELSE 'verification' END AS dataset FROM n""",
)
def head_split(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey")
    numbered = ordered.global_index(s, ["s_suppkey"], ordered.index_chunk(F.col("s_suppkey")), "i")
    return inventory.head_split(numbered, "i", s.count(), 20).select("s_suppkey", "dataset")


@query(
    "view_integrity",
    """WITH t AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0), v AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 50 <> 0)
    SELECT 'train' AS view, (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM v)) + (SELECT count(*) FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM t)) AS differences""",
)
def view_integrity(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "train").otherwise("verification").alias("dataset"))
    views = {"train": p.where("dataset = 'train' AND p_partkey % 50 != 0"), "verification": p.where("dataset = 'verification'")}
    return inventory.family_violations(p, views, ["p_partkey"], "dataset")


@query(
    "density_recommendation",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS v FROM orders) SELECT n AS existing, CAST(greatest(ceil((n - v) * 0.4), 12) AS BIGINT) AS train, CAST(greatest(ceil(v * 0.4), 6) AS BIGINT) AS verification FROM c""",
)
def density_recommendation(spark, folder):
    o = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "O", "verification").otherwise("train").alias("dataset"))
    return inventory.density_recommendation(o, "dataset", 0.4, 3)


@query(
    "extension_counts",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS v FROM orders), s AS (SELECT n, CAST(least(39, greatest(1, round_even(40.0 * v / n, 0))) AS BIGINT) AS k FROM c) SELECT n AS existing, 40 - k AS train, k AS verification FROM s""",
)
def extension_counts(spark, folder):
    o = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "O", "verification").otherwise("train").alias("dataset"))
    return inventory.density_recommendation(o, "dataset", 0.4, 3, explicit_count=40)


@query(
    "domain_differences",
    """WITH a AS (SELECT p_brand, min(p_retailprice) AS lo FROM part GROUP BY p_brand), b AS (SELECT p_brand, min(p_retailprice) AS lo FROM part WHERE p_size > 3 GROUP BY p_brand) SELECT p_brand AS name FROM a JOIN b USING (p_brand) WHERE a.lo <> b.lo""",
)
def domain_differences(spark, folder):
    from ...operators import coverage

    def domain(df):
        d = df.groupBy("p_brand").agg(F.min("p_retailprice").alias("lower"))
        return d.select(
            F.xxhash64("p_brand").alias("ordinal"), F.col("p_brand").alias("name"), "lower", F.lit(2000.0).alias("upper"), F.lit("linear").alias("scale")
        )

    p = table(spark, folder, "part")
    return coverage.domains_differ(domain(p), domain(p.where("p_size > 3"))).select(F.coalesce("name", "r_name").alias("name"))


@query(
    "union_of_fields",
    "SELECT s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer",
)
def union_of_fields(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return tabular.union_of_fields([s, c], ["name"])


# --- trials ------------------------------------------------------------------------


def _trials(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_totalprice") / 1000.0).alias("metric"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 3).otherwise(None).alias("violations"),
        F.col("o_custkey").alias("c"),
    )


@query(
    "best_trials",
    """SELECT o_orderpriority, count(*) AS trials, count(*) FILTER (o_orderstatus = 'F') AS eligible, arg_min(o_orderkey, (o_totalprice, o_orderkey)) FILTER (o_orderstatus = 'F') AS best_trial,
      round(min(o_totalprice) FILTER (o_orderstatus = 'F') / 1000, 6) AS best_metric, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best_available FROM orders GROUP BY o_orderpriority""",
)
def best_trials(spark, folder):
    ok = trials.eligible(F.col("violations"), F.lit(1.0), require_passive=True)
    out = trials.best_trials(_trials(spark, folder), "metric", ok, ["o_orderpriority"], "o_orderkey")
    return out.withColumn("best_metric", r("best_metric"))


@query(
    "reranked_trials",
    """SELECT o_orderkey, o_orderstatus = 'F' AS eligible, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice / 1000.0, o_orderkey) AS rank FROM orders""",
)
def reranked_trials(spark, folder):
    ok = trials.eligible(F.col("violations"), F.lit(1.0), max_violations=2)
    return trials.rerank(_trials(spark, folder), "metric", ok, ["o_orderpriority"], "o_orderkey").select("o_orderkey", "eligible", "rank")


@query(
    "best_so_far",
    """WITH b AS (SELECT *, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM orders)
    SELECT o_orderkey, round(m / 1000, 6) AS best_metric, o_orderstatus = 'F' AND (p IS NULL OR o_totalprice < p) AS promoted FROM b""",
)
def best_so_far(spark, folder):
    ok = trials.eligible(F.col("violations"), F.lit(1.0), require_passive=True)
    chunk = ordered.index_chunk(F.col("o_orderkey"), 5000)
    out = trials.best_so_far(_trials(spark, folder), "metric", ok, ["o_orderpriority"], "o_orderkey", chunk)
    return out.select("o_orderkey", r("best_metric").alias("best_metric"), "promoted")


@query(
    "category_counts",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS category_count FROM orders",
)
def category_counts(spark, folder):
    out = trials.category_counts(_trials(spark, folder), ["o_orderpriority"], "o_orderstatus", "o_orderkey")
    return out.select("o_orderkey", "category_count")


@query(
    "round_improvements",
    """WITH m AS (SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS y, sqrt(avg(l_extendedprice * l_extendedprice)) AS rms FROM lineitem GROUP BY ALL) SELECT l_returnflag, y, round((lag(rms) OVER w - rms) / lag(rms) OVER w, 6) AS improvement FROM m WINDOW w AS (PARTITION BY l_returnflag ORDER BY y)""",
)
def round_improvements(spark, folder):
    m = table(spark, folder, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(
        F.sqrt(F.avg(F.col("l_extendedprice") * F.col("l_extendedprice"))).alias("rms")
    )
    return trials.improvement(m, ["l_returnflag"], "y", "rms").select("l_returnflag", "y", r("improvement").alias("improvement"))


@query(
    "sweep_diagnostics",
    """WITH s AS (SELECT 'priority' AS setting, o_orderpriority AS value, o_totalprice / 1000 AS m, o_orderstatus = 'F' AS p FROM orders UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), o_totalprice / 1000, o_orderstatus = 'F' FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT setting, value, count(*) FILTER (p) AS trials, round(avg(m) FILTER (p), 6) AS mean, round(min(m) FILTER (p), 6) AS minimum, count(*) AS all_trials, round(avg(m), 6) AS all_mean, round(max(m), 6) AS all_maximum FROM s GROUP BY setting, value""",
)
def sweep_diagnostics(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"))
    t = _trials(spark, folder).join(c, "c").withColumn("priority", F.col("o_orderpriority"))
    out = trials.sweep_diagnostics(t, ["priority", "nation"], "metric", F.coalesce(F.col("violations") == 0, F.lit(False)))
    return out.select("setting", "value", "trials", r("mean", 6).alias("mean"), r("minimum", 6).alias("minimum"), "all_trials", r("all_mean", 6).alias("all_mean"), r("all_maximum", 6).alias("all_maximum"))


@query(
    "training_progress",
    """SELECT user_id, count(*) AS epochs, arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, min(value) AS best_loss, arg_min(event_id, (value, event_id)) AS best_epoch FROM events GROUP BY user_id""",
)
def training_progress(spark, folder):
    return trials.progress(table(spark, folder, "events"), ["user_id"], "event_id", "value")


@query("first_candidates", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 25")
def first_candidates(spark, folder):
    return trials.first_n(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey", 25)


@query("sampled_candidates")
def sampled_candidates(spark, folder):
    return trials.seeded_sample(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey", 25, 7)


@query(
    "worst_blocks",
    f"WITH {ERROR_SQL}, m AS (SELECT l_orderkey, round(sqrt(avg(err * err)), 4) AS score FROM f GROUP BY l_orderkey) SELECT l_orderkey, score FROM m ORDER BY score DESC, l_orderkey LIMIT 12",
)
def worst_blocks(spark, folder):
    m = metrics.verification_metrics(errors(spark, folder), ["l_orderkey"], ["truth"], ["pred"])
    m = m.select("l_orderkey", r("rmse_abs", 4).alias("score"))
    return trials.worst_blocks(m, "score", ["l_orderkey"], 12)


# --- settings ------------------------------------------------------------------------

SETTINGS_SQL = r"""
s AS (SELECT page_id, [regexp_extract(url, 'example\.[a-z]+'), regexp_extract(url, '/(en|fr|de|es)/', 1), CAST(page_id % 9 AS VARCHAR)][1:1 + page_id % 3] AS path, CAST(page_id % 7 AS VARCHAR) AS value, 'page' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS source, CAST(page_id % 5 AS INT) AS priority FROM pages),
w AS (SELECT array_to_string(path, '/') AS path, arg_max(value, (priority, source)) AS selected_value, max((priority, source)) AS rk, count(*) AS candidates, count(DISTINCT value) AS distinct_values FROM s GROUP BY path)"""


def _settings(spark, folder):
    parts = F.array(
        F.regexp_extract("url", r"example\.[a-z]+", 0), F.regexp_extract("url", "/(en|fr|de|es)/", 1), (F.col("page_id") % 9).cast("string")
    )
    path = F.slice(parts, F.lit(1), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, folder, "pages").select(
        path.alias("path"),
        (F.col("page_id") % 7).cast("string").alias("value"),
        F.concat(F.lit("page"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("source"),
        (F.col("page_id") % 5).cast("int").alias("priority"),
        F.lit("2024-01-01").cast("timestamp").alias("mtime"),
    )


@query(
    "setting_winners",
    f"WITH {SETTINGS_SQL} SELECT path, selected_value, rk[2] AS selected_source, candidates, distinct_values FROM w",
)
def setting_winners(spark, folder):
    out = settings.winners(_settings(spark, folder))
    return out.select(F.array_join("path", "/").alias("path"), "selected_value", "selected_source", "candidates", "distinct_values")


@query(
    "setting_conflicts",
    f"""WITH {SETTINGS_SQL}, o AS (SELECT array_to_string(path, '/') AS path, value, max((priority, source)) AS r2 FROM s GROUP BY ALL)
    SELECT o.path, selected_value, rk[2] AS selected_source, value AS other_value, r2[2] AS other_source, CASE WHEN r2[1] <> rk[1] THEN 'higher-confidence artifact' ELSE 'newer artifact of equal confidence' END AS resolution FROM o JOIN w ON w.path = o.path WHERE value <> selected_value""",
)
def setting_conflicts(spark, folder):
    return settings.conflicts(_settings(spark, folder)).withColumn("path", F.array_join("path", "/"))


@query(
    "setting_prefixes",
    f"""WITH {SETTINGS_SQL}, p AS (SELECT DISTINCT path FROM s) SELECT array_to_string(a.path, '/') AS shorter, array_to_string(b.path, '/') AS longer FROM p a JOIN p b ON len(a.path) < len(b.path) AND b.path[1:len(a.path)] = a.path""",
)
def setting_prefixes(spark, folder):
    out = settings.prefix_collisions(_settings(spark, folder))
    return out.select(F.array_join("shorter", "/").alias("shorter"), F.array_join("longer", "/").alias("longer"))


@query(
    "resolved_settings",
    f"""WITH {SETTINGS_SQL}, pw AS (SELECT path, arg_max(value, (priority, source)) AS v, max((priority, source)) AS rk FROM s GROUP BY path),
    l AS (SELECT CASE WHEN a.rk >= b.rk THEN b.path ELSE a.path END AS path FROM pw a JOIN pw b ON len(a.path) < len(b.path) AND b.path[1:len(a.path)] = a.path)
    SELECT array_to_string(path, '/') AS path, v AS selected_value FROM pw WHERE path NOT IN (SELECT path FROM l)""",
)
def resolved_settings(spark, folder):
    return settings.resolved(_settings(spark, folder)).select(F.array_join("path", "/").alias("path"), "selected_value")


@query(
    "values_in_order",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, array_to_string(list(event_type ORDER BY o), ',') AS values_in_order FROM f GROUP BY user_id""",
)
def values_in_order(spark, folder):
    return settings.distinct_in_order(table(spark, folder, "events"), ["user_id"], "event_type", "event_id")


@query(
    "tried_values",
    """WITH f AS (SELECT source, value, min(doc_id) AS o FROM (SELECT source, lang AS value, doc_id FROM documents) GROUP BY ALL) SELECT 'lang' AS setting, source, array_to_string(list(value ORDER BY o), ',') AS value, 40 AS priority FROM f GROUP BY source""",
)
def tried_values(spark, folder):
    """Settings recovered from a trial table: values tried, in order."""
    d = table(spark, folder, "documents").select("doc_id", "lang", F.col("source").alias("source_file"), F.lit("2024-01-01").cast("timestamp").alias("mtime"))
    out = artifacts.trial_settings(d, ["lang"], order="doc_id")
    return out.select(F.col("path")[2].alias("setting"), "source", "value", "priority")


@query(
    "stated_settings",
    """SELECT 'event' || CAST(event_id AS VARCHAR) AS source, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, 35 AS priority FROM events WHERE event_type = 'view'""",
)
def stated_settings(spark, folder):
    """Settings stated by JSON documents of one kind."""
    files = table(spark, folder, "events").select(
        F.concat(F.lit("event"), F.col("event_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("mtime"),
        F.col("props").alias("text"), "event_type",
    )
    out = artifacts.extract(files, F.col("event_type") == "view", ["points", "generate"], {"count": "k", "absent": "zz"}, 35)
    return out.select("source", "value", "priority")


@query(
    "filled_settings",
    """WITH st AS (SELECT c_mktsegment AS location, c_nationkey AS name, max(c_custkey) AS value FROM customer WHERE c_nationkey % 2 = 0 OR c_mktsegment <> 'BUILDING' GROUP BY ALL),
    cm AS (SELECT DISTINCT c_mktsegment AS location, c_nationkey AS name FROM customer), al AS (SELECT 'BUILDING' AS location, 0 AS ordinal, 'MACHINERY' AS other UNION ALL SELECT 'BUILDING', 1, 'FURNITURE'),
    b AS (SELECT cm.location, cm.name, arg_min(s2.value, ordinal) AS bv, arg_min(other, ordinal) AS bf FROM cm LEFT JOIN st ON st.location = cm.location AND st.name = cm.name JOIN al ON al.location = cm.location JOIN st s2 ON s2.location = al.other AND s2.name = cm.name WHERE st.value IS NULL GROUP BY ALL)
    SELECT cm.location, cm.name, coalesce(st.value, bv) AS value, bf AS borrowed_from FROM cm LEFT JOIN st ON st.location = cm.location AND st.name = cm.name LEFT JOIN b ON b.location = cm.location AND b.name = cm.name""",
)
def filled_settings(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("location"), F.col("c_nationkey").alias("name"), "c_custkey")
    known = c.where("name % 2 = 0 OR location != 'BUILDING'").groupBy("location", "name").agg(F.max("c_custkey").alias("value"))
    other = spark.createDataFrame([("BUILDING", 0, "MACHINERY"), ("BUILDING", 1, "FURNITURE")], "location string, ordinal int, other string")
    return settings.fill_from_alternatives(known, c.select("location", "name").distinct(), other)


@query(
    "metrics_sources",
    """WITH c AS (SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 END AS o, max(event_id) AS e FROM events GROUP BY ALL) SELECT user_id, arg_min(e, o) AS path FROM c WHERE o IS NOT NULL AND o < 3 GROUP BY user_id""",
)
def metrics_sources(spark, folder):
    kind = (
        F.when(F.col("event_type") == "click", "fit_dir").when(F.col("event_type") == "view", "best_model").when(F.col("event_type") == "error", "nonpassive_fallback")
    )
    e = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("path"))
    out = settings.metrics_source(e.withColumn("kind", kind).withColumn("exists", F.lit(True)), ["user_id"])
    return out.select("user_id", "path")


@query(
    "first_existing_inventory",
    """WITH p AS (SELECT o_custkey AS k, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders) SELECT k, arg_min(path, ordinal) AS path, min(ordinal) AS ordinal FROM p WHERE path IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) GROUP BY k""",
)
def first_existing_inventory(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("path"))
    pointers = ordered.number_rows(o, ["k"], ["path"], ordered.index_chunk(F.col("path")), "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
    existing = table(spark, folder, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("path"))
    return settings.first_existing(pointers, existing, ["k"], "path", "ordinal")


# --- logs ----------------------------------------------------------------------------

SESSION_SQL = """
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
l AS (SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM o WINDOW w AS (PARTITION BY user_id ORDER BY line)),
x AS (SELECT *, sum(CASE WHEN pv IS NULL OR pt <> event_type OR value <= pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line) AS session FROM l),
solves AS (SELECT user_id AS log, CAST(session AS BIGINT) AS solve_index, count(*) AS newton_iterations, sum(CAST(floor(value) AS BIGINT)) AS total_krylov_iterations, max(CAST(floor(value) AS BIGINT)) AS max_krylov, arg_max(value, line) AS final_residual, min(line) AS start_line, max(line) AS end_line, any_value(event_type) AS label FROM x GROUP BY ALL)"""


def _sessions(spark, folder):
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return solverlogs.sessions(e, ["user_id"], ["ts", "event_id"], ordered.time_chunk(F.col("ts")), "event_type", "value", "solve_index")


@query("solve_sessions", f"WITH {SESSION_SQL} SELECT event_id, CAST(session AS BIGINT) AS solve_index FROM x")
def solve_sessions(spark, folder):
    return _sessions(spark, folder).select("event_id", "solve_index")


def _solves(spark, folder):
    s = _sessions(spark, folder).select(
        F.col("user_id").alias("log"), "solve_index", F.col("event_id").alias("line_number"), F.col("event_id").alias("iteration"),
        F.floor("value").cast("long").alias("krylov_iterations"), F.col("value").alias("kcl_residual_a"), F.col("value").alias("krylov_residual"),
        (F.col("event_id") % 3 == 0).alias("rebuilt"), "event_type",
    )
    return s, solverlogs.solve_summary(s)


@query(
    "solve_summaries",
    f"WITH {SESSION_SQL} SELECT log, solve_index, newton_iterations, CAST(total_krylov_iterations AS BIGINT) AS total_krylov_iterations, max_krylov AS max_krylov_in_newton_step, final_residual AS final_krylov_residual FROM solves",
)
def solve_summaries(spark, folder):
    _, s = _solves(spark, folder)
    return s.select("log", "solve_index", "newton_iterations", "total_krylov_iterations", "max_krylov_in_newton_step", "final_krylov_residual")


LOG_SQL = SESSION_SQL + """, logs AS (SELECT log, count(*) AS solve_count, CAST(sum(newton_iterations) AS BIGINT) AS total_newton_iterations, CAST(sum(total_krylov_iterations) AS BIGINT) AS total_krylov_iterations, avg(total_krylov_iterations) AS mean_krylov_per_solve,
  quantile_cont(total_krylov_iterations, 0.5) AS median_krylov_per_solve, quantile_disc(total_krylov_iterations, 0.95) AS p95, max(total_krylov_iterations) AS mx, arg_min(solve_index, (-total_krylov_iterations, solve_index)) AS mi FROM solves GROUP BY log)"""


@query(
    "log_summaries",
    f"WITH {LOG_SQL} SELECT log, solve_count, total_newton_iterations, total_krylov_iterations, round(mean_krylov_per_solve, 6) AS mean_krylov_per_solve, round(median_krylov_per_solve, 6) AS median_krylov_per_solve, CAST(p95 AS DOUBLE) AS p95_krylov_per_solve, CAST(mx AS BIGINT) AS max_krylov_per_solve, mi AS max_krylov_solve_index FROM logs",
)
def log_summaries(spark, folder):
    _, s = _solves(spark, folder)
    out = solverlogs.log_summary(s)
    return out.select(
        "log", "solve_count", "total_newton_iterations", "total_krylov_iterations", r("mean_krylov_per_solve").alias("mean_krylov_per_solve"),
        r("median_krylov_per_solve").alias("median_krylov_per_solve"), F.col("p95_krylov_per_solve").cast("double").alias("p95_krylov_per_solve"), "max_krylov_per_solve", "max_krylov_solve_index",
    )


@query(
    "logs_against_first",
    f"""WITH {LOG_SQL}, b AS (SELECT * FROM logs ORDER BY log LIMIT 1) SELECT l.log, round(100 * (l.total_newton_iterations / b.total_newton_iterations - 1), 4) AS newton_change, round(100 * (l.mean_krylov_per_solve / b.mean_krylov_per_solve - 1), 4) AS krylov_change, l.solve_count - b.solve_count AS solve_count_difference FROM logs l, b""",
)
def logs_against_first(spark, folder):
    _, s = _solves(spark, folder)
    out = solverlogs.against_first(solverlogs.log_summary(s), "log", ["total_newton_iterations", "mean_krylov_per_solve"])
    return out.select(
        "log", r("total_newton_iterations_change_pct", 4).alias("newton_change"), r("mean_krylov_per_solve_change_pct", 4).alias("krylov_change"), "solve_count_difference"
    )


@query(
    "work_by_label",
    f"WITH {SESSION_SQL} SELECT log, label, count(*) AS solves, CAST(sum(total_krylov_iterations) AS BIGINT) AS krylov_iterations, round(avg(total_krylov_iterations), 6) AS krylov_per_solve FROM solves GROUP BY log, label",
)
def work_by_label(spark, folder):
    rows, s = _solves(spark, folder)
    named = s.join(rows.groupBy("log", "solve_index").agg(F.first("event_type").alias("label")), ["log", "solve_index"])
    out = solverlogs.frequency_summary(named, ("log", "label"))
    return out.select("log", "label", "solves", "krylov_iterations", r("krylov_per_solve").alias("krylov_per_solve"))


@query(
    "heaviest_solves",
    f"WITH {SESSION_SQL} SELECT log, solve_index, CAST(total_krylov_iterations AS BIGINT) AS total_krylov_iterations FROM solves ORDER BY total_krylov_iterations DESC, log, solve_index LIMIT 12",
)
def heaviest_solves(spark, folder):
    _, s = _solves(spark, folder)
    return solverlogs.heaviest_solves(s).select("log", "solve_index", "total_krylov_iterations")


@query(
    "run_timings",
    """WITH t AS (SELECT user_id AS log, event_id, value, CASE WHEN event_type = 'click' THEN 140 ELSE 30 END AS score FROM events WHERE event_type IN ('click', 'view')) SELECT log, arg_max(value, (score, event_id)) AS wall_clock_seconds FROM t WHERE score >= 40 GROUP BY log""",
)
def run_timings(spark, folder):
    v = F.col("value").cast("string")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("Total elapsed time: "), v, F.lit(" sec"))).otherwise(F.concat(F.lit("x elapsed time: "), v, F.lit(" s")))
    lines = table(spark, folder, "events").where("event_type IN ('click', 'view')").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_number"), line.alias("line"))
    return solverlogs.run_timing(lines).select("log", "wall_clock_seconds")


LOG_TEXT_SQL = """
k AS (SELECT user_id AS log, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""


def _log_lines(spark, folder):
    """Each event as a piece of a solver log: a label line, a header and a row;
    errors add a failure line."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("log"), "event_id", "event_type", "value")
    pieces = F.array_compact(
        F.array(
            F.when(F.col("event_type") == "click", F.concat(F.lit("Frequency = "), F.floor("value").cast("string"), F.lit(" GHz"))),
            F.lit("Newton solver:      Linear solver:"),
            F.lit("Iter KCL residual Damp Iters Residual"),
            F.concat(F.lit("1 "), F.col("value").cast("string"), F.lit(" mA 100.0 "), F.floor("value").cast("string"), F.lit(" 1.0e-3")),
            F.when(F.col("event_type") == "error", F.lit("Analysis failed to converge")),
        )
    )
    return e.select("log", F.posexplode(pieces).alias("i", "line"), "event_id").select(
        "log", (F.col("event_id") * 10 + F.col("i")).alias("line_number"), "line"
    )


@query(
    "parsed_solver_logs",
    f"""WITH {LOG_TEXT_SQL} SELECT log, n AS solve_index, CAST(floor(value) AS BIGINT) AS total_krylov_iterations, round(value * 1e-3, 9) AS final_kcl_residual_a,
      round(last_value(CASE WHEN event_type = 'click' THEN floor(value) * 1e9 END IGNORE NULLS) OVER (PARTITION BY log ORDER BY n), 1) AS frequency_hz, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS warning_count FROM k""",
)
def parsed_solver_logs(spark, folder):
    """Log text to solves: every event becomes one solve of one row."""
    _, solves, _ = solverlogs.parse_logs(_log_lines(spark, folder))
    return solves.select("log", "solve_index", "total_krylov_iterations", r("final_kcl_residual_a", 9).alias("final_kcl_residual_a"), r("frequency_hz", 1).alias("frequency_hz"), "warning_count")


@query(
    "failure_lines",
    """SELECT count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'view') AS retries FROM events""",
)
def failure_lines(spark, folder):
    line = F.when(F.col("event_type") == "error", "solver FAILED to converge").when(F.col("event_type") == "view", "using source  stepping").otherwise("ok")
    e = table(spark, folder, "events").select(line.alias("line"))
    return e.agg(
        F.count_if(logtext.any_of(F.col("line"), [logtext.FAILURE])).alias("failures"), F.count_if(logtext.any_of(F.col("line"), [logtext.RETRY])).alias("retries")
    )


@query(
    "solver_messages",
    """SELECT user_id AS log, count(*) AS messages FROM events WHERE event_type = 'error' GROUP BY user_id""",
)
def solver_messages(spark, folder):
    _, _, notes = solverlogs.parse_logs(_log_lines(spark, folder))
    return solverlogs.message_table(notes).groupBy("log").agg(F.count("*").alias("messages"))
