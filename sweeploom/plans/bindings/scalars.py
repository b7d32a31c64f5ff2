"""Units, labels, names and other scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels, logtext, scores, units
from ...operators import coverage
from ...sources import tabular
from .base import SIGMA_SQL, query, r, table, two_port

TOKEN_SQL = """
t AS (SELECT o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN ' MM' WHEN 3 THEN 'um' WHEN 4 THEN 'zz' ELSE '!' END AS suffix FROM orders)"""


def tokens(spark, folder):
    k = F.col("o_orderkey") % 6
    suffix = F.when(k == 0, "").when(k == 1, "k").when(k == 2, " MM").when(k == 3, "um").when(k == 4, "zz").otherwise("!")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.concat(cents.cast("string"), suffix).alias("token")
    )


@query(
    "unit_tokens",
    f"""WITH {TOKEN_SQL} SELECT o_orderkey,
      CASE WHEN suffix = '!' THEN NULL ELSE CAST(cents AS DOUBLE) END AS value,
      CASE WHEN suffix = '!' THEN NULL ELSE lower(trim(suffix)) END AS unit,
      round(CASE suffix WHEN '' THEN cents * 1.0 WHEN 'k' THEN cents * 1e3 WHEN ' MM' THEN cents * 1e-3 WHEN 'um' THEN cents * 1e-6 END, 8) AS si
      FROM t""",
)
def unit_tokens(spark, folder):
    token = F.col("token")
    return tokens(spark, folder).select(
        "o_orderkey",
        units.split_value(token)["value"].alias("value"),
        units.token_unit(token).alias("unit"),
        r(units.parse_si(token), 8).alias("si"),
    )


@query(
    "observed_values",
    f"""WITH {TOKEN_SQL} SELECT o_orderkey,
      round(CASE suffix WHEN '' THEN cents * CASE WHEN o_orderpriority LIKE '1%' THEN 1e-3 ELSE 1.0 END
        WHEN 'k' THEN cents * 1e3 WHEN ' MM' THEN cents * 1e-3 WHEN 'um' THEN cents * 1e-6 END, 8) AS observed
      FROM t""",
)
def observed_values(spark, folder):
    declared = F.when(F.col("o_orderpriority").startswith("1"), "mm").otherwise("")
    return tokens(spark, folder).select("o_orderkey", r(units.parse_observed(F.col("token"), declared), 8).alias("observed"))


@query(
    "quoted_tokens",
    """SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000 + CAST(p_partkey % 1000 AS DOUBLE) AS value FROM part""",
)
def quoted_tokens(spark, folder):
    text = F.concat(
        F.lit('"'), F.col("p_size").cast("string"), F.lit(","), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit('"')
    )
    return table(spark, folder, "part").select("p_partkey", units.token_number(units.strip_token(text)).alias("value"))


@query(
    "unit_cube",
    """WITH b AS (SELECT *, (p_retailprice - 900) / (1100 - 900) AS u_lin, (ln(p_retailprice) - ln(900.0)) / (ln(1100.0) - ln(900.0)) AS u_log FROM part)
    SELECT p_partkey, round(u_lin, 9) AS u_lin, round(u_log, 9) AS u_log,
      (u_lin BETWEEN -1e-9 AND 1 + 1e-9 AND u_log BETWEEN -1e-9 AND 1 + 1e-9) AS inside,
      round(exp(ln(900.0) + least(1.0, greatest(0.0, u_log)) * (ln(1100.0) - ln(900.0))), 6) AS back FROM b""",
)
def unit_cube(spark, folder):
    lo, hi = F.lit(900.0), F.lit(1100.0)
    price = F.col("p_retailprice")
    lin, log = units.to_unit(price, lo, hi, F.lit("linear")), units.to_unit(price, lo, hi, F.lit("log"))
    clamped = units.clamp_unit(F.array("a", "b"))
    return (
        table(spark, folder, "part")
        .select("p_partkey", lin.alias("a"), log.alias("b"))
        .select(
            "p_partkey",
            r("a", 9).alias("u_lin"),
            r("b", 9).alias("u_log"),
            units.in_unit_cube(F.array("a", "b")).alias("inside"),
            r(units.from_unit(clamped[1], lo, hi, F.lit("log"))).alias("back"),
        )
    )


GRID_SQL = """
g AS (SELECT *, least(900::DOUBLE, greatest(10::DOUBLE, round_even(l_extendedprice / 1000.0 * 10.0, 0))) AS i,
        least(500::DOUBLE, greatest(0::DOUBLE, round_even(l_discount / 0.001 * 1.0, 0))) AS j FROM lineitem),
k AS (SELECT *, regexp_replace(printf('%.1f', i / 10.0), '\\.?0+$', '') || 'k' AS price_key,
        CAST(CAST(j AS BIGINT) AS VARCHAR) || 'mm' AS discount_key FROM g)"""


def keyed_lines(df):
    price = units.round_to_grid(F.col("l_extendedprice"), F.lit(1000.0), F.lit(90000.0), F.lit(1000.0), 1)
    disc = units.round_to_grid(F.col("l_discount"), F.lit(0.0), F.lit(0.5), F.lit(0.001), 0)
    return df.withColumn("rounded", price).withColumn(
        "price_key", units.format_fixed(F.col("rounded"), F.lit("k"), F.lit(1000.0), 1)
    ).withColumn("discount_key", units.format_fixed(disc, F.lit("mm"), F.lit(0.001), 0))


@query(
    "geometry_keys",
    f"""WITH {GRID_SQL} SELECT price_key, discount_key, count(*) AS points, round(min(i / 10.0 * 1000.0), 4) AS rounded FROM k GROUP BY ALL""",
)
def geometry_keys(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_discount")
    keyed = keyed_lines(lines).withColumn("key", units.identity_key([F.col("price_key"), F.col("discount_key")]))
    return keyed.groupBy("key").agg(F.count("*").alias("points"), r(F.min("rounded"), 4).alias("rounded")).select(
        F.col("key")[0].alias("price_key"), F.col("key")[1].alias("discount_key"), "points", "rounded"
    )


@query(
    "significant_digits",
    """SELECT c_custkey, printf('%.12g', c_acctbal / 7.0) || 'k' AS shown, round(CAST(printf('%.12g', c_acctbal / 7.0) AS DOUBLE), 8) AS stored FROM customer""",
)
def significant_digits(spark, folder):
    v = F.col("c_acctbal") / 7.0
    return table(spark, folder, "customer").select(
        "c_custkey",
        units.format_significant(v, F.lit("k"), F.lit(1.0)).alias("shown"),
        r(units.metadata_number(v), 8).alias("stored"),
    )


WORDS = ["train", "Training ", "targeted", "verify", "TEST", "validation", "new", "other"]
WORDS_SQL = "['train','Training ','targeted','verify','TEST','validation','new','other'][(doc_id % 8) + 1]"


def _word(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


@query(
    "dataset_labels",
    f"""WITH w AS (SELECT doc_id, lower(trim({WORDS_SQL})) AS w FROM documents)
    SELECT CASE WHEN w IN ('train','training','targeted','additional','added','new','acquisition') THEN 'train'
      WHEN w IN ('verification','verify','validation','test') THEN 'verification' END AS label, count(*) AS docs FROM w GROUP BY ALL""",
)
def dataset_labels(spark, folder):
    docs = table(spark, folder, "documents").select(labels.dataset_label(_word(WORDS, "doc_id"), strict=False).alias("label"))
    return docs.groupBy("label").agg(F.count("*").alias("docs"))


STEMS = ["round_2_training_geometries", "points-train", "points_verify", "my.verification.set", "plain", "training_test", "train_points", "test"]
STEMS_SQL = "['round_2_training_geometries','points-train','points_verify','my.verification.set','plain','training_test','train_points','test']"


@query(
    "file_roles",
    f"""WITH s AS (SELECT page_id, {STEMS_SQL}[(page_id % 8) + 1] AS stem FROM pages),
    w AS (SELECT page_id, stem, list_filter(string_split_regex(lower(stem), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM s),
    f AS (SELECT *, list_contains(ws, 'training') OR ws[-1] = 'train' AS tr, list_contains(ws, 'verification') OR ws[-1] IN ('verify','validation','test') AS ve FROM w)
    SELECT page_id, CASE WHEN tr AND ve THEN 'both' WHEN tr THEN 'training' WHEN ve THEN 'verification' END AS role FROM f""",
)
def file_roles(spark, folder):
    return table(spark, folder, "pages").select("page_id", labels.file_role(_word(STEMS, "page_id"), strict=False).alias("role"))


@query(
    "coverage_groups",
    """WITH e AS (SELECT event_id, ['additional','existing','','odd'][(event_id % 4) + 1] AS origin,
        ['train','verification','targeted'][(event_id % 3) + 1] AS dataset, ['lhs','gp_ucb_mean','targeted_x','halton','x'][(event_id % 5) + 1] AS method FROM events),
    s AS (SELECT *, CASE WHEN dataset = 'verification' THEN 'verification' ELSE 'training' END AS split FROM e)
    SELECT CASE WHEN origin = 'additional' THEN 'additional_' || split WHEN origin = 'existing' THEN split
      WHEN dataset = 'targeted' THEN 'additional_training' WHEN split <> 'training' THEN split
      WHEN method LIKE 'targeted\\_%' ESCAPE '\\' OR method LIKE 'gp\\_ucb\\_%' ESCAPE '\\' THEN 'additional_training' ELSE 'training' END AS coverage_group,
      count(*) AS points FROM s GROUP BY ALL""",
)
def coverage_groups(spark, folder):
    e = table(spark, folder, "events").select("event_id")
    group = labels.coverage_group(
        _word(["additional", "existing", "", "odd"], "event_id"),
        _word(["train", "verification", "targeted"], "event_id"),
        _word(["lhs", "gp_ucb_mean", "targeted_x", "halton", "x"], "event_id"),
    )
    return e.select(group.alias("coverage_group")).groupBy("coverage_group").agg(F.count("*").alias("points"))


@query(
    "normalised_names",
    """WITH n AS (SELECT p_partkey, '  ' || p_brand || ' / ' || p_name || '--' AS raw FROM part)
    SELECT p_partkey, lower(regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name_key FROM n""",
)
def normalised_names(spark, folder):
    raw = F.concat(F.lit("  "), "p_brand", F.lit(" / "), "p_name", F.lit("--"))
    return table(spark, folder, "part").select("p_partkey", labels.normal_key(raw).alias("name_key"))


@query(
    "parameter_lookup",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS width, p_type AS kind, NULL::VARCHAR AS absent FROM part""",
)
def parameter_lookup(spark, folder):
    params = F.create_map(F.lit("Line Width"), F.col("p_size").cast("string"), F.lit("KIND"), F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", params.alias("params")).select(
        "p_partkey",
        labels.map_get(F.col("params"), F.lit("line_width")).alias("width"),
        labels.map_get(F.col("params"), F.lit("kind")).alias("kind"),
        labels.map_get(F.col("params"), F.lit("height")).alias("absent"),
    )


@query(
    "frequency_features",
    """SELECT event_id, round(log10(greatest(value, 1.0)), 9) AS logged, value AS linear FROM events""",
)
def frequency_features(spark, folder):
    from ...functions.complexmath import frequency_features as features

    logged, linear = features(F.col("value"), "log-linear")
    return table(spark, folder, "events").select("event_id", r(logged, 9).alias("logged"), linear.alias("linear"))


@query(
    "metric_scores",
    """SELECT c_custkey, round(power(10.0, (c_acctbal / 200.0) / 20.0), 6) AS evm, round(abs(c_acctbal), 6) AS plain FROM customer""",
)
def metric_scores(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        r(scores.metric_score("evm_db", F.col("c_acctbal") / 200.0)).alias("evm"),
        r(scores.metric_score("rmse_abs", F.col("c_acctbal"))).alias("plain"),
    )


@query(
    "engineering_units",
    """WITH e AS (SELECT event_id, value, CAST(event_id % 4 AS INT) AS k FROM events)
    SELECT event_id,
      round(value * [1.0, 1e3, 1e6, 1e9][k + 1], 3) AS hz,
      round(CASE k WHEN 0 THEN value WHEN 1 THEN value + 30 WHEN 2 THEN CASE WHEN value > 0 THEN 10 * log10(value * 1e-3 / 1e-3) END ELSE CASE WHEN value > 0 THEN 10 * log10(value / 1e-3) END END, 6) AS dbm,
      round(value * [1.0, 1e-3, 1e-6, 1.0][k + 1], 12) AS amperes,
      round(CASE k WHEN 0 THEN 3600.0 + (event_id % 50 + 10) * 60 + 5 WHEN 1 THEN (event_id % 50 + 10) * 60.0 + 7 WHEN 2 THEN (event_id % 100) * 60.0 ELSE (event_id % 100) * 1e-3 END, 6) AS seconds
    FROM e""",
)
def engineering_units(spark, folder):
    k = F.col("event_id") % 4
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    minute = (F.col("event_id") % 50 + 10).cast("string")
    small = (F.col("event_id") % 100).cast("string")
    duration = (
        F.when(k == 0, F.concat(F.lit("1:"), minute, F.lit(":05")))
        .when(k == 1, F.concat(minute, F.lit(":07")))
        .when(k == 2, F.concat(small, F.lit(" min")))
        .otherwise(F.concat(small, F.lit("ms")))
    )
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        r(scores.frequency_hz(v, pick(["Hz", "kHz", "MHz", "GHz"])), 3).alias("hz"),
        r(scores.power_dbm(v, pick(["dBm", "dBW", "mW", "W"]))).alias("dbm"),
        r(scores.current_amperes(v, pick(["A", "mA", "µA", "odd"])), 12).alias("amperes"),
        r(scores.duration_seconds(duration)).alias("seconds"),
    )


@query(
    "percent_changes",
    """SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN CASE WHEN c_acctbal = 0 THEN 0.0 END
      ELSE round(100 * (c_acctbal / c_nationkey - 1), 4) END AS change FROM customer""",
)
def percent_changes(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", r(scores.percent_change(F.col("c_acctbal"), F.col("c_nationkey").cast("double")), 4).alias("change")
    )


@query(
    "csv_numbers",
    """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN value END AS number FROM events""",
)
def csv_numbers(spark, folder):
    text = F.col("value").cast("string")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, text).when(k == 1, F.concat(F.lit(" "), text)).when(k == 2, "nan").when(k == 3, "").otherwise("x1")
    return table(spark, folder, "events").select("event_id", units.csv_number(raw).alias("number"))


@query(
    "range_expansion",
    """WITH d AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand)
    SELECT p_brand, round((lo + hi) / 2 - (hi - lo) / 2 * 1.5, 6) AS lin_lo, round((lo + hi) / 2 + (hi - lo) / 2 * 1.5, 6) AS lin_hi,
      round(exp((ln(lo) + ln(hi)) / 2 - (ln(hi) - ln(lo)) / 2 * 1.5), 6) AS log_lo, round(exp((ln(lo) + ln(hi)) / 2 + (ln(hi) - ln(lo)) / 2 * 1.5), 6) AS log_hi FROM d""",
)
def range_expansion(spark, folder):
    d = table(spark, folder, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    lin = units.expand_range(F.col("lo"), F.col("hi"), F.lit("linear"), F.lit(1.5))
    log = units.expand_range(F.col("lo"), F.col("hi"), F.lit("log"), F.lit(1.5))
    return d.select(
        "p_brand",
        r(lin["lower"]).alias("lin_lo"),
        r(lin["upper"]).alias("lin_hi"),
        r(log["lower"]).alias("log_lo"),
        r(log["upper"]).alias("log_hi"),
    )


@query(
    "range_extension",
    """WITH d AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) % 3 AS k FROM part GROUP BY p_brand),
    n AS (SELECT *, CASE WHEN k = 0 THEN lo * 0.9 ELSE lo END AS nlo, CASE WHEN k = 1 THEN hi * 1.2 ELSE hi END AS nhi FROM d)
    SELECT p_brand, CASE k WHEN 0 THEN 'lower' WHEN 1 THEN 'upper' END AS side,
      round(CASE k WHEN 0 THEN nlo WHEN 1 THEN hi END, 6) AS slab_lower, round(CASE k WHEN 0 THEN lo WHEN 1 THEN nhi END, 6) AS slab_upper,
      round(CASE k WHEN 0 THEN (lo - nlo) / (hi - lo) WHEN 1 THEN (nhi - hi) / (hi - lo) END, 6) AS added_volume_ratio FROM n""",
)
def range_extension(spark, folder):
    d = table(spark, folder, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), (F.count("*") % 3).alias("k")
    )
    new_lo = F.when(F.col("k") == 0, F.col("lo") * 0.9).otherwise(F.col("lo"))
    new_hi = F.when(F.col("k") == 1, F.col("hi") * 1.2).otherwise(F.col("hi"))
    plan = units.extension_plan(F.col("lo"), F.col("hi"), new_lo, new_hi, F.lit("linear"))
    return d.select("p_brand", plan.alias("p")).select(
        "p_brand", "p.side", r("p.slab_lower").alias("slab_lower"), r("p.slab_upper").alias("slab_upper"),
        r("p.added_volume_ratio").alias("added_volume_ratio"),
    )


@query(
    "merged_domains",
    """SELECT p_brand AS name_key, min(p_retailprice) AS lower, max(p_retailprice) AS upper, count(DISTINCT CASE WHEN p_size > 25 THEN 'log' ELSE 'linear' END) > 1 AS scale_conflict
    FROM (SELECT replace(lower(p_brand), '#', '_') AS p_brand, p_retailprice, p_size FROM part) GROUP BY p_brand""",
)
def merged_domains(spark, folder):
    declared = table(spark, folder, "part").select(
        F.col("p_brand").alias("name"),
        F.col("p_retailprice").alias("lower"),
        F.col("p_retailprice").alias("upper"),
        F.lit("mm").alias("unit"),
        F.when(F.col("p_size") > 25, "log").otherwise("linear").alias("scale"),
    )
    return coverage.merge_domains(declared).select("name_key", "lower", "upper", "scale_conflict")


@query(
    "json_metrics",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::DOUBLE AS absent FROM events""",
)
def json_metrics(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", scores.nested_number(F.col("props"), "k").alias("k"), scores.nested_number(F.col("props"), "a.b").alias("absent")
    )


@query(
    "admittance",
    f"""WITH {SIGMA_SQL},
    d AS (SELECT *, (1+ar)*(1+dr) - ai*di - (br*cr - bi*ci) AS er, (1+ar)*di + ai*(1+dr) - (br*ci + bi*cr) AS ei FROM m),
    y AS (SELECT record_id, freq_idx, er, ei, -2*br AS nr, -2*bi AS ni,
      (1-ar)*(1+dr) + ai*di + br*cr - bi*ci AS pr, (1-ar)*di - ai*(1+dr) + br*ci + bi*cr AS pi FROM d)
    SELECT record_id, freq_idx, round((pr*er + pi*ei) / (50*(er*er+ei*ei)), 9) AS y11_re, round((pi*er - pr*ei) / (50*(er*er+ei*ei)), 9) AS y11_im,
      round((nr*er + ni*ei) / (50*(er*er+ei*ei)), 9) AS y12_re, round((ni*er - nr*ei) / (50*(er*er+ei*ei)), 9) AS y12_im FROM y""",
)
def admittance(spark, folder):
    from ...functions.complexmath import s_to_y_2x2

    y = s_to_y_2x2(F.col("matrix"))
    return two_port(spark, folder).withColumn("y", y).select(
        "record_id", "freq_idx",
        r(F.col("y")[0], 9).alias("y11_re"), r(F.col("y")[4], 9).alias("y11_im"),
        r(F.col("y")[1], 9).alias("y12_re"), r(F.col("y")[5], 9).alias("y12_im"),
    )


@query(
    "admittance_round_trip",
    f"""WITH {SIGMA_SQL} SELECT record_id, freq_idx, round(ar, 6) AS s11_re, round(bi, 6) AS s12_im, round(cr, 6) AS s21_re FROM m""",
)
def admittance_round_trip(spark, folder):
    """S to Y and back on Arrow batches of any port count."""
    from ...functions.complexmath import s_to_y, y_to_s

    back = two_port(spark, folder).withColumn("s", y_to_s(s_to_y(F.col("matrix"))))
    return back.select(
        "record_id", "freq_idx",
        r(F.col("s")[0]).alias("s11_re"), r(F.col("s")[5]).alias("s12_im"), r(F.col("s")[2]).alias("s21_re"),
    )


@query(
    "log_labels",
    """WITH e AS (SELECT event_id, value, CAST(event_id % 3 AS INT) AS k FROM events)
    SELECT event_id, round(CASE k WHEN 0 THEN value * 1e9 WHEN 2 THEN value * 1e6 END, 2) AS frequency_hz, CASE WHEN k = 1 THEN round(value + 30, 6) END AS power_dbm FROM e""",
)
def log_labels(spark, folder):
    """Frequency and power labels of log lines, a custom pattern tried first."""
    k = F.col("event_id") % 3
    v = F.col("value").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("Fundamental freq[1] = "), v, F.lit(" GHz")))
        .when(k == 1, F.concat(F.lit("Pin = "), v, F.lit(" dBW")))
        .otherwise(F.concat(F.lit("tone@"), v, F.lit("MHz")))
    )
    rows = table(spark, folder, "events").select("event_id", line.alias("line"))
    return rows.select(
        "event_id",
        r(logtext.line_frequency(F.col("line"), r"tone@([0-9.]+)(MHz)")["value"], 2).alias("frequency_hz"),
        r(logtext.line_power(F.col("line"))["value"]).alias("power_dbm"),
    )


@query(
    "newton_rows",
    """SELECT event_id, CAST(event_id % 9 + 1 AS INT) AS iteration, event_id % 4 = 0 AS rebuilt, round(value * 1e-3, 9) AS kcl, CAST(user_id AS INT) AS krylov, CAST(0.001 AS DOUBLE) AS residual
    FROM events WHERE event_id % 5 <> 0""",
)
def newton_rows(spark, folder):
    e = table(spark, folder, "events")
    star = F.when(F.col("event_id") % 4 == 0, "*").otherwise("")
    line = F.concat(
        (F.col("event_id") % 9 + 1).cast("string"), star, F.lit("  "), F.col("value").cast("string"), F.lit(" mA  100.0  "),
        F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, " end").otherwise("  1.0e-03"),
    )
    row = e.select("event_id", logtext.newton_row(line).alias("n")).where("n IS NOT NULL")
    return row.select(
        "event_id", "n.iteration", "n.rebuilt", r("n.kcl_residual_a", 9).alias("kcl"),
        F.col("n.krylov_iterations").alias("krylov"), F.col("n.krylov_residual").alias("residual"),
    )


@query(
    "timing_scores",
    """WITH e AS (SELECT event_id, value, CAST(event_id % 4 AS INT) AS k FROM events)
    SELECT event_id, CASE k WHEN 1 THEN 'cpu' WHEN 2 THEN 'simulation_stopwatch' ELSE 'wall' END AS kind, round(CASE k WHEN 1 THEN value * 60 ELSE value END, 6) AS seconds,
      CAST(CASE k WHEN 0 THEN 140 WHEN 1 THEN 40 WHEN 2 THEN 250 ELSE -50 END AS INT) AS score FROM e""",
)
def timing_scores(spark, folder):
    k = F.col("event_id") % 4
    v = F.col("value").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("Total elapsed time: "), v, F.lit(" seconds")))
        .when(k == 1, F.concat(F.lit("CPU time = "), v, F.lit(" min")))
        .when(k == 2, F.concat(F.lit("Simulation stopwatch time = "), v, F.lit(" s")))
        .otherwise(F.concat(F.lit("step 1 begin elapsed time = "), v, F.lit("s")))
    )
    rows = table(spark, folder, "events").select("event_id", F.explode(logtext.timing_samples(line)).alias("s"))
    wanted = F.when(k == 1, "cpu").when(k == 2, "simulation_stopwatch").otherwise("wall")
    best = rows.where(F.col("s.kind") == wanted).groupBy("event_id").agg(F.max(F.struct("s.score", "s.seconds", "s.kind")).alias("m"))
    return best.select("event_id", "m.kind", r("m.seconds").alias("seconds"), F.col("m.score").alias("score"))


@query(
    "companion_stems",
    """SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]+)$', 1), '\\.[^.]*$', '') AS stem FROM pages""",
)
def companion_stems(spark, folder):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, folder, "pages").select("page_id", tabular.stem(bare).alias("stem"))
