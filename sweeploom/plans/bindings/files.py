"""Files and streams derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.units import parse_si
from ...operators import align
from ...session import scratch
from ...sources import sweepfiles, tabular, textlogs
from ...streaming import live
from .base import SAMPLES_SQL, query, r, samples, table
from .inventories import KEY, SESSION_SQL, _log_lines, _points


def _blocks(spark, folder):
    """Orders as sweep blocks with arrays, two labels."""
    s = samples(spark, folder)
    rows = s.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax", "l_quantity"))).alias("a"),
        F.min("l_suppkey").alias("k"),
    )
    return rows.select(
        F.col("l_orderkey").cast("string").alias("record_id"),
        F.create_map(F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("W"), F.concat(F.col("k").cast("string"), F.lit("um"))).alias("params"),
        F.lit(50.0).alias("reference_impedance_ohm"),
        F.transform("a", lambda x: x["l_linenumber"] * F.lit(1e9)).alias("freq_hz"),
        F.array(F.lit("S11"), F.lit("S21")).alias("labels"),
        F.transform("a", lambda x: F.array(x["l_discount"], x["l_quantity"])).alias("re"),
        F.transform("a", lambda x: F.array(x["l_tax"], x["l_discount"])).alias("im"),
    )


def _written(spark, folder):
    path = scratch(spark, "sweeps")
    tabular.write_blocks(sweepfiles.block_text(_blocks(spark, folder)), path)
    return path


@query(
    "sweep_file_round_trip",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, CAST(l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) + 1 >= 1 AS BOOLEAN) AS ok, l_linenumber * 1e9 AS freq_hz, l_discount AS s11_re, l_tax AS s11_im, l_quantity AS s21_re FROM samples""",
)
def sweep_file_round_trip(spark, folder):
    """Block text written by one job and read back in splits by another."""
    blocks = sweepfiles.blocks(spark, _written(spark, folder))
    blocks = blocks.withColumn("l_orderkey", F.col("params")["order"].cast("long"))
    wide = sweepfiles.response(blocks, "l_orderkey").groupBy("record_id", "freq_idx").agg(
        F.first("l_orderkey").alias("l_orderkey"),
        F.first("freq_hz").alias("freq_hz"),
        F.max(F.when(F.col("label") == "S11", F.col("re"))).alias("s11_re"),
        F.max(F.when(F.col("label") == "S11", F.col("im"))).alias("s11_im"),
        F.max(F.when(F.col("label") == "S21", F.col("re"))).alias("s21_re"),
    )
    return wide.select("l_orderkey", (F.col("freq_idx") >= 0).alias("ok"), "freq_hz", "s11_re", "s11_im", "s21_re")


@query(
    "parameter_only_scan",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, round(min(l_suppkey) * 1e-6, 12) AS w, 'RI' AS data_format, 'Hz' AS frequency_unit, 50.0::DOUBLE AS reference_impedance_ohm FROM samples GROUP BY l_orderkey""",
)
def parameter_only_scan(spark, folder):
    """Parameters and header of each block without its values."""
    blocks = sweepfiles.blocks(spark, _written(spark, folder), with_values=False)
    return blocks.select(
        F.col("params")["order"].cast("long").alias("l_orderkey"), r(parse_si(F.col("params")["W"]), 12).alias("w"),
        "data_format", "frequency_unit", "reference_impedance_ohm",
    )


@query("common_numeric_parameters", "SELECT 'W' AS parameter UNION ALL SELECT 'order'")
def common_numeric_parameters(spark, folder):
    """Parameters that are numeric in every block."""
    return align.numeric_parameters(_blocks(spark, folder))


LINES_SQL = """
lines AS (
  SELECT 'Frequency = ' || CAST(floor(value) AS BIGINT) || ' GHz' AS line FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'Newton solver:      Linear solver:' FROM events
  UNION ALL SELECT 'Iter KCL residual Damp Iters Residual' FROM events
  UNION ALL SELECT '1 mA 100.0 ' || CAST(floor(value) AS BIGINT) || ' 1.0e-3' FROM events
  UNION ALL SELECT 'Analysis failed to converge' FROM events WHERE event_type = 'error')"""


@query(
    "log_file_lines",
    f"""WITH {LINES_SQL} SELECT charset, line, CAST(count(*) AS BIGINT) AS times, TRUE AS numbered
    FROM lines, (VALUES ('UTF-8'), ('UTF-16LE'), ('UTF-16BE')) AS c(charset) GROUP BY charset, line""",
)
def log_file_lines(spark, folder):
    """Log text written in three encodings and read back in splits with line numbers."""
    lines = _log_lines(spark, folder).select(F.regexp_replace("line", r"^1 \S+ mA", "1 mA").alias("line"))
    out = None
    for charset in ("UTF-8", "UTF-16LE", "UTF-16BE"):
        path = scratch(spark, "logs")
        # Lines without quotes and separators: the text sink itself knows UTF-8 only.
        lines.write.option("encoding", charset).option("sep", "\x01").option("quote", "").csv(path)
        back = textlogs.read_lines(spark, f"{path}/part-*", split_bytes=1 << 20).withColumn("charset", F.lit(charset))
        out = back if out is None else out.unionByName(back)
    # Distinct numbers by bitmaps of 32,768 numbers each: exact, and no task holds all numbers of a file.
    marks = out.groupBy("charset", "log", F.bitmap_bucket_number("line_number").alias("bucket")).agg(
        F.max("line_number").alias("top"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("line_number"))).alias("different")
    )
    whole = marks.groupBy("charset", "log").agg((F.max("top") == F.sum("different")).alias("numbered"))
    fine = whole.groupBy("charset").agg(F.every("numbered").alias("numbered"))
    counts = out.groupBy("charset", "line").agg(F.count("*").alias("times"))
    return counts.join(F.broadcast(fine), "charset")  # one row an encoding


@query(
    "csv_inventory",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'train' ELSE 'verification' END AS dataset, c_acctbal AS balance FROM customer",
)
def csv_inventory(spark, folder):
    """Inventory written as CSV text and read back as strings."""
    path = scratch(spark, "csv")
    c = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "train").otherwise("verification").alias("dataset"), "c_acctbal")
    c.write.option("header", True).csv(path)
    rows = tabular.read_csv(spark, path)
    return rows.select(F.col("c_custkey").cast("long").alias("c_custkey"), "dataset", F.col("c_acctbal").cast("double").alias("balance"))


@query(
    "split_views",
    "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'train' ELSE 'verification' END AS dataset, count(*) AS points FROM customer GROUP BY 1",
)
def split_views(spark, folder):
    path = scratch(spark, "views")
    c = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "train").otherwise("verification").alias("dataset"))
    tabular.write_split_views(c, path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("points"))


@query(
    "metadata_document",
    """SELECT 1 AS schema_version, count(*) AS total FROM lineitem""",
)
def metadata_document(spark, folder):
    """One-row metadata with ranges per brand, split counts and integrity, written as JSON and read back."""
    domain = table(spark, folder, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lower"), F.max("p_retailprice").alias("upper")).select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("ordinal"), F.col("p_brand").alias("name"), "lower", "upper", F.lit("mm").alias("unit"), F.lit("linear").alias("scale")
    )
    path = scratch(spark, "metadata")
    doc = tabular.metadata_document(_points(spark, folder), domain, KEY, "dataset", "points.csv")
    doc.write.json(path)
    back = spark.read.json(path)
    return back.select(F.col("schema_version").cast("int").alias("schema_version"), F.col("geometry_integrity.total").alias("total"))


@query(
    "declared_domains",
    "SELECT p_brand AS name, lower(replace(p_brand, '#', '_')) AS name_key, min(p_retailprice) AS lower, max(p_retailprice) AS upper, 1e-3 AS unit_scale FROM part GROUP BY p_brand",
)
def declared_domains(spark, folder):
    """Domain metadata written as JSON and read back with validated ranges."""
    domain = table(spark, folder, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lower"), F.max("p_retailprice").alias("upper")).select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("ordinal"), F.col("p_brand").alias("name"), "lower", "upper", F.lit("mm").alias("unit"), F.lit("linear").alias("scale")
    )
    path = scratch(spark, "domain")
    tabular.metadata_document(_points(spark, folder), domain, KEY, "dataset", "points.csv").write.json(path)
    back = tabular.read_domain(spark, path)
    bad = tabular.domain_problems(back).select("name").distinct()
    return back.join(bad, "name", "left_anti").select("name", "name_key", "lower", "upper", "unit_scale")


@query(
    "live_solve_sessions",
    f"WITH {SESSION_SQL} SELECT user_id AS log, event_id AS line_number, CAST(session AS BIGINT) AS session FROM x".replace("ORDER BY ts, event_id", "ORDER BY event_id").replace(
        "value <= pv", "floor(value) <= floor(pv)"
    ),
)
def live_solve_sessions(spark, folder):
    """The session rule as a stateful stream over the event files."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    rows = stream.select(
        F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("line_number"), F.col("event_type").alias("label"),
        F.floor("value").cast("long").alias("counter"),
    )
    out, state = scratch(spark, "sessions"), scratch(spark, "state")
    job = (
        live.live_sessions(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.parquet(out).select(F.col("log").cast("long").alias("log"), "line_number", "session")


def _arriving(spark, parts):
    """Tables written one after another as the files of a stream, one file a batch."""
    path = scratch(spark, "arriving")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "live_late_rows",
    """WITH h AS (SELECT user_id, max(event_id) FILTER (event_id % 3 > 0) AS seen FROM events GROUP BY user_id)
    SELECT user_id AS log, count(*) AS rows, count(*) FILTER (event_id % 3 = 0 AND event_id <= seen) AS late FROM events JOIN h USING (user_id) GROUP BY user_id""",
)
def live_late_rows(spark, folder):
    """A third of the events comes in a second batch; what lies behind its log by then is marked late."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("line_number"), F.col("event_type").alias("label"),
        F.floor("value").cast("long").alias("counter"),
    )
    stream = _arriving(spark, [rows.where("line_number % 3 > 0"), rows.where("line_number % 3 = 0")])
    out = scratch(spark, "sessions")
    job = (
        live.live_sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state"))
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    found = spark.read.parquet(out).groupBy(F.col("log").cast("long").alias("log"))
    return found.agg(F.count("*").alias("rows"), F.count_if("late").alias("late"))


@query(
    "incremental_audit",
    """SELECT 'NEGATIVE_VALUE' AS code, count(*) FILTER (value < 5) + count(*) FILTER (value < 5 AND event_id % 3 = 0) + count(*) FILTER (value < 5 AND event_id % 4 = 0) AS blocks FROM events
    UNION ALL SELECT 'DUPLICATE_GEOMETRY', count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 4 = 0) FROM events""",
)
def incremental_audit(spark, folder):
    """Arriving blocks audited per micro-batch; copies come inside a batch and over batches."""
    e = table(spark, folder, "events").select("event_id", "value")
    stream = _arriving(spark, [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").unionByName(e.where("event_id % 3 = 0")), e.where("event_id % 4 = 0")])

    def rules(blocks):
        return blocks.where("value < 5").select("event_id", F.lit("NEGATIVE_VALUE").alias("code"))

    issues, copies = scratch(spark, "issues"), scratch(spark, "copies")
    for writer in live.incremental_audit(stream, rules, ["event_id"], issues, copies, scratch(spark, "state")):
        writer.trigger(availableNow=True).start().awaitTermination()
    return live.issue_counts(spark, issues, copies, ["event_id"])
