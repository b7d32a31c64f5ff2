import pytest
from pyspark.sql import functions as F

from sweeploom.operators import ordered, solverlogs
from sweeploom.streaming import live


def test_live_sessions_over_batches_equal_the_batch_result(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = [("a" if i % 3 else "b", i, "x" if i < 12 else "y", i % 5) for i in range(30)]
    schema = "log string, line_number long, label string, counter long"
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(source / f"{k}"))
    job = (
        live.live_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source)))
        .writeStream.format("memory").queryName("live_sessions_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    job.processAllAvailable()
    job.stop()
    got = sorted(map(tuple, spark.table("live_sessions_out").select("log", "line_number", "session").collect()))
    df = spark.createDataFrame(rows, schema)
    want = solverlogs.sessions(df, ["log"], ["line_number"], ordered.index_chunk(F.col("line_number")), "label", "counter")
    assert got == sorted(map(tuple, want.select("log", "line_number", "session").collect()))


def test_incremental_audit_counts_copies_in_and_over_batches(spark, tmp_path):
    schema = "k long, bad boolean"
    source = tmp_path / "in"
    for rows in ([(1, False), (2, True), (1, False)], [(2, False), (3, False)], [(1, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    rules = lambda df: df.where("bad").select("k", F.lit("BAD").alias("code"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    issues, copies = str(tmp_path / "issues"), str(tmp_path / "copies")
    for writer in live.incremental_audit(stream, rules, ["k"], issues, copies, str(tmp_path / "cp")):
        writer.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in live.issue_counts(spark, issues, copies, ["k"]).collect()} == {("BAD", 2), ("DUPLICATE_GEOMETRY", 3)}
    by_batch = {(r.batch, r.k, r.copies) for r in spark.read.parquet(copies).collect()}
    assert by_batch == {(0, 1, 2), (1, 2, 2), (2, 1, 3)}


def test_late_rows_come_out_marked(spark, tmp_path):
    schema = "log string, line_number long, label string, counter long"
    for rows in ([("a", 1, "x", 1), ("a", 5, "x", 2)], [("a", 3, "x", 9), ("a", 6, "x", 3), ("b", 2, "x", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = live.live_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    job.trigger(availableNow=True).start().awaitTermination()
    got = {(r.log, r.line_number, r.session, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, 1, False), ("a", 5, 1, False), ("a", 3, None, True), ("a", 6, 1, False), ("b", 2, 1, False)}
