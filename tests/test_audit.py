import pytest
from pyspark.sql import functions as F

from sweeploom.plans.audit import audit

GRID = (0.0, 1e9, 2e9)


def tables(spark, blocks):
    """blocks: (kind, role, W, frequencies, transmission, s11 overrides)."""
    block, resp = [], []
    for k, (kind, role, w, freqs, t, override) in enumerate(blocks):
        block.append((f"r{k}", k, kind, role, f"{kind}.txt", k, {"W": w}, 50.0))
        for i, f in enumerate(freqs):
            for label, v in (("S11", override.get(i, 0.1)), ("S12", t), ("S21", t), ("S22", 0.1)):
                resp.append((f"r{k}", k, i, f, label, float(v), 0.0))
    b = spark.createDataFrame(
        block,
        "record_id string, ordinal long, dataset_kind string, role string, source_file string, source_index int, params map<string,string>, reference_impedance_ohm double",
    )
    r = spark.createDataFrame(resp, "record_id string, ordinal long, freq_idx int, freq_hz double, label string, re double, im double")
    return b, r


def run(spark, blocks, **options):
    out = audit(*tables(spark, blocks), ["W"], **options)
    return out["verdict"].first()["verdict"], {r["code"] for r in out["reasons"].collect()}, out


def test_pass(spark):
    verdict, codes, _ = run(
        spark,
        [("fine", "train", "1.0", GRID, 0.75, {}), ("fine", "train", "2.0", GRID, 0.74, {}), ("fine", "verification", "1.5", GRID, 0.72, {})],
    )
    assert (verdict, codes) == ("PASS", set())


def test_unlabelled_blocks_are_held_out_and_reported(spark):
    b, r = tables(spark, [("fine", None, f"{1 + k / 10}", GRID, 0.75, {}) for k in range(6)])
    out = audit(b.withColumn("split", F.lit(None).cast("string")), r, ["W"], split_label="split", holdout_fraction=0.34)
    reasons = {x["code"]: x for x in out["reasons"].collect()}
    assert "RANDOM_HOLDOUT_USED" in reasons and "UNASSIGNED_BLOCKS" not in reasons
    found = reasons["RANDOM_HOLDOUT_USED"]
    assert (found["count"], found["affected_examples"], found["additional_location_count"]) == (1, [], 0)
    assert found["recommendation"].startswith("Label the splits")


def test_fail(spark):
    verdict, codes, out = run(
        spark, [("fine", "train", "1.0", GRID, 0.75, {1: 1.2}), ("fine", "verification", "1.0", GRID, 0.45, {})]
    )
    assert verdict == "FAIL"
    assert {"RAW_NONPASSIVE_DATA", "TRAIN_VERIFICATION_OVERLAP", "DUPLICATE_GEOMETRY_RESPONSE_CONFLICT"} <= codes
    assert out["passivity"].first()["violating_points"] == 1


def test_warning(spark):
    verdict, codes, _ = run(
        spark,
        [("fine", "train", "1.0", GRID, 0.75, {}), ("fine", "train", "2.0", GRID, 0.75, {}), ("fine", "verification", "3.0", GRID[:2], 0.75, {})],
    )
    assert verdict == "WARNING"
    assert codes == {"INCONSISTENT_FREQUENCY_GRIDS", "VERIFICATION_OUTSIDE_TRAIN_RANGE"}


def test_units_and_coarse_range(spark):
    domain = spark.createDataFrame([("w", 100e-6, 500e-6, "um")], "name_key string, lower double, upper double, unit string")
    blocks = [("fine", "train", "150", GRID, 0.75, {}), ("fine", "train", "400", GRID, 0.75, {}), ("fine", "verification", "250", GRID, 0.75, {})]
    verdict, codes, out = run(spark, blocks, domain=domain)
    assert (verdict, codes) == ("PASS", set())
    assert out["interpretation"].first()["selected_interpretation"] == "parameter-units"
    mixed = [("fine", "train", "0.0", GRID, 0.75, {}), ("fine", "verification", "3.0", GRID, 0.75, {}), ("coarse", "train", "1.0", GRID, 0.75, {}), ("coarse", "train", "2.0", GRID, 0.75, {})]
    _, codes, _ = run(spark, mixed)
    assert "FINE_OUTSIDE_COARSE_TRAIN_RANGE" in codes


def test_structure_rules_read_the_samples_once(spark):
    from sweeploom.plans.bindings import audits

    plan = audits.structure_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_extendedprice" not in plan  # the tie-break of the samples: behind a checkpoint, not in each rule


def test_labelled_rows_of_the_audit_are_read_from_stored_samples(spark):
    """Four rows a sample are neither stored nor shuffled again by each rule."""
    from sweeploom.plans.bindings import audits, base

    folder = "/root/testdata/sf0.001"
    block, resp = audits.audit_tables(spark, folder)
    assert "Exchange" not in resp._jdf.queryExecution().executedPlan().toString()
    whole = base.response(spark, folder).drop("l_linestatus")
    assert resp.exceptAll(whole).isEmpty() and resp.count() == whole.count()
    assert block.count() == whole.select("record_id").distinct().count()
