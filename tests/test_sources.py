import json

import pytest
import math

from pyspark.sql import functions as F

from sweeploom.operators import settings
from sweeploom.sources import artifacts, sweepfiles, tabular, textlogs

TEXT = """! comment
VAR dataset=train
VAR W = 0.40mm
BEGIN ACDATA
VAR L "1.2mm"
% Freq S11 S21
# GHz S MA R 75
0 0.5 0 0.5 90   ! note
1.5 0.25 180 1.0 -90
END

VAR dataset=verification
BEGIN ACDATA
% Freq S11R S11I S21R S21I
# Hz S DB R 50
1e9 0 0
-20 0
END
"""


def test_sweep_blocks_headers_and_sticky_values(spark, tmp_path):
    (tmp_path / "a.mdif").write_text(TEXT)
    blocks = {b["source_index"]: b for b in sweepfiles.blocks(spark, str(tmp_path)).collect()}
    assert blocks[0]["params"] == {"dataset": "train", "W": "0.40mm", "L": "1.2mm"}
    # W stays in force, L was local to the first block.
    assert blocks[1]["params"] == {"dataset": "verification", "W": "0.40mm"}
    assert (blocks[0]["data_format"], blocks[0]["frequency_unit"], blocks[0]["reference_impedance_ohm"]) == ("MA", "GHz", 75.0)
    assert blocks[0]["freq_hz"] == [0.0, 1.5e9]
    assert math.isclose(blocks[0]["im"][0][1], 0.5) and math.isclose(blocks[0]["re"][1][0], -0.25)
    assert blocks[1]["labels"] == ["S11", "S21"]
    assert math.isclose(blocks[1]["re"][0][0], 1.0) and math.isclose(blocks[1]["re"][0][1], 0.1)


def test_many_files_and_response_rows(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.mdif").write_text(TEXT * 4)
    blocks = sweepfiles.with_ordinal(sweepfiles.blocks(spark, str(tmp_path)))
    assert sorted(r["ordinal"] for r in blocks.select("ordinal").collect()) == list(range(24))
    assert sweepfiles.response(blocks).count() == 3 * 4 * (4 + 2)


def test_sticky_values_cross_splits_and_one_parse_serves(spark, tmp_path):
    block = "BEGIN ACDATA\n% Freq S11\n# Hz S RI R 50\n0 0.5 0\nEND\n"
    text = "".join(f"VAR n={k}\n" + ("VAR seldom=%d\n" % k if k % 40 == 7 else "") + block.replace("ACDATA\n", f"ACDATA\nVAR own={k}\n") for k in range(200))
    for name in ("a", "b"):
        (tmp_path / f"{name}.mdif").write_text("VAR file=" + name + "\n" + text + "VAR late=1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        made = sweepfiles.blocks(spark, str(tmp_path))
        rows = made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("a", "b"):
        own = {r["source_index"]: r["params"] for r in rows if r["source_file"].endswith(f"{name}.mdif")}
        seldom = {k: {"seldom": str(40 * ((k - 7) // 40) + 7)} if k >= 7 else {} for k in range(200)}
        assert own == {k: {"file": name, "n": str(k), "own": str(k)} | seldom[k] for k in range(200)}
    # Blocks are not shuffled nor sorted to learn what is in force.
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_log_encodings(spark, tmp_path):
    for name, data in {
        "bom16": "a\nbé".encode("utf-16"),
        "plain16": "abc\ndef".encode("utf-16-le"),
        "bom8": b"\xef\xbb\xbfone\r\ntwo",
        "bytes": b"ok\n\xff",
    }.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    rows = textlogs.read_lines(spark, str(tmp_path)).collect()
    got = {}
    for row in rows:
        got.setdefault(row["log"].rsplit("/", 1)[1], {})[row["line_number"]] = row["line"]
    assert got["bom16.log"] == {1: "a", 2: "bé"}
    assert got["plain16.log"] == {1: "abc", 2: "def"}
    assert got["bom8.log"] == {1: "one", 2: "two"}
    assert got["bytes.log"][1] == "ok"


@pytest.mark.parametrize("charset", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"])
def test_logs_have_the_same_lines_in_any_encoding_and_split(spark, tmp_path, charset):
    lines = [f"line {i} é字\U0001f600 {'x' * (i % 90)}" for i in range(1, 301)] + ["", "\u0a0a\u0d0d\u0a00 no break", ""]
    text = "".join(line + ("\r\n", "\n", "\r")[i % 3] for i, line in enumerate(lines)) + "no end"
    want = [*enumerate([*lines, "no end"], 1)]
    (tmp_path / "a log.txt").write_bytes(text.encode(charset))
    for split in (64, 1_000, textlogs.SPLIT_BYTES):
        rows = textlogs.read_lines(spark, str(tmp_path), split_bytes=split).collect()
        assert sorted((r.line_number, r.line) for r in rows) == want


def test_odd_logs(spark, tmp_path):
    lone = "a\nb".encode("utf-16-le") + b"\x00\xd8" + "c".encode("utf-16-le")
    for name, data in {"empty": b"", "ends": b"a\n\n", "nul": b"a\x00b\n\x00\x00c", "lone": lone, "mark": b"\xff\xfe", "late": b"x" * 5_000 + b"\x00\n1"}.items():
        (tmp_path / f"{name}.log").write_bytes(data)
    got = {}
    for r in textlogs.read_lines(spark, str(tmp_path), split_bytes=4).collect():
        got.setdefault(r.log.rsplit("/", 1)[1].removesuffix(".log"), {})[r.line_number] = r.line
    assert got["ends"] == {1: "a", 2: ""} and "empty" not in got and "mark" not in got
    # An odd number of bytes is no UTF-16, nor are bytes with half of a surrogate pair.
    assert got["nul"] == {1: "a\x00b", 2: "\x00\x00c"}
    assert got["lone"][1] == "a\x00" and got["late"] == {1: "x" * 5_000 + "\x00", 2: "1"}


def test_domain_documents_and_companions(spark, tmp_path):
    doc = {
        "schema_version": 1,
        "geometry_file": "points.csv",
        "generation_kind": "generated",
        "parameters": [
            {"name": "Line W", "base_unit_range": [4e-4, 8e-4], "unit": "mm", "scale": "linear"},
            {"name": "L", "base_unit_range": [2.0, 1.0], "unit": "mm", "scale": "log"},
        ],
        "next_gp_existing_points": "all.csv",
    }
    (tmp_path / "points.json").write_text(json.dumps(doc))
    (tmp_path / "points.csv").write_text("W,dataset\n0.5mm,train\n")
    domain = tabular.read_domain(spark, str(tmp_path / "points.json"))
    assert domain.where("name_key = 'line_w'").first()["unit_scale"] == 1e-3
    assert {r["problem"] for r in tabular.domain_problems(domain).collect()} == {"empty range"}
    table = tabular.read_csv(spark, str(tmp_path / "points.csv"))
    assert table.columns[:2] == ["W", "dataset"]
    pair = tabular.companions(table, domain).first()
    assert pair["document_file"].endswith("points.json")
    pointers = tabular.inventory_pointers(spark, str(tmp_path / "points.json"))
    existing = spark.createDataFrame([("points.csv",)], "path string")
    chosen = settings.first_existing(pointers, existing, ["source_file"], "path", "ordinal").first()
    assert (chosen["path"], chosen["ordinal"]) == ("points.csv", 3)


def test_artifact_scan_and_settings(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "meta.json").write_text(json.dumps({"model_type": "direct", "activation": "tanh", "parameter_names": ["W", "L"]}))
    (tmp_path / "best.json").write_text(json.dumps({"config": {"activation": "relu"}, "selection_metric": "evm_db"}))
    (tmp_path / "x_report.md").write_text("text")
    files = artifacts.scan(spark, str(tmp_path))
    assert files.count() == 3
    found = {tuple(r["path"]): (r["value"], r["priority"]) for r in artifacts.settings(files).collect()}
    assert found[("models", "fit", "parameter_names")] == ("W,L", 30)
    assert found[("models", "optimize", "activation")] == ("relu", 50)
