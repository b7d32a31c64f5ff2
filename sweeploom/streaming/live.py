"""Live solve sessions and incremental audits of arriving blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

STATE = StructType(
    [
        StructField("session", LongType()),
        StructField("label", StringType()),
        StructField("counter", LongType()),
        StructField("line_number", LongType()),
    ]
)
OUTPUT = StructType(
    [
        StructField("log", StringType()),
        StructField("line_number", LongType()),
        StructField("label", StringType()),
        StructField("counter", LongType()),
        StructField("session", LongType()),
        StructField("late", BooleanType()),
    ]
)


class SessionProcessor(StatefulProcessor):
    """Session number of each arriving row of a log.

    Rows are ordered inside a batch; a row that is not above the last line seen
    comes out as ``late``, without a session.  State is one small row per log.
    """

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, label, counter, seen = self.last.get() if self.last.exists() else (0, None, None, -1)
        frames = list(rows)
        batch = pd.concat(frames).sort_values("line_number") if frames else pd.DataFrame()
        out = []
        for line, new_label, new_counter in zip(batch["line_number"], batch["label"], batch["counter"]):
            if line <= seen:
                out.append((key[0], int(line), new_label, int(new_counter), None, True))
                continue
            if counter is None or new_label != label or new_counter <= counter:
                session += 1
            label, counter, seen = new_label, int(new_counter), int(line)
            out.append((key[0], seen, label, counter, session, False))
        self.last.update((session, label, counter, seen))
        made = pd.DataFrame(out, columns=["log", "line_number", "label", "counter", "session", "late"])
        yield made.astype({"session": "Int64", "late": bool})

    def close(self) -> None:
        pass


def live_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of a stream with ``log, line_number, label, counter``; rows that came too late are marked."""
    return rows.groupBy("log").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="none",
    )


def incremental_audit(
    stream: DataFrame,
    rules: Callable[[DataFrame], DataFrame],
    key: Sequence[str],
    issues_path: str,
    copies_path: str,
    checkpoint: str,
):
    """Audit arriving blocks: two queries to start, of the rules and of the copies.

    ``rules`` gives issue rows of a stream; they are appended to ``issues_path``.
    How often each key has come is a running count in the state store, so copies
    inside a batch and over batches count alike and nothing stored is read again.
    The keys of a batch that came more than once so far go with their count to
    that batch's folder of ``copies_path``; a repeated batch replaces its own.
    """
    found = rules(stream).select(*key, "code")
    issues = found.writeStream.format("parquet").option("path", issues_path).option("checkpointLocation", f"{checkpoint}/rules")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.where("copies > 1").write.mode("overwrite").parquet(f"{copies_path}/batch={batch_id}")

    counted = stream.groupBy(*key).agg(F.count("*").alias("copies"))
    copies = counted.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/copies")
    return issues, copies


def issue_counts(spark, issues_path: str, copies_path: str, key: Sequence[str]) -> DataFrame:
    """``code, blocks`` so far; every block of a key but the first is a DUPLICATE_GEOMETRY."""
    named = spark.read.parquet(issues_path).groupBy("code").agg(F.count("*").alias("blocks"))
    most = spark.read.parquet(copies_path).groupBy(*key).agg(F.max("copies").alias("copies"))
    again = most.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("blocks"))
    return named.unionByName(again.select(F.lit("DUPLICATE_GEOMETRY").alias("code"), "blocks"))
