"""Writers and readers of records."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schema import RECORD


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines; Spark's commit makes the directory whole or not there."""
    records.write.mode(mode).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or the ``results`` of a run's envelope; addresses without a type are taken as `other`."""
    rows = spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)
    return rows


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    fields = f"model string, domains_requested bigint, results array<struct<{', '.join(':'.join(x.strip().split(' ', 1)) for x in _columns(RECORD))}>>"
    return spark.read.schema(fields).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def _columns(ddl: str) -> list[str]:
    out, level, start = [], 0, 0
    for i, c in enumerate(ddl):
        level += (c == "<") - (c == ">")
        if c == "," and not level:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def write_envelope(envelope: DataFrame, path: str) -> None:
    """One JSON file on the driver's disk, replaced at once; for runs of a size that a person reads."""
    row = envelope.select(F.to_json(F.struct("*"))).first()[0]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        json.dump(json.loads(row), out, indent=2, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)
