"""The list of domains: arguments and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.urls import normalise_domain_safe

#: Used where no domain is given.
DEFAULT_DOMAINS = ("example.com", "example.org", "example.net")


def first_of_each(domains: DataFrame) -> DataFrame:
    """(domain_raw, input_pos) with comments, blanks and repeats of one host left out; the first spelling stays."""
    bare = domains.select(F.trim(F.split("domain_raw", ",")[0]).alias("domain_raw"), "input_pos")
    bare = bare.filter((F.col("domain_raw") != "") & ~F.startswith("domain_raw", F.lit("#")))
    keyed = bare.withColumn("domain", normalise_domain_safe(F.col("domain_raw")))
    order = Window.partitionBy("domain").orderBy("input_pos")
    return keyed.withColumn("n", F.row_number().over(order)).filter("n = 1").select("domain", "domain_raw", "input_pos")


def load_domains(spark: SparkSession, given: list[str] | None = None, path: str | None = None, skip_header: bool = False) -> DataFrame:
    """Arguments first, then a file's lines in order; only the first comma-separated field of a line counts."""
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(given or [])], "domain_raw string, input_pos long")
    if path:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\R")).alias("pos", "domain_raw"))
        lines = whole.filter("pos > 0") if skip_header else whole
        rows = rows.unionByName(lines.select("domain_raw", (F.col("pos") + len(given or [])).cast("long").alias("input_pos")))
    return first_of_each(rows)
