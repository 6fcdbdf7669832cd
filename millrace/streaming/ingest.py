"""Records as pages arrive: each batch's finished domains are appended, a partition a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import Settings
from millrace.plans.records import domain_records
from millrace.schema import PAGES


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def record_stream(pages: DataFrame, out: str, checkpoint: str, settings: Settings | None = None, answers: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes ``out/batch=N`` for every batch of pages. A batch that is run again replaces its own partition, so each
    record is written once; pages of one domain belong in one batch."""

    def emit(batch: DataFrame, number: int) -> None:
        asked = batch.select(F.col("domain").alias("domain_raw")).distinct().withColumn("input_pos", F.xxhash64("domain_raw"))
        records = domain_records(asked, batch, settings, None if answers is None else answers(batch))
        records.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
