"""Enrich domains, live or from a table of pages: `python run.py --domains a.com --output records`, with `--pages
pages.parquet` nothing is fetched."""

from __future__ import annotations

import argparse
import datetime
import logging
import sys
from dataclasses import replace

log = logging.getLogger("millrace")


def parse_args(args=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--domains", nargs="*", help="domains; else those of the pages")
    p.add_argument("--input", help="a text file of domains")
    p.add_argument("--pages", help="Parquet of pages; without it the domains are crawled")
    p.add_argument("--responses", help="Parquet of model answers")
    p.add_argument("--hits", help="Parquet of search hits")
    p.add_argument("--output", help="where records go")
    p.add_argument("--envelope", help="a JSON file for the whole run")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--model")
    p.add_argument("--verbose", "-v", action="store_true")
    return p.parse_args(args)


def main(args=None) -> int:
    """0 if any domain gave a record that isn't failed, 1 if none, 2 for bad arguments, 130 if interrupted."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from millrace.config import Settings
    from millrace.plans import crawl, records, report
    from millrace.sources import connectors, domains, sinks

    given = parse_args(args)
    logging.basicConfig(level=logging.DEBUG if given.verbose else logging.INFO)
    settings = Settings.from_env()
    settings = replace(settings, model=given.model or settings.model, max_pages_per_domain=given.max_pages or settings.max_pages_per_domain, output_path=given.output or settings.output_path)
    started = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        if not given.pages and not (given.domains or given.input):
            log.error("give --domains or --input, or --pages")
            return 2
        pages = spark.read.parquet(given.pages) if given.pages else None
        if pages is not None:
            pages = pages if "domain" in pages.columns else records.pages_of_hosts(pages)
        if given.domains or given.input:
            asked = domains.load_domains(spark, given.domains, given.input)
        else:
            asked = pages.select(F.col("domain").alias("domain_raw")).distinct().withColumn("input_pos", F.xxhash64("domain_raw"))
        read = lambda path: spark.read.parquet(path) if path else None
        if pages is None:
            model = connectors.ChatModel(settings).call if settings.llm_api_key and settings.llm_base_url else None
            made = crawl.crawl_records(asked, settings, call=model, provider=connectors.search_provider(settings))
        else:
            made = records.domain_records(asked, pages, settings, read(given.responses), read(given.hits))
        sinks.write_records(made, settings.output_path)
        made = sinks.read_records(spark, settings.output_path)
        totals = report.run_totals(made).first().asDict()
        if given.envelope:
            sinks.write_envelope(report.envelope(made, started, settings.model), given.envelope)
        print(report.dashboard(totals))
        return 0 if totals["succeeded"] + totals["partial"] else 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
