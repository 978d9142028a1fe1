"""Time the headline queries and print one JSON line.

Scale folder: $BENCH_SF_DIR (default /root/testdata/sf0.1); cores: $BENCH_CPUS (default 8). Each query
is run once to warm up and then timed; the whole result is produced, but not kept.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.checks import planted
from hedgerow.functions import risk
from hedgerow.functions.numbering import number_rows
from hedgerow.operators import extract, lines, matchers, pages, responses
from hedgerow.plans import reports
from hedgerow.sources import files as tree
from hedgerow.sources.tables import read_table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(
        spark, f"{sf}/documents.parquet", "doc_id", "text",
        partitions=spark.sparkContext.defaultParallelism,
    ).select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )


QUERIES = {
    "category_matches": lambda spark, sf: matchers.category_matches(documents(spark, sf)),
    "rule_matches": lambda spark, sf: matchers.rule_matches(documents(spark, sf)),
    "planted_category_matches": lambda spark, sf: matchers.category_matches(
        planted.files(spark, sf)
    ),
    "planted_tree_scan": lambda spark, sf: matchers.rule_matches(
        tree.scanned(planted.files(spark, sf))
    ),
    "secrets": lambda spark, sf: extract.page_secrets(
        planted.files(spark, sf), "doc_id", content="content", url="path"
    ),
    "context_window": lambda spark, sf: lines.with_context(
        lines.numbered_lines(planted.files(spark, sf), "path"), "path"
    ),
    "crawl_rows": lambda spark, sf: pages.crawl_rows(planted.pages(spark, sf)),
    "crawl_summary": lambda spark, sf: pages.crawl_summary(planted.pages(spark, sf)),
    "response_detectors": lambda spark, sf: responses.detect(planted.responses(spark, sf)),
    "classify_and_count": lambda spark, sf: reports.severity_counts(
        risk.classify(planted.findings(spark, sf))
    ),
    "number_findings": lambda spark, sf: number_rows(
        planted.findings(spark, sf), "file", "event_id", staged=True
    ),
}


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in QUERIES.items():
        run(query(spark, sf))
        start = time.perf_counter()
        run(query(spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
    count = lambda table: spark.read.parquet(f"{sf}/{table}.parquet").count()
    line_count = lines.numbered_lines(documents(spark, sf), "path").count()
    rates = {
        "lines_per_sec": round(line_count / times["category_matches"]),
        "pages_per_sec": round(count("pages") / times["crawl_rows"]),
        "responses_per_sec": round(count("events") / times["response_detectors"]),
    }
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
