"""Incremental crawls: arriving pages are read as a stream, each batch once, and only URLs not seen before go on.

The discovered set is a Parquet table; a batch anti-joins it, appends its new URLs under its batch number, and skips a batch number already there, so a batch
that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, urls
from ..operators.links import extract_links, html_links
from ..sources.files import exists

PAGES = "page_id long, url string, html string"


def discover(batch: DataFrame, match: list[str] | None, exclude: list[str] | None, preserve_query: bool) -> DataFrame:
    """(url, status) of the links of a batch of pages, each URL once."""
    found = extract_links(html_links(batch), preserve_query).select(F.col("link").alias("url")).distinct()
    return found.withColumn("status", patterns.in_scope(urls.path("url"), match, exclude))


def run(spark: SparkSession, source: str, discovered: str, checkpoint: str, match: list[str] | None = None, exclude: list[str] | None = None, preserve_query: bool = False, max_files: int = 1000) -> None:
    """Work through what lies in source (Parquet of pages) and has not been seen, then stop."""

    def take(batch: DataFrame, number: int) -> None:
        new = discover(batch, match, exclude, preserve_query)
        if exists(spark, discovered):
            old = spark.read.schema("url string, status string, batch long").parquet(discovered)
            new = new.join(old.filter(F.col("batch") != number), "url", "left_anti")
        new.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(discovered)

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
