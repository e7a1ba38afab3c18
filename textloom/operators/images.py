"""Image downloads as tables: which images stay, their file names, and the map from element to local path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images


def filter_images(fetched: DataFrame, min_bytes: int = images.MIN_BYTES, min_dim: int = images.MIN_DIM, skip_svg: bool = False) -> DataFrame:
    """fetched (page, ord, url, ok, content_type, body, ...) with width, height and skip_reason."""
    sized = fetched.withColumn("size", images.dimensions("body"))
    reason = images.skip_reason(F.col("ok"), F.col("content_type"), F.col("url"), F.col("body"), F.col("size"), min_bytes, min_dim, skip_svg)
    return sized.withColumn("skip_reason", reason).withColumn("width", F.col("size.width")).withColumn("height", F.col("size.height")).drop("size")


def number_images(filtered: DataFrame) -> DataFrame:
    """The images that stay, with local_path images/<page>/img-NNN.ext numbered by page in order."""
    k = F.row_number().over(Window.partitionBy("page").orderBy("ord"))
    kept = filtered.filter("skip_reason is null").withColumn("n", k)
    name = F.concat(F.lit("img-"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")), images.extension(F.col("content_type"), F.col("url")))
    return kept.withColumn("local_path", F.concat(F.lit("images/"), "page", F.lit("/"), name)).drop("n")


def skip_counts(filtered: DataFrame) -> DataFrame:
    """One row: how many images were left out for each reason, and how many stay."""
    n = lambda r: F.count_if(F.col("skip_reason") == r)
    return filtered.agg(n("failed").alias("failed"), n("svg").alias("svg"), n("bytes").alias("bytes"), n("dimensions").alias("dimensions"), F.count_if(F.col("skip_reason").isNull()).alias("kept"))


def element_paths(image_map: DataFrame, numbered: DataFrame) -> DataFrame:
    """(page, element_id, local_path): image_map (page, element_id, url) joined with the files; of files of one URL the last wins."""
    last = numbered.groupBy("page", "url").agg(F.max_by("local_path", "ord").alias("local_path"))
    return image_map.join(last, ["page", "url"]).select("page", "element_id", "local_path")
