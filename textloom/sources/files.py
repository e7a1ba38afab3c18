"""Files of a crawl: URL lists, Markdown folders, images, manifests and crawl state, read and written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
MANIFEST = "version int, startUrl string, match string, pageCount int, totalImages int, startedAt string, completedAt string, pages array<struct<url:string,snapshot:string,imageCount:int>>"
STATE = "version int, startUrl string, match string, discoveredUrls array<string>, completedUrls array<string>, failedUrls array<string>, excludedUrls array<string>, queue array<string>, redirects map<string,string>, startedAt string, updatedAt string, config string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads; a pattern, whether anything fits it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(own)
    return found is not None and len(found) > 0


def clean_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed lines without blanks and # comments, as (ord, url); ord must be there or is taken from the reading order."""
    text = F.regexp_replace(F.regexp_replace(F.col(col), r"^[\s ﻿]+", ""), r"[\s ﻿]+$", "")
    ord_ = F.col("ord") if "ord" in lines.columns else F.monotonically_increasing_id()
    return lines.select(ord_.alias("ord"), text.alias("url")).filter("url <> '' and not startswith(url, '#')")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file of URLs, each once, in order. The file is read whole, so order is the file's."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    return clean_lines(lines).groupBy("url").agg(F.min("ord").alias("ord"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, markdown) of a folder's *.md files but index.md; not recursive. ValueError if there are none."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    docs = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.regexp_replace(F.url_decode(name), r"\.md$", "").alias("stem"), F.col("value").alias("markdown")).filter("stem <> 'index'")
    if docs.isEmpty():
        raise ValueError(f"no Markdown files in {folder}")
    return docs


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(url, body) of image files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("url"), F.col("content").alias("body"))


def _as_list(c):
    """A field that may hold one string or a JSON array of strings."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the present version; missing files, bad JSON and other versions give none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("match", _as_list(F.col("match")))
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    return raw.filter(F.col("version") == VERSION).withColumn("match", _as_list(F.col("match")))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, MANIFEST)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state's row; a missing list of excluded URLs is empty."""
    return _read(spark, path, STATE).withColumn("excludedUrls", F.coalesce("excludedUrls", F.array().cast("array<string>")))


def state_rows(state: DataFrame) -> DataFrame:
    """(url, status, canonical): each URL of a state row under its strongest status."""
    sets = [("completed", "completedUrls", 0), ("failed", "failedUrls", 1), ("queued", "queue", 2), ("excluded", "excludedUrls", 3), ("discovered", "discoveredUrls", 4)]
    one = None
    for status, col, rank in sets:
        part = state.select(F.explode(col).alias("url"), F.lit(status).alias("status"), F.lit(rank).alias("rank"))
        one = part if one is None else one.union(part)
    best = one.groupBy("url").agg(F.min_by("status", "rank").alias("status"))
    turned = state.select(F.explode("redirects").alias("url", "canonical"))
    return best.join(turned, "url", "left")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Snapshot rows as Parquet, one folder a site wave; Spark's commit protocol makes the write atomic."""
    snapshots.write.mode("append").parquet(path)


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """(file, content): each snapshot as indented JSON for snapshots/<page_name>.json."""
    body = F.struct("version", "url", "title", "tree", F.col("url_map").alias("urlMap"), F.col("image_map").alias("imageMap"), F.col("node_count").alias("nodeCount"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("capturedAt"))
    return snapshots.select(F.concat(F.lit("snapshots/"), "page_name", F.lit(".json")).alias("file"), F.to_json(body, {"pretty": "true"}).alias("content"))


def manifest_json(start_url: str, match: list[str] | None, started: str, completed: str | None, pages: DataFrame) -> DataFrame:
    """A manifest row of pages (ord, url, snapshot, imageCount) as JSON."""
    held = pages.agg(F.count("*").cast("int").alias("pageCount"), F.coalesce(F.sum("imageCount"), F.lit(0)).cast("int").alias("totalImages"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "url", "snapshot", "imageCount"))), lambda p: F.struct(p.url, p.snapshot, p.imageCount)).alias("pages"))
    body = F.struct(F.lit(VERSION).alias("version"), F.lit(start_url).alias("startUrl"), F.from_json(F.lit(json.dumps(match)), "array<string>").alias("match"), "pageCount", "totalImages", F.lit(started).alias("startedAt"), F.lit(completed).alias("completedAt"), "pages")
    return held.select(F.to_json(body).alias("content"))


def write_texts(files: DataFrame, folder: str) -> None:
    """Texts (file, content) below a folder, one folder a file name; Spark's commit protocol makes the write atomic."""
    files.select("file", F.col("content").alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(folder)


def missing_input(spark: SparkSession, folder: str, converter: str | None = None) -> str | None:
    """Why a folder can't be converted: no manifest, or no such converter; None if it can."""
    from ..operators.convert import CONVERTERS

    if not exists(spark, f"{folder.rstrip('/')}/site.json"):
        return f"no site.json in {folder}: capture a site first"
    if converter is not None and converter not in CONVERTERS:
        return f"no converter {converter!r}: known are {', '.join(sorted(CONVERTERS))}"
    return None


class WaveStore:
    """Crawl state by wave: each save writes a new folder and only then moves the pointer, so a reader never sees half a save."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> int | None:
        if not exists(self.spark, f"{self.folder}/pointer"):
            return None
        return self.spark.read.schema("wave int").json(f"{self.folder}/pointer").agg(F.max("wave")).first()[0]

    def save(self, state: DataFrame) -> int:
        wave = (self._pointer() or 0) + 1
        state.write.mode("overwrite").parquet(f"{self.folder}/wave-{wave}")
        self.spark.createDataFrame([(wave,)], "wave int").coalesce(1).write.mode("append").json(f"{self.folder}/pointer")
        return wave

    def load(self) -> DataFrame | None:
        wave = self._pointer()
        return None if wave is None else self.spark.read.parquet(f"{self.folder}/wave-{wave}")

    def delete(self) -> None:
        """Remove the state, pointer first, so that a reader finds either all of it or none."""
        jvm = self.spark.sparkContext._jvm
        for name in ("pointer", ""):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finished(self) -> bool:
        """Nothing queued or failed is left, so the state may be deleted."""
        state = self.load()
        return state is not None and state.filter("status in ('queued', 'failed')").isEmpty()
