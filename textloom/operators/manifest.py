"""Snapshots and site manifests: roll-ups, the index table, name collisions, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def snapshots(trees: DataFrame, maps: DataFrame, pages: DataFrame, now: str) -> DataFrame:
    """Snapshot rows (version 1): url, title, tree, url_map, image_map, node_count, captured_at, page_name. pages (page_id, url, html)."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    joined = pages.select("page_id", "url", title.alias("title")).join(trees, "page_id").join(maps, "page_id", "left")
    empty = F.create_map().cast("map<string,string>")
    return joined.select("page_id", F.lit(1).alias("version"), "url", "title", "tree", F.coalesce("url_map", empty).alias("url_map"), F.coalesce("image_map", empty).alias("image_map"), "node_count", F.lit(now).cast("timestamp").alias("captured_at"), urls.page_name("url").alias("page_name"))


def site_manifest(entries: DataFrame, key: list[str]) -> DataFrame:
    """Counts by site: entries (key..., image_count)."""
    return entries.groupBy(*key).agg(F.count("*").alias("page_count"), F.sum("image_count").alias("total_images"))


def index_row(url, snapshot, image_count):
    """A row of the index table; long URLs keep their last 57 characters."""
    shown = F.when(F.length(url) > 60, F.concat(F.lit("..."), F.right(url, F.lit(57)))).otherwise(url)
    return F.concat(F.lit("| "), shown, F.lit(" | "), snapshot, F.lit(" | "), image_count.cast("string"), F.lit(" |"))


def index_table(site: str, entries: DataFrame, key: list[str], date: str) -> DataFrame:
    """One Markdown index per key: entries (key..., ord, url, snapshot, image_count)."""
    rows = F.sort_array(F.collect_list(F.struct("ord", index_row(F.col("url"), F.col("snapshot"), F.col("image_count")).alias("row"))))
    held = entries.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: r.row), "\n").alias("rows"), F.count("*").alias("n"), F.sum("image_count").alias("images"))
    text = F.concat(F.lit(f"# {site} — {date}\n\n| Page | Snapshot | Images |\n|------|----------|--------|\n"), "rows", F.lit("\n\nTotal: "), F.col("n").cast("string"), F.lit(" pages, "), F.col("images").cast("string"), F.lit(" images\n"))
    return held.select(*key, text.alias("markdown"))


def name_collisions(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Page names that stand for more than one normalised URL."""
    named = pages.select(urls.page_name(url_col).alias("page_name"), urls.normalize(url_col, True).alias("url"))
    return named.groupBy("page_name").agg(F.countDistinct("url").alias("n_urls")).filter("n_urls > 1")


def inspect(snapshots_df: DataFrame, url: str, lines: int = 100, links: int = 50, images: int = 20, width: int = 100) -> DataFrame:
    """Previews of one page: its first tree lines, links and images (each URL cut to width)."""
    cut = lambda m, n: F.slice(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit(" "), F.substring(e.value, 1, width))), 1, n)
    own = snapshots_df.filter(F.col("url") == url)
    return own.select("url", urls.inspect_name("url").alias("name"), F.array_join(F.slice(F.split("tree", "\n"), 1, lines), "\n").alias("tree"), cut("url_map", links).alias("links"), cut("image_map", images).alias("images"))


def fetch(pages: DataFrame, url: str, form: str = "ax") -> DataFrame:
    """One page as html, text, ax (tree) or links: (url, content)."""
    from ..sources.html_nodes import read_nodes
    from .links import extract_links, html_links
    from .tree import explode_nodes, trees

    own = pages.filter(F.col("url") == url)
    if form == "html":
        return own.select("url", F.col("html").alias("content"))
    if form == "ax":
        return trees(read_nodes(own)).join(own.select("page_id", "url"), "page_id").select("url", F.col("tree").alias("content"))
    if form == "text":
        words = explode_nodes(read_nodes(own)).filter("role = 'StaticText'").groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "\n").alias("content"))
        return own.select("page_id", "url").join(words, "page_id", "left").select("url", F.coalesce("content", F.lit("")).alias("content"))
    if form == "links":
        found = extract_links(html_links(own)).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "link"))), lambda x: x.link), "\n").alias("content"))
        return own.select("page_id", "url").join(found, "page_id", "left").select("url", F.coalesce("content", F.lit("")).alias("content"))
    raise ValueError(f"unknown format {form!r}: html, text, ax or links")
