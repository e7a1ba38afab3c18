"""Links of pages: from HTML or from URL maps, resolved, kept to the page's host, normalised, first occurrence kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order. The keys carry the page, so no group outgrows a page."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def html_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, base, ord, href, url): every anchor of every page in order, its href resolved against the page."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)
    # the base is parsed once a page and each href resolved once, before the explode
    resolved = F.transform(F.array(urls.page_base(url_col)), lambda b: F.transform(hrefs, lambda h: F.struct(h.alias("href"), urls.resolve_at(b, h).alias("url"))))[0]
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("base"), F.posexplode(resolved).alias("ord", "link"))
    return held.select("page_id", "base", "ord", "link.href", "link.url")


def map_links(maps: DataFrame, map_col: str = "url_map") -> DataFrame:
    """(page_id, base, ord, url) from a map of element id to URL per page, in map order."""
    found = F.posexplode(F.map_values(map_col)).alias("ord", "url")
    return maps.select("page_id", F.col("url").alias("base"), found)


def extract_links(links: DataFrame, preserve_query: bool = False) -> DataFrame:
    """(page_id, ord, link): valid links to the page's own host, normalised, each once per page at its first place."""
    own = links.filter(urls.same_host("url", "base")).select("page_id", "ord", urls.normalize("url", preserve_query).alias("link")).filter("link is not null")
    return own.groupBy("page_id", "link").agg(F.min("ord").alias("ord")).select("page_id", "ord", "link")
