"""Trees to Markdown through registered converters, and local paths for image references."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVERTERS: dict[str, Callable[[str, dict, dict], str]] = {}
_LINE = re.compile(r'^( *)\[([^\]]*)\] (\S+)(?: \(level=(\d+)\))?(?:: "(.*)")?$')

# Parts of a page that are not its content.
FURNITURE = frozenset("navigation contentinfo banner complementary form search".split())


def register(name: str):
    """Make a function (tree, url map, image map) -> Markdown available by name."""

    def keep(f):
        CONVERTERS[name] = f
        return f

    return keep


@register("generic")
def generic(tree: str, url_map: dict, image_map: dict) -> str:
    """Headings by level, paragraphs, list items, links and images; furniture is left out."""
    out: list[str] = []
    hidden, inline = None, None
    for raw in tree.split("\n"):
        m = _LINE.match(raw)
        if not m:
            continue
        depth, element, role, level, name = len(m[1]), m[2], m[3], m[4], m[5] or ""
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if role in FURNITURE else None
        if hidden is not None:
            continue
        if inline is not None and depth > inline:
            continue
        inline = depth if role in ("heading", "link", "image", "img") else None
        if role == "heading" and name:
            out.append(f"{'#' * int(level or 1)} {name}")
        elif role == "link" and name:
            out.append(f"[{name}]({url_map[element]})" if element in url_map else name)
        elif role in ("image", "img") and element in image_map:
            out.append(f"![{name}](../{image_map[element]})")
        elif role == "StaticText" and name:
            out.append(name)
    return "\n\n".join(out) + "\n" if out else ""


def convert(snapshots: DataFrame, converter: str = "generic", only: list[str] | None = None, limit: int | None = None, name_col: str = "page_name") -> DataFrame:
    """snapshots (tree, url_map, image_map, ...) with ``markdown`` and ``error``: a page that fails has a null text and says why. only: page names; limit: a
    dry run over so many pages."""
    chosen = snapshots.filter(F.col(name_col).isin(only)) if only else snapshots
    chosen = chosen.limit(limit) if limit is not None else chosen
    own = CONVERTERS[converter]

    @F.pandas_udf("struct<markdown:string,error:string>")
    def run(tree: pd.Series, url_map: pd.Series, image_map: pd.Series) -> pd.DataFrame:
        rows = []
        for t, u, i in zip(tree, url_map, image_map, strict=True):
            try:
                rows.append((own(t or "", dict(u or {}), dict(i or {})), None))
            except Exception as e:  # one bad page must not stop the others; its error is a column
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["markdown", "error"])

    return chosen.withColumn("_c", run("tree", "url_map", "image_map")).select("*", "_c.markdown", "_c.error").drop("_c")


_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
_URL_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def image_keys(url: Column) -> Column:
    """What a Markdown file may call an image: its URL, its path, and each proper tail of the path."""
    names = F.filter(F.split(F.regexp_extract(url, _URL_PATH, 1), "/"), lambda x: x != "")
    tails = F.transform(F.array(names), lambda n: F.when(F.size(n) > 1, F.transform(F.sequence(F.lit(2), F.greatest(F.size(n), F.lit(2))), lambda k: F.array_join(F.slice(n, k, F.size(n)), "/"))).otherwise(F.array().cast("array<string>")))[0]
    return F.when(url.rlike(_URL_PATH), F.concat(F.array(url, F.regexp_extract(url, _URL_PATH, 1)), tails)).otherwise(F.array(url))


def localize_images(markdown: Column | str, paths: Column | str) -> Column:
    """Image references whose URL, path or tail of a path is known point to the local file; paths: a map of URL to local path, later images win. Null Markdown stays null."""
    text, known = (F.col(c) if isinstance(c, str) else c for c in (markdown, paths))
    entries = F.flatten(F.transform(F.map_entries(known), lambda e: F.transform(image_keys(e["key"]), lambda k: F.struct(k.alias("key"), e["value"].alias("path")))))
    last = lambda held, key: F.get(F.transform(F.reverse(F.filter(held, lambda e: e["key"] == key)), lambda e: e["path"]), F.lit(0))
    target = lambda ref: F.regexp_extract(ref, r"\]\(([^)]+)\)$", 1)
    pointed = lambda held, ref: F.coalesce(F.concat(F.regexp_extract(ref, r"^(!\[[^\]]*\]\()", 1), F.coalesce(last(held, target(ref)), last(held, F.regexp_replace(target(ref), "[?#].*$", ""))), F.lit(")")), ref)
    # the texts between references and the references, by turns
    done = F.transform(F.array(F.coalesce(entries, F.array().cast("array<struct<key:string,path:string>>"))), lambda held: F.array_join(F.zip_with(F.split(text, _IMAGE, -1), F.regexp_extract_all(text, F.lit(_IMAGE), 0), lambda t, ref: F.concat(t, F.coalesce(pointed(held, ref), F.lit("")))), ""))[0]
    return F.when(text.rlike(_IMAGE), done).otherwise(text)
