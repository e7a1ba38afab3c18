"""Raw accessibility-like nodes from HTML, with the standard library's parser; one page per call, Arrow-batched."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.tree import NODES, flat_tree, line

# Roles of HTML elements in the accessibility tree; elements without content; elements that never show.
ROLES = {"a": "link", "article": "article", "aside": "complementary", "body": "generic", "button": "button", "div": "generic", "figure": "figure", "footer": "contentinfo", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "header": "banner", "img": "image", "li": "listitem", "main": "main", "nav": "navigation", "ol": "list", "p": "paragraph", "section": "region", "table": "table", "td": "cell", "th": "columnheader", "tr": "row", "ul": "list"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title".split())
NAMED = frozenset("link button heading cell columnheader".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[tuple[str, dict | None]] = []
        self.hidden = 0
        self._add("RootWebArea", None)

    def _add(self, role: str, name: str | None, properties: list | None = None) -> dict:
        k = len(self.nodes) + 1
        node = {"node_id": str(k), "role": role, "name": name, "ignored": False, "backend_id": k, "child_ids": [], "properties": properties or []}
        self.nodes.append(node)
        if k > 1:
            parent = next((n for _, n in reversed(self.stack) if n is not None), self.nodes[0])
            parent["child_ids"].append(node["node_id"])
        return node

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += tag not in VOID
            return
        if self.hidden:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        a, node = {k: v or "" for k, v in attrs}, None
        if tag in ROLES:
            properties = []
            if tag[0] == "h" and tag[1:].isdigit():
                properties.append({"name": "level", "type": "integer", "value": tag[1:]})
            if link := a.get("href") if tag == "a" else a.get("src") if tag == "img" else None:
                properties.append({"name": "url", "type": "string", "value": link})
            node = self._add(ROLES[tag], a.get("alt") if tag == "img" else None, properties)
        if tag not in VOID:
            self.stack.append((tag, node))

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or self.hidden:
            return
        for _, n in reversed(self.stack):
            if n is not None and n["role"] in NAMED:
                n["name"] = f"{n['name']} {text}" if n["name"] else text
                break
        self._add("StaticText", text)


def nodes_of(page: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader.nodes


def read_nodes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, nodes) of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prop = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string())])
        node = pa.struct([("node_id", pa.string()), ("role", pa.string()), ("name", pa.string()), ("ignored", pa.bool_()), ("backend_id", pa.int32()), ("child_ids", pa.list_(pa.string())), ("properties", pa.list_(prop))])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([nodes_of(h) for h in own.column(2).to_pylist()], pa.list_(node))], names=["page_id", "url", "nodes"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html_col).mapInArrow(parse, f"page_id {kind}, url string, nodes {NODES}")


_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_SNAPSHOT = "tree string, node_count int, url_map map<string,string>, image_map map<string,string>, title string"


def snapshot_of(page: str | None, frame: int = 0) -> tuple[str, int, dict, dict, str]:
    """Tree, node count, link and image maps (last URL of an element wins) and title of a page, from one reading."""
    nodes = nodes_of(page)
    shown = flat_tree(nodes, frame)
    maps: tuple[dict, dict] = ({}, {})
    for n in nodes:
        url = next((p["value"] for p in n["properties"] if p["name"] == "url"), None)
        if url:
            maps[n["role"] in ("image", "img")][f"{frame}-{n['backend_id'] or 0}"] = url
    title = _TITLE.search(page or "")
    return "\n".join(line(*x) for x in shown), len(shown), *maps, title[1] if title else ""


def read_snapshots(pages: DataFrame, now: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Snapshot rows (version 1) of HTML pages, as ``manifest.snapshots`` makes them of trees and maps, in one pass without a shuffle."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                made = list(zip(*(snapshot_of(h) for h in own.column(2).to_pylist()), strict=True))
                text = pa.map_(pa.string(), pa.string())
                kinds = (pa.string(), pa.int32(), text, text, pa.string())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array([list(x.items()) for x in c] if k == text else c, k) for c, k in zip(made, kinds, strict=True))], names=["page_id", "url", "tree", "node_count", "url_map", "image_map", "title"])

    kind = pages.schema[id_col].dataType.simpleString()
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html_col).mapInArrow(parse, f"page_id {kind}, url string, {_SNAPSHOT}")
    return held.select("page_id", F.lit(1).alias("version"), "url", "title", "tree", "url_map", "image_map", "node_count", F.lit(now).cast("timestamp").alias("captured_at"), urls.page_name("url").alias("page_name"))
