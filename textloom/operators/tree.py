"""Accessibility trees: raw node lists to indented text, node counts, and URL and image maps.

A page is an array of nodes (see NODE). The tree starts at the first node; ignored nodes, inline text boxes, unnamed generic nodes and text that
repeats its parent's name are left out and their children move up. Unreachable nodes and dangling child ids are dropped; a node met again on
its own path (a cycle) is not entered twice. Maps come from all raw nodes, the last URL of an element id winning.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<node_id:string,role:string,name:string,ignored:boolean,backend_id:int,child_ids:array<string>,properties:array<struct<name:string,type:string,value:string>>>"
NODES = f"array<{NODE}>"

# Roles that never show, and roles that show only with a name.
ALWAYS_SKIPPED, SKIPPED_UNNAMED = ("InlineTextBox",), ("generic", "none")


def level_of(properties: Column) -> Column:
    """The first numeric ``level`` property, or null."""
    first = F.get(F.filter(properties, lambda p: p["name"] == "level"), F.lit(0))
    return F.when(first["type"].isin("integer", "number"), first["value"].cast("double").cast("int"))


def element_id(frame: int, backend: Column) -> Column:
    return F.concat(F.lit(f"{frame}-"), F.coalesce(backend, F.lit(0)).cast("string"))


def explode_nodes(pages: DataFrame, id_col: str = "page_id", nodes_col: str = "nodes") -> DataFrame:
    """(page_id, pos, node_id, role, name, ignored, backend_id, child_ids, properties): one row per raw node."""
    return pages.select(F.col(id_col).alias("page_id"), F.posexplode(nodes_col).alias("pos", "n")).select("page_id", "pos", "n.*")


def redundant_text(nodes: DataFrame) -> DataFrame:
    """(page_id, pos) of static text whose first listing parent has an equal name (two missing names are equal)."""
    listed = nodes.select("page_id", F.col("pos").alias("parent_pos"), F.col("name").alias("parent_name"), F.explode("child_ids").alias("node_id"))
    parent = listed.groupBy("page_id", "node_id").agg(F.min_by(F.struct("parent_name"), "parent_pos").alias("p"))
    text = nodes.filter("role = 'StaticText'").select("page_id", "pos", "node_id", "name")
    return text.join(parent, ["page_id", "node_id"]).filter(F.col("name").eqNullSafe(F.col("p.parent_name"))).select("page_id", "pos")


def skipped(nodes: DataFrame) -> DataFrame:
    """nodes with a boolean ``skip``."""
    redundant = redundant_text(nodes).withColumn("redundant", F.lit(True))
    by_role = F.coalesce("ignored", F.lit(False)) | F.col("role").isin(*ALWAYS_SKIPPED) | (F.col("role").isin(*SKIPPED_UNNAMED) & (F.coalesce("name", F.lit("")) == ""))
    return nodes.join(redundant, ["page_id", "pos"], "left").withColumn("skip", by_role | F.coalesce("redundant", F.lit(False))).drop("redundant")


def flat_tree(nodes: list[dict], frame: int = 0) -> list[tuple[str, int, str, str, int | None]]:
    """(element id, depth, role, name, level) of each shown node, in order. One page at a time."""
    by_id = {n["node_id"]: n for n in nodes}
    parent_name: dict[str, str | None] = {}
    for n in nodes:
        for c in n["child_ids"] or ():
            parent_name.setdefault(c, n["name"])

    def hidden(n: dict) -> bool:
        if n["ignored"] or n["role"] in ALWAYS_SKIPPED or (n["role"] in SKIPPED_UNNAMED and not n["name"]):
            return True
        return n["role"] == "StaticText" and n["node_id"] in parent_name and parent_name[n["node_id"]] == n["name"]

    def level(n: dict) -> int | None:
        own = next((p for p in n["properties"] or () if p["name"] == "level"), None)
        return int(float(own["value"])) if own and own["type"] in ("integer", "number") and own["value"] is not None else None

    out: list[tuple[str, int, str, str, int | None]] = []
    stack: list[tuple[str, int, frozenset]] = [(nodes[0]["node_id"], 0, frozenset())] if nodes else []
    while stack:
        key, depth, above = stack.pop()
        n = by_id.get(key)
        if n is None or key in above:
            continue
        skip = hidden(n)
        if not skip:
            out.append((f"{frame}-{n['backend_id'] or 0}", depth, n["role"], n["name"] or "", level(n)))
        stack += ((c, depth if skip else depth + 1, above | {key}) for c in reversed(n["child_ids"] or ()))
    if not out:
        return [(f"{frame}-0", 0, "empty", "", None)]
    if sum(x[1] == 0 for x in out) > 1:
        return [(f"{frame}-0", 0, "document", "", None)] + [(i, d + 1, *rest) for i, d, *rest in out]
    return out


def line(element: str, depth: int, role: str, name: str, level: int | None) -> str:
    return "  " * depth + f"[{element}] {role}" + (f" (level={level})" if level else "") + (f': "{name}"' if name else "")


def line_column(element: Column, depth: Column, role: Column, name: Column, level: Column) -> Column:
    """The same line in native expressions."""
    shown = F.when(F.coalesce(level, F.lit(0)) != 0, F.concat(F.lit(" (level="), level.cast("string"), F.lit(")"))).otherwise("")
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(': "'), name, F.lit('"'))).otherwise("")
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("["), element, F.lit("] "), role, shown, named)


def trees(pages: DataFrame, id_col: str = "page_id", nodes_col: str = "nodes", frame: int = 0) -> DataFrame:
    """(page_id, tree, node_count) of each page."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                flat = [flat_tree(n or [], frame) for n in own.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(["\n".join(line(*x) for x in f) for f in flat]), pa.array([len(f) for f in flat], pa.int32())], names=["page_id", "tree", "node_count"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), nodes_col).mapInArrow(build, f"page_id {kind}, tree string, node_count int")


def element_urls(nodes: DataFrame, frame: int = 0) -> DataFrame:
    """(page_id, kind ("image" or "link"), element_id, url, first_pos): the last URL of each element, in order of first mention."""
    url = F.get(F.filter("properties", lambda p: p["name"] == "url"), F.lit(0))["value"]
    found = nodes.withColumn("url", url).filter("url <> ''").select("page_id", "pos", F.when(F.col("role").isin("image", "img"), "image").otherwise("link").alias("kind"), element_id(frame, F.col("backend_id")).alias("element_id"), "url")
    return found.groupBy("page_id", "kind", "element_id").agg(F.max_by("url", "pos").alias("url"), F.min("pos").alias("first_pos"))


def url_maps(nodes: DataFrame, frame: int = 0) -> DataFrame:
    """(page_id, url_map, image_map): maps in order of first mention."""
    own = element_urls(nodes, frame)
    entries = lambda kind: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("first_pos", "element_id", "url")))), lambda x: F.struct(x.element_id, x.url)))
    return own.groupBy("page_id").agg(entries("link").alias("url_map"), entries("image").alias("image_map"))


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes below a root element, in their old order: roots (page_id, backend_id). A page whose root is missing keeps its whole tree."""
    from ..plans.session import checkpoint

    start = nodes.join(roots, ["page_id", "backend_id"], "left_semi").select("page_id", "node_id")
    reached = wave = checkpoint(start.distinct())
    children = nodes.select("page_id", "node_id", F.explode("child_ids").alias("child"))
    while True:
        below = wave.join(children, ["page_id", "node_id"]).select("page_id", F.col("child").alias("node_id")).distinct()
        wave = checkpoint(below.join(reached, ["page_id", "node_id"], "left_anti"))
        if wave.isEmpty():
            break
        reached = checkpoint(reached.union(wave))
    whole = nodes.join(reached.select("page_id").distinct(), "page_id", "left_anti")
    return nodes.join(reached, ["page_id", "node_id"], "left_semi").select(*nodes.columns).unionByName(whole.select(*nodes.columns))


def pick_samples(snapshots: DataFrame, order_col: str = "page_id") -> DataFrame:
    """First, middle and last snapshot by order."""
    n = snapshots.count()
    if n == 0:
        return snapshots
    wanted = {0, n // 2, n - 1}
    low = snapshots.orderBy(order_col).limit(1)
    high = snapshots.orderBy(F.desc(order_col)).limit(1)
    middle = snapshots.orderBy(order_col).offset(n // 2).limit(1)
    return low.union(middle).union(high).dropDuplicates([order_col]) if len(wanted) > 1 else low
