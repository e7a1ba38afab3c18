"""Breadth-first crawl of a link graph, one DataFrame wave per level.

Edges are (src, pos, dst). A wave joins the frontier with the edges, drops what is already discovered, classifies the rest by scope and goes
on with what is queued. The order of a visit is (wave, order of the parent, position); a URL found twice keeps its first place.
Redirects (requested, landed canonical URL) collapse: a page whose canonical URL was captured earlier counts as completed without a capture of its own.
State is one row a URL: url, status (queued, completed, excluded, unmatched, failed), wave, ord, canonical, captured.
Each wave is checkpointed in the shared folder, so a lost executor costs a wave at most; the discovered URLs are written anew as one table every COMPACT waves, so plans
do not grow with the depth. A crawl ends when nothing is queued, however deep that is.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, urls
from ..plans.session import checkpoint
from .links import keep_first

STATE = "url string, status string, wave int, ord string, canonical string, captured boolean"
COMPACT = 8


def place(k, digits: int = 6):
    """A position as hexadecimal digits, so that orders of one wave compare as texts; positions of more digits take 16 after a letter that sorts behind them all."""
    n = k.cast("long")
    return F.when(n < 16**digits, F.lpad(F.hex(n), digits, "0")).otherwise(F.concat(F.lit("g"), F.lpad(F.hex(n), 16, "0")))


def _visited(wave: DataFrame, done: DataFrame, redirects: DataFrame | None, failing: DataFrame | None) -> DataFrame:
    """A wave's queued URLs with what came of them."""
    fails = F.lit(False)
    if failing is not None:
        wave = wave.join(failing.select("url", F.lit(True).alias("fails")), "url", "left")
        fails = F.coalesce("fails", F.lit(False))
    status = F.when(fails, "failed").otherwise("completed").alias("status")
    if redirects is None:
        return wave.select("url", status, "wave", "ord", F.col("url").alias("canonical"), (~fails).alias("captured"))
    seen = wave.join(redirects.select(F.col("requested").alias("url"), F.col("landed").alias("canonical")), "url", "left").select("url", status, "wave", "ord", F.coalesce("canonical", "url").alias("canonical"))
    first = seen.filter("status = 'completed'").groupBy("canonical").agg(F.min("ord").alias("_first"))
    fresh = first.join(done.filter("captured").select("canonical").distinct(), "canonical", "left_anti")
    return seen.join(fresh, "canonical", "left").select("url", "status", "wave", "ord", "canonical", F.coalesce((F.col("status") == "completed") & (F.col("ord") == F.col("_first")), F.lit(False)).alias("captured"))


def bfs(edges: DataFrame, start: DataFrame, match: list[str] | None = None, exclude: list[str] | None = None, max_pages: int | None = None, redirects: DataFrame | None = None, failing: DataFrame | None = None, state: DataFrame | None = None, scoped: bool = True) -> DataFrame:
    """The final state of a crawl. start: (url, ord); state: an earlier run's rows, whose queued URLs go on. max_pages bounds completed URLs (failures don't
    count); what it leaves stays queued. An order is the text of the positions on the way to a URL; it compares within a wave."""
    spark = edges.sparkSession
    if state is None:
        frontier, completed = start.select("url", F.lit(0).alias("wave"), place(F.col("ord")).alias("ord")), 0
        done = spark.createDataFrame([], STATE)
    else:
        old = checkpoint(state.select("url", "status", "wave", "ord", "canonical", "captured"))
        frontier, done = old.filter("status = 'queued'").select("url", "wave", "ord"), old.filter("status <> 'queued'")
        completed = done.filter("status = 'completed'").count() if max_pages is not None else 0
    frontier = checkpoint(frontier)
    for wave in count(1):
        if frontier.isEmpty() or (max_pages is not None and completed >= max_pages):
            break
        visit = frontier if max_pages is None else frontier.orderBy("wave", "ord").limit(max_pages - completed)
        visited = _visited(visit, done, redirects, failing)
        if redirects is not None or failing is not None or max_pages is not None:
            visited = checkpoint(visited)
        done = done.unionByName(visited)
        if wave % COMPACT == 0:
            done = checkpoint(done)
        waiting = None
        if max_pages is not None:
            completed += visited.filter("status = 'completed'").count()
            waiting = frontier.join(visited, "url", "left_anti").select("url", "wave", "ord", F.lit("queued").alias("kind"))
        read = visited.filter("captured").select(F.col("url").alias("src"), F.col("ord").alias("_parent"), (F.col("wave") + 1).alias("wave"))
        found = read.join(edges, "src").select(F.col("dst").alias("url"), "wave", F.concat("_parent", place(F.col("pos"))).alias("ord"))
        first = found.groupBy("url").agg(F.min(F.struct("wave", "ord")).alias("at"))
        known = done.select("url") if redirects is None else done.select("url").union(done.select("canonical"))
        known = known if waiting is None else known.union(waiting.select("url"))
        kind = patterns.in_scope(urls.path("url"), match, exclude) if scoped else F.lit("queued")
        new = first.join(known, "url", "left_anti").select("url", "at.wave", "at.ord", kind.alias("kind"))
        new = checkpoint(new if waiting is None else new.unionByName(waiting))
        if scoped:
            done = done.unionByName(new.filter("kind <> 'queued'").select("url", F.col("kind").alias("status"), "wave", "ord", F.col("url").alias("canonical"), F.lit(False).alias("captured")))
        frontier = new.filter("kind = 'queued'").select("url", "wave", "ord")
    rest = frontier.select("url", F.lit("queued").alias("status"), "wave", "ord", F.col("url").alias("canonical"), F.lit(False).alias("captured"))
    return done.unionByName(rest)


def collapse_redirects(visits: DataFrame) -> DataFrame:
    """visits (ord, requested, canonical): the first visit of a canonical URL is captured, later ones are duplicates."""
    first = visits.groupBy("canonical").agg(F.min("ord").alias("_first"))
    return visits.join(first, "canonical").select("ord", "requested", "canonical", (F.col("ord") == F.col("_first")).alias("captured"))


def reconcile(state: DataFrame, snapshots: DataFrame, match: list[str] | None = None, exclude: list[str] | None = None, retry_failed: bool = False) -> DataFrame:
    """A resumed crawl's state: (url, status). state has (url, status, canonical), snapshots (url). Completed URLs without a snapshot of their own or of their
    canonical URL are queued again; discovered URLs outside every set are queued if in scope, else excluded; failed ones only on demand."""
    held = snapshots.select("url").distinct()
    target = state.withColumn("target", F.coalesce("canonical", "url"))
    kept = target.join(held.select(F.col("url").alias("target"), F.lit(True).alias("has")), "target", "left")
    scope = patterns.in_scope(urls.path("url"), match, exclude)
    loose = F.when(scope == "queued", "queued").otherwise("excluded")
    status = (
        F.when((F.col("status") == "completed") & F.col("has").isNull(), "queued")
        .when((F.col("status") == "discovered") & F.col("has").isNotNull(), "completed")
        .when(F.col("status") == "discovered", loose)
        .when((F.col("status") == "failed") & F.lit(retry_failed), "queued")
        .otherwise(F.col("status"))
    )
    return kept.select("url", status.alias("status"))


def crawl_status(state: DataFrame) -> DataFrame:
    """One row of counts by status; found says whether anything is left to do."""
    n = lambda s: F.count_if(F.col("status") == s)
    return state.agg(n("completed").alias("completed"), n("queued").alias("queued"), n("failed").alias("failed"), n("excluded").alias("excluded"), F.coalesce(F.count_if(F.col("status").isin("queued", "failed")) > 0, F.lit(False)).alias("interrupted"))


def initial_state(start_url: str, match: list[str] | None = None, config: dict | None = None, now: str = "") -> dict:
    """The state file of a crawl that has only its start."""
    start = urls.start_url(start_url)
    return {"version": 1, "startUrl": start, "match": match, "discoveredUrls": [start], "completedUrls": [], "failedUrls": [], "excludedUrls": [], "queue": [start], "redirects": {}, "startedAt": now, "updatedAt": now, "config": config or {}}


def restored(exclude: list[str] | None, preserve_query: bool | None, saved: dict | None) -> tuple[list[str] | None, bool | None]:
    """Settings of a resumed crawl: what isn't given comes from the saved configuration."""
    saved = saved or {}
    return exclude or saved.get("exclude") or exclude, saved.get("preserveQuery") if preserve_query is None else preserve_query


def list_mode(listed: DataFrame, captured: DataFrame, earlier: DataFrame | None = None, retry_failed: bool = False) -> DataFrame:
    """A crawl of a given list, without following links: (ord, url, status), one row a listed URL, by the URL asked for. listed (ord, url): repeats go; captured (url): the pages
    that came; earlier (url, status): completed URLs stay so, failed ones are left failed unless retried."""
    once = listed.groupBy("url").agg(F.min("ord").alias("ord"))
    came = once.join(captured.select("url").distinct().withColumn("_came", F.lit(True)), "url", "left")
    now = F.when(F.col("_came"), "completed").otherwise("failed")
    if earlier is None:
        return came.select("ord", "url", now.alias("status"))
    before = earlier.groupBy("url").agg(F.min("status").alias("_before"))
    fixed = F.col("_before") == "completed" if retry_failed else F.col("_before").isin("completed", "failed")
    return came.join(before, "url", "left").select("ord", "url", F.when(fixed, F.col("_before")).otherwise(now).alias("status"))


def may_start_fresh(state: DataFrame) -> bool:
    """Whether a fresh crawl would overwrite no completed page."""
    return state.filter("status = 'completed'").isEmpty()


def progress(done: int, queued: int, cells: int = 20) -> str:
    """A text bar of a crawl under way."""
    share = (done + 1) / (done + queued + 1)
    full = int(share * cells + 0.5)
    return "[" + "#" * full + "-" * (cells - full) + f"] {int(share * 100 + 0.5)}%"


def keep_first_urls(listed: DataFrame) -> DataFrame:
    """A URL list without repeats, first occurrences in order."""
    return keep_first(listed, ["url"], ["ord"])
