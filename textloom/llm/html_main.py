"""Main text of web pages by nearest-URL page differencing.

1. Each page becomes text lines: a small tolerant HTML reader drops scripts, styles, comments and markup, decodes character
   references and closes a line at every block border. A line knows whether it stands inside an article or main element, inside
   furniture (elements that the HTML standard gives that role, or containers that are called so), and in which container of the article.
2. Pages of one host are ordered by URL path; the nearest URL of a page is, among the REACH pages before and after it, the one that shares the longest path
   prefix, then the closest. Pages that are nearly the same (copies) are passed over: their difference says nothing. The two pages' lines are aligned by longest
   common subsequence.
3. On a page without article or main element shared lines are deleted. On a page with one, the shared lines of a container are deleted where they are half
   of it or more; the article's own lines stay even where a neighbour repeats them: a passage that two articles share is main text of both.
4. What is left of the page is joined by newlines.

Differencing alone cannot meet the contract: menus and adverts that differ from page to page would stay, so structure decides first (figures in the README).

Pages are dealt by (host, path) into ranges of about RANGE_BYTES, so a host with a third of all pages spreads over many tasks. The ranges come from the keys alone;
each hands its first and last REACH pages to the ranges beside it, so a page's neighbours, and with them the result, do not depend on where ranges end.
Null and empty html give an empty text, a null or odd URL has the empty host; repeated rows are copies of each other, so they get the same text; very long pages are
read whole, with memory in proportion to their lines (the alignment is split in halves). Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element names of the HTML standard by what they do to lines, and usual names of page furniture.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg select option button canvas title".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
NAMES = "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
#: Elements that hold running text: their names say nothing about furniture, and they make no container.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ol ul li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption details summary address hgroup a abbr b bdi bdo cite code del dfn em i ins kbd mark math q s samp small strong sub sup time u var".split())
#: Pages looked at either way for the nearest different one; bytes of pages in a range; share of equal lines from which on two pages are the same.
REACH, RANGE_BYTES, SAME = 8, 8 << 20, 0.9
_FURNITURE_NAME = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(NAMES)})(?:$|[\s_-])", re.I)
#: Inside an article a header is the article's own, so that name alone says nothing there.
_INNER_NAME = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(n for n in NAMES if n != 'header')})(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![\w:-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"\s+")


def lines_of(page: str | None) -> list[tuple[str, bool, bool, int]]:
    """(text, inside an article, inside furniture, container within the article or 0) of each line, in page order."""
    out: list[tuple[str, bool, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, article, furniture, container
    opened: Counter = Counter()
    containers = 0
    page = page or ""

    def close() -> None:
        text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, *(stack[-1][1:] if stack else (False, False, 0))))

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                close()
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            if name in BLOCK:
                close()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            close()
            while stack and stack[-1][0] not in BLOCK and not stack[-1][2]:  # inline elements left open end with the line
                pop()
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"):
                pop()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        _, article, furniture, container = stack[-1] if stack else ("", False, False, 0)
        named = " ".join(x for g in _NAMED.findall(m[3]) for x in g if x)
        own = name in FURNITURE and not (name == "header" and article)
        called = bool(named) and name not in PROSE and name not in ("html", "body", "article", "main") and bool((_INNER_NAME if article else _FURNITURE_NAME).search(named))
        if article and name in BLOCK and name not in PROSE and name != "article":
            containers += 1
            container = containers
        stack.append((name, article or name in ("article", "main"), furniture or own or called, container))
        opened[name] += 1
    close()
    return out


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a and each prefix of b, by bit-parallel rows."""
    where: dict[int, int] = {}
    for k, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Places of x in a longest common subsequence with y; halves of x are solved apart where a table would be large."""
    if len(x) * len(y) > TABLE and len(x) > 1:
        half = len(x) // 2
        total = _prefix_lengths(x[:half], y) + _prefix_lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(total))
        return _aligned(x[:half], y[:cut]) + [half + k for k in _aligned(x[half:], y[cut:])]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    y_ = np.array(y, np.int64)
    for i in range(len(x) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], np.where(y_ == x[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


#: Cells of an alignment's table at most (4 bytes each).
TABLE = 1 << 20


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of a are in a longest common subsequence with b. Equal ends are matched first."""
    keep = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    hi_a, hi_b = len(a), len(b)
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
        keep[hi_a] = True
    common_ = set(a[lo:hi_a]) & set(b[lo:hi_b])
    if not common_:
        return keep
    x = [k for k in range(lo, hi_a) if a[k] in common_]
    for k in _aligned([a[k] for k in x], [v for v in b[lo:hi_b] if v in common_]):
        keep[x[k]] = True
    return keep


def main_lines(lines: list[tuple[str, bool, bool, int]], shared: list[bool]) -> list[str]:
    """Lines left once furniture and what differencing deletes are gone."""
    if not any(x[1] for x in lines):
        return [t for (t, _, furniture, _), s in zip(lines, shared, strict=True) if not furniture and not s]
    held, met = Counter(), Counter()
    for (_, article, furniture, container), s in zip(lines, shared, strict=True):
        if article and not furniture and container:
            held[container] += 1
            met[container] += s
    return [t for (t, article, furniture, c), s in zip(lines, shared, strict=True) if article and not furniture and not (s and 2 * met[c] >= held[c] > 0)]


def _print(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _prefix(a: str, b: str) -> int:
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearest_of(page: dict, before: list[dict], after: list[dict]) -> dict | None:
    """The nearest different page of the host; before and after: closest first."""
    options = sorted(((-_prefix(p["path"], page["path"]), d, side, p) for side, near in enumerate((before, after)) for d, p in enumerate(near) if p["host"] == page["host"]), key=lambda o: o[:3])
    for _, _, _, p in options:
        both = sum((page["counts"] & p["counts"]).values())
        if both < SAME * max(len(page["prints"]), len(p["prints"])):
            return p
    return None


_KEY = ("host", "path", "page_key", "url_key")
_DEALT = "dest long, own boolean, host string, path string, page_key long, url_key long, page_id long, url string, html string"
_RESULT = "page_id long, url string, text string, n_chars long, n_shared long, nearest_url string"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first key, the last key to hand back, the first key to hand on."""
    head, tail = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = lambda b: list(zip(*(b.column(k).to_pylist() for k in range(4))))
        if len(head) < REACH:
            head += rows(batch.slice(0, REACH - len(head)))
        tail = (tail + rows(batch.slice(max(0, batch.num_rows - REACH))))[-REACH:]
    if head:
        keys = (head[0], head[-1], tail[0])
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([key[k]], kinds[k]) for key in keys for k in range(4)], names=[f"{n}{k}" for n in ("first", "back", "on") for k in range(4)])


_EDGES = ", ".join(f"{n}{k} {t}" for n in ("first", "back", "on") for k, t in enumerate(("string", "string", "long", "long")))


def _deal(edges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each page to its range, and to the range beside it if it stands near the border."""
        firsts, backs, ons = edges.value
        for batch in batches:
            rows, dest, own = [], [], []
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in _KEY))):
                p = max(bisect_right(firsts, key) - 1, 0)
                for d, hands in ((p, True), (p - 1, key <= backs[p]), (p + 1, key >= ons[p])):
                    if hands and 0 <= d < len(firsts):
                        rows.append(k)
                        dest.append(d)
                        own.append(d == p)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(own, pa.bool_()), *taken.columns], names=["dest", "own", *taken.schema.names])

    return run


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order of (range, host, path): each against the nearest different page among REACH on either side."""
    out: list[tuple] = []
    window: list[dict] = []  # the pages waiting for those after them, behind up to REACH done ones
    done = 0

    def finish(k: int) -> None:
        page = window[k]
        if not page["own"]:
            return
        near = nearest_of(page, window[max(0, k - REACH) : k][::-1], window[k + 1 : k + 1 + REACH])
        shared = shared_lines(page["prints"], near["prints"]) if near else [False] * len(page["prints"])
        text = "\n".join(main_lines(page["lines"], shared))
        out.append((page["page_id"], page["url"], text, len(text), sum(shared), near["url"] if near else None))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in _RESULT.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for page in batch.slice(at, 256).to_pylist():
                if window and window[-1]["dest"] != page["dest"]:
                    for k in range(done, len(window)):
                        finish(k)
                    window, done = [], 0
                page["lines"] = lines_of(page.pop("html"))
                page["prints"] = [_print(x[0]) for x in page["lines"]]
                page["counts"] = Counter(page["prints"])
                window.append(page)
                if len(window) - done > REACH:
                    finish(done)
                    done += 1
                    if done > REACH:
                        window.pop(0)
                        done -= 1
            if out:
                yield flush()
    for k in range(done, len(window)):
        finish(k)
    if out:
        yield flush()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_shared (lines the nearest page has too), nearest_url."""
    bare = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    page_id = F.col(id_col).cast("long")
    keys = pages.select(host.alias("host"), path.alias("path"), F.coalesce(page_id, F.lit(-(1 << 63))).alias("page_key"), F.xxhash64(url_col).alias("url_key"))
    ranges = common.pieces_for(pages, range_bytes)
    ordered = keys.repartitionByRange(ranges, *_KEY).sortWithinPartitions(*_KEY)
    found = sorted(tuple(tuple(r[4 * n : 4 * n + 4]) for n in range(3)) for r in ordered.mapInArrow(_edges, _EDGES).collect())
    edges = pages.sparkSession.sparkContext.broadcast(tuple(zip(*found)) if found else ((("", "", 0, 0),),) * 3)
    keyed = pages.select(host.alias("host"), path.alias("path"), F.coalesce(page_id, F.lit(-(1 << 63))).alias("page_key"), F.xxhash64(url_col).alias("url_key"), page_id.alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    dealt = keyed.mapInArrow(_deal(edges), _DEALT).repartitionById(max(1, len(found)), F.col("dest").cast("int")).sortWithinPartitions("dest", *_KEY)
    return dealt.mapInArrow(_difference, _RESULT)


def brute_force(pages: list[tuple]) -> dict:
    """(page_id, url): text of a small list of (page_id, url, html), by sorting the whole list and plain tables; for tests."""
    rows = []
    for page_id, url, html in pages:
        bare = re.sub(r"[?#].*$", "", url or "", flags=re.S)
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/]*)(.*)", bare, re.S)
        lines = lines_of(html)
        rows.append({"host": m[1].lower() if m else "", "path": m[2] if m else bare, "id": page_id, "url": url, "lines": lines, "prints": [x[0] for x in lines], "counts": Counter(x[0] for x in lines)})
    rows.sort(key=lambda r: (r["host"], r["path"], -(1 << 63) if r["id"] is None else r["id"]))
    out = {}
    for k, page in enumerate(rows):
        near = nearest_of(page, rows[max(0, k - REACH) : k][::-1], rows[k + 1 : k + 1 + REACH])
        x, y = page["prints"], near["prints"] if near else []
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if x[i] == y[j] else max(table[i + 1][j], table[i][j + 1])
        out[page["id"], page["url"]] = (table[0][0], near["url"] if near else None)
    return out
