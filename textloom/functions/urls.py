"""URL columns, all in native expressions.

Well-formed absolute URLs are split by one pattern; anything else is null (``page_name`` gives "page"). Host and scheme are
lower-cased and default ports dropped. Dot segments and raw non-ASCII characters are kept as they stand; pass URLs through
``whatwg`` first where a crawl may hold such.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_match

SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?$"

# Query parameters that only say how a visitor arrived. Names starting with utm_ count too.
TRACKING = ["_hsenc", "_hsmi", "hslang", "hsctatracking", "gclid", "fbclid", "msclkid", "mkt_tok", "_ga", "_gl"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _part(url: Column | str, k: int) -> Column:
    c = _col(url)
    return F.when(c.rlike(SHAPE), F.regexp_extract(c, SHAPE, k))


def host(url: Column | str) -> Column:
    """Host name without user or port."""
    bare = F.regexp_replace(F.lower(_part(url, 2)), "^.*@", "")
    return F.regexp_replace(bare, ":[0-9]*$", "")


def origin(url: Column | str) -> Column:
    """scheme://host[:port], default ports dropped."""
    scheme = F.lower(_part(url, 1))
    place = F.regexp_replace(F.lower(_part(url, 2)), "^.*@", "")
    usual = ((scheme == "http") & place.endswith(":80")) | ((scheme == "https") & place.endswith(":443"))
    return F.concat(scheme, F.lit("://"), F.when(usual, F.regexp_replace(place, ":[0-9]+$", "")).otherwise(place))


def path(url: Column | str) -> Column:
    """Path; "/" where the URL has none."""
    p = _part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def search(url: Column | str) -> Column:
    """Query with its question mark, or empty; a lone question mark counts as none."""
    q = _part(url, 4)
    return F.when(q == "?", F.lit("")).otherwise(q)


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("utm_") | low.isin(TRACKING)


def kept_query(url: Column | str) -> Column:
    """Query without tracking parameters, order kept, form-encoded spaces, every parameter with "="; empty if none is left."""
    params = F.filter(F.split(F.substring(search(url), 2, 1 << 30), "&"), lambda p: (p != "") & ~is_tracking(F.regexp_extract(p, "^([^=]*)", 1)))
    shown = F.transform(params, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    joined = F.regexp_replace(F.array_join(shown, "&"), "%20", "+")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def normalize(url: Column | str, preserve_query: bool = False) -> Column:
    """A page's identity: origin and path without trailing slashes or fragment; the query only on demand, cleaned of tracking."""
    bare = F.concat(origin(url), F.regexp_replace(path(url), "/+$", ""))
    return F.concat(bare, kept_query(url)) if preserve_query else bare


def canonical(requested: Column | str, landed: Column | str, start_url: Column | str, match: list[str] | None = None, exclude: list[str] | None = None, preserve_query: bool = False) -> Column:
    """Where a page that was asked for at one URL and landed at another belongs: the landed URL if it is in scope, else the requested."""
    asked, came = normalize(requested, preserve_query), normalize(landed, preserve_query)
    scope = origin(landed).eqNullSafe(origin(start_url)) & (F.lit(True) if match is None else any_match(path(landed), match)) & (F.lit(True) if not exclude else ~any_match(path(landed), exclude))
    return F.when(asked.isNull() | came.isNull() | (asked == came) | ~scope, _col(requested)).otherwise(came)


def page_name(url: Column | str) -> Column:
    """File name of a page: its path with hyphens (80 characters at most), the host where the path is empty, a digest of the query appended."""
    flat = F.regexp_replace(path(url), "^/+|/+$", "")
    named = F.substring(F.regexp_replace(F.regexp_replace(flat, "[^A-Za-z0-9-]", "-"), "-+", "-"), 1, 80)
    base = F.when(flat == "", F.regexp_replace(host(url), "\\.", "-")).otherwise(named)
    digest = F.when(search(url) == "", F.lit("")).otherwise(F.concat(F.lit("-"), F.substring(F.sha1(search(url)), 1, 8)))
    return F.coalesce(F.concat(base, digest), F.lit("page"))


def inspect_name(url: Column | str) -> Column:
    """Name of an inspection dump: the path with hyphens, or "index"."""
    flat = F.regexp_replace(F.regexp_replace(path(url), "^/|/$", ""), "/", "-")
    return F.when(flat == "", F.lit("index")).otherwise(F.coalesce(flat, F.lit("index")))


def same_host(url: Column | str, base: Column | str) -> Column:
    return F.coalesce(host(url) == host(base), F.lit(False))


def same_origin(url: Column | str, base: Column | str) -> Column:
    return F.coalesce(origin(url) == origin(base), F.lit(False))


def login_like(requested: Column | str, landed: Column | str, title: Column | str) -> Column:
    """The browser seems to have been sent to a sign-in page."""
    low = F.lower(F.coalesce(_col(title), F.lit("")))
    return ~same_host(landed, requested) | low.contains("sign in") | low.contains("log in") | low.contains("sso") | low.contains("authenticate")


def resolve(base: Column | str, href: Column | str) -> Column:
    """An href against its page: absolute, scheme-relative, root-relative, query or fragment only, or relative; dot segments are kept."""
    return F.transform(F.array(page_base(base)), lambda b: resolve_at(b, _col(href)))[0]


def page_base(url: Column | str) -> Column:
    """What resolving against a page needs, reckoned once: scheme with colon, origin, folder, bare URL, query."""
    c = _col(url)
    return F.struct(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("scheme"), origin(c).alias("origin"), F.regexp_replace(path(c), "[^/]*$", "").alias("folder"), F.concat(origin(c), path(c)).alias("bare"), search(c).alias("search"))


def resolve_at(base: Column, href: Column) -> Column:
    """``resolve`` against a ``page_base``."""
    h = F.trim(href)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(base["scheme"], h))
        .when(h.startswith("/"), F.concat(base["origin"], h))
        .when(h.startswith("?"), F.concat(base["bare"], h))
        .when(h.startswith("#") | (h == ""), F.concat(base["bare"], base["search"], h))
        .otherwise(F.concat(base["origin"], base["folder"], h))
    )


def start_url(url: str) -> str:
    """A crawl's start URL: trailing slashes go, nothing else."""
    return url.rstrip("/")


def auto_match(start_url: str) -> list[str] | None:
    """The scope that a start URL suggests: everything below its path; none for the root."""
    from urllib.parse import urlsplit

    p = urlsplit(start_url).path.rstrip("/")
    return [f"{p}/**"] if p else None


def whatwg_text(url: str | None) -> str | None:
    """A URL as browsers write it: dot segments resolved, path and query percent-encoded, host in lower case; None if it isn't one."""
    from urllib.parse import quote, urlsplit

    if not url:
        return None
    parts = urlsplit(url.strip())
    if not parts.scheme or not parts.netloc:
        return None
    out: list[str] = []
    names = parts.path.replace("\\", "/").split("/")[1:]
    for k, name in enumerate(names):
        plain = name.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        elif plain != ".":
            out.append(name)
        if plain in (".", "..") and k == len(names) - 1:
            out.append("")
    # the characters that paths and queries keep as they are
    fixed = quote("/" + "/".join(out), safe="/%:@!$&'()*+,;=~-._[]|")
    query = "?" + quote(parts.query, safe="/%:@!$&()*+,;=~-._?[]|{}`^\\") if parts.query else ""
    fragment = "#" + parts.fragment if parts.fragment else ""
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{fixed}{query}{fragment}"


def whatwg(url: Column | str) -> Column:
    """``whatwg_text`` as an Arrow-batched column."""

    @F.pandas_udf("string")
    def fix(urls):
        return urls.map(whatwg_text)

    return fix(_col(url))
