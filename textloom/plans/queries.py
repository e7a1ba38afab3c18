"""The named queries and, where SQL can express them, the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images as image_functions
from ..functions import patterns, urls
from ..operators import chunking, convert, frontier, links, manifest, tree
from ..operators import images as image_operators
from ..sources import files, html_nodes

NOW = "2024-01-01T00:00:00.000Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- URLs

_PARSED = r"""p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]+)', 1)) AS origin,
 lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) END AS path,
 CASE WHEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS search FROM pages)"""
_BARE = "origin || regexp_replace(path, '/+$', '')"
_KEPT = "array_to_string(list_transform(list_filter(string_split(substr(search, 2), '&'), lambda q: q <> '' AND NOT (starts_with(lower(string_split(q, '=')[1]), 'utm_') OR lower(string_split(q, '=')[1]) IN ('_hsenc','_hsmi','hslang','hsctatracking','gclid','fbclid','msclkid','mkt_tok','_ga','_gl'))), lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END), '&')"
_NAME = "CASE WHEN regexp_replace(path, '^/+|/+$', '', 'g') = '' THEN replace(host, '.', '-') ELSE substr(regexp_replace(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '[^A-Za-z0-9-]', '-', 'g'), '-+', '-', 'g'), 1, 80) END || CASE WHEN search = '' THEN '' ELSE '-' || substr(sha1(search), 1, 8) END"
_WITH_QUERY = f"{_BARE} || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END"


@query(f"WITH {_PARSED} SELECT page_id, {_BARE} AS link FROM p")
def url_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.normalize("url").alias("link"))


@query(f"WITH {_PARSED} SELECT page_id, {_WITH_QUERY} AS link FROM p")
def url_normalize_keep_query(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.normalize("url", True).alias("link"))


@query(f"WITH {_PARSED} SELECT page_id, {_NAME} AS page_name FROM p")
def page_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.page_name("url").alias("page_name"))


@query(f"WITH {_PARSED} SELECT {_NAME} AS page_name, count(DISTINCT {_WITH_QUERY}) AS n_urls FROM p GROUP BY 1 HAVING count(DISTINCT {_WITH_QUERY}) > 1")
def name_collisions(spark, sf_dir):
    return manifest.name_collisions(_table(spark, sf_dir, "pages"))


@query(rf"""WITH {_PARSED} SELECT CASE WHEN NOT regexp_matches(path, '^/(en|de)(/.*)?$') THEN 'unmatched' WHEN regexp_matches(path, '^/[^/]+/1[^/]*$') OR regexp_matches(path, '^/de/[^/]*\.html$') THEN 'excluded' ELSE 'queued' END AS status, count(*) AS n FROM p GROUP BY 1""")
def scope_classify(spark, sf_dir):
    status = patterns.in_scope(urls.path("url"), ["/{en,de}/**"], ["/*/1*", "/de/*.html"])
    return _table(spark, sf_dir, "pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_PARSED} SELECT page_id, CASE WHEN regexp_matches(path, '^/(en|fr)/[0-9]{{2,3}}(/|$)') THEN 'queued' ELSE 'unmatched' END AS status FROM p""")
def scope_regex(spark, sf_dir):
    # the second pattern is no valid expression and so matches nothing
    return _table(spark, sf_dir, "pages").select("page_id", patterns.in_scope(urls.path("url"), ["re:^/(en|fr)/[0-9]{2,3}(/|$)", "re:[unclosed"]).alias("status"))


_LANDED = "CASE page_id % 5 WHEN 0 THEN {url} WHEN 1 THEN {url} || '/' WHEN 2 THEN 'https://login.example.com/sign-in' WHEN 3 THEN {bare} || '-moved#top' ELSE 'not a url' END"


@query(rf"""WITH {_PARSED}, l AS (SELECT *, {_LANDED.format(url=f"({_BARE})", bare=f"({_BARE})")} AS landed FROM p),
m AS (SELECT page_id, url, {_BARE} AS asked, origin AS o, landed, CASE WHEN landed = 'not a url' THEN NULL ELSE regexp_replace(regexp_replace(landed, '#.*$', ''), '/+$', '') END AS came FROM l)
SELECT page_id, CASE WHEN came IS NULL OR came = asked OR NOT starts_with(came, o || '/') OR regexp_matches(came, '^[^:]+://[^/]+/de/') THEN url ELSE came END AS canonical FROM m""")
def canonical_url(spark, sf_dir):
    bare = urls.normalize("url")
    landed = F.when(F.col("page_id") % 5 == 0, bare).when(F.col("page_id") % 5 == 1, F.concat(bare, F.lit("/"))).when(F.col("page_id") % 5 == 2, F.lit("https://login.example.com/sign-in")).when(F.col("page_id") % 5 == 3, F.concat(bare, F.lit("-moved#top"))).otherwise(F.lit("not a url"))
    pages = _table(spark, sf_dir, "pages").withColumn("landed", landed)
    return pages.select("page_id", urls.canonical("url", "landed", "url", None, ["/de/**"]).alias("canonical"))


@query(rf"""WITH {_PARSED} SELECT page_id, host <> CASE WHEN page_id % 3 = 0 THEN 'login.example.com' ELSE host END OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'sso') OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'sign in') OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'log in') OR contains(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'authenticate') AS login FROM p""")
def login_flag(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").withColumn("landed", F.when(F.col("page_id") % 3 == 0, "https://login.example.com/").otherwise(F.col("url")))
    return pages.select("page_id", urls.login_like("url", "landed", F.regexp_extract("html", "<title>([^<]*)", 1)).alias("login"))


@query("""WITH l AS (SELECT page_id AS ord, CASE page_id % 4 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN '# ' || url WHEN 2 THEN '   ' ELSE regexp_replace(url, '[0-9]+', '1', 'g') END AS line FROM pages), c AS (SELECT ord, trim(line) AS url FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))
SELECT url, min(ord) AS ord FROM c GROUP BY url""")
def url_list_clean(spark, sf_dir):
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(k == 1, F.concat(F.lit("# "), "url")).when(k == 2, F.lit("   ")).otherwise(F.regexp_replace("url", "[0-9]+", "1"))
    lines = files.clean_lines(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), line.alias("value")))
    return lines.groupBy("url").agg(F.min("ord").alias("ord"))


# ---------------------------------------------------------------- links and frontier

_LINKS = rf"""{_PARSED}, h AS (SELECT *, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM p), l AS (SELECT page_id, origin, host, unnest(range(len(hrefs))) AS ord, unnest(hrefs) AS href FROM h),
r AS (SELECT page_id, origin, host, ord, href, origin || href AS url FROM l)"""


@query(f"WITH {_LINKS} SELECT page_id, cast(ord AS int) AS ord, href, url FROM r")
def links_extract(spark, sf_dir):
    return links.html_links(_table(spark, sf_dir, "pages")).select("page_id", "ord", "href", "url")


@query(rf"WITH {_LINKS} SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS link, cast(min(ord) AS int) AS ord FROM r WHERE NOT regexp_matches(href, '\s') GROUP BY 1, 2")
def links_dedup(spark, sf_dir):
    return links.extract_links(links.html_links(_table(spark, sf_dir, "pages"))).select("page_id", "link", "ord")


@query(rf"WITH {_LINKS} SELECT host, count(DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS n_links FROM r WHERE NOT regexp_matches(href, '\s') GROUP BY 1")
def links_same_host(spark, sf_dir):
    found = links.extract_links(links.html_links(_table(spark, sf_dir, "pages")))
    return found.groupBy(urls.host("link").alias("host")).agg(F.countDistinct("link").alias("n_links"))


def _graph(spark, sf_dir):
    """Edges page i -> 2i+1 and 2i+2, as far as there are such pages."""
    ids = _table(spark, sf_dir, "pages").select("page_id")
    children = ids.select(F.col("page_id").alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    edges = children.select(F.col("i"), "pos", (2 * F.col("i") + 1 + F.col("pos")).alias("page_id")).join(ids, "page_id", "left_semi")
    named = edges.select(F.concat(F.lit("n"), "i").alias("src"), "pos", F.concat(F.lit("n"), "page_id").alias("dst"))
    start = ids.filter("page_id = 0").select(F.lit("n0").alias("url"), F.lit(0).alias("ord"))
    return named, start


_BFS = "RECURSIVE b(id, wave, ord) AS (SELECT page_id, 0, '000000' FROM pages WHERE page_id = 0 UNION ALL SELECT p.page_id, b.wave + 1, b.ord || lpad((p.page_id - 2 * b.id - 1)::VARCHAR, 6, '0') FROM b JOIN pages p ON p.page_id IN (2 * b.id + 1, 2 * b.id + 2))"


@query(f"WITH {_BFS} SELECT 'n' || id AS url, 'completed' AS status, wave, ord FROM b")
def frontier_bfs(spark, sf_dir):
    edges, start = _graph(spark, sf_dir)
    return frontier.bfs(edges, start, scoped=False).select("url", "status", "wave", "ord")


@query(f"WITH {_BFS} SELECT 'n' || id AS url, CASE WHEN id < 50 THEN 'completed' ELSE 'queued' END AS status, wave, ord FROM b WHERE id <= 100")
def frontier_budget(spark, sf_dir):
    edges, start = _graph(spark, sf_dir)
    return frontier.bfs(edges, start, max_pages=50, scoped=False).select("url", "status", "wave", "ord")


@query(f"WITH {_PARSED}, v AS (SELECT page_id AS ord, url AS requested, {_BARE} AS canonical FROM p) SELECT ord, requested, canonical, ord = min(ord) OVER (PARTITION BY canonical) AS captured FROM v")
def redirect_collapse(spark, sf_dir):
    visits = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("requested"), urls.normalize("url").alias("canonical"))
    return frontier.collapse_redirects(visits).select("ord", "requested", "canonical", "captured")


_STATE = "s AS (SELECT url, path, CASE page_id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'queued' WHEN 4 THEN 'excluded' ELSE 'discovered' END AS status, page_id FROM p)"


def _state(spark, sf_dir):
    names = F.array(*map(F.lit, ("completed", "completed", "failed", "queued", "excluded", "discovered")))
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.element_at(names, (F.col("page_id") % 6 + 1).cast("int")).alias("status"), F.lit(None).cast("string").alias("canonical"))


@query(rf"""WITH {_PARSED}, {_STATE}, k AS (SELECT DISTINCT url FROM s WHERE page_id % 4 <> 0)
SELECT s.url, CASE WHEN status = 'completed' AND k.url IS NULL THEN 'queued' WHEN status = 'discovered' AND k.url IS NOT NULL THEN 'completed' WHEN status = 'discovered' AND regexp_matches(path, '^/en(/.*)?$') THEN 'queued' WHEN status = 'discovered' THEN 'excluded' WHEN status = 'failed' THEN 'queued' ELSE status END AS status FROM s LEFT JOIN k ON s.url = k.url""")
def resume_reconcile(spark, sf_dir):
    state = _state(spark, sf_dir)
    return frontier.reconcile(state, state.filter("page_id % 4 <> 0").select("url"), ["/en/**"], None, retry_failed=True)


@query(f"WITH {_PARSED}, {_STATE} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status IN ('queued', 'failed')) > 0 AS interrupted FROM s")
def crawl_status(spark, sf_dir):
    return frontier.crawl_status(_state(spark, sf_dir))


# ---------------------------------------------------------------- chunks

_SMALL = chunking.ChunkConfig(1500, 200, False)


def _last(mark: str) -> str:
    """0-based place of the last mark in seg, or -1."""
    back = f"chr({ord(mark[-1])})" + (f" || chr({ord(mark[0])})" if len(mark) > 1 else "")
    return f"(CASE WHEN strpos(reverse(seg), {back}) = 0 THEN -1 ELSE length(seg) - strpos(reverse(seg), {back}) - {len(mark) - 1} END)"


def _char_cte(size: int, overlap: int, stop: str, source: str = "SELECT doc_id, text FROM documents") -> str:
    point = f"CASE WHEN {_last('. ')} > length(seg) * 0.5 THEN {_last('. ')} + 2 WHEN {_last(chr(10) * 2)} > length(seg) * 0.3 THEN {_last(chr(10) * 2)} + 2 WHEN {_last(chr(10))} > length(seg) * 0.3 THEN {_last(chr(10))} + 1 WHEN {_last(' ')} > length(seg) * 0.3 THEN {_last(' ')} + 1 ELSE length(seg) END"
    step = lambda start: f"(SELECT CASE WHEN {start} + {size} >= length(text) THEN length(text) WHEN bp > {size} * 0.3 THEN {start} + bp ELSE {start} + {size} END FROM (SELECT {point} AS bp FROM (SELECT substr(text, cast({start} + 1 AS bigint), {size}) AS seg)))"
    return f"""RECURSIVE d AS (SELECT * FROM ({source}) WHERE length(text) > {size}), c(doc_id, text, k, a, b) AS (SELECT doc_id, text, 0, 0::BIGINT, {step('0')}::BIGINT FROM d
UNION ALL SELECT doc_id, text, k + 1, s, {step('s')}::BIGINT FROM (SELECT *, greatest(b - {overlap}, a + 1) AS s FROM c WHERE {stop}) WHERE s < length(text))"""


def _chunks(spark, sf_dir, config):
    return chunking.chunk(_table(spark, sf_dir, "documents"), "doc_id", "text", config)


@query(f"WITH {_char_cte(1500, 200, 'b < length(text)')} SELECT doc_id, cast(k AS int) AS chunk_index, cast(a AS int) AS start_pos, cast(b AS int) AS end_pos, substr(text, a + 1, b - a) AS text FROM c UNION ALL SELECT doc_id, 0, 0, cast(length(coalesce(text, '')) AS int), coalesce(text, '') FROM documents WHERE length(coalesce(text, '')) <= 1500")
def chunk_char(spark, sf_dir):
    return _chunks(spark, sf_dir, _SMALL).select("doc_id", "chunk_index", "start_pos", "end_pos", "text")


@query(f"WITH {_char_cte(1500, 200, 'true')} SELECT doc_id, cast(k AS int) AS chunk_index, cast(a AS int) AS start_pos, cast(b AS int) AS end_pos FROM c UNION ALL SELECT doc_id, 0, 0, cast(length(coalesce(text, '')) AS int) FROM documents WHERE length(coalesce(text, '')) <= 1500")
def chunk_char_legacy(spark, sf_dir):
    return chunking.chunk(_table(spark, sf_dir, "documents"), "doc_id", "text", chunking.ChunkConfig(1500, 200, False, legacy_tail=True)).select("doc_id", "chunk_index", "start_pos", "end_pos")


@query(f"WITH {_char_cte(1500, 200, 'b < length(text)')} SELECT doc_id, cast(k AS int) AS chunk_index, cast(a AS int) AS start_pos, cast(b AS int) AS end_pos FROM c UNION ALL SELECT doc_id, 0, 0, cast(length(coalesce(text, '')) AS int) FROM documents WHERE length(coalesce(text, '')) <= 1500")
def chunk_dispatch(spark, sf_dir):
    return _chunks(spark, sf_dir, _SMALL).select("doc_id", "chunk_index", "start_pos", "end_pos")


def _chunk_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("stem"), "text")
    return chunking.render(docs, chunking.chunk(docs, "stem", "text", _SMALL), "stem", "text", NOW)


_FILES = f"""{_char_cte(1500, 200, 'b < length(text)')}, f AS (SELECT 'doc-' || doc_id AS stem, k + 1 AS chunk, count(*) OVER (PARTITION BY doc_id) AS total_chunks, substr(text, a + 1, b - a) AS body FROM c), g AS (SELECT stem, stem || '-' || CASE WHEN chunk < 1000 THEN lpad(chunk::VARCHAR, 3, '0') ELSE chunk::VARCHAR END || '.md' AS file, chunk, total_chunks, body FROM f WHERE total_chunks > 1)"""


@query(rf"""WITH {_FILES} SELECT stem, file, chunk::INT AS chunk, total_chunks::INT AS total_chunks, '---' || chr(10) || 'source_title: "' || stem || '"' || chr(10) || 'chunk: ' || chunk || chr(10) || 'total_chunks: ' || total_chunks || chr(10) || 'heading_context: "' || replace(regexp_extract(body, '(?m)^(#{{1,6}})\s+(.+)$', 2), '"', '\"') || '"' || chr(10) || 'chunked_at: {NOW}' || chr(10) || '---' || chr(10) || body || chr(10) AS content FROM g""")
def chunk_frontmatter(spark, sf_dir):
    return _chunk_files(spark, sf_dir).select("stem", "file", "chunk", "total_chunks", "content")


@query(f"WITH {_FILES} SELECT stem, '' AS url, stem AS title, count(*) AS chunks, string_agg('chunks/' || file, ' ' ORDER BY chunk) AS files FROM g GROUP BY stem")
def chunk_manifest(spark, sf_dir):
    return chunking.manifest(_chunk_files(spark, sf_dir)).select("stem", "url", "title", "chunks", F.array_join("files", " ").alias("files"))


def _conversations_markdown(spark, sf_dir):
    """# Conversation N, then ## role and the text of each turn in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    held = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x.role, F.lit("\n\n"), F.coalesce(x.text, F.lit("")), F.lit("\n"))), "\n")
    return held.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))


_MARKDOWN = "m AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id)"
_BLANKS = "' ' || chr(10) || chr(9) || chr(13)"
_FOLD = rf"""RECURSIVE {_MARKDOWN}, l AS (SELECT conv_id, unnest(range(len(string_split(markdown, chr(10))))) AS k, unnest(string_split(markdown, chr(10))) AS line FROM m WHERE length(markdown) > 600),
n AS (SELECT *, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS heading, length(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, sum(CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.+)$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS section, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY k) - length(line) - 1 AS pos FROM l),
s AS (SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY section) AS k, max(heading) AS heading, max(level) AS level, string_agg(line || chr(10), '' ORDER BY n.k) AS body, min(pos)::BIGINT AS start FROM n GROUP BY conv_id, section),
f(conv_id, k, cur, st, stack, e1, e1_at, e2, e2_at) AS (SELECT DISTINCT conv_id, 0::BIGINT, '', 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM s
UNION ALL SELECT conv_id, k, CASE WHEN length(joined) > 900 THEN '' ELSE joined END, CASE WHEN length(joined) > 900 THEN start + length(body) ELSE joined_at END, stack, CASE WHEN over THEN cur END, CASE WHEN over THEN st END, CASE WHEN length(joined) > 900 THEN joined END, CASE WHEN length(joined) > 900 THEN joined_at END
FROM (SELECT *, CASE WHEN over THEN again || body ELSE cur || body END AS joined, CASE WHEN over THEN start - length(again) ELSE st END AS joined_at
FROM (SELECT s.conv_id, s.k, s.body, s.start, f.cur, f.st, CASE WHEN s.heading = '' THEN f.stack ELSE list_append(f.stack[1:greatest(s.level - 1, 0)], s.heading) END AS stack, f.cur <> '' AND length(f.cur) + length(s.body) > 600 AS over,
CASE WHEN length(f.cur) <= 80 THEN f.cur WHEN strpos(right(f.cur, 80), chr(10)) > 0 THEN substr(right(f.cur, 80), strpos(right(f.cur, 80), chr(10)) + 1) ELSE right(f.cur, 80) END AS again FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)))"""
_HEADED = f"""WITH {_FOLD}, {_char_cte(600, 80, 'b < length(text)', "SELECT conv_id || ':' || k AS doc_id, e2 AS text FROM f WHERE e2 IS NOT NULL").removeprefix('RECURSIVE ')},
r AS (SELECT conv_id, k, 0 AS kind, 0 AS piece, e1_at AS a, e1_at + length(e1) AS b, trim(e1, {_BLANKS}) AS text, stack FROM f WHERE e1 IS NOT NULL
UNION ALL SELECT f.conv_id, f.k, 1, c.k, f.e2_at + c.a, f.e2_at + c.b, trim(substr(c.text, c.a + 1, c.b - c.a), {_BLANKS}), f.stack FROM f JOIN c ON c.doc_id = f.conv_id || ':' || f.k WHERE trim(substr(c.text, c.a + 1, c.b - c.a), {_BLANKS}) <> ''
UNION ALL SELECT conv_id, k, 2, 0, st, st + length(cur), trim(cur, {_BLANKS}), stack FROM f WHERE trim(cur, {_BLANKS}) <> '' AND k = (SELECT max(s.k) FROM s WHERE s.conv_id = f.conv_id))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k, kind, piece) - 1)::INT AS chunk_index, a::INT AS start_pos, b::INT AS end_pos, text, array_to_string(stack, ' > ') AS heading_context FROM r
UNION ALL SELECT conv_id, 0, 0, length(markdown)::INT, markdown, 'Conversation ' || conv_id FROM m WHERE length(markdown) <= 600"""


@query(_HEADED)
def chunk_heading(spark, sf_dir):
    return chunking.chunk(_conversations_markdown(spark, sf_dir), "conv_id", "markdown", chunking.ChunkConfig(600, 80)).drop("total_chunks")


@query("""WITH m AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(range(len(string_split(markdown, chr(10))))) AS k, unnest(string_split(markdown, chr(10))) AS line FROM m), n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS section, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY k) - length(line) - 1 AS pos FROM l)
SELECT conv_id, section::INT AS section, min(pos)::INT AS start_pos, max(length(regexp_extract(line, '^(#{1,6})\\s+.', 1)))::INT AS level FROM n GROUP BY 1, 2""".replace("\\\\", "\\"))
def markdown_sections(spark, sf_dir):
    lines = _conversations_markdown(spark, sf_dir).select("conv_id", F.posexplode(F.split("markdown", "\n")).alias("k", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("k")
    marked = lines.withColumn("section", F.sum(F.col("line").rlike(r"^#{1,6}\s+.").cast("int")).over(w)).withColumn("pos", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1)
    return marked.groupBy("conv_id", F.col("section").cast("int").alias("section")).agg(F.min("pos").cast("int").alias("start_pos"), F.max(F.length(F.regexp_extract("line", r"^(#{1,6})\s+.", 1))).alias("level"))


# ---------------------------------------------------------------- trees, manifests, Markdown


def _conversation_nodes(spark, sf_dir):
    """A conversation as raw nodes: a document whose children are its turns, with texts that repeat a turn's name below."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    held = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("t"))
    none = F.array().cast("array<struct<name:string,type:string,value:string>>")
    node = lambda i, role, name, backend, children, props: F.struct(i.alias("node_id"), role.alias("role"), name.alias("name"), F.lit(False).alias("ignored"), backend.cast("int").alias("backend_id"), children.alias("child_ids"), props.alias("properties"))
    url = lambda i: F.array(F.struct(F.lit("url").alias("name"), F.lit("string").alias("type"), F.concat(F.lit("/turn/"), i).alias("value")))
    root = node(F.lit("r"), F.lit("document"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.lit(1), F.transform("t", lambda x, i: F.concat(F.lit("t"), i.cast("string"))), none)
    turns = F.transform("t", lambda x, i: node(F.concat(F.lit("t"), i.cast("string")), x.role, x.text, i + 2, F.array(F.concat(F.lit("s"), i.cast("string"))), url(i.cast("string"))))
    texts = F.transform("t", lambda x, i: node(F.concat(F.lit("s"), i.cast("string")), F.lit("StaticText"), x.text, i + 1000, F.array().cast("array<string>"), none))
    return held.select(F.col("conv_id").alias("page_id"), F.concat(F.array(root), turns, texts).alias("nodes"))


_TURNS = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations)"


@query(f"""WITH {_TURNS} SELECT conv_id AS page_id, '[0-1] document: "Conversation ' || conv_id || '"' || chr(10) || string_agg('  [0-' || (i + 2) || '] ' || role || CASE WHEN coalesce(text, '') = '' THEN '' ELSE ': "' || text || '"' END, chr(10) ORDER BY i) AS tree FROM t GROUP BY conv_id""")
def tree_lines(spark, sf_dir):
    return tree.trees(_conversation_nodes(spark, sf_dir)).select("page_id", "tree")


@query(f"WITH {_TURNS} SELECT conv_id AS page_id, (count(*) + 1)::INT AS node_count FROM t GROUP BY conv_id")
def tree_node_count(spark, sf_dir):
    return tree.trees(_conversation_nodes(spark, sf_dir)).select("page_id", "node_count")


@query(f"WITH {_TURNS} SELECT conv_id AS page_id, '0-' || (i + 2) AS element_id, '/turn/' || i AS url, 'link' AS kind FROM t")
def tree_maps(spark, sf_dir):
    nodes = tree.explode_nodes(_conversation_nodes(spark, sf_dir))
    return tree.element_urls(nodes).select("page_id", "element_id", "url", "kind")


@query(f"WITH {_TURNS} SELECT conv_id AS page_id, count(*) AS n_skipped FROM t GROUP BY conv_id")
def tree_skipped(spark, sf_dir):
    nodes = tree.explode_nodes(_conversation_nodes(spark, sf_dir))
    return tree.skipped(nodes).filter("skip").groupBy("page_id").agg(F.count("*").alias("n_skipped"))


def _snapshots(spark, sf_dir):
    return html_nodes.read_snapshots(_table(spark, sf_dir, "pages"), NOW)


@query("""WITH b AS (SELECT page_id, '![a](http://x.example/media/i/' || page_id || '.png?w=1) ![b](i/' || page_id || '.png) ![c](none.png)' AS m FROM pages)
SELECT page_id, '![a](images/p/' || page_id || '.png) ![b](images/p/' || page_id || '.png) ![c](none.png)' AS markdown FROM b""")
def md_image_refs(spark, sf_dir):
    i = F.col("page_id").cast("string")
    held = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("![a](http://x.example/media/i/"), i, F.lit(".png?w=1) ![b](i/"), i, F.lit(".png) ![c](none.png)")).alias("m"), F.create_map(F.concat(F.lit("http://x.example/media/i/"), i, F.lit(".png")), F.concat(F.lit("images/p/"), i, F.lit(".png"))).alias("p"))
    return held.select("page_id", convert.localize_images("m", "p").alias("markdown"))


def _entries(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(urls.host("url").alias("host"), F.col("page_id").alias("ord"), "url", F.concat(F.lit("snapshots/"), urls.page_name("url"), F.lit(".json")).alias("snapshot"), (F.col("page_id") % 3).alias("image_count"))


@query(f"WITH {_PARSED} SELECT host, count(*) AS page_count, sum(page_id % 3)::BIGINT AS total_images FROM p GROUP BY host")
def site_manifest(spark, sf_dir):
    return manifest.site_manifest(_entries(spark, sf_dir), ["host"])


@query(f"""WITH {_PARSED} SELECT host, '# docs — 2024-01-01' || chr(10) || chr(10) || '| Page | Snapshot | Images |' || chr(10) || '|------|----------|--------|' || chr(10) || string_agg('| ' || CASE WHEN length(url) > 60 THEN '...' || right(url, 57) ELSE url END || ' | snapshots/' || {_NAME} || '.json | ' || (page_id % 3) || ' |', chr(10) ORDER BY page_id) || chr(10) || chr(10) || 'Total: ' || count(*) || ' pages, ' || sum(page_id % 3)::BIGINT || ' images' || chr(10) AS markdown FROM p GROUP BY host""")
def index_table(spark, sf_dir):
    return manifest.index_table("docs", _entries(spark, sf_dir), ["host"], "2024-01-01")


# ---------------------------------------------------------------- images


def _fetched(spark, sf_dir):
    """An image a page: PNG, GIF, or SVG headers of sizes that follow from the id; every seventh fetch failed."""
    i = F.col("page_id")
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    side, other = (i % 40) * 10 + 1, (i % 25) * 16 + 1
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D494844520000")), two(side), F.unhex(F.lit("0000")), two(other))
    gif = F.concat(F.unhex(F.lit("474946383961")), F.unhex(F.concat(F.substring(F.lpad(F.hex(side), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(side), 4, "0"), 1, 2), F.substring(F.lpad(F.hex(other), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(other), 4, "0"), 1, 2))))
    svg = F.concat(F.lit('<svg xmlns="x" width="'), side.cast("string"), F.lit('px" viewBox="0 0 9 '), other.cast("string"), F.lit('"></svg>')).cast("binary")
    kind = i % 3
    return _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), (i % 10).cast("string")).alias("page"), i.alias("ord"), F.concat(F.lit("http://x.example/"), i.cast("string"), F.when(kind == 0, ".png").when(kind == 1, ".gif?v=1").otherwise(".svg")).alias("url"), (i % 7 != 0).alias("ok"), F.when(kind == 0, "image/png").when(kind == 1, "").otherwise("image/svg+xml").alias("content_type"), F.when(kind == 0, png).when(kind == 1, gif).otherwise(svg).alias("body"))


_FETCHED = "f AS (SELECT 'p' || (page_id % 10) AS page, page_id AS ord, 'http://x.example/' || page_id || CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.gif?v=1' ELSE '.svg' END AS url, page_id % 7 <> 0 AS ok, CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' ELSE '.svg' END AS ext, ((page_id % 40) * 10 + 1)::INT AS width, ((page_id % 25) * 16 + 1)::INT AS height FROM pages)"


@query(f"WITH {_FETCHED} SELECT ord, width, height FROM f")
def image_dims(spark, sf_dir):
    return _fetched(spark, sf_dir).withColumn("s", image_functions.dimensions("body")).select("ord", "s.width", "s.height")


@query(f"WITH {_FETCHED} SELECT ord, width, height FROM f WHERE ext <> '.svg'")
def image_dims_native(spark, sf_dir):
    return _fetched(spark, sf_dir).withColumn("s", image_functions.native_dimensions("body")).filter("s is not null").select("ord", "s.width", "s.height")


@query(f"WITH {_FETCHED} SELECT count(*) FILTER (NOT ok) AS failed, 0::BIGINT AS svg, 0::BIGINT AS bytes, count(*) FILTER (ok AND width < 150 AND height < 150) AS dimensions, count(*) FILTER (ok AND NOT (width < 150 AND height < 150)) AS kept FROM f")
def image_skips(spark, sf_dir):
    return image_operators.skip_counts(image_operators.filter_images(_fetched(spark, sf_dir)))


@query(f"WITH {_FETCHED}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM f WHERE ok AND NOT (width < 150 AND height < 150)) SELECT page, url, 'images/' || page || '/img-' || lpad(n::VARCHAR, 3, '0') || ext AS local_path FROM k")
def image_filter(spark, sf_dir):
    return image_operators.number_images(image_operators.filter_images(_fetched(spark, sf_dir))).select("page", "url", "local_path")


from . import crawl_queries  # noqa: E402, F401  (registers its queries here)
