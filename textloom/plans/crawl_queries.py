"""More named queries: crawls over the pages' own links, list mode, trees of HTML, snapshots and their Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import chunking, convert, frontier, images, links, manifest, tree
from ..sources import files, html_nodes
from .queries import _BARE, _BFS, _FETCHED, _FILES, _LINKS, _NAME, _PARSED, _SMALL, _TURNS, NOW, _chunk_files, _conversation_nodes, _entries, _fetched, _graph, _snapshots, _table, query

# ---------------------------------------------------------------- crawls

_PLACE = "lpad(upper(to_hex({0})), 6, '0')"


@query(rf"""WITH {_LINKS}, n AS (SELECT page_id, {_BARE} AS url FROM p), v AS (SELECT url, 0 AS wave, {_PLACE.format("min(page_id)")} AS ord, max(page_id % 11 = 0) AS fails FROM n WHERE page_id % 5 = 0 GROUP BY url),
e AS (SELECT n.url AS src, r.ord AS pos, regexp_replace(regexp_replace(r.url, '[?#].*$', ''), '/+$', '') AS dst FROM r JOIN n ON n.page_id = r.page_id WHERE NOT regexp_matches(href, '\s')),
f AS (SELECT dst AS url, min(v.ord || {_PLACE.format("pos")}) AS ord FROM v JOIN e ON e.src = v.url WHERE NOT fails AND dst NOT IN (SELECT url FROM v) GROUP BY dst)
SELECT url, CASE WHEN fails THEN 'failed' ELSE 'completed' END AS status, wave, ord FROM v UNION ALL SELECT url, CASE WHEN regexp_matches(url, '^[^:]+://[^/]+/[a-m][^/]*$') THEN 'excluded' ELSE 'completed' END, 1, ord FROM f""")
def crawl_links(spark, sf_dir):
    """Every fifth page is a start; links lead on by the pages' own anchors; some starts fail, some paths are excluded."""
    pages = _table(spark, sf_dir, "pages").withColumn("page", urls.normalize("url"))
    found = links.extract_links(links.html_links(pages)).join(pages.select("page_id", "page"), "page_id")
    edges = found.select(F.col("page").alias("src"), F.col("ord").alias("pos"), F.col("link").alias("dst"))
    start = pages.filter("page_id % 5 = 0").groupBy(F.col("page").alias("url")).agg(F.min("page_id").alias("ord"))
    failing = pages.filter("page_id % 55 = 0").select(F.col("page").alias("url")).distinct()
    return frontier.bfs(edges, start, exclude=["/[a-m]*"], failing=failing).select("url", "status", "wave", "ord")


@query(f"WITH {_BFS.replace('FROM b JOIN pages p ON', 'FROM b JOIN pages p ON b.id % 7 <> 3 AND')} SELECT 'n' || id AS url, CASE WHEN id % 7 = 3 THEN 'failed' ELSE 'completed' END AS status, wave FROM b")
def frontier_failures(spark, sf_dir):
    edges, start = _graph(spark, sf_dir)
    failing = _table(spark, sf_dir, "pages").filter("page_id % 7 = 3").select(F.concat(F.lit("n"), "page_id").alias("url"))
    return frontier.bfs(edges, start, failing=failing, scoped=False).select("url", "status", "wave")


@query("""WITH l AS (SELECT 'u' || (page_id % 97) AS url, min(page_id) AS ord FROM pages GROUP BY 1), c AS (SELECT DISTINCT 'u' || (page_id % 80) AS url FROM pages WHERE page_id % 3 <> 0), b AS (SELECT 'u' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS was FROM pages WHERE page_id < 30)
SELECT l.ord, l.url, coalesce(b.was, CASE WHEN c.url IS NULL THEN 'failed' ELSE 'completed' END) AS status FROM l LEFT JOIN c USING (url) LEFT JOIN b USING (url)""")
def list_mode(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    named = lambda n: F.concat(F.lit("u"), n.cast("string")).alias("url")
    i = F.col("page_id")
    earlier = pages.filter("page_id < 30").select(named(i), F.when(i % 2 == 0, "completed").otherwise("failed").alias("status"))
    return frontier.list_mode(pages.select(i.alias("ord"), named(i % 97)), pages.filter("page_id % 3 <> 0").select(named(i % 80)), earlier)


@query("""WITH s AS (SELECT 'u' || page_id AS url, page_id FROM pages) SELECT url, CASE WHEN page_id % 2 = 0 THEN 'completed' WHEN page_id % 3 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'queued' WHEN page_id % 7 = 0 THEN 'excluded' ELSE 'discovered' END AS status, CASE WHEN page_id % 4 = 0 THEN 'c' || page_id END AS canonical FROM s""")
def state_rows(spark, sf_dir):
    """A state file's sets as one table; a URL that stands in several sets keeps the strongest."""
    i = F.col("page_id")
    name = F.concat(F.lit("u"), i.cast("string"))
    held = lambda n: F.sort_array(F.collect_list(F.when(i % n == 0, name)))
    every = F.sort_array(F.collect_list(name))
    turned = F.map_from_entries(F.sort_array(F.collect_list(F.when(i % 4 == 0, F.struct(name, F.concat(F.lit("c"), i.cast("string")))))))
    state = _table(spark, sf_dir, "pages").agg(every.alias("discoveredUrls"), held(2).alias("completedUrls"), held(3).alias("failedUrls"), held(5).alias("queue"), held(7).alias("excludedUrls"), turned.alias("redirects"))
    return files.state_rows(state).select("url", "status", "canonical")


@query(rf"WITH {_PARSED} SELECT page_id, CASE WHEN replace(regexp_replace(path, '^/|/$', '', 'g'), '/', '-') = '' THEN 'index' ELSE replace(regexp_replace(path, '^/|/$', '', 'g'), '/', '-') END AS name FROM p")
def inspect_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.inspect_name("url").alias("name"))


@query("SELECT url, html AS content FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 3)")
def fetch_html(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return manifest.fetch(pages, pages.filter("page_id = 3").first().url, "html")


# ---------------------------------------------------------------- trees of conversations


@query(f"WITH {_TURNS} SELECT conv_id AS page_id, 't' || i AS node_id FROM t WHERE i = 1 UNION ALL SELECT conv_id, 's' || i FROM t WHERE i = 1 UNION ALL SELECT conv_id, x FROM (SELECT conv_id, unnest(list_concat(['r'], ['t' || i, 's' || i])) AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM t) WHERE n = 1 * 3 AND false UNION ALL SELECT conv_id, unnest(['r', 't0', 's0']) FROM t GROUP BY conv_id HAVING count(*) = 1")
def tree_subtree(spark, sf_dir):
    """What stands below the second turn; a conversation of one turn keeps its whole tree."""
    nodes = tree.explode_nodes(_conversation_nodes(spark, sf_dir))
    roots = nodes.filter("backend_id = 3").select("page_id", "backend_id").distinct()
    return tree.subtree(nodes, roots).select("page_id", "node_id")


@query(f"""WITH {_TURNS} SELECT conv_id AS page_id, '  [0-' || (i + 2) || '] heading (level=' || (i % 6 + 1) || ')' || CASE WHEN coalesce(text, '') = '' THEN '' ELSE ': "' || text || '"' END AS line FROM t""")
def tree_levels(spark, sf_dir):
    nodes = tree.explode_nodes(_conversation_nodes(spark, sf_dir)).filter("node_id like 't%'")
    number = (F.col("backend_id") - 2) % 6 + 1
    properties = F.array(F.struct(F.lit("level").alias("name"), F.lit("integer").alias("type"), number.cast("string").alias("value")))
    level = tree.level_of(properties)
    return nodes.select("page_id", tree.line_column(tree.element_id(0, F.col("backend_id")), F.lit(1), F.lit("heading"), F.col("name"), level).alias("line"))


@query(f"""WITH {_TURNS} SELECT conv_id AS page_id, CASE WHEN count(*) > 1 THEN '[0-0] document' || chr(10) ELSE '' END || string_agg(CASE WHEN n > 1 THEN '  ' ELSE '' END || '[0-' || (i + 2) || '] ' || role || CASE WHEN coalesce(text, '') = '' THEN '' ELSE ': "' || text || '"' END, chr(10) ORDER BY i) AS tree, (count(*) + CASE WHEN count(*) > 1 THEN 1 ELSE 0 END)::INT AS node_count FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t) GROUP BY conv_id""")
def tree_wrapped(spark, sf_dir):
    """The document node is ignored, so its turns move up; more than one of them get a new root."""
    held = _conversation_nodes(spark, sf_dir).withColumn("nodes", F.transform("nodes", lambda n: n.withField("ignored", n["node_id"] == "r")))
    return tree.trees(held)


@query("SELECT conv_id AS page_id FROM (SELECT DISTINCT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE k IN (0, n // 2, n - 1)")
def samples(spark, sf_dir):
    return tree.pick_samples(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id")).distinct())


# ---------------------------------------------------------------- trees of HTML

# Roles of the elements that the pages hold.
_ROLE = "CASE t WHEN 'body' THEN 'generic' WHEN 'div' THEN 'generic' WHEN 'nav' THEN 'navigation' WHEN 'ul' THEN 'list' WHEN 'li' THEN 'listitem' WHEN 'a' THEN 'link' WHEN 'article' THEN 'article' WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'footer' THEN 'contentinfo' END"
_DECODED = "replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
#: A fold over each page's tokens with a stack of open elements, then names, hidden nodes and depths from the ids of ancestors.
_HTML = rf"""RECURSIVE k AS (SELECT page_id, url, html, regexp_extract_all(regexp_replace(regexp_replace(html, '<!DOCTYPE[^>]*>|<!--.*?-->', '', 'gs'), '<head>.*?</head>', '', 's'), '<[^>]*>|[^<]+') AS w FROM pages),
f(page_id, i, tags, ids, n, node, tag, above, text, href) AS (SELECT page_id, 0, []::VARCHAR[], []::BIGINT[], 1::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::BIGINT[], NULL::VARCHAR, NULL::VARCHAR FROM k
UNION ALL SELECT page_id, i + 1, CASE WHEN opens THEN list_append(tags, t) WHEN closes THEN tags[1:keep] ELSE tags END, CASE WHEN opens THEN list_append(ids, CASE WHEN role IS NULL THEN 0 ELSE n + 1 END) WHEN closes THEN ids[1:keep] ELSE ids END, n + CASE WHEN makes THEN 1 ELSE 0 END, CASE WHEN makes THEN n + 1 END, CASE WHEN makes THEN CASE WHEN opens THEN t ELSE '#' END END, ids, CASE WHEN NOT opens THEN told END, href
FROM (SELECT *, opens AND role IS NOT NULL OR told <> '' AS makes, len(tags) - coalesce(nullif(list_position(list_reverse(tags), t), 0), 0) AS keep FROM (SELECT *, {_ROLE} AS role FROM (SELECT page_id, i, n, CASE WHEN p AND tags[-1] = 'p' THEN tags[1:-2] ELSE tags END AS tags, CASE WHEN p AND tags[-1] = 'p' THEN ids[1:-2] ELSE ids END AS ids, t, opens, closes AND list_contains(tags, t) AS closes, told, href
FROM (SELECT f.page_id, f.i, f.n, f.tags, f.ids, lower(regexp_extract(w[f.i + 1], '^</?([A-Za-z0-9]+)', 1)) AS t, regexp_matches(w[f.i + 1], '^<[A-Za-z]') AND NOT regexp_matches(w[f.i + 1], '^<(br|img|hr|meta|link|input)\b') AS opens, starts_with(w[f.i + 1], '</') AS closes, regexp_matches(w[f.i + 1], '^<p\b') AS p,
CASE WHEN starts_with(w[f.i + 1], '<') THEN '' ELSE trim(regexp_replace((SELECT {_DECODED} FROM (SELECT w[f.i + 1] AS x)), '\s+', ' ', 'g')) END AS told, CASE WHEN regexp_matches(w[f.i + 1], '^<a\s') THEN regexp_extract(w[f.i + 1], 'href="([^"]*)"', 1) END AS href FROM f JOIN k ON k.page_id = f.page_id WHERE f.i < len(w)))))),
m AS (SELECT page_id, node, tag, (SELECT {_ROLE} FROM (SELECT tag AS t)) AS role, list_filter(above, lambda x: x > 0) AS above, text, href FROM f WHERE node IS NOT NULL),
c AS (SELECT page_id, node, unnest(above) AS over, text FROM m WHERE tag = '#'),
l AS (SELECT m.page_id, m.node, string_agg(c.text, ' ' ORDER BY c.node) AS name FROM m JOIN c ON c.page_id = m.page_id AND c.over = m.node WHERE m.tag IN ('a', 'h1') GROUP BY 1, 2),
d AS (SELECT m.page_id, m.node, m.tag, m.above, m.href, CASE WHEN m.tag = '#' THEN 'StaticText' ELSE m.role END AS role, CASE WHEN m.tag = '#' THEN m.text ELSE l.name END AS name, coalesce(m.role, '') = 'generic' OR m.tag = '#' AND m.text = coalesce(q.name, '') AS hidden FROM m LEFT JOIN l ON l.page_id = m.page_id AND l.node = m.node LEFT JOIN l q ON q.page_id = m.page_id AND q.node = m.above[-1]),
a AS (SELECT d.page_id, d.node, count(b.node) FILTER (NOT b.hidden) AS shown, coalesce(bool_or(b.tag IN ('nav', 'footer')), false) AS furniture, coalesce(bool_or(b.tag IN ('a', 'h1')), false) AS inline FROM (SELECT page_id, node, unnest(list_concat(above, [0])) AS over FROM d) d LEFT JOIN d b ON b.page_id = d.page_id AND b.node = d.over GROUP BY 1, 2),
v AS (SELECT d.*, a.shown + 1 AS depth, a.furniture, a.inline FROM d JOIN a ON a.page_id = d.page_id AND a.node = d.node WHERE NOT d.hidden),
tree AS (SELECT k.page_id, '[0-1] RootWebArea' || coalesce(chr(10) || string_agg(repeat('  ', depth::INT) || '[0-' || node || '] ' || role || CASE WHEN tag = 'h1' THEN ' (level=1)' ELSE '' END || CASE WHEN coalesce(name, '') = '' THEN '' ELSE ': "' || name || '"' END, chr(10) ORDER BY node), '') AS tree, (count(node) + 1)::INT AS node_count,
 count(node) FILTER (tag = 'a' AND href <> '')::INT AS n_links, string_agg(CASE WHEN tag = 'h1' THEN '# ' ELSE '' END || name, chr(10) || chr(10) ORDER BY node) FILTER (NOT furniture AND NOT inline AND (role = 'StaticText' OR tag = 'h1' AND coalesce(name, '') <> '')) AS markdown FROM k LEFT JOIN v ON v.page_id = k.page_id GROUP BY k.page_id)"""


@query(f"WITH {_HTML} SELECT page_id, tree, node_count FROM tree")
def tree_html(spark, sf_dir):
    return tree.trees(html_nodes.read_nodes(_table(spark, sf_dir, "pages")))


@query(f"WITH {_HTML}, {_PARSED} SELECT p.page_id, p.url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, {_NAME} AS page_name, node_count, tree, n_links FROM p JOIN tree ON tree.page_id = p.page_id")
def snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("page_id", "url", "title", "page_name", "node_count", "tree", F.size("url_map").alias("n_links"))


@query(f"WITH {_HTML}, {_PARSED} SELECT p.page_id, {_NAME} AS page_name, CASE WHEN markdown IS NULL THEN '' ELSE markdown || chr(10) END AS markdown, NULL::VARCHAR AS error FROM p JOIN tree ON tree.page_id = p.page_id")
def md_convert(spark, sf_dir):
    return convert.convert(_snapshots(spark, sf_dir)).select("page_id", "page_name", "markdown", "error")


@query(f"WITH {_PARSED}, n AS (SELECT page_id, {_NAME} AS page_name FROM p) SELECT page_id, page_name FROM n WHERE page_name IN (SELECT page_name FROM n WHERE page_id IN (2, 3))")
def convert_only(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    names = [r[0] for r in pages.filter("page_id in (2, 3)").select(urls.page_name("url")).collect()]
    return convert.convert(_snapshots(spark, sf_dir), only=names).select("page_id", "page_name")


# ---------------------------------------------------------------- manifests and images


@query(f"""WITH {_PARSED}, e AS (SELECT page_id, '{{"url":"' || url || '","snapshot":"snapshots/' || {_NAME} || '.json","imageCount":' || (page_id % 3) || '}}' AS row FROM p)
SELECT '{{"version":1,"startUrl":"https://e.com/docs","match":["/docs/**"],"pageCount":' || count(*) || ',"totalImages":' || sum(page_id % 3)::BIGINT || ',"startedAt":"{NOW}","pages":[' || string_agg(row, ',' ORDER BY page_id) || ']}}' AS content FROM e""")
def manifest_json(spark, sf_dir):
    entries = _entries(spark, sf_dir).select("ord", "url", "snapshot", F.col("image_count").cast("int").alias("imageCount"))
    return files.manifest_json("https://e.com/docs", ["/docs/**"], NOW, None, entries)


@query(f"""WITH {_FILES}, s AS (SELECT stem, count(*) AS n, string_agg('"chunks/' || file || '"', ',' ORDER BY chunk) AS names FROM g GROUP BY stem)
SELECT '{{"createdAt":"{NOW}","chunkConfig":{{"chunkSize":1500,"overlap":200,"splitOnHeadings":false}},"totalChunks":' || coalesce(sum(n), 0)::BIGINT || ',"totalPages":' || count(*) || ',"pages":[' || string_agg('{{"url":"","title":"' || stem || '","chunks":' || n || ',"files":[' || names || ']}}', ',' ORDER BY stem) || ']}}' AS content FROM s""")
def chunk_manifest_json(spark, sf_dir):
    return chunking.manifest_json(chunking.manifest(_chunk_files(spark, sf_dir)), _SMALL, NOW)


@query(f"WITH {_FETCHED}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS n FROM f WHERE ok AND NOT (width < 150 AND height < 150)) SELECT page, '0-' || ord AS element_id, 'images/' || page || '/img-' || lpad(n::VARCHAR, 3, '0') || ext AS local_path FROM k")
def image_elements(spark, sf_dir):
    fetched = _fetched(spark, sf_dir)
    shown = fetched.select("page", F.concat(F.lit("0-"), F.col("ord").cast("string")).alias("element_id"), "url")
    return images.element_paths(shown, images.number_images(images.filter_images(fetched)))
