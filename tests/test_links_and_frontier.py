"""Links, breadth-first crawls, redirects, resumption, and the incremental run."""

from textloom.operators import frontier, links
from textloom.sources import files
from textloom.streaming import incremental

H = "https://h.com"
START, BARE, OLD, NOW = f"{H}/hc", f"{H}/hc/a/1", f"{H}/hc/a/1-old", f"{H}/hc/a/1-now"


def _links(spark, rows, **options):
    df = spark.createDataFrame([(1, "https://e.com/docs", k, u) for k, u in enumerate(rows)], "page_id int, base string, ord int, url string")
    return [r.link for r in links.extract_links(df, **options).orderBy("ord").collect()]


def test_links(spark):
    assert _links(spark, ["https://e.com/a", "https://other.com/b", "junk"]) == ["https://e.com/a"]
    assert _links(spark, ["https://e.com/a", "https://e.com/a/", "https://e.com/a#x"]) == ["https://e.com/a"]
    assert _links(spark, ["https://e.com/a?sort=asc", "https://e.com/a?sort=desc"]) == ["https://e.com/a"]
    assert len(_links(spark, [f"https://e.com/i?id={k}" for k in range(3)], preserve_query=True)) == 3
    assert _links(spark, ["https://e.com/i?utm_a=1", "https://e.com/i"], preserve_query=True) == ["https://e.com/i"]


def _site(spark):
    edges = spark.createDataFrame([(START, 0, BARE), (START, 1, OLD), (START, 2, NOW), (NOW, 0, NOW), (BARE, 0, NOW)], "src string, pos int, dst string")
    redirects = spark.createDataFrame([(BARE, NOW), (OLD, NOW)], "requested string, landed string")
    start = spark.createDataFrame([(START, 0)], "url string, ord int")
    return edges, redirects, start


def test_redirects_collapse_and_budget(spark):
    edges, redirects, start = _site(spark)
    full = {r.url: r for r in frontier.bfs(edges, start, ["/hc/**"], redirects=redirects).collect()}
    assert {r.canonical for r in full.values() if r.captured} == {START, NOW}
    assert full[BARE].captured and not full[OLD].captured and full[OLD].status == "completed"
    part = frontier.bfs(edges, start, ["/hc/**"], redirects=redirects, max_pages=2)
    state = {r.url: r.status for r in part.collect()}
    assert state[START] == state[BARE] == "completed" and state[OLD] == "queued"
    again = {r.url: r.status for r in frontier.bfs(edges, start, ["/hc/**"], redirects=redirects, state=part).collect()}
    assert again[OLD] == "completed" and set(again.values()) == {"completed"}


def test_failures_scope_and_cycles(spark):
    edges = spark.createDataFrame([("https://h.com/a", 0, "https://h.com/b"), ("https://h.com/a", 1, "https://h.com/x"), ("https://h.com/b", 0, "https://h.com/a"), ("https://h.com/b", 1, "https://h.com/c")], "src string, pos int, dst string")
    start = spark.createDataFrame([("https://h.com/a", 0)], "url string, ord int")
    failing = spark.createDataFrame([("https://h.com/c",)], "url string")
    got = {r.url[-1]: (r.status, r.wave) for r in frontier.bfs(edges, start, None, ["/x"], failing=failing).collect()}
    assert got == {"a": ("completed", 0), "b": ("completed", 1), "x": ("excluded", 1), "c": ("failed", 2)}


def test_reconcile_and_status(spark):
    rows = [("https://h.com/en/1", "completed", None), ("https://h.com/en/2", "completed", "https://h.com/en/9"), ("https://h.com/en/3", "failed", None), ("https://h.com/en/4", "discovered", None), ("https://h.com/de/5", "discovered", None), ("https://h.com/en/6", "discovered", None)]
    state = spark.createDataFrame(rows, "url string, status string, canonical string")
    held = spark.createDataFrame([("https://h.com/en/9",), ("https://h.com/en/6",)], "url string")
    got = {r.url[-1]: r.status for r in frontier.reconcile(state, held, ["/en/**"]).collect()}
    assert got == {"1": "queued", "2": "completed", "3": "failed", "4": "queued", "5": "excluded", "6": "completed"}
    retried = {r.url[-1]: r.status for r in frontier.reconcile(state, held, ["/en/**"], retry_failed=True).collect()}
    assert retried["3"] == "queued"
    counts = frontier.crawl_status(state).first()
    assert (counts.completed, counts.failed, counts.interrupted) == (2, 1, True)
    assert not frontier.may_start_fresh(state)
    assert frontier.progress(0, 1) == "[##########----------] 50%"


def test_state_files(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"version": 1, "startUrl": "u", "match": "/a/**", "discoveredUrls": ["a", "b"], "completedUrls": ["a"], "failedUrls": [], "queue": [], "redirects": {"a": "z"}}')
    (tmp_path / "old.json").write_text('{"version": 2}')
    (tmp_path / "bad.json").write_text("{nonsense")
    row = files.load_state(spark, str(tmp_path / "state.json")).first()
    assert row.match == ["/a/**"] and row.excludedUrls == []
    rows = {r.url: (r.status, r.canonical) for r in files.state_rows(files.load_state(spark, str(tmp_path / "state.json"))).collect()}
    assert rows == {"a": ("completed", "z"), "b": ("discovered", None)}
    assert files.load_state(spark, str(tmp_path / "old.json")).count() == 0
    assert files.load_state(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.load_manifest(spark, str(tmp_path / "none.json")).count() == 0
    store = files.WaveStore(spark, str(tmp_path / "waves"))
    assert store.load() is None
    df = spark.createDataFrame([("a", "queued")], "url string, status string")
    assert store.save(df) == 1 and not store.finished()
    assert store.save(df.selectExpr("url", "'completed' AS status")) == 2 and store.finished()


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# head\n https://a.com \n\nhttps://b.com\nhttps://a.com\n")
    assert [r.url for r in files.read_url_list(spark, str(tmp_path / "urls.txt")).orderBy("ord").collect()] == ["https://a.com", "https://b.com"]


def test_incremental(spark, tmp_path):
    pages = lambda k, *hrefs: spark.createDataFrame([(k, "https://e.com/", "".join(f'<a href="{h}">x</a>' for h in hrefs))], incremental.PAGES)
    source, seen, check = (str(tmp_path / x) for x in ("in", "seen", "check"))
    pages(1, "/a", "/b", "https://other.com/").write.parquet(source)
    incremental.run(spark, source, seen, check, exclude=["/b"])
    pages(2, "/b", "/c").write.mode("append").parquet(source)
    incremental.run(spark, source, seen, check, exclude=["/b"])
    got = sorted((r.url, r.status, r.batch) for r in spark.read.parquet(seen).collect())
    assert got == [("https://e.com/a", "queued", 0), ("https://e.com/b", "excluded", 0), ("https://e.com/c", "queued", 1)]


def test_positions_keep_their_order_beyond_six_digits(spark):
    df = spark.createDataFrame([(n,) for n in (0, 9, 2**24 - 1, 2**24, 2**24 + 1, 2**40)], "n long")
    told = [r[0] for r in df.orderBy("n").select(frontier.place(df.n)).collect()]
    assert told == sorted(told) and told[0] == "000000" and len(set(told)) == 6


def test_a_deep_crawl_ends_by_itself(spark):
    edges = spark.createDataFrame([(f"u{k}", 0, f"u{k + 1}") for k in range(20)], "src string, pos int, dst string")
    out = frontier.bfs(edges, spark.createDataFrame([("u0", 0)], "url string, ord int"), scoped=False)
    assert {(r.url, r.wave, r.status) for r in out.collect()} == {(f"u{k}", k, "completed") for k in range(21)}


def test_resumed_settings_and_first_state():
    saved = {"exclude": ["/a"], "preserveQuery": True}
    assert frontier.restored(None, None, saved) == (["/a"], True)
    assert frontier.restored(["/b"], False, saved) == (["/b"], False) and frontier.restored(None, None, None) == (None, None)
    state = frontier.initial_state("https://e.com/docs/", ["/docs/**"], {"exclude": ["/x"]}, "t")
    assert state["queue"] == state["discoveredUrls"] == ["https://e.com/docs"] and state["completedUrls"] == [] and state["config"] == {"exclude": ["/x"]}


def test_list_mode(spark):
    listed = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "d")], "ord int, url string")
    came = spark.createDataFrame([("a",), ("d",)], "url string")
    rows = lambda df: sorted((r.ord, r.url, r.status) for r in df.collect())
    assert rows(frontier.list_mode(listed, came)) == [(0, "a", "completed"), (1, "b", "failed"), (3, "c", "failed"), (4, "d", "completed")]
    earlier = spark.createDataFrame([("b", "completed"), ("d", "failed")], "url string, status string")
    assert rows(frontier.list_mode(listed, came, earlier)) == [(0, "a", "completed"), (1, "b", "completed"), (3, "c", "failed"), (4, "d", "failed")]
    assert rows(frontier.list_mode(listed, came, earlier, retry_failed=True))[-1] == (4, "d", "completed")
