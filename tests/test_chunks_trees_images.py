"""Chunks, trees, conversion, images, manifests, configs."""

import struct

import pytest
from pyspark.sql import functions as F

from textloom.functions import images as image_functions
from textloom.operators import chunking, convert, images, manifest, tree
from textloom.sources import files, html_nodes, site_config

MARKDOWN = "intro line\n\n# One\n\n" + "alpha beta. " * 20 + "\n\n## Two\n\n" + "gamma delta. " * 20 + "\n\n# Three\n\nend\n"


def test_chunk_invariants():
    config = chunking.ChunkConfig(300, 50)
    got = chunking.chunks_of(MARKDOWN, config)
    assert len(got) > 1 and all(len(text) <= 450 for _, _, text, _ in got)
    assert all(any(line in text for _, _, text, _ in got) for line in MARKDOWN.split("\n") if len(line) < 100)
    assert chunking.chunks_of("short", config) == [(0, 5, "short", "")]
    assert chunking.chunks_of(None, config) == [(0, 0, "", "")]
    one = "# H\n" + "word " * 500
    assert len(chunking.chunks_of(one, chunking.ChunkConfig(500, 50))) > 1
    assert len(chunking.chunks_of(one, chunking.ChunkConfig(500, 50, legacy_tail=True))) > len(chunking.chunks_of(one, chunking.ChunkConfig(500, 50)))


def test_heading_context():
    text = "".join(f"{h}\n{'x ' * 30}\n" for h in ("# A", "### B", "### C", "## D"))
    contexts = [c for *_, c in chunking.chunks_of(text, chunking.ChunkConfig(70, 0, own_context=True))]
    assert contexts == ["A", "A > B", "A > B > C", "A > D"]


def test_spans_cover_text():
    text = "One sentence. " * 100
    spans = list(chunking.spans(text, chunking.ChunkConfig(100, 20, False)))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_render_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([("page", 'source_url: https://e.com/p\n# The "Title"\n' + "w " * 200), ("small", "x")], "stem string, text string")
    config = chunking.ChunkConfig(150, 10)
    out = chunking.render(docs, chunking.chunk(docs, "stem", "text", config), "stem", "text", "T").orderBy("chunk").collect()
    assert out[0].file == "page-001.md" and {r.stem for r in out} == {"page"}
    assert out[0].content.startswith('---\nsource_url: https://e.com/p\nsource_title: "The \\"Title\\""\nchunk: 1\n') and "\n---\n" in out[0].content
    pages = chunking.manifest(spark.createDataFrame(out))
    row = pages.first()
    assert row.chunks == len(out) and row.files[0] == "chunks/page-001.md"
    assert chunking.manifest_totals(pages, config, "T").first().total_chunks == len(out)
    for name, text in (("a.md", "# A"), ("index.md", "x"), ("b.txt", "y")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in files.read_markdown(spark, str(tmp_path)).collect()] == [("a", "# A")]


def _node(i, role, name=None, children=(), backend=None, ignored=False, **props):
    kinds = {"level": "integer", "url": "string"}
    return {"node_id": i, "role": role, "name": name, "ignored": ignored, "backend_id": backend, "child_ids": list(children), "properties": [{"name": k, "type": kinds[k], "value": str(v)} for k, v in props.items()]}


NODES = [
    _node("1", "RootWebArea", "Site", ["2", "3", "7", "404"], 1),
    _node("2", "heading", "Welcome", ["4"], 37, level=1),
    _node("3", "generic", "", ["5", "6"], 50),
    _node("4", "StaticText", "Welcome", (), 38),
    _node("5", "link", "Go", (), 52, url="https://e.com/go"),
    _node("6", "InlineTextBox", "x", (), 53),
    _node("7", "image", "pic", ["1"], 80, url="https://e.com/p.png"),
    _node("9", "link", "lost", (), 90, url="https://e.com/lost"),
    _node("10", "link", "again", (), 52, url="https://e.com/go2"),
]


def test_tree(spark):
    df = spark.createDataFrame([(1, NODES), (2, []), (3, None), (4, [_node("1", "generic", "", ["2", "3"]), _node("2", "link", "a"), _node("3", "link", "b")])], f"page_id int, nodes {tree.NODES}")
    got = {r.page_id: r for r in tree.trees(df).collect()}
    assert got[1].tree == '[0-1] RootWebArea: "Site"\n  [0-37] heading (level=1): "Welcome"\n  [0-52] link: "Go"\n  [0-80] image: "pic"'
    assert got[1].node_count == 4 and got[2].tree == got[3].tree == "[0-0] empty"
    assert got[4].tree == '[0-0] document\n  [0-0] link: "a"\n  [0-0] link: "b"' and got[4].node_count == 3
    nodes = tree.explode_nodes(df)
    maps = {r.page_id: r for r in tree.url_maps(nodes).collect()}
    assert maps[1].url_map == {"0-52": "https://e.com/go2", "0-90": "https://e.com/lost"} and maps[1].image_map == {"0-80": "https://e.com/p.png"}
    assert {(r.page_id, r.node_id) for r in tree.skipped(nodes).filter("skip").collect()} == {(1, "3"), (1, "4"), (1, "6"), (4, "1")}
    roots = spark.createDataFrame([(1, 50)], "page_id int, backend_id int")
    below = tree.subtree(nodes, roots)
    assert {r.node_id for r in below.filter("page_id = 1").collect()} == {"3", "5", "6"} and below.filter("page_id = 4").count() == 3
    level = nodes.select(tree.level_of(F.col("properties")).alias("l")).filter("l is not null").collect()
    assert [r.l for r in level] == [1]


def test_html_to_markdown(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/n">n</a></nav><main><h2>Head <b>line</b></h2><p>Text &amp; more</p><a href="/x">go</a><img src="/i.png" alt="pic"></main><script>no</script></body></html>'
    df = spark.createDataFrame([(1, "https://e.com/", page), (2, "https://e.com/2", None)], "page_id int, url string, html string")
    nodes = html_nodes.read_nodes(df)
    snaps = manifest.snapshots(tree.trees(nodes), tree.url_maps(tree.explode_nodes(nodes)), df, "2024-01-01T00:00:00Z")
    got = {r.page_id: r for r in convert.convert(snaps).collect()}
    assert "## Head line" in got[1].markdown and "Text & more" in got[1].markdown and "[go](/x)" in got[1].markdown and "/n" not in got[1].markdown and got[1].error is None

    @convert.register("broken")
    def broken(tree, url_map, image_map):
        raise ValueError("no")

    assert convert.convert(snaps, "broken", limit=1).first().error == "ValueError: no"
    assert manifest.inspect(snaps, "https://e.com/").first().name == "index"
    for form in ("html", "text", "ax", "links"):
        assert manifest.fetch(df, "https://e.com/", form).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        manifest.fetch(df, "https://e.com/", "pdf")
    assert '"nodeCount"' in files.snapshot_json(snaps).first().content
    assert tree.pick_samples(snaps).count() == 2


def test_image_refs(spark):
    paths = {"https://e.com/media/i/p.png": "images/p/img-001.png"}
    text = "![a](https://e.com/media/i/p.png) ![b](i/p.png?x=1#y) ![c](other.png) ![d](/media/i/p.png)"
    assert spark.createDataFrame([(text, paths)], "m string, p map<string,string>").select(convert.localize_images("m", "p")).first()[0] == "![a](images/p/img-001.png) ![b](images/p/img-001.png) ![c](other.png) ![d](images/p/img-001.png)"
    odd = spark.createDataFrame([(None, paths), ("x ![a](b)", None), ("![a](x.png)", {"not a url": "l"})], "m string, p map<string,string>")
    assert [r[0] for r in odd.select(convert.localize_images("m", "p")).collect()] == [None, "x ![a](b)", "![a](x.png)"]


PNG = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 48, 64) + bytes(8)
DIMENSIONS = [
    (PNG, (640, 480)),
    (PNG[:20], None),
    (b"GIF89a" + struct.pack("<HH", 12, 34), (12, 34)),
    (b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 0x4000 | 100, 50), (100, 50)),
    (b"RIFF\0\0\0\0WEBPVP8L" + bytes(5) + struct.pack("<I", 99 | 49 << 14), (100, 50)),
    (JPEG, (64, 48)),
    (b"\xff\xd8\xff\x01\xff\xff\xff\xe1\x00\x06\xff\xc0ab\xff\xc5\x00\x11\x08" + struct.pack(">HH", 7, 9) + bytes(8), (9, 7)),
    (b"\xff\xd8\xff\xda\x00\x04ab\xff\xc0\x00\x11\x08" + bytes(12), None),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"), (640, 480)),
    (b'<svg width="24px" height="16">', (24, 16)),
    (b'<svg width="100%" height="50%" viewBox="0 0 300 200">', (300, 200)),
    (b'<svg viewBox="0,0,30,20">', (30, 20)),
    (b"<svg xmlns='x'></svg>", None),
    (b"just some text", None),
    (b"", None),
    (None, None),
]


@pytest.mark.parametrize(("body", "want"), DIMENSIONS)
def test_dimensions(body, want):
    assert image_functions.dimensions_of(body) == want


def test_image_pipeline(spark):
    small = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 24, 24)
    rows = [("p", 0, "http://e/a.png", False, "image/png", None), ("p", 1, "http://e/b.png", True, "image/png", small), ("p", 2, "http://e/c", True, "image/jpeg; x", JPEG + bytes(200)), ("p", 3, "http://e/d.webp?x", True, None, PNG), ("p", 4, "http://e/e.svg", True, "image/svg+xml", b'<svg width="640" height="480">')]
    df = spark.createDataFrame(rows, "page string, ord int, url string, ok boolean, content_type string, body binary")
    kept = images.filter_images(df)
    assert [r.skip_reason for r in kept.orderBy("ord").collect()] == ["failed", "dimensions", "dimensions", None, None]
    assert [r.local_path for r in images.number_images(kept).orderBy("ord").collect()] == ["images/p/img-001.webp", "images/p/img-002.svg"]
    counts = images.skip_counts(images.filter_images(df, min_bytes=25, skip_svg=True)).first()
    assert (counts.failed, counts.svg, counts.bytes, counts.kept) == (1, 1, 2, 0)
    paths = images.element_paths(spark.createDataFrame([("p", "0-1", "http://e/d.webp?x")], "page string, element_id string, url string"), images.number_images(kept))
    assert tuple(paths.first()) == ("p", "0-1", "images/p/img-001.webp")


def test_index_and_collisions(spark):
    long = "https://e.com/" + "x" * 70
    df = spark.createDataFrame([("s", 0, "https://e.com/a", "snapshots/a.json", 2), ("s", 1, long, "b", 1)], "site string, ord int, url string, snapshot string, image_count int")
    text = manifest.index_table("docs", df, ["site"], "2024-01-01").first().markdown
    assert text.startswith("# docs — 2024-01-01\n\n| Page |") and "..." + long[-57:] in text and text.endswith("\n\nTotal: 2 pages, 3 images\n")
    twice = spark.createDataFrame([("https://e.com/a/b",), ("https://e.com/a-b",)], "url string")
    assert manifest.name_collisions(twice).first().page_name == "a-b"


def test_site_config(tmp_path):
    good = site_config.parse('name = "x"\nstartUrl = "https://e.com"\nmatch = "/a/**"\npreserveQuery = true\nsettleMs = 0\n[[preActions]]\naction = "type"\nselector = "#u"\nvalue = "v"\n')
    assert good.match == ["/a/**"] and good.preserveQuery is True and good.preActions == [{"action": "type", "selector": "#u", "value": "v"}]
    bad = ["", "name = ", 'name = ""', 'name="x"\nmatch = 3', 'name="x"\nexclude = "a"', 'name="x"\npreserveQuery = "yes"', 'name="x"\nsettleMs = -1', 'name="x"\nrecycleTabEvery = 0', 'name="x"\n[[preActions]]\naction = "fly"', 'name="x"\n[[preActions]]\naction = "click"', 'name="x"\n[[preActions]]\naction = "delay"\nms = 1\nmatch = "/a"']
    for text in bad:
        with pytest.raises(site_config.ConfigError):
            site_config.parse(text)
    with pytest.raises(site_config.ConfigError):
        site_config.load(str(tmp_path / "none.toml"))
    (tmp_path / "sites").mkdir()
    (tmp_path / "sites" / "a.toml").write_text('name = "a"')
    assert site_config.resolve_path("a", "/nowhere", str(tmp_path)).endswith("sites/a.toml") and site_config.resolve_path("x/y", "/h") == "x/y"
    assert site_config.fill_env("$A-${B}", {"A": "1", "B": "2"}) == "1-2"
    with pytest.raises(site_config.ConfigError):
        site_config.fill_env("$MISSING", {})


def test_files_that_are_written(spark, tmp_path):
    import json

    docs = spark.createDataFrame([("a", "# A\n\n" + "words and more. " * 40), ("b", "short")], "stem string, text string")
    config = chunking.ChunkConfig(200, 20, False)
    rendered = chunking.render(docs, chunking.chunk(docs, "stem", "text", config), "stem", "text", "now")
    files.write_texts(rendered, str(tmp_path / "chunks"))
    back = spark.read.text(str(tmp_path / "chunks"), wholetext=True)
    assert {(r.file, r.value.rstrip()) for r in back.collect()} == {(r.file, r.content.rstrip()) for r in rendered.collect()}
    told = json.loads(chunking.manifest_json(chunking.manifest(rendered), config, "now").first().content)
    assert told["totalPages"] == 1 and told["totalChunks"] == rendered.count() and told["pages"][0]["files"][0] == "chunks/a-001.md" and told["chunkConfig"]["chunkSize"] == 200
    assert files.missing_input(spark, str(tmp_path)).startswith("no site.json")
    (tmp_path / "site.json").write_text("{}")
    assert files.missing_input(spark, str(tmp_path), "generic") is None and "no converter" in files.missing_input(spark, str(tmp_path), "none")
    store = files.WaveStore(spark, str(tmp_path / "state"))
    store.save(docs)
    assert store.load().count() == 2
    store.delete()
    assert store.load() is None


def test_snapshots_of_one_reading_agree_with_trees_and_maps(spark):
    page = '<title>T</title><body><nav><a href="/x">X</a></nav><main><h2>H</h2><p>one<img src="http://e.com/i.png" alt="i"></p><a href="/y">Y z</a></main>'
    df = spark.createDataFrame([(1, "https://e.com/", page), (2, "https://e.com/b", None), (3, "https://e.com/c", "")], "page_id long, url string, html string")
    nodes = html_nodes.read_nodes(df)
    apart = manifest.snapshots(tree.trees(nodes), tree.url_maps(tree.explode_nodes(nodes)), df, "2024-01-01")
    columns = sorted(apart.columns)
    rows = lambda x: sorted((tuple(r[c] for c in columns) for r in x.collect()), key=lambda r: r[columns.index("page_id")])
    want = [tuple("" if c == "title" and v is None else v for c, v in zip(columns, r, strict=True)) for r in rows(apart)]
    assert rows(html_nodes.read_snapshots(df, "2024-01-01").select(columns)) == want
