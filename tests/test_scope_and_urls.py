"""Scope patterns and URL columns."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import patterns, urls


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("/blog/*", "/blog/post", True),
        ("/blog/*", "/blog/a/b", False),
        ("/blog/*", "/blog/.hidden", False),
        ("/docs/**", "/docs/a/b/c", True),
        ("/docs/**", "/docs", True),
        ("/docs/**", "/docs/", True),
        ("/docs/**", "/docsx", False),
        ("/docs/**", "/docs/.git/x", False),
        ("**/*Reference*", "/api/v1/MyReferencePage", True),
        ("/docs/{guide,api}/**", "/docs/api/x", True),
        ("/docs/{guide,api}/**", "/docs/blog/x", False),
        ("/v{1..3}/x", "/v2/x", True),
        ("/v{1..3}/x", "/v4/x", False),
        ("/p?ge", "/page", True),
        ("/p?ge", "/pge", False),
        ("/[a-c]x", "/bx", True),
        ("/[!a-c]x", "/bx", False),
        ("/[!a-c]x", "/zx", True),
        ("/@(a|bc)/x", "/bc/x", True),
        ("/+(ab)", "/abab", True),
        ("/!(ab)", "/ab", False),
        ("/!(ab)", "/abc", True),
        ("!/blog/*", "/blog/x", False),
        ("!/blog/*", "/docs", True),
        ("#/blog", "#/blog", False),
        ("/a.b", "/a.b", True),
        ("/a.b", "/axb", False),
        ("re:^/r/[A-Za-z0-9_~]{20,24}(/|$)", "/r/abcdefghijklmnopqrstu", True),
        ("re:^/r/[A-Za-z0-9_~]{20,24}(/|$)", "/r/short", False),
        ("re:[unclosed", "/unclosed", False),
    ],
)
def test_pattern(pattern, path, fits):
    assert patterns.compile_pattern(pattern).test(path) is fits


def test_patterns_in_spark(spark):
    rows = [("/docs/a",), ("/docs/private/a",), ("/blog",), (None,)]
    df = spark.createDataFrame(rows, "path string").withColumn("s", patterns.in_scope(F.col("path"), ["/docs/**"], ["/docs/private/**"]))
    assert [r.s for r in df.collect()] == ["queued", "excluded", "unmatched", "unmatched"]
    assert spark.createDataFrame(rows, "path string").select(patterns.in_scope(F.col("path"), []).alias("s")).distinct().first().s == "unmatched"
    assert spark.createDataFrame(rows, "path string").select(patterns.in_scope(F.col("path"), None).alias("s")).distinct().first().s == "queued"
    assert patterns.excluding("/docs/private/x", ["/blog", "/docs/private/**"]) == "/docs/private/**"


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "plain", "kept"),
    [
        ("https://Docs.Example.com/a/b/#top", "https://docs.example.com/a/b", "https://docs.example.com/a/b"),
        ("https://docs.example.com/", "https://docs.example.com", "https://docs.example.com"),
        ("https://docs.example.com:443/a", "https://docs.example.com/a", "https://docs.example.com/a"),
        ("http://docs.example.com:8080/a//", "http://docs.example.com:8080/a", "http://docs.example.com:8080/a"),
        ("https://e.com/i?utm_source=x&b=1&a=2&hsLang=en&_hsenc=q", "https://e.com/i", "https://e.com/i?b=1&a=2"),
        ("https://e.com/i?UTM_x=1", "https://e.com/i", "https://e.com/i"),
        ("https://e.com/i?q=a%20b&flag", "https://e.com/i", "https://e.com/i?q=a+b&flag="),
        ("not a url", None, None),
        (None, None, None),
    ],
)
def test_normalize(spark, url, plain, kept):
    df = spark.createDataFrame([(url,)], "u string").select(urls.normalize("u").alias("a"), urls.normalize("u", True).alias("b"))
    assert tuple(df.first()) == (plain, kept)


@pytest.mark.parametrize(
    ("url", "name"),
    [
        ("https://docs.example.com/r/en-US/x8e31f38/u136a4e9", "r-en-US-x8e31f38-u136a4e9"),
        ("https://docs.example.com/", "docs-example-com"),
        ("https://docs.example.com", "docs-example-com"),
        ("https://e.com/" + "a" * 100, "a" * 80),
        ("https://e.com/a//b.html", "a-b-html"),
        ("https://e.com/a?", "a"),
        ("nonsense", "page"),
    ],
)
def test_page_name(spark, url, name):
    assert spark.createDataFrame([(url,)], "u string").select(urls.page_name("u").alias("n")).first().n == name


def test_page_names_differ_by_query(spark):
    df = spark.createDataFrame([("https://e.com/doc?a=1",), ("https://e.com/doc?a=2",)], "u string").select(urls.page_name("u").alias("n"))
    names = [r.n for r in df.collect()]
    assert len(set(names)) == 2 and all(n.startswith("doc-") and len(n) == 12 for n in names)


CANONICAL = [
    ("https://h.com/a/1", "https://h.com/a/1", None, None, False, "https://h.com/a/1"),
    ("https://h.com/a/1", "https://h.com/a/1-new", None, None, False, "https://h.com/a/1-new"),
    ("https://h.com/a/1", "https://h.com/a/1-new", ["/a/**"], None, False, "https://h.com/a/1-new"),
    ("https://h.com/a/1", "https://h.com/signin", ["/a/**"], None, False, "https://h.com/a/1"),
    ("https://h.com/a/1", "https://login.h.com/a/1", None, None, False, "https://h.com/a/1"),
    ("https://h.com/a/1", "http://h.com/a/1-new", None, None, False, "https://h.com/a/1"),
    ("https://h.com/a/1", "https://h.com/a/x", ["/a/**"], ["/a/x"], False, "https://h.com/a/1"),
    ("https://h.com/a/1", "https://h.com/a/2/?q=1#t", None, None, False, "https://h.com/a/2"),
    ("https://h.com/a/1/", "https://h.com/a/1?x=1", None, None, False, "https://h.com/a/1/"),
    ("https://h.com/a/1", "https://h.com/d?id=1&utm_source=x", None, None, True, "https://h.com/d?id=1"),
    ("https://h.com/a/1", "nonsense", None, None, False, "https://h.com/a/1"),
]


@pytest.mark.parametrize("case", CANONICAL)
def test_canonical(spark, case):
    asked, landed, match, exclude, keep, want = case
    df = spark.createDataFrame([(asked, landed)], "a string, b string")
    assert df.select(urls.canonical("a", "b", F.lit("https://h.com/a"), match, exclude, keep).alias("c")).first().c == want


def test_small_url_functions(spark):
    assert urls.auto_match("https://e.com/docs/") == ["/docs/**"] and urls.auto_match("https://e.com") is None
    assert urls.whatwg_text("https://E.com/a/../für/./x y") == "https://e.com/f%C3%BCr/x%20y"
    assert urls.whatwg_text("nope") is None
    df = spark.createDataFrame([("https://e.com/a/b?x=1", h) for h in ("c", "/c", "//o.org/c", "?y=2", "#t", "http://z.com/")], "b string, h string")
    assert [r[0] for r in df.select(urls.resolve("b", "h")).collect()] == ["https://e.com/a/c", "https://e.com/c", "https://o.org/c", "https://e.com/a/b?y=2", "https://e.com/a/b?x=1#t", "http://z.com/"]
    login = spark.createDataFrame([("https://e.com/a", "https://e.com/a", "Log In now"), ("https://e.com/a", "https://sso.e.com/", "x"), ("https://e.com/a", "https://e.com/b", None)], "r string, l string, t string")
    assert [r[0] for r in login.select(urls.login_like("r", "l", "t")).collect()] == [True, True, False]
    assert _one(spark, urls.inspect_name(F.lit("https://e.com/a/b/"))) == "a-b" and _one(spark, urls.inspect_name(F.lit("https://e.com/"))) == "index"


def test_expressions_are_those_of_the_jvm(spark):
    df = spark.createDataFrame([("/en/guide",), ("/fr/guide",)], "p string")
    hit = lambda pattern: [r[0] for r in df.select(patterns.any_match(df.p, [pattern])).collect()]
    assert hit("re:^/(?<lang>en|de)/") == [True, False]
    assert hit("re:^/(?P<lang>en)/") == [False, False] and hit("re:[unclosed") == [False, False]
    assert patterns.excluding("/de/x", ["re:^/(?<lang>en|de)/"]) and patterns.excluding("/fr/x", ["re:^/(?<lang>en|de)/"]) is None
    assert urls.start_url("https://e.com/docs///") == "https://e.com/docs"
