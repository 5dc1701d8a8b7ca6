from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from feedspark.functions.urls import is_likely_article_url


def python_rule(url):
    """The article-URL rule stated directly on Python's urlparse (ground truth for the test)."""
    try:
        path = urlparse(url).path
        if not path or path == "/":
            return False
        segs = [s for s in path.split("/") if s]
        if not segs:
            return False
        if len(segs) > 1:
            return True
        s = segs[0]
        return any(c.isdigit() for c in s) or "-" in s or len(s) > 15
    except Exception:
        return False


FIXTURE = [
    ("https://x.com", False), ("https://x.com/", False), ("https://x.com/?q=a-b", False),
    ("https://x.com//", False), ("https://x.com/news", False), ("https://x.com/video", False),
    ("https://x.com/a/b", True), ("https://x.com/video/1", True), ("https://x.com/top-story", True),
    ("https://x.com/live-updates", True), ("https://x.com/news2024", True),
    ("https://x.com/abcdefghijklmno", False), ("https://x.com/abcdefghijklmnop", True),
    ("https://x.com/a;b-c", False), ("https://x.com/a;x/b-c", True), ("x.com/foo/bar", True),
    ("https://x.com/a b/c", True), ("http://[bad/x/y", False), ("https://x.com/news²", True),
]

EXTRA = ["  https://x.com/a/b", "https://x.com/a\tb-c", "mailto:someone", "ftp://h/x;type=a", "https://x.com/①",
         "https://x.com/#frag/a/b", "HTTPS://X.COM/A-B?x=1", "", "https://x.com/%20-", "//host/a1"]


@pytest.mark.parametrize("url,expected", FIXTURE)
def test_fixture_matches_python(url, expected):
    assert python_rule(url) == expected


def test_spark_rule(spark):
    urls = [u for u, _ in FIXTURE] + EXTRA
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(is_likely_article_url(F.col("u"))).collect()]
    assert got == [python_rule(u) for u in urls]


def test_null_url_is_false(spark):
    df = spark.createDataFrame([(None,)], "u string")
    assert df.select(is_likely_article_url(F.col("u"))).first()[0] is False
