"""Main text of literal pages: no <article>, navigation, nested and broken tags."""
from html.parser import HTMLParser

import pytest

from feedspark.functions import main_text as M

LONG = "This paragraph has quite a few words, more than fifteen of them, so that it is surely taken for content by the rule."
MORE = "Another paragraph follows it with many other words, again more than fifteen of them, and no links at all inside of it."
NAV = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page,want", [
    (f"<html><body><div>{NAV}</div><div class='x'><h1>The title</h1><div>{LONG}</div><div>{MORE}</div></div><div>(c) 2024</div></body></html>", ["The title", LONG, MORE]),
    (f"<body><nav>{LONG}</nav><p>{LONG}<p>{MORE}</body>", [LONG, MORE]),
    (f"<div><div><span>{LONG[:40]}</span><b>{LONG[40:]}</b></div><footer>{MORE}</footer></div>", [LONG]),
    (f"<article><p>{LONG}</p><p>Six words beside a long one.</p><p>Two words</p><p>{MORE}</p></article>", [LONG, "Six words beside a long one.", MORE]),
    (f"<p><a href='#'>{LONG}</a></p><p>{MORE}</p>", [MORE]),
    (f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p > a {{}}</style><!-- <p>{LONG}</p> --><p>{MORE}</p>", [MORE]),
    (f"<form><div>{LONG}<form></form></div></form><td>{MORE} &amp; &eacute;</td>", [MORE + " & é"]),
    (f"<p title='a > b'>{LONG}", [LONG]),
    (f"<title>{LONG}</title>{MORE}", [MORE]),
    ("", []), (None, []), ("no tags and few words", []), ("<<<>>> < p", []),
    (LONG, [LONG]),
])
def test_literal_pages(page, want):
    assert M.main_text(page)[0] == "\n\n".join(want)


class Plain(HTMLParser):
    """Blocks by the library's parser, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.blocks, self.text, self.linked, self.links, self.skip, self.heading = [], "", 0, 0, 0, False

    def close_block(self, heading=False):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append((text, len(text.split()), self.linked, self.heading))
        self.text, self.linked, self.links, self.heading = "", 0, 0, heading

    def handle_starttag(self, tag, attrs):
        if not self.skip and (tag in M.BLOCKS or tag in M.SKIPPED):
            self.close_block(tag in M.HEADINGS)
        self.skip += tag in M.SKIPPED
        self.links = 1 if tag == "a" else self.links

    def handle_endtag(self, tag):
        self.skip -= tag in M.SKIPPED
        if not self.skip and tag in M.BLOCKS:
            self.close_block()
        self.links = 0 if tag == "a" else self.links

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.linked += len(data.split()) if self.links else 0


def test_blocks_of_the_pages_equal_a_library_parser(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert len(pages) > 10
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close_block()
        assert [(b.text, b.words, b.linked, b.heading) for b in M.segment(page)] == plain.blocks


def test_table_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html")
    got = M.with_main_text(pages.unionByName(spark.createDataFrame([("u", None)], "url string, html string"))).collect()
    assert len(got) == pages.count() + 1
    assert all(r["n_kept"] <= r["n_blocks"] for r in got) and sum(bool(r["main_text"]) for r in got) > 10
    assert [(r["main_text"], r["n_blocks"]) for r in got if r["url"] == "u"] == [("", 0)]
