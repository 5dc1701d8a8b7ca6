"""Main text of a page by text and link density, in one pass over its tags.

A page is cut into text blocks at block-level tags. Each block knows its words, how many of them stand in links, and the
tag around it; text in regions that never carry an article (navigation, forms, scripts, ...) is left out at once. A block is
content if few of its words are links and it is long, or if it is of middle length and a neighbour is content; a
heading counts if content follows it. Pages without an <article> or <p> are handled like all others.

The rule works on one page at a time, so pages go through Arrow batches; what Spark has is the pages' table and its partitions.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a long block, and of one of middle length; largest share of words in links.
LONG, MIDDLE, LINK_SHARE = 15, 6, 0.33
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
# Tags that hold no article text; block-level tags; tags without an end.
SKIPPED = frozenset("script style noscript template svg iframe object nav footer aside form button select option textarea head menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
RAW = frozenset(("script", "style", "textarea", "title"))


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool


def segment(page: str) -> Iterator[Block]:
    """Text blocks of a page in their order."""
    pieces: list[str] = []
    linked = skipped_words = 0
    in_link, heading = 0, False
    skip: list[str] = []          # open tags of the region that is left out, the outermost first
    at = 0

    def block() -> Block | None:
        text = " ".join(html.unescape("".join(pieces)).split())
        return Block(text, len(text.split()), linked, heading) if text else None

    while at <= len(page):
        tag = TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if not skip and text:
            pieces.append(text)
            if in_link:
                linked += len(html.unescape(text).split())
        if not tag:
            break
        at = tag.end()
        name = (tag.group(2) or "").lower()
        end = tag.group(1) == "/"
        if not name:
            continue
        if not end and name in RAW and not (tag.group(3) or "").endswith("/"):  # its content is no markup
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name in SKIPPED or name == "title":
                at = close.end() if close else len(page)
            continue
        if skip:
            if end and name in skip:
                del skip[len(skip) - 1 - skip[::-1].index(name):]
            elif not end and name in SKIPPED and not (tag.group(3) or "").endswith("/"):
                skip.append(name)
            continue
        if name in BLOCKS or name in SKIPPED:
            if done := block():
                yield done
            pieces, linked = [], 0
            heading = name in HEADINGS and not end
            if name != "br":
                in_link = 0  # a link left open ends with its block
        if name == "a":
            in_link = 0 if end else 1
        elif not end and name in SKIPPED and not (tag.group(3) or "").endswith("/"):
            skip.append(name)
    if done := block():
        yield done


def content(blocks: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    few_links = [b.linked <= LINK_SHARE * b.words for b in blocks]
    sure = [few and b.words >= LONG and not b.heading for b, few in zip(blocks, few_links)]
    near = lambda i: (i > 0 and sure[i - 1]) or (i + 1 < len(blocks) and sure[i + 1])
    kept = [s or (few and not b.heading and b.words >= MIDDLE and near(i)) for i, (b, few, s) in enumerate(zip(blocks, few_links, sure))]
    for i in range(len(blocks) - 2, -1, -1):  # a heading, or a heading before one, in front of content
        if blocks[i].heading and few_links[i] and kept[i + 1]:
            kept[i] = True
    return kept


def main_text(page: str | None) -> tuple[str, int, int]:
    """(main text, its blocks apart by empty lines; number of blocks; number of blocks kept)."""
    blocks = list(segment(page or ""))
    kept = content(blocks)
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k), len(blocks), sum(kept)


def with_main_text(pages: DataFrame, key: str = "url", html_col: str = "html") -> DataFrame:
    """(key, main_text, n_blocks, n_kept) of every page; a null page has the empty text."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [main_text(page) for page in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                                                 names=[key, "main_text", "n_blocks", "n_kept"])

    return pages.select(key, html_col).mapInArrow(run, f"`{key}` {kind}, main_text string, n_blocks int, n_kept int")
