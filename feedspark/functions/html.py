"""Page-text extraction from raw HTML with regular expressions that Java regex and RE2 agree on.

Re-aims per-URL HTML parsing as column expressions over a ``pages(url, html)`` table.
"""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Markup that never carries article text (scripts, styles, comments).
NOISE_RE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
# The first paragraph runs to its close tag or to the next block that implicitly ends it.
FIRST_P_RE = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p(?:\s[^>]*)?>|</article>|<div|$)"
# The article body.
ARTICLE_RE = r"(?is)<article\b[^>]*>(.*?)</article>"
# A meta tag: quoted attribute values may hold '>'.
META_TAG_RE = r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title>"
TAG_RE = r"<[^>]*>"
# Tags whose boundaries become line breaks in the full text.
BLOCK_TAG_RE = (r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|blockquote|section|article|header|"
                r"footer|nav|pre|hr)\b[^>]*>")
# Paragraph terminators used to close paragraphs explicitly before extracting them all.
P_OPEN_RE = r"(?i)(<p(?:\s[^>]*)?>)"
P_BREAK_RE = r"(?i)(</article>|<div)"
ALL_P_RE = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"

# Named character references of HTML 4 and the apostrophe of XML.
ENTITIES = {**name2codepoint, "apos": 39}
# A reference behind its '&': decimal, hexadecimal or named.
REFERENCE_RE = r"^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));"
REPLACEMENT = 0xFFFD

# Description length limits and suffix.
P_DESCRIPTION_CHARS = 300
FULLTEXT_DESCRIPTION_CHARS = 250
ELLIPSIS = "..."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _character(code: Column) -> Column:
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    code = F.when(valid, code).otherwise(F.lit(REPLACEMENT))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(c) -> Column:
    """Character references replaced by their character, each once; unknown ones stay."""
    text = _c(c)
    names = F.create_map(*[F.lit(x) for pair in sorted(ENTITIES.items()) for x in pair])
    parts = F.split(text, "&")

    def decoded(part: Column) -> Column:
        dec, hexa, name = (F.regexp_extract(part, REFERENCE_RE, g) for g in (1, 2, 3))
        code = (F.when(dec != "", dec.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
                .when(name != "", F.try_element_at(names, name)))
        rest = F.substr(part, F.locate(";", part) + 1)
        return F.when(code.isNotNull(), F.concat(_character(code), rest)).otherwise(F.concat(F.lit("&"), part))

    tail = F.transform(F.slice(parts, 2, F.size(parts)), decoded)
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), TAG_RE, "")


def remove_noise(html) -> Column:
    return F.regexp_replace(_c(html), NOISE_RE, "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, double-quoted, single-quoted or bare ('' when absent)."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def meta_description_raw(clean_html) -> Column:
    """Content of the first <meta name=description>, entity-decoded, not stripped ('' when absent)."""
    tags = F.filter(F.regexp_extract_all(_c(clean_html), F.lit(META_TAG_RE), F.lit(0)), lambda t: attribute(t, "name") == "description")
    return decode_entities(attribute(F.coalesce(F.get(tags, F.lit(0)), F.lit("")), "content"))


def has_paragraph(clean_html) -> Column:
    return _c(clean_html).rlike(r"(?i)<p(?:\s[^>]*)?>")


def first_paragraph_text(clean_html) -> Column:
    """Text of the first <p> (tags removed, entities decoded, not stripped)."""
    return decode_entities(strip_tags(F.regexp_extract(_c(clean_html), FIRST_P_RE, 1)))


def page_description(clean_html) -> Column:
    """Meta description (stripped) if its content is non-empty; else first paragraph text, stripped,
    first 300 chars, always followed by '...'; else NULL."""
    meta = meta_description_raw(clean_html)
    p = first_paragraph_text(clean_html)
    return (F.when(meta != "", py_strip(meta))
            .when(has_paragraph(clean_html) & (p != ""),
                  F.concat(F.substring(py_strip(p), 1, P_DESCRIPTION_CHARS), F.lit(ELLIPSIS)))
            .otherwise(F.lit(None).cast("string")))


def _lines_to_text(c) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: py_strip(x))
    return F.array_join(F.filter(lines, lambda x: x != F.lit("")), "\n\n")


def page_full_text(clean_html) -> Column:
    """Main text: the <article> body, else all paragraphs; block boundaries become paragraph breaks."""
    body = F.regexp_extract(_c(clean_html), ARTICLE_RE, 1)
    closed = F.concat(
        F.regexp_replace(F.regexp_replace(_c(clean_html), P_OPEN_RE, "</p>$1"), P_BREAK_RE, "</p>$1"),
        F.lit("</p>"))
    paragraphs = F.array_join(F.regexp_extract_all(closed, F.lit(ALL_P_RE), F.lit(1)), "\n")
    src = F.when(body != "", body).otherwise(paragraphs)
    text = decode_entities(strip_tags(F.regexp_replace(src, BLOCK_TAG_RE, "\n")))
    return _lines_to_text(text)


def page_title(clean_html) -> Column:
    return py_strip(decode_entities(strip_tags(F.regexp_extract(_c(clean_html), TITLE_RE, 1))))
