"""Is a search hit an article page rather than a home/section page (Python ``urlparse`` rules)."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes for which Python's urlparse splits ';params' off the last path segment
# (urllib.parse.uses_params).
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
                 "rtspu", "sip", "sips", "mms", "sftp", "tel")

# A single path segment longer than this counts as an article slug.
SLUG_MIN_EXCLUSIVE = 15

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
LEADING_C0_RE = r"^[\x00-\x20]+"
UNSAFE_BYTES_RE = r"[\t\r\n]"


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Regex class of every code point where Python's ``str.isdigit()`` is true.

    Built from the running interpreter's Unicode tables (decimal digits plus superscripts,
    circled digits, ...), written as ``\\x{...}`` ranges that both Java regex and RE2 accept.
    """
    cps = [cp for cp in range(0x110000) if chr(cp).isdigit()]
    ranges, start, prev = [], cps[0], cps[0]
    for cp in cps[1:]:
        if cp != prev + 1:
            ranges.append((start, prev))
            start = cp
        prev = cp
    ranges.append((start, prev))
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{body}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_path(url) -> Column:
    """Path as Python's urlparse returns it (params of the last segment removed)."""
    u = F.regexp_replace(F.regexp_replace(_c(url), LEADING_C0_RE, ""), UNSAFE_BYTES_RE, "")
    scheme = F.lower(F.regexp_extract(u, SCHEME_RE, 1))
    path = F.regexp_extract(u, PATH_RE, 1)
    return F.when(scheme.isin(*PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def _netloc_unbalanced(url) -> Column:
    u = F.regexp_replace(F.regexp_replace(_c(url), LEADING_C0_RE, ""), UNSAFE_BYTES_RE, "")
    net = F.regexp_extract(u, NETLOC_RE, 1)
    return (F.instr(net, "[") > 0) != (F.instr(net, "]") > 0)


def is_likely_article_url(url) -> Column:
    """True for URLs that look like an article; never NULL (NULL/empty url -> False)."""
    path = url_path(url)
    segs = F.filter(F.split(path, "/"), lambda s: s != F.lit(""))
    n = F.size(segs)
    first = F.element_at(segs, 1)
    one_seg_article = (first.rlike(digit_class()) | (F.instr(first, "-") > 0)
                       | (F.length(first) > SLUG_MIN_EXCLUSIVE))
    verdict = (F.when(_c(url).isNull(), False)
               .when(_netloc_unbalanced(url), False)
               .when((path == "") | (path == "/"), False)
               .when(n == 0, False)
               .when(n > 1, True)
               .when(one_seg_article, True)
               .otherwise(False))
    return verdict


def url_root(url) -> Column:
    """scheme://host part of a URL (used to make home-page hits in the stand-in search table)."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
