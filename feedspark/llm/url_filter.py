"""Operator 8: URL filters by a blocked Bloom filter and an exact hash join, in DataFrame expressions alone.

Listed are rules (host and path, which fit a host and its subdomains and every path that starts alike) and
canonical URLs. A page's keys are its canonical URL and every ending of its host, at a dot, with every start of
its path that is as long as some rule's path. The Bloom filter has blocks of 8 words of 32 bits; a listed key sets
one bit in each word of the one block that its hash names. The number of blocks is at most MAX_BLOCKS, so the
broadcast table of blocks is bounded whatever the list's length; a key whose bits are all set is only a possible
hit, and an exact join with the list removes the false ones. The longest rule decides; without a rule, a listed
canonical URL is blocked and any other allowed.

Keys are made for distinct URLs; the verdicts are joined to the pages by URL.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and is allowed; repeated
rows, URLs and ids, and null ids, give a row each; other columns are not read; the empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .literals import constant_table

#: (host, path, verdict) (fixed values).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Names of sites whose pages are listed.
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
WORDS, WORD_BITS, BITS_PER_KEY, MAX_BLOCKS = 8, 32, 16, 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without a final .html or slashes; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) for i in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the column ``key``, and the number of blocks (a power of two)."""
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * WORDS * WORD_BITS < n_keys * BITS_PER_KEY:
        n_blocks *= 2
    made = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return made.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def possible_hits(probes: DataFrame, filter_: DataFrame, n_blocks: int, others: bool = False) -> DataFrame:
    """Rows of ``probes`` whose ``key`` may be listed; with ``others`` all rows, and whether it may in ``__hit``."""
    hit = None
    for i, b in enumerate(_bits(F.col("key"))):
        c = F.col(f"w{i}").bitwiseAND(b) != 0
        hit = c if hit is None else hit & c
    # at most MAX_BLOCKS rows of nine numbers
    met = probes.withColumn("block", _block(F.col("key"), n_blocks)).join(F.broadcast(filter_), "block", "left" if others else "inner")
    if others:
        return met.withColumn("__hit", F.coalesce(hit, F.lit(False))).select(*probes.columns, "__hit")
    return met.where(hit).select(probes.columns)


def page_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(url, key) of distinct ``url``s: R and a rule that would fit, or U and the canonical URL."""
    host, path = host_path(F.col("url"))
    parts = urls.select("url", host.alias("h"), path.alias("p")).where(F.col("h") != "")
    labels = F.split("h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    starts = F.filter(starts, lambda x: x.isNotNull())
    rules = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(F.lit("R"), e, s))))
    own = F.array(F.concat(F.lit("U"), canonical(F.col("h"), F.col("p"))))
    return parts.select("url", F.explode(F.array_distinct(F.concat(rules, own))).alias("key"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row; ``listed`` has one column of URLs to block."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col(listed.columns[0]))
    urls = listed.where(host != "").select(F.concat(F.lit("U"), canonical(host, path)).alias("key")).distinct()
    fixed = constant_table(spark, ["key", "rule", "verdict", "size"], [("R" + h + p, h + p, v, len(h) + len(p)) for h, p, v in rules],
                           ["string", "string", "string", "int"])
    entries = fixed.unionByName(urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("size")))
    filter_, n_blocks = bloom(entries, urls.count() + len(rules))
    probes = page_keys(pages.select("url").where(F.col("url").isNotNull()).distinct(), sorted({len(p) for _, p, _ in rules}))
    hits = possible_hits(probes, filter_, n_blocks).join(entries, "key")
    best = hits.groupBy("url").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    host, path = host_path(F.col("url"))
    return pages.join(best, "url", "left").select(
        F.col("__id").alias(id_col), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """URLs of the pages of LISTED_SITES."""
    host, _ = host_path(F.col("url"))
    return pages.where(F.exists(F.split(host, r"\."), lambda x: x.isin(*LISTED_SITES))).select("url")


def op8(spark, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed_urls(pages))


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    sites = ", ".join(f"'{s}'" for s in LISTED_SITES)
    part = lambda i: f"regexp_extract(coalesce(url, ''), '{PARTS}', {i})"
    canon = r"regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '')"
    return f"""
WITH r(h, p, v) AS (VALUES {rules}),
g AS (SELECT row_number() OVER () AS n, page_id, translate({part(1)}, '{UPPER}', '{LOWER}') AS host, {part(2)} AS path FROM pages),
l AS (SELECT DISTINCT {canon} AS c FROM g WHERE len(list_intersect(string_split(host, '.'), [{sites}])) > 0),
m AS (SELECT n, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS verdict FROM g JOIN r
      ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, m.rule AS rule,
  CASE WHEN m.verdict IS NOT NULL THEN m.verdict WHEN host <> '' AND {canon} IN (SELECT c FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM g LEFT JOIN m USING (n)
"""


OP8_SQL = _sql()
