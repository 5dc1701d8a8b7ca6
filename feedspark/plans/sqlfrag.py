"""SQL fragments for the oracle (DuckDB dialect): the same stand-in views and scalar rules as the
Spark code in SQL. Patterns that both engines share are checked against literal cases in tests."""
from __future__ import annotations

from html.entities import name2codepoint

from ..functions.text import PY_WHITESPACE

WS = "(" + " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def hash32(*parts: str) -> str:
    joined = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def text_field(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return f"CASE WHEN lower({s}) IN ('nan', 'none', '') THEN NULL ELSE {s} END"


def combine(*cols: str) -> str:
    return "concat_ws('. ', " + ", ".join(text_field(c) for c in cols) + ")"


def round5(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 5)"


_TS = "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(names: list[str] | tuple[str, ...], final: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in order) + "\n" + final


# ---------------------------------------------------------------- stand-in views
cte("art_base", (), f"""
SELECT CAST(doc_id AS VARCHAR) AS article_id,
       CASE WHEN doc_id % 41 = 7 THEN '  ' ELSE split_part(text, chr(10), 1) END AS title,
       CASE WHEN doc_id % 7 = 0 OR doc_id % 41 = 7 THEN 'NaN' ELSE substr(text, 1, 200) END AS description,
       CASE WHEN doc_id % 41 = 7 THEN 'none' ELSE text END AS content,
       CASE WHEN doc_id % 19 = 0 THEN NULL
            WHEN doc_id % 23 = 0 THEN 'general'
            WHEN doc_id % 29 = 0 THEN 'News '
            WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) || ' '
            ELSE lang END AS category,
       CASE WHEN doc_id % 17 = 0 THEN 'not-a-date'
            WHEN doc_id % 13 = 0 THEN strftime({_TS}, '%Y-%m-%d')
            WHEN doc_id % 31 = 0 THEN strftime({_TS}, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime({_TS}, '%Y-%m-%d %H:%M:%S') END AS published_at,
       doc_id * 2 AS row_ord
FROM documents""")

cte("articles", ("art_base",), """
SELECT article_id, title, description, content, category, published_at, row_ord FROM art_base
UNION ALL
SELECT article_id, title, CAST(NULL AS VARCHAR) AS description, content, upper(category) AS category, published_at,
       CASE WHEN CAST(article_id AS BIGINT) % 20 = 10 THEN row_ord - 1 ELSE row_ord + 1 END AS row_ord
FROM art_base WHERE CAST(article_id AS BIGINT) % 10 = 0""")


def sampled_articles_cte(name: str, cap: int, seed: int = 42) -> None:
    cte(name, ("articles",), f"""
SELECT * FROM articles
QUALIFY row_number() OVER (ORDER BY {hash32(str(seed), 'row_ord')}, row_ord) <= {cap}""")


cte("art_dedup", ("articles",), """
SELECT * FROM articles WHERE article_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY row_ord) = 1""")

cte("art_steps", ("art_dedup",), f"""
SELECT article_id, category, published_at, row_ord,
       {combine('title', 'description', 'content')} AS combined_text
FROM art_dedup""")

cte("art_filtered", ("art_steps",), f"""
SELECT article_id, {strip('lower(CAST(category AS VARCHAR))')} AS category,
       try_cast({strip('published_at')} AS TIMESTAMP) AS published_at, combined_text
FROM art_steps
WHERE category IS NOT NULL AND {strip('combined_text')} <> ''
  AND try_cast({strip('published_at')} AS TIMESTAMP) IS NOT NULL""")

cte("category_labels", ("art_filtered",), """
SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS category_encoded
FROM (SELECT DISTINCT category FROM art_filtered) c""")

cte("processed", ("art_filtered", "category_labels"), """
SELECT f.article_id, f.category, l.category_encoded, f.published_at, f.combined_text
FROM art_filtered f JOIN category_labels l USING (category)""")


# ---------------------------------------------------------------- vectors, interactions, profiles
TOKEN_RE = r"[^\p{L}\p{N}]+"


def encode_sparse(name: str, src: str, key: str, text: str, dim: int = 64, deps: tuple[str, ...] = ()) -> None:
    """Hashed bag-of-words in long sparse form: name(key, b, v) with v the L2-normalised count."""
    cte(name + "_cnt", deps, f"""
SELECT {key} AS k, {hash32('t')} % {dim} AS b, CAST(count(*) AS DOUBLE) AS c
FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '{TOKEN_RE}')) AS t FROM {src}) x
WHERE t <> '' GROUP BY 1, 2""")
    cte(name, (name + "_cnt",), f"""
SELECT c.k, c.b, c.c / n.nrm AS v
FROM {name}_cnt c JOIN (SELECT k, sqrt(sum(c * c)) AS nrm FROM {name}_cnt GROUP BY k) n USING (k)""")


cte("vector_docs", (), """
SELECT CAST(doc_id AS VARCHAR) AS article_id, text FROM documents""")
encode_sparse("avec", "vector_docs", "article_id", "text", deps=("vector_docs",))

cte("interactions", (), """
SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 50 = 7 THEN 'unknown-' || event_id % 7 ELSE CAST(event_id % (SELECT max(doc_id) + 1 FROM documents) AS VARCHAR) END AS item_id,
       CAST(1.0 AS DOUBLE) AS rating, ts AS timestamp
FROM events
WHERE event_type IN ('view', 'click', 'purchase')""")

cte("interactions_graded", (), """
SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 50 = 7 THEN 'unknown-' || event_id % 7 ELSE CAST(event_id % (SELECT max(doc_id) + 1 FROM documents) AS VARCHAR) END AS item_id,
       CAST(least(value / 100.0, 1.0) AS DOUBLE) AS rating, ts AS timestamp
FROM events
WHERE event_type IN ('view', 'click', 'purchase')""")

cte("emb_long", (), """
SELECT CAST(vec_id AS VARCHAR) AS article_id, label, CAST(e.pos - 1 AS INTEGER) AS pos, CAST(e.value AS DOUBLE) AS value
FROM (SELECT vec_id, label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings) e""")

cte("user_prefs_long", (), """
SELECT CAST(u.user_id AS VARCHAR) AS user_id, l.lang
FROM (SELECT DISTINCT user_id FROM events) u
JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM (SELECT DISTINCT lang FROM documents) d) l
  ON l.idx = u.user_id % 4 OR (u.user_id % 3 = 0 AND l.idx = (u.user_id + 1) % 4)""")

cte("user_prefs", ("user_prefs_long",), """
SELECT user_id, string_agg(lang, ',' ORDER BY lang) AS preferences FROM user_prefs_long GROUP BY user_id""")

cte("liked_counts", ("interactions",), """
SELECT user_id, item_id, count(*) AS w FROM interactions GROUP BY 1, 2""")

# profile over the driver's labelled vectors
cte("pmean_e", ("liked_counts", "emb_long"), """
SELECT l.user_id, e.pos, sum(l.w * e.value) / sum(l.w) AS value, sum(l.w) AS n_liked
FROM liked_counts l JOIN emb_long e ON e.article_id = l.item_id GROUP BY 1, 2""")
cte("pnorm_e", ("pmean_e",), "SELECT user_id, sqrt(sum(value * value)) AS nrm FROM pmean_e GROUP BY 1")
cte("punit_e", ("pmean_e", "pnorm_e"), """
SELECT m.user_id, m.pos, CASE WHEN n.nrm > 0 THEN m.value / n.nrm ELSE m.value END AS value
FROM pmean_e m JOIN pnorm_e n USING (user_id)""")

# flagship profile over the hashed document vectors (sparse)
cte("pmean_f", ("liked_counts", "avec"), """
SELECT l.user_id, a.b, sum(l.w * a.v) / t.n AS value
FROM liked_counts l JOIN avec a ON a.k = l.item_id
JOIN (SELECT l2.user_id, sum(l2.w) AS n FROM liked_counts l2
      WHERE l2.item_id IN (SELECT k FROM avec) GROUP BY 1) t ON t.user_id = l.user_id
GROUP BY l.user_id, a.b, t.n""")
cte("punit_f", ("pmean_f",), """
SELECT m.user_id, m.b, m.value / n.nrm AS value
FROM pmean_f m JOIN (SELECT user_id, sqrt(sum(value * value)) AS nrm FROM pmean_f GROUP BY 1) n USING (user_id)""")

cte("cat_counts", ("liked_counts", "vector_docs", "processed"), f"""
SELECT l.user_id, p.category, CAST(sum(l.w) AS BIGINT) AS n
FROM liked_counts l JOIN processed p ON p.article_id = l.item_id
WHERE l.item_id IN (SELECT article_id FROM vector_docs) AND p.category IS NOT NULL AND p.category <> ''
GROUP BY 1, 2""")

cte("top_cats", ("cat_counts",), """
SELECT user_id, CAST(topic_rank AS INTEGER) AS topic_rank, category, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS topic_rank FROM (
    SELECT *, max(CASE WHEN category NOT IN ('news', 'general', '') THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id) AS hs FROM cat_counts) a
  WHERE category NOT IN ('news', 'general', '') OR hs = 0) b
WHERE topic_rank <= 3""")

cte("prof_users", ("liked_counts", "vector_docs"), """
SELECT DISTINCT user_id FROM liked_counts WHERE item_id IN (SELECT article_id FROM vector_docs)""")

cte("uq", ("prof_users", "top_cats"), """
SELECT u.user_id, CAST(coalesce(t.topic_rank, 1) AS INTEGER) AS query_idx,
       CASE WHEN t.category IS NULL THEN 'top breaking news' ELSE 'latest news ' || t.category END AS query,
       CAST(count(*) OVER (PARTITION BY u.user_id) AS INTEGER) AS n_queries
FROM prof_users u LEFT JOIN top_cats t USING (user_id)""")

cte("uq_quota", ("uq",), """
SELECT *, CAST(CASE WHEN 20 < n_queries THEN 1
                    ELSE 20 // n_queries + CASE WHEN query_idx - 1 >= n_queries - 20 % n_queries THEN 1 ELSE 0 END
               END AS INTEGER) AS quota
FROM uq""")

# ---------------------------------------------------------------- pages and search stand-in
NOISE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
FIRST_P = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p(?:\s[^>]*)?>|</article>|<div|$)"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
META_TAG = r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
BLOCK = (r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|blockquote|section|article|header|"
         r"footer|nav|pre|hr)\b[^>]*>")
REFERENCE = r"^(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));"
NAMES = "MAP {" + ", ".join(f"'{n}': {c}" for n, c in sorted({**name2codepoint, "apos": 39}.items())) + "}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def decode(x: str) -> str:
    """Character references in one go: text is cut at every '&'."""
    ref = lambda g: f"regexp_extract(p, {q(REFERENCE)}, {g})"
    code = (f"CASE WHEN {ref(1)} <> '' THEN CAST({ref(1)} AS INTEGER) WHEN {ref(2)} <> '' THEN CAST('0x' || {ref(2)} AS INTEGER) "
            f"WHEN {ref(3)} <> '' THEN {NAMES}[{ref(3)}] END")
    safe = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN ({code}) ELSE 65533 END"
    one = f"CASE WHEN ({code}) IS NULL THEN '&' || p ELSE chr({safe}) || substr(p, strpos(p, ';') + 1) END"
    parts = f"string_split({x}, '&')"
    return (f"CASE WHEN contains({x}, '&') THEN {parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {one}), '') "
            f"ELSE {x} END")


def attribute(tag: str, name: str) -> str:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return "(" + " || ".join(f"regexp_extract({tag}, {q(pattern)}, {g})" for g in (1, 2, 3)) + ")"


def untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def first_p_text(clean: str) -> str:
    return decode(untag(f"regexp_extract({clean}, {q(FIRST_P)}, 1)"))


cte("page_clean", (), f"""
SELECT page_id, url, regexp_replace(html, {q(NOISE)}, '', 'g') AS clean FROM pages""")

cte("page_given", ("page_clean",), """
SELECT page_id, url, CASE WHEN page_id % 17 = 3 THEN '' ELSE clean END AS clean FROM page_clean""")

cte("page_feat", ("page_given",), f"""
SELECT url,
  CASE WHEN meta <> '' THEN {strip('meta')}
       WHEN regexp_matches(clean, '(?i)<p(?:\\s[^>]*)?>') AND ptext <> '' THEN substr({strip('ptext')}, 1, 300) || '...'
       ELSE NULL END AS description,
  array_to_string(list_filter(list_transform(string_split(
      {decode(untag(f"regexp_replace(CASE WHEN body <> '' THEN body ELSE allp END, {q(BLOCK)}, chr(10), 'g')"))},
      chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS full_text
FROM (
  SELECT url, clean,
    {decode("mcontent")} AS meta,
    {first_p_text('clean')} AS ptext,
    regexp_extract(clean, {q(ARTICLE)}, 1) AS body,
    array_to_string(regexp_extract_all(
        regexp_replace(regexp_replace(clean, '(?i)(<p(?:\\s[^>]*)?>)', '</p>\\1', 'g'), '(?i)(</article>|<div)', '</p>\\1', 'g') || '</p>',
        '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), chr(10)) AS allp
  FROM (SELECT url, clean, {attribute("mtag", "content")} AS mcontent FROM (
    SELECT url, clean, coalesce(list_filter(regexp_extract_all(clean, {q(META_TAG)}, 0), lambda t: {attribute("t", "name")} = 'description')[1], '') AS mtag
    FROM page_given) m0) m
) f""")

cte("page_hits", ("page_clean",), f"""
SELECT query, page_id,
  CASE WHEN page_id % 11 = 0 THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) ELSE url END AS link,
  CASE WHEN page_id % 13 = 0 AND query <> 'latest news en' THEN NULL ELSE page_title END AS title,
  snippet
FROM (
  SELECT 'latest news ' || v.qlang AS query, p.* FROM (
    SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS lang,
           {strip(decode(untag(f"regexp_extract(clean, {q(TITLE)}, 1)")))} AS page_title,
           substr({strip(first_p_text('clean'))}, 1, CASE WHEN page_id % 17 = 3 THEN 29 ELSE 160 END) AS snippet
    FROM page_clean) p
  JOIN (VALUES ('en'), ('de'), ('fr'), ('es')) v(qlang) ON p.lang = v.qlang OR p.page_id % 5 = 0
  UNION ALL
  SELECT 'top breaking news' AS query, page_id, url,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS lang,
         {strip(decode(untag(f"regexp_extract(clean, {q(TITLE)}, 1)")))} AS page_title,
         substr({strip(first_p_text('clean'))}, 1, CASE WHEN page_id % 17 = 3 THEN 29 ELSE 160 END) AS snippet
  FROM page_clean) h""")

cte("search_results", ("page_hits",), """
SELECT query, CAST(pos AS INTEGER) AS pos, link, title, snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY page_id) AS pos FROM page_hits) r""")


# ---------------------------------------------------------------- URL rule and candidates
def url_flags_cte(name: str, src: str, link: str, deps: tuple[str, ...]) -> None:
    """name(all src columns, is_article): Python urlparse-based article-URL rule in SQL."""
    from ..functions.urls import NETLOC_RE, PARAM_SCHEMES, PATH_RE, SCHEME_RE, digit_class
    schemes = ", ".join(q(s) for s in PARAM_SCHEMES)
    cte(name + "_p", deps, f"""
SELECT *, lower(regexp_extract(__u, {q(SCHEME_RE)}, 1)) AS __scheme,
       regexp_extract(__u, {q(PATH_RE)}, 1) AS __path0,
       regexp_extract(__u, {q(NETLOC_RE)}, 1) AS __net
FROM (SELECT *, regexp_replace(regexp_replace({link}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g') AS __u FROM {src}) s""")
    cte(name + "_q", (name + "_p",), f"""
SELECT *, list_filter(string_split(__path, '/'), lambda s: s <> '') AS __segs FROM (
  SELECT *, CASE WHEN __scheme IN ({schemes}) THEN regexp_replace(__path0, ';[^/]*$', '') ELSE __path0 END AS __path
  FROM {name}_p) s""")
    cte(name, (name + "_q",), f"""
SELECT * EXCLUDE (__u, __scheme, __path0, __net, __path, __segs),
  CASE WHEN {link} IS NULL THEN false
       WHEN contains(__net, '[') <> contains(__net, ']') THEN false
       WHEN __path = '' OR __path = '/' THEN false
       WHEN len(__segs) = 0 THEN false
       WHEN len(__segs) > 1 THEN true
       WHEN regexp_matches(__segs[1], {q(digit_class())}) OR contains(__segs[1], '-') OR length(__segs[1]) > 15 THEN true
       ELSE false END AS is_article
FROM {name}_q""")


cte("hits", ("uq_quota", "search_results"), """
SELECT u.user_id, u.query_idx, s.pos, s.link, s.title, s.snippet
FROM uq_quota u JOIN search_results s ON s.query = u.query AND s.pos <= u.quota""")

cte("hits_dedup", ("hits",), """
SELECT * FROM hits WHERE link IS NOT NULL AND link <> ''
QUALIFY row_number() OVER (PARTITION BY user_id, link ORDER BY query_idx, pos) = 1""")

cte("hits_titled", ("hits_dedup",), "SELECT * FROM hits_dedup WHERE title IS NOT NULL AND title <> ''")
url_flags_cte("hits_flagged", "hits_titled", "link", ("hits_titled",))
cte("cands", ("hits_flagged",), "SELECT * EXCLUDE (is_article) FROM hits_flagged WHERE is_article")

cte("cands_text", ("cands", "page_feat"), """
SELECT c.*, f.description, f.full_text,
  CASE WHEN f.full_text IS NOT NULL AND f.full_text <> ''
            AND length(f.full_text) > length(coalesce(c.snippet, '')) * 1.5 THEN f.full_text
       ELSE c.snippet END AS te,
  coalesce(nullif(f.description, ''),
           CASE WHEN f.full_text <> '' THEN substr(f.full_text, 1, 250) || '...' END, c.snippet) AS display_description
FROM cands c LEFT JOIN page_feat f ON f.url = c.link""")

cte("ucands", ("cands_text",), """
SELECT user_id, link, query_idx, pos, title, snippet, display_description, te AS text_for_embedding
FROM cands_text WHERE te IS NOT NULL AND length(te) >= 30""")

cte("ctexts", ("ucands",), "SELECT DISTINCT text_for_embedding FROM ucands")
encode_sparse("cvec", "ctexts", "text_for_embedding", "text_for_embedding", deps=("ctexts",))

cte("scored", ("ucands", "cvec", "punit_f"), """
SELECT c.user_id, c.link, c.query_idx, c.pos, c.title, c.snippet, c.display_description,
       coalesce(sum(p.value * v.v), 0.0) AS content_score
FROM ucands c
LEFT JOIN cvec v ON v.k = c.text_for_embedding
LEFT JOIN punit_f p ON p.user_id = c.user_id AND p.b = v.b
GROUP BY c.user_id, c.link, c.query_idx, c.pos, c.title, c.snippet, c.display_description""")

cte("ranked", ("scored",), """
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY content_score DESC, query_idx, pos) AS INTEGER) AS rank
FROM scored""")


# ---------------------------------------------------------------- clustering, contrastive, CF
cte("eval_keys", ("emb_long",), f"""
SELECT article_id FROM (SELECT DISTINCT article_id FROM emb_long) k
QUALIFY row_number() OVER (ORDER BY {hash32("'42'", 'article_id')}, article_id) <= 3000""")

cte("cents", ("emb_long",), "SELECT label, pos, avg(value) AS c FROM emb_long GROUP BY 1, 2")

cte("nc_all", ("emb_long", "cents"), """
SELECT article_id, label, CAST(cl AS INTEGER) AS cluster FROM (
  SELECT e.article_id, e.label, c.label AS cl,
         sum(e.value * c.c) / (sqrt(sum(e.value * e.value)) * sqrt(sum(c.c * c.c))) AS cos
  FROM emb_long e JOIN cents c ON c.pos = e.pos GROUP BY 1, 2, 3) x
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY cos DESC, cl) = 1""")


def lloyd(name: str, src: str) -> None:
    """One round of k-means: rows go to the nearest mean of ``src`` (label, pos, c)."""
    cte(name, ("emb_long", src), f"""
SELECT article_id, CAST(cl AS INTEGER) AS cluster FROM (
  SELECT e.article_id, c.label AS cl, sum((e.value - c.c) * (e.value - c.c)) AS d
  FROM emb_long e JOIN {src} c ON c.pos = e.pos GROUP BY 1, 2) x
QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY d, cl) = 1""")


lloyd("lloyd1", "cents")
cte("cents1", ("emb_long", "lloyd1"), """
SELECT l.cluster AS label, e.pos, avg(e.value) AS c FROM emb_long e JOIN lloyd1 l USING (article_id) GROUP BY 1, 2""")
lloyd("lloyd2", "cents1")

cte("cont", ("nc_all",), "SELECT label, cluster, CAST(count(*) AS DOUBLE) AS nij FROM nc_all GROUP BY 1, 2")

cte("ari_val", ("cont",), """
SELECT CASE WHEN fn = 0 AND fp = 0 THEN 1.0
            ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari
FROM (SELECT snij - n AS tp, sa - snij AS fn, sb - snij AS fp, n * n - sa - sb + snij AS tn FROM (
  SELECT sum(nij) AS n, sum(nij * nij) AS snij,
         (SELECT sum(s * s) FROM (SELECT sum(nij) AS s FROM cont GROUP BY label) a) AS sa,
         (SELECT sum(s * s) FROM (SELECT sum(nij) AS s FROM cont GROUP BY cluster) b) AS sb
  FROM cont) s) t""")

cte("nmi_val", ("cont",), """
SELECT CASE WHEN ku = kv AND ku IN (0, 1) THEN 1.0 WHEN mi = 0 THEN 0.0 ELSE mi / ((hu + hv) / 2.0) END AS nmi
FROM (
  SELECT greatest(coalesce((SELECT sum(c.nij / t.n * ln(t.n * c.nij / (a.ai * b.bj)))
                   FROM cont c JOIN (SELECT label, sum(nij) AS ai FROM cont GROUP BY 1) a USING (label)
                   JOIN (SELECT cluster, sum(nij) AS bj FROM cont GROUP BY 1) b USING (cluster)), 0.0), 0.0) AS mi,
         (SELECT -sum(ai / t.n * ln(ai / t.n)) FROM (SELECT sum(nij) AS ai FROM cont GROUP BY label) a) AS hu,
         (SELECT -sum(bj / t.n * ln(bj / t.n)) FROM (SELECT sum(nij) AS bj FROM cont GROUP BY cluster) b) AS hv,
         (SELECT count(DISTINCT label) FROM cont) AS ku,
         (SELECT count(DISTINCT cluster) FROM cont) AS kv
  FROM (SELECT sum(nij) AS n FROM cont) t) x""")

cte("vec_cl", ("emb_long", "nc_all"), """
SELECT e.article_id, n.cluster, list(e.value ORDER BY e.pos) AS v FROM emb_long e JOIN nc_all n USING (article_id) GROUP BY 1, 2""")

cte("sil_points", ("vec_cl", "nc_all"), """
SELECT i, CASE WHEN own_n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s FROM (
  SELECT i, max(CASE WHEN own AND n > 1 THEN sd / (n - 1) END) AS a, min(CASE WHEN NOT own THEN sd / n END) AS b,
         max(CASE WHEN own THEN n END) AS own_n
  FROM (
    SELECT d.i, d.cj = d.ci AS own, sum(d.d) AS sd, cnt.n
    FROM (SELECT x.article_id AS i, x.cluster AS ci, y.cluster AS cj, sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
          FROM vec_cl x, vec_cl y) d
    JOIN (SELECT cluster, count(*) AS n FROM nc_all GROUP BY 1) cnt ON cnt.cluster = d.cj
    GROUP BY d.i, d.cj, d.ci, cnt.n) g
  GROUP BY i) h""")

cte("sil_val", ("sil_points",), "SELECT avg(s) AS silhouette FROM sil_points")

cte("cpairs", ("processed",), f"""
SELECT article_id, CAST((rn - 1) // 8 AS BIGINT) AS batch_id, CAST((rn - 1) % 8 AS INTEGER) AS slot FROM (
  SELECT article_id, row_number() OVER (ORDER BY {hash32("'42'", 'article_id')}, article_id) AS rn,
         count(*) OVER () AS total
  FROM processed) r
WHERE total >= 8""")

encode_sparse("pvec", "processed", "article_id", "combined_text", deps=("processed",))

cte("pdense", ("cpairs", "pvec"), """
SELECT g.article_id, g.batch_id, list(coalesce(v.v, 0.0) ORDER BY g.pos) AS vec
FROM (SELECT article_id, batch_id, r.pos FROM cpairs, range(64) r(pos)) g
LEFT JOIN pvec v ON v.k = g.article_id AND v.b = g.pos GROUP BY 1, 2""")

cte("closs", ("pdense",), """
SELECT avg(mx + ln(se) - own) AS loss FROM (
  SELECT i, max(own) AS own, max(mx) AS mx, sum(exp(lg - mx)) AS se FROM (
    SELECT *, max(lg) OVER (PARTITION BY i) AS mx, CASE WHEN i = j THEN lg END AS own FROM (
      SELECT a.article_id AS i, b.article_id AS j, 20.0 * list_dot_product(a.vec, b.vec) AS lg
      FROM pdense a JOIN pdense b USING (batch_id)) p) w
  GROUP BY i) z""")


def cf_ctes(prefix: str, src: str) -> None:
    cte(prefix + "_pairs", (src,), f"""
SELECT user_id, item_id, avg(rating) AS rating,
       {hash32("'42'", 'user_id', 'item_id')} < {int(0.2 * 4294967296.0)} AS is_test
FROM {src} GROUP BY 1, 2""")
    cte(prefix + "_bi", (prefix + "_pairs",), f"""
SELECT item_id, sum(rating - (SELECT avg(rating) FROM {prefix}_pairs WHERE NOT is_test)) / (10.0 + count(*)) AS b_item
FROM {prefix}_pairs WHERE NOT is_test GROUP BY 1""")
    cte(prefix + "_bu", (prefix + "_pairs", prefix + "_bi"), f"""
SELECT p.user_id, sum(p.rating - (SELECT avg(rating) FROM {prefix}_pairs WHERE NOT is_test) - i.b_item) / (15.0 + count(*)) AS b_user
FROM {prefix}_pairs p JOIN {prefix}_bi i USING (item_id) WHERE NOT p.is_test GROUP BY 1""")
    cte(prefix + "_pred", (prefix + "_pairs", prefix + "_bi", prefix + "_bu"), f"""
SELECT p.user_id, p.item_id, p.rating,
       least(greatest((SELECT avg(rating) FROM {prefix}_pairs WHERE NOT is_test)
                      + coalesce(u.b_user, 0.0) + coalesce(i.b_item, 0.0), 0.0), 1.0) AS est
FROM {prefix}_pairs p LEFT JOIN {prefix}_bi i USING (item_id) LEFT JOIN {prefix}_bu u USING (user_id)
WHERE p.is_test""")


def pr_ctes(prefix: str, pred: str, threshold: float, k: int = 10) -> None:
    cte(prefix + "_per_user", (pred,), f"""
SELECT r.user_id,
       CASE WHEN t.n_rec = 0 THEN 0.0 ELSE t.n_both / t.n_rec END AS precision,
       CASE WHEN r.n_rel = 0 THEN 0.0 ELSE t.n_both / r.n_rel END AS recall
FROM (SELECT user_id, CAST(sum(CASE WHEN rating >= {threshold} THEN 1 ELSE 0 END) AS DOUBLE) AS n_rel FROM {pred} GROUP BY 1) r
JOIN (SELECT user_id, CAST(sum(CASE WHEN est >= {threshold} THEN 1 ELSE 0 END) AS DOUBLE) AS n_rec,
             CAST(sum(CASE WHEN est >= {threshold} AND rating >= {threshold} THEN 1 ELSE 0 END) AS DOUBLE) AS n_both
      FROM (SELECT * FROM {pred} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY est DESC, item_id) <= {k}) x
      GROUP BY 1) t USING (user_id)""")
    cte(prefix + "_avg", (prefix + "_per_user",), f"""
SELECT coalesce(avg(precision), 0.0) AS precision_at_k, coalesce(avg(recall), 0.0) AS recall_at_k FROM {prefix}_per_user""")


cf_ctes("cfg", "interactions_graded")
cf_ctes("cf1", "interactions")
pr_ctes("pr1", "cf1_pred", 1.0)
pr_ctes("prg", "cfg_pred", 0.5)

cte("counts", ("processed", "interactions", "prof_users"), """
SELECT (SELECT count(*) FROM processed) AS processed_articles, (SELECT count(*) FROM interactions) AS interactions,
       (SELECT count(*) FROM prof_users) AS users_with_profiles""")


cte("cfa_pairs", ("interactions_graded",), "SELECT user_id, item_id, avg(rating) AS rating FROM interactions_graded GROUP BY 1, 2")
cte("cfa_bi", ("cfa_pairs",), """
SELECT item_id, sum(rating - (SELECT avg(rating) FROM cfa_pairs)) / (10.0 + count(*)) AS b_item FROM cfa_pairs GROUP BY 1""")
cte("cfa_bu", ("cfa_pairs", "cfa_bi"), """
SELECT p.user_id, sum(p.rating - (SELECT avg(rating) FROM cfa_pairs) - i.b_item) / (15.0 + count(*)) AS b_user
FROM cfa_pairs p JOIN cfa_bi i USING (item_id) GROUP BY 1""")
cte("cfa_top", ("cfa_pairs", "cfa_bi", "cfa_bu"), """
SELECT * FROM (
  SELECT user_id, item_id, est, CAST(row_number() OVER (PARTITION BY user_id ORDER BY est DESC, item_id) AS INTEGER) AS rank FROM (
    SELECT u.user_id, i.item_id, least(greatest((SELECT round(avg(rating), 6) FROM cfa_pairs) + round(u.b_user, 6) + round(i.b_item, 6), 0.0), 1.0) AS est
    FROM cfa_bu u, cfa_bi i WHERE NOT EXISTS (SELECT 1 FROM cfa_pairs p WHERE p.user_id = u.user_id AND p.item_id = i.item_id)) x) y
WHERE rank <= 10""")
