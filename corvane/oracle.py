"""SQL (DuckDB) for the queries that SQL can express, written from the operators' definitions."""

from __future__ import annotations

from .operators.keywords import STOP_WORDS
from .functions.urls import ASSET, CRAWL_EXCLUDES, INDEX_EXCLUDES

_NETLOC = "regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)"
_PATH = "regexp_extract({u}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_ORIGIN = "lower(regexp_extract({u}, '^([^:/?#]+)://', 1)) || '://' || " + _NETLOC
_NORMALISE = r"regexp_replace(regexp_replace(split_part({u}, '#', 1), '^\s+|\s+$', '', 'g'), '/+$', '')"
_GIT_HOST = r"regexp_full_match(lower(" + _NETLOC + r"), '(?:github\.com|gitlab\.com|git\.[^.]+\.(?:com|edu|org|io)|(?:[^.]+\.)?github\.io)')"
_ANY = lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, 'https://github.com/org/repo/blob/main/docs/doc-' || doc_id || '.txt' AS u, 'Doc ' || doc_id AS t FROM documents)"
# Each takes a table d of (doc_id, text, u, t).
_PARENTS_OF = r"""
s AS (SELECT doc_id, u, t, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM d),
r(doc_id, u, t, n, piece, rest) AS (
  SELECT doc_id, u, t, -1, NULL::VARCHAR, x FROM s WHERE length(x) >= 60
  UNION ALL
  SELECT doc_id, u, t, n + 1, left(rest, cut), regexp_replace(substr(rest, cut + 1), '^\s+|\s+$', '', 'g')
  FROM (SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest) WHEN strpos(w, chr(10)) = 0 OR 1200 - strpos(reverse(w), chr(10)) < 60 THEN 1200 ELSE 1200 - strpos(reverse(w), chr(10)) END AS cut
        FROM (SELECT *, left(rest, 1200) AS w FROM r WHERE rest <> ''))),
p AS (SELECT doc_id, n::BIGINT AS pid, t, piece AS x, u FROM r WHERE n >= 0)"""
_CHILDREN_OF = (
    _PARENTS_OF
    + r""",
w AS (SELECT doc_id, pid, t, x, u, length(x) AS n, unnest(range(0, length(x), 297)) AS s FROM p),
v AS (SELECT *, substr(x, s + 1, 350) AS y FROM w WHERE s = 0 OR s - 297 + 350 < n),
z AS (SELECT doc_id, pid, t, u, s, n, x, CASE WHEN n <= 350 THEN x ELSE regexp_replace(CASE WHEN s + 350 < n AND strpos(y, chr(10)) > 0 AND 350 - strpos(reverse(y), chr(10)) > 0 THEN left(y, 350 - strpos(reverse(y), chr(10))) ELSE y END, '^\s+|\s+$', '', 'g') END AS c FROM v),
k AS (SELECT doc_id, pid, t, u, s, c FROM z WHERE n <= 350 OR length(c) >= 60
  UNION ALL SELECT DISTINCT doc_id, pid, t, u, 0, x FROM z WHERE n > 350 AND (doc_id, pid) NOT IN (SELECT (doc_id, pid) FROM z WHERE length(c) >= 60)),
c AS (SELECT doc_id, pid, row_number() OVER (PARTITION BY doc_id, pid ORDER BY s) - 1 AS ordinal, t, u, c AS x FROM k)"""
)
_PARENTS, _CHILDREN = f"{_DOCS},{_PARENTS_OF}", f"{_DOCS},{_CHILDREN_OF}"
_TITLE = r"""regexp_replace(trim(replace(replace(replace(replace(regexp_extract({html}, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '\s*[|]\s*.+$', '')"""
# The text of a page's article, one line for each string of it: the test pages have no other elements there than h1, p, b and br.
_ARTICLE = r"""array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>'),
  lambda y: regexp_replace(regexp_replace(replace(replace(replace(y, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')), lambda y: y <> ''), chr(10))"""
_PAGES = f"d AS (SELECT page_id AS doc_id, {_ARTICLE} AS text, url AS u, {_TITLE.replace('{html}', 'html')} AS t FROM pages)"
# Pages of the site in the order of the walk; links to what the site doesn't have give nothing, so they are left out.
_SITE = f"""e AS (SELECT count(*) AS n FROM pages), g AS (SELECT page_id AS i, list_filter([page_id * 2 + 1, page_id * 3 + 1], lambda x: x < n) AS o FROM pages, e),
q(h, seen) AS (SELECT 0::BIGINT, [1::BIGINT] UNION ALL SELECT h + 1, list_concat(seen, list_filter(g.o, lambda x: NOT list_contains(seen, x))) FROM q JOIN g ON g.i = seen[h + 1] WHERE h < len(seen)),
o AS (SELECT unnest(seen) AS page_id, unnest(range(0, len(seen))) AS doc_id FROM (SELECT seen FROM q ORDER BY h DESC LIMIT 1)),
d AS (SELECT o.doc_id, {_ARTICLE} AS text, 'https://docs.example.org/p/' || page_id AS u, {_TITLE.replace('{html}', 'html')} AS t FROM o JOIN pages USING (page_id)),{_CHILDREN_OF},
m AS (SELECT *, row_number() OVER (ORDER BY doc_id, pid) - 1 AS parent, length(x) AS parent_chars FROM p),
b AS (SELECT row_number() OVER (ORDER BY c.doc_id, c.pid, c.ordinal) - 1 AS doc, m.parent AS pid, c.t, c.u, c.x, length(c.x) AS chars, m.parent_chars FROM c JOIN m ON m.doc_id = c.doc_id AND m.pid = c.pid)"""
# The three versions of a site: vv(version, page_id, html); then pages, parents and children of a version.
_VERSIONS = """vv AS (SELECT 0 AS version, page_id, html FROM pages WHERE page_id % 5 <> 4
  UNION ALL SELECT 1, page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '</article>', '<p>This page was revised once, and that is all that happened to it.</p></article>') ELSE html END FROM pages WHERE page_id % 7 <> 1
  UNION ALL SELECT 2, page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '</article>', '<p>This page was revised again, now for good, in the third version.</p></article>') WHEN page_id % 4 = 1 THEN replace(html, '</article>', '<p>Another remark.</p></article>') ELSE html END FROM pages WHERE page_id % 11 <> 2)"""
_VERSION_PAGES = f"d AS (SELECT version * 1000000000 + page_id AS doc_id, {_ARTICLE} AS text, 'https://docs.example.org/p/' || page_id AS u, {_TITLE.replace('{html}', 'html')} AS t FROM vv WHERE {{which}}),{_CHILDREN_OF}"
_TERMS = "d AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}') AS terms FROM documents)"
_TF = _TERMS + ", tf AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY term, doc)"
_VECS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_EDGES = _VECS + ", e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) > 0.3)"
_GREEDY = (
    _EDGES
    + """,
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM v), n AS (SELECT o.i, o.vec_id, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS lower FROM o LEFT JOIN e ON e.b = o.vec_id GROUP BY o.i, o.vec_id),
g(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT n.i, CASE WHEN list_has_any(g.kept, n.lower) THEN g.kept ELSE list_append(g.kept, n.vec_id) END FROM g JOIN n ON n.i = g.i + 1),
k AS (SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))"""
)
_BEST = _VECS + ", b AS (SELECT a.vec_id, max(list_dot_product(a.e, b.e)) AS m FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"
_SCRIPT = """p AS (SELECT page_id, page_id || '|' || url AS url, html, page_id % 8 AS m FROM pages),
h AS (SELECT url, CASE WHEN m <> 4 THEN 'W/"' || page_id || '"' END AS etag, CASE WHEN m = 4 THEN 'Mon, 05 Jan 2026 10:00:00 GMT' END AS last_modified, 1000.0::DOUBLE AS fetched_at, sha256(html) AS sha FROM p WHERE m IN (1, 2, 3, 4, 5)),
f AS (SELECT p.url, p.m, m IN (1, 2, 3, 4, 5) AS conditional, CASE WHEN m IN (0, 2, 4, 6) THEN 'stored' WHEN m = 1 THEN 'not_modified' WHEN m IN (3, 5) THEN 'failed' ELSE 'mismatch' END AS outcome,
  CASE WHEN m IN (0, 4, 6) THEN html || '!' WHEN m = 2 THEN html || '?' WHEN m = 1 THEN html END AS body, CASE WHEN m = 0 THEN '"new"' WHEN m = 2 THEN '"again"' WHEN m IN (4, 6) THEN NULL ELSE h.etag END AS etag,
  CASE WHEN m IN (0, 2, 4, 6) THEN NULL ELSE h.last_modified END AS last_modified, CASE WHEN m IN (0, 1, 2, 4, 6) THEN 2000.0::DOUBLE ELSE h.fetched_at END AS fetched_at, CASE WHEN m IN (0, 4, 6) THEN sha256(html || '!') WHEN m = 2 THEN sha256(html || '?') ELSE h.sha END AS sha256
  FROM p LEFT JOIN h ON p.url = h.url)"""
_WALK = """c AS (SELECT count(*) AS n FROM pages),
l AS (SELECT page_id AS i, [(page_id * 2 + 1) % n, (page_id * 7 + 3) % n, (page_id * 3 + 2) % n] AS o FROM pages, c),
q(h, seen) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL
  SELECT h + 1, list_concat(seen, list_filter([l.o[1], CASE WHEN l.o[2] <> l.o[1] THEN l.o[2] END, CASE WHEN l.o[3] <> l.o[1] AND l.o[3] <> l.o[2] THEN l.o[3] END], lambda x: x IS NOT NULL AND NOT list_contains(seen, x))) FROM q JOIN l ON l.i = seen[h + 1] WHERE h < len(seen)),
w AS (SELECT seen FROM q ORDER BY h DESC LIMIT 1)"""
_QV = _VECS + ", q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0)"


def _fmt(sql: str, u: str = "url") -> str:
    return sql.replace("{u}", u)


_LINKS = (
    r"""r AS (SELECT page_id, url, unnest(range(0, len(a))) AS place, unnest(a) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)),
j AS (SELECT page_id, url, place, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h WHEN starts_with(h, '//') THEN split_part(url, ':', 1) || ':' || h WHEN starts_with(h, '/') THEN """
    + _fmt(_ORIGIN)
    + r""" || h WHEN starts_with(h, '#') OR h = '' THEN url ELSE regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') || h END AS link FROM (SELECT *, replace(replace(replace(replace(href, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM r)),
k AS (SELECT page_id, url, place::BIGINT AS place, """
    + _fmt(_NORMALISE, "link")
    + " AS link FROM j)"
)

_BM25_SEARCH = f"""WITH {_TF}, n AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM d), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM benchmark),
s AS (SELECT query_id, tf.doc, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * (0.5 + tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.terms) / n.a)))), 6) AS score FROM q JOIN f USING (term) JOIN tf USING (term) JOIN d ON d.doc = tf.doc, n GROUP BY query_id, tf.doc)
SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10"""

ORACLE = {
    "url_parts": f"SELECT page_id, {_fmt(_NORMALISE)} AS normalised, {_fmt(_ORIGIN)} AS origin, lower({_fmt(_NETLOC)}) AS host, {_fmt(_PATH)} AS path, CASE WHEN {_fmt(_GIT_HOST)} THEN 'code' WHEN contains(lower(url), 'teamdynamix.') THEN 'kb' ELSE 'page' END AS kind, {_fmt(_GIT_HOST)} AS git_host, contains(lower(url), 'teamdynamix.') AS portal FROM pages",
    "url_scope": f"""WITH {_LINKS}, s AS (SELECT *, {_fmt(_ORIGIN)} AS o, regexp_extract(url, '/TDClient/[0-9]+/[^/]+/') AS x, regexp_matches(link, '(?i)(?:example\\.(com|org)/)') AS i, regexp_matches(link, '(?i){ASSET}') AS asset, regexp_matches(link, '{_ANY(CRAWL_EXCLUDES)}') AS e FROM k)
SELECT url, place, link, starts_with(link, o) AND NOT asset AND starts_with(link, o || x) AND NOT e AS in_scope, i AND NOT asset AND NOT e AS in_wide_scope, asset FROM s""",
    "url_filters": f"""WITH d AS (SELECT doc_id, 'https://site' || (doc_id % 7) || '.example.org' || ['/Search', '/Search/?q=1', '/issues/4', '/a.PDF', '/a.pdf/x', '/b.md?raw=1', '/tree/main', '/CategoryID=3', '/wiki/_edit', '/styles.css?v=2', '/TDClient/12/Help/KB'][(doc_id % 11 + 1)::INT] AS url FROM documents)
SELECT doc_id, url, regexp_matches(url, '(?i){ASSET}') AS asset, regexp_matches(url, '{_ANY(CRAWL_EXCLUDES)}') AS crawl_excluded, regexp_matches(url, '{_ANY(INDEX_EXCLUDES)}') AS index_excluded, {_fmt(_ORIGIN)} || regexp_extract(url, '/TDClient/[0-9]+/[^/]+/') AS auto_prefix FROM d""",
    "git_files": f"WITH {_DOCS} SELECT doc_id, true AS git_text, 'https://raw.githubusercontent.com/org/repo/main/docs/doc-' || doc_id || '.txt' AS raw_url, 'Doc ' || doc_id AS title, '.kb_cache/pages/' || sha1(u) || '.html' AS cache_path, left(sha1(u || chr(0) || 'Doc'), 16) AS stable_id FROM d",
    "page_titles": f"SELECT page_id, {_TITLE.replace('{html}', 'html')} AS title FROM pages",
    "page_links": f"WITH {_LINKS} SELECT page_id, place, link FROM k WHERE link <> ''",
    "page_sections": f"WITH {_PAGES} SELECT doc_id AS page_id, t AS title, 0::BIGINT AS place, NULL::VARCHAR AS heading, text FROM d",
    # In Markdown's HTML blocks are parted by line breaks; each is an empty part of its section's text.
    "content_branches": f"""WITH d AS (SELECT page_id, page_id % 6 AS m, {_TITLE.replace("regexp_replace(trim(", "trim(").rsplit(", '", 2)[0].replace('{html}', 'html')} AS t FROM pages),
r AS (SELECT page_id, m, t, unnest(CASE WHEN m = 3 THEN [NULL] WHEN m = 4 THEN [0::BIGINT, 1, 2] ELSE [0::BIGINT, 1, 2] END) AS place FROM d),
s AS (SELECT *, CASE WHEN m = 4 THEN 'Page ' || page_id ELSE regexp_replace(CASE WHEN m = 0 THEN t ELSE 'Article - ' || t END, '\\s*[|]\\s*.+$', '') END AS title FROM r)
SELECT page_id, title AS site_title, title, place, CASE WHEN place = 1 THEN CASE WHEN m = 4 THEN 'First' ELSE 'First ' || t END WHEN place = 2 THEN 'Second' END AS heading,
  CASE place WHEN 0 THEN CASE WHEN m = 4 THEN 'Page ' || page_id || '  Intro of page ' || page_id || '. ' ELSE 'Intro of page ' || page_id || '.' END WHEN 1 THEN CASE WHEN m = 4 THEN ' Some words. ' ELSE t || ' End.' END WHEN 2 THEN CASE WHEN m = 4 THEN ' ' ELSE '' END || 'Last words.' END AS text FROM s""",
    "facet_counts": f"""WITH {_TERMS}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM benchmark), t AS (SELECT DISTINCT doc, unnest(terms) AS term FROM d),
h AS (SELECT DISTINCT query_id, doc FROM q JOIN t USING (term)), f AS (SELECT doc_id AS doc, coalesce(lang, 'none') AS a, coalesce(lang, 'none') || '/' || coalesce(source, 'none') AS b FROM documents)
SELECT query_id, 1::BIGINT AS level, a AS value, count(*) AS hits FROM h JOIN f USING (doc) GROUP BY query_id, a UNION ALL SELECT query_id, 2::BIGINT, b, count(*) FROM h JOIN f USING (doc) GROUP BY query_id, b""",
    "cache_source": "SELECT u AS url, '\"' || page_id || '\"' AS etag, sha256(html) AS sha256, sha256(html) AS body_sha256, left(sha1(u), 2) AS shelf FROM (SELECT *, 'https://docs.example.org/p/' || page_id AS u FROM pages)",
    "cache_source_urls": "SELECT 'https://docs.example.org/p/' || page_id AS url, '\"' || page_id || '\"' AS etag, sha256(html) AS body_sha256 FROM pages WHERE page_id < 60 AND page_id % 7 = 0",
    "section_lateral": f"WITH {_PAGES} SELECT doc_id AS page_id, 0::BIGINT AS place, NULL::VARCHAR AS heading, text FROM d",
    "page_chunks": f"WITH RECURSIVE {_PAGES},{_CHILDREN_OF} SELECT doc_id AS page_id, t, u, lower({_fmt(_NETLOC, 'u')}) AS host, CASE WHEN {_fmt(_GIT_HOST, 'u')} THEN 'code' WHEN contains(lower(u), 'teamdynamix.') THEN 'kb' ELSE 'page' END AS kind, 1.0::DOUBLE AS weight, pid, ordinal, x FROM c",
    "parent_chunks": f"WITH RECURSIVE {_PARENTS} SELECT doc_id, pid AS local_pid, t, x, u, 'github.com' AS host, 'code' AS kind, 1.0::DOUBLE AS weight FROM p",
    "child_chunks": f"WITH RECURSIVE {_CHILDREN} SELECT doc_id, pid, ordinal, x FROM c",
    "chunk_positions": f"WITH RECURSIVE {_PARENTS} SELECT row_number() OVER (ORDER BY doc_id, pid) - 1 AS pid, doc_id, sha256(x) AS x_sha256 FROM p",
    "token_lists": f"WITH {_TERMS} SELECT doc, array_to_string(terms, ' ') AS terms FROM d",
    "bm25_doc_lengths": f"WITH {_TERMS} SELECT doc, len(terms)::BIGINT AS len FROM d",
    "bm25_document_frequencies": f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "bm25_postings": f"WITH {_TF} SELECT term, doc, tf FROM tf",
    "bm25_statistics": f"WITH {_TERMS} SELECT 1.2::DOUBLE AS k, 0.75::DOUBLE AS b, 0.5::DOUBLE AS d, count(*) AS docs, coalesce(avg(len(terms)), 0)::DOUBLE AS avg_doc_len FROM d",
    "bm25_child_frequencies": f"WITH RECURSIVE {_CHILDREN}, i AS (SELECT row_number() OVER () AS doc, regexp_extract_all(lower(t || ' ' || x), '[a-z0-9]{{3,}}') AS terms FROM c) SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc, unnest(terms) AS term FROM i) GROUP BY term",
    "quantised_vectors": "SELECT vec_id, unnest(range(0, len(q))) AS i, unnest(q) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even((x * 127::FLOAT)::DOUBLE, 0)))::BIGINT) AS q FROM embeddings)",
    "near_duplicate_edges": f"WITH {_EDGES} SELECT a, b FROM e",
    "greedy_near_duplicates": f"WITH RECURSIVE {_GREEDY} SELECT vec_id FROM k",
    "compacted_parents": f"WITH RECURSIVE {_GREEDY} SELECT vec_id, dense_rank() OVER (ORDER BY vec_id // 4) - 1 AS pid FROM k",
    "calibration_all": f"WITH {_BEST} SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS sample_size FROM b",
    "hash_embeddings": f"WITH RECURSIVE {_CHILDREN} SELECT doc_id, pid, ordinal, 384::BIGINT AS dims, 1.0::DOUBLE AS norm FROM c",
    "cache_revalidation": f"WITH {_SCRIPT} SELECT url, conditional, outcome, sha256(body) AS body_sha256, etag, last_modified, fetched_at, sha256 FROM f",
    "cache_after_fetch": f"WITH {_SCRIPT} SELECT url, etag, fetched_at, sha256 FROM f WHERE sha256 IS NOT NULL",
    "cache_states": f"WITH {_SCRIPT} SELECT url, etag, fetched_at, sha256 FROM f WHERE sha256 IS NOT NULL",
    "changed_pages": "SELECT page_id FROM pages WHERE page_id % 3 = 0",
    "crawl_order": f"WITH RECURSIVE {_WALK} SELECT 'p' || unnest(seen) AS url, unnest(range(0, len(seen))) AS visit_seq FROM w",
    "crawl_limited": f"WITH RECURSIVE {_WALK} SELECT 'p' || unnest(seen[1:17]) AS url, unnest(range(0, least(17, len(seen)))) AS visit_seq FROM w",
    "site_crawl": f"WITH RECURSIVE {_SITE} SELECT doc, pid, t, u, chars, parent_chars FROM b",
    "index_manifest": f"""WITH RECURSIVE {_SITE}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc) AS copy FROM b) WHERE copy = 1),
y AS (SELECT count(DISTINCT term) AS terms FROM (SELECT unnest(regexp_extract_all(lower(t || ' ' || x), '[a-z0-9]{{3,}}')) AS term FROM f))
SELECT count(*) AS chunks, count(DISTINCT u) AS sources, count(DISTINCT pid) AS parents, any_value(terms) AS terms, least(count(*), 500) AS sample_size, (SELECT t FROM d WHERE doc_id = 0) AS site FROM f, y""",
    "bm25_search": _BM25_SEARCH,
    "bm25_block_search": _BM25_SEARCH,
    "posting_blocks": f"WITH {_TF} SELECT term, count(*) AS postings, min(doc) AS first, max(doc) AS last, true AS bounded FROM tf GROUP BY term",
    "cosine_search": f"WITH {_QV} SELECT query_id, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (SELECT query_id, vec_id AS doc, round(list_dot_product(q.e, v.e), 9) AS score FROM q, v)) WHERE rank <= 10",
    "fused_search": f"""WITH {_QV}, i AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even((x * 127::FLOAT)::DOUBLE, 0)))::DOUBLE / 127) AS e FROM embeddings),
a AS (SELECT query_id, vec_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.e, v.e), 9) DESC, vec_id) AS r FROM q, v),
b AS (SELECT query_id, vec_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.e, i.e), 9) DESC, vec_id) AS r FROM q, i)
SELECT query_id, doc, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a WHERE r <= 10 UNION ALL SELECT * FROM b WHERE r <= 10) GROUP BY query_id, doc""",
    "calibrated_matches": f"WITH {_BEST}, s AS (SELECT avg(m) AS mean, stddev_pop(m) AS std FROM b) SELECT query_id, doc, z FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc, round((list_dot_product(q.e, v.e) - mean) / std, 4) AS z FROM v q, v, s WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE z > -1",
    "parent_lookup": f"WITH RECURSIVE {_CHILDREN} SELECT c.doc_id, c.pid, c.ordinal, sha256(p.x) AS parent_sha256 FROM c JOIN p ON c.doc_id = p.doc_id AND c.pid = p.pid",
    "parent_metadata": f"WITH RECURSIVE {_PARENTS} SELECT doc_id, pid AS local_pid, left(sha1(u || chr(0) || t), 16) AS id, 'github' AS source_type, 'page' AS content_type, 'org/repo/blob/main/docs' AS categories, false AS local FROM p",
    "privacy_review": r"""WITH f AS (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'ssn' END, CASE WHEN regexp_matches(text, '(?:\+1[ .-]?)?\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b') THEN 'phone' END,
  CASE WHEN regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') THEN 'email' END, CASE WHEN regexp_matches(text, '(?i)\b(?:mrn|medical record)\b\D{0,12}\d{5,}') THEN 'record_number' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:dob|date of birth|born)\b\D{0,12}\d{1,4}[/-]\d{1,2}[/-]\d{1,4}') THEN 'birth_date' END], lambda x: x IS NOT NULL) AS flags FROM documents)
SELECT doc_id, array_to_string(flags, ',') AS flags FROM f WHERE len(flags) > 0""",
    "document_keywords": rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda s: list_filter(list_transform(string_split_regex(s, '[,;:()\[\]"]+'), lambda p: regexp_extract_all(p, '{_WORD}')), lambda p: len(p) > 0)), lambda s: len(s) > 0) AS ss FROM documents),
s AS (SELECT doc_id, len(ss) AS n, unnest(range(0, len(ss))) AS si, unnest(ss) AS ps FROM d),
p AS (SELECT doc_id, n, si, unnest(range(0, len(ps))) AS pi, unnest(ps) AS ws FROM s),
w AS (SELECT doc_id, n, si, pi, unnest(range(0, len(ws))) AS ti, unnest(ws) AS w FROM p),
k AS (SELECT *, lower(w) AS term, lag(lower(w)) OVER o AS l, lead(lower(w)) OVER o AS r, length(w) > 2 AND NOT lower(w) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}) AND regexp_matches(w, '[^0-9]') AS ok,
  length(w) > 1 AND w = upper(w) AND w <> lower(w) AS acronym, left(w, 1) <> lower(left(w, 1)) AND (pi > 0 OR ti > 0) AS capital FROM w WINDOW o AS (PARTITION BY doc_id, si, pi ORDER BY ti)),
t AS (SELECT doc_id, n, term, count(*) AS tf, greatest(count(*) FILTER (capital AND NOT acronym), count(*) FILTER (acronym)) AS c, count(DISTINCT si) AS sf, median(si) AS med,
  coalesce(count(DISTINCT l) / nullif(count(l), 0), 0) + coalesce(count(DISTINCT r) / nullif(count(r), 0), 0) AS apart FROM k WHERE ok GROUP BY doc_id, n, term),
f AS (SELECT doc_id, term, c / (1 + ln(tf)) AS c, tf / (avg(tf) OVER o + stddev_pop(tf) OVER o) AS f, 1 + apart * tf / max(tf) OVER o AS r, ln(ln(3 + med)) AS m, sf / n AS d FROM t WINDOW o AS (PARTITION BY doc_id)),
v AS (SELECT doc_id, term, m * r / (c + f / r + d / r) AS s FROM f),
x AS (SELECT k.doc_id, si, pi, ti, k.term, ok, v.s FROM k LEFT JOIN v ON k.doc_id = v.doc_id AND k.term = v.term),
g AS (SELECT doc_id, ok AS o1, term AS t1, s AS s1, lead(ok) OVER o AS o2, lead(term) OVER o AS t2, lead(s) OVER o AS s2, lead(ok, 2) OVER o AS o3, lead(term, 2) OVER o AS t3, lead(s, 2) OVER o AS s3 FROM x WINDOW o AS (PARTITION BY doc_id, si, pi ORDER BY ti)),
c AS (SELECT doc_id, t1 AS keyword, s1 AS product, s1 AS total FROM g WHERE o1 UNION ALL SELECT doc_id, t1 || ' ' || t2, s1 * s2, s1 + s2 FROM g WHERE o1 AND o2 UNION ALL SELECT doc_id, t1 || ' ' || t2 || ' ' || t3, s1 * s2 * s3, s1 + s2 + s3 FROM g WHERE o1 AND o2 AND o3),
q AS (SELECT doc_id, keyword, round(any_value(product) / (count(*) * (1 + any_value(total))), 9) AS score, CASE WHEN length(keyword) < 2 THEN [keyword] ELSE list_distinct(list_transform(range(1, length(keyword)), lambda i: substr(keyword, i, 2))) END AS b FROM c GROUP BY doc_id, keyword),
l AS (SELECT doc_id, list([{{'s': score, 'k': keyword, 'b': b}}] ORDER BY score, keyword) AS l FROM q GROUP BY doc_id),
h AS (SELECT doc_id, list_reduce(l, lambda a, y: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda z: 200 * len(list_intersect(z.b, y[1].b)) >= 80 * (len(z.b) + len(y[1].b)))) > 0 THEN a ELSE list_concat(a, y) END) AS h FROM l)
SELECT doc_id, unnest(range(1, len(h) + 1)) AS rank, unnest(list_transform(h, lambda y: y.k)) AS keyword, unnest(list_transform(h, lambda y: y.s)) AS score FROM h""",
    "delta_index": f"""WITH RECURSIVE {_VERSIONS}, {_VERSION_PAGES.replace('{which}', 'version = 2')},
m AS (SELECT doc_id, pid, row_number() OVER (ORDER BY doc_id, pid) - 1 AS parent FROM p)
SELECT row_number() OVER (ORDER BY c.doc_id, c.pid, c.ordinal) - 1 AS doc, m.parent AS pid, c.u, sha256(c.x) AS x_sha256, 384::BIGINT AS dims FROM c JOIN m ON m.doc_id = c.doc_id AND m.pid = c.pid""",
    "delta_terms": f"""WITH RECURSIVE {_VERSIONS}, {_VERSION_PAGES.replace('{which}', 'version = 2')},
i AS (SELECT row_number() OVER () AS doc, regexp_extract_all(lower(t || ' ' || x), '[a-z0-9]{{3,}}') AS terms FROM c) SELECT term, count(DISTINCT doc) AS df FROM (SELECT doc, unnest(terms) AS term FROM i) GROUP BY term""",
    "delta_history": f"""WITH RECURSIVE {_VERSIONS}, {_VERSION_PAGES.replace('{which}', 'true')},
f AS (SELECT a.version, a.page_id FROM vv a LEFT JOIN vv b ON b.version = a.version - 1 AND b.page_id = a.page_id WHERE b.html IS DISTINCT FROM a.html),
g AS (SELECT b.version + 1 AS version, count(*) AS dead FROM vv b LEFT JOIN vv a ON b.version = a.version - 1 AND b.page_id = a.page_id WHERE b.version < 2 AND b.html IS DISTINCT FROM a.html GROUP BY b.version),
kk AS (SELECT f.version, CASE WHEN t = '' THEN x ELSE t || chr(10) || x END AS y FROM c JOIN f ON c.doc_id = f.version * 1000000000 + f.page_id),
e AS (SELECT version, count(*) AS embedded FROM (SELECT y, min(version) AS version FROM kk GROUP BY y) GROUP BY version)
SELECT n.version::INT AS segment_id, n.pages, coalesce(g.dead, 0) AS dead, coalesce(q.chunks, 0) AS chunks, coalesce(e.embedded, 0) AS embedded FROM (SELECT version, count(*) AS pages FROM f GROUP BY version) n
LEFT JOIN g ON g.version = n.version LEFT JOIN (SELECT version, count(*) AS chunks FROM kk GROUP BY version) q ON q.version = n.version LEFT JOIN e ON e.version = n.version""",
    "caption_texts": "SELECT 'https://video.example.org/' || conv_id || '.txt' AS url, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS body_sha256 FROM conversations GROUP BY conv_id",
}
