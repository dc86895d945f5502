"""The same queries as DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from .functions.urls import BINARY, JUNK
from .queries import SCOPES, SEEDS, VECTORS

_P = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _norm(src: str, query: bool = True) -> str:
    """A table expression: ``src`` (with a column u) and its canonical form n."""
    q = f"list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN {_in(JUNK)}))" if query else "[]::VARCHAR[]"
    return f"""(SELECT * EXCLUDE (s, sch, a, pth, q, h, port, qs), CASE WHEN coalesce(sch, '') NOT IN ('http', 'https') OR h = '' THEN '' ELSE
  sch || '://' || h || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || regexp_replace(CASE WHEN pth = '' THEN '/' ELSE pth END, '/+', '/', 'g') || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END END AS n
FROM (SELECT *, lower(regexp_replace(regexp_replace(a, '^.*@', ''), ':[0-9]*$', '')) AS h, regexp_extract(a, ':([0-9]*)$', 1) AS port, {q} AS qs
FROM (SELECT *, lower(regexp_extract(s, '{_P}', 1)) AS sch, regexp_extract(s, '{_P}', 3) AS a, regexp_extract(s, '{_P}', 4) AS pth, regexp_extract(s, '{_P}', 6) AS q
FROM (SELECT *, trim(u) AS s FROM {src}))))"""


def _host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({u}, '{_P}', 3), '^.*@', ''), ':[0-9]*$', ''))"


def _domain(h: str) -> str:
    p = f"string_split({h}, '.')"
    return f"CASE WHEN len({p}) <= 2 OR regexp_matches({h}, '^[0-9.]+$') THEN {h} WHEN {p}[-2] IN ('co', 'com', 'org', 'net', 'gov', 'edu', 'ac') AND length({p}[-1]) <= 3 THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"


def _plain(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


_BINARY = f"lower(regexp_extract(regexp_extract({{u}}, '{_P}', 4), '(\\.[^./]*)$', 1)) IN {_in(BINARY)}"
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_ROOT = "regexp_extract({u}, '^[^:]*://[^/?#]*')"


def _hrefs(table: str) -> str:
    """page_id, url and the references h of a table's anchors that may be followed."""
    value = _plain(r"""trim(regexp_extract(tag, '(?is)href\s*=\s*"([^"]*)"', 1))""")
    return rf"""SELECT page_id, url, {value} AS h FROM (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '{_UNSEEN}', ' ', 'g'), '(?is)<a\s[^>]*>')) AS tag FROM {table}) WHERE NOT contains(tag, 'rel="nofollow"')"""


def _links(table: str, base: str) -> str:
    """CTEs pg (page_id, src) and links (page_id, src, url) of a table (page_id, url, html). base: the page's base address by its url."""
    root = _ROOT.format(u="url")
    folder = "regexp_replace(b, '[^/]*$', '')"
    return f"""pg AS (SELECT page_id, n AS src FROM {_norm(f"(SELECT page_id, url AS u FROM {table})")}),
raw AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z]+:') THEN h WHEN h LIKE '/%' THEN {root} || h ELSE {folder} || h END AS u FROM (SELECT *, {base} AS b FROM ({_hrefs(table)})) WHERE h <> '' AND h NOT LIKE '#%'),
links AS (SELECT DISTINCT page_id, src, n AS url FROM {_norm("raw")} JOIN pg USING (page_id) WHERE n <> '')
"""


LINKS = "WITH " + _links("pages", "regexp_replace(url, '[?#].*$', '')")
#: The page table as a web.
_WEB = f"""WITH p0 AS (SELECT page_id, n AS url, html FROM {_norm("(SELECT page_id, url AS u, html FROM pages)")}),
kids AS (SELECT page_id // 8 AS page_id, string_agg('<a href="' || url || '">x</a>', '' ORDER BY page_id) AS a FROM p0 GROUP BY 1),
web AS (SELECT page_id, url, replace(html, '</head>', CASE WHEN page_id % 3 = 1 THEN '<base href="/b/">' ELSE '' END || CASE WHEN page_id % 11 = 5 THEN '<META name="Robots" content="NOINDEX, NoFollow">' ELSE '' END
  || CASE WHEN page_id % 4 = 2 THEN '<link rel="canonical" href="HTTP://E.com:80/c/' || page_id || '?utm_source=1">' ELSE '' END || '<meta name="description" content="  about ' || page_id || ' "></head>')
  || coalesce(a, '') || '<a href="k' || page_id || '">k</a><a rel="nofollow" href="/never">n</a>' AS html FROM p0 LEFT JOIN kids USING (page_id)),
""" + _links("web", f"CASE WHEN page_id % 3 = 1 THEN {_ROOT.format(u='url')} || '/b/' ELSE regexp_replace(url, '[?#].*$', '') END")
_TEXT = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>|<canvas\b.*?</canvas\s*>|<iframe\b.*?</iframe\s*>', ' ', 'g')"""
_TEXT = f"regexp_replace({_TEXT}, '(?is)^.*?<body\\b[^>]*>|^.*?</head\\s*>', '')"
_TEXT = "regexp_replace(" + _plain(f"regexp_replace({_TEXT}, '(?s)<[^>]*>', ' ', 'g')") + r", '[ \t\r\n\f]+', ' ', 'g')"
_TEXT = f"trim({_TEXT}, ' ')"
_TITLE = f"""substr({_plain(r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')")}, 1, 512)"""


def _verdict(mode: str) -> str:
    hosts = [s.split("/")[2] for s in SEEDS]
    test = {"site": f"{_domain('h')} IN ('example.net', 'example.com')", "host": f"h IN {_in(hosts)}", "path": " OR ".join(f"starts_with(url, '{s[: s.rfind('/')]}')" for s in SEEDS), "any": "true"}[mode]
    return f"CASE WHEN {_BINARY.format(u='url')} THEN 'binary' WHEN h = '' THEN 'host' WHEN contains(url, '/the') THEN 'deny_pattern' WHEN h = 'thther.example.org' OR ends_with(h, '.thther.example.org') THEN 'in' WHEN NOT ({test}) THEN 'mode' ELSE 'in' END"


assert SCOPES["host"].deny_patterns == ("/the",)
_LOG = """WITH log AS (SELECT 'h' || user_id AS host, event_id AS seq, epoch_us(ts) / 1e6 AS ts, event_type <> 'error' AS ok, value AS elapsed, length(props) AS chars, event_type AS kind,
  CASE WHEN event_type = 'error' THEN [404, 429, 500, 503][event_id % 4 + 1] ELSE 200 END AS code,
  CASE WHEN event_type = 'error' THEN ['Navigation timeout of 30 s', 'net::ERR_NAME', 'Connection refused', 'something else', 'useragent', 'took longer than', 'socket hang up', 'it was closed', 'net::x', 'ECONNREFUSED'][event_id % 10 + 1] END AS message FROM events)
"""
_KIND = "CASE WHEN seq % 10 = 0 THEN 'timeout' WHEN seq % 10 IN (1, 2, 9) THEN 'network_error' ELSE 'backend_error' END"
_LOCAL = "CASE WHEN seq % 10 IN (0, 4, 5) THEN 'timeout' WHEN seq % 10 IN (1, 2, 7) THEN 'network_error' ELSE 'backend_error' END"
_PCT = ", ".join(f"xs[least(len(xs) - 1, floor({p} * len(xs)))::INT + 1] AS p{round(100 * p)}" for p in (0.5, 0.9, 0.99))
_QUEUE = f"WITH q AS (SELECT seq, n AS url, {_host('n')} AS host, seq % 7 = 0 AS is_retry FROM {_norm('(SELECT page_id AS seq, url AS u FROM pages)')})\n"
_ROUTED = f"""WITH p AS (SELECT url, {_host('url')} AS h, {_TEXT} AS t, {_TITLE} AS tt, length(html) AS nh FROM pages),
j AS (SELECT *, CASE WHEN length(t) < 2500 THEN 'thin-text' WHEN length(t) / nh < 0.03 THEN 'low-text-ratio' ELSE 'ok' END AS why, CASE WHEN length(h) % 2 = 0 THEN CASE WHEN nh % 2 = 1 THEN tt ELSE t || ' more' END END AS rt FROM p),
o AS (SELECT url, h, why, t, rt, CASE WHEN why = 'ok' THEN 'sufficient' WHEN rt IS NULL THEN 'escalation_failed' WHEN length(rt) < length(t) THEN 'rendered_not_better' ELSE 'escalated' END AS outcome FROM j)
"""
_REQ = _LOG.rstrip() + """, req AS (SELECT seq, ['document', 'image', 'script', 'font', ''][seq % 5 + 1] AS kind, seq % 6 = 0 AS prefetch, seq % 4 <> 0 AS outside,
  CASE WHEN seq % 9 = 0 THEN -1 ELSE chars END AS size, CASE WHEN seq % 2 = 0 THEN seq % 3 = 0 END AS cached FROM log)
"""
_TRACE = _REQ.rstrip() + """, tr AS (SELECT seq AS request_id, host, kind AS rkind, req.prefetch, outside,
  CASE WHEN length(host) = 2 OR lkind IN ('view', 'signup') THEN 0 ELSE chars END AS size, CASE WHEN lkind <> 'signup' THEN lelapsed > 20 OR lelapsed < 1 OR lkind = 'click' END AS from_cache
  FROM req JOIN (SELECT seq, host, kind AS lkind, elapsed AS lelapsed, chars FROM log) USING (seq)),
ty AS (SELECT CASE WHEN rkind = '' THEN 'other' ELSE rkind END AS name, count(*) AS n, sum(size) AS b FROM tr GROUP BY 1),
bl AS (SELECT reason AS name, count(*) AS n FROM (SELECT CASE WHEN prefetch THEN 'prefetch' WHEN rkind IN ('image', 'font') THEN 'resource_type' WHEN NOT outside THEN 'host' END AS reason FROM tr) WHERE reason IS NOT NULL GROUP BY 1),
t1 AS (SELECT count(*) AS requests, sum(size)::BIGINT AS bytes, count(DISTINCT host) AS pages, round(count(*) / count(DISTINCT host), 1) AS per_page, count(*) FILTER (WHERE from_cache) AS from_cache, count(*) FILTER (WHERE NOT from_cache) AS from_network, round(count(*) FILTER (WHERE from_cache) / count(from_cache), 6) AS cache_hit_rate FROM tr)
"""
_SIG = _LOG.rstrip() + """, s0 AS (SELECT host, seq, ts, CASE WHEN seq % 2 = 0 THEN 'acquire' WHEN seq % 13 = 5 THEN 'crawl_delay' WHEN code IN (429, 503) THEN 'throttled' WHEN ok THEN 'success' ELSE 'error' END AS signal FROM log),
ev AS (SELECT *, CASE WHEN signal = 'crawl_delay' THEN 1.0 + seq % 4 WHEN signal = 'throttled' AND seq % 3 = 0 THEN 0.5 + seq % 7 END::DOUBLE AS arg, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS k FROM s0),
st AS (SELECT host, 0 AS k, NULL::BIGINT AS seq, ts, NULL::VARCHAR AS signal, NULL::BOOLEAN AS granted, 4.0::DOUBLE AS rate, 32.0::DOUBLE AS top, 8.0::DOUBLE AS tokens, 8.0::DOUBLE AS burst, ts AS updated, 0.0::DOUBLE AS blocked, 0 AS streak, 0 AS thr FROM ev WHERE k = 1
UNION ALL
SELECT host, k, seq, ts, signal, CASE WHEN signal = 'acquire' THEN asks AND filled >= 1 END, rate2, top2, CASE WHEN asks THEN filled - (filled >= 1)::INT WHEN signal = 'throttled' THEN 0 ELSE tokens END,
  CASE WHEN rises OR signal = 'throttled' THEN greatest(1, least(8, 2 * rate2)) WHEN signal = 'crawl_delay' THEN greatest(1, least(burst, 2 / arg)) ELSE burst END,
  CASE WHEN asks THEN greatest(ts, updated) ELSE updated END, CASE WHEN signal = 'throttled' THEN greatest(blocked, ts + coalesce(arg, least(60, 2.0 ** least(thr + 1, 6)))) ELSE blocked END,
  CASE WHEN signal = 'success' THEN CASE WHEN rises THEN 0 ELSE streak + 1 END WHEN signal IN ('throttled', 'error') THEN 0 ELSE streak END, thr + (signal = 'throttled')::INT
FROM (SELECT *, CASE WHEN rises THEN least(top, rate + 0.5) WHEN signal = 'throttled' THEN greatest(least(0.2, top), rate * 0.5) WHEN signal = 'error' THEN greatest(least(0.2, top), 0.9 * rate) WHEN signal = 'crawl_delay' THEN least(rate, top2) ELSE rate END AS rate2
FROM (SELECT ev.host, ev.k, ev.seq, ev.ts, ev.signal, ev.arg, rate, top, tokens, burst, updated, blocked, streak, thr, ev.signal = 'acquire' AND ev.ts >= blocked AS asks, ev.signal = 'success' AND streak + 1 >= 10 AND rate < top AS rises,
  CASE WHEN ev.signal = 'crawl_delay' THEN least(top, 1 / ev.arg) ELSE top END AS top2, least(burst, tokens + greatest(0, ev.ts - updated) * rate) AS filled FROM st JOIN ev ON ev.host = st.host AND ev.k = st.k + 1))),
res AS (SELECT *, CASE WHEN ts < blocked THEN blocked WHEN least(burst, tokens + greatest(0, ts - updated) * rate) >= 1 THEN ts ELSE ts + (1 - least(burst, tokens + greatest(0, ts - updated) * rate)) / rate END AS ready_at FROM st WHERE k > 0)
"""
_SIG = _SIG.replace("WITH log", "WITH RECURSIVE log", 1)
_LIMITER = _SIG + "SELECT host, seq, signal, granted, round(rate, 6) AS rate, round(tokens, 6) AS tokens, round(blocked, 6) AS blocked_until, round(ready_at, 6) AS ready_at FROM res"
_BATCHES = """WITH p AS (SELECT page_id AS rid, page_id // 16 AS batch, url, length(url) % 5 AS kind FROM pages),
sure AS (SELECT rid, batch, kind FROM p WHERE kind IN (0, 1, 3)),
lost AS (SELECT rid, batch, row_number() OVER (PARTITION BY batch ORDER BY rid) AS nth FROM p WHERE kind IN (2, 4)),
spare AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY rid) AS nth FROM p WHERE kind = 2),
r AS (SELECT rid, kind FROM sure UNION ALL SELECT rid, CASE WHEN spare.nth IS NULL THEN 9 ELSE 2 END FROM lost LEFT JOIN spare USING (batch, nth))
"""
_GRAPH = """WITH RECURSIVE site AS (SELECT 'http://site.test/page/' || n AS url, n FROM range(12) t(n) UNION ALL SELECT 'http://site.test/', 0),
e AS (SELECT url AS src, 'http://site.test/page/' || k AS dst FROM site, range(12) t(k) WHERE k IN (2 * n, 2 * n + 1)),
walk AS (SELECT 'http://site.test/' AS url, 0 AS depth, NULL::VARCHAR AS parent UNION ALL SELECT dst, depth + 1, src FROM walk JOIN e ON src = url WHERE depth < 4),
best AS (SELECT url, min(depth) AS depth, (min({'d': depth, 'p': parent})).p AS parent FROM walk GROUP BY url)
"""
_ROBOTS = f"""WITH rp AS (SELECT page_id, n AS url, regexp_extract(n, '^[^:]+://[^/]*') AS origin, regexp_replace(n, '^[^:]+://[^/]*', '') AS path FROM {_norm('(SELECT page_id, url AS u FROM pages)')}),
rb AS (SELECT page_id, url, CASE length(origin) % 5 WHEN 0 THEN false WHEN 1 THEN true ELSE CASE WHEN starts_with(path, '/en/2') THEN true WHEN starts_with(path, '/en/') OR ends_with(path, '9') THEN false ELSE true END END AS allowed,
  CASE WHEN length(origin) % 5 > 1 THEN 2.0::DOUBLE END AS crawl_delay FROM rp)
"""
_VALUES = ", ".join(f"('{v}')" for v in VECTORS)

ORACLES = {
    "q_link_frontier": LINKS + f"SELECT {_host('url')} AS host, count(DISTINCT url) AS n_new FROM links WHERE {_host('url')} = {_host('src')} AND url NOT IN (SELECT src FROM pg) GROUP BY 1",
    "q_url_normalize": f"SELECT page_id, n AS norm FROM {_norm('(SELECT page_id, url AS u FROM pages)')}",
    "q_url_parts": f"SELECT page_id, h AS host, {_domain('h')} AS domain, path, {_BINARY.format(u='url')} AS is_binary, regexp_matches(url, '^(?i:https?)://') AS crawlable FROM (SELECT page_id, url, {_host('url')} AS h, regexp_extract(url, '{_P}', 4) AS path FROM pages)",
    "q_url_vectors": f"WITH v(u) AS (VALUES {_VALUES}), b AS {_norm('v', False)} SELECT a.u AS raw, a.n AS norm, b.n AS bare FROM {_norm('v')} a JOIN b ON a.u = b.u",
    "q_scope_reasons": LINKS + f"SELECT {_verdict('host')} AS verdict, count(*) AS n FROM (SELECT url, {_host('url')} AS h FROM links) GROUP BY 1",
    **{f"q_scope_{m}": LINKS + f"SELECT url, {_verdict(m)} AS verdict FROM (SELECT DISTINCT url, {_host('url')} AS h FROM links)" for m in SCOPES},
    "q_links": LINKS + "SELECT page_id, url FROM links",
    "q_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "q_text": f"SELECT page_id, {_TEXT} AS text FROM pages",
    **{k: _WEB + f"""SELECT page_id, {_TITLE} AS title, 'about ' || page_id AS description, page_id % 11 = 5 AS noindex, page_id % 11 = 5 AS nofollow, CASE WHEN page_id % 4 = 2 THEN 'http://e.com/c/' || page_id END AS canonical,
CASE WHEN page_id % 11 = 5 THEN 0 ELSE (SELECT count(*) FROM links l WHERE l.page_id = web.page_id) END AS n_links FROM web""" for k in ("q_page_facts", "q_page_parser")},
    "q_crawl_pages": "WITH RECURSIVE" + _WEB[4:] + f""", one AS (SELECT * FROM web QUALIFY row_number() OVER (PARTITION BY url ORDER BY html) = 1),
e AS (SELECT src, url AS dst FROM links WHERE page_id IN (SELECT page_id FROM one) AND page_id % 11 <> 5 AND NOT ({_BINARY.format(u='url')}) AND {_host('url')} <> ''),
walk AS (SELECT src AS url, 0 AS depth FROM pg WHERE page_id BETWEEN 1 AND 7 UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = walk.url WHERE depth < 5),
best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url),
par AS (SELECT b.url, min(e.src) AS parent FROM best b JOIN e ON e.dst = b.url JOIN best a ON a.url = e.src AND a.depth = b.depth - 1 GROUP BY b.url),
n AS (SELECT page_id, count(*) AS n FROM links WHERE page_id % 11 <> 5 GROUP BY 1)
SELECT b.url, b.url AS final_url, b.depth, parent, CASE WHEN one.url IS NULL THEN 404 ELSE 200 END AS http_status, CASE WHEN one.url IS NULL THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN one.url IS NULL THEN '' ELSE {_TITLE} END AS title,
  CASE WHEN b.depth < 5 THEN coalesce(n, 0) ELSE 0 END::INT AS n_links, CASE WHEN one.url IS NULL THEN 'HTTP 404' END AS error, CASE WHEN one.url IS NULL THEN 0.0 ELSE round(page_id / 1000, 4) END AS elapsed_s, 'corpus' AS backend
FROM best b LEFT JOIN par USING (url) LEFT JOIN one ON one.url = b.url LEFT JOIN n USING (page_id)""",
    "q_seeds": f"""WITH r AS (SELECT url AS u FROM pages UNION ALL SELECT 'https://' || regexp_replace(url, '^https://', '') FROM pages WHERE NOT contains(regexp_replace(url, '^https://', ''), '://')) SELECT DISTINCT n AS url FROM {_norm("r")} WHERE n <> ''""",
    "q_same_site": LINKS + f"SELECT page_id, url, {_domain(_host('src'))} = {_domain(_host('url'))} AS same FROM links",
    "q_scope_bare_host": LINKS + f"SELECT url, CASE WHEN {_BINARY.format(u='url')} THEN 'binary' WHEN {_host('url')} = '' THEN 'host' WHEN starts_with(url, 'https://therhe.example.org') OR starts_with(url, '{SEEDS[0][: SEEDS[0].rfind('/')]}') THEN 'in' ELSE 'mode' END AS verdict FROM (SELECT DISTINCT url FROM links)",
    "q_scope_allow": LINKS + f"SELECT url, CASE WHEN {_BINARY.format(u='url')} THEN 'binary' WHEN {_host('url')} = '' THEN 'host' WHEN {_host('url')} = 'example.net' OR ends_with({_host('url')}, '.example.net') THEN 'deny_domain' WHEN NOT (starts_with(url, 'https://therhe.example.org') OR starts_with(url, '{SEEDS[0][: SEEDS[0].rfind('/')]}')) THEN 'mode' WHEN NOT regexp_matches(url, '/t|/a[a-m]') THEN 'allow_pattern' ELSE 'in' END AS verdict FROM (SELECT DISTINCT url FROM links)",
    "q_bloom_inserts": LINKS + "SELECT count(DISTINCT url) AS known, count(DISTINCT url) AS inserts FROM links",
    "q_next_ready": _QUEUE + "SELECT min(length(host))::DOUBLE AS next_ready FROM q WHERE length(host) > 22",
    "q_attempts": _LOG + "SELECT seq, row_number() OVER (PARTITION BY host, chars ORDER BY ts, seq) - 1 AS attempt FROM log",
    "q_full_summary": _LOG.rstrip() + f""", l AS (SELECT list(elapsed ORDER BY elapsed) AS xs FROM (SELECT elapsed FROM log WHERE elapsed > 0 ORDER BY ts DESC, seq DESC LIMIT 2000))
SELECT round(max(ts) - min(ts), 2) AS elapsed_s, count(*) AS fetched, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, 0::BIGINT AS retried, 9::BIGINT AS discovered, 0::BIGINT AS enqueued, 2::BIGINT AS duplicates, 0::BIGINT AS out_of_scope, 0::BIGINT AS robots_blocked,
round(count(*) / greatest(max(ts) - min(ts), 1e-9), 2) AS pages_per_second, round(count(*) FILTER (WHERE ok) / count(*), 4) AS success_rate, round(sum(chars) / 1e6, 2) AS mb_html,
{", ".join(f"(SELECT round(xs[least(len(xs) - 1, floor({p} * len(xs)))::INT + 1], 3) FROM l) AS latency_p{round(100 * p)}_s" for p in (0.5, 0.9, 0.99))},
(SELECT string_agg(code || ':' || n, ',' ORDER BY code) FROM (SELECT code, count(*) AS n FROM log GROUP BY 1)) AS status_counts,
(SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM (SELECT 'e' || seq % 13 AS k, count(*) AS n FROM log WHERE NOT ok GROUP BY 1 ORDER BY n DESC, k LIMIT 10)) AS errors
FROM log""",
    "q_snapshot": _QUEUE.rstrip() + ", " + _LOG[5:].rstrip() + """ SELECT count(*) AS fetched, (SELECT count(*) FROM q) AS queued, (SELECT count(DISTINCT host) FROM q) AS hosts, (SELECT count(DISTINCT host) FROM q WHERE length(host) <= 1704200000) AS ready, 0::BIGINT AS deferred,
count(*) FILTER (WHERE ts <= 1704200000 AND ts + elapsed * 3600 > 1704200000) AS in_flight, (1::BIGINT << 40) - count(*) AS budget_left, 7::BIGINT AS seen, (SELECT round(round(count(*) / (max(ts) - min(ts)), 6), 2) FROM (SELECT ts FROM log ORDER BY ts DESC, seq DESC LIMIT 2000)) AS recent_pps, false AS paused_memory FROM log""",
    "q_memory_pauses": _LOG + """SELECT probe, ts, pct IS NOT NULL AND coalesce(state, false) AS paused FROM (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY probe ORDER BY ts ROWS UNBOUNDED PRECEDING) AS state
FROM (SELECT host AS probe, ts, seq, pct, CASE WHEN pct >= 60 THEN true WHEN pct < 55 THEN false END AS turn FROM (SELECT *, CASE WHEN seq % 10 > 0 THEN elapsed * 2 END AS pct FROM log)))""",
    "q_bench_rows": _LOG + "SELECT *, pps = max(pps) OVER () AS best FROM (SELECT *, round(pages / greatest(elapsed, 1e-9), 2) AS pps FROM (SELECT kind AS backend, (seq % 3)::INT AS concurrency, count(*) AS pages, round(sum(elapsed), 2) AS elapsed FROM log GROUP BY 1, 2))",
    "q_streak_raises": _LOG + "SELECT host, max(least(n, 5))::BIGINT AS best_streak, sum(n // 5)::BIGINT AS raises FROM (SELECT host, g, count(*) FILTER (WHERE ok) AS n FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, seq) AS g FROM log) GROUP BY host, g) GROUP BY host",
    "q_classify_sources": _LOG + f"SELECT DISTINCT message, {_LOCAL} AS plain, {_KIND} AS browser, CASE WHEN seq % 10 = 6 THEN 'network_error' ELSE {_KIND} END AS batch FROM log WHERE message IS NOT NULL",
    "q_headers": _LOG + "SELECT seq, 'x-a:' || kind || ',' || kind || ':v' AS headers, kind || ',z,' || kind AS links, CASE WHEN seq % 2 = 0 THEN kind ELSE 'plain' END AS text, kind AS decoded FROM log",
    "q_blocked": _REQ + "SELECT reason, count(*) AS requests FROM (SELECT CASE WHEN prefetch THEN 'prefetch' WHEN kind IN ('image', 'font') THEN 'resource_type' WHEN NOT outside THEN 'host' END AS reason FROM req) WHERE reason IS NOT NULL GROUP BY 1",
    "q_trace": _TRACE + "SELECT request_id, size, from_cache FROM tr",
    "q_trace_totals": _TRACE + "SELECT * FROM t1",
    "q_trace_report": _TRACE + """SELECT 1 AS place, printf('%d requests, %.2f MB, %d pages', requests, bytes / 1e6, pages) AS line FROM t1
UNION ALL SELECT 1000 + row_number() OVER (ORDER BY n DESC, name), printf('%s: %d requests, %.1f a page, %.2f MB', name, n, n / (SELECT pages FROM t1), b / 1e6) FROM ty
UNION ALL SELECT 2000 + row_number() OVER (ORDER BY n DESC, name), printf('blocked by %s: %d requests, %.1f a page', name, n, n / (SELECT pages FROM t1)) FROM bl
UNION ALL SELECT 3001, printf('cache: %d hits, %d from the network, %.0f%% hits', from_cache, from_network, cache_hit_rate * 100) FROM t1""",
    "q_routing_memory": _ROUTED + """, m AS (SELECT *, starts_with(h, 'm.') AS known FROM o), x AS (SELECT CASE WHEN known THEN CASE WHEN rt IS NULL THEN 'cached_failed' ELSE 'escalated' END ELSE outcome END AS outcome, known FROM m)
SELECT count(*) AS requested, count(*) FILTER (WHERE outcome = 'sufficient') AS served_plain, count(*) FILTER (WHERE outcome <> 'sufficient') AS escalated, count(*) FILTER (WHERE outcome = 'escalation_failed') AS escalation_failed, count(*) FILTER (WHERE outcome = 'rendered_not_better') AS rendered_not_better, count(*) FILTER (WHERE known) AS host_cache_hits, round(count(*) FILTER (WHERE outcome <> 'sufficient') / count(*), 3) AS escalation_rate FROM x""",
    "q_routing_snapshot": _ROUTED.rstrip() + ", " + _LOG[5:] + """SELECT count(*) AS requested, count(*) FILTER (WHERE outcome = 'sufficient') AS served_plain, count(*) FILTER (WHERE outcome <> 'sufficient') AS escalated, 0::BIGINT AS host_cache_hits,
(SELECT string_agg(why || ':' || n, ',' ORDER BY why) FROM (SELECT why, count(*) AS n FROM o WHERE outcome <> 'sufficient' GROUP BY 1)) AS reasons, (SELECT count(*) FROM (SELECT host FROM log WHERE NOT ok GROUP BY host HAVING max(ts) > 1706000000)) AS hosts_needing_render, true AS browser_started FROM o""",
    "q_limiter": _LIMITER,
    "q_limiter_stream": _LIMITER,
    "q_limiter_snapshot": _SIG + "SELECT host, round(arg_max(rate, k), 2) AS rate FROM res GROUP BY host",
    "q_host_memory": "WITH RECURSIVE" + _LOG[4:].rstrip() + """, ev AS (SELECT host, seq, ts, ok, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS k FROM log),
st AS (SELECT host, 0 AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS via, -1e18::DOUBLE AS until FROM ev WHERE k = 1
UNION ALL SELECT ev.host, ev.k, ev.seq, CASE WHEN ev.ts < until THEN 'memory' WHEN NOT ok THEN 'escalated' ELSE 'plain' END, CASE WHEN ev.ts >= until AND NOT ok THEN ev.ts + 86400 ELSE until END FROM st JOIN ev ON ev.host = st.host AND ev.k = st.k + 1)
SELECT host, seq, via FROM st WHERE k > 0""",
    "q_robots_cache": "WITH RECURSIVE" + _LOG[4:].rstrip() + """, ev AS (SELECT host, ts, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS k FROM log),
st AS (SELECT host, 1 AS k, false AS hit, ts AS read FROM ev WHERE k = 1
UNION ALL SELECT ev.host, ev.k, ev.ts - read < 604800, CASE WHEN ev.ts - read < 604800 THEN read ELSE ev.ts END FROM st JOIN ev ON ev.host = st.host AND ev.k = st.k + 1)
SELECT count(DISTINCT host) AS robots_cached, count(*) FILTER (WHERE hit) AS robots_hits, count(*) FILTER (WHERE NOT hit) AS robots_misses, count(*) FILTER (WHERE NOT hit AND host LIKE '%7') AS robots_errors FROM st""",
    "q_robots_fresh": _LOG + "SELECT host AS origin FROM log GROUP BY host HAVING 1706660000 - max(ts) < 36000",
    "q_paced": "WITH RECURSIVE" + _LOG[4:].rstrip() + """, ev AS (SELECT host, seq, ts, elapsed * 100 AS el, row_number() OVER (PARTITION BY host ORDER BY ts, seq) AS k FROM log),
st AS (SELECT host, 1 AS k, seq, ts AS b, ts + el AS e FROM ev WHERE k = 1
UNION ALL SELECT host, k, seq, b2, b2 + el FROM (SELECT ev.host, ev.k, ev.seq, el, greatest(ev.ts, e, b + 1000) AS b2 FROM st JOIN ev ON ev.host = st.host AND ev.k = st.k + 1))
SELECT seq AS ordinal, round(b, 3) AS started_ts, round(e, 3) AS finished_ts FROM st""",
    "q_admission": "WITH RECURSIVE" + _LOG[4:].rstrip() + """, ev AS (SELECT kind, seq, ts, elapsed * 100 AS el, row_number() OVER (PARTITION BY kind ORDER BY ts, seq) AS k FROM log),
st AS (SELECT kind, 0 AS k, NULL::BIGINT AS seq, NULL::DOUBLE AS b, -1e18::DOUBLE AS free FROM ev WHERE k = 1
UNION ALL SELECT kind, k, seq, CASE WHEN late THEN NULL ELSE greatest(ts, free) END, CASE WHEN late THEN free ELSE greatest(ts, free) + el END FROM (SELECT ev.kind, ev.k, ev.seq, ev.ts, el, free, free - ev.ts > 2000 AS late FROM st JOIN ev ON ev.kind = st.kind AND ev.k = st.k + 1))
SELECT seq AS ordinal, CASE WHEN b IS NULL THEN 'rejected' ELSE 'ok' END AS status, round(b, 3) AS started_ts FROM st WHERE k > 0""",
    "q_connector_batches": _BATCHES + """SELECT status, error, with_links, count(*) AS n FROM (SELECT CASE kind WHEN 9 THEN 'backend_error' WHEN 3 THEN CASE WHEN rid % 2 = 0 THEN 'http_error' ELSE 'ok' END ELSE 'ok' END AS status,
CASE kind WHEN 9 THEN 'no result returned' WHEN 3 THEN 'blocked by a guess' ELSE '' END AS error, kind IN (0, 1, 2) AS with_links FROM r) GROUP BY ALL""",
    "q_connector_keys": _LOG + "SELECT seq AS key, CASE kind WHEN 'signup' THEN 'backend_error' WHEN 'click' THEN 'timeout' ELSE CASE WHEN code >= 400 THEN 'http_error' ELSE 'ok' END END AS status, CASE kind WHEN 'signup' THEN 'no result' WHEN 'click' THEN 'Timed out' ELSE CASE WHEN code >= 400 THEN 'HTTP ' || code END END AS error FROM log",
    "q_connector_plain": _LOG + f"SELECT seq, CASE WHEN seq % 2 = 1 AND message IS NOT NULL THEN {_LOCAL} WHEN code >= 400 THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN seq % 2 = 1 AND message IS NOT NULL THEN message WHEN code >= 400 THEN 'HTTP ' || code END AS error FROM log",
    "q_capabilities": "SELECT * FROM (VALUES ('corpus', true, '-'), ('http', true, 'proxy')) t(name, available, capabilities)",
    "q_inlinks": LINKS + "SELECT url, count(DISTINCT src) AS n_pages FROM links GROUP BY url",
    "q_outlinks_by_host": LINKS + f"SELECT {_host('src')} AS host, count(*) AS n_links, count(DISTINCT url) AS n_targets FROM links GROUP BY 1",
    "q_crawl_graph": _GRAPH + "SELECT b.url, depth, parent, 'ok' AS status, 'Page ' || n AS title, CASE WHEN depth < 4 THEN (SELECT count(*) FROM e WHERE src = b.url) + 2 ELSE 0 END AS n_links FROM best b JOIN site USING (url)",
    "q_crawl_metrics": _GRAPH + """, f AS (SELECT count(*) AS pages, sum(CASE WHEN depth < 4 THEN (SELECT count(*) FROM e WHERE src = b.url) ELSE 0 END) AS inside, 2 * count(*) FILTER (WHERE depth < 4) AS out FROM best b)
SELECT unnest(['discovered', 'out_of_scope', 'duplicates', 'enqueued', 'dropped', 'robots_blocked', 'fetched', 'retried', 'rounds']) AS counter, unnest([inside + out, out, inside - (pages - 1), pages, 0, 0, pages, 0, (SELECT max(depth) + 1 FROM best)])::BIGINT AS n FROM f""",
    "q_crawl_depth1": LINKS + f""", one AS (SELECT page_id, src, html FROM pages JOIN pg USING (page_id) WHERE src <> '' QUALIFY row_number() OVER (PARTITION BY src ORDER BY html) = 1),
f AS (SELECT url, min(src) AS parent FROM links WHERE page_id IN (SELECT page_id FROM one) AND NOT ({_BINARY.format(u='url')}) AND {_host('url')} <> '' AND url NOT IN (SELECT src FROM pg) GROUP BY url),
n AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1)
SELECT src AS url, 0 AS depth, NULL::VARCHAR AS parent, 'ok' AS status, 200 AS http_status, {_TITLE} AS title, coalesce(n, 0)::INT AS n_links FROM one LEFT JOIN n USING (page_id)
UNION ALL SELECT url, 1, parent, 'http_error', 404, '', 0 FROM f""",
    "q_fetch_corpus": LINKS + "SELECT CASE WHEN src IS NULL THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN src IS NULL THEN 404 ELSE 200 END AS http_status, count(*) AS n FROM (SELECT DISTINCT url FROM links) l LEFT JOIN (SELECT src FROM pg) g ON l.url = g.src GROUP BY 1, 2",
    "q_seen_anti": LINKS + "SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT src FROM pg)",
    "q_seen_bloom": LINKS + "SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT src FROM pg)",
    "q_frontier_turns": _QUEUE + "SELECT url, host, rn, ceil(rn / 2)::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM q)",
    "q_frontier_caps": _QUEUE + "SELECT url, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY is_retry DESC, seq) AS rn FROM q) WHERE rn <= 3 ORDER BY is_retry DESC, seq LIMIT 100",
    "q_pop_batch": _QUEUE + "SELECT url, host, rn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM q WHERE length(host) % 2 = 1) ORDER BY rn, host LIMIT 64",
    "q_frontier_stats": _QUEUE + "SELECT count(*) AS queued, count(DISTINCT host) AS hosts, count(DISTINCT host) FILTER (WHERE length(host) % 2 = 1) AS ready, count(DISTINCT host) FILTER (WHERE length(host) % 2 = 0) AS deferred FROM q",
    "q_status_counts": _LOG + "SELECT code AS http_status, count(*) AS n FROM log GROUP BY 1",
    "q_summary": _LOG + "SELECT count(*) AS fetched, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, sum(chars)::BIGINT AS bytes_html, round(count(*) / greatest(max(ts) - min(ts), 1e-9), 4) AS pages_per_second, round(count(*) FILTER (WHERE ok) / count(*), 4) AS success_rate FROM log",
    "q_error_topk": _LOG + "SELECT host, count(*) AS n FROM log WHERE NOT ok GROUP BY host ORDER BY n DESC, host LIMIT 10",
    "q_latency_pct": _LOG + f"SELECT {_PCT} FROM (SELECT list(elapsed ORDER BY elapsed) AS xs FROM (SELECT elapsed FROM log WHERE elapsed > 0 ORDER BY ts DESC, seq DESC LIMIT 2000))",
    "q_host_latency": _LOG + f"SELECT host, {_PCT} FROM (SELECT host, list(elapsed ORDER BY elapsed) AS xs FROM (SELECT host, elapsed, row_number() OVER (PARTITION BY host ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE elapsed > 0) WHERE rn <= 2000 GROUP BY host)",
    "q_recent_pps": _LOG + "SELECT round(count(*) / (max(ts) - min(ts)), 6) AS recent_pps FROM (SELECT ts FROM log ORDER BY ts DESC, seq DESC LIMIT 2000)",
    "q_streaks": _LOG + "SELECT host, max(n)::BIGINT AS best_streak FROM (SELECT host, g, count(*) FILTER (WHERE ok) AS n FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, seq) AS g FROM log) GROUP BY host, g) GROUP BY host",
    "q_in_flight": _LOG + ", e AS (SELECT host, ts AS t, 1 AS d FROM log UNION ALL SELECT host, ts + elapsed * 64, -1 FROM log) SELECT host, max(o)::BIGINT AS most_open FROM (SELECT host, sum(d) OVER (PARTITION BY host ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM e) GROUP BY host",
    "q_outcome_map": _LOG + f"SELECT seq, CASE WHEN ok THEN 'ok' WHEN seq % 3 > 0 THEN CASE WHEN code >= 400 THEN 'http_error' WHEN seq % 2 = 0 THEN 'ok' ELSE {_KIND} END ELSE {_KIND} END AS outcome, CASE WHEN code < 400 THEN 'ok' ELSE 'http_error' END AS by_code, CASE WHEN code >= 400 THEN 'HTTP ' || code END AS error FROM log",
    "q_classify_error": _LOG + f"SELECT {_KIND} AS kind, count(*) AS n FROM log WHERE message IS NOT NULL GROUP BY 1",
    "q_retry_plan": _LOG + f", s AS (SELECT *, CASE WHEN ok THEN 'ok' ELSE {_KIND} END AS status FROM log) SELECT seq, status, status <> 'ok' AND seq % 5 < 2 AS again, CASE WHEN status <> 'ok' AND seq % 5 < 2 THEN 1.5 * 2 ** (seq % 5) END AS delay, CASE WHEN code IN (429, 503) THEN 'throttled' WHEN status = 'ok' THEN 'success' ELSE 'error' END AS signal FROM s",
    "q_retry_after": "SELECT event_id AS seq, CASE WHEN event_id % 3 < 2 THEN [5.0, 2.5, 0.0, NULL, NULL][event_id % 5 + 1] END::DOUBLE AS seconds, CASE WHEN event_id % 3 = 0 THEN [5.0, 2.5, 0.0, NULL, NULL][event_id % 5 + 1] END::DOUBLE AS service_seconds FROM events",
    "q_block_reason": _REQ + "SELECT seq, prefetch, CASE WHEN prefetch THEN 'prefetch' WHEN kind IN ('image', 'font') THEN 'resource_type' WHEN NOT outside THEN 'host' END AS reason FROM req",
    "q_resource_trace": _REQ + "SELECT CASE WHEN kind = '' THEN 'other' ELSE kind END AS resource_type, count(*) AS requests, sum(greatest(size, 0))::BIGINT AS bytes FROM req GROUP BY 1",
    "q_cache_rate": _REQ + "SELECT count(*) AS requests, round(count(*) FILTER (WHERE cached) / count(cached), 6) AS cache_hit_rate FROM req",
    "q_content_check": f"""SELECT page_id, why AS reason, why IN ('ok', 'not-ok') AS sufficient FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'http-403' WHEN page_id % 13 = 0 THEN 'not-ok' WHEN length(t) < 600 THEN 'thin-text:' || length(t)
  WHEN length(t) / length(html) < 0.2 THEN 'low-text-ratio:' || printf('%.3f', length(t) / length(html)) ELSE 'ok' END AS why FROM (SELECT page_id, html, {_TEXT} AS t FROM pages))""",
    "q_routing": _ROUTED + "SELECT url, CASE outcome WHEN 'escalated' THEN 'rendered' ELSE 'plain' END AS tier, CASE outcome WHEN 'escalated' THEN length(rt) ELSE length(t) END AS n_chars, outcome FROM o",
    "q_routing_stats": _ROUTED + "SELECT count(*) AS requested, count(*) FILTER (WHERE outcome = 'sufficient') AS served_plain, count(*) FILTER (WHERE outcome <> 'sufficient') AS escalated, count(*) FILTER (WHERE outcome = 'escalation_failed') AS escalation_failed, count(*) FILTER (WHERE outcome = 'rendered_not_better') AS rendered_not_better, 0::BIGINT AS host_cache_hits, round(count(*) FILTER (WHERE outcome <> 'sufficient') / count(*), 3) AS escalation_rate FROM o",
    "q_routing_reasons": _ROUTED + "SELECT why AS reason, count(*) AS n FROM o WHERE outcome <> 'sufficient' GROUP BY 1",
    "q_window_rate": _LOG + "SELECT floor(ts / 3600)::BIGINT AS hour, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM log GROUP BY 1",
    "q_robots_filter": _ROBOTS + "SELECT page_id, allowed, crawl_delay FROM rb",
    "q_crawl_robots": _ROBOTS + "SELECT DISTINCT url, 'ok' AS status, crawl_delay FROM rb WHERE allowed",
    "q_response": _ROBOTS + f""", one AS (SELECT page_id AS chosen, n AS url FROM {_norm("(SELECT page_id, url AS u, html FROM pages)")} QUALIFY row_number() OVER (PARTITION BY n ORDER BY html) = 1), """ + LINKS[5:] + """SELECT rb.page_id AS ordinal, CASE WHEN allowed THEN 'ok' ELSE 'blocked_robots' END AS status, CASE WHEN NOT allowed THEN 'denied by robots.txt' END AS error, CASE WHEN allowed THEN round(chosen / 7, 3) ELSE 0.0 END AS elapsed_s, NULL::VARCHAR AS text,
CASE WHEN allowed THEN (SELECT count(*) FROM links l WHERE l.page_id = chosen) ELSE 0 END AS n_links FROM rb JOIN one ON rb.url = one.url""",
    "q_service": f"""WITH c AS (SELECT n AS url, page_id % 19 = 0 AS bad, {_TITLE} AS t FROM {_norm('(SELECT page_id, html, url AS u FROM pages)')} QUALIFY row_number() OVER (PARTITION BY n ORDER BY html) = 1),
r AS (SELECT page_id AS ordinal, n AS final_url, page_id % 10 AS el FROM {_norm("(SELECT page_id, CASE WHEN page_id % 17 = 3 THEN 'mailto:x' ELSE url END AS u FROM pages)")}),
s AS (SELECT ordinal, final_url, t, CASE WHEN final_url = '' THEN 'skipped' WHEN el > 8.5 THEN 'timeout' WHEN c.url IS NULL OR bad THEN 'http_error' ELSE 'ok' END AS status, CASE WHEN bad THEN 500 ELSE 200 END AS code FROM r LEFT JOIN c ON final_url = c.url)
SELECT ordinal, final_url, status, CASE WHEN status IN ('ok', 'http_error') THEN code END AS http_status, CASE status WHEN 'skipped' THEN 'not a usable url' WHEN 'timeout' THEN 'no response within 8.5 s' WHEN 'http_error' THEN 'HTTP ' || code END AS error, CASE WHEN status IN ('ok', 'http_error') THEN t ELSE '' END AS title FROM s""",
    "q_completed": _LOG + "SELECT seq AS rid, CASE WHEN kind = 'view' THEN 'backend_error' WHEN ok THEN 'ok' ELSE 'timeout' END AS status FROM log",
    "q_sink_roundtrip": f"SELECT page_id, url, {_TITLE} AS title, NULL::VARCHAR AS error, round(page_id / 7, 4) AS elapsed_s FROM pages",
    "q_source_parity": "SELECT 0::BIGINT AS n",
}
