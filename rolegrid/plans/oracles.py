"""The same results as plain SQL for an independent engine with RE2 patterns."""

from __future__ import annotations

import re

from rolegrid.functions import patterns as P
from rolegrid.functions.tags import DEFAULT_DICTIONARY
from rolegrid.plans.feed import AS_OF, BASE_URL, FEED_SQL, PAGE_JOBS_SQL, SOURCES_SQL

_NAMES = dict(orders="orders", customer="customer", nation="nation")
FEED = FEED_SQL.format(**_NAMES)
SOURCES = SOURCES_SQL.format(**_NAMES)
PAGE_JOBS = PAGE_JOBS_SQL.format(**_NAMES)
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_IN_LINE = WHITE.replace(r"\t-\r", r"\t\x0b\f\r")
MARKS = r"\x01\x02\x03"
ATTRS = r"""(?:[\s/](?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*))?>"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {to}, 'g')"


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def grp(expr: str, pattern: str, n: int) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {n})"


def trim(expr: str) -> str:
    return sub(expr, rf"^[{WHITE}]+|[{WHITE}]+\z")


def clean(expr: str) -> str:
    s = sub(f"coalesce({expr}, '')", r"[\t\n\f\r ]+", "' '")
    s = f"replace({s}, '&nbsp;', chr(160))"
    s = sub(s, r"(?s)<!--.*?(?:-->|\z)", "chr(3)")
    s = sub(s, r"(?is)<script" + ATTRS + r".*?(?:</script[^>]*>|\z)|<style" + ATTRS
            + r".*?(?:</style[^>]*>|\z)", "chr(3)")
    s = sub(s, r"(?i)<li" + ATTRS, "chr(1)")
    s = sub(s, r"(?i)<(?:br|p|div|ul|ol|h[1-6])" + ATTRS + r"|</(?:p|div|h[1-6])(?:[\s/][^>]*)?>", "chr(2)")
    s = sub(s, r"""</?[A-Za-z](?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*)>|<[!?][^>]*>|</[^A-Za-z>][^>]*>""", "chr(3)")
    # no lookaround: neighbouring white-space nodes need a second pass
    for _ in range(2):
        s = sub(s, rf"(^|[{MARKS}])[{WHITE}]+([{MARKS}]|\z)", r"'\1\2'")
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        s = f"replace({s}, '&{name};', {q(char)})"
    s = f"replace(replace(replace({s}, chr(1), chr(10) || '- '), chr(2), chr(10)), chr(3), '')"
    s = sub(s, rf"[{WHITE_IN_LINE}]+", "' '")
    s = sub(s, " ?\n ?", "chr(10)")
    s = sub(s, "\n{3,}", "chr(10) || chr(10)")
    return sub(s, r"^[ \n]+|[ \n]+\z")


def company_key(e: str) -> str:
    s = sub(sub(f"lower({e})", P.PERSERO, "' '"), P.TBK, "' '")
    s = sub(sub(s, P.COMPANY_PUNCT), P.LEGAL_FORM)
    return trim(sub(s, P.BLANKS, "' '"))


def title_key(e: str) -> str:
    return sub(sub(sub(f"lower({e})", P.MODE_TAG, "' '"), P.TITLE_SENIORITY), P.NON_KEY)


def mode(title: str, location: str, text: str) -> str:
    t = f"({title} || ' ' || {location} || ' ' || {text})"
    arms = " ".join(f"WHEN {hit(t, p)} THEN '{n}'" for n, p in P.MODE_PATTERNS)
    return f"CASE {arms} WHEN {trim(location)} <> '' THEN 'onsite' ELSE 'unknown' END"


def years(text: str) -> str:
    parts = []
    for i, p in enumerate(P.YEARS_PATTERNS):
        n = f"TRY_CAST(nullif({grp(text, p, 1)}, '') AS BIGINT)"
        parts.append(f"CASE WHEN {grp(text, p, 2)} = '' THEN {n} END" if i == P.YEARS_REJECTING else n)
    return f"coalesce({', '.join(parts)})"


def level(title: str, text: str) -> str:
    arms = " ".join(f"WHEN {hit(title, p)} THEN '{n}'" for n, p in P.LEVEL_PATTERNS)
    y = years(text)
    return (f"CASE {arms} WHEN {y} < 2 THEN 'junior' WHEN {y} < 5 THEN 'mid' "
            f"WHEN {y} IS NOT NULL THEN 'senior' ELSE 'unknown' END")


def city(e: str) -> str:
    return trim(sub(f"split_part({e}, ',', 1)", P.MODE_TAG))


def tags(text: str) -> str:
    by_tag: dict[str, list[str]] = {}
    for a in DEFAULT_DICTIONARY:
        esc = "".join("\\" + c if not c.isalnum() and c != " " else c for c in a.alias)
        title_case = f"({a.alias[:1].upper() + a.alias[1:].lower()}|{a.alias.upper()})"
        if a.not_after:
            test = hit(text, rf"(?i)(^|[^0-9A-Za-z_\{a.not_after}]){esc}($|[^0-9A-Za-z_])")
        elif a.not_before:
            rest = sub(text, rf"\b{title_case}[\s-]*(?i:{a.not_before})\b", "' '")
            test = hit(rest, rf"\b{title_case}\b")
        elif a.kind == "cap":
            test = hit(text, rf"\b{title_case}\b")
        elif a.alias.isalnum():
            test = hit(text, rf"(?i)\b{esc}\b")
        else:
            test = hit(text, rf"(?i){esc}")
        by_tag.setdefault(a.tag, []).append(test)
    arms = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN {q(t)} END" for t, tests in by_tag.items())
    return f"list_sort(list_filter([{arms}], lambda x: x IS NOT NULL))"


def _amount(n: str, u: str) -> str:
    bare = sub(n, r"[.,]+\z")
    parts = f"regexp_split_to_array({bare}, '[.,]')"
    f = (f"CASE WHEN lower({u}) IN ('jt', 'juta', 'jutaan') THEN 1000000.0::DOUBLE "
         f"WHEN lower({u}) IN ('rb', 'ribu', 'ribuan') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END")
    v = (f"CASE WHEN list_contains({parts}, '') THEN NULL "
         f"WHEN {f} > 1 AND len({parts}) = 2 AND length({parts}[2]) <= 2 THEN {parts}[1] || '.' || {parts}[2] "
         f"ELSE array_to_string({parts}, '') END")
    return f"TRY_CAST(round(TRY_CAST({v} AS DOUBLE) * {f}) AS BIGINT)"


def norm_ctes() -> str:
    t = trim("salary_raw")
    bare = sub(sub("t", P.SALARY_CURRENCY), P.SALARY_PERIOD)
    r, s = P.SALARY_RANGE, P.SALARY_SINGLE
    return f"""
feed AS ({FEED}),
cleaned AS (SELECT * EXCLUDE (description), {clean("description")} AS body, {t} AS t,
   {title_key("title")} AS title_normalized, {company_key("company")} AS company_normalized FROM feed),
bared AS (SELECT *, CASE WHEN {hit("t", P.SALARY_VAGUE)} OR {hit("t", P.SALARY_FOREIGN)} THEN ''
   ELSE {bare} END AS b FROM cleaned),
cut AS (SELECT *, {grp("b", r, 1)} AS n1, {grp("b", r, 2)} AS v1, {grp("b", r, 3)} AS n2, {grp("b", r, 4)} AS v2,
   {grp("b", s, 1)} AS n, {grp("b", s, 2)} AS u, regexp_extract(b, '(?s)^([^0-9]*)', 1) AS pre FROM bared),
amounts AS (SELECT *, {_amount("n1", "CASE WHEN v1 = '' THEN v2 ELSE v1 END")} AS a1,
   {_amount("n2", "CASE WHEN v2 = '' THEN v1 ELSE v2 END")} AS a2, {_amount("n", "u")} AS a,
   CASE WHEN {hit("pre", P.SALARY_MAX_WORD)} THEN 'max' WHEN {hit("pre", P.SALARY_MIN_WORD)} THEN 'min' ELSE 'both' END AS side
   FROM cut),
norm AS (SELECT ingest_seq, source_id, source_url, {trim("title")} AS title, title_normalized,
   {trim("company")} AS company_name, company_normalized, nullif(body, '') AS description,
   CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN least(a1, a2) WHEN side = 'both' THEN a
        WHEN side = 'min' AND a > 0 THEN a END AS salary_min,
   CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(a1, a2) WHEN side = 'both' THEN a
        WHEN side = 'max' AND a > 0 THEN a END AS salary_max,
   CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN 'range' WHEN a IS NULL THEN 'unknown'
        WHEN side = 'both' THEN 'exact' ELSE 'estimated' END AS salary_conf,
   nullif(salary_raw, '') AS salary_raw, {tags("(title || chr(10) || body)")} AS stack,
   nullif(location, '') AS location, nullif({city("location")}, '') AS location_city,
   {mode("title", "location", "body")} AS mode, {level("title", "body")} AS level,
   source_job_id, sha256(company_normalized || title_normalized) AS fingerprint, posted_at
   FROM amounts)"""


NORM = "WITH " + norm_ctes()

POST = NORM + f""",
latest AS (SELECT * EXCLUDE (rn), ingest_seq AS last_seq FROM (SELECT *,
     row_number() OVER (PARTITION BY source_id, source_url ORDER BY ingest_seq DESC) AS rn,
     min(ingest_seq) OVER (PARTITION BY source_id, source_url) AS first_seq FROM norm) WHERE rn = 1),
seen AS (SELECT *, TIMESTAMP '{AS_OF}' - to_days(CAST(first_seq % 30 AS INT)) AS first_seen_at FROM latest),
ranked AS (SELECT *, first_value(source_url) OVER w AS winner, count(*) OVER (PARTITION BY fingerprint) AS members
   FROM seen WINDOW w AS (PARTITION BY fingerprint ORDER BY posted_at ASC NULLS LAST, first_seen_at, first_seq)),
posts AS (SELECT *, CASE WHEN winner <> source_url THEN winner END AS canonical_url, first_seq % 9 <> 0 AS is_active,
   greatest(first_seen_at, TIMESTAMP '{AS_OF}' - to_days(CAST(last_seq % 15 AS INT))) AS last_seen_at FROM ranked),
live AS (SELECT * FROM posts WHERE canonical_url IS NULL AND is_active),
firms AS (SELECT company_normalized AS name_normalized, max_by(company_name, ingest_seq) AS name FROM norm GROUP BY 1),
srcs AS ({SOURCES})"""

_STACK = "array_to_string(stack, ',') AS stack"


def trigram_list(e: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({e}), '[^0-9a-z]+'), lambda w: w <> '')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: "
            f"list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def similar(source: str, block: str, text: str) -> str:
    return f"""
items AS (SELECT DISTINCT {block} AS block, {text} AS txt FROM {source} WHERE {text} <> ''),
sets AS (SELECT block, txt, {trigram_list("txt")} AS g FROM items),
pairs AS (SELECT a.block, a.txt AS text_a, b.txt AS text_b, len(list_intersect(a.g, b.g)) AS shared,
   len(a.g) + len(b.g) AS both_n FROM sets a JOIN sets b ON a.block = b.block AND a.txt < b.txt),
near AS (SELECT block, text_a, text_b, CAST(shared AS BIGINT) AS shared, CAST(both_n - shared AS BIGINT) AS total
   FROM pairs WHERE 10 * shared > 7 * (both_n - shared))"""


# Postings by company and title; edges by fingerprint or similar title; labels to a fixed point.
GROUPS = POST.replace("WITH ", "WITH RECURSIVE ", 1) + "," + similar(
    "posts", "company_normalized", "title_normalized") + """,
nodes AS (SELECT fingerprint, company_normalized, title_normalized, min(source_url) AS node, count(*) AS members
   FROM posts GROUP BY 1, 2, 3),
edges AS (SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.fingerprint = b.fingerprint AND a.node <> b.node
   UNION SELECT a.node, b.node FROM near JOIN nodes a ON a.company_normalized = block AND a.title_normalized = text_a
     JOIN nodes b ON b.company_normalized = block AND b.title_normalized = text_b
   UNION SELECT b.node, a.node FROM near JOIN nodes a ON a.company_normalized = block AND a.title_normalized = text_a
     JOIN nodes b ON b.company_normalized = block AND b.title_normalized = text_b),
reach AS (SELECT node AS u, node AS v FROM nodes UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
comp AS (SELECT u AS node, min(v) AS component FROM reach GROUP BY 1),
keyed AS (SELECT n.*, c.component FROM nodes n JOIN comp c USING (node)),
grouped AS (SELECT p.source_url, p.posted_at, p.first_seen_at, p.first_seq, k.fingerprint, k.title_normalized, k.members, k.component
   FROM posts p JOIN keyed k ON p.fingerprint = k.fingerprint AND p.company_normalized = k.company_normalized
     AND p.title_normalized = k.title_normalized),
elected AS (SELECT *, first_value(source_url) OVER (PARTITION BY component
   ORDER BY posted_at ASC NULLS LAST, first_seen_at, first_seq) AS canonical_id FROM grouped)"""

_PAGES = f"""
jobs AS ({PAGE_JOBS}),
placed AS (SELECT *, unnest(CASE WHEN feed_no % 4 = 1 AND page_no = 7 THEN [7, 8]
     WHEN feed_no % 4 = 1 AND page_no = 8 THEN [] ELSE [page_no] END) AS page FROM jobs),
numbered AS (SELECT *, feed_no * 20 + page AS number,
   row_number() OVER (PARTITION BY keyword, page ORDER BY id) - 1 AS pos FROM placed),
page_list AS (SELECT DISTINCT keyword, feed_no, page, number FROM numbered),
state AS (SELECT *, CASE WHEN number % 37 = 0 THEN 'payload script not found'
   WHEN number % 41 = 0 THEN 'payload is not valid JSON' END AS error,
   feed_no % 4 = 2 AND page = 12 AS is_empty FROM page_list),
good AS (SELECT n.* FROM numbered n JOIN state s USING (keyword, page) WHERE s.error IS NULL AND NOT s.is_empty)"""

_SEARCH_FORM = "(' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


def form(e: str) -> str:
    return _SEARCH_FORM.format(e)


ORDERS = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted_at FROM orders)")
_OUTCOMES = """
outcomes AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS was_inserted FROM events)"""

_PART_NAMES = f"""
names AS (SELECT p_brand, {title_key("p_name || ' ' || p_type || ' ' || p_size")} AS name FROM part)"""

_LIST = ("source_id, source_url, title, salary_max, mode, level, location_city, posted_at, " + _STACK)
_POST_FORM = form("concat_ws(' ', title, nullif(array_to_string(stack, ' '), ''), description)")


def _jstr(name: str, expr: str) -> str:
    return f"CASE WHEN nullif({expr}, '') IS NULL THEN NULL ELSE '\"{name}\":' || to_json({expr}) END"


def _jraw(name: str, expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE '\"{name}\":' || CAST({expr} AS VARCHAR) END"


def _jts(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN NULL ELSE '\"{name}\":\"' || strftime({name}, '%Y-%m-%dT%H:%M:%SZ') || '\"' END"


_JSON = "'{' || concat_ws(',', " + ", ".join([
    _jstr("id", "source_url"), _jstr("title", "title"), "'\"company\":' || to_json(name)",
    _jstr("description", "description"), _jraw("salary_min", "salary_min"), _jraw("salary_max", "salary_max"),
    _jstr("salary_confidence", "salary_conf"), _jstr("salary_raw", "salary_raw"), "'\"stack\":' || to_json(stack)",
    _jstr("location", "location"), _jstr("location_city", "location_city"), _jstr("mode", "mode"),
    _jstr("level", "level"), _jstr("source_url", "source_url"), _jts("posted_at"), _jts("first_seen_at"),
    _jts("last_seen_at"), _jraw("is_active", "is_active")]) + ") || '}'"

ORACLES: dict[str, str] = {
    "normalized_postings": NORM + f" SELECT * REPLACE (array_to_string(stack, ',') AS stack) FROM norm",
    "clean_pages": f"SELECT page_id, strlen(html) AS bytes_in, {clean('html')} AS text, strlen({clean('html')}) AS bytes_out FROM pages",
    "clean_page_totals": f"""WITH c AS (SELECT html, {clean('html')} AS t FROM pages)
SELECT count(*) AS n_pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes_in, CAST(sum(strlen(t)) AS BIGINT) AS bytes_out FROM c""",
    "salary_profile": NORM + """ SELECT source_id, salary_conf, count(*) AS n, CAST(sum(salary_min) AS BIGINT) AS sum_min,
 CAST(sum(salary_max) AS BIGINT) AS sum_max, count(salary_min) AS n_min, count(salary_max) AS n_max FROM norm GROUP BY 1, 2""",
    "document_tags": f"SELECT doc_id, array_to_string({tags('text')}, ',') AS tags FROM documents",
    "user_dictionary_tags": """WITH words AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS alias FROM part WHERE p_partkey % 10 = 0),
t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^0-9a-z_]+')) AS alias FROM part),
h AS (SELECT p_partkey, string_agg(DISTINCT upper(alias), ',' ORDER BY upper(alias)) AS tags FROM t JOIN words USING (alias) GROUP BY 1)
SELECT p_partkey, coalesce(tags, '') AS tags FROM part LEFT JOIN h USING (p_partkey)""",
    "dictionary_rows_tags": NORM + " SELECT ingest_seq, array_to_string(stack, ',') AS tags FROM norm",
    "posting_tags": NORM + " SELECT ingest_seq, unnest(stack) AS tag FROM norm",
    "mode_counts": NORM + " SELECT mode, count(*) AS n FROM norm GROUP BY 1",
    "level_counts": NORM + " SELECT level, count(*) AS n FROM norm GROUP BY 1",
    "city_counts": NORM + " SELECT location_city, count(*) AS n FROM norm WHERE location_city IS NOT NULL GROUP BY 1",
    "company_keys": NORM + " SELECT company_normalized, count(DISTINCT company_name) AS spellings, count(*) AS n FROM norm GROUP BY 1",
    "title_keys": NORM + " SELECT title_normalized, count(DISTINCT title) AS spellings, count(*) AS n FROM norm GROUP BY 1",
    "fingerprint_groups": POST + " SELECT DISTINCT fingerprint, members, winner AS canonical_url FROM posts WHERE members > 1",
    "document_copies": f"""SELECT sha256({company_key('lang')} || {title_key('text')}) AS fingerprint, count(*) AS members,
 min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "search_tokens": f"""WITH t AS (SELECT doc_id, list_filter(string_split({form('text')}, ' '), lambda x: x <> '') AS l FROM documents),
p AS (SELECT unnest(l) AS token, unnest(range(1, len(l) + 1)) AS pos FROM t)
SELECT token, count(*) AS n, max(pos) AS max_pos FROM p GROUP BY 1""",
    "crawl_plan": f"""WITH w AS (SELECT p_name AS keyword, min(p_size) - 2 AS m FROM part GROUP BY 1),
p AS (SELECT keyword, unnest(range(1, 1 + CASE WHEN m <= 0 THEN 3 WHEN m > 20 THEN 20 ELSE m END)) AS page FROM w)
SELECT keyword, CAST(page AS INT) AS page, '{BASE_URL}/id-ID/job-board/te/' || replace(keyword, ' ', '%20') || '/' || page AS url FROM p""",
    "page_postings": "WITH " + _PAGES + f""" SELECT keyword, CAST(page AS INT) AS page, pos, name AS title, company_name AS company,
 CASE WHEN NOT shown OR (base_salary IS NULL AND maximum_salary IS NULL) THEN '' ELSE
   CASE WHEN base_salary IS NOT NULL AND maximum_salary IS NOT NULL THEN '' WHEN maximum_salary IS NOT NULL THEN 'up to ' ELSE 'from ' END
   || coalesce(nullif(currency, ''), 'IDR') || ' ' || concat_ws(' - ', base_salary, maximum_salary)
   || CASE WHEN salary_interval = '' THEN '' ELSE '/' || salary_interval END END AS salary_raw,
 CASE WHEN no_place THEN '' ELSE concat_ws(', ', nullif(city, ''), nullif(country, ''))
   || CASE WHEN wfh THEN ' (Remote)' WHEN hybrid THEN ' (Hybrid)' ELSE '' END END AS location,
 {trim("description || chr(10) || chr(10) || qualifications")} AS description,
 '{BASE_URL}/c/' || code || '/jobs/' || id || '/' || slug AS source_url, CAST(id AS VARCHAR) AS source_job_id,
 CASE WHEN activated <> 'soon' THEN epoch_us(CAST(activated AS TIMESTAMPTZ)) END AS posted_at FROM good""",
    "page_errors": "WITH " + _PAGES + f""" SELECT keyword, CAST(page AS INT) AS page, '{BASE_URL}/id-ID/job-board/te/' || replace(keyword, ' ', '%20')
 || '/' || page AS url, error FROM state WHERE error IS NOT NULL""",
    "page_trim": "WITH " + _PAGES + """,
ids AS (SELECT keyword, page, list(id) AS ids FROM good GROUP BY 1, 2),
full_pages AS (SELECT s.*, crawl, coalesce(i.ids, []) AS ids, CASE WHEN feed_no % 4 = 3 THEN 100 ELSE 300 END AS total
   FROM state s JOIN (VALUES (1), (2)) c(crawl) ON crawl = 1 OR feed_no % 3 = 0 LEFT JOIN ids i USING (keyword, page)),
lagged AS (SELECT *, lag(ids) OVER w AS prev, lag(total) OVER w AS prev_total,
   sum(len(ids)) OVER (PARTITION BY crawl, keyword ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
   FROM full_pages WINDOW w AS (PARTITION BY crawl, keyword ORDER BY page)),
first_stop AS (SELECT crawl, keyword, min(page) AS stop FROM lagged WHERE error IS NOT NULL OR len(ids) = 0
   OR (prev IS NOT NULL AND len(list_intersect(ids, prev)) = len(ids)) OR coalesce(before >= prev_total, false) GROUP BY 1, 2)
SELECT crawl, keyword, CAST(page AS INT) AS page, len(ids) AS n_jobs FROM full_pages LEFT JOIN first_stop USING (crawl, keyword)
WHERE stop IS NULL OR page < stop""",
    "country_audit": "WITH " + _PAGES + """ SELECT keyword, CAST(page AS INT) AS page, count(*) AS total_jobs,
 count(*) FILTER (WHERE NOT no_place AND country NOT IN ('', 'Indonesia')) AS wrong_country_jobs,
 string_agg(DISTINCT CASE WHEN NOT no_place AND country NOT IN ('', 'Indonesia') THEN country END, ','
   ORDER BY CASE WHEN NOT no_place AND country NOT IN ('', 'Indonesia') THEN country END) AS countries_seen
 FROM good GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT no_place AND country NOT IN ('', 'Indonesia')) > 0""",
    "feed_union": """SELECT 'board' AS feed, count(*) AS n, count(*) AS n_urls, NULL AS error FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'parts', count(*), 0, NULL FROM part
UNION ALL SELECT 'broken', 0, 0, 'feed "broken": connection reset'""",
    "tag_stats": POST + " SELECT tag, count(*) AS job_count FROM (SELECT unnest(stack) AS tag FROM live) GROUP BY 1",
    "active_count": POST + " SELECT count(*) AS active_jobs FROM live",
    "source_stats": POST + """ SELECT s.id, s.slug, s.name, s.last_run_at, count(live.source_url) AS active_jobs
 FROM srcs s LEFT JOIN live ON live.source_id = s.id GROUP BY 1, 2, 3, 4""",
    "supplier_stats": """SELECT n_nationkey, n_name, count(s_suppkey) FILTER (WHERE s_acctbal > 5000) AS n
 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "stats_bundle": POST + """ SELECT 'total' AS part, '' AS name, count(*) AS n FROM live
UNION ALL SELECT 'source', s.slug, count(live.source_url) FROM srcs s LEFT JOIN live ON live.source_id = s.id GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(stack) AS tag FROM live) GROUP BY 2""",
    "kept_stats": POST + """, after AS (SELECT * REPLACE (CASE WHEN first_seq % 4 = 1 THEN NOT is_active ELSE is_active END AS is_active,
   CASE WHEN first_seq % 6 = 2 THEN source_id % 25 + 1 ELSE source_id END AS source_id) FROM posts),
open AS (SELECT * FROM after WHERE canonical_url IS NULL AND is_active)
SELECT 'total' AS part, '' AS name, count(*) AS n FROM open
UNION ALL SELECT 'source', s.slug, count(open.source_url) FROM srcs s LEFT JOIN open ON open.source_id = s.id GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(stack) AS tag FROM open) GROUP BY 2""",
    "settled_moves": """WITH RECURSIVE moves AS (SELECT c_custkey AS old_id, CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 49 ELSE c_custkey + 1 END AS new_id
   FROM customer WHERE c_custkey % 50 <> 0 OR CAST(floor((c_custkey - 1) / 50) AS BIGINT) % 7 = 0),
walk AS (SELECT old_id, new_id, 1 AS step FROM moves
   UNION ALL SELECT w.old_id, m.new_id, step + 1 FROM walk w JOIN moves m ON w.new_id = m.old_id WHERE step < 60),
ends AS (SELECT old_id, new_id FROM walk WHERE new_id NOT IN (SELECT old_id FROM moves))
SELECT o_orderkey AS id, coalesce(new_id, o_custkey) AS canonical_job_id FROM orders LEFT JOIN ends ON o_custkey = old_id""",
    "rejected_moves": """WITH RECURSIVE moves AS (SELECT p_partkey AS old_id, CASE WHEN p_partkey % 20 = 0 THEN p_partkey - 13 ELSE p_partkey + 1 END AS new_id
   FROM part WHERE p_partkey % 20 <> 0 OR CAST(floor((p_partkey - 1) / 20) AS BIGINT) % 3 = 0),
walk AS (SELECT old_id, new_id, 1 AS step FROM moves
   UNION ALL SELECT w.old_id, m.new_id, step + 1 FROM walk w JOIN moves m ON w.new_id = m.old_id WHERE step < 40)
SELECT old_id, new_id, 'the moves lead back to where they came from' AS error FROM moves
 WHERE old_id NOT IN (SELECT old_id FROM walk WHERE new_id NOT IN (SELECT old_id FROM moves))""",
    "next_cursors": f"""WITH days AS (SELECT '1997-03-' || lpad(CAST(i AS VARCHAR), 2, '0') AS day FROM range(1, 8) t(i)),
rows_ AS (SELECT day, o_orderkey, row_number() OVER (PARTITION BY day ORDER BY posted_at DESC, o_orderkey DESC) AS rn
   FROM days LEFT JOIN {ORDERS} ON CAST(CAST(posted_at AS DATE) AS VARCHAR) = day)
SELECT day, max(CASE WHEN rn = 20 THEN o_orderkey END) AS last_key FROM rows_ GROUP BY 1""",
    "feed_errors": """SELECT string_agg(CASE WHEN n_nationkey % 5 = 3 THEN 'feed "n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '": nation '
   || n_nationkey || ' does not answer' END, chr(10) ORDER BY n_nationkey) AS error,
 CAST((SELECT count(*) FROM supplier WHERE s_nationkey % 5 <> 3) AS INT) AS n_rows FROM nation""",
    "stream_repeats": f"""WITH feed AS ({FEED}), sent AS (SELECT source_id, source_url, title, company, salary_raw, location, description, source_job_id, posted_at FROM feed
   UNION SELECT source_id, source_url, title || ' II', company, salary_raw, location, description, source_job_id, posted_at FROM feed WHERE ingest_seq % 5 = 0)
SELECT source_id, count(*) AS n FROM sent GROUP BY 1""",
    "archived_pages": """SELECT page_id % 8 AS part, count(*) AS n, max(page_id) AS last_page, CAST(sum(length(html)) AS BIGINT) AS chars,
 CAST((SELECT count(*) FROM pages WHERE page_id = 83) AS BIGINT) AS n_errors
 FROM pages WHERE page_id % 8 <> 3 OR page_id < 83 GROUP BY 1""",
    "seeded_sources": f"""WITH srcs AS ({SOURCES}) SELECT id, slug FROM srcs WHERE id <> 1
 UNION ALL SELECT id, slug FROM (VALUES (1, 'dealls'), (2, 'kalibrr')) s(id, slug) WHERE id NOT IN (SELECT id FROM srcs WHERE id <> 1)""",
    "list_filters": POST + f""" SELECT {_LIST} FROM live WHERE list_has_any(stack, ['Go', 'Python', 'React'])
 AND salary_max >= 5000000 AND mode = 'remote' AND location_city ILIKE '%a_arta'""",
    "list_page": POST + f""" SELECT {_LIST} FROM (SELECT *, {_POST_FORM} AS f FROM live) WHERE level = 'senior'
 AND contains(f, ' tools ') AND contains(f, ' build r d ') AND (contains(f, ' java ') OR contains(f, ' data platform '))
 AND NOT contains(f, ' kafka ') ORDER BY posted_at DESC NULLS LAST, source_url DESC LIMIT 50""",
    "keyset_page": f"""SELECT * FROM {ORDERS} WHERE (coalesce(posted_at, '-infinity'::TIMESTAMP), o_orderkey)
 < (TIMESTAMP '1997-03-04', 5000) ORDER BY posted_at DESC NULLS LAST, o_orderkey DESC LIMIT 100""",
    "keyset_page_unknown": f"""SELECT * FROM {ORDERS} WHERE (coalesce(posted_at, '-infinity'::TIMESTAMP), o_orderkey)
 < ('-infinity'::TIMESTAMP, 9000) ORDER BY posted_at DESC NULLS LAST, o_orderkey DESC LIMIT 100""",
    "page_boundaries": f"""SELECT CAST(rn // 20 AS BIGINT) AS page, posted_at, o_orderkey FROM (SELECT *, row_number() OVER (
 ORDER BY posted_at DESC NULLS LAST, o_orderkey DESC) AS rn FROM {ORDERS}) WHERE rn % 20 = 0""",
    "text_search": f"""SELECT doc_id, lang, source FROM (SELECT *, {form('text')} AS f FROM documents) WHERE contains(f, ' the ')
 AND contains(f, ' of the ') AND (contains(f, ' that ') OR contains(f, ' with ')) AND NOT contains(f, ' license ')""",
    "token_search": f"""SELECT doc_id FROM (SELECT doc_id, string_split({form('text')}, ' ') AS l FROM documents)
 WHERE list_has_all(l, ['the', 'and', 'that'])""",
    "token_terms": f"""SELECT doc_id FROM (SELECT doc_id, {form('text')} AS f FROM documents) WHERE contains(f, ' the ')
 AND contains(f, ' of the ') AND (contains(f, ' that ') OR contains(f, ' with the ')) AND NOT contains(f, ' license ')
 AND NOT contains(f, ' and of the ')""",
    "token_index_search": f"""SELECT doc_id FROM (SELECT doc_id, {form("CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN concat_ws(' ', text, 'Seen again at', source) ELSE text END")} AS f
 FROM documents WHERE doc_id % 11 <> 0) WHERE contains(f, ' the ') AND (contains(f, ' again at src1 ') OR contains(f, ' that '))
 AND NOT contains(f, ' again at src2 ')""",
    "posting_lookup": POST + f""" SELECT source_url, title, p.is_active, slug FROM posts p JOIN srcs s ON s.id = p.source_id
 WHERE source_url = '{BASE_URL}/jobs/54' AND slug = 'nation_0'""",
    "company_lookup": POST + """ SELECT name, name_normalized FROM firms WHERE name_normalized IN
 (SELECT company_normalized FROM live WHERE mode = 'remote')""",
    "posting_companies": POST + """ SELECT source_id, source_url, coalesce(name, '') AS company FROM live
 LEFT JOIN firms ON name_normalized = company_normalized""",
    "posting_json": POST + f" SELECT source_url AS id, {_JSON} AS json FROM live JOIN firms ON name_normalized = company_normalized",
    "posting_detail": POST + """ SELECT a.source_url AS asked_id, CASE WHEN p.source_url = a.source_url THEN 'job' ELSE 'duplicate' END AS role,
 p.source_url, p.title, name AS company, p.first_seq
 FROM posts a JOIN posts p ON p.source_url = a.source_url OR p.canonical_url = a.source_url
 JOIN firms ON name_normalized = p.company_normalized WHERE a.first_seq % 50 = 4""",
    "canonical_duplicates": POST + """ SELECT c.source_url AS canonical_url, c.title AS canonical_title, d.source_url, d.title
 FROM posts d JOIN posts c ON d.canonical_url = c.source_url""",
    "trigram_pairs": f"""WITH p AS (SELECT p_partkey, p_name AS a, p_type || ' ' || split_part(p_name, ' ', -1) AS b FROM part),
g AS (SELECT *, {trigram_list('a')} AS ga, {trigram_list('b')} AS gb FROM p),
s AS (SELECT *, len(list_intersect(ga, gb)) AS shared FROM g)
SELECT p_partkey, a, b, shared, len(ga) + len(gb) - shared AS total, shared / (len(ga) + len(gb) - shared) AS similarity FROM s""",
    "near_duplicates": NORM + "," + similar("norm", "company_normalized", "title_normalized") + " SELECT * FROM near",
    "part_near_duplicates": "WITH " + _PART_NAMES + "," + similar("names", "p_brand", "name") + " SELECT * FROM near",
    "part_name_groups": "WITH RECURSIVE " + _PART_NAMES + "," + similar("names", "p_brand", "name") + """,
edges AS (SELECT block || '/' || text_a AS u, block || '/' || text_b AS v FROM near
   UNION SELECT block || '/' || text_b, block || '/' || text_a FROM near),
reach AS (SELECT u, u AS v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT u AS node, min(v) AS component FROM reach GROUP BY 1""",
    "duplicate_groups": GROUPS + " SELECT DISTINCT fingerprint, title_normalized, members, component, canonical_id FROM elected",
    "canonical_pointers": GROUPS + " SELECT source_url AS id, nullif(canonical_id, source_url) AS canonical_id FROM elected",
    "reparented": POST + """ SELECT d.source_url AS id, CASE WHEN c.source_id = 2 THEN c.source_url || '#new' ELSE c.source_url END AS canonical_job_id
 FROM posts d JOIN posts c ON d.canonical_url = c.source_url""",
    "manual_merges": POST + f""", m AS (SELECT source_url AS job_id, 1 AS seq, '{BASE_URL}/jobs/' || (first_seq - first_seq % 50) AS canonical_id
   FROM posts WHERE first_seq % 50 < 2
   UNION ALL SELECT source_url, 2, '{BASE_URL}/jobs/' || (first_seq - first_seq % 50 + 52) FROM posts WHERE first_seq % 50 = 1),
c AS (SELECT *, CASE WHEN job_id = canonical_id THEN 'a posting cannot be a duplicate of itself'
   WHEN canonical_id NOT IN (SELECT source_url FROM posts) THEN 'the target of the merge does not exist' END AS error FROM m)
 SELECT job_id AS id, max_by(canonical_id, seq) AS canonical_job_id, CAST(NULL AS VARCHAR) AS error FROM c WHERE error IS NULL GROUP BY 1
 UNION ALL SELECT job_id, canonical_id, error FROM c WHERE error IS NOT NULL""",
    "company_upsert": NORM + """ SELECT company_normalized AS name_normalized, max_by(company_name, ingest_seq) AS name,
 bool_or(ingest_seq % 4 = 0) AS kept_id FROM norm GROUP BY 1""",
    "latest_events": """SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts,
 min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS deliveries FROM events GROUP BY 1, 2""",
    "posting_upsert": NORM + f""",
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_url ORDER BY ingest_seq DESC) AS rn,
   min(ingest_seq) OVER (PARTITION BY source_id, source_url) AS first_seq FROM norm WHERE ingest_seq % 10 <> 9) WHERE rn = 1),
new AS (SELECT * FROM norm WHERE ingest_seq % 10 = 9 UNION ALL
   SELECT * REPLACE (source_url || '/b' AS source_url) FROM norm WHERE ingest_seq % 10 <> 9 AND ingest_seq % 50 = 0),
batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_url ORDER BY ingest_seq DESC) AS rn,
   min(ingest_seq) OVER (PARTITION BY source_id, source_url) AS first_seq FROM new) WHERE rn = 1)
SELECT source_id, source_url, CASE WHEN b.title IS NULL THEN o.title ELSE b.title END AS title,
  CASE WHEN b.title IS NULL THEN o.salary_max ELSE b.salary_max END AS salary_max,
  CASE WHEN b.title IS NULL THEN o.posted_at ELSE b.posted_at END AS posted_at,
  CASE WHEN o.first_seq % 5 = 0 THEN 'kept' END AS canonical_job_id,
  CASE WHEN o.title IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{AS_OF}' - to_days(30) END AS first_seen_at,
  CASE WHEN b.title IS NULL THEN TIMESTAMP '{AS_OF}' - to_days(30) ELSE TIMESTAMP '{AS_OF}' END AS last_seen_at,
  b.title IS NOT NULL AS is_active, coalesce(o.first_seq, b.first_seq) AS first_seq
FROM old o FULL OUTER JOIN batch b USING (source_id, source_url)""",
    "event_outcomes": "WITH " + _OUTCOMES + " SELECT event_id, was_inserted FROM outcomes",
    "run_counters": "WITH " + _OUTCOMES + """ SELECT CAST(ts AS DATE) AS day, count(*) AS jobs_found,
 count(*) FILTER (WHERE value <= 300 AND was_inserted AND value >= 5) AS jobs_new,
 count(*) FILTER (WHERE value <= 300 AND (NOT was_inserted OR value < 5)) AS jobs_duplicate,
 count(*) FILTER (WHERE value > 300) AS jobs_failed FROM outcomes GROUP BY 1""",
    "run_ledger": f"""WITH feed AS ({FEED}), srcs AS ({SOURCES}),
e AS (SELECT *, row_number() OVER (PARTITION BY source_id, source_url ORDER BY ingest_seq) = 1 AS ins, ingest_seq % 101 = 0 AS bad FROM feed),
c AS (SELECT source_id, count(*) AS f, count(*) FILTER (WHERE NOT bad AND ins) AS n, count(*) FILTER (WHERE NOT bad AND NOT ins) AS d,
  count(*) FILTER (WHERE bad) AS x FROM e GROUP BY 1)
SELECT s.id AS source_id, coalesce(f, 0) AS jobs_found, coalesce(n, 0) AS jobs_new, coalesce(d, 0) AS jobs_duplicate,
  coalesce(x, 0) AS jobs_failed, CASE WHEN s.id IN (3, 4) AND coalesce(f, 0) = 0 THEN 'failed' ELSE 'success' END AS status,
  nullif(concat_ws(chr(10), CASE WHEN s.id IN (3, 4) THEN 'source error' END,
    CASE WHEN coalesce(x, 0) > 0 THEN x || ' failed rows' END), '') AS error_message
FROM srcs s LEFT JOIN c ON c.source_id = s.id""",
    "source_last_run": f"""WITH feed AS ({FEED}), srcs AS ({SOURCES})
SELECT id, slug, CASE WHEN id IN (SELECT source_id FROM feed) THEN TIMESTAMP '{AS_OF}' END AS last_run_at FROM srcs""",
    "stale_sweep": """WITH l AS (SELECT user_id, event_type, arg_max(ts, event_id) AS t FROM events GROUP BY 1, 2),
s AS (SELECT *, user_id % 10 <> 0 AS act, user_id % 10 <> 0 AND t < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS was_stale FROM l)
SELECT user_id, event_type, act AND NOT was_stale AS is_active, was_stale FROM s""",
    "constraint_audit": f"""
SELECT 'line is unique' AS "check", l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'order exists', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0) GROUP BY 2
UNION ALL SELECT 'customer exists', CAST(o_custkey AS VARCHAR), count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'event type', event_type, count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 2
UNION ALL SELECT 'required value', 'posted_at', count(*) FROM {ORDERS} WHERE posted_at IS NULL HAVING count(*) > 0""",
    "posting_audit": POST + f""",
d AS (SELECT *, CASE WHEN first_seq % 500 = 1 THEN 99 ELSE source_id END AS sid,
   CASE WHEN first_seq % 300 = 2 THEN 'moon' ELSE mode END AS m,
   CASE WHEN first_seq % 40 = 4 THEN '{BASE_URL}/jobs/' || (first_seq + 40) END AS ptr FROM posts)
SELECT 'source exists' AS "check", '99' AS key, count(*) AS n FROM d WHERE sid = 99 HAVING count(*) > 0
UNION ALL SELECT 'company exists', company_normalized, count(*) FROM d WHERE company_normalized = 'customer 7' GROUP BY 2
UNION ALL SELECT 'mode value', 'moon', count(*) FROM d WHERE m = 'moon' HAVING count(*) > 0
UNION ALL SELECT 'required value', 'level', count(*) FROM d WHERE first_seq % 400 = 3 HAVING count(*) > 0
UNION ALL SELECT 'canonical exists', ptr, count(*) FROM d WHERE ptr IS NOT NULL AND ptr NOT IN (SELECT source_url FROM d) GROUP BY 2
UNION ALL SELECT 'pointer target is not canonical', ptr, count(*) FROM d WHERE ptr IN (SELECT source_url FROM d WHERE ptr IS NOT NULL) GROUP BY 2""",
}


def _run_sql(good: str) -> str:
    """One run of the feed into empty tables: every posting is first seen at once."""
    return GROUPS.replace("FROM norm) WHERE rn = 1)", f"FROM norm WHERE {good}) WHERE rn = 1)").replace(
        "TIMESTAMP '" + AS_OF + "' - to_days(CAST(first_seq % 30 AS INT)) AS first_seen_at",
        "TIMESTAMP '" + AS_OF + "' AS first_seen_at")


_GOOD = "ingest_seq % 101 <> 0 AND ingest_seq % 107 <> 0 AND ingest_seq % 103 <> 0"
_ERROR = """CASE WHEN ingest_seq % 101 = 0 THEN 'text holds a null character' WHEN ingest_seq % 107 = 0 THEN 'posting has no address'
 WHEN ingest_seq % 103 = 0 THEN 'source does not exist' END"""
ORACLES["ingest_jobs"] = _run_sql(_GOOD) + """ SELECT p.source_id, p.source_url, p.title, nullif(e.canonical_id, p.source_url) AS canonical_url,
 p.salary_min, p.first_seq, true AS is_active FROM posts p JOIN elected e USING (source_url)"""
ORACLES["stream_ingest"] = _run_sql("true") + """ SELECT p.source_id, p.source_url, p.title,
 nullif(e.canonical_id, p.source_url) AS canonical_url FROM posts p JOIN elected e USING (source_url)"""
ORACLES["ingest_errors"] = f"""WITH feed AS ({FEED}) SELECT ingest_seq, CASE WHEN ingest_seq % 107 <> 0 THEN source_url END AS source_url,
 {_ERROR} AS error FROM feed WHERE NOT ({_GOOD})"""
ORACLES["ingest_ledger"] = _run_sql(_GOOD) + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY posted_at ASC NULLS LAST, first_seq) AS place FROM elected),
arrived AS (SELECT coalesce(min(place) OVER (PARTITION BY component ORDER BY first_seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < place, false) AS dup FROM placed),
c AS (SELECT count(*) FILTER (WHERE NOT dup) AS n FROM arrived),
e AS (SELECT {_ERROR} AS error FROM feed),
f AS (SELECT count(*) AS found, count(error) AS failed FROM e),
t AS (SELECT string_agg(x || ' rows failed: ' || error, chr(10) ORDER BY place) AS error_message
   FROM (SELECT error, count(*) AS x, list_position(['text holds a null character', 'posting has no address', 'source does not exist'], error) AS place
         FROM e WHERE error IS NOT NULL GROUP BY 1))
SELECT 'feed' AS id, 'success' AS status, found AS jobs_found, n AS jobs_new, found - failed - n AS jobs_duplicate,
  failed AS jobs_failed, error_message FROM c, f, t"""


def _renamed(sql: str, suffix: str, **names: str) -> str:
    """The SQL with its own table names made new, so that it can follow itself."""
    own = ("items", "sets", "pairs", "near", "nodes", "edges", "reach", "comp", "keyed", "grouped", "elected")
    for name in own:
        sql = re.sub(rf"\b{name}\b", name + suffix, sql)
    for name, new in names.items():
        sql = re.sub(rf"\b{name}\b", new, sql)
    return sql


_FIRST = _run_sql("ingest_seq % 10 <> 9").replace(f"TIMESTAMP '{AS_OF}' AS first_seen_at", "TIMESTAMP '2024-01-22' AS first_seen_at")
_CONTENT = ("title", "title_normalized", "company_normalized", "fingerprint", "posted_at")
_SECOND = _FIRST + """,
run1 AS (SELECT p.*, nullif(e.canonical_id, p.source_url) AS ptr FROM posts p JOIN elected e USING (source_url)),
delivered AS (SELECT * FROM norm WHERE ingest_seq % 10 = 9
   UNION ALL SELECT * REPLACE (source_url || '/b' AS source_url, ingest_seq + 1000000000 AS ingest_seq,
     posted_at - to_days(400) AS posted_at) FROM norm WHERE ingest_seq % 50 = 0),
batch2 AS (SELECT source_id, source_url, max(ingest_seq) AS last_seq, min(ingest_seq) AS first_seq FROM delivered GROUP BY 1, 2),
new2 AS (SELECT d.*, b.first_seq FROM delivered d JOIN batch2 b ON d.source_url = b.source_url AND d.ingest_seq = b.last_seq),
all2 AS (SELECT source_id, source_url, """ + ", ".join(
    f"CASE WHEN b.title IS NULL THEN r.{c} ELSE b.{c} END AS {c}" for c in _CONTENT) + f""",
   coalesce(r.first_seen_at, TIMESTAMP '{AS_OF}') AS first_seen_at, coalesce(r.first_seq, b.first_seq) AS first_seq, r.ptr,
   b.title IS NOT NULL AS touched, r.title IS NULL AS fresh FROM run1 r FULL OUTER JOIN new2 b USING (source_id, source_url)),
state2 AS (SELECT * FROM all2 WHERE ptr IS NULL)""" + _renamed(GROUPS[GROUPS.index(similar(
    "posts", "company_normalized", "title_normalized")) - 1:], "2", posts="state2")
_AFTER = """, result2 AS (SELECT a.*, CASE WHEN a.ptr IS NULL THEN nullif(e.canonical_id, a.source_url)
     ELSE coalesce(t.canonical_id, a.ptr) END AS canonical_url,
   touched OR (a.first_seq % 7 <> 0 AND a.first_seq % 2 = 0) AS is_active,
   NOT touched AND a.first_seq % 7 <> 0 AND a.first_seq % 2 = 1 AS was_stale
   FROM (SELECT a.source_id, a.source_url, a.title, a.ptr, a.touched, a.fresh, a.first_seq FROM all2 a) a
   LEFT JOIN elected2 e ON e.source_url = a.source_url LEFT JOIN elected2 t ON t.source_url = a.ptr)"""
ORACLES["ingest_second_run"] = _SECOND + _AFTER + """
 SELECT source_id, source_url, title, canonical_url, first_seq, is_active FROM result2"""
ORACLES["ingest_second_ledger"] = _SECOND + _AFTER + """,
placed AS (SELECT e.component, e.first_seq, s.fresh, CASE WHEN s.fresh THEN e.first_seq + 1 ELSE 0 END AS arrival,
   row_number() OVER (PARTITION BY e.component ORDER BY e.posted_at ASC NULLS LAST, e.first_seen_at, e.first_seq) AS place
   FROM elected2 e JOIN state2 s USING (source_url)),
arrived AS (SELECT *, coalesce(min(place) OVER (PARTITION BY component ORDER BY arrival, place
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < place, false) AS dup FROM placed),
c AS (SELECT count(*) FILTER (WHERE fresh AND NOT dup) AS n FROM arrived), f AS (SELECT count(*) AS found FROM delivered),
s AS (SELECT count(*) FILTER (WHERE was_stale) AS deactivated FROM result2)
 SELECT 'second' AS id, 'success' AS status, found AS jobs_found, n AS jobs_new, found - n AS jobs_duplicate,
   CAST(0 AS BIGINT) AS jobs_failed, deactivated FROM c, f, s"""

# the rows of page_postings on pages that page_trim keeps, as a feed
_PAGE_FEED = f"""WITH {_PAGES.replace(chr(10) + "jobs AS", "jobs AS", 1)},
rows AS ({ORACLES["page_postings"].split(_PAGES)[1]}),
kept AS ({ORACLES["page_trim"].split(_PAGES)[1].lstrip(",").strip().replace("ids AS (", "WITH ids AS (", 1)})
SELECT row_number() OVER (ORDER BY keyword, page, pos) AS ingest_seq, 2 AS source_id, title, company, salary_raw, location,
  description, source_url, source_job_id, make_timestamp(posted_at) AS posted_at
FROM rows JOIN (SELECT keyword, page FROM kept WHERE crawl = 1) USING (keyword, page)"""
ORACLES["pages_ingest"] = _run_sql("true").replace(f"feed AS ({FEED})", f"feed AS ({_PAGE_FEED})") + """
 SELECT p.source_id, p.source_url, p.title, p.salary_min, p.salary_max, p.mode, p.location_city,
 nullif(e.canonical_id, p.source_url) AS canonical_url FROM posts p JOIN elected e USING (source_url)"""
