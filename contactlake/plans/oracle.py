"""DuckDB oracle SQL, one statement per registered query.

Only the base tables are views in the oracle; fixtures are inlined as CTEs
with the same portable SQL Spark runs.  Each statement restates the operator
in SQL independently of the DataFrame code it checks.
"""

from __future__ import annotations

from contactlake.functions import html as H
from contactlake.plans import sqlfrag as S
from contactlake.plans.sqlfrag import q
from contactlake.sources.fixtures import duckdb_fixture_ctes
from contactlake.operators.extract import EMAIL_BLOCKLIST, FAKE_PHONE_SUBSTRINGS

ORACLE: dict[str, str] = {}

MAILTO_INNER = "split_part(regexp_replace(x, '^mailto:', ''), '?', 1)"
TEL_INNER = "regexp_replace(x, '^tel:', '')"


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def _text_stages(src: str, cols: str, drop=H.RAW_TEXT_TAGS, prefix="t") -> str:
    """CTE stages giving ``hrefs`` and ``txt`` (body text) for ``src``."""
    rm = q(S.removal_regex(drop))
    return (
        f"{prefix}1 AS (SELECT {cols}, regexp_replace(html, {rm}, '', 'g') AS h FROM {src}),\n"
        f"{prefix}2 AS (SELECT *, CASE WHEN regexp_extract(h, {q(S.BODY_RE)}, 1) <> '' "
        f"THEN regexp_extract(h, {q(S.BODY_RE)}, 1) ELSE regexp_replace(h, {q(S.HEAD_RE)}, '', 'g') END AS b "
        f"FROM {prefix}1),\n"
        f"{prefix}3 AS (SELECT * EXCLUDE (h, b), {S.href_list('h')} AS hrefs, "
        f"{S.decode_all(S.strip_tags('b'))} AS txt FROM {prefix}2)")


def _email_list_stages(src: str, prefix="e") -> str:
    mailto = (f"list_transform(list_filter(list_transform(list_filter(hrefs, lambda x: starts_with(x, 'mailto:')), "
              f"lambda x: {S.js_trim(MAILTO_INNER)}), "
              f"lambda x: {S.weak_email('x')}), lambda x: lower(x))")
    text = (f"list_transform(list_filter(CASE WHEN strpos(txt, '@') > 0 THEN "
            f"regexp_extract_all(txt, {q(S.EMAIL_TEXT_RE2)}, 0) ELSE []::VARCHAR[] END, "
            f"lambda x: {S.weak_email('x')}), lambda x: lower(x))")
    block = " OR ".join(f"contains(x, {q(b)})" for b in EMAIL_BLOCKLIST)
    return (
        f"{prefix}1 AS (SELECT *, CASE WHEN starts_with(url, 'http') THEN list_concat({mailto}, {text}) "
        f"ELSE []::VARCHAR[] END AS found FROM {src}),\n"
        f"{prefix}2 AS (SELECT * EXCLUDE (found), {S.ordered_distinct('found')} AS dist FROM {prefix}1),\n"
        f"{prefix}3 AS (SELECT * EXCLUDE (dist), list_filter(dist, lambda x: NOT ({block})) AS emails "
        f"FROM {prefix}2)")


def _phone_list_stages(src: str, prefix="p", strict=False) -> str:
    tel = (f"list_filter(list_transform(list_filter(hrefs, lambda x: starts_with(x, 'tel:')), "
           f"lambda x: {S.js_trim(TEL_INNER)}), "
           f"lambda x: {S.weak_phone('x')})")
    parts = [tel] + [
        f"list_filter(list_transform(regexp_extract_all(txt, {q(p)}, 0), lambda x: {S.js_trim('x')}), "
        f"lambda x: {S.weak_phone('x')})" for p in S.phone_res_re2(strict)]
    found = parts[0]
    for p in parts[1:]:
        found = f"list_concat({found}, {p})"
    fake = " AND ".join(f"NOT contains(x, {q(f)})" for f in FAKE_PHONE_SUBSTRINGS)
    return (
        f"{prefix}1 AS (SELECT *, CASE WHEN starts_with(url, 'http') THEN {found} "
        f"ELSE []::VARCHAR[] END AS pfound FROM {src}),\n"
        f"{prefix}2 AS (SELECT * EXCLUDE (pfound), {S.ordered_distinct('pfound')} AS pdist FROM {prefix}1),\n"
        f"{prefix}3 AS (SELECT * EXCLUDE (pdist), list_filter(pdist, lambda x: length({S.digits('x')}) "
        f"BETWEEN 10 AND 15 AND {fake}) AS phones FROM {prefix}2)")


def best_email_expr(lst: str = "emails") -> str:
    return f"list_filter({lst}, lambda x: {S.valid_email('x')})[1]"


def best_phone_expr(lst: str = "phones") -> str:
    return (f"list_filter(list_transform({lst}, lambda x: {S.valid_phone('x')}), "
            f"lambda x: x IS NOT NULL)[1]")


def site_contacts_sql(strict=False) -> str:
    """CTEs ending in ``sc(page_id, url, html, emails, phones)``."""
    return (duckdb_fixture_ctes("site_pages") + ",\n"
            + _text_stages("site_pages", "page_id, url, html") + ",\n"
            + _email_list_stages("t3") + ",\n"
            + _phone_list_stages("e3", strict=strict) + ",\n"
            + "sc AS (SELECT page_id, url, html, emails, phones FROM p3)\n")


@oracle("best_email_per_page")
def _():
    return (site_contacts_sql()
            + f"SELECT page_id, url, coalesce({best_email_expr()}, '') AS best_email, "
              "CAST(len(emails) AS BIGINT) AS n_emails FROM sc")


@oracle("best_phone_per_page")
def _():
    return (site_contacts_sql()
            + f"SELECT page_id, url, coalesce({best_phone_expr()}, '') AS best_phone, "
              "CAST(len(phones) AS BIGINT) AS n_phones FROM sc")


@oracle("page_email_list")
def _():
    return (site_contacts_sql()
            + "SELECT page_id, CAST(g.i - 1 AS BIGINT) AS pos, emails[g.i] AS email "
              "FROM sc, LATERAL (SELECT unnest(generate_series(1, len(emails))) AS i) g")


@oracle("page_phone_list")
def _():
    return (site_contacts_sql()
            + "SELECT page_id, CAST(g.i - 1 AS BIGINT) AS pos, phones[g.i] AS phone "
              "FROM sc, LATERAL (SELECT unnest(generate_series(1, len(phones))) AS i) g")


# --- dedup ----------------------------------------------------------------------
def _features(src="businesses") -> str:
    return S.dedup_feature_stages(src, "df")


@oracle("business_signatures")
def _():
    return (duckdb_fixture_ctes("businesses") + ",\n" + _features() + "\n"
            "SELECT ord, nname, naddr, pd, coalesce(host, '') AS host, sig FROM dff")


@oracle("duplicate_pairs")
def _():
    return (duckdb_fixture_ctes("businesses") + ",\n" + _features() + "\n"
            "SELECT * FROM (SELECT a.ord AS ord_a, b.ord AS ord_b, " + S.pair_score_sql("a", "b") + " AS score "
            "FROM dff a JOIN dff b ON a.ord < b.ord AND a.phone <> '' AND b.phone <> '' "
            "AND (contains(a.pd, b.pd) OR contains(b.pd, a.pd))) WHERE score > 0.85::DOUBLE")


KEPT_FIELDS = ["ord", "phone", "pd", "email", "website", "host", "nname", "naddr", "sig"]
EMPTY_KEPT = ("list_filter([{" + ", ".join(
    f"'{f}': NULL::{'BIGINT' if f == 'ord' else 'VARCHAR'}" for f in KEPT_FIELDS) + "}], lambda x: false)")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _walk(src: str) -> str:
    """CTEs from the features of ``src`` to ``kept_ords(ord)``: the sequential
    rule, row by row."""
    st = "{" + ", ".join(f"'{f}': f.{f}" for f in KEPT_FIELDS) + "}"
    return (_features(src) + ",\n"
            "fr AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM dff),\n"
            "walk(rn, kept) AS (SELECT 0::BIGINT, " + EMPTY_KEPT + " UNION ALL "
            "SELECT f.rn, CASE WHEN list_contains(list_transform(w.kept, lambda k: k.sig), f.sig) "
            "OR len(list_filter(w.kept, lambda k: " + S.pair_score_sql("k", "f") + " > 0.85::DOUBLE)) > 0 "
            "THEN w.kept ELSE list_append(w.kept, " + st + ") END "
            "FROM walk w JOIN fr f ON f.rn = w.rn + 1),\n"
            "kept_ords AS (SELECT unnest(list_transform(kept, lambda k: k.ord)) AS ord FROM walk "
            "WHERE rn = (SELECT count(*) FROM fr))\n")


@oracle("dedup_businesses")
def _():
    return (_recursive(duckdb_fixture_ctes("businesses") + ",\n") + _walk("businesses")
            + "SELECT ord, name, phone, email, website, address, category FROM businesses "
              "WHERE ord IN (SELECT ord FROM kept_ords)")


@oracle("dedup_in_batches")
def _():
    return ORACLE["dedup_businesses"]


# --- validators, URL functions, reports -----------------------------------------
from contactlake.operators.extract import (BUSINESS_INDICATORS, BUSINESS_MIN_SCORE,  # noqa: E402
                                           NON_BUSINESS_HOSTS)
from contactlake.operators.freshness import DEFAULT_TTL_MS, TTL_MS  # noqa: E402
from contactlake.functions.validate import DISPOSABLE_DOMAINS  # noqa: E402

BCOLS = "ord, name, phone, email, website, address, category"


def _validated() -> str:
    return duckdb_fixture_ctes("businesses") + ",\n" + S.validated_stages() + "\n"


@oracle("validated_businesses")
def _():
    return _validated() + "SELECT * FROM validated"


@oracle("phone_formats")
def _():
    return (duckdb_fixture_ctes("businesses")
            + f"SELECT ord, phone, coalesce({S.valid_phone('phone')}, '') AS formatted, "
              f"CAST(length({S.digits('phone')}) AS BIGINT) AS n_digits, "
              f"coalesce({S.weak_phone('phone')}, false) AS weak_ok FROM businesses")


def _biz_sql() -> str:
    from contactlake.sources.fixtures import BUSINESSES_SQL, duckdb_sql
    return duckdb_sql(BUSINESSES_SQL).strip()


@oracle("email_checks")
def _():
    body = (site_contacts_sql().replace("WITH ", "WITH businesses AS (" + _biz_sql() + "),\n", 1)
            + ", e AS (SELECT 'business' AS src, ord AS id, email FROM businesses UNION ALL "
              "SELECT 'page', page_id, unnest(emails) FROM sc)\n"
            + f"SELECT src, id, email, coalesce({S.valid_email('email')}, false) AS valid, "
              f"coalesce({S.weak_email('email')}, false) AS weak_ok, "
              f"coalesce(strpos(email, '@') > 0 AND lower(split_part(email, '@', 2)) IN "
              f"({', '.join(q(d) for d in DISPOSABLE_DOMAINS)}), false) "
              f"AS disposable FROM e")
    return body


@oracle("page_url_normalised")
def _():
    return (duckdb_fixture_ctes("businesses") + ",\n"
            + "u AS (SELECT 'page' AS src, page_id AS id, url AS raw FROM pages UNION ALL "
              "SELECT 'business', ord, website FROM businesses),\n"
            + S.normalized_website_stages("u", "raw", "n", "nw") + ",\n"
            + S.url_host_stages("nw7", "raw", "h", "hs") + "\n"
            + "SELECT src, id, raw, coalesce(n, '') AS normalized, coalesce(h, '') AS host FROM hs3")


@oracle("url_intake_errors")
def _():
    return (duckdb_fixture_ctes("url_inputs") + ",\n"
            + f"u AS (SELECT ord, raw, 'https://' || {S.strip_prefix('lower(' + S.js_trim('raw') + ')')} AS cleaned "
              f"FROM url_inputs WHERE {S.js_trim('raw')} <> ''),\n"
            + S.url_parts_stages("u", "cleaned", "up") + "\n"
            + "SELECT ord, raw, cleaned, CASE WHEN NOT up_valid THEN 'Invalid URL: Invalid URL' "
              "WHEN NOT contains(up_host, '.') THEN 'Invalid URL: Invalid domain format' "
              "WHEN contains(up_host, 'localhost') OR contains(up_host, '127.0.0.1') "
              "OR regexp_matches(up_host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+\\z') "
              "THEN 'Invalid URL: Local URLs not supported' ELSE '' END AS error FROM up6")


@oracle("url_list_lines")
def _():
    return (duckdb_fixture_ctes("url_inputs") + f", n AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, {S.js_trim('raw')} AS raw FROM url_inputs) "
            "SELECT ord, raw FROM n WHERE raw <> ''")


@oracle("business_request_rows")
def _():
    return (duckdb_fixture_ctes("businesses") + ", b AS (SELECT *, ord // 10 AS g FROM businesses), "
            "r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS place FROM b WHERE g % 7 <> 3) "
            "SELECT name, phone, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM r GROUP BY 1, 2 "
            "UNION ALL SELECT 'Invalid businesses data', '', count(DISTINCT g), 0 FROM b WHERE g % 7 = 3 HAVING count(*) > 0")


@oracle("url_standard_cases")
def _():
    from contactlake.sources.fixtures import URL_CASES
    values = ", ".join(f"({i}, {q(href)})" for i, (_, href) in enumerate(URL_CASES))
    return (f"SELECT page_id, replace(href, 'KEY', CAST(page_id AS VARCHAR)) AS href FROM pages "
            f"JOIN (VALUES {values}) c(i, href) ON page_id % {len(URL_CASES)} = i")


@oracle("redirect_links")
def _():
    return ("WITH l AS (SELECT page_id, '/url?q=' || url_encode(url) || '&sa=U&ved=x' AS link FROM pages)\n"
            "SELECT page_id, link, CASE WHEN contains(link, '/url?') AND regexp_extract(link, 'url\\?q=([^&]+)', 1) <> '' "
            "THEN coalesce(url_decode(replace(regexp_extract(link, 'url\\?q=([^&]+)', 1), '+', '%2B')), link) "
            "ELSE link END AS target FROM l")


@oracle("search_requests")
def _():
    enc = "url_encode(business_type || ' in ' || location)"
    for a, b in [("%21", "!"), ("%2A", "*"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        enc = f"replace({enc}, {q(a)}, {q(b)})"
    return ("WITH qq AS (SELECT DISTINCT c_mktsegment AS business_type, n_name AS location FROM customer "
            "JOIN nation ON c_nationkey = n_nationkey), pg AS (SELECT unnest([1, 2, 3]) AS page)\n"
            f"SELECT business_type, location, CAST(page AS BIGINT) AS page, "
            f"'https://www.google.com/search?tbm=lcl&q=' || {enc} || '&hl=en&gl=us&start=' || "
            f"CAST((page - 1) * 10 AS VARCHAR) AS request_url FROM qq, pg")


@oracle("coverage_stats")
def _():
    nb = lambda c: f"{S.js_trim('coalesce(' + c + ', ' + chr(39) * 2 + ')')} <> ''"
    return (_validated() + f"SELECT count(*) AS total, count_if({nb('phone')}) AS with_phone, "
            f"count_if({nb('email')}) AS with_email, count_if({nb('website')}) AS with_website FROM validated")


def _nb(c: str) -> str:
    return f"({S.js_trim('coalesce(' + c + ', ' + chr(39) * 2 + ')')} <> '')"


@oracle("export_counts")
def _():
    nw = f"(NOT {_nb('website')})"
    return (_validated() + f"SELECT count(*) AS total, count_if({nw}) AS without_website, "
            f"count_if({_nb('phone')}) AS all_phone, count_if({_nb('email')}) AS all_email, "
            f"count_if({_nb('website')}) AS all_website, count_if({nw} AND {_nb('phone')}) AS nw_phone, "
            f"count_if({nw} AND {_nb('email')}) AS nw_email, count_if({nw} AND {_nb('website')}) AS nw_website "
            f"FROM validated")


@oracle("export_no_website")
def _():
    return (_validated() + 'SELECT name AS "Business Name", category AS "Category", phone AS "Phone", '
            'email AS "Email", website AS "Website", address AS "Address" FROM validated '
            f"WHERE NOT {_nb('website')}")


@oracle("display_rows")
def _():
    cut = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"
    return (_validated() + "SELECT ord, name, "
            f"CASE WHEN category <> '' THEN {cut('category', 60)} ELSE '' END AS category_text, "
            "CASE WHEN phone <> '' THEN phone ELSE 'No phone' END AS phone_text, "
            "CASE WHEN email <> '' THEN email ELSE 'No email' END AS email_text, "
            "CASE WHEN website <> '' THEN website ELSE 'No website' END AS website_text, "
            f"CASE WHEN address <> '' THEN {cut('address', 25)} ELSE 'No address' END AS address_text FROM validated")


@oracle("page_slice")
def _():
    return _validated() + "SELECT * FROM validated ORDER BY ord LIMIT 10 OFFSET 20"


@oracle("deep_page")
def _():
    return _validated() + "SELECT * FROM validated ORDER BY ord LIMIT 10 OFFSET 600"


@oracle("page_meta")
def _():
    return (_validated() + ", v AS (SELECT *, CAST((row_number() OVER (PARTITION BY category ORDER BY ord) - 1) // 10 + 1 AS BIGINT) AS page FROM validated),\n"
            "per AS (SELECT category, page, count(*) AS rows FROM v GROUP BY category, page),\n"
            "tot AS (SELECT category, count(*) AS total_results FROM v GROUP BY category)\n"
            "SELECT per.category, CAST(page AS BIGINT) AS current_page, CAST(rows AS BIGINT) AS rows, "
            "page < CAST(ceil(total_results / 10.0::DOUBLE) AS BIGINT) AS has_next_page, page > 1 AS has_previous_page, "
            "CAST(ceil(total_results / 10.0::DOUBLE) AS BIGINT) AS total_pages, CAST(total_results AS BIGINT) AS total_results "
            "FROM per JOIN tot ON per.category = tot.category")


@oracle("accumulated_pages")
def _():
    return (duckdb_fixture_ctes("businesses")
            + ", b AS (SELECT *, category AS query, CAST(floor(ord / 50) AS BIGINT) + 1 AS page FROM businesses),\n"
              "f AS (SELECT query, name, min(page) AS first_page FROM b GROUP BY query, name)\n"
              f"SELECT b.query, b.page, {', '.join('b.' + c for c in BCOLS.split(', '))} FROM b "
              "JOIN f ON b.query = f.query AND b.name = f.name WHERE b.page = f.first_page")


# --- crawl log ------------------------------------------------------------------
from contactlake.operators.crawl import REASON_PHRASES  # noqa: E402


def _status_message(s: str) -> str:
    phrase = "CASE " + s + " " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in REASON_PHRASES.items()) + " ELSE '' END"
    return (f"CASE WHEN {s} >= 200 AND {s} < 300 THEN NULL "
            f"WHEN {s} IN (403, 429) THEN 'Access denied (' || CAST({s} AS VARCHAR) || '): Website may be blocking automated requests' "
            f"WHEN {s} = 404 THEN 'Page not found (404): Website may not exist' "
            f"WHEN {s} >= 500 THEN 'Server error (' || CAST({s} AS VARCHAR) || '): Website may be temporarily unavailable' "
            f"ELSE 'HTTP ' || CAST({s} AS VARCHAR) || ': ' || {phrase} END")


def _attempts_sql() -> str:
    return (duckdb_fixture_ctes("crawl_log")
            + ", a AS (SELECT url, status, timed_out, row_number() OVER (PARTITION BY url ORDER BY fetched_at, event_id) AS attempt "
              "FROM crawl_log), a3 AS (SELECT * FROM a WHERE attempt <= 3),\n"
              "d AS (SELECT url, count(*) AS attempts, min(CASE WHEN (status >= 200 AND status < 300) OR status IN (403, 404, 429) OR timed_out "
              "THEN attempt END) AS dec_at, max(attempt) AS last_at FROM a3 GROUP BY url),\n"
              "o AS (SELECT d.url, CAST(d.attempts AS BIGINT) AS attempts, CAST(coalesce(dec_at, last_at) AS BIGINT) AS final_attempt, "
              "CAST(a3.status AS BIGINT) AS status, a3.timed_out AS late FROM d JOIN a3 ON a3.url = d.url AND a3.attempt = coalesce(dec_at, last_at)),\n"
              f"outcome AS (SELECT * EXCLUDE (late), coalesce(status >= 200 AND status < 300, false) AS ok, CASE WHEN status >= 200 AND status < 300 THEN '' "
              f"WHEN late THEN 'Request timeout after 30 seconds' WHEN status IS NULL THEN 'Failed to fetch after retries' "
              f"ELSE {_status_message('status')} END AS message FROM o)\n")


@oracle("attempt_outcome")
def _():
    return _attempts_sql() + "SELECT * FROM outcome"


def _category_sql(m: str, status: str | None) -> tuple[str, str]:
    server = f"contains({m}, 'Server error') OR contains({m}, '5')" if status is None else \
        f"contains({m}, 'Server error') OR coalesce({status} >= 500, contains({m}, '5'))"
    from contactlake.operators import crawl as CR
    rules = [
        (f"contains({m}, 'timeout') OR contains({m}, 'Request timeout')", "timeout", q(CR.MSG_TIMEOUT)),
        (f"contains({m}, 'Access denied') OR contains({m}, '403') OR contains({m}, '429')", "network", q(CR.MSG_BLOCKED)),
        (f"contains({m}, '404') OR contains({m}, 'not found')", "network", q(CR.MSG_NOT_FOUND)),
        (f"contains({m}, 'Not a business website')", "content", q(CR.MSG_NOT_BUSINESS)),
        (f"contains({m}, 'Invalid URL')", "validation", m),
        (server, "network", q(CR.MSG_SERVER)),
        (f"contains({m}, 'quota') OR contains({m}, 'exceeded')", "network", q(CR.MSG_QUOTA)),
    ]
    cat = "CASE " + " ".join(f"WHEN {c} THEN {q(k)}" for c, k, _ in rules) + " ELSE 'unknown' END"
    msg = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in rules) + f" ELSE {m} END"
    return cat, msg


def _errors_sql(strict: bool) -> str:
    cat, msg = _category_sql("text", None if strict else "status")
    return (_attempts_sql() + ", t AS (SELECT url, status, url || ': ' || message AS text FROM outcome WHERE NOT ok),\n"
            f"ec AS (SELECT url, status, text, {cat} AS category, {msg} AS error_message FROM t)\n")


@oracle("error_categories")
def _():
    return _errors_sql(False) + "SELECT *, url || ': ' || error_message AS line FROM ec"


@oracle("error_categories_strict")
def _():
    return _errors_sql(True) + "SELECT *, url || ': ' || error_message AS line FROM ec"


@oracle("error_category_counts")
def _():
    return _errors_sql(False) + "SELECT category, CAST(count(*) AS BIGINT) AS n FROM ec GROUP BY category"


@oracle("redirect_targets")
def _():
    from contactlake.operators.crawl import MAX_REDIRECTS, REDIRECT_STATUSES
    red = ", ".join(str(s) for s in REDIRECT_STATUSES)
    head = (duckdb_fixture_ctes("crawl_log")
            + ", last AS (SELECT url AS k_url, l.s AS k_status, l.c AS k_loc FROM (SELECT url, arg_max({'s': status, 'c': location}, "
              "(fetched_at, event_id)) AS l FROM crawl_log GROUP BY url)),\n"
              "s0 AS (SELECT k_url AS url, k_url AS cur, 0 AS hops FROM last)")
    parts, outs = [head], []
    for i in range(MAX_REDIRECTS + 1):
        parts.append(
            f"j{i} AS (SELECT s{i}.*, k_status, k_loc, CASE WHEN k_status IS NULL THEN 'fetch failed' "
            f"WHEN k_status >= 200 AND k_status < 300 THEN 'ok' "
            f"WHEN k_status IN ({red}) AND coalesce(k_loc, '') = '' THEN 'Redirect (' || CAST(k_status AS VARCHAR) || ') without Location header' "
            f"WHEN k_status NOT IN ({red}) THEN 'Failed to fetch (' || CAST(k_status AS VARCHAR) || ')' END AS outc, "
            f"CASE WHEN starts_with(k_loc, 'http') THEN k_loc "
            f"WHEN starts_with(k_loc, '//') THEN split_part(cur, ':', 1) || ':' || k_loc "
            f"WHEN starts_with(k_loc, '/') THEN regexp_extract(cur, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || k_loc "
            f"ELSE regexp_replace(regexp_extract(cur, '^([^?#]*)', 1), '[^/]*\\z', '') || k_loc END AS nxt "
            f"FROM s{i} LEFT JOIN last ON cur = k_url)")
        outs.append(f"SELECT url, cur AS final_url, CAST(hops AS BIGINT) AS hops, CAST(k_status AS BIGINT) AS status, "
                    f"outc AS outcome FROM j{i} WHERE outc IS NOT NULL")
        if i < MAX_REDIRECTS:
            parts.append(f"s{i + 1} AS (SELECT url, nxt AS cur, hops + 1 AS hops FROM j{i} WHERE outc IS NULL)")
        else:
            outs.append(f"SELECT url, nxt AS final_url, CAST(hops + 1 AS BIGINT) AS hops, CAST(k_status AS BIGINT) AS status, "
                        f"'Too many redirects when fetching ' || url AS outcome FROM j{i} WHERE outc IS NULL")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(outs)


def _entries_sql() -> str:
    ttl = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in TTL_MS.items()) + f" ELSE {DEFAULT_TTL_MS} END"
    key = f"kind || ':' || regexp_replace(lower(url), {q('[' + S.WS + ']+')}, '_', 'g')"
    return (duckdb_fixture_ctes("crawl_log")
            + f", ce AS (SELECT {key} AS key, kind, url, fetched_at, event_id, CAST({ttl} AS BIGINT) AS ttl_ms "
              "FROM crawl_log WHERE status >= 200 AND status < 300),\n"
              "lk AS (SELECT key, arg_max(fetched_at, (fetched_at, event_id)) AS fetched_at, "
              "arg_max(event_id, (fetched_at, event_id)) AS event_id, arg_max(kind, (fetched_at, event_id)) AS kind, "
              "arg_max(ttl_ms, (fetched_at, event_id)) AS ttl_ms FROM ce GROUP BY key),\n"
              "nw AS (SELECT max(fetched_at) AS now FROM crawl_log),\n"
              "fr AS (SELECT lk.*, CAST(floor((epoch_us(now) - epoch_us(fetched_at)) / 1000) AS BIGINT) AS age_ms, "
              "(epoch_us(now) - epoch_us(fetched_at)) <= ttl_ms * 1000 AS fresh FROM lk, nw)\n")


@oracle("latest_by_key")
def _():
    return _entries_sql() + "SELECT key, fetched_at, event_id, kind, ttl_ms FROM lk"


@oracle("fresh_lookup")
def _():
    return _entries_sql() + "SELECT key, kind, fetched_at, ttl_ms, age_ms, fresh FROM fr"


@oracle("lookups_as_of")
def _():
    return (_entries_sql().rstrip() + f", lo AS (SELECT event_id, kind || ':' || regexp_replace(lower(url), {q('[' + S.WS + ']+')}, '_', 'g') AS key, "
            "fetched_at + to_minutes((event_id % 7) * 10) AS at FROM crawl_log WHERE event_id % 3 = 0),\n"
            "u AS (SELECT key, fetched_at, max(event_id) AS entry_id, max(ttl_ms) AS ttl_ms FROM ce GROUP BY key, fetched_at)\n"
            "SELECT lo.event_id, lo.key, u.entry_id, coalesce((epoch_us(lo.at) - epoch_us(u.fetched_at)) <= u.ttl_ms * 1000, false) AS fresh "
            "FROM lo ASOF LEFT JOIN u ON lo.key = u.key AND lo.at >= u.fetched_at")


@oracle("expired_entries")
def _():
    return _entries_sql() + "SELECT key, kind, fetched_at, age_ms FROM fr WHERE NOT fresh"


@oracle("cache_stats")
def _():
    return _entries_sql() + "SELECT count_if(fresh) AS size, count_if(NOT fresh) AS expired FROM fr"


# --- mentions in documents --------------------------------------------------------
def _email_mentions_sql() -> str:
    return ("WITH m AS (SELECT doc_id, list_transform(list_filter(CASE WHEN strpos(text, '@') > 0 THEN "
            f"regexp_extract_all(text, {q(S.EMAIL_TEXT_RE2)}, 0) ELSE []::VARCHAR[] END, lambda x: {S.weak_email('x')}), "
            "lambda x: lower(x)) AS found FROM documents),\n"
            f"d AS (SELECT doc_id, {S.ordered_distinct('found')} AS l FROM m),\n"
            "em AS (SELECT doc_id, CAST(g.i - 1 AS BIGINT) AS pos, l[g.i] AS email FROM d, "
            "LATERAL (SELECT unnest(generate_series(1, len(l))) AS i) g)\n")


@oracle("email_mentions")
def _():
    return _email_mentions_sql() + "SELECT * FROM em"


@oracle("email_domain_counts")
def _():
    return (_email_mentions_sql() + "SELECT CASE WHEN strpos(email, '@') > 0 THEN split_part(email, '@', 2) END AS domain, "
            "count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM em GROUP BY 1")


def _phone_mentions_sql(strict: bool) -> str:
    parts = [f"list_filter(list_transform(regexp_extract_all(text, {q(p)}, 0), lambda x: {S.js_trim('x')}), "
             f"lambda x: {S.weak_phone('x')})" for p in S.phone_res_re2(strict)]
    found = parts[0]
    for p in parts[1:]:
        found = f"list_concat({found}, {p})"
    fake = " AND ".join(f"NOT contains(x, {q(f)})" for f in FAKE_PHONE_SUBSTRINGS)
    return (f"WITH m AS (SELECT doc_id, {found} AS found FROM documents),\n"
            f"d AS (SELECT doc_id, list_filter({S.ordered_distinct('found')}, lambda x: length({S.digits('x')}) "
            f"BETWEEN 10 AND 15 AND {fake}) AS l FROM m)\n"
            "SELECT doc_id, CAST(g.i - 1 AS BIGINT) AS pos, l[g.i] AS phone FROM d, "
            "LATERAL (SELECT unnest(generate_series(1, len(l))) AS i) g")


@oracle("phone_mentions")
def _():
    return _phone_mentions_sql(False)


@oracle("phone_mentions_strict")
def _():
    return _phone_mentions_sql(True)


# --- contact-page fallback, enrichment, business score ---------------------------
def _fallback_sql(extra_fixtures=()) -> str:
    base = site_contacts_sql()
    for f in extra_fixtures:
        base = base.replace("WITH ", f"WITH {f},\n", 1)
    rm = q(S.removal_regex(H.RAW_TEXT_TAGS))
    kw = "lambda x: contains(x, 'contact') OR contains(x, 'Contact')"
    return (base + f", k1 AS (SELECT url, emails, phones, {best_email_expr()} AS best_email, {best_phone_expr()} AS best_phone, "
            f"list_filter({S.href_list('regexp_replace(html, ' + rm + ', ' + chr(39) * 2 + ', ' + q('g') + ')')}, {kw})[1] AS khref "
            "FROM sc),\n"
            + S.url_parts_stages("k1", "url", "ko") + ",\n"
            "k2 AS (SELECT url, best_email, best_phone, CASE WHEN khref IS NULL THEN NULL "
            "WHEN starts_with(khref, 'http') THEN khref WHEN starts_with(khref, '/') THEN ko_origin || khref "
            "ELSE ko_origin || '/' || khref END AS contact_url FROM ko6),\n"
            + S.normalized_website_stages("k2", "url", "site", "ks") + ",\n"
            + S.normalized_website_stages("ks7", "contact_url", "c_site", "kc") + ",\n"
            "one AS (SELECT site, first(best_email ORDER BY url) AS best_email, first(best_phone ORDER BY url) AS best_phone "
            "FROM kc7 WHERE site IS NOT NULL GROUP BY site),\n"
            "fb AS (SELECT m.url, m.site, m.contact_url, m.best_email, m.best_phone, c.best_email AS c_email, c.best_phone AS c_phone, "
            "coalesce(m.best_email, c.best_email) AS email, coalesce(m.best_phone, c.best_phone) AS phone "
            "FROM kc7 m LEFT JOIN one c ON m.c_site = c.site AND (m.best_email IS NULL OR m.best_phone IS NULL) "
            "AND m.contact_url IS NOT NULL),\n"
            "fs AS (SELECT site, first(email ORDER BY url) AS email, first(phone ORDER BY url) AS phone FROM fb "
            "WHERE site IS NOT NULL GROUP BY site)\n")


@oracle("contact_page_fallback")
def _():
    return (_fallback_sql() + "SELECT url, coalesce(contact_url, '') AS contact_url, coalesce(email, '') AS email, "
            "coalesce(phone, '') AS phone, CASE WHEN best_email IS NOT NULL THEN 'main' WHEN c_email IS NOT NULL "
            "THEN 'contact' ELSE '' END AS email_source, CASE WHEN best_phone IS NOT NULL THEN 'main' "
            "WHEN c_phone IS NOT NULL THEN 'contact' ELSE '' END AS phone_source FROM fb")


def _enriched_sql(field: str) -> str:
    from contactlake.sources.fixtures import PAGE_BUSINESSES_SQL, duckdb_sql
    pb = "page_businesses AS (" + duckdb_sql(PAGE_BUSINESSES_SQL).strip() + ")"
    sql = _fallback_sql()
    sql = sql.replace("sc AS (SELECT", pb + ",\nsc AS (SELECT", 1) + ", " + S.normalized_website_stages(
        "page_businesses", "website", "b_site", "pb") + "\n"
    pred = (f"coalesce(b.website, '') <> '' AND coalesce(b.{field}, '') = '' AND starts_with(b.website, 'http')")
    cols = [f"coalesce(f.{field}, b.{field}) AS {field}" if c == field else f"b.{c}" for c in BCOLS.split(", ")]
    return sql + f"SELECT {', '.join(cols)} FROM pb7 b LEFT JOIN fs f ON b.b_site = f.site AND {pred}"


@oracle("enriched_emails")
def _():
    return _enriched_sql("email")


@oracle("enriched_phones")
def _():
    return _enriched_sql("phone")


@oracle("business_score")
def _():
    rm = q(S.removal_regex(()))
    body = (f"CASE WHEN regexp_extract(h, {q(S.BODY_RE)}, 1) <> '' THEN regexp_extract(h, {q(S.BODY_RE)}, 1) "
            f"ELSE regexp_replace(h, {q(S.HEAD_RE)}, '', 'g') END")
    title = f"array_to_string(regexp_extract_all(h, {q(S.TITLE_RE)}, 1), '')"
    hits = []
    for terms, weight in BUSINESS_INDICATORS:
        cond = " OR ".join(f"contains(t, {q(x)}) OR contains(ti, {q(x)})" for x in terms)
        hits.append((cond, weight, f"Found business indicator: {terms[0]}"))
    pts = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in hits)
    reasons = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for c, _, r in hits) + ")"
    return (duckdb_fixture_ctes("site_pages")
            + f", s1 AS (SELECT page_id, url, regexp_replace(html, {rm}, '', 'g') AS h FROM site_pages),\n"
              f"s2 AS (SELECT page_id, url, lower({S.decode_all(S.strip_tags(body))}) AS t, lower({S.decode_all(title)}) AS ti FROM s1),\n"
              f"s3 AS (SELECT page_id, url, {pts} AS points, {reasons} AS reasons FROM s2)\n"
              f"SELECT page_id, url, CAST(points AS BIGINT) AS points, points >= {BUSINESS_MIN_SCORE} AS is_valid, "
              "points / 100.0::DOUBLE AS confidence, reasons FROM s3")


@oracle("business_verdict")
def _():
    score = ORACLE["business_score"]
    # Reuse the score statement as a CTE next to the contact lists.
    sc_part = site_contacts_sql()
    deny = " OR ".join(f"contains(vh, {q(h)})" for h in NON_BUSINESS_HOSTS)
    return (sc_part + ", bs AS (" + score + "),\n"
            + S.url_host_stages("sc", "url", "vh", "vs") + ",\n"
            "j AS (SELECT vs3.page_id, vs3.url, len(emails) > 0 OR len(phones) > 0 AS has, vh, bs.is_valid AS s_valid, "
            "bs.confidence AS s_conf, bs.reasons AS s_reasons FROM vs3 JOIN bs ON vs3.page_id = bs.page_id)\n"
            "SELECT page_id, url, CASE WHEN has THEN true WHEN " + f"coalesce({deny}, false)" + " THEN false ELSE s_valid END AS is_valid, "
            "CASE WHEN has THEN (0.6::DOUBLE + 0.6::DOUBLE) / 2 WHEN " + f"coalesce({deny}, false)" + " THEN 0.0::DOUBLE ELSE s_conf END AS confidence, "
            "CASE WHEN has THEN 'AI found contact information, AI confidence: 60%' WHEN " + f"coalesce({deny}, false)"
            + " THEN 'Known non-business platform' ELSE s_reasons END AS reasons FROM j")


# --- result pages: expected from the fields the pages were written from -----------
def _cards_sql() -> str:
    from contactlake.sources.fixtures import LISTING_CARDS_SQL, duckdb_sql
    return "WITH lc AS (" + duckdb_sql(LISTING_CARDS_SQL).strip() + ")"


@oracle("listing_cards")
def _():
    return (_cards_sql() + ",\nc AS (SELECT *, page_id * 10 + pos AS ord FROM lc WHERE name <> ''),\n"
            + S.validated_stages("c") + "\nSELECT CAST(ord // 10 AS BIGINT) AS page_id, CAST(ord % 10 AS BIGINT) AS pos, "
            "name, phone, email, website, address, category FROM validated")


@oracle("listing_meta")
def _():
    return (_cards_sql() + ",\np AS (SELECT DISTINCT page_id, page_id % 5 + 1 AS page, page_id % 4 <> 3 AS nxt, "
            "CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id * 7 + 1 END AS total FROM lc)\n"
            "SELECT page_id, CAST(page AS BIGINT) AS current_page, nxt AS has_next_page, page > 1 AS has_previous_page, "
            "CAST(CASE WHEN total > 0 THEN ceil(total / 10.0::DOUBLE) ELSE page + CASE WHEN nxt THEN 1 ELSE 0 END END AS BIGINT) AS total_pages, "
            "CAST(total AS BIGINT) AS total_results FROM p")


@oracle("page_text")
def _():
    return (duckdb_fixture_ctes("site_pages") + ",\n" + _text_stages("site_pages", "page_id, url, html")
            + "\nSELECT page_id, txt AS text FROM t3")


@oracle("broken_page_elements")
def _():
    from contactlake.sources.fixtures import BROKEN_FIELDS_SQL, duckdb_sql
    return ("WITH f AS (" + duckdb_sql(BROKEN_FIELDS_SQL).strip() + ") SELECT page_id, CASE page_id % 10 "
            "WHEN 2 THEN a || ' < ' || b || ' <3 ' || c WHEN 6 THEN a || '<b>' || b || c ELSE a || b || c END AS text, "
            "CASE page_id % 10 WHEN 7 THEN '/1?x=1&y=2 /2' ELSE '' END AS links, "
            "CASE page_id % 10 WHEN 0 THEN '0:' || a || b || c || '|1:' || b || '|1:' || c WHEN 1 THEN '0:' || c "
            "WHEN 4 THEN '0:' || a || '|0:' || b || '|0:' || c WHEN 8 THEN '0:' || a || '|0:' || b || '|0:' || c "
            "WHEN 9 THEN '0:' || a || '|0:' || b ELSE '' END AS items FROM f")


# --- custom-site flow --------------------------------------------------------------
def _custom_sql() -> str:
    """CTEs ending in ``errs`` (ord, url, error, category) and ``kept`` (rows)."""
    err = ("CASE WHEN NOT up_valid THEN 'Invalid URL: Invalid URL' WHEN NOT contains(up_host, '.') "
           "THEN 'Invalid URL: Invalid domain format' WHEN contains(up_host, 'localhost') OR contains(up_host, '127.0.0.1') "
           "OR regexp_matches(up_host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+\\z') THEN 'Invalid URL: Local URLs not supported' END")
    from contactlake.sources.fixtures import URL_INPUTS_SQL, duckdb_sql
    ui = "url_inputs AS (" + duckdb_sql(URL_INPUTS_SQL).strip() + ")"
    return (_recursive(site_contacts_sql().replace("WITH ", "WITH " + ui + ",\n", 1))
            + ", bv AS (" + ORACLE["business_verdict"] + "),\n"
            + f"u AS (SELECT ord, raw, 'https://' || {S.strip_prefix('lower(' + S.js_trim('raw') + ')')} AS cleaned "
              f"FROM url_inputs WHERE {S.js_trim('raw')} <> ''),\n"
            + S.url_parts_stages("u", "cleaned", "up") + ",\n"
            + f"ue AS (SELECT ord, raw, cleaned, {err} AS err FROM up6),\n"
            + "okl AS (SELECT ord, raw, cleaned FROM ue WHERE err IS NULL),\n"
            + S.normalized_website_stages("okl", "cleaned", "site", "cw") + ",\n"
            + S.normalized_website_stages("site_pages", "url", "p_site", "pw") + ",\n"
            + "pid AS (SELECT p_site, min(page_id) AS page_id FROM pw7 WHERE p_site IS NOT NULL GROUP BY p_site),\n"
            "ft AS (SELECT c.*, pid.page_id, bv.is_valid FROM cw7 c LEFT JOIN pid ON c.site = pid.p_site "
            "LEFT JOIN bv ON bv.page_id = pid.page_id),\n"
            "errs AS (SELECT ord, raw AS url, err AS error, 'validation' AS category FROM ue WHERE err IS NOT NULL "
            "UNION ALL SELECT ord, raw, 'Invalid URL format: ' || cleaned, 'validation' FROM ft WHERE site IS NULL "
            "UNION ALL SELECT ord, raw, site || ': fetch failed', 'unknown' FROM ft WHERE site IS NOT NULL AND page_id IS NULL "
            "UNION ALL SELECT ord, raw, 'Does not appear to be a business website', 'content' FROM ft WHERE page_id IS NOT NULL AND NOT is_valid),\n"
            "asm AS (SELECT ft.ord, 'Unknown Business' AS name, coalesce(sc.phones[1], '') AS phone, coalesce(sc.emails[1], '') AS email, "
            "ft.site AS website, 'Springfield' AS address, 'Retail' AS category FROM ft JOIN sc ON sc.page_id = ft.page_id WHERE ft.is_valid),\n"
            + S.validated_stages("asm", "va") + ",\n" + _walk("validated")
            + ", kept AS (SELECT * FROM validated WHERE ord IN (SELECT ord FROM kept_ords))\n")


@oracle("custom_scrape_rows")
def _():
    return _custom_sql() + f"SELECT {BCOLS} FROM kept"


@oracle("custom_scrape_errors")
def _():
    return _custom_sql() + "SELECT *, url || ': ' || error AS line FROM errs"


@oracle("run_summary")
def _():
    cats = ["validation", "network", "content", "timeout", "unknown"]
    return (_custom_sql() + "SELECT (SELECT count(*) FROM okl) AS total, (SELECT count(*) FROM kept) AS successful, "
            "(SELECT count(*) FROM errs) AS failed, "
            + ", ".join(f"(SELECT count(*) FROM errs WHERE category = {q(c)}) AS n_{c}" for c in cats))


@oracle("flagship_coverage")
def _():
    both = _enriched_sql("email").rsplit("SELECT ", 1)[0]
    pred = lambda f: f"coalesce(b.website, '') <> '' AND coalesce(b.{f}, '') = '' AND starts_with(b.website, 'http')"
    return (_recursive(both) + ", en AS (SELECT b.ord, b.name, CASE WHEN " + pred("phone") + " THEN coalesce(f.phone, b.phone) ELSE b.phone END AS phone, "
            "CASE WHEN " + pred("email") + " THEN coalesce(f.email, b.email) ELSE b.email END AS email, b.website, b.address, b.category "
            "FROM pb7 b LEFT JOIN fs f ON b.b_site = f.site),\n" + S.validated_stages("en", "vf") + ",\n" + _walk("validated")
            + f"SELECT count(*) AS total, count_if({_nb('phone')}) AS with_phone, count_if({_nb('email')}) AS with_email, "
              f"count_if({_nb('website')}) AS with_website FROM validated WHERE ord IN (SELECT ord FROM kept_ords)")


# --- export texts -------------------------------------------------------------------
EXPORT_ORDER = [("name", "Business Name"), ("category", "Category"), ("phone", "Phone"), ("email", "Email"),
                ("website", "Website"), ("address", "Address")]


@oracle("export_csv_lines")
def _():
    f = lambda c: (f"CASE WHEN contains({c}, ',') OR contains({c}, chr(34)) OR contains({c}, chr(10)) OR contains({c}, chr(13)) "  # noqa: E731
                   f"THEN chr(34) || replace({c}, chr(34), chr(34) || chr(34)) || chr(34) ELSE {c} END")
    return _validated() + "SELECT ord, " + " || ',' || ".join(f(c) for c, _ in EXPORT_ORDER) + " AS line FROM validated"


@oracle("export_json_objects")
def _():
    body = " || ',' || chr(10) || ".join(f"'    \"{c}\": ' || CAST(to_json({c}) AS VARCHAR)" for c, _ in EXPORT_ORDER)
    return _validated() + f"SELECT ord, '  {{' || chr(10) || {body} || chr(10) || '  }}' AS object FROM validated"


@oracle("export_txt_blocks")
def _():
    rows = " || ".join(f"'{lab}: ' || CASE WHEN {c} <> '' THEN {c} ELSE 'N/A' END || chr(10)" for c, lab in EXPORT_ORDER)
    return (_validated() + ", n AS (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM validated "
            f"WHERE NOT {_nb('website')})\nSELECT ord, 'Business ' || CAST(i AS VARCHAR) || ':' || chr(10) || repeat('=', 21) || chr(10) || {rows} AS block FROM n")


# --- model cascade and list keys ------------------------------------------------------
@oracle("model_cascade")
def _():
    from contactlake.sources.fixtures import MODEL_RESULTS_SQL, duckdb_sql
    mr = "mr AS (" + duckdb_sql(MODEL_RESULTS_SQL).strip() + ")"
    return (site_contacts_sql() + f", {mr},\n"
            f"b AS (SELECT url, {best_email_expr()} AS be, {best_phone_expr()} AS bp FROM sc),\n"
            + S.normalized_website_stages("b", "url", "b_site", "mb") + ",\n" + S.normalized_website_stages("mr", "url", "m_site", "mm") + ",\n"
            "m1 AS (SELECT m_site, first(email ORDER BY url) AS email, first(phone ORDER BY url) AS phone, first(conf_emails ORDER BY url) AS ce, "
            "first(conf_phones ORDER BY url) AS cp FROM mm7 WHERE m_site IS NOT NULL GROUP BY m_site),\n"
            "j AS (SELECT b.*, m1.*, m_site IS NOT NULL AS has, coalesce(ce, 0.6::DOUBLE) AS e, coalesce(cp, 0.6::DOUBLE) AS p FROM mb7 b LEFT JOIN m1 ON b.b_site = m1.m_site)\n"
            f"SELECT url, coalesce(CASE WHEN {S.valid_email('email')} THEN email END, be, '') AS email, coalesce({S.valid_phone('phone')}, bp, '') AS phone, "
            "CASE WHEN has THEN 'ai' ELSE 'traditional' END AS method, (e + p) / 2 AS confidence, "
            "CAST(floor((e + p) / 2 * 100 + 0.5) AS BIGINT) AS confidence_pct FROM j")


@oracle("url_set_keys")
def _():
    return ("SELECT split_part(url, '/', 3) AS host, sha256(array_to_string(list_sort(list(url)), '|')) AS key "
            "FROM pages GROUP BY 1")
