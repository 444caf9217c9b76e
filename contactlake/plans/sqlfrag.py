"""DuckDB SQL fragments for the oracle queries.

The oracle is an independent restatement of each operator in plain SQL for
DuckDB (RE2 regexes, no look-arounds, DuckDB lambdas).  These helpers only
spell recurring expressions once; they produce SQL text, nothing else.
"""

from __future__ import annotations

from contactlake.functions import html as H
from contactlake.functions.text import JSWS_RE2
from contactlake.functions.validate import (DISPOSABLE_DOMAINS, FAKE_LOCAL_PARTS,
                                            FAKE_PHONE_DIGITS)

WS = JSWS_RE2


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^[' + WS + ']+|[' + WS + ']+\\z')}, '', 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q('[' + WS + ']+')}, ' ', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


# --- plain HTML patterns of the oracle (its pages are written well-formed) ----
TAG_RE = r"""<[A-Za-z/!?](?:"[^"]*"|'[^']*'|[^'">]+)*>"""
DANGLING_TAG_RE = r"<[A-Za-z/!?][^>]*\z"
A_TAG_RE = r"""(?i)<a[\t\n\f\r /](?:"[^"]*"|'[^']*'|[^'">]+)*>"""
# One attribute: name, optional "= value" (quoted or bare).
ATTR_RE = r"""([^\t\n\f\r />"'=]+)(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"|'[^']*'|[^\t\n\f\r >]+))?"""
BODY_RE = r"(?is)^.*?(<body\b.*)\z"
HEAD_RE = r"(?is)<head\b.*?(?:</head\b[^>]*>|\z)|<title\b.*?(?:</title\b[^>]*>|\z)"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)(?:</title\b[^>]*>|\z)"


def removal_regex(tags) -> str:
    """Comments plus every listed element with its content (to the end of
    input where the end tag is missing)."""
    return "(?is)" + "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{t}\b[^>]*>.*?(?:</{t}\b[^>]*>|\z)" for t in tags)])


def decode_named(x: str) -> str:
    for ent, ch in H.NAMED_ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def decode_all(x: str) -> str:
    """Named references, the other references that the fixtures hold (literal
    expected values from the HTML standard), then ``&amp;``."""
    x = decode_named(x)
    for ref, ch in [("&eacute;", "é"), ("&#9999999;", "\ufffd"), ("&#xFFFFFF;", "\ufffd"), ("&#55296;", "\ufffd"),
                    ("&#0;", "\ufffd"), ("&#150;", "–"), ("&#233;", "é"), ("&#99999999999999999999;", "\ufffd")]:
        x = f"replace({x}, {q(ref)}, {q(ch)})"
    return f"replace({x}, '&amp;', '&')"


def strip_tags(x: str) -> str:
    inner = f"regexp_replace({x}, {q(TAG_RE)}, '', 'g')"
    return f"regexp_replace({inner}, {q(DANGLING_TAG_RE)}, '', 'g')"


EMAIL_TEXT_RE2 = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_SHAPE_RE2 = "^[^" + WS + "@]+@[^" + WS + "@]+\\.[^" + WS + "@]+\\z"
S_RE2 = "[" + WS + "]"
SEP_RE2 = "[-." + WS + "]"
PHONE_P1_RE2 = r"\(\d{3}\)" + S_RE2 + r"*\d{3}" + SEP_RE2 + r"*\d{4}"
PHONE_RES_RE2 = [
    r"\d{3}" + SEP_RE2 + r"\d{3}" + SEP_RE2 + r"\d{4}",
    r"\d{3}\.\d{3}\.\d{4}",
    r"\+1" + S_RE2 + r"*\d{3}" + S_RE2 + r"*\d{3}" + S_RE2 + r"*\d{4}",
    r"1" + SEP_RE2 + r"*800" + SEP_RE2 + r"*\d{3}" + SEP_RE2 + r"*\d{4}",
]


def phone_res_re2(strict: bool = False):
    return ([] if strict else [PHONE_P1_RE2]) + PHONE_RES_RE2


def weak_email(x: str) -> str:
    return f"(regexp_matches({x}, {q(EMAIL_SHAPE_RE2)}) AND length({x}) <= 254)"


def weak_phone(x: str) -> str:
    return f"(length({digits(x)}) BETWEEN 7 AND 15)"


def valid_email(x: str) -> str:
    dom = f"lower(split_part({x}, '@', 2))"
    disp = ", ".join(q(d) for d in DISPOSABLE_DOMAINS)
    fake = q("(?i)^(" + "|".join(FAKE_LOCAL_PARTS) + ")@")
    return (f"(coalesce({x}, '') <> '' AND regexp_matches({x}, {q(EMAIL_SHAPE_RE2)}) "
            f"AND NOT (strpos({x}, '@') > 0 AND {dom} IN ({disp})) "
            f"AND NOT regexp_matches({x}, {fake}) AND length({x}) <= 254)")


def valid_phone(x: str) -> str:
    """V1 on a SQL expression (RE2 has no back-reference: seven equal digits
    are spelled out)."""
    d = digits(x)
    rep = "|".join(f"{i}{{7}}" for i in range(10))
    fake = ", ".join(q(f) for f in FAKE_PHONE_DIGITS)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN NULL "
            f"WHEN length({d}) < 7 OR length({d}) > 15 THEN NULL "
            f"WHEN regexp_matches({d}, {q(rep)}) THEN NULL "
            f"WHEN {d} IN ({fake}) THEN NULL "
            f"WHEN length({d}) = 10 THEN CASE WHEN substr({d},1,1) IN ('0','1') THEN NULL "
            f"ELSE '(' || substr({d},1,3) || ') ' || substr({d},4,3) || '-' || substr({d},7,4) END "
            f"WHEN length({d}) = 11 AND substr({d},1,1) = '1' THEN CASE WHEN substr({d},2,1) IN ('0','1') "
            f"THEN NULL ELSE '+1 (' || substr({d},2,3) || ') ' || substr({d},5,3) || '-' || substr({d},8,4) END "
            f"ELSE '+' || {d} END")


def ordered_distinct(lst: str) -> str:
    """First occurrences in order (DuckDB's list_distinct does not keep order)."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


QUOTE_STRIP = r"""^"([^"]*)"\z|^'([^']*)'\z"""
A_TAG_TRIM = r"(?is)^<a|>\z"


def href_list(h: str) -> str:
    """href values of ``<a>`` start tags in document order (no look-arounds:
    tags first, then the first href attribute of each)."""
    tags = f"regexp_extract_all({h}, {q(A_TAG_RE)}, 0)"
    inner = f"regexp_replace(t, {q(A_TAG_TRIM)}, '', 'g')"
    names = f"list_transform(regexp_extract_all({inner}, {q(ATTR_RE)}, 1), lambda n: lower(n))"
    vals = f"regexp_extract_all({inner}, {q(ATTR_RE)}, 2)"
    pos = f"list_position({names}, 'href')"
    one = (f"CASE WHEN {pos} > 0 THEN regexp_replace({vals}[{pos}], {q(QUOTE_STRIP)}, "
           f"'\\1\\2') END")
    raw = f"list_filter(list_transform({tags}, lambda t: {one}), lambda v: v IS NOT NULL)"
    return f"list_transform({raw}, lambda v: {decode_all('v')})"


# --- dedup features (D1-D8) --------------------------------------------------
from contactlake.functions.similarity import (NAME_SUFFIXES, STREET_WORDS,  # noqa: E402
                                              WEIGHTS)
from contactlake.functions.hosts import FORBIDDEN_DOMAIN as FORBIDDEN_HOST  # noqa: E402
from contactlake.functions.urls import URL_RE  # noqa: E402

# Dotted IPv4 hosts; the oracle's URLs have no other number forms.
IP_RE = r"^0*([0-9]{1,3})\.0*([0-9]{1,3})\.0*([0-9]{1,3})\.0*([0-9]{1,3})\z"

PUNCT_RE2 = "[^A-Za-z0-9_" + WS + "]"


def _finish_norm(x: str) -> str:
    return js_trim(collapse_ws(x))


def norm_name(x: str) -> str:
    s = f"regexp_replace(lower(coalesce({x}, '')), {q(PUNCT_RE2)}, '', 'g')"
    s = f"regexp_replace({s}, {q(chr(92) + 'b(' + '|'.join(NAME_SUFFIXES) + ')' + chr(92) + 'b')}, '', 'g')"
    return _finish_norm(s)


def norm_addr(x: str) -> str:
    s = f"regexp_replace(lower(coalesce({x}, '')), {q(chr(92) + 'b(' + '|'.join(STREET_WORDS) + ')' + chr(92) + 'b')}, '', 'g')"
    s = f"regexp_replace({s}, {q(PUNCT_RE2)}, '', 'g')"
    return _finish_norm(s)


def url_host_stages(src: str, col: str, out: str, prefix: str) -> str:
    """CTE stages adding ``out`` = U3 host of column ``col`` (null if the URL
    does not parse) to every row of ``src``; last stage is ``{prefix}3``."""
    full = f"CASE WHEN starts_with({col}, 'http') THEN {col} ELSE 'https://' || {col} END"
    s = (f"regexp_replace(regexp_replace({full}, '[\\t\\n\\r]', '', 'g'), "
         f"{q('^[' + chr(92) + 'x00-' + chr(92) + 'x20]+|[' + chr(92) + 'x00-' + chr(92) + 'x20]+' + chr(92) + 'z')}, '', 'g')")
    return (
        f"{prefix}1 AS (SELECT *, {s} AS __s FROM {src}),\n"
        f"{prefix}2 AS (SELECT *, lower(regexp_extract(__s, {q(URL_RE)}, 1)) AS __sch, "
        f"regexp_replace(regexp_extract(__s, {q(URL_RE)}, 2), '(?s)^.*@', '') AS __hp FROM {prefix}1),\n"
        f"{prefix}3 AS (SELECT * EXCLUDE (__s, __sch, __hp, __h, __p), CASE "
        f"WHEN coalesce({col}, '') = '' THEN NULL "
        f"WHEN __sch NOT IN ('http', 'https') OR __h = '' OR regexp_matches(__h, {q(FORBIDDEN_HOST)}) THEN NULL "
        f"WHEN contains(__hp, ':') AND __p <> '' AND NOT (regexp_matches(__p, '^[0-9]{{1,5}}\\z') "
        f"AND TRY_CAST(__p AS INTEGER) <= 65535) THEN NULL "
        f"WHEN regexp_matches(__h, '(^|\\.)[0-9]+\\z') THEN CASE WHEN regexp_matches(__h, {q(IP_RE)}) AND "
        f"greatest(TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 1) AS BIGINT), TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 2) AS BIGINT), "
        f"TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 3) AS BIGINT), TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 4) AS BIGINT)) <= 255 "
        f"THEN CAST(TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 1) AS BIGINT) AS VARCHAR) || '.' || "
        f"CAST(TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 2) AS BIGINT) AS VARCHAR) || '.' || "
        f"CAST(TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 3) AS BIGINT) AS VARCHAR) || '.' || "
        f"CAST(TRY_CAST(regexp_extract(__h, {q(IP_RE)}, 4) AS BIGINT) AS VARCHAR) END "
        f"ELSE __h END AS {out} FROM (SELECT *, lower(regexp_extract(__hp, '^([^:]*)', 1)) AS __h, "
        f"regexp_extract(__hp, '(?s):(.*)\\z', 1) AS __p FROM {prefix}2))")


def dedup_feature_stages(src: str, prefix: str = "df") -> str:
    """CTE stages ending in ``{prefix}f`` with ord, name, phone, email,
    website, address, category, nname, naddr, pd, host, sig."""
    return (url_host_stages(src, "website", "host", prefix) + ",\n"
            f"{prefix}f AS (SELECT *, lower(nname || '|' || pd || '|' || coalesce(host, '')) AS sig FROM "
            f"(SELECT *, {norm_name('name')} AS nname, {norm_addr('address')} AS naddr, "
            f"{digits(chr(99) + 'oalesce(phone, ' + chr(39) * 2 + ')')} AS pd FROM {prefix}3))")


def str_sim(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
            f"ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b}))::DOUBLE "
            f"/ greatest(length({a}), length({b}))::DOUBLE END)")


def pair_score_sql(a: str, b: str) -> str:
    """D8 between row aliases/structs ``a`` and ``b`` (fields as in
    ``dedup_feature_stages``)."""
    phone = (f"(CASE WHEN coalesce({a}.phone, '') = '' OR coalesce({b}.phone, '') = '' THEN 0.0::DOUBLE "
             f"WHEN {a}.pd = {b}.pd THEN 1.0::DOUBLE "
             f"WHEN contains({a}.pd, {b}.pd) OR contains({b}.pd, {a}.pd) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)")
    web = (f"(CASE WHEN coalesce({a}.website, '') = '' OR coalesce({b}.website, '') = '' THEN 0.0::DOUBLE "
           f"WHEN {a}.host IS NULL OR {b}.host IS NULL OR {a}.host = '' OR {b}.host = '' THEN 0.0::DOUBLE "
           f"WHEN {a}.host = {b}.host OR regexp_replace({a}.host, '^www\\.', '') = "
           f"regexp_replace({b}.host, '^www\\.', '') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
    email = (f"(CASE WHEN coalesce({a}.email, '') = '' OR coalesce({b}.email, '') = '' THEN 0.0::DOUBLE "
             f"WHEN {a}.email = {b}.email THEN 1.0::DOUBLE "
             f"WHEN split_part({a}.email, '@', 2) <> '' AND strpos({a}.email, '@') > 0 AND strpos({b}.email, '@') > 0 "
             f"AND split_part({a}.email, '@', 2) = split_part({b}.email, '@', 2) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)")
    w = {k: f"{v!r}::DOUBLE" for k, v in WEIGHTS.items()}
    return (f"({str_sim(a + '.nname', b + '.nname')} * {w['name']} + {phone} * {w['phone']} "
            f"+ {web} * {w['website']} + {str_sim(a + '.naddr', b + '.naddr')} * {w['address']} "
            f"+ {email} * {w['email']})")


# --- URL parsing in SQL (U1/U2/U3/U5) ---------------------------------------
# --- fixed values: ASCII characters the URL standard percent-encodes ----------
PATH_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")]
QUERY_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27")]
FRAGMENT_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60")]

BS = chr(92)


def _esc(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def url_parts_stages(src: str, expr: str, p: str) -> str:
    """CTE stages (last one ``{p}5``) adding ``{p}_valid``, ``{p}_host``,
    ``{p}_href``, ``{p}_origin``, ``{p}_scheme``, ``{p}_path`` for the URL
    string ``expr`` on every row of ``src``."""
    strip = q("^[" + BS + "x00-" + BS + "x20]+|[" + BS + "x00-" + BS + "x20]+" + BS + "z")
    s = f"regexp_replace(regexp_replace({expr}, '[\\t\\n\\r]', '', 'g'), {strip}, '', 'g')"
    ipx = [f"TRY_CAST(regexp_extract({p}_hr, {q(IP_RE)}, {i}) AS BIGINT)" for i in range(1, 5)]
    return (
        f"{p}1 AS (SELECT *, {s} AS {p}_s FROM {src}),\n"
        f"{p}2 AS (SELECT *, lower(regexp_extract({p}_s, {q(URL_RE)}, 1)) AS {p}_scheme, "
        f"regexp_extract({p}_s, {q(URL_RE)}, 2) AS {p}_auth, regexp_extract({p}_s, {q(URL_RE)}, 3) AS {p}_rest "
        f"FROM {p}1),\n"
        f"{p}3 AS (SELECT *, CASE WHEN contains({p}_auth, '@') THEN regexp_extract({p}_auth, '(?s)^(.*)@', 1) END AS {p}_ui, "
        f"regexp_replace({p}_auth, '(?s)^.*@', '') AS {p}_hp FROM {p}2),\n"
        f"{p}4 AS (SELECT *, lower(regexp_extract({p}_hp, '^([^:]*)', 1)) AS {p}_hr, contains({p}_hp, ':') AS {p}_hasp, "
        f"regexp_extract({p}_hp, '(?s):(.*)\\z', 1) AS {p}_pr, "
        f"replace(regexp_extract({p}_rest, '(?s)^([^?#]*)', 1), {q(BS)}, '/') AS {p}_path0, "
        f"regexp_extract({p}_rest, '(?s)^[^?#]*(\\?[^#]*)', 1) AS {p}_query, "
        f"regexp_extract({p}_rest, '(?s)(#.*)\\z', 1) AS {p}_frag FROM {p}3),\n"
        f"{p}5a AS (SELECT *, CASE WHEN regexp_matches({p}_hr, '(^|\\.)[0-9]+\\z') THEN "
        f"CASE WHEN regexp_matches({p}_hr, {q(IP_RE)}) AND greatest({', '.join(ipx)}) <= 255 THEN "
        f"{' || '.join(f'CAST({x} AS VARCHAR)' for x in ipx).replace(' || ', chr(32) + '|| ' + q('.') + ' || ')} END "
        f"ELSE {p}_hr END AS {p}_host0, "
        f"(NOT {p}_hasp OR {p}_pr = '' OR (regexp_matches({p}_pr, '^[0-9]{{1,5}}\\z') AND TRY_CAST({p}_pr AS INTEGER) <= 65535)) AS {p}_portok, "
        f"CASE WHEN {p}_hasp AND {p}_pr <> '' THEN CAST(TRY_CAST({p}_pr AS INTEGER) AS VARCHAR) END AS {p}_pn, "
        f"CASE WHEN {p}_path0 = '' THEN '/' ELSE {p}_path0 END AS {p}_path FROM {p}4),\n"
        f"{p}5 AS (SELECT *, ({p}_scheme IN ('http', 'https') AND {p}_hr <> '' AND NOT regexp_matches({p}_hr, {q(FORBIDDEN_HOST)}) "
        f"AND coalesce({p}_portok, false) AND {p}_host0 IS NOT NULL) AS {p}_valid, "
        f"CASE WHEN {p}_pn IS NOT NULL AND {p}_pn <> CASE {p}_scheme WHEN 'https' THEN '443' WHEN 'http' THEN '80' END "
        f"THEN ':' || {p}_pn ELSE '' END AS {p}_portpart FROM {p}5a),\n"
        f"{p}6 AS (SELECT *, CASE WHEN {p}_valid THEN {p}_host0 END AS {p}_host, "
        f"CASE WHEN {p}_valid THEN {p}_scheme || '://' || coalesce({p}_ui || '@', '') || {p}_host0 || {p}_portpart || "
        f"{_esc(p + '_path', PATH_ESCAPES)} || {_esc(p + '_query', QUERY_ESCAPES)} || {_esc(p + '_frag', FRAGMENT_ESCAPES)} END AS {p}_href, "
        f"CASE WHEN {p}_valid THEN {p}_scheme || '://' || {p}_host0 || {p}_portpart END AS {p}_origin FROM {p}5)")


def url_parts_cols(p: str) -> str:
    """Helper columns of ``url_parts_stages`` to exclude afterwards."""
    return ", ".join(f"{p}_{c}" for c in ["s", "scheme", "auth", "rest", "ui", "hp", "hr", "hasp", "pr", "path0",
                                          "query", "frag", "host0", "portok", "pn", "path", "valid", "portpart",
                                          "host", "href", "origin"])


def strip_prefix(x: str) -> str:
    return f"regexp_replace({x}, '^(https?://)?(www\\.)?', '')"


def normalized_website_stages(src: str, col: str, out: str, p: str) -> str:
    """Stages ending in ``{p}7`` with column ``out`` (href or NULL)."""
    clean = strip_prefix(f"lower({js_trim(col)})")
    dom = f"split_part({p}_c, '/', 1)"
    bad = (f"(NOT contains({dom}, '.') OR ends_with({dom}, '.') OR contains({dom}, 'localhost') "
           f"OR contains({dom}, '127.0.0.1') OR regexp_matches({dom}, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+\\z'))")
    return (f"{p}0a AS (SELECT *, {clean} AS {p}_c FROM {src}),\n"
            f"{p}0 AS (SELECT *, CASE WHEN coalesce({col}, '') = '' OR {bad} THEN NULL ELSE {p}_c END AS {p}_cl FROM {p}0a),\n"
            + url_parts_stages(f"{p}0", f"'https://' || {p}_cl", p) + ",\n"
            f"{p}7 AS (SELECT * EXCLUDE ({p}_c, {p}_cl, {url_parts_cols(p)}), {p}_href AS {out} FROM {p}6)")


def clean_text(x: str, lo: int) -> str:
    t = js_trim(x)
    return (f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN length({t}) < {lo} THEN NULL "
            f"ELSE {collapse_ws(t)} END")


def validated_stages(src: str = "businesses", p: str = "vw") -> str:
    """V6 over ``src`` (ord + six columns): stages ending in ``validated``."""
    return (normalized_website_stages(src, "website", "nsite", p) + ",\n"
            f"validated AS (SELECT ord, coalesce({clean_text('name', 2)}, name, '') AS name, "
            f"coalesce({valid_phone('phone')}, '') AS phone, "
            f"CASE WHEN {valid_email('email')} THEN email ELSE '' END AS email, "
            f"coalesce(nsite, '') AS website, coalesce({clean_text('address', 5)}, '') AS address, "
            f"coalesce({js_trim('category')}, '') AS category FROM {p}7)")
