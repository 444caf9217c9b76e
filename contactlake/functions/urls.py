"""URL functions (U1-U6) as JVM-side column expressions and transforms.

``url_parts`` parses an absolute http(s) URL as the URL standard does:
tab/newline removal, any run of ``/`` or ``\\`` after the scheme, userinfo,
hosts as domains (percent-decoded, Punycode), IPv4 number forms or IPv6
literals, ports, dot segments and the percent-encode sets (``hosts``).

Every parsing stage is bound once per row with ``let`` (a lambda variable),
so each regex runs once and optimizer rules that substitute aliases (filter
pushdown, projection collapsing) cannot copy the parser into several places.
"""

from __future__ import annotations

from typing import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import hosts
from contactlake.functions.text import col_, js_trim, let

LOCAL_HOST_MARKERS = ["localhost", "127.0.0.1"]
IPV4_SHAPE = r"^\d+\.\d+\.\d+\.\d+\z"
# Local-search request template (U6) and its page size.
SEARCH_URL_PREFIX = "https://www.google.com/search?tbm=lcl&q="
SEARCH_URL_SUFFIX = "&hl=en&gl=us&start="
RESULTS_PER_PAGE = 10

URL_RE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)(.*)\z"


def url_parts(src) -> Column:
    """Struct of the parsed URL: scheme, host, port (null if default/absent),
    path, query, fragment, valid (false where a URL parser throws), href,
    origin.  Each parsing stage is bound once per row (``let``)."""
    s0 = F.regexp_replace(F.regexp_replace(col_(src), r"[\t\n\r]", ""),
                          r"^[\x00-\x20]+|[\x00-\x20]+\z", "")

    def split_url(s):
        return let(F.struct(F.lower(F.regexp_extract(s, URL_RE, 1)).alias("scheme"),
                            F.regexp_extract(s, URL_RE, 2).alias("auth"),
                            F.regexp_extract(s, URL_RE, 3).alias("rest")), split_auth)

    def split_auth(m):
        auth = m["auth"]
        return let(F.struct(m["scheme"].alias("scheme"), m["rest"].alias("rest"),
                            F.when(auth.contains("@"), F.regexp_extract(auth, r"(?s)^(.*)@", 1)).otherwise(F.lit("")).alias("userinfo"),
                            F.regexp_replace(auth, r"(?s)^.*@", "").alias("hp")), split_host)

    def split_host(a):
        hp = a["hp"]
        host = F.regexp_extract(hp, r"(?s)^(\[[^\]]*\]|[^:]*)", 1)
        return let(F.struct(a["scheme"].alias("scheme"), a["rest"].alias("rest"), a["userinfo"].alias("userinfo"), host.alias("host"),
                            F.substr(hp, F.length(host) + 1).alias("port")), check)

    def check(h):
        scheme, port, rest = h["scheme"], h["port"], h["rest"]
        number = F.regexp_extract(port, r"^:0*([0-9]{0,5})\z", 1)
        port_ok = (port == "") | port.rlike(r"^:0*[0-9]{0,5}\z") & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 65535)
        port_text = F.when(port.rlike("[0-9]"), F.coalesce(number.try_cast("int"), F.lit(0)).cast("string"))
        default_port = F.when(scheme == "https", "443").when(scheme == "http", "80")
        path = F.replace(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit("\\"), F.lit("/"))
        return let(F.struct(
            scheme.alias("scheme"), h["userinfo"].alias("userinfo"),
            F.when(scheme.isin("http", "https") & port_ok, let(h["host"], hosts.host_of)).alias("host"),
            F.when(port_text != default_port, port_text).alias("port"),
            let(F.when(path == "", F.lit("/")).otherwise(path), hosts.without_dots).alias("path"),
            F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(rest, r"(?s)(#.*)\z", 1).alias("fragment")), assemble)

    def assemble(v):
        valid = v["host"].isNotNull()
        portpart = F.when(v["port"].isNotNull(), F.concat(F.lit(":"), v["port"])).otherwise(F.lit(""))
        origin = F.concat(v["scheme"], F.lit("://"), v["host"], portpart)
        user, password = (F.regexp_extract(v["userinfo"], r"(?s)^([^:]*):?(.*)\z", k) for k in (1, 2))
        coded = lambda c: hosts.percent_encoded(c, hosts.USERINFO_ENCODED)
        login = F.concat(coded(user), F.when(password != "", F.concat(F.lit(":"), coded(password))).otherwise(F.lit("")))
        href = F.concat(v["scheme"], F.lit("://"),
                        F.when(v["userinfo"].rlike(r"(?s)^:?\z"), F.lit("")).otherwise(F.concat(login, F.lit("@"))),
                        v["host"], portpart, hosts.percent_encoded(v["path"], hosts.PATH_ENCODED),
                        F.when(v["query"] == "", F.lit("")).otherwise(hosts.percent_encoded(v["query"], hosts.QUERY_ENCODED)),
                        F.when(v["fragment"] == "", F.lit("")).otherwise(hosts.percent_encoded(v["fragment"], hosts.FRAGMENT_ENCODED)))
        return F.struct(
            v["scheme"].alias("scheme"), v["host"].alias("host"), v["port"].alias("port"),
            v["path"].alias("path"), v["query"].alias("query"), v["fragment"].alias("fragment"),
            valid.alias("valid"), F.when(valid, href).alias("href"), F.when(valid, origin).alias("origin"))

    return let(s0, split_url)


_built: dict = {}


def _parser() -> Column:
    """``url_parts`` of the column ``__url_in``, built once a JVM: the expression
    has thousands of nodes, and building it takes longer than running it on
    small tables."""
    jvm = id(SparkContext._gateway)
    if jvm not in _built:
        _built.clear()
        _built[jvm] = url_parts(F.col("__url_in"))
    return _built[jvm]


def with_url_parts(src, out: str) -> Callable[[DataFrame], DataFrame]:
    """Add struct column ``out`` = ``url_parts(src)``."""
    def t(df: DataFrame) -> DataFrame:
        return df.withColumn("__url_in", col_(src)).withColumn(out, _parser()).drop("__url_in")
    return t


def _strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^(https?://)?(www\.)?", "")


def with_normalized_website(src, out: str) -> Callable[[DataFrame], DataFrame]:
    """U1 ``validateWebsite``: canonical ``https://`` href or null."""
    def t(df: DataFrame) -> DataFrame:
        cl = f"__{out}_clean"
        df = df.withColumn(cl, _strip_prefix(F.lower(js_trim(src))))
        c = F.col(cl)
        dom = F.split_part(c, F.lit("/"), F.lit(1))
        bad = ((~dom.contains(".")) | dom.endswith(".")
               | dom.contains(LOCAL_HOST_MARKERS[0]) | dom.contains(LOCAL_HOST_MARKERS[1])
               | dom.rlike(IPV4_SHAPE))
        df = df.withColumn(cl, F.when(col_(src).isNull() | (col_(src) == "") | bad,
                                      F.lit(None).cast("string")).otherwise(c))
        df = df.transform(with_url_parts(F.concat(F.lit("https://"), F.col(cl)), cl + "_p"))
        return df.withColumn(out, F.col(cl + "_p")["href"]).drop(cl, cl + "_p")
    return t


def with_intake_check(src, cleaned: str, error: str) -> Callable[[DataFrame], DataFrame]:
    """``cleaned`` = ``https://`` + lower-cased line without scheme/``www.``;
    ``error`` = null for accepted lines, else the intake message."""
    def t(df: DataFrame) -> DataFrame:
        df = df.withColumn(cleaned, F.concat(F.lit("https://"), _strip_prefix(F.lower(js_trim(src)))))
        pp = f"__{error}_p"
        df = df.transform(with_url_parts(cleaned, pp))
        p = F.col(pp)
        host = p["host"]
        err = (F.when(~p["valid"], F.lit("Invalid URL: Invalid URL"))
               .when(~host.contains("."), F.lit("Invalid URL: Invalid domain format"))
               .when(host.contains(LOCAL_HOST_MARKERS[0]) | host.contains(LOCAL_HOST_MARKERS[1])
                     | host.rlike(IPV4_SHAPE), F.lit("Invalid URL: Local URLs not supported")))
        return df.withColumn(error, err).drop(pp)
    return t


def with_url_host(src, out: str) -> Callable[[DataFrame], DataFrame]:
    """U3 ``extractDomain``: lower-case hostname or null."""
    def t(df: DataFrame) -> DataFrame:
        c = col_(src)
        full = F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
        pp = f"__{out}_p"
        df = df.transform(with_url_parts(full, pp))
        p = F.col(pp)
        return df.withColumn(out, F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
                             .when(p["valid"], p["host"])).drop(pp)
    return t


def with_resolved_link(page_url, href, out: str) -> Callable[[DataFrame], DataFrame]:
    """Absolute if it starts with ``http``; else page origin joined by ``/``."""
    def t(df: DataFrame) -> DataFrame:
        pp = f"__{out}_p"
        df = df.transform(with_url_parts(page_url, pp))
        origin = F.col(pp)["origin"]
        h = col_(href)
        rel = F.when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(origin, F.lit("/"), h))
        return df.withColumn(out, F.when(h.isNull(), F.lit(None).cast("string"))
                             .when(h.startswith("http"), h).otherwise(rel)).drop(pp)
    return t


def unwrap_redirect(c) -> Column:
    """U4: ``/url?q=<target>&...`` links resolve to the percent-decoded target."""
    c = col_(c)
    m = F.regexp_extract(c, r"url\?q=([^&]+)", 1)
    decoded = F.try_url_decode(F.replace(m, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("/url?") & (m != ""), F.coalesce(decoded, c)).otherwise(c)


def encode_uri_component(c) -> Column:
    """``encodeURIComponent`` from Java's form encoder."""
    e = F.url_encode(col_(c))
    for a, b in [("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def search_request_url(business_type, location, page) -> Column:
    """Local-search request URL for (type, location, page)."""
    business_type, location, page = col_(business_type), col_(location), col_(page)
    q = F.when(F.coalesce(location, F.lit("")) != "",
               F.concat(business_type, F.lit(" in "), location)).otherwise(business_type)
    start = ((page - 1) * RESULTS_PER_PAGE).cast("string")
    return F.concat(F.lit(SEARCH_URL_PREFIX), encode_uri_component(q), F.lit(SEARCH_URL_SUFFIX), start)
