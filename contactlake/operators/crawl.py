"""Crawl-log operators: status messages, error categories, attempt
resolution and redirect chains (E1-E4, J7).

The source handles one fetch at a time; here a crawl log
``(event_id, fetched_at, url, status, location, kind)`` of any size is
resolved with grouped aggregations and joins.  Per-URL "first k attempts"
uses k rounds of a grouped minimum instead of a window over the URL, so a
URL holding a large share of the log is still pre-aggregated map-side rather
than sorted in one task.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlake.functions.text import col_
from contactlake.functions.urls import with_url_parts
from contactlake.session import ensure_checkpoint_dir

# --- fixed values: messages and categories of the error rules --------------
MAX_ATTEMPTS = 3
MAX_REDIRECTS = 5
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
STOP_STATUSES = [403, 404, 429]
# Standard reason phrases used as the status text of other failures.
REASON_PHRASES = {
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 405: "Method Not Allowed",
    406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout",
    409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed",
    413: "Payload Too Large", 414: "URI Too Long", 415: "Unsupported Media Type",
    416: "Range Not Satisfiable", 417: "Expectation Failed", 418: "I'm a Teapot",
    421: "Misdirected Request", 422: "Unprocessable Entity", 425: "Too Early",
    426: "Upgrade Required", 428: "Precondition Required", 431: "Request Header Fields Too Large",
    451: "Unavailable For Legal Reasons",
}
TEXT_TIMEOUT = "Request timeout after 30 seconds"
TEXT_NO_STATUS = "Failed to fetch after retries"
MSG_TIMEOUT = "Website took too long to respond (timeout after 30 seconds)"
MSG_BLOCKED = "Website is blocking automated requests"
MSG_NOT_FOUND = "Website not found (404 error)"
MSG_NOT_BUSINESS = "Does not appear to be a business website"
MSG_SERVER = "Website server error - may be temporarily unavailable"
MSG_QUOTA = "AI service temporarily unavailable - using traditional extraction"


def status_message(status) -> Column:
    """Error text of a non-2xx status (null for 2xx)."""
    s = col_(status)
    phrase = F.coalesce(F.element_at(F.create_map(*[x for k, v in REASON_PHRASES.items()
                                                    for x in (F.lit(k), F.lit(v))]), s), F.lit(""))
    st = s.cast("string")
    return (F.when((s >= 200) & (s < 300), F.lit(None).cast("string"))
            .when(s.isin(403, 429), F.concat(F.lit("Access denied ("), st,
                                             F.lit("): Website may be blocking automated requests")))
            .when(s == 404, F.lit("Page not found (404): Website may not exist"))
            .when(s >= 500, F.concat(F.lit("Server error ("), st,
                                     F.lit("): Website may be temporarily unavailable")))
            .otherwise(F.concat(F.lit("HTTP "), st, F.lit(": "), phrase)))


def with_error_category(message, status=None, strict: bool = False,
                        out_category: str = "category",
                        out_message: str = "error_message") -> Callable[[DataFrame], DataFrame]:
    """Ordered rules over the error text -> (category, reported message).

    ``strict`` applies every rule to the whole text, as the source does (so
    any '5' in it, e.g. in the URL, means "server error").  The default keeps
    that rule for texts without a status and otherwise decides it by the
    status (>= 500) when one is given.
    """
    def t(df: DataFrame) -> DataFrame:
        m = col_(message)
        if strict or status is None:
            server = m.contains("Server error") | m.contains("5")
        else:
            s = col_(status)
            server = m.contains("Server error") | F.coalesce(s >= 500, m.contains("5"))
        rules = [
            (m.contains("timeout") | m.contains("Request timeout"), "timeout", F.lit(MSG_TIMEOUT)),
            (m.contains("Access denied") | m.contains("403") | m.contains("429"), "network", F.lit(MSG_BLOCKED)),
            (m.contains("404") | m.contains("not found"), "network", F.lit(MSG_NOT_FOUND)),
            (m.contains("Not a business website"), "content", F.lit(MSG_NOT_BUSINESS)),
            (m.contains("Invalid URL"), "validation", m),
            (server, "network", F.lit(MSG_SERVER)),
            (m.contains("quota") | m.contains("exceeded"), "network", F.lit(MSG_QUOTA)),
        ]
        cat = F.lit("unknown")
        msg = m
        for cond, c, new in reversed(rules):
            cat = F.when(cond, F.lit(c)).otherwise(cat)
            msg = F.when(cond, new).otherwise(msg)
        return df.withColumn(out_category, cat).withColumn(out_message, msg)
    return t


def error_line(url, error) -> Column:
    """``url: error``."""
    return F.concat_ws(": ", col_(url), col_(error))


def first_k_per_key(df: DataFrame, key: str, order: list[str], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per ``key`` by ``order``, ranked 1..k.

    Spark puts a group limit before the shuffle, so at most ``k`` rows of a
    key leave a map task, however hot the key is; one scan, one exchange.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def is_success(status) -> Column:
    """Never null: an attempt without a status is no success."""
    s = col_(status)
    return F.coalesce((s >= 200) & (s < 300), F.lit(False))


def attempt_outcome(log: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per URL over its first ``attempts`` attempts (by fetched_at,
    event_id): the first success wins; 403/404/429 and a timeout stop at once;
    else the last error.

    Returns (url, attempts, final_attempt, status, ok, message).
    """
    a = first_k_per_key(log.select("url", "fetched_at", "event_id", "status", "timed_out"), "url",
                        ["fetched_at", "event_id"], attempts, "attempt")
    late = F.coalesce("timed_out", F.lit(False))
    decisive = is_success("status") | F.coalesce(F.col("status").isin(*STOP_STATUSES), F.lit(False)) | late
    row = F.struct("attempt", "status", late.alias("late"))
    g = a.groupBy("url").agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(decisive, row)).alias("d"), F.max(row).alias("last"))
    fin = F.coalesce(F.col("d"), F.col("last"))
    out = g.select("url", F.col("attempts").cast("bigint").alias("attempts"),
                   fin["attempt"].cast("bigint").alias("final_attempt"),
                   fin["status"].cast("bigint").alias("status"), fin["late"].alias("late"))
    message = (F.when(is_success("status"), F.lit("")).when(F.col("late"), F.lit(TEXT_TIMEOUT))
               .otherwise(F.coalesce(status_message("status"), F.lit(TEXT_NO_STATUS))))
    return out.withColumn("ok", is_success("status")).withColumn("message", message).drop("late")


def latest_per_url(log: DataFrame) -> DataFrame:
    """Last row per URL (by fetched_at, event_id): one grouped maximum."""
    g = log.groupBy("url").agg(F.max(F.struct("fetched_at", "event_id", "status", "location")).alias("l"))
    return g.select("url", "l.fetched_at", "l.event_id", "l.status", "l.location")


def resolve_location(current, location, out: str = "__next") -> Callable[[DataFrame], DataFrame]:
    """Redirect target: absolute if it starts with ``http``; ``//host`` takes
    the scheme, ``/path`` the origin, ``?query`` the path, ``#part`` the page;
    anything else the current directory."""
    def t(df: DataFrame) -> DataFrame:
        df = df.transform(with_url_parts(current, "__cur"))
        loc, cur = col_(location), F.col("__cur")
        page = F.concat(cur["origin"], cur["path"])
        nxt = (F.when(loc.startswith("http"), loc)
               .when(loc.startswith("//"), F.concat(cur["scheme"], F.lit(":"), loc))
               .when(loc.startswith("/"), F.concat(cur["origin"], loc))
               .when(loc.startswith("?"), F.concat(page, loc))
               .when(loc.startswith("#"), F.concat(page, cur["query"], loc))
               .otherwise(F.concat(F.regexp_replace(page, r"[^/]*\z", ""), loc)))
        return df.withColumn(out, nxt).drop("__cur")
    return t


def redirect_targets(log: DataFrame, starts: DataFrame | None = None, redirects: int = MAX_REDIRECTS) -> DataFrame:
    """J7 on the last status of every URL: follow 301/302/303/307/308 with a
    Location, at most ``redirects`` times (one fetch more than that).

    One frame holds all rows; each step joins it to the materialised last
    status per URL.  Rows that are done get a key of their own that matches
    nothing, so they do not meet in one partition.

    Returns (url, final_url, hops, status, outcome) where outcome is ``ok``
    or the error text.
    """
    ensure_checkpoint_dir(log.sparkSession)
    last = latest_per_url(log).select(F.col("url").alias("k_url"), F.col("status").alias("k_status"),
                                      F.col("location").alias("k_loc")).checkpoint(eager=True)
    if starts is None:
        cur = last.select(F.col("k_url").alias("url"), F.col("k_url").alias("at"), F.lit(0).alias("hops"),
                          F.col("k_status").alias("status"), F.col("k_loc").alias("loc"))
    else:
        cur = starts.select("url").join(last, F.col("url") == F.col("k_url"), "left").select(
            "url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.col("k_status").alias("status"), F.col("k_loc").alias("loc"))
    st = F.col("status")
    is_redirect = F.coalesce(st.isin(*REDIRECT_STATUSES), F.lit(False))
    pending = is_redirect & (F.coalesce(F.col("loc"), F.lit("")) != "")
    for _ in range(redirects):
        cur = (cur.withColumn("__go", pending).transform(resolve_location("at", "loc"))
               .withColumn("__key", F.when(F.col("__go"), F.col("__next")).otherwise(F.concat(F.lit("\u0000"), "url"))))
        go = F.col("__go")
        cur = cur.join(last, F.col("__key") == F.col("k_url"), "left").select(
            "url", F.when(go, F.col("__next")).otherwise(F.col("at")).alias("at"),
            (F.col("hops") + go.cast("int")).alias("hops"),
            F.when(go, F.col("k_status")).otherwise(st).alias("status"),
            F.when(go, F.col("k_loc")).otherwise(F.col("loc")).alias("loc"))
    cur = cur.withColumn("__go", pending).transform(resolve_location("at", "loc"))
    outcome = (F.when(st.isNull(), F.lit("fetch failed"))
               .when(is_success(st), F.lit("ok"))
               .when(F.col("__go"), F.concat(F.lit("Too many redirects when fetching "), F.col("url")))
               .when(is_redirect, F.concat(F.lit("Redirect ("), st.cast("string"), F.lit(") without Location header")))
               .otherwise(F.concat(F.lit("Failed to fetch ("), st.cast("string"), F.lit(")"))))
    return cur.select("url", F.when(F.col("__go"), F.col("__next")).otherwise(F.col("at")).alias("final_url"),
                      (F.col("hops") + F.col("__go").cast("int")).cast("bigint").alias("hops"),
                      st.cast("bigint").alias("status"), outcome.alias("outcome"))
