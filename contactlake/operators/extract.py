"""Contact extraction and business scoring over a page corpus.

Input: any DataFrame with a URL column and an HTML column (the page corpus).
Everything is a narrow, per-row transform: no shuffle, evaluated in the scan
stage.  Results are ordered distinct lists (``array_distinct`` keeps first
occurrences), matching the insertion-ordered sets of the source.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import html as H
from contactlake.functions.text import JSWS, WB, col_, digits_only, js_trim
from contactlake.functions.urls import with_resolved_link, with_url_host
from contactlake.functions.validate import (is_valid_email_weak, is_valid_phone_weak,
                                            validate_email, validate_phone)

# --- fixed values: extraction patterns, filters and caps -------------------
EMAIL_TEXT_RE = WB + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + WB
_S = f"[{JSWS}]"
_SEP = f"[-.{JSWS}]"
# Phone text patterns in the order they are applied.  P1 is the intended
# "(123) 456-7890" form; strict mode omits it, as the source's P1 never matches.
PHONE_P1 = r"\(\d{3}\)" + _S + r"*\d{3}" + _SEP + r"*\d{4}"
PHONE_TEXT_RES = [
    r"\d{3}" + _SEP + r"\d{3}" + _SEP + r"\d{4}",
    r"\d{3}\.\d{3}\.\d{4}",
    r"\+1" + _S + r"*\d{3}" + _S + r"*\d{3}" + _S + r"*\d{4}",
    r"1" + _SEP + r"*800" + _SEP + r"*\d{3}" + _SEP + r"*\d{4}",
]
EMAIL_BLOCKLIST = ["example.com", "yourdomain", "domain.com", "test@", "sample@"]
FAKE_PHONE_SUBSTRINGS = ["1234567890", "0000000000"]
CONTACT_LINK_KEYWORDS = ["contact", "Contact"]

BUSINESS_INDICATORS = [
    (["contact us", "contact"], 15),
    (["about us", "about"], 10),
    (["services", "our services"], 12),
    (["products", "our products"], 10),
    (["phone", "call us", "telephone"], 10),
    (["email", "contact@", "info@"], 10),
]
BUSINESS_MIN_SCORE = 25
NON_BUSINESS_HOSTS = [
    "craigslist.org", "facebook.com", "twitter.com", "instagram.com", "linkedin.com",
    "youtube.com", "google.com", "amazon.com", "ebay.com", "wikipedia.org",
    "reddit.com", "pinterest.com", "tiktok.com", "snapchat.com", "github.com",
]
TRADITIONAL_CONFIDENCE = 0.6


def phone_patterns(strict: bool = False) -> list[str]:
    return ([] if strict else [PHONE_P1]) + PHONE_TEXT_RES


def _empty_str_array() -> Column:
    return F.array().cast("array<string>")


def email_text_matches(text) -> Column:
    """Raw text matches of the e-mail pattern (pre-filtered on '@')."""
    t = col_(text)
    return F.when(t.contains("@"), F.regexp_extract_all(t, F.lit(EMAIL_TEXT_RE), 0)) \
        .otherwise(_empty_str_array())


def emails_from(hrefs, text, blocklist: Sequence[str] = EMAIL_BLOCKLIST,
                limit: int | None = None) -> Column:
    """T3 list: mailto links then text matches, weakly valid, lower-cased,
    ordered distinct, minus blocklisted substrings; only the first ``limit`` if given (L3)."""
    mailto = F.transform(
        F.filter(col_(hrefs), lambda h: h.startswith("mailto:")),
        lambda h: js_trim(F.split_part(F.regexp_replace(h, "^mailto:", ""), F.lit("?"), F.lit(1))))
    found = F.concat(F.filter(mailto, is_valid_email_weak),
                     F.filter(email_text_matches(text), is_valid_email_weak))
    out = F.array_distinct(F.transform(found, lambda e: F.lower(e)))
    if blocklist:
        out = F.filter(out, lambda e: ~F.exists(
            F.array(*[F.lit(b) for b in blocklist]), lambda b: e.contains(b)))
    return F.slice(out, 1, limit) if limit else out


def phones_from(hrefs, text, strict: bool = False, limit: int | None = None) -> Column:
    """T4 list: tel links, then each text pattern in turn; raw strings, ordered
    distinct; 10-15 digits and no fake run; only the first ``limit`` if given (L3)."""
    tel = F.transform(F.filter(col_(hrefs), lambda h: h.startswith("tel:")),
                      lambda h: js_trim(F.regexp_replace(h, "^tel:", "")))
    parts = [F.filter(tel, is_valid_phone_weak)]
    t = col_(text)
    for p in phone_patterns(strict):
        parts.append(F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), 0), js_trim),
                              is_valid_phone_weak))
    out = F.array_distinct(F.concat(*parts))

    def keep(ph: Column) -> Column:
        n = F.length(digits_only(ph))
        ok = (n >= 10) & (n <= 15)
        for s in FAKE_PHONE_SUBSTRINGS:
            ok = ok & ~ph.contains(s)
        return ok
    out = F.filter(out, keep)
    return F.slice(out, 1, limit) if limit else out


def first_valid_email(emails) -> Column:
    """First entry passing the full e-mail validator."""
    return F.get(F.filter(col_(emails), validate_email), 0)


def first_valid_phone(phones) -> Column:
    """First entry the phone validator formats (formatted value)."""
    return F.get(F.filter(F.transform(col_(phones), validate_phone), lambda p: p.isNotNull()), 0)


def with_contacts(url: str = "url", html: str = "html", strict: bool = False,
                  blocklist: Sequence[str] = EMAIL_BLOCKLIST, hrefs_out: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Add ``emails`` (T3) and ``phones`` (T4) for every page; ``hrefs_out``
    keeps the page's hrefs for T7.  The page is stripped once.

    Pages whose URL does not start with ``http`` give empty lists (S1).
    """
    def t(df: DataFrame) -> DataFrame:
        df = df.withColumn("__parts", H.page_parts(html))
        text, hrefs = F.col("__parts.text"), F.col("__parts.hrefs")
        ok = F.coalesce(col_(url).startswith("http"), F.lit(False))
        df = df.withColumn("emails", F.when(ok, emails_from(hrefs, text, blocklist))
                           .otherwise(_empty_str_array()))
        df = df.withColumn("phones", F.when(ok, phones_from(hrefs, text, strict))
                           .otherwise(_empty_str_array()))
        if hrefs_out:
            df = df.withColumn(hrefs_out, hrefs)
        return df.drop("__parts")
    return t


def with_contact_link(url: str = "url", html: str = "html",
                      keywords: Sequence[str] = CONTACT_LINK_KEYWORDS,
                      out: str = "contact_url", hrefs: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """T7 + U5: first anchor (document order) whose href has a keyword, resolved
    against the page origin; ``hrefs`` names a column that holds the hrefs
    already (else the page is read for them)."""
    def t(df: DataFrame) -> DataFrame:
        if hrefs is None:
            df = df.transform(H.with_anchor_hrefs(html, "__khrefs"))
        first = F.get(F.filter(F.col(hrefs or "__khrefs"), lambda h: F.exists(
            F.array(*[F.lit(k) for k in keywords]), lambda k: h.contains(k))), 0)
        df = df.withColumn("__khref", first)
        return df.transform(with_resolved_link(url, "__khref", out)).drop("__khrefs", "__khref")
    return t


def with_business_score(html: str = "html", out: str = "score") -> Callable[[DataFrame], DataFrame]:
    """struct(points, is_valid, confidence, reasons) from indicator terms in
    the lower-cased body text (nothing removed, uncapped) or title."""
    def t(df: DataFrame) -> DataFrame:
        df = df.withColumn("__sparts", H.page_parts(html, drop=(), title=True))
        df = df.withColumn("__stext", F.lower("__sparts.text")).withColumn("__stitle", F.lower("__sparts.title"))
        hits = []
        for terms, weight in BUSINESS_INDICATORS:
            found = None
            for term in terms:
                h = F.col("__stext").contains(term) | F.col("__stitle").contains(term)
                found = h if found is None else (found | h)
            hits.append((found, weight, f"Found business indicator: {terms[0]}"))
        points = sum((F.when(f, F.lit(w)).otherwise(F.lit(0)) for f, w, _ in hits), F.lit(0))
        reasons = F.filter(F.array(*[F.when(f, F.lit(r)) for f, _, r in hits]),
                           lambda r: r.isNotNull())
        df = df.withColumn(out, F.struct(
            points.alias("points"), (points >= BUSINESS_MIN_SCORE).alias("is_valid"),
            (points / F.lit(100.0)).alias("confidence"), reasons.alias("reasons")))
        return df.drop("__sparts", "__stext", "__stitle")
    return t


def denylisted_host(host) -> Column:
    """Host contains one of the platform names."""
    h = col_(host)
    return F.coalesce(F.exists(F.array(*[F.lit(s) for s in NON_BUSINESS_HOSTS]),
                               lambda s: h.contains(s)), F.lit(False))


def with_business_verdict(url: str = "url", html: str = "html", emails: str = "emails",
                          phones: str = "phones", conf_emails="conf_emails",
                          conf_phones="conf_phones", out: str = "verdict"
                          ) -> Callable[[DataFrame], DataFrame]:
    """Contacts found -> valid with their mean confidence; only otherwise
    the platform denylist (T9) and then the indicator score (T8).

    ``conf_emails``/``conf_phones`` name columns (or Columns) holding the
    extraction confidences (0.6 for the traditional path).
    """
    from contactlake.functions.text import js_round

    def t(df: DataFrame) -> DataFrame:
        df = df.transform(with_business_score(html, "__score")).transform(with_url_host(url, "__vhost"))
        has = (F.size(col_(emails)) > 0) | (F.size(col_(phones)) > 0)
        avg = (col_(conf_emails) + col_(conf_phones)) / 2
        contact_reasons = F.array(F.lit("AI found contact information"),
                                  F.concat(F.lit("AI confidence: "),
                                           js_round(avg * 100).cast("string"), F.lit("%")))
        s = F.col("__score")
        deny = denylisted_host(F.col("__vhost"))
        verdict = (F.when(has, F.struct(F.lit(True).alias("is_valid"), avg.alias("confidence"),
                                        contact_reasons.alias("reasons")))
                   .when(deny, F.struct(F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence"),
                                        F.array(F.lit("Known non-business platform")).alias("reasons")))
                   .otherwise(F.struct(s["is_valid"].alias("is_valid"), s["confidence"].alias("confidence"),
                                       s["reasons"].alias("reasons"))))
        return df.withColumn(out, verdict).drop("__score", "__vhost")
    return t


def not_business_message(verdict) -> Column:
    """Error text of a rejected site (confidence as a rounded percent)."""
    from contactlake.functions.text import js_round
    v = col_(verdict)
    return F.concat(F.lit("Not a business website (confidence: "),
                    js_round(v["confidence"] * 100).cast("bigint").cast("string"),
                    F.lit("%). Reasons: "), F.array_join(v["reasons"], ", "))
