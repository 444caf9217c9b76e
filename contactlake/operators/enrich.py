"""Enrichment joins (J1-J5) and the custom-site flow.

The source fetches a site per business; here the page corpus is a table and
every lookup is a join on the URL.  Contacts are extracted once per page
(``page_contacts``), so e-mail and phone enrichment share one pass over the
HTML.  Joins are plain equi-joins: Spark picks sort-merge or (via AQE)
broadcast from runtime sizes, and AQE splits a hot URL on the probe side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.functions.text import col_
from contactlake.functions.urls import with_intake_check, with_normalized_website
from contactlake.functions.validate import validate_records
from contactlake.operators.extract import (EMAIL_BLOCKLIST, TRADITIONAL_CONFIDENCE, first_valid_email,
                                           first_valid_phone, not_business_message,
                                           with_business_verdict, with_contact_link,
                                           with_contacts)

UNKNOWN_BUSINESS = "Unknown Business"


def page_contacts(pages: DataFrame, strict: bool = False,
                  blocklist: Sequence[str] = EMAIL_BLOCKLIST) -> DataFrame:
    """Per page: url, emails, phones (T3/T4), best_email/best_phone (T6) and
    contact_url (T7 + U5)."""
    c = (pages.select("url", "html")
         .transform(with_contacts("url", "html", strict, blocklist, hrefs_out="__hrefs"))
         .transform(with_contact_link("url", "html", hrefs="__hrefs")))
    return c.select("url", "emails", "phones", "contact_url",
                    first_valid_email("emails").alias("best_email"),
                    first_valid_phone("phones").alias("best_phone"))


def by_site(contacts: DataFrame) -> DataFrame:
    """One row per normalised URL (U1): the row with the smallest raw URL, so a
    page that was crawled twice does not multiply what is joined to it.  Rows
    whose URL has no normal form answer no lookup."""
    cols = [c for c in contacts.columns if c != "url"]
    t = contacts.transform(with_normalized_website("url", "__site")).where(F.col("__site").isNotNull())
    return (t.groupBy(F.col("__site").alias("site")).agg(F.min_by(F.struct("url", *cols), F.struct("url", F.xxhash64(*cols))).alias("r"))
            .select("site", "r.*"))


def _lookup(left: DataFrame, need, key: str, right: DataFrame, cols: dict[str, str]) -> DataFrame:
    """``left`` plus columns ``cols`` (new name: column of ``right``) of the row
    of ``right`` whose site is the normal form of ``left``'s column ``key``.
    Rows that need no lookup stay out of the join."""
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(n) for n, c in cols.items()]
    need = F.coalesce(need, F.lit(False))
    rest = left.where(~need).select("*", *nothing)
    asked = left.where(need).transform(with_normalized_website(key, "__site"))
    found = right.select(F.col("site").alias("__r"), *[F.col(c).alias(n) for n, c in cols.items()])
    got = asked.join(found, F.col("__site") == F.col("__r"), "left").select(*[F.col(c) for c in left.columns], *cols)
    return got.unionByName(rest)


def contacts_with_fallback(contacts: DataFrame) -> DataFrame:
    """Main-page best e-mail/phone, else the contact page's.

    Only pages missing a value look the contact page up (by normalised URL).
    """
    need = (F.col("best_email").isNull() | F.col("best_phone").isNull()) & F.col("contact_url").isNotNull()
    j = _lookup(contacts, need, "contact_url", by_site(contacts.select("url", "best_email", "best_phone")),
                {"c_email": "best_email", "c_phone": "best_phone"})
    return j.select(
        "url", "emails", "phones", "contact_url", "best_email", "best_phone",
        F.coalesce("best_email", "c_email").alias("email"),
        F.coalesce("best_phone", "c_phone").alias("phone"),
        F.when(F.col("best_email").isNotNull(), "main").when(F.col("c_email").isNotNull(), "contact")
         .otherwise("").alias("email_source"),
        F.when(F.col("best_phone").isNotNull(), "main").when(F.col("c_phone").isNotNull(), "contact")
         .otherwise("").alias("phone_source"))


def enrich(businesses: DataFrame, contacts: DataFrame, field: str) -> DataFrame:
    """J1 (``field='email'``) / J2 (``field='phone'``): rows with a website and
    an empty ``field`` get the site's value (``http`` sites only); other rows
    pass unchanged."""
    site = F.coalesce(F.col("website"), F.lit(""))
    need = (site != "") & (F.coalesce(col_(field), F.lit("")) == "") & site.startswith("http")
    j = _lookup(businesses, need, "website", by_site(contacts.select("url", field)), {"__found": field})
    return j.withColumn(field, F.coalesce("__found", col_(field))).drop("__found")


def with_model_contacts(contacts: DataFrame, model: DataFrame | None) -> DataFrame:
    """J4 cascade: a model result for the URL wins when it has a valid e-mail
    (e-mail path) / any phone (phone path); otherwise the traditional lists
    with confidence 0.6 and method ``traditional``.

    ``model``: (url, emails, phones, conf_emails, conf_phones).
    """
    base = contacts.withColumn("method", F.lit("traditional")) \
        .withColumn("conf_emails", F.lit(TRADITIONAL_CONFIDENCE)) \
        .withColumn("conf_phones", F.lit(TRADITIONAL_CONFIDENCE))
    if model is None:
        return base
    j = _lookup(base, F.col("url").isNotNull(), "url", by_site(model), {
        "m_url": "url", "m_emails": "emails", "m_phones": "phones", "m_ce": "conf_emails", "m_cp": "conf_phones"})
    has_model = F.col("m_url").isNotNull()
    m_email = first_valid_email("m_emails")
    m_phone = first_valid_phone("m_phones")
    return j.select(
        "url", "contact_url",
        F.when(has_model, F.col("m_emails")).otherwise(F.col("emails")).alias("emails"),
        F.when(has_model, F.col("m_phones")).otherwise(F.col("phones")).alias("phones"),
        F.coalesce(m_email, "best_email").alias("best_email"),
        F.coalesce(m_phone, "best_phone").alias("best_phone"),
        F.when(has_model, "ai").otherwise("traditional").alias("method"),
        F.when(has_model, F.col("m_ce")).otherwise(F.col("conf_emails")).alias("conf_emails"),
        F.when(has_model, F.col("m_cp")).otherwise(F.col("conf_phones")).alias("conf_phones"))


def custom_scrape(url_lines: DataFrame, pages: DataFrame, business_type: str | None = None,
                  location: str | None = None, max_sites: int | None = None,
                  ai_business: DataFrame | None = None, strict_errors: bool = False):
    """The custom-site flow (U2 -> L1 -> U1 -> page lookup -> T10 -> J5 -> V6).

    ``url_lines``: (ord, raw).  Returns ``(rows, errors, n_valid)`` where rows
    are validated business rows with ``ord`` (dedup is applied by the
    caller), errors are (ord, url, error, category) and ``n_valid`` the
    number of accepted sites after the cap (a DataFrame with one row).
    """
    from contactlake.operators.crawl import MSG_NOT_BUSINESS, with_error_category
    from contactlake.functions.text import js_trim

    lines = url_lines.where(js_trim("raw") != "").transform(with_intake_check("raw", "cleaned", "intake_error"))
    invalid = lines.where(F.col("intake_error").isNotNull()).select(
        "ord", F.col("raw").alias("url"), F.col("intake_error").alias("error"),
        F.lit("validation").alias("category"))
    ok = lines.where(F.col("intake_error").isNull())
    if max_sites is not None:
        ok = ok.orderBy("raw", "ord").limit(max_sites)
    ok = ok.transform(with_normalized_website("cleaned", "site"))
    bad_format = ok.where(F.col("site").isNull()).select(
        "ord", F.col("raw").alias("url"),
        F.concat(F.lit("Invalid URL format: "), F.col("cleaned")).alias("message"))
    sites = ok.where(F.col("site").isNotNull())
    # one page per site: the smallest page_id; its key first, its HTML after
    ids = (pages.select("page_id", "url").transform(with_normalized_website("url", "p_site")).where(F.col("p_site").isNotNull())
           .groupBy("p_site").agg(F.min("page_id").alias("p_id")))
    fetched = (sites.join(ids, F.col("site") == F.col("p_site"), "left")
               .join(pages.select("page_id", F.col("url").alias("p_url"), "html"), F.col("p_id") == F.col("page_id"), "left")
               .drop("p_site", "p_id", "page_id"))
    missing = fetched.where(F.col("p_url").isNull()).select(
        "ord", F.col("raw").alias("url"), F.concat(F.col("site"), F.lit(": fetch failed")).alias("message"))
    # One pass over the fetched pages; the verdict table is checkpointed so
    # the accepted and rejected branches reuse it instead of re-parsing.
    from contactlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(pages.sparkSession)
    found = (fetched.where(F.col("p_url").isNotNull())
             .transform(with_contacts("site", "html"))
             .withColumn("conf_emails", F.lit(TRADITIONAL_CONFIDENCE))
             .withColumn("conf_phones", F.lit(TRADITIONAL_CONFIDENCE))
             .transform(with_business_verdict("site", "html"))
             .drop("html").checkpoint(eager=True))
    rejected = found.where(~F.col("verdict.is_valid")).select(
        "ord", F.col("raw").alias("url"),
        F.concat(F.col("site"), F.lit(": "), not_business_message("verdict")).alias("message"))
    accepted = found.where(F.col("verdict.is_valid"))
    if ai_business is not None:
        ab = ai_business.select(F.col("url").alias("ab_url"), F.col("business_name").alias("ab_name"),
                                F.col("business_type").alias("ab_type"))
        accepted = accepted.join(ab, F.col("site") == F.col("ab_url"), "left")
        name = F.coalesce(F.when(F.col("ab_name") != "", F.col("ab_name")), F.lit(UNKNOWN_BUSINESS))
        btype = F.coalesce(F.when(F.col("ab_type") != "", F.col("ab_type")), F.lit(""))
    else:
        name, btype = F.lit(UNKNOWN_BUSINESS), F.lit("")
    assembled = accepted.select(
        "ord", name.alias("name"),
        F.coalesce(F.get("phones", 0), F.lit("")).alias("phone"),
        F.coalesce(F.get("emails", 0), F.lit("")).alias("email"),
        F.col("site").alias("website"),
        F.lit(location or "").alias("address"),
        (F.lit(business_type) if business_type else btype).alias("category"))
    rows = assembled.transform(validate_records(keep=("ord",)))
    # The flow knows what went wrong, so the category does not depend on digits
    # of the URL in the text; ``strict_errors`` applies the source's text rules.
    kinds = ((bad_format, "validation"), (missing, "unknown"), (rejected, "content"))
    parts = [part.withColumn("kind", F.lit(k)) for part, k in kinds]
    fails = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if strict_errors:
        fails = fails.transform(with_error_category("message", None, True))
    else:
        fails = fails.withColumn("category", F.col("kind")).withColumn("error_message", F.when(
            F.col("kind") == "content", F.lit(MSG_NOT_BUSINESS)).otherwise(F.col("message")))
    errors = invalid.unionByName(fails.select("ord", "url", F.col("error_message").alias("error"),
                                              F.col("category")))
    n_valid = ok.agg(F.count(F.lit(1)).alias("n_valid"))
    return rows, errors, n_valid
