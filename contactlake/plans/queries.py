"""Named end-to-end queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables (or fixtures Spark derives from them) in
full and returns flat, scalar columns whose names equal the oracle's.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.operators.extract import (first_valid_email, first_valid_phone, with_contacts)
from contactlake.sources import fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def site_contacts(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return fixtures.site_pages(spark, sf_dir).transform(with_contacts("url", "html", strict))


@query("best_email_per_page")
def best_email_per_page(spark, sf_dir):
    """S1 -> T1 -> T3 -> V2 -> L4: best e-mail of every page."""
    c = site_contacts(spark, sf_dir)
    return c.select("page_id", "url",
                    F.coalesce(first_valid_email("emails"), F.lit("")).alias("best_email"),
                    F.size("emails").cast("bigint").alias("n_emails"))


@query("best_phone_per_page")
def best_phone_per_page(spark, sf_dir):
    """T4 -> V1 -> L4: best (formatted) phone of every page."""
    c = site_contacts(spark, sf_dir)
    return c.select("page_id", "url",
                    F.coalesce(first_valid_phone("phones"), F.lit("")).alias("best_phone"),
                    F.size("phones").cast("bigint").alias("n_phones"))


@query("page_email_list")
def page_email_list(spark, sf_dir):
    """The ordered e-mail list of every page, one row per entry."""
    c = site_contacts(spark, sf_dir)
    return c.select("page_id", F.posexplode("emails").alias("pos", "email")) \
            .select("page_id", F.col("pos").cast("bigint").alias("pos"), "email")


@query("page_phone_list")
def page_phone_list(spark, sf_dir):
    """T4/T5: the ordered phone list of every page, one row per entry."""
    c = site_contacts(spark, sf_dir)
    return c.select("page_id", F.posexplode("phones").alias("pos", "phone")) \
            .select("page_id", F.col("pos").cast("bigint").alias("pos"), "phone")


# --- dedup (D1, D8, D9) -------------------------------------------------------
from contactlake.operators.dedup import (FEATURE_COLS, dedup_ordered, duplicate_edges,  # noqa: E402
                                         with_dedup_features)
from contactlake.session import ensure_checkpoint_dir  # noqa: E402

BUSINESS_COLS = ["ord", "name", "phone", "email", "website", "address", "category"]


@query("business_signatures")
def business_signatures(spark, sf_dir):
    """Normalised name, address, phone digits, host and signature."""
    b = fixtures.businesses(spark, sf_dir).transform(with_dedup_features())
    return b.select("ord", "nname", "naddr", "pd", F.coalesce("host", F.lit("")).alias("host"), "sig")


@query("duplicate_pairs")
def duplicate_pairs(spark, sf_dir):
    """D8 > 0.85 over the blocked candidate pairs (each pair once, a < b)."""
    ensure_checkpoint_dir(spark)                # the joins read the features several times
    feat = fixtures.businesses(spark, sf_dir).transform(with_dedup_features()).select(*FEATURE_COLS).checkpoint()
    return duplicate_edges(feat).select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"), "score")


@query("dedup_businesses")
def dedup_businesses(spark, sf_dir):
    """Ordered greedy dedup of the raw business rows."""
    return dedup_ordered(fixtures.businesses(spark, sf_dir)).select(*BUSINESS_COLS)


@query("dedup_in_batches")
def dedup_in_batches(spark, sf_dir):
    """D9 over three batches of the rows by ``ord``, each against what the
    earlier ones kept."""
    import uuid

    from contactlake.operators.batches import dedup_batch
    from contactlake.session import ensure_checkpoint_dir
    b = fixtures.businesses(spark, sf_dir)
    top = b.agg(F.max("ord").alias("m")).first()["m"] or 0
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    third = F.floor(F.col("ord") * 3 / (top + 1))
    kept = [dedup_batch(b.where(third == k), path, k) for k in range(3)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).select(*BUSINESS_COLS)


# --- validators and URL functions ---------------------------------------------
from contactlake.functions.text import digits_only  # noqa: E402
from contactlake.functions.urls import (encode_uri_component, search_request_url,  # noqa: E402
                                        unwrap_redirect, with_intake_check,
                                        with_normalized_website, with_url_host)
from contactlake.functions.validate import (is_disposable_email, is_valid_email_weak,  # noqa: E402
                                            is_valid_phone_weak, validate_email,
                                            validate_phone, validate_records)
from contactlake.sources.tables import read_table  # noqa: E402


def validated(spark, sf_dir):
    return fixtures.businesses(spark, sf_dir).transform(validate_records(keep=("ord",)))


def without_website(spark, sf_dir):
    """The validated rows without a website.  They are checkpointed before the
    filter: the optimizer would move it, and so the URL parser, into the scan's one task."""
    ensure_checkpoint_dir(spark)
    return R.without_website(validated(spark, sf_dir).checkpoint())


@query("validated_businesses")
def validated_businesses(spark, sf_dir):
    """V6 on every business row."""
    return validated(spark, sf_dir)


@query("phone_formats")
def phone_formats(spark, sf_dir):
    """V1/V8 on the raw phones."""
    b = fixtures.businesses(spark, sf_dir)
    return b.select("ord", "phone", F.coalesce(validate_phone("phone"), F.lit("")).alias("formatted"),
                    F.length(digits_only("phone")).cast("bigint").alias("n_digits"),
                    is_valid_phone_weak("phone").alias("weak_ok"))


@query("email_checks")
def email_checks(spark, sf_dir):
    """V2/V3/V7 on raw e-mails and on every e-mail found in the page corpus."""
    b = fixtures.businesses(spark, sf_dir).select(F.lit("business").alias("src"), F.col("ord").alias("id"),
                                                  "email")
    p = site_contacts(spark, sf_dir).select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                            F.explode("emails").alias("email"))
    e = b.unionByName(p)
    return e.select("src", "id", "email", validate_email("email").alias("valid"),
                    is_valid_email_weak("email").alias("weak_ok"),
                    is_disposable_email("email").alias("disposable"))


@query("page_url_normalised")
def page_url_normalised(spark, sf_dir):
    """U1/U3 on every page URL and on the business websites."""
    pg = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                                   F.col("url").alias("raw"))
    bz = fixtures.businesses(spark, sf_dir).select(F.lit("business").alias("src"), F.col("ord").alias("id"),
                                                   F.col("website").alias("raw"))
    u = pg.unionByName(bz).transform(with_normalized_website("raw", "n")).transform(with_url_host("raw", "h"))
    return u.select("src", "id", "raw", F.coalesce("n", F.lit("")).alias("normalized"),
                    F.coalesce("h", F.lit("")).alias("host"))


@query("url_intake_errors")
def url_intake_errors(spark, sf_dir):
    """U2 over every non-blank intake line."""
    from contactlake.functions.text import js_trim
    u = fixtures.url_inputs(spark, sf_dir).where(js_trim("raw") != "")
    u = u.transform(with_intake_check("raw", "cleaned", "error"))
    return u.select("ord", "raw", "cleaned", F.coalesce("error", F.lit("")).alias("error"))


def _written(spark, df, column, order):
    """``df``'s column as the lines of text files in the shared folder."""
    import uuid

    from contactlake.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    df.repartitionByRange(4, order).sortWithinPartitions(order).select(column).write.text(path)
    return path


@query("url_list_lines")
def url_list_lines(spark, sf_dir):
    """The intake lines written to text files, read back and numbered."""
    from contactlake.sources import readers
    lines = readers.url_lines(spark, _written(spark, fixtures.url_inputs(spark, sf_dir), "raw", "ord"), across_files=True)
    return lines.select("ord", "raw")


@query("business_request_rows")
def business_request_rows(spark, sf_dir):
    """S3: request bodies of ten businesses each written as JSON Lines (one in
    seven cut off), read back: rows and errors by place."""
    from contactlake.sources import readers
    b = fixtures.businesses(spark, sf_dir).withColumn("g", F.floor(F.col("ord") / 10))
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", *BUSINESS_COLS[1:]))), lambda r: F.struct(
        *[r[c].alias(c) for c in BUSINESS_COLS[1:]])).alias("businesses")))
    bodies = b.groupBy("g").agg(body.alias("body")).select("g", F.when(F.col("g") % 7 == 3, F.substring("body", 1, 40)).otherwise(F.col("body")).alias("body"))
    rows, errors = readers.business_requests(spark, _written(spark, bodies, "body", "g"))
    return (rows.groupBy("name", "phone").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("places"))
            .unionByName(errors.groupBy(F.col("error").alias("name"), F.lit("").alias("phone")).agg(
                F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("places"))))


@query("url_standard_cases")
def url_standard_cases(spark, sf_dir):
    """Hrefs of URLs with international, numeric and IPv6 hosts, dot
    segments, logins and characters to encode; empty where a parser fails."""
    from contactlake.functions.urls import with_url_parts
    u = fixtures.url_cases(spark, sf_dir).transform(with_url_parts("raw", "p"))
    return u.select("page_id", F.coalesce("p.href", F.lit("")).alias("href"))


@query("redirect_links")
def redirect_links(spark, sf_dir):
    """U4: search-result redirect links built from page URLs, unwrapped."""
    pg = read_table(spark, sf_dir, "pages")
    link = F.concat(F.lit("/url?q="), encode_uri_component("url"), F.lit("&sa=U&ved=x"))
    return pg.select("page_id", link.alias("link")).select("page_id", "link",
                                                            unwrap_redirect("link").alias("target"))


@query("search_requests")
def search_requests(spark, sf_dir):
    """Request URLs for (segment, nation) queries, pages 1-3."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    q = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_mktsegment").alias("business_type"), F.col("n_name").alias("location")).distinct()
    q = q.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return q.select("business_type", "location", F.col("page").cast("bigint").alias("page"),
                    search_request_url("business_type", "location", "page").alias("request_url"))


# --- contact-page fallback, scoring, verdict ----------------------------------
from contactlake.operators.enrich import (contacts_with_fallback, custom_scrape, enrich,  # noqa: E402
                                          page_contacts)
from contactlake.operators.extract import (TRADITIONAL_CONFIDENCE, with_business_score,  # noqa: E402
                                           with_business_verdict)


def site_page_contacts(spark, sf_dir):
    """Per-page contacts with fallback.  The page pass is materialised once
    (reliable checkpoint) because the fallback self-join and both enrichment
    joins read it: one regex pass over the HTML instead of four."""
    from contactlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    pc = page_contacts(fixtures.site_pages(spark, sf_dir)).checkpoint(eager=True)
    return contacts_with_fallback(pc)


@query("contact_page_fallback")
def contact_page_fallback(spark, sf_dir):
    """J3 (+T7/U5): main-page contact or, failing that, the contact page's."""
    c = site_page_contacts(spark, sf_dir)
    return c.select("url", F.coalesce("contact_url", F.lit("")).alias("contact_url"),
                    F.coalesce("email", F.lit("")).alias("email"),
                    F.coalesce("phone", F.lit("")).alias("phone"), "email_source", "phone_source")


@query("business_score")
def business_score(spark, sf_dir):
    """Indicator points of every page."""
    s = fixtures.site_pages(spark, sf_dir).transform(with_business_score("html", "s"))
    return s.select("page_id", "url", F.col("s.points").cast("bigint").alias("points"),
                    F.col("s.is_valid").alias("is_valid"), F.col("s.confidence").alias("confidence"),
                    F.array_join("s.reasons", ", ").alias("reasons"))


@query("business_verdict")
def business_verdict(spark, sf_dir):
    """T10 (T3/T4 first, then T9, then T8) on every page."""
    s = (site_contacts(spark, sf_dir)
         .withColumn("ce", F.lit(TRADITIONAL_CONFIDENCE)).withColumn("cp", F.lit(TRADITIONAL_CONFIDENCE))
         .transform(with_business_verdict("url", "html", "emails", "phones", "ce", "cp", "v")))
    return s.select("page_id", "url", F.col("v.is_valid").alias("is_valid"),
                    F.col("v.confidence").alias("confidence"), F.array_join("v.reasons", ", ").alias("reasons"))


# --- enrichment joins -----------------------------------------------------------
def _enriched(spark, sf_dir, field):
    pb = fixtures.page_businesses(spark, sf_dir)
    return enrich(pb, site_page_contacts(spark, sf_dir), field).select(*BUSINESS_COLS)


@query("enriched_emails")
def enriched_emails(spark, sf_dir):
    """Fill empty e-mails from the business site (with J3 fallback)."""
    return _enriched(spark, sf_dir, "email")


@query("enriched_phones")
def enriched_phones(spark, sf_dir):
    """Fill empty phones from the business site (with J3 fallback)."""
    return _enriched(spark, sf_dir, "phone")


# --- reports, filters, paging ---------------------------------------------------
from contactlake.operators import reports as R  # noqa: E402


@query("coverage_stats")
def coverage_stats(spark, sf_dir):
    """A1 on the validated businesses."""
    return R.coverage_stats(validated(spark, sf_dir))


@query("export_counts")
def export_counts(spark, sf_dir):
    """A2 on the validated businesses."""
    return R.export_counts(validated(spark, sf_dir))


@query("export_no_website")
def export_no_website(spark, sf_dir):
    """F1 + F2: rows without a website, all fields under their labels."""
    v = without_website(spark, sf_dir)
    return R.select_fields(v.select("ord", *BUSINESS_COLS[1:]))


@query("display_rows")
def display_rows(spark, sf_dir):
    """list texts of every validated row."""
    v = validated(spark, sf_dir)
    return v.select("ord", "name", *R.display_columns())


@query("page_slice")
def page_slice(spark, sf_dir):
    """L2: third page of ten of the validated rows."""
    return R.page_slice(validated(spark, sf_dir), 3)


@query("deep_page")
def deep_page(spark, sf_dir):
    """L2: page 61 of ten of the validated rows by a rank index."""
    import uuid

    from contactlake.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    R.write_page_index(validated(spark, sf_dir), path)
    return R.indexed_page(spark, path, 61)


@query("page_meta")
def page_meta(spark, sf_dir):
    """A5 on result pages of ten (by ord, numbered inside the category)."""
    v = R.numbered_within(validated(spark, sf_dir).select("ord", "category"), "category", "ord")
    v = v.withColumn("page", F.floor((F.col("number") - 1) / 10) + 1)
    return R.page_meta(v, "page", group=["category"])


@query("accumulated_pages")
def accumulated_pages(spark, sf_dir):
    """Per category (the query), pages of 50 rows by ord accumulate by
    exact name."""
    b = fixtures.businesses(spark, sf_dir).withColumn("query", F.col("category")) \
        .withColumn("page", F.floor(F.col("ord") / 50).cast("bigint") + 1)
    return R.accumulate_pages(b, "query", "page", "name").select("query", "page", *BUSINESS_COLS)


# --- crawl log ------------------------------------------------------------------
from contactlake.operators import crawl as CR  # noqa: E402
from contactlake.operators import freshness as FR  # noqa: E402


@query("attempt_outcome")
def attempt_outcome(spark, sf_dir):
    """E3 (+E1): outcome of the first three attempts of every URL."""
    return CR.attempt_outcome(fixtures.crawl_log(spark, sf_dir))


def _error_rows(spark, sf_dir, strict):
    a = CR.attempt_outcome(fixtures.crawl_log(spark, sf_dir)).where(~F.col("ok"))
    text = F.concat(F.col("url"), F.lit(": "), F.col("message"))
    a = a.withColumn("text", text).transform(CR.with_error_category("text", None if strict else "status", strict))
    return a.select("url", "status", "text", "category", "error_message",
                    CR.error_line("url", "error_message").alias("line"))


@query("error_categories")
def error_categories(spark, sf_dir):
    """E1 -> E2 (status-aware) -> E4 for every failed URL."""
    return _error_rows(spark, sf_dir, False)


@query("error_categories_strict")
def error_categories_strict(spark, sf_dir):
    """E2 with the source's text-only rules (any '5' means server error)."""
    return _error_rows(spark, sf_dir, True)


@query("error_category_counts")
def error_category_counts(spark, sf_dir):
    """A3 over the failed URLs."""
    return R.errors_by_category(_error_rows(spark, sf_dir, False)).select(
        "category", F.col("n").cast("bigint").alias("n"))


@query("redirect_targets")
def redirect_targets(spark, sf_dir):
    """Redirect chains over the last status of every URL."""
    return CR.redirect_targets(fixtures.crawl_log(spark, sf_dir))


def _entries(spark, sf_dir):
    log = fixtures.crawl_log(spark, sf_dir)
    latest = FR.latest_by_key(FR.cache_entries(log), "key", ("fetched_at", "event_id"), ("kind", "ttl_ms"))
    # "now" is a one-row aggregate: a broadcast of proven size.
    now = FR.log_now(log).withColumn("__k", F.lit(1))
    return (latest.withColumn("__k", F.lit(1)).join(F.broadcast(now), "__k").drop("__k")
            .transform(FR.with_freshness(F.col("now"))))


@query("latest_by_key")
def latest_by_key(spark, sf_dir):
    """C1 + C3: last successful write per cache key."""
    log = fixtures.crawl_log(spark, sf_dir)
    return FR.latest_by_key(FR.cache_entries(log), "key", ("fetched_at", "event_id"), ("kind", "ttl_ms"))


@query("fresh_lookup")
def fresh_lookup(spark, sf_dir):
    """C4 + C5: age and freshness of every cache key at the log's "now"."""
    return _entries(spark, sf_dir).select("key", "kind", "fetched_at", "ttl_ms", "age_ms", "fresh")


@query("lookups_as_of")
def lookups_as_of(spark, sf_dir):
    """C4: lookups of every third logged URL some minutes after its fetch, each
    answered by the latest entry of that time."""
    log = fixtures.crawl_log(spark, sf_dir)
    asked = log.where("event_id % 3 = 0").select("event_id", FR.cache_key("kind", "url").alias("key"),
                                                 F.expr("fetched_at + make_interval(0, 0, 0, 0, 0, (event_id % 7) * 10)").alias("at"))
    t = FR.lookup_as_of(FR.cache_entries(log), asked)
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("entry.fetched_at").cast("timestamp"))
    return t.select("event_id", "key", F.col("entry.event_id").alias("entry_id"), F.coalesce(age <= F.col("entry.ttl_ms") * 1000, F.lit(False)).alias("fresh"))


@query("expired_entries")
def expired_entries(spark, sf_dir):
    """Keys the sweep removes."""
    return _entries(spark, sf_dir).where(~F.col("fresh")).select("key", "kind", "fetched_at", "age_ms")


@query("cache_stats")
def cache_stats(spark, sf_dir):
    """Size after the sweep and the number of expired keys."""
    return _entries(spark, sf_dir).agg(F.count_if("fresh").alias("size"),
                                       F.count_if(~F.col("fresh")).alias("expired"))


# --- mentions in plain documents ------------------------------------------------
from contactlake.operators.extract import email_text_matches, phones_from  # noqa: E402


@query("email_mentions")
def email_mentions(spark, sf_dir):
    """T3 text path on whole documents: weakly valid, lower-cased, ordered
    distinct per document (no blocklist: all fixture mail is example.com)."""
    d = read_table(spark, sf_dir, "documents")
    found = F.array_distinct(F.transform(F.filter(email_text_matches("text"), is_valid_email_weak),
                                         lambda e: F.lower(e)))
    return d.select("doc_id", F.posexplode(found).alias("pos", "email")) \
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "email")


def _phone_mentions(spark, sf_dir, strict):
    d = read_table(spark, sf_dir, "documents")
    lst = phones_from(F.array().cast("array<string>"), "text", strict, limit=None)
    return d.select("doc_id", F.posexplode(lst).alias("pos", "phone")) \
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "phone")


@query("phone_mentions")
def phone_mentions(spark, sf_dir):
    """T4 text path on whole documents, with the intended paren pattern."""
    return _phone_mentions(spark, sf_dir, False)


@query("phone_mentions_strict")
def phone_mentions_strict(spark, sf_dir):
    """T4 text path exactly as the source (paren pattern never matches)."""
    return _phone_mentions(spark, sf_dir, True)


@query("email_domain_counts")
def email_domain_counts(spark, sf_dir):
    """Mentions per e-mail domain over all documents."""
    m = email_mentions(spark, sf_dir)
    return m.groupBy(F.get(F.split("email", "@"), 1).alias("domain")).agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("doc_id").alias("documents"))


# --- custom-site flow and run summary --------------------------------------------
def _custom(spark, sf_dir):
    return custom_scrape(fixtures.url_inputs(spark, sf_dir), fixtures.site_pages(spark, sf_dir),
                         business_type="Retail", location="Springfield")


@query("custom_scrape_rows")
def custom_scrape_rows(spark, sf_dir):
    """U2 -> U1 -> page lookup -> T10 -> J5 -> V6 -> D9 over the intake lines."""
    rows, _, _ = _custom(spark, sf_dir)
    return dedup_ordered(rows).select(*BUSINESS_COLS)


@query("custom_scrape_errors")
def custom_scrape_errors(spark, sf_dir):
    """Per-site errors with category (E2) and report line."""
    _, errors, _ = _custom(spark, sf_dir)
    return errors.select("ord", "url", "error", "category", CR.error_line("url", "error").alias("line"))


@query("run_summary")
def run_summary(spark, sf_dir):
    """A3 + A4: valid sites, rows after dedup, all errors, per category."""
    rows, errors, n_valid = _custom(spark, sf_dir)
    kept = dedup_ordered(rows).agg(F.count(F.lit(1)).alias("successful"))
    cats = ["validation", "network", "content", "timeout", "unknown"]
    e = errors.agg(F.count(F.lit(1)).alias("failed"),
                   *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in cats])
    one = [x.withColumn("__k", F.lit(1)) for x in (n_valid, kept, e)]
    return one[0].join(one[1], "__k").join(one[2], "__k").select(
        F.col("n_valid").alias("total"), "successful", "failed", *[f"n_{c}" for c in cats])


# --- export texts -----------------------------------------------------------------
from contactlake.sinks import export as EX  # noqa: E402


@query("export_csv_lines")
def export_csv_lines(spark, sf_dir):
    """The CSV line of every validated row."""
    return validated(spark, sf_dir).select("ord", EX.csv_line().alias("line"))


@query("export_json_objects")
def export_json_objects(spark, sf_dir):
    """The JSON object of every validated row."""
    return validated(spark, sf_dir).select("ord", EX.json_object().alias("object"))


@query("export_txt_blocks")
def export_txt_blocks(spark, sf_dir):
    """S7 + S8: the numbered text block of every validated row without a website."""
    rows = EX.numbered(without_website(spark, sf_dir))
    return rows.select("ord", EX.txt_block("number").alias("block"))


# --- result pages -----------------------------------------------------------------
from contactlake.operators import listing as LI  # noqa: E402


@query("listing_cards")
def listing_cards(spark, sf_dir):
    """S4 + F4 + V6: the named cards of every result page."""
    return LI.listing_businesses(fixtures.listing_pages(spark, sf_dir)).select("page_id", "pos", *BUSINESS_COLS[1:])


@query("listing_meta")
def listing_meta(spark, sf_dir):
    """A5 of every result page."""
    return LI.result_meta(fixtures.listing_pages(spark, sf_dir))


@query("page_text")
def page_text(spark, sf_dir):
    """The visible text of every page, character references decoded."""
    from contactlake.functions.html import with_body_text
    return fixtures.site_pages(spark, sf_dir).transform(with_body_text("html", "text")).select("page_id", "text")


@query("broken_page_elements")
def broken_page_elements(spark, sf_dir):
    """T1 on malformed markup: visible text, link targets, and the texts of
    list items, cells and terms at any depth by the element tree."""
    from contactlake.functions import dom
    from contactlake.functions.html import page_parts, page_tree
    from contactlake.functions.text import let

    def items(tree):
        own = F.filter(tree["nodes"], lambda n: n["name"].isin("li", "td", "dt", "dd"))
        # the depth among items: how many of them an item lies in
        return let(own, lambda ns: F.array_join(F.transform(ns, lambda n: F.concat(
            F.size(F.filter(ns, lambda m: dom.inside(n, m))).cast("string"), F.lit(":"),
            dom.text_of(tree, n))), "|"))

    t = fixtures.broken_pages(spark, sf_dir).withColumn("parts", page_parts("html"))
    return t.select("page_id", F.col("parts.text").alias("text"), F.array_join("parts.hrefs", " ").alias("links"),
                    let(page_tree("html", ("script",)), items).alias("items"))


# --- model cascade and list keys --------------------------------------------------
@query("model_cascade")
def model_cascade(spark, sf_dir):
    """J4 + A6: model results before the page's own, with the mean confidence."""
    from contactlake.operators.enrich import with_model_contacts
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    model = fixtures.model_results(spark, sf_dir).select("url", one("email").alias("emails"), one("phone").alias("phones"),
                                                         "conf_emails", "conf_phones")
    c = with_model_contacts(page_contacts(fixtures.site_pages(spark, sf_dir)), model)
    return c.select("url", F.coalesce("best_email", F.lit("")).alias("email"), F.coalesce("best_phone", F.lit("")).alias("phone"),
                    "method", *R.mean_confidence("conf_emails", "conf_phones"))


@query("url_set_keys")
def url_set_keys(spark, sf_dir):
    """The key of the pages of each host."""
    p = read_table(spark, sf_dir, "pages").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    return p.groupBy("host").agg(F.collect_list("url").alias("urls")).select("host", FR.set_key("urls").alias("key"))


# --- flagship -------------------------------------------------------------------
@query("flagship_coverage")
def flagship_coverage(spark, sf_dir):
    """site pages -> contacts (+fallback) -> e-mail and phone enrichment ->
    V6 -> D9 -> coverage stats."""
    contacts = site_page_contacts(spark, sf_dir)
    pb = fixtures.page_businesses(spark, sf_dir)
    e = enrich(enrich(pb, contacts, "email"), contacts, "phone")
    v = e.transform(validate_records(keep=("ord",)))
    return R.coverage_stats(dedup_ordered(v))
