"""Record normalisation and pairwise similarity terms.

All terms are double-valued JVM expressions; the pair score adds the weighted
terms in a fixed order so results agree bit-for-bit with the source's
floating-point sum (0.4+0.2+0.15+0.1 = 0.8500000000000001 is > 0.85).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import JSWS, WB, col_, digits_only, js_trim

# --- fixed values: words dropped by the normalisers and the score weights ---
NAME_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "company", "co", "llp", "lp"]
STREET_WORDS = ["street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "drive", "dr",
                "lane", "ln", "way", "place", "pl"]
WEIGHTS = {"name": 0.4, "phone": 0.2, "website": 0.15, "address": 0.15, "email": 0.1}
DUPLICATE_THRESHOLD = 0.85
PHONE_CONTAINED_SCORE = 0.8
EMAIL_SAME_DOMAIN_SCORE = 0.7

PUNCT_RE = f"[^A-Za-z0-9_{JSWS}]"
SUFFIX_RE = WB + "(" + "|".join(NAME_SUFFIXES) + ")" + WB
STREET_RE = WB + "(" + "|".join(STREET_WORDS) + ")" + WB
WS_RUN_RE = f"[{JSWS}]+"


def _finish(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, WS_RUN_RE, " "))


def normalize_name(c) -> Column:
    """Lower, drop punctuation, then suffix words, collapse, trim."""
    c = F.lower(F.coalesce(col_(c), F.lit("")))
    c = F.regexp_replace(c, PUNCT_RE, "")
    c = F.regexp_replace(c, SUFFIX_RE, "")
    return _finish(c)


def normalize_address(c) -> Column:
    """D3: lower, drop street words first, then punctuation, collapse, trim."""
    c = F.lower(F.coalesce(col_(c), F.lit("")))
    c = F.regexp_replace(c, STREET_RE, "")
    c = F.regexp_replace(c, PUNCT_RE, "")
    return _finish(c)


def string_similarity(a, b) -> Column:
    """0 if either empty, 1 if equal, else 1 - levenshtein / longer length."""
    a, b = col_(a), col_(b)
    longer = F.greatest(F.length(a), F.length(b)).cast("double")
    lev = F.levenshtein(a, b).cast("double")
    return (F.when((a == "") | (b == "") | a.isNull() | b.isNull(), F.lit(0.0))
            .when(a == b, F.lit(1.0))
            .otherwise((longer - lev) / longer))


def phone_similarity(p1, d1, p2, d2) -> Column:
    """D5 on raw phones ``p`` and their digit strings ``d``."""
    p1, d1, p2, d2 = col_(p1), col_(d1), col_(p2), col_(d2)
    return (F.when((F.coalesce(p1, F.lit("")) == "") | (F.coalesce(p2, F.lit("")) == ""), F.lit(0.0))
            .when(d1 == d2, F.lit(1.0))
            .when(d1.contains(d2) | d2.contains(d1), F.lit(PHONE_CONTAINED_SCORE))
            .otherwise(F.lit(0.0)))


def website_similarity(w1, h1, w2, h2) -> Column:
    """D6 on raw websites ``w`` and hosts ``h`` (null when unparsable)."""
    w1, h1, w2, h2 = col_(w1), col_(h1), col_(w2), col_(h2)
    s1 = F.regexp_replace(h1, r"^www\.", "")
    s2 = F.regexp_replace(h2, r"^www\.", "")
    return (F.when((F.coalesce(w1, F.lit("")) == "") | (F.coalesce(w2, F.lit("")) == ""), F.lit(0.0))
            .when(h1.isNull() | h2.isNull() | (h1 == "") | (h2 == ""), F.lit(0.0))
            .when((h1 == h2) | (s1 == s2), F.lit(1.0))
            .otherwise(F.lit(0.0)))


def email_similarity(e1, e2) -> Column:
    """Equal 1; same part after the first '@' 0.7."""
    e1, e2 = col_(e1), col_(e2)
    d1, d2 = F.get(F.split(e1, "@"), 1), F.get(F.split(e2, "@"), 1)
    return (F.when((F.coalesce(e1, F.lit("")) == "") | (F.coalesce(e2, F.lit("")) == ""), F.lit(0.0))
            .when(e1 == e2, F.lit(1.0))
            .when((F.coalesce(d1, F.lit("")) != "") & (d1 == d2), F.lit(EMAIL_SAME_DOMAIN_SCORE))
            .otherwise(F.lit(0.0)))


def pair_score(name_s, phone_s, web_s, addr_s, email_s) -> Column:
    """Weighted sum, added in the source's order."""
    return (col_(name_s) * F.lit(WEIGHTS["name"]) + col_(phone_s) * F.lit(WEIGHTS["phone"])
            + col_(web_s) * F.lit(WEIGHTS["website"]) + col_(addr_s) * F.lit(WEIGHTS["address"])
            + col_(email_s) * F.lit(WEIGHTS["email"]))


def phone_digits(c) -> Column:
    return digits_only(F.coalesce(col_(c), F.lit("")))
