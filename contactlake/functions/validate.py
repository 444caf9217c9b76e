"""Scalar validators and cleaners (V1-V8), all JVM-side ``Column`` functions.

Each returns the cleaned value or null (or a boolean for the checks), so a
whole record is validated by one ``select`` that Catalyst fuses into the scan
stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import JSWS, col_, collapse_ws, digits_only, js_trim

# --- fixed values: the validator's lists -----------------------------------
FAKE_PHONE_DIGITS = ["1234567890", "0000000000", "1111111111"]
DISPOSABLE_DOMAINS = [
    "tempmail.com", "10minutemail.com", "guerrillamail.com", "mailinator.com",
    "throwaway.email", "temp-mail.org", "getnada.com", "maildrop.cc",
    "yopmail.com", "sharklasers.com", "guerrillamailblock.com",
]
FAKE_LOCAL_PARTS = ["test", "example", "sample", "demo", "noreply", "no-reply"]
EMAIL_MAX_LEN = 254
NAME_MIN = 2
ADDRESS_MIN = 5

EMAIL_SHAPE = f"^[^{JSWS}@]+@[^{JSWS}@]+\\.[^{JSWS}@]+\\z"
FAKE_EMAIL = "(?i)^(" + "|".join(FAKE_LOCAL_PARTS) + ")@"


def _present(c: Column) -> Column:
    """JS truthiness of a string: not null and not empty."""
    return c.isNotNull() & (c != "")


def validate_phone(c) -> Column:
    """V1: formatted phone or null."""
    c = col_(c)
    d = digits_only(c)
    n = F.length(d)
    first, second = F.substring(d, 1, 1), F.substring(d, 2, 1)
    us10 = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3),
                    F.lit("-"), F.substring(d, 7, 4))
    us11 = F.concat(F.lit("+1 ("), F.substring(d, 2, 3), F.lit(") "), F.substring(d, 5, 3),
                    F.lit("-"), F.substring(d, 8, 4))
    null = F.lit(None).cast("string")
    return (F.when(~_present(c), null)
            .when((n < 7) | (n > 15), null)
            .when(d.rlike(r"(\d)\1{6,}"), null)
            .when(d.isin(*FAKE_PHONE_DIGITS), null)
            .when(n == 10, F.when(first.isin("0", "1"), null).otherwise(us10))
            .when((n == 11) & (first == "1"), F.when(second.isin("0", "1"), null).otherwise(us11))
            .otherwise(F.concat(F.lit("+"), d)))


def email_domain(c) -> Column:
    """``email.split("@")[1]`` (null when there is no '@')."""
    return F.get(F.split(col_(c), "@"), 1)


def is_disposable_email(c) -> Column:
    """V3: lower-cased part after the first '@' is a listed throwaway domain."""
    return F.coalesce(F.lower(email_domain(c)).isin(*DISPOSABLE_DOMAINS), F.lit(False))


def validate_email(c) -> Column:
    """V2: shape, not disposable, no placeholder local part, at most 254 chars."""
    c = col_(c)
    return F.coalesce(
        _present(c) & c.rlike(EMAIL_SHAPE) & ~is_disposable_email(c)
        & ~c.rlike(FAKE_EMAIL) & (F.length(c) <= EMAIL_MAX_LEN), F.lit(False))


def is_valid_email_weak(c) -> Column:
    """V7: shape and length only (used while extracting)."""
    c = col_(c)
    return F.coalesce(c.rlike(EMAIL_SHAPE) & (F.length(c) <= EMAIL_MAX_LEN), F.lit(False))


def is_valid_phone_weak(c) -> Column:
    """V8: 7 to 15 digits."""
    n = F.length(digits_only(col_(c)))
    return F.coalesce((n >= 7) & (n <= 15), F.lit(False))


def _clean_text(c, lo: int, hi: int | None) -> Column:
    c = col_(c)
    t = js_trim(c)
    null = F.lit(None).cast("string")
    out = F.when(~_present(c), null).when(F.length(t) < lo, null)
    if hi is not None:
        out = out.when(F.length(t) > hi, F.substring(t, 1, hi))     # cut, no whitespace collapse
    return out.otherwise(collapse_ws(t))


def validate_business_name(c, longest: int | None = None) -> Column:
    """V4; cut at ``longest`` characters only if it is given."""
    return _clean_text(c, NAME_MIN, longest)


def validate_address(c, longest: int | None = None) -> Column:
    """V5; cut at ``longest`` characters only if it is given."""
    return _clean_text(c, ADDRESS_MIN, longest)


def validate_records(name="name", phone="phone", email="email", website="website",
                     address="address", category="category", keep=()):
    """V6 as a transform: the six cleaned business columns, ``""`` for missing.

    ``keep`` lists extra columns (e.g. ``ord``) carried through unchanged.
    """
    from contactlake.functions.urls import with_normalized_website

    def t(df):
        df = df.transform(with_normalized_website(col_(website), "__v6_site"))
        n, ph, em = col_(name), col_(phone), col_(email)
        return df.select(
            *[col_(k) for k in keep],
            F.coalesce(validate_business_name(n), n, F.lit("")).alias("name"),
            F.coalesce(validate_phone(ph), F.lit("")).alias("phone"),
            F.when(validate_email(em), em).otherwise(F.lit("")).alias("email"),
            F.coalesce(F.col("__v6_site"), F.lit("")).alias("website"),
            F.coalesce(validate_address(col_(address)), F.lit("")).alias("address"),
            F.coalesce(js_trim(col_(category)), F.lit("")).alias("category"))
    return t
