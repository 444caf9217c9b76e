"""String building blocks shared by every operator.

The source behaviour follows JavaScript string and RegExp semantics, which
differ from Java's in two places that matter here:

* JS ``\\s`` and ``String.prototype.trim`` cover NBSP and the other Unicode
  space characters; Java ``\\s`` and Spark ``trim`` do not.  ``JSWS`` is the
  JS whitespace class spelled out.
* JS ``\\b`` is an ASCII word boundary; Java's is Unicode-aware.  ``WB`` is the
  ASCII boundary written with look-arounds.

Both are given twice: for Java regexes (Spark) and for RE2 (the DuckDB
oracle, which has no look-arounds but whose ``\\b`` is already ASCII).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the JavaScript whitespace class (ECMAScript WhiteSpace +
# LineTerminator), as character-class bodies for each regex dialect ---------
JSWS = (r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029"
        r"\u202f\u205f\u3000\ufeff")
JSWS_RE2 = (r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}\x{feff}")

_W = "A-Za-z0-9_"
# ASCII word boundary for Java regexes.
WB = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
WB_RE2 = r"\b"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """``String.prototype.trim``: strip JS whitespace at both ends."""
    return F.regexp_replace(col_(c), f"^[{JSWS}]+|[{JSWS}]+\\z", "")


def collapse_ws(c) -> Column:
    """``s.replace(/\\s+/g, " ")``."""
    return F.regexp_replace(col_(c), f"[{JSWS}]+", " ")


def digits_only(c) -> Column:
    """``s.replace(/\\D/g, "")`` (JS ``\\d`` is ASCII 0-9)."""
    return F.regexp_replace(col_(c), "[^0-9]", "")


def is_blank(c) -> Column:
    """Missing, empty or whitespace-only (``!x || x.trim() === ""``)."""
    return F.coalesce(js_trim(col_(c)), F.lit("")) == ""


def nonblank(c) -> Column:
    return ~is_blank(c)


def empty_to_null(c) -> Column:
    """Public edge uses ``""`` for missing; inside we often want null."""
    c = col_(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def null_to_empty(c) -> Column:
    return F.coalesce(col_(c), F.lit(""))


def js_round(c) -> Column:
    """``Math.round``: halves round up (towards +inf)."""
    return F.floor(col_(c) + F.lit(0.5))


def let(value, fn) -> Column:
    """Bind ``value`` once per row and return ``fn(bound)``.

    ``transform`` over a one-element array makes the value a lambda variable:
    it is evaluated once, however often ``fn`` reads it, and optimizer rules
    that substitute column aliases (projection collapsing, filter pushdown)
    cannot copy it into several places.
    """
    return F.get(F.transform(F.array(col_(value)), fn), 0)
