"""Visible text, titles and anchors of HTML pages, and character references.

A page is cut into tokens once (``dom.tokens``); text, titles and links are
read from the tokens by JVM expressions inside the scan stage, without per-row
Python.  This follows an HTML parser and ``$("body").text()``: raw-text elements
asked to be dropped have no text, text starts where the body does, text nodes
join directly and character references are decoded in text, titles and
attribute values, ``&amp;`` last of all.

Every stage is bound once per row with ``let``.
"""

from __future__ import annotations

from html.entities import name2codepoint
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import dom
from contactlake.functions.text import col_, let

# --- fixed values: what numeric references 128-159 stand for (the five numbers
# without a character there keep the control character of that number) -------
WINDOWS_1252 = {n: bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(128, 160)}

# --- fixed values: named character references decoded by the text
# functions (the common ones; "&amp;" is handled last, separately) ----------
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&hellip;", "…"), ("&trade;", "™"), ("&euro;", "€"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"),
]

RAW_TEXT_TAGS = ("script", "style", "noscript")

def decode_named(c) -> Column:
    c = col_(c)
    for ent, ch in NAMED_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def _table(pairs: dict) -> Column:
    """A constant map of strings from one literal (a literal an entry takes the
    analyzer long)."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


def _character(n: Column) -> Column:
    """The character of a numeric reference (null: no such number): U+FFFD for
    zero, surrogates and numbers past the last code point, the windows-1252
    characters for 128-159, as in the HTML standard."""
    table = _table(WINDOWS_1252)
    return (F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(n.between(128, 159), F.coalesce(F.try_element_at(table, n.cast("string")), F.lit("\ufffd")))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def _decode_numeric(c: Column) -> Column:
    """Fold over this row's decimal references (input must be an attribute)."""
    return F.aggregate(
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#([0-9]+);"), 1)), c,
        lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _character(n.try_cast("bigint"))))


def _decode_hex(c: Column) -> Column:
    def number(n):
        short = F.regexp_replace(n, "^0+", "")
        return F.when(F.length(short) <= 6, F.conv(short, 16, 10).try_cast("bigint"))
    return F.aggregate(
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#[xX]([0-9a-fA-F]+);"), 1)), c,
        lambda acc, n: F.regexp_replace(acc, F.concat(F.lit("&#[xX]"), n, F.lit(";")),
                                        let(_character(number(n)), lambda ch: F.when(ch.isin("$", "\\"), F.concat(F.lit("\\"), ch)).otherwise(ch))))


def _decode_other(c: Column) -> Column:
    """Fold over named references outside NAMED_ENTITIES."""
    names = {k: chr(v) for k, v in name2codepoint.items() if k != "amp"}
    table = _table(names)
    return F.aggregate(
        F.array_distinct(F.regexp_extract_all(c, F.lit(r"&([A-Za-z]+[0-9]*);"), 1)), c,
        lambda acc, n: F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")),
                                 F.coalesce(F.try_element_at(table, n), F.concat(F.lit("&"), n, F.lit(";")))))


def decode_entities(c) -> Column:
    """Decode named, decimal and hex references; ``&amp;`` last.  Texts without
    an ampersand pass through."""
    def others(n):
        return F.when(n.rlike("&(?!amp;)[A-Za-z]+[0-9]*;"), _decode_other(n)).otherwise(n)

    def numeric(n):
        return F.when(n.contains("&#"), let(_decode_numeric(n), _decode_hex)).otherwise(n)

    def all_(x):
        return F.when(x.contains("&"), F.replace(let(let(decode_named(x), others), numeric), F.lit("&amp;"), F.lit("&"))).otherwise(x)
    return let(col_(c), all_)


def with_decoded(src: str, out: str) -> Callable[[DataFrame], DataFrame]:
    """Decode character references of column ``src`` into ``out``."""
    def t(df: DataFrame) -> DataFrame:
        return df.withColumn(out, decode_entities(src))
    return t


def cap_html(c, cap: int | None = None) -> Column:
    c = col_(c)
    return F.substring(c, 1, cap) if cap else c


def _title_of(toks: Column) -> Column:
    titles = F.filter(toks, lambda t: dom.tag_name(t) == "title")
    return F.array_join(F.transform(titles, lambda t: decode_entities(dom.raw_text(t))), "")


def _hrefs_of(toks: Column) -> Column:
    links = F.filter(toks, lambda t: t.rlike(r"^<[aA][\t\n\f\r />]"))
    hrefs = F.filter(F.transform(links, lambda t: dom.attribute(t, "href")), lambda x: x.isNotNull())
    return F.transform(hrefs, decode_entities)


def _text_of(toks: Column, drop: Iterable[str]) -> Column:
    return F.array_join(dom.texts(dom.body_of(toks), decode_entities, tuple(drop)), "")


def page_tree(html, drop: Iterable[str] = ()) -> Column:
    """``dom.tree`` with character references decoded in the texts."""
    return dom.tree(html, decode_entities, tuple(drop))


def body_text(html, drop: Iterable[str] = RAW_TEXT_TAGS, cap: int | None = None) -> Column:
    """``$("body").text()`` after ``$(drop).remove()``; ``cap``: only the first so
    many characters of the page (none by default)."""
    return let(dom.tokens(cap_html(html, cap)), lambda t: _text_of(t, drop))


def page_parts(html, drop: Iterable[str] = RAW_TEXT_TAGS, title: bool = False) -> Column:
    """Struct of text and hrefs (or, with ``title``, text and title): the page
    is cut into tokens once for both."""
    def parts(t):
        other = _title_of(t).alias("title") if title else _hrefs_of(t).alias("hrefs")
        return F.struct(_text_of(t, drop).alias("text"), other)
    return let(dom.tokens(html), parts)


def with_body_text(html: str, out: str, drop: Iterable[str] = RAW_TEXT_TAGS,
                   cap: int | None = None) -> Callable[[DataFrame], DataFrame]:
    def t(df: DataFrame) -> DataFrame:
        return df.withColumn(out, body_text(html, drop, cap))
    return t


def with_title_text(html: str, out: str) -> Callable[[DataFrame], DataFrame]:
    """``$("title").text()``: all title elements joined, references decoded."""
    def t(df: DataFrame) -> DataFrame:
        return df.withColumn(out, let(dom.tokens(html), _title_of))
    return t


def with_anchor_hrefs(html: str, out: str, cap: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """href values of all ``<a href>`` elements in document order (decoded).

    Anchors without an href attribute are skipped, as an ``a[href...]``
    selector would skip them; what stands inside raw-text elements is no anchor.
    """
    def t(df: DataFrame) -> DataFrame:
        return df.withColumn(out, let(dom.tokens(cap_html(html, cap)), _hrefs_of))
    return t
