"""HTML tokens and element trees as column expressions.

``tokens`` cuts a page into comments, raw-text elements, tags and text with one
regular expression that follows the HTML standard's tokenizer: quotes count
only after ``=``, an open quote or tag at the end of input swallows the rest,
``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text, the text of
script, style and the like ends at their end tag or at the end of input only.

``nodes`` folds the tag tokens over a stack of open elements and gives each
element as an interval of token numbers with its parent.  A start tag first
closes what it implies closed (``p`` before blocks, ``li``, ``dd``, ``option``,
table parts, headings, links, buttons); an end tag closes up to its element if
no scope boundary lies between and is ignored otherwise; what is open at the
end closes there.  The stack is a short string, top first (``;li#14;ul#9;``),
rules are regular expressions on it, and the fold runs in blocks of ``BLOCK``
tags so that the growing output is copied once a block, not once a tag.

Limits: misnested formatting elements are closed, not reopened; text in a table
outside its cells stays in place; ``head`` and ``body`` that are not written
are not elements (``body_start`` finds where the body's content begins).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import col_, let

WS = r"\t\n\f\r "
# --- fixed values: element names by their part in the HTML standard ----------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW_TEXT = ["script", "style", "noscript", "iframe", "noembed", "noframes", "xmp"]
RAW_WITH_REFERENCES = ["title", "textarea"]
HEAD_CONTENT = ["html", "head", "base", "link", "meta", "title", "script", "style", "noscript", "noframes", "template"]
CLOSES_P = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
            "figure", "footer", "form", "header", "hgroup", "hr", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
            "summary", "table", "ul", "h1", "h2", "h3", "h4", "h5", "h6", "xmp"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
SCOPE = ["applet", "caption", "html", "table", "td", "th", "marquee", "object", "template"]
SPECIAL = ["address", "applet", "area", "article", "aside", "base", "blockquote", "body", "br", "button", "caption", "center", "col",
           "colgroup", "dd", "details", "dir", "div", "dl", "dt", "embed", "fieldset", "figcaption", "figure", "footer", "form", "frame",
           "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "iframe", "img", "input", "li", "link",
           "listing", "main", "marquee", "menu", "meta", "nav", "noembed", "noframes", "noscript", "object", "ol", "p", "param", "pre",
           "script", "search", "section", "select", "source", "style", "summary", "table", "tbody", "td", "template", "textarea", "tfoot",
           "th", "thead", "title", "tr", "track", "ul", "wbr", "xmp"]
BLOCK_ENDS = ["address", "article", "aside", "blockquote", "button", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
              "figcaption", "figure", "footer", "form", "header", "hgroup", "listing", "main", "menu", "nav", "ol", "pre", "search",
              "section", "summary", "ul", "applet", "marquee", "object", "dd", "dt"]
TABLE_PARTS = ["caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"]

BLOCK = 256

_ATTRIBUTES = (rf"""(?:[{WS}/]++|[^{WS}/>][^{WS}/>=]*+(?:[{WS}]*+=[{WS}]*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^{WS}>"'][^{WS}>]*+)?+)?+)*+""")
TOKEN_RE = "(?is)" + "|".join([
    r"<!--(?:-?>|.*?(?:--!?>|\z))",
    rf"<({'|'.join(RAW_TEXT + RAW_WITH_REFERENCES)})(?=[{WS}/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[{WS}/>])[^>]*+(?:>|\z)|\z)|\z)",
    rf"</?[a-z][^{WS}/>]*+{_ATTRIBUTES}(?:>|\z)",
    r"<[!?][^>]*+(?:>|\z)",
    r"</[^a-z][^>]*+(?:>|\z)",
    r"[^<]++",
    r"<",
])
_RAW_RE = rf"(?is)^<(?:{'|'.join(RAW_TEXT + RAW_WITH_REFERENCES)})(?=[{WS}/>])"


def tokens(html) -> Column:
    """The page as an array of strings; joined they are the page, but for a tag
    that the end of input cuts off, which is left out as a tokenizer does."""
    def whole(toks):
        last = F.get(toks, F.size(toks) - 1)
        cut = last.rlike(r"(?s)^</?[A-Za-z]") & ~is_raw(last) & ~last.rlike(rf"(?is)^</?[a-z][^{WS}/>]*+{_ATTRIBUTES}>\z")
        return F.when(F.coalesce(cut, F.lit(False)), F.slice(toks, F.lit(1), F.size(toks) - 1)).otherwise(toks)
    return let(F.regexp_extract_all(col_(html), F.lit(TOKEN_RE), 0), whole)


def tag_name(token: Column) -> Column:
    """Lower-case name of a start or end tag, empty for other tokens."""
    return F.lower(F.regexp_extract(token, rf"^</?([A-Za-z][^{WS}/>]*)", 1))


def is_text(token: Column) -> Column:
    return ~token.rlike(r"^<(?:/.|[A-Za-z!?])") & (token != "</>")


def is_raw(token: Column) -> Column:
    return token.rlike(_RAW_RE)


def raw_text(token: Column) -> Column:
    """The text inside a raw-text element's token, character references as they are."""
    return F.regexp_extract(token, rf"(?is)^<([a-z]+){_ATTRIBUTES}>(.*?)(?:</\1(?=[{WS}/>])[^>]*+(?:>|\z)|\z)$", 2)


def attribute(token: Column, name: str) -> Column:
    """Value of a start tag's attribute as written: empty if without a value,
    null if the tag has none of that name (the first one counts)."""
    rest = F.regexp_replace(token, rf"(?s)^<[A-Za-z][^{WS}/>]*+|>\z", "")
    pattern = rf"""(?s)[^{WS}/>][^{WS}/>=]*+(?:[{WS}]*+=[{WS}]*+(?:"[^"]*+"|'[^']*+'|[^{WS}>"'][^{WS}>]*+)?+)?+"""
    found = F.get(F.filter(F.regexp_extract_all(rest, F.lit(pattern), 0), lambda a: F.lower(a).rlike(rf"^{name}(?:[{WS}]*=|\z)")), 0)
    value = F.regexp_replace(found, rf"(?s)^[^{WS}/>=]*+[{WS}]*+=?[{WS}]*+", "")
    return F.regexp_replace(value, r"""(?s)^"(.*)"\z|^'(.*)'\z""", "$1$2")


def has_class(token: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attribute(token, "class"), F.lit("")), rf"[{WS}]+"), name)


def texts(toks: Column, decode, drop: Iterable[str] = ()) -> Column:
    """The text that each token adds: ``decode`` resolves character references;
    tags, comments and the raw-text elements named in ``drop`` add none."""
    def one(t):
        inside = F.when(tag_name(t).isin(*RAW_WITH_REFERENCES), decode(raw_text(t))).otherwise(raw_text(t))
        if drop:
            inside = F.when(tag_name(t).isin(*drop), F.lit("")).otherwise(inside)
        return F.when(~t.startswith("<"), decode(t)).when(is_raw(t), inside).when(is_text(t), t).otherwise(F.lit(""))
    return F.transform(toks, one)


def body_start(toks: Column) -> Column:
    """Number (from 0) of the first token of the body: its start tag, or the
    first token that cannot stand in the head; the array's size if there is none.
    What is written inside an open head before its end tag counts as well."""
    def head_only(t):
        return F.when(~t.startswith("<"), t.rlike(rf"^[{WS}]*+\z")).when(is_text(t), F.lit(False)).otherwise(tag_name(t).isin("", *HEAD_CONTENT))
    at = F.array_position(F.transform(toks, lambda t: ~head_only(t)), True)
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.size(toks))


def body_of(toks: Column) -> Column:
    return F.slice(toks, body_start(toks) + 1, F.greatest(F.size(toks), F.lit(1)))


# --- element tree ------------------------------------------------------------

def _through(targets: Iterable[str], barriers: Iterable[str]) -> str:
    """Regex of the stack's top down to and with the nearest target, if no
    barrier comes first."""
    stop = "|".join(sorted(set(barriers) - set(targets)))
    hit = "|".join(targets)
    return rf"^(?:;(?!(?:{stop}|{hit})#)[^;#]++#[0-9]++)*+;(?:{hit})#[0-9]++"


def _cases(name: Column, stack: Column, rules) -> Column:
    out = None
    for names, patterns in rules:
        pop = F.regexp_extract(stack, patterns[0], 0)
        if len(patterns) > 1:
            pop = F.coalesce(F.nullif(pop, F.lit("")), F.regexp_extract(stack, patterns[1], 0))
        out = F.when(name.isin(*names), pop) if out is None else out.when(name.isin(*names), pop)
    return out


_P = _through(["p"], [*SCOPE, "button"])
_OPEN_RULES = [
    (["li"], [_through(["li"], set(SPECIAL) - {"address", "div", "p"}), _P]),
    (["dd", "dt"], [_through(["dd", "dt"], set(SPECIAL) - {"address", "div", "p"}), _P]),
    (HEADINGS, [_through(["p", *HEADINGS], [*SPECIAL, "button"])]),
    ([n for n in CLOSES_P if n not in HEADINGS], [_P]),
    (["a"], [_through(["a"], [*SCOPE, "button"])]),
    (["button"], [_through(["button"], SCOPE)]),
    (["option"], [_through(["option"], SPECIAL)]),
    (["optgroup"], [_through(["optgroup"], ["select", *SCOPE]), _through(["option"], SPECIAL)]),
    (["td", "th"], [_through(["td", "th"], ["tr", "table", "template", "html"])]),
    (["tr"], [_through(["tr", "caption", "colgroup"], ["table", "tbody", "thead", "tfoot", "template", "html"])]),
    (["tbody", "thead", "tfoot", "caption", "colgroup"], [_through(["tbody", "thead", "tfoot", "caption", "colgroup"], ["table", "template", "html"])]),
    (["body"], [_through(["head"], ["body"])]),
]
_CLOSE_RULES = [
    (["p"], [_P]),
    (["li"], [_through(["li"], [*SCOPE, "ol", "ul"])]),
    (HEADINGS, [_through(HEADINGS, SCOPE)]),
    (["head"], [_through(["head"], ["body"])]),
    (["table"], [_through(["table"], ["template", "html"])]),
]


def _popped(name: Column, stack: Column, start: Column) -> Column:
    same = [([n], [_through([n], SCOPE)]) for n in BLOCK_ENDS] + [([n], [_through([n], ["table", "template", "html"])]) for n in TABLE_PARTS]
    ordinary = [([n], [_through([n], SPECIAL)]) for n in ("a", "b", "i", "span", "strong", "em", "font", "small", "u", "label", "select", "option")]
    # any other element: the same rule with the name quoted into the pattern
    other = F.coalesce(F.regexp_substr(stack, F.concat(F.lit(rf"^(?:;(?!(?:{'|'.join(SPECIAL)})#)(?!\Q"), name, F.lit(r"\E#)[^;#]++#[0-9]++)*+;\Q"),
                                                       name, F.lit(r"\E#[0-9]++"))), F.lit(""))
    closing = _cases(name, stack, _CLOSE_RULES + same + ordinary).when(name.isin("html", "body"), F.lit("")).otherwise(other)
    return F.when(start, _cases(name, stack, _OPEN_RULES).otherwise(F.lit(""))).otherwise(closing)


def nodes(toks: Column) -> Column:
    """Elements in document order: struct(id, end, parent, name).  ``id`` is
    the number of the start tag's token; what lies inside has numbers between
    ``id`` and ``end``; ``parent`` is an id, or -1."""
    def tag(t, i):
        raw = is_raw(t)
        return F.struct(i.alias("i"), F.regexp_replace(tag_name(t), "[;#|@\\\\]", "_").alias("n"), (~t.startswith("</")).alias("s"), raw.alias("raw"))

    tags = F.filter(F.transform(toks, tag), lambda x: x["n"] != "")

    def step(acc, x):
        name, stack = x["n"], acc["s"]

        def after(pop):
            def then(rest):
                top = F.regexp_extract(rest, r"^;[^#]*#([0-9]+)", 1)
                number = x["i"].cast("string")
                item = F.concat(F.lit(";"), name, F.lit("#"), number)
                again = name.isin("html", "body", "head") & (rest.contains(F.concat(F.lit(";"), name, F.lit("#"))) | rest.contains(";body#"))
                alone = x["s"] & (x["raw"] | name.isin(*VOID))
                gone = F.when(pop != "", F.concat(pop, F.lit("|"), top, F.lit("@"), number, F.lit("\n"))).otherwise(F.lit(""))
                single = F.when(alone, F.concat(item, F.lit("|"), top, F.lit("@"), number, F.lit("\n"))).otherwise(F.lit(""))
                return F.struct(F.when(x["s"] & ~alone & ~again, F.concat(item, rest)).otherwise(rest).alias("s"),
                                F.concat(acc["o"], gone, single).alias("o"))
            return let(F.substr(stack, F.length(pop) + 1), then)
        return let(_popped(name, stack, x["s"]), after)

    empty = F.struct(F.lit("").alias("s"), F.lit("").alias("o"))

    def blocks(all_tags):
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_tags), F.lit(1)), F.lit(BLOCK))

        def block(acc, at):
            inner = F.aggregate(F.slice(all_tags, at, F.lit(BLOCK)), F.struct(acc["s"].alias("s"), F.lit("").alias("o")), step)
            return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], r["o"]).alias("o")))

        return F.aggregate(starts, empty, block, lambda acc: F.concat(
            acc["o"], acc["s"], F.lit("|@"), F.size(toks).cast("string")))

    def record(rec):
        names, ids = (F.regexp_extract_all(rec, F.lit(r";([^;#]+)#([0-9]+)"), k) for k in (1, 2))
        top, end = F.regexp_extract(rec, r"\|([0-9]*)@", 1), F.regexp_extract(rec, r"@([0-9]+)\z", 1).cast("int")
        return let(F.struct(names.alias("n"), ids.alias("i"), top.alias("t"), end.alias("e")), lambda r: F.transform(r["i"], lambda i, k: F.struct(
            i.cast("int").alias("id"), r["e"].alias("end"),
            F.coalesce(F.get(r["i"], k + 1).try_cast("int"), r["t"].try_cast("int"), F.lit(-1)).alias("parent"),
            F.get(r["n"], k).alias("name"))))

    return let(tags, lambda all_tags: F.sort_array(F.flatten(F.transform(F.split(blocks(all_tags), "\n"), record))))


def tree(html, decode, drop: Iterable[str] = ()) -> Column:
    """struct(tokens, texts, nodes) of a page; bind it with ``let``."""
    return let(tokens(html), lambda t: F.struct(t.alias("tokens"), texts(t, decode, drop).alias("texts"), nodes(t).alias("nodes")))


def inside(node: Column, other: Column) -> Column:
    """Whether ``node`` is a descendant of ``other``."""
    return (node["id"] > other["id"]) & (node["id"] < other["end"])


def token_of(tree: Column, node: Column) -> Column:
    return F.get(tree["tokens"], node["id"])


def text_of(tree: Column, node: Column) -> Column:
    """``.text()`` of one element (its own token's text if it is raw text)."""
    last = F.greatest(node["end"], node["id"] + 1)
    return F.array_join(F.slice(tree["texts"], node["id"] + 1, last - node["id"]), "")
