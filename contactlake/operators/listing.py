"""Result-page cards and page metadata (S4, F4, A5) on the element tree.

``dom.tree`` gives a page's tokens and elements; cards, their descendants,
children by place and ancestors are found by token intervals and parents at any
depth, as selectors would.  The class names are parameters.  All expressions
run in the scan stage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import dom
from contactlake.functions.html import decode_entities, page_tree
from contactlake.functions.text import JSWS, js_trim, let
from contactlake.functions.urls import unwrap_redirect
from contactlake.functions.validate import validate_records
from contactlake.operators.reports import listing_page_meta


class Marks(NamedTuple):
    """Class names and ids of a result page."""
    card: str = "VkpGBb"
    title: str = "dbg0pd"
    name: str = "OSrXXb"
    details: str = "rllt__details"
    website: str = "BSaJxc"
    next_box: str = "d6cvqb"
    next_id: str = "pnnext"
    next_label: str = "Next page"
    next_text: str = "Next"
    stats_id: str = "resultStats"


PHONE_RE = f"([0-9]{{3,}}[-.{JSWS}]?[0-9]{{3,}}[-.{JSWS}]?[0-9]{{4}})"

def _attribute(tree: Column, node: Column, name: str) -> Column:
    return dom.attribute(dom.token_of(tree, node), name)


def _with_class(tree: Column, name: str) -> Column:
    """Elements with the class; the plain search spares parsing most attributes."""
    return F.filter(tree["nodes"], lambda n: dom.token_of(tree, n).contains(name) & dom.has_class(dom.token_of(tree, n), name))


def _text(tree: Column, elements: Column) -> Column:
    """``.text()`` of a list of elements."""
    return F.array_join(F.transform(elements, lambda n: dom.text_of(tree, n)), "")


def _cards(tree: Column, marks: Marks) -> Column:
    """The raw fields of every card."""
    def of_card(card, found):
        within = lambda ns: F.filter(ns, lambda n: dom.inside(n, card))
        names = F.filter(within(found["names"]), lambda n: F.exists(found["titles"], lambda t: dom.inside(n, t)))
        children = let(within(found["details"]), lambda boxes: F.filter(
            tree["nodes"], lambda n: (n["name"] == "div") & F.exists(boxes, lambda b: b["id"] == n["parent"])))
        parent = lambda n, then: let(F.get(F.filter(tree["nodes"], lambda m: m["id"] == n["parent"]), 0), then)
        # the first link with a website mark inside the card's grandparent (the page, if there is none)
        link = parent(card, lambda up: parent(up, lambda box: F.get(F.filter(found["links"], lambda a: F.coalesce(dom.inside(a, box), F.lit(True))), 0)))

        def fields(rows):
            line = lambda i: js_trim(_text(tree, F.slice(rows, i + 1, 1)))
            return F.struct(js_trim(_text(tree, names)).alias("name"),
                            F.regexp_extract(line(3), PHONE_RE, 1).alias("phone"),
                            F.coalesce(let(link, lambda a: decode_entities(_attribute(tree, a, "href"))), F.lit("")).alias("href"),
                            line(2).alias("address"),
                            js_trim(F.regexp_replace(line(1), f"^.*·[{JSWS}]*", "")).alias("category"))
        return let(children, fields)

    marked = {f: _with_class(tree, c) for f, c in (("cards", marks.card), ("titles", marks.title), ("names", marks.name),
                                                   ("details", marks.details), ("sites", marks.website))}

    def linked(m):
        links = F.filter(tree["nodes"], lambda a: (a["name"] == "a") & F.exists(m["sites"], lambda w: dom.inside(w, a)))
        found = F.struct(links.alias("links"), *[m[f].alias(f) for f in ("titles", "names", "details", "cards")])
        return let(found, lambda g: F.transform(g["cards"], lambda card: of_card(card, g)))
    return let(F.struct(*[v.alias(f) for f, v in marked.items()]), linked)


def with_cards(pages: DataFrame, marks: Marks = Marks(), keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """S4 + F4: a row per named card: ``keep``, pos (from 0 over all cards of
    the page) and the six raw fields."""
    t = pages.select(*keep, F.posexplode(let(page_tree("html"), lambda tree: _cards(tree, marks))).alias("pos", "c"))
    t = t.select(*keep, F.col("pos").cast("bigint").alias("pos"), F.col("c.name").alias("name"), F.col("c.phone").alias("phone"),
                 F.lit("").alias("email"), unwrap_redirect(F.col("c.href")).alias("website"), F.col("c.address").alias("address"),
                 F.col("c.category").alias("category"))
    return t.where(F.col("name") != "")


def listing_businesses(pages: DataFrame, marks: Marks = Marks(), keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The cards as validated business rows (V6)."""
    return with_cards(pages, marks, keep).transform(validate_records(keep=(*keep, "pos")))


def result_meta(pages: DataFrame, marks: Marks = Marks(), page: str = "page", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A5 of each result page: any of the three next markers, the first number
    of the statistics text, pages from it or from the marker."""
    def read(tree):
        boxes = _with_class(tree, marks.next_box)

        def is_next(a, boxed):
            return ((_attribute(tree, a, "id") == marks.next_id) & F.exists(boxed, lambda b: dom.inside(a, b))
                    | (_attribute(tree, a, "aria-label") == marks.next_label)
                    | dom.text_of(tree, a).contains(marks.next_text))
        has_next = let(boxes, lambda boxed: F.exists(tree["nodes"], lambda a: (a["name"] == "a") & F.coalesce(is_next(a, boxed), F.lit(False))))
        stats = F.filter(tree["nodes"], lambda n: dom.token_of(tree, n).contains(marks.stats_id)
                         & F.coalesce(_attribute(tree, n, "id") == marks.stats_id, F.lit(False)))
        return F.struct(has_next.alias("next"), _text(tree, stats).alias("stats"))

    pages = pages.withColumn("__m", let(page_tree("html"), read))
    has_next, stats = F.col("__m.next"), F.col("__m.stats")
    number = F.replace(F.regexp_extract(stats, "([0-9,]+)", 1), F.lit(","), F.lit(""))
    t = pages.select(*keep, F.col(page).cast("bigint").alias("__p"), has_next.alias("__n"),
                     F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("__t"))
    return t.select(*keep, *listing_page_meta("__t", "__p", "__n"))
