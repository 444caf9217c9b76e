"""Candidate pairs inside hot blocks, by prefix filters on q-grams.

Rows that share a host (and a phone) leave a duplicate edge to name, address
and e-mail: with ``rest`` = the threshold less the phone's and the host's
share, an edge needs 0.4 name + 0.15 address + 0.1 e-mail > ``rest``.  So its
e-mails are equal, or of one domain, or count nothing, and each case bounds the
names' similarity from below; where that bound is low, either the addresses
are similar (``ADDRESS``) or the names' bound rises.

Two strings of edit similarity above ``m`` share one of their first
``Q * edits + 1`` q-grams in any common order, ``edits`` being the most that the
longest possible partner allows (with Q = 3 every pair has grams enough if m is
above two thirds, as all bounds here are).  The order is by frequency, rarest first, so hot grams come last and
are mostly cut off.  No pair that can be an edge is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.functions import similarity as SIM

Q = 3
ADDRESS = 0.8
#: Names' bound from which names alone are looked up.
SELECTIVE = 0.75
#: Most rows of a host whose blocks are compared pair by pair.
PLAIN_ROWS = 128


def grams(value: Column) -> Column:
    """The q-grams of a padded string, each with its number among equal ones."""
    pad = F.lit("\x01" * (Q - 1))
    padded = F.concat(pad, value, pad)
    plain = F.transform(F.sequence(F.lit(1), F.length(value) + Q - 1), lambda i: F.substring(padded, i, F.lit(Q)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i), lambda x: x == g)).cast("string")))


def ordered_grams(values: DataFrame) -> DataFrame:
    """(value, grams): each distinct string's grams, rarest first."""
    t = values.where("value != ''").distinct().select("value", F.explode(grams(F.col("value"))).alias("gram"))
    counts = t.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return t.join(counts, "gram").groupBy("value").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g")).select(
        "value", F.col("g.gram").alias("grams"))


def prefix(m: float) -> Column:
    """How many of a string's first grams to look up for similarity above m."""
    partner = F.floor(F.length("value") / m + 1e-9)
    return (Q * F.floor((1 - m) * partner + 1e-9) + 1).cast("int")


def similar_rows(x: DataFrame, y: DataFrame, keys: list[str], field: str, m: float, table: DataFrame) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ``field`` may be similar above m;
    columns carry the prefixes a_ and b_."""
    def side(df, p):
        t = df.join(table, F.col(f"{p}{field}") == F.col("value"))
        return t.select(*df.columns, F.explode(F.slice("grams", F.lit(1), prefix(m))).alias(f"{p}gram"))
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in [*keys, "gram"]]
    la, lb = F.length(f"a_{field}"), F.length(f"b_{field}")
    j = side(x, "a_").join(side(y, "b_"), reduce(lambda p, q: p & q, on))
    return j.where(F.least(la, lb) >= F.greatest(la, lb) * F.lit(m) - F.lit(1e-9))


def edge_candidates(x: DataFrame, y: DataFrame, keys: list[str], phone: float, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """All pairs with equal ``keys`` that can be edges if their hosts are equal
    and their phones score ``phone``; needs nname, naddr and email."""
    w = SIM.WEIGHTS
    rest = SIM.DUPLICATE_THRESHOLD - w["phone"] * phone - w["website"]
    domain = lambda p: F.coalesce(F.get(F.split(F.col(f"{p}email"), "@"), 1), F.lit(""))
    x, y = x.withColumn("a_domain", domain("a_")), y.withColumn("b_domain", domain("b_"))
    out = []
    for score, key in ((0.0, []), (SIM.EMAIL_SAME_DOMAIN_SCORE, ["domain"]), (1.0, ["email"])):
        left = rest - w["email"] * score
        bound = lambda address: (left - w["address"] * address) / w["name"] - 1e-9  # noqa: E731, B023
        xs, ys = (df.where(F.col(f"{p}{key[0]}") != "") if key else df for df, p in ((x, "a_"), (y, "b_")))
        if bound(1.0) >= SELECTIVE:
            out.append(similar_rows(xs, ys, keys + key, "nname", bound(1.0), tables["nname"]))
        else:
            out.append(similar_rows(xs, ys, keys + key, "nname", bound(ADDRESS), tables["nname"]))
            out.append(similar_rows(xs, ys, keys + key, "naddr", ADDRESS - 1e-9, tables["naddr"]))
    return out
