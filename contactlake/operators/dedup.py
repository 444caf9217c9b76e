"""Ordered near-duplicate removal (D1, D8, D9) as Spark jobs.

Rule (D9): walk rows by ``ord``; a row is dropped when its signature equals
that of a *kept* row, or when its score with any *kept* row exceeds 0.85;
otherwise it is kept.  Dropped rows never suppress others, so this is the
order-first maximal independent set of the graph "score > 0.85 or equal
signature" - not connected components.

Distributed plan
----------------
1. *Features* per row (normalised name/address, phone digits, host,
   signature): narrow, in the scan stage.
2. *Lossless blocking by the weights.*  Without a phone term the score is at
   most .4+.15+.15+.1 = .80, so an edge needs equal or contained phones.  If
   the hosts (without ``www.``) differ, .4+.2+.15+.1 is just above .85: phone,
   name, address and e-mail must all be equal.  If they are equal, equal phones
   meet on (host, digits), and a phone contained in another one meets it on
   (host, 7 digits), shorter ones on (host, digits); phones without any digit
   are contained in every phone and meet the others of their host.  A length
   bound drops names that cannot reach the needed similarity, and the names'
   edit distance stops there.  For D9, pairs with equal signatures are left
   out.  Hosts of more than ``blocking.PLAIN_ROWS`` rows do not form all pairs
   of a block: prefix filters on q-grams find those that can be edges.
3. *Equal rows are one*: of rows that agree in all features only the first
   takes part; the others share its fate or are dropped after it.
   *Signature groups are never expanded into pairs*: per round two grouped
   minima (earliest kept, earliest undecided ``ord`` per signature) answer
   every signature question; partial aggregation makes hot signatures cheap.
4. *Resolution rounds*: an undecided row is dropped when an earlier
   neighbour is kept, kept when it has no earlier undecided neighbour (score
   edges) and is the earliest undecided row of its signature.  Signatures no
   row of which has an edge are settled at once by their minimum and do not
   enter the loop.  The smallest
   undecided ``ord`` is settled every round, so the loop terminates; state
   and remaining edges are reliably checkpointed each round (lineage cut in
   the shared checkpoint folder, so lost executors recompute one round).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlake.functions import similarity as SIM
from contactlake.functions.urls import with_url_host
from contactlake.operators import blocking as BL
from contactlake.session import ensure_checkpoint_dir

GRAM = 7
# Minimum name similarity an edge needs (all other terms at their maximum);
# the shorter name must be at least this fraction of the longer one.
NAME_LEN_RATIO = (SIM.DUPLICATE_THRESHOLD - (1.0 - SIM.WEIGHTS["name"])) / SIM.WEIGHTS["name"]

FEATURE_COLS = ["ord", "phone", "email", "website", "nname", "naddr", "pd", "host", "sig"]


def with_dedup_features(name="name", phone="phone", email="email", website="website",
                        address="address") -> Callable[[DataFrame], DataFrame]:
    """D1-D3 per row: nname, naddr, pd (phone digits), host, sig."""
    def t(df: DataFrame) -> DataFrame:
        df = df.transform(with_url_host(website, "host"))
        df = (df.withColumn("nname", SIM.normalize_name(name))
                .withColumn("naddr", SIM.normalize_address(address))
                .withColumn("pd", SIM.phone_digits(phone)))
        return df.withColumn("sig", F.lower(F.concat_ws(
            "|", F.col("nname"), F.col("pd"), F.coalesce(F.col("host"), F.lit("")))))
    return t


def _eligible(feat: DataFrame) -> DataFrame:
    """Rows that can take part in a score edge: phone and name present."""
    return feat.where((F.coalesce(F.col("phone"), F.lit("")) != "") & (F.col("nname") != ""))


def candidate_pairs(feat: DataFrame, equal_signatures: bool = True) -> DataFrame:
    """(a, b) with a < b: no pair that can score above the threshold is missed.
    Without ``equal_signatures``, pairs of one signature are left out."""
    host = F.regexp_replace("host", r"^www\.", "")
    el = _eligible(feat).select("ord", "pd", F.length("pd").alias("n"), "nname", "naddr", "sig",
                                F.coalesce("email", F.lit("")).alias("email"), F.coalesce(host, F.lit("")).alias("h"))
    left = el.select(*[F.col(c).alias(f"a_{c}") for c in el.columns])
    right = el.select(*[F.col(c).alias(f"b_{c}") for c in el.columns])

    def pairs(j: DataFrame, cond) -> DataFrame:
        j = j.where(cond & (F.col("a_ord") != F.col("b_ord")))
        la, lb = F.length("a_nname"), F.length("b_nname")
        j = j.where(F.least(la, lb) >= F.greatest(la, lb) * F.lit(NAME_LEN_RATIO) - F.lit(1e-9))
        if not equal_signatures:
            j = j.where(F.col("a_sig") != F.col("b_sig"))
        return j.select(F.least("a_ord", "b_ord").alias("a"), F.greatest("a_ord", "b_ord").alias("b"))

    def equal(*cols):
        out = F.lit(True)
        for c in cols:
            out = out & (F.col(f"a_{c}") == F.col(f"b_{c}"))
        return out

    once = F.col("a_ord") < F.col("b_ord")
    parts = [pairs(left.where((F.col("a_naddr") != "") & (F.col("a_email") != "")).join(right, equal("pd", "nname", "naddr", "email")), once)]

    def within_hosts(hosted: DataFrame, other: DataFrame, join) -> None:
        """``join(x, y, keys, phone)`` pairs rows of one host with equal keys."""
        inside = F.col("a_pd").contains(F.col("b_pd")) & (F.col("a_pd") != F.col("b_pd"))
        contained = SIM.PHONE_CONTAINED_SCORE
        grams = hosted.where(F.col("a_n") >= GRAM).withColumn("a_g", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.col("a_n") - GRAM + 1), lambda i: F.substring(F.col("a_pd"), i, GRAM)))))
        firsts = other.where(F.col("b_n") >= GRAM).withColumn("b_g", F.substring("b_pd", 1, GRAM))
        shorts = other.where(F.col("b_n").between(1, GRAM - 1)).withColumn("b_g", F.col("b_pd"))
        # rows are cut into all their short substrings only where their host has a short phone
        near = hosted.join(shorts.select(F.col("b_h").alias("a_h")).distinct(), "a_h", "left_semi").select(*hosted.columns)
        subs = near.where(F.col("a_n") > 1).withColumn("a_g", F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.least(F.col("a_n"), F.lit(GRAM - 1))),
            lambda ln: F.transform(F.sequence(F.lit(1), F.col("a_n") - ln + 1), lambda i: F.substring(F.col("a_pd"), i, ln)))))))
        for x, y, keys, phone, cond in ((hosted, other, ["h", "pd"], 1.0, once), (grams, firsts, ["h", "g"], contained, inside),
                                        (subs, shorts, ["h", "g"], contained, inside),
                                        (hosted.where(F.col("a_n") > 0), other.where(F.col("b_n") == 0), ["h"], contained, F.lit(True))):
            parts.extend(pairs(j, cond) for j in join(x, y, keys, phone))

    hosts = el.where("h != ''").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BL.PLAIN_ROWS).select("h")
    hosted, other = left.where(F.col("a_h") != ""), right.where(F.col("b_h") != "")
    plain = lambda x, y, keys, phone: [x.join(y, equal(*keys))]
    if hosts.isEmpty():
        within_hosts(hosted, other, plain)
    else:
        side = lambda df, p, how: df.join(hosts.select(F.col("h").alias(f"{p}h")), f"{p}h", how).select(*df.columns)
        within_hosts(side(hosted, "a_", "left_anti"), side(other, "b_", "left_anti"), plain)
        ensure_checkpoint_dir(feat.sparkSession)        # the branches below read these several times
        hot = side(hosted, "a_", "left_semi").checkpoint()
        again = hot.toDF(*[f"b_{c[2:]}" for c in hot.columns])
        tables = {f: BL.ordered_grams(hot.select(F.col(f"a_{f}").alias("value"))).checkpoint() for f in ("nname", "naddr")}
        within_hosts(hot, again, lambda x, y, keys, phone: BL.edge_candidates(x, y, keys, phone, tables))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def score_pairs(feat: DataFrame, pairs: DataFrame) -> DataFrame:
    """D8 for candidate pairs: (a, b, score) with all five terms."""
    f = feat.select(*FEATURE_COLS)
    fa = f.select(*[F.col(c).alias(f"a_{c}") for c in FEATURE_COLS])
    fb = f.select(*[F.col(c).alias(f"b_{c}") for c in FEATURE_COLS])
    j = pairs.join(fa, pairs.a == fa.a_ord).join(fb, pairs.b == fb.b_ord)
    la, lb = F.length("a_nname"), F.length("b_nname")
    # Names too different in length cannot reach the needed similarity even
    # with every other term at its maximum (exact bound, small slack).
    j = j.where(F.least(la, lb) >= F.greatest(la, lb) * F.lit(NAME_LEN_RATIO) - F.lit(1e-9))
    most = f"cast(floor({1 - NAME_LEN_RATIO} * greatest(length(a_nname), length(b_nname)) + 1e-9) as int)"
    j = j.where(f"levenshtein(a_nname, b_nname, {most}) >= 0")
    j = j.select(
        "a", "b",
        SIM.string_similarity("a_nname", "b_nname").alias("s_name"),
        SIM.phone_similarity("a_phone", "a_pd", "b_phone", "b_pd").alias("s_phone"),
        SIM.website_similarity("a_website", "a_host", "b_website", "b_host").alias("s_web"),
        SIM.string_similarity("a_naddr", "b_naddr").alias("s_addr"),
        SIM.email_similarity("a_email", "b_email").alias("s_email"))
    return j.withColumn("score", SIM.pair_score("s_name", "s_phone", "s_web", "s_addr", "s_email"))


def duplicate_edges(feat: DataFrame, equal_signatures: bool = True) -> DataFrame:
    """All (a, b, score) with a < b and score > 0.85."""
    return score_pairs(feat, candidate_pairs(feat, equal_signatures)).where(F.col("score") > SIM.DUPLICATE_THRESHOLD) \
        .select("a", "b", "score")


def resolve_ordered(spark: SparkSession, feat: DataFrame, edges: DataFrame) -> DataFrame:
    """D9 resolution: returns (ord, kept boolean) for every row."""
    ensure_checkpoint_dir(spark)
    e = edges.select("a", "b").checkpoint(eager=True)
    ends = e.select(F.explode(F.array("a", "b")).alias("ord")).distinct()
    live = feat.select("ord", "sig").join(ends, "ord", "left_semi").select("sig").distinct()
    alone = feat.select("ord", "sig").join(live, "sig", "left_anti")
    settled = alone.join(alone.groupBy("sig").agg(F.min("ord").alias("__m")), "sig").select(
        "ord", (F.col("ord") == F.col("__m")).alias("kept"))
    state = feat.select("ord", "sig", F.lit(0).alias("st")).join(live, "sig", "left_semi").checkpoint(eager=True)
    while not state.where(F.col("st") == 0).isEmpty():
        sig_info = state.groupBy("sig").agg(
            F.min(F.when(F.col("st") == 1, F.col("ord"))).alias("mk"),
            F.min(F.when(F.col("st") == 0, F.col("ord"))).alias("mu"))
        sa = state.select(F.col("ord").alias("a"), F.col("st").alias("sta"))
        nb = (e.join(sa, "a").groupBy("b").agg(
            F.max((F.col("sta") == 1).cast("int")).alias("k_before"),
            F.max((F.col("sta") == 0).cast("int")).alias("u_before")))
        s = (state.join(sig_info, "sig").join(nb, state.ord == nb.b, "left")
             .select("ord", "sig", "st", "mk", "mu",
                     F.coalesce("k_before", F.lit(0)).alias("kb"),
                     F.coalesce("u_before", F.lit(0)).alias("ub")))
        new_st = (F.when(F.col("st") != 0, F.col("st"))
                  .when((F.col("kb") == 1) | (F.col("mk") < F.col("ord")), F.lit(2))
                  .when((F.col("ub") == 0) & (F.col("mu") == F.col("ord")), F.lit(1))
                  .otherwise(F.lit(0)))
        state = s.select("ord", "sig", new_st.alias("st")).checkpoint(eager=True)
        # Edges stay only while their later end is undecided and the earlier
        # end is not dropped.
        live_b = state.where(F.col("st") == 0).select(F.col("ord").alias("b"))
        not_dropped_a = state.where(F.col("st") != 2).select(F.col("ord").alias("a"))
        e = e.join(live_b, "b", "left_semi").join(not_dropped_a, "a", "left_semi").checkpoint(eager=True)
    return state.select("ord", (F.col("st") == 1).alias("kept")).unionByName(settled)


def dedup_ordered(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """D9 on a business DataFrame (name, phone, email, website, address,
    category + unique ``ord``); returns the kept rows, same columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = (df.withColumnRenamed(ord_col, "ord") if ord_col != "ord" else df).checkpoint(eager=True)
    kept = kept_rows(base.transform(with_dedup_features()).select(*FEATURE_COLS))
    out = base.join(kept, "ord", "left_semi")
    return out.withColumnRenamed("ord", ord_col) if ord_col != "ord" else out


def kept_rows(feat: DataFrame) -> DataFrame:
    """D9 on features (``FEATURE_COLS``): (ord) of the rows that are kept."""
    spark = feat.sparkSession
    ensure_checkpoint_dir(spark)
    blank = lambda c: (F.coalesce(F.col(c), F.lit("")) == "").alias(f"no_{c}")
    # rows equal in all that scores read: phone and website count by digits, host and being there
    feat = feat.groupBy("nname", "naddr", "pd", "host", "email", "sig", blank("phone"), blank("website")).agg(
        F.min_by(F.struct("ord", "phone", "website"), "ord").alias("f")).select(
        "f.*", "nname", "naddr", "pd", "host", "email", "sig").select(*FEATURE_COLS).checkpoint(eager=True)
    edges = duplicate_edges(feat, equal_signatures=False)
    return resolve_ordered(spark, feat, edges).where("kept").select("ord")
