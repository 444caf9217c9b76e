"""Op 6: near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has CHUNKS chunks of WIDTH b-bit minima.  Two signatures that
differ in at most ``DISTANCE = 2 * CHUNKS - 1`` places have, by pigeonhole, a
chunk with one error at most; enumerating the place of that error gives WIDTH
keys per chunk, so every pair within the distance shares a key.  At the least
similarity of 0.8 a pair differs in 13 places on average; more than 25 has
probability 1.7e-4, and such a pair is lost unless other links join the two.

Documents with equal shingle sets become one class first.  Within a key's
bucket nothing is paired with everything: each member is compared with the
bucket's smallest one, and those within the distance make clusters.  The
members of a cluster are confirmed on full sets, block against block inside
tasks, and only a spanning forest of the links comes out, so a large group of
near copies yields rows in proportion to its size.  Members of one bucket in
different clusters are compared directly (signature distance in the join
condition), so no pair within the distance is left unseen; one of the two is
outside the bucket's largest cluster, so only those members meet the bucket.

Edge cases: null and wordless texts have an empty set, link with nothing and
are kept; texts with fewer words than a shingle are one shingle; repeated rows
share a class (equal ids are all kept); rows with a null id take their class's
component, or stay alone (null component, kept) if the class has no other id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm import common
from contactlake.llm.components import components, dealt, outside_largest
from contactlake.llm.packed import Packed, chain, mix, pack_sorted, texts_of, unpack_sorted, word_bytes

SHINGLE, SIMILARITY = 5, 80
CHUNKS, WIDTH = 13, 5
VALUES, DISTANCE = CHUNKS * WIDTH, 2 * CHUNKS - 1
#: Bits of a shingle when full sets are compared; of a minimum, 16 are kept.
SET_BITS = 40
#: Members of a block of a cluster, and shingles that are counted at once.
BLOCK, COLUMNS = 256, 4096


def shingle_sets(p: Packed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of the distinct shingles, by text and hash."""
    start, end = p.runs(word_bytes())
    doc = p.text_of(start)
    h = p.hashes(start, end, fold=True)
    n = np.bincount(doc, minlength=p.n)
    s = h
    for i in range(1, k):
        s = chain(s[:-1], h[i:]) if len(s) > 1 else s[:0]
    whole = doc[:len(s)] == doc[k - 1:] if len(s) else np.zeros(0, bool)
    sets, docs = [s[whole]], [doc[:len(s)][whole]]
    at = np.cumsum(n) - n
    for i in np.flatnonzero((n > 0) & (n < k)):         # too short: the sequence itself
        v = h[at[i]:at[i] + 1]
        for j in range(1, int(n[i])):
            v = chain(v, h[at[i] + j:at[i] + j + 1])
        sets.append(mix(v + np.uint64(n[i])))
        docs.append(np.array([i]))
    s, d = np.concatenate(sets), np.concatenate(docs).astype(np.int64)
    by = np.lexsort((s, d))
    s, d = s[by], d[by]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])[:len(s)]
    return d[new], s[new]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(977)
    return g.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, VALUES, dtype=np.uint64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig): a 128-bit digest of the set and the
    signature of each document; null where the set is empty."""
    def run(batches):
        import pyarrow as pa
        a, b = _coefficients()
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                p = Packed(texts_of(batch))
                d, s = shingle_sets(p, shingle)
                n = np.bincount(d, minlength=p.n).astype(np.int64)
                some = n > 0
                at = (np.cumsum(n) - n)[some]
                keys, sigs = [None] * p.n, [None] * p.n
                if len(at):
                    k1 = np.add.reduceat(mix(s), at)
                    k2 = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    sig = np.empty((len(at), VALUES), "<u2")
                    for i in range(VALUES):
                        sig[:, i] = np.minimum.reduceat(s * a[i] + b[i], at) & np.uint64(0xFFFF)
                    for j, i in enumerate(np.flatnonzero(some).tolist()):
                        keys[i] = k1[j].tobytes() + k2[j].tobytes()
                        sigs[i] = sig[j].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                                 names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, rep): for every chunk and place in it, a hash of the other values."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, VALUES).astype(np.uint64)
            rep = batch.column(0).to_numpy()
            keys = np.empty((len(rep), VALUES), np.uint64)
            for c in range(CHUNKS):
                for hole in range(WIDTH):
                    h = np.full(len(rep), c * WIDTH + hole + 1, np.uint64)
                    for j in range(WIDTH):
                        if j != hole:
                            h = chain(h, sig[:, c * WIDTH + j])
                    keys[:, c * WIDTH + hole] = h
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep, VALUES))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``."""
    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in common.by_bytes(whole, "text"):
                p = Packed(texts_of(batch))
                d, s = shingle_sets(p, shingle)
                edges = np.searchsorted(d, np.arange(p.n + 1))
                sets = [pack_sorted(np.sort(s[x:y] >> np.uint64(64 - SET_BITS))) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    wanted = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return wanted.select("doc_id", "text").mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity in per cent."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = unpack_sorted(x), unpack_sorted(y)
                n = len(u) + len(v)
                both = np.sort(np.concatenate([u, v]), kind="stable")
                common_ = int((both[1:] == both[:-1]).sum())
                good.append(100 * common_ >= similarity * (n - common_))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    j = j.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _spanning(own: np.ndarray, sets: list[np.ndarray], across: bool, similarity: int) -> list[tuple[int, int]]:
    """Links (a spanning forest of them) among the sets; with ``across`` only
    those between rows whose ``own`` block differs."""
    n = np.array([len(x) for x in sets], np.int64)
    values, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count > 1                              # others are in no intersection
    column = np.cumsum(shared) - 1
    take = shared[inv]
    row, col = row[take], column[inv[take]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [first, first + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[lo:hi], col[lo:hi] - first] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    good = 100 * both >= similarity * (n[:, None] + n[None, :] - both)
    if across:
        good &= own[:, None] != own[None, :]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(good, 1))), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[x] = y
            out.append((i, j))
    return out


def cluster_links(clusters: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links inside the clusters (id, component), as (a, b): all members of a
    cluster are compared on their full sets, block against block, and each
    pair of blocks returns a spanning forest of its links only."""
    size = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    t = clusters.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    t = t.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    t = t.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "shingles")

    def run(batches):
        import pyarrow as pa
        group, own, ids, held = None, [], [], []

        def close():
            links = _spanning(np.array(own), held, group[1] != group[2], similarity) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in links], pa.int64()), pa.array([ids[y] for _, y in links], pa.int64())],
                                              names=["a", "b"])

        for batch in batches:
            for c, i, j, block, id_, shingles in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (c, i, j) != group:
                    if group is not None:
                        yield close()
                    group, own, ids, held = (c, i, j), [], [], []
                own.append(block)
                ids.append(id_)
                held.append(unpack_sorted(shingles))
        if group is not None:
            yield close()

    return (t.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
            .mapInArrow(run, "a long, b long"))


def _far(x: str, y: str) -> str:
    """SQL for the number of places in which two signatures (arrays) differ."""
    return f"aggregate(zip_with({x}, {y}, (u, v) -> if(u = v, 0, 1)), 0, (s, v) -> s + v)"


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``."""
    spark, docs = docs.sparkSession, common.documents_of(docs)
    sketch = common.materialize(sketches(docs, shingle), "sketches")
    classes = common.materialize(
        sketch.where("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"))
        .select("set_key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.sig").alias("sig")), "classes")
    with common.scratch(spark):
        keys = chunk_keys(classes)
        heads = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = common.materialize(keys.join(heads, "key"), "buckets")
        sig = classes.select("rep", "n", F.expr(f"transform(sequence(1, {VALUES}), i -> substring(sig, 2 * i - 1, 2))").alias("sig"))
        x = sig.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
        y = sig.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))
        close = f"100 * least(na, nb) >= {similarity} * greatest(na, nb) and {_far('x', 'y')} <= {DISTANCE}"

        # members of a bucket near its smallest one: they make clusters
        found = members.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        found = common.materialize(found.join(x, "a").join(y, "b").where(close).select("a", "b"), "candidates")
        clusters = components(found, "clusters")
        sets = common.materialize(_sets(docs, clusters.select("id"), shingle), "shingle-sets")
        links = common.materialize(cluster_links(clusters, sets, similarity), "links")

        # members of a bucket in different clusters, neither being its smallest
        big = (members.where("size > 2 and rep != pivot").select("key", "rep").join(clusters.withColumnRenamed("id", "rep"), "rep", "left")
               .withColumn("c", F.coalesce("component", "rep")).drop("component"))
        # those outside a bucket's largest cluster, dealt into blocks, meet the whole bucket
        big = common.materialize(outside_largest(big, BLOCK).join(sig, "rep"), "mixed-buckets")
        x, y = dealt(big, "rep")
        x = x.select("key", "block", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("sig").alias("x"))
        y = y.select("key", "block", "main", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("sig").alias("y"))
        pairs = x.join(y, (x["key"] == y["key"]) & (x["block"] == y["block"]) & F.expr(f"(cb = main or a > b) and ca != cb and {close}"))
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = common.materialize(pairs, "across")
        if not pairs.isEmpty():
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            more = common.materialize(_sets(docs, ids, shingle), "shingle-sets")
            links = links.unionByName(common.materialize(confirm(pairs, more, similarity), "links"))
        comp = components(links, up=1)

    out = sketch.join(classes.select("set_key", "rep"), "set_key", "left")
    out = out.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = out.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (column doc_id) that stay: one document of each component."""
    name = common.unused("gone")
    gone = near_duplicates(docs, shingle, similarity).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
