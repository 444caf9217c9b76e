"""Op 12: hard negatives by a multiway hyperplane tree with sibling ranges.

The index is a GNAT-style tree: a node has up to ``DEGREE`` split points, a row
goes to the child of the nearest one, and for every split point the node keeps
the least and the greatest distance to the rows of each sibling subtree, plus
the range of the rows' lengths.  The tree's shape is fitted on at most
``FIT_ROWS`` rows (a bounded sample, so the tree is a small table whatever the
input); every row is then indexed, and the ranges are those of all rows.

A search is a window of scores: inner products between ``low`` and ``high``.
With the lengths of query and subtree it becomes an annulus of distances, and a
child is passed over if for some split point the triangle inequality puts all
its rows inside or outside that annulus.  Leaves are compared exactly, in groups:
neighbouring leaves of ``GROUP_ROWS`` rows at most, or a share of a larger leaf,
meet ``GROUP_QUERIES`` at most, about, of the queries that reach one of these
leaves; a query comes to a group once, with the leaves that it reaches there.
So a leaf that holds a third of all rows is many groups, and a task holds one
group at a time.  Tables have a row for each vector, so readers hold few of them.  The best rows of the fit sample give
every window a first bound (they are rows of the table themselves), which the
traversal then uses; results are exact, recall is 1.

Two searches: positives (same label, all scores), then one window a positive
among the rows of other labels, from 0.3 to 0.9 of the positive's score.

Edge cases: rows with a null label or vector, or with a null or non-finite
component, take no part; shorter vectors count as padded with zeros; repeated
rows are rows of their own (a copy of the anchor's row can be its positive);
rows without an id are no anchors and rank last among ties; an empty table
gives no rows; other columns are not read.  Scores are 64-bit integers;
products beyond 2^53 are summed in integer arithmetic instead of doubles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlake.llm import common

DEGREE = 8
FIT_ROWS = 16_384
LEAF_ROWS = 1_024
BLOCK_ROWS = 2_048
BLOCK_QUERIES = 256
#: Routed queries that are sent on at once.
SEND_ROWS = 4_096
#: Rows, and queries, that meet in one group; of few rows, LEAST_GROUP at least and so many groups for each reducer.
GROUP_ROWS, GROUP_QUERIES, LEAST_GROUP, GROUPS = 65_536, 16_384, 2_048, 4
#: Candidates that a group holds before it drops all but the best.
HELD = 1 << 20
#: Relative slack of distances against rounding.
SLACK = 1e-9

ROWS = "row long, vec_id long, label int, vector binary"


def vectors(df: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part, written to the
    shared folder: the contract's integer vectors (little-endian 64-bit),
    labels of every seventh id moved on by one.  ``row`` is unique."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        kinds = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.binary())])
        for batch in batches:
            lists, out = batch.column(1), []
            x = np.floor(scale * pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = np.where(np.isfinite(x), x, 0).astype("<i8")
            edge = lists.offsets.to_numpy()
            for k, (i, lab) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if lab is not None and lists[k].is_valid and bad[edge[k]] == bad[edge[k + 1]]:
                    lab = (lab + 1) % labels if i is not None and i % every == 0 else lab
                    out.append({"row": row + k, "vec_id": i, "label": lab, "vector": whole[edge[k]:edge[k + 1]].tobytes()})
            row += batch.num_rows
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    narrow = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("int"))
    return common.materialize(narrow.mapInArrow(run, ROWS), "vectors")


def stacked(values, width: int) -> np.ndarray:
    """Binary vectors as a matrix of int64, padded with zeros."""
    out = np.zeros((len(values), width), np.int64)
    for k, v in enumerate(values):
        x = np.frombuffer(v, "<i8")
        out[k, :len(x)] = x
    return out


def binary(x: np.ndarray):
    """The rows of an integer matrix as an Arrow column."""
    import pyarrow as pa
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def matrix(column, width: int) -> np.ndarray:
    """``binary`` undone."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if big < 2.0 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


class Tree:
    """Split points by node; children are nodes or leaves.  ``ranges[node]`` is
    (low, high) of shape (split point, child), ``norms[node]`` of shape (2, child)."""

    def __init__(self, sample: np.ndarray, rows: int, degree: int = DEGREE, leaf_rows: int = LEAF_ROWS):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []        # >= 0: node, < 0: leaf -1-number
        self.leaves = 0
        self.degree = degree
        share = rows / max(1, len(sample))
        rng = np.random.default_rng(7)
        todo = [(sample, None, 0)]
        while todo:
            part, parent, at = todo.pop()
            spread = len(part) > 2 * degree and len(part) * share > leaf_rows and (part != part[0]).any()
            if not spread:
                number, self.leaves = -1 - self.leaves, self.leaves + 1
                if parent is not None:
                    self.child[parent][at] = number
                continue
            node = len(self.points)
            if parent is not None:
                self.child[parent][at] = node
            # split points far from each other, out of a few candidates
            some = part[rng.permutation(len(part))[:16 * degree]]
            chosen = [0]
            far = distances(some, some[:1])[:, 0]
            while len(chosen) < degree and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
            points = some[chosen]
            self.points.append(points)
            self.child.append([0] * len(points))
            near = distances(part, points).argmin(1)
            todo += [(part[near == k], node, k) for k in range(len(points))]
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        self.norms = [np.array([[np.inf] * len(p), [-np.inf] * len(p)]) for p in self.points]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row; the ranges on the way are widened by the rows."""
        leaf = np.zeros(len(x), np.int64)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            d = distances(x[rows], self.points[node])
            near = d.argmin(1)
            for k, child in enumerate(self.child[node]):
                here = near == k
                if not here.any():
                    continue
                self.low[node][:, k] = np.minimum(self.low[node][:, k], d[here].min(0))
                self.high[node][:, k] = np.maximum(self.high[node][:, k], d[here].max(0))
                self.norms[node][0, k] = min(self.norms[node][0, k], norm[rows[here]].min())
                self.norms[node][1, k] = max(self.norms[node][1, k], norm[rows[here]].max())
                if child >= 0:
                    todo.append((child, rows[here]))
                else:
                    leaf[rows[here]] = -1 - child
        return leaf

    def reached(self, x: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(query, leaf) pairs that the windows cannot pass over; ``low`` and
        ``high`` have a row per query and a column per window (low > high: none)."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        if not self.points:
            yield np.flatnonzero((low <= high).any(1)), 0
            return
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            d = distances(x[rows], self.points[node])
            for k, child in enumerate(self.child[node]):
                if not np.isfinite(self.norms[node][0, k]):
                    continue                    # no row came here
                nearest = np.maximum(0, np.maximum(d - self.high[node][:, k], self.low[node][:, k] - d)).max(1)
                farthest = (d + self.high[node][:, k]).min(1)
                q = norm[rows] ** 2
                n0, n1 = self.norms[node][:, k] ** 2
                inner = (q + n0)[:, None] - 2.0 * high[rows]        # squared bounds of the annulus
                outer = (q + n1)[:, None] - 2.0 * low[rows]
                slack = SLACK * (q + n1)[:, None] + 1e-6
                meets = (low[rows] <= high[rows]) & (nearest[:, None] ** 2 <= outer + slack) & (farthest[:, None] ** 2 >= inner - slack)
                on = rows[meets.any(1)]
                if len(on):
                    if child >= 0:
                        todo.append((child, on))
                    else:
                        yield on, -1 - child


class Index:
    """A fitted tree, its ranges, and the table of the rows with their leaves."""

    def __init__(self, rows: DataFrame, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS):
        self.rows = rows
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("vector")), F.lit(0)).alias("w")).first()
        self.width = max(1, size["w"] // 8)
        picked = rows
        if size["n"] > fit_rows:
            share = int(2 ** 32 * fit_rows / size["n"])
            picked = rows.where(F.pmod(F.xxhash64("row"), F.lit(2 ** 32)) < share)
        fit = picked.limit(2 * fit_rows).collect()
        self.fit = (stacked([r["vector"] for r in fit], self.width), np.array([r["label"] for r in fit], np.int64), np.array([r["row"] for r in fit], np.int64))
        self.tree = Tree(self.fit[0], size["n"], leaf_rows=leaf_rows)
        self.indexed = self._indexed()
        self._widen()
        self.group_rows = min(GROUP_ROWS, max(LEAST_GROUP, size["n"] // (GROUPS * common.parallelism(rows.sparkSession))))
        sizes = np.zeros(self.tree.leaves, np.int64)
        for leaf, n in self.indexed.where("leaf >= 0").groupBy("leaf").count().collect():      # leaves are a bounded number
            sizes[leaf] = n
        self.home = homes(sizes, self.group_rows)

    def _indexed(self) -> DataFrame:
        """(leaf, row, vec_id, label, vector), vectors padded to one width, and one
        row a task with the ranges (leaf -1)."""
        tree, width = self.tree, self.width

        def run(batches):
            import pickle

            import pyarrow as pa
            names = ["leaf", "row", "vec_id", "label", "vector"]
            for batch in batches:
                for piece in (batch.slice(k, BLOCK_ROWS) for k in range(0, batch.num_rows, BLOCK_ROWS)):
                    x = stacked(piece.column(3).to_pylist(), width)
                    yield pa.RecordBatch.from_arrays([pa.array(tree.assign(x)), *(piece.column(k) for k in range(3)), binary(x)], names=names)
            ranges = pickle.dumps((tree.low, tree.high, tree.norms), 5)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                                              pa.array([None], pa.int32()), pa.array([ranges], pa.binary())], names=names)

        return common.materialize(self.rows.mapInArrow(run, f"leaf long, {ROWS}"), "indexed")

    def _widen(self) -> None:
        """Ranges of all tasks, merged in tasks by node before the driver gets
        one row a node (the tree has a bounded number of nodes)."""
        def flat(batches):
            import pickle

            import pyarrow as pa
            for batch in batches:
                for payload in batch.column(0):
                    both = [np.concatenate([low.ravel(), norms[0], -high.ravel(), -norms[1]])
                            for low, high, norms in zip(*pickle.loads(payload.as_py()), strict=True)]
                    if not both:
                        continue
                    node = np.repeat(np.arange(len(both), dtype=np.int32), [len(b) for b in both])
                    at, least = np.concatenate([np.arange(len(b), dtype=np.int32) for b in both]), np.concatenate(both)
                    some = np.isfinite(least)
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(at[some]), pa.array(least[some])], names=["node", "at", "least"])

        got = (self.indexed.where("leaf = -1").select("vector").mapInArrow(flat, "node int, at int, least double")
               .groupBy("node", "at").agg(F.min("least").alias("least")).toPandas())
        for node, at, least in got.itertuples(index=False):
            m = len(self.tree.points[node])
            half = m * m + m
            sign, k = (1, at) if at < half else (-1, at - half)
            if k < m * m:
                (self.tree.low if sign > 0 else self.tree.high)[node][k // m, k % m] = sign * least
            else:
                self.tree.norms[node][0 if sign > 0 else 1, k - m * m] = sign * least

    def _rows(self) -> DataFrame:
        """The indexed rows with their group (grp)."""
        spark = self.rows.sparkSession
        home = spark.createDataFrame([*enumerate(self.home.tolist())], "leaf long, grp long")
        return self.indexed.where("leaf >= 0").join(F.broadcast(home), "leaf")

    def search(self, queries: DataFrame, same_label: bool, best: int) -> DataFrame:
        """``queries``: (row, label, vector, low array<long>, high array<long>),
        a window by position.  Gives (query, window, row, vec_id, score): of each
        window the ``best`` rows, at least, that lie in it, other rows than the
        query itself; the caller ranks."""
        tree, width, fit, home = self.tree, self.width, self.fit, self.home
        kinds = "grp long, row long, label long, vector binary, low array<long>, high array<long>, leaves array<int>"

        def allowed(labels, own):
            return (labels[None, :] == own[:, None]) if same_label else (labels[None, :] != own[:, None])

        def route(batches):
            import pyarrow as pa

            def sent(held, row, own, x, low, high):
                """A row for each group and query, with the query's leaves there."""
                on, leaf = np.concatenate([o for o, _ in held]), np.repeat([k for _, k in held], [len(o) for o, _ in held])
                by = np.lexsort((leaf, on, home[leaf]))
                on, leaf = on[by], leaf[by].astype(np.int32)
                grp = home[leaf]
                first = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (on[1:] != on[:-1])]))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(first, len(on)), pa.int32()), pa.array(leaf))
                for k in range(0, len(first), SEND_ROWS):
                    at = on[first[k:k + SEND_ROWS]]
                    edges = pa.array(np.arange(len(at) + 1) * low.shape[1], pa.int32())
                    lists = [pa.ListArray.from_arrays(edges, pa.array(c[at].ravel())) for c in (low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(grp[first[k:k + SEND_ROWS]]), pa.array(row[at]), pa.array(own[at]), binary(x[at]), *lists,
                                                      leaves.slice(k, SEND_ROWS)], names=["grp", "row", "label", "vector", "low", "high", "leaves"])

            for whole in batches:
                for batch in (whole.slice(k, BLOCK_QUERIES) for k in range(0, whole.num_rows, BLOCK_QUERIES)):
                    row, own = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
                    x = stacked(batch.column(2).to_pylist(), width)
                    low, high = (np.array(batch.column(k).to_pylist(), np.int64).reshape(len(row), -1) for k in (3, 4))
                    # the best rows of the sample bound each window from below
                    score = products(x, fit[0])
                    can = allowed(fit[1], own) & (fit[2][None, :] != row[:, None])
                    for w in range(low.shape[1]):
                        inside = np.where(can & (score >= low[:, w:w + 1]) & (score <= high[:, w:w + 1]), score, np.iinfo(np.int64).min)
                        if inside.shape[1] >= best:
                            low[:, w] = np.maximum(low[:, w], np.partition(inside, -best, 1)[:, -best])
                    held = list(tree.reached(x, low, high))
                    if held:
                        yield from sent(held, row, own, x, low, high)

        def compare(left, right):
            import pyarrow as pa
            import pyarrow.compute as pc
            out = pa.schema([("query", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            numbers = lambda column: column.to_numpy().astype(np.int64)
            known = left.column("vec_id").is_valid().to_numpy()
            ids, labels, rows, leaf = (numbers(c) for c in (left.column("vec_id").fill_null(0), *(left.column(n) for n in ("label", "row", "leaf"))))
            x = matrix(left.column("vector"), width)
            q, own, y = numbers(right.column("row")), numbers(right.column("label")), matrix(right.column("vector"), width)
            low, high = (numbers(pc.list_flatten(right.column(c))).reshape(len(q), -1) for c in ("low", "high"))
            asks, asked_leaf = np.repeat(np.arange(len(q)), numbers(pc.list_value_length(right.column("leaves")))), numbers(pc.list_flatten(right.column("leaves")))
            windows = low.shape[1]
            found, held = [], 0

            def best_of(found):
                """The best of each query and window, ties by id."""
                window, score, col = (np.concatenate(c) for c in zip(*found, strict=True))
                by = np.lexsort((ids[col], ~known[col], -score, window))
                window, score, col = window[by], score[by], col[by]
                keep = np.arange(len(window)) - np.searchsorted(window, window) < best
                return window[keep], score[keep], col[keep]

            inside, by_leaf = np.argsort(leaf, kind="stable"), np.argsort(asked_leaf, kind="stable")
            for k in np.unique(leaf).tolist():
                mine = inside[np.searchsorted(leaf[inside], k):np.searchsorted(leaf[inside], k, side="right")]
                ask = asks[by_leaf[np.searchsorted(asked_leaf[by_leaf], k):np.searchsorted(asked_leaf[by_leaf], k, side="right")]]
                for here in (mine[i:i + BLOCK_ROWS] for i in range(0, len(mine), BLOCK_ROWS)):
                    here = here[np.lexsort((ids[here], ~known[here]))]
                    for ones in (ask[i:i + BLOCK_QUERIES] for i in range(0, len(ask), BLOCK_QUERIES)):
                        score = products(y[ones], x[here])
                        can = allowed(labels[here], own[ones]) & (rows[here][None, :] != q[ones][:, None])
                        for w in range(windows):
                            at, col = np.nonzero(can & (score >= low[ones, w:w + 1]) & (score <= high[ones, w:w + 1]))
                            # of each query the best of the block, ties by id
                            by = np.lexsort((np.arange(len(at)), -score[at, col], at))
                            at, col = at[by], col[by]
                            nth = np.arange(len(at)) - np.searchsorted(at, at)
                            at, col = at[nth < best], col[nth < best]
                            found.append((ones[at] * windows + w, score[at, col], here[col]))
                            held += len(at)
                    if held > HELD:
                        found = [best_of(found)]
                        held = len(found[0][0])
            if not found:
                return out.empty_table()
            window, score, col = best_of(found)
            return pa.Table.from_arrays([pa.array(q[window // windows]), pa.array((window % windows).astype(np.int32)), pa.array(rows[col]),
                                         pa.array(ids[col], mask=~known[col]), pa.array(score)], schema=out)

        asked = common.materialize(queries.select("row", "label", "vector", "low", "high").mapInArrow(route, kinds), "routed")
        left, right = grouped(self._rows(), asked, self.group_rows)
        place = ["grp", "a", "b"]
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(compare, "query long, window int, row long, vec_id long, score long")


def homes(sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each leaf: consecutive leaves, which are neighbours in the
    tree, share one as long as they have ``most`` rows together."""
    out, grp, held = np.zeros(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            grp, held = grp + 1, 0
        out[leaf] = grp
        held += n
    return out


def grouped(rows: DataFrame, asked: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows and the queries (grp, row, ...) with what they are dealt over: the
    rows of a group over a by their number, ``most`` each, its queries over b; every share of
    rows meets every share of queries.  Groups are no more than leaves, a bounded number."""
    deals = lambda df, name, n: df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / n).cast("long").alias(name))
    grid = F.broadcast(deals(rows, "of_rows", most).join(deals(asked, "of_queries", GROUP_QUERIES), "grp"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    return (rows.join(grid, "grp").withColumn("a", one("of_rows")).withColumn("b", every("of_queries")).drop("of_rows", "of_queries"),
            asked.join(grid, "grp").withColumn("b", one("of_queries")).withColumn("a", every("of_rows")).drop("of_rows", "of_queries"))


def ranked(found: DataFrame, keys: list[str], best: int) -> DataFrame:
    """The ``best`` rows of each key by score, ties by smaller vec_id, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mined(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
          fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every anchor (vec_id divisible by ``every``) and each
    of its ``positives``, the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    rows = vectors(embeddings)
    index = Index(rows, fit_rows, leaf_rows)
    anchors = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    all_scores = anchors.withColumn("low", F.array(F.lit(-2 ** 62))).withColumn("high", F.array(F.lit(2 ** 62)))
    near = common.materialize(ranked(index.search(all_scores, True, positives), ["query"], positives), "positives")
    # 100 s >= low p and 100 s <= high p, in whole numbers
    window = F.struct(F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                      F.expr(f"({low} * score - pmod({low} * score, 100)) div 100 + if(pmod({low} * score, 100) > 0, 1, 0)").alias("low"),
                      F.expr(f"({high} * score - pmod({high} * score, 100)) div 100").alias("high"))
    sought = near.groupBy("query").agg(F.sort_array(F.collect_list(window)).alias("p"))
    sought = common.materialize(anchors.join(sought, anchors["row"] == sought["query"]).drop("query"), "anchors")
    # every query has the same number of windows: those it lacks are empty
    fill = lambda field, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(
        F.get(F.col(f"p.{field}"), k - 1), F.lit(none).cast("long")))
    found = index.search(sought.withColumn("low", fill("low", 1)).withColumn("high", fill("high", 0)), False, negatives)
    pairs = sought.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "w"))
    return (ranked(found, ["query", "window"], negatives).join(pairs, ["query", "window"])
            .select("anchor_id", F.col("w.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                    F.col("w.positive_score").alias("positive_score"), F.col("score").alias("negative_score")))
