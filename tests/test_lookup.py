"""As-of lookups on hot keys and the rank index, against plain versions."""

import random
from bisect import bisect_right

from contactlake.operators import freshness as FR
from contactlake.operators import reports as R


def test_as_of_hot_key(spark):
    rng = random.Random(8)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    entries = [(i, key(), rng.randrange(300), rng.randrange(100)) for i in range(900)]
    lookups = [(i, key(), rng.randrange(-5, 320)) for i in range(900)] + [(10_000, "never", 5), (10_001, "hot", None)]
    e = spark.createDataFrame(entries, "event_id long, key string, fetched_at long, ttl_ms long").repartition(5)
    q = spark.createDataFrame(lookups, "id long, key string, at long").repartition(5)
    got = {r.id: r.entry and (r.entry.fetched_at, r.entry.event_id, r.entry.ttl_ms) for r in FR.lookup_as_of(e, q).collect()}
    by = {}
    for i, k, t, v in entries:
        if k is not None:
            by.setdefault(k, []).append((t, i, v))
    want = {}
    for i, k, at in lookups:
        known = sorted(by.get(k, []))
        n = bisect_right(known, (at, float("inf"))) if at is not None else 0
        want[i] = known[n - 1] if n else None
    assert got == want


def test_as_of_without_entries(spark):
    e = spark.createDataFrame([], "event_id long, key string, fetched_at long, ttl_ms long")
    q = spark.createDataFrame([(1, "a", 5)], "id long, key string, at long")
    assert [r.entry for r in FR.lookup_as_of(e, q).collect()] == [None]
    assert FR.lookup_as_of(e, q.limit(0)).count() == 0


def test_indexed_pages(spark, tmpdir_run):
    rng = random.Random(3)
    ords = rng.sample(range(10_000), 537)
    R.write_page_index(spark.createDataFrame([(o, f"n{o}") for o in ords], "ord long, name string").repartition(4), f"{tmpdir_run}/x")
    for page in (1, 2, 17, 53, 54, 55, 900):
        got = [r.ord for r in R.indexed_page(spark, f"{tmpdir_run}/x", page).collect()]
        assert got == sorted(ords)[(page - 1) * 10:page * 10]
