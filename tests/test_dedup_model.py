"""D9 against a plain sequential model of the rule on random small inputs
(including order permutations, shared phones, digit-less phones and
signature-only repeats)."""

import random
import re

from contactlake.operators.dedup import dedup_ordered


def _norm_name(s):
    s = re.sub(r"[^A-Za-z0-9_\s]", "", (s or "").lower())
    s = re.sub(r"(?<![A-Za-z0-9_])(inc|llc|ltd|corp|corporation|company|co|llp|lp)(?![A-Za-z0-9_])", "", s)
    return re.sub(r"\s+", " ", s).strip()


def _norm_addr(s):
    s = (s or "").lower()
    s = re.sub(r"(?<![A-Za-z0-9_])(street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|place|pl)"
               r"(?![A-Za-z0-9_])", "", s)
    s = re.sub(r"[^A-Za-z0-9_\s]", "", s)
    return re.sub(r"\s+", " ", s).strip()


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _sim(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    return (n - _lev(a, b)) / n


def _host(u):
    if not u:
        return None
    m = re.match(r"^(?:https?://)?([^/:?#]+)", u if u.startswith("http") else "https://" + u)
    return m.group(1).lower() if m else None


def _score(x, y):
    d1, d2 = re.sub(r"\D", "", x["phone"]), re.sub(r"\D", "", y["phone"])
    ph = 0.0 if not x["phone"] or not y["phone"] else 1.0 if d1 == d2 else 0.8 if (d1 in d2 or d2 in d1) else 0.0
    h1, h2 = _host(x["website"]), _host(y["website"])
    web = 0.0
    if x["website"] and y["website"] and h1 and h2:
        web = 1.0 if h1 == h2 or h1.removeprefix("www.") == h2.removeprefix("www.") else 0.0
    e1, e2 = x["email"], y["email"]
    em = 0.0 if not e1 or not e2 else 1.0 if e1 == e2 else (
        0.7 if "@" in e1 and "@" in e2 and e1.split("@")[1] and e1.split("@")[1] == e2.split("@")[1] else 0.0)
    return (_sim(_norm_name(x["name"]), _norm_name(y["name"])) * 0.4 + ph * 0.2 + web * 0.15
            + _sim(_norm_addr(x["address"]), _norm_addr(y["address"])) * 0.15 + em * 0.1)


def _sig(x):
    return f"{_norm_name(x['name'])}|{re.sub(r'[^0-9]', '', x['phone'])}|{_host(x['website']) or ''}".lower()


def sequential(rows):
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: r["ord"]):
        if _sig(r) in seen:
            continue
        if any(_score(r, k) > 0.85 for k in kept):
            continue
        kept.append(r)
        seen.add(_sig(r))
    return sorted(r["ord"] for r in kept)


def _random_rows(rng, n):
    names = ["Harbor Bakery", "Harbour Bakery", "HARBOR BAKERY, Inc.", "Acme Co", "Acme", "Blue Door Cafe",
             "Blue Door Café LLC", "Zed"]
    phones = ["", "(212) 555-0100", "+1 212 555 0100", "2125550100", "555-0100", "n/a", "415 555 0199", "5550"]
    sites = ["", "https://www.harbor.example/", "harbor.example", "http://acme.example/about", "acme.example"]
    emails = ["", "info@harbor.example", "sales@harbor.example", "hi@acme.example"]
    addrs = ["", "12 Main Street", "12 Main St", "40 Oak Avenue, Suite 2", "40 Oak Ave"]
    ords = rng.sample(range(10 * n), n)
    return [{"ord": o, "name": rng.choice(names), "phone": rng.choice(phones), "email": rng.choice(emails),
             "website": rng.choice(sites), "address": rng.choice(addrs), "category": "x"} for o in ords]


def test_dedup_matches_sequential_model(spark):
    rng = random.Random(7)
    for trial in range(4):
        rows = _random_rows(rng, 40 + 10 * trial)
        df = spark.createDataFrame(rows, "ord long, name string, phone string, email string, website string, "
                                         "address string, category string")
        got = sorted(r.ord for r in dedup_ordered(df).select("ord").collect())
        assert got == sequential(rows), f"trial {trial}"


def _shop_rows(rng, n, words):
    """Rows of one host and mostly one phone: near names, addresses and e-mails."""
    out = []
    for i in range(n):
        base = rng.randrange(max(1, n // 3))
        r = random.Random(base)
        name = " ".join(r.choice(words) for _ in range(3)) + f" {base}"
        addr = f"{base} {r.choice(words)} {r.choice(words)}"
        if rng.random() < 0.5:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice("xyz") + name[k + 1:]
        if rng.random() < 0.3:
            addr += rng.choice([" west", " 2"])
        out.append({"ord": i, "name": name, "phone": rng.choice(["212 555 0100"] * 6 + ["2125550100", "+1 212 555 0100", "n/a", "5550100", "55"]),
                    "email": rng.choice(["", f"a{base}@shop.example", "info@shop.example", "x@other.example"]),
                    "website": "https://shop.example/", "address": addr, "category": "x"})
    return out


SCHEMA = "ord long, name string, phone string, email string, website string, address string, category string"


def test_hot_block_matches_sequential_model(spark, monkeypatch):
    from contactlake.operators import blocking
    monkeypatch.setattr(blocking, "PLAIN_ROWS", 8)
    rng = random.Random(11)
    words = ["harbor", "bakery", "blue", "door", "cafe", "acme", "north", "mill"]
    rows = _shop_rows(rng, 220, words) + [{**r, "ord": 1000 + i} for i, r in enumerate(_random_rows(rng, 30))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.ord for r in dedup_ordered(df).select("ord").collect()) == sequential(rows)


def test_hot_block_candidates_are_few(spark):
    """Rows of one host and phone with other names and addresses: hardly any
    of the block's pairs is formed."""
    from contactlake.operators import dedup
    n, rng = 2000, random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(3 * n)]
    rows = [{"ord": i, "name": " ".join(rng.sample(words, 2)), "phone": "212 555 0100", "email": f"m{i}@shop{i}.example",
             "website": "https://shop.example/", "address": " ".join(rng.sample(words, 3)), "category": "x"} for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    feat = df.transform(dedup.with_dedup_features()).select(*dedup.FEATURE_COLS).checkpoint()
    assert dedup.candidate_pairs(feat, equal_signatures=False).count() < 0.003 * n * (n - 1) / 2


def test_batches_equal_one_run(spark, tmpdir_run):
    """Any split by ``ord`` keeps what one run keeps; a replayed batch too."""
    from contactlake.operators.batches import dedup_batch
    rng = random.Random(21)
    rows = sorted(_random_rows(rng, 60), key=lambda r: r["ord"])
    cuts = [0, 7, 34, 60]
    got = []
    for k in range(3):
        df = spark.createDataFrame(rows[cuts[k]:cuts[k + 1]], SCHEMA)
        kept = sorted(r.ord for r in dedup_batch(df, tmpdir_run, k).select("ord").collect())
        if k == 1:
            assert kept == sorted(r.ord for r in dedup_batch(df, tmpdir_run, k).select("ord").collect())
        got += kept
    assert got == sequential(rows)
