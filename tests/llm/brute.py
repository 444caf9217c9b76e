"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def contamination(texts, items, window=10):
    held = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[k:k + window])].add(i)
    sizes = {len(k) for k in held}
    out = []
    for t in texts:
        w = ALNUM.findall(low(t))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                x = held.get(tuple(w[k:k + n]))
                if x:
                    found |= x
                    hit[k:k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def quality(t):
    t = t or ""
    w = SPACED.findall(t)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def near(rows, k=2):
    """doc_id -> (set size, component)."""
    sets = {}
    for i, t in rows:
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def suffix(rows, length=50):
    """doc_id -> sorted (bytes, removed, spans, digest of the rest)."""
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            first[w] = min(first.get(w, math.inf), key(i))
    out = defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key(i):
                gone[k:k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i].append((len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return {i: sorted(v) for i, v in out.items()}


def lm(rows):
    """(N, V, doc_id -> (held out, tokens, known, base score))."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*SPACED.findall(low(t)), None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return n, v, {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
                  for i, ws in tokens.items()}


def lm_interpolated(rows, buckets, iterations, enough):
    """doc_id -> log10 probability by deleted interpolation with dictionaries."""
    start = object()
    crc = {i: zlib.crc32(str(i).encode()) for i, _ in rows}
    seq = {i: [*SPACED.findall(low(t)), None] for i, t in rows}
    pairs = {i: list(zip([start, *ws[:-1]], ws, strict=True)) for i, ws in seq.items()}
    train = [i for i in seq if crc[i] % 10]
    one = Counter(w for i in train for w in seq[i])
    two = Counter(p for i in train for p in pairs[i])
    n, v = sum(one.values()), len(one)
    context = one | Counter({start: len(train)})
    bucket = lambda c: min(buckets - 1, math.ceil(math.log2(c + 1)))

    def parts(cw, cv, cvw):
        return (cvw / cv if cv else 0.0, cw / n if n else 0.0, 1 / (v + 1))

    fit = []
    for i in train:
        if crc[i] // 10 % 10 == 0:
            own1, own2 = Counter(seq[i]) | Counter({start: 1}), Counter(pairs[i])
            fit += [(bucket(cv := context[a] - own1[a]), parts(one[w] - own1[w], cv, two[a, w] - own2[a, w])) for a, w in pairs[i]]
    weights = [[1 / 3] * 3 for _ in range(buckets)]
    for _ in range(iterations):
        e = defaultdict(lambda: [0.0] * 3)
        for b, p in fit:
            part = [x * y for x, y in zip(weights[b], p, strict=True)]
            for k in range(3):
                e[b][k] += part[k] / sum(part)
        new = [[x / sum(e[b]) for x in e[b]] if b in e else weights[b] for b in range(buckets)]
        moved = max(abs(x - y) for a, b in zip(new, weights, strict=True) for x, y in zip(a, b, strict=True))
        weights = new
        if moved < enough:
            break
    return {i: sum(math.log10(sum(x * y for x, y in zip(weights[bucket(context[a])], parts(one[w], context[a], two[a, w]), strict=True)))
                   for a, w in pairs[i]) for i in seq}
