"""Hosts and path segments of URLs by the URL standard, as column expressions:
percent-decoded domains with their labels in Punycode, the number forms of
IPv4 addresses, IPv6 literals, dot segments, percent-encode sets.

Each function takes a bound value (a lambda variable or attribute) and returns
null for what a parser rejects.

Limits: of the Unicode mapping before Punycode, lower case, full-width forms,
the other full stops, ignorable characters and canonical composition are done;
other compatibility forms stay as they are.  Labels that come as ``xn--`` are
not decoded and checked.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlake.functions.text import let

# --- fixed values of the URL standard ------------------------------------------
FORBIDDEN_DOMAIN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]"
PATH_ENCODED = r"""[^\x21-\x7e]|["<>`{}]"""
QUERY_ENCODED = r"""[^\x21-\x7e]|["<>']"""
FRAGMENT_ENCODED = r"""[^\x21-\x7e]|["<>`]"""
USERINFO_ENCODED = r"""[^\x21-\x7e]|["#<>?`{}/:;=@\[\\\]^|]"""
FULL_STOPS = "。．｡"
IGNORED = "­​⁠﻿"
# --- fixed values of RFC 3492 ----------------------------------------------------
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128


def composed_pairs(limit: int = 0x2000) -> dict[str, str]:
    """Base and mark -> character, for the composed characters below ``limit``."""
    out = {}
    for n in range(0xC0, limit):
        parts = unicodedata.normalize("NFD", chr(n))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(n):
            out[unicodedata.normalize("NFC", parts[:-1]) + parts[-1]] = chr(n)
    return out


def _lookup(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


def _compose(s: Column) -> Column:
    """One mark joined to the character before it, wherever there is a pair."""
    table = _lookup(composed_pairs())
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?s)[^\p{M}]\p{M}"), 0))
    return F.aggregate(found, s, lambda acc, p: F.replace(acc, p, F.coalesce(F.try_element_at(table, p), p)))


def percent_encoded(s: Column, which: str) -> Column:
    """Characters of the class ``which`` as percent-encoded UTF-8."""
    def one(ch):
        return F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(which), 0))
    return F.when(s.rlike(which), F.aggregate(found, s, lambda acc, ch: F.replace(acc, ch, one(ch)))).otherwise(s)


# --- Punycode --------------------------------------------------------------------

def _digit(n: Column) -> Column:
    return F.chr(F.when(n < 26, n + 97).otherwise(n + 22))


def _variable_length(delta: Column, bias: Column) -> Column:
    """``delta`` in the digits of RFC 3492; eight are enough for 31 bits."""
    def step(acc, k):
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), k * BASE - bias))
        q = acc["q"]
        low = q < t
        digit = F.when(low, q).otherwise(t + (q - t) % (BASE - t))
        return F.when(acc["done"], acc).otherwise(F.struct(F.when(low, q).otherwise(F.floor((q - t) / (BASE - t))).alias("q"),
                                                           F.concat(acc["out"], _digit(digit)).alias("out"), low.alias("done")))
    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long")), start, step, lambda acc: acc["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    d = F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2))
    limit = (BASE - T_MIN) * T_MAX // 2

    def scale(acc, _):
        return F.when(acc["d"] > limit, F.struct(F.floor(acc["d"] / (BASE - T_MIN)).alias("d"), (acc["k"] + BASE).alias("k"))).otherwise(acc)
    start = let(d, lambda x: F.struct((x + F.floor(x / points)).alias("d"), F.lit(0).cast("long").alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, scale, lambda acc: acc["k"] + F.floor((BASE - T_MIN + 1) * acc["d"] / (acc["d"] + SKEW)))


def punycode(label: Column) -> Column:
    """A label without upper-case letters in ASCII: as it is, or ``xn--`` and
    its Punycode."""
    def encode(points):
        basic = F.filter(points, lambda c: c < FIRST_N)
        long = lambda n: F.lit(n).cast("long")

        def of(b):
            start = F.struct(long(0).alias("delta"), long(FIRST_BIAS).alias("bias"), F.size(b).cast("long").alias("h"), long(FIRST_N).alias("n"),
                             F.concat(F.array_join(F.transform(b, lambda c: F.chr(c)), ""), F.when(F.size(b) > 0, F.lit("-")).otherwise(F.lit(""))).alias("out"))

            def outer(acc, m):
                base = F.struct((acc["delta"] + (m - acc["n"]) * (acc["h"] + 1)).alias("delta"), acc["bias"].alias("bias"), acc["h"].alias("h"),
                                acc["n"].alias("n"), acc["out"].alias("out"))

                def inner(a, c):
                    hit = F.struct(long(0).alias("delta"), _adapted(a["delta"], a["h"] + 1, a["h"] == F.size(b)).alias("bias"), (a["h"] + 1).alias("h"),
                                   a["n"].alias("n"), F.concat(a["out"], _variable_length(a["delta"], a["bias"])).alias("out"))
                    less = F.struct((a["delta"] + 1).alias("delta"), a["bias"].alias("bias"), a["h"].alias("h"), a["n"].alias("n"), a["out"].alias("out"))
                    return F.when(c == m, hit).when(c < m, less).otherwise(a)

                done = F.aggregate(points, base, inner)
                return let(done, lambda d: F.struct((d["delta"] + 1).alias("delta"), d["bias"].alias("bias"), d["h"].alias("h"), (m + 1).alias("n"),
                                                    d["out"].alias("out")))

            wide = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= FIRST_N)))
            return F.aggregate(wide, start, outer, lambda acc: F.concat(F.lit("xn--"), acc["out"]))
        return let(basic, of)

    chars = F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.ascii(F.substring(label, i, F.lit(1))).cast("long"))
    return F.when(label.rlike(r"[^\x00-\x7f]"), let(chars, encode)).otherwise(label)


def domain_to_ascii(host: Column) -> Column:
    """A host's percent-decoded, mapped labels, non-ASCII ones in Punycode."""
    wide = "".join(chr(n) for n in range(0xFF01, 0xFF5F) if chr(n) not in FULL_STOPS)
    plain = "".join(chr(n - 0xFEE0) for n in range(0xFF01, 0xFF5F) if chr(n) not in FULL_STOPS)

    def mapped(h):
        m = F.lower(F.translate(h, FULL_STOPS + wide + IGNORED, "..." + plain))
        joined = let(m, lambda x: F.when(x.rlike(r"\p{M}"), let(_compose(x), _compose)).otherwise(x))
        return let(joined, lambda x: F.array_join(F.transform(F.split(x, r"\."), punycode), "."))

    decoded = F.when(host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    return let(decoded, lambda h: F.when(h.contains("�"), F.lit(None).cast("string"))
               .when(h.rlike(r"[^\x00-\x7f]"), mapped(h)).otherwise(F.lower(h)))


# --- addresses ---------------------------------------------------------------------

def ends_in_number(host: Column) -> Column:
    return host.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?\z")


def ipv4(host: Column) -> Column:
    """Dotted form of one to four decimal, octal or hexadecimal numbers."""
    def number(p):
        hexa, octal = F.regexp_extract(p, r"^0[xX]0*([0-9a-fA-F]{0,8})\z", 1), F.regexp_extract(p, r"^0+([0-7]{0,11})\z", 1)
        value = lambda digits, base: F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, base, 10).cast("long"))
        return (F.when(p.rlike(r"^0[xX]0*[0-9a-fA-F]{0,8}\z"), value(hexa, 16)).when(p.rlike(r"^0+[0-7]{0,11}\z"), value(octal, 8))
                .when(p.rlike(r"^[1-9][0-9]{0,9}\z"), p.try_cast("long")))

    def parse(parts):
        n = F.size(parts)
        last = F.get(parts, n - 1)
        fine = (n <= 4) & ~F.exists(parts, lambda x: x.isNull()) & ~F.exists(F.slice(parts, F.lit(1), n - 1), lambda x: x > 255) \
            & (last < F.pow(F.lit(256), 5 - n))
        total = last + F.aggregate(F.transform(F.slice(parts, F.lit(1), n - 1), lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("long")),
                                   F.lit(0).cast("long"), lambda a, x: a + x)
        dotted = let(total, lambda t: F.concat_ws(".", *[(F.shiftright(t, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)]))
        return F.when(fine, dotted)

    return let(F.transform(F.split(F.regexp_replace(host, r"\.\z", ""), r"\."), number), parse)


def ipv6(inner: Column) -> Column:
    """Shortest form of the address between the brackets."""
    hex_group = r"^[0-9a-f]{1,4}\z"
    tail = r"^(.*:)([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\z"

    def without_v4(a):
        octet = [F.regexp_extract(a, tail, i) for i in range(2, 6)]
        fine = ~F.lit(False)
        for o in octet:
            fine = fine & ~o.rlike(r"^0[0-9]") & (o.try_cast("int") <= 255)
        pair = lambda x, y: F.lower(F.hex(x.try_cast("long") * 256 + y.try_cast("long")))
        return F.when(~a.rlike(tail), a).when(fine, F.concat(F.regexp_extract(a, tail, 1), pair(octet[0], octet[1]), F.lit(":"), pair(octet[2], octet[3])))

    def parse(a):
        sides = F.split(a, "::", -1)
        groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))

        def whole(lr):
            have = F.size(lr["l"]) + F.size(lr["r"])
            gap = F.size(sides) == 2
            fine = (F.when(gap, have <= 7).otherwise(have == 8) & (F.size(sides) <= 2)
                    & ~F.exists(F.concat(lr["l"], lr["r"]), lambda g: ~g.rlike(hex_group)))
            eight = F.concat(lr["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - have)), lr["r"])
            text = F.concat(F.lit(":"), F.array_join(F.transform(eight, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), F.lit(":"))
            return F.when(fine, let(text, shortened))
        return let(F.struct(groups(F.get(sides, 0)).alias("l"), groups(F.coalesce(F.get(sides, 1), F.lit(""))).alias("r")), whole)

    def shortened(s):
        out = F.regexp_replace(s, "^:|:$", "")
        for k in range(2, 9):
            run = ":0" * k + ":"
            at = F.instr(s, run)
            cut = F.concat(F.substring(s, F.lit(1), at - 1), F.lit("::"), F.substring(s, at + len(run), F.lit(99)))
            trimmed = let(cut, lambda c: F.regexp_replace(F.regexp_replace(c, "^:(?!:)", ""), "(?<!:):$", ""))
            out = F.when(at > 0, trimmed).otherwise(out) if k == 2 else F.when(at > 0, trimmed).otherwise(out)
        return out

    return let(F.lower(inner), lambda a: F.when(~a.contains(":::"), let(without_v4(a), parse)))


def host_of(raw: Column) -> Column:
    """The serialised host, or null where the standard's host parser fails."""
    def domain(h):
        return F.when((h == "") | h.rlike(FORBIDDEN_DOMAIN), F.lit(None).cast("string")).when(ends_in_number(h), ipv4(h)).otherwise(h)
    address = let(F.regexp_extract(raw, r"^\[(.*)\]\z", 1), ipv6)
    return F.when(raw.startswith("["), F.when(raw.rlike(r"^\[.*\]\z"), F.concat(F.lit("["), address, F.lit("]")))) \
        .otherwise(let(domain_to_ascii(raw), domain))


# --- paths -------------------------------------------------------------------------

DOT, DOTS = r"(?i)^(?:\.|%2e)\z", r"(?i)^(?:\.|%2e){2}\z"


def without_dots(path: Column) -> Column:
    """A path (it starts with a slash) with ``.`` and ``..`` segments resolved."""
    def walk(segments):
        last = F.size(segments) - 1

        def step(acc, seg):
            final = acc["i"] == last
            closed = lambda kept: F.when(final, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
            up = F.slice(acc["out"], F.lit(1), F.greatest(F.lit(0), F.size(acc["out"]) - 1))
            out = F.when(seg.rlike(DOTS), closed(up)).when(seg.rlike(DOT), closed(acc["out"])).otherwise(F.concat(acc["out"], F.array(seg)))
            return F.struct((acc["i"] + 1).alias("i"), out.alias("out"))

        start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(segments, start, step, lambda acc: F.concat(F.lit("/"), F.array_join(acc["out"], "/")))

    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), let(F.split(F.substr(path, F.lit(2)), "/", -1), walk)).otherwise(path)
