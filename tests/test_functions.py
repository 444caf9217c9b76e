"""Unit tables for the scalar functions."""

from pyspark.sql import functions as F

from conftest import one_col
from contactlake.functions import html as H
from contactlake.functions import similarity as SIM
from contactlake.functions import urls as U
from contactlake.functions import validate as V
from contactlake.operators import crawl as CR


def test_validate_phone(spark):
    cases = {
        "123456": None, "1234567": "+1234567", "(212) 555-0100": "(212) 555-0100",
        "0125550100": None, "1125550100": None, "12125550100": "+1 (212) 555-0100",
        "11125550100": None, "1234567890": None, "2222222123": None,
        "123456789012345": "+123456789012345", "1234567890123456": None, "": None,
        "+44 20 7946 0958": "+442079460958",
    }
    got = one_col(spark, list(cases), V.validate_phone)
    assert got == list(cases.values())


def test_validate_email(spark):
    long_ok = "a" * 244 + "@x.example"       # 254 chars
    cases = {
        "info@shop.biz": True, "NoReply@shop.biz": False, "test@shop.biz": False,
        "latest@shop.biz": True, "x@MAILINATOR.COM": False, long_ok: True, long_ok + "x": False,
        "a b@c.de": False, "a@b": False, "a@b.c|d": True, "a b@c.de": False, "": False,
    }
    got = one_col(spark, list(cases), V.validate_email)
    assert got == list(cases.values())


def test_clean_text(spark):
    assert one_col(spark, [" a ", "  Two   words ", "x" * 210], V.validate_business_name) == \
        [None, "Two words", "x" * 210]
    assert one_col(spark, ["x" * 210], lambda c: V.validate_business_name(c, 200)) == ["x" * 200]
    assert one_col(spark, ["1 Main", "  12  Main  St "], V.validate_address) == ["1 Main", "12 Main St"]


def _href(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, u string")
    return [r[0] for r in df.transform(U.with_normalized_website("u", "n")).orderBy("i").select("n").collect()]


def test_normalize_website(spark):
    cases = {
        "http://Shop12.example.net/About": "https://shop12.example.net/about",
        " www.a.com ": "https://a.com/", "localhost:3000": None, "1.2.3.4": None,
        "1.2.3.4:80": "https://1.2.3.4:80/", "a.com:443/x y": "https://a.com/x%20y",
        "noext": None, "a.b.": None, "": None, "shop.example.net?q=1": "https://shop.example.net/?q=1",
    }
    assert _href(spark, list(cases)) == list(cases.values())


def test_intake_and_host(spark):
    df = spark.createDataFrame([(0, "1.2.3.4:80"), (1, "intranet"), (2, "HTTP://X.com"), (3, "a.com")],
                               "i long, u string")
    rows = (df.transform(U.with_intake_check("u", "c", "e")).transform(U.with_url_host("u", "h"))
            .orderBy("i").select("e", "h").collect())
    assert [r.e for r in rows] == ["Invalid URL: Local URLs not supported", "Invalid URL: Invalid domain format",
                                   None, None]
    assert [r.h for r in rows] == ["1.2.3.4", "intranet", "http", "a.com"]


def test_resolve_and_unwrap(spark):
    df = spark.createDataFrame([("https://a.com:443/x/y?z", "/contact"), ("http://a.com/x", "contact.html"),
                                ("http://a.com/x", "https://b.com/c")], "u string, h string")
    got = [r[0] for r in df.transform(U.with_resolved_link("u", "h", "r")).select("r").collect()]
    assert got == ["https://a.com/contact", "http://a.com/contact.html", "https://b.com/c"]
    assert one_col(spark, ["/url?q=https%3A%2F%2Fa.com%2Fx%2By&sa=U", "https://plain"], U.unwrap_redirect) == \
        ["https://a.com/x+y", "https://plain"]


def test_normalisers_and_similarity(spark):
    assert one_col(spark, ["HARBOR  BAKERY 12, Inc.", "Café Co.", "Acme Corporation LLC"], SIM.normalize_name) == \
        ["harbor bakery 12", "caf", "acme"]
    assert one_col(spark, ["12 Main Street, Suite 3", "4 Rd. Way"], SIM.normalize_address) == \
        ["12 main suite 3", "4"]
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(SIM.string_similarity("a", "b")).collect()] == [2 / 3, 0.0, 1.0]
    p = spark.createDataFrame([("(212) 555-0100", "+1 212 555 0100"), ("n/a", "123"), ("", "1")], "a string, b string")
    got = p.select(SIM.phone_similarity("a", SIM.phone_digits("a"), "b", SIM.phone_digits("b"))).collect()
    assert [r[0] for r in got] == [0.8, 0.8, 0.0]
    e = spark.createDataFrame([("a@x.com", "b@x.com"), ("a@x.com", "a@x.com"), ("a@x.com", "")], "a string, b string")
    assert [r[0] for r in e.select(SIM.email_similarity("a", "b")).collect()] == [0.7, 1.0, 0.0]
    s = spark.range(1).select(SIM.pair_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    assert s.first()[0] > 0.85            # 0.8500000000000001


def test_error_rules(spark):
    df = spark.createDataFrame([
        ("https://a5.com: Page not found (404): Website may not exist", 404),
        ("https://a5.com: HTTP 418: I'm a Teapot", 418),
        ("https://a.com: Request timeout after 30 seconds", None),
        ("https://a.com: Not a business website (confidence: 10%). Reasons: x", None),
        ("Invalid URL: Invalid domain format", None),
        ("https://a.com: quota exceeded", None),
    ], "m string, s int")
    strict = df.transform(CR.with_error_category("m", None, True)).select("category").collect()
    default = df.transform(CR.with_error_category("m", "s", False)).select("category").collect()
    assert [r[0] for r in strict] == ["network", "network", "timeout", "content", "validation", "network"]
    assert [r[0] for r in default] == ["network", "unknown", "timeout", "content", "validation", "network"]
    st = spark.createDataFrame([(403,), (404,), (503,), (418,), (200,)], "s int")
    assert [r[0] for r in st.select(CR.status_message("s")).collect()] == [
        "Access denied (403): Website may be blocking automated requests",
        "Page not found (404): Website may not exist",
        "Server error (503): Website may be temporarily unavailable", "HTTP 418: I'm a Teapot", None]


def test_html_edges(spark):
    cap_case = "<html><body>keep " + "x" * (50_000 - 40) + "<script>var a = 1;" + "y" * 100 + "</script>tail"
    cases = [
        ('<html><head><title>T</title></head><body><p>a&amp;b</p><td>1</td><td>2</td></body></html>', "a&b12"),
        ('<body><a title="x>y" href="/c">link</a>&nbsp;&#65;&#x42;</body>', "link AB"),
        ("<body>a<!-- hidden -->b<script>var s='</p>';</script>c</body>", "abc"),
        (cap_case, "keep " + "x" * (50_000 - 40) + "tail"),      # no cap by default
        ("<body>caf&eacute; &#9999999;&#xFFFFFF;&#55296;&#0;&#150;&#x80;&#99999999999999999999;&nosuch;&amp;lt;</body>",
         "café \ufffd\ufffd\ufffd\ufffd–€\ufffd&nosuch;&lt;"),
        ("<body>&#36;&#x24;&#92;&#x5c;1</body>", "$$\\\\1"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i long, html string")
    got = [r[0] for r in df.transform(H.with_body_text("html", "t")).orderBy("i").select("t").collect()]
    assert got == [e for _, e in cases]
    capped = spark.createDataFrame([(cap_case,)], "html string").transform(H.with_body_text("html", "t", cap=50_000))
    assert capped.first().t == "keep " + "x" * (50_000 - 40)
    a = spark.createDataFrame([('<a class="q>" href=\'mailto:x@y.z?s=1\'>m</a><A HREF=/contact>c</A><a name=x>',)],
                              "html string")
    assert a.transform(H.with_anchor_hrefs("html", "h")).first().h == ["mailto:x@y.z?s=1", "/contact"]


def test_bad_urls_are_values_not_errors(spark):
    from contactlake.functions.urls import url_parts
    rows = ["http://a.com:abc/", "http://a.com:8x", "http://a.com:99999999999/", "http://1.2.3.99999999999999999999/",
            "http://1.2.3.256/", "http://001.2.3.4:0080/x", None, "", "http://a.com:70000/"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, u string")
    got = [(r[0], r[1]) for r in df.select("i", url_parts("u").alias("p")).orderBy("i").select("p.valid", "p.href").collect()]
    assert got == [(False, None)] * 5 + [(True, "http://1.2.3.4/x")] + [got[6]] + [(False, None)] * 2


def test_attempts_without_status_and_timeouts(spark):
    from datetime import datetime
    t = [datetime(2024, 1, 1, 0, i) for i in range(5)]
    log = spark.createDataFrame([
        (1, t[0], "u1", None, False), (2, t[1], "u1", 200, False), (3, t[0], "u2", None, True), (4, t[1], "u2", 200, False),
        (5, t[0], "u3", None, False), (6, t[1], "u3", None, None), (7, t[2], "u3", None, False), (8, t[3], "u3", 200, False)],
        "event_id long, fetched_at timestamp, url string, status int, timed_out boolean")
    got = {r["url"]: (r["attempts"], r["final_attempt"], r["status"], r["ok"], r["message"]) for r in CR.attempt_outcome(log).collect()}
    assert got == {"u1": (2, 2, 200, True, ""), "u2": (2, 1, None, False, "Request timeout after 30 seconds"),
                   "u3": (3, 3, None, False, "Failed to fetch after retries")}
    plan = CR.attempt_outcome(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_relative_redirects(spark):
    cases = [("?x=1", "http://h.com/a/b?x=1"), ("#f", "http://h.com/a/b?q=2#f"), ("c", "http://h.com/a/c"), ("/r", "http://h.com/r"),
             ("//o.org/z", "http://o.org/z"), ("http://p.net/", "http://p.net/")]
    df = spark.createDataFrame([("http://h.com/a/b?q=2", c) for c, _ in cases], "at string, loc string")
    assert [r[0] for r in df.transform(CR.resolve_location("at", "loc", "n")).select("n").collect()] == [e for _, e in cases]


def test_repeated_pages_do_not_multiply_rows(spark):
    from contactlake.operators import enrich as EN
    contacts = spark.createDataFrame([("https://Shop.example.com/", "a@s.com"), ("https://shop.example.com/", "b@s.com"),
                                      ("https://www.shop.example.com/", None)], "url string, email string")
    b = spark.createDataFrame([(1, "http://shop.example.com", ""), (2, "http://shop.example.com", "own@x.com"), (3, "", None)],
                              "ord long, website string, email string")
    got = {r["ord"]: r["email"] for r in EN.enrich(b, contacts, "email").collect()}
    assert got == {1: "a@s.com", 2: "own@x.com", 3: None}


def test_url_standard_cases(spark):
    from contactlake.sources.fixtures import URL_CASES
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URL_CASES)] + [(10_000, None), (10_001, "")], "i int, u string")
    got = [r[0] for r in df.select("i", U.url_parts("u")["href"].alias("h")).orderBy("i").select("h").collect()]
    assert got == [h or None for _, h in URL_CASES] + [None, None] and len(URL_CASES) > 60


def test_punycode_on_random_labels(spark):
    import random

    from contactlake.functions import hosts
    rng = random.Random(2)
    labels = ["".join(rng.choice("ab-9éüßжыяあ漢字𠮷😀ก") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    want = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    assert one_col(spark, labels, lambda c: hosts.let(c, hosts.punycode)) == want


def test_ipv6_on_random_addresses(spark):
    import ipaddress
    import random

    from contactlake.functions import hosts
    rng = random.Random(4)
    groups = [[rng.choice([0, 0, 0, 1, 0xFFFF, rng.randrange(65536)]) for _ in range(8)] for _ in range(300)]
    written = [":".join(f"{g:0{rng.choice([1, 4])}X}" for g in gs) for gs in groups]
    # the library writes mapped and a single zero group its own way
    want = [ipaddress.IPv6Address(":".join(f"{g:x}" for g in gs)) for gs in groups]
    got = one_col(spark, written, lambda c: hosts.let(c, hosts.ipv6))
    assert [ipaddress.IPv6Address(g) for g in got] == want
    plain = [(g, w) for g, w, gs in zip(got, want, groups, strict=True) if "." not in str(w) and gs.count(0) != 1]
    assert all(g == str(w) for g, w in plain if "::" in str(w))


def test_dot_segments_on_random_paths(spark):
    import random

    from contactlake.functions import hosts
    rng = random.Random(6)

    def plain(path):
        out, parts = [], path[1:].split("/")
        for i, s in enumerate(parts):
            kind = s.lower().replace("%2e", ".")
            if kind in (".", ".."):
                del out[len(out) - (kind == ".." and len(out) > 0):]
                if i == len(parts) - 1:
                    out.append("")
            else:
                out.append(s)
        return "/" + "/".join(out)
    paths = ["/" + "/".join(rng.choice(["a", "b", "", ".", "..", "%2e", ".%2E", "..."]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    assert one_col(spark, paths, lambda c: hosts.let(c, hosts.without_dots)) == [plain(p) for p in paths]
