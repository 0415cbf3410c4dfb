from linkengine.llm import url_reputation as U
from linkengine.llm.queries import RULES
from pyspark.sql import functions as F


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


GOOD, BAD = "<p>" + "good words here " * 40 + "</p>", "<script>" + "many words here " * 40 + "</script>| 1 - 2 |"
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1", "http://a.example.net/de/1", "x://y://z/fr/", "http://example.net", "http://example.net?q",
    "https://notexample.com/de/1", "https://b.example.com/de/x?y#z", "https://example.org/fr/a", "http://ÄÖ.org/fr/é\n/x", "http://ÉA.Net/", "http://h#/x", "http://org/fr/",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], "h")], "page_id long, url string, html string")
    rows = U.judge(df, RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[r["page_id"]] if r["page_id"] is not None else URLS[4]
        assert (r["host"], r["path"]) == split(url)
        name, verdict = rule(*split(url))
        assert r["rule"] == name and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert U.judge(df.limit(0), RULES).count() == 0


def test_shrinkage(spark):
    rows = [("bad.evil.com", 1)] * 30 + [("new.evil.com", None)] + [("www.good.org", 0)] * 40 + [("one.good.org", 1)] + [("x.co.uk", None), ("", None), ("a.b.co.uk", 0)]
    got = {r["host"]: r for r in U.reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    assert got["bad.evil.com"]["lower"] > 0.5 > got["www.good.org"]["upper"]
    assert got["new.evil.com"]["rate"] > got["x.co.uk"]["rate"] > got["www.good.org"]["rate"]
    assert got["one.good.org"]["rate"] < 0.9 and all(0 <= r["lower"] <= r["rate"] <= r["upper"] <= 1 for r in got.values())
    none = U.reputation(spark.createDataFrame([("h", None), ("i", None)], "host string, outcome int")).collect()
    assert {round(r["rate"], 9) for r in none} == {0.5}


def test_registered_domain(spark):
    hosts = ["a.b.co.uk", "co.uk", "example.org", "www.example.org", "org", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffix, domain = U.suffix_and_domain(F.col("h"))
    assert [(r[0], r[1]) for r in df.select(suffix, domain).collect()] == [
        ("co.uk", "b.co.uk"), ("uk", "co.uk"), ("org", "example.org"), ("org", "example.org"), ("org", "org"), ("", ""),
    ]


def test_hosts_of_ports_users_and_addresses(spark):
    hosts = ["user@www.example.org:8080", "10.0.0.1:80", "[::1]:8080", "a.b.gov.fr.", "x.y.platform.example", "www.b.co"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffix, domain = U.suffix_and_domain(F.col("h"), ("platform.example",))
    assert [(r[0], r[1]) for r in df.select(suffix, domain).collect()] == [
        ("org", "example.org"), ("10.0.0.1", "10.0.0.1"), ("[::1]", "[::1]"), ("gov.fr", "b.gov.fr"), ("platform.example", "y.platform.example"), ("co", "b.co"),
    ]


def test_page_outcomes(spark):
    pages = {GOOD: 0, BAD: 1, None: 1, "": 1, "<b>few words</b>": 1, "x | " * 60: 1, "<!-- " + "word " * 60 + "-->": 1, "ä, " * 50: 0, "w " * 49: 1, "w " * 50: 0, "<style>" + "w " * 60 + "</style>": 1}
    pages["word " * 300_000] = 0
    pages["w " * 80 + "7 " * 20], pages["w " * 79 + "7 " * 21] = 0, 1
    rows = spark.createDataFrame([(h,) for h in pages], "html string").select(U.page_outcome(F.col("html")).alias("y")).collect()
    assert [r["y"] for r in rows] == list(pages.values())


def test_hosts_of_one_domain_get_different_verdicts(spark):
    pages = [(f"http://bad.example.com/{i}", BAD if i % 10 else GOOD) for i in range(200)] + [(f"http://good.example.com/{i}", GOOD if i % 10 else BAD) for i in range(200)]
    pages += [("http://new.example.com/1", BAD), ("http://a.b.org/x", GOOD), ("http://a.b.org/" + "x" * 200_000, GOOD)]
    rows = U.judge(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string"), RULES).collect()
    verdicts = {(r["host"], r["verdict"]) for r in rows if r["rule"] is None}
    assert verdicts == {("bad.example.com", "block"), ("good.example.com", "allow"), ("new.example.com", "allow"), ("a.b.org", "allow")}
    lower = {r["host"]: r["bad_rate_lower"] for r in rows}
    assert lower["bad.example.com"] > 0.7 > 0.2 > lower["good.example.com"]


def test_no_page_is_judged_by_its_own_outcome(spark):
    """The bound of a page is the same whether it is good or bad itself, strengths held equal."""
    others = [("h.x.com", 1)] * 6 + [("h.x.com", 0)] * 3 + [("i.x.com", 0)] * 5 + [("j.y.com", 1)] * 4 + [("k.z.org", 0)] * 5
    bounds = []
    for y in (0, 1):
        levels = [(19 + 5, 10 + y, 3.0), (15, 6 + y, 4.0), (10, 6 + y, 5.0)]
        df = spark.createDataFrame([((24, 10 + y), levels)], "top struct<n:bigint,k:bigint>, levels array<struct<n:bigint,k:bigint,s:double>>")
        bounds.append(tuple(df.select(U._posterior(F.col("top"), F.col("levels"), F.lit(y))).first()[0]))
    assert bounds[0] == bounds[1]
    rows = U.reputation(spark.createDataFrame([*others, ("alone.w.net", 1)], "host string, outcome int")).collect()
    alone = next(r for r in rows if r["host"] == "alone.w.net")
    # Without its only page the host is as bad as the corpus, not as itself.
    assert alone["others"]["bad"] < 0.5 and alone["others"]["good"] is None and alone["rate"] > 0.5


def test_internal_names_as_extra_columns(spark):
    names = ["host", "path", "rule", "decided", "lower", "outcome", "n", "k", "suffix", "domain", "above", "a", "b", "s", "rate"]
    df = spark.createDataFrame([(1, "http://x.org/fr/", None, *names)], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    r = U.judge(df, RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == ("x.org", "/fr/", "org/fr/", "allow")
