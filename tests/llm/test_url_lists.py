import datetime as dt
import random

from lodestone.llm import url_lists as U
from oracle import assert_same, views
from pyspark.sql import functions as F

DAY = lambda n: dt.datetime(2023, 1, 1) + dt.timedelta(days=n)
EVENTS = "pattern string, listed_at timestamp_ntz, action string, category string"
PAGES = "page_id long, url string, fetched_at timestamp_ntz"


def test_intervals(spark):
    rows = [("a.b", DAY(1), "add", "x"), ("a.b", DAY(2), "add", "x"), ("a.b", DAY(5), "remove", "x"), ("a.b", DAY(5), "add", "x"), ("a.b", DAY(9), "add", "x"), ("c.d", DAY(3), "remove", None), (None, DAY(1), "add", "x"), ("a.b", None, "add", "x"), ("a.b", DAY(7), "renamed", "x")]
    got = {(r["pattern"], r["start"], r["end"]) for r in U.intervals(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("a.b", DAY(1), DAY(5)), ("a.b", DAY(9), None)}


def test_patterns(spark):
    urls = {"https://u@Www.A.co:80/x/y/z.html?q=/a/": ["www.a.co", "a.co", "www.a.co/x/", "www.a.co/x/y/"], "http://localhost": ["localhost"], "http://a.b./": ["a.b"], "nonsense": [], None: []}
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", U.patterns(F.col("url")).alias("p"))
    assert {r["url"]: r["p"] for r in df.collect()} == urls


def test_judgement_equals_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.org", "x.a.org", "b.net", "y.x.a.org"]
    events = [(r.choice([*hosts, "a.org/p/", "x.a.org/p/q/"]), DAY(r.randrange(30)), r.choice(["add", "remove"]), r.choice(["m", "n", None])) for _ in range(60)]
    pages = [(i, f"http://{r.choice(hosts)}{r.choice(['', '/', '/p/i.html', '/p/q/j', '/pp/'])}", DAY(r.randrange(35))) for i in range(120)] + [(500, None, DAY(3)), (501, "http://a.org/", None), (None, "http://b.net/", DAY(9))]
    got = U.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(events, EVENTS)).collect()
    state = {}
    for p, at, action, c in sorted(events, key=lambda e: (e[1], e[2])):
        state.setdefault((p, c), []).append((at, action))

    def active(url, at):
        if url is None or at is None:
            return []
        host, _, path = url[7:].partition("/")
        keys = {".".join(host.split(".")[k:]) for k in range(len(host.split(".")) - 1)}
        parts = path.split("/")[:-1]
        keys |= {host + "/" + "/".join(parts[: k + 1]) + "/" for k in range(len(parts))}
        out = []
        for (p, c), moments in state.items():
            before = [a for t, a in moments if t <= at]
            if p in keys and before and before[-1] == "add":
                out.append((-len(p), p, c or ""))
        return sorted(out)

    want = {i: active(u, t) for i, u, t in pages}
    assert len(got) == len(pages)
    for row in got:
        w = want[row["page_id"]]
        assert row["n_active"] == len(w) and row["kept"] == (not w)
        assert (row["pattern"], row["category"]) == ((w[0][1], w[0][2]) if w else (None, None))


def test_pages_and_prefixes_equal_the_oracle_rule(spark):
    """Exact pages, parts of names, top directories, and hosts in upper case with a dot."""
    r = random.Random(8)
    hosts, tails = ["a.co", "www.a.co", "b.co"], ["", "/", "/x", "/x/", "/x/z.html", "/x/z.html5", "/x/zz/", "/x/zz/q", "/X/z.html", "/é/ü", "//x//y", "/x/z.html/in"]
    listed = [h + t for h in hosts for t in r.sample(tails, 7)] + ["B.Co./x/zz/q", "A.CO/X/z.html", "WWW.a.co"]
    events = spark.createDataFrame([(p, DAY(1), "add", "x") for p in listed], EVENTS)
    pages = [(i, f"http://{h}{t}{q}", DAY(2)) for i, (h, t, q) in enumerate((h, t, q) for h in hosts for t in tails for q in ("", "?q=/x/z.html"))]
    low = lambda p: p.partition("/")[0].lower().rstrip(".") + "".join(p.partition("/")[1:])
    entries = {low(p) for p in listed}

    def met(u):
        page = u[7:].partition("?")[0]
        h = page.partition("/")[0]
        return {p for p in entries if h == p or h.endswith("." + p) or ("/" in p and page.startswith(p))}

    judged = {x["page_id"]: x for x in U.judge(spark.createDataFrame(pages, PAGES), events).collect()}
    active = {}
    for x in U.active_entries(spark.createDataFrame(pages, PAGES), events).collect():
        active.setdefault(x["page_id"], set()).add(x["pattern"])
    for i, u, _ in pages:
        assert active.get(i, set()) == met(u), u
        assert judged[i]["n_active"] == len(met(u)) and judged[i]["kept"] == (not met(u)), u


def test_empty_repeats_and_clashes(spark):
    events, pages = spark.createDataFrame([("a.org", DAY(1), "add", "x")], EVENTS), spark.createDataFrame([(1, "http://a.org/", DAY(2))] * 2, PAGES)
    assert U.judge(pages.limit(0), events).count() == 0
    assert U.judge(pages, events.limit(0)).where("not kept").count() == 0
    clash = pages.withColumn("pattern", F.lit("x")).withColumn("start", F.lit(1)).withColumn("k", F.lit(2))
    assert [r["kept"] for r in U.judge(clash, events).collect()] == [False]
    assert U.active_entries(clash, events).count() == 1


def test_query_equals_oracle(spark):
    from lodestone.llm import catalogue

    sf = "/root/testdata/sf0.001"
    assert_same(catalogue.op2_url_lists(spark, sf), views(sf), U.ORACLE)


def test_odd_urls_equal_the_oracle(spark, tmp_path):
    """IPv6 hosts, ports, users, URLs without a host, nulls and repeats, with entries of every kind on the list."""
    from lodestone.llm import catalogue

    hosts = [f"{a}{i}.{b}" for i in range(40) for a in ("", "www.") for b in ("example.com", "example.org")] + [f"[2001:db8::{i:x}]" for i in range(60)] + ["[::1]:8080", "u:p@Host.Example.com.", "10.0.0.7", "localhost"]
    urls = [f"http://{h}{t}" for h in hosts for t in ("", "/", "/x", "/x/", "/x/z.html?q=/x/", "/é/ü#top")]
    urls += ["nonsense", "http://", "http:///x", "http://[::1", "//a.b/c", "", None, None, urls[3], urls[3]]
    rows = [(379 * i, u) for i, u in enumerate(urls)] + [(3 * 379, urls[3]), (None, urls[0]), (None, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.op2_url_lists(spark, str(tmp_path))
    assert_same(got, views(str(tmp_path)), U.ORACLE)
    found = {(r["category"], str(r["pattern"]).startswith("[")) for r in got.where("not kept").collect()}
    assert {("top", False), ("page", False), ("directory", False), ("host", False), ("host", True)} <= found
