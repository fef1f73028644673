import pytest

from tribune.llm import url_filter as u


def test_host_path(spark):
    urls = ["http://A.Example.NET/En/x?q#f", "HTTPS://h", "https://h?x/y", "nope.net/en/", None, "", "a://b://c/d", "x://ÄB.net/#/e"]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    host, path = u.host_path(df.url)
    got = [(r[0], r[1]) for r in df.select(host, path).collect()]
    assert got == [("a.example.net", "/En/x"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("Äb.net", "/")]


def rank(hosts, links, seeds):
    base = {h: (h in seeds) / max(len(seeds), 1) for h in hosts}
    now = dict(base)
    for _ in range(200):
        got = dict.fromkeys(hosts, 0.0)
        for s, d in links:
            got[d] += now[s] / sum(1 for x, _ in links if x == s)
        lost = sum(got.values())
        now = {h: base[h] * (1 - 0.85 * lost) + 0.85 * got[h] for h in hosts}
    return now


def test_rules_and_links(spark):
    a = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://w.example.net/en/1", a("x.com"), "z"),
        (2, "http://w.example.net/de/1", None, "z"),
        (3, "http://q.org/fr/", a("good.com", "Q.org", "good.com"), "z"),
        (4, "http://q.org/en/", "", "z"),
        (5, "http://bad.com/", a("w.example.net", "spam.net"), "z"),
        (6, "http://good.com/a", a("bad.com"), "z"),
        (7, "http://s.example.com/de/1", "", "z"),
        (8, "http://s.example.com/en/1", "", "z"),
        (9, None, a("bad.com"), "z"),
        (9, None, a("bad.com"), None),
        (10, "http://notnet/", "", "z"),
    ]
    # columns named like those at work are the user's
    df = spark.createDataFrame([(*p, "r", "b") for p in pages], "page_id long, url string, html string, verdict string, rules string, by_host string")
    rows = u.judge(df, u.RULES).collect()
    assert len(rows) == len(pages) and all((r.rules, r.by_host) == ("r", "b") for r in rows)
    hosts = {"w.example.net", "q.org", "bad.com", "good.com", "s.example.com", "notnet", "x.com", "spam.net"}
    links = {("w.example.net", "x.com"), ("q.org", "good.com"), ("bad.com", "w.example.net"), ("bad.com", "spam.net"), ("good.com", "bad.com")}
    trust = rank(hosts, links, {"w.example.net", "q.org"})
    distrust = rank(hosts, {(d, s) for s, d in links}, {"w.example.net", "spam.net"})
    for r in rows:
        if r.host:
            assert r.trust == pytest.approx(trust[r.host], abs=1e-3) and r.distrust == pytest.approx(distrust[r.host], abs=1e-3)
    doubted = {h for h in hosts if distrust[h] > trust[h] and distrust[h] * len(hosts) >= u.THRESHOLD}
    assert "bad.com" in doubted and "x.com" not in doubted
    own = lambda h: "block" if h in doubted else "allow"
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == {
        1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("org/fr/", "allow"), 4: (None, own("q.org")), 5: (None, "block"),
        6: (None, own("good.com")), 7: ("example.com/de/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
    }
    assert u.judge(df.limit(0), u.RULES).count() == 0


def test_cycles_converge(spark):
    ring = [f"h{k}.com" for k in range(12)]
    links = {(ring[k], ring[(k + 1) % 12]) for k in range(12)} | {("h3.com", "a.net"), ("b.org", "h5.com")}
    hosts = {*ring, "a.net", "b.org"}
    marked = spark.createDataFrame([(h, h == "b.org", h == "a.net") for h in hosts], "host string, trusted boolean, blocked boolean")
    got = {r.host: (r.trust, r.distrust) for r in u.spread(marked, spark.createDataFrame(sorted(links), "src string, dst string")).collect()}
    trust, distrust = rank(hosts, links, {"b.org"}), rank(hosts, {(d, s) for s, d in links}, {"a.net"})
    most = u.ERROR / len(hosts)
    assert sum(abs(got[h][0] - trust[h]) + abs(got[h][1] - distrust[h]) for h in hosts) <= most
    none = u.spread(marked, spark.createDataFrame([], "src string, dst string")).collect()
    assert {r.host: (r.trust, r.distrust) for r in none} == {h: (float(h == "b.org"), float(h == "a.net")) for h in hosts}


def test_long_hosts(spark):
    """A url of 100 KB costs no more than its length; rules fit it as any other."""
    import time

    hosts = ["a." * 50_000 + "example.net", "." * 100_000 + "net", "b" * 100_000 + ".org", "x." * 50_000 + "nowhere"]
    pages = spark.createDataFrame([(k, f"http://{h}/en/", None) for k, h in enumerate(hosts)], "page_id long, url string, html string")
    began = time.time()
    got = {r.page_id: r.rule for r in u.judge(pages, u.RULES).collect()}
    assert got == {0: "example.net/en/", 1: "net/", 2: None, 3: None} and time.time() - began < 60
