import re

from cuemill.llm.urls import RULES, host_edges, url_filter


def base(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])
    fits = [(len(r), r, v) for r, v in RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


URLS = [None, "", "no url", "://", "http://", "http://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://org",
        "http://org/", "http://xorg/", "https://b.com/fr/", "https://b.com/de/9#f", "https://b.com/fr?x=/fr/",
        "ftp://x.net#://y.org/es/", "http://É.org/É", "http://a.net/", "http://bad.net/", "http://a.net/\nb"]
HTML = {15: '<a href="http://B.com/x">', 16: "<a HREF='//evil.com/z'>", 17: None}


def brute_rank(edges, seeds, damping=0.85, rounds=300):
    total = sum(seeds.values())
    start = {h: n / total for h, n in seeds.items() if n}
    rank = start
    for _ in range(rounds):
        new = {h: (1 - damping) * x for h, x in start.items()}
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + damping * rank[a] * n / sum(m for (s, _), m in edges.items() if s == a)
        rank = new
    return rank


def test_rules_and_spread(spark):
    rows = [(i, u, HTML.get(i, "<p>"), "r") for i, u in enumerate(URLS)] + [(99, "http://evil.com/de/1", "", "r"), (99, "http://evil.com/de/1", "", "r")]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    assert len(got) == len(rows)
    edges, seeds = {}, ({}, {})
    for i, u, h, _ in rows:
        host, _, _, verdict = base(u)
        for to in {x.lower() for x in re.findall(r"(?i)href=[\"'](?:https?:)?//([^/\"']+)", h or "")}:
            edges[host, to] = edges.get((host, to), 0) + 1
        for kind, name in enumerate(("allow", "block")):
            seeds[kind][host] = seeds[kind].get(host, 0) + (verdict == name)
    for host in {h for e in edges for h in e} | {base(r[1])[0] for r in rows} - {""}:
        while host.count(".") > 1:
            up = host.split(".", 1)[1]
            edges[host, up], edges[up, host] = 1, 1
            host = up
    trust = brute_rank(edges, seeds[0])
    distrust = brute_rank({(b, a): n for (a, b), n in edges.items()}, seeds[1])
    for r in got:
        url = dict((x[0], x[1]) for x in rows)[r.page_id]
        host, path, rule, verdict = base(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        t, d = trust.get(host, 0), distrust.get(host, 0)
        assert abs((r.trust or 0) - t) <= 1e-4 * t and abs((r.distrust or 0) - d) <= 1e-4 * d
        assert r.verdict == (verdict or ("block" if t + d and round(d / (t + d), 3) > 0.5 else "allow"))
    assert {r.page_id: r.verdict for r in got}[16] == "block"  # links to a blocked host


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_far_hosts(spark):
    """A chain that leads only to a blocked host, longer than the rounds between two tables."""
    n = 17
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(n)]
    rows.append((n, f"http://h{n}.net/de/1", ""))
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, html string"),
                     rules=(("net/de/", "block"),)).collect()
    assert {r.verdict for r in got} == {"block"}


def test_every_parent_of_a_long_name(spark):
    pages = spark.createDataFrame([("a." * 90 + "deep.info", "")], "host string, html string")
    assert host_edges(pages, "html").count() == 2 * 90
