import math
from collections import defaultdict

from pyspark.sql import functions as F

from folioscope.llm import catalog
from folioscope.llm import url_filter as U


def frame(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "s0", "t0", "n", "labelled", "purity")})


def test_hosts_and_paths(spark):
    cases = {
        "http://A.Example.ORG/Es/x?y#z": ("a.example.org", "/Es/x"),
        "https://x.com": ("x.com", ""),
        "https://x.com?q=://y/z": ("x.com", ""),
        "https://x.com#f/g": ("x.com", ""),
        "a://b://c": ("b:", "//c"),
        "no scheme/at all": ("", ""),
        "://": ("", ""),
        "": ("", ""),
        None: ("", ""),
    }
    rows = U.judge_urls(frame(spark, list(cases)), catalog.URL_RULES).collect()
    assert {list(cases)[r.page_id]: (r.host, r.path) for r in rows} == cases


def test_rules(spark):
    cases = {
        "http://a.org/x": ("org/", "allow"),
        "http://example.org/es/1": ("example.org/es/", "block"),
        "http://sub.example.org/en/17": ("example.org/en/1", "block"),
        "http://sub.example.org/en/27": ("org/", "allow"),
        "http://notexample.org/es/1": ("org/", "allow"),
        "http://a.com/de/1": ("com/de/", "block"),
        "http://a.com/fr/1": ("com/fr/", "allow"),
        "http://xcom/fr/1": (None, None),
        "http://a.org": (None, None),
    }
    rows = U.judge_urls(frame(spark, list(cases)), catalog.URL_RULES).collect()
    for r in rows:
        rule, verdict = list(cases.values())[r.page_id]
        assert r.rule == rule
        assert verdict is None or r.verdict == verdict


def test_templates_learn_from_rules(spark):
    rules = [("block", "h.net", "/spam/a"), ("allow", "h.net", "/news/a")]
    urls = [f"http://h.net/spam/a{i}/{i}" for i in range(40)] + [f"http://h.net/news/a{i}/{i}" for i in range(40)]
    urls += ["http://h.net/spam/b/7", "http://h.net/news/b/7", "http://other.net/spam/b/7"]
    rows = {urls[r.page_id]: r for r in U.judge_urls(frame(spark, urls), rules).collect()}
    assert rows["http://h.net/spam/b/7"].verdict == "block"
    assert rows["http://h.net/spam/b/7"].template == "/spam/*/*"
    assert rows["http://h.net/news/b/7"].verdict == "allow"
    assert rows["http://other.net/spam/b/7"].verdict == "allow"


def brute(rows, depth=U.DEPTH):
    """Purity of each (host, segments) cell by plain loops."""
    cells = defaultdict(lambda: [0, 0, 0])
    for host, segments, verdict in rows:
        cell = cells[host, segments]
        cell[0] += 1
        cell[1] += verdict is not None
        cell[2] += verdict == "block"
    total = [sum(c[i] for c in cells.values()) for i in range(3)]
    rate = total[2] / total[1] if total[1] else 0.0
    state = {}
    for (host, segments) in cells:
        mine = [c for (h, _), c in cells.items() if h == host]
        state[host, segments] = ((), (sum(c[2] for c in mine) + U.PRIOR * rate) / (sum(c[1] for c in mine) + U.PRIOR))
    for level in range(depth):
        children, parents = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
        for (host, segments), (path, _) in state.items():
            for i in range(3):
                children[host, path, segments[level]][i] += cells[host, segments][i]
                parents[host, path][i] += cells[host, segments][i]
        named = {}
        for (host, path, segment), (n, labelled, blocked) in children.items():
            pn, pl, pb = parents[host, path]
            others = pl - labelled
            p = (pb + 0.5) / (pl + 1)
            error = math.sqrt(p * (1 - p) * (1 / (labelled + 1) + 1 / (others + 1)))
            gap = abs((blocked + 0.5) / (labelled + 1) - (pb - blocked + 0.5) / (others + 1))
            own = segment == "" or (n >= U.MIN_SHARE * pn and labelled > 0 and others > 0 and gap > U.Z * error)
            named[host, path, segment] = segment if own else "*"
        moved = {k: ((*path, named[k[0], path, k[1][level]]), purity) for k, (path, purity) in state.items()}
        nodes = defaultdict(lambda: [0, 0])
        for k, (path, _) in moved.items():
            nodes[k[0], path][0] += cells[k][1]
            nodes[k[0], path][1] += cells[k][2]
        state = {k: (path, (nodes[k[0], path][1] + U.PRIOR * purity) / (nodes[k[0], path][0] + U.PRIOR)) for k, (path, purity) in moved.items()}
    return state


def test_tree_against_loops(spark, sf_dir):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    found = U.judge_urls(pages, catalog.URL_RULES).collect()
    ruled = {r.page_id: r.verdict if r.rule else None for r in found}

    def segments(path):
        parts = re.sub("^/", "", path).split("/")
        parts = [*parts, *[""] * U.DEPTH][: U.DEPTH]
        return tuple("*" if re.search(U.VARIABLE, p.lower()) else p for p in parts)

    state = brute([(r.host, segments(r.path), ruled[r.page_id]) for r in found])
    for r in found:
        path, purity = state[r.host, segments(r.path)]
        assert abs(r.purity - purity) < 1e-9
        assert r.template == "".join("/" + p if p else "" for p in path)
        if r.rule is None:
            assert r.verdict == ("block" if round(purity, 9) >= U.THRESHOLD else "allow")


def test_empty(spark):
    assert U.judge_urls(frame(spark, ["http://a/b"]).where("false"), catalog.URL_RULES).count() == 0


def test_labels_reach_unruled_hosts(spark):
    urls = [f"http://bad{h}.net/win/{i}" for h in range(3) for i in range(40)] + [f"http://bad{h}.net/news/{i}" for h in range(3) for i in range(40)]
    urls += ["http://new.net/win/1", "http://new.net/news/1"]
    labels = [(i, "/win/" in u) for i, u in enumerate(urls[:-2])] + [(0, False), (None, True), (7, None), (9999, True)]
    labels = spark.createDataFrame(labels, "key long, bad boolean")
    for pool in (False, True):
        judged = U.judge_urls(frame(spark, urls), [], labels=labels, pool=pool)
        rows = {urls[r.page_id]: r.verdict for r in judged.collect()}
        assert len(rows) == len(urls)
        assert {rows[u] for u in urls[:-2] if "/win/" in u} == {"block"}
        assert {rows[u] for u in urls if "/news/" in u} == {"allow"}
        assert rows["http://new.net/win/1"] == ("block" if pool else "allow")
        assert U.unruled(judged).first().asDict() == {"urls": len(urls), "blocked": 120 + pool}


def test_document_ids(spark):
    urls = ["http://a/en/17.html?x=3", "http://a/en/17/", "http://a/en/x17", "http://a", None]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(U.document_id(F.col("url"))).collect()] == [17, 17, None, None, None]
