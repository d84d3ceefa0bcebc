"""URL filters against a recount in plain Python."""

import math
import re
from collections import Counter, defaultdict

from lexspan.llm.urls import RULES, Templates, filter_urls, op9_url_filter

PAGES = "page_id long, url string, bad boolean, host string, template string"


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), -i, v, h + p) for i, (v, h, p) in enumerate(RULES)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def brute(rows, how=None):
    how = how or Templates()
    parsed = [(*parse(url), bad) for _, url, bad in rows]
    segments = [[s for s in path.split("/") if s] for _, path, _ in parsed]
    templates = ["" for _ in rows]
    for level in range(how.depth):
        counts = Counter((h, t, s[level]) for (h, _, _), t, s in zip(parsed, templates, segments) if len(s) > level)
        nodes = defaultdict(list)
        for (h, t, _), n in counts.items():
            nodes[h, t].append(n)
        for i, ((h, _, _), t, s) in enumerate(zip(parsed, templates, segments)):
            if len(s) > level:
                n, node = counts[h, t, s[level]], nodes[h, t]
                varies = len(node) >= how.children and sum(node) <= how.pages_per_child * len(node)
                own = n >= how.own_pages and 100 * n >= how.own_percent * sum(node)
                templates[i] = t + "/" + (s[level] if not varies or own else "*")
    templates = [t + "/**" if len(s) > how.depth else t for t, s in zip(templates, segments)]
    stats, shapes, branches = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, _, bad), t in zip(parsed, templates):
        stats[h, t][0] += bad is not None
        stats[h, t][1] += bool(bad)
    shape = {t: re.sub(r"/[^/*][^/]*", "/+", t) for _, t in stats}
    for (h, t), (n, b) in stats.items():
        shapes[h, shape[t]][0] += n
        shapes[h, shape[t]][1] += b
    branch = {}
    for (h, t), (n, b) in stats.items():
        sn, sb = shapes[h, shape[t]]
        share = sb / max(sn, 1)
        off = abs(b / max(n, 1) - share) > how.z * math.sqrt(share * (1 - share) / max(n, 1)) + 1e-12
        branch[h, t] = t if n and off else shape[t]
        branches[h, branch[h, t]][0] += n
        branches[h, branch[h, t]][1] += b
    n_all, b_all = sum(n for n, _ in stats.values()), sum(b for _, b in stats.values())
    prior = (n_all - b_all + 1) / (n_all + 2)
    out = []
    for (page_id, _, _), (h, p, _), t in zip(rows, parsed, templates):
        n, b = branches[h, branch[h, t]]
        purity = (n - b + how.prior * prior) / (n + how.prior)
        verdict, rule = rule_of(h, p)
        out.append((page_id, h, p, rule, verdict or ("block" if purity < how.threshold else "allow"), t, round(purity, 9)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((*r[:6], round(r[6], 9)) for r in df.collect()), key=repr)


def test_edges(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG", "http://example.org/es/1", "https://x.example.org/en/1?q",
        "http://badexample.org/es/1", "http://org/", "http://shop.com/fr/x", "http://shop.com/de/x#y", "http://ÄB.com/É",
        "a://b://c/d", "http://h/a//b/", "http://h/a/b/c/d/e/f", "http://h?x/y", "http://h#/y", "http://com/de/", "http://h/*/x",
    ]
    rows = [(i, u, [None, True, False][i % 3]) for i, u in enumerate(urls)]
    rows += [(7, "http://h/tie", None), (7, "http://h/tie", None), (None, "http://h/tie", True)]
    rows += [(100 + i, f"http://spam.net/buy/{i}", True) for i in range(60)]
    rows += [(200 + i, f"http://spam.net/read/{i}.html", False) for i in range(60)]
    rows += [(300 + i, "http://spam.net/buy/about", False) for i in range(40)]
    rows += [(400 + i, f"http://mixed.net/{lang}/{i}", i % 4 == 0) for i in range(60) for lang in ("en", "fr")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(4)
    got = rows_of(filter_urls(frame))
    assert got == brute(rows)
    verdicts = {(r[1], r[5]): r[4] for r in got}
    assert verdicts["spam.net", "/buy/*"] == "block" and verdicts["spam.net", "/read/*"] == "allow"


def test_empty_and_unlabelled(spark):
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(i, f"http://h.net/{i}", None) for i in range(20)]
    got = rows_of(filter_urls(spark.createDataFrame([(*r, "", "") for r in rows], PAGES)))
    assert got == brute(rows) and {r[4] for r in got} == {"allow"}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        m = re.search(r"/(\d{1,18})[^/\d]*/?$", parse(r.url)[1])
        rows.append((r.page_id, r.url, labels.get(int(m[1])) if m else None))
    assert rows_of(op9_url_filter(spark, sf)) == brute(rows)
