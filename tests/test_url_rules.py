"""Longest rules against a plain search of all rules."""

import random

from lekhya.operators import url_rules


def plain(host, path, rules):
    hits = [(len(h), len(p), ok, h, p) for h, p, ok in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not hits:
        return False, None
    top = max(hits)[:2]
    best = [x for x in hits if x[:2] == top]
    return all(x[2] for x in best), (best[0][3], best[0][4])


def test_longest_rule_decides(spark):
    rng = random.Random(9)
    hosts = ["gov.in", "a.gov.in", "b.a.gov.in", "xgov.in", "in", "n.org"]
    paths = ["/", "/d", "/docs", "/docs/a", "/docs/ab", "/x"]
    rules = list({(rng.choice(hosts), rng.choice(paths), rng.random() < .5) for _ in range(40)})
    asked = [(i, rng.choice(hosts), rng.choice(paths) + rng.choice(["", "/q", "b"]))
             for i in range(300)]
    rows = [(i, f"https://{h}{p}?k=1#f") for i, h, p in asked] + [(0, "https://gov.in/docs")] * 2
    asked += [(0, "gov.in", "/docs")] * 2
    got = url_rules.decide(spark.createDataFrame(rows, "id int, url string"),
                           spark.createDataFrame(rules, "host string, prefix string, allow boolean"))
    have = sorted((r["id"], r["allowed"], tuple(r["rule"]) if r["rule"] else ()) for r in got.collect())
    want = sorted((i, ok, r or ()) for i, h, p in asked for ok, r in [plain(h, p, rules)])
    assert have == want


def test_odd_rows(spark):
    rules = spark.createDataFrame(
        [(" .GOV.in ", "/d ", True), ("gov.in", "/d/no", True), ("gov.in", "/d/no", False),
         ("gov.in", "/d/null", None), (None, "/", True), ("", "/", True), ("n.org", None, True)],
        "host string, prefix string, allow boolean")
    urls = ["http://W.gov.in/d", "https://gov.in/d/no/1", "https://gov.in/d/null", "ftp://gov.in/d",
            None, "", "https://n.org/", "https://gov.in.evil.com/d"]
    items = spark.createDataFrame([(u, "h", 1) for u in urls], "url string, host string, place int")
    got = {r["url"]: r["allowed"] for r in url_rules.decide(items, rules).collect()}
    assert [got[u] for u in urls] == [True] + [False] * 7
    assert url_rules.decide(items, rules).columns == ["url", "host", "place", "allowed", "rule"]
    assert url_rules.decide(items.limit(0), rules).count() == 0
    assert url_rules.decide(items, rules.limit(0)).filter("allowed").count() == 0
