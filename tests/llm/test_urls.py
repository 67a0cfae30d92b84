import numpy as np
import pyarrow as pa

from seqloom.llm import queries
from seqloom.llm import urls
from seqloom.llm.urls import BoostedTrees, features, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def rule_of(host, path):
    fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def test_query_by_hand(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op3_url_filters(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r["page_id"]])
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["block_probability"] >= 0.5 else "allow")


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en/x", "x://com/en/", "a://b://c/d", "h://wcom/en/", "h://example.com/en/7?q#f", "h://example.com/en/8", "h://q.net?x=/de/", "h://u@É.ORG:80/es/\nz", "http://com/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in judge_urls(df, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = split(u)
        rule = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule.name if rule else None), u
        assert got[i]["verdict"] in ("allow", "block")
    assert judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_features():
    x = features(pa.array(["http://a.b.com/x/y-1?p=1&q=2#z"]), pa.array(["a.b.com"]), pa.array(["/x/y-1"]), np.array([[0.25, 0.5]]))[0]
    assert x[0] == 30 and x[1] == 7 and x[2] == 6 and x[3] == 2 and x[4] == 3 and x[7] == 3 and x[8] == 1 and x[9] == 1 and list(x[10:]) == [0.25, 0.5]
    assert abs(x[5] - 3 / 30) < 1e-12


def test_split_against_brute_force():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (60, 3)).astype(float)
    y = (x[:, 1] + rng.random(60) > 2.5).astype(float)
    t = BoostedTrees(trees=1, depth=1).fit(x, y)
    b, f = t._binned(x), np.full(60, t.base)
    p = 1 / (1 + np.exp(-f))
    g, h = y - p, p * (1 - p)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(score(b[:, j] <= c) + score(b[:, j] > c) - score(b[:, j] >= 0) for j in range(3) for c in range(len(t.edges[j])))
    assert abs(t.best_split(b, g, h, np.arange(60))[0] - best) < 1e-9


def test_learns_held_out():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((t.predict(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    assert BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).predict(x[:3]).tolist() == [0.5] * 3


def test_suffix_counts_are_those_of_all_distinct_urls(spark):
    rows = [(1, "h://a.b.com/x", "a.b.com", 1), (2, "h://b.com/x", "b.com", 0), (3, "h://com/", "com", 1), (4, "h:///", "", 0)]
    df = spark.createDataFrame(rows, "id long, url string, host string, block int")
    got = {r["suffix"]: (r["blocked"], r["n"]) for r in urls.suffix_counts(df).collect()}
    assert got == {"com": (2, 3), "b.com": (1, 2), "": (0, 1)}
    back = {r["id"]: (r["k1"], r["n1"], r["k2"], r["n2"]) for r in urls.with_counts(df, urls.suffix_counts(df)).collect()}
    assert back[1] == (2, 3, 1, 2) and back[3] == (2, 3, 2, 3)


def test_hot_url_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(i, "h://x.com/en/hot") for i in range(400)] + [(400 + i, f"h://x{i}.net/de/{i}") for i in range(30)] + [(430 + i, f"h://y{i}.com/en/{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    seen = []
    fit = BoostedTrees.fit
    monkeypatch.setattr(BoostedTrees, "fit", lambda self, x, y: (seen.append(len(y)), fit(self, x, y))[1])
    got = judge_urls(df, queries.URL_RULES, max_rows=50).collect()
    assert seen == [50] and len(got) == 460 and {r["verdict"] for r in got if r["page_id"] < 400} == {"block"}


def test_very_long_url_and_repeated_rows(spark):
    long = "h://example.com/en/8" + "/x1" * 700_000
    df = spark.createDataFrame([(1, long), (2, long), (2, long), (3, "h://a.org/x")], "page_id long, url string")
    got = judge_urls(df, queries.URL_RULES).collect()
    assert len(got) == 4 and all(r["verdict"] == "block" and r["rule"] == "com/en/" for r in got if r["page_id"] < 3)
