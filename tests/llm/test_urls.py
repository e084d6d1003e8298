import re

import numpy as np
import xxhash

from tessera.llm import urls

URLS = [
    "https://A.Example.COM/en/7x?q=1", "http://x.example.com/en/8", "http://com/en/", "http://notcom/en/", "https://example.net/de/8", "https://a.net/de/8", "http://b.org/es/#x", "http://b.org/es",
    "https://free-casino-bets.info/win", "https://www.garden-museum.info/roses", "no scheme", "", None, "://", "x://y", "ftp://h?://z/", "http://EXAMPLE.com/EN/7", "http://h#frag/path", "http://ü.Com/en/é?", "https://example.com/en/70",
]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def features(host, path, r):
    line = re.sub("[1-9]", "0", f"/{host} {path} ")
    return {(xxhash.xxh64_intdigest(line[i : i + n].encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63) for n in r.sizes for i in range(max(len(line) - n + 1, 1))}


def model(r):
    rows = [({f % r.buckets for f in features(*parts(u), r)}, y) for u, y in urls.LABELLED]
    y = np.array([y for _, y in rows], float)
    k = np.array([[1 + len(a & b) / np.sqrt(len(a) * len(b)) for b, _ in rows] for a, _ in rows])
    w = np.zeros(len(y))
    for _ in range(r.steps):
        w = w * (1 - r.rate * r.decay) + r.rate * r.pull / len(y) * (y - 1 / (1 + np.exp(-k @ w)))
    weights = np.zeros(r.buckets)
    for (f, _), v in zip(rows, w, strict=True):
        weights[list(f)] += v / np.sqrt(len(f))
    return w.sum() + np.log(r.expected / (1 - r.expected)) - np.log(y.mean() / (1 - y.mean())), weights


def test_against_numpy(spark):
    r = urls.Regression(buckets=8192, steps=40)
    bias, weights = model(r)
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, score double")
    got = urls.url_filter(pages, r=r).collect()
    assert len(got) == len(URLS)
    for row in got:
        host, path = parts(URLS[row.page_id])
        assert (row.host, row.path) == (host, path)
        fit = rule(host, path)
        assert row.rule == (fit.text if fit else None)
        f = {x % r.buckets for x in features(host, path, r)}
        score = 1 / (1 + np.exp(-(bias + weights[list(f)].sum() / np.sqrt(len(f)))))
        assert abs(row.score - score) < 1e-9
        assert row.verdict == (fit.verdict if fit else "block" if score >= r.threshold else "allow")


def test_production_model_tells_them_apart(spark):
    pages = spark.createDataFrame([(0, "https://grand-casino-slots.info/fr/9"), (1, "http://cheap-pills-now.biz/en/2"), (2, "https://www.botany-museum.info/fr/9"), (3, "http://ththre.info/en/2")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.url_filter(pages, rules=()).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    plan = urls.url_filter(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
