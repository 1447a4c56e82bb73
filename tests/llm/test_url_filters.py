import math

from pyspark.sql import functions as F

from placerank.llm import common
from placerank.llm import url_filters as uf

ODD = ["http://A.Example.COM/De/x", "http://example.net", "http://net/", "https://deep.a.example.net/en/1?x=/en/", "x://example.org/fr/#a", "no scheme", None, "",
       "http://user@b.org:80/fr/1", "http:///only/path", "a://b://c/d", "http://10.0.0.1/x", "http://xnet/", "http://.net/", "ftp://sub.example.com?/de/", "http://example.com/de"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def posterior(groups, share):
    """groups: key -> (n, bad, (prior mean, its weight)); mean and weight of each, as the library says."""
    some = [(n, b, p) for n, b, (p, _) in groups.values() if n > 1]
    over = sum((b - n * p) ** 2 - n * p * (1 - p) for n, b, p in some)
    per = sum(n * (n - 1) * p * (1 - p) for n, b, p in some)
    r = min(max(over / per if some else share[0], share[0]), share[1])
    out = {}
    for k, (n, b, (p, above)) in groups.items():
        w = 1 / (r + 1 / (above + 1)) - 1
        out[k] = (w * p + b) / (w + n), w + n
    return out


def bounds(pages, bad):
    """host -> lower bound, by plain loops; hosts here have one-label suffixes or the declared ones."""
    share = (uf.LEAST_SHARE, uf.MOST_SHARE)
    count = {}
    for i, url in pages:
        n, b = count.get(split(url)[0], (0, 0))
        count[split(url)[0]] = (n + (i in bad), b + bool(bad.get(i)))

    def parents(host):
        name = host.rsplit("@", 1)[-1].split(":")[0]
        if name and all(c in "0123456789." for c in name):
            return name, name
        suffix = next((s for s in uf.SUFFIXES if name == s or name.endswith("." + s)), name.rsplit(".", 1)[-1])
        return suffix, name if name == suffix else name[: -len(suffix) - 1].rsplit(".", 1)[-1] + "." + suffix

    domain, top = {}, {}
    for h, (n, b) in count.items():
        s, d = parents(h)
        for table, key in ((domain, d), (top, s)):
            table[key] = (table.get(key, (0, 0))[0] + n, table.get(key, (0, 0))[1] + b)
    seen = sum(n for n, _ in top.values())
    root = (sum(b for _, b in top.values()) + 1) / (seen + 2), seen + 2
    tops = posterior({k: (*v, root) for k, v in top.items()}, share)
    to_suffix = {parents(h)[1]: parents(h)[0] for h in count}
    domains = posterior({k: (*v, tops[to_suffix[k]]) for k, v in domain.items()}, share)
    hosts = posterior({k: (*v, domains[parents(k)[1]]) for k, v in count.items()}, share)
    return {k: m - uf.DEVIATIONS * math.sqrt(m * (1 - m) / (w + 1)) for k, (m, w) in hosts.items()}


def check(spark, pages, bad):
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("bad", F.lit(1))
    outcomes = spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")
    got = uf.url_verdicts(table, outcomes).collect()
    want = bounds(pages, bad)
    assert len(got) == len(pages)
    for r, url in ((r, dict(pages)[r.page_id]) for r in got):
        assert (r.host, r.path) == split(url)
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule
        assert math.isclose(r.bad_bound, want[r.host], abs_tol=2e-6)
        assert r.verdict == (verdict or ("block" if want[r.host] > uf.LIMIT else "allow"))
    return got


def farm(n=400):
    pages = list(enumerate(ODD))
    for i in range(n):
        pages.append((1000 + i, f"http://{'a' if i % 3 else 'b'}.spam{i % 4}.org/x/{i}"))
        pages.append((5000 + i, f"http://h{i % 50}.good.de/x/{i}"))
    bad = {i: True for i, u in pages if "spam" in (u or "") and i % 10} | {i: i % 17 == 0 for i, u in pages if "good" in (u or "") and i % 2}
    return pages, bad


def test_hosts_rules_and_reputation(spark):
    pages, bad = farm()
    got = check(spark, pages, bad)
    spam = {r.verdict for r in got if "spam" in r.host}
    good = {r.verdict for r in got if "good" in r.host}
    assert spam == {"block"} and good == {"allow"}


def test_few_pages_are_judged_by_the_domain_and_heavy_hosts_apart(spark, monkeypatch):
    pages, bad = farm()
    pages += [(9000, "http://new.spam1.org/"), (9001, "http://new.good.de/"), (9002, "http://elsewhere.fr/")]
    one = {(r.page_id, r.verdict, r.bad_bound) for r in check(spark, pages, bad)}
    assert {(i, v) for i, v, _ in one if i >= 9000} == {(9000, "block"), (9001, "allow"), (9002, "allow")}
    monkeypatch.setattr(common.attach_counted, "__defaults__", (0,))
    assert {(r.page_id, r.verdict, r.bad_bound) for r in check(spark, pages, bad)} == one


def test_no_outcomes_no_pages_and_repeats(spark):
    pages, _ = farm(5)
    check(spark, pages, {})
    outcomes = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "page_id long, bad boolean")
    none = spark.createDataFrame([], "page_id long, url string")
    assert uf.url_verdicts(none, outcomes).count() == 0
    twice = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, "http://a.b/")], "page_id long, url string")
    assert uf.url_verdicts(twice, outcomes).count() == 3
    assert [(r.n, r.bad) for r in uf.host_reputation(twice, outcomes).collect()] == [(2, 2)]
