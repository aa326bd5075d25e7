import random

import numpy as np
import pytest

from glosswork.llm import bloom, urls

EDGES = [
    None, "", "no scheme", "http://", "http:///en/x", "http://NET", "http://a.net", "http://a.net/", "http://a.net?x=/", "http://a.net#/", "http://net/", "http://xnet/",
    "HTTP://M.Example.NET/en/1?utm_source=x", "http://example.net/en", "http://example.net/en/", "http://example.net/de/", "http://example.com/de/1", "http://badexample.com/de/1",
    "http://a.b.example.com/de/", "http://a.org/fr/1", "http://a.org/en/1", "x://y://a.net/z", "http://a.net:80/en/", "http://a..net/", "http://.net/", "http://\nhost.net/pa\nth?q", "http://ÄÉ.NET/Ü",
    "http://" + "a." * 3000 + "net/" + "p" * 100_000,
]
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(url, listed, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut].translate(LOWER), rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    return host, path, None, "block" if host and host in listed else "allow"


RULES = [*urls.RULES, ("a.org", "/", "allow"), ("a.org", "/f", "block"), ("org", "/fr/1", "allow"), ("b.example.com", "/de/", "allow"), ("net", "/z", "allow"), ("net", "/z", "block")]


@pytest.mark.parametrize("rules", [urls.RULES, RULES, []])
def test_edges_against_brute_force(spark, rules):
    """Nulls, empty hosts and paths, repeated rows, clashing columns, very long urls; an empty table and an empty list."""
    rows = [(i, u, "x", "y", i) for i, u in enumerate([*EDGES, *EDGES])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, __found string, __ long")
    listed = {"xnet", "a.org", "", "nowhere.example"}
    hosts = spark.createDataFrame([(h,) for h in listed], "h string")
    out = urls.judged(pages, hosts, rules)
    assert out.columns == ["page_id", "url", "__found", "__", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute(u, listed, rules) for i, u, *_ in rows}
    assert urls.judged(pages.limit(0), hosts, rules).count() == 0
    none = urls.judged(pages, hosts.limit(0), rules).collect()
    assert {r.page_id: r.verdict for r in none} == {i: brute(u, set(), rules)[3] for i, u, *_ in rows}


def keys_of(spark, n, share, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.getrandbits(63), rng.getrandbits(63), rng.random() < share) for _ in range(n)], "a long, b long, listed boolean")


@pytest.mark.parametrize("n, share", [(20_000, 0.02), (5_000, 0.5), (3_000, 0.97), (50, 1.0), (50, 0.0), (0, 0.0)])
def test_cascade_is_exact_on_its_universe(spark, n, share):
    keys = keys_of(spark, n, share, n)
    found = urls.cascade(keys)
    rows = keys.collect()
    a, b = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (0, 1))
    assert found.holds(a, b).tolist() == [r.listed for r in rows]
    listed = sum(r.listed for r in rows)
    assert found.bits <= urls.bits_needed(listed, n - listed) + 64 * len(found.filters)
    if share == 0.02:
        assert 3 <= len(found.filters) and not all(one.holds(a, b)[[not r.listed for r in rows]].any() is False for one in found.filters[:1])


def test_parts_give_the_same_rows(spark, sf, monkeypatch):
    """A list above the bound is parted by hash; a filter above it is refused."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    hosts = pages.select(urls.host_of(pages.url).alias("h")).distinct().filter("length(h) % 2 = 0")
    want = sorted(map(tuple, urls.judged(pages, hosts).drop("url").collect()), key=repr)
    monkeypatch.setattr(bloom, "MOST_BITS", 256)
    assert sorted(map(tuple, urls.judged(pages, hosts).drop("url").collect()), key=repr) == want
    assert {r[-1] for r in want} == {"allow", "block"}
    with pytest.raises(ValueError):
        bloom.built(keys_of(spark, 1000, 1, 1).select("a", "b"), 1000, 0.01)


def test_plan_has_no_join(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    plan = urls.judged(pages, urls.tracking_hosts(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
