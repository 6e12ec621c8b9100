import random
import time

import numpy as np
import pytest

from docquery.llm.queries import URL_LISTED, URL_RULES
from docquery.llm.url_filter import DigestArray, filter_urls, split_url


def brute(url):
    host, path = split_url(url)
    fits = [(len(k), a, k) for a, k in URL_RULES for h, s, p in [k.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    if fits:
        return max(fits)[2], max(fits)[1]
    return None, "block" if any(host == h or host.endswith("." + h) for h in URL_LISTED) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1", "http://a.example.com/en/", "http://example.com/en", "http://example.com?x=/en/",
    "http://xexample.com/en/", "http://a.b.net/es/1", "http://a.net/fr/?q", "http://a.net/de/", "http://x.spam-farm.example.org/en/9#t", "ftp://spam-farm.example.org",
    "http://a://b/c", "http://" + "a." * 3000 + "com/x", "http://casino-win.example.net/de/" + "p" * 5000,
]


def test_matches_brute_force_with_nulls_repeats_and_clashing_names(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[4], "x", "y"), (4, URLS[4], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = filter_urls(df, URL_RULES, URL_LISTED).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[4 if r.page_id is None else r.page_id]
        assert (r.host, r.path) == split_url(url)
        assert (r.rule, r.verdict) == brute(url), url


def test_long_lists_are_joined(spark):
    df = spark.createDataFrame(list(enumerate(URLS[7:])), "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in URL_LISTED], "k string")
    a = filter_urls(df, URL_RULES, listed).orderBy("page_id").collect()
    b = filter_urls(df, URL_RULES, listed, max_bytes=2).orderBy("page_id").collect()
    assert a == b and any(r.listed for r in a)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert filter_urls(df, (), ()).collect() == []
    assert filter_urls(spark.createDataFrame([(1, "http://a.com")], "page_id int, url string"), (), ()).first().verdict == "allow"


def test_equal_digests_are_told_apart(tmp_path):
    weak = lambda b: len(b) % 2
    keys = ["a", "bb", "c", "dd", "e"]
    DigestArray.build({k: 0 for k in keys}, str(tmp_path / "a"), weak)
    array = DigestArray(str(tmp_path / "a"))
    asked = [*keys, "x", "yy", ""]
    found = array.probe(asked, weak)
    assert [array.key(i) if i >= 0 else None for i in found] == [*keys, None, None, None]
    assert (np.diff(array.digests.astype(int)) >= 0).all()


@pytest.mark.parametrize("url, want", [("HTTP://A.B/C?d", ("a.b", "/C")), ("x", ("", "")), ("a://b#c", ("b", ""))])
def test_split(url, want):
    assert split_url(url) == want


def test_path_keys_fit_alike_on_both_ways(spark):
    urls = ["http://example.com/adverts", "http://a.example.com/adv", "http://example.com/ad", "http://example.org/Ad/x", "http://EXAMPLE.org/ad/x", "http://b.net/x", "http://b.net/x/y?z", "http://www.b.net./x", "http://c.com/en/1", None]
    keys = ["example.com/adv", "Example.ORG/Ad", "b.net/x/", "c.com/en/1", "d.com", None]
    rules = (("allow", "c.com/en/"), ("block", "b.net/x"))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(k,) for k in keys], "k string")
    want = [("example.com/adv", "block"), ("example.com/adv", "block"), (None, "allow"), ("example.org/Ad", "block"), (None, "allow"), (None, "block"), ("b.net/x/", "block"), (None, "allow"), ("c.com/en/1", "allow"), (None, "allow")]
    for way in ({}, {"max_bytes": 2}):
        got = filter_urls(df, rules, listed, **way).orderBy("page_id").collect()
        assert [(r.listed, r.verdict) for r in got] == want, way


def test_random_lists_mapped_joined_and_by_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.com", "b.a.com", "c.org", "x.c.org", "com", "d.net"]
    paths = ["", "/", "/a", "/ab", "/ab/", "/ab/c", "/Ab", "/é/x", "/z?q"]
    urls = [f"http://{rng.choice(['', 'w.', 'W.B.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'c', '/ü', '#x'])}" for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for _ in range(3):
        keys = list({rng.choice(hosts) + rng.choice(paths[:-1]) for _ in range(12)})
        rules = tuple({k: (rng.choice(["allow", "block"]), k) for k in (rng.choice(hosts) + rng.choice(paths[:-1]) for _ in range(3))}.values())
        listed = spark.createDataFrame([(k,) for k in keys], "k string")
        fits = lambda u, k: (lambda h, p, kh, kp: (h == kh or h.endswith("." + kh)) and p.startswith(kp))(*split_url(u), k.split("/", 1)[0], k[len(k.split("/", 1)[0]) :])
        longest = lambda found: max(found, key=lambda k: (len(k), len(k.split("/", 1)[0])), default=None)
        want = []
        for u in urls:
            rule = longest([k for _, k in rules if fits(u, k)])
            hit = longest([k for k in keys if fits(u, k) and k not in {r for _, r in rules}])
            want.append((rule, hit, dict((k, a) for a, k in rules)[rule] if rule else "block" if hit else "allow"))
        for way in ({}, {"max_bytes": 1}):
            got = filter_urls(df, rules, listed, **way).orderBy("page_id").collect()
            assert [(r.rule, r.listed, r.verdict) for r in got] == want, way


def test_opening_takes_no_time_by_the_number_of_keys(tmp_path):
    DigestArray.build({f"h{i % 5000}.com/p{i}": 2 for i in range(200_000)}, str(tmp_path / "many"))
    began = time.perf_counter()
    array = DigestArray(str(tmp_path / "many"))
    assert time.perf_counter() - began < 0.1
    asked, owner = array.candidates([("w.h7.com", "/p7/x"), ("h7.com", "/q"), ("none.org", "/p7")])  # no key of this host is as short as /q
    assert [array.key(i) for i in array.probe(asked) if i >= 0] == ["h7.com/p7"] and set(owner) == {0}
