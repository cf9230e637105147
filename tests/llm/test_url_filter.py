import numpy as np

from flowsieve.llm import url_filter as U

URLS = ["http://a.example.com/en/1", "https://www.EXAMPLE.com/en/x?y#z", "http://example.com", "http://example.com/", "http://x.net/es/2", "http://x.net/fr/", "http://xnet/es/", None, "", "no scheme",
        "ftp://com/a", "http://notexample.com/en/", "http://a.com?u=http://example.com/en/", "http:///en/", "http://example.com#/en/", "http://example.com/en", "://net/es/"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, "allow"))
    return host, path, rule[1], rule[2]


def test_rules_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, _hit string, verdict string")
    want = {i: plain(u) for i, u in enumerate(URLS)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages).collect()} == want
    rules = spark.createDataFrame(list(U.RULES), "host string, path string, verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_by_join(pages, rules).collect()} == want
    assert U.judge(pages.limit(0)).count() == 0


def test_ties_of_rules_are_broken_alike(spark):
    pages = spark.createDataFrame([(0, "http://a.b/xyz"), (1, "http://x.c/yy"), (2, "http://a.b")], "page_id long, url string")
    rules = [("a.b", "/x", "allow"), ("b", "/xyz", "block"), ("x.c", "/", "block"), ("c", "/yy", "allow"), ("a.b", "", "allow"), ("b", "", "block")]
    want = [(0, "a.b/x", "allow"), (1, "x.c/", "block"), (2, "a.b", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in U.judge(pages, rules).collect()) == want
    assert sorted((r.page_id, r.rule, r.verdict) for r in U.judge_by_join(pages, table).collect()) == want


def test_no_rules_and_contradicting_rules(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x")], "page_id long, url string")
    assert U.judge(pages, []).first().verdict == "allow"
    assert U.judge(pages, [("a.com", "/", "allow"), ("a.com", "/", "block")]).first().verdict == "block"


def test_strings_decide_between_equal_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda b: len(b))
    (tmp_path / "r").write_bytes(U.DigestArray.pack([("aa", "/", "allow"), ("bb", "/", "block"), ("c", "/", "block")]))
    store = U.DigestArray(str(tmp_path / "r"))
    hit = store.lookup([b"bb/", b"aa/", b"zz/", b"c/"])
    assert np.array_equal(hit >= 0, [True, True, False, True]) and store.block[hit[0]] and not store.block[hit[1]]
