"""URL rules and templates, and secret findings."""

from pyspark.sql import functions as F

from tracklens.llm import secrets, url_filters


def by_hand(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(s + p, v) for s, p, v in url_filters.RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_rules_and_templates(spark):
    urls = [None, "", "nothing", "http://", "HTTPS://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/2", "http://a.example.com/EN/2", "x://example.com", "http://a.net/es/1", "http://anet/es/1",
            "http://b.net/fr/2#/en/", "http://c.org?q=/es/", "http://d.org/" + "s/" * 40, "http://e.com/\n/x", "a://b://c.com/d", "http://www.example.com/en/9"] * 2
    good = [(f"http://m.org/ok/{i}", 1) for i in range(40)] + [(f"http://m.org/spam/{i}", 0) for i in range(40)] + [(None, 1), ("http://m.org/ok/1", None)]
    pages = spark.createDataFrame(list(enumerate(urls + ["http://m.org/ok/77", "http://m.org/spam/77"])), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, spark.createDataFrame(good, "url string, good int")).collect()}
    assert len(got) == pages.count()
    for i, url in enumerate(urls):
        host, path, (rule, verdict) = by_hand(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (verdict is None or got[i].verdict == verdict)
    assert got[len(urls)].verdict == "allow" and got[len(urls) + 1].verdict == "block" and got[len(urls) + 1].template == "/spam/#"
    assert url_filters.judge_urls(pages.limit(0), spark.createDataFrame([], "url string, good int")).count() == 0


def test_one_bad_section_of_many(spark):
    good = [(f"http://h.org/part-{chr(97 + s % 26)}{chr(97 + s // 26)}/{i}", int(s != 7)) for s in range(100) for i in range(20)]
    pages = spark.createDataFrame([(0, "http://h.org/part-ha/99"), (1, "http://h.org/part-ca/99"), (2, "http://h.org/new/1")] + [(3 + i, u) for i, (u, _) in enumerate(good)], "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, spark.createDataFrame(good, "url string, good int")).collect()}
    assert [got[i].verdict for i in range(3)] == ["block", "allow", "allow"]
    assert got[0].template == "/part-ha/#" and got[1].template == got[2].template == "/*/#"


def test_deep_paths_branch_at_any_depth(spark):
    """Variable segments beyond any fixed depth become wildcards; a path of thousands of segments costs one step."""
    deep = "http://h.org" + "".join(f"/{c}" for c in "abcdefghijkl")
    good = [(f"{deep}/{x}{y}/ok/{i}", 1) for x in "pqrst" for y in "uvwx" for i in range(5)]
    good += [(f"{deep}/{x}{y}/spam/{i}", 0) for x in "pqrst" for y in "uvwx" for i in range(5)]
    urls = [f"{deep}/new/ok/1", f"{deep}/new/spam/1", "http://long.org" + "/s" * 5000 + "/x", "http://long.org" + "/s" * 5000 + "/y/z", "http://long.org" + "/s" * 5000, deep, deep]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, template_ string, n_ int")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, spark.createDataFrame(good, "url string, good int")).collect()}
    below = deep[len("http://h.org"):] + "/*"
    assert [(got[i].template, got[i].verdict) for i in (0, 1)] == [(below + "/ok/#", "allow"), (below + "/spam/#", "block")]
    assert got[2].template == "/s" * 5000 + "/*" and got[3].template == "/s" * 5000 + "/*/z"
    assert got[4].template == "/s" * 5000 and got[5].template == got[6].template == deep[len("http://h.org"):]


def test_secrets(spark, documents, odd):
    kinds = [("key AKIA%016d end", 1), ('token = "%040x" x', 1), ("number %016d and", 0), ("see page-of-things-%d now", 0)]
    rows = [(i * 10 + k, "Before " + text % (i * 7919 + 10**15 if "016d" in text or "040x" in text else i + 100), label) for i in range(40) for k, (text, label) in enumerate(kinds)]
    rows = [(i, t.replace("AKIA", "AKIA"), y) for i, t, y in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert sum(got[i].is_secret == bool(y) for i, _, y in rows if i in got) >= 0.95 * len(rows)
    text = {i: t for i, t, _ in rows}
    assert all(16 <= r.end - r.start and text[i][r.start:r.end].strip() == text[i][r.start:r.end] for i, r in got.items())
    assert secrets.scan_secrets(odd).count() == 0 and secrets.scan_secrets(documents.limit(0)).count() == 0


def test_short_and_odd_assigned_values_are_candidates(spark):
    texts = ['password = "Tr0ub4dor&3" x', "set api_key: 'p@ss w0rd!' now", "DB_PASSWD=hunter2; go", "run abcdefghijklmnopqrstuvwx now", '{"auth_token": "é😀zz9"}', "plain words only"]
    want = {(0, "Tr0ub4dor&3"), (1, "p@ss w0rd!"), (2, "hunter2;"), (3, "abcdefghijklmnopqrstuvwx"), (4, "é😀zz9")}
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, texts[r.doc_id][r.start:r.end]) for r in got} == want
    assert all(r.is_secret for r in got if r.doc_id in (0, 1))
