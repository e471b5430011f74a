import re

from tidemark.llm import url_filter
from tidemark.llm.url_filter import SOFT, STRICT, UrlFilter, judge_urls

URLS = [
    None, "", "no scheme", "http://", "http://A.NET", "http://a.net/", "http://x.example.net/en/1", "http://example.net/de/", "http://badexample.net/en/",
    "https://m.example.com/de/1?x#y", "https://m.example.com/DE/1", "http://w.org/fr/casino", "http://w.org/en/casino", "http://w.org/casinos", "http://w.org/free",
    "http://w.org/free/free", "http://w.org/free-bets", "http://w.org/xcheap/pills", "ftp://h?q#f", "http://h/a?b://c/d", "a://b://c/d",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    rule = verdict = None
    for v, h, p in sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2])):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rule, verdict = h + p, v
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    strict = sum(len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in STRICT)
    soft = sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in SOFT)
    return host, path, rule, strict, soft, verdict or ("block" if 2 * strict + soft >= 2 else "allow")


def test_rules_and_vocabulary(frame):
    rows = [(k, u, "clash") for k, u in enumerate(URLS + URLS[:3])]
    got = {r.page_id: r for r in judge_urls(frame(rows, "page_id long, url string, verdict string")).collect()}
    for k, u, _ in rows:
        r = got[k]
        assert (r.host, r.path, r.rule, r.strict_hits, r.soft_hits, r.verdict) == expected(u), u


def test_longest_rule_and_own_vocabulary(frame):
    own = UrlFilter(rules=(("block", "b.net", "/x/y"), ("allow", "ab.b.net", "/")), strict=("bad",), soft=("p", "q", "r"), reject_at=3)
    rows = [(1, "http://ab.b.net/x/y"), (2, "http://a.com/p/q"), (3, "http://a.com/p-q.r"), (4, "http://a.com/bad")]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(frame(rows, "page_id long, url string"), using=own).collect()}
    assert got == {1: ("ab.b.net/", "allow"), 2: (None, "allow"), 3: (None, "block"), 4: (None, "block")}
    assert judge_urls(frame(rows, "page_id long, url string").where("false")).count() == 0
