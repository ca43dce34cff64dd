import random
import re

from quillmap.llm import url_filter as U
from quillmap.llm.queries import URL_GLOBS, URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url[url.index("://") + 3:]
    host, path, query = re.fullmatch(r"([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?", rest, re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query or ""


def brute(url, rules, globs):
    host, path, query = parse(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.text), r.verdict == "block", [-ord(c) for c in r.text]))
        return host, path, best.text, best.verdict
    as_re = lambda g: re.compile(re.escape(g).replace(r"\*", ".*"), re.S)
    hit = [g for g in globs if as_re(g.host).fullmatch(host) and as_re(g.path).fullmatch(path + query)]
    if hit:
        return host, path, None, max(hit, key=lambda g: (len(g.text), g.verdict == "block")).verdict
    return host, path, None, "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///", "HTTP://EXAMPLE.ORG/es/x", "http://example.org/es", "http://a.example.org/es/",
    "http://badexample.org/es/", "https://x.org", "https://x.org/", "http://org/", "http://com/fr/", "http://a.com/fr/x?y#z", "http://a.com/de/",
    "http://evil.com/x.org/", "http://example.org:80/es/", "ftp://user@b.net/wp-admin/x", "http://c.net/a?u=/wp-admin/1", "http://c.net/a#/wp-admin/1",
    "http://ads.net", "http://x.ads.net/", "http://c.net/LOGIN", "http://c.net/login", "http://c.net/f.exe", "http://c.net/f.exe?x", "x://y://org/z",
    "http://é.org/ü", "http://c.net/*", "http://c.net/" + "a" * 30_000 + ".exe", "http://example.org/en/1", "http://example.org/en/12", "http://example.org/en/2",
    "http://c.net/line\nbreak.exe", "http://c.net/?sessionid=4", "http://c.net?sessionid=4",
]


def test_rules_and_globs(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[9], "x"), (9, URLS[9], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = U.judge_urls(pages, URL_RULES, URL_GLOBS).collect()
    assert len(got) == len(rows)
    want = sorted(repr((i, *brute(u, URL_RULES, URL_GLOBS))) for i, u, _ in rows)
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_many_random_globs_at_once():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab.*") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab.") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["ab" * 500]
    got = U.Automaton([g.encode() for g in globs]).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(re.fullmatch(re.escape(g).replace(r"\*", ".*"), t)), (t, g)


def test_few_texts_take_the_integer_path():
    automaton = U.Automaton([b"*x*" + b"y" * 100 + b"*", b"z"])
    assert automaton.run([b"axb" + b"y" * 100, b"z", b""]).tolist() == [[True, False], [False, True], [False, False]]


def test_star_in_a_rule_is_literal(spark):
    pages = spark.createDataFrame([(1, "http://a.org/*/x"), (2, "http://a.org/b/x")], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, [U.Rule("block", "a.org", "/*/")], []).collect()}
    assert got == {1: "block", 2: "allow"}


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES, URL_GLOBS).collect() == []
