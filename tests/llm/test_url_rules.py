"""URL filter against every rule run on every url."""
import random
import re

import pytest

from cohortspark.llm import url_rules

FIELDS = "page_id long, url string, host int, token string, rule long"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, 1, "t", 2) for i, u in urls], FIELDS)


def plain(url, rules):
    """Host, path and the winning rule by trying all of them, with a matcher of its own."""
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    low = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    target, won = low + rest[len(host):], []
    for rule, pattern, verdict, tier, case in rules:
        body = (pattern or "").removeprefix("|").removeprefix("|").removesuffix("|") if pattern != "|" else ""
        if not body:
            continue
        expression = "".join(".*" if c == "*" else r"(?:[^0-9A-Za-z_.%-]|\Z)" if c == "^" else re.escape(c) for c in body)
        flags = re.S | (0 if case else re.I | re.A)
        if pattern.startswith("||"):
            starts = [0] + [m.end() for m in re.finditer(r"\.", low)]
        elif pattern.startswith("|"):
            starts = [0]
        else:
            starts = range(len(target) + 1)
        if any(re.compile(expression + (r"\Z" if pattern.endswith("|") else ""), flags).match(target, s) for s in starts):
            won.append((tier, -len(pattern), verdict != "block", pattern, rule or "", verdict))
    best = min(won, default=(None,) * 4 + ("", "allow"))
    return low, path, best[3], best[5]


def check(spark, urls, rules):
    made = spark.createDataFrame(rules, url_rules.RULES)
    got = sorted(((r["page_id"], r["host"], r["path"], r["pattern"], r["verdict"]) for r in url_rules.judge(pages(spark, urls), made).collect()), key=repr)
    assert got == sorted(((i, *plain(u, rules)) for i, u in urls), key=repr)


DEFAULTS = [(h + p, f"||{h}{p}", v, 0, True) for h, p, v in url_rules.HOST_RULES] + [(None, p, v, 1, False) for p, v in url_rules.PATTERNS]


def test_given_rules(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.net/en/", "http://example.net/EN/1", "http://badexample.net/en/", "http://x.org/fr/", "http://org/fr/9?x", "http://x.org/fr",
            "https://example.com/de/?a#b", "https://my.example.com?/de/", "http://net", "http://net/", "//net/", "net/", None, "", "://", "http://a.net:80/", "http://u@b.net/x", "x://y://z.net/",
            "http://spam-farm.example.org/en/", "http://www.cheap-pills.example.com/reviews/", "http://h.com/a\n/xxx/", "http://é.net/é", "http://h.com/BANNERS/a.gif", "http://h.com/banners/a.gif?x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.net/"), (3, urls[3]), (3, urls[3])] + [(1000 + i, "http://hot.net/x") for i in range(300)]
    check(spark, rows, DEFAULTS)
    rules = {r["page_id"]: r["rule"] for r in url_rules.judge(pages(spark, [(0, urls[0]), (9, "http://b.net/"), (8, "http://q.com/")])).collect()}
    assert rules == {0: "example.net/en/", 9: "net/", 8: None}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_random_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
    draw = random.Random(3)
    word = lambda: draw.choice(["ads", "ad", "net", "en", "Shop", "x1", "é", "a.b", "c-d", "_", "%20", "(", "[x]", "\\"])
    urls = [(i, f"http{draw.choice(['', 's'])}://" + ".".join(word() for _ in range(draw.randint(1, 3))) + "".join(draw.choice("/?#&=.") + word() for _ in range(draw.randint(0, 5)))) for i in range(400)]
    signs = ["*", "^", "/", ".", "", "?"]
    rules = {("", "", "block", 0, True), (None, None, "block", 0, True), (None, "|", "block", 0, True), (None, "*", "allow", 9, True)}
    for i in range(120):
        body = draw.choice(signs) + "".join(word() + draw.choice(signs) for _ in range(draw.randint(1, 3)))
        rules.add((None, draw.choice(["", "|", "||"]) + body + draw.choice(["", "|"]), draw.choice(["allow", "block"]), draw.randint(0, 1), draw.random() < 0.5))
    check(spark, urls, sorted(rules, key=repr))


def test_index_holds_each_rule_once_under_its_rarest_token(spark):
    made = spark.createDataFrame([(None, "||shop.example.net/en/", "block", 0, True), (None, "*ads*", "block", 0, True)], url_rules.RULES)
    targets = spark.createDataFrame([(f"shop.{i}.net/en/",) for i in range(5)] + [("shop.net/",), ("example.net/en/",)], "target string")
    got = {r["pattern"]: r["token"] for r in url_rules.rarest_token_index(made, targets).collect()}
    assert got == {"||shop.example.net/en/": "example", "*ads*": ""}


def test_nothing(spark):
    assert url_rules.judge(pages(spark, [])).count() == 0
    none = spark.createDataFrame([], url_rules.RULES)
    assert [(r["verdict"], r["rule"]) for r in url_rules.judge(pages(spark, [(1, "http://a.net/")]), none).collect()] == [("allow", None)]
