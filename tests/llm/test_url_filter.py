import random
import re

from tallyfold.llm.queries import HOST_RULES
from tallyfold.llm.url_filter import DEFAULT_BLOCKS, compiled, judge_urls, rule_table

PAGES = "page_id long, url string, rule string, verdict string"


def fits_pattern(pattern, target):
    """Without expressions: the literal parts of a pattern are found one after the other."""
    parts = pattern.removeprefix("||").split("*")
    if pattern.startswith("||"):
        host = target.split("/")[0]
        starts = [0] + [i + 1 for i, c in enumerate(host) if c == "."]
    else:
        starts = [0]
    return any(target.startswith(parts[0], at) and rest_fits(parts[1:], target[at + len(parts[0]) :], pattern.startswith("||")) for at in starts)


def rest_fits(parts, target, anchored):
    for i, part in enumerate(parts):
        if i == len(parts) - 1 and not anchored:
            return target.endswith(part)
        if (at := target.find(part)) < 0:
            return False
        target = target[at + len(part) :]
    return anchored or not target


def plain(url):
    """host, path, rule and verdict, spelled out."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = []
    for name, verdict in HOST_RULES:
        where, start = name.split("/", 1)
        if (host == where or host.endswith("." + where)) and path.startswith("/" + start):
            fits.append((len(name), name, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = any(fits_pattern(p, host + path) for p in DEFAULT_BLOCKS)
    return host, path, None, "block" if blocked else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.NET/x", "http://x.example.net/en/1", "http://example.net/EN/1", "http://xexample.net/en/", "http://example.com/de/", "http://example.com/den",
    "ftp://org/fr/?q", "http://.org/fr/", "http://a.org?x=/fr/", "http://a.org#x", "http://net.org/de/", "http://spam-farm.com/", "http://www.cheap-pills.example.com/en/1?x", "http://a.com/wp-login.php", "http://a.com/b.exe",
    "http://a.com/b.exe?x", "http://a.com/bexe", "a://b://net/", "http://x.net:80/", "http:///net/", "http://é.net/ü/\n", "http://a.com/" + "y/" * 20_000,
]


def judged(spark, urls):
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)], PAGES)
    rules = rule_table(spark, [(n, f"||{n}", v) for n, v in HOST_RULES])
    fallback = rule_table(spark, [(p, p, "block") for p in DEFAULT_BLOCKS])
    return judge_urls(pages, rules, fallback)


def test_equals_all_rules_tried(spark):
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, URLS).collect()}
    assert found == {i: plain(u) for i, u in enumerate(URLS)}


def test_repeats_and_empty(spark):
    assert judged(spark, ["http://a.net/"] * 50).where("verdict = 'block'").count() == 50
    assert judged(spark, []).count() == 0


def test_no_python_in_the_plan(spark):
    plan = judged(spark, URLS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_thousands_of_rules_of_a_table(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice(["a", "b", "Ab", "1", ".", "/", "-", "+", "(", "$", "é", " "]) for _ in range(n))
    patterns = {rng.choice(["", "||"]) + rng.choice(["*", "*/", "", "a"]) + some(rng.randint(0, 5)) + rng.choice(["*", "", "/"]) + some(rng.randint(0, 2)) + rng.choice(["*", ""]) for _ in range(4000)}
    rules = [(p, p, rng.choice(["allow", "block"])) for p in sorted(patterns)]
    urls = ["x://" + some(rng.randint(0, 9)) for _ in range(300)] + ["x://a/b\n", "x://a"]
    table = spark.createDataFrame([*rules, (None, "*", "block"), ("none", None, "block"), ("nor", "*", None)], "rule string, pattern string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = judge_urls(pages, compiled(table), rule_table(spark, [])).collect()
    assert len(found) == len(urls)
    for r in found:
        fits = [(len(name), [-ord(c) for c in name], name, verdict) for name, p, verdict in rules if fits_pattern(p, r.host + r.path)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow")), urls[r.page_id]


def test_rules_that_share_a_name(spark):
    rules = [("r", "||a.com/", "allow"), ("r", "||b.com/", "block"), ("r", "*/x", "block"), ("r", "*/x", "block"), ("r", "||é.*", "block")]
    pages = spark.createDataFrame(list(enumerate(["x://a.com/", "x://b.com/", "x://a.com/x", "x://c.com/", "x://é.com/"])), "page_id long, url string")
    found = judge_urls(pages, rule_table(spark, rules), rule_table(spark, []))
    assert {(r.page_id, r.verdict) for r in found.collect()} == {(0, "allow"), (1, "block"), (2, "block"), (3, "allow"), (4, "block")} and found.count() == 5
