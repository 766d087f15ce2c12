"""Listed rules and mined rules against plain Python."""

import time
from itertools import combinations, product
from random import Random
from urllib.parse import urlsplit

from equiloom.llm import urlrules


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_rule(host, path):
    fits = [r for r in urlrules.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.rule), default=None)
    return (best.rule, best.verdict) if best else (None, None)


URLS = [
    None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org", "http://org/", "http://xorg/a", "http://a.com/de/", "http://com/fr/1#t", "http://é.com/fr/", "x://y://z/de",
    "http://a.net?b/c", "http://a.b.example.org/en/2", "http://u@h.com:80/de/", "http://a.com/De/",
]


def test_parts_and_listed_rules(spark):
    rows = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])], "page_id long, url string")
    found = urlrules.verdicts(rows).collect()
    assert len(found) == len(URLS) + 2
    for row in found:
        url = URLS[3] if row["page_id"] is None else URLS[row["page_id"]]
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")
    assert urlrules.verdicts(rows.limit(0)).count() == 0


def test_split_agrees_with_urlsplit(spark):
    url = "https://m.x.example.net/en/25/a.html?utm=1&b#top"
    row = urlrules.verdicts(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row["host"], row["path"]) == (urlsplit(url).netloc, urlsplit(url).path)


def brute_rules(baskets, support, confidence):
    """Every frequent combination that implies a verdict surely enough, less those a smaller one makes needless."""
    every = set.intersection(*(set(items) for items, _ in baskets))
    items = sorted({i for b, _ in baskets for i in b} - every)
    out = {}
    for size in range(1, len(items) + 1):
        for some in combinations(items, size):
            having = [v for b, v in baskets if set(some) <= set(b)]
            for verdict in {v for v in having}:
                both = having.count(verdict)
                if both >= support * len(baskets) and both / len(having) >= confidence:
                    out[some, verdict] = both / len(having)
    return {(s, v): c for (s, v), c in out.items() if not any(set(t) < set(s) and w == v and d >= c for (t, w), d in out.items())}


def chosen(rules, classes):
    """Rules over classes as rules over tokens, one token a class."""
    of = {}
    for token, name in classes.items():
        of.setdefault(name, []).append(token)
    return {(tuple(sorted(some)), r["verdict"]): round(r["confidence"], 9) for r in rules.collect() for some in product(*(of[i] for i in r["items"]))}


def test_tokens_of_the_same_urls_are_one_class(spark):
    rng = Random(4)
    for _ in range(3):
        baskets = []
        for _ in range(30):
            some = rng.sample(["a", "b", "c", "d"], rng.randrange(5))
            more = [t for i in some if i in "ab" for t in {"a": ["a2"], "b": ["b2", "b3"]}[i]]
            baskets.append((["z", *some, *more], rng.choice(["block", "allow", "block"])))
        found, classes = urlrules.mined(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.1, 0.55)
        assert {classes[t] for t in ("b", "b2", "b3") if t in classes} <= {"b"} and {classes[t] for t in ("a", "a2") if t in classes} <= {"a"}
        assert chosen(found, classes) == {k: round(c, 9) for k, c in brute_rules(baskets, 0.1, 0.55).items()}


def test_a_deep_path_is_mined_in_no_time(spark):
    deep = "/".join(f"s{i}" for i in range(30))
    pages = [(n, f"http://www.example.org/es/{deep}/{n}" if n % 2 else f"http://www.example.org/fr/{n}") for n in range(400)]
    pages += [(1000, "http://other.net/x/s3"), (1001, "http://other.net/x"), (1002, "http://other.net/fr/s3")]
    start = time.time()
    found = {r["page_id"]: r for r in urlrules.verdicts(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert time.time() - start < 60
    assert [found[n]["verdict"] for n in (1000, 1001)] == ["block", "allow"] and found[1000]["method_confidence"] == 1.0


def test_mined_rules(spark):
    baskets = [(["a", "b", "z"], "block")] * 4 + [(["a", "z"], "allow")] * 3 + [(["b", "c", "z"], "block")] * 2 + [(["b", "z"], "allow")] + [(["d", "z"], "allow")] * 2
    found, classes = urlrules.mined(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.15, 0.6)
    assert chosen(found, classes) == {k: round(c, 9) for k, c in brute_rules(baskets, 0.15, 0.6).items()}
    found = found.collect()
    counts = {i: sum(i in b for b, _ in baskets) for i in "abcd"}
    assert all(counts[r["key"]] == min(counts[i] for i in r["items"]) for r in found)


def test_verdicts_follow_the_surest_rule(spark):
    pages = [(f"http://w{i}.example.org/es/x{i}",) for i in range(30)] + [(f"http://w{i}.example.org/fr/x{i}",) for i in range(30)] + [("http://other.net/es/q",), ("http://other.net/fr/q",), ("http://other.net/",)]
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(pages)], "page_id long, url string")
    found = {r["page_id"]: r for r in urlrules.verdicts(rows).collect()}
    assert (found[60]["verdict"], found[61]["verdict"], found[62]["verdict"]) == ("block", "allow", "allow")
    assert found[60]["method_items"] == ["p:es"] and found[60]["rule"] is None
