import random

import pytest

from nearway.llm import url_filter as U
from nearway.llm.queries import RULES


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://example.com", "http://EXAMPLE.com/en/a?b#c", "https://www.example.com/en/x", "https://a.www.example.com/en/", "http://notexample.com/en/",
    "ftp://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://com/", "http://.com/", "http://a..com/x", "http://É.com/É", "http://x.com?y/en/", "http://x.com#/en/", "x://y://z.net/fr/", "http://x.com/a\nb", "http://" + "a." * 300 + "net/fr/" + "b" * 5000,
]


@pytest.mark.parametrize("many", [False, True])
def test_matches_brute_force(spark, many):
    r = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "x.net", "axcom", "a.co"]
    rules = RULES if not many else list({(r.choice(hosts), r.choice(["/", "/p/", "/p/q/", "/p/q/r"])): None for _ in range(20)})
    rules = [x if len(x) == 3 else (*x, r.choice(["allow", "block"])) for x in rules]
    urls = URLS + [f"http://{r.choice(['', 'z.', 'w.z.'])}{r.choice(hosts)}{r.choice(['', '/', '/p', '/p/', '/p/q/r/s', '/q/'])}" for _ in range(300)]
    # repeated rows, a clashing name and a column of its own
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls[:9]])], "page_id long, url string, host string, verdict string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in U.judge_urls(pages, rules, max_local_rules=2 if many else 100, ranges=5).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate([*urls, *urls[:9]])}


def test_rules_as_a_table_and_empty_pages(spark):
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    assert U.judge_urls(pages, rules).collect()[0]["verdict"] == "block"
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert U.judge_urls(pages, []).collect()[0]["verdict"] == "allow"
