import random
import re

import pytest

from textgauge.llm.url_filter import SITE_RULES, WORD_RULES, Rule, judge_urls, site_rule, word_rule

RULES = [*SITE_RULES, *WORD_RULES, site_rule("block", "a.org", "/EN"), site_rule("block", "b.org", ""), word_rule("block", "k"), Rule("block", "q\\z", (), -1, 1, "q")]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def verdict(url, rules):
    """Every rule's expression is run."""
    subject = "".join(split(url))
    hits = [r for r in rules if re.search(r.pattern.replace(r"\A", r"\A").replace(r"\z", r"\Z"), subject, re.ASCII)]
    best = max(hits, key=lambda r: (r.rank, r.weight, -rules.index(r)), default=None)
    return (best.name, best.verdict) if best else (None, "allow")


def urls(seed, n=400):
    rng = random.Random(seed)
    words = ["casino", "Xcasino", "CASINO", "spam-farm", "Aspam-farm", "spam_farmé", "adult1", "K", "k", "K", "free.bets", "Free-bets", "ſ", "en", "EN", "EN2", "es", "q", "\n", "é"]
    hosts = ["a.org", "A.ORG", "www.b.org", "b.organic", "b.org\n", "x.net", "casino.com", "casino.de", "caſino.de", "m.adult.io"]
    out = [None, "", "no scheme", "://", "http://b.org", "http://b.org?x", "http://a.org/Xcasino/", "http://a.org/Aspam-farm/"]
    return out + [f"http://{rng.choice(hosts)}{rng.choice(['', '/'])}{'/'.join(rng.choice(words) for _ in range(rng.randint(0, 3)))}{rng.choice(['', '/', '?casino'])}" for _ in range(n)]


@pytest.mark.parametrize("seed,broadcast_rules", [(1, 20_000), (2, 0)])
def test_every_rule_is_run(spark, seed, broadcast_rules):
    all_urls = urls(seed) + ["http://hot.net/casino/x"] * 2000 * (seed == 2)
    pages = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string")
    for r in judge_urls(pages, RULES, broadcast_rules=broadcast_rules).collect():
        assert (r.host, r.path) == split(all_urls[r.page_id])
        assert (r.rule, r.verdict) == verdict(all_urls[r.page_id], RULES), all_urls[r.page_id]


def test_verdicts_do_not_depend_on_other_rows(spark):
    probe = ["http://a.org/Xcasino/", "http://a.org/Aspam-farm/"]
    seen = set()
    for more in ([], ["http://a.org/farm/"] * 5, ["http://a.org/spam/"] * 5, [f"http://a.org/farm/{k}" for k in range(5)], [f"http://a.org/spam/{k}" for k in range(5)]):
        pages = spark.createDataFrame(list(enumerate(probe + more)), "page_id long, url string")
        seen.add(tuple(r.verdict for r in judge_urls(pages).orderBy("page_id").limit(2).collect()))
    assert seen == {("block", "block")}


def test_many_rules(spark):
    rules = [site_rule("block", f"h{k}.org", "/") for k in range(21_000)] + [word_rule("block", "com")]
    rows = [(1, "http://h7.org/"), (2, "http://x.com/"), (3, "http://h20999.org/a"), (4, None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("h7.org/", "block"), 2: (None, "block"), 3: ("h20999.org/", "block"), 4: (None, "allow")}


def test_words_of_a_rule():
    with pytest.raises(ValueError):
        word_rule("block", "Casino")
