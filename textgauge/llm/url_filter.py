"""URL filter: pattern rules indexed by their rarest literal token.

Every rule has a regular expression over its subject, host and path, and the
literal tokens that any match must contain.  Tokens are maximal runs of a-z and
0-9 in the subject itself, so the index and the expressions read one string and
no rule can match a URL without its tokens.  A count of the tokens over all URLs
tells each rule's rarest, and the rule is filed under it alone.  A URL's tokens
fetch the rules filed under them, and only these run their expressions.  A rule
without a literal is filed under the empty token, which every URL has.

Everything is DataFrame functions.  URLs are judged once each, however many pages
share them, so a hot URL or host costs no task more than another.  Rules are
broadcast up to ``BROADCAST_RULES``; beyond, each token's rules are one row, hot
tokens' rows are broadcast and the rest is joined by shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted

BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; a higher ``rank`` wins, then the longer name.

    ``literals`` are tokens that every subject which ``pattern`` matches has as
    maximal runs of a-z and 0-9; fewer are always right, none is allowed."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int
    weight: int
    name: str | None = None
    note: str = field(default="", compare=False)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path's beginning."""
    subject = host + path
    found = [(m[0], m.end()) for m in re.finditer(_TOKEN, subject)]
    # a token at the path's end may go on in the URL; the host's end is a boundary
    literals = tuple(dict.fromkeys(t for t, end in found if end < len(subject) or not path))
    edge = r"(?=/|\z)"
    return Rule(verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{edge}{re.escape(path)}", literals, 1, len(subject), subject)


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for hosts or paths with these words in a row, joined by - _ or a dot.
    Words are of a-z and 0-9; other characters, capitals in a path among them, end a word."""
    if not words or any(re.fullmatch(_TOKEN, w) is None for w in words):
        raise ValueError(f"words of a-z and 0-9: {words}")
    between = r"[-_.]"
    return Rule(verdict, rf"(?:^|[^a-z0-9]){between.join(words)}(?:[^a-z0-9]|$)", tuple(words), 0, sum(map(len, words)))


SITE_RULES = [
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
]
#: What the filter itself blocks where no site rule fits.
WORD_RULES = [
    word_rule("block", "spam", "farm"),
    word_rule("block", "cheap", "pills"),
    word_rule("block", "casino"),
    word_rule("block", "ads", "track"),
    word_rule("block", "free", "bets"),
    word_rule("block", "adult"),
    word_rule("block", "torrent"),
    word_rule("block", "malware"),
    word_rule("block", "click", "bait"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Judge every page's ``url``: page_id, host, path, rule, verdict.

    The winning rule is the one of highest rank, then weight, then the first in
    the list.  ``rule`` is its name, null where it has none or no rule fits; then
    the verdict is ``default``.  A verdict depends on the URL and the rules alone.
    A null url, or one without ``://``, has an empty host and path.  Repeated rows
    are judged alike; an empty table gives none; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = SITE_RULES + WORD_RULES if rules is None else rules
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    # a URL that very many pages have is judged once, and its pages stay where they are
    pages_of = own.groupBy("url").agg(F.count(F.lit(1)).alias("pages"))
    urls = pages_of.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("subject"))
    tokens = F.array_append(F.array_distinct(F.regexp_extract_all("subject", F.lit(f"({_TOKEN})"), F.lit(1))), F.lit(""))
    spelled = urls.select("url", "subject", F.explode(tokens).alias("token"))
    few = len(rules) <= broadcast_rules

    literals = sorted({t for r in rules for t in r.literals})
    counts: dict[str, int] = {}
    if literals:
        known = spark.createDataFrame([(t,) for t in literals], "token string")
        # at most a row for each literal of a rule
        counts = {r.token: r["count"] for r in spelled.join(F.broadcast(known) if few else known, "token").groupBy("token").count().collect()}
    filed: dict[str, list] = {}
    for k, r in enumerate(rules):
        filed.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t), default=""), []).append((r.pattern, r.verdict, r.name, r.rank, r.weight, -k))
    kind = "token string, n long, filed array<struct<pattern:string,verdict:string,rule:string,rank:int,weight:int,place:int>>"
    index = spark.createDataFrame([(t, counts.get(t, 0) if t else sum(counts.values()) + 1, v) for t, v in filed.items()], kind)
    met = spelled.join(F.broadcast(index), "token") if few else join_counted(spelled, index, ["token"], "n")
    fits = met.select("url", "subject", F.explode("filed").alias("r")).where("subject rlike r.pattern")
    best = fits.groupBy("url").agg(F.max(F.struct("r.rank", "r.weight", "r.place", "r.rule", "r.verdict")).alias("best"))
    out = join_counted(own, pages_of.join(best, "url", "left"), ["url"], "pages")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
