"""URL filters: pattern rules found through their rarest literal token.

All work is done by DataFrame functions. A pattern is literal text with ``*`` for any
characters; its tokens are the runs of letters and digits that the pattern bounds on both
sides. Each rule is filed under the one of its tokens that the fewest URLs have. A URL
fetches the rules filed under its own tokens, and only those run as regular expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: rules of the query, (host, path) and verdict
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# fixed values: patterns that the query blocks or allows where no host rule fits
PATTERN_RULES = [
    (".cheap-pills.", "block"), ("/cheap-pills.", "block"), (".spam-farm.", "block"), ("/spam-farm.", "block"),
    (".casino-win.", "block"), ("/casino-win.", "block"), (".free-bets.", "block"), ("/free-bets.", "block"),
    (".adult-x.", "block"), ("/adult-x.", "block"), (".ads-track.", "block"), ("/ads-track.", "block"),
    ("free-casino", "block"), ("/adserver/", "block"), ("/banner-ads/", "block"),
    (".doubleclick.", "block"), ("/affiliate/*/click", "block"), ("?popunder=", "block"), ("/wp-login.php", "block"),
    ("/casino-history/", "allow"), ("/spam-farm-report/", "allow"),
]
TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def regex(pattern: str) -> str:
    """The pattern as a regular expression on a lower-cased URL."""
    return ".*".join(re.sub(r"([^a-z0-9/=\-_])", r"[\1]", part) for part in pattern.translate(str.maketrans(UPPER, LOWER)).split("*"))


def _tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL has whole: bounded by other characters on both sides."""
    low = pattern.translate(str.maketrans(UPPER, LOWER))
    return sorted({m.group() for m in re.finditer(TOKEN, low)
                   if m.start() > 0 and m.end() < len(low) and low[m.start() - 1] != "*" and low[m.end()] != "*"})


def parts(url):
    """Host and path columns: empty without ``://``; the host's A-Z are lower-cased."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, "://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1)


def judged_by_patterns(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, blocked) of the distinct URLs that some rule matches; an allow rule beats block."""
    spark = urls.sparkSession
    asked = urls.select("url", F.translate("url", UPPER, LOWER).alias("low"))
    words = asked.select("url", "low", F.explode(F.array_distinct(F.concat(
        F.regexp_extract_all("low", F.lit(f"({TOKEN})")), F.array(F.lit(""))))).alias("token"))
    rows = [(i, regex(p), v == "block", _tokens(p)) for i, (p, v) in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_id int, re string, block boolean, tokens array<string>")
    own = table.select("rule_id", F.explode("tokens").alias("token"))
    seen = words.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "token")).alias("t"))
    # a rule without a whole token is filed under the empty one, which every URL has
    filed = table.join(rarest, "rule_id", "left").select("re", "block", F.coalesce("t.token", F.lit("")).alias("token"))
    hits = words.join(filed, "token").filter(F.expr("low RLIKE re"))
    return hits.groupBy("url").agg(F.min("block").alias("blocked"))


def judged_by_hosts(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(url, rule, rule_verdict) of the distinct URLs that a host rule fits, the longest one."""
    host, path = parts(F.col("url"))
    table = urls.sparkSession.createDataFrame(
        [(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules], "suffix string, start string, rule_verdict string")
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (urls.select("url", host.alias("host"), path.alias("path")).filter("host <> ''")
             .select("url", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix")
             .filter(F.expr("startswith(path, start)")))
    rule = F.concat("suffix", "start")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("suffix").alias("h"), rule.alias("rule"), "rule_verdict"))
    return found.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.rule_verdict")


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of ``pages``.

    A host rule fits its host and all subdomains if the path starts with the rule's path;
    the longest wins and decides. Else patterns decide: block where a block rule and no
    allow rule matches, otherwise allow.

    A null URL, or one without ``://``, has an empty host and path, no rule, and the
    patterns' verdict. Equal URLs are judged once; null ids and repeated rows keep their
    rows; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.filter("url IS NOT NULL").select("url").distinct()
    found = judged_by_hosts(urls, host_rules).join(judged_by_patterns(urls, pattern_rules), "url", "full")
    host, path = parts(F.col("url"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return rows.join(found, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "rule", verdict.alias("verdict"))
