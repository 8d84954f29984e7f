"""URL filters: host and path rules, then pattern rules found by their rarest literal token.

Method: the literal tokens that any match of a pattern rule contains are read off its
pattern.  The rule is indexed by the one that is rarest among the urls at hand; the tokens
of a url fetch candidate rules by an equality join, and only those rules run their regular
expression.  Rules without such a token are tried on every url.  DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


class PathRule(NamedTuple):
    action: str
    host: str
    path: str


class PatternRule(NamedTuple):
    name: str
    action: str
    pattern: str  #: a regular expression over the lower-cased url


# The host and path rules of the query.
PATH_RULES = (
    PathRule("allow", "org", "/"), PathRule("block", "example.org", "/es/"), PathRule("block", "example.org", "/en/1"), PathRule("allow", "com", "/fr/"), PathRule("block", "com", "/de/"),
)

# The pattern rules of the query.
PATTERN_RULES = (
    PatternRule("spam-farm", "block", r"://([^/?#]*\.)?spam-farm\."),
    PatternRule("cheap-pills", "block", r"://([^/?#]*\.)?cheap-pills\."),
    PatternRule("online-casino", "block", r"[/.-]online-casino[/.-]"),
    PatternRule("free-slots", "block", r"[/.-]free-slots[/.-]"),
    PatternRule("adult-cams", "block", r"[/.-]adult-cams[/.-]"),
    PatternRule("pirate-download", "block", r"[/.-]pirate-download[/.-]"),
    PatternRule("payday-loan", "block", r"[/.-]payday[/.-]loans?"),
    PatternRule("session-id", "block", r"[?&;]sessionid=[0-9a-f]{16,}"),
    PatternRule("print-view", "block", r"[?&]print=1(&|#|$)"),
)
#: Rule sets up to this size are sent to every task; larger ones are joined by a shuffle.
SMALL_RULES = 10_000


def literal_tokens(pattern: str) -> list[str]:
    """Tokens (whole runs of a-z and 0-9) that every match of a pattern contains.

    A run of literals counts if what stands on either side of it in the pattern can't be a
    letter or digit; an optional part must both end and be preceded (or begin and be
    followed) by something that can't.
    """
    import re

    c, token = re._constants, set("abcdefghijklmnopqrstuvwxyz0123456789")

    def flat(items) -> list[tuple]:
        out = []
        for op, arg in items:
            if op is c.SUBPATTERN:
                out += flat(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] == arg[1] == 1:
                out += flat(arg[2])
            else:
                out.append((op, arg))
        return out

    def bars(items: list[tuple], at: int, step: int) -> bool:
        """Whether what stands at a place, seen in a direction, can't be a letter or digit."""
        if not 0 <= at < len(items):
            return False
        op, arg = items[at]
        if op is c.LITERAL:
            return chr(arg) not in token
        if op is c.AT:
            return arg in (c.AT_END, c.AT_END_STRING, c.AT_BEGINNING, c.AT_BEGINNING_STRING)
        if op is c.IN:
            return all(k is c.LITERAL and chr(v) not in token for k, v in arg)
        if op is c.BRANCH:
            return all((x := flat(y)) and bars(x, 0 if step > 0 else len(x) - 1, step) for y in arg[1])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            x = flat(arg[2])
            own = bool(x) and bars(x, 0 if step > 0 else len(x) - 1, step)
            return own and (arg[0] > 0 or bars(items, at + step, step))
        return False

    items = flat(re._parser.parse(pattern))
    out, at = [], 0
    while at < len(items):
        end = at
        while end < len(items) and items[end][0] is c.LITERAL and chr(items[end][1]) in token:
            end += 1
        if end > at and bars(items, at - 1, -1) and bars(items, end, 1):
            out.append("".join(chr(x) for _, x in items[at:end]))
        at = max(end, at + 1)
    return list(dict.fromkeys(out))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lowered; path from there up to ? or #.  Both empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def path_rule(host: Column, path: Column, rules=PATH_RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host or a subdomain of it, and whose path's beginning, fit; null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):  # the last that fits is outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def pattern_verdicts(urls: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """(url, pattern_action) of the distinct urls that some pattern rule matches; block beats allow."""
    spark: SparkSession = urls.sparkSession
    hint = F.broadcast if len(rules) <= SMALL_RULES else lambda x: x
    table = spark.createDataFrame([(i, r.action, r.pattern, literal_tokens(r.pattern)) for i, r in enumerate(rules)], "rule int, action string, pattern string, tokens array<string>")
    literals = table.select("rule", F.explode("tokens").alias("token"))
    distinct = urls.select("url").filter("url is not null").distinct()
    tokens = distinct.select("url", F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    often = tokens.join(hint(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    first = Window.partitionBy("rule").orderBy(F.coalesce("count", F.lit(0)), "token")
    index = literals.join(often, "token", "left").withColumn("n", F.row_number().over(first)).filter("n = 1").select("rule", "token")
    index = index.join(table.drop("tokens"), "rule")
    matched = tokens.join(hint(index), "token").filter(F.rlike(F.lower("url"), F.col("pattern"))).select("url", "action")
    for r in rules:
        if not literal_tokens(r.pattern):
            matched = matched.unionByName(distinct.filter(F.lower("url").rlike(r.pattern)).select("url", F.lit(r.action).alias("action")))
    return matched.groupBy("url").agg(F.max(F.col("action") == "block").alias("_b")).select("url", F.when(F.col("_b"), "block").otherwise("allow").alias("pattern_action"))


def judge_urls(pages: DataFrame, path_rules=PATH_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """For each row of pages (page_id, url): page_id, host, path, rule, verdict.

    The host and path rule decides if one fits, else the pattern rules, else default.  A null
    url has empty host and path and gets default; null ids and repeated rows are kept; extra
    columns are ignored; urls of any length are judged whole; an empty table gives an empty result.
    """
    some = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    some = some.withColumn("host", host).withColumn("path", path)
    rule, action = path_rule(F.col("host"), F.col("path"), path_rules)
    out = some.withColumn("rule", rule).withColumn("_action", action)
    # only urls without a rule of the first kind need the second
    open_urls = out.filter("rule is null and url is not null")
    judged = open_urls.join(pattern_verdicts(open_urls, pattern_rules), "url", "left")
    rest = out.filter("rule is not null or url is null").withColumn("pattern_action", F.lit(None).cast("string"))
    return judged.unionByName(rest).select("page_id", "host", "path", "rule", F.coalesce("_action", "pattern_action", F.lit(default)).alias("verdict"))
