"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any matching URL
must contain. Rules are filed under the one of their tokens that the fewest
URLs contain; the tokens of a URL fetch its candidate rules, and only those
run. DataFrame functions only. A few rules are part of the plan, without a
shuffle of the pages; many are a table that is joined on the token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, unused

TOKEN = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched against host and path, joined; `tokens` are runs of
    a-z and 0-9 that stand in every match as whole tokens. Of the rules that fit, explicit
    ones go first, then the longest name, then the name itself."""

    name: str
    verdict: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]
    explicit: bool = False


def host_rule(verdict: str, rule: str) -> Rule:
    """Rule of a host, all its subdomains and a path prefix, like example.net/en/."""
    host, slash, path = rule.partition("/")
    # Tokens of the host are whole; the last one of the path may go on in the URL.
    tokens = [t for t in re.split(TOKEN, host.lower()) if t]
    path_tokens = [t for t in re.split(TOKEN, path.lower()) if t]
    if path_tokens and re.search(r"[a-z0-9]$", path.lower()):
        path_tokens.pop()
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys(tokens + path_tokens)), True)


#: Rules of the contract, by host and path prefix.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))

#: Junk hosts and paths that are blocked where no host rule fits.
PATTERN_RULES = tuple(
    Rule(f"pattern:{word}", "block", rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", (word,))
    for word in ("casino", "poker", "porn", "xxx", "viagra", "doubleclick", "adserver", "banner", "popunder", "torrent", "warez")
) + (
    Rule("pattern:free-download", "block", r"(?i)(?:^|[^a-z0-9])free[-_.]download(?:[^a-z0-9]|$)", ("free", "download")),
    Rule("pattern:wp-login", "block", r"(?i)/wp-login\.php(?:[^a-z0-9]|$)", ("wp", "login", "php")),
)
RULES = HOST_RULES + PATTERN_RULES


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(target), TOKEN), lambda t: t != ""))


def rarest_tokens(urls: DataFrame, target: Column, rules: tuple[Rule, ...]) -> dict[str, str]:
    """Rule name to the token that the fewest of all URLs contain; ties: the longer, then the first."""
    wanted = sorted({t for r in rules for t in r.tokens})
    kept = F.array_intersect(url_tokens(target), F.lit(wanted))
    counted = urls.select(F.explode(kept).alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.collect()}  # at most one row for each rule token
    return {r.name: min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) for r in rules if r.tokens}


def _candidates(target: Column, rules: tuple[Rule, ...], filed: dict[str, str]) -> Column:
    """Array of the rules that the tokens of a URL fetch.

    The index is a constant array of buckets by token hash, so a token is
    looked up at once. Rules without tokens are candidates of every URL.
    """
    from pyspark.sql import SparkSession

    def row(rule: Rule) -> Column:
        rank = len(rule.name) + (1_000_000 if rule.explicit else 0)
        return F.struct(F.lit(filed.get(rule.name, "")).alias("token"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.explicit).alias("explicit"), F.lit(rule.pattern).alias("pattern"))

    kind = "array<struct<token:string,rank:int,name:string,verdict:string,explicit:boolean,pattern:string>>"
    n = max(16, 1 << len(rules).bit_length())
    spark = SparkSession.active()
    tokens = sorted(set(filed.values()))
    places = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(n)).alias("p")).collect() if tokens else []
    bucket_of = {r.t: r.p for r in places}
    buckets = [[] for _ in range(n)]
    for rule in rules:
        if rule.name in filed:
            buckets[bucket_of[filed[rule.name]]].append(row(rule))
    index = F.array(*[F.array(*b).cast(kind) for b in buckets])
    fetched = F.flatten(F.transform(url_tokens(target), lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda r: r["token"] == t)))
    always = F.array(*[row(r) for r in rules if r.name not in filed]).cast(kind)
    return F.concat(fetched, always)


def _rule_row(rule: Rule) -> tuple:
    return rule.name, len(rule.name) + (1_000_000 if rule.explicit else 0), rule.verdict, rule.explicit, rule.pattern, list(rule.tokens)


def rule_table(urls: DataFrame, target: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules that have tokens, each under the token that the fewest of all URLs contain; ties as in rarest_tokens."""
    spark = urls.sparkSession
    listed = spark.createDataFrame([_rule_row(r) for r in rules if r.tokens], "name string, rank int, verdict string, explicit boolean, pattern string, tokens array<string>")
    each = listed.withColumn("token", F.explode("tokens")).drop("tokens")
    counted = urls.select(F.explode(url_tokens(target)).alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    row = F.struct(F.coalesce("seen", F.lit(0)), -F.length("token"), "token")
    filed = each.join(counted, "token", "left").groupBy("name", "rank", "verdict", "explicit", "pattern").agg(F.min(row).alias("at"))
    return filed.select(F.col("at.token").alias("token"), "rank", "name", "verdict", "explicit", "pattern")


def _best_by_join(pages: DataFrame, target: Column, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    """(target, best): the rule of every distinct target that one with a token fits."""
    filed = scratch.keep(rule_table(pages, target, rules))
    asked = pages.select(target.alias("target")).distinct().select("target", F.explode(url_tokens(F.col("target"))).alias("token"))
    fits = asked.join(filed, "token").filter(F.regexp_like("target", F.col("pattern")))
    return fits.groupBy("target").agg(F.max(F.struct("rank", "name", "verdict", "explicit")).alias("best"))


def judge_urls(pages: DataFrame, *, url: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = "allow", in_plan: int = 1000, into: str = "judged") -> DataFrame:
    """Adds the struct column `into`: host, path, rule, matched, verdict.

    rule is the longest explicit (host) rule that fits, else null; matched is
    the name of the rule that gave the verdict, of whatever kind; where none
    fits the verdict is `otherwise`. Null URLs and URLs without :// have an
    empty host and path. Repeated rows are judged alike; an empty table stays
    empty; URLs are whole, of any length. More than `in_plan` rules go as a
    table, with the same result. A column named `into` is replaced, all others
    stay as they are.
    """
    host, path, best, other = unused(pages, "__host", "__path", "__best", "__target")
    parts = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    both = F.concat(F.col(host), F.col(path))
    target = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    few = len(rules) <= in_plan
    inside = rules if few else tuple(r for r in rules if not r.tokens)
    fits = F.filter(_candidates(both, inside, rarest_tokens(pages, target, inside) if few else {}), lambda r: F.regexp_like(both, r["pattern"]))
    top = F.array_max(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["explicit"].alias("explicit"))))
    if few:
        parts = parts.withColumn(best, top)
    else:
        found = _best_by_join(pages, target, rules, Scratch(pages.sparkSession)).withColumnsRenamed({"target": other, "best": best})
        parts = parts.join(found, both == F.col(other), "left").withColumn(best, F.greatest(F.col(best), top)).drop(other)
    result = F.struct(
        F.col(host).alias("host"), F.col(path).alias("path"),
        F.when(F.col(f"{best}.explicit"), F.col(f"{best}.name")).alias("rule"),
        F.col(f"{best}.name").alias("matched"),
        F.coalesce(f"{best}.verdict", F.lit(otherwise)).alias("verdict"))
    return parts.withColumn(into, result).drop(host, path, best)
