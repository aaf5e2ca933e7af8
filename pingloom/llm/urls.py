"""URL filter by pattern rules indexed on their rarest literal token.

A rule is a host with a path prefix, or a regular expression over the whole url. Its literal tokens (runs of letters and digits) are
known; one counting pass over the urls tells how rare each is, and the rule is filed under the rarest. The tokens of a url fetch the
rules filed under them, and only those rules are tried. Everything is a column expression: one pass over the urls, no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path, fits no rule and is allowed; rows repeat as
they came; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    """Fits the host and its subdomains if the path starts with ``path``; of several the longest wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"(?s)^(?>.*?://)(?:[^/?#]*\.)?(?i:{re.escape(self.host)}){re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        # the last token of a path may go on in the url unless a mark follows it
        path = re.sub(r"[A-Za-z0-9]+$", "", self.path)
        return re.findall(TOKEN, (self.host + path).lower())


@dataclass(frozen=True)
class PatternRule:
    """Fits a url in which ``regex`` is found; ``literals`` are whole tokens of every url that fits."""

    regex: str
    literals: tuple[str, ...]
    verdict: str = "block"

    @property
    def name(self) -> str:
        return f"~{self.regex}"

    @property
    def tokens(self) -> list[str]:
        return [t for t in self.literals if re.fullmatch(TOKEN, t)]


# The host rules of the task, then patterns of urls that carry sessions, carts and trackers rather than pages.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
PATTERN_RULES = (
    PatternRule(r"[?&]utm_source=feed(?:[&#]|$)", ("utm", "source", "feed")),
    PatternRule(r"[?&](?:sid|sessionid|phpsessid)=[0-9A-Za-z]{8,}", ()),
    PatternRule(r"/cart/(?:add|remove)[/?]", ("cart",)),
    PatternRule(r"/wp-login\.php", ("wp", "login")),  # php may go on, as in php5
    PatternRule(r"[?&]replytocom=[0-9]+", ("replytocom",)),
)


def host_of(url: Column) -> Column:
    # java: [^/?#] may be any other character, line ends included; only A-Z are lower-cased
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1)))


def constant(value: object, kind: str) -> Column:
    """A constant of any size as one literal, which Spark parses once, when it optimises the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def token_counts(urls: DataFrame, url: str, rules: list) -> dict[str, int]:
    """In how many urls each token of the rules occurs; the result has at most one row a token of the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    listed = urls.sparkSession.range(1).select(F.explode(constant(wanted, "array<string>")).alias("w"))
    seen = urls.select(F.explode(tokens_of(F.col(f"`{url}`"))).alias("t")).join(listed, F.col("t") == F.col("w")).groupBy("t").agg(F.count("*").alias("n"))
    return dict.fromkeys(wanted, 0) | {r["t"]: r["n"] for r in seen.collect()}


def index_rules(rules: list, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rule numbers by rarest token, numbers of the rules that have none and are tried on every url)."""
    filed: dict[str, list[int]] = {}
    rest: list[int] = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            rest.append(k)
    return filed, rest


def judge(urls: DataFrame, url: str = "url", hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), host, path, rule, pattern and verdict of each url.

    The longest fitting host rule decides; else any fitting pattern (the first listed is named); else the url is allowed.
    """
    kept = urls.columns if keep is None else keep
    rules = [*hosts, *patterns]
    filed, rest = index_rules(rules, token_counts(urls, url, rules))
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    # a hash table: the map of a token's hash holds one or two tokens, so a look-up doesn't depend on the number of rules
    size = max(1, len(filed))
    table: list[dict[str, list[int]]] = [{} for _ in range(size)]
    for token, ids in filed.items():
        table[zlib.crc32(token.encode()) % size][token] = ids
    index = constant(table, "array<map<string,array<int>>>")
    entry = lambda t: F.try_element_at(F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), t)
    fetched = F.flatten(F.filter(F.transform(tokens_of(F.col(f"`{url}`")), entry), lambda ids: ids.isNotNull()))
    fetched = F.concat(fetched, constant(rest, "array<int>")) if rest else fetched
    regexes = constant([r.regex for r in rules], "array<string>")
    fits = F.filter(fetched, lambda k: F.regexp(u, F.get(regexes, k)))
    # the best: longest host rule, then patterns in their order
    rank = [len(r.name) + len(patterns) if isinstance(r, HostRule) else len(rules) - k - len(hosts) for k, r in enumerate(rules)]
    ranks = constant(rank, "array<int>")
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.get(ranks, k).alias("r"), k.alias("k"))))["k"]
    names, verdicts = constant([r.name for r in rules], "array<string>"), constant([r.verdict for r in rules], "array<string>")
    decided = urls.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], host_of(F.col(f"`{url}`")).alias("h"), path_of(F.col(f"`{url}`")).alias("p"), best.alias("b"))
    by_host = F.col("b") < len(hosts)
    return decided.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        F.col("h").alias("host"),
        F.col("p").alias("path"),
        F.when(by_host, F.get(names, F.col("b"))).alias("rule"),
        F.when(~by_host, F.get(names, F.col("b"))).alias("pattern"),
        F.coalesce(F.get(verdicts, F.col("b")), F.lit("allow")).alias("verdict"),
    )


def report(pages: DataFrame) -> DataFrame:
    return judge(pages, "url", keep=["page_id"])
