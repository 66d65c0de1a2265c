"""URL filtering: rules indexed by their rarest literal token.

Every rule is indexed under the one of its literal tokens that occurs in the fewest URLs of
the table, once for each way to spell it; a URL's tokens fetch candidate rules, and only
candidates run a regular expression. The rule set is an input of bounded size (MAX_RULES) that every task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More rules than this are refused: at about 1 kB a rule the index stays within 200 MB a task.
MAX_RULES = 200_000
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A decision for URLs: by host and path prefix, or by a pattern.

    ``name`` is host/path for path rules and a label for patterns. A pattern is searched in the
    lower-cased ``host/path`` (query and fragment excluded); ``literals`` are whole tokens
    (letters and digits) without which the pattern cannot match, unless the URL has all tokens of
    one of its other ``spellings``.
    """

    name: str
    verdict: str
    pattern: str = ""
    literals: tuple[str, ...] = ()
    spellings: tuple[tuple[str, ...], ...] = ()

    @property
    def is_path(self) -> bool:
        return not self.pattern

    def expression(self) -> str:
        if self.pattern:
            return self.pattern
        host, _, path = self.name.partition("/")
        return rf"\A(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"

    def tokens(self) -> tuple[str, ...]:
        """Tokens that any URL which the rule fits holds whole: not the path's last, which may go on."""
        if self.pattern:
            return self.literals
        host, _, path = self.name.partition("/")
        return tuple(_TOKEN.findall(host.lower() + "/" + re.sub("[A-Za-z0-9]+$", "", path).lower()))

    def alternatives(self) -> tuple[tuple[str, ...], ...]:
        """Token sets, one of which any URL that the rule fits holds whole."""
        return (self.tokens(), *self.spellings)


def pattern(name: str, tokens: str, verdict: str = "block") -> Rule:
    """A pattern rule for the given hyphenated words, apart or joined, as whole tokens of the host or path."""
    words = tokens.split("-")
    spelt = [tuple("".join(w + s for w, s in zip(words, (*cut, ""), strict=True)).split("-")) for cut in product(("-", ""), repeat=len(words) - 1)]
    return Rule(name, verdict, r"(?:^|[^a-z0-9])" + "[-_.]?".join(words) + r"(?:$|[^a-z0-9])", spelt[0], tuple(spelt[1:]))


#: The contract's host and path rules.
PATH_RULES = (Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block"))
#: Our own patterns for spam, gambling, adult, piracy and tracking hosts and paths.
PATTERN_RULES = tuple(
    pattern(x, x)
    for x in "cheap-pills spam-farm casino poker-online online-poker slots-online betting-tips porn xxx sex-cams adult-videos escorts viagra cialis payday-loans link-farm free-money free-iphone warez torrent-free cracked-software keygen doubleclick adserver adservice click-track malware phishing replica-watches essay-mill get-rich-quick".split()
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows of urls(host, path) each wanted token occurs; at most one row per wanted token comes back."""
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", F.lit("/"), "path")), "[^a-z0-9]+"))
    asked = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string"))  # a few tokens per rule, of which there are at most MAX_RULES
    got = urls.select(F.explode(tokens).alias("t")).join(asked, "t").groupBy("t").count()
    return {r["t"]: r["count"] for r in got.collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[tuple[int, re.Pattern]]]:
    """Rarest token to (position, compiled rule). Rules without a token are under the empty one."""
    out: dict[str, list[tuple[int, re.Pattern]]] = {}
    for k, rule in enumerate(rules):
        rarest = {min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="") for tokens in rule.alternatives()}
        for token in sorted(rarest):
            out.setdefault(token, []).append((k, re.compile(rule.expression(), re.DOTALL)))
    return out


def decide(host: str, path: str, rules: tuple[Rule, ...], by_token: dict) -> tuple[str | None, str, str | None]:
    """Rule name (path rules only), verdict and the pattern that decided, for one URL.

    The longest fitting path rule wins, among equally long ones the first by name; without one,
    a fitting pattern does, the first in rule order; without any, the URL is allowed.
    """
    lowered = f"{host}/{path.lower()}" if not path else host + path.lower()
    exact = f"{host}/" if not path else host + path
    best, found = None, None
    for token in ("", *dict.fromkeys(_TOKEN.findall(lowered))):
        for k, rx in by_token.get(token, ()):
            rule = rules[k]
            if rule.is_path:
                if path and rx.search(exact) and (best is None or (-len(rule.name), rule.name) < (-len(best.name), best.name)):
                    best = rule
            elif (found is None or k < found) and rx.search(lowered):
                found = k
    if best:
        return best.name, best.verdict, None
    return (None, "allow", None) if found is None else (None, rules[found].verdict, rules[found].name)


def judge(pages: DataFrame, path_rules: tuple[Rule, ...] = PATH_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and pattern of each row.

    Null, empty and malformed URLs have an empty host and path and are allowed. Repeated rows
    are judged alike, other columns are left out, an empty table gives no rows. More than
    MAX_RULES rules raise ValueError.
    """
    rules = (*path_rules, *pattern_rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a task")
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    counts = token_counts(urls, sorted({t for r in rules for a in r.alternatives() for t in a}))
    by_token = index(rules, counts)

    @F.pandas_udf("rule string, verdict string, pattern string")
    def decided(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([decide(h, p, rules, by_token) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict", "pattern"])

    out = urls.withColumn("d", decided("host", "path"))
    return out.select(F.col("key").alias(key), "host", "path", "d.rule", "d.verdict", "d.pattern")
