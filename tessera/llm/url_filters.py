"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the common filter-list notation: ``||`` starts at the
host or after one of its dots, ``*`` stands for any characters, ``^`` for a
separator or the end, anything else for itself.  Patterns are held against
``"." + host + path``.

The index is a literal array of buckets in the plan: every rule lies in the
bucket of its rarest complete literal token (rarest by its count over all the
URLs).  A URL's tokens are hashed to buckets, which fetches its candidate rules;
only those run their regular expression.  Everything is a projection: no
shuffle, no Python.  Rules without a whole literal token run on every URL.  Beyond
``MAX_RULES`` rules the index is a table instead, which the tokens of each different
(host, path) are joined with; it gives the same answers.

Edge cases: a null URL or one without ``://`` has an empty host and path; no
anchored rule fits it.  Repeated rows are judged one by one, an empty table
gives no rows, and columns other than the key and the URL are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules that one plan may hold as literals.
MAX_RULES = 2_000
BUCKETS = 64
_SEPARATOR = r"(?:[^0-9A-Za-z_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    """``listed`` rules carry a name to report and beat the others; of several
    the longest name wins.  Of unlisted rules that fit, a block wins."""

    pattern: str
    verdict: str
    listed: str | None = None

    @classmethod
    def host_path(cls, host: str, path: str, verdict: str) -> Rule:
        return cls(f"||{host}{path}", verdict, host + path)

    def regex(self) -> str:
        body, start = (self.pattern[2:], r"^[^/]*\.") if self.pattern.startswith("||") else (self.pattern, "")
        parts = {"*": ".*", "^": _SEPARATOR}
        return start + "".join(parts.get(c, c if c.isalnum() else re.sub(r"(.)", r"\\\1", c)) for c in body)

    def tokens(self) -> list[str]:
        """Alphanumeric runs that any URL the rule fits must hold as whole tokens."""
        body = self.pattern.removeprefix("||")
        found = []
        for m in re.finditer(r"[0-9A-Za-z]+", body):
            before = body[m.start() - 1] if m.start() else ("." if self.pattern.startswith("||") else "*")
            after = body[m.end()] if m.end() < len(body) else "*"
            if before != "*" and after != "*":
                found.append(m[0].lower())
        return found


#: The rules that production uses besides a caller's own: advertising and adult paths.
DEFAULT_RULES = tuple(Rule(f"/{word}/", "block") for word in ("ads", "adserver", "banner", "casino", "porn", "xxx", "viagra"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(F.concat_ws(" ", host, path)), "[^0-9a-z]+"), lambda t: t != ""))


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def token_counts(tokens: DataFrame, wanted: list[str]) -> dict[str, int]:
    """URLs per token, over all rows, for the tokens of rules alone (so the
    result is bounded by the rule list)."""
    rows = (
        tokens.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    return {r["token"]: r["count"] for r in rows}


def _fields(rule: Rule, token: str) -> tuple[str, str, str, str | None, int]:
    return token, rule.regex(), rule.verdict, rule.listed, len(rule.listed) if rule.listed is not None else -1


def _literal(rule: Rule, token: str) -> Column:
    return F.struct(*(F.lit(x).alias(n) for x, n in zip(_fields(rule, token), ("token", "regex", "verdict", "listed", "rank"), strict=True)))


def _judge_by_table(parts: DataFrame, index: dict[str, list[Rule]], always: list[Rule], key: str) -> DataFrame:
    """The same with the index as a table.  Each different (host, path) is judged once."""
    rows = [_fields(r, token) for token, own in index.items() for r in own] + [_fields(r, "") for r in always]
    table = parts.sparkSession.createDataFrame(rows, "token string, regex string, verdict string, listed string, rank int")
    once = parts.select("host", "path").distinct()
    asked = once.select("host", "path", F.explode(F.concat(_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))).alias("token"))  # "" is every URL's
    met = asked.join(table, "token")
    fits = F.regexp_like(F.concat(F.lit("."), F.col("host"), F.col("path")), F.col("regex"))
    rule = F.struct("rank", (F.col("verdict") == "block").alias("block"), "listed", "verdict")
    judged = met.groupBy("host", "path").agg(F.max(F.when(fits, rule)).alias("best"), F.count(F.lit(1)).alias("n"))
    verdict, n = F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates")
    return parts.join(judged, ["host", "path"], "left").select(F.col(f"`{key}`"), "host", "path", F.col("best.listed").alias("rule"), verdict, n)


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, n_candidates) for every row of ``pages``.

    ``rule`` is the listed name of the rule that decided, else null; the
    verdict is that rule's, else block where an unlisted rule fits, else allow."""
    literal = {r: t for r in rules if (t := r.tokens())}
    always = sorted((r for r in rules if r not in literal), key=lambda r: r.pattern)
    parts = pages.select(F.col(f"`{key}`"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    tokens = parts.select(_tokens(F.col("host"), F.col("path")).alias("tokens"))
    seen = token_counts(tokens, sorted({t for ts in literal.values() for t in ts})) if literal else {}
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule, ts in literal.items():
        index[min(ts, key=lambda t: (seen.get(t, 0), t))].append(rule)
    if len(rules) > MAX_RULES:
        return _judge_by_table(parts, index, always, key)

    # token -> array of its rules, chosen by hash: one array access for each URL token
    kinds = "array<struct<token:string,regex:string,verdict:string,listed:string,rank:int>>"
    slots: list[list[Column]] = [[] for _ in range(BUCKETS)]
    for token, own in sorted(index.items()):
        for r in sorted(own, key=lambda r: r.pattern):
            slots[_bucket(token)].append(_literal(r, token))
    table = F.array(*(F.array(*s).cast(kinds) if s else F.array().cast(kinds) for s in slots))

    def candidates(t: Column) -> Column:
        return F.filter(F.element_at(table, (F.crc32(t.cast("binary")) % BUCKETS + 1).cast("int")), lambda r: r["token"] == t)

    fetched = F.flatten(F.transform(_tokens(F.col("host"), F.col("path")), candidates))
    if always:
        fetched = F.concat(fetched, F.array(*(_literal(r, "") for r in always)).cast(kinds))
    subject = F.concat(F.lit("."), F.col("host"), F.col("path"))
    fits = F.filter(F.col("candidates"), lambda r: F.regexp_like(subject, r["regex"]))
    order = F.transform(F.col("fits"), lambda r: F.struct(r["rank"].alias("rank"), (r["verdict"] == "block").alias("block"), r["listed"].alias("listed"), r["verdict"].alias("verdict")))
    return (
        parts.withColumn("candidates", fetched)
        .withColumn("fits", fits)
        .withColumn("best", F.array_max(order))
        .select(
            F.col(f"`{key}`"), "host", "path",
            F.col("best.listed").alias("rule"),
            F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
            F.size("candidates").cast("long").alias("n_candidates"),
        )
    )
