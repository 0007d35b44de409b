"""Url rules by a sort-merge range join.

A host read from its last label to its first turns "this host and all its
subdomains" into an interval of keys. Urls are range-partitioned by that key
(and by path and a hash, so that one hot host or url is cut too); a rule goes
to every range its interval overlaps. Each range is then one sorted sweep that
keeps the rules open at the current key on a stack.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import NO_ID, lower_ascii

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: Keys that choose the range limits; a bound, limits only balance work.
CUT_SAMPLE = 20_000
ROWS_PER_RANGE = 500_000
_URL, _RULE = 1, 0


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    """Labels from last to first, each followed by the smallest character: a host's key starts its subdomains' keys."""
    return "".join(label + "\x00" for label in reversed(host.split("."))) if host else ""


def _host_keys(hosts: pd.Series) -> pd.Series:
    return hosts.map(host_key)


def rule_ranges(key: str, cuts: Sequence[tuple]) -> range:
    """The ranges that hold keys starting with ``key``."""
    low = bisect.bisect_right(cuts, (key,))
    high = bisect.bisect_left(cuts, (key[:-1] + "\x01",)) if key else len(cuts)
    return range(low, high + 1)


class OpenRules:
    """The stack of hosts whose rules are open at the current key."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        self.stack[-1][1].setdefault(path, (host, verdict))

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest open rule whose path starts ``path``."""
        self.move(key)
        found = None
        for _, paths in self.stack:
            for n in sorted({len(p) for p in paths if len(p) <= len(path)}, reverse=True):
                if path[:n] in paths:
                    host, verdict = paths[path[:n]]
                    if found is None or len(host) + n >= found[0]:
                        found = (len(host) + n, host + path[:n], verdict)
                    break
        return found and found[1:]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT) -> DataFrame:
    """``pages(page_id, url)`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's path. The rule with the longest text (host and path) wins, of equal
    ones the longer host; of rules with the same host and path the first by
    verdict. A url that no rule fits has a null rule and the verdict
    ``default``.

    A url that is null or has no ``://`` has an empty host and path. Rows with
    null or repeated page_ids keep a row each. Other columns are not read. An
    empty table or no rules are fine.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    key_of = F.pandas_udf(_host_keys, "string")
    urls = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    urls = urls.withColumns({"key": key_of("host"), "salt": F.xxhash64("page_id", "host", "path")})
    rules = rules.select("verdict", "host", "path").withColumn("key", key_of("host"))
    n = urls.count()
    ranges = max(1, min(1_000, -(-n // ROWS_PER_RANGE)), min(24, n // 1_000))
    some = F.pmod(F.xxhash64("salt"), F.lit(max(1, n // CUT_SAMPLE))) == 0  # so that tasks send few rows
    sample = urls.filter(some).select("key", "path", "salt").limit(2 * CUT_SAMPLE).collect()
    ordered = sorted((r["key"], r["path"], r["salt"]) for r in sample)
    cuts = sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)}) if ordered else []

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, paths: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, row) for row in zip(keys, paths, salts)], dtype="int32")

    spread = F.udf(lambda key: list(rule_ranges(key, cuts)), "array<int>")
    both = urls.withColumns({"range": range_of("key", "path", "salt"), "kind": F.lit(_URL), "verdict": F.lit(None).cast("string")})
    opened = rules.select(
        F.lit(NO_ID).alias("page_id"), "host", "path", "key", F.lit(0).cast("long").alias("salt"),
        F.explode(spread("key")).alias("range"), F.lit(_RULE).alias("kind"), "verdict")
    both = both.unionByName(opened)

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rules_open = None, OpenRules()
        for frame in frames:
            out = []
            for part, kind, page, host, path, key, verdict in zip(
                    frame["range"], frame["kind"], frame["page_id"], frame["host"], frame["path"], frame["key"], frame["verdict"]):
                if part != at:
                    at, rules_open = part, OpenRules()
                if kind == _RULE:
                    rules_open.open(key, host, path, verdict)
                else:
                    rule, said = rules_open.best(key, path) or (None, default)
                    out.append((page, host, path, rule, said))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])

    # The order of keys is that of code points, as in Python.
    dealt = both.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "kind", "path", "verdict")
    judged = dealt.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
    return judged.withColumn("page_id", F.nullif("page_id", F.lit(NO_ID)))
