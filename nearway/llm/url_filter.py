"""URL filters: a sort-merge range join of urls with nested (host, path) rules.

A host's labels are reversed ("www.example.com" -> "com.example.www."), so a rule that covers a host and all its
subdomains is one interval of keys: those that begin with its own key. Urls and rules are sorted by key and swept
together, with a stack of the rules whose interval is open; intervals are nested or apart, so the stack is a chain.

Rules of a size that is checked go to every task, which sorts its own urls: no url is shuffled and no host can be hot.
More rules than that are range-joined: each goes to every key range that its interval meets, and urls go to their
range, salted by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are sent to every task; beyond it they are shuffled by key range.
MAX_LOCAL_RULES = 100_000
RULE_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def host_and_path(url):
    """Columns host and path of a url column: null and urls without :// have both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """One pass over keys in ascending order with the stack of open rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        by_key: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            paths = by_key.setdefault(key_of(host), {})
            # of equal rules that disagree, block counts
            if path not in paths or verdict == "block":
                paths[path] = (host + path, verdict)
        self.keys = sorted(by_key)
        self.paths = [list(by_key[k].items()) for k in self.keys]
        self.hosts = [len(k) for k in self.keys]
        self.at, self.stack = 0, []

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule's string and verdict; keys must not fall from call to call."""
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            opened = self.keys[self.at]
            while self.stack and not opened.startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
            self.stack.append(self.at)
            self.at += 1
        while self.stack and not key.startswith(self.keys[self.stack[-1]]):
            self.stack.pop()
        best, size = None, -1
        for i in reversed(self.stack):
            for rule_path, found in self.paths[i]:
                if path.startswith(rule_path) and self.hosts[i] + len(rule_path) > size:
                    best, size = found, self.hosts[i] + len(rule_path)
        return best


def _sweep(hosts: list[str], paths: list[str], rules) -> list[tuple[str, str] | None]:
    keys = [key_of(h) for h in hosts]
    sweep, out = Sweep(rules), [None] * len(keys)
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        out[i] = sweep.judge(keys[i], paths[i])
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_local_rules: int = MAX_LOCAL_RULES, ranges: int = 256) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict (the longest fitting rule's, else default) of every row.

    Null urls, and those without "://", have an empty host and path, which only a rule with an empty host fits.
    Repeated rows are judged each; an empty table gives an empty result; other columns play no part, whatever their
    names. The longest rule has the most characters of host and path; of equally long ones the longer host wins.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").dropna()
        head = rules.limit(max_local_rules + 1).collect()  # bounded: one more than the limit at most
        if len(head) > max_local_rules:
            return _range_join(urls, rules, default, ranges)
        rules = [tuple(r) for r in head]
    elif len(rules) > max_local_rules:
        return _range_join(urls, spark.createDataFrame(rules, RULE_SCHEMA), default, ranges)
    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _sweep(b.column(1).to_pylist(), b.column(2).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())], schema.names)

    return urls.mapInArrow(judge, schema)


def _range_join(urls: DataFrame, rules: DataFrame, default: str, ranges: int) -> DataFrame:
    """For rules that are too many for one task: ranges of keys, each with the rules whose interval meets it."""
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    rules, urls = rules.withColumn("key", key), urls.withColumn("key", key)
    # at most `ranges` cuts, from a bounded sample of rule keys; they only balance the ranges
    sample = [r[0] for r in rules.select("key").orderBy(F.xxhash64("key"), "key").limit(ranges * 16).distinct().orderBy("key").collect()]
    cuts = sample[:: max(1, len(sample) // ranges)][1:]
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<string>)")
    place = lambda c: F.size(F.filter(bound, lambda x: x <= c))
    salts, schema = 16, urls.drop("key").schema
    spread = rules.select("host", "path", "verdict", F.explode(F.sequence(place(F.col("key")), place(F.concat("key", F.lit("\U0010ffff"))))).alias("r"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = urls.select("*", place(F.col("key")).alias("r"), F.pmod(F.xxhash64(*schema.names), F.lit(salts)).cast("int").alias("salt")).drop("key")
    out = T.StructType([*schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        own = list(zip(*(right.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True))
        found = _sweep(left.column("host").to_pylist(), left.column("path").to_pylist(), own)
        made = left.select(schema.names)
        return made.append_column("rule", pa.array([f and f[0] for f in found], pa.string())).append_column("verdict", pa.array([f[1] if f else default for f in found], pa.string()))

    return dealt.groupBy("r", "salt").cogroup(spread.groupBy("r", "salt")).applyInArrow(judge, out)
