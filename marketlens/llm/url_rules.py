"""Allow and block rules on hosts and paths, by a sorted sweep over reversed hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rules that one sweep holds; more rules take so many more sweeps.
RULE_BYTES = 32 << 20
#: Verdict for urls that no rule fits.
DEFAULT = "allow"
#: Parts the labels of a reversed host; sorts before every character of a host.
MARK = "\x01"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.`` with a mark for each dot: all subdomains of a
    host are the keys that start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK))


class Sweep:
    """Merges keys in ascending order with sorted rule intervals, a stack holding the open ones."""

    def __init__(self, rules: list[tuple[str, list[tuple[str, str, str]]]]):
        self.rules = rules  # (host key, [(path, rule, verdict)]), sorted by key
        self.next, self.open = 0, []

    def at(self, key: str) -> list[list[tuple[str, str, str]]]:
        """Rules of all hosts whose interval holds ``key``, the nearest host last."""
        while self.next < len(self.rules) and self.rules[self.next][0] <= key:
            start, paths = self.rules[self.next]
            while self.open and not start.startswith(self.open[-1][0]):
                self.open.pop()
            self.open.append((start, paths))
            self.next += 1
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()
        return [paths for _, paths in self.open]


def _blocks(rules: DataFrame, most: int) -> list[list]:
    rows = rules.where("host is not null").select(
        "host", F.coalesce("path", F.lit("")).alias("path"), "verdict", reversed_host(lower_ascii(F.col("host"))).alias("key")
    )
    size = rows.agg(F.sum(2 * F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    count = max(1, -(-size // most))
    out = []
    for b in range(count):
        by_key: dict[str, list] = {}
        for r in rows.where(F.pmod(F.xxhash64("host", "path"), F.lit(count)) == b).collect():
            by_key.setdefault(r.key, []).append((r.path, f"{r.host}{r.path}", r.verdict))
        out.append(sorted(by_key.items()))
    return out


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
    default: str = DEFAULT, rule_bytes: int = RULE_BYTES,
) -> DataFrame:
    """Host, path, deciding rule and verdict of every url.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains where the path
    starts with the rule's; the longest ``host + path`` wins, of equals the one with the longer
    host, then block. Reversed hosts make a rule the interval of keys that start with its own, so
    the urls of each partition, sorted by Spark, and the sorted rules are merged once, with a stack
    of nested open intervals. Nothing is shuffled: rules are held in blocks of ``rule_bytes``, one
    sweep each, so a host with a third of all urls stays spread over its partitions.

    Returns ``key, host, path, rule, verdict``. A null url or one without ``://`` has an empty host
    and path, which no rule fits; rule is then null and the verdict ``default``. Equal rows give
    equal rows; other columns are not read.
    """
    context = pages.sparkSession.sparkContext
    split = pages.select(
        F.col(key).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
        F.lit(-1).alias("host_length"),
    ).withColumn("sort_key", reversed_host(F.col("host")))
    for rows in _blocks(rules, rule_bytes):
        held = context.broadcast(rows)

        def sweep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pass_on = Sweep(held.value)
            last, fitting = None, []
            for batch in batches:
                column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                for i, at in enumerate(column["sort_key"]):
                    if at != last:
                        last, fitting = at, pass_on.at(at)
                    old = column["rule"][i]
                    best = (len(old), column["host_length"][i], column["verdict"][i] == "block") if old else (-1, -1, False)
                    for paths in fitting:
                        for path, rule, verdict in paths:
                            rank = (len(rule), len(rule) - len(path), verdict == "block")
                            if rank > best and column["path"][i].startswith(path):
                                best = rank
                                column["rule"][i], column["verdict"][i] = rule, verdict
                                column["host_length"][i] = rank[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column[f.name], f.type) for f in batch.schema], schema=batch.schema
                )

        split = split.sortWithinPartitions("sort_key").mapInArrow(sweep, split.schema)
    return split.select(
        F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
