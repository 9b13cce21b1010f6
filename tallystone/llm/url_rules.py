"""URL filter rules by a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot
(``www.example.com`` -> ``com.example.www.``). A rule's host is then a prefix of
the keys of all its subdomains, that is, an interval of the sorted keys. URLs and
rules are dealt to key ranges (boundaries from a bounded sample of URL keys); a
rule goes to every range that its interval meets, which beyond its own range is
only the chain of suffixes of the range's first host. Each range is sorted and
swept once: a stack holds the nested rules whose interval is open, and the
longest rule whose path is a prefix of the URL's path wins.

The range key ends with a hash of the row, so that one host, or one URL, with a
third of all rows is divided like anything else. Equal rules: block wins over
allow. Rules of the same length: the longer host wins, then block.

URLs are parsed once; the table of their keys is written, counted, sampled and
swept. A host's rules are kept with the lengths of their paths, so a URL asks once
for each length, longest first.

Null URL or one without ``://``: host and path empty. Rules never fit an empty
host; rules with a null part are ignored. Null key: returned as it is. Very long
URLs are compared whole. Repeated rows each get a verdict. Without rules every URL
gets the default verdict; an empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SAMPLE_A_RANGE = 40
TOP = "\U0010ffff"


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    """id, host, path, rev of every row."""
    has = F.coalesce(F.contains(F.col(url), F.lit("://")), F.lit(False))
    rest = F.split(F.col(url), "://", 2)[1]
    host = F.when(has, F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    path = F.when(has, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("rev", F.concat(F.array_join(F.reverse(F.split("host", "\\.")), "."), F.lit(".")))


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """The merge of one range: rules and URLs arrive in key order."""

    def __init__(self, default: str):
        #: Of each open host: key, host, its rules by path, and the lengths of those, longest first.
        self.default, self.stack = default, []

    def rule(self, rev: str, host: str, path: str, verdict: str) -> None:
        self.close(rev)
        if not self.stack or self.stack[-1][0] != rev:
            self.stack.append((rev, host, {}, []))
        _, _, paths, lengths = self.stack[-1]
        if path not in paths:
            at = bisect_left(lengths, -len(path))
            if at == len(lengths) or lengths[at] != -len(path):
                lengths.insert(at, -len(path))
            paths[path] = verdict
        elif paths[path] != "block":
            paths[path] = verdict

    def close(self, rev: str) -> None:
        while self.stack and not rev.startswith(self.stack[-1][0]):
            self.stack.pop()

    def url(self, rev: str, path: str) -> tuple[str | None, str]:
        self.close(rev)
        best = None
        for _, host, paths, lengths in reversed(self.stack):
            for n in lengths[bisect_left(lengths, -len(path)) :]:
                if best and (len(host) - n, len(host)) <= best[0]:
                    break
                verdict = paths.get(path[: -n])
                if verdict:
                    best = (len(host) - n, len(host)), host + path[: -n], verdict
                    break
        return best[1:] if best else (None, self.default)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``key``, host, path, rule, verdict of every row; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = parsed(pages, key, url).withColumn("salt", F.hex(F.xxhash64("id", "path")))
    urls = urls.withColumn("at", F.concat("rev", F.lit("\x01"), "salt"))
    urls = settle(urls)
    share = min(1.0, SAMPLE_A_RANGE * ranges / max(1, urls.count()))
    sample = sorted(r[0] for r in urls.sample(share, seed=7).select("at").limit(3 * SAMPLE_A_RANGE * ranges).collect())
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def deal_urls(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            yield b.assign(part=[bisect_right(cuts, at) for at in b["at"]], kind=1, verdict=None)[["part", "at", "kind", "id", "host", "path", "rev", "verdict"]]

    def deal_rules(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            out = []
            for host, path, verdict in zip(b["host"], b["path"], b["verdict"], strict=True):
                if not host or path is None or verdict is None:
                    continue
                rev = reversed_host(host)
                for part in range(bisect_left(cuts, rev), bisect_right(cuts, rev + TOP) + 1):
                    out.append((part, rev, 0, None, host, path, rev, verdict))
            yield pd.DataFrame(out, columns=["part", "at", "kind", "id", "host", "path", "rev", "verdict"])

    kind = dict(pages.dtypes)[key]
    schema = f"part long, at string, kind long, id {kind}, host string, path string, rev string, verdict string"

    def sweep(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        part, now = None, Sweep(default)
        for b in batches:
            out = []
            ids = b["id"]
            for i, (p, k, host, path, rev, verdict) in enumerate(zip(b["part"], b["kind"], b["host"], b["path"], b["rev"], b["verdict"], strict=True)):
                if p != part:
                    part, now = p, Sweep(default)
                if k:
                    out.append((i, host, path, *now.url(rev, path)))
                else:
                    now.rule(rev, host, path, verdict)
            done = pd.DataFrame(out, columns=["i", "host", "path", "rule", "verdict"])
            done.insert(0, key, ids.iloc[done["i"]].to_numpy())
            yield done.drop(columns="i")

    both = urls.mapInPandas(deal_urls, schema).unionByName(rules.select("host", "path", "verdict").mapInPandas(deal_rules, schema))
    dealt = both.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "at", "kind", F.length("path"), "verdict")
    return dealt.mapInPandas(sweep, f"{key} {kind}, host string, path string, rule string, verdict string")
