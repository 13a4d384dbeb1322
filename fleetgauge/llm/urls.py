"""URL rules in a sorted digest array: 64-bit xxhash keys in a memory-mapped file, probed by vectorised binary search.

A rule is (host, path, verdict). It fits its host and every subdomain of it, for paths that start with the rule's path; the
longest fitting rule wins, then the one with the longest host. The index file holds the sorted digests of all rule strings, the
offsets and the strings themselves, so that every digest hit is confirmed on the full string. It is written once to the shared
folder and handed to the executors by `addFile`; each maps its local copy. Rule sets over `max_index_bytes` are not sent out:
their probes are joined to the rules instead, with the same result.

A url is probed once for each number of host labels and each path length that some rule has, so a very long host or path costs no more
probes than a short one. The driver holds the rules of an index as Python objects, some ten times `max_index_bytes`.

Null urls and urls without "://" have an empty host and path and fit no rule. Urls that no rule fits get `default`. Repeated urls
get a row each; rules that occur twice count once, and of two verdicts for the same rule "block" stands. An empty table gives an
empty result, an empty rule list leaves all to `default`. Only id and url are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import shared_folder, ship

from .common import per_batch

SEED = 42
HEAD = "<4q"


def canonical(rules: DataFrame) -> DataFrame:
    """(rule, host, path, block), one row per rule string; hosts in lower case."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.col("path"), F.lit(""))
    return (rules.select(host.alias("host"), path.alias("path"), (F.col("verdict") == "block").alias("block"))
            .filter("host != ''")
            .groupBy("host", "path").agg(F.max("block").alias("block"))
            .withColumn("rule", F.concat("host", "path")))


def split_url(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path) by the query contract, in SQL functions."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return (df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), rest.alias("rest"))
            .select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                    F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")))


def write_index(rules: list[tuple[str, str, bool]]) -> bytes:
    """Head, sorted digests, string offsets, block, path lengths, numbers of host labels, strings."""
    keys = [(xxhash.xxh64_intdigest((h + "\0" + p).encode(), SEED), h, p, b) for h, p, b in rules]
    keys.sort()
    strings = [(h + "\0" + p).encode() for _, h, p, _ in keys]
    lengths, labels = sorted({len(p) for _, _, p, _ in keys}), sorted({h.count(".") + 1 for _, h, _, _ in keys})
    offsets = np.cumsum([0, *map(len, strings)], dtype=np.int64)
    return b"".join([
        struct.pack(HEAD, len(keys), len(lengths), len(labels), int(offsets[-1])),
        np.array([k[0] for k in keys], np.uint64).tobytes(), offsets.tobytes(),
        np.array([k[3] for k in keys], np.int64).tobytes(), np.array(lengths, np.int64).tobytes(),
        np.array(labels, np.int64).tobytes(), b"".join(strings)])


class Index:
    """A mapped index file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as head:
            n, n_lengths, n_labels, size = struct.unpack(HEAD, head.read(struct.calcsize(HEAD)))
        at = struct.calcsize(HEAD)

        def part(kind, count):
            nonlocal at
            found = np.memmap(path, kind, "r", at, (count,)) if count else np.empty(0, kind)
            at += np.dtype(kind).itemsize * count
            return found

        self.keys, self.offsets, self.block = part(np.uint64, n), part(np.int64, n + 1), part(np.int64, n)
        self.lengths, self.labels = part(np.int64, n_lengths).tolist(), part(np.int64, n_labels).tolist()
        self.strings = part(np.uint8, size)

    def lookup(self, probes: list[bytes]) -> np.ndarray:
        """The row of each probe string, or -1. Equal digests are walked until the string itself agrees."""
        if not probes or not len(self.keys):
            return np.full(len(probes), -1)
        digests = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), np.uint64, len(probes))
        first = np.searchsorted(self.keys, digests)
        found = np.full(len(probes), -1)
        hits = np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] == digests))
        for i in hits:
            row = int(first[i])
            while row < len(self.keys) and self.keys[row] == digests[i]:
                if self.strings[self.offsets[row]:self.offsets[row + 1]].tobytes() == probes[i]:
                    found[i] = row
                    break
                row += 1
        return found


def suffixes(host: str, labels: list[int]):
    """The host's last parts of as many labels as some rule's host has; a host of any length has no more of them than there are rule lengths."""
    parts = host.rsplit(".", max(labels, default=0))
    for n in labels:
        if n <= len(parts):
            yield ".".join(parts[-n:])


def published(spark: SparkSession, data: bytes) -> str:
    """Write the index to the shared folder and have every executor fetch it; the name under which SparkFiles finds it."""
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.write(data)
        out.close()
    sc.addFile(fs.makeQualified(path).toString())
    return name


VERDICTS = "page_id bigint, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
               max_index_bytes: int = 64 << 20) -> DataFrame:
    """One row per page: host, path, the rule that wins or null, and the verdict."""
    spark = pages.sparkSession
    rules = canonical(rules)
    urls = split_url(pages, id_col, url_col)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 25), F.lit(0)).alias("b")).first()["b"]
    if size > max_index_bytes:
        return by_join(urls, rules, default)
    listed = [(r["host"], r["path"], r["block"]) for r in rules.collect()]
    name = published(spark, write_index(listed))

    def make():
        index = Index(SparkFiles.get(name))

        def work(batch):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes, owner, memo = [], [], {}
            for i, (host, path) in enumerate(zip(hosts, paths)):
                if (host, path) in memo:
                    continue
                memo[host, path] = i
                for s in suffixes(host, index.labels) if host else ():
                    for n in index.lengths:
                        if n <= len(path):
                            probes.append((s + "\0" + path[:n]).encode())
                            owner.append(i)
            best = {}
            for i, probe, row in zip(owner, probes, index.lookup(probes)):
                if row >= 0:
                    h, _, p = probe.decode().partition("\0")
                    best[i] = max(best.get(i, (0, 0, "", 0)), (len(h) + len(p), len(h), h + p, int(index.block[row])))
            won = [best.get(memo[k]) for k in zip(hosts, paths)]
            return {"page_id": batch.column("page_id"), "host": hosts, "path": paths,
                    "rule": pa.array([w and w[2] for w in won], pa.string()),
                    "verdict": [default if w is None else "block" if w[3] else "allow" for w in won]}
        return work
    return per_batch(urls, make, VERDICTS, rows=4096)


def by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts without an index on the executors: distinct (host, path) pairs are probed by a join."""
    lengths = [r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    pairs = urls.filter("host != ''").select("host", "path").distinct()
    counts = [r["n"] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()]
    labels = F.split("host", r"\.")
    parents = F.filter(F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in counts] or [F.lit(None).cast("string")]),
                       lambda h: h.isNotNull())
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    probes = (pairs.select("host", "path", F.explode(F.array_distinct(parents)).alias("h"), prefixes.alias("ps"))
              .select("host", "path", "h", F.explode("ps").alias("p")).filter("p IS NOT NULL"))
    keyed = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "block", "rule")
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("h").alias("m"), "rule", "block"))
    won = probes.join(keyed, ["h", "p"]).groupBy("host", "path").agg(best.alias("won"))
    verdict = F.when(F.col("won").isNull(), default).when(F.col("won.block"), "block").otherwise("allow")
    return urls.join(won, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), verdict.alias("verdict"))


ship(__name__)
