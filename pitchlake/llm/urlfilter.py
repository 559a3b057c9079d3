"""Operator 1: URL rules in a sorted digest array that workers memory-map."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tuned

#: (host, path prefix, verdict); a rule holds for its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Verdict of urls that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rules of one shard, whose file executors map; a longer list has more shards, each a range of digests.
SHARD_RULES = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def build(rules: Sequence[tuple[str, str, str]], shard_rules: int = SHARD_RULES) -> list[bytes]:
    """The index: a blob of prefix lengths, host depth and each shard's first digest, then a blob per shard.

    A shard is a range of the sorted digests: header, uint64 digests, offsets, verdicts and
    strings. A-Z of hosts are lower-cased; of equal (host, path) the last one counts.
    """
    import xxhash

    last = {(h.translate(_FOLD), p): v for h, p, v in rules}
    digests = np.fromiter((xxhash.xxh64_intdigest(_key(*k)) for k in last), np.uint64, len(last))
    every = list(last)
    order = np.argsort(digests, kind="stable")
    cuts = list(range(0, len(order), shard_rules))
    # equal digests stay in one shard, so that a probe looks into one
    ends = [int(np.searchsorted(digests[order], digests[order[c]], "left")) for c in cuts]
    shards = []
    for a, b in zip(ends, [*ends, len(order)][1:], strict=True):
        own = [every[i] for i in order[a:b]]
        strings = [_key(*k) for k in own]
        offsets = np.cumsum([0, *map(len, strings)]).astype(np.int64)
        blocks = np.array([last[k] == "block" for k in own], np.uint8)
        shards.append(b"".join((np.array([len(own), offsets[-1]], np.int64).tobytes(), digests[order[a:b]].tobytes(), offsets.tobytes(), blocks.tobytes(), *strings)))
    lengths = sorted({len(p) for _, p in last})
    depth = max((h.count(".") + 1 for h, _ in last), default=0)
    head = np.array([depth, len(lengths), *lengths], np.int64).tobytes() + digests[order[ends]].tobytes()
    return [head, *shards]


class Shard:
    """Probes one mapped range of the index."""

    def __init__(self, mapped: np.ndarray):
        n, size = (int(x) for x in mapped[:16].view(np.int64))
        at = 16
        self.keys = mapped[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = mapped[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.blocks = mapped[at : at + n]
        self.strings = mapped[at + n : at + n + size]

    def find(self, wanted: list[bytes], digests: np.ndarray) -> np.ndarray:
        """Row of each key or -1; a digest that is found counts only if the stored string is the same."""
        low = np.searchsorted(self.keys, digests, "left")
        high = np.searchsorted(self.keys, digests, "right")
        out = np.full(len(wanted), -1)
        for i in np.flatnonzero(high > low):
            for row in range(low[i], high[i]):
                if self.strings[self.offsets[row] : self.offsets[row + 1]].tobytes() == wanted[i]:
                    out[i] = row
        return out


class DigestArray:
    """The whole index; shards are mapped when a probe first falls into their range."""

    def __init__(self, head: bytes, shard: Callable[[int], Shard]):
        numbers = np.frombuffer(head, np.int64)
        self.depth, m = int(numbers[0]), int(numbers[1])
        self.lengths = numbers[2 : 2 + m].tolist()
        self.firsts = numbers[2 + m :].view(np.uint64)
        self.shard = lru_cache(None)(shard)

    def verdicts(self, wanted: list[bytes], digests: np.ndarray | None = None) -> list[bool | None]:
        """Whether the rule of each key blocks; None without a rule."""
        import xxhash

        if digests is None:
            digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in wanted), np.uint64, len(wanted))
        out: list[bool | None] = [None] * len(wanted)
        own = np.searchsorted(self.firsts, digests, "right") - 1
        for k in np.unique(own[own >= 0]).tolist():
            at = np.flatnonzero(own == k)
            shard = self.shard(k)
            for i, row in zip(at.tolist(), shard.find([wanted[i] for i in at], digests[at]).tolist(), strict=True):
                if row >= 0:
                    out[i] = bool(shard.blocks[row])
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of the longest rule; of equal lengths that with the longer host."""
        wanted: dict[tuple[str, str], None] = {}
        tried: list[list[tuple[str, str]]] = []
        for host, path in zip(hosts, paths, strict=True):
            labels = host.split(".") if host else []
            own = [(".".join(labels[-d:]), path[:k]) for d in range(min(len(labels), self.depth), 0, -1) for k in self.lengths if k <= len(path)]
            tried.append(own)
            wanted.update(dict.fromkeys(own))
        pairs = list(wanted)
        found = dict(zip(pairs, self.verdicts([_key(*p) for p in pairs]), strict=True))
        out: list[tuple[str | None, str | None]] = []
        for own in tried:
            hits = [p for p in own if found[p] is not None]
            best = max(hits, key=lambda p: (len(p[0]) + len(p[1]), len(p[0])), default=None)
            out.append((None, None) if best is None else (best[0] + best[1], "block" if found[best] else "allow"))
        return out


@lru_cache(2)
def _mapped(names: tuple[str, ...]) -> DigestArray:
    with open(SparkFiles.get(names[0]), "rb") as f:
        head = f.read()
    return DigestArray(head, lambda k: Shard(np.memmap(SparkFiles.get(names[1 + k]), np.uint8, "r")))


def spread(spark: SparkSession, blobs: list[bytes]) -> tuple[str, ...]:
    """Give every executor, also later ones, the files to map; returns their names."""
    names = []
    for blob in blobs:
        name = f"urlrules-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
        names.append(name)
        if not os.path.exists(SparkFiles.get(name)):
            folder = tempfile.mkdtemp(prefix="pitchlake-rules-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file as long as it runs
            with open(os.path.join(folder, name), "wb") as f:
                f.write(blob)
            spark.sparkContext.addFile(os.path.join(folder, name))
    return tuple(names)


def _folded(host) -> F.Column:
    return F.translate(host, _UPPER, _UPPER.lower())


def parsed(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path. host: after the first :// up to / ? # or end, A-Z lower-cased; path: then up to ? # or end; null or without ://: both empty."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(cast(`{0}` as string), ''), instr(coalesce(cast(`{0}` as string), ''), '://') + 3)".format(url_col))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", _folded(host)).withColumn("path", path)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict (allow or block).

    Each url's host suffixes and path prefixes of the rules' lengths are hashed and
    searched for in the mapped array; hits are confirmed on the stored strings. The array
    has as many shards of SHARD_RULES rules as the list needs, all probed alike. Null,
    empty or malformed urls have empty host and path and get the default verdict, as all
    do when there are no rules; long urls are judged whole. Rules of equal length can't
    both fit but by their host's length, the longer one counts. Rows are judged one by
    one: repeated rows and null ids stay, an empty table gives no rows, extra columns are
    left out whatever their names, nothing is shuffled.
    """
    spark = tuned(pages.sparkSession)
    names = spread(spark, build(rules))
    src = parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).select("id", "host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _mapped(names)
        for b in batches:
            got = index.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] or default for x in got], pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def judge_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """judge() for rules that are a table (host, path, verdict, position): candidates are joined to it by equality.

    For lists that the driver shouldn't hold; the caller chooses it, the results are the
    same. Of equal (host, path) the greatest position counts. Lengths of paths are
    collected (a few distinct numbers); rules with a null part are ignored.
    """
    r = rules.select(_folded("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"), "position").dropna().groupBy("rh", "rp").agg(F.max_by("rv", "position").alias("rv"))
    r = r.withColumn("rv", F.when(F.col("rv") == "block", "block").otherwise("allow"))
    lengths = sorted(x[0] for x in r.select(F.length("rp")).distinct().collect())
    src = parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))).select("id", "host", "path")
    # each (host, path) is looked up once, however many rows have it
    one = src.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tried = one.withColumn("n", F.size(labels)).withColumn("rh", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda d: F.array_join(F.slice(labels, d, F.col("n")), "."))))
    tried = tried.withColumn("k", F.explode(F.array(*[F.lit(k) for k in lengths] or [F.lit(None).cast("int")]))).where(F.col("k") <= F.length("path"))
    hits = tried.withColumn("rp", F.col("path").substr(F.lit(1), F.col("k"))).join(r, ["rh", "rp"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"), F.concat("rh", "rp").alias("rule"), F.col("rv"))).alias("b"))
    return src.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.rv", F.lit(default)).alias("verdict"))
