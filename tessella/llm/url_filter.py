"""URL filters by Bloom filter cascades.

A list of rules (host and path prefix) is a set of keys. The keys that the urls of the corpus can ask about, every
suffix of their host with every prefix of their path that a rule could have, are the complete universe. Level 0 of a
cascade is a Bloom filter of the listed keys; level 1 of the keys of the universe that pass level 0 without being
listed; level 2 of the listed keys that pass level 1; and so on until nothing is left. Over that universe the level
where a key stops tells exactly whether it is listed, so urls are judged row by row with a few bit tests and no join.

Level 0 is sized by the number of distinct keys of the universe so that its false positives number about as many as the
listed keys; only these few are collected, and if there are more, level 0 is built anew with more bits. Every task holds
the cascades; for lists too long for that a join on the keys takes their place, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Bloom:
    """A Bloom filter of ``keys`` with about ``rate`` false positives; ``level`` salts its hashes."""

    def __init__(self, keys: Iterable[str], rate: float, level: int):
        keys = list(keys)
        self.level = level
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(len(keys) * self.k / math.log(2)))
        bits = bytearray((self.m + 7) // 8)
        for key in keys:
            for b in self._places(key):
                bits[b >> 3] |= 1 << (b & 7)
        self.bits = bytes(bits)

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.level)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in self._places(key))


class Cascade:
    """Exact membership in ``listed`` for every key of the universe whose false positives at level 0 are ``passed``."""

    def __init__(self, first: Bloom, listed: set[str], passed: set[str]):
        self.levels = [first]
        inside, outside = set(listed), set(passed)
        while outside:
            self.levels.append(Bloom(outside, 0.5, len(self.levels)))
            inside, outside = outside, {k for k in inside if k in self.levels[-1]}

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1

    @property
    def n_bytes(self) -> int:
        return sum(len(level.bits) for level in self.levels)


@dataclass(frozen=True)
class RuleList:
    """Rules with one verdict. Lists of a smaller ``tier`` come first; within a tier the longest rule wins."""

    rules: tuple[str, ...]
    verdict: str
    tier: int = 0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def asked_keys(host: Column, path: Column, lists: list[RuleList]) -> Column:
    """The keys that a url asks about: suffixes of its host and prefixes of its path, of the sizes that rules have.

    The sizes are one array, so the expression stays as small however many there are.
    """
    sizes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for x in lists for r in x.rules})
    if not sizes:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n).alias("length")) for d, n in sizes])
    labels = F.split(host, r"\.")
    fitting = F.filter(pairs, lambda s: (F.size(labels) >= s["depth"]) & (F.length(path) >= s["length"]) & (host != ""))
    return F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(labels, -s["depth"], s["depth"]), "."), F.substring(path, F.lit(1), s["length"])))


def build(urls: DataFrame, lists: list[RuleList]) -> list[Cascade]:
    """A cascade for each list over all keys in the column ``keys`` of ``urls``.

    The lists are held by the driver; the corpus's keys never are, only those that pass a level 0 and are not listed.
    """
    keys = urls.select(F.explode("keys").alias("key"))
    universe = max(1, keys.agg(F.approx_count_distinct("key")).first()[0])
    more = 1.0
    while True:
        first = []
        for x in lists:
            rate = min(0.5, math.sqrt(0.5) * max(1, len(x.rules)) / universe) * more
            first.append(Bloom(x.rules, rate, 0))
        listed = [frozenset(x.rules) for x in lists]

        def passing(batches: Iterator[pa.RecordBatch], first=first, listed=listed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = set(batch.column(0).to_pylist())
                found = [(k, i) for i, (b, own) in enumerate(zip(first, listed, strict=True)) for k in keys if k in b and k not in own]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.int32())], names=["key", "i"])

        most = 4 * sum(len(x.rules) for x in lists) + 1000
        rows = keys.mapInArrow(passing, "key string, i int").distinct().limit(most + 1).collect()
        if len(rows) <= most:
            return [Cascade(b, set(own), {r["key"] for r in rows if r["i"] == i}) for i, (b, own) in enumerate(zip(first, listed, strict=True))]
        more /= 16


#: A listed key costs its cascade about so much: some 40 bits at level 0 for a very large universe, and those above.
BYTES_A_RULE = 8


def _joined(pages: DataFrame, urls: DataFrame, lists: list[RuleList], otherwise: str, id_col: str) -> DataFrame:
    """The same verdicts by an equi-join of the asked keys with the rules. The best rule is found for each distinct key
    set, so many pages with one host are not brought together."""
    rules = urls.sparkSession.createDataFrame(
        [(r, x.tier, i, x.verdict) for i, x in enumerate(lists) for r in x.rules], "key string, tier int, at int, verdict string"
    )
    sets = urls.select(F.array_join("keys", "\n").alias("_set"), "keys").dropDuplicates(["_set"])
    asked = sets.select("_set", F.explode("keys").alias("key")).join(rules, "key")
    order = F.struct("tier", -F.length("key"), "at")
    best = asked.groupBy("_set").agg(F.min_by(F.struct("key", "verdict"), order).alias("best"))
    out = urls.withColumn("_set", F.array_join("keys", "\n")).join(best, "_set", "left")
    return out.select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def judge(
    pages: DataFrame, lists: list[RuleList], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url", most_mb: float = 64.0
) -> DataFrame:
    """``id_col``, host, path, rule (the rule that fits; null: none) and verdict, one row a row of ``pages``.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's. Null urls and urls without
    ``://`` have an empty host and path, fit no rule and get ``otherwise``. Of equal rules with different verdicts the
    list named first counts. ``most_mb``: the largest cascades that every task may hold; rules that would need more are
    joined instead.
    """
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.select(id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    urls = urls.withColumn("keys", asked_keys(F.col("host"), F.col("path"), lists))
    if sum(len(x.rules) for x in lists) * BYTES_A_RULE > most_mb * 1e6:
        return _joined(pages, urls, lists, otherwise, id_col)
    cascades = build(urls, lists)
    tiers = sorted({x.tier for x in lists})
    plan = [[(x.verdict, c) for x, c in zip(lists, cascades, strict=True) if x.tier == tier] for tier in tiers]
    schema = T.StructType([pages.schema[id_col], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def verdict(keys: list[str]) -> tuple[str | None, str]:
        keys = sorted(keys, key=len, reverse=True)
        for tier in plan:
            for key in keys:
                for what, cascade in tier:
                    if key in cascade:
                        return key, what
        return None, otherwise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(k) for k in batch.column(3).to_pylist()]
            rule, what = pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rule, what], names=schema.names)

    return urls.mapInArrow(run, schema)
