"""URL filters: host and path rules over a Bloom filter cascade. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; null where none does. Equal lengths: the first given."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    """One Bloom filter: its words of 64 bits as a written table (word, bits), and its number of bits."""

    words: DataFrame
    bits: int
    hashes: int
    number: int

    def places(self, key: Column) -> list[Column]:
        first, second = F.xxhash64(key), F.xxhash64(key, F.lit(self.number))
        return [
            F.pmod(first.bitwiseXOR(second + F.lit(j * 0x9E3779B1).cast("long")), F.lit(self.bits))
            if j
            else F.pmod(second, F.lit(self.bits))
            for j in range(self.hashes)
        ]

    def holds(self, key: Column) -> Column:
        """Whether all places of ``key`` are set; the words come as a scalar subquery of one bounded array."""
        packed = self.words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(
            F.transform("w", lambda x: x["bits"])
        ).scalar()
        held = F.lit(True)
        for place in self.places(key):
            word = F.get(packed, F.floor(place / 64).cast("int"))
            held = held & (F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return held


@dataclass
class Cascade:
    """Levels for each shard of the keys; membership is exact for every key of the universe it was built on."""

    shards: list[list[Level]]

    def listed(self, key: Column, shard: int = 0) -> Column:
        levels = self.shards[shard]
        said = F.lit(bool(len(levels) % 2))  # held by the last level: what that level encodes
        for n, level in reversed(list(enumerate(levels))):
            said = F.when(~level.holds(key), F.lit(bool(n % 2))).otherwise(said)
        return F.coalesce(said, F.lit(False))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with boolean ``name``. One narrow pass a shard; a cascade within the size bound has one shard."""
        n, out = len(self.shards), None
        for shard in range(n):
            part = df if n == 1 else df.where(F.pmod(F.coalesce(F.xxhash64(key, F.lit(-1)), F.lit(0)), F.lit(n)) == shard)
            part = part.withColumn(name, self.listed(F.col(key), shard))
            out = part if out is None else out.unionByName(part)
        return out


def build_cascade(
    universe: DataFrame, listed: DataFrame, key: str = "key", bits_per_key: int = 10, hashes: int = 5, most_bits: int = 1 << 28
) -> Cascade:
    """Bloom filter cascade of the ``listed`` keys that is exact over ``universe`` (both have column ``key``).

    Level 1 encodes the listed keys, level 2 the other keys of the universe that level 1 holds wrongly, level 3
    the listed keys that level 2 holds wrongly, and so on until none is left. Every level is built by
    aggregation and read as an array of at most ``most_bits`` bits, which is checked: more listed keys are dealt by hash
    into as many shards as bring each below it. Null keys are ignored (never listed), repeated ones count once, an empty
    list holds nothing, an empty universe makes one level.
    """
    keys = cut(
        universe.select(F.col(key).alias("key"), F.lit(False).alias("listed"))
        .union(listed.select(F.col(key), F.lit(True)))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    total = keys.where("listed").count()
    if not total:
        return Cascade([[]])
    n_shards = max(1, math.ceil(total * bits_per_key / most_bits))
    shards = []
    for shard in range(n_shards):
        mine = keys if n_shards == 1 else keys.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(n_shards)) == shard)
        levels: list[Level] = []
        encode = mine.where("listed")
        other = mine.where("NOT listed")
        while True:
            n = encode.count()
            if not n:
                break
            level = Level(None, 64 * math.ceil((n * bits_per_key + 1) / 64), hashes, len(levels) + 1)
            spots = encode.select(F.explode(F.array(*level.places(F.col("key")))).alias("place"))
            bits = spots.select(
                F.floor(F.col("place") / 64).cast("long").alias("word"),
                F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bits"),
            )
            empty = encode.sparkSession.range(level.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
            level.words = cut(bits.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits")))
            levels.append(level)
            encode, other = other.where(level.holds(F.col("key"))), encode
        shards.append(levels)
    return Cascade(shards)


def filter_urls(
    pages: DataFrame, blocked: DataFrame, rules=RULES, url_col: str = "url", blocked_col: str = "host"
) -> DataFrame:
    """``pages`` plus host, path, rule and verdict for every row.

    The longest rule that fits decides; where none fits, the host is blocked exactly if it is in
    ``blocked``, which the cascade answers without a join. Null urls and urls without ``://`` have empty host and path, fit no rule
    and are allowed unless the list holds the empty host. Columns of ``pages`` with these names are replaced.
    """
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    split = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    cascade = build_cascade(split.select(F.col("host").alias("key")), blocked.select(F.col(blocked_col).alias("key")))
    name = fresh(split, "listed")
    marked = cascade.mark(split, "host", name)
    return marked.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(name), "block").otherwise("allow"))}).drop(name)
