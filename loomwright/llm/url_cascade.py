"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

A rule is a host with a path prefix. Every url yields the keys that could be a rule: each suffix of its host at a dot,
joined to each prefix of its path that is as long as some rule's path. The keys of all urls are the universe. Level 0
encodes the listed keys, level 1 the keys of the universe that level 0 takes for listed ones, level 2 the listed keys that
level 1 takes for those, and so on until a level has no false positive. A key of the universe is then judged exactly by
expressions on literals: no join, no lookup table.

The first level is sized by the number of listed keys n and of keys in the universe u: a false-positive rate near n / u
leaves about n keys for level 1. A filter so takes about n * 1.44 * log2(u / n) bits: its size is set by the list and
grows with the logarithm of the corpus only. A list whose first level would take more than MAX_BYTES is dealt by hash to
several cascades, each over its own part of the universe. The keys of all urls are written once and read by every level.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import stored

MAX_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """One Bloom filter: `bits` bits in longs, `hashes` positions a key, hashed with the level's number."""

    number: int
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number * 64 + i), key), F.lit(self.bits).cast("long")) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        bitmap = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded into one literal, whatever the hashes
        test = lambda bits, p: F.getbit(F.element_at(bits, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        return F.exists(F.array(bitmap), lambda bits: F.forall(F.array(*self.positions(key)), lambda p: test(bits, p)))


def build_level(keys: DataFrame, number: int, rate: float) -> Level | None:
    """The filter of the column `key` at a false-positive rate; None for no keys."""
    n = keys.count()
    if not n:
        return None
    hashes = max(1, min(24, round(-math.log2(rate))))
    level = Level(number, max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64), hashes, [])
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w"))
    found = at.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits")).collect()
    level.words = [0] * (level.bits // 64)
    for row in found:  # at most `bits` / 64 rows
        level.words[row["w"]] = row["bits"]
    return level


@dataclass
class Cascade:
    """The levels for each part of the keys, which a hash deals."""

    parts: list[list[Level]]

    def holds(self, key: Column) -> Column:
        """True for exactly the listed keys, for keys of the universe."""
        out = F.lit(False)
        for number, levels in enumerate(self.parts):
            found = F.lit(False)
            for level in reversed(levels):
                found = level.holds(key) & ~found
            out = out | (found if len(self.parts) == 1 else (part_of(key, len(self.parts)) == number) & found)
        return out


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def build_levels(listed: DataFrame, universe: DataFrame, rate: float) -> list[Level]:
    levels: list[Level] = []
    inside, outside = listed, universe
    while (level := build_level(inside, len(levels), rate)) is not None:
        passing = outside.where(level.holds(F.col("key")))
        if not levels:
            passing = passing.join(listed, "key", "left_anti").distinct()
        levels.append(level)
        inside, outside, rate = stored(passing), inside, 0.5
    return levels


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Both have the column `key`; the universe may repeat keys. Listed keys outside the universe do no harm."""
    listed, universe = listed.select("key").where("key is not null").distinct(), universe.select("key").where("key is not null")
    n, u = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(1e-9, n / max(u, 1) * math.sqrt(0.5)))
    parts = max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 8 / MAX_BYTES))
    own = lambda df, k: df if parts == 1 else df.where(part_of(F.col("key"), parts) == k)
    return Cascade([build_levels(own(listed, k), own(universe, k), rate) for k in range(parts)])


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting this url could have: array<struct<size, host_size, key>>."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct(
        (F.length(h) + n).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.when(host != "", pairs).otherwise(F.array().cast("array<struct<size:int,host_size:int,key:string>>"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; other columns stay, and columns with those names are replaced.

    rules: host string, path string (begins with /), verdict block or allow. The longest fitting rule wins, then the
    one with the longer host; a rule listed as both blocks. Urls that no rule fits get `default`: the cascade finds none
    of their keys. A null url, one without :// and one with an empty path fit no rule. Repeated urls are judged alike;
    an empty table or no rules give an empty result or `default` throughout.
    """
    rules = rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = url_parts(F.col(url))
    urls = pages.withColumns({"host": host, "path": path}).withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = stored(urls.select(F.explode(F.transform("__keys", lambda k: k["key"])).alias("key")))
    keys = rules.select("verdict", F.concat("host", "path").alias("key"))

    def hits(verdict: str) -> Column:
        cascade = build_cascade(keys.where(F.col("verdict") == verdict), universe)
        found = F.filter("__keys", lambda k: cascade.holds(k["key"]))
        return F.transform(found, lambda k: F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), F.lit(verdict == "block").alias("blocks"), k["key"].alias("key")))

    best = F.array_max(F.concat(hits("block"), hits("allow")))
    out = urls.withColumn("__best", best)
    out = out.withColumns({"rule": F.col("__best.key"), "verdict": F.when(F.col("__best.blocks").isNull(), default).when(F.col("__best.blocks"), "block").otherwise("allow")})
    return out.drop("__keys", "__best")
