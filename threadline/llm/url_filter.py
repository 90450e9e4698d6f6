"""URL filters: fixed rules, and a Bloom filter cascade over hosts, in DataFrame functions only.

The cascade gives exact membership of every key of the corpus in a list, without a join at
lookup. Level 0 encodes the listed keys, level 1 the other keys that level 0 accepts wrongly,
level 2 the listed keys that level 1 accepts wrongly, and so on until no key is wrong. A key
belongs to the list if the first level that refuses it is an odd one. The key universe stays
in a table; only the bit arrays travel, as scalar subqueries of one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def apply_rules(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null without one. Equal lengths: by text."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        text = F.when(r.fits(host, path), r.text).otherwise(text)
        verdict = F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return text, verdict


def link_heavy(pages: DataFrame, words: Sequence[str] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key): the hosts whose pages together hold more links than paragraphs, and those with one of
    some words in their name. Null pages count as empty."""
    of = lambda pattern: F.sum(F.coalesce(F.regexp_count(html_col, F.lit(pattern)), F.lit(0)))
    hosts = pages.groupBy(host_of(F.col(url_col)).alias("key")).agg(of("<a href=").alias("links"), of("<p[ >]").alias("paragraphs"))
    named = F.col("key").rlike("|".join(words)) if words else F.lit(False)
    return hosts.filter((F.col("links") > F.col("paragraphs")) | named).select("key")


@dataclass
class BloomLevel:
    bits: DataFrame  # one row: words, an array of longs
    n_bits: int
    n_hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def accepts(self, key: Column) -> Column:
        words = self.bits.scalar()
        return reduce(and_, (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.places(key)))


def build_level(keys: DataFrame, n_keys: int, error: float, seed: int) -> BloomLevel:
    """A Bloom filter of keys(key); its bits are or-ed by word before and after the shuffle."""
    n_bits = 64 * math.ceil(max(n_keys, 1) * math.log2(1 / error) * math.log2(math.e) / 64 + 1)
    level = BloomLevel(keys, n_bits, max(1, round(math.log2(1 / error))), seed)
    set_bits = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    blank = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    dense = set_bits.union(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    level.bits = written(one, "bloom-level")
    return level


@dataclass
class Cascade:
    levels: list[BloomLevel]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; exact for those keys, and only for them."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.accepts(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, later_error: float = 0.1) -> Cascade:
    """A cascade for universe(key, listed), of distinct keys. The first level is as exact as the
    ratio of listed to other keys asks for, later ones err with ``later_error``."""
    inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    n_in, n_out = inside.count(), outside.count()
    levels: list[BloomLevel] = []
    error = min(0.5, max(n_in, 1) / (math.sqrt(2) * max(n_out, 1)))
    while n_in:
        level = build_level(inside, n_in, error, len(levels))
        levels.append(level)
        wrong = written(outside.filter(level.accepts(F.col("key"))), "false-positives")
        inside, outside, n_in, error = wrong, inside, wrong.count(), later_error
    return Cascade(levels)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    ``listed(key)`` is the block list of hosts; what it repeats, nulls, and hosts without a page make
    no difference. The longest rule decides; else listed hosts are blocked and others allowed. The list is looked up by cascade as long as
    its first level takes ``max_filter_bytes`` at most, beyond that by a salted join. Null urls
    have empty host and path; repeated rows each give a row; an empty table gives no rows."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    marks = listed.select("key").distinct().withColumn("listed", F.lit(True))
    universe = written(rows.select(F.col("host").alias("key")).distinct().join(marks, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "hosts")
    n_in, n_all = universe.agg(F.count_if("listed"), F.count("*")).first()
    text, verdict = apply_rules(rules, F.col("host"), F.col("path"))
    if n_in * math.log2(2 + 1.5 * n_all / max(n_in, 1)) * 1.45 / 8 <= max_filter_bytes:
        hit = build_cascade(universe).contains(F.col("host"))
    else:
        salts = 32
        keys = universe.filter("listed").select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(keys, (F.col("host") == F.col("key")) & (F.col("salt") == F.col("s")), "left")
        hit = F.col("key").isNotNull()
    return rows.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"))
