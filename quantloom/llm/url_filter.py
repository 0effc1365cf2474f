"""URL filters: path rules, and a Bloom filter cascade over the corpus's own hosts.

Level 1 encodes the listed keys, level 2 those unlisted keys of the corpus that level 1 takes
for listed, level 3 the listed ones that level 2 takes, and so on until none is left; the
first level that does not know a key tells whether it is listed. As the levels are built from
the complete key universe, membership is exact for every key in it, at a few bits a key. The
universe is split by hash into shards of bounded size, each with a cascade of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import MIX_1, MIX_2, cut

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit positions of each key at a level, from two 64-bit hashes of it."""
    with np.errstate(over="ignore"):
        z = (h1 + h2 * np.arange(1, hashes + 1, dtype=np.uint64)[:, None]) ^ (np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return (z ^ (z >> np.uint64(31))) % np.uint64(bits)


def known(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, most_levels: int = 64) -> list[tuple[int, int, bytes]]:
    """(hashes, bits, bitmap) of each level for one shard's whole universe."""
    inside, outside = np.nonzero(listed)[0], np.nonzero(~listed)[0]
    levels: list[tuple[int, int, bytes]] = []
    encode, test = inside, outside
    while len(encode):
        if len(levels) == most_levels:
            raise ValueError("two keys share both hashes")
        rate = min(0.5, math.sqrt(0.5) * len(encode) / max(len(test), 1)) if not levels else 0.5
        hashes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(len(encode) * hashes / math.log(2)))
        bitmap = np.zeros((bits + 7) // 8, dtype=np.uint8)
        at = places(h1[encode], h2[encode], len(levels), hashes, bits).ravel()
        np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        levels.append((hashes, bits, bitmap.tobytes()))
        encode, test = test[known(bitmap, places(h1[test], h2[test], len(levels) - 1, hashes, bits))], encode
    return levels


def is_listed(h1: np.ndarray, h2: np.ndarray, levels: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    out = np.zeros(len(h1), dtype=bool)
    live = np.arange(len(h1))
    for k, (hashes, bits, bitmap) in enumerate(levels):
        passed = known(bitmap, places(h1[live], h2[live], k, hashes, bits))
        out[live[~passed]] = k % 2 == 1
        live = live[passed]
    out[live] = len(levels) % 2 == 1
    return out


def key_hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key, F.lit(11)).alias("h2")]


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 40), F.lit(shards))


def build_cascades(universe: DataFrame, shard_keys: int) -> tuple[DataFrame, int]:
    """(shard, level, hashes, bits, bitmap) rows from ``universe(key, listed)``, one row per key, and the number of shards."""
    shards = universe.count() // shard_keys + 1
    hashed = universe.select(*key_hashes("key"), "listed").withColumn("shard", shard_of(shards))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = cascade(pdf["h1"].to_numpy().astype(np.uint64), pdf["h2"].to_numpy().astype(np.uint64), pdf["listed"].to_numpy(dtype=bool))
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), k, *x) for k, x in enumerate(made)], columns=["shard", "level", "hashes", "bits", "bitmap"])

    return hashed.groupBy("shard").applyInPandas(build, "shard long, level int, hashes int, bits long, bitmap binary"), shards


def with_membership(rows: DataFrame, cascades: DataFrame, shards: int, most_bytes: int = 64_000_000) -> DataFrame:
    """``rows`` plus ``listed`` for their ``key``, probed without a join.

    Cascades are held by each task only up to ``most_bytes``: beyond that the shards are taken in
    several passes, each over the rows of its own shards.
    """
    rows = rows.select("*", *key_hashes("key")).withColumn("shard", shard_of(shards))
    by_shard = cascades.groupBy("shard").agg(F.sum(F.octet_length("bitmap")).alias("b")).orderBy("shard").collect()  # a row per shard
    passes: list[list[int]] = [[]]
    held = 0
    for r in by_shard:
        if held + r["b"] > most_bytes and passes[-1]:
            passes.append([])
            held = 0
        passes[-1].append(r["shard"])
        held += r["b"]

    def probed(part: DataFrame, members: list[int]) -> DataFrame:
        got = cascades.filter(F.col("shard").isin(members)).orderBy("shard", "level").collect() if members else []
        of: dict[int, list] = {}
        for r in got:
            of.setdefault(r["shard"], []).append((r["hashes"], r["bits"], bytes(r["bitmap"])))
        shared = part.sparkSession.sparkContext.broadcast(of)

        def probe(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ready = {k: [(h, b, np.frombuffer(m, dtype=np.uint8)) for h, b, m in v] for k, v in shared.value.items()}
            for h1, h2, shard in batches:
                out = np.zeros(len(h1), dtype=bool)
                for k in shard.unique():
                    at = np.nonzero(shard.to_numpy() == k)[0]
                    if k in ready:
                        out[at] = is_listed(h1.to_numpy()[at].astype(np.uint64), h2.to_numpy()[at].astype(np.uint64), ready[k])
                yield pd.Series(out)

        return part.withColumn("listed", F.pandas_udf(probe, "boolean")("h1", "h2", "shard"))

    out = None
    for k, members in enumerate(passes):
        part = rows if len(passes) == 1 else rows.filter(F.col("shard").isin(members) if k else ~F.col("shard").isin([s for p in passes[1:] for s in p]))
        one = probed(part, members)
        out = one if out is None else out.union(one)
    return out.drop("h1", "h2", "shard")


def url_verdicts(pages: DataFrame, rules: Iterable[Rule], shard_keys: int = 200_000, most_bytes: int = 64_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages(page_id, url)``.

    Where a rule fits, its verdict holds, the longest first. Other pages are blocked when their
    host is listed: the list holds the hosts of which rules block more pages than they allow. A
    null url, or one without ``://``, has an empty host and path, is never listed, and is allowed.
    Rules that fit at equal length go by the order of (verdict, host, path), the last wins. Urls of any
    length are read whole. Repeated rows each get their row; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    votes = F.sum(F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", -1).otherwise(0))
    universe = cut(rows.groupBy(F.col("host").alias("key")).agg((votes > 0).alias("listed")).withColumn("listed", F.col("listed") & (F.col("key") != "")))
    made, shards = build_cascades(universe, shard_keys)
    probed = with_membership(rows.withColumn("key", F.col("host")), cut(made), shards, most_bytes)
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return probed.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
