"""Mixing sources to target weights by blocks.

The words of each source, in a fixed pseudorandom order of its documents, are packed into
blocks of ``block_words``. Output shards draw how many slots each source gets from a
multinomial; a source's slots are numbered through the shards and mapped through a keyed
permutation of its block indices (a fresh one for each epoch), and slots and blocks meet in a
join on (source, block index), whose keys are as even as the blocks are. Running sums go
through buckets of bounded size, so a source that holds a third of all rows is split too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import MIX_1, MIX_2, cut, map_rows, with_groups

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, source, skey, size, h): words of each text, a key that also names the null source, a place in the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        skey.alias("skey"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(9), "doc_id", text).alias("h"),
        *(["text"] if keep_text else []),
    )


def targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(skey, source, source_size, target) for each source.

    Weights repeat over the sources by code point, null last; targets share ``share`` of all
    words and stop at ``most`` times the source, the excess going to the others by weight: the
    level at which that comes out even is found on the sources sorted by what a unit of weight
    can take. One row per source.
    """
    by = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    by = by.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("r", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size")).over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    even = F.min_by("level", F.when(F.col("level") <= F.col("r") * (1 + 1e-12), F.col("r"))).over(whole)
    return by.withColumn("target", F.least("cap", F.coalesce(even, F.lit(0.0)) * F.col("w"))).select("skey", "source", "source_size", "target", "n_rows")


def placed(rows: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``start``: how many words of the source come before the row's.

    Sums run inside buckets of ``bucket_rows`` rows at most in expectation (fewer in a small
    table, so that a large source is spread there too), and then over a source's buckets.
    """
    count = rows.count()
    n = max(1, count // bucket_rows, min(1_000, count // 100))
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(n)))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("s"))
    offsets = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(offsets, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def permuted(index: np.ndarray, key: np.ndarray, size: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Keyed pseudorandom permutation of [0, size): a Feistel network over enough bits, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = x >> h, x & m
            for r in range(rounds):
                z = (right + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(MIX_1)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def block_of(slot: pd.Series, key: pd.Series, blocks: pd.Series) -> pd.Series:
    """Block index of a source's slot; each epoch permutes anew."""
    b = blocks.to_numpy()
    epoch = slot.to_numpy() // b
    return pd.Series(permuted(slot.to_numpy() % b, key.to_numpy() + epoch * 1_000_003, b))


def shares_of(slots: list[int]) -> np.ndarray:
    return np.array(slots, dtype=float) / max(sum(slots), 1)


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[x & ((1 << 64) - 1) for x in key]))


def drawn_counts(spark: SparkSession, slots: list[int], shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """((shard, i, n), shards): how often each shard draws place i of ``slots``, by a multinomial for each shard."""
    total, chance = sum(slots), shares_of(slots)
    shards = -(-total // shard_slots) if total else 0

    def draw(frames):
        for f in frames:
            for shard in f["id"]:
                n = generator(seed, int(shard)).multinomial(min(shard_slots, total - shard * shard_slots), chance)
                drew = np.nonzero(n)[0]
                yield pd.DataFrame({"shard": int(shard), "i": drew.astype(np.int32), "n": n[drew]})

    schema = "shard long, i int, n long"
    return (spark.range(shards).mapInPandas(draw, schema) if shards else spark.createDataFrame([], schema)), shards


def drawn_in_two_steps(goals: DataFrame, shard_slots: int, seed: int, bins: int) -> tuple[DataFrame, int]:
    """((shard, skey, n), shards) for more sources than reach the driver: shards draw bins of sources, and a bin's draws are divided among its own.

    A multinomial in two steps is the same multinomial. A bin is an array of its sources, sorted.
    """
    binned = goals.withColumn("i", F.pmod(F.xxhash64("skey"), F.lit(bins)).cast("int"))
    held = cut(binned.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("skey", "slots"))).alias("m"), F.sum("slots").alias("s")))
    slots = [0] * bins
    for r in held.select("i", "s").collect():  # a row a bin
        slots[r["i"]] = r["s"]
    counts, shards = drawn_counts(goals.sparkSession, slots, shard_slots, seed)
    times = cut(counts.groupBy("i").agg(F.count(F.lit(1)).alias("times")))
    rows = with_groups(counts, held.join(times, "i").select("i", "m", "times"), "i", "times")

    def divide(shard, i, n, m):
        out: tuple[list, list, list] = ([], [], [])
        for s, b, k, members in zip(shard, i, n, m, strict=True):
            own = generator(seed + 1, (s << 24) ^ b).multinomial(k, shares_of([x["slots"] for x in members]))
            for place in np.nonzero(own)[0]:
                for column, x in zip(out, (s, members[place]["skey"], int(own[place])), strict=True):
                    column.append(x)
        return out

    return map_rows(rows.select("shard", "i", "n", "m"), divide, "shard long, skey string, n long"), shards


def drawn_slots(goals: DataFrame, shard_slots: int, seed: int, most_sources: int = 1_000_000) -> DataFrame:
    """(skey, shard, slot, block) for all ``goals(skey, blocks, slots)``: multinomial counts per shard.

    A source's slots end exactly at its goal: what the shards drew beyond is left out, and what
    they fell short goes to one more shard. One row per source reaches the driver, up to ``most_sources``; of
    more, one row per bin of sources, which then divide what their bin drew. A shard has a row for each source that it
    drew, so no more than it has slots. Slots are numbered along a source in stretches of shards, so that none is one task.
    """
    spark = goals.sparkSession
    rows = goals.orderBy("skey").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        counts, shards = drawn_in_two_steps(goals, shard_slots, seed, most_sources)
    else:
        counts, shards = drawn_counts(spark, [r["slots"] for r in rows], shard_slots, seed)
        names = spark.createDataFrame([(i, r["skey"]) for i, r in enumerate(rows)], "i int, skey string")
        counts = counts.join(F.broadcast(names), "i").select("shard", "skey", "n")  # ``most_sources`` rows at most
    rest = goals.select(F.lit(shards).cast("long").alias("shard"), "skey", F.col("slots").alias("n"))
    counts = counts.union(rest).withColumn("stretch", F.floor(F.col("shard") / 4096))
    sums = counts.groupBy("skey", "stretch").agg(F.sum("n").alias("s"))
    base = F.coalesce(F.sum("s").over(Window.partitionBy("skey").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "stretch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = counts.withColumn("inside", first).join(sums.select("skey", "stretch", base.alias("base")), ["skey", "stretch"])
    few = F.broadcast(goals) if len(rows) <= 100_000 else goals
    spans = numbered.withColumn("first", F.col("base") + F.col("inside")).join(few, "skey").withColumn("end", F.least(F.col("first") + F.col("n"), F.col("slots")))
    slots = spans.filter(F.col("end") > F.col("first")).select("skey", "shard", "blocks", F.explode(F.sequence("first", F.col("end") - 1)).alias("slot"))
    return slots.withColumn("block", F.pandas_udf(block_of, "long")("slot", F.xxhash64(F.lit(seed), "skey"), "blocks")).drop("blocks")


def mix_plan(rows: DataFrame, goals: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots): which words of which row fill a block, and where each block goes."""
    size = F.col("source_size")
    blocks = F.ceil(size / block_words).cast("long")
    slots = F.least(F.round(F.col("target") * blocks / size).cast("long"), 2 * blocks)
    drawn = drawn_slots(goals.filter(size > 0).select("skey", blocks.alias("blocks"), slots.alias("slots")), shard_slots, seed)
    return pieces_of(rows, block_words), drawn


def pieces_of(rows: DataFrame, block_words: int) -> DataFrame:
    """``rows`` by the blocks that they reach into: block, from_word, n_words, and the words' text where rows have any.

    A text is split once, then cut inside its row, so that a long one costs no more a word than others.
    """
    size, start = F.col("size"), F.col("start")
    blocks = F.sequence(F.floor(start / block_words).cast("long"), F.floor((start + size - 1) / block_words).cast("long"))

    def piece(block: Column, words: Column | None) -> Column:
        a = F.greatest(start, block * block_words)
        n = F.least(start + size, (block + 1) * block_words) - a
        text = [] if words is None else [F.array_join(F.slice(words, (a - start + 1).cast("int"), n.cast("int")), " ").alias("piece")]
        return F.struct(block.alias("block"), (a - start).alias("from_word"), n.alias("n_words"), *text)

    if "text" in rows.columns:
        split = F.array(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
        cuts = F.flatten(F.transform(split, lambda words: F.transform(blocks, lambda b: piece(b, words))))
    else:
        cuts = F.transform(blocks, lambda b: piece(b, None))
    return rows.filter(size > 0).select(*(c for c in rows.columns if c != "text"), F.inline(cuts))


def mixed_counts(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """For each row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, taken.

    ``taken`` counts the row's words that the mix takes, repeats included; no word is taken more
    than twice. Texts of any length are packed whole; rows that tie in the order go by doc_id. Null texts have no words; a null source is a source of its own, last in order;
    repeated rows are packed each for themselves; other columns are ignored; a table without
    words takes nothing. The same table gives the same mix.
    """
    rows = cut(sized(docs))
    goals = cut(targets(rows, weights, share, most))
    rows = cut(placed(rows))
    pieces, slots = mix_plan(rows, goals, block_words, shard_slots, seed)
    takes = slots.groupBy("skey", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(takes, ["skey", "block"]).groupBy("skey", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    with_words = rows.filter(F.col("size") > 0).join(taken, ["skey", "start"], "left").select("doc_id", "size", "skey", "taken")
    without = rows.filter(F.col("size") == 0).select("doc_id", "size", "skey", F.lit(0).cast("long").alias("taken"))
    return with_groups(with_words.union(without), goals, "skey", "n_rows").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """The mix itself: shard, slot, source, block, doc_ids, n_words, text, one row per slot."""
    rows = cut(sized(docs))
    goals = cut(targets(rows, weights, share, most))
    rows = placed(sized(docs, keep_text=True))
    pieces, slots = mix_plan(rows, goals, block_words, shard_slots, seed)
    piece = F.struct("start", "doc_id", F.col("piece").alias("text"), "n_words")
    filled = pieces.select("skey", "source", "block", piece.alias("p")).groupBy("skey", "source", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return filled.join(slots, ["skey", "block"]).select(
        "shard", "slot", "source", "block", F.col("p.doc_id").alias("doc_ids"), F.aggregate("p", F.lit(0).cast("long"), lambda t, x: t + x["n_words"]).alias("n_words"), F.array_join("p.text", " ").alias("text")
    )
