"""Merkle manifest of a dataset: a digest for each row, one root for all, and a proof for each row.

Ranks are cut into binary digits. Rows of one block (2^8 consecutive ranks of a group) are dealt
together, and then the digits are grouped away one after another, the least first: two siblings
become the children of a struct that holds their digest, so that a whole block is one nested
struct of bounded size. Its root is a leaf of the next layer of blocks. On the way back each
block is unnested level by level with ``transform``, every child taking its siblings' digests along,
and ``explode`` emits the children. A block and what was found above it meet by grouping, not by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import cut, stored

BITS = 8
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def measured(value: Column) -> Column:
    """``-`` for null, else the value as text after its length in bytes, so that no two rows share an encoding."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, lang, leaf, changed): the row's digest, and its digest with one more character counted where ``tampered``."""
    count = F.col("n_chars").cast("decimal(20,0)")
    fields = lambda n: [measured(F.col("doc_id")), measured(F.col("source")), measured(F.col("lang")), measured(n), measured(F.col("text"))]
    leaf = digest(*fields(count))
    touched = F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(touched, digest(*fields(count + 1))).alias("other")).withColumn("changed", F.coalesce("other", "leaf")).drop("other")


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes(group, ...)`` with their rank in the group by ``order`` and the group's depth, the levels above its leaves.

    Nulls come first. Rows are sorted by ranges; a rank is a row's place in its range after the rows of
    the group in earlier ranges, of which a row for each range and group is summed. Rows that tie are told apart
    by a number, so that equal rows spread over ranges too.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in ("group", *order)]
    numbered = stored(nodes.withColumn("tie", F.monotonically_increasing_id()))
    placed = stored(numbered.repartitionByRange(tasks, *keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("place", 33))
    spans = placed.groupBy(F.col("group").alias("_group"), F.col("range").alias("_range")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("_group"))
    depth = F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)
    spans = cut(spans.select("_group", "_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), depth.alias("depth")))
    few = F.broadcast(spans) if spans.count() <= 200_000 else spans  # a row for each range, and for each group more
    found = placed.join(few, F.col("group").eqNullSafe(F.col("_group")) & (F.col("range") == F.col("_range")))
    return found.withColumn("rank", F.col("place") + F.col("shift")).drop("place", "range", "shift", "_group", "_range")


def nested(nodes: DataFrame, layer: int) -> DataFrame:
    """(group, depth, block, node): blocks of 2^BITS consecutive ``nodes(group, depth, rank, node)`` as one struct each.

    Above its depth a group has a single node, which then stands for itself.
    """
    rows = nodes.select("group", "depth", F.shiftright("rank", BITS).alias("block"), F.col("rank").bitwiseAND((1 << BITS) - 1).cast("int").alias("at"), "node")
    rows = rows.repartition("group", "block")  # once: every grouping below finds its rows together
    for level in range(layer * BITS + 1, (layer + 1) * BITS + 1):
        kids = F.array_sort(F.collect_list(F.struct("at", "node")))
        rows = rows.groupBy("group", "depth", "block", F.shiftright("at", 1).alias("up")).agg(kids.alias("kids")).withColumnRenamed("up", "at")
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["hash"]), ""), 256)
        top = F.when(F.lit(level) <= F.col("depth"), joined).otherwise(F.col("kids")[0]["node"]["hash"])
        rows = rows.select("group", "depth", "block", "at", F.struct(top.alias("hash"), F.transform("kids", lambda k: k["node"]).alias("kids")).alias("node"))
    return rows.drop("at")


def children(counts: Column) -> Callable[[Column], Column]:
    """From a row of node and steps to those of its children; where the level ``counts``, each adds its sibling to the steps."""

    def kids(row: Column) -> Column:
        under = row["node"]["kids"]

        def child(kid: Column, i: Column) -> Column:
            before = F.when(i == 1, under[0]["hash"]).otherwise("")
            after = F.when((i == 0) & (F.size(under) == 2), F.get(under, F.lit(1))["hash"]).otherwise("")
            own = F.array(F.struct(before.alias("before"), after.alias("after")))
            return F.struct(kid.alias("node"), F.when(counts, F.concat(own, row["steps"])).otherwise(row["steps"]).alias("steps"))

        return F.transform(under, child)

    return kids


def unnested(blocks: DataFrame, layer: int) -> DataFrame:
    """(group, rank, node, steps, above): the nodes a block was made of, each with the siblings on its way up.

    ``steps`` lists, from the node upwards, what stands before and after it at each level;
    ``above`` is carried along.
    """
    rows = F.array(F.struct("node", "steps"))
    for level in range((layer + 1) * BITS, layer * BITS, -1):
        rows = F.flatten(F.transform(rows, children(F.lit(level) <= F.col("depth"))))
    out = blocks.select("group", "depth", "block", "above", F.posexplode(rows).alias("at", "row"))
    return out.select("group", "depth", (F.shiftleft("block", BITS) + F.col("at")).alias("rank"), F.col("row.node").alias("node"), F.col("row.steps").alias("steps"), "above")


def rolled_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(layers, roots): blocks of ``nodes(group, depth, rank, node)`` layer on layer until each group is one block."""
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    layers = []
    while not layers or levels > BITS * len(layers):
        layers.append(stored(nested(nodes, len(layers))))
        nodes = layers[-1].select("group", "depth", F.col("block").alias("rank"), F.struct(F.col("node.hash").alias("hash")).alias("node"))
    return layers, nodes.select("group", F.col("node.hash").alias("hash"))


def handed_down(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, node, steps, above) for every node below ``tops(group, steps, above)``, by grouping each block with its own top."""
    kind = tops.schema["above"].dataType
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for layer in range(len(layers) - 1, -1, -1):
        down = layers[layer].select("group", "depth", "block", "node", F.lit(None).cast(STEP).alias("steps"), F.lit(None).cast(kind).alias("above"))
        own = tops.select("group", F.lit(None).cast("int").alias("depth"), "block", F.lit(None).cast(layers[layer].schema["node"].dataType).alias("node"), "steps", "above")
        met = down.union(own).groupBy("group", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("depth", "node", "steps", "above")))
        tops = unnested(met, layer).withColumnRenamed("rank", "block")
    return tops.select("group", "node", "steps", "above")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs(doc_id, source, lang, n_chars, text)``.

    Rows of a language ascend by doc_id, nulls first; rows that share a doc_id by their digest, and rows
    equal in all five columns are leaves of their own. Languages ascend bytewise, null first. Where
    ``tampered``, the proof is folded from the digest of a row with n_chars one higher. Whole texts are hashed; empty
    texts and nulls differ. Other columns, whatever their names, do not count. An empty table has an empty manifest.
    """
    rows = leaves(docs, tampered).withColumnRenamed("lang", "group")
    ordered = ranked(rows, ["doc_id", "leaf"])
    layers, subroots = rolled_up(ordered.select("group", "depth", "rank", F.struct(F.col("leaf").alias("hash"), "doc_id", "changed").alias("node")))
    langs = ranked(subroots.select(F.lit(0).alias("group"), F.col("group").alias("lang"), "hash"), ["lang"])
    lang_layers, root = rolled_up(langs.select("group", "depth", "rank", F.struct("hash", "lang").alias("node")))
    top = handed_down(lang_layers, root.select("group", F.array().cast(STEP).alias("steps"), F.col("hash").alias("above")))
    tops = top.select(F.col("node.lang").alias("group"), "steps", F.struct(F.col("node.hash").alias("subroot"), F.col("above").alias("root")).alias("above"))
    found = handed_down(layers, tops)
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate("steps", F.col("node.changed"), lambda so_far, s: digest(s["before"], so_far, s["after"]))
    out = found.select("node.doc_id", F.col("node.hash").alias("leaf"), "above.subroot", "above.root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
