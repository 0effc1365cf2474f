"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to the message they reply to. Jump pointers to the ancestor 2^k replies up are
built by repeated self-joins until no message has one; expanding each leaf by the pointers from
the longest to the shortest then lists its whole path in as many joins as the depth has bits,
with one row per message on a path at any time. Branches are ranked by score, and each chosen
path becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import cut

#: The template, and the strings that are control strings to it or to other common templates (fixed values).
TURN, SEP, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Where a control string begins, its first character is followed by a backslash; backslashes are doubled.
STARTS = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(STARTS), F.lit(r"$0\\"))


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, F.lit(r"([<\[])\\(?!\\)"), F.lit("$1")), F.lit("\\\\"), F.lit("\\"))


def jump_tables(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up): the ancestor 2^k replies up, for k = 0, 1, ... while any message has one."""
    tables = [cut(nodes.filter(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up")))]
    limit = tables[0].groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << (len(tables) - 1)) <= limit:  # a longer chain would be a cycle
        last = tables[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        further = cut(last.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))
        if further.isEmpty():
            break
        tables.append(further)
    return tables


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every message on the path of every leaf, ``up`` replies above it."""
    replied = nodes.filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    at = nodes.join(replied, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    tables = jump_tables(nodes)
    for k in reversed(range(len(tables))):
        step = tables[k].withColumnRenamed("up", "to")
        at = cut(at.union(at.join(step, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), F.col("up") + (1 << k))))
    return at


def ranked(members: DataFrame, best: int | None, salt: int = 64) -> DataFrame:
    """(tree, leaf, rank): branches by mean score, then leaf; only the ``best`` of each tree if given.

    The first cut is taken within salted parts of a tree, so that a tree of many branches does not
    meet in one task; without ``best`` every branch stays and rank is null.
    """
    scores = members.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    if best is None:
        return scores.select("tree", "leaf", F.lit(None).cast("int").alias("rank"))
    order = [F.desc_nulls_last("mean"), F.asc("leaf")]
    part = F.pmod(F.xxhash64("leaf"), F.lit(salt))
    first = scores.withColumn("_r", F.row_number().over(Window.partitionBy("tree", part).orderBy(*order))).filter(F.col("_r") <= best)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).filter(F.col("rank") <= best).select("tree", "leaf", "rank")


def formatted(turns: Column) -> Column:
    """The conversation's text from an array of (role, text) structs."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SEP), escaped(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, learn: str = "assistant") -> Column:
    """Array of (start, length) in code points: where the texts of role ``learn`` lie in the formatted text."""
    wrap = len(TURN) + len(SEP)

    def step(acc, t):
        start = acc["at"] + wrap + F.length(escaped(t["role"]))
        size = F.length(escaped(t["text"]))
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        spans = F.when(t["role"] == learn, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + size + len(END)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """Array of (role, text) structs from a formatted conversation: the inverse of ``formatted``."""
    parts = F.slice(F.split(text, r"<\|end\|>\n"), 1, F.greatest(F.size(F.split(text, r"<\|end\|>\n")) - 1, F.lit(0)))
    pair = lambda p: F.split(F.substring(p, len(TURN) + 1, F.length(p)), r"<\|text\|>")
    return F.transform(parts, lambda p: F.struct(unescaped(F.get(pair(p), F.lit(0))).alias("role"), unescaped(F.get(pair(p), F.lit(1))).alias("text")))


def format_trees(messages: DataFrame, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """tree, leaf, rank, formatted, loss: one row per chosen root-to-leaf path of ``messages``.

    messages(tree, node, parent, role, text, score): node is a long; a parent that is null or unknown
    makes a root. Rows that share a tree and node are turns of that one node, by role and text, under the
    least of their parents. Branches that tie rank by leaf. Null roles and texts are empty; messages of a
    cycle have no leaf and do not appear; texts of any length stay whole, and a path is one row, so its
    turns must fit into one; an empty table gives an empty result.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    once = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    have = once.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    links = once.join(have, ["tree", "parent"], "left")
    links = cut(links.select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("parent")))
    members = paths(links).join(nodes.drop("parent"), ["tree", "node"])
    if best is not None:
        members = members.join(ranked(members, best), ["tree", "leaf"])
    else:
        members = members.withColumn("rank", F.lit(None).cast("int"))
    turn = F.struct(F.negative("up").alias("at"), "role", "text")
    gathered = members.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select("tree", "leaf", "rank", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), learn).alias("loss"))


def as_chain(conversations: DataFrame) -> DataFrame:
    """Messages of ``conversations(conv_id, turn, role, text)``: each row replies to the one before it.

    Rows are ordered by turn (null last), then role and text, so that ties and repeated rows stay. A
    message's score is the length of its text (a chain has one branch, which any score makes the best).
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    n = F.row_number().over(order).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), n.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.length("text").cast("double"))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    turns = read_back(F.col("formatted"))
    masked = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), masked.alias("masked"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
