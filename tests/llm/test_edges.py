"""Empty tables and columns with the names that operators use inside."""

from collections import Counter

from pyspark.sql import functions as F

from quantloom.llm import chat, mixing, simhash, url_filter
from quantloom.llm.queries import URL_RULES

URLS = [(1, "http://a.com/en/1"), (2, None), (3, "x://b.net/de/1")]


def verdicts(df):
    return Counter(map(tuple, url_filter.url_verdicts(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()))


def test_url_verdicts_of_nothing_and_of_clashing_columns(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    clash = df.select("*", *(F.lit("z").alias(c) for c in ("host", "path", "rule", "verdict", "key", "listed", "a.b")))
    assert verdicts(clash) == verdicts(df) and verdicts(df.limit(0)) == Counter()


def test_fingerprints_of_nothing_and_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None), (None, "")], "doc_id long, text string")
    clash = df.select("*", *(F.lit(1).cast("long").alias(c) for c in ("fp", "root", "node", "component_id", "fingerprint", "first_id", "a.b")))
    both = [Counter(map(tuple, simhash.near_duplicates(x).collect())) for x in (df, clash)]
    assert both[0] == both[1] and sum(both[0].values()) == 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_conversations_of_nothing_and_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    clash = df.select("*", *(F.lit("z").alias(c) for c in ("tree", "node", "parent", "leaf", "score", "rank", "formatted", "a.b")))
    both = [Counter(map(str, chat.digests(chat.format_trees(chat.as_chain(x))).collect())) for x in (df, clash)]
    assert both[0] == both[1] and chat.digests(chat.format_trees(chat.as_chain(df.limit(0)))).count() == 0


def test_more_sources_than_reach_the_driver(spark):
    """Bins of sources are drawn first: every source still gets its slots, each once, and the same again."""
    goals = spark.createDataFrame([(f"s{k}", 10 + k, 20 + 3 * k) for k in range(40)], "skey string, blocks long, slots long")
    drawn = [mixing.drawn_slots(goals, 64, 17, most_sources=7) for _ in range(2)]
    got = {r["skey"]: (r["n"], r["slots"], r["b"]) for r in drawn[0].groupBy("skey").agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("slots"), F.countDistinct("block").alias("b")).collect()}
    assert got == {f"s{k}": (20 + 3 * k, 20 + 3 * k, 10 + k) for k in range(40)}
    assert sorted(map(str, drawn[0].collect())) == sorted(map(str, drawn[1].collect()))
    sizes = {r["shard"]: r["count"] for r in drawn[0].groupBy("shard").count().collect()}
    assert all(n <= 64 for shard, n in sizes.items() if shard < max(sizes))


def test_rows_of_one_node_are_its_turns(spark):
    rows = [("t", 1, None, "user", "b"), ("t", 1, None, "user", "a"), ("t", 2, 1, "assistant", "c"), ("t", 2, 1, "assistant", "c")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "tree string, node long, parent long, role string, text string, score double")
    for best in (None, 1):
        got = chat.format_trees(df, best=best).withColumn("back", chat.read_back(F.col("formatted"))).collect()
        assert [[t["text"] for t in r["back"]] for r in got] == [["a", "b", "c", "c"]]
