"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each text becomes the minima of its ``k``-gram hashes over every run of ``w`` consecutive
k-grams. Any span of ``k + w - 1`` words that two texts share contains one whole run, whose
minimum both keep, so no shared window can be missed. Fingerprints of the documents are joined
with the benchmark's to find candidates; only those texts are read again, and around every
fingerprint they share with an item the windows are compared whole, so that a hit is extended
as far as the item goes. Texts are never shuffled while the candidates' keys are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, folded, row_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column | str) -> Column:
    return F.array_remove(F.split(folded(text), SEPARATORS), "")


def shifted(xs: Column, by: int) -> Column:
    return F.slice(xs, by + 1, 1 << 30)


def joined_hash(left: Column, right: Column, by: int, n: int) -> Column:
    """Hashes of runs of ``n`` words from the hashes at each place and ``by`` places on; the tail is to be cut."""
    return F.zip_with(left, shifted(right, by), lambda a, b: F.xxhash64(a, b, F.lit(n)))


def first(xs: Column, n: Column) -> Column:
    return F.slice(xs, 1, F.greatest(n, F.lit(0)))


def with_grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds ``_gram<n>`` for each of ``sizes``: hashes of the runs of n ``words`` at each place, built by joining shorter runs; tails are to be cut.

    Intermediate arrays are columns of their own, so that each is computed once.
    """
    for n in sizes:
        if f"_gram{n}" in df.columns:
            continue
        if n == 1:
            df = df.withColumn("_gram1", F.transform("words", lambda x: F.xxhash64(x)))
        else:
            p = 1 << ((n - 1).bit_length() - 1)
            df = with_grams(df, [p, n - p])
            df = df.withColumn(f"_gram{n}", joined_hash(F.col(f"_gram{p}"), F.col(f"_gram{n - p}"), p, n))
    return df


def grams(n: int) -> Column:
    return first(F.col(f"_gram{n}"), F.size("words") - (n - 1))


def winnowed(df: DataFrame, k: int, w: int, short: list[int]) -> DataFrame:
    """Adds ``fps`` for ``words``: the winnowed k-gram hashes, and all n-gram hashes for each n of ``short``.

    Read ``fps`` by explode_outer: explode would infer a filter, which is pushed down with all of its inputs inlined.
    """
    df = with_grams(df, [k])
    minima, width = f"_gram{k}", 1
    while width < w:
        step = min(width, w - width)
        width += step
        df = df.withColumn(f"_min{width}", F.zip_with(F.col(minima), shifted(F.col(minima), step), lambda a, b: F.least(a, b)))
        minima = f"_min{width}"
    df = with_grams(df, short)
    parts = [first(F.col(minima), F.size("words") - (k + w - 2)), *map(grams, short)]
    return df.withColumn("fps", F.array_distinct(F.concat(*parts)))


def benchmark_items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, words, width) for each row that has words; width is ``window`` or the whole shorter item."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_list("text").alias("words")).filter(F.size("words") > 0)
    return words.withColumn("width", F.least(F.lit(window), F.size("words"))).distinct()


def fingerprints_of_items(items: DataFrame, k: int, w: int, short: list[int]) -> DataFrame:
    """(fp, item): winnowed fingerprints of items of full width; a shorter item's whole n-gram hash."""
    out = winnowed(items.filter(F.col("width") == k + w - 1), k, w, []).select(F.explode_outer("fps").alias("fp"), "item")
    for n in short:
        out = out.union(with_grams(items.filter(F.col("width") == n), [n]).select(F.explode_outer(grams(n)).alias("fp"), "item"))
    return out.distinct()


def windows_at(words: Column, places: Column, width: int) -> Column:
    """Structs (at, window) of the runs of ``width`` words at ``places``."""
    return F.transform(places, lambda j: F.struct(j.alias("at"), F.array_join(F.slice(words, j + 1, F.lit(width)), " ").alias("window")))


def windows_of_items(items: DataFrame, widths: list[int]) -> DataFrame:
    """(width, window, item) of all windows of the items, each once."""
    out = None
    for n in widths:
        some = items.filter(F.col("width") == n).select(F.lit(n).alias("width"), F.explode_outer(windows_at(F.col("words"), F.sequence(F.lit(0), F.size("words") - n), n)["window"]).alias("window"), "item")
        out = some if out is None else out.union(some)
    return out.distinct()


def near_marks(width: int, k: int, window: int, marked: Column) -> Column:
    """Places where a window of ``width`` words can begin: it holds a marked k-gram (or is, for shorter items, itself marked)."""
    back = window - k if width == window else 0
    around = F.flatten(F.transform(marked, lambda p: F.sequence(F.greatest(F.lit(0), p - back), p)))
    return F.array_distinct(F.filter(around, lambda s: s <= F.size("words") - width))


def extended(texts: DataFrame, marks: DataFrame, windows: DataFrame, k: int, window: int, short: list[int], few_marks: bool, few_windows: bool) -> DataFrame:
    """(id, key, item, at, width): every place of a text at which a window of an item occurs.

    ``texts(id, key, words)`` are the candidates. Their k-grams are posted by place and joined with the
    items' fingerprints, and whole windows around the places found are joined with the items' own.
    """
    out = None
    for n in [window, *short]:
        size = k if n == window else n
        posted = with_grams(texts, [size]).select("id", "key", F.posexplode_outer(grams(size)).alias("place", "fp"))
        seeds = posted.join(side(marks.select("fp").distinct(), few_marks), "fp", "left_semi").groupBy("id", "key").agg(F.collect_set("place").alias("marked"))
        near = texts.join(cut(seeds), ["id", "key"]).withColumn("starts", near_marks(n, k, window, F.col("marked")))
        shown = near.select("id", "key", F.inline_outer(windows_at(F.col("words"), F.col("starts"), n)))
        found = shown.join(side(windows.filter(F.col("width") == n), few_windows), "window").select("id", "key", "item", "at", "width")
        out = found if out is None else out.union(found)
    return out


def side(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A window is ``window`` consecutive words of an item of ``benchmark(item_id, text)``, or a
    shorter item whole. Null texts have no words; items without words never occur; a null item_id
    is named by the empty string; repeated items count once; repeated documents each get their
    row; other columns are ignored; an empty table of documents gives an empty result, an empty
    benchmark no hits. Fingerprints, windows and candidates are broadcast each only up to
    ``broadcast_rows`` rows of its own; beyond that the join shuffles.
    """
    w = window - k + 1
    items = cut(benchmark_items(benchmark, window))
    short = [r[0] for r in items.filter(F.col("width") < window).select("width").distinct().orderBy("width").collect()]  # at most window - 1 numbers
    marks = cut(fingerprints_of_items(items, k, w, short))
    windows = cut(windows_of_items(items, [window, *short]))
    few_marks, few_windows = marks.count() <= broadcast_rows, windows.count() <= broadcast_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), row_key("doc_id", "text").alias("key"), "text")
    # each row also posts a null, which one row of the other side takes: so its words are counted here, and repeated rows too
    listed = marks.select("fp", F.lit(1).alias("mark")).distinct().unionByName(docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("mark")))
    posted = winnowed(rows.withColumn("words", word_list("text")), k, w, short)
    posted = posted.select("doc_id", "id", "key", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.array_prepend("fps", F.lit(None).cast("long"))).alias("of"))
    met = posted.join(side(listed, few_marks), F.col("of").eqNullSafe(F.col("fp")))
    seen = cut(met.groupBy("doc_id", "id", "key", "n_words").agg(F.count(F.when(F.col("mark") == 0, 1)).alias("copies"), F.max("mark").alias("mark")))

    wanted = seen.filter("mark = 1").select("id", "key")
    texts = rows.select("id", "key", "text").join(side(wanted, wanted.count() <= broadcast_rows), ["id", "key"], "left_semi")
    texts = cut(texts.dropDuplicates(["id", "key"]).select("id", "key", word_list("text").alias("words")))
    hits = extended(texts, marks, windows, k, window, short, few_marks, few_windows)
    places = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1))
    n_hit = hits.select("id", "key", places.alias("p")).distinct().groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.join(named, ["id", "key"])
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return seen.join(found, ["id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        names.alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
