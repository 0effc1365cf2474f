"""Matrices of dates by stocks in blocks: an array of fixed width for each date and block of stocks.

A pivoted column for every stock makes the plan grow with the market; here the stocks' places are data, in a
dictionary of a row each, and the plan is the same for ten stocks and for a hundred thousand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE, DATE = "stock_code", "trade_date"
WIDTH = 256


def places(rows: DataFrame) -> DataFrame:
    """(stock_code, place) from 0 by code: a row a stock, so that one window over all of them is no bottleneck."""
    codes = rows.select(CODE).filter(F.col(CODE).isNotNull()).distinct()
    return codes.withColumn("place", F.row_number().over(Window.orderBy(CODE)) - 1)


def in_slots(cells: str, value: str, kind: str, width: int) -> Column:
    """Sorted structs of slot and values as an array of all slots: nulls fill the gaps, so the work follows the cells."""
    none = F.lit(None).cast(kind)
    before = lambda i: F.when(i > 0, F.get(cells, i - 1)["slot"]).otherwise(-1)
    filled = F.flatten(F.transform(cells, lambda x, i: F.concat(F.array_repeat(none, x["slot"] - before(i) - 1), F.array(x[value]))))
    return F.concat(filled, F.array_repeat(none, width - 1 - F.get(cells, F.size(cells) - 1)["slot"]))


def blocked(rows: DataFrame, values: Sequence[str], dictionary: DataFrame, width: int = WIDTH) -> DataFrame:
    """(trade_date, block, an array for each of ``values``): slot i of block b is the stock of place b * width + i, null where it has no row.

    Of several rows of a date and stock each value takes the greatest; stocks that the dictionary lacks are left out.
    Rows are dealt by date and block once; both groupings are made where they lie.
    """
    kinds = dict(rows.select(*values).dtypes)
    placed = rows.join(dictionary, CODE).select(DATE, F.floor(F.col("place") / width).cast("int").alias("block"), (F.col("place") % width).alias("slot"), *values)
    one = placed.repartition(DATE, "block").groupBy(DATE, "block", "slot").agg(*(F.max(v).alias(v) for v in values))
    gathered = one.groupBy(DATE, "block").agg(F.sort_array(F.collect_list(F.struct("slot", *values))).alias("_cells"))
    return gathered.select(DATE, "block", *(in_slots("_cells", v, kinds[v], width).alias(v) for v in values))


def unblocked(matrix: DataFrame, values: Sequence[str], dictionary: DataFrame, width: int = WIDTH) -> DataFrame:
    """(trade_date, stock_code, values) of the slots that hold any value; a block meets its codes as a whole."""
    places = dictionary.select(F.floor(F.col("place") / width).cast("int").alias("block"), F.struct((F.col("place") % width).alias("slot"), CODE).alias("c"))
    codes = places.groupBy("block").agg(F.sort_array(F.collect_list("c")).alias("_codes")).select("block", in_slots("_codes", CODE, "string", width).alias(CODE))
    slots = matrix.join(codes, "block").select(DATE, F.inline(F.arrays_zip(CODE, *values)))
    some = slots.filter(F.coalesce(*(F.when(F.col(v).isNotNull(), True) for v in values)))
    return some.filter(F.col(CODE).isNotNull()).select(DATE, CODE, *values)


def matrix_lines(rows: DataFrame, value: str, dictionary: DataFrame) -> DataFrame:
    """(year, head, trade_date, line): the matrix as landed text, a header of all codes for each year and a line a date.

    A date's values are put in the order of their places, each behind as many commas as it is places from the one
    before it, so that a line takes time in proportion to its length. Two rows of a date and stock are an error.
    """
    codes = dictionary.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", CODE))), lambda x: x[CODE]).alias("codes"))  # one row
    width = dictionary.agg(F.count(F.lit(1)).cast("int").alias("width"))  # one row
    placed = rows.join(dictionary, CODE).select(DATE, F.struct((F.col("place") + 1).alias("at"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("text")).alias("cell"))
    cells = placed.groupBy(DATE).agg(F.sort_array(F.collect_list("cell")).alias("m")).join(F.broadcast(width))
    before = lambda i: F.when(i > 0, F.get("m", i - 1)["at"]).otherwise(0)
    gap = lambda x, i: F.when(x["at"] > before(i), F.repeat(F.lit(","), x["at"] - before(i))).otherwise(F.raise_error(F.lit("two rows of a date and stock")).cast("string"))
    of = F.array_join(F.transform("m", lambda x, i: F.concat(gap(x, i), x["text"])), "")
    rest = F.repeat(F.lit(","), F.col("width") - F.get("m", F.size("m") - 1)["at"])
    lines = cells.select(F.year(DATE).alias("year"), F.lit(False).alias("head"), DATE, F.concat(F.coalesce(F.col(DATE).cast("string"), F.lit("")), of, rest).alias("line"))
    years = rows.select(F.year(DATE).alias("year")).distinct().join(F.broadcast(codes))
    heads = years.select("year", F.lit(True).alias("head"), F.lit(None).cast("date").alias(DATE), F.concat_ws(",", F.lit(DATE), F.array_join("codes", ",")).alias("line"))
    return lines.union(heads)
