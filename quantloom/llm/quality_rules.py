"""Quality rules: base counts for each text, then robust multivariate outliers.

The statistics of a text are transformed to a vector; for each language and source a
minimum-covariance-determinant estimate is made from all of its rows. Concentration steps (mean
and covariance of the three quarters of the rows that lie nearest, repeated) run from three fixed
starts, the start of the least determinant goes on, and rows beyond a chi-square quantile of the
Mahalanobis distance are rejected. An estimate is shrunk toward that of its language, and that
one toward all rows, with a weight that falls smoothly with the number of rows, so that a small
group is judged by what is known of it and no size turns a rule on or off. Every step is one
grouped aggregate over all rows; only sums leave a task, so a source that holds a third of all
rows is no hot spot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, whole_row

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SPACES = b" \t\n\r\x0b\x0c"
#: What counts as measurement noise of each statistic (a standard deviation, added to every covariance): a few symbols, a repeated
#: line or a number more or less in a text of usual length. Statistics that most texts have at zero have no spread of their own,
#: and without this their covariance would be singular and one symbol an outlier.
FLOORS = {"v_symbols": 0.05, "v_length": 0.08, "v_lines": 0.05, "v_repeats": 0.05, "v_upper": 0.06, "v_digits": 0.06}
DIMS = list(FLOORS)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def count_text(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(re.sub(rb"[\x80-\xbf]+", b"", text.translate(None, SPACES))) if not text.isascii() else len(text.translate(None, SPACES))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    upper = len(text) - len(text.translate(None, UPPER))
    digits = len(text) - len(text.translate(None, DIGITS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, digits


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")


def text_counts(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """(carried, lang, source, counts) for each row of ``docs``; ``carry`` is by default the doc_id. Null text counts as empty."""
    carried = (F.col("doc_id").cast("long") if carry is None else carry).alias("carried")
    slim = docs.select(carried, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    fields = slim.drop("text").schema
    for name in COUNTS:
        fields = fields.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pa.array(x, pa.int64()) for x in zip(*map(count_text, b.column(3).to_pylist()), strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *found], names=fields.names)

    return slim.mapInArrow(run, fields)


def vectors(counts: DataFrame) -> DataFrame:
    """Adds the transformed statistics; ratios are shrunk so that short texts do not stand out by chance."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.col("word_chars") + 100
    return counts.withColumns(
        {
            "v_symbols": F.log1p(F.col("n_symbols") / (n + 5)),
            "v_length": F.log((F.col("word_chars") + 250) / (n + 50)),
            "v_lines": F.col("n_dup_lines") / (F.col("n_lines") + 5),
            "v_repeats": F.col("n_repeat_words") / n,
            "v_upper": F.col("n_upper") / chars,
            "v_digits": F.col("n_digits") / chars,
        }
    )


def chi2_quantile(q: float, p: int) -> float:
    """Wilson-Hilferty approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def chi2_cdf(x: float, p: int) -> float:
    return NormalDist().cdf(((x / p) ** (1 / 3) - 1 + 2 / (9 * p)) / (2 / (9 * p)) ** 0.5)


#: Tables of a row per group are broadcast up to this many groups (some 400 bytes each), and joined by a shuffle beyond.
BROADCAST_GROUPS = 10_000


#: Tasks that a table of a row per group is gathered in, so that each of the many small steps is a few tasks and files.
FEW_TASKS = 8


def gathered(groups: DataFrame) -> DataFrame:
    """A table of a row per group (and start), checkpointed in few parts."""
    return cut(groups.coalesce(FEW_TASKS))


def beside(groups: DataFrame) -> DataFrame:
    """``groups``, checkpointed, for a join on the group: broadcast if few, so that a large group is not dealt to one task."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``grp``: the row's language and source; nulls are groups of their own."""
    lang, source = (F.coalesce(c, F.lit("\0")) for c in ("lang", "source"))
    return rows.withColumn("grp", F.concat_ws("\t", F.lit("source"), lang, source))


def language_of(grp: Column) -> Column:
    return F.concat_ws("\t", F.lit("language"), F.split(grp, "\t")[1])


EVERYTHING = "all"


def distance(dims: list[str]) -> Column:
    """Squared Mahalanobis distance to the row's ``mu`` under its ``prec`` (row-major inverse covariance)."""
    p = len(dims)
    d = [F.col(x) - F.col("mu")[i] for i, x in enumerate(dims)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + F.col("prec")[i * p + j] * d[i] * d[j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def moments_of(rows: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """(keys, n, mean, cov): row-major covariance over ``rows``, by one aggregate."""
    p = len(dims)
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(dims)]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p{i}_{j}") for i, x in enumerate(dims) for j, y in enumerate(dims) if j >= i]
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    cov = [F.col(f"p{min(i, j)}_{max(i, j)}") / F.col("n") - mean[i] * mean[j] for i in range(p) for j in range(p)]
    return got.select(*keys, "n", F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))


def inverted(floors: list[float], factor: float):
    """Pandas UDF: covariance -> inverse and log determinant of it rescaled, with the floors added."""
    noise = np.diag(np.square(floors))

    @F.pandas_udf("prec array<double>, logdet double")
    def solve(cov: pd.Series) -> pd.DataFrame:
        full = [factor * np.asarray(c).reshape(noise.shape) + noise for c in cov]
        return pd.DataFrame({"prec": [np.linalg.inv(c).ravel() for c in full], "logdet": [np.linalg.slogdet(c)[1] for c in full]})

    return solve


def consistency(support: float, p: int) -> float:
    """What the covariance of the nearest ``support`` of normal rows must be multiplied by."""
    return support / chi2_cdf(chi2_quantile(support, p), p + 2)


def concentrated(rows: DataFrame, est: DataFrame, keys: list[str], dims: list[str], support: float, solve) -> DataFrame:
    """One concentration step for each row of ``est(keys, mu, prec)``, checkpointed: (keys, n, mean, cov, mu, prec, logdet).

    Distances are compared after rounding, so that what the quantile's aggregate holds is bounded.
    """
    far = F.round(F.log1p(distance(dims)), 3)
    near = rows.join(beside(est.select(*keys, "mu", "prec")), "grp").withColumn("far", far)
    limit = gathered(near.groupBy(*keys).agg(F.percentile("far", support).alias("limit")))
    kept = rows.join(beside(gathered(est.select(*keys, "mu", "prec").join(limit, keys))), "grp").filter(far <= F.col("limit"))
    got = moments_of(kept, keys, dims).withColumn("e", solve("cov"))
    return gathered(got.select(*keys, "n", "mean", "cov", F.col("mean").alias("mu"), "e.prec", "e.logdet"))


def mcd_estimates(rows: DataFrame, floors: dict[str, float] = FLOORS, support: float = 0.75, first_steps: int = 2, steps: int = 4) -> DataFrame:
    """(grp, n, mean, cov) of the nearest ``support`` of each ``grp`` of ``rows``, from all of its rows.

    Starts: medians with quartile spreads; mean and covariance of all rows; and of those within the medians' inner half.
    Quantiles are exact over values rounded to 0.001.
    """
    dims, p = list(floors), len(floors)
    solve = inverted(list(floors.values()), consistency(support, p))
    quartiles = rows.groupBy("grp").agg(*(F.percentile(F.round(x, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in dims))
    spread = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(f)) for x, f in floors.items()]
    diag = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    middle = gathered(quartiles.select("grp", F.lit(0).alias("start"), F.array(*(F.col(x)[1] for x in dims)).alias("mu"), F.array(*diag).alias("prec")))
    every = moments_of(rows.withColumn("start", F.lit(1)), ["grp", "start"], dims)
    inner = concentrated(rows, middle.withColumn("start", F.lit(2)), ["grp", "start"], dims, 0.5, solve)
    every = every.withColumn("e", solve("cov")).select("grp", "start", F.col("mean").alias("mu"), "e.prec")
    est = gathered(middle.unionByName(every).unionByName(inner.select("grp", "start", "mu", "prec")))
    for _ in range(first_steps):
        est = concentrated(rows, est, ["grp", "start"], dims, support, solve)
    # determinants that agree but for rounding are a tie, which goes to the first start
    est = gathered(est.groupBy("grp").agg(F.min_by(F.struct("mu", "prec"), F.struct(F.round("logdet", 6), "start")).alias("b")).select("grp", "b.mu", "b.prec"))
    for _ in range(steps):
        est = concentrated(rows, est, ["grp"], dims, support, solve)
    return est.select("grp", "n", "mean", "cov")


def shrunk(small: DataFrame, large: DataFrame, weight: float) -> DataFrame:
    """``small(grp, part, n, mean, cov)`` toward ``large(part, mean, cov)``, which counts as ``weight`` rows."""
    wide = large.select("part", F.col("mean").alias("mean_2"), F.col("cov").alias("cov_2"))
    share = F.col("n") / (F.col("n") + weight)
    blend = lambda a, b: F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)
    return small.join(wide, "part").select("grp", "n", blend("mean", "mean_2").alias("mean"), blend("cov", "cov_2").alias("cov"))


def judges(rows: DataFrame, support: float, shrink_rows: float) -> DataFrame:
    """(grp, mu, prec) for each language and source of ``rows``: its estimate shrunk toward its language's and that toward that of all."""
    rows = rows.coalesce(max(FEW_TASKS, rows.count() // 50_000))  # numbers alone: some 5 MB a task
    levels = F.array("grp", language_of(F.col("grp")), F.lit(EVERYTHING))
    est = mcd_estimates(rows.select(F.explode(levels).alias("grp"), *DIMS), support=support)
    whole = est.filter(F.col("grp") == EVERYTHING).withColumn("part", F.lit(EVERYTHING))
    tongues = est.filter(F.col("grp").startswith("language")).withColumn("part", F.lit(EVERYTHING))
    tongues = shrunk(tongues, whole, shrink_rows).withColumn("part", F.col("grp"))
    groups = shrunk(est.filter(F.col("grp").startswith("source")).withColumn("part", language_of(F.col("grp"))), tongues, shrink_rows)
    solve = inverted(list(FLOORS.values()), consistency(support, len(DIMS)))
    return gathered(groups.withColumn("e", solve("cov")).select("grp", F.col("mean").alias("mu"), "e.prec"))


def judged(counts: DataFrame, judge: DataFrame, quantile: float) -> DataFrame:
    """``counts`` plus base_failed, kept and distance."""
    rows = with_base(counts)
    seen = rows.join(beside(judge), "grp", "left").withColumn("distance", distance(DIMS))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(quantile, len(DIMS)), F.lit(True))
    return seen.withColumn("kept", kept)


def with_base(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return grouped(vectors(counts)).withColumn("base_failed", failed)


def quality_verdicts(docs: DataFrame, shrink_rows: float = 100.0, quantile: float = 1 - 1e-6, support: float = 0.75) -> DataFrame:
    """Counts and verdict for every row of ``docs(doc_id, text, lang, source)``.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows; such rows
    do not count in any estimate. kept: not base_failed and within the chi-square ``quantile`` of
    the robust distance of its language and source, whose estimate is shrunk as if ``shrink_rows``
    more rows were as its language's. Null text is empty; null language or source is a group of
    its own. Texts of any length are counted whole. Repeated rows each get the same verdict; other columns are ignored; an empty table
    gives an empty result.
    """
    counts = cut(text_counts(docs))
    judge = judges(with_base(counts).filter(~F.col("base_failed")), support, shrink_rows)
    out = judged(counts, judge, quantile)
    return out.select(F.col("carried").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def accepted(docs: DataFrame, shrink_rows: float = 100.0, quantile: float = 1 - 1e-6, support: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; texts are counted again and not shuffled."""
    counts = cut(text_counts(docs.withColumn("doc_id", F.lit(0)) if "doc_id" not in docs.columns else docs))
    judge = judges(with_base(counts).filter(~F.col("base_failed")), support, shrink_rows)
    return judged(text_counts(docs, whole_row(docs)), judge, quantile).filter("kept").select("carried.*")
