"""Quality classifier from compressed sizes.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is cut into
blocks that are compressed under each; the difference of the summed sizes, normalised by their
size, tells which kind the text resembles, and a logistic fit on other labelled rows turns it
(with the size per byte, since repetition compresses under either) into a probability.
"""

from __future__ import annotations

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, held_out, map_rows

LEVEL = 3


def dictionary(blocks: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples to train on serve as raw content."""
    total = sum(map(len, blocks))
    try:
        return zstd.train_dictionary(max(256, min(size, total // 8)), blocks).as_bytes()
    except zstd.ZstdError:
        return b"".join(blocks)[:size] or b"\n" * 8


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstd.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstd.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: bytes | None, under: list[zstd.ZstdCompressor], block: int) -> tuple[int, int, int]:
    """(bytes, compressed under the good, under the bad dictionary), over all blocks of the whole text."""
    text = text or b""
    good, bad = under
    cuts = [text[i : i + block] for i in range(0, len(text), block)]
    return len(text), sum(len(good.compress(c)) for c in cuts), sum(len(bad.compress(c)) for c in cuts)


def features(raw: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    d = 10 * (bad - good) / np.maximum(np.maximum(bad, good), 1)
    ratio = good / np.maximum(raw, 1)
    return np.stack([np.ones_like(d), d, ratio, ratio**2, d * np.abs(d)], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(labels: DataFrame, most: int, mod: int, rest: int) -> DataFrame:
    """(doc_id, label, fold): up to ``most`` labelled rows of each class, by a hash of the id, never held-out ones.

    Rows that repeat an id are one; an id with as many labels of either kind has none.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(mod, rest))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("mean")).filter("mean != 0.5")
    known = known.select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"), F.xxhash64(F.lit(1), "doc_id").alias("h"))
    parts = [known.filter(F.col("label") == k).orderBy("h", "doc_id").limit(most) for k in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "label", F.pmod(F.shiftright("h", 8), F.lit(2)).alias("fold"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_blocks: int = 8000, block: int = 512, dictionary_bytes: int = 32_768, threshold: float = 0.7, mod: int = 4, rest: int = 2
) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``.

    Learning reads at most ``most_rows`` labelled rows of each class and ``most_blocks`` blocks of
    each (half of the rows make the dictionaries, half calibrate); these bounds are all that
    reaches the driver. Scoring reads every whole text. Null texts are empty; an empty text gets
    what the fit gives for no evidence; where a class has no rows, every score is 0.5. Repeated
    rows get the same score; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = cut(training_rows(labels, most_rows, mod, rest))
    known = slim.join(F.broadcast(rows), "doc_id")  # at most 2 * most_rows ids
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / block).cast("int"))
    blocks = known.filter("fold = 0").select("doc_id", "label", "text", F.explode(places).alias("k"))
    blocks = blocks.select("label", F.expr(f"substring(text, k * {block} + 1, {block})").alias("b"), F.xxhash64("doc_id", "k").alias("h"))
    samples = {k: [bytes(r["b"]) for r in blocks.filter(F.col("label") == k).orderBy("h", "b").limit(most_blocks).collect()] for k in (0, 1)}
    least = min(map(len, samples.values()))
    trained = tuple(dictionary(samples[k][: 2 * least], dictionary_bytes) for k in (1, 0)) if least else None

    def measure(frame: DataFrame, extra: list[str], schema: str, finish) -> DataFrame:
        made: list = []

        def work(*columns):
            if not made:
                made.append(compressors(trained))
            raw, good, bad = (np.array(x, dtype=float) for x in zip(*(sizes(t, made[0], block) for t in columns[-1]), strict=True)) if columns[-1] else (np.zeros(0),) * 3
            return (*columns[:-1], *finish(raw, good, bad))

        return map_rows(frame.select(*extra, "text"), work, schema)

    weights = None
    if trained:
        got = measure(known.filter("fold = 1"), ["label"], "label int, raw double, good double, bad double", lambda *x: [v.tolist() for v in x]).collect()
        y = np.array([r["label"] for r in sorted(got)], dtype=float)
        if 0 < y.sum() < len(y):
            weights = fitted(features(*(np.array([r[k] for r in sorted(got)]) for k in ("raw", "good", "bad"))), y)
    if weights is None:
        scored = slim.select("doc_id", F.lit(0.5).alias("score"))
    else:
        prob = lambda *x: [(1 / (1 + np.exp(-np.clip(features(*x) @ weights, -30, 30)))).tolist()]
        scored = measure(slim, ["doc_id"], "doc_id long, score double", prob)
    return scored.select("doc_id", held_out(mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
