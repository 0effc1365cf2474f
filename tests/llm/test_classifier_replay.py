"""The compression classifier against a replay of its definition without Spark."""

import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard as zstd

from quantloom.llm import compression_classifier
from tests.llm.test_operators import prose


def row_hash(*values):
    """Spark's 64-bit hash of a row: each value under the hash of those before, as signed."""
    h = 42
    for v, width in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(width, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def replay(docs, labels, most_rows, most_blocks, block=512, size=32_768, threshold=0.7):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    seen = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and not held(i):
            seen.setdefault(i, []).append(q)
    known = {i: int(sum(q) > len(q) / 2) for i, q in seen.items() if 2 * sum(q) != len(q)}
    order = {i: row_hash((1, 4), (i, 8)) for i in known}
    taken = {i for k in (0, 1) for i in sorted((i for i in known if known[i] == k), key=lambda i: (order[i], i))[:most_rows]}
    fold = {i: (order[i] % (1 << 64) >> 8) % 2 if order[i] >= 0 else (order[i] >> 8) % 2 for i in taken}
    blocks = {0: [], 1: []}
    for i, text in docs:
        if i in taken and fold[i] == 0:
            raw = (text or "").encode()
            for k in range(max(len(raw) - 1, 0) // block + 1):
                blocks[known[i]].append((row_hash((i, 8), (k, 4)), raw[k * block : (k + 1) * block]))
    samples = {k: [b for _, b in sorted(x)[:most_blocks]] for k, x in blocks.items()}
    least = min(map(len, samples.values()))
    made = []
    for k in (1, 0):
        some = samples[k][: 2 * least]
        try:
            raw = zstd.train_dictionary(max(256, min(size, sum(map(len, some)) // 8)), some).as_bytes()
        except zstd.ZstdError:
            raw = b"".join(some)[:size] or b"\n" * 8
        made.append(zstd.ZstdCompressor(level=compression_classifier.LEVEL, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False))

    def vector(text):
        raw = (text or "").encode()
        good, bad = (sum(len(c.compress(raw[k : k + block])) for k in range(0, len(raw), block)) for c in made)
        d, ratio = 10 * (bad - good) / max(bad, good, 1), good / max(len(raw), 1)
        return [1.0, d, ratio, ratio * ratio, d * abs(d)]

    x = np.array([vector(t) for i, t in docs if i in taken and fold[i] == 1])
    y = np.array([known[i] for i, _ in docs if i in taken and fold[i] == 1], dtype=float)
    w = np.zeros(5)
    for _ in range(200):  # the maximum of the likelihood less 0.0005 w.w, which the Newton steps reach
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(5), x.T @ (y - p) - 1e-3 * w)
    scores = [1 / (1 + np.exp(-np.clip(np.dot(vector(t), w), -30, 30))) for _, t in docs]
    return sorted((str(i), held(i), round(float(s), 6), int(s >= threshold)) for (i, _), s in zip(docs, scores, strict=True))


@pytest.mark.parametrize(("most_rows", "most_blocks"), [(4000, 8000), (25, 30)])
def test_scores_by_replay(spark, most_rows, most_blocks):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(160):
        text = prose(rng, rng.randint(5, 300))
        good = rng.random() < 0.6
        docs.append((i, text if good or rng.random() < 0.1 else text.replace(" ", "%% ")))
        labels.append((i, int(good)))
    docs += [(300, ""), (301, None), (302, "é" * 3000), (5, docs[5][1])]
    labels += [(300, 1), (7, 1 - labels[7][1]), (None, 1), (9, None), labels[3]]
    got = compression_classifier.quality_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), most_rows, most_blocks)
    assert sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 6), r["predicted"]) for r in got.collect()) == replay(docs, labels, most_rows, most_blocks)
