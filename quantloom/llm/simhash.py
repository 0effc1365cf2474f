"""SimHash fingerprints and near-duplicate groups through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight
positional bytes, the guaranteed minimum of the count filter. A posting of one byte holds a
256th of all fingerprints, so tallying such postings pair by pair would emit a number of rows
that grows with the square of the corpus. The tally is therefore made part of the key: the
index posts each distinct fingerprint under its 28 six-byte position subsets, and a pair
meets in one of them exactly when its tally is six or more. A posting leaves two bytes free, so
it holds 65,536 fingerprints at most, however many copies there are; its members are
verified bit by bit inside one row and leave as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, map_rows
from quantloom.llm.components import connected_components

BYTES = 8


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """XXH64 (seed 42) of each word shingle, in order; of all words where they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return [digest(line, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    return [digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles (XXH64, seed 42)."""
    return majority(shingle_hashes(text, width))


def majority(hashes: list[int]) -> int:
    """Signed 64-bit SimHash of shingle hashes: a bit is 1 if set in over half of them; none: zero."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):  # bits as bytes, a bounded block at a time
        ones += np.unpackbits(h[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs(doc_id, text)``; no words: zero."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_rows(slim, lambda ids, texts: (ids, [fingerprint(t, width) for t in texts]), "doc_id long, fp long")


def byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def postings(fps: DataFrame, shared: int) -> DataFrame:
    """(subset, key, free, fp): every subset of ``shared`` positions; key packs its bytes, free the others."""
    fp = F.col("fp")
    rows = []
    for k, subset in enumerate(combinations(range(BYTES), shared)):
        key, free = F.lit(0).cast("long"), F.lit(0).cast("long")
        for p in range(BYTES):
            if p in subset:
                key = F.shiftleft(key, 8).bitwiseOR(byte(fp, p))
            else:
                free = F.shiftleft(free, 8).bitwiseOR(byte(fp, p))
        rows.append(F.struct(F.shiftleft(F.lit(k).cast("long"), 8 * shared).bitwiseOR(key).alias("key"), free.cast("int").alias("free")))
    return fps.select("fp", F.inline(F.array(*rows)))


def forest(free: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (``bits`` differing bits or fewer) among distinct 16-bit values, as index pairs."""
    n = len(free)
    if n == 2:
        return [(0, 1)] if int(free[0] ^ free[1]).bit_count() <= bits else []
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    if n <= 256:
        near = np.bitwise_count(free[:, None] ^ free[None, :]) <= bits
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            join(int(i), int(j))
        return out
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[free] = np.arange(n)
    for flips in (sum(1 << b for b in c) for r in range(1, bits + 1) for c in combinations(range(16), r)):
        other = place[free ^ flips]
        hit = np.nonzero(other > np.arange(n))[0]
        for i in hit:
            join(int(i), int(other[i]))
    return out


def near_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links that connect all distinct ``fps(fp)`` differing in ``bits`` bits or fewer (at most two).

    Not every such pair is listed, but every one is connected by the rows listed.
    """
    shared = BYTES - bits
    distinct = fps.select("fp").distinct()
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out evenly first: 28 postings are made of each row, too much for the few tasks that so narrow a table is read in
    lists = postings(distinct.repartition(tasks), shared).groupBy("key").agg(F.collect_list(F.struct("free", "fp")).alias("m")).filter(F.size("m") > 1)
    slim = lists.select(F.col("m.free").alias("free"), F.col("m.fp").alias("fp"))

    def verify(frees, members):
        a, b = [], []
        for free, fp in zip(frees, members, strict=True):
            for i, j in forest(np.array(free, dtype=np.int64), bits):
                a.append(fp[i])
                b.append(fp[j])
        return a, b

    return map_rows(slim, verify, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs(doc_id, text)``.

    component_id is the least doc_id reachable over links of ``bits`` differing bits or fewer.
    Null and empty texts have fingerprint zero, which links like any other; repeated rows stay;
    a null doc_id takes part but never names a component unless all of its members are null;
    texts of any length are read whole, their bits summed in blocks of 65,536 shingles;
    other columns are ignored; an empty table gives an empty result.
    """
    if not 1 <= bits <= 2:
        raise ValueError("bits must be 1 or 2: a posting must leave no more than two bytes free")
    fps = cut(fingerprints(docs, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(near_links(distinct, bits))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = named.join(least, "root").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
