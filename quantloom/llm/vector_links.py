"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, and exact cosines inside buckets.

Between unit vectors a cosine is a Euclidean distance, so each table rounds a few Gaussian projections of
a vector to bins of one width and hashes the bins to a bucket. The number of projections follows from the number
of rows (so that a bucket holds few strangers), and the number of tables from the chance at the threshold itself
that a pair is missed in all of them, which is bounded at every size.

Equal vectors of a label are one representative with a count. Members of a bucket are compared in
blocks of bounded size: first by sketches (eight orthonormal projections in a byte each, whose distance never
exceeds that of the vectors), and those with a partner left by their whole vectors. A pair that meets in several
tables counts in the first. What leaves a block is a count for each vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, stored, wider, with_groups
from quantloom.llm.components import connected_components

#: Width of a bin, in standard deviations of a unit vector's projection; strangers an average bucket may hold; rows of a block.
BIN, STRANGERS, BLOCK = 2.0, 4.0, 256
SKETCH, UNIT = 8, 127


def collision(distance: float) -> float:
    """Chance that two points at a distance fall into one bin of a projection."""
    t = BIN / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def table_sizes(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(projections a table, tables) for ``n`` comparable rows: a pair at ``cosine`` is missed with chance ``miss`` at most."""
    k = max(1, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(collision(math.sqrt(2)))))
    met = collision(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(miss) / math.log(1 - met)))


def usable() -> Column:
    """Rows that can link: a label, and a vector of finite components not all zero."""
    infinite = F.lit(float("inf"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return F.coalesce(F.col("label").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashed(reps: DataFrame, k: int, tables: int, seed: int = 42) -> DataFrame:
    """``reps`` with ``keys``, a 32-bit bucket for each table, and ``sketch``; vectors of another length have other projections."""
    at = reps.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for b in batches:
            lengths = b.column(at).value_lengths().to_numpy()
            for d in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == d))
                if d not in made:
                    rng = np.random.default_rng([seed, d])
                    basis = np.linalg.qr(rng.normal(size=(d, min(SKETCH, d))))[0]
                    made[d] = rng.normal(size=(d, k * tables)), rng.uniform(0, BIN, k * tables), rng.integers(0, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), basis
                ways, shift, odd, basis = made[d]
                x = unit_rows(part.column(at).flatten().to_numpy(zero_copy_only=False), part.num_rows)
                bins = np.floor((x @ ways + shift) / BIN).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
                h = (bins * odd).sum(axis=2, dtype=np.uint64)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                keys = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                bytes_ = np.zeros((len(x), SKETCH), dtype=np.int8)
                bytes_[:, : basis.shape[1]] = np.rint(x @ basis * UNIT).astype(np.int8)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
                columns = [pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array(bytes_.view(np.int64)[:, 0])]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "keys", "sketch"])

    return reps.mapInArrow(run, wider(reps, "keys array<int>, sketch long"))


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the graph of a symmetric boolean matrix."""
    left, out = np.ones(len(near), dtype=bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            new = np.nonzero(near[i] & left)[0]
            left[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


def comparable(side: np.ndarray, group: pa.StructScalar) -> np.ndarray:
    """Pairs to compare: all others inside one block, across the sides between two."""
    same = group["a"].as_py() == group["b"].as_py()
    return ~np.eye(len(side), dtype=bool) if same else side[:, None] != side[None, :]


def lists(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    """Rows of the batch with their last column, a list of structs, as an Arrow array."""
    members = batch.column(batch.num_columns - 1)
    for i in range(batch.num_rows):
        yield i, members[i].values


def promising(groups: DataFrame, distance: float) -> DataFrame:
    """(group, rid, side) of the members whose sketch has another one near enough in a group of ``groups(group, m)``."""
    most = (UNIT * distance + math.sqrt(SKETCH)) ** 2 + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, rids, sides = [], [], []
            for i, m in lists(b):
                s = m.field("sketch").to_numpy(zero_copy_only=False).view(np.int8).reshape(len(m), SKETCH).astype(np.float32)
                side = m.field("side").to_numpy(zero_copy_only=False)
                norm = (s * s).sum(axis=1)
                near = (norm[:, None] + norm[None, :] - 2 * s @ s.T <= most) & comparable(side, b.column(0)[i])  # sums of small integers: exact
                hit = np.nonzero(near.any(axis=1))[0]
                rows += [i] * len(hit)
                rids.append(m.field("rid").to_numpy(zero_copy_only=False)[hit])
                sides.append(side[hit])
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate(rids)), pa.array(np.concatenate(sides))], names=["group", "rid", "side"])

    return groups.mapInArrow(run, wider(groups.select("group"), "rid long, side boolean"))


def verified(groups: DataFrame, cosine: float) -> DataFrame:
    """(rid, n, other) for every member with a link that counts here: the rows behind its partners, and an edge of the forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, m in lists(b):
                x = unit_rows(m.field("embedding").flatten().to_numpy(zero_copy_only=False), len(m))
                near = (x @ x.T >= cosine) & comparable(m.field("side").to_numpy(zero_copy_only=False), b.column(0)[i])
                keys = m.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
                for t in range(b.column(0)[i]["table"].as_py()):  # pairs that met in an earlier table count there
                    near &= keys[:, t, None] != keys[None, :, t]
                rid, rows = m.field("rid").to_numpy(zero_copy_only=False), m.field("rows").to_numpy(zero_copy_only=False)
                n = near @ rows
                hit = np.nonzero(near.any(axis=1))[0]
                out[0].extend(rid[hit].tolist())
                out[1].extend(n[hit].tolist())
                out[2].extend([None] * len(hit))
                for a, c in spanning(near):
                    out[0].append(int(rid[a]))
                    out[1].append(0)
                    out[2].append(int(rid[c]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["rid", "n", "other"])

    return groups.mapInArrow(run, "rid long, n long, other long")


def links(reps: DataFrame, cosine: float, miss: float) -> DataFrame:
    """(rid, n, other) as of ``verified`` over all tables, for stored ``reps(rid, label, embedding, rows)``."""
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    whole = stored(hashed(reps, *table_sizes(largest, cosine, miss)))
    bucket = F.struct("label", F.size("embedding").alias("length"), F.col("table"), F.col("key"))
    probes = whole.select("rid", "sketch", "label", "embedding", F.posexplode("keys").alias("table", "key")).select(bucket.alias("bucket"), "rid", "sketch")
    counts = cut(probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    dealt = with_groups(probes, counts, "bucket", "n").select("bucket", "rid", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    group = F.struct("bucket.*", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).alias("group")
    members = dealt.select(group, "rid", "sketch", (F.col("own") <= F.col("other")).alias("side"))
    # a member of a block meets its own block once, with both on one side
    first = promising(members.groupBy("group").agg(F.collect_list(F.struct("rid", "sketch", "side")).alias("m")), math.sqrt(2 - 2 * cosine))
    first = cut(first)
    asked = cut(first.select("rid").distinct())
    few = F.broadcast(asked) if asked.count() <= 2_000_000 else asked
    vectors = stored(whole.join(few, "rid").select("rid", "embedding", "keys", "rows"))
    pairs = first.join(vectors, "rid").groupBy("group").agg(F.collect_list(F.struct("rid", "side", "embedding", "keys", "rows")).alias("m"))
    return verified(pairs, cosine)


def near_duplicates(rows: DataFrame, cosine: float = 0.98, miss: float = 1e-5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows(vec_id, embedding, label)``.

    Rows link if their labels are equal and the cosine of their vectors is ``cosine`` or more; a pair at just that
    cosine is missed with chance ``miss`` at most, a closer one less often, equal vectors never. Rows without a
    label, and vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Repeated rows link with each other. A null id counts as a link; it names no component
    unless all ids of it are null, and then the row is kept. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.concat_ws(" ", F.col("label").cast("string"), F.col("embedding").cast("string"))
    slim = rows.select("vec_id", "label", "embedding")
    good = slim.filter(usable()).withColumn("vector", F.unhex(F.sha2(text, 256)))
    made = good.groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = stored(made.withColumn("rid", F.monotonically_increasing_id()))
    found = cut(links(reps.select("rid", "label", "embedding", "rows"), cosine, miss))
    linked = found.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter(F.col("other").isNotNull()).select(F.col("rid").alias("a"), F.col("other").alias("b")))
    known = reps.select("rid", "vector", "first_id", "rows").join(linked, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    known = cut(known.select("vector", "rows", "first_id", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    parts = cut(known.filter("n_links >= rows").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size")))
    grouped = with_groups(known.filter("n_links >= rows"), parts, "root", "size").select("vector", "rows", "n_links", "component_id")
    alone = known.filter("n_links < rows").select("vector", "rows", "n_links", F.col("first_id").alias("component_id"))
    results = cut(grouped.union(alone))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    out = with_groups(good.select("vec_id", "vector"), results, "vector", "rows").select("vec_id", "n_links", "component_id", kept)
    rest = slim.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(rest)
