"""Vector codes, vector links and the Merkle manifest on small tables, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import merkle, vector_codes, vector_links
from quantloom.llm.common import with_groups

VECTORS = "vec_id long, embedding array<float>, label int, rid long, vector string, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- 11: codes -------------------------------------------------------------------------------------------------------


def coded_by_hand(rows, parts=4, entries=256, rounds=4):
    rows = sorted((r for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    long = max((len(r[1]) for r in rows), default=0)
    width = -(-long // parts)
    ints = [[math.floor(1024 * x) for x in r[1]] + [0] * (width * parts - len(r[1])) for r in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    find = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in ints:
                own[find(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs, strict=True)]
    out = []
    for r, v in zip(rows, ints, strict=True):
        hits = [find(cut(v, p), books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[label], sha) for i, label, c, e in out)


def float32(xs):
    return [float(np.float32(x)) for x in xs]


def test_codes_by_hand(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 8))
    rows = [(i, float32(centres[i % 7] + rng.normal(size=8) * 0.2), i % 3 if i % 5 else None) for i in range(120)]
    rows += [rows[4], rows[4], (None, float32(rng.normal(size=8)), 1), (900, None, 1), (901, [1.0, None, *[0.0] * 6], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, 2), (904, [1.0] * 7, 0), (905, [], 0)]
    got = vector_codes.compressed(table(spark, rows), entries=20)
    assert Counter(map(tuple, got.collect())) == coded_by_hand(rows, entries=20)
    assert got.count() == 125


def test_few_rows_and_no_rows(spark):
    rows = [(2, [0.5, -0.5, 0.25, 0.0], None), (1, [0.5, -0.5, 0.25, 0.0], None)]
    assert Counter(map(tuple, vector_codes.compressed(table(spark, rows)).collect())) == coded_by_hand(rows)
    assert vector_codes.compressed(table(spark, rows).limit(0)).count() == 0
    assert vector_codes.compressed(table(spark, [(1, None, 1)])).count() == 0
    assert Counter(map(tuple, vector_codes.compressed(table(spark, [(1, [], 1)])).collect())) == coded_by_hand([(1, [], 1)])
    with pytest.raises(ValueError):
        vector_codes.compressed(table(spark, [(1, [1e9] * 4, 1)]))


def test_pivots_save_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, size=(64, 6))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, size=(4000, 6))
    entries = x[:256]
    pivots = vector_codes.spread_pivots(entries, 12)
    index, far, done = vector_codes.nearest(x, vector_codes.root(vector_codes.distances(x, pivots)), entries, vector_codes.root(vector_codes.distances(pivots, entries)))
    plain = vector_codes.distances(x, entries)
    assert (index == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all() and done < 0.1 * plain.size


# --- 12: links -------------------------------------------------------------------------------------------------------


def linked_by_hand(rows, least=0.98):
    ok = [r[2] is not None and good(r[1]) and any(r[1]) for r in rows]
    near = defaultdict(set)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                dot = math.fsum(x * y for x, y in zip(a[1], b[1], strict=True))
                if dot / math.sqrt(math.fsum(x * x for x in a[1]) * math.fsum(x * x for x in b[1])) >= least - 1e-12:
                    near[i].add(j)
                    near[j].add(i)
    out = Counter()
    for i, r in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            new = near[queue.pop()] - seen
            seen |= new
            queue += new
        least_id = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out[r[0], len(near[i]), least_id, r[0] == least_id] += 1
    return out


def planted(seed=7, strangers=150, copies=40):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [(i, float32(unit(rng.normal(size=16))), i % 3) for i in range(strangers)]
    for k, spread in enumerate((0.01, 0.03, 0.045)):
        base = unit(rng.normal(size=16))
        rows += [(1000 * (k + 1) - j, float32(unit(base + rng.normal(size=16) * spread) * (1 + j % 3)), k) for j in range(copies)]
    return rows


def test_links_by_hand(spark):
    rows = planted()
    rows += [rows[3], rows[3], (None, rows[5][1], rows[5][2]), (None, rows[9][1], None), (None, [0.0] * 16, 1), (2000, [0.0] * 16, 1), (2001, None, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, 0.0], 1), (2005, [2.0, 0.0], 1), (2006, [], 1), (2007, [1e-40] * 16, 2), (2008, [1e38] * 16, 2)]
    got = vector_links.near_duplicates(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == linked_by_hand(rows)
    assert vector_links.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 16)  # the largest bucket is dealt to several blocks, and they meet in pairs
    rows = planted(9, 20, 90)
    assert Counter(map(tuple, vector_links.near_duplicates(table(spark, rows)).collect())) == linked_by_hand(rows)


def test_chance_of_a_miss():
    for n in (10, 10_000, 10_000_000):
        k, tables = vector_links.table_sizes(n, 0.98, 1e-5)
        assert (1 - vector_links.collision(0.2) ** k) ** tables <= 1e-5
    rng = np.random.default_rng(1)
    z, shift = rng.normal(size=200_000) * 0.7, rng.uniform(0, 2, 200_000)
    assert abs((np.floor((z + shift) / 2) == np.floor(shift / 2)).mean() - vector_links.collision(0.7)) < 0.005


def test_large_groups_are_broadcast_and_the_rest_dealt(spark):
    rows = spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(80)] + [(None, -1)], "key int, v int")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    want = sorted(map(str, rows.join(groups.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select("key", "v", "n", "s").collect()))
    for most in (5, 1000):
        assert sorted(map(str, with_groups(rows, groups, "key", "n", most).select("key", "v", "n", "s").collect())) == want


# --- 13: manifest ----------------------------------------------------------------------------------------------------


def sha(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def manifest_by_hand(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        """(root, for each leaf its steps of (before, after))."""
        steps = [[] for _ in nodes]
        members = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, joined = [], []
            for k in range(0, len(nodes), 2):
                pair = nodes[k : k + 2]
                for i in members[k]:
                    steps[i].append(("", pair[1] if len(pair) > 1 else ""))
                for i in members[k + 1] if len(pair) > 1 else []:
                    steps[i].append((pair[0], ""))
                up.append(sha(*pair))
                joined.append(members[k] + (members[k + 1] if len(pair) > 1 else []))
            nodes, members = up, joined
        return nodes[0], steps

    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = sha(enc(doc_id), enc(source), enc(lang), enc(n), enc(text))
        touched = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = sha(enc(doc_id), enc(source), enc(lang), enc(n + 1), enc(text)) if touched else leaf
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    top, above = climb([trees[g][0] for g in order]) if order else ("", [])
    out = Counter()
    for g, more in zip(order, above, strict=True):
        for (_, _, leaf, doc_id, changed), steps in zip(sorted(groups[g]), trees[g][1], strict=True):
            folded = changed
            for before, after in steps + more:
                folded = sha(before, folded, after)
            out[doc_id, leaf, trees[g][0], top, sha(*(b + a for b, a in steps + more)), folded, folded == top] += 1
    return out


@pytest.mark.parametrize("bits", [2, 8])
def test_manifest_by_hand(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)  # small blocks: several layers
    rows = [(i, f"text {i}" if i % 4 else "", ["en", "de", None, "é"][i % 4 if i < 30 else 0], "s" if i % 3 else None, i if i % 5 else None) for i in range(75)]
    rows += [rows[8], rows[8], (8, "other", "en", "s", 8), (None, None, None, None, None), (None, "x" * 300_000, "en", "é", 3), (5, "lone", "zz", "s", 4), (-7, "é", "", "s", 2**63 - 1)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, `a.b` string, leaf string").repartition(3)
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert Counter(map(tuple, got.collect())) == manifest_by_hand(rows)
    if bits == 8:
        assert merkle.manifest(df.limit(0), F.lit(True)).count() == 0
        one = merkle.manifest(df.filter("lang = 'zz'"), F.lit(False)).first()
        assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("")


def test_proofs_are_made_without_python_or_collecting_groups(spark):
    nodes = spark.range(5).select((F.col("id") % 2).alias("group"), (F.col("id") % 2 + 2).cast("int").alias("depth"), F.col("id").alias("rank"), F.struct(F.col("id").cast("string").alias("hash")).alias("node"))
    plan = merkle.nested(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Python" not in plan
