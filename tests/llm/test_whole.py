"""What the corpus operators and the pipeline must do in whole, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from quantloom.llm import common, html_extraction, secrets, shingle_join, simhash

DATA = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long"


def shingles_by_hand(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_by_hand(texts):
    sets = [shingles_by_hand(t) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return {frozenset(i for i in range(len(texts)) if part[i] == p) for p in part}


def edited():
    """Texts with copies in which a few words differ: similarities from 0.5 to 1, a large group, and a common line."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for k in range(40):
        words = [word() for _ in range(rng.choice([5, 9, 60, 150, 400]))]
        for _ in range(30 if k == 0 else 3):
            other = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other) + (" " + line if k % 3 == 0 else ""))
    return texts


def test_bitmap_filter_loses_no_similar_pair():
    """Sketches never differ by more than the sets; posting pairs hold every similar pair that is not yet connected."""
    rng = np.random.default_rng(4)
    for least in (0.5, 0.8, 0.9):
        sets = []
        for n in (1, 5, 31, 33, 100, 700):
            whole = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            sets += [np.unique(np.concatenate([whole[rng.random(n) < keep], rng.integers(0, 1 << 63, k, dtype=np.uint64), whole[:1]])) for keep in (1.0, 0.97, 0.9, 0.7) for k in (0, 1, 3, n // 10)]
        sets.sort(key=len)
        marks = [shingle_join.sketch(x) for x in sets]
        pairs = set()
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                size = min(len(marks[i]), len(marks[j]))
                far = np.bitwise_count(shingle_join.halved(marks[i], size) ^ shingle_join.halved(marks[j], size)).sum()
                assert far <= len(np.setxor1d(sets[i], sets[j]))
                if i % 7 != j % 7 and shingle_join.similar(sets[i], sets[j], least):
                    assert shingle_join.sketches_near(marks[i].tobytes(), len(sets[i]), marks[j].tobytes(), len(sets[j]), least)
                    pairs.add((i, j))
        n, k = [len(x) for x in sets], list(range(len(sets)))
        a, b = shingle_join.posting_pairs(n, k, [0] * len(k), [i % 7 for i in k], [m.tobytes() for m in marks], least)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        assert pairs <= found and len(found) < len(k) ** 2 // 3 and all(x % 7 != y % 7 for x, y in found)


@pytest.mark.parametrize(("often", "most"), [(4, 1_000_000), (1_000_000, 0)])
def test_groups_by_brute_force_on_shingles(spark, often, most):
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text").repartition(3)
    got = {}
    for r in shingle_join.similar_groups(df, often=often, broadcast_rows=most).collect():
        got.setdefault(r["group"], set()).add(r["row"])
    want = groups_by_hand(texts)
    assert {frozenset(x) for x in got.values()} == want and len(texts) > len(want) > 10


def test_near_copies_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(min(rows[i][0] for i in g) for g in groups_by_hand([t for _, t in rows]))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()) == want


def test_stages_judge_rows_and_not_ids(spark):
    """Null and repeated ids: each row's own text decides."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(30))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first()["text"]
    clean = [text() for _ in range(6)]
    rows = [(None if k % 2 else 7, t, "en", "s", len(t)) for k, t in enumerate(clean)]
    same = spark.createDataFrame([*rows, *rows], ROW)
    assert sorted(r["text"] for r in corpus_pipeline.near_duplicate_stage(spark, same, DATA).collect()) == sorted(clean)
    leaked = spark.createDataFrame([*rows, (None, item, "en", "s", 9), (7, item, "en", "s", 9)], ROW)
    assert sorted(r["text"] for r in corpus_pipeline.decontamination_stage(spark, leaked, DATA).collect()) == sorted(clean)
    bad = spark.createDataFrame([*rows, (None, "too few words", "en", "s", 13), (7, "few", "en", "s", 3)], ROW)
    assert sorted(r["text"] for r in corpus_pipeline.quality_stage(spark, bad, DATA).collect()) == sorted(clean)


@pytest.mark.parametrize("value", ["QzXvKpWmTrYb", "x9#Q!z7", "qzkxvwpj"])
@pytest.mark.parametrize("before", ["pwd: ", "private_key = ", "passphrase: ", "credential is "])
def test_guess_cost_alone_decides(before, value):
    ranks = {w: i for i, w in enumerate([*secrets.COMMON, "correcthorse"], 1)}
    least = secrets.guess_cost(value, ranks)
    assert [s[0] for s in secrets.secret_spans((before + value).encode(), ranks, least)] == ["guess"]
    assert secrets.secret_spans((before + value).encode(), ranks, least + 0.1) == []
    assert least > 8 and secrets.secret_spans((before + "correcthorse").encode(), ranks) == []


def test_redaction_covers_whole_values(spark):
    df = spark.createDataFrame([(1, "a password=Abcdefgh1234!Zx9#q b")], "doc_id long, text string")
    assert [r["text"] for r in secrets.redacted(df).collect()] == ["a password=[SECRET] b"]


LONG = "some running words of the article " * 4
NESTED = [
    ("<article><h1>T</h1><p>intro</p><div class=\"content\"><p>{x}</p></div></article>", "T\nintro\n{x}"),
    ("<article><p>{x}{x}</p><div class=\"text\"><p>{x}</p></div><p>end</p></article>", "{x} {x}\n{x}\nend"),
    ("<article><p>intro</p><table><tr><td>{x}</td></tr><tr><td>b</td></tr></table></article>", "intro\n{x}\nb"),
    ("<div class=\"page\"><h1>T</h1><ul><li>{x}</li></ul><p>end</p></div>", "T\n{x}\nend"),
    ("<main><h1>T</h1><section><p>{x}</p></section><div class=\"share\">s</div></main>", "T\n{x}"),
    ("<div class=\"wrap\"><div class=\"list\"><a href=x>other one</a> <a href=y>other two</a></div><div class=\"post\"><h1>T</h1><p>{x}</p></div></div>", "T\n{x}"),
]


@pytest.mark.parametrize(("page", "want"), NESTED)
def test_nothing_of_the_article_is_dropped(spark, page, want):
    fill = lambda s, x: s.replace("{x}", x)
    html = "<html><body><nav><a href=x>menu</a></nav>" + fill(page, LONG) + "<footer>foot</footer></body></html>"
    df = spark.createDataFrame([(k, f"http://h.com/{k}", html) for k in range(2)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extraction.main_text(df).collect()} == {fill(want, LONG.strip())}


def test_a_common_shingle_is_many_small_comparisons(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rng = random.Random(8)
    rows, base = [], "all of these texts begin with the very same words"
    for k in range(150):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(rng.choice([1, 2, 3, 30]))]
        rows.append((k, k, f"{base} {' '.join(words)}"))
        if k % 10 == 0:
            rows.append((1000 + k, 1000 + k, f"{base} {' '.join(words)} " + words[-1]))
    df = spark.createDataFrame(rows, "row long, doc_id long, text string")
    got = {r["row"]: r["group"] for r in shingle_join.similar_groups(df, often=10**9).collect()}
    sets = {i: shingle_join.shingle_set(t.encode()) for i, _, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and shingle_join.similar(sets[i], sets[j], 0.8):
                root[find(j)] = find(i)
    assert len(set(got.values())) == len({find(i) for i in sets}) > 20
    assert all((got[i] == got[j]) == (find(i) == find(j)) for i in sets for j in sets)


def test_links_leave_a_block_as_a_forest():
    rng = np.random.default_rng(6)
    whole = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(whole, rng.integers(0, 200, 12)), rng.integers(0, 1 << 63, 6, dtype=np.uint64)])) for _ in range(60)]
    sets += [rng.integers(0, 1 << 63, 190, dtype=np.uint64) for _ in range(5)]
    sets[-5:] = map(np.unique, sets[-5:])
    roots = [k // 3 * 3 if k < 60 else k for k in range(65)]
    links = shingle_join.block_forest(list(range(65)), roots, [x.tobytes() for x in sets], 0.8)
    root = {r: r for r in roots}
    for a, b in links:
        assert shingle_join.similar(sets[a], sets[b], 0.8)
        old, new = root[roots[b]], root[roots[a]]
        assert old != new
        root = {k: new if v == old else v for k, v in root.items()}
    assert len(links) == 19 and len({root[r] for r in roots}) == 6


def test_a_pair_is_taken_where_its_first_shared_shingles_meet():
    held = np.sort(np.random.default_rng(7).integers(0, 1 << 63, 50, dtype=np.uint64))
    marks = [shingle_join.sketch(held).tobytes()] * 3
    pairs = lambda early: sorted(zip(*(x.tolist() for x in shingle_join.posting_pairs([50] * 3, [1, 2, 3], [2] * 3, [1, 2, 3], marks, 0.8, early=early)), strict=True))
    assert pairs(None) == pairs([[], [], []]) == [(1, 2), (1, 3), (2, 3)]
    assert pairs([[7, 8], [8], [9]]) == [(1, 3), (2, 3)]


def test_near_duplicates_use_the_fingerprint_index(spark, monkeypatch):
    fps = [0, 1, 3, 1 << 40, 0, 0xFF << 20, 0x7F << 20]
    df = spark.createDataFrame([(10 + k, fp) for k, fp in enumerate(fps)], "sig long, fp long")
    got = {(r["a"], r["b"]) for r in shingle_join.simhash_pairs(df).collect()}
    near = {(10 + i, 10 + j) for i in range(7) for j in range(i + 1, 7) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert got <= near and (10, 14) in got and (15, 16) in got
    assert {x for pair in got for x in pair} == set(range(10, 17))
    asked = []
    monkeypatch.setattr(shingle_join, "near_links", lambda fps, *a: asked.append(fps.count()) or simhash.near_links(fps, *a))
    docs = spark.createDataFrame([(k, f"one text of some words that is here {'once' if k else 'twice'}") for k in range(3)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, docs, DATA).count() == 2 and asked == [2]


def test_blocks_reach_python_in_small_batches(spark, monkeypatch):
    """Rows of the near-duplicate steps are wide, so batches are bounded by bytes, not by 10,000 rows or 64 MB; a block's pairs are not held."""
    name, before, seen = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []
    plain = shingle_join.map_rows
    monkeypatch.setattr(shingle_join, "map_rows", lambda *a: (seen.append(spark.conf.get(name)), plain(*a))[1])
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(edited()[:40])], "row long, doc_id long, text string")
    shingle_join.similar_groups(df).count()
    assert seen and set(seen) == {str(common.BATCH_BYTES)} and spark.conf.get(name) == before
    wide = spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 1000000) as binary) as x")
    with common.small_batches(spark):
        sizes = [r["n"] for r in common.map_rows(wide, lambda x: ([len(x)],), "n int").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 5
    some = [np.frombuffer(np.arange(k, k + 50, dtype=np.uint64).tobytes(), np.uint64) for k in range(600)]
    marks = [shingle_join.sketch(x).tobytes() for x in some]
    largest = max(len(x) for _, x in shingle_join.meetings([50] * 600, list(range(600)), [0] * 600, list(range(600)), marks, 0.8))
    assert largest < 600
    near = shingle_join.posting_pairs([50] * 600, list(range(600)), [0] * 600, list(range(600)), marks, 0.8)
    assert shingle_join.meeting([50] * 600, list(range(600)), [0] * 600, list(range(600)), marks, 0.8) == np.unique(np.concatenate(near)).tolist()
