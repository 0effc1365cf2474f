"""The language model against a replay bit by bit, and its chunk counts against plain counting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import context_mixing as cm
from tests.llm.test_operators import DOCS, prose

WIDE, SHORT = (1 << 64) - 1, (1 << 32) - 1
GOLD = 0x9E3779B97F4A7C15


def mixed(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & WIDE
    z = (z ^ z >> 27) * 0x94D049BB133111EB & WIDE
    return z ^ z >> 31


def bits_with_contexts(words, codes):
    """For each word its bits: (node, bit, contexts), from the definition."""
    escape = codes.escape
    ids = [codes.index.get(w, escape) for w in words]
    for k, w in enumerate(words):
        back = lambda d: ids[k - d] if k >= d else escape + d  # noqa: E731, B023
        kinds = [*reversed([i for i in ids[:k] if codes.common[i]]), escape, escape]
        kind = (kinds[0] * GOLD + 5) & WIDE
        one = (back(1) * GOLD + 1) & WIDE
        hashes = [((kind ^ kinds[1] + 1) * GOLD + 6) & WIDE, one, ((one ^ back(2) + 1) * GOLD + 2) & WIDE]
        parts = [(ids[k], [mixed(h) >> 32 for h in hashes])]
        for at, byte in enumerate(w + b" " if ids[k] == escape else b""):
            h, found = 7, []
            for d in range(1, 6):
                h = (h * GOLD + (w[at - d] + 1 if at >= d else 0) + d) & WIDE
                if d in (1, 3, 5):
                    found.append(mixed(h ^ kind if d == 1 else h) >> 32)
            parts.append((escape + 1 + byte, found))
        out = []
        for symbol, contexts in parts:
            for i in range(codes.start[symbol], codes.start[symbol] + codes.length[symbol]):
                node = int(codes.node[i])
                salt = node * 0x85EBCA77 & SHORT
                out.append((node, int(codes.bit[i]), [((c ^ salt) * 0x9E3779B1 & SHORT) >> (32 - cm.BITS) for c in contexts]))
        yield out


def counts_by_hand(lists, codes):
    tables = [Counter() for _ in range(cm.ORDERS + 1)]
    for words in lists:
        for bits in bits_with_contexts(words, codes):
            for node, bit, slots in bits:
                for table, slot in zip(tables, [*slots, node], strict=True):
                    table[slot, bit] += 1
    return tables


def replay(words, codes, tables, weights, refine, out_of_counts):
    """Log probability of each word, one bit at a time."""
    own = np.zeros((2, cm.INPUTS))
    logs, pull = [], np.zeros((2, cm.INPUTS))
    for k, bits in enumerate(bits_with_contexts(words, codes)):
        if k and k % cm.BLOCK == 0:
            own = np.clip(own + cm.RATE * pull, -0.5, 0.5)
            pull = np.zeros((2, cm.INPUTS))
        total = 0.0
        for node, bit, slots in bits:
            x, levels = [], []
            for table, slot in zip(tables, [*slots, node], strict=True):
                n = [table[slot, 0], table[slot, 1]]
                if out_of_counts:
                    n[bit] = max(n[bit] - 1, 0)
                x.append(round(10 * max(-12, min(12, math.log((n[1] + 0.4) / (n[0] + 0.4))))) / 10)
                levels.append(sum(sum(n) >= v for v in cm.LEVELS))
            x.append(0.3)
            spelled = int(node >= codes.escape)
            row = 5 * spelled + levels[2]
            step = round(max(-384, min(384, 32 * float(np.dot(weights[5 * row + levels[1]] + own[spelled], x)))))
            p = 1 / (1 + math.exp(-step / 32))
            pull[spelled] += (bit - p) * np.array(x)
            at = max(-7.999, min(7.999, step / 32)) * 2 + 16
            low = int(at)
            p = (p + refine[row][low] * (1 - at + low) + refine[row][low + 1] * (at - low)) / 2
            total += math.log(p if bit else 1 - p)
        logs.append(total)
    return logs


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(8)
    lists = [cm.tokens_of(prose(rng, rng.randint(0, 90)).encode()) for _ in range(40)]
    lists += [lists[3], cm.tokens_of(b"th\xc3\xa9 " * 200), cm.tokens_of(b"")]
    n = Counter(w for x in lists for w in x)
    words = sorted(w for w, c in n.items() if c > 2)
    codes = cm.codes_of(words, [n[w] for w in words], sum(c for c in n.values() if c <= 2))
    total = np.zeros(cm.cells(codes), dtype=np.uint32)
    cm.count_texts(lists[5:], codes, total)
    return lists, codes, total


def test_counts_by_hand(trained):
    lists, codes, total = trained
    tables = counts_by_hand(lists[5:], codes)
    for o, table in enumerate(tables):
        part = total[o * (2 << cm.BITS) : (o + 1) * (2 << cm.BITS)] if o < cm.ORDERS else total[cm.ORDERS * (2 << cm.BITS) :]
        assert {(k >> 1, k & 1): int(part[k]) for k in np.nonzero(part)[0].tolist()} == dict(table)


@pytest.mark.parametrize("out_of_counts", [False, True])
def test_replay_bit_by_bit(trained, out_of_counts):
    lists, codes, total = trained
    model = cm.fresh(codes, total)
    learner = cm.Learner(model.weights)
    for _ in cm.predicted(lists[:5], False, model, learner):
        pass
    assert (learner.seen > 0).sum() > 5 and not np.allclose(learner.weights, model.weights)
    n, ones = learner.bins.reshape(2, cm.REFINED, cm.BINS)
    model = model._replace(weights=learner.weights.astype(np.float32), refine=((ones + 20 * model.refine) / (n + 20)).astype(np.float32))
    tables = counts_by_hand(lists[5:], codes)
    for part, t, logs in cm.predicted(lists, out_of_counts, model):
        for k, place in enumerate(part.tolist()):
            want = replay(lists[place], codes, tables, model.weights, model.refine, out_of_counts)
            got = logs[t.text == k]
            # a sum at the edge of a step may round either way
            assert len(got) == len(want) and abs(got.sum() - sum(want)) < 2e-3 * (1 + len(want)) and np.quantile(np.abs(got - want), 0.9) < 1e-3


def test_order_of_words_counts(trained):
    lists, codes, total = trained
    model = cm.fresh(codes, total)
    words = lists[3]
    logs = [[float(x[t.text == k].sum()) for k in range(2)] for _, t, x in cm.predicted([words, [*words[:-1][::-1], b""]], False, model)][0]
    assert abs(logs[0] - logs[1]) > 0.1


def test_codes_are_a_distribution(trained):
    """After the same words, all coded words and the escape share a probability of one."""
    lists, codes, total = trained
    model = cm.fresh(codes, total)
    before = lists[6][:7]
    each = [[*before, w] for w in codes.index]
    share = sum(math.exp(float(logs[t.text == k][-1])) for part, t, logs in cm.predicted(each, False, model) for k in range(len(part)))
    unseen = next(iter(cm.predicted([[*before, b"qqq"]], False, model)))
    assert 0.5 < share < 1 + 1e-5 and share + math.exp(float(unseen[2][-1])) < 1 + 1e-5


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(50)] + [None, "", " \t\n", "É É É", prose(rng, 6000)]
    texts += [texts[0], texts[0], texts[1], texts[54]]
    return [*enumerate(texts), (3, texts[3]), (None, "The unknown"), (77, "Long" * 3000)]


def test_language_model(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, "w", 2, "k", 0) for i, t in rows], DOCS)
    got = cm.text_scores(df, frequent_words=50).collect()
    tokens = lambda t: cm.tokens_of((t or "").encode())
    counts = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(tokens(t)), sum(x in counts for x in tokens(t)), total, round(sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert held(54) != held(58)  # a copy is foreseen where the other one is learned from
    copies = [r["bits_per_byte"] for r in got if r["doc_id"] in (54, 58) and r["held_out"]]
    assert max(copies) < 0.5 < min(r["bits_per_byte"] for r in got if r["doc_id"] in range(5, 40) and r["n_tokens"] > 60)
    assert cm.text_scores(df.limit(0)).count() == 0
    only_held = df.filter("doc_id in (0, 1, 2, 3, 4)").filter("crc32(cast(doc_id as string)) % 5 = 1")
    assert cm.text_scores(only_held).count() == only_held.count()


def test_match_gains_by_hand(spark):
    rng = random.Random(2)
    texts = []
    for row in range(60):
        keys = [rng.choice((1, 2, 3, row + 100)) for _ in range(rng.randint(1, 12))]
        texts.append((row, rng.random() < 0.3, [None, *keys[:-1]], keys, [-rng.random() * 400 for _ in keys]))
    df = spark.createDataFrame(texts, "row long, held_out boolean, prev array<bigint>, cur array<bigint>, logp array<double>")
    pairs = Counter((a, b) for _, out, prev, cur, _ in texts if not out for a, b in zip(prev, cur, strict=True) if a is not None)
    want = {}
    for row, out, prev, cur, logp in texts:
        for a, b, lp in zip(prev, cur, logp, strict=True):
            left = Counter(pairs)
            if a is not None and not out:
                left[a, b] -= 1
            after = {y: c for (x, y), c in left.items() if x == a and c > 0}
            n = sum(after.values())
            if a is not None and n:
                p = max(after.get(b, 0) - 0.5, 0) + (0.5 + 0.5 * len(after)) * 10.0**lp
                low = math.log10((0.5 + 0.5 * len(after)) / (n + 0.5))
                want[row] = want.get(row, 0.0) + max(math.log10(p / (n + 0.5)) - lp if p > 0 else low, low)
    got = {r["row"]: r["gain"] for r in cm.match_gains(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_chunks_depend_on_words_alone(trained):
    lists, codes, _ = trained
    words = max(lists, key=len)
    t = cm.tokens([words, words[:40], []], codes)
    starts, keys = cm.chunks(t, codes)
    assert starts[0] == 0 and len(words) in starts.tolist() and len(keys) == len(starts)
    again = cm.chunks(cm.tokens([words], codes), codes)
    assert again[1].tolist() == keys[: len(again[1])].tolist()


def test_counts_are_added_in_place(spark, monkeypatch):
    monkeypatch.setattr(cm, "CHUNK_CELLS", 4)
    df = spark.range(30).selectExpr("id % 10 as k").repartition(3)

    def add(total, batch):
        np.add.at(total, batch.column(0).to_numpy(), np.uint32(1))

    once = cm.summed(df, add, 10)
    assert once.tolist() == [3] * 10
    twice = cm.summed(df, add, 10, once)
    assert twice is once and once.tolist() == [6] * 10


def test_the_driver_holds_no_counts(spark, trained, monkeypatch):
    """Tables are added up and turned into predictions in tasks; put together they are what the counts give at once."""
    lists, codes, total = trained
    df = spark.createDataFrame([(b" ".join(words[:-1]),) for words in lists[5:]], "text binary").repartition(3)

    def add(into, batch):
        cm.count_texts([cm.tokens_of(x) for x in batch.column(0).to_pylist()], codes, into)

    sums = cm.chunk_sums(df, add, cm.cells(codes))
    once, twice = (cm.assembled(codes, cm.packed_tables(x), *cm.unlearned()) for x in (sums, cm.chunk_sums(df, add, cm.cells(codes), sums)))
    for got, want in ((once, cm.fresh(codes, total)), (twice, cm.fresh(codes, 2 * total))):
        for held, known in zip([*got.orders, got.zero], [*want.orders, want.zero], strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(held, known, strict=True))
    for name in ("summed", "fresh"):
        monkeypatch.setattr(cm, name, None)
    assert cm.text_scores(spark.createDataFrame([(k, "a b c " * k) for k in range(30)], "doc_id long, text string")).count() == 30
