"""Language-model scores of running text by online logistic context mixing.

A text is its lower-cased words and one end token. A frequent word is coded by the bits of its
Huffman code; any other by an escape and then its bytes and a space, eight bits each. Every bit
is predicted under several hashed contexts: for codes the last two very common words of the text
(they tell its language and kind), the word before, and the two words before; for spelled words
the last one, three and five bytes (the first of them with the last very common word); and the
bit's place alone. The predictions are mixed in the logistic domain by weights that a gate of
their confidences selects; a text's own weights follow its errors block by block while it is
read, and a table refines what the mix says. Context tables are sums over all training texts;
weights and refinement are learned on a tenth of the training texts, before those join the
tables. A training text is predicted with each of its bits taken out of the counts.

Long repeats are told apart by a match model that grows with the corpus: texts are cut at places
that their words decide, Spark counts which chunk follows which in all training texts, and a
chunk's probability is that of the mix, smoothed into those counts (Pitman-Yor), where the chunk
before it has been seen elsewhere.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import MIX_1, MIX_2, held_out, map_rows, stored

ORDERS = 3
BITS = 22
INPUTS = ORDERS + 2
COMMON = 64
LEVELS = (0.5, 2.5, 8.5, 64.5)
GATES = 2 * (len(LEVELS) + 1) ** 2
REFINED = 2 * (len(LEVELS) + 1)
BINS = 33
FINE = 32
REACH = 12
PRIOR = 0.4
STEP = 10  # packed predictions are tenths
BLOCK = 64
RATE = 0.0005
GROUP_TOKENS = 60_000
GROUP_TEXTS = 256
AT_ONCE = 1000  # texts that are lists of words at a time
CHUNK_CELLS = 1 << 18
CHUNK_WORDS = 32
GOLD = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint32(0x9E3779B1)
SALT = np.uint32(0x85EBCA77)


def mix64(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


class Codes(NamedTuple):
    """Bit paths of symbols: frequent words by index, then the escape, then 256 bytes."""

    index: dict[bytes, int]
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    hashes: np.ndarray
    common: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.index)

    @property
    def nodes(self) -> int:
        return len(self.index) + 256


def codes_of(words: list[bytes], counts: list[int], others: int) -> Codes:
    """Huffman codes of ``words`` and of the escape, which stands for ``others`` occurrences; bytes have plain ones."""
    weight = [*counts, max(others, 1)]
    n = len(weight)
    order = sorted(range(n), key=lambda i: (weight[i], i))
    leaves, inner = deque(order), deque()
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    side = np.zeros(2 * n - 1, dtype=np.uint8)
    for k in range(n - 1):
        new = n + k
        weight.append(0)
        for s in (0, 1):
            queue = leaves if leaves and (not inner or weight[leaves[0]] <= weight[inner[0]]) else inner
            child = queue.popleft()
            parent[child], side[child] = new, s
            weight[new] += weight[child]
        inner.append(new)
    # paths are written in place, from the leaves up: all steps of all words at once would be hundreds of megabytes
    root, length = 2 * n - 2, np.full(n + 256, 8)
    length[:n] = 0
    for _, leaf, _ in upward(parent, n, root):
        length[leaf] += 1
    start = np.cumsum(length) - length
    node, bit = np.empty(length.sum(), dtype=np.int32), np.empty(length.sum(), dtype=np.uint8)
    for depth, leaf, at in upward(parent, n, root):
        where = start[leaf] + length[leaf] - 1 - depth
        node[where], bit[where] = parent[at] - n, side[at]
    byte, place = np.repeat(np.arange(256), 8), np.tile(np.arange(8), 256)
    node[start[n] :] = n - 1 + ((1 << place) | (byte >> (8 - place)))
    bit[start[n] :] = (byte >> (7 - place)) & 1
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    common = np.zeros(n + 1, dtype=bool)
    common[sorted((i for i in range(len(words)) if words[i]), key=lambda i: (-counts[i], i))[:COMMON]] = True
    return Codes({w: i for i, w in enumerate(words)}, start, length, node, bit, hashes, common)


def upward(parent: np.ndarray, n: int, root: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth from below, leaves, the nodes above them at that depth) of a tree of ``n`` leaves, as long as leaves are below the root."""
    leaf, at, depth = np.arange(n), np.arange(n), 0
    while n > 1 and len(leaf):
        yield depth, leaf, at
        at = parent[at]
        leaf, at, depth = leaf[at != root], at[at != root], depth + 1


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(b"")
    return words


class Tokens(NamedTuple):
    """Words of some texts in their order: text of each, code index, words without a code by place, context hashes by order, common word before."""

    text: np.ndarray
    ids: np.ndarray
    rare: np.ndarray
    spelled: list[bytes]
    contexts: np.ndarray
    kind: np.ndarray


def tokens(lists: list[list[bytes]], codes: Codes) -> Tokens:
    flat = [w for words in lists for w in words]
    get, escape = codes.index.get, codes.escape
    ids = np.array([get(w, escape) for w in flat], dtype=np.int64)
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    text = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[text]
    rare = np.nonzero(ids == escape)[0]
    before = [np.where(place >= k, np.concatenate([np.zeros(min(k, len(ids)), np.int64), ids[:-k]]), escape + k).astype(np.uint64) for k in (1, 2)]
    is_common = codes.common[ids]
    at = np.concatenate([np.full(2, -1), np.nonzero(is_common)[0]])
    passed = np.cumsum(is_common) - is_common
    kinds = [np.where(at[passed + k] >= np.arange(len(ids)) - place, ids[at[passed + k]], escape).astype(np.uint64) for k in (1, 0)]
    with np.errstate(over="ignore"):
        kind = kinds[0] * GOLD + np.uint64(5)
        two_kinds = (kind ^ (kinds[1] + np.uint64(1))) * GOLD + np.uint64(6)
        one = before[0] * GOLD + np.uint64(1)
        two = (one ^ (before[1] + np.uint64(1))) * GOLD + np.uint64(2)
    return Tokens(text, ids, rare, [flat[k] for k in rare.tolist()], short(mix64(np.stack([two_kinds, one, two]))), kind)


def short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


class Symbols(NamedTuple):
    """Codes and bytes to predict, in order: symbol, its token's place, context hashes by order."""

    symbol: np.ndarray
    token: np.ndarray
    contexts: np.ndarray


def symbols(t: Tokens, order: np.ndarray, codes: Codes) -> Symbols:
    """What codes the tokens, taken in ``order``: a code, or an escape and the bytes of the word and a space."""
    ids = t.ids[order]
    sizes = np.ones(len(ids), dtype=np.int64)
    rank = np.zeros(len(t.ids), dtype=np.int64)
    rank[t.rare] = np.arange(len(t.rare))
    at = np.nonzero(ids == codes.escape)[0]
    words = [t.spelled[k] for k in rank[order[at]].tolist()]
    sizes[at] += np.array([len(w) + 1 for w in words], dtype=np.int64) if words else 0
    token = np.repeat(np.arange(len(ids)), sizes)
    symbol = ids[token]
    contexts = t.contexts[:, order][:, token]
    if words:
        byte = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        lengths = np.array([len(w) + 1 for w in words])
        place = np.arange(len(byte)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        spelled = np.ones(len(symbol), dtype=bool)
        spelled[np.cumsum(sizes) - sizes] = False
        where = np.nonzero(spelled)[0]
        symbol[where] = codes.escape + 1 + byte.astype(np.int64)
        wide = byte.astype(np.uint64) + np.uint64(1)
        h = np.full(len(byte), 7, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, 6):
                h = h * GOLD + np.where(place >= k, np.concatenate([np.zeros(min(k, len(wide)), np.uint64), wide[:-k]]), np.uint64(0)) + np.uint64(k)
                if k in (1, 3, 5):
                    contexts[k // 2, where] = short(mix64(h if k > 1 else h ^ t.kind[order][token[where]]))
    return Symbols(symbol, token, contexts)


def events(symbol: np.ndarray, contexts: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place of the symbol, node, bit, slots by order) of every bit of the symbols."""
    length = codes.length[symbol]
    of = np.repeat(np.arange(len(symbol)), length)
    at = np.arange(len(of)) + np.repeat(codes.start[symbol] - (np.cumsum(length) - length), length)
    node, bit = codes.node.take(at), codes.bit.take(at)
    salt = node.astype(np.uint32) * SALT
    slots = [((c.take(of) ^ salt) * SPREAD) >> np.uint32(32 - BITS) for c in contexts]
    return of, node, bit, slots


def cells(codes: Codes) -> int:
    """Counts held: zeros and ones by order and slot, then by node."""
    return ORDERS * (2 << BITS) + 2 * codes.nodes


def count_texts(lists: list[list[bytes]], codes: Codes, total: np.ndarray) -> None:
    for part in groups([len(x) for x in lists]):
        t = tokens([lists[k] for k in part], codes)
        s = symbols(t, np.arange(len(t.ids)), codes)
        _, node, bit, slots = events(s.symbol, s.contexts, codes)
        one = np.uint32(1)
        for o, slot in enumerate(slots):
            np.add.at(total[o * (2 << BITS) : (o + 1) * (2 << BITS)], pair(slot, bit), one)
        np.add.at(total[ORDERS * (2 << BITS) :], pair(node, bit), one)


def pair(slot: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Index of a slot's count of the bit."""
    return (slot.astype(np.int64) << 1) | bit


def groups(sizes: list[int]) -> list[np.ndarray]:
    """Texts of like length together, as many as make a bounded amount of work (or one)."""
    order = np.argsort(np.array(sizes, dtype=np.int64), kind="stable")
    out, held = [], 0
    first = 0
    for k, i in enumerate(order.tolist()):
        if k > first and (held + sizes[i] > GROUP_TOKENS or k - first >= GROUP_TEXTS):
            out.append(order[first:k])
            first, held = k, 0
        held += sizes[i]
    if first < len(order):
        out.append(order[first:])
    return out


def packed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictions by slot as counted, and by slot and bit with one such bit taken out: log odds in tenths, times 256, plus a confidence level."""
    out = np.empty((len(n), 3), dtype=np.int16)
    for k in range(3):
        zeros, ones = (np.maximum(n[:, b].astype(np.float32) - (k == b + 1), 0) for b in (0, 1))
        level = np.searchsorted(LEVELS, zeros + ones, side="right")
        out[:, k] = np.rint(STEP * np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))).clip(-12, 12)).astype(np.int16) * 256 + level
    return out[:, 0].copy(), out[:, 1:].ravel()


class Model(NamedTuple):
    codes: Codes
    orders: list[tuple[np.ndarray, np.ndarray]]
    zero: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray
    refine: np.ndarray


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: The mix, in steps of 1 / FINE, as a probability.
CURVE = squash((np.arange(2 * REACH * FINE + 1) - REACH * FINE) / FINE).astype(np.float32)


def unlearned() -> tuple[np.ndarray, np.ndarray]:
    """(weights, refinement) before any text."""
    return np.full((GATES, INPUTS), 0.3, dtype=np.float32), np.repeat(squash((np.arange(BINS) - (BINS - 1) / 2)[None, :] / 2), REFINED, axis=0).astype(np.float32)


def fresh(codes: Codes, counts: np.ndarray) -> Model:
    weights, refine = unlearned()
    size = 2 << BITS
    orders = [packed(counts[o * size : (o + 1) * size].reshape(-1, 2)) for o in range(ORDERS)]
    return Model(codes, orders, packed(counts[ORDERS * size :].reshape(-1, 2)), weights, refine)


def bit_logs(refine: np.ndarray) -> np.ndarray:
    """Log probability of a zero and a one by refinement row and step of the mix: the mean of the mix and the table, read between its bins."""
    x = np.clip((np.arange(len(CURVE)) - REACH * FINE) / FINE, -7.999, 7.999) * 2 + (BINS - 1) // 2
    low = x.astype(np.int64)
    p = (CURVE + refine[:, low] * (1 - (x - low)) + refine[:, low + 1] * (x - low)) / 2
    return np.log(np.stack([1 - p, p], axis=-1).clip(1e-7, 1)).astype(np.float32)


class Learner:
    """Weights that follow every block's errors (Adagrad), and counts for the refinement, over the texts of one task."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float64)
        self.squares = np.full(weights.shape, 1e-3)
        self.seen = np.zeros(GATES)
        self.bins = np.zeros((2, REFINED * BINS))

    def learn(self, gate: np.ndarray, inputs: np.ndarray, error: np.ndarray, at: np.ndarray, bit: np.ndarray) -> None:
        n = np.bincount(gate, minlength=GATES)
        g = np.stack([np.bincount(gate, weights=error * x, minlength=GATES) for x in inputs], axis=1) / np.maximum(n, 1)[:, None]
        self.squares += g * g
        self.weights += 0.02 * g / np.sqrt(self.squares)
        self.seen += n
        self.bins += np.stack([np.bincount(at, minlength=REFINED * BINS), np.bincount(at, weights=bit, minlength=REFINED * BINS)])


def predicted(lists: list[list[bytes]], out_of_counts: bool, model: Model, learner: Learner | None = None) -> Iterator[tuple[np.ndarray, Tokens, np.ndarray]]:
    """(places of some texts, their tokens, natural log probability of each token); with each bit taken out of the counts if they hold the texts."""
    logs_of = bit_logs(model.refine).ravel()
    for part in groups([len(x) for x in lists]):
        t = tokens([lists[k] for k in part], model.codes)
        sizes = np.bincount(t.text, minlength=len(part))
        place = np.arange(len(t.ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block = (place // BLOCK).astype(np.int32)
        order = np.argsort(block, kind="stable")
        s = symbols(t, order, model.codes)
        logs = np.zeros(len(t.ids))
        own = np.zeros((2, len(part), INPUTS), dtype=np.float32)  # for codes, for spelled words
        ends = np.searchsorted(block[order][s.token], np.arange(1, block.max() + 2))
        first = 0
        for end in ends.tolist():
            read_block(t, s, order, slice(first, end), out_of_counts, model, logs_of, own, logs, learner)
            first = end
        yield part, t, logs


def read_block(t: Tokens, s: Symbols, order: np.ndarray, span: slice, out_of_counts: bool, model: Model, logs_of: np.ndarray, own: np.ndarray, logs: np.ndarray, learner: Learner | None) -> None:
    """One block of every text that reaches it: log probabilities go to ``logs``, and each text's ``own`` weights follow its errors."""
    of, node, bit, slots = events(s.symbol[span], s.contexts[:, span], model.codes)
    if not len(of):
        return
    token_of = order[s.token[span]]
    text = t.text[token_of].take(of)
    if out_of_counts:
        held = [alone.take(pair(slot, bit)) for (_, alone), slot in zip([*model.orders, model.zero], [*slots, node], strict=True)]
    else:
        held = [plain.take(slot) for (plain, _), slot in zip([*model.orders, model.zero], [*slots, node], strict=True)]
    levels = len(LEVELS) + 1
    row = (node >= model.codes.escape) * np.int64(levels) + (held[2] & 255)
    gate = row * levels + (held[1] & 255)
    inputs = np.empty((INPUTS, len(of)), dtype=np.float32)
    for i, v in enumerate(held):
        np.multiply(v >> 8, np.float32(1 / STEP), out=inputs[i], casting="unsafe")
    inputs[-1] = 0.3
    starts = np.concatenate([[0], np.nonzero(text[1:] != text[:-1])[0] + 1])
    readers = text[starts]
    weights = learner.weights.astype(np.float32) if learner else model.weights
    both = (weights.reshape(1, 2, -1, INPUTS) + own[:, readers].transpose(1, 0, 2)[:, :, None]).reshape(-1, INPUTS)
    reader = np.repeat(np.arange(len(starts)) * GATES, np.diff([*starts, len(of)]))
    mix = np.einsum("ei,ie->e", both.take(reader + gate, axis=0), inputs)
    step = np.rint((mix * FINE).clip(-REACH * FINE, REACH * FINE)).astype(np.int64) + REACH * FINE
    error = bit - CURVE.take(step)
    log = logs_of.take(((row * len(CURVE) + step) << 1) | bit)
    if learner:
        learner.learn(gate, inputs, error, row * BINS + np.rint(np.clip(step / FINE - REACH, -8, 8) * 2).astype(np.int64) + (BINS - 1) // 2, bit)
    token = token_of.take(of)
    first = np.concatenate([[0], np.nonzero(token[1:] != token[:-1])[0] + 1])
    logs[token[first]] = np.add.reduceat(log, first, dtype=np.float64)
    slope = np.multiply(inputs, error, out=inputs)
    pull = np.add.reduceat(slope, starts, axis=1).T
    slope *= node >= model.codes.escape
    pull_spelled = np.add.reduceat(slope, starts, axis=1).T
    own[:, readers] = np.clip(own[:, readers] + np.float32(RATE) * np.stack([pull - pull_spelled, pull_spelled]), -0.5, 0.5)


def chunks(t: Tokens, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(first token, key) of each chunk of the texts: a chunk ends where two words hash to a place in ``CHUNK_WORDS``, or the text does."""
    h = np.zeros(len(t.ids), dtype=np.uint64)
    coded = t.ids < codes.escape
    h[coded] = codes.hashes[t.ids[coded]]
    h[t.rare] = np.array([xxhash.xxh64_intdigest(w) for w in t.spelled], dtype=np.uint64)
    with np.errstate(over="ignore"):
        pair = mix64(h * np.uint64(3) + np.concatenate([np.zeros(1, np.uint64), h[:-1]]))
        cuts = np.zeros(len(h), dtype=bool)
        cuts[1:] = (pair[:-1] % np.uint64(CHUNK_WORDS) == 0) | (t.text[1:] != t.text[:-1])
        cuts[:1] = True
        starts = np.nonzero(cuts)[0]
        inside = np.arange(len(h)) - np.repeat(starts, np.diff([*starts, len(h)]))
        key = np.add.reduceat(mix64(h + (inside.astype(np.uint64) + np.uint64(1)) * GOLD), starts)
    return starts, key


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, c): every distinct token of all documents with its count in the training ones; the end is the empty token."""

    def count(texts, outs):
        counts: Counter = Counter()
        seen: set = set()
        for t, out in zip(texts, outs, strict=True):
            words = tokens_of(t)
            if out:
                seen.update(words)
            else:
                counts.update(words)
        held = [*counts, *(w for w in seen if w not in counts)]
        return held, [counts[w] for w in held]

    return map_rows(docs.select("text", "held_out"), count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def squeezed(x: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(x.tobytes())


def opened(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstd.ZstdDecompressor().decompress(data), dtype=dtype)


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of one chunk's counts."""
    first, *others = pdf["data"]
    total = opened(first, np.uint64).copy()
    for d in others:
        total += opened(d, np.uint64)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "data": [squeezed(total)]})


def chunk_sums(df: DataFrame, add, size: int, more: DataFrame | None = None) -> DataFrame:
    """(chunk, data): sums over all rows of arrays of ``size`` counts, to which ``add(total, batch)`` adds a batch, and of those in ``more``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // CHUNK_CELLS) * CHUNK_CELLS, dtype=np.uint32)
        for b in batches:
            add(total[:size], b)
        flat = total.reshape(-1, CHUNK_CELLS)
        live = [k for k in range(len(flat)) if flat[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([squeezed(flat[k].astype(np.uint64)) for k in live], pa.binary())], names=["chunk", "data"])

    schema = "chunk int, data binary"
    # what all tasks made meets in parts of each chunk first, so that no task adds up all of it
    made = df.mapInArrow(build, schema).withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(8)))
    parts = made.groupBy("chunk", "part").applyInPandas(merge, schema)
    return (parts.union(more) if more is not None else parts).groupBy("chunk").applyInPandas(merge, schema)


def summed(df: DataFrame, add, size: int, into: np.ndarray | None = None) -> np.ndarray:
    """The sums of ``chunk_sums`` as one array; with ``into`` added to it in place."""
    flat = np.zeros(size, dtype=np.uint64) if into is None else into
    for r in chunk_sums(df, add, size).toLocalIterator():
        part = flat[r["chunk"] * CHUNK_CELLS : (r["chunk"] + 1) * CHUNK_CELLS]
        part += opened(bytes(r["data"]), np.uint64)[: len(part)]
    return flat


#: Chunk and its predictions, plain and with a bit taken out, compressed: what the driver holds of the tables.
Tables = list[tuple[int, bytes, bytes]]


def packed_tables(counts: DataFrame) -> Tables:
    """Predictions of ``counts(chunk, data)``, made in tasks; chunks without counts are left out."""

    def work(chunks, data):
        made = [packed(opened(d, np.uint64).reshape(-1, 2)) for d in data]
        return chunks, [squeezed(plain) for plain, _ in made], [squeezed(alone) for _, alone in made]

    rows = map_rows(counts.select("chunk", "data"), work, "chunk int, plain binary, alone binary").toLocalIterator()
    return [(r["chunk"], bytes(r["plain"]), bytes(r["alone"])) for r in rows]


def assembled(codes: Codes, tables: Tables, weights: np.ndarray, refine: np.ndarray) -> Model:
    size = -(-cells(codes) // CHUNK_CELLS) * CHUNK_CELLS
    plain, alone = np.zeros(size // 2, dtype=np.int16), np.zeros(size, dtype=np.int16)  # without counts both are zero
    for chunk, x, y in tables:
        at = chunk * CHUNK_CELLS
        plain[at // 2 : (at + CHUNK_CELLS) // 2] = opened(x, np.int16)
        alone[at : at + CHUNK_CELLS] = opened(y, np.int16)
    n = ORDERS << BITS
    orders = [(plain[o << BITS : (o + 1) << BITS], alone[o * (2 << BITS) : (o + 1) * (2 << BITS)]) for o in range(ORDERS)]
    return Model(codes, orders, (plain[n : n + codes.nodes], alone[2 * n : 2 * (n + codes.nodes)]), weights, refine)


def least_count(vocab: DataFrame, most: int) -> int:
    """The least count, two or more, such that no more than ``most`` tokens reach it."""
    by = vocab.filter("c > 1").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    small = by.filter("c < 10000").select("c", "n").union(by.filter("c >= 10000").groupBy(F.floor(F.log2("c") * 16).alias("k")).agg(F.max("c").alias("c"), F.sum("n").alias("n")).select("c", "n"))
    reached = 0
    for r in sorted(small.collect(), reverse=True):  # at most some ten thousand rows
        reached += r["n"]
        if reached > most:
            return r["c"] + 1
    return 2


def shipped(sc, coded: bytes, tables: Tables, weights: np.ndarray, refine: np.ndarray):
    """A broadcast of a model by a name of its own, in compressed parts; ``coded`` are its codes, pickled and compressed."""
    return sc.broadcast((uuid.uuid4().hex, coded, tables, weights, refine))


#: The model that this worker process unpacked last, by its name: tasks of one stage use the same.
UNPACKED: dict[str, Model] = {}


def received(shared) -> Model:
    name, coded, *rest = shared.value
    if name not in UNPACKED:
        UNPACKED.clear()
        UNPACKED[name] = assembled(pickle.loads(zstd.ZstdDecompressor().decompress(coded)), *rest)
    return UNPACKED[name]


def learned(texts: DataFrame, coded: bytes, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refinement) from all of ``texts(text)``: each task learns over its own, and tasks count by the bits they saw."""
    old_weights, old_refine = unlearned()
    shared = shipped(texts.sparkSession.sparkContext, coded, tables, old_weights, old_refine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = received(shared)
        learner = Learner(given.weights)
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                for _ in predicted([tokens_of(x) for x in b.column(0).slice(k, AT_ONCE).to_pylist()], False, given, learner):
                    pass
        if learner.seen.any():
            flat = np.concatenate([(learner.weights * learner.seen[:, None]).ravel(), learner.seen, learner.bins.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    rows = texts.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many rows as weights and bins
    shared.destroy()
    if not rows:
        return old_weights, old_refine
    flat = np.array([r["v"] for r in sorted(rows)])
    total, seen, bins = np.split(flat, [GATES * INPUTS, GATES * INPUTS + GATES])
    weights = np.where(seen[:, None] > 0, total.reshape(GATES, INPUTS) / np.maximum(seen, 1)[:, None], old_weights)
    n, ones = bins.reshape(2, REFINED, BINS)
    return np.round(weights, 6).astype(np.float32), ((ones + 20 * old_refine) / (n + 20)).astype(np.float32)


def match_gains(read: DataFrame, concentration: float = 0.5, discount: float = 0.5) -> DataFrame:
    """(row, gain): what the match model adds to a text's log10 probability.

    ``read(row, held_out, prev, cur, logp)`` has arrays of chunk keys and of the mix's log10 probabilities. Counts are of
    training texts; a training text's own chunk is taken out of them.
    """
    rows = read.select("row", "held_out", F.inline(F.arrays_zip("prev", "cur", "logp"))).filter("prev is not null")
    pairs = rows.filter(~F.col("held_out")).groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("c"))
    pairs = stored(pairs)
    totals = pairs.groupBy("prev").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("t"))
    known = rows.join(totals, "prev")
    known = known.withColumn("own", (~F.col("held_out")).cast("int")).filter("n - own > 0").join(pairs, ["prev", "cur"], "left")
    c = F.coalesce("c", F.lit(0)) - F.col("own")
    n = F.col("n") - F.col("own")
    t = F.col("t") - F.when(c == 0, F.col("own")).otherwise(0)
    p = (F.greatest(c - discount, F.lit(0.0)) + (concentration + discount * t) * F.pow(F.lit(10.0), "logp")) / (n + concentration)
    least = F.log10((concentration + discount * t) / (n + concentration)) + F.col("logp")  # where the power is below any double
    return known.groupBy("row").agg(F.round(F.sum(F.greatest(F.log10(p), least) - F.col("logp")), 9).alias("gain"))


def text_scores(docs: DataFrame, mod: int = 5, rest: int = 1, frequent_words: int = 200_000, learning_share: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for ``docs(doc_id, text)``.

    Counts come from all rows that are not held out. ``frequent_words`` bounds the words that have
    codes, all of which are broadcast; context tables have a fixed number of slots for each order, in
    which contexts may meet; one in ``learning_share`` training rows teaches the weights. The
    chunk counts of the match model are tables that grow with the corpus. Null and empty texts are
    the end token alone; repeated rows are scored (and counted) each; other columns are ignored;
    an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), held_out(mod, rest).alias("held_out"))
    vocab = stored(vocabulary(rows))
    n_train, n_distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    frequent = sorted((bytes(r["token"]), r["c"]) for r in vocab.filter(F.col("c") >= least_count(vocab, frequent_words)).toLocalIterator())
    words, counts = [w for w, _ in frequent], [c for _, c in frequent]
    codes = codes_of(words, counts, n_train - sum(counts))
    base_of = F.log10((F.col("c") + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
    base_head = np.log10((np.array([*counts, 0], dtype=float) + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
    base_head[-1] = 0.0
    coder = sc.broadcast(codes)

    def count(total: np.ndarray, b: pa.RecordBatch) -> None:
        for k in range(0, len(b), AT_ONCE):
            count_texts([tokens_of(x) for x in b.column(0).slice(k, AT_ONCE).to_pylist()], coder.value, total)

    teaches = F.pmod(F.xxhash64(F.lit(2), "doc_id", "text"), F.lit(learning_share)) == 0
    train = rows.filter(~F.col("held_out"))
    teachers, others = train.filter(teaches).select("text"), train.filter(~teaches).select("text")
    coded = zstd.ZstdCompressor(level=1).compress(pickle.dumps(codes, protocol=5))
    size = cells(codes)
    sums = stored(chunk_sums(others, count, size))
    weights, refine = learned(teachers, coded, packed_tables(sums))
    shared = shipped(sc, coded, packed_tables(chunk_sums(teachers, count, size, sums)), weights, refine)

    def look(ids, texts, outs):
        model, n = received(shared), len(ids)
        columns: list[list] = [ids, outs, [len(t) for t in texts], *([None] * n for _ in range(7))]
        for at, out in ((at, out) for at in range(0, n, AT_ONCE) for out in (False, True)):
            some = [k for k in range(at, min(at + AT_ONCE, n)) if outs[k] == out]
            for part, t, logs in predicted([tokens_of(texts[k]) for k in some], not out, model):
                starts, keys = chunks(t, model.codes)
                ends = np.searchsorted(t.text, np.arange(len(part)), side="right")
                rare, cuts = np.searchsorted(t.rare, ends), np.searchsorted(starts, ends)
                chunk, base, known = keys.view(np.int64).tolist(), np.concatenate([[0], np.cumsum(base_head[t.ids])]), 0
                log10 = (np.add.reduceat(logs, starts) / np.log(10)).tolist()
                last = [0, 0, 0]
                for k, e, r, c in zip(part.tolist(), ends.tolist(), rare.tolist(), cuts.tolist(), strict=True):
                    n_tokens, mine = e - last[0], chunk[last[2] : c]
                    known = n_tokens - (r - last[1])
                    values = n_tokens, known, float(base[e] - base[last[0]]), t.spelled[last[1] : r], [None, *mine[:-1]], mine, log10[last[2] : c]
                    for column, value in zip(columns[3:], values, strict=True):
                        column[some[k]] = value
                    last = [e, r, c]
        return tuple(columns)

    schema = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, rare array<binary>, prev array<bigint>, cur array<bigint>, logp array<double>"
    read = stored(map_rows(rows, look, schema).withColumn("row", F.monotonically_increasing_id()))
    spelled = read.select("row", F.explode("rare").alias("token")).join(vocab.withColumn("base", base_of), "token")
    extra = spelled.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.round(F.sum("base"), 9).alias("more_base"))
    logp = F.aggregate("logp", F.lit(0.0), lambda a, x: a + x)
    score = F.col("logp_sum") + F.coalesce("gain", F.lit(0.0))
    slim = read.select("row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", logp.alias("logp_sum"))
    return slim.join(extra, "row", "left").join(match_gains(read), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score / F.lit(np.log10(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
