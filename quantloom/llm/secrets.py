"""Secret scans: base patterns, and credential values whose password guess cost is high.

A value that follows a credential word is segmented at minimum cost into dictionary words,
dates, repeats, keyboard walks and brute-force spans (dynamic programming over its characters;
costs are log10 guesses). Values that a guesser would need many tries for are secrets, even
where no fixed pattern fits; ``password: changeme2024`` is not. The dictionary is the corpus's
own most frequent words, ranked by a Spark aggregate over all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, map_rows, whole_row

KINDS = ("assign", "access", "hex", "guess")
#: What introduces a credential, the pattern kinds of the base, and keyboard rows.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ASSIGN_STARTS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CONTEXT = re.compile(
    rb"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|client[_-]?secret)s?[\"']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*[\"']?([^\s\"',;<>()\x00-\x1f]+)",
    re.I,
)
CONTEXT_STARTS = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"api", b"access", b"private", b"credential", b"client")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Words of common passwords and placeholders, which rank before the corpus's own.
COMMON = (
    "password passwd pass admin root user login guest test secret letmein welcome changeme default master dragon monkey "
    "football baseball shadow sunshine princess superman batman iloveyou trustno hello freedom whatever access token key "
    "example sample dummy placeholder your here insert none null true false value string redacted hidden xxx"
).split()
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:(?:19|20)\d\d|\d\d)")
YEAR = re.compile(r"(?:19|20)\d\d")
LEET = str.maketrans("4301$57@!", "aeolsstai")


def walks() -> dict[str, tuple[int, int]]:
    """Where each key lies: (row, place)."""
    return {c: (r, i) for r, row in reversed(list(enumerate(ROWS))) for i, c in enumerate(row)}


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 guesses of a dictionary word, as it is or with digits for letters, in some capitalisation; None if it is none."""
    lower = part.lower()
    rank = ranks.get(lower)
    turned = ranks.get(lower.translate(LEET)) if rank is None else None
    if rank is None and turned is None:
        return None
    caps, n = sum(x.isupper() for x in part), len(part)
    variants = 1 if not caps else 2 if caps == n or (caps == 1 and part[0].isupper()) else math.comb(n, caps) + 1
    return math.log10((rank or turned) + 1) + math.log10(variants) + (0.0 if rank is not None else 0.6)


def letter_cost(c: str) -> float:
    """log10 of the characters of its kind: digits, small or capital letters, other ASCII, the rest."""
    return math.log10(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if c.isascii() else 1000)


def heads_of(ranks: dict[str, int]) -> dict[str, int]:
    """Length of the longest dictionary word for each beginning of three letters."""
    out: dict[str, int] = {}
    for w in ranks:
        out[w[:3]] = max(out.get(w[:3], 0), len(w))
    return out


def plain_segments(value: str, i: int, ranks: dict[str, int], heads: dict[str, int], longest: int) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of every date, keyboard walk and word that begins at ``i``."""
    n, c = len(value), value[i]
    if c.isdigit():
        ends = {m.end() for m in [DATE.match(value, i)] if m} | ({i + 4} if YEAR.match(value, i) else set())
        yield from ((j, 2.0 if j - i <= 4 else 4.6) for j in ends)
    row, place = WALKS.get(c.lower(), (-1, 0))
    for step in (1, -1):  # a walk along a row of keys
        j, at = i + 1, place + step
        while j < n and row >= 0 and 0 <= at < len(ROWS[row]) and ROWS[row][at] == value[j].lower():
            j, at = j + 1, at + step
            if j - i >= 3:
                yield j, math.log10(4 * 10 * (j - i))
    head = value[i : i + 3].lower()
    for j in range(i + 3, min(n, i + min(longest, max(heads.get(head, 0), heads.get(head.translate(LEET), 0)))) + 1):
        cost = word_cost(value[i:j], ranks)
        if cost is not None:
            yield j, cost


def repeat_cost(value: str, i: int, size: int) -> float | None:
    """log10 guesses of the block of ``size`` at ``i`` that repeats at once, from where it begins, and is cheap to repeat; else None.

    A single character must come three times, a longer block twice.
    """
    block = value[i : i + size]
    if block != value[i + size : i + 2 * size] or (size == 1 and value[i + 2 : i + 3] != block) or (i >= size and value[i - size : i] == block):
        return None
    return letter_cost(block) if size == 1 else size * math.log10(36)


def repeat_end(value: str, i: int, size: int) -> int:
    """Where the repetition with period ``size`` that begins at ``i`` breaks off: by comparing slices that double."""
    k, step = 0, 64
    while step:
        if i + size + k + step <= len(value) and value[i + k : i + k + step] == value[i + size + k : i + size + k + step]:
            k, step = k + step, step * 2
        else:
            step //= 2
    return i + size + k


def segments(value: str, i: int, ranks: dict[str, int], longest: int, heads: dict[str, int] | None = None) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of every word, date, repeat and keyboard walk that begins at ``i``."""
    yield from plain_segments(value, i, ranks, heads_of(ranks) if heads is None else heads, longest)
    for size in range(1, (len(value) - i) // 2 + 1):
        cost = repeat_cost(value, i, size)
        if cost is not None:
            for times in range(3 if size == 1 else 2, (repeat_end(value, i, size) - i) // size + 1):
                yield i + times * size, cost + math.log10(times)


def guess_cost(value: str, ranks: dict[str, int], longest: int = 48, enough: float | None = None, heads: dict[str, int] | None = None) -> float:
    """Least log10 guesses over all segmentations of ``value``; words are looked up to ``longest`` characters.

    With ``enough`` only the side of it on which the cost lies is asked, and some number on that side is returned.
    """
    heads = heads_of(ranks) if heads is None else heads
    if enough is not None:
        return side_of(value, ranks, longest, enough, heads)
    n = len(value)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] + (math.log10(2) if i else 0.0)  # another segment doubles what must be tried
        best[i + 1] = min(best[i + 1], best[i] + letter_cost(value[i]))
        for j, cost in segments(value, i, ranks, longest, heads):
            best[j] = min(best[j], here + cost)
    return best[n]


def side_of(value: str, ranks: dict[str, int], longest: int, enough: float, heads: dict[str, int]) -> float:
    """A number on the side of ``enough`` (50 at most) on which the guess cost of ``value`` lies, in time linear in its length.

    Places that cost enough are not followed up, so blocks that cost enough once are no repeats here, and a
    repetition is carried along as what its next round costs. Deep inside one where nothing else has begun for
    ``quiet`` characters, nothing else can begin until it breaks off, and single characters up to there would cost enough: the rest is skipped.
    """
    n, sizes, quiet = len(value), range(1, int(enough / math.log10(36)) + 1), longest + 12
    if n == 0:
        return 0.0
    ahead = {0: 0.0}  # what segmentations have got to, from the place being looked at
    repeats: list[tuple[int, int, float, int]] = []  # begin, size, cost but for the times, end
    i, still, final = 0, 0, math.inf
    while i < n:
        now = ahead.pop(i, math.inf)
        repeats = [r for r in repeats if r[3] >= i]
        for begin, size, cost, _ in repeats:
            times, part = divmod(i - begin, size)
            if part == 0 and times >= (3 if size == 1 else 2):
                now = min(now, cost + math.log10(times))
        still += 1
        if now < enough:
            here = now + (math.log10(2) if i else 0.0)
            steps = [(i + 1, now + letter_cost(value[i]))]
            for j, cost in plain_segments(value, i, ranks, heads, longest):
                steps.append((j, here + cost))
                still = 0
            for size in sizes:
                cost = repeat_cost(value, i, size)
                if cost is not None:
                    still, end = 0, repeat_end(value, i, size)
                    times = (end - i) // size
                    repeats.append((i, size, here + cost, i + times * size))
                    if i + times * size == n:
                        steps.append((n, here + cost + math.log10(times)))
            for j, cost in steps:
                if j == n:
                    final = min(final, cost)
                elif cost < ahead.get(j, math.inf):
                    ahead[j] = cost
        elif any(True for _ in plain_segments(value, i, ranks, heads, longest)) or any(repeat_cost(value, i, size) is not None for size in sizes):
            still = 0  # something begins here, though it is not followed up
        if final < enough:
            return final
        i += 1
        least = min([final, *ahead.values(), *(cost + math.log10(max(2, (i - begin) // size)) for begin, size, cost, end in repeats if end >= i)])
        if least >= enough:
            return least
        far = max((end for begin, _, _, end in repeats if i - begin >= 2 * quiet), default=0) - 2 * quiet
        if still >= quiet and far > i:
            i, ahead = far, {}
    return final


WALKS = walks()


def starts_of(low: bytes, words: tuple[bytes, ...]) -> list[int]:
    found = set()
    for w in words:
        at = low.find(w)
        while at >= 0:
            found.add(at)
            at = low.find(w, at + 1)
    return sorted(found)


def matches_at(pattern: re.Pattern, text: bytes, starts: list[int]) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches, given all places where one can begin."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def secret_spans(text: bytes | None, ranks: dict[str, int], least_cost: float = 8.0, heads: dict[str, int] | None = None) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) in code points, by start and then kind as in KINDS."""
    text, heads = text or b"", heads_of(ranks) if heads is None else heads
    low = text.lower()
    found = []
    for m in matches_at(ASSIGN, text, starts_of(low, ASSIGN_STARTS)):
        if m.end(2) - m.start(2) >= 12:
            found.append(("assign", *m.span(), *m.span(2)))
    found += [("access", *m.span(), *m.span()) for m in matches_at(ACCESS, text, starts_of(text, (b"AKIA",))) if m.end() - m.start() >= 18]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    values = [(a, b) for *_, a, b in found]
    for m in matches_at(CONTEXT, text, starts_of(low, CONTEXT_STARTS)):
        a, b = m.span(1)
        value = m[1].rstrip(b".!?:")
        b = a + len(value)
        if any(x <= a and b <= y for x, y in values):
            continue
        if guess_cost(value.decode("utf-8", "replace"), ranks, enough=least_cost, heads=heads) >= least_cost:
            found.append(("guess", *m.span()[:1], b, a, b))
    if not text.isascii() and found:
        ends = sorted({x for _, *span in found for x in span})
        place, at, chars = {}, 0, 0
        for x in ends:
            chars += len(text[at:x].decode("utf-8", "replace"))
            at = x
            place[x] = chars
        found = [(k, *(place[x] for x in span)) for k, *span in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def word_ranks(docs: DataFrame, top: int = 20_000) -> dict[str, int]:
    """Rank from 1 of the ``top`` most frequent alphabetic words of three letters or more in all texts.

    The dictionary's size is the parameter ``top``; ties go to the lesser word.
    """

    def count(texts):
        counts: Counter = Counter()
        for t in texts:
            counts.update((t or b"").lower().split())
        words = [(w, n) for w, n in counts.items() if 3 <= len(w) <= 48]
        return [w for w, _ in words], [n for _, n in words]

    counted = map_rows(docs.select(F.col("text").cast("binary")), count, "word binary, n long")
    word = F.regexp_replace(F.col("word").cast("string"), r"[.,!?;:]+$", "")
    words = cut(counted.groupBy(word.alias("word")).agg(F.sum("n").alias("n")).filter(F.col("word").rlike(r"^\p{L}{3,}$")))
    by_size = words.groupBy(F.floor(8 * F.log2("n")).alias("k")).count().orderBy(F.desc("k")).collect()  # a few hundred rows
    reached, least = 0, 0
    for r in by_size:
        reached, least = reached + r["count"], r["k"]
        if reached >= top:
            break
    rows = words.filter(F.floor(8 * F.log2("n")) >= least).orderBy(F.desc("n"), "word").limit(top).collect()
    ranks: dict[str, int] = {}
    for word in [*COMMON, *(r["word"] for r in rows)]:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


def scanned(docs: DataFrame, carry: Column, top: int = 20_000, least_cost: float = 8.0) -> DataFrame:
    """(carried, text, spans) for each row of ``docs``: spans are kind:start:end:value_start:value_end strings."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, top))
    heads = docs.sparkSession.sparkContext.broadcast(heads_of(ranks.value))
    slim = docs.select(carry.alias("carried"), "text")
    fields = slim.withColumn("spans", F.array().cast("array<string>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            spans = [[":".join(map(str, s)) for s in secret_spans(t, ranks.value, least_cost, heads.value)] for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.list_(pa.string()))], names=fields.names)

    return slim.mapInArrow(run, fields)


def secret_report(docs: DataFrame, top: int = 20_000, least_cost: float = 8.0) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are those of whole matches; kind guess adds credential values that no base span covers
    whole and whose guess cost is high.
    Texts and values of any length are read whole; spans that begin together go by kind. Null and empty texts have none; repeated rows each get their row; other columns are ignored;
    an empty table gives an empty result.
    """
    found = scanned(docs, F.col("doc_id").cast("long"), top, least_cost)
    part = lambda s, i: F.element_at(F.split(s, ":"), i)
    short = F.transform("spans", lambda s: F.substring_index(s, ":", 3))
    base = F.filter(short, lambda s: part(s, 1) != "guess")
    n = lambda kind: F.size(F.filter(short, lambda s: part(s, 1) == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("carried").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(short, ",").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", top: int = 20_000, least_cost: float = 8.0) -> DataFrame:
    """``docs`` with every secret value replaced by ``mark`` and n_chars counted anew; clean rows are unchanged.

    All columns stay, whatever their names; null texts stay null, and an empty table stays empty.
    """
    found = scanned(docs, whole_row(docs), top, least_cost)
    end = lambda s, i: F.element_at(F.split(s, ":"), i).cast("int")
    ends = F.transform("spans", lambda s: F.struct(end(s, 4).alias("a"), end(s, 5).alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        fresh = F.when(x["a"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["a"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(fresh.alias("out"), F.greatest(acc["at"], x["b"]).alias("at"))

    done = F.aggregate(F.array_sort(ends), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.lit(1 << 30))))
    clean = F.size("spans") == 0
    out = found.select("carried", clean.alias("clean"), F.when(clean, F.col("text")).otherwise(done).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("clean"), F.col("carried.n_chars")).otherwise(F.length("text").cast("long"))}
    return out.select(*(new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))
