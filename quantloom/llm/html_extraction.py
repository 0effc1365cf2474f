"""HTML main-text extraction by consensus host paths.

Each page's containers are scored by the share of its running text that they hold, and the
deepest container that holds most of it is widened to the article around it, which votes, under
a generalised tag-class path, for its host. The votes are summed in Spark; every page is then extracted again along its host's
winning path, or along its own best where it lacks that path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, map_rows
from quantloom.llm.url_filter import host_of

#: Comments; raw text up to its end tag (scripts and styles that never end take the rest, as browsers have it); whole elements that are
#: no text, where they do end; declarations; tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<(title|textarea|noscript|template|iframe|xmp)\b[^>]*(?<!/)>(?:(?!<\2\b).)*?</\2\s*>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed values of HTML: elements that hold others, other elements that end a block, and names that mark what is not the article.
CONTAINERS = frozenset("html head body main article section div aside nav header footer form ul ol dl table tbody thead tfoot tr blockquote figure details dialog menu fieldset center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption summary legend option".split())
NEVER = frozenset("head nav aside footer form menu dialog fieldset".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay sidebar side aside widget widgets related recommended share sharing social comment comments commentlist respond reply replies disqus breadcrumb breadcrumbs pagination pager menu nav "
    "navbar navigation topbar toolbar footer masthead newsletter subscribe subscription signup login search skip hidden".split()
)
#: Words that a compound name may hold beside a mark (``share-buttons``, ``cookie-box``); with any other (``share-price``) it is no mark.
BESIDE = frozenset(
    "area articles bar block bottom box button buttons center container field form heading header icon icons inner item items large left link links list main mobile outer page panel posts right "
    "section site slot small sticky stories thread title top unit wrap wrapper".split()
)
#: Elements whose own text is none of the page's; they end with their end tag, or where a block begins that cannot be inside.
SILENT = frozenset("svg object select button iframe noscript template textarea".split())
#: Elements whose marks never count, and the open elements that each of these closes by itself, as far as the table around it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption figcaption legend summary".split())
CLOSES = {"tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
CONTENT = frozenset("article content main post entry story body text".split())

#: Elements that are parts of a text, never the whole of an article, and those that are one by name.
PARTS = frozenset("ul ol dl table tbody thead tfoot tr blockquote figure details center".split())
WHOLE = ("article", "main")


def marked(name: str) -> bool:
    """Whether a class or id as a whole names something that is not the article."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


def named(attributes: str, tag: str = "div") -> tuple[str, bool]:
    """(generalised class suffix, whether the attributes mark something that is not the article).

    Headings are never marked by a name, and other parts of a text by a class alone, not by an id.
    """
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    classes = found.get("class", "").lower().split()
    names = [] if tag in HEADINGS else [*classes, *found.get("id", "").lower().split()[: tag in CONTAINERS]]
    bare = ATTRIBUTE.sub("", attributes).lower().split()
    hidden = "hidden" in bare or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    junk = any(map(marked, names)) or found.get("role", "").lower() in ROLES or hidden
    return "".join("." + re.sub(r"\d+", "#", c).replace("/", "|") for c in sorted(classes)), junk


class Page:
    """A page's container paths as a tree (node 0: the page), and its blocks: (node, raw text, characters of it in links)."""

    def __init__(self) -> None:
        self.parent, self.step, self.depth = [-1], [""], [0]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []

    def child(self, node: int, step: str) -> int:
        k = self.known.setdefault((node, step), len(self.step))
        if k == len(self.step):
            self.parent.append(node)
            self.step.append(step)
            self.depth.append(self.depth[node] + 1)
        return k

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return "".join("/" + x for x in reversed(steps))

    def node(self, path: str) -> int | None:
        """The node of a path, None where the page lacks it."""
        at: int | None = 0
        for step in path.split("/")[1:]:
            at = self.known.get((at, step))
            if at is None:
                return None
        return at

    def summed(self, values: list[int]) -> list[int]:
        """For each node the sum over the blocks in and below it of ``values``, one for each block; children follow their parents."""
        out = [0] * len(self.step)
        for (node, _, _), v in zip(self.blocks, values, strict=True):
            out[node] += v
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def below(self, top: int) -> list[str]:
        """Cleaned texts of the blocks in and below a node, in page order, without empty ones."""
        inside = [k == top for k in range(len(self.step))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parent[k]]
        return [x for x in (cleaned(text) for node, text, _ in self.blocks if inside[node]) if x]


def parsed(page: str) -> Page:
    """The blocks of a page outside what is never the article.

    Marks of what is not the article count on containers and parts of a text, but not on a container that
    holds most of the page's text (a class like ``sidebar-right`` on the whole page). A table's rows and
    sections end where the next begins, with or without end tags.
    """
    out = Page()
    raw: list[tuple[int, str, int, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, node, left out for good, innermost marked container around
    opened: Counter = Counter()
    outer = [0]  # for each marked container the one around it
    node, skip, around = 0, False, 0
    block_skip = False
    silent, inline = "", ["", 0]  # the silent element that is open; the marked inline element and how often it is open
    parts: list[str] = []
    linked = 0
    in_link = False
    at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if not text.isspace():
                raw.append((node, text, linked, around))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for t, *_ in stack[k:]:
            opened[t] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if not (skip or block_skip or silent or inline[1]) and m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                linked += len(text)
        at = m.end()
        if m[4] is None:
            continue
        tag, closing, given = m[4].lower(), bool(m[3]), m[5]
        if silent == "select" and tag == "option":
            continue
        if silent and (tag == silent or tag in BREAKS):
            silent = ""
            if tag in SILENT:
                continue
        if tag in SILENT:
            if not (closing or given.rstrip().endswith("/")):
                silent = tag
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "td", "th"):
            if not (skip or block_skip or silent or inline[1]):
                parts.append(" ")
        if tag in BREAKS:
            end_block()
            inline[:] = "", 0
            block_skip = False
            suffix, junk = named(given, tag) if given and not closing and not given.isspace() else ("", False)
            if tag not in CONTAINERS:
                block_skip = junk
                continue
            if closing:
                if opened[tag]:
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            else:
                if tag == "body":
                    while stack and stack[-1][0] == "head":
                        close(len(stack) - 1)
                if tag in CLOSES and any(opened[t] for t in CLOSES[tag]):
                    k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "table" or stack[i][0] in CLOSES[tag]), None)
                    if k is not None and stack[k][0] != "table":
                        close(k)
                node, skip, around = stack[-1][1:] if stack else (0, False, 0)
                whole = any(opened[t] for t in WHOLE)
                never = tag in NEVER or (tag == "header" and not whole)
                if junk and tag not in ("html", "body", *WHOLE):
                    outer.append(around)
                    around = len(outer) - 1
                stack.append((tag, out.child(node, tag + suffix), never or skip, around))
                opened[tag] += 1
            node, skip, around = stack[-1][1:] if stack else (0, False, 0)
        elif tag == inline[0]:
            inline[1] += -1 if closing else 1
            if not inline[1]:
                inline[0] = ""
        elif not (closing or inline[1] or tag in VOID or tag in SILENT) and given and "=" in given and named(given, tag)[1]:
            inline[:] = tag, 1
    if not (skip or block_skip or silent or inline[1]) and at < len(page):
        parts.append(page[at:])
    end_block()
    held = [0] * len(outer)
    for _, text, _, mark in raw:
        held[mark] += len(text)
    for k in range(len(outer) - 1, 0, -1):
        held[outer[k]] += held[k]
    # a marked container holds at least what one inside it does, so the innermost decides
    out.blocks = [(n, text, links) for n, text, links, mark in raw if not mark or 2 * held[mark] > held[0]]
    return out


def article_around(page: Page, node: int) -> int:
    """The outermost article or else main that holds ``node``; without one, as far up as what is added is mostly not links.

    Parts of a text (lists, tables, quotations) always give way to what holds them; the body and
    the document are taken for an article only then.
    """
    bare = lambda k: page.step[k].partition(".")[0]
    above = [node]
    while above[-1]:
        above.append(page.parent[above[-1]])
    for name in WHOLE:
        for k in reversed(above):
            if bare(k) == name:
                return k
    sizes = page.summed([len(cleaned(text)) for _, text, _ in page.blocks])
    links, count = page.summed([n for _, _, n in page.blocks]), page.summed([1] * len(page.blocks))
    best = node
    for inner, around in zip(above, above[1:]):
        part, beside = bare(inner) in PARTS, count[around] - count[inner]
        if not part and (bare(around) in ("", "html", "body") or 2 * (links[around] - links[inner]) > sizes[around] - sizes[inner]):
            break
        if part or beside:
            best = around
    return best


def best_container(page: Page, share: float = 0.6) -> tuple[int, float]:
    """(node, share) of the article around the deepest container with most of the text outside links; article-like names need less."""
    held = page.summed([max(len(text) - linked, 0) for _, text, linked in page.blocks])
    total = held[0]
    if not total:
        return 0, 0.0

    def enough(k: int) -> bool:
        words = set(re.split(r"[^a-z]+", page.step[k]))
        return held[k] >= (share / 2 if words & CONTENT and page.step[k] != "body" else share) * total

    fits = [k for k in range(len(held)) if not k or enough(k)]
    most = max((page.depth[k], held[k]) for k in fits)
    node = article_around(page, max((k for k in fits if (page.depth[k], held[k]) == most), key=page.path))
    return node, held[node] / total


def cleaned(raw: str) -> str:
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def extract(html: str | None, winner: str | None) -> str:
    """The page's main text along ``winner``, or along its own best container."""
    page = parsed(html or "")
    node = None if winner is None else page.node(winner)
    chosen = [] if node is None else page.below(node)
    return "\n".join(chosen or page.below(best_container(page)[0]))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path that most of the host's pages vote for; ties go to the greater share, then the path."""

    def vote(hosts, htmls):
        pages = [parsed(h or "") for h in htmls]
        got = [best_container(p) for p in pages]
        return hosts, [p.path(k) for p, (k, _) in zip(pages, got, strict=True)], [s for _, s in got]

    votes = map_rows(pages.select("host", "html"), vote, "host string, path string, share double").filter("share > 0")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("share"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "share", "path")).alias("path"))


def main_text(pages: DataFrame, broadcast_hosts: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages(page_id, url, html)``.

    Null and empty html give an empty text. Pages without a host form a group of their own.
    Pages of any length and depth are read whole, in time in proportion to their length. Paths that tie in votes go by
    share, then by name. Repeated rows each get their row; other columns are ignored; an empty table gives an empty
    result. The winners, a row per host,
    are broadcast up to ``broadcast_hosts`` hosts and joined by a shuffle beyond.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    winners = cut(host_paths(rows))
    few = winners.count() <= broadcast_hosts
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")
    fields = joined.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, fields)
