"""Main text of web pages, by gradient-boosted trees over the features of DOM nodes.

Each element gets features of its subtree (text, density, links, punctuation), its attribute tokens
(hashed), its depth, and its place among its siblings. Boosted regression trees give the log-odds
that it is main content. Decoding is hierarchical: a node that is chosen brings its whole subtree, so
no ancestor and descendant can contradict each other; of all such choices the one with the greatest
sum of log-odds is taken, by one pass from the leaves to the root.

The trees are fitted on at most MOST_PAGES pages that mark their main text themselves (`article`, `main`
or role=main); those names are hidden from the features, so that pages without such marks are judged by
the rest.

Defined results: a null page gives a null text, an empty one an empty text. Broken markup is repaired as
browsers roughly do; what isn't markup is text. Without any marked page there is no model: then all text
outside script, style and the like is kept. A page none of whose nodes is likely to be main content gives an
empty text. Where a whole subtree and the best choice of its parts have equal sums, the whole subtree is taken; a sum of 0
isn't. Pages are read to their end, however long, nested or broken; the work grows with a page's length alone. An empty
table gives no rows. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.session import tuned

MOST_PAGES = 400
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32
BUCKETS = 8
SCHEMA = "page_id long, url string, text string, nodes long, chosen long"

_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/><]*+)|[!?])")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe textarea".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES = {t: frozenset(["p"]) for t in _BLOCK} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_STOPS = frozenset("table ul ol dl div section article main body html".split())
_MAIN = frozenset(["article", "main"])
_KINDS = [frozenset(x.split()) for x in ("p pre blockquote", "ul ol li dl dt dd", "h1 h2 h3 h4 h5 h6", "a", "b i em strong span code small sub sup br", "table thead tbody tr td th", "nav footer header aside form button menu select", "title head meta link base")]
_MARKS = re.compile(r"[.,;:!?]")
_WORD = re.compile(r"\w+")


class Page:
    """The elements of a page in document order, and its pieces of text with the elements that hold them."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.tokens, self.main = ["#root"], [-1], [()], [False]
        #: The nearest block of each element: itself, or one above it.
        self.blocks = [0]
        self.texts: list[tuple[int, str]] = []
        self._source, self._last, self._ends, self._gap, self._broken = source, {}, {}, (0, -1), False
        open_, depths = [0], defaultdict(list)  # open elements, and for each tag's name where in that list it is
        at = look = 0

        def close(k: int) -> None:
            for node in open_[k:]:
                depths[self.tags[node]].pop()
            del open_[k:]

        while (found := _START.search(source, look)) is not None:
            start, name = found.start(), found.group(3)
            if name is not None:
                end = self._end(found.end())
            elif found.group(1):
                end = source.find("-->", start + 4) + 3
                end = end if end > 2 else len(source)
            else:
                end = self._next(">", found.end()) + 1 or -1
            if end < 0:  # never closed, so it's text
                look = start + 1
                continue
            if start > at:
                self._text(open_[-1], source[at:start])
            at = look = end
            if name is None:
                continue
            name = name.lower()
            if found.group(2):
                if depths[name]:
                    close(depths[name][-1])
                continue
            attributes = source[found.end() : end - 1]
            if name in _RAW:
                if not attributes.rstrip().endswith("/"):
                    raw = re.compile(rf"</{re.escape(name)}", re.I).search(source, at)
                    past = source.find(">", raw.end()) if raw else -1
                    at = look = past + 1 if past >= 0 else len(source)
                continue
            if closes := _CLOSES.get(name):
                nearest = max((depths[x][-1] for x in closes if depths[x]), default=0)
                if nearest and nearest > max((depths[x][-1] for x in _STOPS if depths[x] and x not in closes), default=0):
                    close(nearest)
            tokens = [t.lower() for m in _ATTRIBUTE.finditer(attributes) for t in (m.group(2) or m.group(3) or m.group(4) or "").split()] if "=" in attributes else []
            self.tags.append(name)
            self.parents.append(open_[-1])
            self.blocks.append(len(self.tags) - 1 if name in _BLOCK else self.blocks[open_[-1]])
            self.main.append(self.main[open_[-1]] or name in _MAIN or "main" in tokens and "role" in attributes.lower())
            self.tokens.append(tuple(t for t in tokens if t not in _MAIN))
            if name not in _VOID and not attributes.endswith("/"):
                depths[name].append(len(open_))
                open_.append(len(self.tags) - 1)
        if at < len(source):
            self._text(open_[-1], source[at:])
        del self._source, self._last, self._ends, self._gap

    def _next(self, mark: str, at: int) -> int:
        """Where the mark is next; -1 if nowhere."""
        if (last := self._last.get(mark)) is None:
            last = self._last[mark] = self._source.rfind(mark)
        return self._source.find(mark, at) if at <= last else -1

    def _edge(self, at: int) -> int:
        """Where the next quote or > is; -1 if nowhere. Looked up once for all places before it."""
        low, edge = self._gap
        if not low <= at <= edge:
            edge = min((x for x in (self._next(mark, at) for mark in "\"'>") if x >= 0), default=-1)
            self._gap = (at, edge if edge >= 0 else len(self._source))
        return edge if edge < len(self._source) else -1

    def _end(self, at: int) -> int:
        """Where a tag ends that is open at `at`, outside of quotes; -1 if nowhere. What was looked up on the way is kept."""
        if not self._broken:
            if (whole := _REST.match(self._source, at)) is not None:
                return whole.end()
            self._broken = True  # some tag isn't closed: from now on, nothing is read twice
        passed, ends = [], self._ends
        while True:
            edge = self._edge(at) if not passed else min((x for x in (self._next(mark, at) for mark in "\"'>") if x >= 0), default=-1)
            if edge < 0:
                end = -1
                break
            if (mark := self._source[edge]) == ">":
                end = edge + 1
                break
            if edge in ends:
                end = ends[edge]
                break
            passed.append(edge)
            if (other := self._next(mark, edge + 1)) < 0:
                end = -1
                break
            at = other + 1
        ends.update(dict.fromkeys(passed, end))
        return end

    def _text(self, node: int, text: str) -> None:
        if "&" in text:
            text = html.unescape(_LONG_REFERENCE.sub("\ufffd", text))
        text = " ".join(text.split())
        if text:
            self.texts.append((node, text))

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parents = np.array(self.parents)
        depth = np.zeros(n)
        own, linked, marks, words, upper = (np.zeros(n) for _ in range(5))
        first = np.full(n, np.inf)
        in_link = np.zeros(n, bool)
        aside = np.zeros(n, bool)
        tags, chain = self.tags, self.parents
        order, seen, children = np.zeros(n), np.zeros(n), np.zeros(n)
        same_before = np.zeros(n)
        last_tag: dict[int, str] = {}
        for k in range(1, n):
            p = chain[k]
            depth[k] = depth[p] + 1
            in_link[k] = in_link[p] or tags[k] == "a"
            aside[k] = aside[p] or tags[k] in _KINDS[6]
            order[k] = children[p]
            children[p] += 1
            same_before[k] = last_tag.get(p) == tags[k]
            last_tag[p] = tags[k]
        place = 0
        for node, text in self.texts:
            own[node] += len(text)
            marks[node] += len(_MARKS.findall(text))
            words[node] += text.count(" ") + 1
            upper[node] += sum(map(str.isupper, text))
            first[node] = min(first[node], place)
            place += len(text)
        linked[in_link] = own[in_link]
        chars, tagged = own.copy(), np.ones(n)
        for k in range(n - 1, 0, -1):
            p = chain[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
            marks[p] += marks[k]
            words[p] += words[k]
            upper[p] += upper[k]
            tagged[p] += tagged[k]
            first[p] = min(first[p], first[k])
        up = np.maximum(parents, 0)
        some = np.maximum(chars, 1)
        density, links = chars / tagged, linked / some
        whole = max(chars[0], 1)
        columns = [
            depth, np.log1p(chars), chars / whole, np.log1p(tagged), np.log1p(density), links, np.log1p(own), children,
            order, children[up], order / np.maximum(children[up] - 1, 1), chars / np.maximum(chars[up], 1), links[up], np.log1p(density[up]),
            marks / some, some / np.maximum(words, 1), upper / some, same_before, aside, np.where(np.isfinite(first), first, place) / whole,
            np.log1p(chars[up]), children[up[up]], chars == 0,
        ]
        columns += [np.fromiter((t in kind for t in tags), float, n) for kind in _KINDS]
        hashed = np.zeros((BUCKETS, n))
        for k, tokens in enumerate(self.tokens):
            for t in tokens:
                hashed[zlib.crc32(t.encode()) % BUCKETS, k] = 1
        return np.stack([*columns, *hashed], axis=1)

    def choose(self, odds: np.ndarray) -> np.ndarray:
        """The nodes of the best set of whole subtrees."""
        n, chain = len(odds), self.parents
        whole, best, parts = odds.copy(), np.zeros(n), np.zeros(n)
        for k in range(n - 1, -1, -1):
            best[k] = max(whole[k], parts[k])
            if k:
                whole[chain[k]] += whole[k]
                parts[chain[k]] += best[k]
        chosen = np.zeros(n, bool)
        for k in range(n):
            chosen[k] = (k > 0 and chosen[chain[k]]) or (whole[k] > 0 and whole[k] >= parts[k])
        return chosen

    def text(self, chosen: np.ndarray) -> str:
        """The chosen text: a line for each block, its inline pieces joined by spaces."""
        lines: list[list[str]] = []
        block = -2
        for node, text in self.texts:
            if not chosen[node]:
                continue
            node = self.blocks[node]
            if node != block:
                lines.append([])
                block = node
            lines[-1].append(text)
        return "\n".join(" ".join(x) for x in lines)


class Boosted:
    """Gradient-boosted trees of one depth for log loss, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(mean / (1 - mean))
        self.feature = np.zeros((TREES, 2**DEPTH - 1), np.int64)
        self.cut = np.full((TREES, 2**DEPTH - 1), np.inf)
        self.leaf = np.zeros((TREES, 2**DEPTH))
        odds = np.full(len(y), self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                gain, best = np.full(width, 1e-6), np.full((width, 2), -1)
                total = [np.bincount(node, v, minlength=width) for v in (g, h)]
                parent = total[0] ** 2 / (total[1] + 1)
                for f, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    at = node * (len(cuts) + 1) + binned[:, f]
                    gl, hl = (np.bincount(at, v, minlength=width * (len(cuts) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1] for v in (g, h))
                    value = gl**2 / (hl + 1) + (total[0][:, None] - gl) ** 2 / (total[1][:, None] - hl + 1) - parent[:, None]
                    k = value.argmax(axis=1)
                    top = value[np.arange(width), k]
                    better = top > gain
                    gain[better] = top[better]
                    best[better] = np.stack([np.full(width, f), k], axis=1)[better]
                base = width - 1
                for i in range(width):
                    if best[i, 0] >= 0:
                        self.feature[t, base + i], self.cut[t, base + i] = best[i, 0], self.cuts[best[i, 0]][best[i, 1]]
                node = node * 2 + (x[np.arange(len(y)), self.feature[t, base + node]] > self.cut[t, base + node])
            sums = [np.bincount(node, v, minlength=2**DEPTH) for v in (g, h)]
            self.leaf[t] = RATE * sums[0] / (sums[1] + 1)
            odds += self.leaf[t][node]
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = node * 2 + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit(pages: DataFrame, most: int = MOST_PAGES) -> Boosted | None:
    """Trees fitted on at most `most` pages that mark their main text, those whose html hashes lowest."""
    tuned(pages.sparkSession)
    hashed = F.xxhash64("html")
    marked = pages.select("html").where(F.lower("html").rlike(r"<(article|main)\b|role\s*=\s*.?main"))
    # Only the lowest hashes are looked at, so what tasks send doesn't grow with their number; more of them if few are marked.
    share = min(1.0, 2 * most / max(1, pages.count()))
    while True:
        least = marked if share == 1 else marked.where(hashed < int(-(1 << 63) + share * (1 << 64)))
        sources = [r[0] for r in least.orderBy(hashed, "html").limit(most).collect()]
        if share == 1 or len(sources) == most:
            break
        share = min(1.0, share * 8)
    x, y = [], []
    for source in sources:
        page = Page(source)
        x.append(page.features())
        y.append(np.array(page.main, float))
    if not x or len(np.unique(np.concatenate(y))) < 2:
        return None
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """(page_id, url, text, nodes, chosen) of every page: its main text, its elements, and how many of them hold it."""
    shared = tuned(pages.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [None if source is None else Page(source) for source in batch.column("html").to_pylist()]
            real = [p for p in parsed if p is not None]
            if shared.value is not None and real:
                odds = shared.value.odds(np.concatenate([p.features() for p in real]))
                ends = np.cumsum([len(p.tags) for p in real])
                chosen = iter([p.choose(odds[end - len(p.tags) : end]) for p, end in zip(real, ends, strict=True)])
            else:
                chosen = iter([np.ones(len(p.tags), bool) for p in real])
            rows = []
            for page in parsed:
                if page is None:
                    rows.append((None, None, None))
                else:
                    mine = next(chosen)
                    rows.append((page.text(mine), len(page.tags) - 1, int(mine[1:].sum())))
            text, nodes, kept = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(nodes, pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "url", "text", "nodes", "chosen"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, SCHEMA)
