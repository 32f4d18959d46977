"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between tags that start a line of their own, in
page order. A block is described by the tags, classes and ids of its ancestors and by its text:
length, links, punctuation, telling words, place. The field has two states, main text and the
rest; its weights are learned by stochastic gradient on the likelihood of labelled pages, and
the states of a page are those of the best path (Viterbi). Main blocks are joined by one blank.

Labelled pages are the examples below, whose main blocks are marked, and up to ``sample_pages``
pages of the table that mark their article themselves (``article`` or ``main``), drawn by a
hash. Every page is learned twice, once without these two tags, so that other pages are read by
their remaining features.

Defined results: a null or empty html gives an empty text; so does a page without main blocks.
Character references are decoded, white space (blank, tab, line feed, vertical tab, form feed,
carriage return) in a block becomes one blank, and nothing is dropped or capped inside a block.
Tags that are not closed end with their parent; scripts, styles, titles, text areas and frames
last until their own end tag, or the end of the page, and a tag that is cut off ends with the page.
A page takes time in proportion to its length, however deep or broken it is: tags are read one
attribute after the other, and open elements are counted by name. Repeated rows are extracted each; other columns
are kept by :func:`extracted`.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecheck.llm.common import table

SAMPLE_PAGES = 200
EPOCHS = 8
LEAST_LESSONS = 3000
RATE = 0.3
DECAY = 1e-4
SEED = 13

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is not text of the page: raw ones hold no tags and last until their own end
# tag, whatever looks like a tag before it; hidden ones are nested and end like other elements.
_RAW_END = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in "script style title textarea iframe".split()
}
_HIDDEN = frozenset("noscript template select option button svg".split())
# Elements that end where another one of their name starts.
_ENDED_BY_NEXT = frozenset("li dt dd td th tr option optgroup button select".split())
_SEMANTIC = ("t:article", "t:main")
_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f\v/>]*")
_GAP = re.compile(r"[ \t\n\r\f\v/]*")
_WHITE = re.compile(r"[ \t\n\r\f\v]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\r\f\v/>=]*")
_BARE = re.compile(r"[^ \t\n\r\f\v>]*")
_NAMING = frozenset("class id role".split())
_NOT_NAME = re.compile(r"[^a-z0-9]+")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_TELLING = frozenset(
    "accept advertisement archive categories comment comments contact cookie cookies copyright faq follow home"
    " impressum imprint login menu newsletter posted powered privacy register related replies reply reserved"
    " rights search share sign sitemap sponsored subscribe tags terms tweet views".split()
)
_ROUGH_WORD = re.compile(r"[a-z]+")


class LeafBlock:
    """Text of a block, names of its ancestors, letters in links, and the mark of examples.

    ``above`` is the sum of the weights of the ancestors, where weights were given; then ``names``
    holds the name of the leaf only.
    """

    __slots__ = ("text", "names", "linked", "keep", "above")

    def __init__(self, text: str, names: tuple[str, ...], linked: int, keep: bool, above: float = 0.0):
        self.text, self.names, self.linked, self.keep, self.above = text, names, linked, keep, above


def tag_end(page: str, at: int) -> tuple[int, list[str], bool]:
    """Where the tag ends whose name ends at ``at``, its naming words, and whether it closes itself.

    Quotes count where a value starts. A tag that is cut off ends with the page.
    """
    names: list[str] = []
    n = len(page)
    while True:
        i = _GAP.match(page, at).end()
        if i >= n:
            return n, names, False
        if page[i] == ">":
            return i + 1, names, i > at and page[i - 1] == "/"
        found = _ATTRIBUTE.match(page, i)
        name, at, value = found[0].lower(), found.end(), ""
        i = _WHITE.match(page, at).end()
        if i < n and page[i] == "=":
            i = _WHITE.match(page, i + 1).end()
            if i >= n:
                return n, names, False
            if page[i] in "\"'":
                at = page.find(page[i], i + 1) + 1
                if not at:
                    return n, names, False
                value = page[i + 1 : at - 1]
            else:
                found = _BARE.match(page, i)
                value, at = found[0], found.end()
        if name in _NAMING:
            names += [f"c:{x}" for x in _NOT_NAME.split(value.lower()) if x]
        elif name == "data-keep":
            names.append("keep")


class _Blocks:
    """Open elements of a page and the block that is being read."""

    def __init__(self, weights: dict[str, float] | None):
        self.blocks: list[LeafBlock] = []
        self.stack: list[tuple[str, list[str]]] = []
        self.outer: list[int] = []  # places of open elements that are not inline
        self.open: Counter[str] = Counter()  # such elements by name
        self.inline: list[Counter[str]] = [Counter()]  # inline elements by name, in each of them
        self.above: Counter[str] = Counter()
        self.weights, self.score = weights, 0.0
        self.pieces: list[str] = []
        self.linked = self.links = 0
        self.hidden: int | None = None  # the place of the outermost hidden element

    def push(self, name: str, names: list[str]) -> None:
        if name in _INLINE:
            self.inline[-1][name] += 1
        else:
            self.outer.append(len(self.stack))
            self.open[name] += 1
            self.inline.append(Counter())
        self.stack.append((name, names))
        self.links += name == "a"
        for n in names:
            self.above[n] += 1
            if self.weights is not None and self.above[n] == 1:
                self.score += self.weights.get(n, 0.0)

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        if self.hidden is not None and depth <= self.hidden:
            self.hidden = None
        while len(self.stack) > depth:
            name, names = self.stack.pop()
            self.links -= name == "a"
            if name in _INLINE:
                self.inline[-1][name] -= 1
            else:
                self.outer.pop()
                self.inline.pop()
                self.open[name] -= 1
            for n in names:
                self.above[n] -= 1
                if not self.above[n]:
                    del self.above[n]
                    if self.weights is not None:
                        self.score -= self.weights.get(n, 0.0)

    def end_of(self, name: str) -> int | None:
        """The place of the element that an end tag closes: inline ones do not reach over others."""
        if not (self.inline[-1] if name in _INLINE else self.open)[name]:
            return None
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name)

    def end_block(self) -> None:
        text = _SPACES.sub(" ", "".join(self.pieces)).strip(" ") if self.pieces else ""
        if text:
            leaf = f"l:{self.stack[self.outer[-1]][0]}" if self.outer else "l:"
            names = (leaf,) if self.weights is not None else (*(n for n in self.above if n != "keep"), leaf)
            self.blocks.append(LeafBlock(text, names, min(self.linked, len(text)), "keep" in self.above, self.score))
        self.pieces.clear()
        self.linked = 0

    def add(self, source: str) -> None:
        if source and self.hidden is None:
            text = html.unescape(source)
            self.pieces.append(text)
            if self.links:
                self.linked += len(text)

    def start(self, name: str) -> None:
        """What the start of an element ends: the block, and a paragraph, item, cell or option."""
        if self.hidden is None and name not in _HIDDEN:
            self.end_block()
        if self.outer:
            depth = self.outer[-1]
            open_name = self.stack[depth][0]
            ended = open_name == name and name in _ENDED_BY_NEXT or open_name == "option" and name == "optgroup"
            if ended or open_name == "p" and name not in _HIDDEN:
                self.close(depth)


def leaf_blocks(page: str, weights: dict[str, float] | None = None) -> list[LeafBlock]:
    """The leaf blocks of a page in order. ``data-keep`` marks main blocks of examples."""
    now, at, search, last = _Blocks(weights), 0, 0, page.rfind(">")
    while (low := page.find("<", search)) >= 0:
        ahead = page[low + 1 : low + 2]
        if ahead in ("!", "?", "/") and not _NAME.match(page, low + 2) or ahead == "!":
            comment = page.startswith("<!--", low)
            if not comment and (ahead == "/" or low > last):  # "</" without a name, or "<!" without an end, is text
                search = low + 1
                continue
            now.add(page[at:low])
            end = page.find("-->" if comment else ">", low + 4 if comment else low)
            at = search = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        found = _NAME.match(page, low + (2 if ahead == "/" else 1))
        if not found:
            search = low + 1
            continue
        now.add(page[at:low])
        name = found[0].lower()
        at, names, alone = tag_end(page, found.end())
        search = at
        if ahead == "/":
            depth = now.end_of(name)
            if name not in _INLINE and (now.hidden is None or depth is not None and depth < now.hidden):
                now.end_block()
            if depth is not None:
                now.close(depth)
        elif name in _RAW_END:
            if not alone:
                end = _RAW_END[name].search(page, at)
                at = search = tag_end(page, end.end())[0] if end else len(page)
        elif name in _VOID:
            if now.hidden is None and name == "br":
                now.pieces.append(" ")
            if now.hidden is None and name == "hr":
                now.end_block()
        else:
            if name not in _INLINE:
                now.start(name)
            if not alone:
                names = [f"t:{name}", *names] if now.hidden is None else []
                if now.hidden is None and name in _HIDDEN:
                    now.hidden = len(now.stack)
                now.push(name, names)
    now.add(page[at:])
    now.end_block()
    return now.blocks


def features(blocks: list[LeafBlock], without: tuple[str, ...] = ()) -> list[list[str]]:
    out, last = [], len(blocks) - 1
    for i, block in enumerate(blocks):
        text, size = block.text, len(block.text)
        found = ["bias", *(n for n in block.names if n not in without)]
        found.append(f"size:{min(9, int(math.log2(size + 1)))}")
        found.append(f"links:{int(4 * block.linked / size)}")
        found.append("ends" if text[-1] in ".!?…\"”»" else "open")
        if size < 400:
            words = _ROUGH_WORD.findall(text.lower())
            found += [f"w:{w}" for w in set(words) & _TELLING]
        if "©" in text[:80]:
            found.append("w:copyright")
        if text.isupper():
            found.append("upper")
        if i == 0:
            found.append("first")
        if i == last:
            found.append("last")
        out.append(found)
    return out


class ChainField:
    """Two states; weights of features for state 1, of steps between states, and of both ends."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.steps = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, page: list[list[str]]) -> np.ndarray:
        weight = self.weights.get
        return np.array([sum(weight(f, 0.0) for f in block) for block in page])

    def states(self, page: str) -> tuple[list[LeafBlock], list[int]]:
        """The blocks of a page and their most likely states; ancestors are weighed as they open."""
        blocks = leaf_blocks(page, self.weights)
        emit = self.scores(features(blocks)) + np.array([b.above for b in blocks])
        return blocks, self.path(emit.tolist()) if blocks else []

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each state at each block, and expected number of each step."""
        n = len(emit)
        score = np.stack([np.zeros(n), emit], axis=1)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + score[0]
        for i in range(1, n):
            ahead[i] = score[i] + np.logaddexp(ahead[i - 1, 0] + self.steps[0], ahead[i - 1, 1] + self.steps[1])
        for i in range(n - 2, -1, -1):
            nxt = score[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(self.steps[:, 0] + nxt[0], self.steps[:, 1] + nxt[1])
        total = np.logaddexp(*ahead[-1])
        steps = np.zeros((2, 2))
        if n > 1:
            joint = ahead[:-1, :, None] + self.steps[None] + (score[1:] + behind[1:])[:, None, :] - total
            steps = np.exp(joint).sum(axis=0)
        return np.exp(ahead + behind - total), steps

    def learn(self, page: list[list[str]], states: np.ndarray, rate: float, decay: float = DECAY) -> None:
        chance, steps = self.marginals(self.scores(page))
        seen = np.zeros((2, 2))
        np.add.at(seen, (states[:-1], states[1:]), 1)
        self.steps += rate * (seen - steps - decay * self.steps)
        first = np.zeros(2)
        first[states[0]] = 1
        self.start += rate * (first - chance[0] - decay * self.start)
        for block, error in zip(page, (states - chance[:, 1]).tolist()):
            for f in block:
                old = self.weights.get(f, 0.0)
                self.weights[f] = old + rate * (error - decay * old)

    def best(self, page: list[list[str]]) -> list[int]:
        """The most likely states, by Viterbi."""
        return self.path(self.scores(page).tolist())

    def path(self, emit: list[float]) -> list[int]:
        (stay0, up), (down, stay1) = self.steps.tolist()
        low, high = self.start[0], self.start[1] + emit[0]
        back = []
        for score in emit[1:]:
            to_low, to_high = (low + stay0, high + down), (low + up, high + stay1)
            back.append((int(to_low[1] > to_low[0]), int(to_high[1] > to_high[0])))
            low, high = max(to_low), max(to_high) + score
        state = int(high > low)
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


# Telling class names and roles of what is not main text, for labels of pages with an article.
_ASIDE = frozenset(
    "t:nav t:aside t:footer t:form c:ad c:ads c:advert c:advertisement c:comment c:comments c:cookie c:menu c:nav"
    " c:navigation c:newsletter c:notice c:promo c:related c:share c:sidebar c:social c:sponsored c:banner".split()
)


def _self_labels(blocks: list[LeafBlock]) -> np.ndarray:
    def main(block: LeafBlock) -> bool:
        names = set(block.names)
        return bool(names & set(_SEMANTIC)) and not names & _ASIDE

    return np.array([main(b) for b in blocks], dtype=int)


def trained(pages: Iterable[str], epochs: int = EPOCHS, rate: float = RATE) -> ChainField:
    """A field learned from the examples and from pages that mark their article."""
    lessons = []
    for source, own in [(e, False) for e in EXAMPLES] + [(p, True) for p in pages]:
        blocks = leaf_blocks(source)
        if not blocks:
            continue
        states = _self_labels(blocks) if own else np.array([b.keep for b in blocks], dtype=int)
        if not states.any():
            continue
        lessons += [(features(blocks), states), (features(blocks, _SEMANTIC), states)]
    field, order = ChainField(), np.random.default_rng(SEED)
    for epoch in range(max(epochs, -(-LEAST_LESSONS // max(1, len(lessons))))):
        for i in order.permutation(len(lessons)):
            field.learn(*lessons[i], rate / (1 + epoch) ** 0.5)
    return field


def main_text(page: str | None, field: ChainField) -> str:
    return " ".join(b.text for b, state in zip(*field.states(page or "")) if state)


def fitted(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> ChainField:
    """The field for a table: at most about ``sample_pages`` pages are read for it."""
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
    count = marked.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "html"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.where(draw < min(1.0, sample_pages / max(1, count))).dropDuplicates(["html"])
    return trained(r["html"] for r in chosen.orderBy("html").limit(2 * sample_pages).collect())


def extracted(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``pages`` with ``text``, the main text."""
    field = fitted(pages, html_col, sample_pages)

    @F.pandas_udf("string")
    def text(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sources:
            yield pd.Series([main_text(source, field) for source in batch], dtype=object)

    return pages.withColumn("text", text(F.col(html_col)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# Hand-labelled pages: data-keep marks the main text.
EXAMPLES = [
    """<body><header class="site-header"><a href="/">Daily Post</a><p>News since 1990</p></header>
    <nav class="menu"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to improve this site. <a href="/c">Accept</a></div>
    <div class="content" data-keep><h1>Rain over the harbour</h1><p>The rain came in the night, and by the morning
    all boats were back.</p><p>Nobody had expected it so early in the year.</p></div>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Storms of the past</a></li></ul></aside>
    <div id="comments"><h3>Comments</h3><p class="comment">I was there and it was worse than you say.</p>
    <p class="comment">Thanks for writing about this.</p></div>
    <footer>Copyright 2020 Daily Post. All rights reserved.</footer></body>""",
    """<body><div id="top"><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></div>
    <div class="ad">Buy two chairs and get a table for half the price.</div>
    <article data-keep><h2>Baking bread at home</h2><p>Flour, water, salt and time are all it takes.</p>
    <ul><li>500 grams of flour</li><li>A spoon of salt</li></ul><p>Leave the dough over night.</p>
    <blockquote>Good bread needs patience, said my aunt.</blockquote></article>
    <form action="/news"><label>Subscribe to our newsletter</label><p>Your address stays with us.</p></form>
    <div class="footer"><p>Privacy policy</p><p>Terms of use</p></div></body>""",
    """<body><header><h1>The Walker</h1><p>Notes from the road</p></header><main><div class="post" data-keep>
    <h1>Across the pass</h1><p>We left before dawn.</p><p>Snow lay on the northern side until noon, and the
    path was hard to see.</p><pre>6 hours, 1200 metres</pre></div><div class="share"><a href="#">Tweet</a>
    <a href="#">Share</a></div><section class="comments"><h2>2 replies</h2><div class="comment"><p>Beautiful
    pictures, thank you.</p></div><div class="comment"><p>Which map did you use?</p></div></section></main>
    <footer><p>Powered by a small machine</p></footer></body>""",
    """<body><table class="nav"><tr><td><a href="/">Home</a></td><td><a href="/x">Index</a></td></tr></table>
    <div class="notice">This site is under maintenance on Sunday.</div><div class="entry" data-keep>
    <h3>How tides work</h3><p>The moon pulls at the water on both sides of the earth.</p><p>Twice a day the sea
    rises and falls.</p><table><tr><td>High</td><td>6:10</td></tr></table></div>
    <div class="promo">Sponsored: holidays by the sea from 99.</div><div class="footer">Contact us</div></body>""",
    """<body><div class="banner">Summer sale</div><div class="wrap"><div class="left sidebar"><p>Categories</p>
    <ul><li><a href="/a">Travel</a></li><li><a href="/b">Food</a></li></ul><p>Archive</p></div>
    <div class="main" data-keep><h1>A quiet village</h1><p>There is one shop, and it opens at ten.</p><p>Most
    houses are older than the road.</p><p>Short.</p></div></div><div class="related"><p>You may also like</p>
    <p><a href="/q">Ten more villages</a></p></div><footer>&copy; 2021</footer></body>""",
    """<body><p data-keep>A page may have no frame at all, only text.</p><p data-keep>Then all of it is the main
    text of the page, however short.</p></body>""",
]
