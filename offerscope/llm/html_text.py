"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into its block elements and runs of text (inline markup is part of a
run).  Every node has features: text, link, mark-up and punctuation density of its subtree,
depth, place and share among its siblings, its siblings' densities, and the tokens of its
own, its parent's and all its ancestors' tag, class, id and role.  Boosted trees give each
node the odds that its subtree holds main text.

Decoding finds the most likely labelling in which a node that holds main text has only
ancestors that do, and nothing is kept below a node that does not: the best value of a
subtree is ``max(0, own log odds + best values of its children)``, one pass upward, and a
pass downward from the root reads off the runs to keep.

Learning: up to ``TRAIN_PAGES`` pages of at most ``TRAIN_CHARS`` characters.  Those with
semantic mark-up (article, main) are labelled by it; their runs are also set anew in other
layouts (menus, notices, forms, sidebars, adverts, comments around or inside the text; whole
pages in a form, or below a menu or form that is left open), where labels are known by construction.

Defined results: a null or empty page, or one without text, gives an empty text; broken
mark-up is read as far as it goes; repeated rows are read one by one; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerscope.llm import boosting

TRAIN_PAGES = 200
TRAIN_CHARS = 100_000
#: Most frequent attribute tokens that are features.
TOKENS = 64
RUN = "#text"
#: Nodes that are judged at once.
GROUP_NODES = 8000

# Elements that do not end a run of text, elements without an end tag,
# elements that never hold main text, those that seldom do but can be around all of it (``ruled_out``), and
# those that mark it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template select textarea svg".split())
SELDOM = frozenset("noscript button iframe object form nav".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav aside footer form header".split())
ASIDE_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie footer menu nav navbar"
    " newsletter notice popup promo related respond share sharing sidebar social sponsor sponsored subscribe".split()
)
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p"
    " pre section table ul".split()
)
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SPLIT_TOKENS = re.compile(r"[^a-z]+")


@dataclass
class Page:
    """Nodes in page order; a parent comes before its children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)  # inline elements


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[int] = []
        self.run: list[str] = []
        self.link_depth = self.run_links = self.run_marks = 0
        self._add("html", ())
        self.open.append(0)

    def _add(self, tag: str, tokens: tuple[str, ...], text: str = "") -> int:
        p = self.page
        p.parent.append(self.open[-1] if self.open else -1)
        p.tag.append(tag)
        p.tokens.append(tokens)
        p.text.append(text)
        p.links.append(self.run_links if text else 0)
        p.marks.append(self.run_marks if text else 0)
        return len(p.tag) - 1

    def end_run(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._add(RUN, (), text)
            self.run.clear()
        self.run_links = self.run_marks = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            self.run_marks += 1
            self.link_depth += tag == "a"
            return
        self.end_run()
        if tag in VOID or tag == "html":
            return
        if tag == "body":
            self._close(("head",))
        elif tag in ENDS_P:
            self._close(("p",))
        if tag in ENDS_SAME:
            self._close(ENDS_SAME[tag], within=("ul", "ol", "dl", "table"))
        tokens = [t for name, value in attrs if name in ("class", "id", "role") and value for t in SPLIT_TOKENS.split(value.lower()) if len(t) > 1]
        self.open.append(self._add(tag, tuple(dict.fromkeys(tokens))))
        self.link_depth = 0

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.link_depth = max(0, self.link_depth - (tag == "a"))
            return
        self.end_run()
        if tag not in VOID and tag not in ("html", "body"):
            self._close((tag,))

    def _close(self, tags: Sequence[str], within: Sequence[str] = ()) -> None:
        """Close the innermost open element of ``tags`` and all inside it, if it is not beyond ``within``."""
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.page.tag[self.open[depth]]
            if name in tags:
                del self.open[depth:]
                return
            if name in within or (tags == ("p",) and name not in ("p",)):
                return

    def handle_data(self, data: str) -> None:
        if self.page.tag[self.open[-1]] in ("script", "style"):
            return
        self.run.append(data)
        if self.link_depth:
            self.run_links += len(data.strip())


def read_page(html: str) -> Page:
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.end_run()
    return reader.page


@dataclass
class Features:
    """Feature levels of the nodes of a page; ``tokens`` maps an attribute token to its place."""

    tokens: dict[str, int]

    def of(self, pages: Sequence[Page]) -> np.ndarray:
        """Rows of all pages, in order."""
        numbers: list[list[float]] = []
        own_at: list[int] = []
        above_at: list[int] = []
        k, row = len(self.tokens), 0
        for page in pages:
            numbers += self._numbers(page)
            own: list[frozenset[int]] = []
            above: list[frozenset[int]] = []
            for i, (tag, names) in enumerate(zip(page.tag, page.tokens)):
                mine = frozenset([self.tokens[t] for t in (tag, *names) if t in self.tokens])
                p = page.parent[i]
                over = above[p] | own[p] if i else frozenset()
                own.append(mine)
                above.append(over)
                at = (row + i) * 3 * k
                own_at += [at + j for j in mine]
                above_at += [at + 2 * k + j for j in over]
                if i:
                    above_at += [at + k + j for j in own[p]]
            row += len(page.tag)
        flags = np.zeros(row * 3 * k, np.uint8)
        flags[own_at] = 1
        flags[above_at] = 1
        numeric = np.array(numbers, float).reshape(row, -1)
        numeric[:, :LOGS] = np.log2(numeric[:, :LOGS] + 1) * 2
        return np.concatenate([np.clip(numeric, 0, 31).astype(np.uint8), flags.reshape(row, 3 * k)], axis=1)

    def _numbers(self, page: Page) -> list[list[float]]:
        parent = page.parent
        n = len(parent)
        chars = [len(t) for t in page.text]
        links = [min(a, b) for a, b in zip(page.links, chars)]
        marks = [m + 1 for m in page.marks]
        points = [len(t.translate(ONLY_POINTS)) if t.isascii() else sum(map(t.count, ".,;:!?")) for t in page.text]
        runs = [int(t == RUN) for t in page.tag]
        depth, count, place = [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = count[p]
            count[p] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            marks[p] += marks[i]
            points[p] += points[i]
            runs[p] += runs[i]
        linked = [a / (c or 1) for a, c in zip(links, chars)]
        before, after, last = [0.0] * n, [0.0] * n, [-1] * n
        for i in range(1, n):
            p = parent[i]
            j = last[p]
            if j >= 0:
                before[i], after[j] = linked[j], linked[i]
            last[p] = i
        whole = chars[0] or 1
        found = []
        for i in range(n):
            p = max(parent[i], 0)
            c, around, siblings = chars[i] or 1, chars[p] or 1, count[p] or 1
            found.append(
                [
                    chars[i],
                    chars[i] / (runs[i] or 1),
                    around / siblings,
                    siblings * siblings,
                    linked[i] * 20,
                    marks[i] / c * 200,
                    points[i] / c * 300,
                    depth[i],
                    place[i] / siblings * 20,
                    chars[i] / around * 20,
                    chars[i] / whole * 20,
                    before[i] * 20,
                    after[i] * 20,
                    linked[p] * 20,
                ]
            )
        return found


#: Numeric features that are taken by their logarithm; they come first.
LOGS = 4
ONLY_POINTS = {c: None for c in range(128) if chr(c) not in ".,;:!?"}


def ruled_out(page: Page) -> list[bool]:
    """Nodes that hold no main text whatever the trees say.

    A form, menu or the like is left to the trees if it is around an article, a main part, a
    heading h1 or more than half of the page's text.
    """
    out = [tag in NEVER for tag in page.tag]
    seldom = [i for i, tag in enumerate(page.tag) if tag in SELDOM]
    if seldom:
        chars = [len(t) for t in page.text]
        main = [tag in MAIN or tag == "h1" for tag in page.tag]
        for i in range(len(out) - 1, 0, -1):
            p = page.parent[i]
            chars[p] += chars[i]
            main[p] = main[p] or main[i]
        for i in seldom:
            out[i] = not main[i] and 2 * chars[i] <= chars[0]
    return out


def keep_runs(page: Page, logits: np.ndarray) -> list[int]:
    """The runs of the most likely labelling without contradictions between ancestors and descendants."""
    best = logits.tolist()
    out = ruled_out(page)
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0 and not out[i]:
            best[page.parent[i]] += best[i]
        else:
            best[i] = 0.0
    kept = [True] * len(best)  # the whole page is never ruled out as such: its runs are
    for i in range(1, len(best)):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    return [i for i in range(len(best)) if kept[i] and page.tag[i] == RUN]


@dataclass
class Extractor:
    features: Features
    trees: boosting.Trees

    def texts(self, htmls: Sequence[str]) -> Iterator[str]:
        """The main text of each page; pages are judged a few at a time."""
        group: list[Page] = []
        nodes = 0
        for html in htmls:
            group.append(read_page(html))
            nodes += len(group[-1].tag)
            if nodes > GROUP_NODES:
                yield from self._judge(group)
                group, nodes = [], 0
        yield from self._judge(group)

    def _judge(self, pages: list[Page]) -> Iterator[str]:
        logits = self.trees.logits(self.features.of(pages)) if pages else []
        at = 0
        for page in pages:
            kept = keep_runs(page, logits[at : at + len(page.tag)])
            at += len(page.tag)
            yield " ".join([page.text[i] for i in kept])


# learning


def marked_runs(page: Page) -> np.ndarray | None:
    """1 for nodes whose subtree holds main text by the page's semantic mark-up; None if it has none."""
    n = len(page.tag)
    inside, outside, wrapped = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    label = np.zeros(n)
    for i in range(n):
        p = max(page.parent[i], 0)
        tag = page.tag[i]
        aside = tag in (ASIDE | NEVER) - SELDOM or bool(ASIDE_TOKENS & set(page.tokens[i]))
        inside[i] = inside[p] or tag in MAIN
        outside[i] = outside[p] or aside
        # main text that begins inside such an element is not ruled out by it
        wrapped[i] = (wrapped[p] or tag in SELDOM) and tag not in MAIN
        label[i] = tag == RUN and inside[i] and not outside[i] and not wrapped[i]
    if not inside.any():
        return None
    for i in range(n - 1, 0, -1):
        label[page.parent[i]] = max(label[page.parent[i]], label[i])
    return label


YES, NO = "\x02", "\x03"  # written before texts of known label

# How the parts of a page are marked up, by role.
LAYOUTS = {
    "main": ['article', 'main', 'div class="content"', 'div class="post-body"', 'div class="entry-content"', 'section class="story"', 'div id="article-text"', 'div'],
    "menu": ['nav', 'div class="menu"', 'div id="navbar"', 'ul class="nav"', 'div class="breadcrumbs"'],
    "header": ['header', 'div class="header"', 'div id="masthead"', 'div class="site-header"'],
    "footer": ['footer', 'div class="footer"', 'div id="footer"'],
    "side": ['aside', 'div class="sidebar"', 'div id="related"', 'div class="widget"', 'div class="teaser"'],
    "ad": ['div class="ad"', 'div class="advert"', 'div class="promo"', 'aside class="sponsored"', 'div class="banner"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div id="consent"', 'div class="popup"', 'div class="alert"'],
    "form": ['div class="newsletter"', 'div class="subscribe"', 'div class="login"', 'form'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'div id="disqus-thread"', 'div class="respond"'],
    "share": ['div class="share"', 'div class="social"', 'ul class="sharing"', 'div class="tags"', 'div class="author-bio"'],
}

#: Elements around a whole page, and what they hold before it if they are left open.
WRAPS = {
    "form": lambda items, words: f"<p>{NO}{words(4)}</p>",
    'form id="aspnetForm"': lambda items, words: f"<label>{NO}{words(2)}</label>",
    "nav": lambda items, words: items(5),
    "object": lambda items, words: NO + words(3),
    "noscript": lambda items, words: NO + words(6),
}


def recomposed(rng: random.Random, texts: list[str], labels: str = YES) -> str:
    """A page in a random layout with main text drawn from ``texts``."""

    def part(role: str, inner: str) -> str:
        tag = rng.choice(LAYOUTS[role])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def words(n: int) -> str:
        drawn = rng.choice(texts).split() or ["a"]
        at = rng.randrange(len(drawn))
        return escape(" ".join(drawn[at : at + n]))

    def items(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{NO}{words(rng.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"

    def other(role: str) -> str:
        if role in ("menu", "share"):
            return part(role, items(rng.randint(2, 8)))
        if role == "comments":
            return part(role, "".join(f'<div class="{rng.choice(("comment", "reply", "c"))}"><p>{NO}{words(rng.randint(4, 50))}</p></div>' for _ in range(rng.randint(1, 5))))
        if role == "side" and rng.random() < 0.5:
            return part(role, f"<h3>{NO}{words(3)}</h3>" + items(rng.randint(2, 6)))
        return part(role, f"<p>{NO}{words(rng.randint(2, 30))}</p>" if rng.random() < 0.5 else NO + words(rng.randint(2, 30)))

    blocks = [f"<h1>{YES}{words(rng.randint(3, 10))}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 8)):
        tag = rng.choice(("p", "p", "p", "p", "p", "h2", "blockquote", "li", "div", "td"))
        text = f"{YES}{words({'h2': 6, 'li': 15}.get(tag, rng.randint(3, 120)))}"
        blocks.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}</{tag}>"))
    for role in ("ad", "share", "form", "comments", "side", "notice"):
        if rng.random() < 0.25:
            blocks.insert(len(blocks) if role in ("comments", "share") else rng.randint(0, len(blocks)), other(role))
    main = part("main", "".join(blocks))
    around = [other(r) for r in ("notice", "header", "menu", "ad") if rng.random() < 0.7]
    below = [other(r) for r in ("side", "share", "form", "comments", "ad", "footer") if rng.random() < 0.5]
    body = "".join([*around, main, *below])
    body = f"<div class=page>{body}</div>" if rng.random() < 0.4 else body
    drawn = rng.random()
    if drawn < 0.2:  # all of it in one element, or below one that is left open
        tag = rng.choice(tuple(WRAPS))
        body = f"<{tag}>{body}</{tag.split()[0]}>" if drawn < 0.1 else f"<{tag}>{WRAPS[tag](items, words)}{body}"
    return f"<html><body>{body}</body></html>"


def known_runs(page: Page) -> np.ndarray:
    label = np.array([float(t.startswith(YES)) for t in page.text])
    for i in range(len(label) - 1, 0, -1):
        label[page.parent[i]] = max(label[page.parent[i]], label[i])
    page.text = [t.lstrip(YES + NO) for t in page.text]
    return label


def learn(pages: Sequence[str], made: int = 400, seed: int = 4) -> Extractor:
    """Fit an extractor to pages with semantic mark-up and to new layouts of their texts."""
    rng = random.Random(seed)
    examples: list[tuple[Page, np.ndarray]] = []
    texts: list[str] = []
    for html in pages:
        page = read_page(html)
        label = marked_runs(page)
        if label is not None:
            examples.append((page, label))
            texts += [t for t, y in zip(page.text, label) if y and t]
    texts = texts or ["no page has main text that is marked as such"]
    for _ in range(made):
        page = read_page(recomposed(rng, texts))
        examples.append((page, known_runs(page)))
    seen: dict[str, int] = {}
    for page, _ in examples:
        for t in {t for tag, tokens in zip(page.tag, page.tokens) for t in (tag, *tokens)}:
            seen[t] = seen.get(t, 0) + 1
    frequent = sorted(seen, key=lambda t: (-seen[t], t))[:TOKENS]
    features = Features({t: i for i, t in enumerate(frequent)})
    x = features.of([page for page, _ in examples])
    y = np.concatenate([label for _, label in examples])
    return Extractor(features, boosting.fit(x, y))


def training_pages(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = TRAIN_PAGES) -> list[str]:
    """Pages to learn from: up to ``most``, none longer than ``TRAIN_CHARS``, chosen by a hash of the key; one page of each key."""
    short = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).filter(
        F.col("_key").isNotNull() & (F.char_length("_html") <= TRAIN_CHARS)
    )
    # keys first: each task would otherwise send its own best pages to the driver
    keys = short.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(most)
    chosen = (
        short.join(F.broadcast(keys), "_key", "left_semi")
        .groupBy("_key")
        .agg(F.min("_html").alias("_html"))
        .orderBy(F.xxhash64("_key"), "_key")
    )
    return [r["_html"] for r in chosen.collect()]


def extract(
    pages: DataFrame, extractor: Extractor, html: str = "html", keep: Sequence[str | Column] = ("page_id", "url")
) -> DataFrame:
    """``keep`` columns and the main text of every whole page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(extractor.texts([x.as_py() or "" for x in batch.column(batch.num_columns - 1)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], "text"]
            )

    schema = T.StructType([*pages.select(*keep).schema.fields]).add("text", T.StringType())
    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(read, schema)
