"""Main text of web pages by sum-product inference on the tree of their elements."""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitway.llm.common import free_name, table

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template title textarea svg math iframe object canvas select".split())
_UNCLOSED = frozenset("script style title textarea iframe".split())  # of those, what runs on to the end of the page if it isn't closed
_WRAPPERS = frozenset("div section center".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"}, "body": {"head"},
}
_SCOPES = frozenset("html body table ul ol dl div section article aside nav main form td th blockquote".split())


@dataclass
class Tree:
    """Block elements of a page in the order of their opening; parent[0] is -1. Inline elements belong to the block they are in."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parent: list[int] = field(default_factory=lambda: [-1])
    #: Runs of text between blocks, in page order: (element, text, letters inside links).
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def parse(page: str | None) -> Tree:
    """Lenient reading of a page: missing end tags, stray end tags and a cut-off end are taken as browsers do in the main."""
    tree = Tree()
    page = page or ""
    open_: list[int] = [0]
    text: list[str] = []
    linked = depth = at = 0
    missing: set[str] = set()

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                tree.runs.append((open_[-1], joined, linked))
            text, linked = [], 0

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * (depth > 0)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag == "p" or tag not in _INLINE:
                for k in range(len(open_) - 1, 0, -1):
                    if tree.tags[open_[k]] == tag:
                        flush()
                        depth = 0
                        del open_[k:]
                        break
            continue
        if tag in _RAW:
            # What these hold isn't text of the page; it ends at their own end tag, whatever it looks like.
            if tag in ("svg", "math") and m[3].endswith("/") or tag in missing:
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not end and tag not in _UNCLOSED:
                missing.add(tag)  # nowhere further on either
                continue
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            depth = 1
        elif tag == "br":
            text.append(" ")
        if tag in _INLINE or tag in _VOID:
            continue
        flush()
        depth = 0
        if tag not in ("html", "head"):
            closes = _CLOSES.get(tag, set()) | {"p"}
            for k in range(len(open_) - 1, 0, -1):
                if tree.tags[open_[k]] in closes:
                    del open_[k:]
                elif tree.tags[open_[k]] in _SCOPES:
                    break
        words = {w for _, v in _ATTRIBUTE.findall(m[3]) for w in _NAME.findall(_CAMEL.sub(" ", v).lower())} if m[3] else ()
        tree.tags.append(tag)
        tree.names.append(tuple(sorted(words)))
        tree.parent.append(open_[-1])
        open_.append(len(tree.tags) - 1)
    if at < len(page):
        text.append(page[at:])
    flush()
    return tree


def _features(tree: Tree) -> list[tuple[str, ...]]:
    """What each element shows of itself: its tag, the words of its class, id and role, its own text and links."""
    n = len(tree.tags)
    letters, linked = [0] * n, [0] * n
    for i, t, links in tree.runs:
        letters[i] += len(t)
        linked[i] += links
    out = []
    for i in range(n):
        shown = [f"name={w}" for w in tree.names[i]]
        if tree.tags[i] not in ("#page", "html", "body") and (letters[i] or tree.names[i] or tree.tags[i] not in _WRAPPERS):  # these hold both kinds
            shown.append(f"tag={tree.tags[i]}")
        if letters[i] and i:
            shown.append(f"letters={min(6, int(math.log(letters[i], 4)))}")
            shown.append(f"links={min(3, int(4 * linked[i] / max(letters[i], 1)))}")
        out.append(tuple(shown))
    return out


#: Log-odds of a state that is taken as given, and the weight of all pairs of elements beside those of two tags.
CERTAIN, PRIOR = 30.0, 8.0


@dataclass(frozen=True)
class PageModel:
    """unary: feature -> log-odds of content; bias: of the root; stay: P(child has its parent's state) for boilerplate and content; pairs: the same for the tags of parent and child."""

    unary: dict[str, float]
    bias: float
    stay: tuple[float, float]
    pairs: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)

    def stays(self, tree: Tree) -> list[tuple[float, float]]:
        """P(element has its parent's state) by that state. Nameless wrappers around a single element have its state."""
        n, parent = len(tree.tags), tree.parent
        children, shows = [0] * n, [False] * n
        for p in parent[1:]:
            children[p] += 1
        for i, _, _ in tree.runs:
            shows[i] = True
        wraps = [children[i] == 1 and not shows[i] and not tree.names[i] and tree.tags[i] in _WRAPPERS for i in range(n)]
        return [self.stay, *((1.0, 1.0) if wraps[p] else self.pairs.get((tree.tags[p], tree.tags[i]), self.stay) for i, p in enumerate(parent[1:], 1))]

    def marginals(self, tree: Tree, bias: float | None = None, given: int | None = None) -> list[float]:
        """P(content) of each element, exactly: messages from the leaves to the root, then back. bias: of the root, if not the model's; given: an element that is content."""
        n, parent, get = len(tree.tags), tree.parent, self.unary.get
        stays = self.stays(tree)
        own = [1 / (1 + math.exp(-max(-20.0, min(20.0, sum(get(f, 0.0) for f in fs))))) for fs in _features(tree)]
        if given is not None:
            own[given] = 1 / (1 + math.exp(-CERTAIN))
        zero, one = [1 - x for x in own], own[:]  # products of own evidence and messages from children
        up0, up1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            s = zero[i] + one[i]
            z, o = zero[i] / s, one[i] / s
            b, c = stays[i]
            up0[i], up1[i] = b * z + (1 - b) * o, (1 - c) * z + c * o
            p = parent[i]
            zero[p] *= up0[i]
            one[p] *= up1[i]
            s = zero[p] + one[p]
            zero[p], one[p] = zero[p] / s, one[p] / s
        first = 1 / (1 + math.exp(-(self.bias if bias is None else bias)))
        zero[0], one[0] = zero[0] * (1 - first), one[0] * first
        out = [0.0] * n
        out[0] = one[0] / (zero[0] + one[0])
        for i in range(1, n):
            p = parent[i]
            # The parent's belief without what this child told it.
            z, o = (1 - out[p]) / max(up0[i], 1e-300), out[p] / max(up1[i], 1e-300)
            s = z + o
            z, o = z / s, o / s
            b, c = stays[i]
            z, o = (b * z + (1 - c) * o) * zero[i], ((1 - b) * z + c * o) * one[i]
            out[i] = o / (z + o)
        return out

    def text(self, page: str | None) -> str:
        tree = parse(page)
        if not tree.runs:
            return ""
        p = self.marginals(tree)
        if not any(p[i] >= 0.5 for i, _, _ in tree.runs):
            # Nothing stands out. The element that is content likeliest, of those with text in or under them, is taken as given;
            # where it has no text of its own that follows, as on a page that is all article, so is the root.
            holds = {i for i, _, _ in tree.runs}
            for i in range(len(tree.tags) - 1, 0, -1):
                if i in holds:
                    holds.add(tree.parent[i])
            best = max(sorted(holds), key=lambda i: p[i])
            p = self.marginals(tree, given=best)
            if not any(p[i] >= 0.5 for i, _, _ in tree.runs):
                p = self.marginals(tree, CERTAIN)
        return "\n".join(t for i, t, _ in tree.runs if p[i] >= 0.5)


def train(labelled: Iterator[tuple[Tree, list[bool]]]) -> PageModel:
    """Fit by counting: naive Bayes evidence of each feature, and how often a child has its parent's state (add one half)."""
    seen = defaultdict(lambda: [0.5, 0.5])
    state, stays, moves = [0.5, 0.5], [0.5, 0.5], [0.5, 0.5]
    kinds = defaultdict(lambda: [[0, 0], [0, 0]])
    for tree, content in labelled:
        for i, fs in enumerate(_features(tree)):
            y = int(content[i])
            if tree.tags[i] in ("#page", "body"):
                continue
            state[y] += 1
            for f in fs:
                seen[f][y] += 1
            if i:
                up = int(content[tree.parent[i]])
                (stays if up == y else moves)[up] += 1
                kinds[tree.tags[tree.parent[i]], tree.tags[i]][up][up != y] += 1
    unary = {f: math.log(c[1] / state[1]) - math.log(c[0] / state[0]) for f, c in seen.items()}
    stay = tuple(stays[k] / (stays[k] + moves[k]) for k in (0, 1))
    # Pairs of tags that were seen rarely have about what all pairs have.
    pairs = {k: tuple((v[u][0] + PRIOR * stay[u]) / (sum(v[u]) + PRIOR) for u in (0, 1)) for k, v in kinds.items()}
    return PageModel(unary, 0.0, stay, pairs)


# --- labelled pages -----------------------------------------------------------------------------

#: Pages of the training set, and the seed of its layouts.
TRAINING_PAGES, SEED = 1500, 7


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[str, list[bool]]]:
    """Pages of many layouts, with the label of each block element in the order of its opening.

    Content is in elements marked data-y="1", boilerplate in data-y="0"; the mark itself is no feature.
    """
    pick = random.Random(seed)
    words = lambda low, high: " ".join("w" * pick.randint(1, 9) for _ in range(pick.randint(low, high)))

    def block(y: int, tag: str, inner: str, name: str = "") -> str:
        return f'<{tag} data-y="{y}"{f" {pick.choice(("class", "id"))}={chr(34)}{name}{chr(34)}" if name else ""}>{inner}</{tag}>'

    def links(y: int, k: int) -> str:
        return block(y, "ul", "".join(block(y, "li", f'<a href="/x">{words(1, 3)}</a>') for _ in range(k)))

    def menu() -> str:
        return block(0, pick.choice(["nav", "nav", "div", "header"]), links(0, pick.randint(3, 9)), pick.choice(["", "nav", "menu", "navbar", "site-menu", "navigation", "breadcrumbs", "top-bar", "masthead", "header"]))

    def noise() -> str:
        kind = pick.randrange(9)
        if kind == 0:
            return block(0, pick.choice(["div", "aside"]), words(2, 14), pick.choice(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "promotion", "sponsor"]))
        if kind == 1:
            return block(0, pick.choice(["aside", "div", "section"]), block(0, "h3", words(1, 4)) + links(0, pick.randint(2, 6)) + block(0, "p", words(4, 30)), pick.choice(["", "sidebar", "related", "widget", "recommended", "trending", "popular", "more-stories"]))
        if kind == 2:
            return block(0, pick.choice(["div", "section"]), block(0, "p", words(6, 25)), pick.choice(["cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "privacy-notice", "alert", "popup", "modal"]))
        if kind == 3:
            return block(0, "form", words(1, 6) + "<input>" + block(0, pick.choice(["div", "p", "button", "label"]).replace("label", "div"), words(1, 4)), pick.choice(["", "search", "newsletter", "subscribe", "signup", "login", "contact"]))
        if kind == 4:
            return block(0, pick.choice(["section", "div"]), block(0, "h3", words(1, 3)) + "".join(block(0, pick.choice(["div", "li", "p", "article"]), words(1, 2) + block(0, "p", words(4, 60)), pick.choice(["comment", "reply", "comment-body", "response"])) for _ in range(pick.randint(1, 4))), pick.choice(["comments", "comment-list", "responses", "discussion", "disqus", "replies"]))
        if kind == 5:
            return block(0, "div", links(0, pick.randint(2, 5)), pick.choice(["share", "social", "sharing", "social-links", "follow"]))
        if kind == 6:
            return block(0, pick.choice(["div", "p"]), words(3, 20), pick.choice(["disclaimer", "copyright", "legal", "terms", "byline", "meta", "tags", "pager", "pagination"]))
        if kind == 7:
            return block(0, "aside", block(0, "p", words(3, 40)))
        return block(0, "header", block(0, pick.choice(["h1", "div", "p"]), words(1, 6)), pick.choice(["", "site-header", "masthead"]))

    def piece() -> str:
        kind = pick.randrange(15)
        if kind < 9:
            return block(1, "p", words(*pick.choice([(1, 4), (2, 12), (10, 60), (40, 300)])) + (f' <a href="/y">{words(1, 4)}</a> {words(2, 20)}' if pick.random() < 0.2 else ""))
        if kind == 9:
            return block(1, pick.choice(["h2", "h3", "h4"]), words(1, 8))
        if kind == 10:
            return block(1, pick.choice(["ul", "ol"]), "".join(block(1, "li", words(2, 25)) for _ in range(pick.randint(2, 5))))
        if kind == 11:
            return block(1, "blockquote", block(1, "p", words(5, 50)))
        if kind == 12:
            return block(1, "pre", words(3, 30))
        if kind == 13:
            return block(1, "dl", "".join(block(1, "dt", words(1, 4)) + block(1, "dd", words(2, 25)) for _ in range(pick.randint(1, 4))))
        return block(1, "table", "".join(block(1, "tr", "".join(block(1, "td", words(1, 8)) for _ in range(3))) for _ in range(3)))

    for _ in range(n):
        inside = [piece() for _ in range(pick.choice([1, 1, 2, 3, pick.randint(1, 10), pick.randint(1, 10)]))]
        for _ in range(pick.choice([0, 0, 0, 1, 2])):
            inside.insert(pick.randint(0, len(inside)), noise())
        body = block(1, "h1", words(1, 14)) * (pick.random() < 0.8) + "".join(inside)
        outer = pick.choice(["article", "article", "main", "div", "section"])
        article = block(1, outer, body, pick.choice(["content", "post", "article", "entry-content", "main", "story", "article-body", "post-content", "text"]) if outer in ("div", "section") or pick.random() < 0.3 else "")
        if pick.random() < 0.4:
            article = block(1, pick.choice(["main", "div"]), article, pick.choice(["", "main", "content", "page"]))
        foot = block(0, "footer", words(2, 25) + (links(0, pick.randint(2, 5)) if pick.random() < 0.4 else "") + (block(0, "p", words(3, 20)) if pick.random() < 0.4 else ""), pick.choice(["", "footer", "site-footer"])) if pick.random() < 0.8 else block(0, "div", words(3, 25) + block(0, "p", words(3, 20)), pick.choice(["footer", "site-footer", "copyright"]))
        page = "<body data-y='0'>" + menu() + "".join(noise() for _ in range(pick.randint(0, 3))) + article + "".join(noise() for _ in range(pick.randint(0, 3))) + foot + "</body>"
        yield page, [False, *(y == "1" for y in re.findall(r"<(?!/)\w+ data-y=[\"'](\d)", page))]


@lru_cache(maxsize=1)
def default_model() -> PageModel:
    return train((parse(p), y) for p, y in labelled_pages())


def extract(pages: DataFrame, model: PageModel | None = None, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages with column out_col: the text of all content elements of the whole page.

    The page's elements form a tree whose nodes are content or boilerplate. Evidence at each node and
    potentials between parent and child are learnt from labelled pages; sum-product messages up and
    down the tree give each node's marginal, and nodes of one half or more are content. Their text has
    character references decoded, white space inside a block made one space, and blocks joined by a
    line break in page order. Null, empty and text-free pages give an empty text; a page without
    markup is one block; very long and deep pages are read whole, in time linear in their length. All
    rows, repeated ones too, and all columns come back; where pages have such a column already,
    underscores are put after the new one's name. An empty table gives no rows.
    """
    own = model or default_model()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([own.text(p) for p in b], dtype=object)

    return pages.withColumn(free_name(pages, out_col), F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(html_col)))


def op6_html(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
