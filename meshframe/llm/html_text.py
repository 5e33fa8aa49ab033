"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into blocks: stretches of text between block-level tags, each with its open ancestors (names, classes and
ids) and the share of its text inside links. The field tags each block as article or other; emissions sum the weights
of hashed features of ancestors and text, transitions tie neighbours, and Viterbi finds the best sequence. Weights are
learnt on pages that a generator builds with known labels (menus, headers, notices, adverts, forms, sidebars, comments,
footers around articles of varied make), so nothing is drawn from the pages to be judged.

Scripts, styles and other content that is not shown never become blocks. Character references are decoded; white space
inside a block is one space; the article's blocks are joined by one space in page order.

Markup is cut by the states of the HTML standard: quotes in names and values without quotes, comments that end at once or
by ``--!>``, scripts that hold comments with scripts. An element keeps only what it adds to its ancestors, so time and
memory follow a page's length, however deep it is nested.

Nulls: a null page is empty and has no text. Markup that is not closed, closed twice or cut off is read as far as it
goes. Pages of any length are read whole; memory follows the longest. Ties between sequences go to what is not article.
Repeated rows get a result each. Columns other than identifier, address and page are not looked at. Empty tables give
empty results.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import table

HASH_BITS = 14
TRAINING_PAGES, EPOCHS, RATE, L2 = 900, 12, 0.3, 1e-3

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg math time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is not shown as text.
HIDDEN = frozenset("script style noscript noembed noframes template head title textarea select option svg math iframe object canvas audio video".split())
#: Elements whose content follows the rules of XML.
FOREIGN = frozenset("svg math".split())
#: Content up to the closing tag, whatever it looks like.
RAW = frozenset("script style textarea title iframe noscript noembed noframes".split())
#: Blocks that end an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: White space of markup, and an attribute: its name, then a value in double or single quotes, or without any.
_S = r"\t\n\f\r "
_NAME = rf"=[^{_S}/>=]*+|[^{_S}/>=]++"
_ATTRIBUTE = rf"""(?:{_NAME})(?:[{_S}]*+=[{_S}]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^{_S}>"'][^{_S}>]*+)?+)?+"""
#: Comments, of which some end at once; declarations, and end tags without a name; tags. No quantifier gives back what it
#: has taken, so a page is read in one pass.
_MARKUP = re.compile(rf"<!--(?:-?>|(?:(?!--!?>).)*+(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![a-zA-Z]|\Z)[^>]*+>?|<(/?)([a-zA-Z][^{_S}/>]*+)((?:[{_S}/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_PARTS = re.compile(rf"""({_NAME})(?:[{_S}]*+=[{_S}]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^{_S}>"'][^{_S}>]*+))?+)?+""")
_CLOSED = re.compile(rf"""(?:^|[{_S}"'])/[{_S}]*\Z""").search
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
#: What opens and closes the stretches of a script in which its end tag does not count.
_SCRIPT = re.compile(rf"<!--|--!?>|<(/?)script(?=[{_S}/>])", re.I)


#: One notice word in so many words makes a block a notice.
NOTICE_WORDS = 50


class Node:
    """An open element: what it adds to its ancestors' features, so that a page's depth costs nothing."""

    __slots__ = ("added", "depth", "leaf", "number", "outer", "parent")

    def __init__(self, number: int, parent: Node | None, name: str, added: tuple[int, ...]):
        self.number, self.parent, self.added = number, parent, added
        above = (0, "none", "") if parent is None else (parent.depth, parent.leaf, parent.outer)
        if name in INLINE or name in ("", "html", "body"):
            self.depth, self.leaf, self.outer = above
        else:
            self.depth, self.leaf, self.outer = above[0] + 1, name, "" if above[1] == "none" else above[1]


class Block:
    """A stretch of text, the share of it inside links, and the innermost open element."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, linked: float, node: Node):
        self.text, self.linked, self.node = text, linked, node


@lru_cache(maxsize=4096)
def _named(attributes: str) -> tuple[str, ...]:
    """The words in an element's class, id and role."""
    found = set()
    for m in _PARTS.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            found.update(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return tuple(sorted(found))


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the content of a raw element that starts at at ends, its end tag included."""
    stop = None
    if name == "script":
        escaped = inner = False
        for m in _SCRIPT.finditer(page, at):
            if m[0] == "<!--":
                escaped = True
            elif m[0][:2] == "--":
                escaped = inner = False
            elif not m[1]:
                inner = escaped
            elif inner:
                inner = False
            else:
                stop = m
                break
    else:
        stop = re.compile(rf"</{name}(?=[{_S}/>])", re.I).search(page, at)
    if stop is None:
        return len(page)
    tag = _MARKUP.match(page, stop.start())
    return len(page) if tag is None else tag.end()


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, blank ones left out."""
    out: list[Block] = []
    root = Node(0, None, "", ())
    stack: list[tuple[str, Node]] = []
    outer: list[int] = []  # places in the stack of what is not inline
    open_names: dict[str, int] = {}
    open_features: dict[int, int] = {}
    parts: list[str] = []
    linked = hidden = links = made = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked / max(1, sum(map(len, parts))), stack[-1][1] if stack else root))
            parts.clear()
            linked = 0

    def push(name: str, names: tuple[str, ...]) -> None:
        nonlocal hidden, links, made
        made += 1
        own = {_hash(f"c={w}") for w in names}
        if name not in INLINE:
            own.add(_hash(f"t={name}"))
            outer.append(len(stack))
        added = tuple(f for f in own if f not in open_features)
        for f in added:
            open_features[f] = len(stack)
        stack.append((name, Node(made, stack[-1][1] if stack else root, name, added)))
        open_names[name] = open_names.get(name, 0) + 1
        hidden += name in HIDDEN
        links += name == "a"

    def pop(name: str) -> None:
        """Closes the innermost open element of that name, with what is open inside it."""
        nonlocal hidden, links
        if not open_names.get(name):
            return
        while True:
            n, node = stack.pop()
            for f in node.added:
                del open_features[f]
            if outer and outer[-1] == len(stack):
                outer.pop()
            open_names[n] -= 1
            hidden -= n in HIDDEN
            links -= n == "a"
            if n == name:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            linked += len(text) if links > 0 else 0

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE and not hidden:
                close()
            if name == "br":
                continue
            pop(name)
            continue
        if name in VOID:
            if name == "hr" and not hidden:
                close()
            elif name == "br" and parts and not hidden:
                parts.append(" ")
            continue
        if hidden and name != "body":
            pass  # what is not shown ends no block
        elif name in ENDS_PARAGRAPH:
            close()
            if outer and stack[outer[-1]][0] == "p":
                pop("p")
        elif name not in INLINE:
            close()
            if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop(name)
        if _CLOSED(m[3]) and (name in FOREIGN or any(open_names.get(n) for n in FOREIGN)):
            continue  # elsewhere a slash closes nothing
        if name in RAW:
            at = _raw_end(page, name, at)
            continue
        push(name, _named(m[3]) if m[3] else ())
        if name == "body":
            hidden = 0
    close()
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) >> (32 - HASH_BITS)


def _ancestors(node: Node) -> list[int]:
    """The features that the ancestors add, each once."""
    out = []
    while node is not None:
        out += node.added
        node = node.parent
    return out


@lru_cache(maxsize=20_000)
def _place_features(leaf: str, outer: str, depth: int) -> tuple[int, ...]:
    return tuple(_hash(f) for f in ("bias", f"leaf={leaf}", f"pair={outer}>{leaf}", f"depth={min(depth, 6)}"))


_NOTICE = ("cookie", "subscribe", "newsletter", "sign up", "copyright", "©", "all rights", "advert", "sponsored", "log in", "share", "comment", "reply", "privacy", "terms", "follow us", "related")


def own_features(block: Block, place: int, total: int) -> list[int]:
    """What a block's text and place add to the features of its ancestors."""
    text = block.text
    low = text.lower()
    words = text.count(" ") + 1
    found = [f"len={min(int(math.log2(words)), 8)}", f"link={int(block.linked * 4)}", f"stop={text[-1] in '.!?…:;'}", f"first={text[0].isupper()}", f"at={place * 5 // max(1, total)}"]
    if words < 12:
        found.append(f"short={'stop' if text[-1] in '.!?' else 'open'}")
    found += [f"n={w}" for w in _NOTICE if w in low and low.count(w) * NOTICE_WORDS >= words]
    node = block.node
    return [*_place_features(node.leaf, node.outer, node.depth), *(_hash(f) for f in found)]


def block_features(block: Block, place: int, total: int) -> list[int]:
    return [*_ancestors(block.node), *own_features(block, place, total)]


def emissions(page_blocks: list[Block], weights: np.ndarray) -> list[float]:
    """The sums of the blocks' weights; an element's sum is its parent's and what it adds."""
    known = {0: 0.0}

    def of(node: Node) -> float:
        way = []
        while node.number not in known:
            way.append(node)
            node = node.parent
        value = known[node.number]
        for n in reversed(way):
            value = known[n.number] = value + (float(weights[list(n.added)].sum()) if n.added else 0.0)
        return value

    total = len(page_blocks)
    return [of(b.node) + float(weights[own_features(b, i, total)].sum()) for i, b in enumerate(page_blocks)]


class Field:
    """weights for the state article; trans[i][j] of state j after state i."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def article(self, page_blocks: list[Block]) -> list[bool]:
        """The best sequence of states, by Viterbi."""
        if not page_blocks:
            return []
        (t00, t01), (t10, t11) = self.trans.tolist()
        other, main, back = 0.0, 0.0, []
        for i, e in enumerate(emissions(page_blocks, self.weights)):
            if i:
                from_other = (other + t00 >= main + t10, other + t01 > main + t11)
                other, main = max(other + t00, main + t10), max(other + t01, main + t11) + e
                back.append(from_other)
            else:
                main = e
        state = main > other
        out = [state]
        for from_other in reversed(back):
            state = not from_other[1] if state else not from_other[0]
            out.append(state)
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return " ".join(b.text for b, keep in zip(found, self.article(found), strict=True) if keep)


# ---------------------------------------------------------------- labelled pages


def labelled_page(rng: random.Random) -> list[tuple[Block, bool]]:
    """A page from a random template with the label of each block. Article words are marked with a letter that nothing
    else uses; the mark is taken off again."""
    mark = "ѣ"
    syllables = ["ta", "re", "mo", "an", "in", "or", "the", "de", "la", "ung", "que", "os", "ent", "er"]

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def pick(*names: str) -> str:
        return rng.choice(names)

    def tag(name: str, inner: str, names: tuple[str, ...] = ()) -> str:
        attribute = f' {pick("class", "id")}="{pick(*names)}"' if names and rng.random() < 0.85 else ""
        ending = "" if name in ("p", "li") and rng.random() < 0.2 else f"</{name}>"
        return f"<{name}{attribute}>{inner}{ending}"

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(n)]
        return "<ul>" + "".join(tag("li", i) for i in items) + "</ul>" if rng.random() < 0.7 else pick(" | ", " ").join(items)

    def paragraph() -> str:
        size = rng.choice([(1, 5), (5, 25), (20, 120), (40, 200)])
        inner = " ".join(mark + sentence(*size) for _ in range(rng.choice([1, 1, 2, 4])))
        if rng.random() < 0.2:
            inner = pick("<b>", "<em>", f'<a href="x">{mark}{words(1, 3)}</a> ', "<span>") + inner
        if rng.random() < 0.15:
            inner += "<br>" + mark + sentence(3, 12)
        return inner

    def article() -> str:
        body = []
        if rng.random() < 0.85:
            body.append(f"<{(h := pick('h1', 'h1', 'h2'))}>{mark}{sentence(2, 14)}</{h}>")
        for _ in range(rng.choice([1, 2, 4, 8, 15])):
            kind = rng.random()
            if kind < 0.8:
                body.append(tag(pick("p", "p", "p", "p", "div"), paragraph()))
            elif kind < 0.87:
                body.append(f"<h2>{mark}{words(1, 8)}</h2>")
            elif kind < 0.93:
                body.append("<ul>" + "".join(tag("li", mark + sentence(2, 30)) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.96:
                body.append(f"<blockquote>{tag('p', paragraph())}</blockquote>")
            else:
                body.append(tag(pick("pre", "td"), mark + words(3, 40)))
            if rng.random() < 0.06:
                body.append(tag(pick("div", "aside"), sentence(3, 15), ("ad", "advert", "promo", "related", "sponsored", "banner")))
        inner = "".join(body)
        shape = rng.random()
        if shape < 0.55:
            return tag("article", inner, ("post", "entry", "content", "article"))
        if shape < 0.7:
            return tag("main", inner, ("content", "main"))
        if shape < 0.82:
            return pick(inner, f"<div>{inner}</div>")
        return f'<div {pick("class", "id")}="{pick("content", "article body", "post", "entry content", "main", "story", "article")}">{inner}</div>'

    def other() -> str:
        kind = rng.randrange(11)
        if kind < 2:
            return tag(pick("nav", "nav", "div"), links(rng.randint(2, 9)), ("nav", "menu", "navbar", "breadcrumb", "navigation"))
        if kind == 2:
            return tag("header", pick("", f"<h1>{words(1, 4)}</h1>", f"<p>{sentence(2, 8)}</p>") + links(rng.randint(0, 5)), ("header", "masthead", "site header", "top"))
        if kind == 3:
            return tag(pick("div", "section"), f"<p>{pick('We use cookies. ', 'Cookie notice: ', '')}{sentence(4, 30)}</p>{pick('', '<button>OK</button>')}", ("cookie", "notice", "consent", "banner", "alert", "cookie banner", "gdpr"))
        if kind < 6:
            return f'<div {pick("class", "id")}="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot", "banner")}">{pick("", "<p>")}{sentence(2, 40)}</div>'
        if kind == 6:
            return tag("form", f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>", ("search", "form", "login", "newsletter", "subscribe"))
        if kind == 7:
            return tag(pick("aside", "aside", "div"), f"<h3>{words(1, 5)}</h3>" + pick(links(4), f"<p>{sentence(4, 40)}</p>", f"<p>{sentence(10, 80)}</p>"), ("sidebar", "related", "widget", "side", "popular", "aside"))
        if kind == 8:
            many = "".join(tag(pick("div", "li", "p", "article"), f"<b>{words(1, 2)}</b> <p>{sentence(2, 60)}</p>", ("comment", "reply", "comment body")) for _ in range(rng.randint(1, 5)))
            return f'<{(s := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment list", "discussion", "responses", "replies")}"><h3>{pick("Comments", words(1, 2))}</h3>{many}</{s}>'
        if kind == 9:
            return tag(pick("div", "ul"), links(rng.randint(2, 6)), ("share", "social", "tags", "pagination", "meta"))
        return tag("footer", pick("", "<p>") + pick("&copy; ", "Copyright ", "") + sentence(2, 25) + pick("", links(4)), ("footer", "site footer", "bottom", "copyright"))

    before = [other() for _ in range(rng.randint(0, 4))]
    after = [other() for _ in range(rng.randint(0, 4))]
    page = "<html><head><title>x</title></head><body>" + "".join(before) + article() + "".join(after) + pick("", "</body></html>")
    if rng.random() < 0.3:
        page = page.replace("<body>", f'<body><div class="{pick("wrapper", "page", "container", "site")}">')
    out = []
    for b in blocks(page):
        out.append((Block(b.text.replace(mark, "") or "x", b.linked, b.node), mark in b.text))
    return out


def train(pages: list[list[tuple[Block, bool]]], epochs: int = EPOCHS, seed: int = 3) -> Field:
    """Stochastic gradient ascent (AdaGrad) on the regularised likelihood, by forward-backward on each page."""
    weights, trans = np.zeros(1 << HASH_BITS), np.zeros((2, 2))
    seen, seen_trans = np.full(1 << HASH_BITS, 1e-6), np.full((2, 2), 1e-6)
    data = [([block_features(b, i, len(p)) for i, (b, _) in enumerate(p)], np.array([y for _, y in p], int)) for p in pages if p]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            feats, y = data[k]
            n = len(y)
            e = np.array([weights[f].sum() for f in feats])
            boost, m = np.exp(np.clip(e, -30, 30)), np.exp(trans)
            fw, bw = np.ones((n, 2)), np.ones((n, 2))
            fw[0, 1] = boost[0]
            for t in range(1, n):
                fw[t] = fw[t - 1] @ m
                fw[t, 1] *= boost[t]
                fw[t] /= fw[t].sum()
            pair = np.zeros((2, 2))
            for t in range(n - 2, -1, -1):
                after = bw[t + 1] * (1.0, boost[t + 1])
                joint = fw[t][:, None] * m * after
                pair += joint / joint.sum()
                bw[t] = m @ after
                bw[t] /= bw[t].sum()
            p = fw * bw
            error = y - p[:, 1] / p.sum(1)
            flat = np.concatenate([np.asarray(f) for f in feats])
            g = np.bincount(flat, np.repeat(error, [len(f) for f in feats]), 1 << HASH_BITS)
            touched = np.flatnonzero(g)
            g = g[touched] - L2 * weights[touched]
            seen[touched] += g * g
            weights[touched] += RATE * g / np.sqrt(seen[touched])
            true = np.zeros((2, 2))
            np.add.at(true, (y[:-1], y[1:]), 1)
            tg = true - pair - L2 * trans
            seen_trans += tg * tg
            trans += RATE * tg / np.sqrt(seen_trans)
    return Field(weights.astype(np.float32), trans)


@lru_cache(maxsize=1)
def trained() -> Field:
    rng = random.Random(17)
    return train([labelled_page(rng) for _ in range(TRAINING_PAGES)])


def _extract(model):
    def run(batches):
        field = Field(*model.value)
        for batch in batches:
            texts = [field.text(v.as_py() or "") for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None, page: str = "html", ident: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""
    field = field or trained()
    model = pages.sparkSession.sparkContext.broadcast((field.weights, field.trans))
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
