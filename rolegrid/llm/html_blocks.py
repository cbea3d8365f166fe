"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block tags into flat blocks of text. A block's features are
its own and its neighbours' word counts and link densities, and a few bits of
what encloses it (article, navigation or other side parts, telling class
names). A decision tree (Gini, numpy) decides which blocks are main text; it is
trained here on the blocks of a small labelled table of pages that
:func:`labelled_pages` writes out by rule from a seed.

Scripts, styles, form fields, comments and the page head never are text.
Character references are decoded once, after tags are cut; white space inside
a block becomes one blank; kept blocks are joined by one blank in page order.
Null, empty and tag-free pages work (the latter is one block); unclosed tags
end with the page; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrid.llm.common import map_rows, values

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME_PART = re.compile(r"[A-Za-z]+")

# Elements whose content is no text of the page.
SILENT = frozenset("script style title head noscript template textarea select option svg math iframe "
                   "object audio video canvas datalist button".split())
RAW = frozenset("script style title textarea noscript iframe template".split())  # read up to their end tag
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img input link meta".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
# Containers that are kept on the stack of open elements.
BOXES = frozenset("div section nav aside footer header article main form ul ol dl table tbody thead tr td th figure "
                  "blockquote details dialog fieldset menu center address".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
# Words in class and id names that tell side parts, reader comments and main parts.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs cookie cookies consent copyright "
                       "footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination popup "
                       "promo promotion recommended related search share sharing sidebar signup social sponsor sponsored "
                       "subscribe subscription tags toolbar topbar widget disclaimer alert paywall teaser".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reader readers".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "page_has_main",
            "side_tag", "side_word", "comment", "main_word", "heading", "item", "header")


@dataclass
class Block:
    text: str
    words: int
    links: float
    bits: tuple[int, ...]


@dataclass
class _Box:
    tag: str
    side: bool
    comment: bool
    main_word: bool
    main: bool
    hidden: bool


def _box(tag: str, attributes: str) -> _Box:
    names: set[str] = set()
    role, hidden = "", False
    for key, a, b, c, flag in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() in ("class", "id"):
            names.update(_NAME_PART.findall(value))
        elif key.lower() == "role":
            role = value
        hidden |= flag == "hidden" or (key.lower() == "style" and "display:none" in value.replace(" ", ""))
    return _Box(tag, bool(names & SIDE_WORDS) or role in ("banner", "navigation", "complementary", "contentinfo", "search"),
                bool(names & COMMENT_WORDS), bool(names & MAIN_WORDS),
                tag in ("article", "main") or role in ("main", "article"), hidden)


def _context(stack: list[_Box]) -> tuple[tuple[int, ...], bool]:
    """Bits of what encloses a block, and whether it is hidden.

    Inside an article only what lies inside it counts, and outside it the
    side elements and reader comments that hold the article itself.
    """
    inner = max((i for i, b in enumerate(stack) if b.main), default=-1)
    inside, outside = stack[inner + 1:], stack[:inner + 1]
    side_tag = any(b.tag in SIDE_TAGS for b in inside) or any(b.tag in ("nav", "aside", "footer") for b in outside)
    side_word = any(b.side for b in inside) or (inner >= 0 and stack[inner].side)
    comment = any(b.comment for b in stack)
    header = inner < 0 and any(b.tag == "header" for b in stack)
    return ((int(inner >= 0), int(side_tag), int(side_word), int(comment), int(any(b.main_word for b in inside)),
             int(header)), any(b.hidden for b in stack))


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[_Box] = []
    silent: list[str] = []
    parts: list[str] = []
    links: list[str] = []
    state = {"link": 0, "tag": ""}

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                bits, hidden = _context(stack)
                if not hidden:
                    words = text.count(" ") + 1
                    linked = len(entities.unescape(" ".join(links)).split()) if links else 0
                    out.append(Block(text, words, min(1.0, linked / words),
                                     (*bits, int(state["tag"][:1] == "h" and state["tag"][1:].isdigit()),
                                      int(state["tag"] in ("li", "dt", "dd", "td", "th")))))
            parts.clear()
            links.clear()

    def say(text):
        if text and not silent:
            parts.append(text)
            if state["link"]:
                links.append(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        say(page[at:m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "title" or not silent:
                at = end.end() if end else len(page)
            continue
        if tag in SILENT:
            if closing:
                if tag in silent:
                    del silent[len(silent) - 1 - silent[::-1].index(tag):]
            elif not attributes.rstrip().endswith("/"):
                if not silent:
                    flush()
                silent.append(tag)
            continue
        if tag == "body" and silent:
            silent.clear()  # an unclosed head ends here
        if tag == "a":
            state["link"] = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag == "br":
            say(" ")
            continue
        flush()
        state["link"] = 0
        state["tag"] = "" if closing else tag
        if tag in BOXES:
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            else:
                stack.append(_box(tag, attributes))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Feature rows of a page's blocks, in the order of ``FEATURES``."""
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    bits = np.array([b.bits for b in found], float).reshape(len(found), 8)
    in_main, side_tag, side_word, comment, main_word, header, heading, item = bits.T
    has_main = np.full(len(found), float((in_main + main_word).any()))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], in_main, has_main,
                            side_tag, side_word, comment, main_word, heading, item, header])


class Tree:
    """Binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0))
        best = None
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], y[order]
                n = np.arange(1, len(t))
                left = np.cumsum(t)[:-1]
                right = t.sum() - left
                impurity = left * (n - left) / n + right * (len(t) - n - right) / (len(t) - n)
                impurity[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = np.inf
                i = int(impurity.argmin()) if len(impurity) else 0
                if len(impurity) and impurity[i] < np.inf and (best is None or impurity[i] < best[0] - 1e-12):
                    best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
        if best:
            go = x[:, best[1]] <= best[2]
            a = self._grow(x[go], y[go], depth - 1, least)
            b = self._grow(x[~go], y[~go], depth - 1, least)
            self.nodes[at] = (best[1], best[2], a, b, self.nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, cut, a, b, share = self.nodes[node]
            if f < 0 or not len(rows):
                out[rows] = share
                continue
            go = x[rows, f] <= cut
            todo += [(a, rows[go]), (b, rows[~go])]
        return out


def labelled_pages(n: int, seed: int) -> list[list[tuple[str, int]]]:
    """``n`` pages as lists of ``(html, label)`` parts; label 1 is main text, -1 holds no block."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(2, 10)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    link = lambda: f'<a href="/{word()}">{say(1, 4)}</a>'

    def menu():
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(3, 8))) + "</ul>"

    def side(tag, name):
        body = rng.choice([menu, lambda: f"<p>{say(3, 40)}</p>", lambda: f"<h3>{say(1, 4)}</h3><p>{say(5, 30)} {link()}</p>",
                           lambda: f"{say(4, 25)}"])()
        return f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>{body}</{tag}>'

    def main_parts():
        out = [(f"<h1>{say(3, 10)}</h1>", 1)]
        for _ in range(rng.randrange(2, 10)):
            shape = rng.randrange(12)
            if shape < 5:
                out.append((f"<p>{say(20, 120)}</p>", 1))
            elif shape < 8:
                out.append((f"<p>{say(1, 8)}</p>", 1))
            elif shape == 8:
                out.append((f"<h2>{say(1, 6)}</h2>", 1))
            elif shape == 9:
                out.append((f"<p>{say(10, 40)} {link()} {say(3, 20)}</p>", 1))
            elif shape == 10:
                out.append(("<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(3)) + "</ul>", 1))
            else:
                out.append((side("div", rng.choice(["ad", "share", "related-posts", "newsletter-signup", "promo"])), 0))
        return out

    pages = []
    for i in range(n):
        top = [(side("nav", rng.choice(["", "menu"])), 0)]
        if rng.random() < 0.5:
            top.append((side("header", rng.choice(["", "site-header", "masthead"])), 0))
        if rng.random() < 0.5:
            top.append((side("div", rng.choice(["cookie-notice", "banner", "ad", "advert", "topbar", "notice"])), 0))
        if rng.random() < 0.4:
            top.append((side("div", ""), 0) if i % 5 < 3 else (side("div", "search"), 0))
        kind = i % 5
        if kind == 4:  # nothing tells the parts but their text
            bare = [f"<div>{' | '.join(link() for _ in range(rng.randrange(3, 9)))}</div>", f"<p>{link()}</p><p>{link()} {link()}</p>",
                    f"<div>{say(1, 4)}</div>"]
            body = [(f"<p>{say(20, 120)}</p>", 1) if rng.random() < 0.75 else (f"<p>{say(4, 12)}</p>", 1)
                    for _ in range(rng.randrange(3, 9))]
            pages.append([("<html><body><table>", -1), (rng.choice(bare), 0), (rng.choice(bare), 0), (f"<h1>{say(3, 10)}</h1>", 1),
                          (f"<p>{say(25, 120)}</p>", 1), *body, (f"<p>{say(25, 120)}</p>", 1),
                          (rng.choice(bare[:2]), 0), (rng.choice(bare), 0), ("</table></body></html>", -1)])
            continue
        if kind < 3:  # article, main, or both
            opening, closing = [("<article>", "</article>"), ("<main>", "</main>"),
                                ('<main id="main"><article class="post">', "</article></main>")][kind]
        else:  # told by class names only
            name = rng.choice(["content", "post-content", "entry", "article-body", "story"])
            opening, closing = f'<div class="{name}">', "</div>"
        bottom = []
        if rng.random() < 0.6:
            bottom.append((side("aside", rng.choice(["", "sidebar"])), 0))
        if rng.random() < 0.6:
            rows = "".join(f'<div class="comment"><p>{say(2, 60)}</p></div>' for _ in range(rng.randrange(1, 5)))
            bottom.append((f'<section id="{rng.choice(["comments", "discussion", "replies"])}">{rows}</section>', 0))
        if rng.random() < 0.4:
            bottom.append((f"<form><label>{say(1, 4)}</label><p>{say(2, 15)}</p></form>", 0))
        bottom.append((side("footer", ""), 0) if i % 5 else (side("div", "footer"), 0))
        body = main_parts()
        if rng.random() < 0.3:
            body.append((f'<section class="comments"><p>{say(5, 80)}</p></section>', 0))
        pages.append([("<html><body>", -1), *top, (opening, -1), *body, (closing, -1), *bottom, ("</body></html>", -1)])
    return pages


def labelled_blocks(pages: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks; a part's blocks share its label."""
    xs, ys = [], []
    for parts in pages:
        found = blocks("".join(p for p, _ in parts))
        labels = [y for p, y in parts if y >= 0 for _ in blocks(p)]
        assert len(found) == len(labels)
        xs.append(features(found))
        ys.append(np.array(labels, float))
    return np.vstack(xs), np.concatenate(ys)


@lru_cache(maxsize=2)
def trained(n: int = 250, seed: int = 5) -> Tree:
    return Tree(*labelled_blocks(labelled_pages(n, seed)))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``."""
    tree = tree or trained()

    def run(it):
        for batch in it:
            texts = [main_text(h or "", tree) for h in values(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run,
                    "page_id long, url string, text string, n_chars long")
