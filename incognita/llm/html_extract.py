"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is tokenized, tolerant of unclosed and stray tags, into leaf blocks: stretches of text between block-level tags,
with the tags, classes, ids and roles of their ancestors. Each block is described by ancestor tags, words in their
attributes and the shape of its text; the field's two labels (article or not) are decoded by Viterbi's algorithm. It is
trained here by gradient ascent on the likelihood of labelled pages, which ``labelled_pages`` writes in many layouts.

Edge cases: null html counts as empty; a page without article blocks has empty text; scripts, styles, comments and other
raw content never are blocks; what stands in drawings, formulas, objects and canvases is read as other text is; rows that repeat a page_id are extracted each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# HTML's block-level, void and raw-text elements, those of other vocabularies, where HTML goes on inside them,
# their texts that stand by themselves, and which open elements an opening tag closes.
BLOCK = frozenset(
    "html head body title nav header footer main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend button select option blockquote pre figure figcaption address hr details summary dialog center menu label noscript template".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noframes noembed xmp".split())
FOREIGN = frozenset("svg math".split())
HTML_IN = frozenset("foreignobject desc svg-title annotation-xml mi mo mn ms mtext".split())
LABEL = frozenset("text desc svg-title".split())
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
STORY = frozenset("article main".split())
SCOPE = frozenset("table td th ul ol dl select article section div main aside nav body".split())
IN_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form blockquote pre figure address hr fieldset details menu center".split())

_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNQUOTED = re.compile(r"""=\s*[^\s"']*/\Z""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    """An open element: its tag and the words of its class, id and role."""

    tag: str
    words: tuple[str, ...]


@dataclass
class Block:
    """A leaf block: white space collapsed, with the elements around it and the share of its text in links.

    ``story`` counts the outermost article and main elements up to the one around the block; 0 if none is.
    """

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: float
    story: int = 0


@lru_cache(maxsize=4096)
def _words(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        found += [w.lower() for w in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(found))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    in_link, link_chars, stories = 0, 0, 0

    def close() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] in BLOCK), min(1.0, link_chars / len(text)), stories if any(x[0] in STORY for x in stack) else 0))
        parts, link_chars = [], 0

    def pop(tag: str, scope: frozenset[str] = frozenset()) -> None:
        nonlocal in_link
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                in_link -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    def foreign() -> str:
        for tag, _ in reversed(stack):
            if tag in FOREIGN:
                return tag
            if tag in BLOCK or tag in HTML_IN:
                break
        return ""

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "title" and any(x[0] == "svg-title" for x in stack):
                tag = "svg-title"
            if tag in BLOCK:
                close()
            if tag == "br" or (tag in LABEL and any(x[0] == "svg" for x in stack)):
                parts.append(" ")
            pop(tag)
            continue
        attributes = m[3] or m[6] or ""
        outside = foreign()
        if tag == "title" and outside == "svg":
            tag = "svg-title"
        if attributes.endswith("/") and (outside or tag in FOREIGN) and not _UNQUOTED.search(attributes):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>{f'|(?=</{outside})' if outside else ''}", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if outside and tag in LABEL:
            parts.append(" ")
        if outside and tag in BLOCK:
            pop(outside)
        if tag in BLOCK:
            close()
            if tag in IN_P:
                pop("p", SCOPE)
            for other in CLOSES.get(tag, ()):
                pop(other, frozenset(("table",)) if tag in ("tr", "td", "th") else SCOPE - {other})
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            pop("a", SCOPE)
            in_link += 1
        if tag in STORY and not any(x[0] in STORY for x in stack):
            stories += 1
        stack.append((tag, _words(attributes)))
    close()
    return out


# --- features -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 14)
def path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    """Features of the elements around a block; the same path is described once."""
    tags = [t for t, _ in path]
    inner = [f"word:{w}" for _, words in path for w in words]
    out = [f"in:{t}" for t in tags if t not in ("html", "body")]
    if path:
        out += [f"leaf:{tags[-1]}", *(f"leafword:{w}" for w in path[-1][1])]
    story = max((k for k, t in enumerate(tags) if t in ("article", "main")), default=None)
    if story is not None:
        out += [f"story>{t}" for t in tags[story + 1 :] if t in ("header", "footer", "nav", "aside", "form", "section")]
    elif "header" in tags or "footer" in tags:
        out.append("page-edge")
    return tuple(dict.fromkeys([*out, *inner]))


_MARK = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
# Words that short texts around an article have.
_CUE = re.compile(r"\b(?:comments?|repl(?:y|ies)|said|cookies?|accept|newsletter|subscri(?:be|ption)|sign (?:in|up)|log ?in|advert(?:isement|ising)?|sponsored|related|recommended|most read|read more|share|follow us|search|menu|privacy|terms of use|contact|home|tags)\b", re.I)


def text_features(text: str, linked: float) -> tuple[str, ...]:
    """Features of a block's shape."""
    words = text.count(" ") + 1
    size = next((k for k, most in enumerate((2, 5, 10, 20, 40, 80)) if words <= most), 6)
    out = [f"size:{size}", f"linked:{min(4, int(linked * 5))}", "stop" if text[-1] in ".!?…:;\"'»”" else "nostop"]
    if _MARK.search(text):
        out.append("copyright")
    if words <= 12 and _CUE.search(text):
        out.append("cue")
    if text.count("|") + text.count("·") >= 2 and words < 30:
        out.append("bars")
    if sum(c.isdigit() for c in text[:80]) * 3 > len(text[:80]):
        out.append("digits")
    return tuple(out)


def describe(page: list[Block]) -> list[tuple[str, ...]]:
    """The features of each block of a page."""
    out, stories = [], any(b.story for b in page)
    for k, b in enumerate(page):
        place = []
        if stories and not b.story:
            place.append("outside")
        elif b.story > 1:
            place.append("later-story")
        if k and k == len(page) - 1:
            place.append("last")
        if k and page[k - 1].path == b.path:
            place.append("as-before")
        out.append((*path_features(b.path), *text_features(b.text, b.linked), *place, "bias"))
    return out


# --- the field ----------------------------------------------------------------------------------------------------


class Field:
    """Weights of a linear chain with labels 0 (other) and 1 (article).

    A block's features speak for label 1 by their summed weights; ``moves`` weighs neighbouring labels.
    """

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, features: list[tuple[str, ...]]) -> list[int]:
        """The likeliest labels, by Viterbi's algorithm."""
        if not features:
            return []
        get, (m00, m01), (m10, m11) = self.weights.get, *self.moves
        other, story, back = 0.0, 0.0, []
        for k, f in enumerate(features):
            e = sum(get(x, 0.0) for x in f)
            if k == 0:
                story = e
                continue
            a, b, c, d = other + m00, story + m10, other + m01, story + m11
            back.append((b > a, d > c))
            other, story = max(a, b), max(c, d) + e
        labels = [int(story > other)]
        for from_other, from_story in reversed(back):
            labels.append(int(from_story if labels[-1] else from_other))
        return labels[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 120, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """Fits a field by gradient ascent (Adam) on the mean log-likelihood of labelled pages, less ``decay`` times squared weights."""
    names = sorted({f for features, _ in pages for x in features for f in x})
    index = {f: k for k, f in enumerate(names)}
    t = max(len(labels) for _, labels in pages)
    flat = np.zeros((sum(len(labels) for _, labels in pages), len(names)), np.float32)
    for row, f in zip(flat, (f for features, _ in pages for f in features)):
        row[[index[g] for g in f]] = 1
    y, mask = np.zeros((len(pages), t), int), np.zeros((len(pages), t), bool)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    pair = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    theta, m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    lse = lambda a, axis: (top := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))
    for step in range(1, rounds + 1):
        e = np.zeros((len(pages), t, 2))
        e[mask, 1] = flat @ theta[:-4].astype(np.float32)
        moves = theta[-4:].reshape(2, 2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for k in range(1, t):
            new = lse(forward[:, k - 1, :, None] + moves, 1) + e[:, k]
            forward[:, k] = np.where(mask[:, k, None], new, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            new = lse(moves[None] + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = lse(forward[:, -1], 1)
        on = np.exp(forward[..., 1] + backward[..., 1] - z[:, None])
        joint = np.exp(forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad = np.concatenate([(y[mask] - on[mask]).astype(np.float32) @ flat, (seen - joint[pair].sum(axis=0)).ravel()]) / len(pages) - decay * theta * 2
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (rounds + 1))
    return Field({f: float(w) for f, w in zip(names, theta)}, theta[-4:].reshape(2, 2).tolist())


# --- labelled pages -----------------------------------------------------------------------------------------------


class _Writer:
    """Writes a page and, beside it, whether each of its texts belongs to the article."""

    def __init__(self, draw: random.Random):
        self.draw, self.html, self.truth = draw, [], []

    def words(self, least: int, most: int) -> str:
        d = self.draw
        return " ".join("".join(d.choice("bcdfglmnprstvzaeiou") for _ in range(d.randint(2, 9))) for _ in range(d.randint(least, most)))

    def cue(self, kind: str, text: str) -> str:
        """The text, or now and then words that such a part of a page has."""
        d = self.draw
        return d.choice(CUES[kind]) if d.random() < 0.4 else f"{d.choice(CUES[kind])} {text}" if d.random() < 0.2 else text

    def sentence(self, least: int = 5, most: int = 60) -> str:
        return self.words(least, most).capitalize() + self.draw.choice("....!?")

    def put(self, tag: str, text: str, label: int, attributes: str = "", closed: bool = True) -> None:
        self.html.append(f"<{tag}{attributes}>{text}" + f"</{tag.split()[0]}>" * closed)
        self.truth.append(label)

    def open(self, tag: str, attributes: str = "") -> None:
        self.html.append(f"<{tag}{attributes}>")

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>")


# Words that class, id and role attributes of each part of a page are made of.
NAMES = {
    "menu": "nav navbar menu navigation topnav mainnav breadcrumb breadcrumbs links toc tabs pager pagination".split(),
    "header": "header masthead banner top topbar branding logo site-header page-header".split(),
    "footer": "footer bottom copyright legal colophon site-footer page-footer imprint".split(),
    "side": "sidebar side aside widget related recommended popular trending rail secondary complementary more-stories tags".split(),
    "notice": "notice cookie cookies consent alert gdpr banner-cookie popup modal overlay paywall warning message newsletter privacy dialog".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense ad-slot banner-ad commercial".split(),
    "form": "form search login signup subscribe newsletter-form contact search-box register".split(),
    "comments": "comments comment replies discussion reader-comments comment-list respond reactions disqus feedback user-comments".split(),
    "share": "share social sharing follow buttons toolbar".split(),
    "story": "content article post entry story main text body article-body post-content entry-content main-content page-content wrapper-text".split(),
}
CUES = {
    "menu": ["Home", "Contact", "Menu", "Search"],
    "header": ["Home", "Search", "Menu"],
    "footer": ["Privacy", "Terms of use", "Contact", "All rights reserved"],
    "side": ["Related", "Most read", "Read more", "Recommended", "Tags"],
    "notice": ["We use cookies.", "Accept", "Subscribe to our newsletter", "Cookie settings"],
    "ad": ["Advertisement", "Sponsored", "Advert"],
    "form": ["Search", "Sign up", "Log in", "Subscribe"],
    "comments": ["Comments", "Leave a reply", "Reply", "3 replies", "Add a comment"],
    "share": ["Share", "Follow us"],
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "notice": "dialog"}


def _part(w: _Writer, kind: str, named: bool = True) -> None:
    """Some part of a page that isn't the article; unless ``named``, its elements may be of no telling kind."""
    d = w.draw
    tag = SEMANTIC.get(kind) if d.random() < 0.6 else None
    tag = tag or ("form" if kind == "form" else d.choice(["div", "div", "div", "section"]))
    plain = (tag in ("nav", "header", "footer", "aside", "form", "dialog") and d.random() < 0.6) or (not named and d.random() < 0.5)
    attributes = "" if plain else f' {d.choice(["class", "class", "id", "role"])}="{d.choice(NAMES[kind])}"'
    w.open(tag, attributes)
    bare = d.random() < 0.4
    if kind == "menu":
        if d.random() < 0.8:
            w.open("ul")
            for _ in range(d.randint(2, 9)):
                w.put("li", f'<a href="#">{w.cue(kind, w.words(1, 2))}</a>', 0, closed=d.random() < 0.8)
            w.close("ul")
        else:
            w.put("div" if not bare else "span", " | ".join(f'<a href="#">{w.words(1, 2)}</a>' for _ in range(5)), 0)
    elif kind == "header":
        w.put(d.choice(["h1", "div", "p", "h2"]), w.words(1, 6), 0)
        if d.random() < 0.5:
            w.put("p", w.cue(kind, w.words(2, 14)), 0)
    elif kind == "footer":
        w.put("p" if not bare else "span", f"{d.choice(['&copy;', '©', 'Copyright', ''])} {w.words(1, 5)} {d.choice(['&middot;', '|', '-'])} {w.sentence(3, 12)}", 0)
        if d.random() < 0.3:
            w.put("p", w.cue(kind, w.sentence(6, 40)), 0)
    elif kind == "form":
        w.put("label", w.cue(kind, w.words(1, 3)), 0)
        w.put("button", w.words(1, 2), 0)
        if d.random() < 0.4:
            w.put("p", w.sentence(4, 25), 0)
    elif kind == "comments":
        if d.random() < 0.7:
            w.put(d.choice(["h2", "h3", "h4"]), w.cue(kind, f"{d.randint(1, 90)} {w.words(1, 1)}"), 0)
        listed = d.choice(["ol", "ul", ""])
        if listed:
            w.open(listed)
        for _ in range(d.randint(1, 4)):
            holder = "li" if listed else d.choice(["div", "li", "article", "section"])
            w.open(holder, d.choice(["", ' class="comment"', ' class="reply"']))
            if d.random() < 0.5:
                w.put("div", w.words(1, 3), 0)
            for _ in range(d.randint(1, 2)):
                w.put("p", w.sentence(3, 60), 0)
            if d.random() < 0.2:
                w.put("div", '<a href="#">Reply</a>', 0)
            w.close(holder)
        if listed:
            w.close(listed)
    elif kind == "share":
        for _ in range(d.randint(2, 4)):
            w.put(d.choice(["div", "li"]), f'<a href="#">{w.cue(kind, w.words(1, 2))}</a>', 0)
    elif bare:
        w.html.append(w.cue(kind, w.sentence(3, 30)))
        w.truth.append(0)
    else:
        if d.random() < 0.4:
            w.put(d.choice(["h2", "h3", "h4"]), w.cue(kind, w.words(1, 4)), 0)
        for _ in range(d.randint(1, 3)):
            w.put(d.choice(["p", "div", "li"]), w.sentence(3, 45) if d.random() < 0.7 else f'<a href="#">{w.words(3, 9)}</a>', 0)
    w.close(tag)


def _story(w: _Writer) -> None:
    """The article, with asides, adverts and the like between its blocks now and then."""
    d = w.draw
    layout = d.choice(["article", "article", "article", "main", "both", "div", "div", "section", "td", "bare"])
    outer = {"article": ["article"], "main": ["main"], "both": ["main", "article"], "div": ["div"], "section": ["section"], "td": ["table", "tr", "td"], "bare": []}[layout]
    for tag in outer:
        named = (tag in ("div", "section") and d.random() < 0.75) or (tag in ("article", "main", "td") and d.random() < 0.4)
        w.open(tag, f' {d.choice(["class", "id"])}="{d.choice(NAMES["story"])}"' if named else "")
    paragraph = d.choice(["p"] * 7 + ["div"] * 2)
    if d.random() < 0.8:
        head = d.random() < 0.15 and layout in ("article", "both")
        if head:
            w.open("header")
        w.put("h1" if d.random() < 0.85 else "h2", w.words(1, 14), 1)
        if head:
            w.close("header")
    if d.random() < 0.1:
        _part(w, "share")
    sloppy = d.random() < 0.3
    for _ in range(1 if d.random() < 0.15 else d.randint(1, 14)):
        form = d.random()
        if form < 0.75:
            text = w.sentence(1 if d.random() < 0.1 else 5, 90)
            if d.random() < 0.15:
                text = f'{text} <a href="#">{w.words(1, 4)}</a> {w.sentence(2, 8)}'
            if d.random() < 0.02:
                text = f"{d.choice(CUES['form'])} {w.words(1, 6)}"
            if d.random() < 0.1:
                text = " | ".join(w.words(1, 1) for _ in range(d.randint(5, 40)))
            w.put(paragraph, f"<b>{text}<br>" if sloppy and d.random() < 0.4 else text, 1, closed=paragraph == "div" or not sloppy or d.random() < 0.5)
        elif form < 0.85:
            w.put(d.choice(["h2", "h3"]), w.words(1, 8), 1)
        elif form < 0.92:
            tag = d.choice(["ul", "ol"])
            w.open(tag)
            for _ in range(d.randint(2, 5)):
                w.put("li", w.words(1, 16), 1)
            w.close(tag)
        else:
            w.put(d.choice(["blockquote", "pre", "figcaption"]), w.sentence(2, 30), 1)
        if d.random() < 0.05:
            _part(w, d.choice(["ad", "side", "form", "notice", "share"]))
    if d.random() < 0.12:
        _part(w, "comments")
    for tag in reversed(outer):
        w.close(tag)


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages in drawn layouts, with a label for each leaf block: 1 for the article's."""
    out, draw = [], random.Random(seed)
    for _ in range(n):
        w = _Writer(draw)
        if draw.random() < 0.85:
            w.html.append("<!DOCTYPE html><html><head>")
            w.put("title", w.words(1, 12), 0)
            w.html.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        wrapped = draw.random() < 0.3
        if wrapped:
            w.open("div", draw.choice(["", ' class="wrapper"', ' id="page"', ' class="container"']))
        for kind, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("ad", 0.4), ("form", 0.3), ("side", 0.25)):
            if draw.random() < chance:
                _part(w, kind)
        w.html.append("<!-- x -->")
        _story(w)
        for kind, chance in (("share", 0.15), ("comments", 0.35), ("side", 0.35), ("ad", 0.3), ("form", 0.25), ("menu", 0.2), ("notice", 0.15), ("footer", 0.85)):
            if draw.random() < chance:
                _part(w, kind, kind != "comments")
        if wrapped:
            w.close("div")
        w.html.append("</body></html>")
        out.append(("".join(w.html), w.truth))
    return out


TRAIN_PAGES = 900


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    """The field trained on ``pages`` labelled pages."""
    data = []
    for html, truth in labelled_pages(pages, seed):
        found = blocks(html)
        if len(found) == len(truth):
            data.append((describe(found), truth))
    return train(data)


def main_text(page: str | None, field: Field) -> str:
    """The article's blocks, joined by empty lines."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, field.decode(describe(found))) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 2):
                texts = [main_text(p, field) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
