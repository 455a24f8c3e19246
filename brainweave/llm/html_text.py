"""Operator 5, HTML extraction: a linear-chain conditional random field over the leaf blocks of a page's DOM.

A page becomes its leaf blocks in page order: a block is the text between two borders of block-level elements, with the
elements that stand open around it. Character references are decoded; white space inside a block is one blank; script,
style, comments and other elements that show no text give no blocks. Every block has features of its ancestors (tags,
and words of their class, id and role) and of its text (length, links, punctuation, capitals, place). The field has
two labels, main text and the rest, a weight per feature and label and a weight per pair of neighbouring
labels; it is trained on labelled pages (``html_training``) by gradient ascent on the log-likelihood, and a page is
decoded by Viterbi. The main text is its blocks, joined by one newline; nothing is cut or left out.

Defined cases: a null or empty html, and a page without main text, give an empty string; repeated rows give the same
result; markup that is never closed ends with the page; an empty table gives an empty result; columns of the input named
text or n_chars are replaced, others stay. Pages are independent of each other: no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML, by how they are treated.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math meter noscript object output "
    "picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var video body html marquee nobr".split()
)
RAW = set("script style textarea title template iframe noembed noframes xmp svg annotation annotation-xml".split())
ELEMENTS = BLOCK | INLINE
#: What an opening tag closes: an open element of these names, not looking past the barriers.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

#: Words by which pages name their parts in class and id.
NAMED = set(
    "ad ads advert advertisement adslot sponsor sponsored promo promoted banner cookie consent gdpr notice alert popup modal "
    "overlay newsletter subscribe signup login comment comments reply replies discussion respond disqus nav navigation navbar "
    "menu breadcrumb breadcrumbs sidebar side rail widget related recommended more share social follow footer foot header "
    "masthead top toolbar search form article post entry content main body story text copyright legal tags meta byline "
    "author date caption pager pagination skip hidden".split()
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


@lru_cache(maxsize=4096)
def named_parts(attributes: str) -> frozenset[str]:
    """The words of class, id and role that name parts of pages. Short attributes are remembered: pages repeat them."""
    return frozenset({w.lower() for _, a, b, c in ATTRIBUTE.findall(attributes) for w in NAME_PART.findall(a or b or c)} & NAMED)


@dataclass(slots=True)
class Place:
    """Where a block stands. Elements within each other share these sets, which are bounded whatever the depth."""

    parent: str = "-"  # the innermost open element
    block: str = "-"  # the innermost one of block level
    tags: frozenset[str] = frozenset()  # open elements that HTML has
    marks: frozenset[str] = frozenset()  # words of their class, id and role that name parts of pages

    def inside(self, name: str, attributes: str) -> Place:
        """The place inside a further element."""
        tags = self.tags if name in self.tags or name not in ELEMENTS else self.tags | {name}
        marks = self.marks
        if "=" in attributes:
            new = (named_parts(attributes) if len(attributes) < 200 else named_parts.__wrapped__(attributes)) - marks
            marks = marks | new if new else marks
        return Place(name, name if name in BLOCK else self.block, tags, marks)


class Open:
    """The open elements of a page, with the positions of each name: finding and closing one takes no walk over the others."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places = [Place()]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # positions of elements of block level
        self.links = 0

    def last(self, *names: str) -> int:
        """The position of the innermost open element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def block_after(self, i: int) -> bool:
        """Whether an element of block level is open inside the i-th."""
        return bool(self.blocks) and self.blocks[-1] > i

    def add(self, name: str, attributes: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.links += name == "a"
        self.names.append(name)
        self.places.append(self.places[-1].inside(name, attributes))

    def close(self, i: int) -> None:
        """Closes the i-th and all inside it."""
        while len(self.names) > i:
            name = self.names.pop()
            self.places.pop()
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.links -= name == "a"


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in order; in time linear in the page, however its elements are nested or left open."""
    found: list[Block] = []
    stack = Open()
    parts: list[str] = []
    linked, place, end = 0, 0, len(page)
    context: Place | None = None

    def say(text: str) -> None:
        nonlocal linked, context
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if context is None and text and not text.isspace():
            context = stack.places[-1]
        if stack.links:
            linked += len(text.strip())

    def border() -> None:
        nonlocal linked, context
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text and context:
                found.append(Block(text, context, linked))
            parts.clear()
        linked, context = 0, None

    def close(i: int) -> None:
        if stack.block_after(i - 1):
            border()
        stack.close(i)

    for m in TAG.finditer(page):
        if m.start() < place:
            continue  # inside a raw element
        if m.start() > place:
            say(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                border()
            i = stack.last(name)
            if i >= 0 and (name in BLOCK or name == "a" or not stack.block_after(i)):  # other inline end tags don't close blocks
                close(i)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCK:
            border()
            i = stack.last("p")
            if i >= 0 and name != "button" and not stack.block_after(i):
                close(i)
            if name in CLOSES:
                i = stack.last(*CLOSES[name])
                if i > stack.last(*BARRIER.get(name, ("table",))):
                    close(i)
        if name in VOID:
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                ended = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, place)
                place = ended.end()
            continue
        stack.add(name, m[3])
    if place < end:
        say(page[place:])
    border()
    return found


# ---- features

def squashed(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def feature_names(page: list[Block]) -> Iterator[list[str]]:
    n = len(page)
    for i, b in enumerate(page):
        text, size = b.text, len(b.text)
        words = text.count(" ") + 1
        letters = sum(map(str.isalpha, text)) or 1
        out = ["bias", f"parent:{b.place.parent}"]
        out += [f"tag:{t}" for t in b.place.tags]
        out += [f"mark:{m}" for m in b.place.marks]
        block_parent = b.place.block
        inside = "article" in b.place.tags or "main" in b.place.tags
        out += [
            f"block:{block_parent}",
            f"words:{squashed(words, (2, 4, 8, 16, 32, 64))}",
            f"linked:{squashed(int(10 * b.linked / size), (1, 3, 5, 8))}",
            f"stops:{squashed(text.count('. ') + text.count(', '), (1, 3, 8))}",
            f"end:{text[-1] if text[-1] in '.!?:,' else ('digit' if text[-1].isdigit() else 'other')}",
            f"caps:{squashed(int(10 * sum(map(str.isupper, text)) / letters), (2, 5, 8))}",
            f"digits:{squashed(int(10 * sum(map(str.isdigit, text)) / size), (2, 5))}",
            f"place:{4 * i // n}",
        ]
        if inside:
            out += ["inside", f"inside:{block_parent}", f"inside:linked:{squashed(int(10 * b.linked / size), (1, 5))}"]
        if not inside:
            out.append(f"outside:words:{squashed(words, (4, 16, 40))}")
        if "©" in text:
            out.append("copyright")
        yield out


@dataclass
class Field:
    """Feature numbers, weights per feature and label (rest, main), and weights of (label before, label)."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, names in enumerate(feature_names(page)):
            out[i] = self.weights[[self.index[f] for f in names if f in self.index]].sum(0)
        return out

    def viterbi(self, emit: np.ndarray) -> list[bool]:
        """The most likely labels."""
        best, back = emit[0], []
        for e in emit[1:]:
            paths = best[:, None] + self.steps
            back.append(paths.argmax(0))
            best = paths.max(0) + e
        label = int(best.argmax())
        labels = [label]
        for b in reversed(back):
            label = int(b[label])
            labels.append(label)
        return [bool(x) for x in reversed(labels)]

    def main_text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        if not found:
            return ""
        keep = self.viterbi(self.emissions(found))
        return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, rate: float = 0.2, decay: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty, by AdaGrad; forward-backward over all pages at once, padded to equal length."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in fs] for fs in feature_names(page)] for page, _ in pages]
    n, longest = len(pages), max(len(r) for r in rows)
    feat = np.array([f for page in rows for fs in page for f in fs])
    cell = np.array([p * longest + i for p, page in enumerate(rows) for i, fs in enumerate(page) for _ in fs])
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    for p, (_, labels) in enumerate(pages):
        mask[p, : len(labels)] = True
        gold[p, : len(labels)] = labels
    truth = np.zeros((n, longest, 2))
    np.put_along_axis(truth, gold[..., None], 1.0, 2)
    truth *= mask[..., None]
    pair = mask[:, 1:] & mask[:, :-1]
    truth_steps = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    sum_w, sum_s = np.full_like(w, 1e-8), np.full_like(steps, 1e-8)
    for _ in range(rounds):
        emit = np.stack([np.bincount(cell, w[feat, y], n * longest) for y in (0, 1)], 1).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for i in range(1, longest):
            on = logsum(ahead[:, i - 1, :, None] + steps, 1) + emit[:, i]
            ahead[:, i] = np.where(mask[:, i, None], on, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            on = logsum(steps + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(mask[:, i + 1, None], on, behind[:, i])
        total = logsum(ahead[:, -1], 1)
        likely = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        both = ahead[:, :-1, :, None] + steps + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        likely_steps = (np.exp(both) * pair[..., None, None]).sum((0, 1))
        off = (truth - likely).reshape(-1, 2)
        g = np.stack([np.bincount(feat, off[cell, y], len(names)) for y in (0, 1)], 1) - decay * w
        gs = truth_steps - likely_steps - decay * steps
        sum_w += g * g
        sum_s += gs * gs
        w += rate * g / np.sqrt(sum_w)
        steps += rate * gs / np.sqrt(sum_s)
    return Field(names, w, steps)


_TRAINED: list[Field] = []


def trained() -> Field:
    """The field trained on the labelled pages, once per process."""
    if not _TRAINED:
        from brainweave.llm import html_training

        _TRAINED.append(train(html_training.labelled_pages()))
    return _TRAINED[0]


def extract_text(pages: DataFrame, html: str = "html", model: Field | None = None) -> DataFrame:
    """pages with text and n_chars instead of the html column."""
    kept = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred weights

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = kept.value
        for batch in batches:
            yield pd.Series([field.main_text(x) for x in batch], dtype=object)

    others = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (html.lower(), "text", "n_chars")]
    return pages.select(*others, text_of(F.col(f"`{html}`").cast("string")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
