"""Main text of web pages: blocks are judged by stop words, length and links, short ones by neighbours.

Element names decide only where an element never holds article text, and for reader comments, which read
like an article. All else about names is evidence: blocks in a container whose class or id names a notice,
advert or menu, and blocks outside the page's article elements, are out unless the densities find most of
the page's text there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame

from corpusweave.session import ship_package

LANGUAGES = ("english", "french", "german", "spanish")
LONG = 200  # characters of a block that is text whatever its words
MIDDLE = 70  # characters from which stop words decide
STOP_DENSITY = 0.2
LINK_DENSITY = 0.3

# Element names of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea iframe object svg canvas menu dialog".split()
)
MAIN = frozenset(("article", "main"))
# words of class and id names that speak against a container, those of reader comments, and words that say
# nothing beside them
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead header cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related "
    "recommended widget form login search pagination pager".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
NEUTRAL = frozenset(
    "area bar block body box container content bottom entry group inner item items left list outer panel posts reader right row section site stream thread top "
    "user users widget wrap wrapper".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def named(names: str, words: frozenset[str]) -> bool:
    """Whether a class or id, as a whole, is one of ``words``, alone or with neutral ones beside it."""
    for token in names.split():
        parts = [p.lower() for p in _PARTS.findall(token) if not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in MARKS or p in NEUTRAL for p in parts):
            return True
    return False


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    place: int | None  # number of the article that holds it
    out: bool  # inside an element that is never article text
    mark: int | None = None  # number of the outermost container around it whose name speaks against it
    good: bool | None = None


@dataclass
class _Open:
    tag: str
    out: bool
    place: int | None
    mark: int | None


@dataclass
class _Reader(HTMLParser):
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # where on the stack the elements of a name stand
        self.parts: list[str] = []
        self.linked = self.places = self.marks = 0

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, None, None)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.top()
            self.blocks.append(Block(text, self.linked, top.place, top.out, top.mark))
        self.parts.clear()
        self.linked = 0

    def drop(self, tag: str, stop: frozenset[str]) -> None:
        """Close the innermost open ``tag``, unless an element of ``stop`` is nearer. An element leaves the
        stack once, and a name that is not open costs nothing."""
        if not self.open[tag] or any(self.open[s][-1] > self.open[tag][-1] for s in stop if self.open[s]):
            return
        for _ in range(len(self.stack) - self.open[tag][-1]):
            self.open[self.stack.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            self.drop("p", BLOCKS - {"p"})
            if tag == "li":
                self.drop("li", frozenset(("ul", "ol", "menu")))
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        top = self.top()
        place, mark = top.place, top.mark
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        inside = tag not in ("html", "body")
        out = top.out or tag in NEVER or hidden or (tag == "header" and place is None) or (inside and named(names, COMMENTS))
        if tag in MAIN and place is None and not out:
            self.places += 1
            place = self.places
        if mark is None and inside and tag not in MAIN and named(names, MARKS):
            self.marks += 1
            mark = self.marks
        if tag not in BLOCKS and (out, mark) != (top.out, top.mark):
            self.flush()
        self.open[tag].append(len(self.stack))
        self.stack.append(_Open(tag, out, place, mark))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        top = self.top()
        if tag in BLOCKS or (top.tag == tag and (top.out or top.mark is not None)):
            self.flush()
        self.drop(tag, MAIN if tag not in MAIN else frozenset())

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())


def read_blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def density_label(block: Block, stop_words: frozenset[str]) -> bool | None:
    """Text or not by length, links and stop words alone; None where they do not say."""
    length = len(block.text)
    if block.linked > LINK_DENSITY * length:
        return False
    if length >= LONG:
        return True
    if length >= MIDDLE:
        words = [w.strip(".,;:!?\"'()[]*#$%&|-").lower() for w in block.text.split()]
        if sum(w in stop_words for w in words) >= STOP_DENSITY * len(words):
            return True
    return None


def classify(blocks: list[Block], stop_words: frozenset[str]) -> None:
    """Set ``good``: first from each block alone, then short blocks from their nearest decided neighbours.

    What is around a page's articles is out, unless ten times the text that they hold is found there by the
    densities. A named container loses its blocks, unless more than half of all characters of its article
    (or of a page without articles) are in it and the densities call them text.
    """
    kept = [b for b in blocks if not b.out]
    for b in kept:
        b.good = density_label(b, stop_words)
    inside = sum(len(b.text) for b in kept if b.place is not None and b.mark is None)
    around = sum(len(b.text) for b in kept if b.place is None and b.mark is None and b.good)
    articles = 10 * inside >= around and any(b.place is not None for b in kept)
    whole: dict[int | None, int] = defaultdict(int)
    held: dict[int | None, int] = defaultdict(int)
    for b in kept:
        whole[b.place] += len(b.text)
        held[b.mark] += len(b.text) * bool(b.good)
    named_out = [b.out or (b.mark is not None and 2 * held[b.mark] <= whole[b.place]) for b in blocks]
    for b, out in zip(blocks, named_out, strict=True):
        if out or (articles and b.place is None):
            b.good = False
    decided = [b.good for b in blocks]
    for i, b in enumerate(blocks):
        if b.good is None:
            near = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(blocks) and (decided[j] is None or (articles and blocks[j].place != b.place) or (articles and named_out[j])):
                    j += step
                if 0 <= j < len(blocks):
                    near.append((abs(j - i), not decided[j]))
            b.good = not min(near)[1] if near else True  # a tie goes to text


def main_text(html: str, stop_words: frozenset[str]) -> str:
    blocks = read_blocks(html)
    classify(blocks, stop_words)
    return "\n".join(b.text for b in blocks if b.good)


def extract_text(
    pages: DataFrame, keep: list[str], html_col: str = "html", languages: tuple[str, ...] = LANGUAGES
) -> DataFrame:
    """The ``keep`` columns of every page with ``text`` (string) and ``n_chars`` (its code points).

    Blocks are cut at block elements; a line break counts as white space. A block is out if it lies in
    an element that is never article text or among reader comments, or mostly in links; it is text if it
    is long or, at middle length, has enough stop words, unless names speak against it, see
    :func:`classify`. A block that stays undecided takes the label of its nearest decided neighbour,
    inside an article only of neighbours in it; with none it is text. A kept column named as a result
    gives its place to it. A null or empty page
    gives the empty string; broken markup is read as far as it goes; repeated rows stay. Pages don't
    leave their task.
    """
    spark = pages.sparkSession
    ship_package(spark)
    words = spark.sparkContext.broadcast(
        frozenset(w.lower() for name in languages for w in StopWordsRemover.loadDefaultStopWords(name))
    )

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = [main_text(h.as_py() or "", words.value) for h in part.column(len(keep))]
                sizes = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], [*keep, "text", "n_chars"]
                )

    keep = [c for c in keep if c not in ("text", "n_chars")]
    source = pages.select(*keep, html_col)
    return source.mapInArrow(extracted, source.select(*keep).schema.add("text", "string").add("n_chars", "long"))
