"""Main text of web pages, from parser events and the density of text between tags.

One pass over the events of the standard parser cuts a page into lines, one per block, each with its text, the
number of tags around it and its place in the tree. The ratio of text to tags is smoothed over the
neighbouring lines by a Gaussian, and the lines above a threshold cluster into content regions. The regions
decide which element holds the article; all lines of that element are the main text, short ones too, except
what is a menu, header, footer, sidebar, notice, advert, form or comment by its tag or its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablegauge.llm.common import arrow_table, text_groups

GROUP_BYTES = 4 << 20
#: Elements without content, without readable text, beside the article, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template svg math canvas iframe object audio video select datalist button textarea".split())
BESIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("article body div html main section table tbody td tr".split())
#: Words in a class, id or role that name something beside the article.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo
    cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup
    promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
HEADER_NAMES = frozenset("header masthead banner".split())
#: Elements that are never beside the article by their name.
KEPT = frozenset("html body main article".split())

TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters inside links
    path: tuple[int, ...]  # elements around it, outermost first


class Lines(HTMLParser):
    """Cuts a page into lines; ``names`` has the tag of every element in ``path``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, str]] = []  # tag, number, why it is left out or ""
        self.names: list[str] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.out = ""  # why text is left out here

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, tuple(n for t, n, _ in self.stack if t in HOLDERS)))
            self.tags = 0
        self.parts, self.linked = [], 0

    def reason(self, tag: str, attrs: list) -> str:
        if tag in SILENT:
            return "silent"
        if tag in BESIDE:
            return "header" if tag == "header" else "beside"
        if tag not in KEPT and attrs:
            named = {w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())}
            if found := named & NAMES:
                return "header" if found <= HEADER_NAMES else "beside"
        return ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br" or tag in VOID:
            if tag == "hr":
                self.flush()
            else:
                self.parts.append(" " if tag == "br" and not self.out else "")
            return
        if tag in BLOCKS:
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1):  # a paragraph ends where the next block begins
                if self.stack[i][0] == "p":
                    self.end_from(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        if tag in ("article", "main", "body") and self.out in ("beside", "header", "silent") and not any(t in ("article", "main") for t, _, _ in self.stack):
            # An element before the article that nobody closed.
            first = next(i for i, (_, _, why) in enumerate(self.stack) if why)
            self.end_from(first)
        why = self.reason(tag, attrs)
        if tag == "li" and self.stack and self.stack[-1][0] == "li":
            self.end_from(len(self.stack) - 1)
        self.names.append(tag)
        self.stack.append((tag, len(self.names) - 1, why))
        self.links += tag == "a"
        self.judge()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.end_from(i)
                break

    def handle_data(self, data: str) -> None:
        if self.out:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def end_from(self, at: int) -> None:
        """Ends the element at this place of the stack, and those inside it."""
        for tag, _, _ in self.stack[at:]:
            self.links -= tag == "a"
        del self.stack[at:]
        self.judge()

    def judge(self) -> None:
        whys = [why for _, _, why in self.stack if why]
        self.out = whys[0] if whys else ""
        if whys and set(whys) == {"header"}:
            tags = [t for t, _, _ in self.stack]
            # The heading of an article may stand in a header of its own.
            inside = next((i for i, t in enumerate(tags) if t in ("article", "main")), len(tags))
            first = next(i for i, (_, _, why) in enumerate(self.stack) if why)
            if inside < first and HEADINGS & set(tags):
                self.out = ""

    def unknown_decl(self, data: str) -> None:
        """CDATA sections and the like have no text."""


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios under a Gaussian of this width, which counts only lines that exist."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (np.convolve(ratios, kernel, "full") / np.convolve(np.ones(len(ratios)), kernel, "full"))[radius:len(ratios) + radius]


def regions(lines: list[Line], sigma: float, cut: float) -> list[int]:
    """Lines whose smoothed ratio of text to tags reaches ``cut`` times the mean: the content regions."""
    ratios = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    smooth = smoothed(ratios, sigma)
    chosen = np.flatnonzero(smooth >= cut * smooth.mean())
    return chosen.tolist() or [int(np.argmax(ratios))]


def main_text(html: str, sigma: float = 1.0, cut: float = 0.5) -> str:
    """The main text of a page, one line per block; empty if there is none."""
    page = Lines()
    last = html.rfind("<")
    if last > html.rfind(">") and re.match(r"<[A-Za-z/!?]", html[last:last + 2]):
        html = html[:last]  # a tag that the end of the page cuts off
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    dense = set(regions(lines, sigma, cut))
    for wanted in ("article", "main"):
        held: dict[int, int] = {}
        for i, line in enumerate(lines):
            for n in line.path:
                if page.names[n] == wanted:
                    held[n] = held.get(n, 0) + (len(line.text) if i in dense else 0)
                    break
        if held:
            best = {n for n, size in held.items() if size} or set(held)
            return "\n".join(x.text for x in lines if best & set(x.path))
    total = sum(len(lines[i].text) for i in dense)
    inside: dict[int, int] = {}
    for i in dense:
        for n in lines[i].path:
            inside[n] = inside.get(n, 0) + len(lines[i].text)
    # The innermost element that holds most of the dense text; elements are numbered from the outside in.
    holder = max((n for n, size in inside.items() if size >= 0.7 * total), default=None)
    return "\n".join(x.text for x in lines if (holder is None or holder in x.path) and 2 * x.linked <= len(x.text))


def extract_text(pages: DataFrame, sigma: float = 1.0, cut: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are not read. A null or empty page has an empty
    text. Character references are decoded, white space inside a block (line breaks too) becomes one
    space, blocks are joined by a line feed. Repeated rows give a row each, a null id or url stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, "html", GROUP_BYTES):
            texts = [main_text(h or "", sigma, cut) for h in group.column(2).to_pylist()]
            yield arrow_table({"page_id": group.column(0), "url": group.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, TEXT)

    columns = (F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.select(*columns).mapInArrow(run, from_arrow_schema(TEXT))
