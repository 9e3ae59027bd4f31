"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of text runs and tags. Words score positive (less, or below zero, in
containers that rarely hold content) and tags negative, with weights learned from labelled
pages: those whose markup names their article. One linear scan finds the contiguous run of
tokens with the largest sum. Where that region lies in an element the page itself calls an
article or its main part, it is widened or cut to that element, and parts inside it that are no
content (menus, footers, sidebars, notices, adverts, forms, reader comments) are left out. A class,
id or role says so if all pieces of one of its names do ("cookie-notice", not "with-sidebar"). Such
a mark, or a form, that would take most words of a page is void if no unmarked article is left and
it is, or holds, an article, or is a form, or leaves no word.

Blocks end at block-level tags; white space in a block becomes one space, character references
are decoded, blocks are joined by a line feed. Nothing else is dropped, however long.

Null and empty html give an empty text, as do pages without words. Broken markup ends where the
page ends; a tag that is cut off there is dropped. Repeated rows give repeated results. Weights
come from `bound` labelled pages at most; without any, defaults stand. Extraction works in the
row: no shuffle. Other columns of the input are kept; clashing names are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.llm.common import slices, with_field

SAMPLE_PAGES = 4_000
WORD_WEIGHT, TAG_WEIGHT, LEAST_TAG, MOST_TAG = 0.5, -0.2, -0.05, -3.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noframes|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|</?(?P<odd>[a-z][^\s/>]*)[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
PIECE = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCK - frozenset("body head html".split())
# Elements that never hold the article's text, and words of a class, id or role that say so.
NO_CONTENT = frozenset("nav aside footer form noscript template svg button select option object canvas dialog menu head audio video".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies discussion"
    " share sharing social related recommended newsletter subscribe subscription popup modal overlay footer masthead topbar"
    " toolbar search login signup contentinfo complementary".split()
)
# Names that a paragraph of an article may have.
OF_PARAGRAPHS = frozenset("notice notices alert social search".split())
ROOTS = frozenset(["article", "main"])
SAME = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
        "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
          "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}


@dataclass
class Element:
    name: str
    mark: str
    skip: bool
    root: int
    soft: tuple[int, ...] = ()


@dataclass
class Page:
    """Tokens of a page: kind (feature), words, text, block number, whether left out, article."""

    kinds: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    skips: list[bool] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    softs: list[tuple[int, ...]] = field(default_factory=list)

    def add(self, kind: str, words: int, text: str, block: int, skip: bool, root: int, soft: tuple[int, ...]) -> None:
        for values, value in zip((self.kinds, self.words, self.texts, self.blocks, self.skips, self.roots, self.softs), (kind, words, text, block, skip, root, soft), strict=True):
            values.append(value)

    def settle(self, strong: set[int]) -> None:
        """Leaves out what marks take, except for marks that would take the page's content; `strong` are articles and forms."""
        total, left, held, rooted, article = 0, 0, Counter(), set(strong), False
        for words, skip, root, soft in zip(self.words, self.skips, self.roots, self.softs, strict=True):
            if skip or not words:
                continue
            total, left, article = total + words, left + (0 if soft else words), article or bool(root and not soft)
            for k in soft:
                held[k] += words
                if root:
                    rooted.add(k)
        void = {k for k, n in held.items() if not article and n * 2 > total and (k in rooted or not left)}
        self.skips = [skip or not void.issuperset(soft) for skip, soft in zip(self.skips, self.softs, strict=True)]


def marks(attrs: str) -> tuple[str, bool, set[str]]:
    """First word of the class or id, whether it is hidden, and the words by which a name says that it is no content."""
    first, out, said = "", False, set()
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            out = True
        elif value:
            pieces = [p for p in PIECE.split(value) if p]
            first = first or (pieces[0] if pieces and name != "role" else "")
            for one in value.split():
                own = {p for p in PIECE.split(one) if p}
                said |= own if own <= NO_CONTENT_WORDS else set()
    return first, out, said


def read_page(html: str) -> Page:
    """The tokens of a page with the open elements applied to each text run."""
    page, stack, block, at, roots, softs, strong = Page(), [], 0, 0, 0, 0, set()

    def text_until(end: int) -> None:
        if end > at:
            text = html[at:end]
            words = len(text.split())
            top = stack[-1] if stack else Element("", "", False, 0)
            linked = "/a" if any(e.name == "a" for e in stack[-4:]) else ""
            mark = next((e.mark for e in reversed(stack) if e.mark), "")
            holder = next((e.name for e in reversed(stack) if e.name in BLOCK), "")
            page.add(f"{holder}.{mark}{linked}", words, text, block, top.skip, top.root, top.soft)

    for found in TOKEN.finditer(html):
        text_until(found.start())
        at = found.end()
        name = (found["name"] or found["odd"] or "").lower()
        if not name:
            continue
        closing = found["close"] == "/" or (found["odd"] is not None and html.startswith("</", found.start()))
        if name in BLOCK:
            block += 1
        if not closing:
            if name in ROOTS:
                while stack and stack[-1].name not in ROOTS and any(e.name in NO_CONTENT for e in stack):
                    stack.pop()
            if name in CLOSES_PARAGRAPH:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in BLOCK:
                        break
            for k in range(len(stack) - 1, -1, -1):
                if name not in SAME or stack[k].name in SCOPES[name] and stack[k].name not in SAME[name]:
                    break
                if stack[k].name in SAME[name]:
                    del stack[k:]
                    break
            above = stack[-1] if stack else Element("", "", False, 0)
            mark, out, said = marks(found["attrs"] or "")
            root = above.root
            if name in ROOTS and not root:
                roots += 1
                root = roots
            out = out and name not in ("html", "body")
            skip = above.skip or out or (name in NO_CONTENT and name != "form") or (name == "header" and not root)
            soft = above.soft
            if name == "p" and root:
                said = said - OF_PARAGRAPHS
            if name == "form" or said and name not in ("html", "body"):
                softs += 1
                soft = (*soft, softs)
                if name == "form" or name in ROOTS:
                    strong.add(softs)
            page.add(f"<{name}", 0, "", block, skip, root, soft)
            if name not in VOID and not (found["attrs"] or "").endswith("/"):
                stack.append(Element(name, mark, skip, root, soft))
        else:
            top = stack[-1] if stack else Element("", "", False, 0)
            page.add(f"</{name}", 0, "", block, top.skip, top.root, top.soft)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
    text_until(len(html))
    page.settle(strong)
    return page


@dataclass(frozen=True)
class Weights:
    words: dict[str, float]
    tags: dict[str, float]

    def of(self, kind: str, words: int) -> float:
        if kind.startswith("<"):
            return self.tags.get(kind, TAG_WEIGHT)
        return words * self.words.get(kind, WORD_WEIGHT)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the largest sum; the first of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, value in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += value
        if total > best:
            best, region = total, (start, k + 1)
    return region


def extract(html: str | None, weights: Weights) -> str:
    """The main text of one page."""
    page = read_page(html or "")
    scores = [
        min(0.0, weights.of(k, n)) if skip else weights.of(k, n)
        for k, n, skip in zip(page.kinds, page.words, page.skips, strict=True)
    ]
    start, end = best_region(scores)
    inside = Counter()
    for k in range(start, end):
        if not page.skips[k]:
            inside[page.roots[k]] += page.words[k]
    total = sum(inside.values())
    root = max((r for r in inside if r), key=lambda r: inside[r], default=0)
    # The region's edges follow the page's own article where most of its words are in one.
    whole = root if root and inside[root] * 2 > total else None
    first = page.blocks[start] if total else 0
    last = page.blocks[end - 1] if total else -1
    blocks: dict[int, list[str]] = {}
    for k, (text, block, skip, at) in enumerate(zip(page.texts, page.blocks, page.skips, page.roots, strict=True)):
        if skip or not (at == whole if whole else first <= block <= last):
            continue
        if text:
            blocks.setdefault(block, []).append(text)
        elif page.kinds[k] == "<br":
            blocks.setdefault(block, []).append(" ")
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and tags inside and outside the articles of one task's labelled pages, by kind."""
    counts = {True: Counter(), False: Counter()}
    for batch in slices(batches):
        for html in batch.column("html").to_pylist():
            page = read_page(html or "")
            for kind, words, root, skip in zip(page.kinds, page.words, page.roots, page.skips, strict=True):
                counts[bool(root) and not skip][kind] += words if not kind.startswith("<") else 1
    rows = [(k, inside, n) for inside, counter in counts.items() for k, n in counter.items() if n]
    yield pa.RecordBatch.from_pydict({
        "kind": pa.array([r[0] for r in rows], pa.string()), "inside": pa.array([r[1] for r in rows], pa.bool_()),
        "n": pa.array([r[2] for r in rows], pa.int64()),
    })


def learn(pages: DataFrame, bound: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most `bound` pages (in expectation) whose markup names an article."""
    labelled = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select("page_id", "html")
    known = labelled.count()
    if known > bound:
        labelled = labelled.filter(F.pmod(F.xxhash64("page_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * (bound / known)))
    counted = labelled.select("html").mapInArrow(token_counts, "kind STRING, inside BOOLEAN, n BIGINT").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside"),
    )
    words, tags = {}, {}
    # Kinds seen often enough to count: at most all tokens of the bounded sample over 20.
    for r in counted.filter(F.col("inside") + F.col("outside") >= 20).collect():
        odds = float(np.log((r["inside"] + 0.5) / (r["outside"] + 0.5)))
        if r["kind"].startswith("<"):
            tags[r["kind"]] = max(MOST_TAG, min(LEAST_TAG, odds))
        else:
            words[r["kind"]] = max(-1.0, min(1.0, odds / 3))
    return Weights(words, tags)


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """The rows of `pages` with `text` and `n_chars`."""
    kept = pages.drop("text")
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [extract(h, sent.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, with_field(kept, "text", T.StringType())).withColumn("n_chars", F.char_length("text").cast("bigint"))
