"""Blocks of text out of article XML, HTML and plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of an article that are no text of it.
SKIPPED_TITLES = ("references", "acknowledgements", "acknowledgments", "funding", "competing interests", "conflict of interest", "author contributions", "supplementary material", "bibliography")
SKIPPED_TAGS = {"xref", "fig", "table-wrap", "disp-formula", "inline-formula", "graphic", "media", "object-id"}


def _skipped(title: str | None) -> bool:
    """Whether a heading, without its number, begins like a part that is no text."""
    return bool(title) and re.sub(r"^[\d\s.:()]+", "", title).lower().strip(" .:").startswith(SKIPPED_TITLES)


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _text(node: ElementTree.Element) -> str:
    parts = [node.text or ""]
    for child in node:
        if _tag(child) not in SKIPPED_TAGS:
            parts.append(_text(child))
        parts.append(child.tail or "")
    return "".join(parts)


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def article_blocks(xml: str) -> list[tuple[str | None, str]]:
    """(section, text) of an article's title, abstract and body; sections
    inherit the heading above, skipped ones leave nothing, malformed XML gives
    no blocks."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out: list[tuple[str | None, str]] = []

    def walk(node: ElementTree.Element, heading: str | None) -> None:
        title = next((c for c in node if _tag(c) == "title"), None)
        own = _flat(_text(title)) if title is not None else heading
        if _skipped(own):
            return
        for child in node:
            if _tag(child) == "sec":
                walk(child, own)
            elif _tag(child) == "p" and (t := _flat(_text(child))):
                out.append((own, t))

    for node in root.iter():
        if _tag(node) == "article-title" and not any(s == "Title" for s, _ in out) and (t := _flat(_text(node))):
            out.append(("Title", t))
        elif _tag(node) == "abstract" and node.get("abstract-type") not in ("graphical", "teaser"):
            walk(node, "Abstract")
        elif _tag(node) == "body":
            walk(node, None)
    return out


class _Page(HTMLParser):
    BLOCKS = {"p", "li", "td", "blockquote", "pre", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "br"}
    DROPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str | None, str]] = []
        self.heading: str | None = None
        self.held: list[str] = []
        self.dropped = 0
        self.in_heading = False

    def flush(self) -> None:
        text = _flat("".join(self.held))
        self.held = []
        if text and self.in_heading:
            self.heading = text
        elif text and not _skipped(self.heading):
            self.out.append((self.heading, text))

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.flush()
            self.dropped += 1
        elif tag in self.BLOCKS:
            self.flush()
            self.in_heading = tag[0] == "h" and tag[1:].isdigit()

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in self.BLOCKS:
            self.flush()
            self.in_heading = False

    def handle_data(self, data):
        if not self.dropped:
            self.held.append(data)


def page_blocks(page: str) -> list[tuple[str | None, str]]:
    parser = _Page()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.out


def plain_blocks(text: str) -> list[tuple[str | None, str]]:
    return [(None, t) for part in re.split(r"\n\s*\n", html.unescape(text)) if (t := _flat(part))]


READERS = {"xml": article_blocks, "html": page_blocks, "text": plain_blocks}


def blocks(sources: DataFrame, key: str, body: str, kind: str) -> DataFrame:
    """(key, ord, section, text) of every block of the bodies; ``kind`` is xml,
    html or text. Null and empty bodies give none."""
    reader = READERS[kind]
    key_type = sources.schema[key].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, sections, texts = [], [], [], []
            for i, b in enumerate(batch.column(1).to_pylist()):
                for n, (s, t) in enumerate(reader(b) if b else ()):
                    rows.append(i)
                    ords.append(n)
                    sections.append(s)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ords, pa.int32()), pa.array(sections, pa.string()), pa.array(texts, pa.string())], names=["key", "ord", "section", "text"])

    return sources.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(work, f"key {key_type}, ord int, section string, text string").withColumnRenamed("key", key)
