"""Cutting oversized texts at natural boundaries (problem 2).

Agglomerative merging: a text is first cut into atomic segments at the
coarsest boundaries that leave segments small enough; adjacent segments then
sit in a heap by the strength of the boundary between them, and the weakest
boundaries are merged first while the combined size plus the overlap fits.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidora.llm.sentences import Splitter, blocks

LEVELS = ("none", "word", "sentence", "paragraph")
_GAP = re.compile(r"\s+")


def _paragraph_cuts(text: str) -> list[int]:
    return [a for a, _ in blocks(text)][1:]


def _sentence_cuts(text: str, splitter: Splitter) -> list[int]:
    cuts = []
    for end in splitter.ends(text)[:-1]:
        while text[end].isspace():
            end += 1
        cuts.append(end)
    return cuts


def _word_cuts(text: str) -> list[int]:
    return [m.end() for m in _GAP.finditer(text) if 0 < m.start() and m.end() < len(text)]


def _units(text: str, cuts: list[int]) -> Iterator[tuple[int, int]]:
    edges = [0, *cuts, len(text)]
    return zip(edges, edges[1:])


def atoms(text: str, size: int, overlap: int, splitter: Splitter) -> list[tuple[int, int]]:
    """Atomic segments as (start, strength of the boundary at start). Only the
    units that exceed ``size``, without white space around them, are cut at the
    next finer level; a word that does is cut so that the overlap fits too."""
    out: list[tuple[int, int]] = []

    def cut(a: int, b: int, level: int, strength: int) -> None:
        piece = text[a:b]
        if len(piece.strip()) <= size:
            out.append((a, strength))
            return
        if level == 0:
            for k in range(a, b, size - overlap):
                out.append((k, strength if k == a else 0))
            return
        cuts = _paragraph_cuts(piece) if level == 3 else _sentence_cuts(piece, splitter) if level == 2 else _word_cuts(piece)
        for k, (x, y) in enumerate(_units(piece, cuts)):
            cut(a + x, a + y, level - 1, level if k else strength)

    cut(0, len(text), 3, 3)
    return out


def merge(starts: list[tuple[int, int]], end: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Merges adjacent segments over the weakest boundaries first (ties: the
    smaller result, then the earlier one) while ``overlap`` characters of the
    text before still fit. Returns the pieces as (start, end) without overlap."""
    n = len(starts)
    first = [a for a, _ in starts]
    last = [*first[1:], end]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    version = [0] * n

    def entry(k: int) -> tuple[int, int, int, int, int]:
        j = right[k]
        return starts[j][1], last[j] - first[k], k, version[k], version[j]

    heap = [entry(k) for k in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, length, k, v, w = heapq.heappop(heap)
        j = right[k] if alive[k] else n
        if j >= n or version[k] != v or version[j] != w:
            continue
        if length + (min(overlap, first[k])) > size:
            continue
        last[k] = last[j]
        alive[j] = False
        right[k] = right[j]
        version[k] += 1
        if right[k] < n:
            left[right[k]] = k
            heapq.heappush(heap, entry(k))
        if left[k] >= 0:
            heapq.heappush(heap, entry(left[k]))
    return [(first[k], last[k]) for k in range(n) if alive[k]]


def cut_text(text: str, size: int, overlap: int, splitter: Splitter) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, strength of the boundary at start).
    ``start`` lies ``overlap`` characters before the end of the piece before;
    less where a unit that fits ``size`` leaves no room for so many. No piece is
    longer than ``size``; without their overlaps the pieces are the text, but
    for white space at an end that wouldn't fit. A text within ``size`` is one
    piece."""
    if len(text) <= size:
        return [(0, len(text), 3)]
    found = atoms(text, size, overlap, splitter)
    strength = dict(found)
    out = []
    for a, b in merge(found, len(text), size, overlap):
        kind = strength[a]
        while b - a > size and text[a].isspace():
            a += 1
        b = min(b, a + size)  # what lies beyond is white space
        out.append((max(0, a - overlap, b - size) if a else 0, b, kind))
    return out


def split_items(items: DataFrame, key: str = "passage_seq", text: str = "text", keep: tuple[str, ...] = ("section",), size: int = 3000, overlap: int = 200, rules: dict | None = None, only_oversized: bool = False) -> DataFrame:
    """Pieces of every item: key, ``keep`` columns, ``piece`` (from 0),
    ``start_char``, ``end_char``, ``boundary`` (kind of the boundary at the
    start), ``level`` (the finest boundary between the item's pieces, which is
    the coarsest level at which all its units fit) and ``text``.

    An item within ``size`` is one piece. Null texts give no row, an empty text
    one empty piece. Repeated rows repeat their pieces. ``only_oversized``
    leaves out the items within ``size`` before any text leaves the JVM.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size")
    sent = items.sparkSession.sparkContext.broadcast(rules)
    source = items.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).cast("struct<none:int>").alias("kept"))
    source = source.where(F.length("text") > size) if only_oversized else source.where(F.col("text").isNotNull())
    schema = StructType(list(source.schema.fields)).add("piece", "integer").add("start_char", "integer").add("end_char", "integer").add("boundary", "string").add("level", "string")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(sent.value)
        for batch in batches:
            rows, texts, piece, starts, ends, bounds, levels = [], [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                cuts = cut_text(t, size, overlap, splitter)
                level = LEVELS[min(s for _, _, s in cuts)]
                for n, (a, b, s) in enumerate(cuts):
                    rows.append(row)
                    texts.append(t[a:b])
                    piece.append(n)
                    starts.append(a)
                    ends.append(b)
                    bounds.append(LEVELS[s])
                    levels.append(level)
            took = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), pa.array(texts, pa.string()), batch.column(2).take(took), pa.array(piece, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(bounds, pa.string()), pa.array(levels, pa.string())],
                names=["key", "text", "kept", "piece", "start_char", "end_char", "boundary", "level"],
            )

    out = source.mapInArrow(pieces, schema)
    return out.select(F.col("key").alias(key), *([F.col("kept")[c].alias(c) for c in keep]), "piece", "start_char", "end_char", "boundary", "level", F.col("text").alias(text))
