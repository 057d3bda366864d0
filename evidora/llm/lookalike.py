"""One form for text that looks the same (problem 4).

Look-alike pairs of code points and strings (Unicode decompositions, the
published confusables table) are closed transitively by
union-find; each class is represented by its most frequent member in the
corpus; texts are rewritten greedily, code points by a table and longer
strings by a multi-pattern automaton (leftmost, longest first).
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators.contain import containing

# Letters of other scripts that are drawn like Latin ones, in
# order, and below them signs that are drawn alike. More letters come from the
# table that ICU carries.
ALIKE = (
    ("АВЕКМНОРСТУХЅІЈԚԜҮ", "ABEKMHOPCTYXSIJQWY"),
    ("аеорсухѕіјһԛԝ", "aeopcyxsijhqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("ονρ", "ovp"),
    ("‐‑−⁃", "----"),
    ("’‘ʼ", "'''"),
)
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
DRAWN_ALIKE = ("wide", "narrow", "font", "noBreak", "compat")
NOT_ALIKE = "ſ"


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b, key=lambda s: (len(s), s))] = min(a, b, key=lambda s: (len(s), s))

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def alike_pairs(chars: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Look-alike pairs that concern the given code points: compatibility forms
    that are drawn alike, canonical compositions, spaces, and :data:`ALIKE`."""
    for odd, plain in ALIKE:
        yield from zip(odd, plain)
    for c in chars:
        if c in NOT_ALIKE:
            continue
        parts = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs" and c != " ":
            yield c, " "
        elif parts.startswith("<"):
            tag, _, codes = parts[1:].partition("> ")
            if tag in DRAWN_ALIKE:
                plain = "".join(chr(int(x, 16)) for x in codes.split())
                if not plain.isspace() and plain[0] != " ":
                    yield c, plain
        elif parts:
            yield c, unicodedata.normalize("NFD", c)
            single = parts.split()
            if len(single) == 1:
                yield c, chr(int(single[0], 16))


def _drawn(c: str) -> str | None:
    """The case of a letter whose shape is compared: that of cased letters, and
    upper for Lisu, whose letters are drawn as Latin capitals."""
    kind = unicodedata.category(c)
    return kind if kind in ("Lu", "Ll") else "Lu" if "ꓐ" <= c <= "ꓽ" and kind == "Lo" else None


def published_pairs(chars: Iterable[str], shapes: dict[str, str]) -> Iterator[tuple[str, str]]:
    """Look-alike pairs after a published table of shapes (letter -> its
    prototype, one or several characters): letters of one case that have the
    same shape, ASCII ones first, and a letter with the string that is its
    shape where that is a letter under an overlaid sign. Two ASCII letters are
    never a pair: l and I stay apart."""
    plain: dict[tuple[str, str], list[str]] = {}
    for a in map(chr, range(128)):
        if a.isalpha():
            plain.setdefault((shapes.get(a, a), _drawn(a)), []).append(a)
    first: dict[tuple[str, str], str] = {}
    for c in sorted(chars):
        case = _drawn(c)
        if c < "\x80" or case is None or c in NOT_ALIKE:
            continue
        shape = shapes.get(c, c)
        letters = plain.get((shape, case), ())
        if len(letters) == 1 and letters[0] != c:
            yield c, letters[0]
        elif not letters and len(shape) == 1 and (other := first.setdefault((shape, case), c)) != c:
            yield c, other
        elif len(shape) == 2 and shape != unicodedata.normalize("NFD", c) and unicodedata.category(shape[1]) == "Mn":
            yield c, shape


def shapes_of(spark: SparkSession, chars: Iterable[str]) -> dict[str, str]:
    """Prototypes of letters in the confusables table of the Unicode security
    mechanisms, which the JVM's ICU library carries; empty where it doesn't."""
    letters = sorted({c for c in chars if _drawn(c)} | {chr(k) for k in range(128) if chr(k).isalpha()})
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (AttributeError, TypeError):
        return {}
    out: dict[str, str] = {}
    for k in range(0, len(letters), 4096):
        part = letters[k : k + 4096]
        found = checker.getSkeleton("\n".join(part)).split("\n")
        out |= dict(zip(part, found)) if len(found) == len(part) else {c: checker.getSkeleton(c) for c in part}
    return out


def char_counts(texts: DataFrame, *columns: str) -> DataFrame:
    """How often each code point occurs in the columns: rows (s, n), counted per
    partition first; there are at most as many rows as code points."""
    schema = pa.schema([("s", pa.string()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                whole = "\n".join(t for t in column.to_pylist() if t)
                if whole:
                    seen = np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
                    points[: len(seen)] += seen
        found = np.flatnonzero(points)
        found = found[(found < 0xD800) | (found > 0xDFFF)]
        yield pa.RecordBatch.from_arrays([pa.array([chr(k) for k in found], pa.string()), pa.array(points[found])], schema=schema)

    return texts.select(*columns).mapInArrow(count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))


def rewriting(counts: dict[str, int], shapes: dict[str, str] | None = None) -> tuple[dict[int, str], dict[str, str]]:
    """The rewriting that the counts lead to: code point -> representative, and
    string -> representative. Of a class, the most frequent member represents
    it (ties: the shortest, then the first in code point order); a string
    counts as often as its rarest letter. Invisible characters are represented
    by nothing."""
    sets = Classes()
    for x, y in itertools.chain(alike_pairs(counts), published_pairs(counts, shapes or {})):
        sets.union(x, y)

    def often(s: str) -> int:
        if len(s) == 1:
            return counts.get(s, 0)
        if unicodedata.combining(s[-1]):
            return 0
        return min(counts.get(c, 0) for c in s)

    points: dict[int, str] = {ord(c): "" for c in INVISIBLE}
    strings: dict[str, str] = {}
    for members in sets.classes().values():
        best = max(members, key=lambda s: (often(s), -len(s), tuple(-ord(c) for c in s)))
        for s in members:
            if s != best:
                if len(s) == 1:
                    points[ord(s)] = best
                elif unicodedata.combining(s[-1]):
                    strings[s] = best
    # Representatives are themselves rewritten until nothing changes.
    for k, s in points.items():
        for _ in range(4):
            s = s.translate({a: b for a, b in points.items() if chr(a) in s and a != k})
        points[k] = s
    return points, strings


class Rewriter:
    def __init__(self, points: dict[int, str], strings: dict[str, str]):
        self.points, self.strings = points, strings
        self.automaton = None
        if strings:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for s, to in strings.items():
                self.automaton.add_word(s.translate(points), (len(s.translate(points)), to.translate(points)))
            self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        text = text.translate(self.points)
        if text.isascii():
            return text
        composed = unicodedata.normalize("NFC", text)
        if self.automaton is None or not any("̀" <= c <= "ͯ" for c in text):
            return composed
        out, at = [], 0
        for end, (length, to) in self.automaton.iter_long(text):
            out += text[at : end - length + 1], to
            at = end + 1
        return unicodedata.normalize("NFC", "".join([*out, text[at:]]))


class Unifier:
    """The corpus's rewriting as a Column function."""

    def __init__(self, counts: dict[str, int], shapes: dict[str, str] | None = None):
        self.points, self.strings = rewriting(counts, shapes)
        self.ascii_stays = not any(k < 128 for k in self.points)

    @classmethod
    def of(cls, *parts: DataFrame) -> Unifier:
        """From all texts of one-column frames. What is collected is bounded by
        the number of code points."""
        counted = None
        for part in parts:
            one = char_counts(part, part.columns[0])
            counted = one if counted is None else counted.unionByName(one)
        total: Counter = Counter()
        for row in counted.toLocalIterator():
            total[row["s"]] += row["n"]
        return cls(total, shapes_of(parts[0].sparkSession, total))

    def column(self, text: Column, sparse: bool = False) -> Column:
        """``text`` in its one form; null stays null. Rows that the rewriting
        can't change stay in the JVM; ``sparse`` gives null for them."""
        points, strings = self.points, self.strings

        @F.arrow_udf("string")
        def rewrite(column: pa.Array) -> pa.Array:
            own = Rewriter(points, strings)
            return pa.array([None if t is None else own(t) for t in column.to_pylist()], pa.string())

        if not self.ascii_stays:
            return rewrite(text)
        changed = rewrite(F.when(text.rlike(r"[^\x00-\x7F]"), text))
        return changed if sparse else F.coalesce(changed, text)


def quote_matches(quotes: DataFrame, passages: DataFrame, unifier: Unifier, hot: int = 256) -> DataFrame:
    """For every distinct (doc_id, quote): ``verbatim``, whether some passage of
    that document contains it as it stands, and ``unified``, whether one does
    in the one form.

    Matched by :func:`evidora.operators.contain.containing`: on doc_id, in
    documents beyond ``hot`` passages by fingerprints. Quotes that are null,
    empty or nothing but invisible characters match nothing; a document without
    passages gives false for both. Repeated rows count once.
    """
    q = quotes.where(F.col("doc_id").isNotNull() & (F.col("quote") != "")).select("doc_id", "quote").distinct()
    q = q.withColumn("form", unifier.column(F.col("quote"), sparse=True)).where(F.trim(F.coalesce("form", "quote")) != "")
    q = q.withColumn("q_id", F.xxhash64("doc_id", "quote"))
    p = passages.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    p = p.select("doc_id", F.xxhash64("doc_id", "text").alias("p_id"), F.col("text").alias("body"), unifier.column(F.col("text"), sparse=True).alias("form"))
    found = containing(q.select("q_id", "doc_id", F.col("quote").alias("body"), "form"), p, hot)
    hits = found.groupBy("q_id").agg(F.bool_or("same").alias("verbatim"))
    return q.join(hits, "q_id", "left").select("doc_id", "quote", F.coalesce("verbatim", F.lit(False)).alias("verbatim"), F.col("verbatim").isNotNull().alias("unified"))


def citations(ledger: DataFrame) -> DataFrame:
    """Distinct (claim_id, cit_no, doc_id, quote) of a ledger; ``cit_no`` counts from 0."""
    each = ledger.select("claim_id", F.posexplode("citations").alias("cit_no", "c"))
    return each.select("claim_id", "cit_no", F.col("c.doc_id").alias("doc_id"), F.col("c.quote").alias("quote")).distinct()
