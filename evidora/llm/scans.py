"""Repair of text from scanned pages (problem 1).

Running headers and page numbers are taken out of the line structure, by their
look and by recurring over the texts of a document; what is left is one stream of characters, which is read along the cheapest path under the
corpus's word counts, hyphenated breaks, missing and stray spaces and confused
characters being edges with a price; paragraph boundaries are chosen by dynamic programming over lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.session import cut

# What a scanner reads (left) and what may stand there (right).
# SIGNS never belong inside a word, LETTERS may.
SIGNS = {"€": "ec", "¢": "ce", "@": "ao", "|": "li", "!": "il", "ſ": "fs", "$": "s", "0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "£": "e", "¦": "li"}
LETTERS = {"c": "e", "f": "t", "b": "h", "e": "c", "t": "f", "h": "b", "l": "i", "i": "l", "I": "l", "cl": "d", "vv": "w", "ii": "u", "rn": "m", "m": ("in", "rn", "ni"), "ri": "n", "li": "h", "d": ("cl",), "0": "O", "1": "I"}
# Characters that SIGNS and LETTERS connect have one spelling in atoms, so a
# damaged word and what it stands for are spelled alike, also in parts.
ATOMS = str.maketrans(
    {c: "i" for c in "ilr|!1¦"} | {c: "e" for c in "ec€¢3£"} | {c: "o" for c in "ao@04"} | {c: "f" for c in "fts$57ſ"} | {c: "ii" for c in "bhnu68"} | {"m": "iii", "d": "ei", "w": "vv", "9": "g"}
)
BREAK_MARKS = "-‐‑¬­"

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_EDGE = "\"'“”‘’«»()[]{}.,;:!?…"
_NOT_LATIN = re.compile(r"[^\x20-\x7e -ɏ€ſ‐‑–—’‘“”…]")
_BREAK = re.compile(r"[-‐‑¬­](?:[ \t]*\r?\n\s*|[ \t]+)(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def breaks(text: str) -> Iterator[tuple[int, int, str, str, str, bool]]:
    """Words broken by a hyphen and white space: (start, end, left part, mark,
    right part, whether at a line's end)."""
    for m in _BREAK.finditer(text):
        a = m.start()
        while a and text[a - 1].isalpha():
            a -= 1
        if a < m.start():
            right = _LETTERS.match(text, m.end())[0]
            yield a, m.end() + len(right), text[a : m.start()], m[0][0], right, "\n" in m[0]


_PAGE = r"(?:[-—–] ?\d{1,4} ?[-—–]|(?:Page|Seite|Pagina|Página|Sida|S\.) \d{1,4}(?: (?:of|von|de|sur) \d{1,4})?|\[\d{1,4}\]|\d{1,4} ?/ ?\d{1,4}|pp?\. ?\d{1,4})"
_CAPS = r"[A-Z][A-Z'’.,&·:;()\-]{0,40}(?:[ ]{1,3}[A-Z0-9][A-Z0-9'’.,&·:;()\-]{0,40}){1,30}"
_TITLED = r"[A-Z]\w{1,30}(?:[ ](?:[a-z]{1,3}|[A-Z]\w{1,30})){0,7}"
_HEAD = rf"(?:{_TITLED},? vol\. \d+|{_TITLED}[ ]{{1,3}}\d+ ?\(\d+\)|[A-Z][A-Z'’\-]{{2,}}(?: [A-Z'’\-]+)* · [^\n]{{2,60}}|{_CAPS}|[A-Z]\w+(?:[-'’]\w+)* et al\.)"
_BOTH = rf"(?:(?P<page>\d{{1,4}}|{_PAGE})(?P<ph>(?:[ ]{{2,}}|[ ]*\|[ ]*)(?:{_HEAD}|[A-Z][^\n]{{3,60}}))?|(?P<head>{_HEAD})(?P<hp>(?:[ ]{{2,}}|[ ]*\|[ ]*)(?:\d{{1,4}}|{_PAGE}))?)"
_LINE = re.compile(rf"^[ \t]*{_BOTH}[ \t]*$")
_INLINE_PAGE = re.compile(rf"(?<=[\s]){_PAGE}(?=\s|$)|^{_PAGE}(?=\s)")
_INLINE_HEAD = re.compile(rf"(?<![\w(]){_TITLED},? vol\. \d+(?=\s|$)|(?<![\w(]){_TITLED}[ ]{{1,3}}\d+\(\d+\)(?=\s|$)|(?<!\w)[A-Z][A-Z'’\-]{{3,}} · \S+(?: \S+){{0,5}}|(?<![\w.])[A-Z]{{2,30}}[:,'’\-]?[A-Z'’\-]{{0,20}}:?(?: [A-Z][A-Z'’\-]{{0,30}}[:,]?){{2,12}}(?![a-z])|(?<!\w)[A-Z]\w{{2,30}}(?:-[A-Z]\w{{1,30}})? et al\.(?=\s)|(?<!\w)(?:[A-Z] ){{2,}}[A-Z](?:   (?:[A-Z] )*[A-Z])*(?!\w)")
_PAGE_WORDS = ("/", "[", "p.", "Page ", "Seite ", "Pagina ", "Página ", "Sida ", "S. ")
_PAGE_DASH = re.compile(r"[-—–] ?\d")
_CAPITALS, _ISSUE = re.compile(r" (?<=[A-Z] ) {0,2}[A-Z]"), re.compile(r"\d ?\(\d")
_NUMBER_BEHIND, _NUMBER_AHEAD = re.compile(r"(?: {2,}| ?\| ?)\d{1,4}(?=\s|$)"), re.compile(r"(?:(?<=\s)|^)\d{1,4}(?: {2,}| ?\| ?)$")
_SEE = re.compile(r"(?:\b(?:see|cf|on|vgl|siehe|auf|at|and|to|from|of|by|in)\.?|[(,;])\s*$", re.I)


def _whole_title(text: str, at: int, found: str) -> int:
    """Where a title begins of which the pattern took the last eight words."""
    if len(found.split(" vol. ")[0].split()) < 8 or " vol. " not in found:
        return at
    while m := re.search(r"(?<![\w(])(?:[A-Z]\w+|[A-Z]\w+ [a-z]{1,3}) $", text[max(0, at - 60) : at]):
        at -= len(m[0])
    return at


def line_mark(line: str) -> str:
    """A line as it recurs over the pages: digits alike, single spaces; empty
    for what reads as text (a lower-case beginning, the end of a sentence)."""
    s = line.strip()
    if len(s) < 4 or s[-1] in ".,;:?!" or s[0].islower() or not any(c.isalpha() for c in s):
        return ""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", s))


def furniture(text: str, recurring: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Running headers and page numbers of a text as (start, end, kind), kind
    header, page_number, or both for a line that has both: lines and stretches
    with the look of one, and lines that recur over the document's texts."""
    again = _recurring(text, recurring) if recurring and "\n" in text else []
    out = _furniture(text)
    if out:
        letters = [*filter(str.isalpha, text)]
        if sum(map(str.isupper, letters)) > 0.5 * len(letters):
            out = []
    return out + [x for x in again if not any(a < x[1] and x[0] < b for a, b, _ in out)]


def _recurring(text: str, recurring: frozenset[str]) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        if line_mark(line) in recurring:
            out.append((at, at + len(line), "header"))
        at += len(line) + 1
    return out


def _furniture(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    lines = []
    at = 0
    for line in text.split("\n"):
        lines.append((at, at + len(line), line))
        at += len(line) + 1
    if len(lines) > 1:
        for k, (a, b, line) in enumerate(lines):
            s = line.strip()
            if not s or len(s) > 90 or s[-1] in ",;:?!" or s[0].islower() and s[0] != "p" or not (m := _LINE.match(line.rstrip("\r"))):
                continue
            before = next((x[2].strip() for x in reversed(lines[:k]) if x[2].strip()), "")
            after = next((x[2].strip() for x in lines[k + 1 :] if x[2].strip()), "")
            if m["page"]:
                out.append((a, b, "both" if m["ph"] else "page_number"))
            elif m["hp"]:
                out.append((a, b, "both"))
            elif s.endswith("et al.") and (before[-3:].lower().endswith(" by") or before.endswith(("by", "of", "and", "from", "with"))):
                continue
            elif before or after:
                out.append((a, b, "header"))
        if out:
            return out
    for m in _INLINE_PAGE.finditer(text) if any(w in text for w in _PAGE_WORDS) or ("-" in text or "—" in text or "–" in text) and _PAGE_DASH.search(text) else ():
        before = text[: m.start()]
        if m[0][0] in "pPS" and m[0][1:2] in ".p" and _SEE.search(before[-12:]):
            continue
        if "/" in m[0] and _SEE.search(before[-12:]) and not text[m.end() : m.end() + 3] == "   ":
            continue
        out.append((m.start(), m.end(), "page_number"))
    for m in _INLINE_HEAD.finditer(text) if "·" in text or " vol. " in text or " et al." in text or _CAPITALS.search(text) or "(" in text and _ISSUE.search(text) else ():
        if m[0].isupper() and len(m[0]) > 90:
            continue
        if m[0].endswith("et al.") and (not (before := text[: m.start()].split()[-1:]) or before[0].rstrip(",").lower() in ("by", "and", "of", "from", "with", "in", "see", "cf.", "to", "as") or before[0][-1] in ".(;:"):
            continue
        if " vol. " in m[0] and text[: m.start()].rstrip().endswith(("in", "see", "cf.")):
            continue
        out.append((_whole_title(text, m.start(), m[0]), m.end(), "header"))
        for beside in (_NUMBER_BEHIND.match(text, m.end()), _NUMBER_AHEAD.search(text, max(0, m.start() - 12), m.start())):
            if beside and not any(a <= beside.start() < b or a < beside.end() <= b for a, b, k in out if k == "page_number"):
                out.append((beside.start(), beside.end(), "page_number"))
    return out


def recurring_lines(passages: DataFrame, key: str, doc: str, text: str = "text", least: int = 3) -> DataFrame:
    """(doc, lines): the marks of lines that stand in at least ``least`` texts of
    a document that have several lines. Counted per task first; repeated rows
    count once."""
    schema = pa.schema([("at", pa.int32()), ("line", pa.string())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines = [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                marks = {m for line in t.split("\n") if (m := line_mark(line))}
                at += [row] * len(marks)
                lines += marks
            took = pa.array(at, schema.field("at").type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(lines, pa.string())], names=["doc", "key", "line"])

    several = passages.where(F.col(doc).isNotNull() & F.col(text).contains("\n")).select(F.col(doc).alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in several.schema}
    each = several.mapInArrow(work, f"doc {kinds['doc']}, key {kinds['key']}, line string")
    return each.groupBy("doc", "line").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= least).groupBy("doc").agg(F.collect_list("line").alias("lines"))


def corpus_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word is written, counted per task first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for token, n in total.items():
                w = token.strip(_EDGE)
                if w:
                    words[w] += n
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=schema)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total.update(t.split())
            if len(total) > 400_000:
                yield out()
        yield out()

    return texts.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, text: str = "text", share: float = 1e-6, least: int = 3) -> tuple[dict[str, int], int, int]:
    """(word -> count, the count from which words are held, all words): the
    words with at least ``share`` of all written words, hence at most
    ``1/share`` of them, and at least ``least``. Rarer words are unknown."""
    counted = cut(corpus_words(texts, text))
    total = counted.agg(F.sum("n")).first()[0] or 0
    floor = max(least, math.ceil(share * total))
    return {r["word"]: r["n"] for r in counted.where(F.col("n") >= floor).toLocalIterator()}, floor, total


class Beginnings(dict):
    """Atoms -> 0 if no spelling begins with them, 1 if they are only a
    spelling themselves, 2 if a longer one begins with them. Cached."""

    HEAD = 6  # how much of a spelling is looked up before the sorted list is searched

    def __init__(self, spellings: list[str]):
        super().__init__()
        self.spellings = spellings
        self.heads = {w[:k] for w in spellings for k in range(1, min(len(w), self.HEAD) + 1)}

    def __missing__(self, atoms: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = 0
        if atoms[: self.HEAD] in self.heads:
            i = bisect_left(self.spellings, atoms)
            if i < len(self.spellings) and self.spellings[i] == atoms:
                found, i = 1, i + 1
            if i < len(self.spellings) and self.spellings[i].startswith(atoms):
                found = 2
        self[atoms] = found
        return found


class Decoder:
    """Joint decoding of words under a lexicon."""

    UNKNOWN, PER_CHAR = 9.0, 2.1
    JOIN, SPLIT, MERGE, SIGN, LETTER = 0.5, 7.0, 5.0, 4.0, 4.5

    def __init__(self, known: dict[str, int], floor: int = 3, total: int = 1):
        self.known, self.floor, self.total = known, floor, max(total, 2)
        self.seen: dict[str, str | None] = {}
        self.fine: set[str] = set()
        self.log = math.log(self.total)
        self.spelled: dict[str, list[str]] = {}
        for word in known:
            self.spelled.setdefault(word.lower().translate(ATOMS), []).append(word)
        self.spellings = sorted(self.spelled)
        self.cheapest = {atoms: self.log - math.log(max(map(known.__getitem__, words))) for atoms, words in self.spelled.items()}
        self.begun = Beginnings(self.spellings)
        self.longest = 3 * max(map(len, known), default=0)
        self.shut: dict[str, set[str]] = {}
        self.n_shut = 0
        self.ajar: set[tuple[str, str]] = set()
        self.closed: set[str] = set()  # what no word reaches on from, whatever follows
        self.read: dict[str, list[tuple[str, float, bool]]] = {}
        self.runs: dict[tuple[str, ...], tuple] = {}
        self.alone: dict[str, list[tuple[str, bool]] | None] = {}
        self.parts: dict[str, tuple[str, str, bool, tuple[int, ...]]] = {}
        self.atoms: dict[str, str] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word, 0)
        if not n and word[:1].isupper():
            n = self.known.get(word[0].lower() + word[1:], 0)
        return n

    def cost(self, word: str) -> float:
        n = self.count(word)
        return self.log - math.log(n) if n else max(self.log - math.log(self.floor), self.UNKNOWN) + self.PER_CHAR * len(word)

    def undone(self, chars: str, word: str) -> tuple[float, bool]:
        """What it costs to read characters as a word, by the confusions to
        undo, and whether a sign was among them; infinite if it can't be."""
        if chars == word:
            return 0.0, False
        row: dict[int, tuple[float, bool]] = {0: (0.0, False)}
        rows = [row] + [{} for _ in chars]
        for i, c in enumerate(chars):
            for j, (paid, sign) in rows[i].items():
                steps = [(i + 1, c, 0.0, False)] + [(i + 1, x, self.SIGN, True) for x in SIGNS.get(c, ())]
                for size in (1, 2):
                    steps += [(i + size, x, self.LETTER, False) for x in LETTERS.get(chars[i : i + size], ()) if i + size <= len(chars)]
                for to, x, price, by_sign in steps:
                    if word.startswith(x, j) and (new := (paid + price, sign or by_sign)) < rows[to].get(j + len(x), (math.inf, False)):
                        rows[to][j + len(x)] = new
        return rows[-1].get(len(word), (math.inf, False))

    def readings(self, chars: str) -> list[tuple[str, float, bool]]:
        """Known words that characters without a gap may stand for: (word, cost
        of the confusions undone, whether a sign was among them). Cached."""
        if chars not in self.read:
            if len(self.read) > 300_000:
                self.read.clear()
            self.read[chars] = list(self._readings(chars))
        return self.read[chars]

    def _readings(self, chars: str) -> Iterator[tuple[str, float, bool]]:
        capital = chars[:1].isupper()
        for word in self.spelled.get(chars.lower().translate(ATOMS), ()):
            forms = {word, word[0].upper() + word[1:]} if capital else {word}
            for w in forms:
                paid, sign = self.undone(chars, w)
                if 0 < paid < math.inf:
                    yield w, paid, sign

    def reading(self, token: str) -> str | None:
        """The word that a token with confused characters stands for; None if
        it is best read as it is. Cached by token."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[token] = found = self._reading(token)
        return found

    def _reading(self, token: str) -> str | None:
        if len(token) > self.longest + 20 or _NOT_LATIN.search(token):
            return None
        core = token.strip("\"'“”‘’«»()[]{}.,;:?…").rstrip("!")
        if core[-1:] in BREAK_MARKS or core[:1] in BREAK_MARKS:
            return None
        if len(core) < 3 or not any(c.isalpha() for c in core) or core.isupper():
            return None
        if self.count(core):
            n = self.count(core)
        else:
            n = 0
        signs = any(c in SIGNS for c in core)
        if signs and (sum(c.isdigit() for c in core) > 2 or any(c in "./_+" for c in core)):
            return None
        if not signs and (n > 40 * self.floor or any(c.isdigit() for c in core)):
            return None
        parts = core.split("-")
        if len(parts) > 1:
            read = [self._reading(p) or p for p in parts if p]
            new = "-".join(read)
            return token.replace(core, new) if new != core else None
        best, least, by_sign = None, math.inf, False
        for w, c, sign in self.readings(core):
            k = self.count(w)
            if k and (total := c + self.log - math.log(k)) < least:
                best, least, by_sign = w, total, sign
        if best is None:
            return None
        as_is = self.cost(core) if signs else self.log - math.log(max(n, self.floor))
        if by_sign or least < as_is:
            if not by_sign and (len(core) < 4 or self.count(best) < 8 * max(n, self.floor)):
                return None
            return token.replace(core, best)
        return None

    def settled(self, core: str) -> bool:
        """Whether a token is so frequent that neither its split nor another
        reading can be cheaper."""
        return self.count(core) > 40 * self.floor

    def core(self, token: str) -> str:
        """The letters (and signs) of a token that may be decoded, or nothing:
        no longer than three of the longest known words."""
        core = token.strip(_EDGE)
        if not core or len(core) > self.longest or len(core) > 1 and core.isupper() or not core.isascii() and _NOT_LATIN.search(core):
            return ""
        if core.isalpha():
            return core
        plain = all(c.isalpha() or c in SIGNS for c in core) and any(c.isalpha() for c in core)
        return core if plain and sum(c.isdigit() for c in core) <= 2 else ""

    def part(self, token: str) -> tuple[str, str, bool, tuple[int, ...]]:
        """The core of a token, its atoms, whether it is settled, and the places
        from which its rest begins a longer spelling (of a settled one only the
        first place counts). Cached."""
        found = self.parts.get(token)
        if found is None:
            if len(self.parts) > 300_000:
                self.parts.clear()
            core = self.core(token)
            x, firm = core.lower().translate(ATOMS), bool(core) and self.settled(core)
            self.parts[token] = found = (core, x, firm, tuple(k for k in ((0,) if firm else range(len(x))) if self.begun[x[k:]] == 2))
        return found

    def open(self, left: str, right: str) -> bool:
        """Whether some word may reach over the gap between two tokens. Cached."""
        if left in self.closed:
            return False
        held = self.shut.get(left)
        if held is not None and right in held:
            return False
        pair = (left, right)
        if pair in self.ajar:
            return True
        a, _, _, places = self.part(left)
        if not places or not left.endswith(a):
            if len(self.closed) > 300_000:
                self.closed.clear()
            self.closed.add(left)
            return False
        b = self.part(right)[0]
        if not b or not right.startswith(b):
            found = False
        else:  # the marks around the two don't matter
            found = self._open(a, b) if (a, b) == pair else self.open(a, b)
        if found:
            if len(self.ajar) > 700_000:
                self.ajar.clear()
            self.ajar.add(pair)
            return True
        self.n_shut += 1
        if self.n_shut > 700_000:
            self.shut.clear()
            self.n_shut = 1
        self.shut.setdefault(left, set()).add(right)
        return False

    def _open(self, left: str, right: str) -> bool:
        a, x, _, places = self.part(left)
        b, y, last, _ = self.part(right)
        both, at, whole = x + y, len(x), len(x) + len(y)
        begun, apart = self.begun, None
        for k in places:
            if not begun[both[k : at + 1]]:
                continue
            if begun[both[k:]] == 2:
                return True
            if apart is None:
                apart = self.cost(a) + self.cost(b)
            least = self.MERGE + (self.SPLIT if k else 0.0)
            if not last and any((c := self.cheapest.get(both[k:e])) is not None and least + self.SPLIT + c < apart for e in range(at + 1, whole)):
                return True
            if both[k:] in self.spelled and (least + self.cheapest[both[k:]] < apart if k else self._pays(a, b)):
                return True
        return False

    def _pays(self, a: str, b: str) -> bool:
        """Whether a word is cheaper than the two that it is written as, and
        frequent enough beside the rarer of them."""
        apart, rare = self.cost(a) + self.cost(b), max(self.floor, min(self.count(a), self.count(b)))
        words = [*self.readings(a + b), (a + b, 0.0, False)]
        return any((n := self.count(w)) >= 8 * rare and self.MERGE + paid + self.log - math.log(n) < apart for w, paid, _ in words)

    def path(self, tokens: list[str], hyphens: dict[int, tuple[str, bool]]) -> tuple[str, list[tuple[int | None, str, bool, bool]], str]:
        """The cheapest way to read tokens whose gaps are open: the marks before,
        the words as (token at which it begins if at a gap, text, whether a
        confusion was undone, whether a hyphen was read over), the marks after.
        ``hyphens`` has the mark behind token k and whether a line ends there."""
        cores = [t[:-1] if k in hyphens else t for k, t in enumerate(tokens)]
        lead = cores[0][: len(cores[0]) - len(cores[0].lstrip(_EDGE))]
        tail = cores[-1][len(cores[-1].rstrip(_EDGE)) :]
        cores[0] = cores[0][len(lead) :]
        cores[-1] = cores[-1][: len(cores[-1]) - len(tail)]
        chars = "".join(cores)
        starts, at = [], 0
        for c in cores:
            starts.append(at)
            at += len(c)
        n, ends = at, [*starts[1:], at]
        inside = [0] * n
        for k, (a, b) in enumerate(zip(starts, ends)):
            inside[a:b] = [k] * (b - a)
        seen = [self.count(c) for c in cores]
        firm = [self.settled(c) for c in cores]
        best: list[tuple] = [(0.0,)] + [(math.inf,)] * n
        boundary = {*starts, n}
        spelt = [self.atoms.get(c) or self.atoms.setdefault(c, c.lower().translate(ATOMS)) for c in chars]
        begun, spelled = self.begun, self.spelled

        def gap(k: int) -> float:
            return self.MERGE if k not in hyphens else self.JOIN + (0.0 if hyphens[k][1] else 2.0)

        def put(i: int, j: int, price: float, text: str, confused: bool, joined: bool) -> None:
            price += best[i][0] + (self.SPLIT if i not in boundary else 0.0)
            if price < best[j][0]:
                best[j] = (price, i, text, confused, joined)

        for i in range(n):
            if best[i][0] == math.inf:
                continue
            k = inside[i]
            if i == starts[k]:
                own = self.cost(cores[k])
                if k not in hyphens:
                    put(i, ends[k], own, cores[k], False, False)
                else:
                    mark, at_line = hyphens[k]
                    hanging = self.count(cores[k] + "-")
                    if mark in "-‐‑":
                        put(i, ends[k], own + 1.0, cores[k] + "-", False, False)
                        if hanging:
                            put(i, ends[k], self.log - math.log(hanging), cores[k], False, False)
                        if k + 1 < len(cores) and (whole := self.count(f"{cores[k]}-{cores[k + 1]}")):
                            put(i, ends[k + 1], self.log - math.log(whole), f"{cores[k]}-{cores[k + 1]}", False, False)
                    else:
                        put(i, ends[k], own + 6.0, cores[k], False, False)
                    if k + 1 < len(cores):
                        word = cores[k] + cores[k + 1]
                        put(i, ends[k + 1], self.cost(word) + gap(k), word, False, True)
            elif firm[k]:
                continue
            if i != starts[k] and chars[i].isupper() and chars[i - 1].islower() or i == starts[k] and not firm[k]:
                for j in range(i + 1, ends[k]):  # an unknown word runs into another where a capital shows it
                    if chars[j].isupper() and chars[j - 1].islower():
                        put(i, j, self.cost(chars[i:j]), chars[i:j], False, False)
                if i != starts[k]:
                    put(i, ends[k], self.cost(chars[i : ends[k]]), chars[i : ends[k]], False, False)
            atoms, first = "", chars[i].isupper()
            for j in range(i + 1, n + 1):
                atoms += spelt[j - 1]
                if not begun[atoms]:
                    break
                if atoms not in spelled:
                    continue
                e = inside[j - 1]
                if j != ends[e] and firm[e] or (i == starts[k] and j == ends[k] and firm[k]):
                    continue
                piece = chars[i:j]
                over = [x for x in range(k, e)]
                cut = (i != starts[k], j != ends[e])
                for w, paid, sign in [*([(piece, 0.0, False)] if self.count(piece) else ()), *self.readings(piece)]:
                    if first != w[0].isupper() and paid == 0:
                        continue
                    count = self.count(w)
                    rare = max([self.floor, *(seen[x] for x, y in ((k, cut[0]), (e, cut[1])) if y)])
                    if any(x not in hyphens for x in over):
                        rare = max(rare, min(seen[k : e + 1]))
                    if (any(cut) or any(x not in hyphens for x in over)) and count < 8 * rare or any(cut) and len(w) == 1 and w not in "aI":
                        continue
                    if paid:
                        written = self.count(piece)
                        if not sign and (len(piece) < 4 or count < 8 * max(written, self.floor) or written > 40 * self.floor):
                            continue
                        if not over and not any(cut):
                            if self.reading(piece) != w:
                                continue
                            paid = min(paid, self.cost(piece) - self.log + math.log(count) - 1e-6)
                    put(i, j, paid + self.log - math.log(count) + sum(gap(x) for x in over), w, paid > 0, any(x in hyphens for x in over))
        out, j = [], n
        while j:
            _, i, text, confused, joined = best[j]
            out.append((starts.index(i) if i in boundary else None, text, confused, joined))
            j = i
        out.reverse()
        return lead, out, tail

    def run(self, tokens: tuple[str, ...]) -> tuple[str, list[tuple[int | None, str, bool, bool]], str]:
        """The path of tokens without hyphens, cached without the marks before
        and after them."""
        if tokens in self.runs:
            return self.runs[tokens]
        first, last = tokens[0].lstrip(_EDGE), tokens[-1].rstrip(_EDGE)
        if len(tokens) > 1 and first and last and (first, last) != (tokens[0], tokens[-1]):
            _, out, _ = self.run((first, *tokens[1:-1], last))
            return tokens[0][: len(tokens[0]) - len(first)], out, tokens[-1][len(last) :]
        if len(self.runs) > 200_000:
            self.runs.clear()
        self.runs[tokens] = found = self.path(list(tokens), {})
        return found

    def single(self, token: str) -> tuple[str, bool] | None:
        """A token between shut gaps as it is read, and whether a confusion was
        undone; None if it is best read as it is. Cached by token."""
        if token in self.fine:
            return None
        if token in self.alone:
            return self.alone[token]
        if len(self.alone) > 300_000:
            self.alone.clear()
        found, core = None, self.core(token)
        if core and len(core) > 3 and not self.settled(core):
            at = token.index(core)
            _, pieces, _ = self.run((core,))
            new = token[:at] + " ".join(text for _, text, *_ in pieces) + token[at + len(core) :]
            found = (new, any(p[2] for p in pieces)) if new != token else None
        elif word := self.reading(token):
            found = (word, True)
        if found:
            self.alone[token] = found
        else:
            if len(self.fine) > 300_000:
                self.fine.clear()
            self.fine.add(token)
        return found

    def gaps_shut(self, words: list[str]) -> bool:
        """Whether no word reaches over a gap of these tokens."""
        shut, ajar, closed = self.shut, self.ajar, self.closed
        reached = [k for k, pair in enumerate(zip(words, words[1:])) if pair[0] not in closed and pair[1] not in shut.get(pair[0], ()) and (pair in ajar or self.open(*pair))]
        if not reached:
            return True
        first = last = -1
        for k in reached:
            if k != last:
                if first >= 0 and not self.same(tuple(words[first : last + 1])):
                    return False
                first = k
            last = k + 1
        return self.same(tuple(words[first : last + 1]))

    def same(self, tokens: tuple[str, ...]) -> bool:
        """Whether tokens are best read as they are."""
        lead, pieces, tail = self.run(tokens)
        return len(pieces) == len(tokens) and lead + " ".join(p[1] for p in pieces) + tail == " ".join(tokens)

    def segment(self, chars: str, gaps: list[float]) -> list[str]:
        """Words of a stretch of characters, by dynamic programming: ``gaps[i]``
        is what it costs to read over the white space or break before
        character i inside a word; where there is none, a new word costs
        ``SPLIT``."""
        n = len(chars)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        reach = self.longest // 3
        fresh = max(self.log - math.log(self.floor), self.UNKNOWN)
        unknown, since = math.inf, 0  # an unknown word that is still open: its price, where it began

        def begin(i: int) -> float:
            return best[i] + (self.SPLIT if i and not gaps[i] else 0.0)

        for j in range(1, n + 1):
            on, new = unknown + (gaps[j - 1] if j > 1 else 0.0), begin(j - 1) + fresh
            unknown, since = (on, since) if on <= new else (new, j - 1)
            unknown += self.PER_CHAR
            best[j], back[j] = unknown, since
            inner = 0.0
            for i in range(j - 1, max(-1, j - 1 - reach), -1):
                if self.count(chars[i:j]) and (c := begin(i) + self.cost(chars[i:j]) + inner) < best[j]:
                    best[j], back[j] = c, i
                inner += gaps[i]
        out, j = [], n
        while j:
            out.append(chars[back[j] : j])
            j = back[j]
        return out[::-1]


_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_SPACED_INSIDE = re.compile(r" [^\W\d_] [^\W\d_] ")  # of each such stretch, and quicker to look for


def _unspace(text: str, decoder: Decoder) -> str:
    def close(m: re.Match) -> str:
        chars = m[0].replace(" ", "")
        return " ".join(decoder.segment(chars, [0.0] + [decoder.MERGE / 10] * len(chars)))

    return _SPACED.sub(close, text) if _SPACED_INSIDE.search(text) else text


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out.append(text[at:a])
            at = b
    return "".join([*out, text[at:]])


def paragraphs(lines: list[str], blank_before: list[bool]) -> list[str]:
    """Lines into paragraphs, by dynamic programming: a paragraph should begin
    after a blank line, after a finished sentence, after a line shorter than
    usual, with a capital, and not be a fragment of one line."""
    n = len(lines)
    if not n:
        return []
    usual = sorted(map(len, lines))[n * 3 // 4]

    def cut(k: int) -> float:
        before, first = lines[k - 1].rstrip("\"'”’»)"), lines[k].lstrip("\"'“‘«(")[:1]
        ended = before.endswith((".", "!", "?", "…", ":", "。", "！", "？"))
        c = 4.0 if not ended else 0.0
        c += 4.0 if first.islower() else 0.0
        c += -6.0 if blank_before[k] else 3.0
        return c - (1.5 if ended and len(lines[k - 1]) < 0.6 * usual else 0.0)

    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    least, at = math.inf, 0  # the best beginning of a paragraph of several lines
    for j in range(1, n + 1):
        i = j - 1
        begun = best[i] + (cut(i) if i else 0.0)
        best[j], back[j] = begun + (1.0 if len(lines[i]) < 40 else 0.0), i
        if least < best[j]:
            best[j], back[j] = least, at
        if begun < least:
            least, at = begun, i
    out, j = [], n
    while j:
        out.append(" ".join(lines[back[j] : j]))
        j = back[j]
    return out[::-1]


_TOKEN = re.compile(r"\S+")


def decode(rest: str, decoder: Decoder) -> tuple[str, set[str]]:
    """A text without headers and page numbers, read along the cheapest path
    over its characters, and the kinds of damage (hyphen, chars) on the path.
    Tokens between gaps that no word can reach over are read by themselves."""
    words = rest.split()
    broken = any(c in rest for c in BREAK_MARKS) and bool(_BREAK.search(rest))
    shut = decoder.gaps_shut(words)
    if not broken and shut and not any(decoder.single(t) for t in set(words) - decoder.fine):
        return rest, set()
    kinds: set[str] = set()
    marks: dict[int, tuple[int, int, str, str, str, bool]] = {}
    last = 0
    for start, end, left, mark, right, at_line in breaks(rest) if broken else ():
        if start < last:
            continue
        if not at_line and (mark in "¬­‑" or not right[0].islower()) and not (mark in "¬­" and not decoder.count(left) and decoder.count(left + right)):
            continue
        if _NOT_LATIN.search(left + right) or (start and rest[start - 1] in BREAK_MARKS):
            continue
        marks[start + len(left)] = (start, end, left, mark, right, at_line)
        last = start + len(left)
    out: list[str] = []
    at = 0  # what of rest is in out
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(rest)]
    k = 0
    while k < len(tokens):
        run, hyphens = [tokens[k]], {}
        while True:
            a, b = run[-1]
            after = tokens[k + len(run)] if k + len(run) < len(tokens) else None
            if after and b - 1 in marks and b - a > 1:
                start, end, left, mark, right, at_line = marks[b - 1]
                if start > a and len(run) == 1 and rest[start - 1] not in _EDGE:
                    run[0] = (start, b)  # only the last part of a compound is broken
                hyphens[len(run) - 1] = (mark, at_line)
                stop = after[1] if not rest[end : after[1]].strip(_EDGE) else end
                run.append((after[0], stop if stop - 1 not in marks else after[1]))
                if run[-1][1] != after[1]:
                    break
            elif after and not shut and decoder.open(rest[a:b], rest[after[0] : after[1]]):
                run.append(after)
            else:
                break
        a, b = run[0][0], run[-1][1]
        if len(run) == 1:
            read = decoder.single(rest[a:b])
            if read:
                out += rest[at:a], read[0]
                at = b
                if read[1]:
                    kinds.add("chars")
        else:
            lead, pieces, tail = decoder.run(tuple(rest[x:y] for x, y in run)) if not hyphens else decoder.path([rest[x:y] for x, y in run], hyphens)
            new = [lead]
            for place, text, confused, joined in pieces:
                if place:
                    mark = hyphens.get(place - 1)
                    gap = rest[run[place - 1][1] : run[place][0]]
                    new.append(gap if mark is None else "" if new[-1].endswith("-") else mark[0] + gap)
                elif place is None:
                    new.append(" ")
                new.append(text)
                if confused:
                    kinds.add("chars")
                if joined:
                    kinds.add("hyphen")
            out += rest[at:a], *new, tail
            at = b
        k += len(run)
    return "".join([*out, rest[at:]]), kinds


def examine(text: str, decoder: Decoder, repair: bool, recurring: frozenset[str] = frozenset()) -> tuple[list[str], str | None]:
    """Kinds of damage in a text, and the repaired text if asked for."""
    kinds = set()
    spans: list[tuple[int, int, str]] = []
    if any(c.isdigit() or c.isupper() for c in text):
        spans = furniture(text, recurring)
        for *_, kind in spans:
            kinds.update(("header", "page_number") if kind == "both" else (kind,))
    rest = _without(text, spans) if spans else text
    rest = _unspace(rest, decoder)
    whole, found = decode(rest, decoder)
    kinds |= found
    if not repair:
        return sorted(kinds), None
    lines, blanks, blank = [], [], False
    for line in whole.split("\n"):
        words = line.split()
        if words:
            lines.append(" ".join(words))
            blanks.append(blank)
        blank = not words
    return sorted(kinds), "\n\n".join(paragraphs(lines, blanks))


class Labels:
    """Section labels: which of them are damaged, and what they stand for."""

    def __init__(self, counts: dict[str, int], share: float = 1e-3):
        self.counts = counts
        total = sum(counts.values())
        self.good: dict[str, str] = {}
        for s, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if n >= max(2, share * total):
                self.good.setdefault(self.squeeze(s), s)

    @staticmethod
    def squeeze(label: str) -> str:
        return re.sub(r"[\s\-‐‑¬­~_.]+", "", label)

    def repaired(self, label: str | None) -> str | None:
        """The undamaged label; the label itself if it is sound; "" if a header
        or page number stands in its place."""
        if not label or not label.strip():
            return label
        own = self.counts.get(label, 0)
        for form in (label, re.sub(r"\s+\d{1,4}$", "", label), re.sub(r"^\d{1,4}\s+", "", label)):
            key = self.squeeze(form)
            for k in [key, *self._readings(key)]:
                better = self.good.get(k)
                if better is not None and better != label and self.counts[better] >= 8 * max(own, 1):
                    return better
        if label not in self.good.values() and _LINE.match(label) and not re.fullmatch(r"[A-Z][A-Z ]+", label):
            return ""
        return label

    @staticmethod
    def _readings(key: str) -> Iterator[str]:
        for i in range(len(key)):
            for size in (2, 1):
                piece = key[i : i + size]
                for table in (SIGNS, LETTERS):
                    for x in table.get(piece, ()):
                        yield key[:i] + x + key[i + size :]
                        yield key[:i] + x.upper() + key[i + size :]


def scan_repair(passages: DataFrame, key: str = "passage_seq", text: str = "text", section: str = "section", repair: bool = True, share: float = 1e-6, doc: str = "doc_id") -> DataFrame:
    """Rows (key, kinds, section, text): for every passage the kinds of damage
    found (hyphen, chars, header, page_number, section), its repaired section
    label and, with ``repair``, its repaired text in paragraphs.

    Lines that recur over the texts of a document (column ``doc``, if there is
    one) are running headers whatever they look like. Null texts and labels stay
    null, empty ones empty. Words are judged by
    their counts over all passages, labels by theirs; repeated rows are
    repaired alike. Only words and labels of at least ``share`` and a
    thousandth of all are taken to the workers.
    """
    known = lexicon(passages, text, share)
    labels = passages.where(F.length(F.trim(section)) > 0).groupBy(section).count()
    n = passages.count()
    often = {r[section]: r["count"] for r in labels.where(F.col("count") >= max(2, 1e-4 * n)).toLocalIterator()}
    spark = passages.sparkSession
    sent = spark.sparkContext.broadcast({"known": known, "often": often})
    source = passages.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(section).alias("section"), *([F.col(doc).alias("doc")] if doc in passages.columns else []))
    if doc in passages.columns:
        lines = cut(recurring_lines(passages, key, doc, text))
        source = source.join(F.broadcast(lines) if lines.count() <= 100_000 else lines, "doc", "left").select("key", "text", "section", "lines")
    else:
        source = source.withColumn("lines", F.lit(None).cast("array<string>"))
    schema = passages.select(F.col(key).alias("key")).schema.add("kinds", "string").add("section", "string").add("text", "string")
    spec = ", ".join(f"{f.name} {'array<string>' if f.name == 'kinds' else f.dataType.simpleString()}" for f in schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value  # a worker's tasks share the decoder and what it has cached
        if "decoder" not in held:
            held["decoder"] = Decoder(*held["known"])
        decoder, sound = held["decoder"], Labels(held["often"])
        cache: dict[str | None, str | None] = {}
        for batch in batches:
            kinds, texts, sections = [], [], []
            for t, s, again in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, new = examine(t, decoder, repair, frozenset(again or ())) if t else ([], t)
                if s not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[s] = sound.repaired(s)
                if cache[s] != s:
                    found = [*found, "section"]
                kinds.append(found)
                texts.append(new)
                sections.append(cache[s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(sections, pa.string()), pa.array(texts, pa.string())], names=["key", "kinds", "section", "text"])

    out = source.mapInArrow(work, spec)
    return out.withColumnRenamed("key", key)
