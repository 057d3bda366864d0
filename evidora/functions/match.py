"""Search expressions: how they are written and parsed."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora.functions.text import ACCENTED, PLAIN, question_terms

_LEX = re.compile(r'"([^"]*)"|(\()|(\))|(,)|([^\s()",]+)')
_FOLD = str.maketrans(ACCENTED, PLAIN)
_SIGNS = re.compile(r"[-+/.]|^\d")
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def phrase(text: str) -> tuple[str, ...]:
    """The index tokens of a query word or phrase, folded as the index's are."""
    return tuple(t for t in re.split(r"[^\w]|_", unicodedata.normalize("NFC", text).lower().translate(_FOLD)) if t)


def quoted(expression: str) -> str:
    """Bare words with signs (- + / .) or a leading digit put in quotes;
    operators, parentheses and phrases stay. Applied twice it changes nothing."""

    def word(m: re.Match) -> str:
        w = m[5]
        return m[0] if w is None or w in OPERATORS or not _SIGNS.search(w) else f'"{w}"'

    return _LEX.sub(word, expression)


def any_of(text: Column) -> Column:
    """The recall expression of a question: its terms, quoted, joined by OR;
    empty where it has none."""
    return F.array_join(F.transform(question_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def joined(text: Column, mode: str = "OR") -> Column:
    """The words of a text of two and more characters, quoted, joined by OR or AND."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-'/.]*"), F.lit(0)), lambda w: F.length(w) > 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), f" {mode} ")


def parse(expression: str) -> tuple:
    """A MATCH expression as ("phrase", tokens), ("near", [tokens], n), ("and",
    a, b), ("or", a, b), ("not", a, b). Juxtaposed terms are ANDed first, then
    NOT, AND, OR. Bare terms with signs are phrases. Raises ValueError when
    malformed, also when nothing is asked for."""
    words: list[tuple[str, str]] = []
    for m in _LEX.finditer(expression):
        if m[1] is not None:
            words.append(("phrase", m[1]))
        elif m[5] in OPERATORS:
            words.append((m[5], m[5]))
        else:
            words.append(next((sign, sign) for k, sign in ((2, "("), (3, ")"), (4, ",")) if m[k]) if m[5] is None else ("phrase", m[5]))
    at = 0

    def peek() -> str:
        return words[at][0] if at < len(words) else ""

    def take(kind: str) -> str:
        nonlocal at
        if peek() != kind:
            raise ValueError(f"malformed MATCH expression: {expression}")
        at += 1
        return words[at - 1][1]

    def near() -> tuple:
        take("NEAR")
        take("(")
        inner = [phrase(take("phrase"))]
        while peek() == "phrase":
            inner.append(phrase(take("phrase")))
        n = 10
        if peek() == ",":
            take(",")
            n = int(take("phrase"))
        take(")")
        return ("near", inner, n) if len(inner) > 1 else ("phrase", inner[0])

    def atom() -> tuple:
        if peek() == "NEAR":
            return near()
        if peek() == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        return ("phrase", phrase(take("phrase")))

    def joined_terms() -> tuple:
        left = atom()
        while peek() in ("phrase", "(", "NEAR"):
            left = ("and", left, atom())
        return left

    def level(inner, name: str):
        def run() -> tuple:
            left = inner()
            while peek() == name:
                take(name)
                left = (name.lower(), left, inner())
            return left

        return run

    either = level(level(level(joined_terms, "NOT"), "AND"), "OR")
    tree = either()
    if at < len(words):
        raise ValueError(f"malformed MATCH expression: {expression}")
    return tree
