"""Sentence boundaries across languages and scripts (problem 8).

Document-centred disambiguation: whether a period ends a sentence is decided
from unambiguous occurrences of the same word types, first in the document,
then in the corpus. A type whose period is mostly followed by lower-case
words, digits or commas is an abbreviation; one that is followed by
capitalised names but never by ordinary sentence starters is a title. Scripts
with terminators of their own, or with none (Thai), have their own rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Quotation marks, brackets and terminators by role.
OPENERS = "([{«‹„‚“‘「『（《〈【¿¡"
CLOSERS = ")]}»›”’」』）》〉】“"
PAIRS = {"(": ")", "[": "]", "{": "}", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "《": "》", "〈": "〉", "【": "】"}
TERMINATORS = ".!?…。！？．｡؟।॥։።።።။‼⁇⁈⁉"
WIDE = "。！？．｡"
DASHES = "-–—―"

_BLANK = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_MARKS = re.compile("[" + re.escape("([{«‹„“”」』「『（）《》〈〉【】)]}»›\"") + "]")
_RUN = re.compile("[" + re.escape(TERMINATORS) + "]+")
_RUN_GREEK = re.compile("[" + re.escape(TERMINATORS) + ";;]+")
# Thai and Lao, without their signs of repetition before the gap.
_THAI_GAP = re.compile(r"(?<=[฀-ๅ็-๎๐-๛\u0e80-\u0ec5\u0ec8-\u0edf])\s+(?=[฀-๛\u0e80-\u0edf])")
_TOKEN = re.compile(r"\S+")
_LEAD = "\"'" + OPENERS
_TRAIL = "\"'" + CLOSERS
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_KANA_QUOTE = ("と", "って", "という", "との")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches between blank lines, without outer white space."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if s := piece.strip():
            start = at + piece.index(s[0])
            yield start, start + len(s)
        if m:
            at = m.end()


def _strip(token: str) -> str:
    return token.lstrip(_LEAD)


def observations(text: str) -> Counter:
    """What one document shows about word types: ("l", word) seen in lower
    case, ("c", word) capitalised where no sentence can start, ("s", word)
    capitalised after a terminator, ("n", word) after a number with a period, ("p", type, class) what follows a
    type with a period."""
    seen: Counter = Counter()
    for a, b in blocks(text):
        prev = ""
        for token in text[a:b].split():
            core = _strip(token)
            if not core:
                prev = token
                continue
            word = core.rstrip(_TRAIL + ".,;:!?…")
            low = word.lower()
            first = core[0]
            if prev.endswith("."):
                key = _strip(prev).lower()
                if key[:-1].isdigit():
                    if first.isupper() and low:
                        seen["n", low, ""] += 1
                else:
                    if first.isupper() and len(key) <= 12:
                        short = core.endswith(".") and len(word) <= 4
                        seen["p", key, "initial" if short else "U" + low] += 1
                    elif len(key) <= 12:
                        seen["p", key, "digit" if first.isdigit() else "lower" if first.islower() else "other"] += 1
                    if low and first.isupper():
                        seen["s", low, ""] += 1
            elif low and first.isupper() and prev:
                if prev[-1].isalnum():
                    seen["c", low, ""] += 1
                elif prev[-1] in "!?":
                    seen["s", low, ""] += 1
            if low and first.islower():
                seen["l", low, ""] += 1
            if core[-1] in ",;:" and (m := core.rstrip(",;:")).endswith(".") and len(m) <= 12:
                seen["p", m.lower(), "mid"] += 1
            prev = token.rstrip("\"'") if token[-1] in "\"'" else token
    return seen


def corpus_evidence(documents: DataFrame, text: str = "text") -> DataFrame:
    """Counts of :func:`observations` over all documents, as rows of
    (kind, a, b, n). Each partition counts on its own before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_pydict({"kind": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "n": pa.array([total[k] for k in keys], pa.int64())}, schema=SCHEMA)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total.update(observations(t))
            if len(total) > 200_000:
                yield out()
                total.clear()
        yield out()

    SCHEMA = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    rows = documents.select(F.col(text)).mapInArrow(count, "kind string, a string, b string, n bigint")
    return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def corpus_rules(documents: DataFrame, text: str = "text", share: float = 1e-6) -> dict:
    """The corpus's word types that decide periods: ``abbr`` (type -> may end a
    sentence), ``starter`` words and ``dated`` words, which follow ordinals.
    Only types with at least ``share`` of all observations of their kind are
    returned, hence at most ``1/share`` of each: a fixed bound on what is
    collected. Rarer types are decided by their document."""
    from evidora.session import cut

    seen = cut(corpus_evidence(documents, text))
    words = seen.where("kind <> 'p'").groupBy("a").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "lcsn"])
    total = seen.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    n_of = {r["kind"]: r["n"] for r in total}
    n_words = sum(n_of.get(k, 0) for k in "lcsn")
    floor = max(2, share * n_words)
    starters = words.where((F.col("l") >= floor) & (F.col("l") > F.col("c")))
    dated = words.where((F.col("n") >= max(3, share * n_words)) & (F.col("n") > F.col("l") + F.col("c") + F.col("s")))
    after = seen.where("kind = 'p'").withColumn("next", F.when(F.col("b").startswith("U"), F.substring("b", 2, 100)))
    after = after.join(words.select(F.col("a").alias("next"), "l", "c"), "next", "left")
    cls = F.when(F.col("next").isNull(), F.col("b")).when(F.col("l") > F.col("c"), "starter").when(F.col("c") > 0, "name").otherwise("unknown")
    kinds = ["lower", "digit", "mid", "other", "initial", "starter", "name", "unknown"]
    types = after.withColumn("cls", cls).groupBy("a").agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("cls") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])
    types = types.where(F.col("all") >= max(2, share * n_of.get("p", 0)))
    inside = F.col("lower") + F.col("digit") + F.col("mid")
    upper = F.col("starter") + F.col("name") + F.col("unknown") + F.col("initial")
    title = (upper >= 0.8 * F.col("all")) & (F.col("starter") <= 0.03 * upper) & (F.col("all") >= 8) & (F.length("a") <= 8)
    plain = words.select(F.concat("a", F.lit(".")).alias("a"), (F.col("l") + F.col("c")).alias("undotted"))
    types = types.join(plain, "a", "left").fillna(0, ["undotted"])
    short = (F.length("a") <= 9) & (inside >= F.when(F.col("undotted") > 2 * F.col("all"), 0.8).otherwise(0.3) * F.col("all"))
    dotted = F.regexp_like("a", F.lit(r"^[^0-9]+\.[^0-9]+\.$")) & (F.length("a") <= 9)
    abbr = types.where(short | title | dotted).select("a", (F.col("starter") > 0.1 * F.greatest(upper, F.lit(1))).alias("ends"))
    return {
        "abbr": {r["a"]: r["ends"] for r in abbr.toLocalIterator()},
        "starter": {r["a"] for r in starters.select("a").toLocalIterator()},
        "dated": {r["a"] for r in dated.select("a").toLocalIterator()},
    }


EMPTY_RULES = {"abbr": {}, "starter": set(), "dated": set()}


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Quotations and brackets of a block as (open, close), outermost or not.
    Marks without a partner are left out."""
    stack: list[tuple[str, int]] = []
    found = []

    def close(kinds: str, at: int) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                found.append((stack[k][1], at))
                del stack[k:]
                return True
        return False

    for m in _MARKS.finditer(text, a, b):
        c, at = m[0], m.start()
        if c == '"':
            before = text[at - 1] if at > a else " "
            opens = before.isspace() or before in OPENERS + DASHES
            if not opens and close('"', at):
                continue
            stack.append(('"', at))
        elif c == "“":
            if not close("„", at):
                stack.append(("“", at))
        elif c == "”":
            close("“„", at)
        elif c == "„" or c in PAIRS:
            stack.append((c, at))
        else:
            close(next((o for o, e in PAIRS.items() if e == c), ""), at)
    found.sort()
    return found


class Splitter:
    """Ends of sentences in one text at a time, under the corpus's rules."""

    def __init__(self, rules: dict | None = None):
        rules = rules or EMPTY_RULES
        self.abbr, self.starter, self.dated = rules["abbr"], rules["starter"], rules["dated"]

    def ends(self, text: str | None) -> list[int]:
        """Offsets just behind each sentence. Empty for null and blank texts."""
        if not text or text.isspace():
            return []
        own = self._own(text)
        found: list[int] = []
        for a, b in blocks(text):
            found += self._block(text, a, b, own)
        return found

    def _own(self, text: str) -> dict:
        """What the document itself shows. Only looked at when needed."""
        return {"text": text}

    def _seen(self, own: dict) -> dict:
        if "low" not in own:
            low, cap = set(), set()
            inner: Counter = Counter()
            ended: Counter = Counter()
            prev = ""
            for token in own["text"].split():
                core = _strip(token)
                word = core.rstrip(_TRAIL + ".,;:!?…")
                if word:
                    if word[0].islower():
                        low.add(word.lower())
                    elif prev and prev[-1].isalnum():
                        cap.add(word.lower())
                    if prev.endswith(".") and not prev.endswith(".."):
                        (inner if word[0].islower() or core[0].isdigit() else ended)[_strip(prev).lower()] += 1
                prev = token
            own |= {"low": low, "cap": cap, "inner": inner, "ended": ended, "lower_only": not any(c.isupper() for c in own["text"])}
        return own

    def _undotted(self, word: str, own: dict) -> int:
        """How often the document has a word in lower case without a period."""
        if "plain" not in own:
            own["plain"] = Counter(w for t in own["text"].split() if (w := _strip(t).rstrip(_TRAIL + ",;:!?…")).islower())
        return own["plain"][word]

    def _starts(self, word: str, own: dict) -> bool:
        """Whether a capitalised word is one that is else written small."""
        w = word.lower()
        seen = self._seen(own)
        if w in seen["low"] and w not in seen["cap"]:
            return True
        if w in seen["cap"] and w not in seen["low"]:
            return False
        return w in self.starter

    def _block(self, text: str, a: int, b: int, own: dict) -> list[int]:
        spans = _spans(text, a, b)
        greek = bool(_GREEK.search(text, a, b))
        marks = [(m.start(), m.end(), False) for m in (_RUN_GREEK if greek else _RUN).finditer(text, a, b)]
        if "ก" <= max(text[a:b]) and any("฀" <= c <= "\u0edf" for c in text[a:b]):
            marks += [(m.start(), m.start(), True) for m in _THAI_GAP.finditer(text, a, b)]
            marks.sort()
        out: list[int] = []
        start = a
        for p, e, thai in marks:
            if p < start:
                continue
            end = e
            while end < b:
                gap = end
                while gap < b and text[gap] in " \xa0\u202f\n" and gap - end < 2:
                    gap += 1
                if gap > end:
                    if gap < b and text[gap] in "»›" and any(c == gap for _, c in spans):
                        end = gap
                    else:
                        break
                if not (text[end] in CLOSERS or text[end] in "\"'" or text[end] in TERMINATORS):
                    break
                if text[end] == '"' and not any(x[1] == end for x in spans):
                    break
                if text[end] == "“" and not any(x[1] == end for x in spans):
                    break
                end += 1
            if end >= b:
                break
            if any(o < p and c >= end for o, c in spans):
                continue
            closed = [o for o, c in spans if o < p and e <= c < end]
            if thai or self._boundary(text, a, b, start, p, e, end, closed, own, greek):
                out.append(end)
                start = end
                while start < b and text[start].isspace():
                    start += 1
        out.append(b)
        return out

    def _boundary(self, text: str, a: int, b: int, start: int, p: int, e: int, end: int, closed: list[int], own: dict, greek: bool) -> bool:
        run = text[p:e]
        nxt = text[end]
        quoted = [o for o in closed if text[o] not in "([{（【"]
        if any(c in WIDE for c in run) or (run[-1] in "!?" and _wide(nxt)):
            if not quoted:
                return True
            if text.startswith(_KANA_QUOTE, end):
                return False
            led = text[start : min(quoted)].strip()
            return bool(led) or nxt.isspace() or nxt in OPENERS or nxt == '"'
        if run[-1] in "।॥።။։" and not quoted:
            return True
        if not nxt.isspace():
            return bool(_wide(nxt) and run[-1] in "!?…" and not quoted)
        at = end
        while at < b and text[at].isspace():
            at += 1
        if at >= b:
            return True
        nxt = text[at]
        if nxt in DASHES:
            k = at
            while k < b and (text[k] in DASHES or text[k].isspace()):
                k += 1
            return k < b and text[k].isupper() and not quoted
        k = at
        while k < b and (text[k] in OPENERS or text[k] in "\"'"):
            k += 1
        opened = k > at
        first = text[k] if k < b else nxt
        m = _TOKEN.match(text, k)
        token = m[0] if m else ""
        word = token.rstrip(_TRAIL + ".,;:!?…")
        if first.islower():
            if not self._seen(own)["lower_only"]:
                return nxt in "¿¡"
            if quoted and run[-1] != ".":
                return False
        if first in ",;:.%":
            return False
        if run != ".":
            return True
        if quoted:
            return True
        # A single period: look at the word before it.
        s = p
        while s > a and not text[s - 1].isspace():
            s -= 1
        key = _strip(text[s : p + 1]).lower()
        body = key[:-1]
        if s <= start and start == a and len(body) <= 3 and (body.isdigit() or len(body) == 1 or set(body) <= set("ivxlc")):
            return False  # a numbered heading or list item
        if body.isdigit():
            if len(body) <= 2 and first.isupper() and word.lower() in self.dated and word.lower() not in self._seen(own)["low"]:
                return False
            return True
        initial = len(word) == 1 and token[1:2] == "."
        titled = token.endswith(".") and token.lower() in self.abbr
        starts = not initial and not titled and (opened or (first.isupper() and self._starts(word, own)))
        if len(body) == 1 and body.isalpha():
            ends = self.abbr.get(key)
            if ends is None:
                return starts or (not text[p - 1].isupper() and text[s].islower() and s > a and text[: s].rstrip()[-1:].isdigit())
            return starts or (ends and not first.isdigit() and not initial)
        # The document's own uses decide where they are unambiguous, the corpus
        # where they are not.
        seen = self._seen(own)
        inside, ended = seen["inner"][key], seen["ended"][key]
        if inside >= 2 and inside > 2 * ended:
            return starts
        if key in self.abbr:
            if first.isdigit():
                return False
            return starts or bool(self.abbr[key]) or (not inside and self._undotted(body, own) >= 2)
        if "." in body and len(body) <= 6:
            return starts
        return True


def _wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", rules: dict | None = None, with_text: bool = False) -> DataFrame:
    """One row per sentence: key, ``ord`` (from 0), ``start_char``, ``end_char``.

    A heading is a sentence, a blank line ends one, quotations inside a sentence
    do not. Null, empty and blank texts give no rows; repeated input rows repeat
    theirs. Other columns of the input are not read.
    """
    rules = corpus_rules(documents, text) if rules is None else rules
    sent = documents.sparkSession.sparkContext.broadcast(rules)
    kind = documents.schema[key].dataType.simpleString()
    pa_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("key", pa_kind), ("ord", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(sent.value)
        for batch in batches:
            keys, ords, starts, ends = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for i, end in enumerate(splitter.ends(t)):
                    while t[at].isspace():
                        at += 1
                    keys.append(k)
                    ords.append(i)
                    starts.append(at)
                    ends.append(end)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa_kind), pa.array(ords, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=schema)

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(split, f"key {kind}, ord int, start_char int, end_char int").withColumnRenamed("key", key)
