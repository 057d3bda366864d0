"""Text functions as Columns. Built-in expressions throughout; the Arrow
functions at the end are for what Spark has no expression for (NFKC)."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain ones, in order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Words that aren't asked for in a question.
QUESTION_STOPWORDS = tuple(
    """a an the of in on at to for from by with is are was were be been do does did what why how when which who whom that this these
those would could should can may might will shall as it its their there than then and or but if after before during between about into over
you your we our they them his her he she thing things work worked working important importantly extensively question questions panel approach approaches
useful good better best make makes making idea ideas example examples well lot lots very really just also some such like want need think know
say says said see get got give gives given use used using one two three first second next step steps way ways case cases point points
happen happens happened bit little much many more most less least same different additional addition furthermore instance etc sure maybe perhaps rather
quite even still back around across through help helps helping helpful gaining obtain result results process part parts place places not near""".split()
)
# Words that don't tell two claims apart.
CLAIM_STOPWORDS = tuple(
    """the and for that this with from are was were not but which these those have has had can may will would could should than then there their its
our your his her they them what when how why who into over under between within without also been being such more most other same does did
any all each both some one two three""".split()
)
# Words without content of their own; a parameter wherever it is used.
STOPWORDS = tuple(
    "the and for are was were been being with without from into onto over under above below between among about against during before after since until while this that these those there here their them they his her its our your you she him who whom whose which what when where why how has have had having does did doing can could may might must shall should will would not nor but yet also than then thus such some any all each every both either neither more most less least many much few own same other another only very too just even still again further once per via out off upon within across along around because though although unless whether".split()
)
# Folded signs of the verifier (ligatures, dashes and quotes).
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
DASHES = "‐‑‒–—―−"
QUOTES = "‘’‚“”„"


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: letters and digits of any script, case and
    Latin accents folded. Null for null."""
    return F.filter(F.split(fold_accents(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def question_terms(text: Column, least: int = 3, stopwords: tuple[str, ...] = QUESTION_STOPWORDS) -> Column:
    """Distinct content terms in order: split at everything but ASCII letters
    and digits, lower case, at least ``least`` long, no stopword, no number."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$")))


def content_tokens(text: Column, stopwords: tuple[str, ...] = CLAIM_STOPWORDS) -> Column:
    """Tokens for comparing claims: ASCII words of more than two characters
    that start with a letter and may hold digits and hyphens, with repeats."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9\\-]+"), F.lit(0)), F.lower), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9][A-Za-z0-9\\-'/.]*"))


def verify_fold(text: Column) -> Column:
    """The form in which quotes are compared: NFKC, ligatures, dashes and quotes
    plain, hyphens at a line's end closed with the white space around them,
    white space single, lower case."""
    out = nfkc(text)
    for sign, plain in LIGATURES:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    out = F.translate(out, DASHES, "-" * len(DASHES))
    out = F.translate(out, QUOTES, "'''\"\"\"")
    out = F.regexp_replace(out, r"-\s*\n\s*", "")
    out = F.regexp_replace(out, r"[\s  -  　]+", " ")
    return F.lower(F.trim(out))


def extract_year(text: Column) -> Column:
    """The first year from 1800 to 2049 in a text, else null."""
    found = F.regexp_extract(text, "(?:^|[^0-9])((?:18|19)[0-9]{2}|20[0-4][0-9])(?:[^0-9]|$)", 1)
    return F.when(found != "", found.cast("int"))


def fulltext_class(n_passages: Column, n_chars: Column, asked_abstract: Column | None = None) -> Column:
    """metadata_only, abstract_only (where only that was asked for), full (at
    least 6000 characters in 5 passages), else partial."""
    abstract = F.lit(False) if asked_abstract is None else F.coalesce(asked_abstract, F.lit(False))
    n, c = F.coalesce(n_passages, F.lit(0)), F.coalesce(n_chars, F.lit(0))
    return F.when(n == 0, "metadata_only").when(abstract, "abstract_only").when((c >= 6000) & (n >= 5), "full").otherwise("partial")


def doi(text: Column) -> Column:
    """A DOI in lower case without its resolver."""
    return F.regexp_replace(F.lower(F.trim(text)), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(fold_accents(text), "[^a-z0-9]+", "")


def title_in_text(title: Column, text: Column, share: float = 0.34, head: int = 6000, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Whether at least ``share`` of a title's words of more than three letters
    occur in the first ``head`` characters; true for titles of fewer than three."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    words = F.array_distinct(F.filter(index_tokens(title), lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t)))
    start = fold_accents(F.substring(text, 1, head))
    held = F.size(F.filter(words, lambda w: start.contains(w)))
    return F.when(F.size(words) < 3, True).otherwise(held >= share * F.size(words))


def _arrow(function):
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in column.to_pylist()], pa.string())

    return run


def canonical_text(text: str) -> str:
    """NFKC, hyphenated line ends closed between word characters, dashes, quotes
    and white space plain, case kept."""
    out = unicodedata.normalize("NFKC", text)
    out = re.sub(r"(?<=\w)[-‐‑­]\s*\n\s*(?=[^\W\d_])", "", out)
    out = out.translate({ord(c): "-" for c in DASHES} | {ord(c): "'" for c in "‘’‚"} | {ord(c): '"' for c in "“”„"})
    return re.sub(r"\s+", " ", out).strip()


def nfkc(text: Column) -> Column:
    """NFKC; ASCII texts stay in the JVM."""
    return F.coalesce(_arrow(lambda t: unicodedata.normalize("NFKC", t))(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def canonical(text: Column) -> Column:
    return _arrow(canonical_text)(text)


def canonical_fold(text: Column) -> Column:
    return _arrow(lambda t: canonical_text(t).casefold())(text)


def fold_name(text: Column) -> Column:
    """A name without accents and punctuation, lower case, single spaces."""

    def fold(t: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", plain)).strip().lower()

    return _arrow(fold)(text)
