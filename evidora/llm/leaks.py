"""Evaluation items inside training documents (problem 6).

Prefix-filtered join: the windows of an item are sets of shingles; shingles are
ordered by how many documents hold them, and as a leaked window holds all of
its shingles, the rarest one is the prefix that has to be met. Documents meet
windows by that shingle, at the place it has in the window (position), where
enough words lie on both sides (length), and are verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.sketch import Bits, bitmap, bits_for
from evidora.session import cut

_WORD = re.compile(r"[^\W_]+")
SHINGLE = 3


def words(text: str) -> list[str]:
    """Words in lower case without punctuation; apostrophes join."""
    return _WORD.findall(text.replace("'", "").replace("’", "").casefold())


class Hashes(dict):
    """64-bit hashes of words, cached."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def shingles(self, ws: list[str]) -> np.ndarray:
        """A hash of the ``SHINGLE`` words from each place on."""
        codes = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        n = len(codes) - SHINGLE + 1
        with np.errstate(over="ignore"):
            h = np.zeros(max(n, 0), np.uint64)
            for i in range(SHINGLE if n > 0 else 0):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[i : i + n]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(32))


def _asked(items: DataFrame, item: str, text: str) -> DataFrame:
    return items.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0)).distinct()


def windows(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(item, n, at, window, grams) of every window of ``size`` words of the
    items: the number of words of the item, where the window begins, its words,
    and the hashes of its shingles. Items of fewer words have none."""
    kind = items.schema[item].dataType

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            rows, n, at, window, grams = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ws = words(t)
                if len(ws) < size:
                    continue
                h = hashes.shingles(ws).view(np.int64)
                for k in range(len(ws) - size + 1):
                    rows.append(row)
                    n.append(len(ws))
                    at.append(k)
                    window.append(" ".join(ws[k : k + size]))
                    grams.append(h[k : k + size - SHINGLE + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(window, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=["item", "n", "at", "window", "grams"]
            )

    return _asked(items, item, text).mapInArrow(work, f"item {kind.simpleString()}, n int, at int, window string, grams array<bigint>")


def too_short(items: DataFrame, size: int = 13, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n_words) of the items that can't be searched for, as they have
    fewer than ``size`` words; items without words, or with null text, count 0."""
    count = F.arrow_udf(lambda column: pa.array([len(words(t)) if t else 0 for t in column.to_pylist()], pa.int32()), "int")
    return items.where(F.col(item).isNotNull()).select(F.col(item), count(F.col(text)).alias("n_words")).distinct().where(F.col("n_words") < size)


def _frequency(docs: DataFrame, sent) -> DataFrame:
    """(g, df): in how many documents each shingle of the bitmap occurs."""
    schema = pa.schema([("g", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes, held, rows = Bits(*sent.value), Hashes(), [], 0

        def out() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            for t in batch.column(1).to_pylist():
                h = hashes.shingles(words(t))
                h = np.unique(h[bits.held(h)])
                if len(h):
                    held.append(h)
                    rows += len(h)
            if rows > 1_000_000:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return docs.mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("df"))


def _met(docs: DataFrame, sent, size: int) -> DataFrame:
    """(doc, g, lead, around): each place at which a document has a shingle of
    the bitmap, with up to ``size - SHINGLE`` words before (their number is
    ``lead``) and behind."""
    reach = size - SHINGLE

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = Bits(*sent.value), Hashes()
        for batch in batches:
            rows, gs, leads, arounds = [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ws = words(t)
                if len(ws) < size:
                    continue
                h = hashes.shingles(ws)
                for p in np.flatnonzero(bits.held(h)).tolist():
                    a = max(0, p - reach)
                    rows.append(row)
                    gs.append(h[p].astype(np.int64))
                    leads.append(p - a)
                    arounds.append(" ".join(ws[a : p + size]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(gs, pa.int64()), pa.array(leads, pa.int32()), pa.array(arounds, pa.string())], names=["doc", "g", "lead", "around"])

    return docs.mapInArrow(work, f"doc {docs.schema['doc'].dataType.simpleString()}, g bigint, lead int, around string")


def contained_items(documents: DataFrame, items: DataFrame, size: int = 13, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, words, share): the documents that hold at least
    ``size`` words in a row of an item, how many of its words such windows
    cover in the document, and their share of the item.

    Case and punctuation are ignored. The documents are read twice whatever the
    number of items, once to count shingles and once to meet them; what is
    broadcast is a bitmap of bounded size, and windows are joined as rows. Items
    of fewer than ``size`` words match nothing (:func:`too_short` lists them),
    nor do null or empty texts; repeated rows count once.
    """
    spark = documents.sparkSession
    asked = cut(windows(items, size, item, text))
    docs = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") > 0))
    grams = cut(asked.select(F.explode("grams").alias("g")).distinct())
    bits = bitmap(grams, bits_for(grams.count()))
    seen = spark.sparkContext.broadcast((bits.bits, bits.words))
    df = cut(grams.join(_frequency(docs, seen), "g", "left").fillna(0, ["df"]))
    seen.unpersist()
    each = asked.select("item", "n", "at", "window", F.posexplode("grams").alias("offset", "g")).join(df, "g")
    prefix = cut(each.groupBy("item", "n", "at", "window").agg(F.min_by(F.struct("g", "offset"), F.struct("df", "g", "offset")).alias("p")).select("item", "n", "at", "window", F.col("p.g").alias("g"), F.col("p.offset").alias("offset")))
    rare = prefix.select("g").distinct()
    bits = bitmap(rare, bits_for(rare.count()))
    hits = _met(docs, spark.sparkContext.broadcast((bits.bits, bits.words)), size)
    begin = F.col("lead") - F.col("offset")
    met = hits.join(prefix, "g").where((begin >= 0) & (F.array_join(F.slice(F.split("around", " "), F.greatest(begin, F.lit(0)) + 1, F.lit(size)), " ") == F.col("window")))
    found = met.groupBy("doc", "item", "n").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("ats")), lambda i: F.least(F.lit(size), F.element_at("ats", i) - F.element_at("ats", i - 1)))
    covered = F.lit(size) + F.when(F.size("ats") > 1, F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).otherwise(0)
    out = found.withColumn("words", covered).groupBy("doc", "item").agg(F.max("words").alias("words"), F.max(F.col("words") / F.col("n")).alias("share"))
    return out.select(F.col("doc").alias(doc), F.col("item").alias(item), "words", "share")
