"""Which texts of a document contain a given text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.session import cut


def fingerprints(text: str, k: int, w: int) -> np.ndarray:
    """Hashes of the k-grams that are smallest in a window of w of them: two
    texts that share k+w-1 characters in a row share a fingerprint."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least = h
    if n > 1 and w > 1:
        width = min(w, n)
        least = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)
    return np.unique(least)


# k and w by the length from which they find every shared stretch. Short ones
# go by all their k-grams.
TIERS = ((32, 12, 21), (12, 6, 7), (6, 6, 1), (3, 3, 1), (2, 2, 1), (1, 1, 1))
BROADCAST_DOCS = 100_000


def marks(frame: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, mark), a mark for each fingerprint of the tiers named in the
    array column ``tiers``; marks of different documents and tiers differ."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tier", pa.int32()), ("mark", pa.int64())])
        for batch in batches:
            keys, docs, names, marks = [], [], [], []
            for key_, doc, t, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for least, k, w in TIERS:
                    if least in wanted:
                        found = fingerprints(t, k, w).view(np.int64)
                        keys.append(np.full(len(found), key_, np.int64))
                        docs.append(np.full(len(found), doc, np.int64))
                        names.append(np.full(len(found), least, np.int32))
                        marks.append(found)
            whole = [pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip((keys, docs, names, marks), schema)]
            yield pa.RecordBatch.from_arrays(whole, schema=schema)

    rows = frame.select(F.col(key).alias("key"), F.xxhash64("doc_id").alias("doc"), F.col(text).alias("text"), "tiers").mapInArrow(make, "key bigint, doc bigint, tier int, mark bigint")
    return rows.select(F.col("key").alias(key), F.xxhash64("doc", "tier", "mark").alias("mark"))


def containing(needles: DataFrame, texts: DataFrame, hot: int = 256) -> DataFrame:
    """(q_id, p_id, same): the texts (p_id, doc_id, body[, form]) of a needle's
    own document that contain the needle (q_id, doc_id, body[, form]). Where
    there is a ``form``, it is compared instead of the body, and ``same`` tells
    whether the bodies also match.

    Documents of at most ``hot`` texts join on doc_id. In larger ones a needle
    meets only the texts that hold its rarest fingerprint, so that a document
    with any share of all rows isn't matched pair by pair. The list of larger
    documents is broadcast up to :data:`BROADCAST_DOCS`, beyond that joined.
    Empty needles and nulls match nothing.
    """
    none = F.lit(None).cast("string")
    q = needles.where(F.col("doc_id").isNotNull()).select("q_id", "doc_id", F.col("body").alias("q_body"), (F.col("form") if "form" in needles.columns else none).alias("q_form"))
    p = texts.where(F.col("body").isNotNull() & F.col("doc_id").isNotNull()).select("p_id", "doc_id", F.col("body").alias("p_body"), (F.col("form") if "form" in texts.columns else none).alias("p_form"))
    q_whole, p_whole = F.coalesce("q_form", "q_body"), F.coalesce("p_form", "p_body")
    q = q.where(q_whole != "")
    tier = F.coalesce(*[F.when(F.char_length(q_whole) >= least, least) for least, _, _ in TIERS])
    sizes = p.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    large = cut(sizes.join(q.groupBy("doc_id").agg(F.collect_set(tier).alias("tiers")), "doc_id").select("doc_id", "tiers"))
    n = large.count()
    large = F.broadcast(large) if n <= BROADCAST_DOCS else large
    inside, same = p_whole.contains(q_whole), F.col("p_body").contains(F.col("q_body")).alias("same")
    small = p.join(large.select("doc_id"), "doc_id", "left_anti") if n else p
    plain = small.join(q, "doc_id").where(inside).select("q_id", "p_id", same)
    if not n:
        return plain
    big_p, big_q = p.join(large, "doc_id"), q.join(large.select("doc_id"), "doc_id").withColumn("tiers", F.array(tier))
    p_marks = marks(big_p.withColumn("whole", p_whole), "p_id", "whole")
    known = p_marks.groupBy("mark").agg(F.count("*").alias("df"))
    rarest = marks(big_q.withColumn("whole", q_whole), "q_id", "whole").join(known, "mark").groupBy("q_id").agg(F.min_by("mark", F.struct("df", "mark")).alias("mark"))
    pairs = p_marks.join(rarest, "mark").select("p_id", "q_id").distinct()
    met = pairs.join(big_q.select("q_id", "q_body", "q_form"), "q_id").join(big_p.select("p_id", "p_body", "p_form"), "p_id").where(inside).select("q_id", "p_id", same)
    return plain.unionByName(met)
