"""The document store: compaction, merging, audit, packing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import doi, fulltext_class, title_in_text
from evidora.operators.graph import components

# White space as in the JVM's and SQL's \s.
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+")
KEYS = ("doi", "pmid", "pmcid", "arxiv_id", "source_sha256", "text_sha256")


def current(log: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The last row of each document of a change log; late and repeated rows are
    settled by ``order``. Null keys are left out."""
    one = F.max_by(F.struct(*[F.col(c) for c in log.columns if c != key]), F.col(order)).alias("r")
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(one).select(key, "r.*")


def identity_keys(rows: DataFrame) -> DataFrame:
    """(doc_id, key): every identifier that names a document, with its kind."""
    each = [F.when(F.length(F.trim(F.col(c))) > 0, F.concat(F.lit(f"{c}:"), doi(F.col(c)) if c == "doi" else F.trim(F.col(c)))) for c in KEYS if c in rows.columns]
    return rows.select("doc_id", F.explode(F.filter(F.array(*each), lambda k: k.isNotNull())).alias("key")).distinct()


def aliases(rows: DataFrame) -> DataFrame:
    """(key, n_docs, first_doc): identifiers that more than one document has."""
    return identity_keys(rows).groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


def identity_classes(rows: DataFrame) -> DataFrame:
    """(doc_id, same_as): documents that share identifiers, transitively, with
    the least doc_id of their class. Each document is linked to the first one
    of each shared key, never to all of them."""
    keys = identity_keys(rows)
    first = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(first, "key").select("doc_id", "first")
    return components(edges, "doc_id", "first").select(F.col("member").alias("doc_id"), F.col("root").alias("same_as"))


def merge(held: DataFrame, arriving: DataFrame) -> DataFrame:
    """Upsert by doc_id: the copy with more characters stays (ties: the one
    held), topics are united. ``outcome``: added, replaced, duplicate or kept."""
    a = held.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("a_chars"), F.col("topics").alias("a_topics"), F.lit(True).alias("a"))
    b = arriving.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("b_chars"), F.col("topics").alias("b_topics"), F.lit(True).alias("b"))
    none = F.array().cast("array<string>")
    topics = F.array_sort(F.array_distinct(F.concat(F.coalesce("a_topics", none), F.coalesce("b_topics", none))))
    outcome = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "kept").when(F.col("b_chars") > F.col("a_chars"), "replaced").otherwise("duplicate")
    return a.join(b, "doc_id", "full_outer").select("doc_id", outcome.alias("outcome"), F.greatest(F.coalesce("a_chars", F.lit(0)), F.coalesce("b_chars", F.lit(0))).alias("n_chars"), topics.alias("topics"))


def facts(passages: DataFrame) -> DataFrame:
    """Recomputed (doc_id, n, chars, bad_ids, head) of the stored passages."""
    p = passages.withColumn("want", F.concat("doc_id", F.lit("#p"), F.lpad(F.col("ord").cast("string"), 4, "0")))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"), F.count_if(F.col("want") != F.col("passage_id")).alias("bad_ids"), F.min_by("text", "ord").alias("head"))


def findings(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, finding): each way in which a document's row and its passages
    disagree; passages without a document are ``orphan``."""
    both = docs.select("doc_id", "title", "n_passages", "n_chars", "fulltext_status", "pub_date", F.lit(True).alias("listed")).join(facts(passages), "doc_id", "full_outer")
    n = F.coalesce("n", F.lit(0))
    tests = {
        "orphan": F.col("listed").isNull(),
        "no_text": F.col("listed") & (F.coalesce("n_passages", F.lit(0)) > 0) & (n == 0),
        "count_mismatch": F.col("listed") & (n > 0) & (n != F.coalesce("n_passages", F.lit(0))),
        "size_mismatch": F.col("listed") & (n > 0) & (F.col("chars") != F.coalesce("n_chars", F.lit(0))),
        "status_unsupported": F.col("listed") & (F.col("fulltext_status") == "full") & (fulltext_class(F.col("n_passages"), F.col("n_chars")) != "full"),
        "bad_passage_id": F.col("bad_ids") > 0,
        "title_absent": F.col("listed") & (n > 0) & ~title_in_text(F.col("title"), F.col("head")),
        "bad_date": F.col("listed") & ~F.coalesce(F.col("pub_date").rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), F.lit(False)),
        "short_title": F.col("listed") & (F.coalesce(F.length("title"), F.lit(0)) < 4),
    }
    each = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return both.select("doc_id", F.explode(each).alias("finding"))


def difference(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(side, n_docs, n_passages): documents on one side only, and on both."""
    p = passages.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    both = docs.select("doc_id", F.lit(1).alias("d")).join(p, "doc_id", "full_outer")
    side = F.when(F.col("d").isNull(), "index_only").when(F.col("n").isNull(), "manifest_only").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_passages"))


def pack(blocks: DataFrame, key: str, low: int = 1500, high: int = 3000, least_words: int = 3) -> DataFrame:
    """Blocks (key, ord, section, text) into passages (key, n, section, text,
    passage_id): neighbours of one section are joined by a newline until a
    passage reaches ``low`` characters, and before one exceeds ``high``;
    passages of fewer than ``least_words`` words are dropped. Null and blank
    blocks count as none. The ordered blocks stream through; a task holds the
    passage that it is filling, never a document."""
    kind = blocks.schema[key].dataType
    spec = f"key {kind.simpleString()}, n int, section string, text string"

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, section, held, size, n = None, None, [], 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal n, held, size
            if held and len(_WORDS.findall(text := "\n".join(held))) >= least_words:
                out.append((own, n, section, text))
                n += 1
            held, size = [], 0

        def done(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), (), ()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema.field(0).type, pa.int32(), pa.string(), pa.string()))], names=["key", "n", "section", "text"])
            out.clear()
            return batch

        schema = None
        for batch in batches:
            schema = batch.schema
            for k, s, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if held and (k != own or s != section or size >= low or size + 1 + len(t) > high):
                    close()
                if k != own:
                    own, n = k, 0
                section, size = s, size + len(t) + (1 if held else 0)
                held.append(t)
            yield done(schema)
        if schema is not None:
            close()
            yield done(schema)

    rows = blocks.where(F.length(F.trim("text")) > 0).select(F.col(key).alias("key"), "ord", "section", "text")
    packed = rows.repartition("key").sortWithinPartitions("key", "ord").mapInArrow(fold, spec)
    return packed.select(F.col("key").alias(key), "n", "section", "text", F.concat(F.col("key").cast("string"), F.lit("#p"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("passage_id"))


def statistics(docs: DataFrame) -> DataFrame:
    """(dimension, value, n_docs, n_passages): counts by status, type, channel
    and decade in one pass over grouping sets."""
    d = docs.select(F.coalesce("fulltext_status", F.lit("?")).alias("status"), F.coalesce("doc_type", F.lit("?")).alias("type"), F.coalesce("channel", F.lit("?")).alias("channel"), F.coalesce((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("?")).alias("decade"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"))
    out = d.groupingSets([["status"], ["type"], ["channel"], ["decade"]], "status", "type", "channel", "decade").agg(F.count("*").alias("n_docs"), F.sum("n_passages").alias("n_passages"))
    name = F.when(F.col("status").isNotNull(), "status").when(F.col("type").isNotNull(), "type").when(F.col("channel").isNotNull(), "channel").otherwise("decade")
    return out.select(name.alias("dimension"), F.coalesce("status", "type", "channel", "decade").alias("value"), "n_docs", "n_passages")
