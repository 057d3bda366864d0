"""What a reader may see: permitted sets, masks, and the prior of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.operators import measure as ms

MASK = "[withheld]"


def mentions(texts: DataFrame, ids: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, doc_id): ids that stand in a text as whole tokens; an id inside a
    longer one isn't mentioned. One pass over the texts and an equi-join."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9_#\\-]+"), F.lit(0)))).alias("doc_id"))
    return words.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(key, "doc_id")


def masked(texts: DataFrame, ids: DataFrame, held: DataFrame, key: str = "key", reader: str = "reader", text: str = "text") -> DataFrame:
    """(key, reader, text, n_masked): texts with the ids that their reader
    doesn't hold replaced. ``texts`` has (key, reader, text), ``held`` (reader,
    doc_id). Only ids that a text mentions go into its pattern, longest first."""
    found = mentions(texts, ids, key, text).join(texts.select(key, reader), key).join(held.select(reader, "doc_id").distinct(), [reader, "doc_id"], "left_anti")
    out = found.groupBy(key, reader).agg(F.collect_set("doc_id").alias("ids"))
    longest = F.array_sort(F.col("ids"), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    escaped = F.transform(longest, lambda x: F.regexp_replace(x, "([\\-#])", "\\\\$1"))
    pattern = F.concat(F.lit("(?<![A-Za-z0-9_#\\-])(?:"), F.array_join(escaped, "|"), F.lit(")(?![A-Za-z0-9_#\\-])"))
    whole = texts.join(out, [key, reader], "left")
    new = F.when(F.col("ids").isNotNull(), F.regexp_replace(F.col(text), pattern, F.lit(MASK))).otherwise(F.col(text))
    return whole.select(key, reader, new.alias(text), F.coalesce(F.size("ids"), F.lit(0)).alias("n_masked"))


def outside(cited: DataFrame, permitted: DataFrame) -> DataFrame:
    """Citations of documents that their seat wasn't handed. A seat without any
    permitted document has all its citations outside."""
    return cited.join(permitted.select("seat", "doc_id").distinct(), ["seat", "doc_id"], "left_anti")


def preflight(handed: DataFrame, rubric_counts: DataFrame, contest: DataFrame) -> DataFrame:
    """One row: mean Jaccard distance of the handed documents (seat, doc_id),
    mean divergence of the seats' rubric words (seat, term, n), contestedness of
    all handed texts (one row: score), and the retention that they suggest."""
    g = handed.withColumn("g", F.lit(1))
    packet = ms.jaccard_pairs(g, ["g"], "seat", "doc_id").agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias("packet"))
    rubric = ms.js_pairs(rubric_counts.withColumn("g", F.lit(1)), ["g"], "seat").agg(F.coalesce(F.avg("divergence"), F.lit(0.0)).alias("rubric"))
    rho = 0.6 + 0.3 * (F.col("packet") - 0.5) + 0.2 * (F.col("contest") - 0.5)
    one = packet.crossJoin(rubric).crossJoin(contest.select(F.col("score").alias("contest")))
    return one.select(F.round("packet", 6).alias("packet"), F.round("rubric", 6).alias("rubric"), F.round("contest", 6).alias("contest"), F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.9), rho)), 6).alias("rho"))
