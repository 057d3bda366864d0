"""The manifest as JSON lines, and write-once turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.sources.files import exists

MANIFEST = """seq bigint, doc_id string, title string, first_author string, n_authors int, year int, pub_date string, venue string, doc_type string, provenance string, doi string, pmid string, pmcid string, arxiv_id string,
source_sha256 string, text_sha256 string, source_filename string, source_bytes bigint, fulltext_status string, n_passages int, n_chars int, topics array<string>, channel string, retrieved_at string"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines manifest; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows fit for the store, and the others with ``reason``."""
    reason = (
        F.when(~F.coalesce(F.col("doc_id").rlike("^[a-z0-9][a-z0-9_\\-]*$"), F.lit(False)), "bad id")
        .when(F.coalesce(F.length(F.trim("title")), F.lit(0)) < 4, "no title")
        .when(~F.coalesce(F.col("pub_date").rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), F.lit(False)), "undatable")
        .when((F.coalesce("n_passages", F.lit(0)) == 0) & (F.col("fulltext_status") != "metadata_only"), "no text")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def freeze_turn(ledger: DataFrame, path: str, turn: int, force: bool = False) -> str:
    """Writes a turn's claims under ``turn=n`` once, and returns their digest: a
    hash over the hashes of 4096 buckets, each over its ordered rows' hashes, so
    that no task sees all rows. A frozen turn is refused unless forced."""
    target = f"{path}/turn={turn}"
    if exists(ledger.sparkSession, target) and not force:
        raise FileExistsError(f"turn {turn} is frozen")
    one = ledger.where(F.col("turn") == turn).drop("turn")
    one.write.mode("overwrite").parquet(target)
    row = F.sha2(F.to_json(F.struct(*sorted(one.columns))), 256)
    hashed = one.sparkSession.read.parquet(target).select(row.alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    per = hashed.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "h"))), ""), 256)).first()[0]


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that ``rows`` has; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
