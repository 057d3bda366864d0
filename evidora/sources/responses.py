"""Responses of seats: one JSON file each, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITATION = "struct<doc_id:string,quote:string>"
CLAIM = f"struct<claim:string,text:string,citations:array<{CITATION}>,evidence:array<{CITATION}>,declared:map<string,string>,type:string,territory:string>"
CHECK = f"struct<doc_id:string,cited_by:string,claim:string,verdict:string,why:string,citations:array<{CITATION}>>"
RESPONSE = f"struct<claims:array<{CLAIM}>,abstentions:array<struct<question_part:string,cause:string,detail:string>>,stances:array<struct<seat:string,claim:string,stance:string,why:string>>,citation_checks:array<{CHECK}>>"
VERDICTS = ("supported", "overstated", "misread", "irrelevant", "unreachable")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(seat, body) of the ``*.json`` files of a folder; the seat is the file's
    name, a byte order mark is dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    seat = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.select(seat.alias("seat"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("body"))


def parse(bodies: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Adds ``state`` (answered, unparseable, or, for a seat of the roster
    without a response, no response) and the parsed ``r``."""
    r = F.from_json("body", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    shaped = F.col("body").rlike(r"^\s*\{[\s\S]*\}\s*$") & F.get_json_object("body", "$").isNotNull()
    out = bodies.select("seat", F.when(shaped, "answered").otherwise("unparseable").alias("state"), F.when(shaped, r).alias("r"))
    if roster is None:
        return out
    return roster.select("seat").join(out, "seat", "left").withColumn("state", F.coalesce("state", F.lit("no response")))


def claims(parsed: DataFrame) -> DataFrame:
    """(seat, claim_idx, text, type, territory, declared, citations). The text
    is that of ``claim`` or else ``text``; citations are those under
    ``citations`` or, if there are none, ``evidence``. Items that aren't
    objects, or have no text, are left out."""
    c = parsed.select("seat", F.posexplode("r.claims").alias("claim_idx", "c")).where("c is not null")
    text = F.coalesce(F.nullif(F.trim("c.claim"), F.lit("")), F.nullif(F.trim("c.text"), F.lit("")))
    cited = F.coalesce(F.when(F.size("c.citations") > 0, F.col("c.citations")), F.col("c.evidence"), F.array().cast(f"array<{CITATION}>"))
    return c.select("seat", "claim_idx", text.alias("text"), F.col("c.type").alias("type"), F.col("c.territory").alias("territory"), F.col("c.declared").alias("declared"), F.filter(cited, lambda x: x.isNotNull()).alias("citations")).where("text is not null")


def checks(parsed: DataFrame, shown: DataFrame, quoted: DataFrame | None = None) -> DataFrame:
    """(seat, doc_id, verdict, state): citation checks. An unknown verdict reads
    unrecognised; a document that the seat wasn't shown is not_under_examination;
    a verdict other than supported or unreachable needs a verified quote of the
    document by that seat, in ``quoted`` (seat, doc_id) if given, else it is
    unsupported_verdict."""
    k = parsed.select("seat", F.explode("r.citation_checks").alias("k")).where("k.doc_id is not null")
    verdict = F.when(F.lower("k.verdict").isin(*VERDICTS), F.lower("k.verdict")).otherwise("unrecognised")
    k = k.select("seat", F.col("k.doc_id").alias("doc_id"), verdict.alias("verdict")).join(shown.select("seat", "doc_id", F.lit(True).alias("shown")).distinct(), ["seat", "doc_id"], "left")
    bare = F.lit(False)
    if quoted is not None:
        k = k.join(quoted.select("seat", "doc_id", F.lit(True).alias("quoted")).distinct(), ["seat", "doc_id"], "left")
        bare = F.col("quoted").isNull() & ~F.col("verdict").isin("supported", "unreachable")
    state = F.when(F.col("shown").isNull(), "not_under_examination").when(bare, "unsupported_verdict").otherwise("recorded")
    return k.select("seat", "doc_id", "verdict", state.alias("state"))


def verdict_counts(checked: DataFrame) -> DataFrame:
    """(seat, verdict, n, adverse): checks by reviewer and verdict, and how many
    are adverse: overstated, misread or irrelevant, and recorded."""
    bad = F.col("verdict").isin("overstated", "misread", "irrelevant") & (F.col("state") == "recorded")
    return checked.groupBy("seat", "verdict").agg(F.count("*").alias("n"), F.count_if(bad).alias("adverse"))
