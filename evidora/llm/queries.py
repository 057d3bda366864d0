"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages over 3000 characters, by the boundary at which they are cut."""
    from evidora.llm.pieces import split_items
    from evidora.llm.sentences import corpus_rules

    passages = table(spark, d, "passages")
    pieces = split_items(passages, size=3000, overlap=200, rules=corpus_rules(passages), only_oversized=True)
    return pieces.select("passage_seq", F.col("level").alias("boundary")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All passages in pieces of at most 3000 characters."""
    from evidora.llm.pieces import split_items
    from evidora.llm.sentences import corpus_rules

    passages = table(spark, d, "passages")
    return split_items(passages, size=3000, overlap=200, rules=corpus_rules(passages)).select("passage_seq", "section", "piece", "start_char", "end_char", "boundary", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """End offsets of the sentences of all documents."""
    from evidora.llm.sentences import sentences

    return sentences(table(spark, d, "documents")).select("doc_id", "end_char").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p8_found": p8_found,
}
SQL: dict[str, str] = {}


def _unifier(spark: SparkSession, d: str):
    from evidora.llm.lookalike import Unifier, citations

    return Unifier.of(table(spark, d, "passages").select("text"), citations(table(spark, d, "ledger")).select("quote"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose quote only matches once look-alikes are unified."""
    from evidora.llm.lookalike import citations, quote_matches

    cited = citations(table(spark, d, "ledger"))
    found = quote_matches(cited, table(spark, d, "passages"), _unifier(spark, d)).where("unified and not verbatim")
    return cited.join(found, ["doc_id", "quote"], "left_semi").select("claim_id", "cit_no").distinct()


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """All passages in their one form."""
    unifier = _unifier(spark, d)
    return table(spark, d, "passages").select("passage_seq", unifier.column(F.col("text")).alias("text"))


QUERIES |= {"p4_found": p4_found, "p4_texts": p4_texts}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar passages (word triples, 0.6) and titles (letter triples, 0.65)."""
    from evidora.llm.neardup import linked_pairs, near_duplicates

    passages = linked_pairs(*near_duplicates(table(spark, d, "passages"), "passage_id", "text", 3, "word", 0.6))
    titles = linked_pairs(*near_duplicates(table(spark, d, "docs"), "doc_id", "title", 3, "char", 0.65))
    return passages.select(F.lit("passage").alias("rec"), "key_a", "key_b").unionByName(titles.select(F.lit("title").alias("rec"), "key_a", "key_b"))


QUERIES |= {"p5_found": p5_found}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct spellings of one person or organisation."""
    from evidora.llm.names import entities
    from evidora.operators.graph import class_pairs

    names = table(spark, d, "docmeta").select(F.col("doc_id").alias("record"), F.explode("authors").alias("name")).unionByName(table(spark, d, "docs").select(F.col("doc_id").alias("record"), F.col("first_author").alias("name")))
    return class_pairs(entities(names), "name", "entity").toDF("name_a", "name_b")


QUERIES |= {"p3_found": p3_found}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 words in a row of an evaluation item."""
    return p6_report(spark, d).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items by document, with how much of the item is there."""
    from evidora.llm.leaks import contained_items

    return contained_items(table(spark, d, "documents"), table(spark, d, "eval_items"), size=13)


MIX_BLOCK = 4096  # tokens


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, tokens) of the targeted text, tokenized once."""
    from evidora.llm.mixing import token_counts
    from evidora.session import cut

    targets = table(spark, d, "mix_targets").select("source").distinct()
    wanted = table(spark, d, "documents").select("doc_id", "source", "text").join(targets, "source", "left_semi")
    return cut(token_counts(wanted).select("doc_id", "source", "tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share within their passes."""
    return p7_shares(spark, d).where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source, measured on the rows of the mix."""
    from evidora.llm.mixing import shares

    return shares(_counted(spark, d), table(spark, d, "mix_targets"), block=MIX_BLOCK)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents by slot and pass."""
    from evidora.llm.mixing import mix

    return mix(_counted(spark, d), table(spark, d, "mix_targets"), block=MIX_BLOCK)


QUERIES |= {"p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_shares": p7_shares, "p7_mix": p7_mix}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages by the kind of scan damage that the repair undoes."""
    from evidora.llm.scans import scan_repair

    return scan_repair(table(spark, d, "passages"), repair=False).select("passage_seq", F.explode("kinds").alias("kind")).distinct()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """All passages repaired."""
    from evidora.llm.scans import scan_repair

    return scan_repair(table(spark, d, "passages")).select("passage_seq", "section", "text")


QUERIES |= {"p1_found": p1_found, "p1_texts": p1_texts}
