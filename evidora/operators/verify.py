"""Quote verification and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import verify_fold
from evidora.operators.contain import containing


def claims(ledger: DataFrame) -> DataFrame:
    """One row a claim_id: the one ingested last; repeated rows count once."""
    last = Window.partitionBy("claim_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.xxhash64(F.to_json(F.struct("run", "turn", "seat", "claim_idx", "text", "citations"))))
    return ledger.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def citations(ledger: DataFrame) -> DataFrame:
    """A row for each citation of :func:`claims`, ``cit_no`` from 0."""
    each = claims(ledger).select("claim_id", "run", "turn", "seat", F.posexplode("citations").alias("cit_no", "c"))
    return each.select("claim_id", "run", "turn", "seat", "cit_no", F.col("c.doc_id").alias("doc_id"), F.col("c.quote").alias("quote"))


def verify(cited: DataFrame, passages: DataFrame, docs: DataFrame, own: DataFrame | None = None, least: int = 40, permitted: DataFrame | None = None) -> DataFrame:
    """Adds ``status``, ``tier`` and ``passage_id`` to citations.

    In this order: a folded quote shorter than ``least`` is too_short; a
    document that isn't in ``docs`` is invented; one that its seat wasn't handed
    is out_of_scope, if ``permitted`` (seat, doc_id) is given (no table permits
    all, an empty one nothing); one without passages doc_not_held; a quote that one passage contains is verified, with the first
    passage in source order; else quote_not_found. ``tier`` is own where the
    (seat, doc_id) is in ``own``, else read, for verified ones. A null quote
    counts as empty, a null doc_id as invented.

    Quotes are matched once per (doc_id, folded quote), within the document's
    passages, and by fingerprints in documents of very many.
    """
    q = cited.withColumn("form", verify_fold(F.coalesce("quote", F.lit(""))))
    long = q.where(F.char_length("form") >= least).select("doc_id", "form").distinct().withColumn("q_id", F.xxhash64("doc_id", "form"))
    p = passages.where(F.col("text").isNotNull())
    pairs = containing(long.withColumnRenamed("form", "body"), p.select(F.col("passage_seq").alias("p_id"), "doc_id", verify_fold(F.col("text")).alias("body")))
    at = pairs.join(p.select(F.col("passage_seq").alias("p_id"), "passage_id", "ord"), "p_id").groupBy("q_id").agg(F.min_by("passage_id", F.struct("ord", "p_id")).alias("passage_id"))
    hits = long.join(at, "q_id").select("doc_id", "form", "passage_id")
    known = docs.select("doc_id", F.lit(True).alias("known")).distinct()
    held = passages.select("doc_id", F.lit(True).alias("held")).distinct()
    out = q.join(hits, ["doc_id", "form"], "left").join(known, "doc_id", "left").join(held, "doc_id", "left")
    if permitted is None:
        out = out.withColumn("allowed", F.lit(True))
    else:
        out = out.join(permitted.select("seat", "doc_id", F.lit(True).alias("allowed")).distinct(), ["seat", "doc_id"], "left")
    status = F.when(F.char_length("form") < least, "too_short").when(F.col("known").isNull(), "invented").when(F.col("allowed").isNull(), "out_of_scope").when(F.col("held").isNull(), "doc_not_held").when(F.col("passage_id").isNotNull(), "verified").otherwise("quote_not_found")
    out = out.withColumn("status", status)
    if own is None:
        tier = F.lit(None).cast("string")
    else:
        out = out.join(own.select(F.col("name").alias("seat"), "doc_id", F.lit(True).alias("is_own")).distinct(), ["seat", "doc_id"], "left")
        tier = F.when(F.col("status") == "verified", F.when(F.col("is_own"), "own").otherwise("read"))
    return out.select("claim_id", "run", "turn", "seat", "cit_no", "doc_id", "quote", "status", tier.alias("tier"), F.when(F.col("status") == "verified", F.col("passage_id")).alias("passage_id"))


def grounded(claimed: DataFrame, verified: DataFrame) -> DataFrame:
    """Per claim: grounded if it has citations and all verify, self_anchored if
    any verified one is own."""
    per = verified.groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("ok"), F.count_if((F.col("status") == "verified") & (F.col("tier") == "own")).alias("own"))
    out = claimed.select("claim_id", "run", "turn", "seat").join(per, "claim_id", "left").fillna(0, ["n", "ok", "own"])
    return out.select("claim_id", "run", "turn", "seat", F.col("n").alias("n_citations"), ((F.col("n") > 0) & (F.col("n") == F.col("ok"))).alias("grounded"), (F.col("own") > 0).alias("self_anchored"))


def report(verified: DataFrame, claimed: DataFrame, *by: str) -> DataFrame:
    """Counts and rates by seat or turn: citations by status, grounded claims,
    and the share of grounded claims that rest on own work; a rate over nothing
    is 0. ``claimed`` is what :func:`grounded` gives."""

    def rate(part: Column, whole: Column) -> Column:
        return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6)

    def n(*status: str) -> Column:
        return F.count_if(F.col("status").isin(*status))

    cites = verified.groupBy(*by).agg(F.count("*").alias("n_citations"), n("verified").alias("n_verified"), n("invented").alias("n_invented"), n("out_of_scope").alias("n_out_of_scope"), n("quote_not_found", "doc_not_held").alias("made_up"))
    made = claimed.groupBy(*by).agg(F.count("*").alias("n_claims"), F.count_if("grounded").alias("n_grounded"), F.count_if(F.col("grounded") & F.col("self_anchored")).alias("anchored"))
    same = [made[c].eqNullSafe(cites[c]) for c in by]
    both = made.join(cites, same, "left").select(*[made[c] for c in by], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_claims", "n_grounded", "anchored", "n_citations", "n_verified", "n_invented", "n_out_of_scope", "made_up")])
    return both.select(
        *by, "n_claims", "n_grounded", "n_citations", "n_verified", "n_invented", "n_out_of_scope",
        rate(F.col("made_up"), F.col("n_citations")).alias("fabrication"),
        rate(F.col("n_citations") - F.col("n_verified"), F.col("n_citations")).alias("ungrounded"),
        rate(F.col("anchored"), F.col("n_grounded")).alias("self_anchor"),
    )


def repair_text(verified: DataFrame) -> DataFrame:
    """(claim_id, n_failed, text): for each claim with citations that failed,
    what failed and how, in citation order; no new evidence is shown."""
    why = F.concat(F.lit("- citation "), F.col("cit_no"), F.lit(" of "), F.coalesce("doc_id", F.lit("no document")), F.lit(": "), F.col("status"))
    return verified.where("status <> 'verified'").groupBy("claim_id").agg(F.count("*").alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.struct("cit_no", why.alias("why")))).getField("why"), "\n").alias("text"))
