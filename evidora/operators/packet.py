"""Evidence packets: stratified, capped, budgeted passage sets per seat.

A stratum is a greedy choice: in order, as long as a document's cap and the cap
in all allow it. That equals ranks within the document and then within the
seat, with what was taken before counted in; so a seat's candidates are rows of
one table, each stratum marks some of them, and all seats are built in one job.
A seat's candidates are bounded by its queries and their depths, not by the
collection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from evidora.functions.match import quoted
from evidora.operators.index import Index, match_search, neighbours, top
from evidora.session import cut


@dataclass(frozen=True)
class Budget:
    """How a packet is cut to size."""

    own_floor: int = 60
    per_query: int = 12
    max_passages: int = 260
    max_seeds: int = 200
    max_per_doc: int = 8
    min_docs: int = 10
    neighbours: int = 1
    examine_per_doc: int = 4
    max_examine_docs: int = 16

    @property
    def seeds(self) -> int:
        return min(self.max_seeds, self.max_passages)

    @property
    def deep(self) -> int:
        """How deep the search for a seat's own work, and for breadth, goes."""
        return 40 * self.per_query


def _seat() -> WindowSpec:
    return Window.partitionBy("seat")


def _doc() -> WindowSpec:
    return Window.partitionBy("seat", "doc_id")


def search_plan(asked: list[dict]) -> list[tuple[str, str]]:
    """Named expressions of the seats' searches. ``asked`` has seat, terms (the
    question's), focus (an expression or None) and queries; names are
    seat, kind, number, joined by a tab."""
    out = []
    for a in asked:
        question = " OR ".join(f'"{t}"' for t in a["terms"])
        if not question:
            raise ValueError(f"the question of {a['seat']} has no searchable terms")
        if a.get("focus"):
            out.append((f"{a['seat']}\tfocus\t0", a["focus"]))
        out.append((f"{a['seat']}\tquestion\t0", question))
        for i, q in enumerate(a["queries"]):
            out.append((f"{a['seat']}\tboth\t{i}", f"({question}) AND ({quoted(q)})"))
            out.append((f"{a['seat']}\tbare\t{i}", quoted(q)))
        out += [(f"{a['seat']}\tterm\t{i}", f'"{t}"') for i, t in enumerate(a["terms"])]
    return out


def ranked(index: Index, asked: list[dict], budget: Budget, excluded: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
    """(seat, kind, number, rank, passage_seq, doc_id, ord): the hits of every
    query of the plan, as deep as it is looked at, less those of documents
    (seat, doc_id) that the seat may not see."""
    hits = top(match_search(index, search_plan(asked)), "query", budget.deep)
    part = F.split("query", "\t")
    hits = hits.select(part[0].alias("seat"), part[1].alias("kind"), part[2].cast("int").alias("number"), "rank", "passage_seq")
    hits = hits.where((F.col("rank") <= budget.per_query) | F.col("kind").isin("focus", "question"))
    hits = hits.join(index.places.select("passage_seq", "doc_id", "ord"), "passage_seq")
    if excluded is not None:
        hits = hits.join(excluded.select("seat", "doc_id").distinct(), ["seat", "doc_id"], "left_anti")
    if restricted is not None:
        hits = hits.join(restricted.select("seat", "doc_id").distinct(), ["seat", "doc_id"], "left_semi")
    return hits


def take(t: DataFrame, number: int, order: str, doc_cap: Column | int, cap: Column) -> DataFrame:
    """Marks as stratum ``number`` the rows not yet taken whose ``order`` isn't
    null, in that order, at most ``doc_cap`` a document and ``cap`` a seat, both
    with what was taken before, the column ``before``."""
    t = t.withColumn("held", F.count("stratum").over(_doc())).withColumn("before", F.count("stratum").over(_seat()))
    free = F.col("stratum").isNull() & F.col(order).isNotNull()
    t = t.withColumn("nth", F.row_number().over(_doc().orderBy((~free).cast("int"), order, "passage_seq")) + F.col("held")).withColumn("fits", free & (F.col("nth") <= doc_cap))
    t = t.withColumn("k", F.row_number().over(_seat().orderBy((~F.col("fits")).cast("int"), order, "passage_seq")) + F.col("before")).withColumn("now", F.col("fits") & (F.col("k") <= cap))
    t = t.withColumn("stratum", F.when(F.col("now"), number).otherwise(F.col("stratum"))).withColumn("pick", F.when(F.col("now"), F.col("k").cast("bigint")).otherwise(F.col("pick")))
    return t.drop("held", "before", "nth", "fits", "k", "now")


def widen(t: DataFrame, number: int, order: str, budget: Budget) -> DataFrame:
    """One passage, the first in ``order``, from documents not yet held, until
    the seat has ``min_docs`` documents or its seeds are full."""
    t = t.withColumn("held", F.count("stratum").over(_doc())).withColumn("before", F.count("stratum").over(_seat()))
    t = t.withColumn("n_docs", F.size(F.collect_set(F.when(F.col("held") > 0, F.col("doc_id"))).over(_seat())))
    first = (F.col("held") == 0) & F.col(order).isNotNull() & (F.row_number().over(_doc().orderBy(F.col(order).isNull().cast("int"), order, "passage_seq")) == 1)
    t = t.withColumn("first", first).withColumn("k", F.row_number().over(_seat().orderBy((~F.col("first")).cast("int"), order, "passage_seq")))
    room = F.least(F.lit(budget.min_docs) - F.col("n_docs"), F.lit(budget.seeds) - F.col("before"))
    t = t.withColumn("now", F.col("first") & (F.col("k") <= room))
    t = t.withColumn("stratum", F.when(F.col("now"), number).otherwise(F.col("stratum"))).withColumn("pick", F.when(F.col("now"), (F.col("k") + F.col("before")).cast("bigint")).otherwise(F.col("pick")))
    return t.drop("held", "before", "n_docs", "first", "k", "now")


def _place(*parts: Column | int) -> Column:
    """An order of several numbers below 10,000 as one."""
    out = F.lit(0).cast("bigint")
    for p in parts:
        out = out * 10_000 + (F.lit(p) if isinstance(p, int) else p)
    return out


def seeds(hits: DataFrame, own: DataFrame, asked: DataFrame, passages: DataFrame, budget: Budget) -> DataFrame:
    """(seat, passage_seq, doc_id, ord, stratum, pick): the ranked part of each
    packet. ``hits`` is that of :func:`ranked`, ``own`` (seat, doc_id), ``asked``
    (seat, terms). Strata: 0 precision (focus), 1 own work, 2 the open field,
    3 coverage of the question's terms that no text chosen holds, 4 breadth,
    5 what fills the rest under twice the cap of a document."""
    b = budget
    hits = cut(hits.join(own.select("seat", "doc_id", F.lit(True).alias("own")).distinct(), ["seat", "doc_id"], "left").withColumn("own", F.coalesce("own", F.lit(False))))
    owners = own.select("seat").distinct().withColumn("owner", F.lit(True))
    kind, rank, number = F.col("kind"), F.col("rank"), F.col("number")
    near = rank <= b.per_query
    # In a round robin the first hits of all queries come before the second.
    query = F.when(kind == "question", 0).when(kind == "both", 1 + number).when(kind == "bare", 1000 + number)
    o0 = F.when((kind == "focus") & near, rank)
    o1 = F.when(F.col("own") & kind.isin("focus", "question"), _place(rank, F.when(kind == "focus", 0).otherwise(1)))
    o2 = F.when(kind.isin("question", "both", "bare") & near, _place(rank, query))
    seen = F.when((kind == "focus") & near, _place(0, 0, rank)).when(F.col("owner") & kind.isin("focus", "question") & F.lit(b.own_floor > 0), _place(1, F.when(kind == "focus", 0).otherwise(1), rank)).when(kind.isin("question", "both", "bare") & near, _place(2, query, rank))
    deep = F.when(kind == "question", rank)
    t = hits.where("kind <> 'term'").join(owners, "seat", "left").groupBy("seat", "passage_seq", "doc_id", "ord").agg(F.min(o0).alias("o0"), F.min(o1).alias("o1"), F.min(o2).alias("o2"), F.min(seen).alias("seen"), F.min(deep).alias("deep"))
    t = t.repartition("seat").withColumn("stratum", F.lit(None).cast("int")).withColumn("pick", F.lit(None).cast("bigint"))
    t = take(t, 0, "o0", b.max_per_doc, F.lit(min(b.seeds, max(8, b.seeds // 4))))
    if b.own_floor > 0:
        t = take(t, 1, "o1", b.max_per_doc, F.least(F.lit(b.own_floor) + F.col("before"), F.lit(b.seeds)))
    t = cut(take(t, 2, "o2", b.max_per_doc, F.lit(max(b.own_floor, b.seeds - min(max(4, b.seeds // 5), 40)))))
    # Coverage: the question's terms that occur in no chosen text.
    chosen = t.where("stratum is not null").select("seat", "passage_seq")
    texts = passages.join(chosen.select("passage_seq").distinct(), "passage_seq", "left_semi").groupBy("passage_seq").agg(F.lower(F.first("text")).alias("text")).join(chosen, "passage_seq")
    wanted = asked.select("seat", F.posexplode("terms").alias("number", "term"))
    held = texts.join(wanted, "seat").where(F.col("text").contains(F.col("term"))).select("seat", "number").distinct()
    missing = cut(wanted.join(held, ["seat", "number"], "left_anti").select("seat", "number"))
    more = hits.where("kind = 'term'").join(missing, ["seat", "number"], "left_semi").groupBy("seat", "passage_seq", "doc_id", "ord").agg(F.min(_place(number, rank)).alias("o3"))
    t = t.drop("o0", "o1", "o2").join(more, ["seat", "passage_seq", "doc_id", "ord"], "full_outer").repartition("seat").withColumn("seen", F.coalesce("seen", F.col("o3") + F.lit(3 * 10**8)))
    t = take(t, 3, "o3", max(2, b.max_per_doc // 2), F.lit(b.seeds))
    if b.min_docs:
        t = widen(t, 4, "seen", b)
        # The deep draw, where the pool had too few documents.
        enough = F.size(F.collect_set(F.when(F.col("stratum").isNotNull(), F.col("doc_id"))).over(_seat())) >= b.min_docs
        t = t.withColumn("deep", F.when(~enough, F.col("deep")))
        t = widen(t, 4, "deep", b).withColumn("seen", F.coalesce("seen", F.col("deep") + F.lit(5 * 10**8)))
    t = take(t, 5, "seen", 2 * b.max_per_doc, F.lit(b.seeds))
    return t.where("stratum is not null").select("seat", "passage_seq", "doc_id", "ord", "stratum", "pick")


def context(chosen: DataFrame, places: DataFrame, budget: Budget, excluded: DataFrame | None = None) -> DataFrame:
    """Passages beside the seeds: documents in the order in which they were
    first picked, passages in source order, until the packet holds
    ``max_passages``; seeds are never displaced. Stratum 6."""
    near = neighbours(chosen.select("seat", "doc_id", "ord"), places, budget.neighbours).select("seat", "doc_id", F.col("near_seq").alias("passage_seq"), F.col("near_ord").alias("ord")).distinct()
    near = near.join(chosen.select("seat", "passage_seq"), ["seat", "passage_seq"], "left_anti")
    if excluded is not None:
        near = near.join(excluded.select("seat", "doc_id").distinct(), ["seat", "doc_id"], "left_anti")
    near = near.join(chosen.groupBy("seat", "doc_id").agg(F.min("pick").alias("first")), ["seat", "doc_id"]).join(chosen.groupBy("seat").agg(F.count("*").alias("n")), "seat")
    near = near.withColumn("pick", F.row_number().over(_seat().orderBy("first", "ord", "passage_seq")) + F.col("n")).where(F.col("pick") <= F.greatest(F.lit(budget.max_passages), F.col("n")))
    return near.select("seat", "passage_seq", "doc_id", "ord", F.lit(6).alias("stratum"), F.col("pick").cast("bigint").alias("pick"))


def examination(examine: DataFrame, quotes: DataFrame, passages: DataFrame, budget: Budget, excluded: DataFrame | None = None) -> DataFrame:
    """(seat, doc_id, passage_seq, ord): what each seat is shown of documents
    (seat, doc_id, place) that others cited, the first ``max_examine_docs``: the
    passages that hold a quote of ``quotes`` (doc_id, quote) and those beside
    them, at most ``examine_per_doc`` unless more hold one; the document's start
    where none does."""
    first = F.row_number().over(Window.partitionBy("seat").orderBy("place", "doc_id"))
    asked = examine.withColumn("_n", first).where(F.col("_n") <= budget.max_examine_docs).select("seat", "doc_id")
    if excluded is not None:
        asked = asked.join(excluded.select("seat", "doc_id").distinct(), ["seat", "doc_id"], "left_anti")
    p = passages.select("passage_seq", "doc_id", "ord", "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["passage_seq"])
    at = p.join(quotes.where("quote <> ''").select("doc_id", "quote").distinct(), "doc_id").where(F.col("text").contains(F.col("quote"))).select("doc_id", "ord", "passage_seq").distinct()
    places = cut(p.select("passage_seq", "doc_id", "ord"))
    beside = neighbours(at.select("doc_id", "ord"), places, 1).select("doc_id", F.col("near_seq").alias("passage_seq"), F.col("near_ord").alias("ord")).distinct()
    beside = beside.join(at.select("doc_id", "passage_seq", F.lit(True).alias("anchor")), ["doc_id", "passage_seq"], "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    per = Window.partitionBy("doc_id")
    picked = beside.withColumn("_a", F.count_if("anchor").over(per)).withColumn("_n", F.row_number().over(per.orderBy(F.desc("anchor"), "ord", "passage_seq"))).where(F.col("_n") <= F.greatest(F.lit(budget.examine_per_doc), F.col("_a")))
    start = places.join(at.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_n", F.row_number().over(per.orderBy("ord", "passage_seq"))).where(F.col("_n") <= budget.examine_per_doc)
    shown = picked.select("doc_id", "passage_seq", "ord").unionByName(start.select("doc_id", "passage_seq", "ord"))
    return asked.join(shown, "doc_id")


def build(index: Index, passages: DataFrame, asked: list[dict], own: DataFrame, examine: DataFrame | None = None, quotes: DataFrame | None = None, excluded: DataFrame | None = None, restricted: DataFrame | None = None, budget: Budget = Budget()) -> DataFrame:
    """(seat, passage_seq, doc_id, ord, stratum, pick, is_own, is_examined): the
    packets of all seats. Seeds (strata 0 to 5), context (6), and, outside the
    budget, what is under examination (7, without a pick). ``is_examined`` holds
    for a document that is handed over to be checked."""
    spark = index.spark
    terms = spark.createDataFrame([(a["seat"], a["terms"]) for a in asked], "seat string, terms array<string>")
    chosen = cut(seeds(ranked(index, asked, budget, excluded, restricted), own, terms, passages, budget))
    whole = chosen
    if budget.neighbours:
        whole = whole.unionByName(context(chosen, index.places, budget, excluded))
    shown = None
    if examine is not None and quotes is not None:
        shown = cut(examination(examine, quotes, passages, budget, excluded))
        new = shown.join(whole.select("seat", "passage_seq"), ["seat", "passage_seq"], "left_anti")
        whole = whole.unionByName(new.select("seat", "passage_seq", "doc_id", "ord", F.lit(7).alias("stratum"), F.lit(None).cast("bigint").alias("pick")))
    whole = whole.join(own.select("seat", "doc_id", F.lit(True).alias("is_own")).distinct(), ["seat", "doc_id"], "left")
    if shown is not None:
        whole = whole.join(shown.select("seat", "doc_id", F.lit(True).alias("is_examined")).distinct(), ["seat", "doc_id"], "left")
    else:
        whole = whole.withColumn("is_examined", F.lit(None).cast("boolean"))
    return whole.select("seat", "passage_seq", "doc_id", "ord", "stratum", "pick", F.coalesce("is_own", F.lit(False)).alias("is_own"), F.coalesce("is_examined", F.lit(False)).alias("is_examined"))


def derived(packets: DataFrame, seats: DataFrame) -> DataFrame:
    """(seat, n_permitted, n_evidence, n_examined, n_own): how many documents a
    seat may cite, has as evidence (permitted and not under examination), is to
    check, and has of its own; a seat without any counts 0."""
    docs = packets.groupBy("seat", "doc_id").agg(F.bool_or("is_examined").alias("x"), F.bool_or("is_own").alias("o"))
    per = docs.groupBy("seat").agg(F.count("*").alias("n_permitted"), F.count_if(~F.col("x")).alias("n_evidence"), F.count_if("x").alias("n_examined"), F.count_if("o").alias("n_own"))
    return seats.select("seat").distinct().join(per, "seat", "left").fillna(0)


def audit(chosen: DataFrame, asked: DataFrame, own: DataFrame, seat: str = "seat") -> DataFrame:
    """One row for each seat of ``asked`` (seat, terms): sizes, own documents,
    the largest document's share, the share of question terms that occur
    anywhere in the texts (as substrings), and whether the packet is thin. An
    empty packet is thin."""
    per = chosen.groupBy(seat, "doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).join(own.withColumn("is_own", F.lit(1)), [seat, "doc_id"], "left")
    sizes = per.groupBy(seat).agg(F.sum("n").alias("n_passages"), F.count("*").alias("n_docs"), F.count("is_own").alias("own_docs"), F.sum("c").alias("n_chars"), (F.max("n") / F.sum("n")).alias("share"))
    terms = asked.select(seat, F.explode("terms").alias("term"))
    held = chosen.select(seat, F.lower("text").alias("t")).join(terms, seat).where(F.col("t").contains(F.col("term"))).select(seat, "term").distinct().withColumn("in", F.lit(1))
    cover = terms.join(held, [seat, "term"], "left").groupBy(seat).agg((F.count("in") / F.count("*")).alias("cover"))
    out = asked.select(seat).join(sizes, seat, "left").join(cover, seat, "left").fillna(0)
    thin = (F.col("n_passages") == 0) | (F.col("n_docs") < 8) | (F.col("cover") < 0.55) | (F.col("share") > 0.45)
    return out.select(seat, "n_passages", "n_docs", "own_docs", "n_chars", F.round("share", 6).alias("max_doc_share"), F.round("cover", 6).alias("coverage"), thin.alias("thin"))
