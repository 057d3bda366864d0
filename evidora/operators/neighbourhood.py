"""One-hop plans over a citation graph, given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first(frame: DataFrame, seat: str, n: int) -> DataFrame:
    order = Window.partitionBy(seat).orderBy(F.desc("n"), "work")
    return frame.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def plan(authored: DataFrame, cites: DataFrame, held: DataFrame, wrote: DataFrame | None = None, about: DataFrame | None = None, seat: str = "seat", reads: int = 120, anchors: int = 10, citing: int = 8, people: int = 8, each: int = 12, fields: int = 3, canon: int = 30) -> DataFrame:
    """(seat, work, node, n, new): works to acquire for each seat. ``authored``
    has (seat, work), ``cites`` (src, dst), ``held`` (work), ``wrote`` (work,
    author), ``about`` (work, topic).

    Nodes: authored; reads, the works its own cite at least twice, most cited
    first; collaborators, the most cited works, up to ``each``, of the
    ``people`` with whom it wrote most; cited_by, works that cite its most cited
    ones, up to ``citing`` an anchor; canon, the ``canon`` most cited works of
    its ``fields`` most frequent topics. A work has the first node it falls
    under; ``new`` if it isn't held.
    """
    own = authored.select(seat, "work").distinct()
    edges = cites.where("src <> dst").distinct()
    read = own.join(edges, own["work"] == edges["src"]).groupBy(seat, F.col("dst").alias("work")).agg(F.count("*").alias("n")).where("n >= 2")
    weight = edges.groupBy(F.col("dst").alias("work")).agg(F.count("*").alias("n"))
    top = _first(own.join(weight, "work"), seat, anchors).select(seat, F.col("work").alias("anchor"))

    def ranked(rows: DataFrame, by: str, most: int) -> DataFrame:
        """The most cited works of each (seat, ``by``)."""
        r = F.row_number().over(Window.partitionBy(seat, by).orderBy(F.desc("n"), "work"))
        weighed = rows.join(weight, "work", "left").fillna(0, ["n"])
        return weighed.withColumn("r", r).where(F.col("r") <= most).groupBy(seat, "work").agg(F.max("n").alias("n"))

    def often(rows: DataFrame, what: str, most: int) -> DataFrame:
        return rows.groupBy(seat, what).agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(Window.partitionBy(seat).orderBy(F.desc("k"), what))).where(F.col("r") <= most).select(seat, what)

    nodes = [("authored", own.withColumn("n", F.lit(0))), ("reads", _first(read, seat, reads))]
    if wrote is not None:
        by = wrote.select("work", "author").distinct()
        nodes.append(("collaborators", ranked(often(own.join(by, "work"), "author", people).join(by, "author").select(seat, "author", "work"), "author", each)))
    nodes.append(("cited_by", ranked(top.join(edges, F.col("anchor") == F.col("dst")).select(seat, "anchor", F.col("src").alias("work")), "anchor", citing)))
    if about is not None:
        on = about.select("work", "topic").distinct()
        nodes.append(("canon", ranked(often(own.join(on, "work"), "topic", fields).join(on, "topic").select(seat, "topic", "work"), "topic", canon)))
    rows = None
    for p, (name, d) in enumerate(nodes):
        one = d.select(seat, "work", F.lit(p).alias("p"), F.lit(name).alias("node"), F.col("n").cast("bigint").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy(seat, "work").agg(F.min_by(F.struct("node", "n"), "p").alias("x"))
    return best.join(held.select("work", F.lit(False).alias("new")).distinct(), "work", "left").select(seat, "work", F.col("x.node").alias("node"), F.col("x.n").alias("n"), F.coalesce("new", F.lit(True)).alias("new"))


def corroborated(candidates: DataFrame, known: DataFrame, anchors: DataFrame, seat: str = "seat", least: int = 2, most_authors: int = 30) -> DataFrame:
    """Adds to (seat, work, authors, topics) whether at least ``least`` authors
    are known to the seat, whether a topic is one of its anchors', and the first
    test a work fails; works of more than ``most_authors`` authors fail as
    consortia. ``known`` has (seat, author), ``anchors`` (seat, topic)."""
    c = candidates.select(seat, "work", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    shared = c.select(seat, "work", F.explode(F.array_distinct("authors")).alias("author")).join(known.select(seat, "author").distinct(), [seat, "author"]).groupBy(seat, "work").agg(F.count("*").alias("shared"))
    on_topic = c.select(seat, "work", F.explode("topics").alias("topic")).join(anchors.select(seat, "topic").distinct(), [seat, "topic"], "left_semi").select(seat, "work", F.lit(True).alias("on_topic")).distinct()
    out = c.join(shared, [seat, "work"], "left").join(on_topic, [seat, "work"], "left").fillna(0, ["shared"]).fillna(False, ["on_topic"])
    fails = F.when(F.size("authors") > most_authors, "consortium").when(F.col("shared") < least, "authors").when(~F.col("on_topic"), "topic")
    return out.select(seat, "work", "shared", "on_topic", fails.alias("fails"))
