"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.session import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``member`` and ``root`` (the smallest member) for every vertex of an edge.

    Large-star and small-star rounds, each an aggregation and an equi-join on
    the vertex, cut to the checkpoint folder; the number of rounds grows with
    the logarithm of the longest path. Only a count and a checksum of the edges
    reach the driver. Null ends and loops are left out; repeated edges count
    once; an empty edge table gives no rows.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    for _ in range(most_rounds if seen[0] else 0):
        # Large star: each vertex hands its larger neighbours its smallest one.
        round_trip = now.union(now.select("b", "a"))
        least = round_trip.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = round_trip.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each vertex and its smaller neighbours point to the smallest.
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        before, seen = seen, _state(now)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("member"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("member"), "root").distinct())


def class_pairs(members: DataFrame, key: str, root: str, all_pairs_up_to: int = 64) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of the records of each class: all
    pairs of a class of up to ``all_pairs_up_to`` records; of a larger one the
    pairs with its first record, which name the same class."""
    one = members.select(F.col(key).alias("k"), F.col(root).alias("r")).distinct()
    size = one.groupBy("r").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1")
    small = one.join(size.where(F.col("n") <= all_pairs_up_to), "r").groupBy("r").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    a = small.select("ks", F.posexplode("ks").alias("i", "key_a"))
    pairs = a.select("key_a", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("key_b"))
    large = one.join(size.where(F.col("n") > all_pairs_up_to), "r").where("k <> first").select(F.col("first").alias("key_a"), F.col("k").alias("key_b"))
    return pairs.unionByName(large)
