"""Measures of difference between seats. Seat, turn, run and permutation are
columns; pairs are formed of the seats of one turn, whose number is that of
chairs at a table, never of documents or terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(members: DataFrame, group: list[str], one: str) -> DataFrame:
    """Pairs (group, a, b), a < b, of the members of each group."""
    m = members.select(*group, one).distinct()
    return m.select(*group, F.col(one).alias("a")).join(m.select(*group, F.col(one).alias("b")), group).where("a < b")


def jaccard_pairs(sets: DataFrame, group: list[str], one: str, item: str) -> DataFrame:
    """(group, a, b, shared, distance): Jaccard distance of two members' item
    sets; every pair of members with items, also with none in common."""
    s = sets.select(*group, one, item).distinct()
    size = s.groupBy(*group, one).agg(F.count("*").alias("n"))
    both = s.select(*group, F.col(one).alias("a"), item).join(s.select(*group, F.col(one).alias("b"), item), [*group, item]).where("a < b").groupBy(*group, "a", "b").agg(F.count("*").alias("shared"))
    out = pairs(size, group, one).join(both, [*group, "a", "b"], "left").fillna(0, ["shared"])
    out = out.join(size.select(*group, F.col(one).alias("a"), F.col("n").alias("na")), [*group, "a"]).join(size.select(*group, F.col(one).alias("b"), F.col("n").alias("nb")), [*group, "b"])
    return out.select(*group, "a", "b", "shared", (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("distance"))


def overlap_coefficients(sets: DataFrame, one: str, item: str) -> DataFrame:
    """(seat_a, seat_b, shared, overlap): shared items over the smaller set."""
    s = sets.select(one, item).distinct()
    size = s.groupBy(one).agg(F.count("*").alias("n"))
    both = s.select(F.col(one).alias("a"), item).join(s.select(F.col(one).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(size.select(F.col(one).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(one).alias("b"), F.col("n").alias("nb")), "b")
    return out.select(F.col("a").alias("seat_a"), F.col("b").alias("seat_b"), "shared", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))


def js_pairs(counts: DataFrame, group: list[str], one: str) -> DataFrame:
    """(group, a, b, divergence): Jensen-Shannon divergence, base 2, of two
    members' term counts (group, one, term, n). A term that one side lacks adds
    half its share, so only shared terms are joined."""
    total = Window.partitionBy(*group, one)
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    x = p.select(*group, F.col(one).alias("a"), "term", F.col("p").alias("pa"))
    y = p.select(*group, F.col(one).alias("b"), "term", F.col("p").alias("pb"))
    m = (F.col("pa") + F.col("pb")) / 2
    part = 0.5 * F.col("pa") * F.log2(F.col("pa") / m) + 0.5 * F.col("pb") * F.log2(F.col("pb") / m) - 0.5 * F.col("pa") - 0.5 * F.col("pb")
    shared = x.join(y, [*group, "term"]).where("a < b").groupBy(*group, "a", "b").agg(F.sum(part).alias("part"))
    return pairs(counts, group, one).join(shared, [*group, "a", "b"], "left").select(*group, "a", "b", F.greatest(F.lit(0.0), 1 + F.coalesce("part", F.lit(0.0))).alias("divergence"))


def tfidf(counts: DataFrame, group: list[str], one: str) -> DataFrame:
    """(group, one, term, w): tf-idf fitted within each group, tf 1 + ln n, idf
    ln((1 + N) / (1 + df)) + 1, rows of length 1. A member without terms has no
    row; N counts members with terms."""
    n = counts.select(*group, one).distinct().groupBy(*group).agg(F.count("*").alias("members"))
    df = counts.groupBy(*group, "term").agg(F.count("*").alias("df"))
    w = counts.join(df, [*group, "term"]).join(n, group).withColumn("w", (1 + F.log("n")) * (F.log((1 + F.col("members")) / (1 + F.col("df"))) + 1))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*group, one)))).select(*group, one, "term", "w")


def cosine_pairs(weights: DataFrame, group: list[str], one: str) -> DataFrame:
    """(group, a, b, cosine) of every pair of members with terms, a < b."""
    x = weights.select(*group, F.col(one).alias("a"), "term", F.col("w").alias("wa"))
    y = weights.select(*group, F.col(one).alias("b"), "term", F.col("w").alias("wb"))
    dot = x.join(y, [*group, "term"]).where("a < b").groupBy(*group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs(weights, group, one).join(dot, [*group, "a", "b"], "left").fillna(0.0, ["cosine"])


def vendi(cosines: DataFrame, members: DataFrame, group: list[str], one: str) -> DataFrame:
    """(group, m, vs2, dispersion): the order-2 Vendi score as (trace K)^2 over
    the sum of squared entries, and 1 minus the mean cosine (0 for one member)."""
    m = members.select(*group, one).distinct().groupBy(*group).agg(F.count("*").alias("m"))
    sums = cosines.groupBy(*group).agg(F.sum(F.col("cosine") * F.col("cosine")).alias("sq"), F.avg("cosine").alias("mean"))
    out = m.join(sums, group, "left")
    return out.select(*group, "m", (F.col("m") * F.col("m") / (F.col("m") + 2 * F.coalesce("sq", F.lit(0.0)))).alias("vs2"), F.when(F.col("m") < 2, 0.0).otherwise(1 - F.col("mean")).alias("dispersion"))


def truncated_vendi(kernel_rows: DataFrame, group: list[str], top: int = 4) -> DataFrame:
    """(group, vendi): exp entropy of the ``top`` largest eigenvalues of each
    group's kernel, given as rows (group, a, b, k) of both triangles and the
    diagonal. Needs eigenvalues, hence a grouped Python function; a kernel has
    as many rows as a group has members."""
    import numpy as np
    import pandas as pd

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        k = frame.pivot(index="a", columns="b", values="k").fillna(0.0).clip(-1, 1).to_numpy()
        lam = np.linalg.eigvalsh(k / len(k))
        lam = np.sort(lam[lam > 1e-12])[::-1][:top]
        lam = lam / lam.sum() if len(lam) else lam
        out = {g: frame[g].iloc[0] for g in group} | {"vendi": float(np.exp(-(lam * np.log(lam)).sum())) if len(lam) else 0.0}
        return pd.DataFrame([out])

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kernel_rows.select(*group).schema) + ", vendi double"
    return kernel_rows.groupBy(*group).applyInPandas(one, spec)


def entropy(values: DataFrame, group: list[str], value: str, kinds: int) -> DataFrame:
    """(group, n, k, entropy, modal): natural-log entropy of the values with the
    Miller-Madow correction, over ln ``kinds``, clipped to [0, 1]; and 1 minus
    the largest share. Null values don't count."""
    c = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    whole = c.groupBy(*group).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.max("c").alias("most"))
    h = F.log("n") - F.col("clogc") / F.col("n") + (F.col("k") - 1) / (2 * F.col("n"))
    import math

    return whole.select(*group, "n", "k", F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / math.log(kinds))).alias("entropy"), (1 - F.col("most") / F.col("n")).alias("modal"))


def redeal(sets: DataFrame, group: list[str], one: str, item: str, times: int) -> DataFrame:
    """(perm, group, one, item): the items of each group dealt anew to its
    members, ``times`` times, each member getting as many as it had, in the
    order of an md5; an item dealt twice to a member counts once. All
    permutations are rows of one job."""
    s = sets.select(*group, one, item).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("perm"))
    mixed = Window.partitionBy("perm", *group).orderBy(F.md5(F.concat_ws("|", "perm", *group, one, item)), one, item)
    place = Window.partitionBy("perm", *group).orderBy(one, item)
    dealt = s.withColumn("slot", F.row_number().over(mixed)).select("perm", *group, item, "slot")
    seats = s.withColumn("slot", F.row_number().over(place)).select("perm", *group, one, "slot")
    return seats.join(dealt, ["perm", *group, "slot"]).select("perm", *group, one, item).distinct()


def separation(observed: Column, null: Column) -> Column:
    return F.when(null >= 1, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (observed - null) / (1 - null))))


def monitor(series: DataFrame, run: str, turn: str, value: str, bound: float = 19.0) -> DataFrame:
    """(run, llr, fired, history): a run's sequential test over its turns. A
    value adds 4 ln((1 - x) / x), a null nothing; at plus or minus ln ``bound``
    it fires and starts again from 0. The history holds the sum before a reset."""
    import math

    edge = math.log(bound)
    xs = F.transform(F.sort_array(F.collect_list(F.struct(turn, F.col(value).alias("v")))), lambda s: s["v"])
    start = F.struct(F.lit(0.0).alias("llr"), F.lit(0).alias("fired"), F.array().cast("array<double>").alias("history"))

    def step(s: Column, x: Column) -> Column:
        clipped = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), x))
        now = F.when(x.isNull(), s["llr"]).otherwise(s["llr"] + 4 * F.log((1 - clipped) / clipped))
        fires = F.abs(now) >= edge
        return F.struct(F.when(fires, 0.0).otherwise(now).alias("llr"), (s["fired"] + fires.cast("int")).alias("fired"), F.concat(s["history"], F.array(F.round(now, 6))).alias("history"))

    out = series.groupBy(run).agg(xs.alias("xs")).select(run, F.aggregate("xs", start, step).alias("s"))
    return out.select(run, F.round("s.llr", 6).alias("llr"), F.col("s.fired").alias("fired"), F.col("s.history").alias("history"))


def exclusive(sets: DataFrame, group: list[str], one: str, item: str) -> DataFrame:
    """(group, one, n_only): how many items a member has that no other in its
    group has; members without such items are left out."""
    s = sets.select(*group, one, item).distinct()
    alone = s.groupBy(*group, item).agg(F.count("*").alias("n"), F.min(one).alias(one)).where("n = 1")
    return alone.groupBy(*group, one).agg(F.count("*").alias("n_only"))


def contestedness(texts: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """(key, marks, words, score): marker substrings (overlapping ones count
    each) per 1000 words, as 1 - exp(-density / 2)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    marks = sum(((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m) for m in markers), F.lit(0.0))
    words = F.size(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != ""))
    per = texts.select(key, marks.alias("marks"), words.alias("words")).groupBy(key).agg(F.sum("marks").alias("marks"), F.sum("words").alias("words"))
    return per.select(key, F.col("marks").cast("bigint").alias("marks"), "words", F.round(F.when(F.col("words") > 0, 1 - F.exp(-0.5 * 1000 * F.col("marks") / F.col("words"))).otherwise(0.0), 6).alias("score"))
