"""The band that a panel's first turn sets, and each turn's standing in it.

Everything that doesn't hang on earlier turns is Column arithmetic; the
sequential test and the number of rungs already used are folded over a run's
turns, of which there are as many as the run has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floors, ceilings and thresholds of the measures.
EVIDENCE_FLOOR, NOVELTY_FLOOR, FIDELITY_FLOOR, LEAST_PARTICIPATION = 0.15, 0.25, 0.25, 0.6
POSITIONS_FLOORS = {"tfidf-cosine": 0.20, "sentence-transformers:all-MiniLM-L6-v2": 0.023}
CEILING, CEILING_SLACK = 0.35, 1.20
LEAST_CLAIMS, AGREED, DISPUTED = 4, 0.20, 0.35
LADDER = (
    "route_to_most_distant_peers", "withhold_the_consensus_evidence", "reanchor_to_own_corpus", "anonymize_the_table",
    "isolate_from_cross_talk", "assign_dissent_to_the_evidenced_minority", "stop_deliberating_and_report", "declare_collapse",
)


def bands(snapshots: DataFrame, rho: Column | float, backend: str = "tfidf-cosine") -> DataFrame:
    """(run, reference_turn, floor_evidence, floor_positions, ceiling_positions,
    ref_evidence, ref_positions, calibrated): fixed by each run's first turn.
    ``snapshots`` has (run, turn, evidence, positions); ``rho`` is the share of
    the first turn's separation that a later one should keep. A backend without
    a calibrated floor gets no absolute floor for positions."""
    rho = F.lit(rho) if isinstance(rho, float) else rho
    first = snapshots.groupBy("run").agg(F.min("turn").alias("reference_turn"), *[F.min_by(F.coalesce(c, F.lit(0.0)), "turn").alias(f"ref_{c}") for c in ("evidence", "positions")])
    floor = F.lit(POSITIONS_FLOORS.get(backend, 0.0))
    return first.select(
        "run", "reference_turn", F.greatest(F.lit(EVIDENCE_FLOOR), rho * F.col("ref_evidence")).alias("floor_evidence"), F.greatest(floor, rho * F.col("ref_positions")).alias("floor_positions"),
        F.least(F.lit(1.0), F.greatest(F.lit(CEILING), CEILING_SLACK * F.col("ref_positions"))).alias("ceiling_positions"), "ref_evidence", "ref_positions", F.lit(backend in POSITIONS_FLOORS).alias("calibrated"),
    )


def retained() -> Column:
    """The least share of the first turn's separation that an informative axis
    keeps, at most 1; null where no axis can be measured."""
    each = [F.when(F.col(f"{a}_ok") & (F.col(f"ref_{a}") > 0), F.least(F.lit(1.0), F.col(a) / F.col(f"ref_{a}"))) for a in ("evidence", "positions")]
    return F.least(*each)


def retention(snapshots: DataFrame, banded: DataFrame) -> DataFrame:
    """(run, turn, retained) of the turns after the first."""
    return snapshots.join(banded, "run").where(F.col("turn") > F.col("reference_turn")).select("run", "turn", retained().alias("retained"))


def standing(snapshots: DataFrame, banded: DataFrame, bound: float = 19.0) -> DataFrame:
    """(run, turn, verdict, move, skipped, n_breached, llr, fired).

    ``snapshots`` has, of each turn: n_claims, n_seats, n_expected, evidence,
    evidence_ok, positions, positions_ok, dissent, n_stances, novelty, lost (home
    seats below the floor of fidelity), n_consensus, has_minority. In this
    order: too few claims, seats or participants: undetermined; the first turn:
    reference; fidelity lost; above the ceiling: scattered; agreement on
    disjoint evidence: corroboration; dispute over shared evidence: contested;
    nothing breached: healthy; the test not fired: collapsing, watched; else the
    next rung of the ladder, skipping one that can't bite. Turns count for the
    test from the second on."""
    s = snapshots.join(banded, "run")
    evidence_low = F.col("evidence_ok") & (F.col("evidence") < F.col("floor_evidence"))
    positions_low = F.col("positions_ok") & (F.col("positions") < F.col("floor_positions"))
    stale = F.coalesce(F.col("novelty") < NOVELTY_FLOOR, F.lit(False))
    breached = evidence_low.cast("int") + positions_low.cast("int") + stale.cast("int")
    early = F.when((F.col("n_claims") < LEAST_CLAIMS) | (F.col("n_seats") < 2) | (F.col("n_seats") < LEAST_PARTICIPATION * F.col("n_expected")), "undetermined").when(F.col("turn") == F.col("reference_turn"), "reference_turn")
    later = (
        F.when(F.col("lost") > 0, "fidelity_lost")
        .when(F.col("positions_ok") & (F.col("positions") > F.col("ceiling_positions")), "scattered")
        .when(F.col("evidence_ok") & (F.col("evidence") >= F.col("floor_evidence")) & (F.col("dissent") < AGREED) & (F.col("n_stances") > 0), "independent_corroboration")
        .when(evidence_low & (F.col("dissent") >= DISPUTED), "contested_evidence")
        .when(breached == 0, "healthy")
    )
    row = F.struct("turn", early.alias("early"), later.alias("later"), breached.alias("n_breached"), retained().alias("x"), (F.col("n_consensus") > 0).alias("shared"), F.col("has_minority").alias("minority"))
    edge, top = math.log(bound), len(LADDER) - 1
    rung = F.array(*[F.lit(m) for m in LADDER])
    out = "array<struct<turn:int,verdict:string,move:string,skipped:int,n_breached:int,llr:double,fired:boolean>>"
    start = F.struct(F.lit(0.0).alias("llr"), F.lit(0).alias("used"), F.array().cast(out).alias("out"))

    def step(state: Column, r: Column) -> Column:
        x = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), r["x"]))
        raw = F.when(r["early"].isNotNull() | r["x"].isNull(), state["llr"]).otherwise(state["llr"] + 4 * F.log((1 - x) / x))
        fires = F.abs(raw) >= edge
        acts = r["early"].isNull() & r["later"].isNull() & (raw >= edge)
        first = F.least(state["used"], F.lit(top))
        barred = acts & (((first == 1) & ~r["shared"]) | ((first == 5) & ~r["minority"]))
        second = F.least(state["used"] + 1, F.lit(top))
        place = F.when(barred, second).otherwise(first)
        move = F.when(acts, F.element_at(rung, place + 1)).otherwise("none")
        verdict = F.coalesce(r["early"], r["later"], F.when(acts & (place >= top - 1), "collapsed").otherwise("collapsing"))
        new = F.struct(r["turn"].alias("turn"), verdict.alias("verdict"), move.alias("move"), barred.cast("int").alias("skipped"), r["n_breached"].alias("n_breached"), F.round(raw, 6).alias("llr"), fires.alias("fired"))
        used = state["used"] + F.when(acts, 1 + barred.cast("int")).otherwise(0)
        return F.struct(F.when(fires, 0.0).otherwise(raw).alias("llr"), used.alias("used"), F.concat(state["out"], F.array(new)).alias("out"))

    turns = s.groupBy("run").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return turns.select("run", F.explode(F.aggregate("rows", start, step, lambda st: st["out"])).alias("r")).select("run", "r.*")


def controls(judged: DataFrame) -> DataFrame:
    """(run, turn, peers, withhold, own_only, anonymous, isolated, dissent, stop):
    what a turn's move changes in the retrieval of the next."""
    m = F.col("move")
    names = ("peers", "withhold", "own_only", "anonymous", "isolated", "dissent")
    return judged.select("run", "turn", *[(m == LADDER[i]).alias(n) for i, n in enumerate(names)], m.isin(*LADDER[6:]).alias("stop"))


def fixed_again(rosters: DataFrame) -> DataFrame:
    """(run, turn, reference_turn, refixed): the turn whose band holds for a
    turn. ``rosters`` has (run, turn, seat); a change of the roster fixes the
    band anew."""
    per = rosters.where("run is not null and turn is not null and seat is not null").groupBy("run", "turn").agg(F.array_join(F.array_sort(F.collect_set("seat")), ",").alias("roster"))
    w = Window.partitionBy("run").orderBy("turn")
    per = per.withColumn("refixed", F.coalesce(F.col("roster") != F.lag("roster").over(w), F.lit(True)))
    return per.select("run", "turn", F.max(F.when(F.col("refixed"), F.col("turn"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("reference_turn"), "refixed")
