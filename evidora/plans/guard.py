"""Queries of observations, bands and trajectories over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions.text import content_tokens
from evidora.operators import guardrail as gd
from evidora.operators import measure as ms
from evidora.plans import panel, search
from evidora.plans.panel import _C, TURN
from evidora.plans.sqltext import content
from evidora.session import cut
from evidora.sources.files import mark, once_written, shared_folder
from evidora.sources.sinks import transcript
from evidora.sources.tables import table

DEALS, RHO = 50, 0.6


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return panel._claims(spark, d).where("run is not null and turn is not null and seat is not null")


def _verified_docs(spark: SparkSession, d: str) -> DataFrame:
    """(run, turn, seat, doc_id) of the verified citations."""
    c = _rows(spark, d).select(*TURN, "seat", F.explode("citations").alias("c")).where("c.status = 'verified' and c.doc_id is not null")
    return c.select(*TURN, "seat", F.col("c.doc_id").alias("doc_id")).distinct()


def _grounded_terms(spark: SparkSession, d: str) -> DataFrame:
    words = _rows(spark, d).where("grounded").select(*TURN, "seat", F.explode(content_tokens(F.col("text"))).alias("term"))
    return words.groupBy(*TURN, "seat", "term").agg(F.count("*").alias("n"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """What each seat's turn counts for: text of grounded claims, verified documents."""
    docs = _verified_docs(spark, d).groupBy(*TURN, "seat").agg(F.count("*").alias("n_docs"))
    texts = _rows(spark, d).groupBy(*TURN, "seat").agg(F.count("*").alias("n_claims"), F.count_if("grounded").alias("n_grounded"), F.coalesce(F.sum(F.when(F.col("grounded"), F.length("text"))), F.lit(0)).alias("n_chars"))
    return texts.join(docs, [*TURN, "seat"], "left").select(*TURN, "seat", "n_claims", "n_grounded", "n_chars", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    docs = cut(_verified_docs(spark, d))
    rows = _rows(spark, d)
    seen = ms.jaccard_pairs(docs, TURN, "seat", "doc_id").groupBy(*TURN).agg(F.avg("distance").alias("observed"))
    null = ms.jaccard_pairs(ms.redeal(docs, TURN, "seat", "doc_id", DEALS), ["perm", *TURN], "seat", "doc_id").groupBy("perm", *TURN).agg(F.avg("distance").alias("m")).groupBy(*TURN).agg(F.avg("m").alias("null"))
    ev = seen.join(null, TURN).select(*TURN, ms.separation(F.col("observed"), F.col("null")).alias("evidence"), (F.col("null") < 0.95).alias("evidence_ok"))
    w = cut(ms.tfidf(cut(_grounded_terms(spark, d)), TURN, "seat"))
    ps = ms.vendi(ms.cosine_pairs(w, TURN, "seat"), w, TURN, "seat").select(*TURN, F.when(F.col("m") > 1, (F.col("vs2") - 1) / (F.col("m") - 1)).alias("positions"), (F.col("m") > 1).alias("positions_ok"))
    expected = rows.groupBy("run").agg(F.count_distinct("seat").alias("n_expected"))
    stance = F.col("declared")["confidence"]
    base = rows.groupBy(*TURN).agg(F.count("*").alias("n_claims"), F.count_distinct("seat").alias("n_seats"), F.count(stance).alias("n_stances"), F.coalesce(F.avg((stance != "high").cast("double")), F.lit(0.0)).alias("dissent"), F.bool_or(F.coalesce(stance == "low", F.lit(False))).alias("low"))
    # Seats at home that rest less than a quarter of their grounded claims on own work.
    own = search.own_documents(spark, d).select(F.col("name").alias("seat"), "doc_id", F.lit(1).alias("own"))
    home = docs.join(own, ["seat", "doc_id"], "left").groupBy(*TURN, "seat").agg((F.count("own") / F.count("*")).alias("share")).where("share >= 0.2")
    anchor = rows.where("grounded").groupBy(*TURN, "seat").agg(F.avg(F.coalesce("self_anchored", F.lit(False)).cast("double")).alias("anchor"))
    lost = home.join(anchor, [*TURN, "seat"]).groupBy(*TURN).agg(F.count_if(F.col("anchor") < gd.FIDELITY_FLOOR).alias("lost"))
    citing = docs.groupBy(*TURN).agg(F.count_distinct("seat").alias("k"))
    agreed = docs.groupBy(*TURN, "doc_id").agg(F.count("*").alias("n")).join(citing, TURN).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(0.5 * F.col("k")))).groupBy(*TURN).agg(F.count("*").alias("n_consensus"))
    minority = ms.exclusive(docs, TURN, "seat", "doc_id").join(rows.where(stance == "low").select(*TURN, "seat").distinct(), [*TURN, "seat"], "left_semi").select(*TURN).distinct().withColumn("has_minority", F.lit(True))
    fresh = panel.novelty(spark, d).select(*TURN, "novelty")
    out = base.join(expected, "run")
    for part in (ev, ps, lost, agreed, minority, fresh):
        out = out.join(part, TURN, "left")
    out = out.fillna(0, ["lost", "n_consensus"]).fillna(False, ["evidence_ok", "positions_ok", "has_minority"])
    return cut(out.select(*TURN, "n_claims", "n_seats", "n_expected", F.round("evidence", 6).alias("evidence"), "evidence_ok", F.round("positions", 6).alias("positions"), "positions_ok", F.round("dissent", 6).alias("dissent"), "n_stances", "novelty", "lost", "n_consensus", "has_minority"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots, taken once for the present tables: a turn that was
    measured is read, not measured again."""
    name = "snapshots-" + "".join(mark(spark, f"{d}/{t}.parquet") for t in ("docs", "seats", "ledger"))
    return spark.read.parquet(once_written(spark, f"{shared_folder(spark)}/{name}", lambda beside: _snapshots(spark, d).write.parquet(beside)))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What each turn is judged by, measured anew."""
    return _snapshots(spark, d)


def bands(spark: SparkSession, d: str) -> DataFrame:
    b = gd.bands(_measured(spark, d), RHO)
    return b.select("run", "reference_turn", *[F.round(c, 6).alias(c) for c in ("floor_evidence", "floor_positions", "ceiling_positions", "ref_evidence", "ref_positions")], "calibrated")


def band_retention(spark: SparkSession, d: str) -> DataFrame:
    s = _measured(spark, d)
    return gd.retention(s, gd.bands(s, RHO)).select("run", "turn", F.round("retained", 6).alias("retained"))


def turn_standing(spark: SparkSession, d: str) -> DataFrame:
    s = _measured(spark, d)
    return gd.standing(s, gd.bands(s, RHO))


def turn_controls(spark: SparkSession, d: str) -> DataFrame:
    return gd.controls(turn_standing(spark, d))


def band_identity(spark: SparkSession, d: str) -> DataFrame:
    return gd.fixed_again(_rows(spark, d).select(*TURN, "seat"))


def axis_change(spark: SparkSession, d: str) -> DataFrame:
    """How each axis moved since the turn before."""
    s = _measured(spark, d)
    w = Window.partitionBy("run").orderBy("turn")
    each = [s.select(*TURN, F.lit(a).alias("axis"), F.round(F.col(a) - F.lag(a).over(w), 5).alias("change")) for a in ("evidence", "positions", "dissent")]
    return each[0].unionByName(each[1]).unionByName(each[2]).where("change is not null")


def trajectory_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each expected turn of a run with its rates and the four modes of failure:
    F1 positions below .10 and F2 fewer than .15 new documents and F3 novelty
    below .30, all after the first turn, F4 fewer than .80 grounded claims. A
    turn without claims is a hole: it has no rates and no flags."""
    rows = _rows(spark, d)
    expected = rows.groupBy("run").agg(F.max("turn").alias("last")).select("run", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("turn"))
    claims = rows.groupBy(*TURN).agg(F.count("*").alias("n_claims"), F.avg(F.coalesce("grounded", F.lit(False)).cast("double")).alias("grounded"))
    docs = _verified_docs(spark, d).select(*TURN, "doc_id").distinct()
    new = docs.withColumn("new", (F.col("turn") == F.min("turn").over(Window.partitionBy("run", "doc_id"))).cast("double")).groupBy(*TURN).agg(F.avg("new").alias("new_share"))
    s = _measured(spark, d).select(*TURN, F.when(F.col("positions_ok"), F.col("positions")).alias("positions"), "novelty")
    out = expected.join(claims, TURN, "left").join(new, TURN, "left").join(s, TURN, "left")
    late = F.col("turn") > 1

    def flag(test) -> F.Column:
        return F.coalesce(test, F.lit(False))

    return out.select(
        *TURN, F.when(F.col("n_claims").isNull(), "hole").otherwise("ok").alias("state"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.round("grounded", 6).alias("grounded"), F.round("new_share", 6).alias("new_share"),
        flag(late & (F.col("positions") < 0.10)).alias("f1"), flag(late & (F.col("new_share") < 0.15)).alias("f2"), flag(late & (F.col("novelty") < 0.30)).alias("f3"), flag(F.col("grounded") < 0.80).alias("f4"),
    )


def prior_context(spark: SparkSession, d: str) -> DataFrame:
    """What a seat of a turn may be shown of all earlier turns: its own claims,
    and the grounded claims of others, by number and length."""
    rows = _rows(spark, d)
    own = rows.groupBy("run", "seat", "turn").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.count_if("grounded").alias("g"))
    before = Window.partitionBy("run", "seat").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    mine = own.withColumn("n_own", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("own_chars", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("own_grounded", F.coalesce(F.sum("g").over(before), F.lit(0)))
    table_ = Window.partitionBy("run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    every = own.groupBy("run", "turn").agg(F.sum("g").alias("g")).withColumn("all_grounded", F.coalesce(F.sum("g").over(table_), F.lit(0))).select("run", "turn", "all_grounded")
    return mine.join(every, ["run", "turn"]).select("run", "turn", "seat", "n_own", "own_chars", (F.col("all_grounded") - F.col("own_grounded")).alias("n_others"))


def distinct_n(spark: SparkSession, d: str) -> DataFrame:
    """The share of different n-grams among a seat's n-grams of a turn, n = 1, 2, 3."""
    t = _rows(spark, d).select(*TURN, "seat", content_tokens(F.col("text")).alias("ts"))
    each = t.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(F.size("ts") >= F.col("n"))
    grams = each.select(*TURN, "seat", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ts") - F.col("n") + 1), lambda i: F.array_join(F.slice("ts", i, F.col("n")), " "))).alias("g"))
    return grams.groupBy(*TURN, "seat", "n").agg(F.count_distinct("g").alias("n_distinct"), F.count("*").alias("n_all")).withColumn("share", F.round(F.col("n_distinct") / F.col("n_all"), 6))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's claims as one text, by length and digest."""
    return transcript(panel._claims(spark, d)).select(*TURN, F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def stylometry_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often each seat's later claims are taken for its own, beside chance."""
    s = cut(panel.stylometry(spark, d))
    seats = s.select("predicted").distinct().count() or 1
    per = s.groupBy("seat").agg(F.sum("n").alias("n_claims"), F.coalesce(F.sum(F.when(F.col("seat") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("n_hits"))
    return per.select("seat", "n_claims", "n_hits", F.round(F.col("n_hits") / F.col("n_claims"), 6).alias("rate"), F.round(F.lit(1.0 / seats), 6).alias("chance"))


QUERIES = {f.__name__: f for f in (transcripts, stylometry_rate, observations, snapshots, bands, band_retention, turn_standing, turn_controls, band_identity, axis_change, trajectory_flags, prior_context, distinct_n)}

_ROWS = f"{_C}, rws as (select * from claims where run is not null and turn is not null and seat is not null), vd as (select distinct run, turn, seat, c.doc_id as doc_id from (select run, turn, seat, unnest(citations) as c from rws) where c.status = 'verified' and c.doc_id is not null)"
_NOVEL = panel.SQL["novelty"]
_SNAP = f"""{_ROWS},
sz as (select run, turn, seat, count(*) as n from vd group by all), sh as (select run, turn, x.seat as a, y.seat as b, count(*) as k from vd x join vd y using (run, turn, doc_id) where x.seat < y.seat group by all),
ob as (select a.run, a.turn, avg(1 - coalesce(k, 0) / (a.n + b.n - coalesce(k, 0))) as observed from sz a join sz b on a.run = b.run and a.turn = b.turn and a.seat < b.seat left join sh on sh.run = a.run and sh.turn = a.turn and sh.a = a.seat and sh.b = b.seat group by 1, 2),
dx as (select vd.*, p as perm from vd cross join range({DEALS}) r(p)), dm as (select *, row_number() over (partition by perm, run, turn order by md5(concat_ws('|', perm, run, turn, seat, doc_id)), seat, doc_id) as slot from dx), dp as (select *, row_number() over (partition by perm, run, turn order by seat, doc_id) as slot from dx),
de as (select distinct p.perm, p.run, p.turn, p.seat, m.doc_id from dp p join dm m using (perm, run, turn, slot)), dz as (select perm, run, turn, seat, count(*) as n from de group by all), ds as (select perm, run, turn, x.seat as a, y.seat as b, count(*) as k from de x join de y using (perm, run, turn, doc_id) where x.seat < y.seat group by all),
nl as (select run, turn, avg(m) as nul from (select a.perm, a.run, a.turn, avg(1 - coalesce(k, 0) / (a.n + b.n - coalesce(k, 0))) as m from dz a join dz b on a.perm = b.perm and a.run = b.run and a.turn = b.turn and a.seat < b.seat left join ds on ds.perm = a.perm and ds.run = a.run and ds.turn = a.turn and ds.a = a.seat and ds.b = b.seat group by 1, 2, 3) group by 1, 2),
ev as (select run, turn, case when nul >= 1 then 0 else least(1, greatest(0, (observed - nul) / (1 - nul))) end as evidence, nul < 0.95 as evidence_ok from ob join nl using (run, turn)),
gt as (select run, turn, seat, term, count(*) as n from (select run, turn, seat, unnest({content('text')}) as term from rws where grounded) group by all), gn as (select run, turn, count(distinct seat) as m from gt group by all), gf as (select run, turn, term, count(*) as df from gt group by all),
gr as (select run, turn, seat, term, (1 + ln(n)) * (ln((1 + m) / (1 + df)) + 1) as w from gt join gn using (run, turn) join gf using (run, turn, term)), gw as (select *, w / sqrt(sum(w * w) over (partition by run, turn, seat)) as u from gr),
gc as (select run, turn, sum(c * c) as sq from (select run, turn, x.seat as a, y.seat as b, sum(x.u * y.u) as c from gw x join gw y using (run, turn, term) where x.seat < y.seat group by all) group by 1, 2),
ps as (select run, turn, case when m > 1 then (m * m / (m + 2 * coalesce(sq, 0)) - 1) / (m - 1) end as positions, m > 1 as positions_ok from gn left join gc using (run, turn)),
ex as (select run, count(distinct seat) as n_expected from rws group by 1),
ba as (select run, turn, count(*) as n_claims, count(distinct seat) as n_seats, count(declared['confidence']) as n_stances, coalesce(avg(case when declared['confidence'] is not null then (declared['confidence'] <> 'high')::int end), 0) as dissent from rws group by 1, 2),
ow as (select distinct s.name, d.doc_id from (select name, unnest(own_topics) as t from seats) s join (select doc_id, unnest(topics) as t from docs) d using (t)),
hm as (select run, turn, seat from vd left join ow on ow.name = seat and ow.doc_id = vd.doc_id group by 1, 2, 3 having count(ow.doc_id) / count(*) >= 0.2), an as (select run, turn, seat, avg(coalesce(self_anchored, false)::int) as anchor from rws where grounded group by 1, 2, 3),
ls as (select run, turn, count(*) filter (where anchor < 0.25) as lost from hm join an using (run, turn, seat) group by 1, 2),
ck as (select run, turn, count(distinct seat) as k from vd group by 1, 2), ag as (select run, turn, count(*) as n_consensus from (select run, turn, doc_id, count(*) as n from vd group by all) join ck using (run, turn) where n >= greatest(2, ceil(0.5 * k)) group by 1, 2),
mi as (select distinct run, turn from (select run, turn, min(seat) as seat from vd group by run, turn, doc_id having count(*) = 1) join (select distinct run, turn, seat from rws where declared['confidence'] = 'low') using (run, turn, seat)),
nv as (select run, turn, novelty from ({_NOVEL})),
snap as (select ba.run, ba.turn, n_claims, n_seats, n_expected, round(evidence, 6) as evidence, coalesce(evidence_ok, false) as evidence_ok, round(positions, 6) as positions, coalesce(positions_ok, false) as positions_ok, round(dissent, 6) as dissent, n_stances, novelty, coalesce(lost, 0) as lost, coalesce(n_consensus, 0) as n_consensus, mi.run is not null as has_minority
  from ba join ex using (run) left join ev using (run, turn) left join ps using (run, turn) left join ls using (run, turn) left join ag using (run, turn) left join mi on mi.run = ba.run and mi.turn = ba.turn left join nv on nv.run = ba.run and nv.turn = ba.turn),
band as (select run, min(turn) as reference_turn, greatest(0.15, {RHO} * arg_min(coalesce(evidence, 0), turn)) as floor_evidence, greatest(0.2, {RHO} * arg_min(coalesce(positions, 0), turn)) as floor_positions, least(1, greatest(0.35, 1.2 * arg_min(coalesce(positions, 0), turn))) as ceiling_positions, arg_min(coalesce(evidence, 0), turn) as ref_evidence, arg_min(coalesce(positions, 0), turn) as ref_positions from snap group by 1),
kept as (select snap.run, snap.turn, least(case when evidence_ok and ref_evidence > 0 then least(1, evidence / ref_evidence) end, case when positions_ok and ref_positions > 0 then least(1, positions / ref_positions) end) as retained from snap join band using (run))"""
_STAND = f"""with recursive {_SNAP},
pre as (select s.*, retained as x, row_number() over (partition by s.run order by s.turn) as i, coalesce((evidence_ok and evidence < floor_evidence)::int, 0) + coalesce((positions_ok and positions < floor_positions)::int, 0) + coalesce((novelty < 0.25)::int, 0) as n_breached,
  case when n_claims < 4 or n_seats < 2 or n_seats < 0.6 * n_expected then 'undetermined' when s.turn = reference_turn then 'reference_turn' end as early,
  case when lost > 0 then 'fidelity_lost' when positions_ok and positions > ceiling_positions then 'scattered' when evidence_ok and evidence >= floor_evidence and dissent < 0.2 and n_stances > 0 then 'independent_corroboration' when evidence_ok and evidence < floor_evidence and dissent >= 0.35 then 'contested_evidence' end as mid
  from snap s join band using (run) join kept on kept.run = s.run and kept.turn = s.turn),
gate as (select *, coalesce(mid, case when n_breached = 0 then 'healthy' end) as later, case when early is null and x is not null then 4 * ln((1 - least(1 - 1e-6, greatest(1e-6, x))) / least(1 - 1e-6, greatest(1e-6, x))) else 0 end as inc from pre),
walk as (select run, i, cast(0 as double) as llr, 0 as used, cast(null as int) as turn, cast(null as varchar) as verdict, cast(null as varchar) as move, 0 as skipped, 0 as n_breached, cast(0 as double) as raw, false as fired from gate where false
  union all select run, 0, cast(0 as double), 0, null, null, null, 0, 0, cast(0 as double), false from (select distinct run from gate)
  union all select g.run, g.i, case when abs(w.llr + g.inc) >= ln(19) then 0 else w.llr + g.inc end, w.used + case when a.acts then 1 + a.barred::int else 0 end, g.turn,
    coalesce(g.early, g.later, case when a.acts and a.place >= 6 then 'collapsed' else 'collapsing' end), case when a.acts then a.ladder[a.place + 1] else 'none' end, a.barred::int, g.n_breached, w.llr + g.inc, abs(w.llr + g.inc) >= ln(19)
  from walk w join gate g on g.run = w.run and g.i = w.i + 1, lateral (select acts, barred, case when barred then least(w.used + 1, 7) else least(w.used, 7) end as place, ['{"', '".join(gd.LADDER)}'] as ladder from (select acts, acts and ((w.used = 1 and g.n_consensus = 0) or (w.used = 5 and not g.has_minority)) as barred from (select g.early is null and g.later is null and w.llr + g.inc >= ln(19) as acts))) a),
judged as (select run, turn, verdict, move, skipped, n_breached, round(raw, 6) as llr, fired from walk where i > 0)"""
SQL = {
    "transcripts": f"""with {_C}, l as (select run, turn, seat, coalesce(claim_idx, 0) as i, claim_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(citations, []), lambda c: c.doc_id), lambda x: x is not null))), ', ') as ds, text, grounded from claims where run is not null and turn is not null and seat is not null),
t as (select run, turn, string_agg('[' || seat || '] ' || coalesce(text, '') || case when coalesce(grounded, false) then '' else ' (not grounded)' end || case when ds <> '' then ' {{' || ds || '}}' else '' end, chr(10) order by seat, i, claim_id) as x from l group by 1, 2) select run, turn, length(x) as n_chars, md5(x) as digest from t""",
    "stylometry_rate": f"with s as ({panel.SQL['stylometry']}), k as (select count(distinct predicted) as k from s) select seat, cast(sum(n) as bigint) as n_claims, cast(coalesce(sum(n) filter (where seat = predicted), 0) as bigint) as n_hits, round(coalesce(sum(n) filter (where seat = predicted), 0) / sum(n), 6) as rate, round(1.0 / (select k from k), 6) as chance from s group by 1",
    "observations": f"with {_ROWS} select r.run, r.turn, r.seat, count(*) as n_claims, count(*) filter (where grounded) as n_grounded, cast(coalesce(sum(length(text)) filter (where grounded), 0) as bigint) as n_chars, (select count(*) from vd where vd.run = r.run and vd.turn = r.turn and vd.seat = r.seat) as n_docs from rws r group by 1, 2, 3",
    "snapshots": f"with {_SNAP} select * from snap",
    "bands": f"with {_SNAP} select run, reference_turn, round(floor_evidence, 6) as floor_evidence, round(floor_positions, 6) as floor_positions, round(ceiling_positions, 6) as ceiling_positions, round(ref_evidence, 6) as ref_evidence, round(ref_positions, 6) as ref_positions, true as calibrated from band",
    "band_retention": f"with {_SNAP} select run, turn, round(retained, 6) as retained from kept join band using (run) where turn > reference_turn",
    "turn_standing": f"{_STAND} select * from judged",
    "turn_controls": f"{_STAND} select run, turn, {', '.join(f"move = '{m}' as {n}" for m, n in zip(gd.LADDER, ('peers', 'withhold', 'own_only', 'anonymous', 'isolated', 'dissent')))}, move in ('{gd.LADDER[6]}', '{gd.LADDER[7]}') as stop from judged",
    "band_identity": f"with {_ROWS}, r as (select run, turn, list_sort(list(distinct seat)) as roster from rws group by 1, 2), c as (select run, turn, coalesce(roster <> lag(roster) over (partition by run order by turn), true) as refixed from r) select run, turn, max(case when refixed then turn end) over (partition by run order by turn) as reference_turn, refixed from c",
    "axis_change": f"with {_SNAP}, l as (select run, turn, unnest(['evidence', 'positions', 'dissent']) as axis, unnest([evidence, positions, dissent]) as v from snap), c as (select run, turn, axis, round(v - lag(v) over (partition by run, axis order by turn), 5) as change from l) select * from c where change is not null",
    "trajectory_flags": f"""with {_SNAP}, e as (select run, unnest(range(1, last + 1))::int as turn from (select run, max(turn) as last from rws group by 1)), c as (select run, turn, count(*) as n_claims, avg(coalesce(grounded, false)::int) as grounded from rws group by 1, 2),
fd as (select distinct run, turn, doc_id from vd), nw as (select run, turn, avg(fresh::int) as new_share from (select *, turn = min(turn) over (partition by run, doc_id) as fresh from fd) group by 1, 2)
select e.run, e.turn, case when n.n_claims is null then 'hole' else 'ok' end as state, coalesce(n.n_claims, 0) as n_claims, round(n.grounded, 6) as grounded, round(new_share, 6) as new_share, coalesce(e.turn > 1 and positions_ok and positions < 0.1, false) as f1, coalesce(e.turn > 1 and new_share < 0.15, false) as f2, coalesce(e.turn > 1 and novelty < 0.3, false) as f3, coalesce(n.grounded < 0.8, false) as f4
from e left join c n on n.run = e.run and n.turn = e.turn left join nw on nw.run = e.run and nw.turn = e.turn left join snap s on s.run = e.run and s.turn = e.turn""",
    "prior_context": f"with {_ROWS}, st as (select distinct run, turn, seat from rws) select run, turn, seat, (select count(*) from rws r where r.run = st.run and r.seat = st.seat and r.turn < st.turn) as n_own, cast(coalesce((select sum(length(text)) from rws r where r.run = st.run and r.seat = st.seat and r.turn < st.turn), 0) as bigint) as own_chars, (select count(*) from rws r where r.run = st.run and r.seat <> st.seat and r.turn < st.turn and r.grounded) as n_others from st",
    "distinct_n": f"with {_ROWS}, t as (select run, turn, seat, {content('text')} as ts from rws), n as (select *, unnest([1, 2, 3]) as n from t), g as (select run, turn, seat, n, array_to_string(ts[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(ts) - n + 2)) as i from n where len(ts) >= n)) select run, turn, seat, n, count(distinct g) as n_distinct, count(*) as n_all, round(count(distinct g) / count(*), 6) as share from g group by 1, 2, 3, 4",
}
