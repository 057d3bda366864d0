"""Queries of verification and measurement over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions.text import DASHES, LIGATURES, QUOTES, content_tokens
from evidora.operators import measure as ms
from evidora.operators import verify as vf
from evidora.operators.deals import axes_of_turns
from evidora.operators.index import neighbours, once
from evidora.plans.search import _PACKET_SQL, own_documents, packets
from evidora.plans.sqltext import CLAIMS, LLR, content, nfkc
from evidora.session import cut
from evidora.sources.tables import table

TURN = ["run", "turn"]
DEALS = 200
# Marks of a live argument.
MARKERS = [
    "however", "in contrast", "by contrast", "conversely", "nevertheless", "controversial", "controversy", "debate", "debated", "disputed", "conflicting", "inconsistent", "discrepant", "discrepancy", "paradox",
    "remains unclear", "remains unknown", "not been established", "contrary to", "challenge the", "challenges the", "fail to replicate", "could not be replicated", "unresolved", "at odds with",
]
NEAR_DUPLICATE = 0.8


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return vf.claims(table(spark, d, "ledger"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (run, turn, seat, doc_id)."""
    return vf.citations(table(spark, d, "ledger")).where(F.col("doc_id").isNotNull()).select(*TURN, "seat", "doc_id").distinct()


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """(run, turn, seat, term, n)."""
    words = _claims(spark, d).select(*TURN, "seat", F.explode(content_tokens(F.col("text"))).alias("term"))
    return words.groupBy(*TURN, "seat", "term").agg(F.count("*").alias("n"))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    return vf.verify(vf.citations(table(spark, d, "ledger")), once(table(spark, d, "passages")), table(spark, d, "docs"), own_documents(spark, d))


def verify_status(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("claim_id", "cit_no", "status", "tier", "passage_id")


def verify_report(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_verified(spark, d))
    return vf.report(v, vf.grounded(_claims(spark, d), v), "run", "seat")


def verify_permitted(spark: SparkSession, d: str) -> DataFrame:
    """Statuses where a seat may only cite what its packet holds."""
    handed = packets(spark, d).select("seat", "doc_id").distinct()
    v = vf.verify(vf.citations(table(spark, d, "ledger")), once(table(spark, d, "passages")), table(spark, d, "docs"), own_documents(spark, d), permitted=handed)
    return v.select("claim_id", "cit_no", "status", "tier")


def claim_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What to say of claims whose citations failed."""
    return vf.repair_text(_verified(spark, d)).select("claim_id", "n_failed", F.md5("text").alias("digest"))


def claim_grounded(spark: SparkSession, d: str) -> DataFrame:
    return vf.grounded(_claims(spark, d), _verified(spark, d)).select("claim_id", "n_citations", "grounded", "self_anchored")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ms.jaccard_pairs(_cited(spark, d), TURN, "seat", "doc_id").withColumn("distance", F.round("distance", 6))


def js_divergence(spark: SparkSession, d: str) -> DataFrame:
    return ms.js_pairs(_terms(spark, d), TURN, "seat").withColumn("divergence", F.round("divergence", 6))


def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    w = ms.tfidf(_terms(spark, d), TURN, "seat").withColumn("w", F.round("w", 6))
    r = F.row_number().over(Window.partitionBy(*TURN, "seat").orderBy(F.desc("w"), "term"))
    return w.withColumn("r", r).where("r <= 5")


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ms.cosine_pairs(ms.tfidf(_terms(spark, d), TURN, "seat"), TURN, "seat").withColumn("cosine", F.round("cosine", 6))


def vendi2(spark: SparkSession, d: str) -> DataFrame:
    w = cut(ms.tfidf(_terms(spark, d), TURN, "seat"))
    v = ms.vendi(ms.cosine_pairs(w, TURN, "seat"), w, TURN, "seat")
    return v.select(*TURN, "m", F.round("vs2", 6).alias("vs2"), F.round("dispersion", 6).alias("dispersion"))


def distant_peers(spark: SparkSession, d: str) -> DataFrame:
    c = cut(ms.cosine_pairs(ms.tfidf(_terms(spark, d), TURN, "seat"), TURN, "seat")).withColumn("cosine", F.round("cosine", 9))
    both = c.select(*TURN, F.col("a").alias("seat"), F.col("b").alias("peer"), "cosine").union(c.select(*TURN, "b", "a", "cosine"))
    r = F.row_number().over(Window.partitionBy(*TURN, "seat").orderBy("cosine", "peer"))
    return both.withColumn("r", r).where("r <= 2").select(*TURN, "seat", "peer", "r")


def stance_entropy(spark: SparkSession, d: str) -> DataFrame:
    v = _claims(spark, d).select(*TURN, F.col("declared")["confidence"].alias("stance"))
    return ms.entropy(v, TURN, "stance", 4).select(*TURN, "n", "k", F.round("entropy", 6).alias("entropy"))


def modal_disagreement(spark: SparkSession, d: str) -> DataFrame:
    v = _claims(spark, d).select(*TURN, F.col("declared")["confidence"].alias("stance"))
    return ms.entropy(v, TURN, "stance", 4).select(*TURN, F.round("modal", 6).alias("modal"))


def contestedness(spark: SparkSession, d: str) -> DataFrame:
    return ms.contestedness(once(table(spark, d, "passages")), "doc_id", "text", MARKERS)


def _consensus(s: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents that at least 2 and ``share`` of a turn's citing seats cite."""
    seats = s.groupBy(*TURN).agg(F.count_distinct("seat").alias("n_seats"))
    c = s.groupBy(*TURN, "doc_id").agg(F.count_distinct("seat").alias("n"))
    return c.join(seats, TURN).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(share * F.col("n_seats")))).select(*TURN, "doc_id", "n")


def consensus_docs(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(_cited(spark, d))


def consensus_docs_wide(spark: SparkSession, d: str) -> DataFrame:
    """As consensus_docs, for a tenth of the seats."""
    return _consensus(_cited(spark, d), 0.1)


def contested_docs(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).groupBy("run", "doc_id").agg(F.count_distinct("seat").alias("n_seats")).where("n_seats > 1")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """(run, turn, seat, docs): what each claim cites."""
    return _claims(spark, d).select(*TURN, "seat", F.transform("citations", lambda c: c["doc_id"]).alias("docs"))


def perm_null_evidence(spark: SparkSession, d: str) -> DataFrame:
    out = axes_of_turns(_documents(spark, d), TURN, DEALS, ("evidence",))
    return out.select(*TURN, F.round("observed", 6).alias("observed"), F.round("null", 6).alias("null_mean"), F.round(ms.separation(F.col("observed"), F.col("null")), 5).alias("separation"), (F.col("null") < 0.95).alias("informative"))


def _against_earlier(spark: SparkSession, d: str, by_seat: bool) -> DataFrame:
    """(run, turn[, seat], a, most): each claim's largest cosine to the earlier
    claims of its run (and seat), where that is a near duplicate, else what it
    was found to be at most; tf-idf fitted on those and the turn's."""
    c = _claims(spark, d).where(F.col("turn").isNotNull() & F.col("run").isNotNull() & F.col("seat").isNotNull())
    group = ["run", "seat"] if by_seat else ["run"]
    terms = c.select(*group, "claim_id", F.col("turn").alias("own_turn"), F.explode(content_tokens(F.col("text"))).alias("term")).groupBy(*group, "claim_id", "own_turn", "term").agg(F.count("*").alias("n"))
    turns = c.select(*group, "turn").distinct()
    scope = terms.join(turns, group).where("own_turn <= turn")
    key = [*group, "turn"]
    w = cut(ms.tfidf(scope, key, "claim_id").join(terms.select("claim_id", "own_turn").distinct(), "claim_id"))
    # Rarest terms first; what lies behind a claim's prefix is shorter than the
    # threshold, so two claims that reach it share a term of both prefixes.
    order = Window.partitionBy(*key, "claim_id").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = w.join(w.groupBy(*key, "term").agg(F.count("*").alias("df")), [*key, "term"])
    prefix = ranked.withColumn("left", F.sum(F.col("w") * F.col("w")).over(order)).where(F.col("left") >= NEAR_DUPLICATE**2 - 1e-6)
    new, old = w.where("own_turn = turn"), w.where("own_turn < turn")
    met = prefix.where("own_turn = turn").select(*key, F.col("claim_id").alias("a"), "term").join(prefix.where("own_turn < turn").select(*key, F.col("claim_id").alias("b"), "term"), [*key, "term"]).select(*key, "a", "b").distinct()
    dot = met.join(new.select(*key, F.col("claim_id").alias("a"), "term", F.col("w").alias("wa")), [*key, "a"]).join(old.select(*key, F.col("claim_id").alias("b"), "term", F.col("w").alias("wb")), [*key, "b", "term"])
    best = dot.groupBy(*key, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos")).groupBy(*key, "a").agg(F.max("cos").alias("most"))
    base = new.select(*key, F.col("claim_id").alias("a")).distinct()
    earlier = old.select(*key).distinct()
    return base.join(earlier, key, "left_semi").join(best, [*key, "a"], "left").fillna(0.0, ["most"])


def novelty(spark: SparkSession, d: str) -> DataFrame:
    m = _against_earlier(spark, d, False)
    return m.groupBy(*TURN).agg(F.count("*").alias("n_claims"), F.round(F.avg((F.round("most", 9) < 0.8).cast("int")), 6).alias("novelty"))


def self_restatement(spark: SparkSession, d: str) -> DataFrame:
    m = _against_earlier(spark, d, True)
    return m.groupBy(*TURN).agg(F.count("*").alias("n_claims"), F.round(F.avg((F.round("most", 9) >= 0.8).cast("int")), 6).alias("restated"))


def herding(spark: SparkSession, d: str) -> DataFrame:
    """Net moves toward the confident end between a seat's turns."""
    level = F.element_at(F.create_map(F.lit("low"), F.lit(0), F.lit("middling"), F.lit(1), F.lit("high"), F.lit(2)), F.col("declared")["confidence"])
    s = _claims(spark, d).select("run", "turn", "seat", level.alias("v")).where("v is not null").groupBy("run", "turn", "seat").agg(F.avg("v").alias("v"))
    moved = s.withColumn("move", F.signum(F.round(F.col("v") - F.lag("v").over(Window.partitionBy("run", "seat").orderBy("turn")), 9)))
    return moved.groupBy(*TURN).agg(F.count_if(F.col("move") > 0).alias("toward"), F.count_if(F.col("move") < 0).alias("away"))


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    s = _cited(spark, d).select("run", "turn", "doc_id").distinct()
    first = s.withColumn("new", (F.col("turn") == F.min("turn").over(Window.partitionBy("run", "doc_id"))).cast("int"))
    per = first.groupBy(*TURN).agg(F.count("*").alias("n_docs"), F.sum("new").alias("n_new"))
    return per.select(*TURN, "n_docs", "n_new", F.round(F.col("n_new") / F.col("n_docs"), 6).alias("new_share"), F.sum("n_new").over(Window.partitionBy("run").orderBy("turn")).alias("docs_so_far"))


def monitor_llr(spark: SparkSession, d: str) -> DataFrame:
    """The share of new documents, watched turn by turn."""
    s = _cited(spark, d).select("run", "turn", "doc_id").distinct()
    first = s.withColumn("new", (F.col("turn") == F.min("turn").over(Window.partitionBy("run", "doc_id"))).cast("double"))
    return ms.monitor(first.groupBy(*TURN).agg(F.avg("new").alias("x")), "run", "turn", "x").select("run", "llr", "fired", F.array_join("history", " ").alias("history"))


def territory(spark: SparkSession, d: str) -> DataFrame:
    s = _cited(spark, d)
    own = own_documents(spark, d).select(F.col("name").alias("seat"), "doc_id", F.lit(1).alias("own"))
    per = s.join(own, ["seat", "doc_id"], "left").groupBy(*TURN, "seat").agg((F.count("own") / F.count("*")).alias("share"))
    return per.select(*TURN, "seat", F.round("share", 6).alias("own_share"), F.when(F.col("share") >= 0.2, "home").when(F.col("share") >= 0.05, "adjacent").otherwise("foreign").alias("zone"))


def evidenced_minority(spark: SparkSession, d: str) -> DataFrame:
    only = ms.exclusive(_cited(spark, d), TURN, "seat", "doc_id")
    low = _claims(spark, d).where(F.col("declared")["confidence"] == "low").select(*TURN, "seat").distinct()
    r = F.row_number().over(Window.partitionBy(*TURN).orderBy(F.desc("n_only"), "seat"))
    return only.join(low, [*TURN, "seat"], "left_semi").withColumn("r", r).where("r = 1").select(*TURN, "seat", "n_only")


def disclosure_set(spark: SparkSession, d: str) -> DataFrame:
    """Per turn, the cited documents by how many seats have verified quotes of
    them, the first 16."""
    v = _verified(spark, d).where("status = 'verified'")
    c = v.groupBy(*TURN, "doc_id").agg(F.count_distinct("seat").alias("n_seats"), F.count_distinct("quote").alias("n_quotes"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy(*TURN).orderBy(F.desc("n_seats"), "doc_id"))).where("r <= 16")


def audit_cases(spark: SparkSession, d: str) -> DataFrame:
    """Verified citations of grounded claims handed to every other seat of the
    turn, with the passages at most 4 places around."""
    every = cut(_verified(spark, d))
    sound = vf.grounded(_claims(spark, d), every).where("grounded").select("claim_id")
    v = every.where("status = 'verified'").join(sound, "claim_id", "left_semi")
    others = _claims(spark, d).where("seat is not null").select(*TURN, F.col("seat").alias("reviewer")).distinct()
    places = once(table(spark, d, "passages")).select("doc_id", "passage_id", "ord", "passage_seq")
    at = v.join(places.groupBy("passage_id").agg(F.min("ord").alias("ord")), "passage_id").select(*TURN, "seat", "claim_id", "cit_no", "doc_id", "ord")
    near = neighbours(at, places, 4)
    return near.join(others, TURN).where("seat <> reviewer").select("claim_id", "cit_no", "reviewer", "near_seq")


def stylometry(spark: SparkSession, d: str) -> DataFrame:
    """Claims of later turns against seat centroids of the first two: (seat,
    predicted, n)."""
    c = _claims(spark, d).where("seat is not null").select("claim_id", "seat", "turn", F.explode(content_tokens(F.col("text"))).alias("term"))
    early = c.where("turn <= 2").groupBy("seat", "term").agg(F.count("*").alias("n")).withColumn("w", F.log1p("n"))
    early = early.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("seat"))))
    late = c.where("turn > 2").groupBy("claim_id", "seat", "term").agg(F.log1p(F.count("*")).alias("v"))
    dot = late.join(early.select(F.col("seat").alias("predicted"), "term", "w"), "term").groupBy("claim_id", "seat", "predicted").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("s"))
    best = dot.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("s"), "predicted"))).where("r = 1")
    return best.groupBy("seat", "predicted").agg(F.count("*").alias("n"))


def turn_roster(spark: SparkSession, d: str) -> DataFrame:
    """Seats of the roster against those that spoke in each run."""
    runs = _claims(spark, d).where("run is not null").select("run").distinct()
    spoke = _claims(spark, d).where("seat is not null").groupBy("run", "seat").agg(F.count("*").alias("n_claims"))
    roster = runs.crossJoin(F.broadcast(table(spark, d, "seats").select(F.col("name").alias("seat"))))
    return roster.join(spoke, ["run", "seat"], "left").select("run", "seat", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.when(F.col("n_claims").isNull(), "no response").otherwise("answered").alias("state"))


QUERIES = {
    f.__name__: f
    for f in (verify_status, verify_report, verify_permitted, claim_repairs, claim_grounded, jaccard_pairs, js_divergence, tfidf_top_terms, cosine_pairs, vendi2, distant_peers, stance_entropy, modal_disagreement, contestedness, consensus_docs, consensus_docs_wide, contested_docs, perm_null_evidence, novelty, self_restatement, herding, trajectory, monitor_llr, territory, evidenced_minority, disclosure_set, audit_cases, stylometry, turn_roster)
}


def _fold(x: str) -> str:
    x = nfkc(x)
    for sign, plain in LIGATURES:
        x = f"replace({x}, '{sign}', '{plain}')"
    quotes = QUOTES.replace("'", "''")
    x = f"translate(translate({x}, '{DASHES}', '{'-' * len(DASHES)}'), '{quotes}', '''''''\"\"\"')"
    return f"lower(trim(regexp_replace(regexp_replace({x}, '-\\s*\\n\\s*', '', 'g'), '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' '))"


_CITS = """cits as (select claim_id, run, turn, seat, i - 1 as cit_no, c.doc_id as doc_id, c.quote as quote from (select *, unnest(citations) as c, generate_subscripts(citations, 1) as i from claims)),
cited as (select distinct run, turn, seat, doc_id from cits where doc_id is not null)"""
_C = f"{CLAIMS},\n{_CITS}"
_OWN = "own as (select distinct s.name, d.doc_id from (select name, unnest(own_topics) as t from seats) s join (select doc_id, unnest(topics) as t from docs) d using (t))"
_PSG_V = "psg as (select distinct on (passage_seq) passage_seq, passage_id, doc_id, ord, text from passages)"
_V = f"""{_C}, {_OWN}, {_PSG_V},
folded as (select *, {_fold("coalesce(quote, '')")} as form from cits), bodies as (select *, {_fold('text')} as body from psg),
hits as (select f.doc_id, f.form, arg_min(passage_id, (ord, passage_seq)) as passage_id from (select distinct doc_id, form from folded where length(form) >= 40) f join bodies b on b.doc_id = f.doc_id and contains(b.body, f.form) group by 1, 2),
ver as (select f.*, case when length(form) < 40 then 'too_short' when not exists (select 1 from docs d where d.doc_id = f.doc_id) then 'invented' when not exists (select 1 from psg p where p.doc_id = f.doc_id) then 'doc_not_held' when h.passage_id is not null then 'verified' else 'quote_not_found' end as status, h.passage_id as pid from folded f left join hits h using (doc_id, form)),
verified as (select claim_id, run, turn, seat, cit_no, doc_id, quote, status, case when status = 'verified' then case when exists (select 1 from own o where o.name = ver.seat and o.doc_id = ver.doc_id) then 'own' else 'read' end end as tier, case when status = 'verified' then pid end as passage_id from ver)"""
_T = f"{_C}, terms as (select run, turn, seat, term, count(*) as n from (select run, turn, seat, unnest({content('text')}) as term from claims) where run is not null and turn is not null and seat is not null group by 1, 2, 3, 4)"
_W = f"""{_T}, nn as (select run, turn, count(distinct seat) as nn from terms group by 1, 2), dfs as (select run, turn, term, count(*) as df from terms group by 1, 2, 3),
raw as (select run, turn, seat, term, (1 + ln(n)) * (ln((1 + nn) / (1 + df)) + 1) as w from terms join dfs using (run, turn, term) join nn using (run, turn)),
wts as (select run, turn, seat, term, w / sqrt(sum(w * w) over (partition by run, turn, seat)) as w from raw),
mem as (select distinct run, turn, seat from wts),
cos as (select a.run, a.turn, a.seat as a, b.seat as b, coalesce((select sum(x.w * y.w) from wts x join wts y using (run, turn, term) where x.run = a.run and x.turn = a.turn and x.seat = a.seat and y.seat = b.seat), 0) as cosine from mem a join mem b on a.run = b.run and a.turn = b.turn and a.seat < b.seat)"""
_J = """size as (select {g}, seat, count(*) as n from {s} group by all),
jac as (select {ga}, a.seat as a, b.seat as b, (select count(*) from {s} x join {s} y using ({g}, doc_id) where {same} and x.seat = a.seat and y.seat = b.seat) as shared, a.n as na, b.n as nb from size a join size b using ({g}) where a.seat < b.seat)"""
_JT = _J.format(g="run, turn", ga="a.run, a.turn", s="cited", same="x.run = a.run and x.turn = a.turn")
_STANCE = f"with {_C}, v as (select run, turn, declared['confidence'] as s from claims), c as (select run, turn, s, count(*) as c from v where s is not null group by 1, 2, 3)"


def _earlier(group: str, having: str) -> str:
    on = " and ".join(f"{{0}}.{g} = {{1}}.{g}" for g in group.split(", "))
    return f"""with {_C}, t as (select {group}, claim_id, turn as own_turn, term, count(*) as n from (select {group}, claim_id, turn, unnest({content('text')}) as term from claims where run is not null and seat is not null and turn is not null) group by all),
turns as (select distinct {group}, turn from claims where run is not null and seat is not null and turn is not null),
sc as (select t.*, turns.turn as turn from t join turns using ({group}) where own_turn <= turns.turn),
nn as (select {group}, turn, count(distinct claim_id) as nn from sc group by all), dfs as (select {group}, turn, term, count(*) as df from sc group by all),
raw as (select {group}, turn, claim_id, own_turn, term, (1 + ln(n)) * (ln((1 + nn) / (1 + df)) + 1) as w from sc join dfs using ({group}, turn, term) join nn using ({group}, turn)),
w as (select * exclude (w), w / sqrt(sum(w * w) over (partition by {group}, turn, claim_id)) as w from raw),
dots as (select {group}, turn, x.claim_id as a, y.claim_id as b, sum(x.w * y.w) as cos from w x join w y using ({group}, turn, term) where x.own_turn = turn and y.own_turn < turn group by all),
base as (select distinct {group}, turn, claim_id as a from w where own_turn = turn and exists (select 1 from w o where {on.format('o', 'w')} and o.turn = w.turn and o.own_turn < o.turn)),
best as (select {group}, turn, a, coalesce(max(cos), 0) as most from base left join dots using ({group}, turn, a) group by all)
select run, turn, count(*) as n_claims, {having} from best group by 1, 2"""


_COS_MARKS = " + ".join(f"(length(x) - length(replace(x, '{m}', ''))) / {len(m)}" for m in MARKERS)

SQL = {
    "verify_status": f"with {_V} select claim_id, cit_no, status, tier, passage_id from verified",
    "verify_report": f"""with {_V}, per as (select claim_id, count(*) as n, count(*) filter (where status = 'verified') as ok, count(*) filter (where tier = 'own') as own from verified group by 1), g as (select c.run, c.seat, coalesce(n > 0 and n = ok, false) as gr, coalesce(own > 0, false) as sa from claims c left join per using (claim_id)),
a as (select run, seat, count(*) as n_claims, count(*) filter (where gr) as n_grounded, count(*) filter (where gr and sa) as anchored from g group by 1, 2), b as (select run, seat, count(*) as n, count(*) filter (where status = 'verified') as v, count(*) filter (where status = 'invented') as i, count(*) filter (where status in ('quote_not_found', 'doc_not_held')) as f from verified group by 1, 2)
select a.run, a.seat, n_claims, n_grounded, coalesce(n, 0) as n_citations, coalesce(v, 0) as n_verified, coalesce(i, 0) as n_invented, 0::bigint as n_out_of_scope, round(coalesce(f / nullif(n, 0), 0), 6) as fabrication, round(coalesce((n - v) / nullif(n, 0), 0), 6) as ungrounded, round(coalesce(anchored / nullif(n_grounded, 0), 0), 6) as self_anchor from a left join b on a.run is not distinct from b.run and a.seat is not distinct from b.seat""",
    "verify_permitted": f"with ho as ({_PACKET_SQL} select distinct seat, doc_id from packet), v as (with {_V} select claim_id, cit_no, seat, doc_id, status, tier from verified), x as (select v.*, ho.doc_id is not null as handed from v left join ho using (seat, doc_id)) select claim_id, cit_no, case when status in ('too_short', 'invented') or handed then status else 'out_of_scope' end as status, case when handed then tier end as tier from x",
    "claim_repairs": f"with {_V} select claim_id, count(*) as n_failed, md5(string_agg('- citation ' || cit_no || ' of ' || coalesce(doc_id, 'no document') || ': ' || status, chr(10) order by cit_no)) as digest from verified where status <> 'verified' group by 1",
    "claim_grounded": f"with {_V}, per as (select claim_id, count(*) as n, count(*) filter (where status = 'verified') as ok, count(*) filter (where tier = 'own') as own from verified group by 1) select claim_id, coalesce(n, 0) as n_citations, coalesce(n > 0 and n = ok, false) as grounded, coalesce(own > 0, false) as self_anchored from claims left join per using (claim_id)",
    "jaccard_pairs": f"with {_C}, {_JT} select run, turn, a, b, shared, round(1 - shared / (na + nb - shared), 6) as distance from jac",
    "js_divergence": f"""with {_T}, p as (select *, n / sum(n) over (partition by run, turn, seat) as p from terms), mem as (select distinct run, turn, seat from terms),
k as (select run, turn, x.seat as a, y.seat as b, sum(0.5 * x.p * log2(2 * x.p / (x.p + y.p)) + 0.5 * y.p * log2(2 * y.p / (x.p + y.p)) - 0.5 * x.p - 0.5 * y.p) as part from p x join p y using (run, turn, term) where x.seat < y.seat group by 1, 2, 3, 4)
select a.run, a.turn, a.seat as a, b.seat as b, round(greatest(0, 1 + coalesce(part, 0)), 6) as divergence from mem a join mem b on a.run = b.run and a.turn = b.turn and a.seat < b.seat left join k on k.run = a.run and k.turn = a.turn and k.a = a.seat and k.b = b.seat""",
    "tfidf_top_terms": f"with {_W} select * from (select run, turn, seat, term, round(w, 6) as w, row_number() over (partition by run, turn, seat order by round(w, 6) desc, term) as r from wts) where r <= 5",
    "cosine_pairs": f"with {_W} select run, turn, a, b, round(cosine, 6) as cosine from cos",
    "vendi2": f"with {_W}, m as (select run, turn, count(*) as m from mem group by 1, 2), s as (select run, turn, sum(cosine * cosine) as sq, avg(cosine) as mean from cos group by 1, 2) select run, turn, m, round(m * m / (m + 2 * coalesce(sq, 0)), 6) as vs2, round(case when m < 2 then 0 else 1 - mean end, 6) as dispersion from m left join s using (run, turn)",
    "distant_peers": f"with {_W}, both_ways as (select run, turn, a as seat, b as peer, round(cosine, 9) as cosine from cos union all select run, turn, b, a, round(cosine, 9) from cos) select run, turn, seat, peer, r from (select *, row_number() over (partition by run, turn, seat order by cosine, peer) as r from both_ways) where r <= 2",
    "stance_entropy": f"{_STANCE} select run, turn, cast(sum(c) as bigint) as n, count(*) as k, round(least(1, greatest(0, (ln(sum(c)) - sum(c * ln(c)) / sum(c) + (count(*) - 1) / (2 * sum(c))) / ln(4))), 6) as entropy from c group by 1, 2",
    "modal_disagreement": f"{_STANCE} select run, turn, round(1 - max(c) / sum(c), 6) as modal from c group by 1, 2",
    "contestedness": f"with t as (select doc_id, lower(coalesce(text, '')) as x from (select distinct on (passage_seq) * from passages)), per as (select doc_id, sum({_COS_MARKS}) as marks, sum(len(list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda w: w <> ''))) as words from t group by 1) select doc_id, cast(marks as bigint) as marks, cast(words as bigint) as words, round(case when words > 0 then 1 - exp(-500 * marks / words) else 0 end, 6) as score from per",
    "consensus_docs": f"with {_C}, s as (select run, turn, count(distinct seat) as k from cited group by 1, 2), c as (select run, turn, doc_id, count(distinct seat) as n from cited group by 1, 2, 3) select run, turn, doc_id, n from c join s using (run, turn) where n >= greatest(2, ceil(0.5 * k))",
    "consensus_docs_wide": f"with {_C}, s as (select run, turn, count(distinct seat) as k from cited group by 1, 2), c as (select run, turn, doc_id, count(distinct seat) as n from cited group by 1, 2, 3) select run, turn, doc_id, n from c join s using (run, turn) where n >= greatest(2, ceil(0.1 * k))",
    "contested_docs": f"with {_C} select run, doc_id, count(distinct seat) as n_seats from cited group by 1, 2 having count(distinct seat) > 1",
    "perm_null_evidence": f"""with {_C}, {_JT}, obs as (select run, turn, avg(1 - shared / (na + nb - shared)) as observed from jac group by 1, 2),
s as (select cited.*, p as perm from cited cross join range({DEALS}) r(p)),
mixed as (select *, row_number() over (partition by perm, run, turn order by md5(concat_ws('|', perm, run, turn, seat, doc_id)), seat, doc_id) as slot from s),
places as (select *, row_number() over (partition by perm, run, turn order by seat, doc_id) as slot from s),
dealt as (select distinct p.perm, p.run, p.turn, p.seat, m.doc_id from places p join mixed m using (perm, run, turn, slot)),
dsize as (select perm, run, turn, seat, count(*) as n from dealt group by all),
dshared as (select perm, run, turn, x.seat as a, y.seat as b, count(*) as shared from dealt x join dealt y using (perm, run, turn, doc_id) where x.seat < y.seat group by all),
dj as (select a.perm, a.run, a.turn, avg(1 - coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0))) as m from dsize a join dsize b on a.perm = b.perm and a.run = b.run and a.turn = b.turn and a.seat < b.seat left join dshared d on d.perm = a.perm and d.run = a.run and d.turn = a.turn and d.a = a.seat and d.b = b.seat group by 1, 2, 3),
nul as (select run, turn, avg(m) as nul from dj group by 1, 2)
select run, turn, round(observed, 6) as observed, round(nul, 6) as null_mean, round(case when nul >= 1 then 0 else least(1, greatest(0, (observed - nul) / (1 - nul))) end, 5) as separation, nul < 0.95 as informative from obs join nul using (run, turn)""",
    "novelty": _earlier("run", "round(avg(case when round(most, 9) < 0.8 then 1 else 0 end), 6) as novelty"),
    "self_restatement": _earlier("run, seat", "round(avg(case when round(most, 9) >= 0.8 then 1 else 0 end), 6) as restated"),
    "herding": f"with {_C}, s as (select run, turn, seat, avg(case declared['confidence'] when 'low' then 0 when 'middling' then 1 when 'high' then 2 end) as v from claims where declared['confidence'] in ('low', 'middling', 'high') group by 1, 2, 3), m as (select run, turn, round(v - lag(v) over (partition by run, seat order by turn), 9) as mv from s) select run, turn, count(*) filter (where mv > 0) as toward, count(*) filter (where mv < 0) as away from m group by 1, 2",
    "trajectory": f"with {_C}, s as (select distinct run, turn, doc_id from cited), f as (select *, turn = min(turn) over (partition by run, doc_id) as new from s), per as (select run, turn, count(*) as n_docs, count(*) filter (where new) as n_new from f group by 1, 2) select run, turn, n_docs, n_new, round(n_new / n_docs, 6) as new_share, cast(sum(n_new) over (partition by run order by turn) as bigint) as docs_so_far from per",
    "monitor_llr": f"with recursive {_C}, s as (select distinct run, turn, doc_id from cited), f as (select *, turn = min(turn) over (partition by run, doc_id) as new from s), series as (select run, turn, avg(case when new then 1.0 else 0.0 end) as x from f group by 1, 2), " + LLR.format(run="run", turn="turn", more=", string_agg(cast(round(raw, 6) as varchar), ' ' order by i) as history"),
    "territory": f"with {_C}, {_OWN}, per as (select run, turn, seat, count(o.doc_id) / count(*) as share from cited c left join own o on o.name = c.seat and o.doc_id = c.doc_id group by 1, 2, 3) select run, turn, seat, round(share, 6) as own_share, case when share >= 0.2 then 'home' when share >= 0.05 then 'adjacent' else 'foreign' end as zone from per",
    "evidenced_minority": f"with {_C}, alone as (select run, turn, doc_id, min(seat) as seat from cited group by 1, 2, 3 having count(*) = 1), o as (select run, turn, seat, count(*) as n_only from alone group by 1, 2, 3), low as (select distinct run, turn, seat from claims where declared['confidence'] = 'low') select run, turn, seat, n_only from (select *, row_number() over (partition by run, turn order by n_only desc, seat) as r from o join low using (run, turn, seat)) where r = 1",
    "disclosure_set": f"with {_V}, c as (select run, turn, doc_id, count(distinct seat) as n_seats, count(distinct quote) as n_quotes from verified where status = 'verified' group by 1, 2, 3) select * from (select *, row_number() over (partition by run, turn order by n_seats desc, doc_id) as r from c) where r <= 16",
    "audit_cases": f"with {_V}, gr as (select claim_id from verified group by 1 having count(*) = count(*) filter (where status = 'verified')), st as (select distinct run, turn, seat as reviewer from claims where seat is not null), p as (select passage_id, min(ord) as mid from psg group by 1) select claim_id, cit_no, reviewer, q.passage_seq as near_seq from verified v join gr using (claim_id) join st using (run, turn) join p using (passage_id) join psg q on q.doc_id = v.doc_id and q.ord between mid - 4 and mid + 4 where status = 'verified' and reviewer <> seat",
    "stylometry": f"""with {_C}, c as (select claim_id, seat, turn, unnest({content('text')}) as term from claims where seat is not null), e0 as (select seat, term, ln(1 + count(*)) as w from c where turn <= 2 group by 1, 2), e as (select seat, term, w / sqrt(sum(w * w) over (partition by seat)) as w from e0),
l as (select claim_id, seat, term, ln(1 + count(*)) as v from c where turn > 2 group by 1, 2, 3), s as (select claim_id, l.seat, e.seat as predicted, round(sum(v * w), 9) as s from l join e using (term) group by 1, 2, 3)
select seat, predicted, count(*) as n from (select *, row_number() over (partition by claim_id order by s desc, predicted) as r from s) where r = 1 group by 1, 2""",
    "turn_roster": f"with {_C}, sp as (select run, seat, count(*) as n_claims from claims where seat is not null group by 1, 2) select r.run, s.name as seat, coalesce(n_claims, 0) as n_claims, case when n_claims is null then 'no response' else 'answered' end as state from (select distinct run from claims where run is not null) r cross join seats s left join sp on sp.run = r.run and sp.seat = s.name",
}
