"""Queries that combine packets, citations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.functions.text import content_tokens
from evidora.operators import identity as idn
from evidora.operators import measure as ms
from evidora.operators import neighbourhood as nb
from evidora.operators import scope
from evidora.operators.corpus import current
from evidora.operators.deals import axes_of_turns
from evidora.operators.verify import citations
from evidora.plans import panel, search
from evidora.plans.panel import _C, _CITS, _W
from evidora.plans.sqltext import content
from evidora.session import cut
from evidora.sources.tables import table


def _handed(spark: SparkSession, d: str) -> DataFrame:
    return cut(search.packets(spark, d).select("seat", "passage_seq", "doc_id"))


def out_of_scope(spark: SparkSession, d: str) -> DataFrame:
    """Citations of documents that their seat's packet doesn't hold."""
    cited = citations(table(spark, d, "ledger")).where("doc_id is not null and seat is not null")
    return scope.outside(cited, _handed(spark, d)).select("claim_id", "cit_no", "seat", "doc_id")


def preflight(spark: SparkSession, d: str) -> DataFrame:
    handed = _handed(spark, d)
    words = table(spark, d, "seats").select(F.col("name").alias("seat"), F.explode(content_tokens(F.concat_ws(" ", "display", "probe", "territory"))).alias("term")).groupBy("seat", "term").agg(F.count("*").alias("n"))
    texts = handed.select("passage_seq").distinct().join(search.passages_of(spark, d).select("passage_seq", "text"), "passage_seq").withColumn("k", F.lit(1))
    return scope.preflight(handed.select("seat", "doc_id").distinct(), words, ms.contestedness(texts, "k", "text", panel.MARKERS))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """(run, turn, seat, item, tokens, docs) of the claims of seats."""
    c = panel._claims(spark, d).where("run is not null and turn is not null and seat is not null")
    return c.select("run", "turn", "seat", F.col("claim_id").alias("item"), content_tokens(F.col("text")).alias("tokens"), F.transform("citations", lambda x: x["doc_id"]).alias("docs"))


def panel_axes(spark: SparkSession, d: str) -> DataFrame:
    """The four axes of every turn in long form. Nothing is dealt: a turn has an
    evidence axis where two seats cite, and then it has a null as well."""
    turn = ["run", "turn"]
    axes = axes_of_turns(_tokens(spark, d), turn, 0).select(*turn, "axis", F.when(F.col("axis") == "evidence", F.round("observed", 6)).otherwise(F.col("observed")).alias("observed"))
    st = panel._claims(spark, d).where("run is not null and turn is not null").select(*turn, F.col("declared")["confidence"].alias("s")).where("s is not null")
    st = st.groupBy(*turn).agg(F.avg((F.col("s") != "high").cast("double")).alias("observed")).select(*turn, F.lit("stance").alias("axis"), "observed")
    return axes.unionByName(st).withColumn("observed", F.round("observed", 5))


DEALS, POSITION_DEALS = 200, 8  # 8: max(8, DEALS / 25)


def panel_null(spark: SparkSession, d: str) -> DataFrame:
    """The evidence, lexical and positions axes of every turn beside their mean
    over re-deals: of documents for evidence, of claims for the others. Positions
    aren't corrected by their null."""
    both = axes_of_turns(_tokens(spark, d), ["run", "turn"], DEALS, position_deals=POSITION_DEALS).where(F.col("null").isNotNull())
    raw = F.col("axis") == "positions"
    apart = F.when(raw, F.col("observed")).otherwise(ms.separation(F.col("observed"), F.col("null")))
    return both.select("run", "turn", "axis", F.round("observed", 5).alias("observed"), F.round("null", 5).alias("null_mean"), F.round(apart, 4).alias("separation"), (raw | (F.col("null") < 0.95)).alias("informative"))


def citation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Works to read for each seat: its topics' documents, and what claims that
    cite them cite besides."""
    own = search.own_documents(spark, d).select(F.col("name").alias("seat"), F.col("doc_id").alias("work"))
    c = citations(table(spark, d, "ledger")).where("doc_id is not null").select("claim_id", "cit_no", "doc_id")
    cites = c.where("cit_no = 0").select("claim_id", F.col("doc_id").alias("src")).join(c.where("cit_no > 0").select("claim_id", F.col("doc_id").alias("dst")), "claim_id").select("src", "dst")
    docs, meta = table(spark, d, "docs"), current(table(spark, d, "docmeta"))
    wrote = meta.select(F.col("doc_id").alias("work"), F.explode("authors").alias("a")).select("work", idn.full_name_key(F.col("a")).alias("author")).where("author <> ''")
    return nb.plan(own, cites, docs.select(F.col("doc_id").alias("work")), wrote, docs.select(F.col("doc_id").alias("work"), F.explode("topics").alias("topic")))


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    m = current(table(spark, d, "docmeta")).select("doc_id", idn.document_id(F.col("first_author"), F.col("year"), F.col("venue")).alias("base"), idn.full_name_key(F.col("first_author")).alias("name_key"))
    return idn.disambiguated(m, "base", "doc_id").select("doc_id", "id", "name_key")


QUERIES = {f.__name__: f for f in (out_of_scope, preflight, panel_axes, panel_null, citation_plan, document_ids)}

_PK = search._PACKET_SQL.replace("with ", "", 1)
_CUR = "cur as (select * from docmeta where doc_id is not null qualify row_number() over (partition by doc_id order by seq desc) = 1)"
_PLAIN = f"trim(regexp_replace(translate(lower({{x}}), '{idn.FROM}', '{idn.TO}'), '[^a-z0-9]+', ' ', 'g'))"
_EV = panel.SQL["perm_null_evidence"]
_P = _PLAIN.format


def _dealt(name: str, items: str, item: str, times: int) -> str:
    """CTE ``name``: the items as written (perm -1) and dealt anew."""
    return f"""{name}_s as (select run, turn, seat, {item}, p as perm from {items} cross join range({times}) r(p)),
{name}_m as (select *, row_number() over (partition by perm, run, turn order by md5(concat_ws('|', perm, run, turn, seat, {item})), seat, {item}) as slot from {name}_s),
{name}_p as (select *, row_number() over (partition by perm, run, turn order by seat, {item}) as slot from {name}_s),
{name} as (select distinct p.perm, run, turn, p.seat, m.{item} from {name}_p p join {name}_m m using (perm, run, turn, slot) union all select -1, run, turn, seat, {item} from {items})"""


def _null_sql() -> str:
    pair = "a.perm = b.perm and a.run = b.run and a.turn = b.turn and a.seat < b.seat left join {k} k on k.perm = a.perm and k.run = a.run and k.turn = a.turn and k.a = a.seat and k.b = b.seat"
    same = "using (perm, run, turn, {x}) where x.seat < y.seat group by all"
    return f"""with {_C}, owners as (select run, turn, seat, claim_id from claims where run is not null and turn is not null and seat is not null),
refs as (select run, turn, seat, doc_id from cited where run is not null and turn is not null and seat is not null),
ct as (select claim_id, term, count(*) as n from (select claim_id, unnest({content("text")}) as term from claims) group by 1, 2),
{_dealt("de", "refs", "doc_id", DEALS)}, {_dealt("dc", "owners", "claim_id", DEALS)},
es as (select perm, run, turn, seat, count(*) as n from de group by all), ek as (select perm, run, turn, x.seat as a, y.seat as b, count(*) as sh from de x join de y {same.format(x="doc_id")}),
ev as (select a.perm, a.run, a.turn, avg(1 - coalesce(sh, 0) / (a.n + b.n - coalesce(sh, 0))) as v from es a join es b on {pair.format(k="ek")} group by 1, 2, 3),
tt as (select perm, run, turn, seat, term, sum(n) as n from dc join ct using (claim_id) group by all), tp as (select *, n / sum(n) over (partition by perm, run, turn, seat) as p from tt), ts as (select distinct perm, run, turn, seat from tt),
lk as (select perm, run, turn, x.seat as a, y.seat as b, sum(0.5 * x.p * log2(2 * x.p / (x.p + y.p)) + 0.5 * y.p * log2(2 * y.p / (x.p + y.p)) - 0.5 * x.p - 0.5 * y.p) as part from tp x join tp y {same.format(x="term")}),
lx as (select a.perm, a.run, a.turn, avg(greatest(0, 1 + coalesce(part, 0))) as v from ts a join ts b on {pair.format(k="lk")} group by 1, 2, 3),
pt as (select * from tt where perm < {POSITION_DEALS}), pn as (select perm, run, turn, count(distinct seat) as m from pt group by all), pd as (select perm, run, turn, term, count(*) as df from pt group by all),
pr as (select pt.*, (1 + ln(n)) * (ln((1 + m) / (1 + df)) + 1) as w from pt join pn using (perm, run, turn) join pd using (perm, run, turn, term)), pw as (select *, w / sqrt(sum(w * w) over (partition by perm, run, turn, seat)) as u from pr),
pk as (select perm, run, turn, x.seat as a, y.seat as b, sum(x.u * y.u) as c from pw x join pw y {same.format(x="term")}), pq as (select perm, run, turn, sum(c * c) as sq from pk group by all),
ps as (select perm, run, turn, case when m > 1 then (m * m / (m + 2 * coalesce(sq, 0)) - 1) / (m - 1) else 0 end as v from pn left join pq using (perm, run, turn) where m > 1 or perm >= 0),
every as (select 'evidence' as axis, * from ev union all select 'lexical', * from lx union all select 'positions', * from ps),
o as (select axis, run, turn, v as observed from every where perm = -1), z as (select axis, run, turn, avg(v) as nul from every where perm >= 0 group by all)
select run, turn, axis, round(observed, 5) as observed, round(nul, 5) as null_mean,
round(case when axis = 'positions' then observed when nul >= 1 then 0 else least(1, greatest(0, (observed - nul) / (1 - nul))) end, 4) as separation, axis = 'positions' or nul < 0.95 as informative from o join z using (axis, run, turn)"""

SQL = {
    "out_of_scope": f"with {_PK}, {_CITS}, ho as (select distinct seat, doc_id from packet) select claim_id, cit_no, seat, doc_id from cits c where doc_id is not null and seat is not null and not exists (select 1 from ho where ho.seat = c.seat and ho.doc_id = c.doc_id)",
    "preflight": f"""with {_PK}, ho as (select distinct seat, doc_id from packet), hs as (select seat, count(*) as n from ho group by 1),
pj as (select avg(1 - coalesce(sh, 0) / (a.n + b.n - coalesce(sh, 0))) as packet from hs a join hs b on a.seat < b.seat left join (select x.seat as sa, y.seat as sb, count(*) as sh from ho x join ho y using (doc_id) where x.seat < y.seat group by 1, 2) k on sa = a.seat and sb = b.seat),
ru as (select seat, term, count(*) as n from (select name as seat, unnest({content("concat_ws(' ', display, probe, territory)")}) as term from seats) group by 1, 2), rp as (select *, n / sum(n) over (partition by seat) as p from ru), rs as (select distinct seat from ru),
rk as (select x.seat as a, y.seat as b, sum(0.5 * x.p * log2(2 * x.p / (x.p + y.p)) + 0.5 * y.p * log2(2 * y.p / (x.p + y.p)) - 0.5 * x.p - 0.5 * y.p) as part from rp x join rp y using (term) where x.seat < y.seat group by 1, 2),
rj as (select avg(greatest(0, 1 + coalesce(part, 0))) as rubric from rs a join rs b on a.seat < b.seat left join rk on rk.a = a.seat and rk.b = b.seat),
ct as (select lower(coalesce(text, '')) as x from psg where passage_seq in (select passage_seq from packet)), cs as (select cast(sum({panel._COS_MARKS}) as bigint) as marks, sum(len(list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda w: w <> ''))) as words from ct),
cc as (select round(case when words > 0 then 1 - exp(-500 * marks / words) else 0 end, 6) as contest from cs)
select round(packet, 6) as packet, round(rubric, 6) as rubric, contest, round(greatest(0.4, least(0.9, 0.6 + 0.3 * (packet - 0.5) + 0.2 * (contest - 0.5))), 6) as rho from pj cross join rj cross join cc""",
    "panel_axes": f"""with {_W}, jp as (select *, n / sum(n) over (partition by run, turn, seat) as p from terms), tm as (select distinct run, turn, seat from terms),
jk as (select run, turn, x.seat as a, y.seat as b, sum(0.5 * x.p * log2(2 * x.p / (x.p + y.p)) + 0.5 * y.p * log2(2 * y.p / (x.p + y.p)) - 0.5 * x.p - 0.5 * y.p) as part from jp x join jp y using (run, turn, term) where x.seat < y.seat group by 1, 2, 3, 4),
vm as (select run, turn, count(*) as m from mem group by 1, 2), vs as (select run, turn, sum(cosine * cosine) as sq from cos group by 1, 2)
select run, turn, 'evidence' as axis, round(observed, 5) as observed from ({_EV}) union all
select a.run, a.turn, 'lexical', round(avg(greatest(0, 1 + coalesce(part, 0))), 5) from tm a join tm b on a.run = b.run and a.turn = b.turn and a.seat < b.seat left join jk on jk.run = a.run and jk.turn = a.turn and jk.a = a.seat and jk.b = b.seat group by 1, 2 union all
select run, turn, 'stance', round(avg(case when declared['confidence'] <> 'high' then 1.0 else 0.0 end), 5) from claims where run is not null and turn is not null and declared['confidence'] is not null group by 1, 2 union all
select run, turn, 'positions', round((m * m / (m + 2 * coalesce(sq, 0)) - 1) / (m - 1), 5) from vm left join vs using (run, turn) where m > 1""",
    "panel_null": _null_sql(),
    "citation_plan": f"""with {_C}, {_CUR}, own as (select distinct s.name as seat, d.doc_id as work from (select name, unnest(own_topics) as t from seats) s join (select doc_id, unnest(topics) as t from docs) d using (t)),
e as (select distinct a.doc_id as src, b.doc_id as dst from cits a join cits b using (claim_id) where a.cit_no = 0 and b.cit_no > 0 and a.doc_id <> b.doc_id),
wt as (select dst as work, count(*) as n from e group by 1),
rd as (select seat, dst as work, count(*) as n from own join e on own.work = e.src group by 1, 2 having count(*) >= 2), rd2 as (select * from rd qualify row_number() over (partition by seat order by n desc, work) <= 120),
an as (select seat, work as anchor from own join wt using (work) qualify row_number() over (partition by seat order by n desc, work) <= 10),
wr0 as (select distinct doc_id as work, list_sort(list_filter(string_split({_P(x='a')}, ' '), lambda w: length(w) > 1)) as ks from (select doc_id, unnest(authors) as a from cur)), wr as (select distinct work, array_to_string(ks, ' ') as grp from wr0 where len(ks) >= 2),
co as (select seat, grp from own join wr using (work) group by 1, 2 qualify row_number() over (partition by seat order by count(*) desc, grp) <= 8), tp as (select distinct doc_id as work, unnest(topics) as grp from docs), fi as (select seat, grp from own join tp using (work) group by 1, 2 qualify row_number() over (partition by seat order by count(*) desc, grp) <= 3),
pool as (select seat, 2 as p, 'collaborators' as node, 12 as most, grp, work from co join wr using (grp) union all select seat, 3, 'cited_by', 8, anchor, src from an join e on e.dst = an.anchor union all select seat, 4, 'canon', 30, grp, work from fi join tp using (grp)),
best as (select pool.*, coalesce(wt.n, 0) as n, row_number() over (partition by p, seat, grp order by coalesce(wt.n, 0) desc, work) as r from pool left join wt using (work)),
al as (select seat, work, 0 as p, 'authored' as node, 0 as n from own union all select seat, work, 1, 'reads', n from rd2 union all select seat, work, p, any_value(node), max(n) from best where r <= most group by seat, work, p)
select seat, work, node, n, not exists (select 1 from docs d where d.doc_id = work) as new from (select * from al qualify row_number() over (partition by seat, work order by p) = 1)""",
    "document_ids": f"""with {_CUR}, a as (select doc_id, year, venue, trim(regexp_replace(coalesce(first_author, ''), '\\s+', ' ', 'g')) as q from cur), w as (select *, string_split(q, ' ') as ws from a),
n as (select *, ws[-1] as z, array_to_string(ws[1:len(ws) - 1], ' ') as r from w), f as (select *, case when contains(q, ',') then split_part(q, ',', 1) when len(ws) > 1 and length(z) <= 3 and upper(z) = z then r else regexp_extract(r, '(?i)(?:^|\\s)((?:(?:{"|".join(idn.PARTICLES)})(?:\\s|$))+)$', 1) || ' ' || z end as fam from n),
s as (select *, replace({_P(x="fam")}, ' ', '') as sn, coalesce(nullif(year, 0)::varchar, '') as y, replace({_P(x="coalesce(venue, '')")}, ' ', '')[1:12] as vt from f),
b as (select doc_id, case when sn <> '' then sn || y || case when vt = '' then 'na' else vt end else 'anon' || y || sha256(coalesce(nullif(venue, ''), 'unknown'))[1:10] end as base, list_sort(list_filter(string_split({_P(x="q")}, ' '), lambda w: length(w) > 1)) as ks from s), i as (select *, row_number() over (partition by base order by doc_id) as k from b)
select doc_id, base || case when k = 1 then '' when k <= 27 then chr((k + 95)::int) else 'v' || (k - 26) end as id, case when len(ks) >= 2 then array_to_string(ks, ' ') else '' end as name_key from i""",
}
