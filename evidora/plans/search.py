"""Queries of the index and of packet construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions import match
from evidora.functions.text import question_terms
from evidora.operators import index as ix
from evidora.operators import packet as pk
from evidora.operators.measure import overlap_coefficients
from evidora.plans.sqltext import CLAIMS, POST, PSG, bm25, question, tok
from evidora.session import cut
from evidora.sources.files import mark, once_written, shared_folder
from evidora.sources.tables import table


def passages_of(spark: SparkSession, d: str) -> DataFrame:
    return ix.once(table(spark, d, "passages"))


def item_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", F.explode(question_terms(F.col("text"))).alias("term"))


def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """What the written index holds, by table."""
    i = ix.open_index(spark, d)
    parts = {"passages": i.places, "terms": i.terms, "titles": i.titles}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    rows += [i.terms.agg(F.sum("df").alias("n")).select(F.lit("postings").alias("part"), "n"), i.terms.agg(F.sum("cf").alias("n")).select(F.lit("words").alias("part"), "n")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def index_alignment(spark: SparkSession, d: str) -> DataFrame:
    return ix.alignment(ix.open_index(spark, d), table(spark, d, "passages"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = ix.bm25(ix.open_index(spark, d), item_terms(spark, d), "item_id")
    return ix.top(scores, "item_id", 10).select("item_id", "rank", "passage_seq", F.round("score", 5).alias("score"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.open_index(spark, d).terms


def title_vocab(spark: SparkSession, d: str) -> DataFrame:
    return ix.open_index(spark, d).titles


# Expressions over words of the test tables, one for each form of the grammar.
FORMS = (
    ("or", "reef OR moss"), ("and", "shelf AND film"), ("both", "shelf film"), ("not", "shelf NOT film"), ("phrase", '"second panel"'), ("nested", "(reef OR moss) AND (panel NOT film)"), ("again", "panel OR panel"),
    ("near", "NEAR(panel film, 5)"), ("phrases", '"second panel" OR "the shelf"'), ("accents", "réef OR CAFÉ"), ("signs", "two-year"), ("none", "qqqqq AND reef"),
)


def match_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 passages of an expression of each form."""
    hits = ix.top(ix.match_search(ix.open_index(spark, d), list(FORMS)), "query", 20)
    return hits.select("query", "rank", "passage_seq", F.round("score", 5).alias("score"))


def match_forms(spark: SparkSession, d: str) -> DataFrame:
    """How many passages satisfy an expression of each form."""
    return ix.match_count(ix.open_index(spark, d), list(FORMS))


def _seats(spark: SparkSession, d: str) -> list:
    """The seats are a stated table of chairs, taken to the driver."""
    return table(spark, d, "seats").select("name", "queries", "probe", question_terms(F.concat_ws(" ", "display", "probe", "territory")).alias("terms")).orderBy("name").collect()


def seat_expressions(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [(f"{s['name']}\t{q}", match.quoted(q)) for s in _seats(spark, d) for q in s["queries"]]


def match_expressions(spark: SparkSession, d: str) -> DataFrame:
    """How many passages satisfy each seat's expressions, and its probe as a phrase."""
    asked = [*seat_expressions(spark, d), *[(f"{s['name']}\t\"{s['probe']}\"", f'"{s["probe"]}"') for s in _seats(spark, d)]]
    n = ix.match_count(ix.open_index(spark, d), asked)
    return n.select(F.split("query", "\t")[0].alias("name"), F.split("query", "\t")[1].alias("query"), "n")


TYPES = ("research_article", "review", "thesis", "preprint")


def _scope(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "seats").select(F.explode("own_topics").alias("topic")).distinct()
    shut = spark.createDataFrame([("moss_cover",)], "topic string")
    return ix.admitted(table(spark, d, "docs"), before=2020, since=2000, types=TYPES, topics=topics, without_topics=shut)


_SCOPE_SQL = """scope as (select p.* from psg p where exists (select 1 from docs d where d.doc_id = p.doc_id and d.year < 2020 and d.year >= 2000
  and d.doc_type in ('research_article', 'review', 'thesis', 'preprint')
  and exists (select 1 from (select unnest(d.topics) as t) x where x.t in (select unnest(own_topics) from seats))
  and not exists (select 1 from (select unnest(d.topics) as t) x where x.t = 'moss_cover')))"""


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = ix.filtered_search(ix.open_index(spark, d), seat_expressions(spark, d), _scope(spark, d), 20)
    part = F.split("query", "\t")
    return hits.select(part[0].alias("name"), part[1].alias("query"), "rank", "passage_seq", F.round("score", 5).alias("score"))


def search_absences(spark: SparkSession, d: str) -> DataFrame:
    """Expressions without a hit in scope, with how many passages were examined."""
    asked = [*seat_expressions(spark, d), ("nowhere\tqqqqq", "qqqqq")]
    _, absent = ix.filtered_search(ix.open_index(spark, d), asked, _scope(spark, d), 20)
    return absent.select(F.split("query", "\t")[0].alias("name"), F.split("query", "\t")[1].alias("query"), "examined")


def scope_count(spark: SparkSession, d: str) -> DataFrame:
    places = ix.open_index(spark, d).places.join(_scope(spark, d), "doc_id", "left_semi")
    return places.agg(F.count("*").alias("n_passages"), F.count_distinct("doc_id").alias("n_docs"))


def context_window(spark: SparkSession, d: str) -> DataFrame:
    i = ix.open_index(spark, d)
    seeds = ix.top(ix.match_search(i, seat_expressions(spark, d)), "query", 10).select("query", "passage_seq")
    seeds = seeds.join(i.places.select("passage_seq", "doc_id", "ord"), "passage_seq")
    near = ix.neighbours(seeds, i.places, 1)
    return near.select(F.split("query", "\t")[0].alias("name"), F.split("query", "\t")[1].alias("query"), "passage_seq", "near_seq", "near_ord").distinct()


def focus(index: ix.Index, asked: DataFrame, key: str, n_terms: int = 3, max_share: float = 0.05, min_titles: int = 25) -> DataFrame:
    """(key, focus): the question's rarest terms, joined by AND, of those that
    at least ``min_titles`` titles hold and at most ``max_share`` of all
    passages; questions with fewer than two such terms have none. ``asked`` has
    rows (key, term)."""
    fit = asked.join(index.terms.where(F.col("df") <= max_share * index.n).select("term", "df"), "term").join(index.titles.where(F.col("n_docs") >= min_titles), "term")
    rare = fit.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("df", "term"))).where(F.col("r") <= n_terms)
    one = F.array_join(F.sort_array(F.collect_list(F.struct("r", "term"))).getField("term"), " AND ")
    return rare.groupBy(key).agg(one.alias("focus"), F.count("*").alias("k")).where("k >= 2").select(key, "focus")


def focus_terms(spark: SparkSession, d: str) -> DataFrame:
    return focus(ix.open_index(spark, d), item_terms(spark, d), "item_id")


def focus_terms_wide(spark: SparkSession, d: str) -> DataFrame:
    """As focus_terms, with bounds for small collections."""
    return focus(ix.open_index(spark, d), item_terms(spark, d), "item_id", 3, 0.25, 1)


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents, passages, and documents by topic."""
    docs = table(spark, d, "docs")
    out = docs.select(F.explode("topics").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("topic").alias("dimension"), "value", "n")
    out = out.unionByName(docs.agg(F.count_distinct("doc_id").alias("n")).select(F.lit("docs").alias("dimension"), F.lit("").alias("value"), "n"))
    return out.unionByName(ix.open_index(spark, d).places.agg(F.count("*").alias("n")).select(F.lit("passages").alias("dimension"), F.lit("").alias("value"), "n"))


def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the cited documents; a null title reads as empty, a document
    that isn't held has none."""
    cited = table(spark, d, "ledger").select(F.explode("citations.doc_id").alias("doc_id")).where("doc_id is not null").distinct()
    return cited.join(table(spark, d, "docs").select("doc_id", F.coalesce("title", F.lit("")).alias("title")).distinct(), "doc_id")


def document_passages(spark: SparkSession, d: str) -> DataFrame:
    """The first passages of each document under a seat's topics, in order."""
    own = own_documents(spark, d).select("doc_id").distinct()
    return ix.passages_of(passages_of(spark, d).select("passage_seq", "doc_id", "ord"), own, [0, 1, 2, 5]).select("doc_id", "ord", "passage_seq")


def search_strings(spark: SparkSession, d: str) -> DataFrame:
    """The recall expression of each evaluation item, and its words joined."""
    t = F.col("text")
    return table(spark, d, "eval_items").select("item_id", match.any_of(t).alias("any_of"), F.md5(match.joined(t, "AND")).alias("all_words"))


def own_documents(spark: SparkSession, d: str) -> DataFrame:
    """(name, doc_id): documents under a seat's own topics."""
    topics = table(spark, d, "seats").select("name", F.explode("own_topics").alias("topic"))
    return table(spark, d, "docs").select("doc_id", F.explode("topics").alias("topic")).join(topics, "topic").select("name", "doc_id").distinct()


def examined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(seat, doc_id, place): verified documents that others cited in the last
    turn of a run, most cited first; and their quotes (doc_id, quote)."""
    from evidora.operators.verify import claims

    c = claims(table(spark, d, "ledger")).where("turn is not null")
    c = c.withColumn("_last", F.max("turn").over(Window.partitionBy("run"))).where("turn = _last").select("seat", F.explode("citations").alias("c")).where("seat is not null and c.status = 'verified' and c.doc_id is not null")
    c = cut(c.select("seat", F.col("c.doc_id").alias("doc_id"), F.coalesce("c.quote", F.lit("")).alias("quote")).distinct())
    seats = table(spark, d, "seats").select(F.col("name").alias("reader"))
    n = c.select("seat", "doc_id").distinct().join(seats, F.col("seat") != F.col("reader")).groupBy("reader", "doc_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("n"), "doc_id"))
    return n.select(F.col("reader").alias("seat"), "doc_id", place.alias("place")), c.select("doc_id", "quote").distinct()


SMALL = pk.Budget(own_floor=10, per_query=6, max_passages=90, max_seeds=60, max_per_doc=2, min_docs=30, examine_per_doc=2, max_examine_docs=5)


def _packets(spark: SparkSession, d: str, budget: pk.Budget, max_share: float, min_titles: int) -> DataFrame:
    i = ix.open_index(spark, d)
    seats = _seats(spark, d)
    terms = spark.createDataFrame([(s["name"], t) for s in seats for t in s["terms"]], "seat string, term string")
    sharp = {r["seat"]: r["focus"] for r in focus(i, terms, "seat", 3, max_share, min_titles).collect()}
    asked = [{"seat": s["name"], "terms": s["terms"], "focus": sharp.get(s["name"]), "queries": s["queries"]} for s in seats]
    own = own_documents(spark, d).withColumnRenamed("name", "seat")
    return pk.build(i, table(spark, d, "passages"), asked, own, *examined(spark, d), budget=budget)


def packets(spark: SparkSession, d: str) -> DataFrame:
    """Every seat's packet under the default budget, built once for the present
    tables: what a turn hands out is read, not chosen again."""
    name = "packets-" + "".join(mark(spark, f"{d}/{t}.parquet") for t in ("passages", "docs", "seats", "ledger"))
    folder = once_written(spark, f"{shared_folder(spark)}/{name}", lambda beside: _packets(spark, d, pk.Budget(), 0.05, 25).write.parquet(beside))
    return spark.read.parquet(folder)


def packet_strata(spark: SparkSession, d: str) -> DataFrame:
    """Every seat's packet, built anew."""
    return _packets(spark, d, pk.Budget(), 0.05, 25).select("seat", "stratum", "passage_seq", "pick", "is_own", "is_examined")


def packet_small(spark: SparkSession, d: str) -> DataFrame:
    """Packets under a budget so small that every stratum has work to do."""
    return _packets(spark, d, SMALL, 0.25, 1).select("seat", "stratum", "passage_seq", "pick", "is_own", "is_examined")


def packet_sets(spark: SparkSession, d: str) -> DataFrame:
    return pk.derived(cut(packets(spark, d)), table(spark, d, "seats").select(F.col("name").alias("seat")))


def packet_audit(spark: SparkSession, d: str) -> DataFrame:
    chosen = cut(packets(spark, d).select("seat", "passage_seq")).join(passages_of(spark, d).select("passage_seq", "doc_id", "text"), "passage_seq")
    asked = table(spark, d, "seats").select(F.col("name").alias("seat"), question_terms(F.concat_ws(" ", "display", "probe", "territory")).alias("terms"))
    return pk.audit(chosen, asked, own_documents(spark, d).withColumnRenamed("name", "seat"))


def _gaps(chosen: DataFrame) -> DataFrame:
    order = Window.partitionBy("seat", "doc_id").orderBy("ord", "passage_seq")
    return chosen.withColumn("gap", F.coalesce(F.col("ord") - F.lag("ord").over(order) - 1, F.col("ord")))


def packet_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Packet passages in source order, with how many passages are skipped before each."""
    return _gaps(packets(spark, d)).select("seat", "passage_seq", "gap")


def retrieved_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap coefficient of the document sets of each two seats' packets, and
    whether it is small enough for two seats."""
    sets = cut(packets(spark, d).select("seat", F.col("doc_id").alias("item")).distinct())
    return overlap_coefficients(sets, "seat", "item").withColumn("apart", F.col("overlap") <= 0.35)


def packet_text(spark: SparkSession, d: str) -> DataFrame:
    """Each seat's packet as one text: own documents, then those read, then
    those under examination, each in id order; passages in source order, skipped
    ones marked, and quoted ones of documents under examination."""
    _, quotes = examined(spark, d)
    gaps = cut(_gaps(packets(spark, d)))
    texts = passages_of(spark, d).select("passage_seq", "doc_id", "text").join(gaps.select("passage_seq").distinct(), "passage_seq", "left_semi")
    held = texts.join(quotes.where("quote <> ''"), "doc_id").where(F.col("text").contains(F.col("quote"))).select("passage_seq", F.lit(True).alias("quoted")).distinct()
    rows = gaps.join(texts.drop("doc_id"), "passage_seq").join(held, "passage_seq", "left")
    line = F.concat(F.when(F.col("gap") > 0, F.concat(F.lit("[... "), F.col("gap"), F.lit("]\n"))).otherwise(""), F.when(F.col("quoted") & F.col("is_examined"), "> ").otherwise(""), F.col("text"))
    part = F.when(F.col("is_examined"), 2).when(F.col("is_own"), 0).otherwise(1)
    docs = rows.withColumn("part", part).groupBy("seat", "part", "doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "passage_seq", line.alias("line")))).getField("line"), "\n").alias("body"))
    whole = docs.groupBy("seat").agg(F.array_join(F.sort_array(F.collect_list(F.struct("part", "doc_id", "body"))).getField("body"), "\n\n").alias("packet"))
    return whole.select("seat", F.length("packet").alias("n_chars"), F.md5("packet").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        index_rebuild, index_alignment, bm25_topk, doc_freq, title_vocab, match_ranked, match_forms, match_expressions, filtered_search, search_absences, scope_count, context_window, focus_terms, focus_terms_wide,
        index_stats, title_lookup, document_passages, search_strings, packet_strata, packet_small, packet_sets, packet_audit, packet_gaps, packet_text,
    )
} | {"overlap_coefficient": retrieved_overlap}

_QT = f"""qw as (select seat, term, min(i) as i from (select name as seat, unnest(ws) as term, generate_subscripts(ws, 1) as i from (select name, {question("concat_ws(' ', display, probe, territory)")} as ws from seats)) group by 1, 2),
qt as (select seat, term, cast(row_number() over (partition by seat order by i) - 1 as int) as number from qw)"""
_SQ = f"sq as (select seat, number, query, t as term from (select name as seat, i - 1 as number, q as query, unnest({tok('q')}) as t from (select name, unnest(queries) as q, generate_subscripts(queries, 1) as i from seats)) where t not in ('and', 'or', 'not'))"
_VOCAB = f"vocab as (select term, count(*) as n_docs from (select distinct doc_id, unnest({tok('title')}) as term from docs) where length(term) >= 3 group by 1)"
_WEIGHT = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _focus_sql(asked: str, key: str, max_share: float, min_titles: int) -> str:
    return f"""fit as (select {key}, term, row_number() over (partition by {key} order by df, term) as r from {asked} join df using (term) join vocab using (term) cross join whole where n_docs >= {min_titles} and df <= {max_share} * n),
sharp as (select {key} from fit where r <= 3 group by 1 having count(*) >= 2)"""


_OWN = "own as (select distinct s.name as seat, d.doc_id from (select name, unnest(own_topics) as t from seats) s join (select doc_id, unnest(topics) as t from docs) d using (t))"
_EXAMINED = f"""{CLAIMS}, lastly as (select run, max(turn) as turn from claims group by 1),
shown as (select distinct seat, c.doc_id as doc_id, coalesce(c.quote, '') as quote from (select seat, unnest(citations) as c from claims join lastly using (run, turn)) where seat is not null and c.status = 'verified' and c.doc_id is not null),
exam as (select name as seat, doc_id, row_number() over (partition by name order by count(distinct s.seat) desc, doc_id) as place from seats join shown s on s.seat <> name group by 1, 2)"""


def _stage(at: str, source: str, number: int, order: str, doc_cap: int, cap: str) -> str:
    """A greedy stratum: of the candidates left, by document first, then by seat."""
    return f"""{at}x as (select s.*, (select count(*) from {source} h where h.seat = s.seat and h.doc_id = s.doc_id and h.stratum is not null) as held, (select count(*) from {source} h where h.seat = s.seat and h.stratum is not null) as taken from {source} s where s.stratum is null and s.{order} is not null),
{at}y as (select * from (select *, held + row_number() over (partition by seat, doc_id order by {order}, passage_seq) as nth from {at}x) where nth <= {doc_cap}),
{at}z as (select * from (select *, taken + row_number() over (partition by seat order by {order}, passage_seq) as k from {at}y) where k <= {cap}),
{at} as (select s.* replace (coalesce(s.stratum, case when z.k is not null then {number} end) as stratum, coalesce(s.pick, z.k) as pick) from {source} s left join {at}z z using (seat, passage_seq))"""


def _wider(at: str, source: str, order: str, b: pk.Budget) -> str:
    return f"""{at}n as (select seat, count(distinct doc_id) filter (where stratum is not null) as nd, count(stratum) as taken from {source} group by 1),
{at}x as (select seat, doc_id, arg_min(passage_seq, ({order}, passage_seq)) as passage_seq, min({order}) as o from {source} s where {order} is not null and not exists (select 1 from {source} h where h.seat = s.seat and h.doc_id = s.doc_id and h.stratum is not null) group by 1, 2),
{at}z as (select seat, x.passage_seq, taken + r as k from (select *, row_number() over (partition by seat order by o, passage_seq) as r from {at}x) x join {at}n using (seat) where r <= least({b.min_docs} - nd, {b.seeds} - taken)),
{at} as (select s.* replace (coalesce(s.stratum, case when z.k is not null then 4 end) as stratum, coalesce(s.pick, z.k) as pick) from {source} s left join {at}z z using (seat, passage_seq))"""


def packet_sql(b: pk.Budget, max_share: float, min_titles: int) -> str:
    """CTEs up to ``packet`` (seat, stratum, passage_seq, doc_id, ord, pick, is_own, is_examined)."""
    main = max(b.own_floor, b.seeds - min(max(4, b.seeds // 5), 40))
    return f"""with {POST}, {_QT}, {_SQ}, {_VOCAB}, {_focus_sql("qt", "seat", max_share, min_titles)}, {_OWN}, {_EXAMINED},
units as (select seat, 'focus' as kind, 0 as number, term, 'b' as grp from fit join sharp using (seat) where r <= 3 union all select seat, 'question', 0, term, 'a' from qt
  union all select distinct s.seat, 'both', s.number, q.term, 'a' from qt q join sq s using (seat) union all select seat, 'both', number, term, 'b' from sq union all select seat, 'bare', number, term, 'b' from sq union all select seat, 'term', number, term, 'b' from qt),
need as (select seat, kind, number, count(*) filter (where grp = 'b') as nb, count(*) filter (where grp = 'a') as na from units group by all),
met as (select seat, kind, number, passage_seq, sum({_WEIGHT}) as score, count(*) filter (where grp = 'b') as hb, count(*) filter (where grp = 'a') as ha from units join post using (term) join df using (term) join sizes using (passage_seq) cross join whole group by all),
hits as (select seat, kind, number, rank, passage_seq, doc_id, ord from (select met.*, row_number() over (partition by seat, kind, number order by round(score, 9) desc, passage_seq) as rank from met join need using (seat, kind, number) where hb = nb and (na = 0 or ha > 0)) join psg using (passage_seq) where rank <= {b.per_query} or (rank <= {b.deep} and kind in ('focus', 'question'))),
h as (select *, exists (select 1 from own o where o.seat = hits.seat and o.doc_id = hits.doc_id) as mine, exists (select 1 from own o where o.seat = hits.seat) as owner, rank <= {b.per_query} as near, case kind when 'question' then 0 when 'both' then 1 + number else 1000 + number end as q from hits),
t0 as (select seat, passage_seq, doc_id, ord, cast(null as int) as stratum, cast(null as bigint) as pick, min(rank) filter (where kind = 'focus' and near) as o0, min((rank, kind <> 'focus')) filter (where mine and kind in ('focus', 'question')) as o1, min((rank, q)) filter (where near and kind in ('question', 'both', 'bare')) as o2,
  min(case when kind = 'focus' and near then (0, 0, rank) when owner and kind in ('focus', 'question') then (1, (kind <> 'focus')::int, rank) when near and kind <> 'focus' then (2, q, rank) end) as seen, min(rank) filter (where kind = 'question') as deep from h where kind <> 'term' group by 1, 2, 3, 4),
{_stage("t1", "t0", 0, "o0", b.max_per_doc, str(min(b.seeds, max(8, b.seeds // 4))))},
{_stage("t2", "t1", 1, "o1", b.max_per_doc, f"least({b.own_floor} + taken, {b.seeds})")},
{_stage("t3", "t2", 2, "o2", b.max_per_doc, str(main))},
body as (select seat, passage_seq, lower(text) as text from t3 join psg using (passage_seq) where stratum is not null),
miss as (select seat, number from qt where not exists (select 1 from body where body.seat = qt.seat and contains(body.text, qt.term))),
more as (select seat, passage_seq, doc_id, ord, min((number, rank)) as o3 from h join miss using (seat, number) where kind = 'term' group by 1, 2, 3, 4),
t4 as (select seat, passage_seq, doc_id, ord, stratum, pick, coalesce(seen, case when o3 is not null then (3, o3[1], o3[2]) end) as seen, deep, o3 from t3 full join more using (seat, passage_seq, doc_id, ord)),
{_stage("t5", "t4", 3, "o3", max(2, b.max_per_doc // 2), str(b.seeds))},
{_wider("t6", "t5", "seen", b)},
few as (select seat from t6 group by 1 having count(distinct doc_id) filter (where stratum is not null) < {b.min_docs}),
t7 as (select * replace (case when seat in (select seat from few) then deep end as deep) from t6),
{_wider("t8", "t7", "deep", b)},
t9 as (select * replace (coalesce(seen, case when deep is not null then (5, 0, deep) end) as seen) from t8),
{_stage("t10", "t9", 5, "seen", 2 * b.max_per_doc, str(b.seeds))},
seeds as (select seat, passage_seq, doc_id, ord, stratum, pick from t10 where stratum is not null),
earliest as (select seat, doc_id, min(pick) as since from seeds group by 1, 2), full_n as (select seat, count(*) as n from seeds group by 1),
near as (select distinct s.seat, p.passage_seq, p.doc_id, p.ord from seeds s join psg p on p.doc_id = s.doc_id and p.ord between s.ord - {b.neighbours} and s.ord + {b.neighbours} where not exists (select 1 from seeds x where x.seat = s.seat and x.passage_seq = p.passage_seq)),
beside as (select near.*, n, n + row_number() over (partition by seat order by since, ord, passage_seq) as pick from near join earliest using (seat, doc_id) join full_n using (seat)),
plain as (select * from seeds union all select seat, passage_seq, doc_id, ord, 6, pick from beside where pick <= greatest({b.max_passages}, n)),
asked as (select seat, doc_id from exam where place <= {b.max_examine_docs}), anchor as (select distinct p.doc_id, p.ord, p.passage_seq from psg p join shown s on s.doc_id = p.doc_id and s.quote <> '' and contains(p.text, s.quote)),
around as (select distinct p.doc_id, p.ord, p.passage_seq, exists (select 1 from anchor x where x.passage_seq = p.passage_seq) as is_anchor from anchor a join psg p on p.doc_id = a.doc_id and p.ord between a.ord - 1 and a.ord + 1),
picked as (select doc_id, passage_seq, ord from (select *, count(*) filter (where is_anchor) over (partition by doc_id) as na, row_number() over (partition by doc_id order by is_anchor desc, ord, passage_seq) as r from around) where r <= greatest({b.examine_per_doc}, na)
  union all select doc_id, passage_seq, ord from (select *, row_number() over (partition by doc_id order by ord, passage_seq) as r from psg where doc_id in (select doc_id from asked) and doc_id not in (select doc_id from anchor)) where r <= {b.examine_per_doc}),
handed as (select seat, doc_id, passage_seq, ord from asked join picked using (doc_id)),
everything as (select * from plain union all select seat, passage_seq, doc_id, ord, 7, null from handed x where not exists (select 1 from plain p where p.seat = x.seat and p.passage_seq = x.passage_seq)),
packet as (select e.*, exists (select 1 from own o where o.seat = e.seat and o.doc_id = e.doc_id) as is_own, exists (select 1 from handed x where x.seat = e.seat and x.doc_id = e.doc_id) as is_examined from everything e)"""


_PACKET_SQL = packet_sql(pk.Budget(), 0.05, 25)
_TOP = "select {q}, rank, passage_seq, round(score, 5) as score from (select *, row_number() over (partition by {q} order by round(score, 9) desc, passage_seq) as rank from scores) where rank <= {k}"
_ITEMS = f"item_terms as (select distinct item_id, unnest({question('text')}) as term from eval_items)"
# Seats' expressions ask for both of their words.
_SEAT_HITS = f"{_SQ}, sn as (select seat, number, count(*) as k from sq group by 1, 2), scores as (select seat as name, query, passage_seq, sum({_WEIGHT}) as score from sq join sn using (seat, number) join post using (term) join df using (term) join sizes using (passage_seq) cross join whole group by seat, query, number, k, passage_seq having count(*) = k)"
# Units of the expressions of FORMS: tf of words, of phrases by adjacent places, and of words near each other.
_FORMS_SQL = f"""{POST}, pos as (select passage_seq, unnest(ts) as term, generate_subscripts(ts, 1) as i from (select passage_seq, {tok('text')} as ts from psg)),
one as (select term as unit, passage_seq, tf from post where term in ('reef', 'moss', 'shelf', 'film', 'panel', 'cafe')),
two as (select a.term || ' ' || b.term as unit, a.passage_seq, count(*) as tf from pos a join pos b on b.passage_seq = a.passage_seq and b.i = a.i + 1 where (a.term, b.term) in (('second', 'panel'), ('the', 'shelf'), ('two', 'year')) group by 1, 2),
close as (select distinct a.passage_seq, a.i as p, b.i as f from pos a join pos b on b.passage_seq = a.passage_seq where a.term = 'panel' and b.term = 'film' and abs(a.i - b.i) - 1 <= 5),
unit as (select * from one union all select * from two), dfs as (select unit, count(*) as df from unit group by 1),
here as (select passage_seq, list(unit) as us from unit group by 1),
asked as (select * from (values ('or', ['reef', 'moss']), ('and', ['shelf', 'film']), ('both', ['shelf', 'film']), ('not', ['shelf', 'film']), ('phrase', ['second panel']), ('nested', ['reef', 'moss', 'panel', 'film']), ('again', ['panel', 'panel']), ('phrases', ['second panel', 'the shelf']), ('accents', ['reef', 'cafe']), ('signs', ['two year'])) v(query, us)),
each as (select query, u as unit from (select query, unnest(us) as u from asked)),
parts as (select query, passage_seq, df, tf from each join unit using (unit) join dfs using (unit) union all select 'near', passage_seq, df, count(distinct p) from close join dfs on unit = 'panel' group by 1, 2, 3 union all select 'near', passage_seq, df, count(distinct f) from close join dfs on unit = 'film' group by 1, 2, 3),
sums as (select query, passage_seq, sum({_WEIGHT}) as score from parts join sizes using (passage_seq) cross join whole group by 1, 2),
scores as (select query, passage_seq, score from sums left join here using (passage_seq) where case query when 'and' then list_has_all(us, ['shelf', 'film']) when 'both' then list_has_all(us, ['shelf', 'film']) when 'not' then list_contains(us, 'shelf') and not list_contains(us, 'film') when 'nested' then list_has_any(us, ['reef', 'moss']) and list_contains(us, 'panel') and not list_contains(us, 'film') else true end)"""

SQL = {
    "index_rebuild": f"with {POST}, {_VOCAB} select 'passages' as part, count(*) as n from psg union all select 'terms', count(*) from df union all select 'titles', count(*) from vocab union all select 'postings', count(*) from post union all select 'words', count(*) from occ",
    "index_alignment": f"with {PSG}, f as (select passage_seq, unnest({tok('text')}) as term from psg where passage_seq = (select min(passage_seq) from psg where len({tok('text')}) > 0)) select passage_seq, term, true as aligned from f order by length(term) desc, term limit 1",
    "bm25_topk": f"with {POST}, {_ITEMS}, {bm25('item_terms', 'item_id')} {_TOP.format(q='item_id', k=10)}",
    "doc_freq": f"with {POST} select term, count(*) as df, cast(sum(tf) as bigint) as cf from post group by 1",
    "title_vocab": f"with {_VOCAB} select * from vocab",
    "match_ranked": f"with {_FORMS_SQL} {_TOP.format(q='query', k=20)}",
    "match_forms": f"with {_FORMS_SQL} select query, count(passage_seq) as n from (select unnest(['or', 'and', 'both', 'not', 'phrase', 'nested', 'again', 'near', 'phrases', 'accents', 'signs', 'none']) as query) left join scores using (query) group by 1",
    "match_expressions": f"""with {PSG}, t as (select ' ' || array_to_string({tok('text')}, ' ') || ' ' as x from psg),
q as (select name, q as query, list_filter(regexp_split_to_array(lower(replace(q, '"', '')), '[^a-z0-9]+'), lambda w: w <> 'and') as ws, q like '"%' as phrase from (select name, unnest(list_append(queries, '"' || probe || '"')) as q from seats))
select name, query, count(*) filter (where case when phrase then contains(x, ' ' || array_to_string(ws, ' ') || ' ') else contains(x, ' ' || ws[1] || ' ') and contains(x, ' ' || ws[2] || ' ') end) as n from q cross join t group by 1, 2""",
    "filtered_search": f"with {POST}, {_SCOPE_SQL}, {_SEAT_HITS}, inside as (select * from scores where passage_seq in (select passage_seq from scope)) {_TOP.format(q='name, query', k=20).replace('from scores', 'from inside')}",
    "search_absences": f"with {POST}, {_SCOPE_SQL}, {_SEAT_HITS}, asked as (select name, unnest(queries) as query from seats union all select 'nowhere', 'qqqqq') select name, query, (select count(*) from scope) as examined from asked a where not exists (select 1 from scores s where s.name = a.name and s.query = a.query and s.passage_seq in (select passage_seq from scope))",
    "scope_count": f"with {PSG}, {_SCOPE_SQL} select count(*) as n_passages, count(distinct doc_id) as n_docs from scope",
    "context_window": f"with {POST}, {_SEAT_HITS}, hits as ({_TOP.format(q='name, query', k=10)}) select distinct h.name, h.query, h.passage_seq, q.passage_seq as near_seq, q.ord as near_ord from hits h join psg p using (passage_seq) join psg q on q.doc_id = p.doc_id and q.ord between p.ord - 1 and p.ord + 1",
    "focus_terms": f"with {POST}, {_ITEMS}, {_VOCAB}, {_focus_sql('item_terms', 'item_id', 0.05, 25)} select item_id, string_agg(term, ' AND ' order by r) as focus from fit join sharp using (item_id) where r <= 3 group by 1",
    "focus_terms_wide": f"with {POST}, {_ITEMS}, {_VOCAB}, {_focus_sql('item_terms', 'item_id', 0.25, 1)} select item_id, string_agg(term, ' AND ' order by r) as focus from fit join sharp using (item_id) where r <= 3 group by 1",
    "index_stats": f"with {PSG} select 'topic' as dimension, topic as value, count(*) as n from (select unnest(topics) as topic from docs) group by 2 union all select 'docs', '', count(distinct doc_id) from docs union all select 'passages', '', (select count(*) from psg)",
    "title_lookup": "select distinct d.doc_id, coalesce(d.title, '') as title from docs d where d.doc_id in (select c.doc_id from (select unnest(citations) as c from ledger))",
    "document_passages": f"with {PSG}, {_OWN} select doc_id, ord, passage_seq from psg where ord in (0, 1, 2, 5) and doc_id in (select doc_id from own)",
    "search_strings": f"""select item_id, coalesce(string_agg('"' || term || '"', ' OR ' order by i), '') as any_of, md5(array_to_string(list_transform(list_filter(regexp_extract_all(any_value(text), '[A-Za-z0-9][A-Za-z0-9\\-''/.]*'), lambda w: length(w) > 1), lambda w: '"' || w || '"'), ' AND ')) as all_words
from (select item_id, text, term, min(i) as i from (select item_id, text, unnest(ws) as term, generate_subscripts(ws, 1) as i from (select item_id, text, {question('text')} as ws from eval_items)) group by 1, 2, 3) group by item_id""",
    "packet_strata": f"{_PACKET_SQL} select seat, stratum, passage_seq, pick, is_own, is_examined from packet",
    "packet_small": f"{packet_sql(SMALL, 0.25, 1)} select seat, stratum, passage_seq, pick, is_own, is_examined from packet",
    "packet_sets": f"{_PACKET_SQL}, ds as (select distinct seat, doc_id, is_own, is_examined from packet) select name as seat, count(doc_id) as n_permitted, count(*) filter (where not is_examined) as n_evidence, count(*) filter (where is_examined) as n_examined, count(*) filter (where is_own) as n_own from seats left join ds on ds.seat = name group by 1",
    "packet_audit": f"""{_PACKET_SQL}, bodies as (select seat, passage_seq, p.doc_id, text from packet k join psg p using (passage_seq)),
per as (select seat, doc_id, count(*) as n from bodies group by 1, 2),
agg as (select seat, count(*) as n_passages, count(distinct doc_id) as n_docs, cast(sum(length(text)) as bigint) as n_chars from bodies group by 1),
share as (select seat, max(n) / sum(n) as max_doc_share, count(own.doc_id) as own_docs from per left join own using (seat, doc_id) group by 1),
cover as (select t.seat, avg(case when exists (select 1 from bodies b where b.seat = t.seat and contains(lower(b.text), t.term)) then 1.0 else 0.0 end) as coverage from qt t group by 1)
select seat, n_passages, n_docs, own_docs, n_chars, round(max_doc_share, 6) as max_doc_share, round(coverage, 6) as coverage, n_docs < 8 or coverage < 0.55 or max_doc_share > 0.45 as thin from agg join share using (seat) join cover using (seat)""",
    "packet_gaps": f"{_PACKET_SQL} select seat, passage_seq, coalesce(ord - lag(ord) over (partition by seat, doc_id order by ord, passage_seq) - 1, ord) as gap from packet",
    "overlap_coefficient": f"""{_PACKET_SQL}, s as (select distinct seat, doc_id as item from packet), n as (select seat, count(*) as n from s group by 1)
select a.seat as seat_a, b.seat as seat_b, count(*) as shared, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) as overlap, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) <= 0.35 as apart from s a join s b on a.item = b.item and a.seat < b.seat join n x on x.seat = a.seat join n y on y.seat = b.seat group by 1, 2""",
    "packet_text": f"""{_PACKET_SQL}, g as (select k.*, text, coalesce(k.ord - lag(k.ord) over (partition by seat, k.doc_id order by k.ord, passage_seq) - 1, k.ord) as gap from packet k join psg using (passage_seq)),
ds as (select seat, case when is_examined then 2 when is_own then 0 else 1 end as part, doc_id, string_agg(case when gap > 0 then '[... ' || gap || ']' || chr(10) else '' end || case when is_examined and passage_seq in (select passage_seq from anchor) then '> ' else '' end || text, chr(10) order by ord, passage_seq) as body from g group by 1, 2, 3)
select seat, length(string_agg(body, chr(10) || chr(10) order by part, doc_id)) as n_chars, md5(string_agg(body, chr(10) || chr(10) order by part, doc_id)) as digest from ds group by 1""",
}
