"""Queries of the document store, of names, and of vectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions import text as tx
from evidora.operators import corpus as cp
from evidora.operators import identity as idn
from evidora.operators import measure as ms
from evidora.functions.text import ACCENTED, PLAIN
from evidora.operators.index import once
from evidora.plans.sqltext import LLR, STOP, tok
from evidora.sources.tables import table


def _authored(spark: SparkSession, d: str) -> DataFrame:
    return cp.current(table(spark, d, "docmeta")).select("doc_id", F.explode("authors").alias("author"))


def manifest_current(spark: SparkSession, d: str) -> DataFrame:
    return cp.current(table(spark, d, "docmeta")).select("doc_id", "seq", "title", "fulltext_status", "n_chars")


def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    return cp.aliases(cp.current(table(spark, d, "docmeta")))


def identity_classes(spark: SparkSession, d: str) -> DataFrame:
    return cp.identity_classes(cp.current(table(spark, d, "docmeta")))


def library_merge(spark: SparkSession, d: str) -> DataFrame:
    m = cp.merge(table(spark, d, "docs"), cp.current(table(spark, d, "docmeta")))
    return m.select("doc_id", "outcome", "n_chars", F.array_join("topics", ",").alias("topics"))


def library_audit(spark: SparkSession, d: str) -> DataFrame:
    return cp.findings(table(spark, d, "docs"), once(table(spark, d, "passages")))


def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    return cp.difference(table(spark, d, "docs"), once(table(spark, d, "passages")))


def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return cp.statistics(table(spark, d, "docs"))


def fulltext_class(spark: SparkSession, d: str) -> DataFrame:
    m = cp.current(table(spark, d, "docmeta"))
    return m.select("doc_id", tx.fulltext_class(F.col("n_passages"), F.col("n_chars"), F.col("fulltext_status") == "abstract_only").alias("derived"), "fulltext_status")


def passage_pack(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines packed into passages, by size and digest."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("section", F.lit(None).cast("string"))
    return cp.pack(lines, "doc_id").select("doc_id", "n", "passage_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "docmeta")
    return m.select("seq", tx.doi(F.col("doi")).alias("doi"), tx.extract_year(F.coalesce("pub_date", "retrieved_at")).alias("found_year"), tx.slug(F.col("venue")).alias("venue_slug"), F.coalesce("year", tx.extract_year(F.col("pub_date"))).alias("year_known"), tx.word_count(F.col("title")).cast("int").alias("n_words"), F.sha2(F.col("title"), 256).alias("title_sha")).distinct()


def coauthor_overlap(spark: SparkSession, d: str) -> DataFrame:
    return idn.coauthor_counts(_authored(spark, d))


def reads_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents a seat cites most, at least twice, the first 20."""
    from evidora.operators.verify import citations

    c = citations(table(spark, d, "ledger")).where("seat is not null and doc_id is not null").groupBy("seat", "doc_id").agg(F.count("*").alias("n")).where("n >= 2")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("seat").orderBy(F.desc("n"), "doc_id"))).where("r <= 20")


def holdout_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per topic, the first 5 documents since 2015 with 5 passages or more."""
    t = table(spark, d, "docs").where("year >= 2015 and n_passages >= 5").select("doc_id", "year", F.explode("topics").alias("topic"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("year", "doc_id"))).where("r <= 5").select("topic", "doc_id", "r")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors in long form (label, vec_id, term, w)."""
    v = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("term", "x")).withColumn("x", F.col("x").cast("double"))
    return v.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("vec_id")))).select("label", "vec_id", "term", "w")


def vector_vendi(spark: SparkSession, d: str) -> DataFrame:
    """Order-2 Vendi score of each label. The squared entries of the kernel sum
    to the squared entries of the second-moment matrix, so that no pair of
    vectors is formed: its side is the dimension, not the number of vectors."""
    v = _vectors(spark, d)
    moment = v.select("label", "vec_id", F.col("term").alias("i"), F.col("w").alias("a")).join(v.select("vec_id", F.col("term").alias("j"), F.col("w").alias("b")), "vec_id").groupBy("label", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("m"))
    n = v.select("label", "vec_id").distinct().groupBy("label").agg(F.count("*").alias("n"))
    sq = moment.groupBy("label").agg(F.sum(F.col("m") * F.col("m")).alias("sq"))
    return n.join(sq, "label").select("label", "n", F.round(F.col("n") * F.col("n") / F.col("sq"), 5).alias("vs2"))


def centroid_label(spark: SparkSession, d: str) -> DataFrame:
    """The label whose centroid is nearest each vector: (label, predicted, n)."""
    v = _vectors(spark, d)
    c = v.groupBy("label", "term").agg(F.avg("w").alias("c")).select(F.col("label").alias("predicted"), "term", (F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("label")))).alias("c"))
    s = v.join(F.broadcast(c), "term").groupBy("vec_id", "label", "predicted").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("s"))
    best = s.groupBy("vec_id", "label").agg(F.max_by("predicted", F.struct("s", -F.col("predicted"))).alias("predicted"))
    return best.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def event_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type")
    return ms.entropy(e, ["user_id"], "event_type", 5).select("user_id", "n", "k", F.round("entropy", 6).alias("entropy"), F.round("modal", 6).alias("modal"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties read out of the events' JSON, by day."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count(k).alias("k_n"))


def event_monitor(spark: SparkSession, d: str) -> DataFrame:
    """The sequential test over each day's share of purchases."""
    day = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("x")).withColumn("run", F.lit("all"))
    return ms.monitor(day, "run", "day", "x").select("run", "llr", "fired", F.array_join("history", " ").alias("history"))


def duplicate_versions(spark: SparkSession, d: str) -> DataFrame:
    """Log rows that a later row of the same document supersedes."""
    m = table(spark, d, "docmeta").select("doc_id", "seq").distinct()
    return m.withColumn("last", F.max("seq").over(Window.partitionBy("doc_id"))).where("seq < last")


QUERIES = {
    f.__name__: f
    for f in (manifest_current, alias_groups, identity_classes, library_merge, library_audit, manifest_difference, library_stats, fulltext_class, passage_pack, text_functions, coauthor_overlap, reads_topk, holdout_pairs, vector_vendi, centroid_label, event_entropy, event_properties, event_monitor, duplicate_versions)
}
_CUR = "cur as (select * from docmeta where doc_id is not null qualify row_number() over (partition by doc_id order by seq desc) = 1)"
_PSG = "psg as (select distinct on (passage_seq) passage_seq, passage_id, doc_id, ord, text from passages)"
_CITED = "claims as (select distinct on (claim_id) * from ledger order by claim_id, ingested_at desc nulls last), cits as (select claim_id, run, turn, seat, c.doc_id as doc_id, c.quote as quote from (select *, unnest(citations) as c from claims))"
_KEYS = " union ".join(
    f"select doc_id, '{c}:' || " + ("regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:dx\\.)?doi\\.org/|^doi:\\s*', '')" if c == "doi" else f"trim({c})") + f" as key from cur where length(trim({c})) > 0" for c in cp.KEYS
)


def _plain(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{idn.FROM}', '{idn.TO}'), '[^a-z0-9]+', ' ', 'g'))"


def _class(n: str, c: str, asked: str = "false") -> str:
    return f"case when coalesce({n}, 0) = 0 then 'metadata_only' when coalesce({asked}, false) then 'abstract_only' when coalesce({c}, 0) >= 6000 and coalesce({n}, 0) >= 5 then 'full' else 'partial' end"


_TITLE_WORDS = f"list_distinct(list_filter({tok('title')}, lambda t: length(t) > 3 and not list_contains({STOP}, t)))"
_YEAR = "try_cast(nullif(regexp_extract({x}, '(?:^|[^0-9])((?:18|19)[0-9]{{2}}|20[0-4][0-9])(?:[^0-9]|$)', 1), '') as int)"
_VEC = """v0 as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as term from embeddings), v as (select label, vec_id, term, x / sqrt(sum(x * x) over (partition by vec_id)) as w from v0)"""
SQL = {
    "manifest_current": f"with {_CUR} select doc_id, seq, title, fulltext_status, n_chars from cur",
    "alias_groups": f"with {_CUR}, keys as ({_KEYS}) select key, count(distinct doc_id) as n_docs, min(doc_id) as first_doc from keys group by 1 having count(distinct doc_id) > 1",
    "identity_classes": f"with recursive {_CUR}, keys as ({_KEYS}), shared as (select key from keys group by 1 having count(distinct doc_id) > 1), k as (select * from keys join shared using (key)), reach as (select doc_id, doc_id as other from k union select r.doc_id, b.doc_id from reach r join k a on a.doc_id = r.other join k b on b.key = a.key) select doc_id, min(other) as same_as from reach group by 1",
    "library_merge": f"""with {_CUR}, a as (select doc_id, coalesce(n_chars, 0) as ac, topics as at_ from docs), b as (select doc_id, coalesce(n_chars, 0) as bc, topics as bt from cur)
select doc_id, case when ac is null then 'added' when bc is null then 'kept' when bc > ac then 'replaced' else 'duplicate' end as outcome, greatest(coalesce(ac, 0), coalesce(bc, 0)) as n_chars, array_to_string(list_sort(list_distinct(list_concat(coalesce(at_, []), coalesce(bt, [])))), ',') as topics from a full join b using (doc_id)""",
    "library_audit": f"""with {_PSG}, f as (select doc_id, count(*) as n, sum(length(text)) + count(*) - 1 as chars, count(*) filter (where doc_id || '#p' || lpad(ord::varchar, 4, '0') <> passage_id) as bad, arg_min(text, ord) as head from psg group by 1),
b as (select coalesce(d.doc_id, f.doc_id) as doc_id, d.doc_id is not null as listed, d.title, d.n_passages, d.n_chars, d.fulltext_status, d.pub_date, coalesce(f.n, 0) as n, f.chars, f.bad, f.head, {_TITLE_WORDS} as tw from docs d full join f on f.doc_id = d.doc_id)
select doc_id, finding from (
select doc_id, 'orphan' as finding from b where not listed union all
select doc_id, 'no_text' from b where listed and coalesce(n_passages, 0) > 0 and n = 0 union all
select doc_id, 'count_mismatch' from b where listed and n > 0 and n <> coalesce(n_passages, 0) union all
select doc_id, 'size_mismatch' from b where listed and n > 0 and chars <> coalesce(n_chars, 0) union all
select doc_id, 'status_unsupported' from b where listed and fulltext_status = 'full' and {_class('n_passages', 'n_chars')} <> 'full' union all
select doc_id, 'bad_passage_id' from b where bad > 0 union all
select doc_id, 'title_absent' from b where listed and n > 0 and len(tw) >= 3 and len(list_filter(tw, lambda w: contains(translate(lower(head[1:6000]), '{ACCENTED}', '{PLAIN}'), w))) < 0.34 * len(tw) union all
select doc_id, 'bad_date' from b where listed and not coalesce(regexp_full_match(pub_date, '[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?'), false) union all
select doc_id, 'short_title' from b where listed and coalesce(length(title), 0) < 4)""",
    "manifest_difference": f"with {_PSG}, p as (select doc_id, count(*) as n from psg where doc_id is not null group by 1) select case when d.doc_id is null then 'index_only' when n is null then 'manifest_only' else 'both' end as side, count(*) as n_docs, cast(coalesce(sum(n), 0) as bigint) as n_passages from docs d full join p on p.doc_id = d.doc_id group by 1",
    "library_stats": " union all ".join(f"select '{n}' as dimension, coalesce({x}, '?') as value, count(*) as n_docs, cast(sum(coalesce(n_passages, 0)) as bigint) as n_passages from docs group by 2" for n, x in (("status", "fulltext_status"), ("type", "doc_type"), ("channel", "channel"), ("decade", "cast(year // 10 * 10 as varchar)"))),
    "fulltext_class": f"with {_CUR} select doc_id, {_class('n_passages', 'n_chars', "fulltext_status = 'abstract_only'")} as derived, fulltext_status from cur",
    "passage_pack": """with recursive l as (select doc_id, row_number() over (partition by doc_id order by ord) as i, t from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents) where length(trim(t, ' ')) > 0),
w as (select doc_id, i, t as body, 1 as g from l where i = 1 union all select l.doc_id, l.i, case when length(w.body) < 1500 and length(w.body) + 1 + length(l.t) <= 3000 then w.body || chr(10) || l.t else l.t end, case when length(w.body) < 1500 and length(w.body) + 1 + length(l.t) <= 3000 then w.g else w.g + 1 end from w join l on l.doc_id = w.doc_id and l.i = w.i + 1),
ps as (select doc_id, g, arg_max(body, i) as body from w group by 1, 2)
select doc_id, cast(row_number() over (partition by doc_id order by g) - 1 as int) as n, doc_id || '#p' || lpad(cast(row_number() over (partition by doc_id order by g) - 1 as varchar), 4, '0') as passage_id, cast(length(body) as int) as n_chars, md5(body) as digest from ps where len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) >= 3""",
    "text_functions": f"""select distinct seq, regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:dx\\.)?doi\\.org/|^doi:\\s*', '') as doi, {_YEAR.format(x='coalesce(pub_date, retrieved_at)')} as found_year, regexp_replace(translate(lower(venue), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', '', 'g') as venue_slug,
coalesce(year, {_YEAR.format(x='pub_date')}) as year_known, len(regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9\\-''/.]*')) as n_words, sha256(title) as title_sha from docmeta""",
    "coauthor_overlap": f"""with {_CUR}, w as (select doc_id, list_filter(string_split({_plain('author')}, ' '), lambda x: x <> '') as ws from (select doc_id, unnest(authors) as author from cur)), k as (select distinct doc_id, case when len(ws) >= 2 then ws[-1] || '|' || ws[1][1] else ws[1] end as k from w where len(ws) >= 1), few as (select doc_id from k group by 1 having count(*) <= 30)
select a.k as a, b.k as b, count(*) as n_docs from k a join k b on a.doc_id = b.doc_id and a.k < b.k where a.doc_id in (select doc_id from few) group by 1, 2""",
    "reads_topk": f"with {_CITED}, c as (select seat, doc_id, count(*) as n from cits where seat is not null and doc_id is not null group by 1, 2 having count(*) >= 2) select * from (select *, row_number() over (partition by seat order by n desc, doc_id) as r from c) where r <= 20",
    "holdout_pairs": "select topic, doc_id, r from (select topic, doc_id, row_number() over (partition by topic order by year, doc_id) as r from (select doc_id, year, unnest(topics) as topic from docs where year >= 2015 and n_passages >= 5)) where r <= 5",
    "vector_vendi": f"with {_VEC}, m as (select x.label, x.term as i, y.term as j, sum(x.w * y.w) as m from v x join v y using (vec_id) group by 1, 2, 3), n as (select label, count(distinct vec_id) as n from v group by 1), s as (select label, sum(m * m) as sq from m group by 1) select label, n, round(n * n / sq, 5) as vs2 from n join s using (label)",
    "centroid_label": f"with {_VEC}, c0 as (select label as predicted, term, avg(w) as c from v group by 1, 2), c as (select predicted, term, c / sqrt(sum(c * c) over (partition by predicted)) as c from c0), s as (select vec_id, label, predicted, round(sum(w * c), 9) as s from v join c using (term) group by 1, 2, 3) select label, predicted, count(*) as n from (select *, row_number() over (partition by vec_id, label order by s desc, predicted) as r from s) where r = 1 group by 1, 2",
    "event_entropy": "with c as (select user_id, event_type, count(*) as c from events where event_type is not null group by 1, 2) select user_id, cast(sum(c) as bigint) as n, count(*) as k, round(least(1, greatest(0, (ln(sum(c)) - sum(c * ln(c)) / sum(c) + (count(*) - 1) / (2 * sum(c))) / ln(5))), 6) as entropy, round(1 - max(c) / sum(c), 6) as modal from c group by 1",
    "event_properties": "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k_sum, count(json_extract(props, '$.k')) as k_n from events group by 1, 2",
    "event_monitor": "with recursive series as (select 'all' as run, cast(ts as date) as day, avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as x from events group by 1, 2), " + LLR.format(run="run", turn="day", more=", string_agg(cast(round(raw, 6) as varchar), ' ' order by i) as history"),
    "duplicate_versions": "with s as (select distinct doc_id, seq from docmeta), m as (select *, max(seq) over (partition by doc_id) as last from s) select * from m where seq < last",
}
