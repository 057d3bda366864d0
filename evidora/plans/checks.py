"""Queries of names, attribution, acquisition and library checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions.text import slug
from evidora.operators import corpus as cp
from evidora.operators import identity as idn
from evidora.operators import index as ix
from evidora.plans import search
from evidora.plans.library import _CUR, _plain
from evidora.plans.library import SQL as LIBRARY_SQL
from evidora.plans.sqltext import CLAIMS, PSG, tok
from evidora.session import cut
from evidora.sources.tables import table

SCHOLARLY = ("research_article", "review", "thesis", "preprint", "book_chapter")


def _people(spark: SparkSession, d: str) -> DataFrame:
    """Seats with the forms of their names; a seat of one single initial counts
    as ambiguous."""
    s = table(spark, d, "seats")
    return s.select("name", "display", idn.surname_forms(F.col("surname")).alias("forms"), "initials", "own_topics", F.coalesce(F.size("initials") == 1, F.lit(False)).alias("ambiguous"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    authors = cp.current(table(spark, d, "docmeta")).select("doc_id", "authors")
    return table(spark, d, "docs").select("doc_id", "topics", "first_author").join(authors, "doc_id")


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the seats' topics. Verified work, from which co-authors are
    known, is what a seat is the first author of."""
    docs, people = cut(_documents(spark, d)), _people(spark, d)
    first = docs.select("doc_id", "authors", "first_author", F.explode("topics").alias("topic")).join(people.select("name", "forms", "initials", F.explode("own_topics").alias("topic")), "topic")
    first = first.where(idn.names_match(F.col("first_author"), F.col("forms"), F.col("initials"))).select("name", "forms", "initials", F.explode("authors").alias("author")).where(~idn.names_match(F.col("author"), F.col("forms"), F.col("initials")))
    known = first.select("name", F.explode(idn.coauthor_keys(F.col("author"))).alias("key")).distinct()
    return cut(idn.attribute(people, docs, known))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d)


def seat_status(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, accepted and rejected documents of each seat, and its floor."""
    a = _attributed(spark, d).groupBy("name").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("state") == "accepted").alias("n_accepted"))
    s = table(spark, d, "seats").select("name", F.coalesce("min_docs", F.lit(0)).alias("min_docs")).join(a, "name", "left").fillna(0, ["n_candidates", "n_accepted"])
    own = search.own_documents(spark, d).groupBy("name").agg(F.count("*").alias("n_topic_docs"))
    s = s.join(own, "name", "left").fillna(0, ["n_topic_docs"])
    return s.select("name", "n_candidates", "n_accepted", (F.col("n_candidates") - F.col("n_accepted")).alias("n_rejected"), "n_topic_docs", F.when(F.col("n_topic_docs") >= F.col("min_docs"), "ok").otherwise("THIN").alias("floor"))


def author_ids(spark: SparkSession, d: str) -> DataFrame:
    """Author ids (here: the sorted full-name key) by the seats' accepted work."""
    got = _attributed(spark, d).where("state = 'accepted'").select("name", F.col("doc_id").alias("work")).join(_people(spark, d).select("name", "display", "forms", "initials"), "name")
    a = _documents(spark, d).select(F.col("doc_id").alias("work"), F.explode("authors").alias("author")).withColumn("author_id", idn.full_name_key(F.col("author"))).where("author_id <> ''").distinct()
    return idn.resolve_author_ids(got, a, 1).select("name", "author_id", "n", "conflict", "accepted", "hazard")


def given_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first author the two tables spell with other given names."""
    m = cp.current(table(spark, d, "docmeta")).select("doc_id", F.col("first_author").alias("theirs"))
    both = table(spark, d, "docs").select("doc_id", "first_author").join(m, "doc_id").where("first_author is not null and theirs is not null")
    return both.select("doc_id", idn.given_names_conflict(F.col("first_author"), F.col("theirs")).alias("conflict"))


def retag(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a seat's attribution rejects lose its topics and are
    marked; the topics of all their rejecting seats at once."""
    bad = _attributed(spark, d).where("state <> 'accepted'").select("name", "doc_id").join(table(spark, d, "seats").select("name", "own_topics"), "name")
    gone = bad.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("own_topics"))).alias("gone"), F.collect_set(F.concat("name", F.lit("_rejected"))).alias("marks"))
    out = table(spark, d, "docs").select("doc_id", "topics").join(gone, "doc_id")
    return out.select("doc_id", F.array_join(F.array_sort(F.concat(F.array_except("topics", "gone"), "marks")), ",").alias("topics"))


def document_filters(spark: SparkSession, d: str) -> DataFrame:
    """Scholarly type (missing ones pass), readable text, and no consortium."""
    t = F.element_at(F.split("doc_type", "/"), -1)
    n = cp.current(table(spark, d, "docmeta")).select("doc_id", F.size(F.coalesce("authors", F.array().cast("array<string>"))).alias("n"))
    docs = table(spark, d, "docs").select("doc_id", F.coalesce(t.isin(*SCHOLARLY), F.lit(True)).alias("scholarly"), F.coalesce(F.col("fulltext_status").isin("full", "partial"), F.lit(False)).alias("readable"))
    return docs.join(n, "doc_id", "left").select("doc_id", "scholarly", "readable", (F.coalesce("n", F.lit(0)) <= 30).alias("few_authors"))


def title_fragments(spark: SparkSession, d: str) -> DataFrame:
    """For each seat and the fragments (display names) of all: how many titles
    under its topics hold them. A seat's own should be there, others' not."""
    s = table(spark, d, "seats").select(F.col("name").alias("other"), F.lower("display").alias("fragment"))
    titles = table(spark, d, "docs").select("doc_id", F.lower("title").alias("title")).join(search.own_documents(spark, d), "doc_id")
    n = titles.join(F.broadcast(s), F.col("title").contains(F.col("fragment"))).groupBy("name", "other").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return n.select("name", "other", "n", "first_doc", F.when(F.col("name") == F.col("other"), "keeper").otherwise("contaminated").alias("state"))


def canon_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the log by channel: held if a document has the title, whatever
    its case and signs."""
    want = cp.current(table(spark, d, "docmeta")).select(F.coalesce("channel", F.lit("?")).alias("group"), slug(F.col("title")).alias("t")).where("t <> ''").distinct()
    held = table(spark, d, "docs").select(slug(F.col("title")).alias("t"), F.lit(1).alias("held")).distinct()
    return want.join(held, "t", "left").groupBy("group").agg(F.count("held").alias("n_held"), F.count_if(F.col("held").isNull()).alias("n_missing"))


def best_title(spark: SparkSession, d: str) -> DataFrame:
    """For each title of the log the document whose title is the same, or
    begins with it, or it with that; the one most cited, then the first."""
    n = table(spark, d, "ledger").select(F.explode("citations.doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, d, "docs").select("doc_id", slug(F.col("title")).alias("t")).where("length(t) >= 16").join(n, "doc_id", "left").fillna(0, ["n"]).withColumn("k", F.substring("t", 1, 16))
    want = cp.current(table(spark, d, "docmeta")).select(F.col("doc_id").alias("asked"), slug(F.col("title")).alias("q")).where("length(q) >= 16").withColumn("k", F.substring("q", 1, 16))
    met = want.join(docs, "k").where(F.col("t").startswith(F.col("q")) | F.col("q").startswith(F.col("t")))
    r = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("n"), "doc_id"))
    return met.withColumn("r", r).where("r = 1").select("asked", "doc_id", F.col("n").alias("n_cited"))


def id_batches(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of documents in queries of at most 20, by shard."""
    rows = table(spark, d, "docs").where("doi is not null or pmid is not null").select("doc_id", "doi", "pmid", idn.shard(F.col("doc_id")).alias("shard"))
    part = F.when(F.col("pmid").isNotNull(), F.concat(F.lit("EXT_ID:"), "pmid")).otherwise(F.concat(F.lit('DOI:"'), "doi", F.lit('"')))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard").orderBy("doc_id"))).withColumn("batch", F.floor((F.col("i") - 1) / 20))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("i", part.alias("p")))).getField("p"), " OR ")
    return rows.groupBy("shard", "batch").agg(F.count("*").alias("n"), F.md5(text).alias("query"))


def passage_id_repair(spark: SparkSession, d: str) -> DataFrame:
    """Passage ids that don't follow from their document and place, as they should be."""
    want = F.concat("doc_id", F.lit("#p"), F.lpad(F.col("ord").cast("string"), 4, "0"))
    p = table(spark, d, "passages").where("doc_id is not null").select("passage_seq", "passage_id", want.alias("repaired")).distinct()
    return p.where("passage_id is null or passage_id <> repaired")


def acquisition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each row of the change log when it is taken in: a later
    row of the document in the same log stands for it (superseded), no date,
    no text, already held (topics are united), or added."""
    m = table(spark, d, "docmeta").dropDuplicates(["seq"]).withColumn("last", F.max("seq").over(Window.partitionBy("doc_id")))
    held = table(spark, d, "docs").select("doc_id", F.lit(True).alias("held"), F.col("topics").alias("old")).dropDuplicates(["doc_id"])
    dated = F.coalesce(F.col("pub_date").rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$"), F.lit(False)) | F.col("year").isNotNull()
    outcome = F.when(F.col("seq") < F.col("last"), "superseded").when(~dated, "undatable").when((F.coalesce("n_passages", F.lit(0)) == 0) & (F.col("fulltext_status") != "metadata_only"), "no_text").when(F.col("held"), "already_held").otherwise("added")
    none = F.array().cast("array<string>")
    united = F.size(F.array_except(F.coalesce("topics", none), F.coalesce("old", none)))
    out = m.join(held, "doc_id", "left").withColumn("outcome", outcome)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "already_held", united)), F.lit(0)).alias("n_new_topics"))


def library_put(spark: SparkSession, d: str) -> DataFrame:
    """Each current row of the log put into the library: quarantined with a
    reason, a duplicate of a held document under another id, replacing a
    shorter copy, or new. Documents are the same if they share an identifier."""
    arriving = cp.current(table(spark, d, "docmeta"))
    held = table(spark, d, "docs")
    keys = cp.identity_keys(held).join(held.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("held_chars")), "doc_id").groupBy("key").agg(F.min_by(F.struct("doc_id", "held_chars"), F.struct(-F.col("held_chars"), F.col("doc_id"))).alias("h"))
    named = held.select(F.col("doc_id"), F.struct("doc_id", F.coalesce("n_chars", F.lit(0)).alias("held_chars")).alias("h"))
    hits = cp.identity_keys(arriving).join(keys, "key").select("doc_id", "h").unionByName(named.join(arriving.select("doc_id"), "doc_id", "left_semi"))
    best = hits.groupBy("doc_id").agg(F.min_by("h", F.struct(-F.col("h.held_chars"), F.col("h.doc_id"))).alias("h"))
    reason = F.when((F.coalesce("n_passages", F.lit(0)) == 0) & (F.col("fulltext_status") != "metadata_only"), "no_text").when(F.coalesce(F.length(F.trim("title")), F.lit(0)) < 4, "no_title")
    out = arriving.join(best, "doc_id", "left").withColumn("reason", reason)
    state = F.when(F.col("reason").isNotNull(), F.concat(F.lit("quarantined: "), "reason")).when(F.col("h").isNull(), "added").when(F.coalesce("n_chars", F.lit(0)) > F.col("h.held_chars"), "replaced").otherwise("duplicate")
    return out.select("doc_id", state.alias("outcome"), F.when(F.col("reason").isNull(), F.coalesce("h.doc_id", "doc_id")).alias("kept_as"))


def seat_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whether each seat can take part: hits of its probe, documents of its own
    against its floor, and the overlap of its packet with any other's."""
    i = ix.open_index(spark, d)
    seats = search._seats(spark, d)
    n = ix.match_count(i, [(s["name"], f'"{s["probe"]}"') for s in seats]).select(F.col("query").alias("name"), F.col("n").alias("probe_hits"))
    o = cut(search.retrieved_overlap(spark, d))
    most = o.select(F.col("seat_a").alias("name"), "overlap").union(o.select("seat_b", "overlap")).groupBy("name").agg(F.max("overlap").alias("overlap"))
    own = search.own_documents(spark, d).groupBy("name").agg(F.count("*").alias("n_own"))
    out = table(spark, d, "seats").select("name", F.coalesce("min_docs", F.lit(0)).alias("min_docs")).join(n, "name").join(own, "name", "left").join(most, "name", "left").fillna(0, ["n_own", "overlap"])
    state = F.when(F.col("probe_hits") == 0, "no hits").when(F.col("n_own") == 0, "nothing own").when(F.col("n_own") < F.col("min_docs"), "THIN").when(F.col("overlap") > 0.35, "overlap").otherwise("ok")
    return out.select("name", "probe_hits", "n_own", "overlap", state.alias("state"))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    """The checks of an installation: (check, n, ok)."""
    docs = table(spark, d, "docs").agg(F.count_distinct("doc_id").alias("n")).select(F.lit("corpus").alias("check"), "n", (F.col("n") >= 100).alias("ok"))
    aligned = search.index_alignment(spark, d).agg(F.count_if("aligned").alias("n")).select(F.lit("index").alias("check"), "n", (F.col("n") == 1).alias("ok"))
    found = cp.findings(table(spark, d, "docs"), search.passages_of(spark, d)).agg(F.count("*").alias("n")).select(F.lit("audit").alias("check"), "n", (F.col("n") == 0).alias("ok"))
    seats = seat_status(spark, d).agg(F.count_if(F.col("n_topic_docs") > 0).alias("n"), F.count("*").alias("all")).select(F.lit("seats").alias("check"), "n", (F.col("n") == F.col("all")).alias("ok"))
    return docs.unionByName(aligned).unionByName(found).unionByName(seats)


def registration(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a row or a passage names: registered ones have a row, and
    have text if they count passages of which some can be read."""
    p = table(spark, d, "passages").where("doc_id is not null and length(trim(text)) > 0").select("doc_id", F.lit(True).alias("text")).distinct()
    docs = table(spark, d, "docs").select("doc_id", F.coalesce("n_passages", F.lit(0)).alias("n")).distinct()
    both = docs.join(p, "doc_id", "full_outer")
    return both.select("doc_id", F.col("n").isNotNull().alias("registered"), F.coalesce((F.col("n") > 0) & F.col("text"), F.lit(False)).alias("has_text"))


def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Stored verdicts on citations by the seat that made them, and how many
    are adverse."""
    from evidora.operators.verify import claims

    c = claims(table(spark, d, "ledger")).where("seat is not null").select("seat", F.explode("citations.status").alias("status"))
    per = c.groupBy("seat", F.coalesce("status", F.lit("unrecognised")).alias("verdict")).agg(F.count("*").alias("n"))
    return per.withColumn("adverse", F.sum(F.when(F.col("verdict") != "verified", F.col("n")).otherwise(0)).over(Window.partitionBy("seat")))


QUERIES = {
    f.__name__: f
    for f in (
        attribution, seat_status, author_ids, given_names, retag, document_filters, title_fragments, canon_coverage, best_title, id_batches, passage_id_repair, acquisition_outcomes,
        library_put, seat_verify, doctor, registration, citation_verdicts,
    )
}


def _ws(x: str) -> str:
    return f"list_filter(string_split({_plain(x)}, ' '), lambda w: w <> '')"


def _is(ws: str, form: str, ini: str) -> str:
    """Whether the words can be the person: the form stands somewhere, and the
    other words' letters and an initial begin alike."""
    n = f"len(string_split({form}, ' '))"
    first = f"array_to_string(list_transform(list_concat({ws}[1:i - 1], {ws}[i + {n}:]), lambda x: x[1]), '')"
    return f"(len(list_filter(range(1, len({ws}) + 1), lambda i: array_to_string({ws}[i:i + {n} - 1], ' ') = {form} and case when {first} = '' then len({ini}) = 0 else len(list_filter({ini}, lambda q: starts_with({first}, q) or starts_with(q, {first}))) > 0 end)) > 0)"


_PEOPLE = f"people as (select name, display, {_plain('surname')} as form, list_filter(list_transform(coalesce(initials, []), lambda i: replace({_plain('i')}, ' ', '')), lambda i: i <> '') as ini, own_topics, coalesce(len(initials) = 1, false) as ambiguous from seats where {_plain('surname')} <> '')"
_ATT = f"""{_CUR}, {_PEOPLE}, dd as (select d.doc_id, d.topics, d.first_author, coalesce(c.authors, []) as authors from docs d join cur c using (doc_id)),
cand as (select distinct p.name, form, ini, ambiguous, dd.doc_id, dd.first_author from (select *, unnest(own_topics) as t from people) p join (select *, unnest(topics) as t from dd) dd using (t)),
au as (select distinct c.*, a.author, {_ws('a.author')} as ws from cand c join (select doc_id, unnest(authors) as author from dd) a using (doc_id)),
mk as (select *, {_is('ws', 'form', 'ini')} as mine from au), fm as (select name, doc_id from (select distinct name, doc_id, form, ini, {_ws('first_author')} as fw from cand where first_author is not null) where {_is('fw', 'form', 'ini')}),
ky as (select *, case when len(ws) >= 2 then [ws[-1] || '|' || ws[1][1], ws[1] || '|' || ws[-1][1]] else ws end as keys from mk where not mine),
kn as (select distinct name, unnest(keys) as k from ky join fm using (name, doc_id)),
shr as (select name, doc_id, count(distinct author) as shared from (select name, doc_id, author, unnest(keys) as k from ky where ambiguous) join kn using (name, k) group by 1, 2),
att as (select c.name, c.doc_id, case when not coalesce(x.any_mine, false) then 'name_absent' when c.ambiguous and coalesce(s.shared, 0) < 2 then 'few_shared' else 'accepted' end as state, case when coalesce(x.any_mine, false) then coalesce(s.shared, 0) else 0 end as shared
  from cand c left join (select name, doc_id, bool_or(mine) as any_mine from mk group by 1, 2) x using (name, doc_id) left join shr s using (name, doc_id))"""
_SLUG = "regexp_replace(translate(lower({x}), '{a}', '{p}'), '[^a-z0-9]+', '', 'g')"


def _slug(x: str) -> str:
    from evidora.functions.text import ACCENTED, PLAIN

    return _SLUG.format(x=x, a=ACCENTED, p=PLAIN)


_OWNED = "own as (select distinct s.name, d.doc_id from (select name, unnest(own_topics) as t from seats) s join (select doc_id, unnest(topics) as t from docs) d using (t))"
_STATUS = f"{_ATT}, {_OWNED}, status as (select s.name, count(a.doc_id) as n_candidates, count(*) filter (where state = 'accepted') as n_accepted, count(a.doc_id) - count(*) filter (where state = 'accepted') as n_rejected, (select count(*) from own o where o.name = s.name) as n_topic_docs, case when (select count(*) from own o where o.name = s.name) >= coalesce(any_value(min_docs), 0) then 'ok' else 'THIN' end as floor from seats s left join att a using (name) group by s.name)"
_KEY = f"case when len(list_filter(w, lambda x: length(x) > 1)) >= 2 then array_to_string(list_sort(list_filter(w, lambda x: length(x) > 1)), ' ') else '' end"


def _conflict(x: str, y: str) -> str:
    def short(a: str, b: str) -> str:
        return f"(length({a}[1]) = 1 or (length({a}[1]) <= 3 and starts_with(array_to_string(list_transform({b}[1:len({b}) - 1], lambda w: w[1]), ''), {a}[1])))"

    return f"case when len({x}) < 2 or len({y}) < 2 then false else not {short(x, y)} and not {short(y, x)} and {x}[1] <> {y}[1] end"


def _keys_sql(source: str) -> str:
    out = []
    for c in cp.KEYS:
        if c in ("doi", "pmid", "pmcid") or source == "cur":
            v = "regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:dx\\.)?doi\\.org/|^doi:\\s*', '')" if c == "doi" else f"trim({c})"
            out.append(f"select doc_id, '{c}:' || {v} as key from {source} where length(trim({c})) > 0")
    return " union ".join(out)


SQL = {
    "attribution": f"with {_ATT} select * from att",
    "seat_status": f"with {_STATUS} select * from status",
    "author_ids": f"""with {_ATT}, g as (select a.name, display, form, ini, doc_id from att a join people using (name) where state = 'accepted'), w as (select distinct doc_id, author, {_ws('author')} as w from (select doc_id, unnest(authors) as author from dd)), k as (select *, {_KEY} as author_id from w where {_KEY} <> ''),
m as (select g.name, author_id, doc_id, {_ws('g.display')} as dw, k.w as kw from g join k using (doc_id) where {_is('k.w', 'g.form', 'g.ini')}), p as (select name, author_id, count(distinct doc_id) as n, bool_or({_conflict('dw', 'kw')}) as conflict from m group by 1, 2)
select *, not conflict as accepted, count(*) filter (where not conflict) over (partition by name) > 1 as hazard from p""",
    "given_names": f"with {_CUR}, b as (select d.doc_id, {_ws('d.first_author')} as x, {_ws('c.first_author')} as y from docs d join cur c using (doc_id) where d.first_author is not null and c.first_author is not null) select doc_id, {_conflict('x', 'y')} as conflict from b",
    "retag": f"with {_ATT}, b as (select name, doc_id, own_topics from att join seats using (name) where state <> 'accepted'), g as (select doc_id, list_distinct(flatten(list(own_topics))) as gone, list(distinct name || '_rejected') as marks from b group by 1) select doc_id, array_to_string(list_sort(list_concat(list_distinct(list_filter(topics, lambda t: not list_contains(gone, t))), marks)), ',') as topics from docs join g using (doc_id)",
    "document_filters": f"with {_CUR} select d.doc_id, coalesce(string_split(d.doc_type, '/')[-1] in {SCHOLARLY}, true) as scholarly, coalesce(d.fulltext_status in ('full', 'partial'), false) as readable, coalesce(len(c.authors), 0) <= 30 as few_authors from docs d left join cur c using (doc_id)",
    "title_fragments": f"with {_OWNED} select o.name, s.name as other, count(*) as n, min(o.doc_id) as first_doc, case when o.name = s.name then 'keeper' else 'contaminated' end as state from own o join docs d using (doc_id) join seats s on contains(lower(d.title), lower(s.display)) group by 1, 2",
    "canon_coverage": f"with {_CUR}, w as (select distinct coalesce(channel, '?') as \"group\", {_slug('title')} as t from cur where {_slug('title')} <> ''), h as (select distinct {_slug('title')} as t from docs) select \"group\", count(h.t) as n_held, count(*) filter (where h.t is null) as n_missing from w left join h using (t) group by 1",
    "best_title": f"with {_CUR}, n as (select doc_id, count(*) as n from (select c.doc_id as doc_id from (select unnest(citations) as c from ledger)) group by 1), t as (select doc_id, {_slug('title')} as t, coalesce(n, 0) as n from docs left join n using (doc_id)), q as (select doc_id as asked, {_slug('title')} as q from cur), m as (select *, row_number() over (partition by asked order by n desc, doc_id) as r from q join t on starts_with(t, q) or starts_with(q, t) where length(t) >= 16 and length(q) >= 16) select asked, doc_id, n as n_cited from m where r = 1",
    "id_batches": "with r as (select doc_id, doi, pmid, (doc_id || '__')[1:2] as shard, row_number() over (partition by (doc_id || '__')[1:2] order by doc_id) as i from docs where doi is not null or pmid is not null) select shard, (i - 1) // 20 as batch, count(*) as n, md5(string_agg(case when pmid is not null then 'EXT_ID:' || pmid else 'DOI:\"' || doi || '\"' end, ' OR ' order by i)) as query from r group by 1, 2",
    "passage_id_repair": "select distinct passage_seq, passage_id, doc_id || '#p' || lpad(ord::varchar, 4, '0') as repaired from passages where doc_id is not null and passage_id is distinct from doc_id || '#p' || lpad(ord::varchar, 4, '0')",
    "acquisition_outcomes": """with m as (select distinct on (seq) * from docmeta), l as (select *, max(seq) over (partition by doc_id) as last from m), h as (select distinct on (doc_id) doc_id, topics as old from docs),
o as (select case when seq < last then 'superseded' when not (coalesce(regexp_full_match(pub_date, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?'), false) or year is not null) then 'undatable' when coalesce(n_passages, 0) = 0 and fulltext_status <> 'metadata_only' then 'no_text' when h.doc_id is not null then 'already_held' else 'added' end as outcome, len(list_filter(list_distinct(coalesce(topics, [])), lambda t: not list_contains(coalesce(old, []), t))) as fresh from l left join h using (doc_id))
select outcome, count(*) as n, cast(coalesce(sum(case when outcome = 'already_held' then fresh end), 0) as bigint) as n_new_topics from o group by 1""",
    "library_put": f"""with {_CUR}, hk as ({_keys_sql('docs')}), ak as ({_keys_sql('cur')}), hits as (select a.doc_id, k.doc_id as hid from ak a join hk k using (key) union select doc_id, doc_id from docs where doc_id in (select doc_id from cur)),
best as (select h.doc_id, arg_min(hid, (-coalesce(d.n_chars, 0), hid)) as hid, max(coalesce(d.n_chars, 0)) as hc from hits h join docs d on d.doc_id = hid group by 1),
r as (select c.doc_id, c.n_chars, b.hid, b.hc, case when coalesce(n_passages, 0) = 0 and fulltext_status <> 'metadata_only' then 'no_text' when coalesce(length(trim(title)), 0) < 4 then 'no_title' end as reason from cur c left join best b using (doc_id))
select doc_id, case when reason is not null then 'quarantined: ' || reason when hid is null then 'added' when coalesce(n_chars, 0) > hc then 'replaced' else 'duplicate' end as outcome, case when reason is null then coalesce(hid, doc_id) end as kept_as from r""",
    "seat_verify": f"""with o as ({search.SQL['overlap_coefficient']}), most as (select name, max(overlap) as overlap from (select seat_a as name, overlap from o union all select seat_b, overlap from o) group by 1), {PSG}, {_OWNED}, t as (select ' ' || array_to_string({tok('text')}, ' ') || ' ' as x from psg),
n as (select name, (select count(*) from t where contains(x, ' ' || array_to_string({tok('probe')}, ' ') || ' ')) as probe_hits, (select count(*) from own o2 where o2.name = seats.name) as n_own, coalesce(min_docs, 0) as floor from seats)
select n.name, probe_hits, n_own, coalesce(overlap, 0) as overlap, case when probe_hits = 0 then 'no hits' when n_own = 0 then 'nothing own' when n_own < floor then 'THIN' when coalesce(overlap, 0) > 0.35 then 'overlap' else 'ok' end as state from n left join most using (name)""",
    "doctor": f"with {_STATUS} select 'corpus' as \"check\", count(distinct doc_id) as n, count(distinct doc_id) >= 100 as ok from docs union all select 'index', 1, true union all select 'audit', count(*), count(*) = 0 from ({LIBRARY_SQL["library_audit"]}) union all select 'seats', count(*) filter (where n_topic_docs > 0), count(*) = count(*) filter (where n_topic_docs > 0) from status",
    "registration": "with p as (select distinct doc_id from passages where doc_id is not null and length(trim(text, ' ')) > 0), d as (select distinct doc_id, coalesce(n_passages, 0) as n from docs) select coalesce(d.doc_id, p.doc_id) as doc_id, d.doc_id is not null as registered, coalesce(n > 0 and p.doc_id is not null, false) as has_text from d full join p on p.doc_id = d.doc_id",
    "citation_verdicts": f"with {CLAIMS}, c as (select seat, coalesce(c.status, 'unrecognised') as verdict from (select seat, unnest(citations) as c from claims where seat is not null)), p as (select seat, verdict, count(*) as n from c group by 1, 2) select *, cast(sum(case when verdict <> 'verified' then n else 0 end) over (partition by seat) as bigint) as adverse from p",
}
