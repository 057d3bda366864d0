"""Pieces of SQL that several oracle queries share."""

from __future__ import annotations

import unicodedata

from evidora.functions.text import ACCENTED, CLAIM_STOPWORDS, PLAIN, QUESTION_STOPWORDS, STOPWORDS

STOP, ASKED_STOP, CLAIM_STOP = ("[" + ",".join(f"'{w}'" for w in words) + "]" for words in (STOPWORDS, QUESTION_STOPWORDS, CLAIM_STOPWORDS))


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({x}),'{ACCENTED}','{PLAIN}'),'[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def content(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x},'[A-Za-z][A-Za-z0-9\\-]+'), lambda t: lower(t)), lambda t: length(t) > 2 and not list_contains({CLAIM_STOP}, t))"


def question(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}),'[^a-z0-9]+'), lambda t: length(t) >= 3 and not list_contains({ASKED_STOP}, t) and not regexp_matches(t,'^[0-9]+$'))"


CLAIMS = "claims as (select distinct on (claim_id) * from ledger order by claim_id, ingested_at desc nulls last)"
PSG = "psg as (select distinct on (passage_seq) passage_seq, passage_id, doc_id, ord, section, year, text from passages)"
POST = f"""{PSG},
occ as (select passage_seq, unnest({tok('text')}) as term from psg),
post as (select term, passage_seq, count(*) as tf from occ group by 1, 2),
sizes as (select passage_seq, coalesce(len({tok('text')}), 0) as dl from psg),
whole as (select count(*) as n, avg(dl) as avgdl from sizes),
df as (select term, count(*) as df from post group by 1)"""


def bm25(queries: str, query: str) -> str:
    """CTE ``scores`` over a CTE of (query, term)."""
    return f"""scores as (
  select {query}, p.passage_seq, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score, count(distinct p.term) as hits
  from post p join sizes using (passage_seq) join df using (term) join {queries} q using (term) cross join whole group by 1, 2)"""


# The sequential test as a recursive walk over a CTE ``series`` with a column x.
LLR = """steps as (select {run}, row_number() over (partition by {run} order by {turn}) as i, 4 * ln((1 - least(1 - 1e-6, greatest(1e-6, x))) / least(1 - 1e-6, greatest(1e-6, x))) as inc from series),
walk as (select {run}, i, inc as raw, case when abs(inc) >= ln(19) then 0.0 else inc end as llr, case when abs(inc) >= ln(19) then 1 else 0 end as fired from steps where i = 1
  union all select s.{run}, s.i, w.llr + s.inc, case when abs(w.llr + s.inc) >= ln(19) then 0.0 else w.llr + s.inc end, w.fired + case when abs(w.llr + s.inc) >= ln(19) then 1 else 0 end from walk w join steps s on s.{run} = w.{run} and s.i = w.i + 1)
select {run} as run, round(arg_max(llr, i), 6) as llr, arg_max(fired, i) as fired{more} from walk group by 1"""


def nfkc(x: str) -> str:
    """NFKC of a column as far as one character stands for one, and for the
    signs below that stand for several, in DuckDB, which has only NFC."""
    one = {c: n for c in map(chr, range(0x80, 0x2FA20)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c and c not in "'"}
    for sign in "…ﬀﬁﬂﬃﬄﬅﬆ½¼¾™℃℉№ŀ‼⁇⁈⁉﷼ĳǆ":
        x = f"replace({x}, '{sign}', '{unicodedata.normalize('NFKC', sign)}')"
    plain = "".join(one.values()).replace("'", "''")
    return f"nfc_normalize(translate({x}, '{''.join(one)}', '{plain}'))"
