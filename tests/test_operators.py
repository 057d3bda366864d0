"""Operators against hand-made cases and sequential models."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.functions import text as tx
from evidora.functions.match import parse, quoted
from evidora.operators import corpus as cp
from evidora.operators import guardrail as gd
from evidora.operators import identity as idn
from evidora.operators import index as ix
from evidora.operators import measure as ms
from evidora.operators import packet as pk
from evidora.operators import verify as vf
from evidora.operators.graph import class_pairs, components

PASSAGES = "passage_seq bigint, passage_id string, doc_id string, ord int, section string, year int, text string"


def test_components_chain_and_ties(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201)]
    out = {r["member"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100 and out[201] == 200 and len(out) == 45


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_random(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    out = {r["member"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_class_pairs_small_and_large(spark):
    rows = [("a", 1), ("b", 1), ("c", 1), ("c", 1)] + [(f"x{i}", 2) for i in range(6)] + [("z", 3)]
    out = {(r[0], r[1]) for r in class_pairs(spark.createDataFrame(rows, "k string, r int"), "k", "r", 5).collect()}
    assert {("a", "b"), ("a", "c"), ("b", "c")} <= out
    assert {p for p in out if p[0].startswith("x")} == {("x0", f"x{i}") for i in range(1, 6)} and len(out) == 8


TEXTS = ["the reef grew and the reef shrank", "salt reef", "", "quiet salt flats near salt pans", "reef reef reef", "café CAFE x_y", "cox 2 trial of salt near the quiet reef", "salt a b c d e f reef", None]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    p = spark.createDataFrame([(i, f"d{i % 3}#p{i}", f"d{i % 3}", i, t) for i, t in enumerate(TEXTS, 1)] + [(1, "d1#p1", "d1", 1, TEXTS[0])], "passage_seq bigint, passage_id string, doc_id string, ord int, text string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    ix.write_index(p, spark.createDataFrame([("d0", "Salt reef"), ("d1", None)], "doc_id string, title string"), folder)
    return ix.Index(spark, folder)


@pytest.fixture(scope="module")
def fts5():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body, tokenize=\"unicode61 remove_diacritics 2\")")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(TEXTS, 1)))
    return con


def test_bm25_equals_fts5(spark, index, fts5):
    want = {r: -s for r, s in fts5.execute("select rowid, bm25(t) from t where t match 'salt OR reef OR cafe'")}
    q = spark.createDataFrame([(1, "salt"), (1, "reef"), (1, "cafe")], "q int, term string")
    got = {r["passage_seq"]: r["score"] for r in ix.bm25(index, q, "q").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


FORMS = ["salt reef", "salt AND reef", "salt OR reef AND quiet", "reef NOT salt", '"salt reef"', '"reef reef"', "(salt OR cafe) AND (reef NOT trial)", "CAFÉ", '"cox 2"', "NEAR(salt reef, 5)", "NEAR(salt reef)", "NEAR(salt reef, 2)", "reef OR reef", 'quiet AND ("salt flats" OR "quiet reef")', "qqq", "qqq OR salt", "reef NOT qqq", "salt NOT (reef OR flats)"]


def test_match_search_equals_fts5(index, fts5):
    got = {}
    for r in ix.match_search(index, [(q, q) for q in FORMS]).collect():
        got.setdefault(r["query"], {})[r["passage_seq"]] = r["score"]
    for q in FORMS:
        want = {r: -s for r, s in fts5.execute("select rowid, bm25(t) from t where t match ?", (q,))}
        assert got.get(q, {}).keys() == want.keys(), q
        assert all(abs(got[q][k] - want[k]) < 1e-9 for k in want), q


def test_index_of_nulls_and_repeated_rows(index):
    assert index.n == 9 and {r["dl"] for r in index.places.where("passage_seq in (3, 9)").collect()} == {0}
    row = index.postings(["reef"]).where("passage_seq = 1").collect()
    assert len(row) == 1 and list(row[0]["positions"]) == [1, 5]
    assert index.titles.count() == 2 and ix.alignment(index, index.spark.createDataFrame([(5, "reef reef reef")], "passage_seq bigint, text string")).first()["aligned"]


def test_open_index_follows_the_files(spark, tmp_path):
    for name in ("passages", "docs"):
        spark.createDataFrame([("d", 1, "d#p1", 1, "a b")], "doc_id string, passage_seq bigint, passage_id string, ord int, text string").withColumn("title", F.lit("one two")).write.parquet(f"{tmp_path}/{name}.parquet")
    first = ix.open_index(spark, str(tmp_path))
    assert ix.open_index(spark, str(tmp_path)).folder == first.folder and first.n == 1
    spark.createDataFrame([("e", 2, "e#p1", 1, "c", "t")], "doc_id string, passage_seq bigint, passage_id string, ord int, text string, title string").write.mode("append").parquet(f"{tmp_path}/passages.parquet")
    assert ix.open_index(spark, str(tmp_path)).n == 2
    with pytest.raises(FileNotFoundError):
        ix.Index(spark, f"{tmp_path}/none")


def test_neighbours_and_document_passages(spark):
    p = spark.createDataFrame([(i, "d", i) for i in range(6)] + [(9, "e", 0)], "passage_seq bigint, doc_id string, ord int")
    seeds = spark.createDataFrame([("d", 0), ("d", 4), ("gone", 1)], "doc_id string, ord int")
    assert sorted(r["near_seq"] for r in ix.neighbours(seeds, p, 1).collect()) == [0, 1, 3, 4, 5]
    assert [r["ord"] for r in ix.passages_of(p, spark.createDataFrame([("d",)], "doc_id string"), [0, 2, 5], 2).orderBy("ord").collect()] == [0, 2]


@pytest.mark.parametrize("bad", ["", "AND a", "(a", "a )", "a OR", "NEAR(a b, x)", "NEAR a"])
def test_malformed_match_raises(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_words_with_signs_are_quoted():
    assert quoted('COX-2 AND (film OR "a-b") NOT 5') == '"COX-2" AND (film OR "a-b") NOT "5"'
    assert quoted(quoted("a/b c.d")) == quoted("a/b c.d") == '"a/b" "c.d"'


def sequential(hits, own, asked, texts, b):
    """The greedy choice of one seat, one passage at a time."""
    chosen, per, pool = {}, {}, {}

    def take(p, doc, cap, doc_cap, stratum):
        if len(chosen) < cap and p not in chosen and per.get(doc, 0) < doc_cap:
            chosen[p] = stratum
            per[doc] = per.get(doc, 0) + 1

    def run(kinds, depth, stage, only=False):
        lists = []
        for kind, number in kinds:
            rows = sorted((r for r in hits if r[0] == kind and r[1] == number and r[2] <= depth), key=lambda r: r[2])
            for r in rows:
                pool.setdefault(r[3], r[4])
            lists.append([r for r in rows if not only or r[4] in own])
        return lists

    def robin(lists, cap, doc_cap, stratum):
        for depth in range(max(map(len, lists), default=0)):
            for rows in lists:
                if depth < len(rows):
                    take(rows[depth][3], rows[depth][4], cap, doc_cap, stratum)

    has_focus = any(r[0] == "focus" for r in hits)
    focus = [("focus", 0)] if has_focus else []
    robin(run(focus, b.per_query, 0), min(b.seeds, max(8, b.seeds // 4)), b.max_per_doc, 0)
    if own:
        cap = min(b.own_floor + len(chosen), b.seeds)
        robin(run([*focus, ("question", 0)], b.deep, 1, True), cap, b.max_per_doc, 1)
    numbers = sorted({r[1] for r in hits if r[0] in ("bare", "both")})
    robin(run([("question", 0), *[("both", n) for n in numbers], *[("bare", n) for n in numbers]], b.per_query, 2), max(b.own_floor, b.seeds - min(max(4, b.seeds // 5), 40)), b.max_per_doc, 2)
    have = " ".join(texts[p] for p in chosen).lower()
    for n, t in enumerate(asked):
        if t not in have:
            robin(run([("term", n)], b.per_query, 3), b.seeds, max(2, b.max_per_doc // 2), 3)
    for more in (pool, None):
        if more is None and len(per) < b.min_docs:
            run([("question", 0)], b.deep, 5)
        for p, doc in pool.items():
            if len(per) < b.min_docs and doc not in per:
                take(p, doc, b.seeds, b.max_per_doc, 4)
    for p, doc in pool.items():
        take(p, doc, b.seeds, 2 * b.max_per_doc, 5)
    return [(p, s) for p, s in chosen.items()]


def test_packets_equal_a_sequential_choice(spark):
    rnd = random.Random(8)
    b = pk.Budget(own_floor=4, per_query=3, max_passages=40, max_seeds=24, max_per_doc=2, min_docs=9)
    rows, owns, want = [], {"u": {"d1", "d2"}, "v": set(), "w": {"d0"}}, {}
    doc = {p: f"d{p % 11}" for p in range(90)}
    texts = {p: rnd.choice(["alpha reef", "beta", "gamma salt", "delta"]) for p in doc}
    asked = {"u": ["alpha", "zeta"], "v": ["salt", "beta", "nu"], "w": ["mu", "delta"]}
    for s in owns:
        mine = []
        kinds = [("question", 0, 120), ("both", 0, 3), ("bare", 0, 3), ("both", 1, 3), ("bare", 1, 3), *[("term", n, 3) for n in range(len(asked[s]))], *([("focus", 0, 30)] if s != "w" else [])]
        for kind, number, depth in kinds:
            found = rnd.sample(range(90), rnd.randrange(min(depth, 60) + 1))
            mine += [(kind, number, r, p, doc[p]) for r, p in enumerate(found, 1)]
        rows += [(s, *m) for m in mine]
        want[s] = sequential(mine, owns[s], asked[s], texts, b)
    hits = spark.createDataFrame([(*r, 0) for r in rows], "seat string, kind string, number int, rank int, passage_seq bigint, doc_id string, ord int")
    own = spark.createDataFrame([(s, x) for s, xs in owns.items() for x in xs], "seat string, doc_id string")
    terms = spark.createDataFrame(list(asked.items()), "seat string, terms array<string>")
    passages = spark.createDataFrame(list(texts.items()), "passage_seq bigint, text string")
    got = {}
    for r in pk.seeds(hits, own, terms, passages, b).orderBy("pick").collect():
        got.setdefault(r["seat"], []).append((r["passage_seq"], r["stratum"]))
    assert got == want


def test_empty_packets_are_thin(spark):
    asked = spark.createDataFrame([("u", ["reef"])], "seat string, terms array<string>")
    row = pk.audit(spark.createDataFrame([], "seat string, passage_seq bigint, doc_id string, text string"), asked, spark.createDataFrame([], "seat string, doc_id string")).first()
    assert row["thin"] and row["n_docs"] == 0
    with pytest.raises(ValueError):
        pk.search_plan([{"seat": "u", "terms": [], "queries": []}])


def test_examination_shows_quotes_and_starts(spark):
    p = spark.createDataFrame([(i, "d", i, f"text {i} here") for i in range(9)] + [(20 + i, "e", i, "other") for i in range(6)], "passage_seq bigint, doc_id string, ord int, text string")
    ask = spark.createDataFrame([("u", "d", 1), ("u", "e", 2), ("u", "f", 3), ("v", "d", 1)], "seat string, doc_id string, place int")
    quotes = spark.createDataFrame([("d", "text 4"), ("d", ""), ("e", "never there")], "doc_id string, quote string")
    shut = spark.createDataFrame([("v", "d")], "seat string, doc_id string")
    out = {(r["seat"], r["passage_seq"]) for r in pk.examination(ask, quotes, p, pk.Budget(examine_per_doc=3), shut).collect()}
    assert out == {("u", 3), ("u", 4), ("u", 5), ("u", 20), ("u", 21), ("u", 22)}


def test_every_verification_status(spark):
    text = "It is — after all — a “quoted” sentence that is long enough to be checked."
    p = spark.createDataFrame([(1, "d1#p0000", "d1", 0, None, 2000, text), (2, "d1#p0001", "d1", 1, None, 2000, text), (3, "d1#p0002", "d1", 2, None, None, None)], PASSAGES)
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    quotes = [("d1", 'IT IS - after all - a "quoted"   sentence that is long'), ("d1", "short"), ("d9", "x" * 50), ("d2", "x" * 50), ("d1", "y" * 50), ("d1", None), (None, "z" * 60)]
    led = spark.createDataFrame([(i, "r", 1, "s", i, d, q) for i, (d, q) in enumerate(quotes)], "claim_id bigint, run string, turn int, seat string, cit_no int, doc_id string, quote string")
    own = spark.createDataFrame([("s", "d1")], "name string, doc_id string")
    out = {r["claim_id"]: (r["status"], r["tier"], r["passage_id"]) for r in vf.verify(led, p, docs, own).collect()}
    assert out[0] == ("verified", "own", "d1#p0000")
    assert [out[i][0] for i in range(1, 7)] == ["too_short", "invented", "doc_not_held", "quote_not_found", "too_short", "invented"]


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "run string, status string")
    claimed = spark.createDataFrame([(None, True, True), ("r", False, False)], "run string, grounded boolean, self_anchored boolean")
    assert vf.report(empty, claimed.limit(0), "run").count() == 0
    out = {r["run"]: (r["n_claims"], r["n_citations"], r["ungrounded"], r["self_anchor"]) for r in vf.report(empty, claimed, "run").collect()}
    assert out == {None: (1, 0, 0.0, 1.0), "r": (1, 0, 0.0, 0.0)}


def test_out_of_scope_is_not_fabrication(spark):
    p = spark.createDataFrame([(1, "d#p0000", "d", 0, None, 2000, "y" * 60)], PASSAGES)
    docs = spark.createDataFrame([("d",)], "doc_id string")
    led = spark.createDataFrame([(1, "r", 1, "s", 0, "d", "y" * 50), (2, "r", 1, "t", 0, "d", "y" * 50), (3, "r", 1, "t", 0, "gone", "y" * 50), (4, "r", 1, "t", 0, "d", "y")], "claim_id bigint, run string, turn int, seat string, cit_no int, doc_id string, quote string")
    handed = spark.createDataFrame([("s", "d")], "seat string, doc_id string")
    out = {r["claim_id"]: r["status"] for r in vf.verify(led, p, docs, permitted=handed).collect()}
    assert out == {1: "verified", 2: "out_of_scope", 3: "invented", 4: "too_short"}
    assert {r["status"] for r in vf.verify(led.where("claim_id < 3"), p, docs, permitted=handed.limit(0)).collect()} == {"out_of_scope"}
    repairs = {r["claim_id"]: r["text"] for r in vf.repair_text(vf.verify(led, p, docs, permitted=handed)).collect()}
    assert repairs == {2: "- citation 0 of d: out_of_scope", 3: "- citation 0 of gone: invented", 4: "- citation 0 of d: too_short"}


def test_js_bounds(spark):
    c = [("g", "a", "x", 2), ("g", "b", "x", 5), ("g", "c", "y", 1)]
    out = {(r["a"], r["b"]): r["divergence"] for r in ms.js_pairs(spark.createDataFrame(c, "g string, s string, term string, n bigint"), ["g"], "s").collect()}
    assert abs(out["a", "b"]) < 1e-12 and abs(out["a", "c"] - 1) < 1e-12


def test_vendi_trace_form_and_truncated(spark):
    terms = [("g", s, t, 1) for s, ts in {"a": "xy", "b": "xy", "c": "z"}.items() for t in ts]
    w = ms.tfidf(spark.createDataFrame(terms, "g string, s string, term string, n bigint"), ["g"], "s")
    cos = ms.cosine_pairs(w, ["g"], "s")
    v = ms.vendi(cos, w, ["g"], "s").first()
    assert abs(v["vs2"] - 9 / 5) < 1e-9 and abs(v["dispersion"] - 2 / 3) < 1e-9
    k = [("g", a, b, 1.0 if a == b else 0.0) for a in "pqr" for b in "pqr"]
    assert abs(ms.truncated_vendi(spark.createDataFrame(k, "g string, a string, b string, k double"), ["g"]).first()["vendi"] - 3) < 1e-9


def test_redeal_keeps_sizes_at_most(spark):
    s = [("r", seat, f"d{i}") for seat, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)]
    out = ms.redeal(spark.createDataFrame(s, "run string, seat string, doc string"), ["run"], "seat", "doc", 5).groupBy("perm", "seat").count().collect()
    assert all(r["count"] <= {"a": 3, "b": 1, "c": 2}[r["seat"]] for r in out) and len({r["perm"] for r in out}) == 5


def test_panel_null_deals_claims_and_documents_200_times(spark):
    from evidora.plans import more, registry

    assert more.DEALS == 200 and more.POSITION_DEALS == max(8, more.DEALS // 25)
    out = registry.QUERIES["panel_null"](spark, "/root/testdata/sf0.001").collect()
    assert {r["axis"] for r in out} == {"evidence", "lexical", "positions"}
    assert all(r["separation"] == round(r["observed"], 4) and r["informative"] for r in out if r["axis"] == "positions")


def _ledger(spark, folder, rows):
    kinds = "claim_id bigint, run string, turn int, seat string, claim_idx int, text string, declared map<string,string>, citations array<struct<doc_id:string,quote:string>>, ingested_at timestamp"
    full = [(i, run, turn, seat, i, text, {"confidence": "high"}, [(c, "") for c in cites], None) for i, (run, turn, seat, text, cites) in enumerate(rows)]
    spark.createDataFrame(full, kinds).write.mode("overwrite").parquet(f"{folder}/ledger.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    import duckdb

    from evidora.plans import registry

    con = duckdb.connect()
    con.execute(f"create view ledger as select * from '{folder}/ledger.parquet/*.parquet'")
    theirs = con.execute(registry.SQL[name])
    columns = [c[0] for c in theirs.description]
    ours = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).select(*columns).collect()]

    def plain(rows):
        return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert plain(ours) == plain(theirs.fetchall()) and ours
    return ours


ODD_TURNS = [
    *[("r", 1, seat, text, docs) for seat, text, docs in (("b", "grain rust spores spores", ["d1", "d2"]), ("a", "rust resistance genes", ["d2", "d3", "d4"]), (None, "barley grain yield", ["d9", "d1"]), ("c", "genes of barley", []), ("c", "", ["d1"]), ("b", "spores drift", ["d5", None]))],
    ("r", 2, "a", "one speaker alone", ["d1"]), (None, 1, "a", "no run", ["d1"]), (None, 1, "b", "no run", ["d2"]), ("r", None, "a", "no turn", ["d1"]), ("r", None, "b", "no turn", ["d2"]),
    ("s", 1, "a", "same words here", ["d1"]), ("s", 1, "b", "same words here", ["d1"]), ("t", 1, "a", "", ["d1"]), ("t", 1, "b", "words", ["d2"]),
]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_deals_of_documents_are_sent_nowhere(spark, tmp_path):
    """the estimate of an exploded table is that of the table, so 200 deals of it were broadcast."""
    from evidora.plans import registry

    d = _ledger(spark, tmp_path, ODD_TURNS)
    _same_as_sql(spark, d, "perm_null_evidence")  # a null seat takes its places last, as in SQL
    plan = _plan(registry.QUERIES["perm_null_evidence"](spark, d))
    assert "Broadcast" not in plan and plan.count("Join") == 0


def test_deals_of_a_large_turn_are_spread_and_blocked(spark, tmp_path, monkeypatch):
    from evidora.operators import deals

    d = _ledger(spark, tmp_path, ODD_TURNS)
    monkeypatch.setattr(deals, "LARGE", 2)
    monkeypatch.setattr(deals, "SPREAD", 7)
    _same_as_sql(spark, d, "perm_null_evidence")
    owner, items, k, n = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 2, 0]), 3, 3
    dealt = deals.orders("r|1", [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), (None, "x")], range(9))
    whole = deals.distances(owner, items, dealt, k, n)
    monkeypatch.setattr(deals, "CELLS", 1)
    assert list(whole) == list(deals.distances(owner, items, dealt, k, n))


def test_deals_are_in_md5_order():
    import hashlib

    from evidora.operators import deals

    places = [(seat, item) for seat in ("a", "b" * 30, "né", None) for item in ("", "x" * 40, "y" * 120, "z" * 54, 7, None)]
    for perms in (range(200), range(95, 104), range(8, 9), range(0)):
        for head in ("run|3", "r" * 31 + "|12"):
            got = deals.orders(head, places, perms)
            want = [sorted(range(len(places)), key=lambda j: (hashlib.md5("|".join(str(x) for x in (p, head, *places[j]) if x is not None).encode()).hexdigest(), j)) for p in perms]
            assert got.tolist() == want


def test_axes_need_no_deals(spark, tmp_path):
    """the axes dealt 200 times for a null that they don't show."""
    from evidora.plans import registry

    d = _ledger(spark, tmp_path, ODD_TURNS)
    _same_as_sql(spark, d, "panel_axes")
    plan = _plan(registry.QUERIES["panel_axes"](spark, d))
    assert "Broadcast" not in plan and plan.count("Join") == 0


def test_panel_null_sends_no_dealt_table(spark, tmp_path):
    """as F2, for deals of claims; a null seat's documents aren't dealt here."""
    from evidora.plans import registry

    d = _ledger(spark, tmp_path, ODD_TURNS)
    _same_as_sql(spark, d, "panel_null")
    plan = _plan(registry.QUERIES["panel_null"](spark, d))
    assert "Broadcast" not in plan and plan.count("Join") == 0


def test_monitor_fires_resets_and_skips_nulls(spark):
    rows = [("p", t, x) for t, x in enumerate([0.5, None, 0.4, 0.2, 0.0])] + [("q", 0, 1.0)]
    out = {r["run"]: r for r in ms.monitor(spark.createDataFrame(rows, "run string, turn int, x double"), "run", "turn", "x").collect()}
    llr, fired, history = 0.0, 0, []
    for x in [0.5, None, 0.4, 0.2, 0.0]:
        if x is not None:
            x = min(1 - 1e-6, max(1e-6, x))
            llr += 4 * math.log((1 - x) / x)
        history.append(round(llr, 6))
        if abs(llr) >= math.log(19):
            llr, fired = 0.0, fired + 1
    assert list(out["p"]["history"]) == history and out["p"]["fired"] == fired == 2 and out["q"]["fired"] == 1


def test_contestedness_of_null_and_marks(spark):
    t = spark.createDataFrame([("a", "This is unclear. Unclear!"), ("b", None), ("c", "")], "k string, t string")
    out = {r["k"]: r for r in ms.contestedness(t, "k", "t", ["unclear"]).collect()}
    assert out["a"]["marks"] == 2 and out["b"]["score"] == 0 == out["c"]["score"]


def test_current_takes_late_rows_in_order(spark):
    m = spark.createDataFrame([("a", 3, "new"), ("a", 1, "old"), ("a", 3, "new"), (None, 9, "x"), ("b", 2, None)], "doc_id string, seq bigint, title string")
    assert {(r["doc_id"], r["title"]) for r in cp.current(m).collect()} == {("a", "new"), ("b", None)}


def test_identity_classes_are_transitive(spark):
    rows = [("a", "10.1/X", None), ("b", "https://doi.org/10.1/x", "p1"), ("c", None, "p1"), ("d", "", "  "), ("e", "10.2/y", None)]
    out = {r["doc_id"]: r["same_as"] for r in cp.identity_classes(spark.createDataFrame(rows, "doc_id string, doi string, pmid string")).collect()}
    assert out == {"a": "a", "b": "a", "c": "a"}


def test_merge_outcomes(spark):
    schema = "doc_id string, n_chars int, topics array<string>"
    a = spark.createDataFrame([("k", 5, ["x"]), ("r", 1, None), ("d", 9, ["y"])], schema)
    b = spark.createDataFrame([("n", 4, ["z"]), ("r", 7, ["w"]), ("d", 9, ["x"])], schema)
    out = {r["doc_id"]: (r["outcome"], r["n_chars"], list(r["topics"])) for r in cp.merge(a, b).collect()}
    assert out == {"k": ("kept", 5, ["x"]), "n": ("added", 4, ["z"]), "r": ("replaced", 7, ["w"]), "d": ("duplicate", 9, ["x", "y"])}


def test_audit_finds_each_class(spark):
    text = "A title of some length stands here. " * 3
    docs = spark.createDataFrame([("a", "Other words entirely unrelated", 2, 5, "full", "2020-13x"), ("b", "Ok title", 3, 10, "partial", "2020"), ("c", "x", 0, 0, "metadata_only", "2020-01")], "doc_id string, title string, n_passages int, n_chars int, fulltext_status string, pub_date string")
    p = spark.createDataFrame([(1, "a#p0009", "a", 0, None, 2020, text), (2, "z#p0000", "z", 0, None, 2020, text)], PASSAGES)
    got = {(r["doc_id"], r["finding"]) for r in cp.findings(docs, p).collect()}
    assert {("a", "count_mismatch"), ("a", "size_mismatch"), ("a", "status_unsupported"), ("a", "bad_passage_id"), ("a", "title_absent"), ("a", "bad_date"), ("b", "no_text"), ("c", "short_title"), ("z", "orphan")} == got


def test_pack_sizes_sections_and_words(spark):
    b = [("d", i, "s1" if i < 4 else "s2", f"w{i} " * 200) for i in range(6)] + [("d", 9, "s3", "two words"), ("e", 0, None, "   "), ("f", 0, None, None)]
    out = cp.pack(spark.createDataFrame(b, "k string, ord int, section string, text string"), "k").orderBy("n").collect()
    assert [r["section"] for r in out] == ["s1", "s1", "s2"] and all(len(r["text"]) <= 3000 for r in out)


def test_name_matching(spark):
    cases = [
        ("Müller, Anna B.", "Muller", None, ["A", "AB"], True), ("B Muller", "Muller", None, ["A"], False), ("Mullerson A", "Muller", None, ["A"], False), ("Muller", "Muller", None, ["A"], False), ("Muller", "Muller", None, [], True), (None, "Muller", None, ["A"], False),
        ("Del Rio M", "Del Rio", None, ["M"], True), ("Rio M", "Del Rio", None, ["M"], False), ("Okafor John S", "Okafor", None, ["S"], False), ("Ndubisi CO", "Okafor Ndubisi", ["Ndubisi"], ["C"], True), ("Okafor Ndubisi C", "Okafor Ndubisi", ["Ndubisi"], ["C"], True), ("Muller A", "Muller", None, [], False),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "a string, s string, o array<string>, i array<string>").withColumn("f", idn.surname_forms(F.col("s"), F.col("o")))
    got = [r[0] for r in df.select(idn.names_match(F.col("a"), F.col("f"), F.col("i"))).collect()]
    assert got == [c[4] for c in cases]


def test_co_authors_decide_for_ambiguous_names(spark):
    seats = spark.createDataFrame([("s", ["varga"], ["l"], ["t"], True), ("none", [], ["l"], ["t"], False)], "name string, forms array<string>, initials array<string>, own_topics array<string>, ambiguous boolean")
    docs = spark.createDataFrame(
        [("real", ["Varga L", "Okoro S", "Mia Chen"], ["t"]), ("alias", ["Varga L", "Okoro S"], ["t"]), ("lone", ["Varga L"], ["t", "u"]), ("other", ["Moss A"], ["t"]), ("off", ["Varga L", "Okoro S", "Mia Chen"], ["u"]), ("nul", None, ["t"])], "doc_id string, authors array<string>, topics array<string>"
    )
    known = spark.createDataFrame([("s", "okoro|s"), ("s", "s|o"), ("s", "chen|m")], "name string, key string")
    out = {r["doc_id"]: (r["state"], r["shared"]) for r in idn.attribute(seats, docs, known).collect()}
    assert out == {"real": ("accepted", 2), "alias": ("few_shared", 1), "lone": ("few_shared", 0), "other": ("name_absent", 0), "nul": ("name_absent", 0)}
    assert {r["state"] for r in idn.attribute(seats, docs).where("doc_id = 'other'").collect()} == {"name_absent"}


def test_given_names_and_author_ids(spark):
    cases = [("Lazlo M. Varga", "L M Varga", False), ("Lazlo Varga", "Laura Varga", True), ("Lazlo M Varga", "LM Varga", False), ("Varga", "Laura Varga", False), (None, "Laura Varga", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    assert [bool(r[0]) for r in df.select(idn.given_names_conflict(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]
    got = spark.createDataFrame([("s", "Lazlo Varga", ["varga"], ["l"], w) for w in "abc"], "name string, display string, forms array<string>, initials array<string>, work string")
    a = spark.createDataFrame([("a", 1, "L Varga"), ("b", 1, "Lazlo Varga"), ("a", 2, "Laura Varga"), ("b", 2, "Laura Varga"), ("c", 3, "Varga L"), ("c", 4, "Moss A")], "work string, author_id int, author string")
    out = {r["author_id"]: (r["n"], r["conflict"], r["accepted"], r["hazard"]) for r in idn.resolve_author_ids(got, a).collect()}
    assert out == {1: (2, False, True, False), 2: (2, True, False, False), 3: (1, True, False, False)}


def test_surnames_and_suffixes(spark):
    cases = [("Example AA", "example"), ("A. A. Example", "example"), ("Example, Alex A.", "example"), ("Jan van der Groningen", "vandergroningen"), ("Del Rio M", "delrio"), ("", ""), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    assert [r[0] for r in df.select(idn.surname_of(F.col("a"))).collect()] == [w for _, w in cases]
    rows = spark.range(30).select(F.lit("x").alias("base"), F.col("id").alias("o"))
    ids = [r["id"] for r in idn.disambiguated(rows, "base", "o").orderBy("o").collect()]
    assert ids[:3] == ["x", "xa", "xb"] and ids[26:] == ["xz", "xv2", "xv3", "xv4"]


def test_the_ladder_is_climbed_not_repeated(spark):
    rows = [("r", t, 9, 4, 4, 0.9 if t == 1 else 0.1, True, 0.8 if t == 1 else 0.05, True, 0.3, 9, None, 0, 0, False) for t in range(1, 12)]
    rows += [("few", 1, 2, 2, 2, 0.9, True, 0.9, True, 0.0, 2, None, 0, 0, False), ("lost", 1, 9, 3, 3, 0.9, True, 0.9, True, 0.0, 9, None, 0, 0, False), ("lost", 2, 9, 3, 3, 0.9, True, 0.9, True, 0.0, 9, 1.0, 1, 0, False), ("fine", 1, 9, 3, 3, 0.5, True, 0.5, True, 0.3, 9, None, 0, 0, False), ("fine", 2, 9, 3, 3, 0.5, True, 0.5, True, 0.3, 9, 1.0, 0, 0, False)]
    s = spark.createDataFrame(rows, "run string, turn int, n_claims bigint, n_seats bigint, n_expected bigint, evidence double, evidence_ok boolean, positions double, positions_ok boolean, dissent double, n_stances bigint, novelty double, lost bigint, n_consensus bigint, has_minority boolean")
    out = {(r["run"], r["turn"]): r for r in gd.standing(s, gd.bands(s, 0.6)).collect()}
    moves = [out["r", t]["move"] for t in range(2, 12)]
    assert moves[0] == gd.LADDER[0] and moves[1] == gd.LADDER[2] and out["r", 3]["skipped"] == 1 and moves[2:4] == [gd.LADDER[3], gd.LADDER[4]] and moves[4] == gd.LADDER[6]
    assert out["r", 6]["verdict"] == "collapsed" and moves[5:] == [gd.LADDER[7]] * 5
    assert out["few", 1]["verdict"] == "undetermined" and out["lost", 2]["verdict"] == "fidelity_lost" and out["fine", 2]["verdict"] == "healthy" and out["fine", 1]["verdict"] == "reference_turn"


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  co-\nop — “x”", "Café_COX-2")], "a string, b string")
    r = df.select(tx.verify_fold(F.col("a")), tx.canonical(F.col("a")), tx.index_tokens(F.col("b")), tx.question_terms(F.lit("What is the COX-2 rate, 2020?")), tx.extract_year(F.lit("in 1999-05")), tx.nfkc(F.lit("ｆull")), tx.fold_name(F.lit("O'Brien-Šmit, J."))).first()
    assert r[0] == 'fine coop - "x"' and r[1] == 'fine coop - "x"' and r[2] == ["cafe", "cox", "2"] and r[3] == ["cox", "rate"] and r[4] == 1999 and r[5] == "full" and r[6] == "o brien smit j"


def test_containment_in_hot_documents(spark):
    from evidora.operators.contain import containing

    rnd = random.Random(6)
    texts = [(i, "hot" if i < 300 else f"d{i % 9}", "".join(rnd.choice("abcd ") for _ in range(120))) for i in range(360)] + [(900, "hot", None), (901, None, "abc")]
    needles = []
    for k in range(150):
        i, d, t = texts[rnd.randrange(360)]
        a, n = rnd.randrange(60), rnd.choice([1, 4, 15, 40])
        needles.append((k, d, t[a : a + n] if k % 5 else t[a : a + n] + "z"))
    needles += [(997, "hot", ""), (998, "hot", None), (999, None, "abc")]
    p, q = spark.createDataFrame(texts, "p_id bigint, doc_id string, body string"), spark.createDataFrame(needles, "q_id bigint, doc_id string, body string")
    want = {(k, i) for k, d, f in needles for i, e, t in texts if f and d and d == e and t and f in t}
    for hot in (10, 10_000):
        assert {(r["q_id"], r["p_id"]) for r in containing(q, p, hot=hot).collect()} == want
