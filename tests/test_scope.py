"""Scopes, masks, citation plans and document ids."""

import hashlib

from pyspark.sql import functions as F

from evidora.operators import identity as idn
from evidora.operators import neighbourhood as nb
from evidora.operators import scope


def test_mask_whole_ids_only(spark):
    texts = spark.createDataFrame([(1, "u", "see chen2021 and chen2021nature, chen2021#p1"), (2, "v", "see chen2021."), (3, "u", None), (4, "u", "")], "key bigint, reader string, text string")
    ids = spark.createDataFrame([("chen2021",), ("chen2021nature",), ("other",)], "doc_id string")
    held = spark.createDataFrame([("v", "chen2021"), ("u", "chen2021nature")], "reader string, doc_id string")
    out = {r["key"]: (r["text"], r["n_masked"]) for r in scope.masked(texts, ids, held).collect()}
    assert out == {1: ("see [withheld] and chen2021nature, chen2021#p1", 1), 2: ("see chen2021.", 0), 3: (None, 0), 4: ("", 0)}


def test_outside_without_any_permission(spark):
    cited = spark.createDataFrame([("u", "a"), ("v", "a")], "seat string, doc_id string")
    assert [r["seat"] for r in scope.outside(cited, spark.createDataFrame([("u", "a")], "seat string, doc_id string")).collect()] == ["v"]
    assert scope.outside(cited, spark.createDataFrame([], "seat string, doc_id string")).count() == 2


def test_plan_nodes(spark):
    own = spark.createDataFrame([("s", "a"), ("s", "b")], "seat string, work string")
    cites = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("z", "a"), ("z", "a"), ("a", "a"), ("b", "a")], "src string, dst string")
    held = spark.createDataFrame([("x",), ("a",)], "work string")
    out = {(r["work"], r["node"], r["new"]) for r in nb.plan(own, cites, held).collect()}
    assert out == {("a", "authored", False), ("b", "authored", True), ("x", "reads", False), ("z", "cited_by", True)}


def test_corroboration_chain(spark):
    rows = [("s", "ok", ["p", "q", "r"], ["t"]), ("s", "one", ["p"], ["t"]), ("s", "off", ["p", "q"], ["u"]), ("s", "big", [f"a{i}" for i in range(40)], ["t"]), ("s", "nul", None, None)]
    c = spark.createDataFrame(rows, "seat string, work string, authors array<string>, topics array<string>")
    out = {r["work"]: r["fails"] for r in nb.corroborated(c, spark.createDataFrame([("s", "p"), ("s", "q")], "seat string, author string"), spark.createDataFrame([("s", "t")], "seat string, topic string")).collect()}
    assert out == {"ok": None, "one": "authors", "off": "topic", "big": "consortium", "nul": "authors"}


def test_document_ids(spark):
    rows = [("Léger, A. B.", 2001, "J. of Tides"), ("A. Léger", 2001, "J. of Tides"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, y int, v string").withColumn("base", idn.document_id(F.col("a"), F.col("y"), F.col("v"))).withColumn("n", F.coalesce("a", F.lit("")))
    got = sorted(r["id"] for r in idn.disambiguated(df, "base", "n").collect())
    assert got == ["anonb23a6a8439", "leger2001joftides", "leger2001joftidesa"]


def test_coauthors_skip_consortia(spark):
    a = [("d", n) for n in ("Ann Bee", "Cy Dow", "Ann Bee")] + [("e", f"P{i} Q{i}x") for i in range(40)] + [("f", None), ("f", "Mono")]
    out = idn.coauthor_counts(spark.createDataFrame(a, "doc_id string, author string")).collect()
    assert [(r["a"], r["b"], r["n_docs"]) for r in out] == [("bee|a", "dow|c", 1)]
