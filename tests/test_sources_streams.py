"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evidora.operators import measure as ms
from evidora.sources import feeds, manifests, markup, paged, responses, sinks, specs
from evidora.streaming import monitor


def test_responses(spark, tmp_path):
    ok = {"claims": [{"claim": "c1", "evidence": [{"doc_id": "d", "quote": "q"}]}, {"text": "c2", "citations": [{"doc_id": "e", "quote": "r"}], "evidence": [{"doc_id": "x", "quote": "y"}]}, {"claim": " "}], "citation_checks": [{"doc_id": "d", "verdict": "Misread"}, {"doc_id": "z", "verdict": "odd"}, {"verdict": "supported"}]}
    (tmp_path / "a.json").write_text("﻿" + json.dumps(ok))
    (tmp_path / "b.json").write_text("not json")
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "seat string")
    parsed = responses.parse(responses.read(spark, str(tmp_path)), roster)
    assert {(r["seat"], r["state"]) for r in parsed.collect()} == {("a", "answered"), ("b", "unparseable"), ("c", "no response")}
    got = {r["text"]: [c["doc_id"] for c in r["citations"]] for r in responses.claims(parsed).collect()}
    assert got == {"c1": ["d"], "c2": ["e"]}
    shown = spark.createDataFrame([("a", "d")], "seat string, doc_id string")
    assert {(r["doc_id"], r["verdict"], r["state"]) for r in responses.checks(parsed, shown).collect()} == {("d", "misread", "recorded"), ("z", "unrecognised", "not_under_examination")}
    bare = responses.checks(parsed, shown, shown.where("doc_id = 'other'"))
    assert {r["state"] for r in bare.where("doc_id = 'd'").collect()} == {"unsupported_verdict"} and {r["state"] for r in responses.checks(parsed, shown, shown).where("doc_id = 'd'").collect()} == {"recorded"}
    assert sum(r["adverse"] for r in responses.verdict_counts(responses.checks(parsed, shown)).collect()) == 1


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"seq": 1, "doc_id": "a1", "title": "Some title", "pub_date": "2020", "n_passages": 2}\n\n{"seq": 2, "doc_id": "Bad Id"}\n')
    rows = manifests.read(spark, str(tmp_path / "m.jsonl"))
    good, bad = manifests.split_valid(rows)
    assert [r["doc_id"] for r in good.collect()] == ["a1"] and [r["reason"] for r in bad.collect()] == ["bad id"]
    (tmp_path / "n.jsonl").write_text('{"seq": 1\n')
    with pytest.raises(Exception):
        manifests.read(spark, str(tmp_path / "n.jsonl")).collect()


def test_frozen_turns(spark, tmp_path):
    led = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "turn int, text string")
    one = manifests.freeze_turn(led, str(tmp_path), 1)
    with pytest.raises(FileExistsError):
        manifests.freeze_turn(led, str(tmp_path), 1)
    assert manifests.freeze_turn(led.orderBy(F.desc("text")), str(tmp_path), 1, force=True) == one
    assert manifests.freeze_turn(led, str(tmp_path), 2) != one
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_partition_replacement(spark, tmp_path):
    schema = "seat string, turn int, note string"
    manifests.replace_partitions(spark.createDataFrame([("a", 1, "old"), ("a", 2, "keep")], schema), str(tmp_path), "seat", "turn")
    manifests.replace_partitions(spark.createDataFrame([("a", 1, "new")], schema), str(tmp_path), "seat", "turn")
    assert {r["note"] for r in spark.read.parquet(str(tmp_path)).collect()} == {"new", "keep"}


def test_markup(spark):
    xml = "<article><front><article-title>On <i>reefs</i></article-title><abstract><p>Short.</p></abstract><abstract abstract-type='graphical'><p>no</p></abstract></front><body><sec><title>Methods</title><p>We saw<xref>1</xref> it.</p><sec><p>Inner.</p></sec></sec><sec><title>7. References</title><p>no</p></sec></body></article>"
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, "")], "k bigint, b string")
    got = [(r["section"], r["text"]) for r in markup.blocks(df, "k", "b", "xml").orderBy("ord").collect()]
    assert got == [("Title", "On reefs"), ("Abstract", "Short."), ("Methods", "We saw it."), ("Methods", "Inner.")]
    page = "<html><nav>menu</nav><h1>Top</h1><p>A &amp; b</p><script>x()</script><h2>References</h2><p>no</p></html>"
    assert markup.page_blocks(page) == [("Top", "A & b")]
    assert markup.plain_blocks("a\nb\n\n\nc") == [(None, "a b"), (None, "c")]


def test_paged_search(spark, tmp_path):
    pages = {"rel.start": {"records": [{"doi": "10/A", "title": "t", "year": 2001}], "next": "n1"}, "rel.n1": {"records": [{"pmid": "7", "title": "u"}], "next": "n1"}, "cited.start": {"records": [{"doi": "10/a ", "title": "again"}, {"title": "v"}], "next": None}}
    for name, body in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    spark.dataSource.register(paged.PagedSearch)
    rows = spark.read.format("paged_search").option("queries", "rel|cited").load(str(tmp_path))
    assert rows.count() == 4
    assert {(r["key"], r["pass"]) for r in paged.first_by_pass(rows, ["rel", "cited"]).collect()} == {("10/a", "rel"), ("7", "rel"), ("v", "cited")}
    with pytest.raises(Exception):
        spark.read.format("paged_search").option("queries", "absent").load(str(tmp_path)).collect()


def test_stream_equals_batch(spark, tmp_path):
    xs = [("p", t, x) for t, x in enumerate([0.5, None, 0.4, 0.2, 0.0])] + [("q", 0, 1.0), ("q", 1, 0.6)]
    schema = "run string, turn bigint, x double"
    for k, part in enumerate((xs[:3], xs[3:], xs[:2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = monitor.watch(stream).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["run"], r["turn"]): round(r["llr"], 6) for r in spark.table("watched").collect()}
    batch = {r["run"]: list(r["history"]) for r in ms.monitor(spark.createDataFrame(xs, schema), "run", "turn", "x").collect()}
    assert [got["p", t] for t in range(5)] == batch["p"] and [got["q", t] for t in range(2)] == batch["q"]


def test_stream_of_days(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "purchase"), ("2024-01-01 02:00:00", "view"), ("2024-01-09 00:00:00", "view")]
    spark.createDataFrame(rows, "ts string, event_type string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").json(str(tmp_path / "in"))
    q = monitor.event_rates(stream).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n"], r["share"]) for r in spark.table("days").collect()] == [(2, 0.5)]


def test_stream_compaction(spark, tmp_path):
    schema = "doc_id string, seq bigint, title string"
    spark.createDataFrame([("a", 1, "old"), ("b", 2, "b")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    log = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    monitor.compact_into(log(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    spark.createDataFrame([("a", 3, "new"), ("a", 0, "late")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    monitor.compact_into(log(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    rows = monitor.compacted(spark, str(tmp_path / "out")).collect()
    assert {(r["doc_id"], r["title"]) for r in rows} == {("a", "new"), ("b", "b")}


def test_seat_specifications(spark, tmp_path):
    a, b = {"name": "a", "display": "A", "queries": ["x"]}, {"name": "b", "display": "B"}
    assert [r["name"] for r in specs.seats(spark, [a, b], ["b", "a"]).orderBy("place").collect()] == ["b", "a"]
    for bad in ({"name": "a"}, {"name": "a", "display": "A", "extra": 1}, {"name": "a", "display": "TODO"}):
        with pytest.raises(ValueError):
            specs.checked(bad)
    with pytest.raises(KeyError):
        specs.seats(spark, [a], ["nobody"])
    (tmp_path / "q.txt").write_text("﻿ Why reefs? \n")
    assert specs.question(spark, path=str(tmp_path / "q.txt")) == "Why reefs?"
    for wrong in ({}, {"inline": "x", "path": "y"}, {"inline": "  "}):
        with pytest.raises(ValueError):
            specs.question(spark, **wrong)


def test_feeds_and_providers(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/1.2v3</id><title>On\n reefs</title><author><name>A B</name></author></entry><entry><id>http://x/abs/1.2v1</id><title>Old</title></entry></feed>'
    out = feeds.entries(spark.createDataFrame([(feed,), (feed,), ("<broken",), (None,)], "body string")).collect()
    assert [(r["id"], r["title"], list(r["authors"])) for r in out] == [("1.2", "On reefs", ["A B"])]
    wanted = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pmcid string")
    one = spark.createDataFrame([("p1", "x" * 600), ("p2", "short")], "pmcid string, body string")
    two = spark.createDataFrame([("p2", "y" * 900), ("p3", "This article is not available " + "z" * 900)], "pmcid string, body string")
    got = {r["pmcid"]: r["provider"] for r in feeds.first_provider(wanted, [("one", one, 500), ("two", two, 800)]).collect()}
    assert got == {"p1": "one", "p2": "two", "p3": None}
    rel, cit = spark.createDataFrame([("a", 0), ("b", 1)], "key string, place int"), spark.createDataFrame([("b", 0), ("c", 1)], "key string, place int")
    era = spark.createDataFrame([(1990, f"e{i}", i) for i in range(60)] + [(2000, "c", 0)], "era int, key string, place int")
    found = {r["key"]: r["pass"] for r in feeds.era_passes(rel, cit, era, 50).collect()}
    assert found["b"] == "relevance" and found["c"] == "cited" and sum(p == "era" for p in found.values()) == 40


def test_sinks(spark, tmp_path):
    with sinks.writing(spark, str(tmp_path), "me"):
        with pytest.raises(RuntimeError, match="me|another"), sinks.writing(spark, str(tmp_path), "you"):
            pass
    with sinks.writing(spark, str(tmp_path), "again"):
        pass
    for bad in ("", "/etc/x", "../x", "a/../../b", "s3://x"):
        with pytest.raises(ValueError):
            sinks.inside("run", bad)
    assert sinks.inside("run", "a/b.txt") == "run/a/b.txt"
    rows = spark.createDataFrame([("k", "p", "absent", None), ("k", "q", "found", None)], "key string, provider string, outcome string, detail string")
    sinks.journal(rows, str(tmp_path / "j"))
    sinks.journal(rows.limit(1), str(tmp_path / "j"))
    assert sum(r["n"] for r in sinks.outcomes(spark.read.json(str(tmp_path / "j"))).collect()) == 3
    for turn in (1, 2, 1):
        sinks.write_turn({"report": rows.limit(turn)}, str(tmp_path), turn)
    assert spark.read.json(str(tmp_path / "report")).count() == 3
