"""Text operators against brute force and hand-made cases, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing extra columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evidora.llm import leaks, lookalike, mixing, names, neardup, pieces, scans, sentences

EN = "We met Dr. Hale at 6 p.m. The reef grew by 3.5 percent. \"Stop now! It broke,\" the log says. What a day this was!\n\nResults\n\n(The beds were sampled twice.) See Fig. 7 of vol. 3 for more... and yet it held."


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 8 sentences


def rules_of(spark, texts):
    return sentences.corpus_rules(frame(spark, [(t,) for t in texts], "text string"))


def split(text, rules=None):
    out, at = [], 0
    for end in sentences.Splitter(rules).ends(text):
        out.append(text[at:end].strip())
        at = end
    return out


def test_sentences_english(spark):
    corpus = ["Dr. Moss saw it. Dr. Reed saw the day. Dr. Hale saw what a reef is. Dr. Lund saw it. Dr. Ost saw. Dr. Abe saw. Dr. Ebb ran. Dr. Ivo ran. See the end. the reef, what the", EN, "it was p.m. The a 5 p.m. What cf. the one (see fig. 3) in fig. 4, vol. 9 of vol. 2 and vol. 3"]
    got = split(EN, rules_of(spark, corpus))
    assert got == ["We met Dr. Hale at 6 p.m.", "The reef grew by 3.5 percent.", '"Stop now! It broke," the log says.', "What a day this was!", "Results", "(The beds were sampled twice.)", "See Fig. 7 of vol. 3 for more... and yet it held."]


@pytest.mark.parametrize(
    "text, want",
    [
        ("„Sind sie da?“, fragte sie. Er schrieb: „Es stieg.“ Wie selten!", ["„Sind sie da?“, fragte sie.", "Er schrieb: „Es stieg.“", "Wie selten!"]),
        ("Il dit : « Oui. » Pourquoi ?\n« Faut-il ? » demanda-t-il.", ["Il dit : « Oui. »", "Pourquoi ?", "« Faut-il ? » demanda-t-il."]),
        ("¿Por qué? «¿Faltan?», preguntó. Anotó: «La deriva».", ["¿Por qué?", "«¿Faltan?», preguntó.", "Anotó: «La deriva»."]),
        ("“都数完了吗？”第二位问道。报告写道：“下降。”见图。", ["“都数完了吗？”第二位问道。", "报告写道：“下降。”", "见图。"]),
        ("「変わらない。もう一度。」と記録にある。終わり。", ["「変わらない。もう一度。」と記録にある。", "終わり。"]),
        ("ค่าเฉลี่ยคือ33.9ที่ชายฝั่ง เราไม่ทราบ", ["ค่าเฉลี่ยคือ33.9ที่ชายฝั่ง", "เราไม่ทราบ"]),
        ("Γιατί άλλαξε; Έμεινε.", ["Γιατί άλλαξε;", "Έμεινε."]),
        ("क्या घटी? औसत 3.2 था। बचे!", ["क्या घटी?", "औसत 3.2 था।", "बचे!"]),
        ("هل ارتفعت؟ نعم.", ["هل ارتفعت؟", "نعم."]),
        ("2. Methods\n\nIt held.", ["2. Methods", "It held."]),
    ],
)
def test_sentences_scripts(text, want):
    assert split(text) == want


def test_the_document_decides_before_the_corpus(spark):
    """A type that the document plainly uses as an abbreviation isn't split at,
    whatever the corpus says, and one it uses as a word is."""
    rules = {"abbr": {"xq.": True, "bar.": False}, "starter": set(), "dated": set()}
    own = "The xq. bars held and the xq. rods held and the xq. pins held. We saw xq. Zorro left."
    assert split(own, rules) == ["The xq. bars held and the xq. rods held and the xq. pins held.", "We saw xq. Zorro left."]
    assert split("A bar is a bar here. We passed the bar. Zorro left.", rules) == ["A bar is a bar here.", "We passed the bar.", "Zorro left."]
    assert split("ທີ່ນີ້ດີ ພວກເຮົາບໍ່ຮູ້") == ["ທີ່ນີ້ດີ", "ພວກເຮົາບໍ່ຮູ້"]


def test_sentences_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "  \n\n ", 0), (4, "One. Two.", 0), (4, "One. Two.", 0), (5, "x" * 200_000 + ".", 0), (6, '"unclosed', 0)]
    out = sentences.sentences(frame(spark, rows, "doc_id bigint, text string, ord int")).collect()
    assert sorted((r["doc_id"], r["end_char"]) for r in out) == [(4, 4), (4, 4), (4, 9), (4, 9), (5, 200_001), (6, 9)]
    assert sentences.sentences(frame(spark, [], "doc_id bigint, text string")).count() == 0


# 2 pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_round_trip(seed):
    rnd = random.Random(seed)
    words = ["w" * rnd.randrange(1, 12) for _ in range(400)]
    text = "".join(w + rnd.choice([" ", ". ", "\n\n", " "]) for w in words)
    sp = sentences.Splitter()
    cuts = pieces.cut_text(text, 300, 40, sp)
    assert all(b - a <= 300 for a, b, _ in cuts)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(y[0] == max(x[1] - 40, y[1] - 300) for x, y in zip(cuts, cuts[1:]))
    # No two neighbours could still be merged.
    assert all(y[1] - x[0] > 300 for x, y in zip(cuts, cuts[1:]))


def test_level_is_that_of_the_cuts(spark):
    """A paragraph between the limit and the limit less the overlap stays whole."""
    text = "Intro.\n\n" + ("Aa bb cc. " * 289).strip() + "\n\n" + "Tail words here. " * 78
    df = frame(spark, [(1, text.strip(), "s")], "passage_seq bigint, text string, section string")
    out = pieces.split_items(df).orderBy("piece").collect()
    assert {r["level"] for r in out} == {"paragraph"} and {r["boundary"] for r in out} == {"paragraph"} and all(len(r["text"]) <= 3000 for r in out)


def test_piece_levels(spark):
    para = ("Aa bb. " * 100).strip()
    rows = [(1, "\n\n".join([para] * 6)), (2, "Aa bb cc. " * 400), (3, "aa bb " * 600), (4, "y" * 5000), (5, "short"), (6, None), (7, ""), (8, "z" * 100_000)]
    df = frame(spark, [(k, t, "s", 1) for k, t in rows], "passage_seq bigint, text string, section string, piece int")
    out = pieces.split_items(df, only_oversized=True).select("passage_seq", "level").distinct().collect()
    assert {r["passage_seq"]: r["level"] for r in out} == {1: "paragraph", 2: "sentence", 3: "word", 4: "none", 8: "none"}
    whole = pieces.split_items(df).collect()
    assert {r["passage_seq"] for r in whole} == {1, 2, 3, 4, 5, 7, 8} and all(len(r["text"]) <= 3000 for r in whole)
    with pytest.raises(ValueError):
        pieces.split_items(df, size=10, overlap=10)


# 4 look-alikes


def test_unify_makes_variants_equal(spark):
    plain = "A café field isn't wide: 12 μm of first-year film"
    variants = ["Ａ café field isn’t wide： 12 µm of ﬁrst‑year ﬁlm", "А​ саfé fiеld isn't wi­de: 12 μm of fir﻿st-year film", "𝐀 café field isn't wide: 12 μm of ﬁrst‐year film"]
    df = frame(spark, [(t,) for t in [plain] * 20 + variants + [None, ""]], "text string")
    u = lookalike.Unifier.of(df)
    got = [r[0] for r in df.select(u.column(F.col("text"))).collect()]
    assert set(got[:23]) == {plain} and got[23] is None and got[24] == ""


def test_letters_of_a_published_table_are_unified(spark):
    plain = "Gwen sang with Anna and Oscar by the flat reef"
    odd = ["ɡwen".replace("ɡ", "G") + " sang with ᎪnnΑ".replace("Α", "a") + " and Օscar by the flаt reef", "Gwen sanɡ with ꓮnna and Oscar by the fӏat reef".replace("ӏ", "l"), "Gwen sang with Anna and Oscar by the flat reef​"]
    df = frame(spark, [(t,) for t in [plain] * 20 + odd + ["o̸re and øre", "øre", "øre"]], "text string")
    u = lookalike.Unifier.of(df)
    got = [r[0] for r in df.select(u.column(F.col("text"))).collect()]
    assert set(got[:23]) == {plain} and got[23] == "øre and øre"
    assert lookalike.Unifier({"l": 5, "I": 5, "1": 5, "m": 1}, {"l": "l", "I": "l", "1": "l", "m": "rn"}).points.keys() & {ord(c) for c in "lI1m"} == set()


def test_quote_matches_equal_brute_force(spark):
    rnd = random.Random(1)
    words = ["reef", "salt", "café", "flats", "mound", "tide", "ﬁlm", "grew", "shrank", "it", "was"]
    docs = {"hot": 400, "small": 3, "other": 2}
    ps = [(d, " ".join(rnd.choices(words, k=30))) for d, n in docs.items() for _ in range(n)] + [("small", None), (None, "x y"), ("small", "")]
    qs = []
    for _ in range(120):
        d, t = rnd.choice([p for p in ps if p[0] and p[1]])
        a = rnd.randrange(len(t) - 5)
        q = t[a : a + rnd.choice([3, 8, 20, 45, 90])]
        qs.append((d, rnd.choice([q, q.replace("ﬁ", "fi"), q.replace("e", "е"), q.replace("s", "5")])))
    qs += [("hot", None), ("hot", ""), ("hot", "​"), (None, "reef"), ("gone", "reef")]
    p, q = frame(spark, ps, "doc_id string, text string"), frame(spark, qs + qs[:5], "doc_id string, quote string")
    u = lookalike.Unifier.of(p.select("text"), q.select("quote"))
    form = lookalike.Rewriter(u.points, u.strings)
    out = {(r["doc_id"], r["quote"]): (r["verbatim"], r["unified"]) for r in lookalike.quote_matches(q, p, u, hot=50).collect()}
    for d, t in {(d, t) for d, t in qs if d and t and form(t).strip()}:
        own = [x for k, x in ps if k == d and x is not None]
        assert out[d, t] == (any(t in x for x in own), any(form(t) in form(x) for x in own)), (d, t)


# 5 near duplicates


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(2)
    base = [[f"w{rnd.randrange(500)}" for _ in range(60)] for _ in range(40)]
    texts = {}
    for i, ws in enumerate(base):
        for v in range(rnd.choice([1, 1, 2, 4])):
            out = list(ws)
            for _ in range(rnd.choice([0, 1, 2, 8])):
                out[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
            texts[f"k{i}-{v}"] = " ".join(out)
    texts |= {"same-a": "Tiny text", "same-b": "tiny TEXT", "long": "q " * 50_000}
    rows = [*texts.items(), *list(texts.items())[:9], ("nul", None), (None, "a b c d"), ("blank", "  ")]
    members, found, classes = neardup.near_duplicates(frame(spark, [(k, t, "z") for k, t in rows], "passage_id string, text string, tid string"), "passage_id", "text", 3, "word", 0.6, recall=0.999)
    got = {(r[0], r[1]) for r in neardup.linked_pairs(members, found, classes).collect()}
    keys = list(texts)
    sets = {k: neardup.grams(t.lower(), 3, "word") for k, t in texts.items()}
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(keys, 2):
        if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    assert got == {(min(a, b), max(a, b)) for a, b in itertools.combinations(keys, 2) if find(a) == find(b)}


def test_hot_bucket_keeps_classes(spark):
    """More variants of one text than a bucket pairs off."""
    base = [f"w{i}" for i in range(50)]
    rows = [(f"v{i:03}", " ".join([*base, f"x{i}"])) for i in range(150)] + [("far", "nothing like the others at all")]
    members, found, classes = neardup.near_duplicates(frame(spark, rows, "k string, t string"), "k", "t", 3, "word", 0.6)
    assert classes.select("root").distinct().count() == 1 and classes.count() == 150
    pairs = neardup.linked_pairs(members, found, classes)
    assert {r["key_b"] for r in pairs.where("key_a = 'v000'").collect()} == {f"v{i:03}" for i in range(1, 150)}


def test_unlike_texts_of_a_hot_bucket_are_not_paired_off(spark, monkeypatch):
    """300 texts in one bucket, in 100 groups of 3: the groups are found, far
    fewer than all 44,850 pairs are verified."""
    rnd = random.Random(5)
    texts, groups = {}, {}
    for g in range(100):
        own = [f"g{g}x{rnd.randrange(10**6)}" for _ in range(40)]
        for v in range(3):
            texts[g * 3 + v], groups[g * 3 + v] = " ".join(["the common head of all", *own, f"v{v}"]), g
    df = frame(spark, list(texts.items()), "tid bigint, text string")
    monkeypatch.setattr(neardup, "band_rows", lambda t, n, unit, bands, rows, hot=None: t.select(F.lit(7).cast("bigint").alias("h"), "tid"))
    monkeypatch.setattr(neardup, "hot_buckets", lambda *a: {})
    compared = []
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a, real=neardup.verified: compared.append(pairs.count()) or real(pairs, *a))
    found = {(r["x"], r["y"]) for r in neardup.links(df, 3, "word", 0.6, 0.98).collect()}
    for a in texts:
        assert all((min(a, b), max(a, b)) in found for b in texts if a != b and groups[a] == groups[b])
    assert sum(compared) < 12_000


def test_spread_buckets_keep_classes(spark, monkeypatch):
    rows = [(f"v{i:03}", " ".join([*(f"w{j}" for j in range(50)), f"x{i}"])) for i in range(150)]
    monkeypatch.setattr(neardup, "hot_buckets", lambda t, n, unit, bands, rows, real=neardup.hot_buckets: real(t, n, unit, bands, rows, 1))
    members, found, classes = neardup.near_duplicates(frame(spark, rows, "k string, t string"), "k", "t", 3, "word", 0.6)
    assert classes.select("root").distinct().count() == 1 and classes.count() == 150


def test_tables_of_pairs_are_not_broadcast_and_texts_are_compared_once(spark):
    texts = frame(spark, [(k, f"a text of its own {k} and more") for k in range(6)], "tid bigint, text string")
    pairs = frame(spark, [(0, 1), (2, 3)], "x bigint, y bigint")
    plan = neardup.verified(pairs, texts, 3, "word", 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1 and "jaccard" not in plan


def test_what_is_held_of_a_bucket_is_bounded(spark):
    rows = [(h, t) for h in (1, 2, 3) for t in range(h, 40 * h) if t % h == 0]
    banded = frame(spark, rows, "h bigint, tid bigint").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(r) for r in neardup.bucket_pairs(banded, 4, most_held=7).collect()]
        whole = {tuple(r) for r in neardup.bucket_pairs(banded, 64).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == {(a, b, None) for h in (1, 2, 3) for a, b in itertools.combinations([t for k, t in rows if k == h], 2)}
    for h in (1, 2, 3):
        hot = [(x, y) for x, y, k in got if k == h]
        led = set.intersection(*map(set, hot))
        assert len(led) == 1 and {t for p in hot for t in p} == {t for k, t in rows if k == h}


@pytest.mark.parametrize("unit", ["word", "char"])
def test_band_hashes_of_many_texts_are_those_of_each(unit, monkeypatch):
    texts = ["", "a b", "a b c d e f", "  ", "one two three", "x" * 5000 + " y z", "a b c d e f"]
    signer = neardup.Signer(3, unit, 4, 2)
    monkeypatch.setattr(signer, "STRETCH", 6)
    with neardup.np.errstate(over="ignore"):
        at, h = signer.many(texts)
        assert at == [i for i, t in enumerate(texts) if (t.split() if unit == "word" else t)]
        for i, row in zip(at, h):
            x = signer.hashes(texts[i])
            low = (signer.a * x + signer.b).min(axis=1).reshape(4, 2).astype("uint64")
            one = (low * signer.mix).sum(axis=1) + signer.band
            one = (one ^ (one >> neardup.np.uint64(32))) * neardup.np.uint64(0x9E3779B97F4A7C15)
            assert (row == one ^ (one >> neardup.np.uint64(29))).all()


def test_near_duplicates_of_nothing(spark):
    assert neardup.linked_pairs(*neardup.near_duplicates(frame(spark, [], "k string, t string"), "k", "t")).count() == 0


def test_band_choice_meets_recall():
    for t in (0.5, 0.6, 0.65, 0.8, 0.95):
        b, r = neardup.choose_bands(t, 0.98)
        assert 1 - (1 - t**r) ** b >= 0.98 and b <= 50


# 6 leaks


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, " ".join(f"t{rnd.randrange(60)}" for _ in range(rnd.choice([5, 13, 25])))) for i in range(30)]
    docs = []
    for i in range(80):
        ws = [f"t{rnd.randrange(60)}" for _ in range(20)]
        k, t = rnd.choice(items)
        part = t.upper().split()
        a = rnd.randrange(3)
        docs.append((i, " ".join(ws + [", ".join(part[a : a + rnd.choice([12, 13, 20])])] + ws)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (900, None), (None, docs[0][1])]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.contained_items(frame(spark, [(a, b, 1.0) for a, b in docs], "doc_id bigint, text string, share double"), frame(spark, items + items[:3] + [(None, "x"), (77, None)], "item_id bigint, text string")).collect()}
    want = set()
    for d, t in docs:
        ws = leaks.words(t or "")
        seen = {tuple(ws[j : j + 13]) for j in range(len(ws) - 12)}
        for i, x in items:
            xs = leaks.words(x)
            if d is not None and any(tuple(xs[j : j + 13]) in seen for j in range(len(xs) - 12)):
                want.add((d, i))
    assert got == want and want
    assert leaks.contained_items(frame(spark, [], "doc_id bigint, text string"), frame(spark, items, "item_id bigint, text string")).count() == 0


def test_leaks_report_what_is_too_short(spark):
    items = frame(spark, [(1, "a b c"), (2, None), (3, " ".join("abcdefghijklm")), (4, "")], "item_id bigint, text string")
    assert sorted(tuple(r) for r in leaks.too_short(items).collect()) == [(1, 3), (2, 0), (4, 0)]


def test_bitmap_holds_what_was_put_in(spark):
    from evidora.llm.sketch import bitmap, bits_for

    ids = spark.range(5000).select(F.xxhash64("id").alias("h"))
    import numpy as np

    own = np.array([r[0] for r in ids.collect()], np.int64).view(np.uint64)
    bits = bitmap(ids, bits_for(5000))
    other = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert bits.held(own).all() and bits.held(other).mean() < 0.02
    assert not bitmap(ids.limit(0), bits_for(0)).held(own).any()


# 7 mixing


def test_schedule_is_pfair():
    blocks = {"a": 50, "b": 30, "c": 17, "d": 3}
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    order = list(mixing.schedule(blocks))
    assert len(order) == total and len(set(order)) == total
    for slot, s, j in order:
        assert j == done[s]
        done[s] += 1
        for k, n in blocks.items():
            assert abs(done[k] - (slot + 1) * n / total) < 1


def test_mix_shares_and_caps(spark):
    rows = [(f"{s}{i}", s, "alpha beta " * 40) for s, n in (("a", 60), ("b", 30), ("c", 2)) for i in range(n)] + [("n", None, "x"), ("u", "untargeted", "x"), ("e", "a", None), ("e2", "a", "")]
    counted = mixing.token_counts(frame(spark, rows, "doc_id string, source string, text string"))
    targets = frame(spark, [("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("gone", 0.1, 9)], "source string, target_share double, max_passes int")
    out = {r["source"]: r for r in mixing.shares(counted, targets).collect()}
    assert [(out[s]["contributed"] - out[s]["wanted"] < 0) == out[s]["short"] for s in out] == [True] * 4
    assert out["a"]["short"] is False and out["b"]["short"] is False and out["c"]["short"] and out["gone"]["short"]
    assert abs(sum(r["actual_share"] for r in out.values()) - 1) < 1e-9
    mixed = mixing.mix(counted, targets, block=64).collect()
    used = {}
    for r in mixed:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"]
    for s in "abc":
        assert 0 <= used[s] - out[s]["contributed"] < 200
    assert max(r["pass"] for r in mixed if r["source"] == "c") == 1 and {r["source"] for r in mixed} == {"a", "b", "c"}


def test_shares_are_measured_on_the_mix(spark, monkeypatch):
    made = []
    monkeypatch.setattr(mixing, "slots", lambda spark, blocks, real=mixing.slots: made.append(dict(blocks)) or real(spark, blocks))
    counted = mixing.token_counts(frame(spark, [(i, "ab"[i % 2], "alpha beta") for i in range(40)], "doc_id bigint, source string, text string"))
    targets = frame(spark, [("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_passes int")
    out = {r["source"]: r for r in mixing.shares(counted, targets, block=4).collect()}
    held = {r["source"]: r["n"] for r in mixing.mix(counted, targets, block=4).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert made and {s: r["contributed"] for s, r in out.items()} == held and out["a"]["short"] and not out["b"]["short"]


def test_mix_of_nothing(spark):
    counted = mixing.token_counts(frame(spark, [], "doc_id string, source string, text string"))
    targets = frame(spark, [("a", 1.0, 1)], "source string, target_share double, max_passes int")
    assert mixing.shares(counted, targets).first()["short"] is False and mixing.shares(counted, targets).first()["size"] == 0


# 3 names


def test_name_entities(spark):
    groups = [
        ["Amara Laverickert", "Laverickert, Amara", "LAVERICKERT Amara", "Aara Laverickert", "A. Laverickert", "Dr. Amara Laverickert", "Amara Lavericket", "Laverickert A"],
        ["Johannes Laverickert", "Laverickert, J.", "Johannes B. Laverickert", "Hans Laverickert"],
        ["Jizadum Institute for Alpine Botany", "Inst. for Alpine Botany (Jizadum)", "Jizadum IAB", "Alpine Botany Institute, Jizadum", "Jizadum Institute for Alpinne Botany"],
        ["Jizadum Consortium for Soil Archives", "JIZADUM CONSORTIUM FOR SOIL ARCHIVES"],
        ["Tove Babededell"],
        ["Tamsin Babededell"],
        ["T. Babededell", "Babededell, T."],
        ["???"],
    ]
    rows = [(n, 1) for g in groups for n in g] + [(None, 1), ("  ", 1), ("Amara Laverickert", 2)]
    out = {r["name"]: r["entity"] for r in names.entities(frame(spark, rows, "name string, entity int")).collect()}
    found = {}
    for n, e in out.items():
        found.setdefault(e, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_close_keys_equal_brute_force(spark):
    rnd = random.Random(9)
    keys = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(6, 13))) for _ in range(150)}
    for k in list(keys)[:80]:
        i = rnd.randrange(len(k) - 1)
        keys.add(rnd.choice([k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k[:i] + k[i + 1] + k[i] + k[i + 2 :], k[:i] + "y" + k[i + 1 :]]))
    keys |= {"li ana", "li anna", "a", "ab", "b"}
    for k in (1, 2):
        got = {(r["a"], r["b"]) for r in names.close_keys(frame(spark, [(x,) for x in keys], "key string"), k).collect()}
        want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if edits(a, b) <= k}
        assert got == want and len(want) > 50


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_short_forms_are_learned_from_records(spark):
    rows = [(r, n) for r, s in enumerate(("Abarnel", "Bedrosov", "Cordellan")) for n in (f"{s}, Quirinius", f"{s}, Quirinius", f"{s}, Rinek")]
    rows += [(9, "Dastemil, Quirinius"), (8, "Rinek Dastemil"), (7, "Ewaldun, Ottoline"), (7, "Ewaldun, Pernilla")]
    df = frame(spark, rows, "record int, name string")
    out = {r["name"]: r["entity"] for r in names.entities(df).collect()}
    assert out["Dastemil, Quirinius"] == out["Rinek Dastemil"] and out["Ewaldun, Ottoline"] != out["Ewaldun, Pernilla"]
    plain = {r["name"]: r["entity"] for r in names.entities(df.select("name")).collect()}
    assert plain["Dastemil, Quirinius"] != plain["Rinek Dastemil"]


def test_short_names_and_ambiguous_acronyms(spark):
    rows = ["Li Anna", "Li Ana", "Tidal Institute for Alpine Botany", "Tidal Institute for Arctic Biology", "Tidal IAB"]
    out = {r["name"]: r["entity"] for r in names.entities(frame(spark, [(n,) for n in rows], "name string")).collect()}
    assert out["Li Anna"] == out["Li Ana"] and out["Tidal IAB"] not in (out[rows[2]], out[rows[3]])


def test_entities_of_nothing(spark):
    assert names.entities(frame(spark, [], "name string")).count() == 0


def test_oversized_items_are_cut_under_the_corpus_rules(spark, tmp_path):
    from evidora.llm import queries

    few = [(i, "We saw that the Abteil. was closed and the Abteil. Keller was open. The bank was dry.", "Methods") for i in range(100)]
    parts = " ".join(["the shoots of the Abteil. Keller were watered and turned and surveyed again with the same care by"] * 45)
    long = [(1000, f"We saw {parts} hand.", "Methods")]
    frame(spark, few + long, "passage_seq bigint, text string, section string").write.parquet(f"{tmp_path}/passages.parquet")
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [(1000, "word")]
    assert {r["boundary"] for r in queries.p2_pieces(spark, str(tmp_path)).where("passage_seq = 1000 and piece > 0").collect()} == {"word"}


# 1 scans


CLEAN = "The second panel described the same shoots and concluded that the trend holds in every subset. Long-term plots were watered twice."


def scanned(spark):
    rows = [(10_000 + i, CLEAN, "Methods") for i in range(800)] + [(0, CLEAN, "Methods")]
    damaged = {
        100: ("The sec-\nond panel described the same shoots and concluded that the trend holds in every subset.", "Methods"),
        101: ("The second pan€l describ3d the samc shoots and concluded that the trcnd holds in every subset.", "Methods"),
        102: ("The second panel described the same shoots and\n\nAnnals of Tidal Work, vol. 12\n\nconcluded that the trend\nholds in every subset.", "Methods"),
        103: ("The second panel described the same shoots and\n- 99 -\nconcluded that the trend holds in every subset.", "Methods"),
        104: (CLEAN, "Meth-\nods"),
        105: (CLEAN, "Meth0ds 12"),
        106: ("Long-\nterm plots were watered twice.", "Methods"),
        107: ("Pre- and post-storm counts were described.", None),
        108: (None, None),
        109: ("", ""),
        110: ("THE SECOND PANEL DESCRIBED THE SAME SHOOTS AND CONCLUDED THAT THE TREND HOLDS", "Methods"),
        111: ("The second panel described the SEDIMENT LETTERS OF NOTE   412 same shoots and concluded that the trend holds.", "12 | Tidal Work"),
        112: ("plots were watered twice. " * 8000, "Methods"),
    }
    more = [(200 + i, "Pre- and post-storm counts were described.", "Methods") for i in range(20)]
    rows += [(k, *v) for k, v in damaged.items()] + more + [(100, *damaged[100])]
    return frame(spark, [(*r, "x") for r in rows], "passage_seq bigint, text string, section string, kinds string")


def test_scan_kinds_and_repair(spark):
    out = {}
    for r in scans.scan_repair(scanned(spark)).collect():
        out[r["passage_seq"]] = (set(r["kinds"]), r["section"], r["text"])
    full = "The second panel described the same shoots and concluded that the trend holds in every subset."
    assert out[100] == ({"hyphen"}, "Methods", full)
    assert out[101] == ({"chars"}, "Methods", full)
    assert out[102] == ({"header"}, "Methods", full)
    assert out[103] == ({"page_number"}, "Methods", full)
    assert out[104] == ({"section"}, "Methods", CLEAN) and out[105] == ({"section"}, "Methods", CLEAN)
    assert out[106] == (set(), "Methods", "Long-term plots were watered twice.")
    assert out[107][0] == set() and out[108] == (set(), None, None) and out[109] == (set(), "", "")
    assert out[110][0] == set() and out[112][0] == set() and out[0] == (set(), "Methods", CLEAN)
    assert out[111][0] == {"header", "page_number", "section"} and out[111][1] == ""


def test_scan_of_nothing(spark):
    assert scans.scan_repair(frame(spark, [], "passage_seq bigint, text string, section string")).count() == 0


def test_a_header_without_the_look_of_one_recurs(spark):
    rows = [(i, "d", f"the panel described the same shoots\nOn the drift of beds {i}\nand concluded that the trend holds", "Methods") for i in range(4)]
    rows += [(9, "e", "the panel described the same shoots\nOn the drift of beds 7\nand concluded that the trend holds", "Methods"), (10, None, "a\nb", None), (0, "d", rows[0][2], "Methods")]
    out = {r["passage_seq"]: (r["kinds"], r["text"]) for r in scans.scan_repair(frame(spark, rows, "passage_seq bigint, doc_id string, text string, section string")).collect()}
    assert all(out[i] == (["header"], "the panel described the same shoots and concluded that the trend holds") for i in range(4)) and out[9][0] == []


def test_long_titles_words_and_paragraphs_are_read_whole():
    title = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda, vol. 12"
    text = f"the trend holds {title} and the reef grew"
    assert [text[a:b] for a, b, k in scans.furniture(text) if k == "header"] == [title]
    left = "w" * 60
    assert [b[2] for b in scans.breaks(f"{left}-\nrest")] == [left]
    lines = ["a line that goes on and on"] * 900 + ["and ends."]
    assert len(scans.paragraphs(lines, [False] * 901)) == 1
    d = scans.Decoder({"the": 900, "trend": 50}, 3, 10_000)
    assert d.segment("the" * 40, [0.0] + [0.5] * 120) == ["the"] * 40


def test_paragraphs_follow_blank_lines_and_sense():
    lines = ["A first line that goes on", "and ends here.", "A second begins after a gap", "and is torn", "by a header."]
    assert scans.paragraphs(lines, [False, False, True, False, True]) == ["A first line that goes on and ends here.", "A second begins after a gap and is torn by a header."]


def test_stray_and_missing_spaces_are_decoded_with_the_rest():
    words = {"the": 9000, "of": 5000, "was": 900, "substrate": 400, "in": 4000, "stance": 60, "range": 300, "turned": 200, "trend": 300, "an": 800, "other": 700, "another": 100}
    d = scans.Decoder(words, 3, 100_000)
    read = lambda text: scans.examine(text, d, True)
    assert read("the subs trate was turned") == ([], "the substrate was turned")
    assert read("the range ofthe trend") == ([], "the range of the trend")
    assert read("the subs tratc was turned") == (["chars"], "the substrate was turned")
    assert read("the sub-\nstratc was turned") == (["chars", "hyphen"], "the substrate was turned")
    assert scans.examine("the sub-\nstratc was turned", d, False) == (["chars", "hyphen"], None)
    assert read("in another range an other trend") == ([], "in another range an other trend")
    assert read("the Xanronema was turned") == ([], "the Xanronema was turned")


def test_atoms_agree_with_the_confusions():
    spell = lambda x: x.lower().translate(scans.ATOMS)
    assert all(spell(k) == spell(x) for table in (scans.SIGNS, scans.LETTERS) for k, v in table.items() for x in v)


def test_beginnings_of_spellings_are_exact_and_kept():
    words = sorted({"trend", "trends", "the", "then", "therefore", "holds", "a"})
    begun = scans.Beginnings(words)
    for x in {w[:k] + tail for w in words for k in range(len(w) + 1) for tail in ("", "x", "e")} - {""}:
        assert begun[x] == (2 if any(w.startswith(x) and w != x for w in words) else int(x in words)), x
        assert x in begun


def test_runs_are_read_once_whatever_marks_surround_them(monkeypatch):
    words = {"the": 900, "trend": 500, "holds": 500}
    d, read = scans.Decoder(words, 3, 10_000), []
    monkeypatch.setattr(d, "path", lambda tokens, hyphens, real=d.path: read.append(tokens) or real(tokens, hyphens))
    for lead, tail in (("", ""), ("(", ")."), ("“", ""), ("", ",")):
        got = d.run((f"{lead}tre", f"nd{tail}"))
        assert got == scans.Decoder(words, 3, 10_000).path([f"{lead}tre", f"nd{tail}"], {}) and got[0] + " ".join(p[1] for p in got[1]) + got[2] == f"{lead}trend{tail}"
    assert read == [["tre", "nd"]]


def test_segmentation_splits_and_merges():
    d = scans.Decoder({"the": 900, "trend": 50, "holds": 50}, 3, 10_000)
    assert d.segment("thetrendholds", [0.0] * 14) == ["the", "trend", "holds"]
    assert d.reading("trcnd") is None or d.reading("trcnd") == "trend"
    assert d.reading("tr€nd") == "trend"
