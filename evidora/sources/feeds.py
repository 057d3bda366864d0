"""Records of outside catalogues, out of what they send."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOM = "{http://www.w3.org/2005/Atom}"
ENTRY = "id string, title string, summary string, published string, authors array<string>"


def atom_entries(xml: str) -> list[tuple]:
    """(id, title, summary, published, authors) of the entries of an Atom feed,
    one for each id without its version; malformed XML gives none."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out: dict[str, tuple] = {}
    for e in root.iter(f"{ATOM}entry"):
        text = {k: re.sub(r"\s+", " ", e.findtext(f"{ATOM}{k}") or "").strip() for k in ("id", "title", "summary", "published")}
        name = re.sub(r"v\d+$", "", text["id"].rsplit("/abs/", 1)[-1])
        if name:
            out.setdefault(name, (name, text["title"], text["summary"], text["published"], [a.findtext(f"{ATOM}name") or "" for a in e.iter(f"{ATOM}author")]))
    return list(out.values())


def entries(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The entries of all feeds; an id that several feeds have counts once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for b in batch.column(0).to_pylist() if b for r in atom_entries(b)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "title", "summary", "published", "authors"])

    return feeds.select(body).mapInArrow(work, ENTRY).dropDuplicates(["id"])


def first_provider(wanted: DataFrame, providers: list[tuple[str, DataFrame, int]], key: str = "pmcid") -> DataFrame:
    """(key, provider, body) of every wanted key: the body of the first provider
    that has one of at least its number of bytes and no refusal; both null where
    none has. ``providers`` are (name, (key, body), least bytes)."""
    out = wanted.select(key).distinct()
    names: list[Column] = []
    for i, (name, bodies, least) in enumerate(providers):
        fit = bodies.where((F.octet_length("body") >= least) & ~F.lower(F.substring("body", 1, 400)).rlike("not available|restricted|error")).groupBy(key).agg(F.min("body").alias(f"_b{i}"))
        out = out.join(fit, key, "left")
        names.append(F.when(F.col(f"_b{i}").isNotNull(), name))
    return out.select(key, F.coalesce(*names).alias("provider"), F.coalesce(*[F.col(f"_b{i}") for i in range(len(providers))]).alias("body"))


def era_passes(relevance: DataFrame, cited: DataFrame, eras: DataFrame, per_pass: int) -> DataFrame:
    """Three passes of a search as one: by relevance, by citations, and by
    relevance within eras, of which each keeps max(40, per_pass / number of
    eras) records. ``relevance`` and ``cited`` have (key, place), ``eras`` (era,
    key, place). A record stays in the first pass that has it: (key, pass, place)."""
    from pyspark.sql import Window

    n = max(1, eras.select("era").distinct().count())
    cap = max(40, per_pass // n)
    kept = eras.withColumn("_n", F.row_number().over(Window.partitionBy("era").orderBy("place", "key"))).where(F.col("_n") <= cap)
    each = [(relevance.where(F.col("place") < per_pass), 0, "relevance"), (cited.where(F.col("place") < per_pass), 1, "cited"), (kept, 2, "era")]
    rows = [d.select("key", F.lit(p).alias("p"), F.lit(name).alias("pass"), "place") for d, p, name in each]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("key").agg(F.min_by(F.struct("pass", "place"), F.struct("p", "place")).alias("x")).select("key", "x.pass", "x.place")
