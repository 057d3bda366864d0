"""What a run writes: attempts, a lock, artifacts, turn tables."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.sources.files import _at


def journal(attempts: DataFrame, path: str) -> None:
    """Appends attempts (key, provider, outcome, detail), those that found
    nothing too, with the time."""
    attempts.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def outcomes(attempts: DataFrame) -> DataFrame:
    """(outcome, n) of a journal; an absence is an outcome, a failure another."""
    return attempts.groupBy("outcome").agg(F.count("*").alias("n"))


@contextmanager
def writing(spark: SparkSession, folder: str, who: str) -> Iterator[None]:
    """Holds ``folder`` for one writer: a second one raises, naming the first.
    The file that marks it is created only if it isn't there."""
    fs, where = _at(spark, f"{folder}/_LOCK")
    try:
        out = fs.create(where, False)
    except Exception as error:
        held = spark.read.text(f"{folder}/_LOCK").first() if fs.exists(where) else None
        raise RuntimeError(f"{folder} is held by {held[0] if held else 'another writer'}") from error
    try:
        out.write(who.encode())
        out.close()
        yield
    finally:
        fs.delete(where, False)


def inside(folder: str, name: str) -> str:
    """The path of an artifact in a run's folder. One that leads out of it is
    refused, not mended."""
    if not name or name.startswith(("/", "~")) or "\\" in name or "://" in name or ".." in name.split("/"):
        raise ValueError(f"an artifact's path must stay inside the run: {name}")
    return posixpath.join(folder, posixpath.normpath(name))


def write_turn(tables: dict[str, DataFrame], folder: str, turn: int) -> None:
    """A turn's derived tables (packets, preflight, report, checks), each under
    its name and the turn; writing one again replaces only that turn."""
    for name, rows in tables.items():
        rows.withColumn("turn", F.lit(turn)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").json(inside(folder, name))


def transcript(claims: DataFrame) -> DataFrame:
    """(run, turn, text): a turn's claims by seat and place, with the seat, the
    type, whether grounded, and the documents cited."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("citations", lambda c: c["doc_id"]), lambda x: x.isNotNull())))
    cited = F.coalesce(F.array_join(ids, ", "), F.lit(""))
    line = F.concat(F.lit("["), "seat", F.lit("] "), F.coalesce("text", F.lit("")), F.when(F.coalesce("grounded", F.lit(False)), "").otherwise(" (not grounded)"), F.when(F.length(cited) > 0, F.concat(F.lit(" {"), cited, F.lit("}"))).otherwise(""))
    rows = claims.where("run is not null and turn is not null and seat is not null").select("run", "turn", F.struct("seat", F.coalesce("claim_idx", F.lit(0)).alias("i"), "claim_id", line.alias("line")).alias("x"))
    per = rows.groupBy("run", "turn", "x.seat").agg(F.array_join(F.sort_array(F.collect_list("x")).getField("line"), "\n").alias("part"))
    return per.groupBy("run", "turn").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seat", "part"))).getField("part"), "\n").alias("text"))
