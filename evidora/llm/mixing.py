"""Mixing sources to target weights (problem 7).

Pfair scheduling: each source's text is cut into blocks of equal size; block j
of a source with weight w is released at slot floor(j/w) and due at slot
ceil((j+1)/w), and earliest-deadline-first fills the slots, so that at every
slot each source is less than one block away from its share.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import math
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("EVIDORA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pre-tokenizing pattern of these vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, text: str = "text", path: str | None = None, name: str = "tokens") -> DataFrame:
    """``documents`` with the number of tokens of ``text`` under a public
    vocabulary file; 0 for null and empty texts."""
    file = path or os.path.join(TOKENIZER_DIR, VOCABULARY)

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        encode = _encoder(file).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in column.to_pylist()], pa.int64())

    return documents.withColumn(name, count(F.col(text)))


_ENCODERS: dict = {}


def _encoder(file: str):
    if file not in _ENCODERS:
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[file] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[file]


def plan(sizes: dict[str, int], targets: Iterable[tuple[str, float, int]], total: int | None = None) -> list[dict]:
    """What each targeted source is to contribute to a mix of ``total`` tokens
    (by default all targeted text): its share of the total, or what its capped
    passes allow where that is less. Shares are taken relative to their sum."""
    rows = sorted({(s, float(w or 0), int(p or 0)) for s, w, p in targets if s is not None})
    whole = sum(w for _, w, _ in rows) or 1.0
    total = sum(sizes.get(s, 0) for s, _, _ in rows) if total is None else total
    out = []
    for s, w, p in rows:
        wanted, available = (w / whole if abs(whole - 1) > 1e-9 else w) * total, sizes.get(s, 0) * p
        out.append({"source": s, "target_share": w, "max_passes": p, "size": sizes.get(s, 0), "wanted": wanted, "contributed": int(min(math.ceil(wanted), available))})
    return out


def schedule(blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block number): one block a slot, each source's blocks in
    the windows that its weight gives them, earliest deadline first. Holds one
    window a source: the next one is made when its block is placed."""
    total = sum(blocks.values())

    def window(s: str, j: int) -> tuple[int, int, str, int]:
        return j * total // blocks[s], -(-(j + 1) * total // blocks[s]), s, j

    waiting = [window(s, 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        yield slot, s, j
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, window(s, j + 1))


def source_sizes(counted: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    return counted.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("size"), F.count("*").alias("n"))


def _plan_of(counted: DataFrame, targets: DataFrame, total: int | None) -> tuple[list[dict], int]:
    """The plan, and the number of records of the largest source. Targets are a
    stated table of mixing weights, one row each, taken to the driver."""
    wanted = targets.select("source", "target_share", "max_passes").distinct()
    sized = source_sizes(counted).join(wanted.select("source").distinct(), "source", "left_semi").collect()
    return plan({r["source"]: int(r["size"] or 0) for r in sized}, [tuple(r) for r in wanted.collect()], total), max([r["n"] for r in sized], default=0)


def slots(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """:func:`schedule` as rows (slot, source, block), made by one task that
    holds the window of one block a source."""
    spec, schema = "slot bigint, source string, block bigint", pa.schema([("slot", pa.int64()), ("source", pa.string()), ("block", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            order = schedule(blocks)
            while part := list(itertools.islice(order, 65_536)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)

    return spark.range(0, 1, 1, 1).mapInArrow(work, spec)


def mix(counted: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, block: int = 65_536) -> DataFrame:
    """The mix: rows (key, source, pass, slot, tokens), ``slot`` being the
    place in the interleaved order of blocks of ``block`` tokens, so that up to
    any slot each source is less than ``block`` tokens (and the record that
    crosses a block's end) from its share.

    Records of a source are laid end to end in an order that their hash gives,
    by prefix sums in two levels, so that no source is sorted in one task; a
    pass beyond the first repeats them in the same order, and a record belongs
    to the block in which it starts. Records with null source, sources without
    a target, and empty texts are left out.
    """
    planned, most = _plan_of(counted, targets, total)
    rows = [r for r in planned if r["contributed"] > 0]
    spark = counted.sparkSession
    buckets = max(16, -(-most // 250_000))
    placed = slots(spark, {r["source"]: -(-r["contributed"] // block) for r in rows})
    quota = F.broadcast(spark.createDataFrame([(r["source"], r["contributed"], r["size"], -(-r["contributed"] // r["size"])) for r in rows], "source string, contributed bigint, size bigint, passes bigint"))
    base = counted.where(F.col("tokens") > 0).select(key, "source", "tokens").join(quota, "source")
    base = base.withColumn("bucket", F.pmod(F.xxhash64(key, "source"), F.lit(buckets)))
    sums = base.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "bucket", "before")
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit("order"), key), key).rowsBetween(Window.unboundedPreceding, -1)
    laid = base.withColumn("own", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(before, ["source", "bucket"])
    each = laid.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    at = F.col("pass") * F.col("size") + F.col("before") + F.col("own")
    each = each.withColumn("at", at).where(F.col("at") < F.col("contributed")).withColumn("block", F.floor(F.col("at") / block))
    return each.join(placed, ["source", "block"]).select(key, "source", "pass", "slot", "tokens")


def shares(counted: DataFrame, targets: DataFrame, total: int | None = None, block: int = 65_536) -> DataFrame:
    """One row a targeted source: its target, its size, the tokens wanted of
    it, and, measured on the rows of :func:`mix`, the tokens and passes that it
    contributes, its actual share of the mix, and whether the mix holds less of
    it than wanted. A target without text counts as size 0."""
    planned, _ = _plan_of(counted, targets, total)
    asked = counted.sparkSession.createDataFrame([(r["source"], r["target_share"], r["max_passes"], r["size"], r["wanted"]) for r in planned], "source string, target_share double, max_passes int, size bigint, wanted double")
    mixed = mix(counted, targets, "doc_id", total, block).groupBy("source").agg(F.sum("tokens").alias("contributed"), (F.max("pass") + 1).alias("passes"))
    got = F.coalesce("contributed", F.lit(0))
    out = asked.join(mixed, "source", "left").withColumn("whole", F.sum(got).over(Window.partitionBy(F.lit(0))))
    actual = F.when(F.col("whole") > 0, got / F.col("whole")).otherwise(0.0)
    return out.select("source", "target_share", "max_passes", "size", "wanted", got.alias("contributed"), F.coalesce("passes", F.lit(0)).alias("passes"), actual.alias("actual_share"), (got < F.col("wanted")).alias("short"))
