"""Near-duplicate records with small edits (problem 5).

MinHash banding: bands and rows are chosen for a target recall at the
threshold, one shuffle brings equal band hashes together, and every candidate
pair is verified on its full n-gram sets. Exact copies count as one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.llm.sketch import Bits, bitmap
from evidora.operators.graph import class_pairs, components
from evidora.session import cut


def choose_bands(threshold: float, recall: float, most_bands: int = 50) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance candidates, with
    which a pair at the threshold meets in one of at most ``most_bands`` bands
    with probability ``recall``."""
    best = (1, 1)
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))
        if bands > most_bands:
            break
        best = (max(1, bands), rows)
    return best


def grams(text: str, n: int, unit: str) -> set:
    """The n-gram set of a lower-cased text, of words or of characters. A text
    with fewer than n units is its only gram."""
    parts = text.split() if unit == "word" else text
    if len(parts) < n:
        return {tuple(parts)} if parts else set()
    if unit == "word":
        return set(zip(*(parts[i:] for i in range(n))))
    return {text[i : i + n] for i in range(len(text) - n + 1)}


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Signer:
    """Band hashes of texts."""

    STRETCH = 1 << 16  # units that are hashed at once, and what the last text has beyond

    def __init__(self, n: int, unit: str, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.n, self.unit, self.bands, self.rows = n, unit, bands, rows
        self.a = rng.integers(1, 2**32, k, dtype=np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]
        self.mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.lift = rng.integers(1, 2**63, max(n, 1), dtype=np.uint64) | np.uint64(1)
        self.band = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.words = _Words()

    def codes(self, text: str) -> np.ndarray:
        """The units of a text as numbers."""
        if self.unit == "word":
            parts = text.split()
            return np.fromiter(map(self.words.__getitem__, parts), np.uint64, len(parts))
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        codes = self.codes(text)
        if not len(codes):
            return np.empty(0, np.uint32)
        if len(codes) < self.n:
            return np.array([xxhash.xxh32_intdigest(codes.tobytes())], np.uint32)
        return self.mixed(codes)

    def mixed(self, codes: np.ndarray) -> np.ndarray:
        """A hash of every n units in a row."""
        m = max(0, len(codes) - self.n + 1)
        h = np.zeros(m, np.uint64)
        for i in range(self.n):
            h = (h ^ (h >> np.uint64(31))) * self.lift[i] + codes[i : i + m]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return (h >> np.uint64(32)).astype(np.uint32)

    def lowest(self, x: np.ndarray) -> np.ndarray:
        """The least value of each hash function over the grams of a text."""
        a, b = self.a[:, 0], self.b[:, 0]
        low = (x[:4096, None] * a + b).min(axis=0)
        for i in range(4096, len(x), 4096):
            low = np.minimum(low, (x[i : i + 4096, None] * a + b).min(axis=0))
        return low

    def many(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """The places of the texts that have grams, and their band hashes, a
        row a text. Grams are hashed over the texts of a stretch at once."""
        at, lows, k = [], [], 0
        while k < len(texts):
            codes, size, begin = [], 0, k
            while k < len(texts) and size < self.STRETCH:
                codes.append(self.codes(texts[k]))
                size += len(codes[-1])
                k += 1
            whole, start = self.mixed(np.concatenate(codes)), 0
            for i, own in enumerate(codes, begin):
                m = len(own) - self.n + 1
                if len(own):
                    at.append(i)
                    lows.append(self.lowest(whole[start : start + m] if m > 0 else self.hashes(texts[i])))
                start += len(own)
        if not at:
            return at, np.empty((0, self.bands), np.uint64)
        h = (np.stack(lows).reshape(-1, self.bands, self.rows).astype(np.uint64) * self.mix).sum(axis=2) + self.band
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return at, h ^ (h >> np.uint64(29))

    def __call__(self, text: str) -> np.ndarray | None:
        at, h = self.many([text])
        return h[0] if at else None


def band_rows(texts: DataFrame, n: int, unit: str, bands: int, rows: int, hot: dict[int, int] | None = None) -> DataFrame:
    """(h, tid) for every band of every text of (tid, text). A task signs each
    text once, so copies don't multiply before the shuffle. Rows of the ``hot``
    buckets have their sides changed, (tid, h), so that a later shuffle on the
    first column spreads them."""
    schema = pa.schema([("h", pa.int64()), ("tid", pa.int64())])
    spread = np.sort(np.array(list(hot or ()), np.int64))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, unit, bands, rows)
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, new = [], []
                for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if tid in seen:
                        continue
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(tid)
                    ids.append(tid)
                    new.append(text)
                at, marks = signer.many(new)
                if at:
                    h, t = marks.ravel().view(np.int64), np.repeat(np.array(ids, np.int64)[at], bands)
                    if len(spread):
                        swap = np.isin(h, spread)
                        h, t = np.where(swap, t, h), np.where(swap, h, t)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(t)], schema=schema)

    return texts.select("tid", "text").mapInArrow(sign, "h bigint, tid bigint")


def hot_buckets(texts: DataFrame, n: int, unit: str, bands: int, rows: int, one_in: int = 64, share: float = 1e-3) -> dict[int, int]:
    """(bucket -> a text of it) for the buckets that a 64th of the texts shows
    to hold ``share`` of them all: at most ``bands / share``. It only decides
    which rows aren't brought together by bucket; the pairs are the same. A
    text has a row a band, so the sample's rows tell how many texts it has."""
    some = texts.where(F.pmod(F.xxhash64("tid", F.lit(3)), F.lit(one_in)) == 0)
    banded = cut(band_rows(some, n, unit, bands, rows).groupBy("h").agg(F.count_distinct("tid").alias("c"), F.min("tid").alias("first")))
    all_rows = banded.agg(F.sum("c")).first()[0] or 0
    least = max(16, share * all_rows / bands)
    return {r["h"]: r["first"] for r in banded.where(F.col("c") >= least).collect()}


def bucket_pairs(banded: DataFrame, all_pairs_up_to: int = 64, spread: dict[int, int] | None = None, most_held: int = 1_000_000) -> DataFrame:
    """Candidate pairs (x, y, hot) of the texts in a band bucket. A bucket of
    fewer than ``all_pairs_up_to`` texts gives all its pairs; a larger one also
    pairs every text with its first one, as ``hot`` pairs with the bucket's
    ``h``: :func:`links` sees to what doesn't match it. Buckets stream through
    in order, of a bucket at most ``most_held`` rows and a batch are held, and
    the first of these pairs with those behind; rows of the ``spread`` buckets
    come as (text, bucket) and are paired with the text named there wherever
    they are."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("hot", pa.int64())])
    spread = spread or {}
    far = np.sort(np.array(list(spread), np.int64))
    leader = np.array([spread[int(h)] for h in far], np.int64)

    def rows(x: np.ndarray, y: np.ndarray, hot: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), hot], schema=schema)

    def whole(h: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of whole buckets, whose rows lie together."""
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        h, t = h[keep], t[keep]
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[new], t[new]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(h)))
        for size in np.unique(np.minimum(sizes, all_pairs_up_to)):
            if size > 1:
                own = t[starts[np.minimum(sizes, all_pairs_up_to) == size][:, None] + np.arange(size)]
                for some in np.array_split(own, -(-len(own) * int(size) ** 2 // 1_000_000)):
                    i, j = np.triu_indices(size, 1)
                    x = some[:, i].ravel()
                    yield rows(x, some[:, j].ravel(), pa.nulls(len(x), pa.int64()))
        for k in np.flatnonzero(sizes >= all_pairs_up_to):
            a, b = starts[k], starts[k] + sizes[k]
            yield rows(np.repeat(t[a], b - a - 1), t[a + 1 : b], pa.array(h[a + 1 : b]))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_h = left_t = np.empty(0, np.int64)  # of the bucket that may go on
        led: tuple[int, int] | None = None  # the bucket too large to be held, and its first text
        for batch in batches:
            h = batch.column(0).to_numpy()
            t = batch.column(1).to_numpy()
            if len(far):
                out = np.isin(t, far)
                if out.any():
                    bucket, one = t[out], h[out]
                    first = leader[np.searchsorted(far, bucket)]
                    differ = first != one
                    yield rows(first[differ], one[differ], pa.array(bucket[differ]))
                    h, t = h[~out], t[~out]
            if led and len(h):
                on = np.searchsorted(h, led[0], "right")
                one = t[:on][t[:on] != led[1]]
                yield rows(np.repeat(led[1], len(one)), one, pa.array(np.repeat(led[0], len(one))))
                h, t = h[on:], t[on:]
                led = None if len(h) else led
            if not len(h):
                continue
            h, t = np.concatenate((left_h, h)), np.concatenate((left_t, t))
            last = np.searchsorted(h, h[-1])
            yield from whole(h[:last], t[:last])
            left_h, left_t = h[last:], t[last:]
            if len(left_h) > most_held:
                yield from whole(left_h, left_t)
                led = int(left_h[0]), int(left_t.min())
                left_h = left_t = np.empty(0, np.int64)
        yield from whole(left_h, left_t)

    return banded.repartition("h").sortWithinPartitions("h").mapInArrow(pairs, "x bigint, y bigint, hot bigint")


BLOOM_BITS = 1 << 26


def _among(ids: DataFrame, column: str):
    """A condition that holds for all of ``ids`` and for few others: a bitmap of
    :data:`BLOOM_BITS` places, 8 MB whatever the number of ids. It only
    spares the shuffle texts that are in no pair; the join decides. Marked as
    not deterministic, lest the planner also puts it to the other side of the
    join or computes the column twice."""
    place = F.xxhash64(F.col(column), F.lit(7))
    bits = bitmap(ids.select(place.alias("at")), BLOOM_BITS)
    sent = ids.sparkSession.sparkContext.broadcast((bits.bits, bits.words))

    @F.arrow_udf("boolean")
    def held(at: pa.Array) -> pa.Array:
        return pa.array(Bits(*sent.value).held(at.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return held.asNondeterministic()(place)


def _narrowed(rest: DataFrame, members: DataFrame, texts: DataFrame, n: int, unit: str, threshold: float) -> DataFrame:
    """Smaller buckets (h, tid) in which every pair of similar texts of a bucket
    (h, tid) meets of which one is in ``rest``. Within a bucket the grams are
    ordered by how many of its texts hold them; two sets of that similarity
    share one of their ``size - ceil(threshold * size) + 1`` rarest grams, so
    what the bucket's texts have in common, and met by, is in few prefixes."""
    signer = Signer(n, unit, 1, 1)

    @F.arrow_udf("array<int>")
    def hashes(column: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            return pa.array([np.unique(signer.hashes(t)).view(np.int32) for t in column.to_pylist()], pa.list_(pa.int32()))

    held = texts.where(_among(members, "tid")).join(members.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    each = members.join(held.select("tid", hashes("text").alias("gs")), "tid").select("h", "tid", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    df = each.groupBy("h", "g").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("h", "tid").orderBy("df", "g"))
    prefix = each.join(df, ["h", "g"]).withColumn("r", rank).where(F.col("r") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("h", "g", "tid")
    wanted = prefix.join(rest.select("h", F.col("one").alias("tid")), ["h", "tid"], "left_semi").select("h", "g").distinct()
    return prefix.join(wanted, ["h", "g"], "left_semi").select(F.xxhash64("h", "g").alias("h"), "tid")


def verified(pairs: DataFrame, texts: DataFrame, n: int, unit: str, threshold: float) -> DataFrame:
    """The pairs (x, y) whose texts' n-gram sets have at least the Jaccard
    similarity ``threshold``, with it."""
    ids = pairs.select(F.col("x").alias("tid")).union(pairs.select(F.col("y").alias("tid"))).distinct()
    held = texts.where(_among(ids, "tid")).join(ids.hint("merge"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("similarity", pa.float64())])

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set] = {}
        size = 0
        for batch in batches:
            out = []
            ends = [(column.to_pylist(), batch.column(k)) for k, column in ((2, batch.column(0)), (3, batch.column(1)))]
            for row, (x, y) in enumerate(zip(ends[0][0], ends[1][0])):
                if size > 500_000:
                    sets.clear()
                    size = 0
                for tid, texts_of in ((x, ends[0][1]), (y, ends[1][1])):
                    if tid not in sets:
                        sets[tid] = grams(texts_of[row].as_py(), n, unit)
                        size += len(sets[tid])
                a, b = sets[x], sets[y]
                both = len(a & b)
                similarity = both / (len(a) + len(b) - both) if a or b else 0.0
                if similarity >= threshold:
                    out.append((x, y, similarity))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), ()), schema)], schema=schema)

    pairs = pairs.hint("merge")
    joined = pairs.join(held.select(F.col("tid").alias("x"), F.col("text").alias("p")), "x").hint("merge").join(held.select(F.col("tid").alias("y"), F.col("text").alias("q")), "y")
    return joined.select("x", "y", "p", "q").mapInArrow(alike, "x bigint, y bigint, similarity double")


def links(texts: DataFrame, n: int, unit: str, threshold: float, recall: float, most_bands: int = 50, most_rounds: int = 8) -> DataFrame:
    """Verified links (x, y, similarity) between different texts of (tid, text).

    All links of buckets of fewer than 64 texts. Of a larger bucket the links
    of every text to one of its texts; those that don't match that one meet
    the others in the smaller buckets of :func:`_narrowed`, round by round, so
    that the chained classes are the same as with all links while unlike texts
    aren't paired off. What is left after ``most_rounds`` meets its whole bucket.
    """
    bands, rows = choose_bands(threshold, recall, most_bands)
    spread = hot_buckets(texts, n, unit, bands, rows)
    # Sizes estimated from the texts tell nothing about the number of pairs:
    # the hints keep tables of pairs from being broadcast on such an estimate.
    found = cut(bucket_pairs(band_rows(texts, n, unit, bands, rows, spread), spread=spread).distinct()).hint("merge")
    known = cut(found.select("x", "y").distinct())
    good = cut(verified(known, texts, n, unit, threshold))
    for turn in range(most_rounds + 1):
        hot = found.where("hot is not null").select(F.col("hot").alias("h"), "x", "y")
        if hot.isEmpty():
            return good
        # The text that a bucket's others are compared with is in all its pairs.
        first = hot.groupBy("h").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        lead = F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(F.when(F.col("y0") == F.col("y1"), F.col("y0")))
        one = F.when(F.col("x") == F.col("lead"), F.col("y")).when(F.col("y") == F.col("lead"), F.col("x"))
        sides = hot.join(good.select("x", "y"), ["x", "y"], "left_anti").join(first.select("h", lead.alias("lead")), "h")
        rest = cut(sides.select("h", F.explode(F.when(one.isNotNull(), F.array(one)).otherwise(F.array("x", "y"))).alias("one")).distinct())
        if rest.isEmpty():
            return good
        members = hot.select("h", F.col("x").alias("tid")).union(hot.select("h", F.col("y").alias("tid"))).distinct().join(rest.select("h").distinct(), "h", "left_semi").hint("merge")
        if turn < most_rounds:
            found = cut(bucket_pairs(_narrowed(rest, members, texts, n, unit, threshold)).distinct()).hint("merge")
        else:
            found = rest.join(members, "h").where("one <> tid").select(F.least("one", "tid").alias("x"), F.greatest("one", "tid").alias("y"), F.lit(None).cast("bigint").alias("hot")).distinct()
        new = cut(found.select("x", "y").distinct().join(known, ["x", "y"], "left_anti"))
        known = known.unionByName(new)
        good = cut(good.unionByName(verified(new, texts, n, unit, threshold)))
    return good


def near_duplicates(records: DataFrame, key: str, text: str, n: int = 5, unit: str = "word", threshold: float = 0.8, recall: float = 0.98) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of similar records. Returns

    - members: (key, tid), each record and its lower-cased text's id,
    - links: (x, y, similarity) between ids of different texts,
    - classes: (member, root) over the linked ids, chained.

    Records with a null key, or a null or blank text, are in no class.
    Repeated rows count once; a key with several texts has several rows.
    """
    base = records.where(F.col(key).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(key).cast("string").alias("key"), F.lower(F.col(text)).alias("text"))
    base = base.withColumn("tid", F.xxhash64("text"))
    found = links(base.select("tid", "text"), n, unit, threshold, recall)
    return base.select("key", "tid").distinct(), found, components(found, "x", "y")


def linked_pairs(members: DataFrame, found: DataFrame, classes: DataFrame, all_pairs_up_to: int = 64) -> DataFrame:
    """Pairs (key_a, key_b) with key_a < key_b that, chained, are the classes: a
    class of up to ``all_pairs_up_to`` records is written as all its pairs, a
    larger one as the pairs with its first record and the verified links
    between the first records of different texts."""
    roots = cut(members.join(classes.withColumnRenamed("member", "tid"), "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root")))
    large = roots.groupBy("root").agg(F.count_distinct("key").alias("n")).where(F.col("n") > all_pairs_up_to)
    first = roots.join(large.select("root"), "root", "left_semi").groupBy("tid").agg(F.min("key").alias("first"))
    ends = found.join(first.select(F.col("tid").alias("x"), F.col("first").alias("a")), "x").join(first.select(F.col("tid").alias("y"), F.col("first").alias("b")), "y")
    ends = ends.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).where("key_a < key_b")
    return class_pairs(roots, "key", "root", all_pairs_up_to).unionByName(ends).distinct()
