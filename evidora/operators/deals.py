"""Axes of a turn as spoken and after re-deals. A turn is one row that holds its
claims; all deals of it are the rows of numpy arrays, so nothing is multiplied
in a shuffle, a broadcast or the driver, whatever the number of deals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from _md5 import md5  # half the time of hashlib's for short texts
except ImportError:
    from hashlib import md5

CELLS = 1_000_000  # numbers held at once
LARGE = 2_000  # rows of a turn beyond which its deals are spread over tasks, so many a row:
SPREAD = 8
AXES = ("evidence", "lexical", "positions")


def _placed(pairs: Iterable[tuple]) -> list[tuple]:
    """(seat, item) in the order of places: by seat, then item, nulls last."""
    return sorted(pairs, key=lambda x: (x[0] is None, x[0] or "", x[1] is None, 0 if x[1] is None else x[1]))


def orders(head: str, places: Sequence[tuple], perms: range) -> np.ndarray:
    """A row a deal: the places in the order of the md5 of deal, group, seat and
    item, joined by bars without the nulls."""
    keys = ["".join(f"|{x}" for x in place if x is not None).encode() for place in places]
    step, out = max(1, CELLS // 4 // max(1, len(keys))), [np.empty((0, len(keys)), np.int64)]
    for low in range(0, len(perms), step):
        heads = [f"{p}|{head}".encode() for p in perms[low : low + step]]
        raw = b"".join([md5(h + k).digest() for h in heads for k in keys])
        h = np.frombuffer(raw, ">u8").reshape(len(heads), len(keys), 2).astype(np.uint64)
        order = np.argsort(h[:, :, 0], axis=1, kind="stable")
        first = np.take_along_axis(h[:, :, 0], order, axis=1)
        if (first[:, 1:] == first[:, :-1]).any():
            order = np.lexsort((h[:, :, 1], h[:, :, 0]), axis=1)
        out.append(order)
    return np.concatenate(out)


def _numbered(values: Iterable) -> tuple[np.ndarray, int]:
    at: dict = {}
    return np.array([at.setdefault(v, len(at)) for v in values], np.int64), len(at)


def distances(owner: np.ndarray, items: np.ndarray, dealt: np.ndarray, k: int, n_items: int) -> np.ndarray:
    """Mean Jaccard distance of the pairs of ``k`` seats for each row of
    ``dealt``, whose place j goes to seat ``owner[j]``; places beyond the owners
    have none."""
    got, (a, b) = items[dealt[:, : len(owner)]], np.triu_indices(k, 1)
    size, shared = np.zeros((len(got), k)), np.zeros((len(got), k, k))
    width = max(1, CELLS // k)
    for low in range(0, n_items, width):
        held = np.zeros((len(got), k, min(width, n_items - low)), np.float32)
        p, j = np.nonzero((got >= low) & (got < low + width))
        held[p, owner[j], got[p, j] - low] = 1
        size += held.sum(2, dtype=np.float64)
        shared += held @ held.transpose(0, 2, 1)
    both = shared[:, a, b]
    return (1 - both / (size[:, a] + size[:, b] - both)).mean(1)


class Words:
    """The terms of a turn's claims, as (claim, term, n), and what a deal of the
    claims makes of them."""

    def __init__(self, tokens: Sequence[list[str]], k: int):
        claim = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        term, n_terms = _numbered(w for t in tokens for w in t)
        cell, n = np.unique(claim * max(1, n_terms) + term, return_counts=True)
        self.claim, self.term, self.n, self.k = cell // max(1, n_terms), cell % max(1, n_terms), n.astype(np.float64), k
        self.n_terms, self.total = n_terms, np.bincount(claim, minlength=len(tokens)).astype(np.float64)
        # Only a term of two claims can be one of two seats.
        common = np.bincount(self.term, minlength=n_terms) > 1
        kept = common[self.term]
        self.common = (self.claim[kept], (np.cumsum(common) - 1)[self.term[kept]], self.n[kept], int(common.sum()))

    def counts(self, seats: np.ndarray, entries: tuple) -> np.ndarray:
        """(deal, term, seat): how often each seat says a term."""
        claim, term, n, n_terms = entries
        at = (np.arange(len(seats))[:, None] * n_terms + term) * self.k + seats[:, claim]
        return np.bincount(at.ravel(), np.tile(n, len(seats)), len(seats) * n_terms * self.k).reshape(len(seats), n_terms, self.k)

    def totals(self, seats: np.ndarray) -> np.ndarray:
        at = np.arange(len(seats))[:, None] * self.k + seats
        return np.bincount(at.ravel(), np.tile(self.total, len(seats)), len(seats) * self.k).reshape(len(seats), self.k)

    def divergences(self, seats: np.ndarray) -> np.ndarray:
        """Mean Jensen-Shannon divergence, base 2, of the pairs of seats with
        terms; not a number where there is no pair."""
        total, c = self.totals(seats), self.counts(seats, self.common)
        deal, term, seat = np.nonzero(c)
        p = c[deal, term, seat] / total[deal, seat]
        run, part = deal * c.shape[1] + term, np.zeros(len(seats))
        at = np.arange(len(run))
        for step in range(1, self.k):
            at = at[at + step < len(run)]
            at = at[run[at] == run[at + step]]
            if not len(at):
                break
            x, y = p[at], p[at + step]
            m = (x + y) / 2
            part += np.bincount(deal[at], 0.5 * x * np.log2(x / m) + 0.5 * y * np.log2(y / m) - 0.5 * x - 0.5 * y, len(seats))
        m = (total > 0).sum(1)
        pairs = m * (m - 1) / 2
        return np.where(pairs > 0, np.maximum(0.0, 1 + part / np.maximum(pairs, 1)), np.nan)

    def positions(self, seats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order-2 Vendi score - 1) / (members - 1) of the seats' tf-idf rows, 0
        for one member; and the members."""
        m = (self.totals(seats) > 0).sum(1)
        c = self.counts(seats, (self.claim, self.term, self.n, self.n_terms))
        idf = np.log((1 + m)[:, None] / (1 + (c > 0).sum(2))) + 1
        w = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0.0) * idf[:, :, None]
        w /= np.sqrt(np.maximum((w * w).sum(1, keepdims=True), 1e-300))
        a, b = np.triu_indices(self.k, 1)
        square = ((w.transpose(0, 2, 1) @ w)[:, a, b] ** 2).sum(1)
        m2 = m.astype(np.float64)
        return np.where(m > 1, (m2 * m2 / np.maximum(m2 + 2 * square, 1) - 1) / np.maximum(m2 - 1, 1), 0.0), m


def _parts(n: int, cells: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, cells))
    return (slice(x, x + step) for x in range(0, n, step))


def _turn(head: str, rows: dict[str, list], perms: range, first: bool, position_deals: int, axes: Sequence[str]) -> list[float | None]:
    """``rows`` by column. For each axis its value as spoken (in the first part of the deals), then
    the sum and the number of its values over the deals."""
    out: list[float | None] = []

    def mean(spoken: float | None, dealt: np.ndarray) -> None:
        dealt = dealt[~np.isnan(dealt)]
        out.extend([spoken if first and spoken is not None and spoken == spoken else None, float(dealt.sum()), float(len(dealt))])

    if "evidence" in axes:
        places = _placed({(seat, doc) for seat, docs in zip(rows["seat"], rows["docs"], strict=True) for doc in docs or () if doc is not None})
        owner, k = _numbered(seat for seat, _ in places if seat is not None)
        items, n_items = _numbered(doc for _, doc in places)
        if k > 1:
            dealt = orders(head, places, perms)
            each = [distances(owner, items, dealt[s], k, n_items) for s in _parts(len(dealt), k * n_items + len(places))]
            mean(float(distances(owner, items, np.arange(len(places))[None], k, n_items)[0]), np.concatenate([np.zeros(0), *each]))
        else:
            mean(None, np.zeros(0))
    if "lexical" in axes or "positions" in axes:
        tokens = {(seat, item): said or [] for seat, item, said in zip(rows["seat"], rows["item"], rows["tokens"], strict=True) if seat is not None}
        places = _placed(tokens)
        owner, k = _numbered(seat for seat, _ in places)
        words = Words([tokens[p] for p in places], k)
        seats = np.empty((len(perms), len(places)), np.int64)
        if len(places):
            np.put_along_axis(seats, orders(head, places, perms), np.broadcast_to(owner, seats.shape), axis=1)
        few = seats[[i for i, p in enumerate(perms) if p < position_deals]]
        if "lexical" in axes:
            each = [words.divergences(seats[s]) for s in _parts(len(seats), len(words.common[0]) + words.common[3] * k)]
            mean(float(words.divergences(owner[None])[0]) if k else None, np.concatenate([np.zeros(0), *each]))
        if "positions" in axes:
            each = [np.where(m > 0, v, np.nan) for v, m in (words.positions(few[s]) for s in _parts(len(few), len(words.n) + words.n_terms * k))]
            v, m = words.positions(owner[None]) if k else ([0.0], [0])
            mean(float(v[0]) if m[0] > 1 else None, np.concatenate([np.zeros(0), *each]))
    return out


def axes_of_turns(claims: DataFrame, group: list[str], deals: int, axes: Sequence[str] = AXES, position_deals: int = 0) -> DataFrame:
    """(group, axis, observed, null): each axis of a group as spoken beside its
    mean over ``deals`` deals (the first ``position_deals`` for positions), null
    where none was dealt. Evidence deals documents, the others claims; a member
    gets as many as it had. Claims have seat, and where their axes are asked for
    docs (array), or item (its key) and tokens (array)."""
    session = claims.sparkSession
    present = [c for c in ("seat", "item", "tokens", "docs") if c in claims.columns]
    turns = claims.dropna(subset=group).groupBy(*group).agg(F.collect_list(F.struct(*present)).alias("rows"))
    turns = turns.select(*group, F.concat_ws("|", *group).alias("head"), "rows")
    if deals:
        step = F.when(F.size("rows") > LARGE, SPREAD).otherwise(deals)
        turns = turns.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(deals - 1), F.col("step"))))
        turns = turns.repartition(int(session.conf.get("spark.sql.shuffle.partitions")), *group, "first")
    else:
        turns = turns.withColumn("step", F.lit(0)).withColumn("first", F.lit(0))
    values = [f"{axis}_{x}" for axis in AXES if axis in axes for x in ("observed", "sum", "n")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                each = b.column("rows").flatten()
                held, ends = {c: each.field(c).to_pylist() for c in present}, np.cumsum([0, *pc.list_value_length(b.column("rows")).to_pylist()])
                found = []
                for i, (head, first, step) in enumerate(zip(*(b.column(c).to_pylist() for c in ("head", "first", "step")), strict=True)):
                    rows = {c: held[c][ends[i] : ends[i + 1]] for c in present}
                    found.append(_turn(head, rows, range(first, min(deals, first + step)), first == 0, position_deals, axes))
                yield pa.RecordBatch.from_arrays([*(b.column(g) for g in group), *(pa.array(x, pa.float64()) for x in zip(*found, strict=True))], names=[*group, *values])

    spec = ", ".join([*(f"{g} {claims.schema[g].dataType.simpleString()}" for g in group), *(f"{v} double" for v in values)])
    found = turns.mapInArrow(work, spec)
    found = found.groupBy(*group).agg(*[(F.max if v.endswith("_observed") else F.sum)(v).alias(v) for v in values])
    each = [F.struct(F.lit(axis).alias("axis"), F.col(f"{axis}_observed").alias("observed"), F.when(F.col(f"{axis}_n") > 0, F.col(f"{axis}_sum") / F.col(f"{axis}_n")).alias("null")) for axis in AXES if axis in axes]
    return found.select(*group, F.inline(F.array(*each))).where("observed is not null")
