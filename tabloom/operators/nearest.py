"""Exact nearest rows between two distributed tables of vectors, pruned by ball bounds.

Vectors are gathered into balls of bounded size: rows are dealt to the nearest of a few pivots, and those of a pivot are
halved at medians until they fit a ball. A ball is known by its centroid and radius, which bound the score of any pair of
rows from two balls. Neighbouring data balls share a slot and neighbouring query balls a page; a slot meets a page only
where bounds allow a hit. There the leaves of the balls meet, the likeliest first, as matrix products, until bounds rule
out the rest, and the best k rows of each query are handed on. Those lists merge in any order. No vectors but the pivots
pass through the driver, and no task holds more than a slot and a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import ident
from ..functions.lineage import cut_lineage

#: Pivots at most, rows of a ball, and vector bytes of a slot and of a page.
PIVOTS, BALL, SLOT_BYTES, PAGE_BYTES = 64, 1024, 32 << 20, 8 << 20
#: Rows of a leaf, pairs of rows scored together, and vector bytes of a pivot that are halved together.
LEAF, PAIRS, RUN_BYTES = 128, 1 << 19, 8 << 20
#: Bounds give way by this much, so that rounding never loses a hit.
SLACK = 1e-9
COSINE, EUCLID = "cosine", "euclid"


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * x @ pivots.T, 0.0))


def _parts(n: int, size: int) -> np.ndarray:
    """Where the parts begin that ``n`` rows fall into when halved until none has more than ``size``."""
    todo, out = [(0, n)], []
    while todo:
        at, m = todo.pop()
        if m <= size:
            out.append(at)
        else:
            todo += [(at + m // 2, m - m // 2), (at, m // 2)]
    return np.array(out, np.int64)


def _halved(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each of the :func:`_parts` holds one side of a median of the widest column, and so on."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        at, m = todo.pop()
        if m > size:
            mine = order[at:at + m]
            rows = x[mine]
            order[at:at + m] = mine[np.argpartition(rows[:, np.ptp(rows, axis=0).argmax()], m // 2)]
            todo += [(at, m // 2), (at + m // 2, m - m // 2)]
    return order


def balls(df: DataFrame, key: str, vector: str, measure: str = COSINE, ball: int = BALL) -> DataFrame:
    """``ball, n, centroid, radius, keys, vectors`` of the rows of ``df`` with a vector; for cosine they get length 1.

    A row per ball of at most ``ball`` rows; ``vectors`` holds them one after another, leaf by leaf. Balls near by each
    other have ids near by. All vectors have one length.
    """
    kind = df.schema[key].dataType
    rows = df.select(ident(key).alias("key"), ident(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    few = rows.orderBy(F.xxhash64("key", "v")).limit(PIVOTS).select("v").collect()
    pivots = np.array([r["v"] for r in few], dtype=float) if few else np.zeros((1, 1))
    pivots = _unit(pivots) if measure == COSINE else pivots
    pivots = pivots[_halved(pivots, 1)]
    held_most = max(ball, RUN_BYTES // (8 * pivots.shape[1]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            x = _unit(x) if measure == COSINE else x
            d = _far(x, pivots)
            own = d.argmin(1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), flat, pa.array(own), pa.array(d[np.arange(len(x)), own])], names=["key", "v", "pivot", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: pa.Table) -> Iterator[pa.RecordBatch]:
            x, keys = _matrix(group["v"].combine_chunks()), group["key"].combine_chunks()
            order, at = _halved(x, min(LEAF, ball)), _parts(len(x), ball)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            for a, b in zip(at, [*at[1:], len(x)]):
                rows = x[order[a:b]]
                centre = rows.mean(0)
                far = float(np.sqrt(((rows - centre) ** 2).sum(1)).max())
                yield pa.record_batch(
                    [pa.array([len(rows)], pa.int64()), one(pa.array(centre)), pa.array([far]), one(keys.take(pa.array(order[a:b]))), one(pa.array(rows.ravel()))],
                    names=["n", "centroid", "radius", "keys", "vectors"])

        held: list[pa.RecordBatch] = []
        n, own = 0, None
        for b in batches:
            # a ball has one pivot; what may go on stays held
            pivot = b.column(2).to_numpy()
            starts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else []
            for i, j in zip(starts, [*starts[1:], len(pivot)]):
                if held and pivot[i] != own:
                    yield from made(pa.Table.from_batches(held))
                    held, n = [], 0
                own = pivot[i]
                while i < j:
                    some = min(j - i, held_most - n)
                    held.append(b.slice(i, some))
                    i, n = i + some, n + some
                    if n == held_most:
                        yield from made(pa.Table.from_batches(held))
                        held, n = [], 0
        if held:
            yield from made(pa.Table.from_batches(held))

    name = kind.simpleString()
    dealt = rows.mapInArrow(deal, f"key {name}, v array<double>, pivot long, far double")
    packed = dealt.repartitionByRange("pivot", "far", "key").sortWithinPartitions("pivot", "far", "key").mapInArrow(
        cut, f"n long, centroid array<double>, radius double, keys array<{name}>, vectors array<double>")
    return cut_lineage(packed.withColumn("ball", F.monotonically_increasing_id()))


def _stretch(found: DataFrame, n: int) -> Column:
    """The number of the stretch of a ball when all are cut into ``n`` stretches of neighbours."""
    part, place = F.shiftrightunsigned("ball", 33), F.col("ball").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in found.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *[c for _, c in sizes]]).tolist()))
    if not sizes:
        return F.lit(0)
    before = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), part)
    return F.floor((before + place) * n / sum(c for _, c in sizes)).cast("int")


def _bounds(measure: str, q: pa.Table, d: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of rows from each query ball (rows) and each data ball (columns)."""
    x, y = (_matrix(t["centroid"].combine_chunks()) for t in (q, d))
    rx, ry = (t["radius"].to_numpy() for t in (q, d))
    if measure == COSINE:
        mid = x @ y.T
        reach = rx[:, None] * np.linalg.norm(y, axis=1) + ry * np.linalg.norm(x, axis=1)[:, None] + rx[:, None] * ry + SLACK
        return mid - reach, mid + reach
    far, reach = _far(x, y), rx[:, None] + ry + SLACK
    return -((far + reach) ** 2), -(np.maximum(far - reach, 0.0) ** 2)


def _meetings(queries: DataFrame, data: DataFrame, slots: int, pages: int, k: int, measure: str) -> DataFrame:
    """``slot, page, q_ball, d_ball`` of all pairs of balls that may hold one of the k best rows of a query.

    ``queries`` has a ``page`` and ``data`` a ``slot`` with each ball. A ball of k rows or more promises each query k
    hits of at least its least score; balls whose greatest score lies below the best promise are left out.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("slot", "ball", "n", "centroid", "radius", every(pages).alias("page"))
    right = queries.select("page", "ball", "centroid", "radius", every(slots).alias("slot"))

    def promise(d: pa.Table, q: pa.Table) -> pa.Table:
        low = np.where(d["n"].to_numpy() >= k, _bounds(measure, q, d)[0], -np.inf) if d.num_rows and q.num_rows else np.zeros((0, 1))
        return pa.table({"f_ball": q["ball"].slice(0, len(low)), "floor": pa.array(low.max(1), pa.float64())})

    def keep(d: pa.Table, q: pa.Table) -> pa.Table:
        high = _bounds(measure, q, d)[1] if d.num_rows and q.num_rows else np.zeros((0, 0))
        i, j = np.nonzero(high >= q["floor"].to_numpy()[:len(high), None])
        return pa.table({c: t[n].take(pa.array(at)) for c, t, n, at in (("slot", d, "slot", j), ("page", q, "page", i), ("q_ball", q, "ball", i), ("d_ball", d, "ball", j))})

    by = ("slot", "page")
    floor = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(promise, "f_ball long, floor double").groupBy("f_ball").agg(F.max("floor").alias("floor"))
    told = right.join(floor, F.col("ball") == F.col("f_ball")).drop("f_ball")
    return left.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(keep, "slot int, page int, q_ball long, d_ball long")


def _score(measure: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if measure == COSINE:
        return q @ x.T
    # squares about the middle of the queries round least
    mid = q.mean(0)
    return -_far(q - mid, x - mid) ** 2


class _Leaves:
    """Consecutive runs of rows, with what bounds the score of any row of theirs."""

    def __init__(self, measure: str, x: np.ndarray, sizes: np.ndarray):
        self.measure, self.x = measure, x
        ends = np.cumsum(sizes)
        self.at = np.concatenate([e - n + _parts(int(n), LEAF) for e, n in zip(ends, sizes)])
        self.end = np.append(self.at[1:], len(x))
        if measure == COSINE:
            n = (self.end - self.at)[:, None]
            self.mid = np.add.reduceat(x, self.at) / n
            self.radius = np.sqrt(np.maximum.reduceat(((x - np.repeat(self.mid, n[:, 0], axis=0)) ** 2).sum(1), self.at))
            self.length = np.linalg.norm(self.mid, axis=1)
        else:
            self.low, self.high = np.minimum.reduceat(x, self.at), np.maximum.reduceat(x, self.at)

    def best(self, other: "_Leaves", i: int) -> np.ndarray:
        """The greatest score that a row of each leaf can have with a row of leaf ``i`` of ``other``."""
        if self.measure == COSINE:
            r = other.radius[i]
            return self.mid @ other.mid[i] + r * self.length + self.radius * other.length[i] + self.radius * r + SLACK
        gap = np.maximum(np.maximum(self.low - other.high[i], other.low[i] - self.high), 0.0)
        return -np.maximum(np.sqrt((gap * gap).sum(1)) - SLACK, 0.0) ** 2


def _top(who: np.ndarray, what: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query in order, ties by the place."""
    order = np.lexsort((place[what], -score, who))
    who, what, score = who[order], what[order], score[order]
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    keep = rank < k
    return who[keep], what[keep], score[keep]


def _leaf_hits(measure: str, q: np.ndarray, rows: _Leaves, high: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query, row and score of the ``k`` best rows of each query of one leaf; ``high`` bounds the scores of each leaf of rows."""
    who, what, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cut, order, most, at = np.full(len(q), -np.inf), np.argsort(-high, kind="stable"), max(LEAF, PAIRS // len(q)), 0
    while at < len(order) and high[order[at]] >= cut.min():
        sizes = np.cumsum((rows.end - rows.at)[order[at:at + 1 + most // 16]])
        # a few leaves tell how far the others have to be looked at
        some = order[at:at + max(1, int(np.searchsorted(sizes, most if at else most // 4, side="right")))]
        at += len(some)
        some = some[high[some] >= cut.min()]
        near = np.concatenate([np.arange(rows.at[j], rows.end[j]) for j in some])
        s = _score(measure, q, rows.x[near])
        floor = cut
        if s.shape[1] > k and np.isneginf(cut).any():
            floor = np.maximum(cut, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
        # rounding of a product may move a row a little, so the last places are decided by exact sums
        i, j = np.nonzero(s >= (floor - 1e-7 * (1 + np.abs(floor)))[:, None])
        e = _exact(measure, q[i], rows.x[near[j]])
        who, what, score = _top(np.append(who, i), np.append(what, near[j]), np.append(score, e), place, k)
        count = np.bincount(who, minlength=len(q))
        cut = np.where(count == k, np.append(score, -np.inf)[np.cumsum(count) - 1], -np.inf)
    return who, what, score


def _exact(measure: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, summed in one order, so equal vectors get equal scores in any block."""
    return (q * x).sum(1) if measure == COSINE else -((q - x) ** 2).sum(1)


def nearest(
    data: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, measure: str = COSINE,
    ball: int = BALL, slot_bytes: int = SLOT_BYTES, page_bytes: int = PAGE_BYTES,
) -> DataFrame:
    """``query_key, key, score, rank``: for each query the k rows of the greatest score, ties by the smaller key.

    ``score`` is the cosine, or minus the squared distance (``measure=EUCLID``). Rows without a vector take no part;
    zero vectors have cosine 0. Keys may repeat, and each row then counts. Fewer than k rows give all of them.
    """
    kind, qkind = data.schema[key].dataType, queries.schema[query_key].dataType
    d, q = balls(data, key, vector, measure, ball), balls(queries, query_key, query_vector, measure, ball)
    width = 8 * (d.agg(F.max(F.size("centroid"))).first()[0] or 1)
    places = lambda df, per: max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) * width // per))
    slots, pages = places(d, slot_bytes), places(q, page_bytes)
    # small tables are still worth all cores
    pages = max(pages, min(q.count(), 2 * data.sparkSession.sparkContext.defaultParallelism)) if d.count() > 1 else pages
    d, q = d.withColumn("slot", _stretch(d, slots)), q.withColumn("page", _stretch(q, pages))
    if slots == pages == 1:
        left, right = (df.select(F.lit(0).alias(a), F.lit(0).alias(b), "keys", "vectors") for df, a, b in ((d, "slot", "page"), (q, "q_slot", "q_page")))
    else:
        met = cut_lineage(_meetings(q, d, slots, pages, k, measure))
        sent = lambda df, c: met.select(c, "slot", "page").distinct().join(df.select("ball", "keys", "vectors"), F.col(c) == F.col("ball")).select("slot", "page", "keys", "vectors")
        left, right = sent(d, "d_ball"), sent(q, "q_ball").withColumnsRenamed({"slot": "q_slot", "page": "q_page"})
    key_type, query_type = to_arrow_type(kind), to_arrow_type(qkind)

    def flat(t: pa.Table) -> tuple[pa.Array, _Leaves]:
        keys, sizes = t["keys"].combine_chunks().flatten(), pc.list_value_length(t["keys"].combine_chunks()).to_numpy()
        x = t["vectors"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return keys, _Leaves(measure, x.reshape(len(keys), -1), sizes)

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not (rows.num_rows and asked.num_rows):
            return pa.table({"q": pa.array([], query_type), "d": pa.array([], key_type), "score": pa.array([], pa.float64())})
        keys, x = flat(rows)
        names, m = flat(asked)
        place = np.empty(len(keys), np.int64)
        place[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
        hits = []
        for i, (a, b) in enumerate(zip(m.at, m.end)):
            who, what, score = _leaf_hits(measure, m.x[a:b], x, x.best(m, i), place, k)
            hits.append((a + who, what, score))
        who, what, score = map(np.concatenate, zip(*hits))
        return pa.table([names.take(pa.array(who)).cast(query_type), keys.take(pa.array(what)).cast(key_type), pa.array(score)], names=["q", "d", "score"])

    found = left.groupBy("slot", "page").cogroup(right.groupBy("q_slot", "q_page")).applyInArrow(best, f"q {qkind.simpleString()}, d {kind.simpleString()}, score double")
    w = W.partitionBy("q").orderBy(F.col("score").desc(), "d")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("d").alias(key), "score", "rank")
