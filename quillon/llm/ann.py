"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors are parted into bands of norms within a factor of two, so that a few long ones don't spoil the
distances of the others; within a band inner products become distances by an extra coordinate that gives all
vectors the same norm. A bounded sample of a band is bisected into leaves of equal size; their means are the
centroids of its posting lists. Every distinct vector goes to its nearest list and, as a boundary vector, to
further lists whose centroids are hardly farther. Centroids are searched by best-first search on an
in-memory neighbour graph, both to assign vectors and to choose a query's lists: those whose distance is within
a ratio of the nearest. The ratio is measured, not guessed: on a bounded held-out sample it is the least one
that finds a share TARGET of the neighbours there.

Vectors are compared list by list, with the queries that chose the list. Lists that lie together form a shard;
shards with many vectors or queries are split into segments and blocks, so no task holds more than SEGMENT
vectors and BLOCK queries. Only ids and scores travel on from there.

Equal vectors are one entry with their k + 1 smallest ids: a query can never need more of them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, rows without an id
and vectors of another length than the table's most frequent one (ties: the shorter) take no part, as queries
neither; equal scores go to the smaller id; repeated rows count once; a query's own id is no candidate; a query
gets k neighbours, or all candidates if they are fewer; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

K = 20
#: Vectors a list, about, until there are MAX_LISTS lists; the centroids of all lists are broadcast.
LIST, MAX_LISTS = 64, 16_384
#: Sampled vectors a list, and components of the sample altogether, at most.
PER_LIST, SAMPLE_NUMBERS = 40, 1 << 24
#: Held-out vectors that the query ratio is measured on, those of them that ask, and the share of neighbours to find.
HELD, ASKING, TARGET = 8192, 1024, 0.94
#: A vector's lists at most, and their distance as a ratio of the nearest one's.
REPLICAS, REPLICA_RATIO = 4, 1.005
#: Bands with so few lists are read whole.
FEW_LISTS = 4
#: The graph's neighbours and entries; rows searched at once, their beam, and centroids of a row that are expanded in one step.
DEGREE, ENTRIES, BATCH, BEAM, WIDTH = 24, 16, 128, 24, 6
SHARD, SEGMENT, BLOCK, CHUNK = 32, 8192, 8192, 256
#: Candidates merged in one call, about.
MERGED = 1 << 21
_PLACES = 1 << 30


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unnested(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of every element of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), np.asarray(column.flatten())


def _nested(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values of ascending rows as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def bisect(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of so many parts of the rows of x, of equal size but for rounding; neighbours lie together."""
    out = []

    def part(rows: np.ndarray, k: int) -> None:
        s = x[rows]
        if k == 1:
            out.append(s.mean(axis=0))
            return
        a, b = s[0], s[np.argmax(((s - s[0]) ** 2).sum(axis=1))]
        for _ in range(6):
            side = s @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = s[side].mean(axis=0), s[~side].mean(axis=0)
        order = np.argsort(-(s @ (a - b)), kind="stable")
        left = k // 2
        cut = len(rows) * left // k
        part(rows[order[:cut]], left)
        part(rows[order[cut:]], k - left)

    part(np.arange(len(x)), lists)
    return np.array(out, np.float32)


class Centroids:
    """Centroids with a graph of nearest neighbours and, for connection, of neighbours in order."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.sq = (centroids * centroids).sum(axis=1)
        n, degree = len(centroids), min(DEGREE, len(centroids) - 1)
        near = np.zeros((n, degree), np.int32)
        for at in range(0, n, 1024):
            d = self.sq[None] - 2 * centroids[at : at + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else 0
        ring = (np.arange(n)[:, None] + np.array([1, -1, n // 3, n // 7 + 2])) % n
        self.graph = np.hstack([near, ring]).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int32))

    def distances(self, q: np.ndarray) -> np.ndarray:
        """From each row of q to every centroid."""
        q = q.astype(np.float32)
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.sq[None] - 2 * q @ self.c.T, 0))

    def search(self, q: np.ndarray, most: int, ratio: float, beam: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q up to most centroids within the ratio of the nearest found, the nearest first, and their distances; a place without one has infinity."""
        found = [self._best(q[at : at + BATCH].astype(np.float32), beam or BEAM) for at in range(0, len(q), BATCH)]
        ids, d = np.vstack([i[:, :most] for i, _ in found]), np.vstack([d[:, :most] for _, d in found])
        return ids, np.where(d <= d[:, :1] * ratio, d, np.inf)

    def _best(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search with a beam: the centroids found and their distances, the nearest first, as wide as the beam."""
        n, rows, beam = len(q), np.arange(len(q))[:, None], min(beam, len(self.c))
        q_sq = (q * q).sum(axis=1)[:, None]
        seen = np.zeros((n, len(self.c)), bool)
        seen[:, self.entries] = True
        ids = np.repeat(self.entries[None], n, axis=0)
        d = np.sqrt(np.maximum(q_sq + self.sq[ids] - 2 * q @ self.c[self.entries].T, 0))
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = ids[rows, order], d[rows, order]
        open_ = np.ones(ids.shape, bool)
        while True:
            useful = open_[:, :beam]
            active = useful.any(axis=1).nonzero()[0]
            if not len(active):
                return ids, d
            pick = np.argsort(~useful[active], axis=1, kind="stable")[:, :WIDTH]
            r = active[:, None]
            valid = useful[r, pick]
            open_[r, pick] = open_[r, pick] & ~valid
            near = np.where(valid[:, :, None], self.graph[ids[r, pick]], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & np.append(np.ones((len(active), 1), bool), near[:, 1:] != near[:, :-1], axis=1)
            fresh &= ~seen[r, near]
            keep = fresh.any(axis=0)
            near, fresh = near[:, keep], fresh[:, keep]
            a, b = fresh.nonzero()
            target = near[a, b]
            seen[active[a], target] = True
            new = np.full((n, near.shape[1]), np.inf, np.float32)
            new[active[a], b] = self._pairs(q, q_sq, active[a], target)
            further = np.zeros((n, near.shape[1]), np.int32)
            further[active] = near
            ids, d, open_ = np.hstack([ids, further]), np.hstack([d, new]), np.hstack([open_, np.isfinite(new)])
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, open_ = ids[rows, order], d[rows, order], open_[rows, order]

    def _pairs(self, q: np.ndarray, q_sq: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(q_sq[a, 0] + self.sq[b] - 2 * np.einsum("ij,ij->i", q[a], self.c[b]), 0))

    def within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Distances from each row of q to the centroids within the ratio of its nearest one, as the graph leads to them; infinity for all others."""
        return np.vstack([self._within(q[at : at + BATCH].astype(np.float32), ratio) for at in range(0, len(q), BATCH)])

    def _within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        n, q_sq = len(q), (q * q).sum(axis=1)[:, None]
        d = np.full((n, len(self.c)), np.inf, np.float32)
        ids, found = self._best(q, BEAM)
        d[np.arange(n)[:, None], ids] = found
        expanded = np.zeros(d.shape, bool)
        while True:
            useful = (d <= d.min(axis=1, keepdims=True) * ratio) & ~expanded
            if not useful.any():
                return np.where(expanded, d, np.inf)
            expanded |= useful
            a, b = useful.nonzero()
            fresh = np.zeros(d.shape, bool)
            fresh[np.repeat(a, self.graph.shape[1]), self.graph[b].reshape(-1)] = True
            a, b = (fresh & np.isinf(d)).nonzero()
            d[a, b] = self._pairs(q, q_sq, a, b)


class Band(NamedTuple):
    """Vectors whose norm is about 2 ** exponent: their lists are numbers first to first + lists - 1."""

    exponent: int
    first: int
    lists: int
    norm: float  # the largest one, times 2 ** -exponent
    centroids: Centroids | None  # None: one list
    ratio: float

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the band, scaled, with the coordinate that makes all norms equal."""
        x = np.ldexp(x, -self.exponent)
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1, keepdims=True), 0))])

    def pointed(self, q: np.ndarray) -> np.ndarray:
        """Queries, of unit norm, as points of the band."""
        return np.hstack([q * self.norm, np.zeros((len(q), 1))])


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def measured_ratio(band: Band, fitted: np.ndarray, held: np.ndarray, k: int, n: int, target: float) -> float:
    """The least ratio of distances at which vectors of the band find the share target of their nearest ones.

    held: vectors of the band that the centroids were not fitted to; n: all vectors of the band. Fitted vectors are
    closer to their centroid than others, so both kinds ask, and the larger ratio holds.
    """
    m = len(held)
    if band.lists <= FEW_LISTS or m < 2:
        return np.inf
    lists = np.zeros((m, min(REPLICAS, band.lists)), np.int64)
    for at in range(0, m, 1024):
        d = band.centroids.distances(band.raised(held[at : at + 1024]))
        own = np.argpartition(d, lists.shape[1] - 1, axis=1)[:, : lists.shape[1]]
        d = np.take_along_axis(d, own, axis=1)
        # a place that isn't used repeats the nearest list
        lists[at : at + 1024] = np.where(d <= d.min(axis=1, keepdims=True) * REPLICA_RATIO, own, np.take_along_axis(own, d.argmin(axis=1)[:, None], axis=1))
    near = min(max(1, round(k * m / n)), m - 1)
    found = []
    for asking, own in ((held[:ASKING], True), (fitted[:: max(1, len(fitted) // ASKING)][:ASKING], False)):
        units = _units(asking)
        s = units @ np.ldexp(held, -band.exponent).T
        if own:
            s[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
        closest = np.argpartition(-s, near - 1, axis=1)[:, :near]
        far = band.centroids.distances(band.pointed(units))
        far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        needed = far[np.arange(len(asking))[:, None, None], lists[closest]].min(axis=2)
        found.append(float(np.quantile(needed, target)) * (1 + 1e-6))
    return max(found)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """The rows that take part: id and vec, as arrays of doubles of one length; the length (dim, if given; 0: no rows)."""
    vec = F.col(vector_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(good, F.lit(False)))
    if dim is None:
        length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = length["n"] if length else 0
    return rows.filter(F.size("vec") == dim), dim


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """One row a distinct vector: vec, ids (its keep smallest). Each task sends at most keep ids of a vector, and vectors move once."""
    order = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("order", order).filter(F.col("order") <= keep)
    return few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponent of the band of each row, and its norm times 2 ** -exponent; whatever the size of its components."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    scaled = np.ldexp(x, -exponent[:, None])
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    more = np.floor(np.log2(norm) + 0.5).astype(np.int32)
    return (exponent + more).astype(np.int32), np.ldexp(norm, -more)


def _with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            exponent, norm = _norms(_matrix(batch["vec"]))
            yield pa.record_batch([*batch.columns, pa.array(exponent), pa.array(norm)], names=[*batch.schema.names, "exponent", "norm"])


class Index(NamedTuple):
    entries: DataFrame  # eid, vec, ids, exponent, norm
    postings: DataFrame  # shard, lists, eid, least (id), vec
    bands: list[Band]
    sizes: np.ndarray  # of the lists
    dim: int
    k: int


def _shards(rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, shard and lists, one for each row and shard."""
    order = np.lexsort((lists, rows))
    rows, lists = rows[order].astype(np.int64), lists[order].astype(np.int64)
    shard = lists // SHARD
    new = np.append(True, (rows[1:] != rows[:-1]) | (shard[1:] != shard[:-1])) if len(rows) else np.empty(0, bool)
    return rows[new], shard[new].astype(np.int32), _nested(np.cumsum(new) - 1, lists.astype(np.int32), int(new.sum()))


def build_index(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> Index | None:
    """None without a vector that takes part."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return None
    entries = _distinct(rows, k + 1).select(F.monotonically_increasing_id().alias("eid"), "vec", "ids")
    entries = common.stored(entries.mapInArrow(_with_norms, "eid long, vec array<double>, ids array<long>, exponent int, norm double"), "vectors")
    facts = sorted(entries.groupBy("exponent").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect())  # at most one row an exponent of a double
    n = sum(f["n"] for f in facts)

    # a sample to fit the lists to, and another one to measure the ratio on
    wanted = {f["exponent"]: max(1, min(f["n"] // LIST, MAX_LISTS * f["n"] // n)) for f in facts}
    budget = min(1.0, SAMPLE_NUMBERS // dim / max(1, sum(wanted.values()) * PER_LIST))
    shares = []
    for f in facts:
        lists = wanted[f["exponent"]]
        fit = 0 if lists == 1 else max(1, int(min(0.75, lists * PER_LIST * budget / f["n"]) * _PLACES))
        held = 0 if lists <= FEW_LISTS else max(1, int(min(0.25, HELD / f["n"]) * _PLACES))
        shares.append((f["exponent"], fit, _PLACES - held))
    place = F.pmod(F.xxhash64("vec"), F.lit(_PLACES))
    chosen = entries.join(F.broadcast(spark.createDataFrame(shares, "exponent int, fit long, held long")), "exponent").withColumn("place", place).filter((F.col("place") < F.col("fit")) | (F.col("place") >= F.col("held")))
    sample = chosen.select("exponent", "place", (F.col("place") < F.col("fit")).alias("fits"), "vec").orderBy("exponent", "place", "vec").drop("place").toArrow()  # SAMPLE_NUMBERS components and HELD vectors a band at most, about
    of, fits, x = sample["exponent"].to_numpy(), sample["fits"].to_numpy(), _matrix(sample["vec"])
    bands: list[Band] = []
    for f in facts:
        own = of == f["exponent"]
        fitted, held = x[own & fits], x[own & ~fits]
        lists = max(1, min(wanted[f["exponent"]], len(fitted) // 2))
        band = Band(f["exponent"], bands[-1].first + bands[-1].lists if bands else 0, lists, f["norm"] * (1 + 1e-12), None, np.inf)
        if lists > 1:
            band = band._replace(centroids=Centroids(bisect(band.raised(fitted), lists)))
            band = band._replace(ratio=measured_ratio(band, fitted, held, k, f["n"], target))
        bands.append(band)
    shared = spark.sparkContext.broadcast({b.exponent: b for b in bands})  # at most MAX_LISTS centroids and one a band

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = _matrix(batch["vec"]), batch["exponent"].to_numpy()
            rows, lists = [], []
            for exponent in np.unique(of):
                band, own = shared.value[int(exponent)], (of == exponent).nonzero()[0]
                if band.lists == 1:
                    rows.append(own)
                    lists.append(np.full(len(own), band.first))
                    continue
                ids, d = band.centroids.search(band.raised(x[own]), REPLICAS, REPLICA_RATIO)
                row, at = (np.isfinite(d) & (d <= d[:, :1] * REPLICA_RATIO)).nonzero()
                rows.append(own[row])
                lists.append(band.first + ids[row, at])
            row, shard, own_lists = _shards(np.concatenate(rows), np.concatenate(lists))
            at = pa.array(row)
            yield pa.record_batch([pa.array(shard), own_lists, *(batch[c].take(at) for c in ("eid", "least", "vec"))], names=["shard", "lists", "eid", "least", "vec"])

    postings = entries.select("eid", F.col("ids")[0].alias("least"), "vec", "exponent").mapInArrow(assign, "shard int, lists array<int>, eid long, least long, vec array<double>")
    postings = common.stored(postings, "postings")
    sizes = np.zeros(bands[-1].first + bands[-1].lists, np.int64)
    for r in postings.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    return Index(entries, postings, bands, sizes, dim, k)


def choose_lists(index: Index, queries: DataFrame, ratio: float | None = None) -> DataFrame:
    """queries: qid, vec. One row a query and shard that it reads: shard, lists, qid, vec. ratio: instead of the measured ones."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((index.bands, index.sizes))
    enough = REPLICAS * (index.k + 1)  # rows of lists that hold k + 1 different entries in any case

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sizes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_matrix(batch["vec"]))
            rows, lists = [], []
            for band in bands:
                own = sizes[band.first : band.first + band.lists]
                within = band.ratio if ratio is None else ratio
                if band.lists <= FEW_LISTS or not np.isfinite(within):
                    rows.append(np.repeat(np.arange(len(units)), band.lists))
                    lists.append(np.tile(np.arange(band.first, band.first + band.lists), len(units)))
                    continue
                q = band.pointed(units)
                chosen = np.isfinite(band.centroids.within(q, within))
                least = min(enough, own.sum())
                for short in ((chosen * own).sum(axis=1) < least).nonzero()[0]:  # further lists, by distance
                    order = np.argsort(band.centroids.distances(q[[short]])[0], kind="stable")
                    chosen[short, order[: int(np.searchsorted(np.cumsum(own[order]), least)) + 1]] = True
                row, at = (chosen & (own > 0)).nonzero()
                rows.append(row)
                lists.append(band.first + at)
            row, shard, own_lists = _shards(np.concatenate(rows), np.concatenate(lists))
            at = pa.array(row)
            yield pa.record_batch([pa.array(shard), own_lists, batch["qid"].take(at), batch["vec"].take(at)], names=["shard", "lists", "qid", "vec"])

    spread = queries.select("qid", "vec").repartition(common.shuffle_partitions(spark))
    return common.stored(spread.mapInArrow(choose, "shard int, lists array<int>, qid long, vec array<double>"), "chosen")


def _top(q: np.ndarray, e: np.ndarray, least: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """The places of the most best of each q, by q, then score, then least."""
    order = np.lexsort((least, -score, q))
    q = q[order]
    first = np.append(True, q[1:] != q[:-1]).nonzero()[0] if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < most]


def _compare(most: int):
    """Vectors and queries of one shard, list by list, to the most best entries of each query: qid, eid, least, score."""

    def run(vs: pa.Table, qs: pa.Table) -> pa.Table:
        parts = []
        if vs.num_rows and qs.num_rows:
            v, q = _matrix(vs["vec"]), _matrix(qs["vec"])
            least = vs["least"].to_numpy()
            scale = 1e-9 * np.sqrt((v * v).sum(axis=1)).max() * np.sqrt((q * q).sum(axis=1))
            v_row, v_list = _unnested(vs["lists"])
            q_row, q_list = _unnested(qs["lists"])
            members = {x: v_row[v_list == x] for x in np.unique(v_list)}
            for at in range(0, len(q), CHUNK):
                part = (q_row >= at) & (q_row < at + CHUNK)
                own_row, own_list = q_row[part] - at, q_list[part]
                s = np.full((min(CHUNK, len(q) - at), len(v)), -np.inf)
                for x in np.unique(own_list):
                    if x in members:
                        a, b = own_row[own_list == x], members[x]
                        s[a[:, None], b] = q[a + at] @ v[b].T  # a vector of two lists has one place
                bound = np.partition(s, -most, axis=1)[:, -most] if s.shape[1] > most else np.full(len(s), -np.inf)
                qi, vi = ((s >= (bound - scale[at : at + CHUNK])[:, None]) & np.isfinite(s)).nonzero()
                exact = np.einsum("ij,ij->i", q[qi + at], v[vi])
                top = _top(qi, vi, least[vi], exact, most)
                parts.append((qi[top] + at, vi[top], exact[top]))
        qi, vi, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        n = np.unique(qi)
        at = np.searchsorted(n, qi)
        lists = [_nested(at, x, len(n)) for x in (vs["eid"].to_numpy()[vi], vs["least"].to_numpy()[vi], score)] if len(qi) else [pa.array([], pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.float64())]
        return pa.table([pa.array(qs["qid"].to_numpy()[n].astype(np.int64)), *lists], names=["qid", "eid", "least", "score"])

    return run


def _merge(most: int):
    """The entries that shards found for some queries: the most best of each, once."""

    def run(rows: pa.Table) -> pa.Table:
        row, e = _unnested(rows["eid"])
        q, least, score = rows["qid"].to_numpy()[row], _unnested(rows["least"])[1], _unnested(rows["score"])[1]
        order = np.lexsort((e, q))
        same = np.append(False, (q[order][1:] == q[order][:-1]) & (e[order][1:] == e[order][:-1])) if len(q) else np.empty(0, bool)
        once = order[~same]
        top = once[_top(q[once], e[once], least[once], score[once], most)]
        return pa.table([pa.array(q[top]), pa.array(e[top]), pa.array(score[top])], names=["qid", "eid", "score"])

    return run


def products(index: Index, chosen: DataFrame) -> int:
    """Inner products that the chosen lists take."""
    asked = chosen.select(F.explode("lists").alias("list")).groupBy("list").count().collect()  # a row a list
    return int(sum(r["count"] * int(index.sizes[r["list"]]) for r in asked))


def _ranked(index: Index, queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """queries: qid. One row a query with the entries found: qid, best (the k + 1 best of struct<less, id>)."""
    spark, k = queries.sparkSession, index.k
    rows_of = {r["shard"]: r["count"] for r in index.postings.groupBy("shard").count().collect()}  # a row a shard
    asked_of = {r["shard"]: r["count"] for r in chosen.groupBy("shard").count().collect()}
    parts = [(s, -(-n // SEGMENT), max(1, -(-asked_of.get(s, 0) // BLOCK))) for s, n in rows_of.items()]
    split = lambda: F.broadcast(spark.createDataFrame(parts, "shard int, segments int, blocks int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.postings.join(split(), "shard").withColumn("segment", F.pmod(F.xxhash64("eid"), F.col("segments")).cast("int")).withColumn("block", upto("blocks"))
    right = chosen.join(split(), "shard").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("segment", upto("segments"))
    keys = ("shard", "segment", "block")
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(k + 1), "qid long, eid array<long>, least array<long>, score array<double>")
    # what one query gets: k + 1 entries from each segment of each shard at most
    buckets = max(1, -(-sum(asked_of.get(s, 0) * n for s, n, _ in parts) * (k + 1) // MERGED))
    merged = compared.withColumn("bucket", F.pmod(F.xxhash64("qid"), F.lit(max(buckets, common.shuffle_partitions(spark))))).groupBy("bucket").applyInArrow(_merge(k + 1), "qid long, eid long, score double")
    by_id = F.flatten(F.transform("best", lambda b: F.transform(b.ids, lambda i: F.struct(b.less.alias("less"), i.alias("id")))))
    named = merged.join(index.entries.select("eid", "ids"), "eid")
    return named.groupBy("qid").agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "ids")).alias("best")).select("qid", F.slice(F.array_sort(by_id), 1, k + 1).alias("best"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_ratio: float | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found among the vectors of other ids.

    query_ratio: of the distances of a query's lists, instead of the one measured for the share target of neighbours.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, k, id_col, vector_col, target)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries, id_col, vector_col, index.dim)[0].distinct()
    distinct = common.stored(asked.groupBy("vec").agg(F.count("*").alias("n_same")).select(F.monotonically_increasing_id().alias("qid"), "vec", "n_same"), "queries")
    ranked = _ranked(index, distinct, choose_lists(index, distinct, query_ratio))
    found = common.stored(distinct.join(ranked, "qid").drop("qid"), "found")
    answers = common.skew_safe_join(asked, found, "vec", "n_same", asked.count(), "inner")
    own = F.slice(F.filter("best", lambda b: b.id != F.col("id")), 1, k)
    each = answers.select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op1_ann": op1_ann}
