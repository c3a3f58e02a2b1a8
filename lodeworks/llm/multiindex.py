"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

K = 10
#: Centroids of each half, rounds of Lloyd's algorithm, and the share of all vectors that a query
#: reranks. Half of the test vectors have no structure, so their neighbours are hardly nearer than
#: anything else: it takes this share for a recall of over 0.9 (see the README).
CENTROIDS, ROUNDS, SHARE = 32, 8, 0.5
#: Vectors of one shard of the index, which a task holds in memory.
SHARD = 50_000


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one float vector an id, of the commonest dimension (the least of equally common ones)."""
    v = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.size("v") > 1)
    dim = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).select("n")
    return rows.join(F.broadcast(dim), F.size("v") == F.col("n"), "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codebooks(spark: SparkSession, rows: DataFrame, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """k centroids of each vector half, by Lloyd's algorithm over all vectors."""
    start = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()]
    x = np.array(start, dtype=np.float32)
    d = x.shape[1] // 2
    books = [x[:, :d].copy(), x[:, d:].copy()]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=tuple(books)) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(c), c.shape[1])) for c in books]
            count = [np.zeros(len(c), dtype=np.int64) for c in books]
            for b in batches:
                x = _matrix(b.column(0))
                for h, part in enumerate((x[:, :d], x[:, d:])):
                    near = distances(part, books[h]).argmin(1)
                    np.add.at(total[h], near, part)
                    count[h] += np.bincount(near, minlength=len(books[h]))
            out = [{"half": h, "c": c, "n": int(count[h][c]), "s": total[h][c].tolist()} for h in (0, 1) for c in np.flatnonzero(count[h]).tolist()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("half", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

        def add(t: pa.Table) -> pa.Table:
            s = np.array(t["s"].to_pylist()).sum(0)
            return pa.table({"half": t["half"][:1], "c": t["c"][:1], "n": pa.array([sum(t["n"].to_pylist())]), "s": pa.array([s.tolist()], pa.list_(pa.float64()))})

        schema = "half int, c int, n long, s array<double>"
        for r in rows.select("v").mapInArrow(sums, schema).groupBy("half", "c").applyInArrow(add, schema).collect():
            books[r.half][r.c] = np.array(r.s) / r.n
    return books[0], books[1]


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells by summed half distances, until they hold ``wanted`` vectors (multi-sequence search).

    The heap holds the pairs whose predecessors in both orders have been taken.
    """
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = np.sort(d1).tolist(), np.sort(d2).tolist()
    n1, n2 = len(o1), len(o2)
    heap = [(s1[0] + s2[0], 0, 0)]
    reached = [0] * n1  #: of each first half, how many second halves were taken
    out: list[int] = []
    got = 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * n2 + o2[j]
        out.append(cell)
        got += sizes[cell]
        reached[i] = j + 1
        if i + 1 < n1 and reached[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < n2 and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


_PLACED = "vec_id long, cell int, v array<float>, asks boolean"
_ROWS = "shard int, kind byte, vec_id long, cell int, v array<float>, probes binary"


def _assign(books):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = books[0].shape[1]
        for b in batches:
            x = _matrix(b.column(1))
            cell = distances(x[:, :d], books[0]).argmin(1) * len(books[1]) + distances(x[:, d:], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), b.column(1), b.column(2)], ["vec_id", "cell", "v", "asks"])

    return assign


def _probe(books, sizes: list[int], shard_of: np.ndarray, wanted: int):
    """Each vector as an entry of its shard, and those that ask to each shard that holds a probed cell."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = books[0].shape[1]
        columns = ["shard", "kind", "vec_id", "cell", "v", "probes"]
        for b in batches:
            n = b.num_rows
            nothing = pa.array([b""] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of[b.column("cell").to_numpy()].astype(np.int32)), pa.array(np.zeros(n, np.int8)), b.column("vec_id"), b.column("cell"), b.column("v"), nothing], columns)
            b = b.filter(b.column("asks"))
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b.column("v"))
            masks = np.zeros((n, len(shard_of)), dtype=np.uint8)
            d1, d2 = distances(x[:, :d], books[0]), distances(x[:, d:], books[1])
            for i in range(n):
                masks[i, traverse(d1[i], d2[i], sizes, wanted)] = 1
            packed = np.packbits(masks, axis=1)
            probes = pa.array([r.tobytes() for r in packed], pa.binary())
            for s in np.unique(shard_of):
                at = pa.array(np.flatnonzero(masks[:, shard_of == s].any(1)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(np.ones(len(at), np.int8)), b.column("vec_id").take(at), b.column("cell").take(at), b.column("v").take(at), probes.take(at)], columns)

    return probe


def _rerank(k: int, cells: int):
    """Streams a shard: its entries come first and stay, queries go by."""

    def near(ids, entries, cell, q_ids, q, probes):
        mask = np.unpackbits(np.frombuffer(b"".join(probes), dtype=np.uint8).reshape(len(q_ids), -1), axis=1)[:, :cells].astype(bool)
        norm = (entries * entries).sum(1)
        # how far float32 can be off, twice over
        slack = 4 * entries.shape[1] * np.finfo(np.float32).eps * (norm.max() + 2 * np.sqrt((q * q).sum(1) * norm.max()))
        for a in range(0, len(q_ids), 256):
            part = q[a : a + 256]
            d = norm - 2 * part @ entries.T
            d[~mask[a : a + 256][:, cell]] = np.inf
            # the query itself may be among them; whatever can't be told from the last one by float32 is compared exactly
            top = min(k + 1, len(ids))
            last = np.partition(d, top - 1, axis=1)[:, top - 1]
            close = (d <= (last + slack[a : a + 256])[:, None]) & np.isfinite(d)
            ends = np.cumsum(close.sum(1))
            at = 0
            while at < len(part):  # some queries at a time, as equal vectors may be many
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, "right")))
                yield exactly(ids, entries, q_ids[a + at : a + to], part[at:to], close[at:to])
                at = to

    def exactly(ids, entries, own, q, close):
        r, e = np.nonzero(close)
        other = ids[e] != own[r]
        r, e = r[other], e[other]
        exact = np.sqrt(((q[r].astype(np.float64) - entries[e]) ** 2).sum(1))
        order = np.lexsort((ids[e], exact, r))
        r, e, exact = r[order], e[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pa.RecordBatch.from_arrays([pa.array(own[r[keep]]), pa.array(ids[e[keep]]), pa.array(exact[keep])], ["vec_id", "neighbour_id", "distance"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                if shard[i] != now:
                    now, held, index = shard[i], [], None
                if kind[i] == 0:
                    held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v")), part.column("cell").to_numpy()))
                elif held or index:
                    index = index or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    yield from near(*index, part.column("vec_id").to_numpy(), _matrix(part.column("v")), part.column("probes").to_pylist())

    return rerank


def neighbours(spark: SparkSession, vectors: DataFrame, queries: Column | None = None, k: int = K, share: float = SHARE, centroids: int = CENTROIDS, rounds: int = ROUNDS, shard: int = SHARD) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors of every vector that asks.

    ``queries`` is a condition on vec_id; without it every vector asks. All vectors are indexed.

    The two halves of the vectors are quantised separately; their pairs of centroids are the cells
    of the index. A query goes through the cells in order of the summed distances of its halves,
    with a heap, until they hold ``share`` of all vectors, and reranks these by exact Euclidean
    distance. rank counts from 1; equally near neighbours, however many, rank by vec_id.

    Null vectors, those with nulls, NaN or infinities and those not of the commonest dimension are
    left out, as are null ids. Repeated rows of an id are one vector (of several, the least).
    Fewer than k others give fewer rows; an empty table or a single vector gives none. Other columns
    may have any name.
    """
    scratch = Scratch(spark)
    schema = "vec_id long, neighbour_id long, distance double"
    rows = scratch.write(clean(vectors))
    n = rows.count()
    if n < 2:
        found = spark.createDataFrame([], schema)
    else:
        books = codebooks(spark, rows, min(centroids, max(1, math.isqrt(n) // 2)), rounds)
        cells = len(books[0]) * len(books[1])
        asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
        placed = scratch.write(rows.select("vec_id", "v", asks.alias("asks")).mapInArrow(_assign(books), _PLACED))
        scratch.drop(rows)
        sizes = [0] * cells
        for r in placed.groupBy("cell").count().collect():
            sizes[r.cell] = r["count"]
        # cells of a first half stay together; shards hold about as many vectors each
        shard_of = np.minimum(np.cumsum(sizes) // max(1, min(shard, -(-n // max(1, -(-n // shard))))), -(-n // shard) - 1)
        wanted = min(n, max(math.ceil(share * n), 20 * k))
        probed = placed.mapInArrow(_probe(books, sizes, shard_of, wanted), _ROWS)
        found = probed.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_rerank(k, cells), schema)
    best = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("near"))
    return best.select("vec_id", F.posexplode("near").alias("rank", "x")).select("vec_id", (F.col("rank") + 1).alias("rank"), "x.neighbour_id", "x.distance")
