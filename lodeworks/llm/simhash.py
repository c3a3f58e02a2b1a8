"""SimHash near-duplicates, compared 64 at a time on vertically stored bit planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, fresh
from .tokens import U64, Words, mix, words

BITS = 128
RADIUS = 24
#: Below 1, an option only: the chance with which a pair at the radius meets in sampled buckets.
RECALL = 0.9
#: Fingerprints of a pair of tiles up to which all are compared, without blocks.
SMALL = 1 << 16
#: Fingerprints a sampled bucket holds, until a table samples BITS_MOST bits; from then on buckets grow and the
#: number of tables stays. What is over TILE fingerprints is compared as pairs of tiles, one pair a task.
BUCKET, BITS_MOST, TILE = 256, 9, 1 << 18
_SALT = U64(0x5BD1E995ABCDEF01)


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128-bit SimHash over the set of words of each row, as (n, 2) uint64, and the number of words."""
    n = w.last - w.first
    key = np.sort(((w.row - w.first).astype(U64) << U64(44)) | (w.hash >> U64(20)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    row = (key >> U64(44)).astype(np.int64)
    h = mix(key & U64((1 << 44) - 1))
    count = np.bincount(row, minlength=n)
    ones = np.zeros((n, BITS), dtype=np.int64)
    if len(h):
        bits = np.unpackbits(np.stack([h, mix(h ^ _SALT)], 1).view(np.uint8), axis=1).view(U64)
        # bytes add up in 64-bit lanes for at most 255 words at a time, then in full width
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.flatnonzero(rank % 255 == 0)
        part = np.add.reduceat(bits, begin, axis=0).view(np.uint8)
        owner = row[begin]
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ones[owner[head]] = np.add.reduceat(part, head, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(U64), count


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        for w in words(b.column(1)):
            f, count = fingerprints(w)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + w.first)), pa.array(f[some, 0].view(np.int64)), pa.array(f[some, 1].view(np.int64))], ["doc_id", "f0", "f1"])


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _planes(f: np.ndarray) -> np.ndarray:
    """(BITS, words): plane b holds bit b of 64 fingerprints a word."""
    n = len(f)
    planes = np.empty((BITS, -(-n // 64)), dtype=U64)
    for b in range(0, planes.shape[1], 1 << 12):  # some rows at a time, as a row of bits takes 128 bytes
        rows = f[b * 64 : (b + (1 << 12)) * 64]
        bits = np.zeros((BITS, -(-len(rows) // 64) * 64), dtype=np.uint8)
        bits[:, : len(rows)] = np.unpackbits(rows.view(np.uint8).reshape(len(rows), BITS // 8), axis=1).T
        planes[:, b : b + (1 << 12)] = np.packbits(bits, axis=1, bitorder="little").view(U64)
    return planes


def close_pairs(f: np.ndarray, radius: int, tile: int = 1 << 13, split: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of fingerprints (n, 2) within ``radius``; with ``split`` only those with i < split <= j.

    Plane b holds bit b of 64 fingerprints a word. The distances of one fingerprint to a block
    of 64 are kept as vertical counters: sixteen planes go through a carry-save tree, its carry
    moves the counters above 16, and a block leaves as soon as all of its 64 distances are over.
    """
    n = len(f)
    planes = _planes(f)
    last = split or n
    at = 0
    while at < last:
        first = (split or at) // 64
        to = min(last, at + max(1, tile // max(1, planes.shape[1] - first)))
        for i, j in _grid(planes[:, first:], f[at:to], radius):
            i, j = i + at, j + first * 64
            ok = (j >= split) & (j < n) if split else (i < j) & (j < n)
            if ok.any():
                yield i[ok], j[ok]
        at = to


def _grid(planes: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, lane) of all ``rows`` against all lanes of ``planes`` that are within ``radius``; blocks may end in unused lanes."""
    flips = np.where(np.unpackbits(rows.view(np.uint8).reshape(-1, BITS // 8), axis=1).T.astype(bool), ~U64(0), U64(0))
    shape = len(rows), planes.shape[1]
    q = blk = None  # of the blocks left, once some have left
    high = [np.zeros(shape, dtype=U64) for _ in range(max(1, (BITS // 16).bit_length()))]
    o = np.zeros(shape, dtype=U64)
    t, f, e = o.copy(), o.copy(), o.copy()
    alive = o
    for b in range(0, BITS, 16):
        x = [planes[p] ^ flips[p][:, None] if q is None else planes[p][blk] ^ flips[p][q] for p in range(b, b + 16)]
        eights = []
        for half in (0, 8):
            fours = []
            for quarter in (0, 4):
                y = x[half + quarter : half + quarter + 4]
                o, t1 = _csa(o, y[0], y[1])
                o, t2 = _csa(o, y[2], y[3])
                t, f1 = _csa(t, t1, t2)
                fours.append(f1)
            f, e1 = _csa(f, *fours)
            eights.append(e1)
        e, carry = _csa(e, *eights)
        for k, c in enumerate(high):
            high[k], carry = c ^ carry, c & carry
        if b + 16 < 3 * radius and b + 16 < BITS:
            continue  # of 64 distances one would still be within the radius
        alive = _at_most([o, t, f, e, *high], radius)
        if b + 16 < BITS:
            keep = np.flatnonzero(alive)
            if len(keep) == 0:
                return
            if len(keep) < 0.75 * alive.size:
                q, blk = (keep // shape[1], keep % shape[1]) if q is None else (q[keep], blk[keep])
                o, t, f, e = (a.ravel()[keep] for a in (o, t, f, e))
                high = [c.ravel()[keep] for c in high]
    alive = alive.ravel()
    keep = np.flatnonzero(alive)
    if len(keep):
        q, blk = (keep // shape[1], keep % shape[1]) if q is None else (q[keep], blk[keep])
        lanes = np.unpackbits(alive[keep].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, lane = np.nonzero(lanes)
        yield q[r], blk[r] * 64 + lane


def blocks(radius: int) -> list[tuple[np.ndarray, int]]:
    """(bits, t): disjoint blocks of bits; two fingerprints within ``radius`` are within t in one of them at least.

    The t + 1 add up to radius + 1: a pair over t in every block differs in more than ``radius``
    bits. A block of t = 1 is worth two; an odd rest takes one of t = 0. Without any, the radius
    leaves too few bits for each, and all pairs are to be compared.
    """
    one, none = (radius + 1) // 2, (radius + 1) % 2
    rest = 8 * none
    wide = min(10, (BITS - rest) // one) if one else 10
    if wide < 8:
        return []
    bits = np.random.default_rng(20).permutation(BITS)
    out = [(np.sort(bits[rest + k * wide : rest + (k + 1) * wide]), 1) for k in range(one)]
    return out + [(np.sort(bits[:rest]), 0)] * none


def near_pairs(f: np.ndarray, radius: int, part: int = 0, parts: int = 1, split: int = 0, tile: int = 1 << 13, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``close_pairs``, exactly, by comparing only what is near in one of the ``blocks``; pairs may come more than once.

    ``part`` of ``parts`` takes its share of the blocks; every pair comes in one part at least.
    Up to ``small`` fingerprints are all compared, as buckets would be too thin.
    """
    n = len(f)
    found = blocks(radius)
    if n <= small or not found:
        if part == 0:
            yield from close_pairs(f, radius, tile, split)
        return
    rows, columns = np.arange(split or n), np.arange(split, n)
    x = np.unpackbits(f.view(np.uint8).reshape(n, BITS // 8), axis=1)
    for bits, t in found[part::parts]:
        key = (x[:, bits].astype(np.int64) << np.arange(len(bits))).sum(1)
        many = 1 << len(bits)
        row = rows[np.argsort(key[rows], kind="stable")]
        row_end = np.cumsum(np.bincount(key[rows], minlength=many))
        column = columns[np.argsort(key[columns], kind="stable")]
        count = np.bincount(key[columns], minlength=many)
        # the columns of a bucket begin with a block of 64
        width = -(-count // 64)
        begin = np.cumsum(width) - width
        slot = np.full(int(width.sum()) * 64, -1)
        slot[np.arange(len(column)) + np.repeat(begin * 64 - (np.cumsum(count) - count), count)] = column
        planes = np.ascontiguousarray(_planes(np.where((slot >= 0)[:, None], f[slot], U64(0))).T)
        for k in range(many):
            own = row[row_end[k - 1] if k else 0 : row_end[k]]
            others = [k] + [k ^ (1 << b) for b in range(len(bits))] * t
            if not split:  # the pair of buckets is compared once
                others = [o for o in others if o >= k]
            at = np.concatenate([np.arange(begin[o], begin[o] + width[o]) for o in others])
            if not len(own) or not len(at):
                continue
            met, ids = np.ascontiguousarray(planes[at].T), slot.reshape(-1, 64)[at].ravel()
            step = max(1, tile // len(at))
            for a in range(0, len(own), step):
                for i, j in _grid(met, f[own[a : a + step]], radius):
                    i, j = own[a + i], ids[j]
                    ok = (j >= 0) & (i != j)
                    i, j = i[ok], j[ok]
                    if len(i):
                        yield np.minimum(i, j), np.maximum(i, j)


def _at_most(counter: list[np.ndarray], bound: int) -> np.ndarray:
    """Lanes whose vertical counter (lowest bit first) is at most ``bound``."""
    less = np.zeros_like(counter[0])
    same = ~less
    for k in range(len(counter) - 1, -1, -1):
        if bound >> k & 1:
            less |= same & ~counter[k]
            same &= counter[k]
        else:
            same &= ~counter[k]
    return less | same


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; label holds the least index of each component."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link(radius: int, parts: int, small: int):
    """The links of a group; with ``parts`` a bucket is one of so many shares of the blocks, otherwise all of it is compared."""

    def link(t: pa.Table) -> pa.Table:
        f = np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], 1).view(U64)
        ids, side = t["rep"].to_numpy(), t["side"].to_numpy()
        order = np.lexsort((ids, side))
        f, ids, side = np.ascontiguousarray(f[order]), ids[order], side[order]
        split = int(np.searchsorted(side, 1))
        label = np.arange(len(ids))
        if split:  # otherwise all rows are of the second tile, the first being empty
            split = split if split < len(ids) else 0
            for a, b in near_pairs(f, radius, t["bucket"][0].as_py(), parts, split, small=small) if parts else close_pairs(f, radius, split=split):
                merge(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[moved]), "b": pa.array(ids[label[moved]])})

    return link


def plan(n: int, radius: int, recall: float, bucket: int = BUCKET, most: int = BITS_MOST) -> tuple[int, int]:
    """Sampled bits a table, and tables, so that a pair at the radius meets with ``recall`` (below 1).

    Up to ``most`` bits are sampled, so the number of tables is bounded whatever n is.
    """
    bits = min(most, max(0, math.ceil(math.log2(max(1, n) / bucket))))
    if not bits:
        return 0, 1
    meet = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _picks(bits: int, tables: int) -> list[np.ndarray]:
    rng = np.random.default_rng(20)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def _keys(b: pa.RecordBatch, picks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The bucket of each fingerprint of a batch, table by table."""
    f = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
    x = np.unpackbits(f.view(np.uint8).reshape(len(f), BITS // 8), axis=1)
    for pick in picks:
        yield (x[:, pick].astype(np.int64) << np.arange(len(pick), dtype=np.int64)).sum(1)


def _sizes(bits: int, tables: int):
    """(bucket, n): how many fingerprints each bucket gets, all tables one after the other."""
    picks = _picks(bits, tables)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tables << bits, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                for k, key in enumerate(_keys(b, picks)):
                    total[k << bits : (k + 1) << bits] += np.bincount(key, minlength=1 << bits)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return sizes


def _bands(bits: int, tables: int, tiles: np.ndarray):
    """Each fingerprint in its bucket of each table; ``tiles`` says in how many tiles a bucket is cut.

    A pair of tiles is a group; a fingerprint goes to the pairs of its tile. side 1 are the rows of the second tile.
    """
    picks = _picks(bits, tables)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column(2).to_numpy()
            tile = mix(rep.view(U64))
            for k, key in enumerate(_keys(b, picks)):
                bucket = key + (k << bits)
                many = tiles[bucket]
                own = (tile % many.astype(U64)).astype(np.int64)
                row = np.repeat(np.arange(len(rep)), many)
                other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                mine = own[row]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[row]), pa.array(high * (high + 1) // 2 + low), pa.array((mine > other).astype(np.int8)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], ["bucket", "pair", "side", "f0", "f1", "rep"])

    return bands


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, recall: float = 1, bucket: int = BUCKET, bits_most: int = BITS_MOST, tile: int = TILE, small: int = SMALL) -> DataFrame:
    """Groups of documents whose 128-bit SimHashes chain within ``radius``.

    Returns one row for each distinct doc_id that has words: (doc_id, group_id, group_size, kept);
    group_id is the least doc_id of the group, and that document is the one kept. Equal
    fingerprints group exactly, and so do all others within the radius: fingerprints are cut into
    tiles of about ``tile`` by hash, each pair of tiles is a task, and within it bit-sliced
    comparison is confined to fingerprints that agree, but for a bit, in one of the disjoint
    ``blocks`` (by the pigeonhole principle no pair is lost). Few tiles share out the blocks over
    several tasks; up to ``small`` fingerprints are all compared. A fingerprint is shuffled once
    for each tile and each task that shares in the blocks.

    Only with a ``recall`` below 1 are links lost: fingerprints then meet in bit-sampling tables,
    whose number follows from it. Sampled bits grow with the logarithm of the corpus up to
    ``bits_most``, so rows shuffled for a fingerprint are bounded. Buckets of more than ``tile``
    fingerprints are compared as pairs of tiles there.

    Documents with a null or wordless text and rows with a null doc_id are in no group and have
    no row. A doc_id on several rows is one document, in the group of any of its texts. Ties
    don't arise: groups are components, named by their least doc_id. A very long text has one
    fingerprint over all of its words. Only doc_id and text are read, so other columns may have
    any name. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    marks = scratch.write(slim.mapInArrow(_fingerprint_batches, "doc_id long, f0 long, f1 long"))
    distinct = scratch.write(marks.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")))
    n = distinct.count()
    parts = max(1, len(blocks(radius)) // -(-n // tile)) if recall >= 1 and n else 0
    if n <= small:
        parts = min(parts, 1)
    bits, tables = plan(n, radius, recall, bucket, bits_most) if recall < 1 else (0, parts or 1)
    tiles = np.ones(tables << bits, dtype=np.int64)
    # at most tables << bits_most rows
    for r in distinct.mapInArrow(_sizes(bits, tables), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > tile).collect():
        tiles[r.bucket] = -(-r.n // tile)
    met = distinct.mapInArrow(_bands(bits, tables, tiles), "bucket long, pair long, side byte, f0 long, f1 long, rep long")
    links = met.groupBy("bucket", "pair").applyInArrow(_link(radius, parts, small), "a long, b long")
    # a document under several fingerprints ties them together
    ties = marks.join(distinct, ["f0", "f1"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    split = marks.groupBy("doc_id").agg(F.min(F.struct("f0", "f1")).alias("lo"), F.max(F.struct("f0", "f1")).alias("hi")).where("lo <> hi").select("doc_id")
    roots = components(links.union(ties.join(split, ties.a == split.doc_id, "left_semi")), scratch)
    named = marks.join(distinct, ["f0", "f1"]).join(roots, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("group_id"))
    sizes = named.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return named.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; documents in no group all stay.

    Repeated rows of a kept doc_id are reduced to one row: of several texts the least (a null one
    last), of equal texts the row that is least as JSON. Rows with a null doc_id, and null or
    wordless texts, stay. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    gone_id, again_id, n = fresh(docs, "gone", "again", "n")
    found = near_duplicates(spark, docs, **options)
    gone = Scratch(spark).write(found.where("not kept").select(F.col("doc_id").alias(gone_id)))
    left = docs.join(gone, docs["doc_id"].cast("long") == gone[gone_id], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again_id)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(again_id)
    if repeated.isEmpty():
        return left
    again = left.join(repeated, left["doc_id"] == repeated[again_id], "left_semi")
    row = F.struct(*(again[c] for c in docs.columns))
    # an aggregate with partial aggregation: a doc_id may hold any share of the rows
    first = F.min_by(row, F.struct(again["text"].isNull(), again["text"], F.to_json(row)))
    again = again.groupBy(again["doc_id"].alias(again_id)).agg(first.alias(n)).select(f"{n}.*")
    return left.join(repeated, left["doc_id"] == repeated[again_id], "left_anti").unionByName(again)
