"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .tokens import U64, grams, mix, words

#: Edits (words inserted, deleted or replaced) allowed, as a share of the item's words.
RATE = 0.2
#: Chance with which a window at the edit bound is to be found; the number of walks follows from it.
RECALL = 0.95
#: Keys of each walk, and sampled positions of each key.
SAMPLES, PICK = 4, 3
#: Items broadcast at a time, in words (about 40 bytes each); a larger benchmark goes through in several passes.
SHARD_WORDS = 2_000_000
#: Items of fewer words match only a document that consists of them.
SHORT = 4


@dataclass
class Items:
    """A part of the benchmark, as it goes to every executor."""

    ids: np.ndarray
    words: list[np.ndarray]
    bound: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  #: by length: hashes, item, offset, filter
    sizes: np.ndarray  #: distinct item lengths
    keys: dict[int, tuple[np.ndarray, np.ndarray]]  #: by length: sorted LSH keys, item
    walks: int  #: 0: every place that can match is verified, without LSH
    short: dict[bytes, list[int]]  #: by their word hashes: ids of the items of few words


def edit_bound(n: int, rate: float) -> int:
    return int(n * rate)


def cgk(seqs: np.ndarray, walks: int) -> np.ndarray:
    """CGK embeddings of word-hash sequences (m rows of equal length n): (3n, m, walks) symbols.

    At each step a walk writes the symbol under its pointer, which moves on or stays by a random
    bit of (walk, step, symbol); behind the end it writes 0. Sequences that agree again after an
    edit tend to fall into step, so the Hamming distance follows the edit distance.
    """
    m, n = seqs.shape
    flat = np.concatenate([seqs, np.zeros((m, 1), dtype=U64)], 1).ravel()
    base = (np.arange(m) * (n + 1))[:, None]
    at = np.broadcast_to(base, (m, walks)).copy()
    coins = np.random.default_rng(n).integers(0, 2**63, (3 * n, walks), dtype=U64) * U64(2) + U64(1)
    out = np.empty((3 * n, m, walks), dtype=U64)
    for j in range(3 * n):
        symbol = out[j] = flat[at]
        at += ((symbol * coins[j]) >> U64(63)).astype(np.int64)
        np.minimum(at, base + n, out=at)
    return out


def lsh_keys(seqs: np.ndarray, walks: int) -> np.ndarray:
    """(m, walks * SAMPLES) keys: each the hash of PICK sampled positions of one walk's embedding.

    Positions come from the first two thirds, which a walk has usually filled.
    """
    m, n = seqs.shape
    e = cgk(seqs, walks)
    rng = np.random.default_rng([n, 1])
    out = np.empty((m, SAMPLES, walks), dtype=U64)
    lane = np.arange(1, walks + 1, dtype=U64) * U64(0x2545F4914F6CDD1D)
    for s in range(SAMPLES):
        k = np.broadcast_to(lane * U64(s + 1), (m, walks))
        for p in np.sort(rng.choice(2 * n, min(PICK, 2 * n), replace=False)):
            k = mix(k * U64(0x9E3779B97F4A7C15) + e[p])
        out[:, s] = k
    return out.reshape(m, -1)


@cache
def walks_for(recall: float, rate: float) -> int:
    """The least number of walks that finds a window at the edit bound with the given chance.

    By simulation: random items of 40 words and copies of them with as many random edits as the
    bound allows. For each pair the share of its walks that meet in a key is its chance a walk.
    """
    rng, n, pairs, most = np.random.default_rng(5), 40, 200, 96
    one = rng.integers(1, 2**62, (pairs, n), dtype=np.int64).astype(U64)
    two = np.zeros_like(one)
    for i, row in enumerate(one.tolist()):
        for _ in range(edit_bound(n, rate)):
            at = int(rng.integers(len(row)))
            new = int(rng.integers(1, 2**62))
            (row.pop, lambda p: row.insert(p, new), lambda p: row.__setitem__(p, new))[rng.integers(3)](at)  # noqa: B023
        two[i, : min(n, len(row))] = row[:n]
    met = (lsh_keys(one, most) == lsh_keys(two, most)).reshape(pairs, SAMPLES, most).any(1).sum(1)
    miss = 1 - (met + 0.5) / (most + 1)
    walks = 1
    while walks < 1000 and (1 - miss**walks).mean() < recall:
        walks += 1
    return walks


def edits_within(item: np.ndarray, region: np.ndarray, bound: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``region`` nearest to ``item``, if within ``bound``.

    Of equally near parts it is the one that ends first, then the shortest.
    """
    n = len(region)
    cost = np.zeros(n + 1, dtype=np.int64)
    start = np.arange(n + 1)
    step = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        diagonal = cost[:-1] + (region != w)
        up = cost[1:] + 1
        take = diagonal <= up
        best = np.concatenate(([i], np.where(take, diagonal, up)))
        origin = np.concatenate(([0], np.where(take, start[:-1], start[1:])))
        # insertions run along the row: a running minimum of cost - column
        low = np.minimum.accumulate(best - step)
        came = np.maximum.accumulate(np.where(best - step == low, step, 0))
        cost, start = low + step, origin[came]
    end = int(np.lexsort((-start, np.arange(n + 1), cost))[0])
    return (int(cost[end]), int(start[end]), end) if cost[end] <= bound else None


def prepare(ids: list[int], texts: list[str], rate: float, recall: float = RECALL) -> Items:
    seqs = []
    for w in words(pa.array(texts, pa.string())):
        b = w.row_bounds()
        seqs += [w.hash[b[i] : b[i + 1]].copy() for i in range(w.last - w.first)]
    keep = [i for i, s in enumerate(seqs) if len(s) >= SHORT]
    short: dict[bytes, list[int]] = {}
    for i, x in enumerate(seqs):
        if 0 < len(x) < SHORT:
            short.setdefault(x.tobytes(), []).append(ids[i])
    walks = walks_for(recall, rate) if recall < 1 else 0
    ids_, seqs = np.array([ids[i] for i in keep], dtype=np.int64), [seqs[i] for i in keep]
    bound = np.array([edit_bound(len(s), rate) for s in seqs], dtype=np.int64)
    found: dict[int, list] = {}
    for i, s in enumerate(seqs):
        q = len(s) // (int(bound[i]) + 1)
        g = grams(s, q)
        for p in range(int(bound[i]) + 1):
            found.setdefault(q, []).append((int(g[p * q]), i, p * q))
    pieces = {}
    for q, x in found.items():
        x.sort()
        h = np.array([r[0] for r in x], dtype=U64)
        bits = np.zeros(1 << 22, dtype=bool)
        bits[(h >> U64(42)).astype(np.int64)] = True
        pieces[q] = (h, np.array([r[1] for r in x]), np.array([r[2] for r in x]), bits)
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    keys = {}
    for n in np.unique(lengths) if walks else ():
        own = np.flatnonzero(lengths == n)
        k = lsh_keys(np.stack([seqs[i] for i in own]), walks)
        flat, item = k.ravel(), np.repeat(own, k.shape[1])
        o = np.argsort(flat, kind="stable")
        keys[int(n)] = (flat[o], item[o])
    return Items(ids_, seqs, bound, pieces, np.unique(lengths), keys, walks, short)


def _lookup(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, index into sorted_) of all equal pairs."""
    lo, hi = np.searchsorted(sorted_, x, "left"), np.searchsorted(sorted_, x, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(x)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _share_words(items: Items, hit: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of hits (start, item, row): those with all but at most b of the item's distinct words about them."""
    keep = np.zeros(len(hit), dtype=bool)
    order = np.argsort(hit[:, 1], kind="stable")
    cuts = np.flatnonzero(np.diff(hit[order, 1])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        k = int(hit[own[0], 1])
        item, b = np.unique(items.words[k]), int(items.bound[k])
        width = len(items.words[k]) + 2 * b
        for part in np.array_split(own, -(-len(own) * width // 1_000_000)):
            at = hit[part, 0][:, None] - b + np.arange(width)
            inside = (at >= 0) & (at < len(h))
            at = np.where(inside, at, 0)
            inside &= row[at] == hit[part, 2][:, None]
            spot = np.minimum(np.searchsorted(item, h[at]), len(item) - 1)
            r, c = np.nonzero(inside & (item[spot] == h[at]))
            seen = np.zeros((len(part), len(item)), dtype=bool)
            seen[r, spot[r, c]] = True
            keep[part] = seen.sum(1) >= len(item) - b
    return keep


def places(items: Items, h: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
    """(start, item, row) of all places where an item can be within its bound; a start may be off by b, and before the row.

    An item within b edits of a part of a row leaves one of its b + 1 pieces whole in it, at most b words
    from its place. So places are those of an occurrence of a piece, in surroundings that hold
    all but at most b of the item's distinct words; no other can match.
    """
    for q, (hashes, item, offset, bits) in items.pieces.items():
        g = grams(h, q)
        at = np.flatnonzero(bits[(g >> U64(42)).astype(np.int64)])
        at = at[row[at] == row[at + q - 1]]
        i, j = _lookup(hashes, g[at])
        if not len(i):
            continue
        hit = np.unique(np.stack([at[i] - offset[j], item[j], row[at[i]]], 1), axis=0)
        hit = hit[_share_words(items, hit, h, row)]
        if len(hit):
            yield hit


def windows(items: Items, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the item-sized windows that can be within the bound of some item: those about its ``places``."""
    out = []
    lengths = np.array([len(s) for s in items.words], dtype=np.int64)
    for hit in places(items, h, row):
        start, n, b = hit[:, 0], lengths[hit[:, 1]], items.bound[hit[:, 1]]
        shift = 2 * b + 1
        k = np.repeat(np.arange(len(start)), shift)
        s = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(shift) - shift, shift) - b[k]
        out.append(np.unique(np.stack([s, n[k], hit[k, 2]], 1), axis=0))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = np.unique(np.concatenate(out), axis=0)
    # a window that reaches over its document's ends begins or ends there; a short document is one window
    lo, hi = np.searchsorted(row, w[:, 2]), np.searchsorted(row, w[:, 2], "right")
    s = np.clip(w[:, 0], lo, np.maximum(hi - w[:, 1], lo))
    w = np.unique(np.stack([s, w[:, 1]], 1), axis=0)
    return w[:, 0], w[:, 1]


@dataclass
class Candidates:
    """Windows of a batch, by length, and the word hashes of the rows they are in."""

    texts: dict[int, np.ndarray]
    found: dict[int, list[tuple[int, int]]]  #: by length: (row, first word)
    pairs: set[tuple[int, int, int]] = field(default_factory=set)  #: (row, first word, item) to verify, without walks


def gather(items: Items, h: np.ndarray, row: np.ndarray, first: int, into: Candidates) -> None:
    """Adds the windows of some rows, numbered from ``first``, or their places if there are no walks."""
    if not items.walks:
        for hit in places(items, h, row):
            lo, hi = np.searchsorted(row, hit[:, 2]), np.searchsorted(row, hit[:, 2], "right")
            for s, i, r, a, b in zip(*hit.T.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if first + r not in into.texts:
                    into.texts[first + r] = h[a:b].copy()
                into.pairs.add((first + r, max(0, s - a), i))
        return
    start, length = windows(items, h, row)
    if not len(start):
        return
    owner = row[start]
    lo, hi = np.searchsorted(row, owner), np.searchsorted(row, owner, "right")
    for s, n, r, a, b in zip(start.tolist(), length.tolist(), owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if first + r not in into.texts:
            into.texts[first + r] = h[a:b].copy()
        into.found.setdefault(n, []).append((first + r, s - a))


def find(items: Items, c: Candidates) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, words) of every item found in each row."""
    pairs = set(c.pairs)
    for n, spots in c.found.items():
        for k in range(0, len(spots), 2048):
            part = spots[k : k + 2048]
            seqs = np.zeros((len(part), n), dtype=U64)
            for j, (r, s) in enumerate(part):
                x = c.texts[r][s : s + n]
                seqs[j, : len(x)] = x
            keys = lsh_keys(seqs, items.walks)
            sorted_, item = items.keys[n]
            i, j = _lookup(sorted_, keys.ravel())
            pairs.update((*part[w], t) for w, t in zip((i // keys.shape[1]).tolist(), item[j].tolist(), strict=True))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    covered: dict[tuple[int, int], int] = {}
    for r, s, i in sorted(pairs):
        x, words_ = c.texts[r], items.words[i]
        if np.array_equal(x[s : s + len(words_)], words_):
            best[r, i] = min(best.get((r, i), (1, 0, 0)), (0, s, len(words_)))
    for r, s, i in sorted(pairs):
        x, words_, b = c.texts[r], items.words[i], int(items.bound[i])
        if s < covered.get((r, i), -1) or best.get((r, i), (1,))[0] == 0:
            continue  # the last region held this window, or the item stands there as it is
        lo = max(0, s - b)
        got = edits_within(words_, x[lo : s + len(words_) + 2 * b], b)
        covered[r, i] = s + b + 1
        if got:
            e, a, z = got
            best[r, i] = min(best.get((r, i), (e, lo + a, z - a)), (e, lo + a, z - a))
    return [(r, i, *v) for (r, i), v in best.items()]


def _search(shared, schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            c = Candidates({}, {})
            got = []
            for w in words(b.column(1)):
                gather(items, w.hash, w.row - w.first, w.first, c)
                if items.short:
                    first = w.row_bounds()
                    for r in np.flatnonzero((np.diff(first) < SHORT) & (np.diff(first) > 0)).tolist():
                        own = w.hash[first[r] : first[r + 1]]
                        got += [(w.first + r, i, 0, 0, len(own)) for i in items.short.get(own.tobytes(), ())]
            got += [(r, int(items.ids[i]), *rest) for r, i, *rest in find(items, c)]
            if got:
                rows, which, edits, start, n = (np.array(x, dtype=np.int64) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(which), pa.array(edits), pa.array(start), pa.array(n)], ["doc_id", "item_id", "edits", "start_word", "n_words"])

    return search


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [k for w in words(b.column(1)) for k in np.diff(w.row_bounds()).tolist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["item_id", "text", "n"])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, edits, start_word, n_words): each benchmark item found in a document.

    An item is found where a part of the document is within rate x its words of it, in words
    inserted, deleted or replaced; words are compared without case and punctuation. The nearest
    part is given, the first of equally near ones. A part at the bound is found with a chance of
    ``recall`` at least, from which the number of CGK walks follows; nearer ones more surely, and
    exact copies always. With a ``recall`` of 1 there are no walks: every place that an exact test
    leaves is verified, and nothing within the bound is missed. Items of fewer than 4 words, which stand in any text by chance, are found
    in documents that consist of nothing else.

    Null or wordless items and documents match nothing. Very long texts are searched whole, items
    of any length too. Rows with a null doc_id or item_id are left out; of repeated rows, or texts
    of one doc_id, the best match stays. Items with equal texts or ids are each found. Other columns
    may have any name. An empty table on either side gives no rows.

    Items go to the executors in shards of at most one and a half times ``shard_words`` words, as
    counted, or of a single item; there is one pass over the documents for each shard, so a
    benchmark of up to two million words takes one.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    scratch = Scratch(spark)
    items = scratch.write(items.mapInArrow(_count, "item_id long, text string, n long"))
    have = items.agg(F.sum("n").alias("n"), F.count("*").alias("items")).first()
    shards = max(1, -(-(have.n or 0) // shard_words))
    shard = lambda k: F.pmod(F.xxhash64("item_id", "text"), F.lit(k))
    while shards < have.items and items.groupBy(shard(shards).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("m")).where((F.col("m") > 1) & (F.col("n") > 1.5 * shard_words)).limit(1).count():
        shards *= 2
    schema = "doc_id long, item_id long, edits long, start_word long, n_words long"
    out = None
    for k in range(shards):
        rows = items.where(shard(shards) == k).orderBy("item_id", "text").collect()
        if not rows and k:
            continue
        shared = spark.sparkContext.broadcast(prepare([r.item_id for r in rows], [r.text for r in rows], rate, recall))
        found = slim.mapInArrow(_search(shared, schema), schema)
        out = found if out is None else out.unionByName(found)
    scratch.drop(items)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "n_words")).alias("m")).select("doc_id", "item_id", "m.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item is found; the others as they are.

    Rows with a null doc_id, and null or wordless texts, stay; every row of a found doc_id goes.
    Other columns may have any name. An empty table stays empty.
    """
    name = fresh(docs, "found")[0]
    found = Scratch(spark).write(contaminated(spark, docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(found, docs["doc_id"].cast("long") == found[name], "left_anti")
