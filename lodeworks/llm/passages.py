"""Substring dedup: recurring passages confirmed and located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, sieve
from .tokens import U64, grams, sliding_min, words

#: Words of a phrase, and of the shortest passage that is certain to be found.
PHRASE, PASSAGE = 32, 50
#: Phrases an automaton holds at most, on average over the shards, and documents that one task
#: streams through it.
SHARD_PHRASES, SHARD_DOCS = 10_000, 20_000
#: Rows whose hits are held at a time.
STREAM_ROWS = 256
_POSITION = 28


def winnow(h: np.ndarray, row: np.ndarray, phrase: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, index of their first word) of the least phrase of every window of phrases.

    A run of ``phrase + window - 1`` words that two rows share is such a window in both, so they
    select the same phrase in it.
    """
    g = grams(h, phrase)
    if len(g) < window:
        return g[:0], np.zeros(0, np.int64)
    low = U64((1 << _POSITION) - 1)
    key = (g & ~low) | (np.arange(len(g), dtype=U64) & low)
    least = sliding_min(key, window)
    whole = row[: len(least)] == row[phrase + window - 2 :]
    at = np.unique((least[whole] & low).astype(np.int64))
    return g[at], at


def _select(phrase: int, window: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1)):
                g, at = winnow(w.hash, w.row, phrase, window)
                if len(g):
                    first = w.row_bounds()
                    r = w.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(0).take(pa.array(r)), pa.array((at - first[r - w.first]).astype(np.int32))], ["h", "doc_id", "pos"])

    return select


def _meet(phrase: int, may_hold):
    """(h, doc_id) of every phrase of a document, wherever it stands, that may be one of the shared ones."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1)):
                g = grams(w.hash, phrase).view(np.int64)
                at = np.flatnonzero((w.row[: len(g)] == w.row[phrase - 1 :]) & may_hold(g)) if len(g) else np.zeros(0, np.int64)
                if len(at):
                    h, r = g[at], w.row[at]
                    order = np.lexsort((h, r))
                    h, r = h[order], r[order]
                    once = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
                    yield pa.RecordBatch.from_arrays([pa.array(h[once]), b.column(0).take(pa.array(r[once]))], ["h", "doc_id"])

    return meet


def _ints(h: np.ndarray) -> np.ndarray:
    """Word hashes as the automaton takes them."""
    return (h >> U64(33)).astype(np.int32)


def _letters(seq: bytes) -> tuple[int, ...]:
    """Words as an automaton reads them: two letters each, seven bits and the rest.

    Its nodes are searched child by child, so the root may not have one for every word a phrase begins with. Letters
    of the two kinds differ, so a match begins with a word.
    """
    word = np.frombuffer(seq, dtype=np.int32)
    out = np.empty(2 * len(word), dtype=np.int32)
    out[::2] = word >> 24
    out[1::2] = (word & 0xFFFFFF) + 128
    return tuple(out.tolist())


_ROUTED = "shard long, salt long, kind byte, key long, lead int, seq binary"
_FOUND = "h long, doc_id long, pos int, before int, after int"


def _route(phrase: int, reach: int):
    """Rows for the automata: phrases of the canonical documents with ``reach`` words about them, and each document for each shard it goes to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, phrases = b.column("shards").to_pylist(), b.column("phrases").to_pylist()
            ids = b.column("doc_id").to_pylist()
            out: list[tuple] = []
            size = 0
            for w in words(b.column("text")):
                first = w.row_bounds()
                seq = _ints(w.hash)
                for r in range(w.first, w.last):
                    own = seq[first[r - w.first] : first[r - w.first + 1]]
                    data = own.tobytes()
                    for p in phrases[r] or ():
                        at = p["pos"]
                        # of texts under one doc_id, each gives its phrases; those too short are another text's
                        if at + phrase <= len(own):
                            lead = min(at, reach)
                            some = own[at - lead : at + phrase + reach].tobytes()
                            out += [(p["shard"], k, 0, p["h"], lead, some) for k in range(p["salts"])]
                            size += len(some) * p["salts"]
                    for s in shards[r] or ():
                        out.append((s["shard"], s["salt"], 1, ids[r], 0, data))
                        size += len(data)
                    if size > 1 << 24:
                        yield _rows(out)
                        out, size = [], 0
            if out:
                yield _rows(out)

    return route


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    shard, salt, kind, key, lead, seq = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(salt, pa.int64()), pa.array(kind, pa.int8()), pa.array(key, pa.int64()), pa.array(lead, pa.int32()), pa.array(seq, pa.binary())], ["shard", "salt", "kind", "key", "lead", "seq"])


def _before(a: bytes, b: bytes) -> int:
    """With how many equal words, of four bytes, two runs end."""
    n = min(len(a), len(b)) // 4
    if not n or a[-4 * n :] == b[-4 * n :]:
        return n
    return next(k for k in range(n) if a[len(a) - 4 * k - 4 : len(a) - 4 * k] != b[len(b) - 4 * k - 4 : len(b) - 4 * k])


def _after(a: bytes, b: bytes) -> int:
    """With how many equal words two runs begin."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    return next(k for k in range(n) if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4])


def _stream(phrase: int, reach: int):
    """Builds the automaton of each shard from the phrases that head it, and runs its documents through.

    A hit is extended word by word on both sides, as far as the document goes on like the canonical one."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, ready = None, None, False
        # some rows at a time, as Python's own values take several times the room of the columns
        for b in (b.slice(k, STREAM_ROWS) for b in batches for k in range(0, b.num_rows, STREAM_ROWS)):
            hits: list[tuple[int, int, int, int, int]] = []
            for shard, salt, kind, key, lead, seq in zip(*(b.column(c).to_pylist() for c in ("shard", "salt", "kind", "key", "lead", "seq")), strict=True):
                if now != (shard, salt):
                    now, ready = (shard, salt), False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                if kind == 0:
                    word = _letters(seq[4 * lead : 4 * (lead + phrase)])
                    # what stands about it is kept as bytes, which take a tenth of the room
                    automaton.add_word(word, (*automaton.get(word, ()), (key, seq[: 4 * lead], seq[4 * (lead + phrase) :])))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                for end, held in automaton.iter(_letters(seq)):
                    end //= 2
                    at = end - phrase + 1
                    before, after = seq[4 * max(0, at - reach) : 4 * at], seq[4 * end + 4 : 4 * (end + 1 + reach)]
                    hits += [(k, key, at, _before(before, left), _after(after, right)) for k, left, right in held]
            if hits:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits, strict=True), kinds, strict=True)], ["h", "doc_id", "pos", "before", "after"])

    return stream


def recurring(spark: SparkSession, docs: DataFrame, phrase: int = PHRASE, passage: int = PASSAGE, shard_phrases: int = SHARD_PHRASES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(doc_id, start_word, end_word, phrases, first_doc_id): every recurring passage in every document.

    A passage is a run of words made of phrases of ``phrase`` words, each of which stands in two
    documents or more, and of the words about them that two documents share; words are compared
    without case and punctuation, and counted from 0. Whatever run of ``passage`` words or more two
    documents share holds such a phrase, and is reported in both; shorter shared runs are reported
    wherever one of their phrases is selected in two documents. A phrase is extended by comparison
    with the least document that holds it, first_doc_id; where two others share more about it than
    either does with that one, their spans are short by up to passage - phrase words at an end.

    Phrases are selected by winnowing and confirmed by an automaton, never by hash alone: shards of
    phrases become Aho-Corasick automata over words. All documents are searched for the phrases, at
    every position; those that hold one stream, whole, through the automata of their phrases. A shard
    takes the phrases of whole documents, so a document goes to few shards; documents of a busy shard
    are split over salts.

    Null and short texts hold no passage. Very long texts are searched whole. Rows with a null doc_id
    are left out; texts under one doc_id count as one document, as do repeated rows. A phrase that
    recurs only within a document isn't reported. Ties don't arise: spans of a document are apart.
    Only doc_id and text are read. An empty table gives no rows.
    """
    scratch = Scratch(spark)
    reach = passage - phrase
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    marks = slim.mapInArrow(_select(phrase, reach + 1), "h long, doc_id long, pos int")
    # partial aggregates: a phrase may stand in any share of the documents
    shared = marks.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last")
    shared = scratch.write(shared.select("h", F.col("first.doc_id").alias("canon"), "first.pos"))
    shards = max(1, -(-shared.count() // shard_phrases))
    shard = F.pmod(F.xxhash64("canon"), F.lit(shards)).alias("shard")
    passes = sieve(spark, shared.select("h"), hashes=2)
    met = slim.mapInArrow(_meet(phrase, passes), "h long, doc_id long").join(shared.select("h", shard), "h")
    goes = scratch.write(met.select("doc_id", "shard").distinct())
    busy = goes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(shard_docs)).cast("long").alias("salts"))
    routes = goes.join(busy, "shard").groupBy("doc_id").agg(F.collect_list(F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).alias("salt"))).alias("shards"))
    canonical = shared.select("h", "canon", "pos", shard).join(busy, "shard").groupBy(F.col("canon").alias("doc_id")).agg(F.collect_list(F.struct("h", "pos", "shard", "salts")).alias("phrases"))
    info = routes.join(canonical, "doc_id", "left")
    rows = slim.join(info, "doc_id").select("doc_id", "text", "shards", "phrases").mapInArrow(_route(phrase, reach), _ROUTED)
    found = scratch.write(rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_stream(phrase, reach), _FOUND))
    scratch.drop(goes)
    # what the canonical document shares about a phrase is what the others share with it
    canon = shared.select("h", "canon")
    other = lambda c: F.max(F.when(F.col("doc_id") != F.col("canon"), F.col(c)))
    sure = found.join(canon, "h").groupBy("h", "canon").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), other("before").alias("most_before"), other("after").alias("most_after")).where("lo <> hi")
    sure = found.join(sure, "h")
    reached = lambda c: F.when(F.col("doc_id") == F.col("canon"), F.least(c, f"most_{c}")).otherwise(F.col(c))
    sure = sure.select("h", "doc_id", "lo", (F.col("pos") - reached("before")).alias("start"), (F.col("pos") + F.lit(phrase) + reached("after")).alias("end"))
    in_doc = Window.partitionBy("doc_id").orderBy("start", "end", "h")
    runs = sure.withColumn("gap", F.when(F.col("start") <= F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("gap").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.count_distinct("h").alias("phrases"), F.min("lo").alias("first_doc_id")).drop("run")
