"""Line dedup by deletion neighbourhoods: lines a character or a word apart share a hashed variant."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, sieve
from .tokens import _BASE, _INVERSE, CHUNK_BYTES, U64, buffers, mix, powers

#: Lines of fewer characters than MIN_FUZZY, or of fewer words than MIN_WORDS, aren't compared by edits of
#: characters, or of words: one edit changes too much of them.
MIN_FUZZY, MIN_WORDS = 20, 8
#: A character that isn't white space, in the regular expressions of Java and of RE2.
SOLID = r"[^\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]"
#: Parts into which lines that share a half are cut, all but one of which they then have to share.
_BLOCKS = 8
_SPOT = "doc_id", "line_no"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h, h2, n) of each line that isn't blank."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = slim.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(SOLID))
    return out.select("doc_id", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"), F.length("line").alias("n"))


@dataclass
class Lines:
    """The lines of some rows, in order, as places in the bytes of these rows."""

    row: np.ndarray
    number: np.ndarray  #: of the line in its row, from 0
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    hash: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    keys: np.ndarray  #: (lines, 8)
    fits: np.ndarray  #: which of the keys a line has


def split_lines(texts: pa.Array, min_fuzzy: int, min_words: int) -> Iterator[Lines]:
    """Lines of a string array with the keys of their intact halves, on whole buffers, without an object a line.

    One edit of a character or a word leaves either the first or the last half of the shorter of two
    lines as it was, so partners agree on a key made of the length of the shorter one, the side and
    the half; a line has keys for its own length and the next less one. An edit of a character
    changes the number of words by one at most, so halves of words serve for it too; only where the
    shorter line has hardly any words it takes halves of characters.
    """
    offsets, data = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(texts))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield _lines_of(data[lo:hi], offsets[first : last + 1] - lo, first, min_fuzzy, min_words)
        first = last


def _lines_of(data: np.ndarray, offsets: np.ndarray, first: int, min_fuzzy: int, min_words: int) -> Lines:
    feeds = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(feeds, offsets)) + 1
    start, end = np.sort(np.concatenate((offsets[:-1], feeds + 1))), np.sort(np.concatenate((feeds, offsets[1:])))
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    spaces = np.flatnonzero(data == 32)
    c0, s0 = np.searchsorted(letters, start), np.searchsorted(spaces, start)
    chars, gaps = np.searchsorted(letters, end) - c0, np.searchsorted(spaces, end) - s0
    keep = (chars >= min_fuzzy) | (gaps + 1 >= min_words)
    row, number, start, end, c0, s0, chars, gaps = (x[keep] for x in (row, number, start, end, c0, s0, chars, gaps))
    words = gaps + 1
    n = len(data)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
    inverse = powers(_INVERSE, n + 1)

    def hashed(a: np.ndarray, z: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(((total[z] - total[a]) * inverse[a]) ^ mix(((z - a).astype(U64) << U64(32)) ^ salt.astype(U64)))

    keys, fits = np.zeros((len(row), 8), dtype=np.int64), np.zeros((len(row), 8), dtype=bool)
    letters, spaces = np.append(letters, n), np.append(spaces, n)
    for less in (0, 1):
        size = chars - less
        half = np.maximum(size // 2, 0)
        few = words <= min_words
        for side, (a, z) in enumerate(((start, letters[c0 + half]), (letters[c0 + chars - half], end))):
            z = np.where(half == 0, a, z)
            keys[:, 2 * less + side] = hashed(a, np.maximum(z, a), size * 4 + side).view(np.int64)
            fits[:, 2 * less + side] = few
        size = words - less
        half = size // 2
        many = size >= max(min_words, 2)
        some = np.where(many, half, 1)  # at least one space is there where it counts
        at = lambda k: spaces[np.minimum(k, len(spaces) - 1)]
        for side, (a, z) in enumerate(((start, at(s0 + some - 1)), (at(s0 + gaps - some) + 1, end))):
            a, z = np.where(many, a, start), np.where(many, z, start)
            keys[:, 4 + 2 * less + side] = hashed(a, z, size * 4 + 2 + side).view(np.int64)
            fits[:, 4 + 2 * less + side] = many
    return Lines(row + first, number, start, end, data, hashed(start, end, np.zeros(len(start), np.int64)).view(np.int64), chars, words, keys, fits)


def _half_rows(min_fuzzy: int, min_words: int):
    """(key, h) of the halves of each line; h tells lines apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in split_lines(b.column(0), min_fuzzy, min_words):
                if len(x.row):
                    r, c = np.nonzero(x.fits)
                    yield pa.RecordBatch.from_arrays([pa.array(x.keys[r, c]), pa.array(x.hash[r])], ["key", "h"])

    return rows


def _likely(min_fuzzy: int, min_words: int, may_hold):
    """(doc_id, line_no, line, keys) of the lines with a key that may be shared."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in split_lines(b.column(1), min_fuzzy, min_words):
                ok = x.fits.copy()
                r, c = np.nonzero(ok)
                ok[r, c] = may_hold(x.keys[r, c])
                hit = np.flatnonzero(ok.any(1))
                if len(hit):
                    raw = x.data.tobytes()
                    line = [raw[a:z] for a, z in zip(x.start[hit].tolist(), x.end[hit].tolist(), strict=True)]
                    keys = [k[f].tolist() for k, f in zip(x.keys[hit], ok[hit], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.row[hit])), pa.array(x.number[hit].astype(np.int32)), pa.array(line, pa.binary()).cast(pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "line_no", "line", "keys"])

    return likely


def _pieces(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of a whole sequence of values, of it without each of them, and which of these head a run of equal ones."""
    n = len(parts)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(parts * powers(_BASE, n), out=total[1:])
    whole = mix(total[n:] ^ U64(n << 40))
    cut = total[:-1] + (total[n] - total[1:]) * U64(_INVERSE)
    return whole, mix(cut ^ U64((n - 1) << 40)), np.concatenate(([True], parts[1:] != parts[:-1]))


def variants(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_pieces``, of the characters of a line."""
    return _pieces(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64) + U64(1))


def word_variants(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_pieces``, of the words of a line, cut at each space."""
    return _pieces(mix(np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in text.split(" ")], dtype=U64)))


def _rows(pieces: tuple[np.ndarray, np.ndarray, np.ndarray], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, kind): kind the line without the piece at a position, kind + 1 whole, kind + 2 without a piece."""
    whole, cut, head = pieces
    # a replaced piece stands at the same place in both lines; a run has one variant without one of it
    placed = mix(cut ^ mix(np.arange(len(cut), dtype=U64) + U64(0x632BE59BD9B4E019)))
    key = np.concatenate([placed, whole, cut[head]])
    return (mix(key ^ U64(kind)) if kind else key).view(np.int64), np.repeat(np.array([kind, kind + 1, kind + 2], dtype=np.int8), [len(cut), 1, head.sum()])


def _block_keys(parts, join) -> list[int]:
    """Hashes of a sequence without each of its blocks, for each length that the shorter of two partners can have.

    One edit touches one block, so partners agree on a key made of that length, the block and all the rest.
    """
    n, out = len(parts), []
    for size in (n, n - 1):
        for i in range(_BLOCKS):
            a, z = i * size // _BLOCKS, (i + 1) * size // _BLOCKS
            rest = f"{size} {i} {join(parts[:a])}\0{join(parts[n - size + z :])}"
            out.append(xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass")) - (1 << 63))
    return out


def _blocks(min_fuzzy: int, min_words: int):
    """(key, h, words, w): the keys of each line by characters and by words, and how many words it has."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, h, words, w = [], [], [], []
            for line, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = [_block_keys(line, str)] if len(line) >= min_fuzzy else []
                pieces = line.split(" ")
                made.append(_block_keys(pieces, " ".join) if len(pieces) >= min_words else [])
                for k, keys in enumerate(made if len(made) > 1 else [[], *made]):
                    key += keys
                    h += [x] * len(keys)
                    words += [k == 1] * len(keys)
                    w += [len(pieces)] * len(keys)
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h, pa.int64()), pa.array(words), pa.array(w, pa.int32())], ["key", "h", "words", "w"])

    return blocks


def _variant_rows(min_fuzzy: int, min_words: int):
    """(key, kind, d, l): kinds 0 to 2 of characters, 3 to 5 of words, as far as wanted; d and l are the document and number of the line."""

    def batch(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "kind", "d", "l"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for line, d, n, chars, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = [_rows(variants(line), 0)] if chars and len(line) >= min_fuzzy else []
                made += [_rows(word_variants(line), 3)] if words and line.count(" ") + 1 >= min_words else []
                for key, kind in made:
                    parts.append((key, kind, np.full(len(key), d, np.int64), np.full(len(key), n, np.int32)))
                    size += len(key)
                if size > 1 << 18:
                    yield batch(parts)
                    parts, size = [], 0
        if parts:
            yield batch(parts)

    return rows


def _apart(min_fuzzy: int, min_words: int):
    """Whether two lines are one edit apart, of a character or of a word."""

    def one(x, y) -> bool:
        a = 0
        while a < min(len(x), len(y)) and x[a] == y[a]:
            a += 1
        z = 0
        while z < min(len(x), len(y)) - a and x[-1 - z] == y[-1 - z]:
            z += 1
        return max(len(x), len(y)) - a - z <= 1

    def apart(line: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(line.to_pylist(), other.to_pylist(), strict=True):
            close = abs(len(x) - len(y)) <= 1 and min(len(x), len(y)) >= min_fuzzy and one(x, y)
            if not close:
                x, y = x.split(" "), y.split(" ")
                close = min(len(x), len(y)) >= min_words and one(x, y)
            out.append(close)
        return pa.array(out)

    return F.arrow_udf(apart, "boolean")


def repeated_lines(spark: SparkSession, docs: DataFrame, min_fuzzy: int = MIN_FUZZY, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line that has an earlier one at most an edit away.

    Returns (doc_id, line_no, first_doc_id, first_line_no, edits): the line, and the earliest line
    (by doc_id, then line number from 0) that is equal (edits 0), or one inserted, deleted or
    replaced character away where both have ``min_fuzzy`` characters, or one inserted, deleted or
    replaced word away where both have ``min_words`` words (edits 1). A word may be of any length,
    so the bound in characters follows what the line is made of. Lines are taken as they are, split
    at newlines, and words at spaces.

    Blank lines, null texts and rows with a null doc_id never count. Repeated rows of a doc_id
    are one document's rows: a line that stands at the same place in each is the same line. Of
    partners at any distance the earliest counts. Very long texts and lines are taken whole. Only
    doc_id and text are read. An empty table gives no rows.

    The deletion neighbourhood is emitted only for lines that share an intact half, and then all but
    one of eight blocks, with another line of a fitting length, which is necessary for one edit;
    nothing is lost by that. A line's partner comes from the least line of each variant, so no pairs
    of a group are made.
    """
    scratch = Scratch(spark)
    lines = _lines(docs)
    spot = F.struct(*_SPOT)
    firsts = scratch.write(lines.groupBy("h", "h2", "n").agg(F.min(spot).alias("first"), F.max(spot).alias("last")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    halves = slim.select("text").mapInArrow(_half_rows(min_fuzzy, min_words), "key long, h long")
    shared = scratch.write(halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"))
    # lines with such a key, once each with the place where they first stand: those that pass the sieve, then exactly
    may_hold = sieve(spark, shared)
    likely = slim.mapInArrow(_likely(min_fuzzy, min_words, may_hold), "doc_id long, line_no int, line string, keys array<long>").where(F.col("line").rlike(SOLID))
    # equal lines have equal keys
    near_all = likely.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2")).agg(F.min(F.struct(*_SPOT, "line", "keys")).alias("first"))
    near_all = scratch.write(near_all.select("h", "first", "first.keys"))
    exact = near_all.select("h", F.explode("keys").alias("key")).join(shared, "key", "left_semi").select("h").distinct()
    cand = scratch.write(near_all.join(exact, "h", "left_semi").select("first.line", "h", F.struct("first.doc_id", "first.line_no").alias("first")))
    scratch.drop(shared, near_all)
    # of these, lines that share all but one of some blocks with another
    blocks = scratch.write(cand.select("line", "h").mapInArrow(_blocks(min_fuzzy, min_words), "key long, h long, words boolean, w int"))
    # an edit of a character within a word is one of the word; by characters only lines of few words, or of
    # different numbers of words, have to be compared
    open_ = F.col("words") | (F.col("w_lo") < min_words) | (F.col("w_lo") < F.col("w_hi"))
    twice = blocks.groupBy("key", "words").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("w").alias("w_lo"), F.max("w").alias("w_hi")).where((F.col("lo") != F.col("hi")) & open_).select("key")
    flags = blocks.join(twice, "key", "left_semi").groupBy("h").agg(F.max(~F.col("words")).alias("by_chars"), F.max("words").alias("by_words"))
    cand_ = cand
    cand = scratch.write(cand.join(flags, "h"))
    scratch.drop(cand_, blocks)
    rows = cand.select("line", "first.doc_id", "first.line_no", "by_chars", "by_words").mapInArrow(_variant_rows(min_fuzzy, min_words), "key long, kind byte, d long, l int")
    rows = scratch.write(rows.select("key", "kind", F.struct(F.col("d").alias("doc_id"), F.col("l").alias("line_no")).alias("first")))
    # the rows of a key meet the least line of each kind, in a join that splits those of a hot key (a template with
    # one word open) where it is skewed
    mine = lambda *k: F.when(F.col("kind").isin(*k), F.col("first"))
    least = rows.groupBy("key").agg(*(F.min(mine(k, k + 3)).alias(f"m{k}") for k in range(3)), F.count("*").alias("many")).where("many > 1")
    seen = rows.join(least, "key").select("first", F.when(F.col("kind").isin(0, 3), F.col("m0")).when(F.col("kind").isin(1, 4), F.col("m2")).otherwise(F.col("m1")).alias("m"))
    best = seen.where("m < first").groupBy("first").agg(F.min("m").alias("m"))
    # the partner's text, for the exact check
    pairs = best.join(cand.select("first", "h", "line"), "first").join(cand.select(F.col("first").alias("m"), F.col("line").alias("other")), "m")
    near = scratch.write(pairs.where(_apart(min_fuzzy, min_words)("line", "other")).select("h", "first", F.col("m").alias("near")))
    scratch.drop(cand, rows)
    partner = firsts.join(near, ["h", "first"], "left").select("h", "h2", "n", "first", "near").where("near is not null or first <> last")
    found = lines.select(*_SPOT, "h", "h2", "n").join(partner, ["h", "h2", "n"])
    found = found.select(*_SPOT, F.coalesce("near", "first").alias("p"), F.col("near").isNotNull().cast("int").alias("edits"), spot.alias("own"))
    return found.where("p < own").select(*_SPOT, F.col("p.doc_id").alias("first_doc_id"), F.col("p.line_no").alias("first_line_no"), "edits").distinct()


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; a document of which only white space is left goes.

    n_chars, where the table has it, is counted anew for texts that changed. Texts that are null
    or had no repeated line stay as they were, as do rows with a null doc_id. Other columns may have
    any name. An empty table stays empty.
    """
    doc, cut, rest = fresh(docs, "doc", "cut", "rest")
    found = repeated_lines(spark, docs, **options)
    cuts = Scratch(spark).write(found.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line_no").alias(cut)))
    # decisions grow with the corpus, so they are never broadcast: one plan at every size, hashing them by document
    joined = docs.join(cuts.hint("shuffle_hash"), docs["doc_id"].cast("long") == cuts[doc], "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(cut, i))
    text = F.when(F.col(cut).isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn(rest, text).where(F.col(cut).isNull() | F.col(rest).rlike(SOLID))
    cols = []
    for c in docs.columns:
        if c.lower() == "text":
            cols.append(F.col(rest).alias(c))
        elif c.lower() == "n_chars":
            cols.append(F.when(F.col(cut).isNull(), F.col(c)).otherwise(F.length(rest)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return joined.select(*cols)
