"""Information-theoretic sanitisation: terms that reveal a protected entity are generalised or removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sieve
from .tokens import words

#: Words on either side of an entity that co-occur with it.
WINDOW = 30
#: Shares of an entity's information from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Documents added to those of a term where it stands by an entity of fewer than SUPPORT documents: what was
#: seen once or twice is weak evidence.
SUPPORT, SMOOTHING = 2, 1

_ENTITIES = [
    ("private key", re.compile(r"-----BEGIN (?:[A-Z]+ )*?PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]+-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)"), "PRIVATE KEY"),
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), "@"),
    ("access key", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"), "IA"),
    ("provider token", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[\w-]{20,}+|xox[abp]-[\w-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)"), None),
    ("secret", re.compile(r"""(?ai:(?:password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)["']?[ \t]*+(?::=|=>|[=:])[ \t]*+["']?)[^\s"',;<>]{6,}+"""), None),
    ("ip address", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), "."),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)"), "+"),
    ("card", re.compile(r"(?<![\w-])\d{4}(?:[ -]?\d{4}){3}(?:\d{3})?(?![\w-])"), None),
    ("national id", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
]
#: Patterns that begin with a digit or a plus sign: in a text without digits they can't match.
_NUMERIC = {"ip address", "phone", "card", "national id"}
_DIGIT = re.compile(r"\d")
#: A secret's name has one of these in it, in any case.
_NAMED = ("passw", "secret", "token", "key")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, class) of protected entities; of overlapping ones the first, then the longest."""
    found = []
    digits = _DIGIT.search(text) is not None
    low = text.lower()
    named = any(x in low for x in _NAMED)
    for kind, pattern, needs in _ENTITIES:
        if (needs is None or needs in text) and (digits or kind not in _NUMERIC) and (named or kind != "secret"):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def _tokens(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hash, start and end of each word of a text, as offsets of its UTF-8 bytes."""
    h, start, end, at = [], [], [], 0
    for w in words(pa.array([text], pa.string())):
        h += w.hash.view(np.int64).tolist()
        start += (w.start + at).tolist()
        end += (w.end + at).tolist()
    return h, start, end


def _masked(text: str) -> tuple[bytes, list[tuple[int, int]], list[int]]:
    """The text with its entities replaced by their classes, in UTF-8; where these stand; and their keys."""
    out, spans, keys, size, at = [], [], [], 0, 0
    for a, z, kind in entities(text):
        before, name = text[at:a].encode("utf-8", "replace"), f"<{kind}>".encode()
        out += [before, name]
        spans.append((size + len(before), size + len(before) + len(name)))
        keys.append(entity_key(kind, text[a:z]))
        size += len(before) + len(name)
        at = z
    out.append(text[at:].encode("utf-8", "replace"))
    return b"".join(out), spans, keys


def _outside(starts: list[int], spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words, by their starts, aren't in one of the spans."""
    s = np.array(starts, dtype=np.int64)
    lo, hi = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    k = np.searchsorted(lo, s, "right") - 1
    return (k < 0) | (s >= hi[k])


def _extract(window: int):
    """Documents with entities: their text with these masked, where the masks stand, and for each entity its key
    and the words about it. What is written holds no entity in clear."""
    found_type = pa.list_(pa.struct([("key", pa.int64()), ("terms", pa.list_(pa.int64()))]))
    span_type = pa.list_(pa.int32())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, places, found, size = [], [], [], [], 0

            def batch(b=b):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(places, span_type), pa.array(found, found_type)], ["doc_id", "text", "masks", "found"])

            for i, text in enumerate(b.column(1).to_pylist()):
                masked, spans, keys = _masked(text)
                if not spans:
                    continue
                masked = masked.decode()
                h, start, _ = _tokens(masked)
                # words of the masks aren't terms
                free = _outside(start, spans) if start else np.zeros(0, bool)
                h, start = np.array(h, dtype=np.int64)[free], np.array(start, dtype=np.int64)[free]
                by_key: dict[int, set[int]] = {}
                for (a, _), k in zip(spans, keys, strict=True):
                    j = int(np.searchsorted(start, a))
                    by_key.setdefault(k, set()).update(h[max(0, j - window) : j + window].tolist())
                rows.append(i)
                texts.append(masked)
                places.append([x for s in spans for x in s])
                found.append([{"key": k, "terms": sorted(t)} for k, t in by_key.items()])
                size += len(masked) + sum(len(t) for t in by_key.values())
                if size > 1 << 22:
                    yield batch()
                    rows, texts, places, found, size = [], [], [], [], 0
            if rows:
                yield batch()

    return extract


def entity_key(kind: str, value: str) -> int:
    """A hash of class and value; case and separators don't count."""
    plain = "".join(c for c in value.casefold() if c.isalnum() or c in "@.")
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode("utf-8", "replace")) - (1 << 63)


def _counts(near):
    """(term, n): in how many rows each word stands that may be ``near`` an entity, part by part of the batches."""

    def counted(seen: list[np.ndarray]) -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "n"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: list[np.ndarray] = []
            for w in words(b.column(0)):
                h = w.hash.view(np.int64)
                some = np.flatnonzero(near(h))
                h, r = h[some], w.row[some]
                # a pair of row and word, once each
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                seen.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))] if len(h) else h)
                if sum(map(len, seen)) > 1_000_000:  # sorting more at once takes memory and hardly shortens the result
                    yield counted(seen)
                    seen = []
            if seen:
                yield counted(seen)

    return counts


def generalise(word: str) -> str:
    return "<number>" if word.isdigit() else "<code>" if any(c.isdigit() for c in word) else "<name>" if word[:1].isupper() else "<term>"


def rewrite(text: str, masks: list[int], general: set[int], removed: set[int]) -> tuple[str, int, int, int]:
    """The sanitised text of a masked one, and how many entities and terms were generalised, and terms removed."""
    counts = [0, 0]
    out, at = [], 0
    if general or removed:
        raw = text.encode()
        h, start, end = _tokens(text)
        free = _outside(start, list(zip(masks[::2], masks[1::2], strict=True)))
        for k, a, z in zip(np.array(h, dtype=np.int64)[free].tolist(), np.array(start)[free].tolist(), np.array(end)[free].tolist(), strict=True):
            if k in removed or k in general:
                out.append(raw[at:a])
                out.append(b"" if k in removed else generalise(raw[a:z].decode()).encode())
                counts[k in removed] += 1
                at = z
        text = (b"".join(out) + raw[at:]).decode()
    return text, len(masks) // 2, counts[0], counts[1]


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [rewrite(t, m, set(g or ()), set(r or ())) for t, m, g, r in zip(*(b.column(c).to_pylist() for c in ("text", "masks", "general", "removed")), strict=True)]
        if got:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in zip(*got, strict=True))], ["doc_id", "text", "entities", "generalised", "removed"])


def disclosures(scratch: Scratch, docs: DataFrame, held: DataFrame, support: int, smoothing: int, least: float) -> DataFrame:
    """(key, term, share) of the terms that reveal an entity.

    By pointwise mutual information over documents: an entity in df(c) of N documents carries
    IC = log2(N / df(c)) bits; a term in df(t) of them, by the entity in df(c, t), gives away
    PMI = log2(N df(c, t) / (df(c) df(t))) of these. share = PMI / IC. An entity in ``support``
    documents or more is revealed by terms that stand by it in as many; one in fewer, as most
    personal data is, by terms about it, in ``smoothing`` more documents than were seen.
    """
    pairs = held.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.key", F.explode("f.terms").alias("term")).distinct()
    entity = held.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.key").distinct().groupBy("key").agg(F.count("*").alias("dc"))
    both = pairs.groupBy("key", "term").agg(F.count("*").alias("both")).join(entity, "key").where((F.col("both") >= support) | (F.col("dc") < support))
    both = scratch.write(both)
    near = sieve(scratch.spark, both.select("term").distinct())
    # words of all documents are counted as far as they stand by an entity somewhere
    term = docs.select("text").mapInArrow(_counts(near), "term long, n long").groupBy("term").agg(F.sum("n").alias("dt"))
    n = docs.agg(F.count("*").alias("docs"))
    ic = F.log2(F.col("docs") / F.col("dc"))
    # rows of one document can make a term's count lag behind; it is in as many documents at least
    dt = F.greatest("dt", "both") + F.when(F.col("dc") < support, F.lit(smoothing)).otherwise(0)
    pmi = F.log2(F.col("docs") * F.col("both") / (F.col("dc") * dt))
    told = scratch.write(both.join(term, "term").crossJoin(n).where("docs > dc").select("key", "term", (pmi / ic).alias("share")).where(F.col("share") >= least))
    scratch.drop(both)
    return told


def sanitise(spark: SparkSession, docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, smoothing: int = SMOOTHING, generalise_from: float = GENERALISE, remove_from: float = REMOVE) -> DataFrame:
    """(doc_id, text, entities, generalised, removed) of every document that holds a protected entity.

    Protected entities (addresses, numbers, keys and secrets that identify or admit somebody, of any
    length) are replaced by their class. Beside them, terms that reveal one are found from
    co-occurrence in the corpus: a term within ``window`` words of the entity that gives away
    ``generalise_from`` of its information (see ``disclosures``) is replaced by a more general word
    everywhere in the documents of that entity, and taken out from ``remove_from`` on. Every entity
    is examined, those of one document too. Documents without entities have no row: they stay as
    they are.

    Null texts and rows with a null doc_id are left out, and not counted. Of repeated rows each is
    rewritten; terms by an entity count once for a doc_id. Of overlapping entities the first, then
    the longest counts. In a corpus in which every document holds an entity it carries no
    information, and nothing can reveal it. A very long text is read whole. Only doc_id and text are
    read. An empty table gives no rows. Intermediate tables hold no entity in clear.
    """
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    held = scratch.write(slim.mapInArrow(_extract(window), "doc_id long, text string, masks array<int>, found array<struct<key: bigint, terms: array<bigint>>>"))
    told = disclosures(scratch, slim, held, support, smoothing, generalise_from)
    keys = held.select("doc_id", F.explode("found.key").alias("key")).distinct()
    term = keys.join(told, "key").groupBy("doc_id", "term").agg(F.max("share").alias("share"))
    lists = term.groupBy("doc_id").agg(F.collect_list(F.when(F.col("share") < remove_from, F.col("term"))).alias("general"), F.collect_list(F.when(F.col("share") >= remove_from, F.col("term"))).alias("removed"))
    out = held.select("doc_id", "text", "masks").join(lists, "doc_id", "left").select("doc_id", "text", "masks", "general", "removed")
    return out.mapInArrow(_rewrite, "doc_id long, text string, entities long, generalised long, removed long")
