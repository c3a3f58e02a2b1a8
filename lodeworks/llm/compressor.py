"""Quality classifier from compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from .tokens import buffers

#: At most so many labelled documents of each class (good, low quality, toxic) train the model.
PER_CLASS = 1500
THRESHOLD = 0.5
_CHUNK = 256
_LEVEL = 6
_CLASSES = ("good", "low", "toxic")


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes, bytes]  #: good; good and low quality; good and toxic
    low: np.ndarray  #: logistic coefficients over ``features``
    toxic: np.ndarray


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, kind, size) of at most ``per_class`` documents a class, and the size of the class.

    The choice is by hash of doc_id, so it doesn't depend on the order of rows: of each class the
    least, which every task picks from its own rows before they meet.
    """
    kind = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    all_ = labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("kind")).where("kind is not null and doc_id is not null").distinct()
    sizes = {r.kind: r.n for r in all_.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # three rows at most
    parts = []
    for k, n in sorted(sizes.items()):
        own = all_.where(F.col("kind") == k)
        # the first of a total order: each task hands on per_class rows at most
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("size", F.lit(n)))
    some = functools.reduce(DataFrame.unionByName, parts) if parts else all_.withColumn("size", F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most 3 x per_class rows, so this side is always small
    return texts.join(F.broadcast(some), "doc_id")


def _words(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(set(t.split()))
    return out


def _pieces(frequency: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in frequency.items():
        for k in (5, 6, 8):
            if len(w) >= k:
                out[" " + w[:k]] += n
        if len(w) >= 4:
            out[w[-4:] + " "] += n
        out[f" {w} "] += n
    return out


def _telling(bad: list[str], good: list[str], size: int) -> bytes:
    """Pieces of words that many bad documents have and hardly any good one, the most telling last."""
    fb, fg = _pieces(_words(bad)), _pieces(_words(good))
    least = max(3, 0.01 * len(bad))
    ranked = []
    for piece, n in fb.items():
        a, b = (n + 0.5) / (len(bad) + 1), (fg[piece] + 0.5) / (len(good) + 1)
        if n >= least and a > 20 * b:
            ranked.append((-n * math.log(a / b), piece))
    out: list[str] = []
    for _, piece in sorted(ranked):
        if not any(piece in x for x in out):
            out.append(piece)
            size -= len(piece.encode())
            if size < 0:
                break
    return "".join(reversed(out)).encode()


def _trained(texts: list[str], size: int) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:  # too few samples: their ends serve as they are
        return b"".join(s[-400:] for s in samples)[-size:]


def _common(texts: list[str], size: int) -> bytes:
    out = []
    for w, _ in sorted(_words(texts).items(), key=lambda x: (-x[1], x[0])):
        out.append(f" {w} ")
        size -= len(out[-1].encode())
        if size < 0:
            break
    return "".join(reversed(out)).encode()


class Sizer:
    """Compressed size of a text, in chunks, under each dictionary; then what the toxic one saves
    beyond noise, and in how many chunks."""

    def __init__(self, dictionaries: tuple[bytes, ...]):
        self.to = []
        for raw in dictionaries:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            p = zstd.ZstdCompressionParameters.from_level(_LEVEL, dict_size=len(raw), source_size=_CHUNK, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            self.to.append(zstd.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def __call__(self, data) -> tuple[int, ...]:
        cuts = [data[i : i + _CHUNK] for i in range(0, len(data), _CHUNK)]
        good, low, toxic = ([len(c(x)) for x in cuts] for c in self.to)
        # a telling piece saves some bytes of its chunk at once; what saves one or two is the parse
        gain = [g - t - 2 for g, t in zip(good, toxic, strict=True) if g - t > 2]
        return sum(good), sum(low), sum(toxic), sum(gain), len(gain)


def features(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Normalised differences of compressed sizes (as of Sizer, raw sizes n), and the ratio itself."""
    base = np.maximum(sizes[:, 0], 1.0)
    low, toxic = (base - sizes[:, 1]) / base, (base - sizes[:, 2]) / base
    ratio = np.minimum(base / np.maximum(n, 1), 1.0)
    gain, share = np.log1p(sizes[:, 3]), sizes[:, 4] / np.maximum(np.ceil(n / _CHUNK), 1)
    return np.stack([np.ones(len(base)), 10 * low, 10 * np.maximum(low, 0), 20 * toxic, gain, 4 * share, 10 * np.minimum(ratio, 0.5), 4 * ratio, 10 * ratio * ratio], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, lightly regularised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[0] = 1e-4
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Dictionaries from one half of the labelled sample, calibration on the other half.

    None where there is no good document, or no bad one, to learn from.
    """
    rows = labelled(docs, labels, per_class).orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    by = {k: [r for r in rows if r.kind == k] for k in _CLASSES}
    if not by["good"] or not (by["low"] or by["toxic"]):
        return None
    learn = {k: [r.text for r in v[::2]] for k, v in by.items()}
    # a text that recurs counts once, or its chance words would look telling
    learn = {k: list(dict.fromkeys(v)) for k, v in learn.items()}
    good = _common(learn["good"], 16384) + _trained(learn["good"], 16384)
    low = _common(learn["low"], 16384) + _trained(learn["low"], 16384)
    model = (good, low, _telling(learn["toxic"], learn["good"], 8192) + good)
    sizer = Sizer(model)
    held = [(r, r.text.encode("utf-8", "surrogatepass")) for v in by.values() for r in (v[1::2] or v)]
    x = features(np.array([sizer(b) for _, b in held], dtype=float), np.array([len(b) for _, b in held]))
    kind = np.array([r.kind for r, _ in held])
    count = Counter(kind)
    weight = np.array([r.size / count[r.kind] for r, _ in held])
    weight *= len(held) / weight.sum()
    return Model(model, *(_logistic(x[kind != other], (kind[kind != other] == k).astype(float), weight[kind != other]) for k, other in (("low", "toxic"), ("toxic", "low"))))


def probabilities(model: Model, sizes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = features(sizes, n)
    return tuple(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for w in (model.low, model.toxic))


def bad_probability(model: Model | None) -> "callable":
    """A column function: text -> struct(p_low, p_toxic), null for null and empty texts."""
    kind = "struct<p_low: double, p_toxic: double>"
    if model is None:
        return lambda text: F.lit(None).cast(kind)
    sizer: list[Sizer] = []

    @F.arrow_udf(kind)
    def score(text: pa.Array) -> pa.Array:
        if not sizer:
            sizer.append(Sizer(model.dictionaries))
        offsets, data = buffers(text)
        view = memoryview(np.ascontiguousarray(data))
        sizes = np.array([sizer[0](view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=float).reshape(-1, 5)
        n = np.diff(offsets)
        low, toxic = probabilities(model, sizes, n)
        none = n == 0
        return pa.StructArray.from_arrays([pa.array(low, mask=none), pa.array(toxic, mask=none)], ["p_low", "p_toxic"])

    return score


def _score(p: Column) -> Column:
    return (1 - p["p_low"]) * (1 - p["p_toxic"])


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, p_low, p_toxic, rejected) of every row of ``docs``.

    score is the calibrated probability that the document is neither of low quality nor toxic;
    a document is rejected where it falls under ``threshold``. Null and empty texts have null
    scores and aren't rejected, as have all where the labels have no good or no bad document.
    Rows repeat as they do in ``docs``; rows with a null doc_id are scored too. Labels with a null
    quality or toxic count only as far as the other one settles the class; a doc_id with labels of
    two classes is in both, and one with several texts gives each. A very long text is compressed
    whole, in chunks. A score equal to the threshold isn't rejected. Of other columns none is read.
    An empty table gives no rows.
    """
    p = bad_probability(fit(spark, docs, labels, per_class))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), p(F.col("text").cast("string")).alias("p"))
    out = out.select("doc_id", _score(F.col("p")).alias("score"), "p.p_low", "p.p_toxic")
    return out.withColumn("rejected", F.coalesce(F.col("score") < threshold, F.lit(False)))


def drop_bad(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``classify`` rejects; rows and columns otherwise as they are.

    Null and empty texts and rows with a null doc_id are treated as there. An empty table stays empty.
    """
    p = bad_probability(fit(spark, docs, labels, per_class))
    return docs.where(F.coalesce(_score(p(F.col("text").cast("string"))) >= threshold, F.lit(True)))


