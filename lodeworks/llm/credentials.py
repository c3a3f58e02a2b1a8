"""Multipart credentials: identifiers, secrets and endpoints linked by an interval join."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Parts of one credential stand at most so many characters apart.
GAP = 400
#: A name with its sign of assignment, and a value.
_NAME = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]*+)["']?+[ \t]*+(?::=|=>|[=:])[ \t]*+["']?+""")
_VALUE = re.compile(r"""[^\s"',;<>&?]{4,}+""")
_SECRET_NAME = re.compile(r"pass(word|wd|phrase)?$|pwd$|secret|token$|api[_-]?key$|access[_-]?key$|private[_-]?key$|auth$|credential", re.I)
_IDENTIFIER_NAME = re.compile(r"user(name)?$|login$|account$|client[_-]?id$|access[_-]?key[_-]?id$|key[_-]?id$|app[_-]?id$", re.I)
_ENDPOINT_NAME = re.compile(r"host(name)?$|server$|endpoint$|url$|uri$|address$", re.I)
_AKIA = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
_SHAPED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[\w-]{20,}+|xox[abp]-[\w-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*?PRIVATE KEY-----")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]+://(?:([^\s/:@]++):([^\s/@]++)@)?[^\s\"'<>]{3,}+")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.]*\d)")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\b")
PARTS = "doc_id long, kind string, part string, start long, stop long, strong boolean, masked string, value long"


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def parts(text: str) -> list[tuple[str, str, int, int, bool, str]]:
    """(kind, part, start, stop, strong, value) of a text; kind is identifier, secret or endpoint.

    A secret is strong where its form alone gives it away: a provider's prefix, a private key, a
    password in a URL, or 20 characters and more of at least 3 bits each under a secret's name.
    Names, values, URLs and addresses may be of any length. A value ends at white space, quotes,
    commas, angle brackets, ``&`` and ``?``, and where the next name of a part begins.
    """
    out: list[tuple[str, str, int, int, bool, str]] = []
    if "AKIA" in text or "ASIA" in text:
        out += [("identifier", "access key id", m.start(), m.end(), True, m.group()) for m in _AKIA.finditer(text)]
    if "_" in text or "-" in text:
        out += [("secret", "provider token", m.start(), m.end(), True, m.group()) for m in _SHAPED.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [("secret", "private key", m.start(), m.end(), True, m.group()) for m in _PEM.finditer(text)]
    if "=" in text or ":" in text:
        names = []
        for m in _NAME.finditer(text):
            kind = "identifier" if _IDENTIFIER_NAME.search(m[1]) else "secret" if _SECRET_NAME.search(m[1]) else "endpoint" if _ENDPOINT_NAME.search(m[1]) else None
            if kind:
                names.append((m.start(), m.end(), kind))
        # a value is cut where the next name of a part begins, so each character belongs to one value at most
        for (_, at, kind), stop in zip(names, [*(n[0] for n in names[1:]), len(text)], strict=False):
            got = _VALUE.match(text, at, stop)
            if got is None:
                continue
            value, span = got[0], got.span()
            if kind == "identifier":
                out.append(("identifier", "named identifier", *span, False, value))
            elif kind == "secret" and not value.startswith("//"):
                strong = len(value) >= 20 and entropy(value) >= 3
                out.append(("secret", "named secret", *span, strong, value))
            elif kind == "endpoint" and "://" not in value:
                out.append(("endpoint", "named endpoint", *span, False, value))
    if "://" in text:
        for m in _URL.finditer(text):
            out.append(("endpoint", "url", m.start(), m.end(), False, m.group()))
            if m.group(2):
                out.append(("identifier", "url user", m.start(1), m.end(1), False, m.group(1)))
                out.append(("secret", "url password", m.start(2), m.end(2), True, m.group(2)))
    if "." in text:
        out += [("endpoint", "ip", m.start(), m.end(), False, m.group()) for m in _IP.finditer(text) if all(int(x) < 256 for x in m.group().split(":")[0].split("."))]
    if "@" in text:
        out += [("identifier", "email", m.start(), m.end(), False, m.group()) for m in _EMAIL.finditer(text)]
    return sorted(set(out), key=lambda p: (p[2], p[3], p[0], p[1]))


def _mask(value: str) -> str:
    return value[:4] + "***"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each row, with their values masked, and hashed to tell them apart: none leaves the task in clear."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    for b in batches:
        rows, found = [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            got = parts(text)
            rows += [i] * len(got)
            found += [(*p[:5], _mask(p[5]), xxhash.xxh64_intdigest(p[5].encode("utf-8", "surrogatepass")) - (1 << 63)) for p in got]
        if found:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True))], ["doc_id", "kind", "part", "start", "stop", "strong", "masked", "value"])


def linked(spark: SparkSession, docs: DataFrame, gap: int = GAP) -> DataFrame:
    """Credentials put together from their parts: one row for each reported part.

    (doc_id, kind, part, start, stop, strong, identifier, identifier_start, endpoint,
    endpoint_start, secret, secret_start, parts): the anchor is a secret, or an access key id;
    the others are the nearest complementary parts of the same document at most ``gap``
    characters away (of equally near ones the first, then the longest), null where there is none.
    parts counts the kinds present. Strong anchors are always reported, weak ones only with a
    complementary part. Values are masked but for their first four characters.

    Null and empty texts and rows with a null doc_id have no parts. Repeated rows count once. Of
    several texts under one doc_id the parts are taken together. A very long text is read whole, and
    its parts meet only those of their own and the next cells. Only doc_id and text are read. An
    empty table gives no rows. Intermediate tables hold no value in clear.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    found = Scratch(spark).write(slim.mapInArrow(_extract, PARTS).distinct())
    anchor = found.where("kind = 'secret' or part = 'access key id'")
    # the interval join meets on cells of gap characters: near parts are in the same cell or the next
    cell = lambda c: F.floor(F.col(c) / F.lit(gap + 1))
    left = anchor.select("*", F.explode(F.sequence(F.floor((F.col("start") - F.lit(gap)) / F.lit(gap + 1)), cell("stop") + F.floor(F.lit(gap) / F.lit(gap + 1)) + F.lit(1))).alias("cell"))
    right = found.select(F.col("doc_id").alias("d"), F.col("kind").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"), F.col("masked").alias("v"), F.explode(F.sequence(cell("start"), cell("stop"))).alias("c"))
    far = F.greatest(F.col("s") - F.col("stop"), F.col("start") - F.col("e"), F.lit(0))
    near = left.join(right, (left["doc_id"] == right["d"]) & (left["cell"] == right["c"]) & (left["kind"] != right["k"]) & (far <= gap))
    pick = lambda k: F.min(F.when(F.col("k") == k, F.struct(far.alias("far"), F.col("s").alias("s"), (-F.col("e")).alias("e"), F.col("v").alias("v"))))
    key = ["doc_id", "kind", "part", "start", "stop", "strong", "masked", "value"]
    got = near.groupBy(*key).agg(*(pick(k).alias(k) for k in ("identifier", "endpoint", "secret")))
    full = anchor.join(got, key, "left")
    out = full.select("doc_id", "kind", "part", "start", "stop", "strong", *(c for k in ("identifier", "endpoint", "secret") for c in (F.when(F.col("kind") == k, F.col("masked")).otherwise(F.col(f"{k}.v")).alias(k), F.when(F.col("kind") == k, F.col("start")).otherwise(F.col(f"{k}.s")).alias(f"{k}_start"))))
    out = out.withColumn("parts", sum(F.col(k).isNotNull().cast("int") for k in ("identifier", "endpoint", "secret")))
    return out.where("strong or parts > 1")
