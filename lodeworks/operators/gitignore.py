"""Ignore rules as a relation: the last rule that matches a path decides."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_regex

RULE = "pos int, pattern string, negate boolean, folder boolean, anchored boolean, re string"


def _inner(pattern: str) -> str:
    return glob_regex(pattern).removeprefix(r"(?s)\A").removesuffix(r"\z")


def parse(lines: Iterable[str]) -> list[tuple]:
    """Rules (RULE) of an ignore file; blank lines and comments are none.

    A subset of the format: ``folder/`` covers what lies under that folder of the root, ``/x``
    is a pattern for the whole path, and a bare pattern fits the name or any part of the path.
    """
    out = []
    for raw in lines:
        text = raw.strip()
        if not text or text.startswith("#"):
            continue
        negate, text = text.startswith("!"), text.removeprefix("!")
        folder, anchored = text.endswith("/"), text.startswith("/")
        pattern = text.rstrip("/").lstrip("/")
        if not pattern:
            continue
        inner = _inner(pattern)
        if folder:
            rule = rf"(?s)\A{re.escape(pattern)}(/.*)?\z"
        elif anchored or "/" in pattern:
            rule = rf"(?s)\A{inner}\z"
        else:
            rule = rf"(?s)\A{inner}\z|(?:\A|/){inner.replace('.*', '[^/]*')}(?:/|\z)"
        out.append((len(out) + 1, pattern, negate, folder, anchored, rule))
    return out


def text_of(rules: DataFrame) -> DataFrame:
    """(pos, text): rules as they are written."""
    return rules.select("pos", F.concat(F.when(F.col("negate"), "!").otherwise(""), F.when(F.col("anchored"), "/").otherwise(""), F.col("pattern"), F.when(F.col("folder"), "/").otherwise("")).alias("text"))


def mark(spark: SparkSession, files: DataFrame, lines: Iterable[str], path: str = "path") -> DataFrame:
    """``files`` with gitignored. An ignore file is a few lines, so its rules become one expression
    over the path, tried from the last to the first, and no join."""
    out = None
    for _, _, negate, _, _, rule in reversed(parse(lines)):
        hit = F.col(path).rlike(rule)
        out = F.when(hit, F.lit(not negate)) if out is None else out.when(hit, F.lit(not negate))
    return files.withColumn("gitignored", F.lit(False) if out is None else out.otherwise(False))
