"""A source tree as a table: a Python data source that lists first and reads only what survives.

``spark.read.format("source_tree").option("root", …)`` gives (path, size_bytes, content BINARY). Unlike
the built-in binary reader it keeps names that begin with ``_`` or ``.``, and empty files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import vocabulary as V
from ..functions import paths as P
from ..operators import gitignore, selection
from . import git

SCHEMA = "path string, size_bytes long, content binary"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.size = int(options.get("partitionFiles", 500))
        self.content = options.get("content", "true") == "true"
        self.only = options.get("paths")

    def partitions(self) -> list[InputPartition]:
        paths = self.only.split("\n") if self.only is not None else sorted(walk(self.root))
        return [_Files(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for p in partition.paths:
            full = os.path.join(self.root, p)
            if not p or not os.path.isfile(full):
                continue
            data = None
            if self.content:
                with open(full, "rb") as f:
                    data = f.read()
            yield p, os.path.getsize(full), data


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk(root: str) -> Iterator[str]:
    """Relative paths of all files; ignored folders aren't entered."""
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in V.IGNORED_FOLDERS)
        for n in names:
            yield os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/")


def discover(root: str) -> tuple[list[str], str]:
    """(relative paths, 'git' or 'filesystem'): what git tracks or would track, and valuable files at
    the root that it ignores; without a repository, every file."""
    if git.is_repository(root):
        at_root = [n for n in os.listdir(root) if os.path.isfile(os.path.join(root, n))]
        extra = [n for n in at_root if n in V.HIGH_VALUE_NAMES or n.startswith("Dockerfile.") or n == ".env.example" or n.startswith("docker-compose")]
        return sorted({*git.files(root), *extra}), "git"
    return sorted(walk(root)), "filesystem"


def read_tree(spark: SparkSession, root: str, paths: list[str] | None = None, content: bool = True) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("root", root).option("content", str(content).lower())
    return (reader if paths is None else reader.option("paths", "\n".join(paths))).load()


def _text(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in data.to_pylist()], pa.string())


def decode(data: Column | str) -> Column:
    """UTF-8 text of a binary column, bytes that aren't dropped."""
    return F.arrow_udf(_text, "string")(data)


def hydrate(listed: DataFrame, root: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """``listed`` (path, size_bytes, gitignored) with content, read where the rows are: the listing never
    comes to the driver. Files that are gone by now drop out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            path, flag, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array([len(d) for d in data], pa.int64()), pa.array(flag, pa.bool_()), pa.array(data, pa.binary())], ["path", "size_bytes", "gitignored", "content"])

        rows, size = [], 0
        for b in batches:
            for path, flag in zip(b.column("path").to_pylist(), b.column("gitignored").to_pylist(), strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                rows.append((path, flag, data))
                size += len(data)
                if size > batch_bytes:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return listed.select("path", "size_bytes", "gitignored").mapInArrow(read, "path string, size_bytes long, gitignored boolean, content binary")


def scan(spark: SparkSession, root: str, max_kb: int = V.MAX_FILE_KB) -> tuple[DataFrame, str]:
    """(candidates, method): (path, size_bytes, char_count, sha256, language, role, priority, reasons,
    content, gitignored, ord), best first.

    Path and size rules run on a listing without contents; only what passes is read.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    paths, method = discover(root)
    ignore = os.path.join(root, ".gitignore")
    lines = open(ignore, encoding="utf-8", errors="ignore").read().splitlines() if os.path.exists(ignore) else []
    listed = gitignore.mark(spark, read_tree(spark, root, paths, content=False), lines)
    listed = listed.where(P.path_decision("path", "size_bytes", F.col("gitignored"), max_kb)["include"])
    f = hydrate(listed, root).where(~P.binary_blob("content")).withColumn("text", decode("content")).where(P.content_decision("path", "text")["include"])
    f = f.where(P.language("path").isNotNull() | P.supported_non_source("path")).withColumn("p", P.priority("path"))
    out = f.select("path", "size_bytes", F.length("text").alias("char_count"), F.sha2("content", 256).alias("sha256"), P.language("path").alias("language"), "p.role", F.col("p.score").alias("priority"), "p.reasons", F.col("text").alias("content"), F.coalesce("gitignored", F.lit(False)).alias("gitignored"))
    return out.withColumn("ord", F.row_number().over(Window.orderBy(*selection.order_key()))), method
