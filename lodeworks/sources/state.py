"""Saved state of a run: one JSON document with a fixed schema, replaced as a whole."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "struct<path:string,sha256:string,language:string,role:string,base_priority:int,priority:int,size_bytes:bigint,char_count:bigint,selected:boolean,gitignored:boolean,summary:string>"
SCHEMA = (
    "version int, generated_at string, repo_root string, head_commit string, selected_paths array<string>, directory_counts map<string,bigint>, gitignore_patterns array<string>,"
    f" discovery_method string, candidate_count bigint, total_chars bigint, bytes_read bigint, files array<{_FILE}>, reverse_dependencies map<string,array<string>>,"
    " skill_index array<struct<name:string,purpose:string,source_evidence:array<string>,related_paths:array<string>>>"
)
REQUIRED = ("version", "generated_at", "repo_root", "files")


def load(spark: SparkSession, path: str, repo_root: str) -> DataFrame | None:
    """The state as one row; None where it is missing, unreadable, incomplete or of another root."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except (OSError, ValueError):
        return None
    return parse(spark, text, repo_root)


def parse(spark: SparkSession, text: str, repo_root: str) -> DataFrame | None:
    """As ``load``, of the text of a state."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict) or any(k not in data for k in REQUIRED) or os.path.realpath(str(data["repo_root"])) != os.path.realpath(repo_root):
        return None
    row = spark.createDataFrame([(json.dumps(data),)], "j string").select(F.from_json("j", SCHEMA, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")
    return None if row.where("files is null").count() else row


def files_of(state: DataFrame) -> DataFrame:
    return state.select(F.explode("files").alias("f")).select("f.*")


def edges_of(state: DataFrame) -> DataFrame:
    """(src, dst) of the saved importers."""
    return state.select(F.explode("reverse_dependencies").alias("dst", "src")).select(F.explode("src").alias("src"), "dst")


def index_of(state: DataFrame) -> DataFrame:
    return state.select(F.explode("skill_index").alias("i")).select("i.*")


def save(path: str, data: dict) -> None:
    """Writes beside the file and puts it in place at once."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(part, path)


def reuse(files: DataFrame, saved: DataFrame) -> DataFrame:
    """``files`` with reused: the saved record of the path has the same content, by hash."""
    s = saved.select("path", F.col("sha256").alias("__sha"), F.col("summary").alias("__summary")).dropDuplicates(["path"])
    return files.join(s, "path", "left").withColumn("reused", F.coalesce(F.col("__sha") == F.col("sha256"), F.lit(False))).withColumn("saved_summary", F.when(F.col("reused"), F.col("__summary"))).drop("__sha", "__summary")
