"""Set operations over evidence: gold comparison, merges of maps and indexes, change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_with_gold(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (emitted, gold, hits, missed, recall) over distinct values of column ``fact``."""
    f, g = facts.select("fact").distinct().withColumn("f", F.lit(1)), gold.select("fact").distinct().withColumn("g", F.lit(1))
    got = f.join(g, "fact", "full").agg(F.count("f").alias("emitted"), F.count("g").alias("gold"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("hits"))
    return got.withColumn("missed", F.col("gold") - F.col("hits")).withColumn("recall", F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(1.0))


def merge_reverse(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Importers (id, importers) of either map, per key the union, sorted."""
    both = current.select("id", "importers").unionByName(previous.select("id", "importers"))
    return both.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("importers")))).alias("importers"))


def merge_index(current: DataFrame, previous: DataFrame, key: str = "name") -> DataFrame:
    """Rows of both by key; a current row replaces the previous one."""
    return current.unionByName(previous.join(current.select(key), key, "left_anti"))


def changed_paths(diffs: DataFrame, own_folder: str) -> DataFrame:
    """Distinct changed paths, renamed ones with both names, outside the output folder, in order."""
    both = diffs.select(F.explode(F.filter(F.array("path", "previous_path"), lambda p: p.isNotNull())).alias("path")).distinct()
    return both.where((F.col("path") != own_folder) & ~F.col("path").startswith(own_folder + "/")).orderBy("path")


def stale(previous: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    return previous.select(key).subtract(current.select(key))


def split_plan(affected: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Affected names that the plan has, and those it lacks."""
    return affected.join(plan.select("name"), "name", "left_semi"), affected.join(plan.select("name"), "name", "left_anti")


def mark_selected(records: DataFrame, selected: DataFrame) -> DataFrame:
    s = selected.select("path").distinct().withColumn("__s", F.lit(True))
    return records.drop("selected").join(s, "path", "left").withColumn("selected", F.coalesce("__s", F.lit(False))).drop("__s")
