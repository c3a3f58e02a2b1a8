"""Ordering, budgets and first-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V


def order_key(priority: str = "priority", size: str = "char_count", path: str = "path") -> list[Column]:
    """Highest priority first, then the smaller file, then the path."""
    return [F.desc(priority), F.asc(size), F.asc(path)]


def select_within_budget(files: DataFrame, max_files: int = V.MAX_FILES, max_chars: int = V.MAX_TOTAL_CHARS, chunk: int = 2000) -> DataFrame:
    """``files`` with selected, and running_chars after each selected row.

    Greedy, in the order of order_key: a file that would overflow ``max_chars`` is skipped and later
    ones may still fit, until ``max_files`` are taken. The walk goes by chunks: the first ``chunk``
    files behind the last one looked at that fit into what is left, a top-k with partial results. The
    first of each always fits, so there are at most ``max_files`` of them, and mostly one. A path that
    stands on several rows is one file of the size of each row.
    """
    rows = files.select(F.col("priority").cast("double").alias("p"), F.col("char_count").cast("long").alias("c"), F.col("path").cast("string").alias("path"))
    rows = rows.where("p is not null and c is not null and path is not null")
    taken: list[tuple[str, int, int]] = []
    total, last = 0, None
    while len(taken) < max_files:
        fit = rows.where(F.col("c") <= max_chars - total)
        if last is not None:
            p, c, path = last
            at = F.struct((-F.col("p")).alias("p"), "c", "path")
            fit = fit.where(at > F.struct(F.lit(-p).alias("p"), F.lit(c).cast("long").alias("c"), F.lit(path).alias("path")))
        found = fit.orderBy(*order_key("p", "c")).limit(chunk).collect()
        for r in found:
            if len(taken) < max_files and total + r.c <= max_chars:
                total += r.c
                taken.append((r.path, r.c, total))
        if len(found) < chunk:
            break
        last = found[-1]
    schema = "__path string, __size long, running_chars long"
    mine = files.sparkSession.createDataFrame(taken, schema).groupBy("__path", "__size").agg(F.min("running_chars").alias("running_chars"))
    joined = files.join(F.broadcast(mine), (F.col("path") == F.col("__path")) & (F.col("char_count") == F.col("__size")), "left")  # max_files rows at most
    return joined.withColumn("selected", F.col("__path").isNotNull()).drop("__path", "__size")


def budget_totals(selected: DataFrame) -> DataFrame:
    """One row: selected and dropped files, and characters kept."""
    return selected.agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("dropped"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("char_count"))), F.lit(0)).alias("total_chars"))


def first_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark's group limit prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def evidence(df: DataFrame, group: str, path: str = "path", order: str = "ord", k: int = 8) -> DataFrame:
    """(group, evidence): the first k paths of each group, in order."""
    return first_k(df, [group], [order, path], k).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", path))), lambda x: x[path]).alias("evidence"))


def core_modules(ranked: list[DataFrame], cap: int = 16) -> DataFrame:
    """(path, source, pos) of the ordered union of candidate lists (path, pos), first mention kept."""
    union = None
    for i, df in enumerate(ranked):
        one = df.select("path", F.lit(i).alias("source"), F.col("pos").cast("long").alias("pos"))
        union = one if union is None else union.unionByName(one)
    first = union.groupBy("path").agg(F.min(F.struct("source", "pos")).alias("m"))
    return first.select("path", "m.source", "m.pos").orderBy("source", "pos", "path").limit(cap)


ROLE_ORDER = {role: n for n, role in enumerate("entrypoint route service model source utility".split())}


def module_key(records: DataFrame) -> list[Column]:
    """Role, then confidence, then how much a module defines, then how deep it lies."""
    role = F.coalesce(*[F.when(F.col("role") == r, F.lit(n)) for r, n in ROLE_ORDER.items()], F.lit(6))
    n = lambda c, cap=None: F.least(F.size(c), F.lit(cap)) if cap else F.size(c)
    symbols = n("functions") + n("classes") + n("methods") + n("routes") * 2 + n("internal_dependencies") + n("call_targets", 8) + n("type_references", 4) + n("data_flow_edges", 4)
    return [role.asc(), F.desc("confidence"), symbols.desc(), (F.size(F.split("path", "/")) - 1).asc(), F.asc("path")]
