"""Per-group pattern mining: support, modal structure, naming, affixes, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

SUPPORT = 0.6


def threshold(n: str, share: float = SUPPORT) -> Column:
    """Files that make a pattern: a share of a group, rounded up, one at least."""
    return F.greatest(F.lit(1), F.floor(F.col(n) * share + 0.9999))


def group_sizes(items: DataFrame, role: str = "role", path: str = "path") -> DataFrame:
    return items.groupBy(role).agg(F.count_distinct(path).alias("n"))


def common_features(features: DataFrame, sizes: DataFrame) -> DataFrame:
    """(role, kind, feature, support, coverage, evidence) of features (role, path, kind, feature) that
    reach the threshold of their role's number of files (role, n)."""
    got = features.distinct().groupBy("role", "kind", "feature").agg(F.count("*").alias("support"), F.array_sort(F.collect_list("path")).alias("evidence"))
    return got.join(sizes, "role").where(F.col("support") >= threshold("n")).select("role", "kind", "feature", "support", (F.col("support") / F.col("n")).alias("coverage"), "evidence")


def modal_structure(structures: DataFrame, sizes: DataFrame, share: float = SUPPORT) -> DataFrame:
    """(role, structure, support, coverage) of the commonest structure of each role, of equally
    common ones the first seen; structures (role, path, ord, structure), empty ones don't count."""
    got = structures.where(F.size("structure") > 0).groupBy("role", "structure").agg(F.count("*").alias("support"), F.min("ord").alias("ord"))
    top = got.withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("support"), "ord"))).where("r = 1")
    return top.join(sizes, "role").where(F.col("support") >= threshold("n", share)).select("role", "structure", "support", (F.col("support") / F.col("n")).alias("coverage"))


def numbered(patterns: DataFrame) -> DataFrame:
    """``patterns`` with their number in the role: best covered first, then kind, then feature."""
    return patterns.withColumn("number", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("coverage"), "kind", "feature")))


def naming(files: DataFrame, role: str = "role", name: str = "name", path: str = "path", order: str = "ord") -> DataFrame:
    """(role, case_style, coverage, examples, affixes…) of roles of two files or more whose commonest
    style covers 60 per cent; names of no style count in the total only."""
    rows = files.select(F.col(role).alias("role"), F.col(name).alias("name"), F.col(path).alias("path"), F.col(order).alias("ord"), P.name_style(name).alias("style"))
    styles = rows.where("style is not null").groupBy("role", "style").agg(F.count("*").alias("k"), F.min("ord").alias("o"))
    top = styles.groupBy("role").agg(F.min(F.struct((-F.col("k")).alias("k"), "o", "style")).alias("m")).select("role", F.col("m.style").alias("case_style"), (-F.col("m.k")).alias("k"))
    affix = affixes(rows, "role", "name")
    examples = rows.withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy("path"))).where("r <= 4").groupBy("role").agg(F.array_sort(F.collect_list("path")).alias("examples"))
    n = rows.groupBy("role").agg(F.count("*").alias("n"))
    out = top.join(n, "role").where("n >= 2").withColumn("coverage", F.col("k") / F.col("n")).where(F.col("coverage") >= SUPPORT)
    return out.join(affix, "role").join(examples, "role").select("role", "case_style", "coverage", "prefix", "suffix", "examples")


def affixes(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, prefix, suffix): the longest of two characters or more that all values of a group share.

    What all values share the least and the greatest share, in order or in reverse order, so two
    minima and two maxima do, and map-side partial aggregation with them.
    """
    v, back = F.col(value), F.reverse(F.col(value))
    ends = df.groupBy(group).agg(F.min(v).alias("a"), F.max(v).alias("b"), F.min(back).alias("c"), F.max(back).alias("d"))

    def common(a: str, b: str) -> Column:
        longest = F.least(F.length(a), F.length(b))
        n = F.aggregate(F.sequence(F.lit(1), F.greatest(longest, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (longest >= i) & (F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(b), i, F.lit(1))), i).otherwise(acc))
        return F.when(n >= 2, F.substring(F.col(a), F.lit(1), n)).otherwise("")

    return ends.select(group, common("a", "b").alias("prefix"), F.reverse(common("c", "d")).alias("suffix"))
