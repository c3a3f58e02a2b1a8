"""What a change touches: modes, affected files and skills, relevance of rules and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import paths as P
from . import graph


def full_rebuild_trigger(path):
    p = F.col(path) if isinstance(path, str) else path
    return P.name(p).isin("Dockerfile", "requirements.txt", "pyproject.toml") | P.matches_glob(p, V.CONFIG_GLOBS) | (P.name(p).isin(*V.HIGH_VALUE_NAMES) & ~p.contains("/"))


def choose_mode(requested: str, changed: DataFrame, has_state: bool, is_repository: bool, has_diff: bool = False, most: int = 64, full_on_config: bool = True) -> tuple:
    """('full' | 'incremental', reason codes)."""
    if requested == "full":
        return "full", []
    if not has_diff and not is_repository:
        return "full", ["not-a-repository"]
    if not has_state:
        return "full", ["no-previous-state"]
    n, config = changed.agg(F.count("*"), F.count_if(full_rebuild_trigger("path"))).first()
    if requested == "incremental" and not n:
        return "incremental", ["no-changes"]
    if full_on_config and config:
        return "full", ["configuration-changed"]
    if n > most:
        return "full", ["too-many-changes"]
    return "incremental", []


def affected_files(spark: SparkSession, mode: str, selected: DataFrame, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): in full mode what is selected, else all that depends on a change, and the change."""
    if mode == "full":
        return selected.select("path").distinct()
    return graph.reachable_from(spark, changed.select(F.col("path").alias("id")), edges).select(F.col("id").alias("path"))


def skill_index(skills: DataFrame) -> DataFrame:
    """(name, purpose, source_evidence, related_paths): evidence distinct and in order."""
    e = P.unique_sorted("source_evidence")
    return skills.select("name", "purpose", e.alias("source_evidence"), e.alias("related_paths"))


def affected_skills(affected: DataFrame, skills: DataFrame, paths: str = "related_paths") -> DataFrame:
    """(name) of skills that any affected file bears on, in order."""
    each = skills.select("name", F.explode(paths).alias("path"))
    return each.join(affected.select("path"), "path", "left_semi").select("name").distinct().orderBy("name")


def relevant_rules(rules: DataFrame, skills: DataFrame, k: int = 8, fallback: int = 5) -> DataFrame:
    """(skill, rule, score, rank): rules (name, text, evidence, confidence, ord) by shared evidence, shared
    tokens and confidence; the best k, or the first rules where none scores.

    Rules meet skills (name, text, read_files) over shared paths and tokens, an equi-join whose rows
    count the overlap. A rule that shares nothing scores by its confidence alone, the same for every
    skill, so of all rules that share nothing with a skill only the k best by confidence can be among its
    best k: these k, k rows, meet every skill.
    """
    every = rules.select(F.col("name").alias("rule"), "confidence", "ord", P.tokens("text").alias("t"), "evidence")
    s = skills.select(F.col("name").alias("skill"), P.tokens("text").alias("t"), "read_files")
    token = s.select("skill", F.explode("t").alias("k")).join(every.select("rule", F.explode("t").alias("k")), "k").groupBy("skill", "rule").agg(F.count("*").alias("shared"))
    path = s.select("skill", F.explode("read_files").alias("k")).join(every.select("rule", F.explode("evidence").alias("k")), "k").select("skill", "rule").distinct().withColumn("hit", F.lit(5).cast("long"))
    base = every.select("rule", "confidence", "ord", F.floor(F.col("confidence") * 3).alias("own"))
    points = token.select("skill", "rule", F.col("shared").alias("points")).unionByName(path.select("skill", "rule", F.col("hit").alias("points"))).groupBy("skill", "rule").agg(F.sum("points").alias("points"))
    met = points.join(base, "rule").withColumn("score", F.col("points") + F.col("own")).where("score > 0").select("skill", "rule", "score", "confidence")
    # k rules by confidence alone, for every skill: if one of them shares something, its score with that is the higher
    sure = base.where("own > 0").orderBy(F.desc("own"), F.desc("confidence"), "rule").limit(k).select("rule", F.col("own").alias("score"), "confidence")
    every_skill = s.select("skill").crossJoin(F.broadcast(sure))
    scored = met.unionByName(every_skill.select("skill", "rule", "score", "confidence")).groupBy("skill", "rule").agg(F.max(F.struct("score", "confidence")).alias("m")).select("skill", "rule", "m.*")
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("score"), F.desc("confidence"), "rule"))).where(F.col("rank") <= k)
    first = every.orderBy("ord").limit(fallback).select("rule", "ord")
    without = s.select("skill").join(scored.select("skill").distinct(), "skill", "left_anti").crossJoin(F.broadcast(first))
    rest = without.select("skill", "rule", F.lit(0).cast("long").alias("score"), F.row_number().over(Window.partitionBy("skill").orderBy("ord")).alias("rank"))
    return top.select("skill", "rule", "score", "rank").unionByName(rest)


def relevant_diffs(diffs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Diffs of the wanted paths (path, pos) in their order, or all in order of path where none fits."""
    hit = diffs.join(wanted.groupBy("path").agg(F.min("pos").alias("pos")), "path")
    return diffs.withColumn("pos", F.row_number().over(Window.orderBy("path"))) if hit.isEmpty() else hit
