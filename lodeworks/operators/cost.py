"""Model-cost estimates: characters to tokens to dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(chars: Column, per_token: float = 4.0) -> Column:
    return F.ceil(chars / F.lit(per_token)).cast("long")


def usd(input_tokens: Column, output_tokens: Column, price: dict) -> Column:
    """Rounded to six places, half to even."""
    return F.bround(input_tokens / 1_000_000 * F.lit(price["input_per_1m"]) + output_tokens / 1_000_000 * F.lit(price["output_per_1m"]), 6)


def output_chars(name: Column | str, evidence: Column) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    bonus = sum(F.when(n.contains(word), extra).otherwise(0) for word, extra in (("overview", 800), ("architecture", 600), ("flow", 400)))
    return (F.lit(1800) + bonus + evidence * 160).cast("long")


def estimate(calls: DataFrame, price: dict) -> DataFrame:
    """calls (name, input_chars, output_chars) with their tokens and dollars."""
    i, o = tokens(F.col("input_chars"), price["chars_per_token"]), tokens(F.col("output_chars"), price["chars_per_token"])
    return calls.select("name", F.col("input_chars").cast("long").alias("input_chars"), i.alias("input_tokens"), F.col("output_chars").cast("long").alias("output_chars"), o.alias("output_tokens"), usd(i, o, price).alias("estimated_usd"))


def patch(per_item: DataFrame) -> DataFrame:
    """What patching sections costs beside rewriting: shares of each item, rounded item by item."""
    up = lambda c, share: F.ceil(F.col(c) * share).cast("long").alias(c)
    return per_item.select("name", up("input_chars", 0.45), up("input_tokens", 0.45), up("output_chars", 0.35), up("output_tokens", 0.35), F.bround(F.col("estimated_usd") * 0.4, 6).alias("estimated_usd"))


def total(per_item: DataFrame, strategy: str) -> DataFrame:
    """One row of sums; zeros where there are no items."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per_item.agg(F.lit(strategy).alias("strategy"), F.count("*").alias("items"), s("input_chars"), s("input_tokens"), s("output_chars"), s("output_tokens"), F.bround(F.coalesce(F.sum("estimated_usd"), F.lit(0.0)), 6).alias("estimated_usd"))


def diff_chars(changed: DataFrame, affected: DataFrame) -> DataFrame:
    """One row: characters that a change brings into the context."""
    n = lambda df, c: df.agg(F.coalesce(F.sum(F.length("path")), F.lit(0)).alias(c))
    return n(changed, "c").crossJoin(n(affected, "a")).select((F.lit(600) + 3 * F.col("c") + F.col("a")).alias("diff_chars"))


def payload(skills: DataFrame, items_of: dict[str, DataFrame]) -> DataFrame:
    """(name, kind, items, chars): for each skill (name, source_evidence), the items (key, evidence, chars) of
    each kind that share evidence with it, in order of key, and the characters they take."""
    want = skills.select("name", F.explode("source_evidence").alias("path")).distinct()
    out = None
    for kind, items in items_of.items():
        has = items.select("key", "chars", F.explode("evidence").alias("path"))
        met = want.join(has, "path").select("name", "key", "chars").distinct()
        one = met.groupBy("name").agg(F.array_sort(F.collect_set("key")).alias("items"), F.sum("chars").alias("chars")).select("name", F.lit(kind).alias("kind"), "items", "chars")
        out = one if out is None else out.unionByName(one)
    return out


def calls(skills: DataFrame, items_of: dict[str, DataFrame], shared_chars: int) -> DataFrame:
    """(name, input_chars, output_chars) of the call for each skill (name, source_evidence, chars): ``shared_chars``,
    the skill itself, and its payload."""
    more = payload(skills, items_of).groupBy("name").agg(F.sum("chars").alias("more"))
    rows = skills.join(more, "name", "left")
    return rows.select("name", (F.lit(shared_chars) + F.col("chars") + F.coalesce("more", F.lit(0))).cast("long").alias("input_chars"), output_chars("name", F.size("source_evidence")).alias("output_chars"))
