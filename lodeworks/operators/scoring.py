"""Priority refinement from content and from the place in the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def refine_graph(files: DataFrame, degree: DataFrame, ranks: DataFrame, entry: DataFrame, hub: DataFrame) -> DataFrame:
    """``files`` (path, score) with the score moved by degree, PageRank, entry points, hubs and isolation."""
    side = degree.join(ranks.select("id", "rank"), "id", "left").join(entry.select("id", F.lit(True).alias("is_entry")), "id", "left").join(hub.select("id", F.lit(True).alias("is_hub")), "id", "left")
    j = files.join(side, files["path"] == side["id"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    i, o, r = n(F.col("in_degree")), n(F.col("out_degree")), F.coalesce("rank", F.lit(0.0))
    moved = F.col("score") + 3 * i + F.bround(r * 50, 0) + flag(F.col("is_entry"), 20) + flag(F.col("is_hub"), 15) - F.when((i == 0) & (o == 0), 10).otherwise(0)
    reasons = F.filter(
        F.array(
            F.when(i > 0, F.concat(F.lit("in_degree:"), i.cast("string"))),
            F.when(r > 0, F.format_string("pagerank:%.3f", r)),
            F.when(F.col("is_entry"), "import-graph entrypoint"),
            F.when(F.col("is_hub"), "import-graph hub"),
            F.when((i == 0) & (o == 0), "isolated file"),
        ),
        lambda x: x.isNotNull(),
    )
    return j.select(*[files[c] for c in files.columns if c != "score"], moved.cast("int").alias("score"), reasons.alias("graph_reasons"))


def content_role(r: Column | None = None) -> Column:
    """The role a file's content gives it, null for none. Reads the columns of an extracted record."""
    names = F.array_union(F.transform("methods", lambda m: F.lower(F.element_at(F.split(m, r"\.", 2), -1))), F.transform("function_details", lambda f: F.lower(f["name"])))
    crud = F.size(F.array_intersect(names, F.array(*map(F.lit, sorted(V.CRUD))))) >= 2
    service = F.exists("class_details", lambda c: c["name"].endswith("Service"))
    model = F.exists("class_details", lambda c: F.exists(c["bases"], lambda b: F.lower(b).rlike("model|schema")))
    return (
        F.when(F.size("routes") > 0, "route")
        .when(service | crud, "service")
        .when((F.size("models_or_schemas") > 0) | model, "model")
        .when(F.array_contains("notes", "has_main_guard"), "entrypoint")
        .when(F.size("functions") >= 2, "utility")
    )


_BOOSTS = dict(utility=8, model=16, service=18, entrypoint=20, route=25)
_SIGNALS = {"route": "route definitions", "service": "service methods", "model": "model/schema", "entrypoint": "main guard", "utility": "exported helpers"}


def content_reason(role: Column) -> Column:
    return F.coalesce(*[F.when(role == k, F.lit(f"content signal: {v}")) for k, v in _SIGNALS.items()])


def content_boost(role: Column) -> Column:
    base = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in _BOOSTS.items()], F.lit(0))
    n = lambda c, cap: F.least(F.size(c), F.lit(cap))
    density = n("call_targets", 8) + n("type_references", 4) + n("data_flow_edges", 4) + F.size("dynamic_imports") * 2 + F.when(F.size("raised_exceptions") > 0, 1).otherwise(0)
    return base + F.least(density, F.lit(12))


def refine_content(files: DataFrame) -> DataFrame:
    """Files with records: role and score after what the content says; only source, utility and
    entrypoint give way to the role of the content."""
    role = content_role()
    f = files.withColumn("content_role", role).withColumn("boost", content_boost(F.col("content_role")))
    over = F.col("content_role").isNotNull() & F.col("role").isin("source", "utility", "entrypoint")
    more = F.filter(F.array(F.when(over, F.concat(F.lit("content role: "), F.col("content_role"))), content_reason(F.col("content_role")), F.when(F.col("boost") > 0, F.concat(F.lit("content signal boost:"), F.col("boost").cast("string")))), lambda x: x.isNotNull())
    return f.withColumn("role", F.when(over, F.col("content_role")).otherwise(F.col("role"))).withColumn("score", F.col("score") + F.col("boost")).withColumn("reasons", F.array_distinct(F.concat("reasons", more)))
