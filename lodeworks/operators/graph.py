"""Dependency graphs: degrees, hubs, components, PageRank, reachability.

A graph is ``nodes(id)`` and ``edges(src, dst)``. Loops keep their state in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Scratch


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edges without loops; with ``nodes``, only those between known nodes."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    if nodes is not None:
        e = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.select("src", "dst")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    all_ = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return all_.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def hubs(degree: DataFrame, n: int = 20) -> DataFrame:
    """The n most depended-on nodes, with their position; in a small graph, all of them."""
    top = degree.orderBy(F.desc("in_degree"), F.desc("out_degree"), "id").limit(n)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("in_degree"), F.desc("out_degree"), "id")))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def entry_points(degree: DataFrame) -> DataFrame:
    return degree.where("in_degree = 0 and out_degree > 0").select("id")


def dependencies(edges: DataFrame) -> DataFrame:
    """(id, internal_dependencies), sorted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("internal_dependencies"))


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """(id, importers), sorted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("importers"))


def _hashed(spark: SparkSession, scratch: Scratch, pairs: DataFrame, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(id, h) of all ends and (u, v) of all pairs, by a 64-bit hash that no two ends share: another seed until that holds."""
    for seed in range(tries):
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: E731, B023
        ids = scratch.write(pairs.select(F.explode("ends").alias("id")).distinct().select("id", number(F.col("id")).alias("h")))
        n, distinct = ids.agg(F.count("*"), F.count_distinct("h")).first()
        if n == distinct:
            return ids, scratch.write(pairs.select(number(F.col("ends")[0]).alias("u"), number(F.col("ends")[1]).alias("v")))
        scratch.drop(ids)
    raise RuntimeError("no hash tells all ids apart")


def _roots(scratch: Scratch, pairs: DataFrame, hops: int = 64) -> DataFrame:
    """(u, top): every node takes its least neighbour for parent; top is the root of its tree.

    Parents form cycles of two nodes only, whose lesser is the root. Every tree has two nodes at least.
    """
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    tree = scratch.write(both.groupBy("u").agg(F.min("v").alias("top")))
    for hop in range(hops):
        up = tree.select(F.col("u").alias("top"), F.col("top").alias("next"))
        back = F.when(F.col("next") == F.col("u"), F.least("u", "top")).otherwise(F.col("top")) if not hop else F.col("next")
        new = scratch.write(tree.join(up, "top").select("u", back.alias("top"), (F.lit(not hop) | (F.col("next") != F.col("top"))).alias("moved")))
        scratch.drop(tree)
        tree = new
        if tree.where("moved").isEmpty():
            return tree.select("u", "top")
    raise RuntimeError("trees did not settle")


def _joined(pairs: list) -> list:
    """(u, top) of the ends of a few pairs, by union-find."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        top[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(top)]


def components(spark: SparkSession, nodes: DataFrame | None, edges: DataFrame, rounds: int = 50, few: int = 1 << 16) -> DataFrame:
    """(id, root): root is the least id of the undirected component; without ``nodes``, of the ends of edges.

    Ids become 64-bit numbers. A round joins every node to its least neighbour, which at least halves the
    nodes, and keeps the distinct edges between the trees so made; the last ``few`` edges are joined on the driver.
    Edges need not be distinct. Only the first round handles all of them.
    """
    scratch = Scratch(spark)
    ids, now = _hashed(spark, scratch, edges.where("src <> dst").select(F.array("src", "dst").alias("ends")))
    steps = []
    for _ in range(rounds):
        if len(last := now.limit(few + 1).collect()) <= few:
            break
        top = _roots(scratch, now)
        steps.append(top)
        near = now.join(top, "u").select(F.col("top").alias("a"), F.col("v").alias("u"))
        far = near.join(top, "u").where("a <> top")
        after = scratch.write(far.select(F.greatest("a", "top").alias("u"), F.least("a", "top").alias("v")).distinct())
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    whole = spark.createDataFrame(_joined(last), "u long, top long")
    for step in reversed(steps):
        whole = step.join(whole.select(F.col("u").alias("top"), F.col("top").alias("t")), "top", "left").select("u", F.coalesce("t", "top").alias("top"))
    placed = scratch.write(ids.join(whole.withColumnRenamed("u", "h"), "h").select("id", "top"))
    # minima by partial aggregation, joined back, so that a large component is never one task's
    rooted = placed.join(placed.groupBy("top").agg(F.min("id").alias("root")), "top").select("id", "root")
    return rooted if nodes is None else nodes.join(rooted, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def clusters(component: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, files): members in order; the larger cluster first, then the lesser first member."""
    groups = component.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("files")).where(F.size("files") >= least)
    return groups.select(F.row_number().over(Window.orderBy(F.desc(F.size("files")), F.col("files")[0])).alias("cluster"), "files")


def cluster_names(cluster: DataFrame) -> DataFrame:
    """``clusters`` with a name: the folders that all share, else the commonest folder."""
    files = cluster.select("cluster", F.posexplode("files").alias("pos", "path"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    parts = files.select("cluster", "pos", folder.alias("folder"), F.posexplode_outer(F.when(folder != "", F.split(folder, "/")).otherwise(F.array().cast("array<string>"))).alias("i", "part"))
    n = cluster.select("cluster", F.size("files").alias("n"))
    shared = parts.where("part is not null").groupBy("cluster", "i").agg(F.count("*").alias("c"), F.count_distinct("part").alias("d"), F.min("part").alias("part")).join(n, "cluster")
    good = shared.withColumn("ok", F.min(F.when((F.col("c") == F.col("n")) & (F.col("d") == 1), 1).otherwise(0)).over(Window.partitionBy("cluster").orderBy("i"))).where("ok = 1")
    common = good.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "/").alias("common"))
    folders = files.withColumn("folder", folder).where("folder <> ''").groupBy("cluster", "folder").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    modal = folders.groupBy("cluster").agg(F.min(F.struct(-F.col("c"), "p", "folder")).alias("m")).select("cluster", F.col("m.folder").alias("modal"))
    return cluster.join(common, "cluster", "left").join(modal, "cluster", "left").select("cluster", "files", F.coalesce("common", "modal", F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))).alias("name"))


def pagerank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) after a fixed number of rounds; the mass of nodes without edges spreads evenly.

    A round adds the same amount to every node and damps what flows along edges, so the ranks are a
    combination of the vectors M^k 1, M being the flow matrix. These need no total of the round
    before: each is one join and one aggregation of what is not zero yet, and the walk ends early
    where a vector vanishes. The amounts follow on the driver from one sum a vector.
    """
    scratch = Scratch(spark)
    out = edges.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("out"))
    links = scratch.write(edges.join(out, F.col("src") == F.col("s")).select("src", "dst", "out"))
    state = scratch.write(nodes.select("id").distinct().join(links.select(F.col("src").alias("id")).distinct().withColumn("flows", F.lit(True)), "id", "left"))
    n = state.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    now = state.select("id", F.lit(1.0).alias("v"))
    vectors = now.select("id", F.lit(0).alias("k"), "v")
    for k in range(1, rounds + 1):
        now = scratch.write(links.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("v") / F.col("out")).alias("v")))
        if now.isEmpty():
            break
        vectors = vectors.unionByName(now.select("id", F.lit(k).alias("k"), "v"))
    sunk = dict(vectors.join(state.where("flows is null"), "id", "left_semi").groupBy("k").agg(F.sum("v")).collect())
    weights = [1 / n]
    for _ in range(rounds):
        lost = sum(w * sunk.get(k, 0.0) for k, w in enumerate(weights))
        weights = [(1 - damping) / n + damping * lost / n, *(damping * w for w in weights)]
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1)
    return vectors.groupBy("id").agg(F.sum(weight * F.col("v")).alias("rank"))


def reachable_from(spark: SparkSession, seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, depth) of all that depend on the seeds, directly or not, and of the seeds themselves.

    Edges point from the dependent to what it uses. They are written once; each round joins only the
    last frontier. Chains of more than ``rounds`` raise, they are not cut.
    """
    scratch = Scratch(spark)
    edges = scratch.write(edges.select("src", "dst"))
    seen = frontier = scratch.write(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    layers = [seen._scratch_path]
    for depth in range(1, rounds + 1):
        step = edges.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        frontier = scratch.write(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        # one scan of all layers: a union of one scan each would make the plan of every round longer
        layers.append(frontier._scratch_path)
        seen = spark.read.schema(frontier.schema).parquet(*layers)
    else:
        raise RuntimeError(f"dependencies reach further than {rounds} steps")
    return seen


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, entry points, leaves, isolated nodes."""
    d = degrees(nodes, edges)
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("internal_edges"), F.count_if(F.expr("in_degree = 0 and out_degree > 0")).alias("entry_points"), F.count_if(F.expr("in_degree = 0")).alias("leaves"), F.count_if(F.expr("in_degree = 0 and out_degree = 0")).alias("isolated"))
