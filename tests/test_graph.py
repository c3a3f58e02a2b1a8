"""Graph queries and operators on graphs that the driver's small tables don't hold."""

import os
import random

from lodeworks.operators import graph
from lodeworks.plans import catalogue

from . import oracle

SF = "/root/testdata/sf0.001"


def _with(spark, folder, **tables):
    """A copy of the small tables in which some are replaced."""
    for t in oracle.TABLES:
        if t in tables:
            tables[t].coalesce(1).write.parquet(f"{folder}/{t}.parquet.d")
            part = next(f for f in os.listdir(f"{folder}/{t}.parquet.d") if f.endswith(".parquet"))
            os.rename(f"{folder}/{t}.parquet.d/{part}", f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_affected_files_reach_as_far_as_the_sql(spark, tmp_path):
    # 2^k depends on 2^(k - 1): a chain of 62 steps, of which the SQL follows 60
    chain = spark.createDataFrame([(1 << k,) for k in range(63)], "p_partkey long")
    sf = _with(spark, tmp_path, part=chain)
    got = oracle.spark_rows(catalogue.QUERIES["affected_files_in_cycles"](spark, sf))
    assert got == oracle.sql_rows(sf, catalogue.ORACLE_SQL["affected_files_in_cycles"])
    assert len(got[1]) == 61


def _plain_roots(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        todo = [] if start in root else [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return root


def test_components_of_chains_stars_and_copies(spark):
    rng = random.Random(3)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("z", f"s{i:02}") for i in range(60)] + [(f"r{rng.randrange(200)}", f"r{rng.randrange(200)}") for _ in range(110)] + [("loop", "loop")]
    e = spark.createDataFrame(pairs + pairs[:40] + [(b, a) for a, b in pairs[:40]] + [(None, "c000")], "src string, dst string")
    want = _plain_roots([p for p in pairs if p[0] != p[1]])
    nodes = spark.createDataFrame([(x,) for x in [*want, "loop", "alone"]], "id string")
    assert {r.id: r.root for r in graph.components(spark, None, e).collect()} == want
    got = graph.components(spark, nodes, e, few=0).collect()
    assert len(got) == len(want) + 2 and {r.id: r.root for r in got} == want | {"loop": "loop", "alone": "alone"}
    none = graph.components(spark, nodes, e.where("false")).collect()
    assert len(none) == len(want) + 2 and all(r.id == r.root for r in none)


def test_components_handle_all_edges_once(spark, monkeypatch):
    # a dense graph of parts and suppliers: rows of edges written in all rounds grow with the edges, and are not written again each round
    rng = random.Random(5)
    pairs = sorted({(f"p{rng.randrange(400)}", f"s{rng.randrange(40)}") for _ in range(6000)})
    nodes, write, rows = len({x for p in pairs for x in p}), graph.Scratch.write, []

    def counted(self, df):
        out = write(self, df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph.Scratch, "write", counted)
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = graph.components(spark, graph.nodes_of(e), e, few=0).collect()
    assert {r.id: r.root for r in got} == _plain_roots(pairs)
    assert sum(rows) < 1.5 * len(pairs) + 10 * nodes
