"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .tokens import U64, mix

_EPS = 1e-9
#: Documents of one source that one task takes through the flight phase at a time.
BLOCK = 50_000
#: Share of the tokens that is selected at least where no total is given.
KEEP = 0.5


def flight(p: list[float], tokens: list[float], coin: list[float]) -> list[float]:
    """The flight phase for a document total and a token total; at most two values stay fractional.

    Three fractional units at a time: the null space of the two constraints over them is a line,
    on which the inclusion probabilities move to one of the ends where one becomes 0 or 1, chosen
    by the coin of the unit that came last, so that the expectation doesn't change.
    """
    p = list(p)
    live: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # the cross product of (1, 1, 1) and the tokens
        u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        forth = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(live, u, strict=True) if x)
        back = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(live, u, strict=True) if x)
        t = forth if coin[i] * (forth + back) < back else -back
        rest = []
        for k, x in zip(live, u, strict=True):
            p[k] += t * x
            if p[k] < _EPS or p[k] > 1 - _EPS:
                p[k] = round(p[k])
            else:
                rest.append(k)
        live = rest
    return p


def landing(p: list[float], tokens: list[float], coin: float) -> list[int]:
    """0 or 1 for each of at most two fractional units, by the coin, each 1 as often as its p says.

    Of all ways to draw them that keep these expectations, it is the one that misses the document and
    token totals least on average: how often both are taken together is the one thing left open, the
    cost is linear in it, so it is at one of its bounds.
    """
    if len(p) < 2:
        return [int(coin < x) for x in p]
    a, b = p
    scale = max(sum(tokens) / 2, 1)

    def miss(x: int, y: int) -> float:
        return abs(x + y - a - b) + abs(x * tokens[0] + y * tokens[1] - a * tokens[0] - b * tokens[1]) / scale

    slope = miss(1, 1) + miss(0, 0) - miss(1, 0) - miss(0, 1)
    both = max(0.0, a + b - 1) if slope > 0 else min(a, b)
    for way, share in (((1, 1), both), ((1, 0), a - both), ((0, 1), b - both)):
        if coin < share:
            return list(way)
        coin -= share
    return [0, 0]


def _uniform(unit: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each unit of a sequence, independent of those of other steps."""
    h = mix(unit.view(U64) ^ mix(np.arange(len(unit), dtype=U64) + U64(step << 40)))
    return (h >> U64(11)).astype(np.float64) / float(1 << 53)


def _flight(t: pa.Table, step: int = 1) -> pa.Table:
    """Units in order of their hash, which is no part of the coins: these are drawn for unit, place and step."""
    order = np.lexsort((t["tokens"].to_numpy(), t["unit"].to_numpy(), t["draw"].to_numpy()))
    t = t.take(pa.array(order))
    p = flight(t["p"].to_pylist(), [float(x) for x in t["tokens"].to_pylist()], _uniform(t["unit"].to_numpy(), step).tolist())
    return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _land(t: pa.Table) -> pa.Table:
    """Flight and landing of what the blocks of one source leave."""
    t = _flight(t, 2)
    p = np.array(t["p"].to_pylist(), dtype=float)
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    p = np.where((p > _EPS) & (p < 1 - _EPS), p, np.round(p))
    if len(left):
        coin = float(_uniform(t["unit"].to_numpy()[left[:1]], 3)[0])
        p[left] = landing(p[left].tolist(), t["tokens"].to_numpy()[left].astype(float).tolist(), coin)
    return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _key(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """What tells documents apart: the id, and without one the source and text."""
    return docs["doc_id"].cast("long"), F.when(docs["doc_id"].isNull(), F.xxhash64(docs["source"].cast("string"), docs["text"].cast("string"))).otherwise(F.lit(0))


def mix_sources(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, tokens: int | None = None, seed: int = 0, block: int = BLOCK, keep: float = KEEP) -> DataFrame:
    """(doc_id, source, tokens, inclusion, shortfall, selected) of every row, so that the selected ones
    hold each source in its target share of tokens.

    ``weights`` are the target shares by source, equal where not given; ``tokens`` is the total to
    select, by default the most for which no source falls short of its share, but ``keep`` of the
    tokens of the weighted sources at least, however small one of them is. A source below its share
    is taken whole, at inclusion 1, and the others make up for what it lacks by their weights;
    shortfall is the tokens that a row's source lacks of its share of the total. A document's
    inclusion probability is its source's target over the source's tokens; tokens are counted as
    words. The cube method makes the number of documents and of tokens drawn from each source equal
    their expectations up to the last two units, which the landing phase draws so that each is
    taken as often as its probability says.

    The flight runs on blocks of a source, then on what the blocks leave (at most two units each).
    A null source is a source like any other, named null. Null and blank texts have no tokens: they
    are balanced by number alone. Very long texts count whole. Rows with a null doc_id are units like
    others. Repeated rows are separate units; ties in order are between equal rows only. A source
    without a weight, or without tokens, has inclusion 0. Only doc_id, source and text are read. An
    empty table gives no rows.
    """
    return _mixed(spark, docs, weights, tokens, seed, block, keep).select("doc_id", "source", "tokens", "inclusion", "shortfall", "selected")


def _mixed(spark, docs, weights, tokens, seed, block, keep) -> DataFrame:
    """As ``mix_sources``, with the second part of the key."""
    scratch = Scratch(spark)
    count = F.size(F.filter(F.split(F.col("text").cast("string"), r"\s+"), lambda w: w != ""))
    doc, other = _key(docs)
    units = docs.select(doc.alias("doc_id"), other.alias("other"), F.col("source").cast("string").alias("source"), F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(count), F.lit(0)).cast("long").alias("tokens"))
    units = scratch.write(units.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "other", "tokens"), F.lit(1 << 52)) / F.lit(float(1 << 52))))
    totals = units.groupBy("source").agg(F.sum("tokens").alias("have"), F.ceil(F.count("*") / F.lit(block)).alias("parts"))
    weight = F.lit(1.0) if weights is None else F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    totals = totals.withColumn("w", F.when(F.col("have") > 0, weight).otherwise(0.0))
    totals = totals_ = scratch.write(totals.withColumn("rate", F.when(F.col("w") > 0, F.col("have") / F.col("w"))))
    weighted = totals.where("w > 0")
    total = F.lit(float(tokens)) if tokens is not None else F.greatest(F.sum("w") * F.min("rate"), F.lit(keep) * F.sum("have"))
    # the level, tokens for a weight of 1, at which the sources not taken whole fill up the total: sources of lower
    # rate are whole, and the first whose rate is not below the level shows it. One row a source, in one order
    rising = Window.orderBy("rate", "source")
    earlier = F.coalesce(F.sum("have").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = weighted.agg(total.alias("total"), F.sum("w").alias("weights"))
    level = weighted.crossJoin(whole).withColumn("level", (F.col("total") - earlier) / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    level = level.where("level <= rate").agg(F.min(F.struct("rate", "source", "level"))["level"].alias("level"))
    totals = totals.crossJoin(level).crossJoin(whole)
    totals = totals.withColumn("inclusion", F.when(F.col("w") > 0, F.coalesce(F.least(F.lit(1.0), F.col("w") * F.col("level") / F.col("have")), F.lit(1.0))).otherwise(0.0))
    short = F.when(F.col("w") > 0, F.greatest(F.lit(0.0), F.col("w") * F.col("total") / F.col("weights") - F.col("have"))).otherwise(0.0)
    rates = scratch.write(totals.select(F.col("source").alias("s"), "inclusion", short.alias("shortfall"), "parts"))
    # the hash of repeated rows is the same; their place in the order tells them apart
    schema = "doc_id long, other long, source string, tokens long, draw double, inclusion double, shortfall double, p double, unit long, part long"
    base = units.join(rates, units["source"].eqNullSafe(rates["s"])).withColumn("p", F.col("inclusion")).withColumn("unit", F.xxhash64("doc_id", "other", F.lit(seed)))
    base = base.withColumn("part", F.pmod(F.xxhash64("doc_id", "other"), F.col("parts")).cast("long")).select(*[c.split()[0] for c in schema.split(", ")])
    flown = scratch.write(base.groupBy("source", "part").applyInArrow(lambda t: _flight(t), schema))
    scratch.drop(units, totals_, rates)
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    # what the blocks of a source leave is a few units a block; it flies and lands in one group
    landed = flown.where(open_).groupBy("source").applyInArrow(lambda t: _land(t), schema)
    done = flown.where(~open_).unionByName(landed)
    return done.withColumn("selected", F.col("p") > 0.5)


def draw(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, tokens: int | None = None, seed: int = 0, block: int = BLOCK, keep: float = KEEP) -> DataFrame:
    """The selected documents, with the columns of ``docs`` and the inclusion probability.

    Of repeated rows of a doc_id all are taken if any is selected, as are equal rows without one. The
    probability's column is inclusion, mix_inclusion where that is taken. Other columns may have any
    name. An empty table stays empty.
    """
    id_, other, p = fresh(docs, "taken_id", "taken_other", "taken_p")
    mixed = _mixed(spark, docs, weights, tokens, seed, block, keep)
    taken = Scratch(spark).write(mixed.where("selected").groupBy(F.col("doc_id").alias(id_), F.col("other").alias(other)).agg(F.max("inclusion").alias(p)))
    name = fresh(docs, "inclusion" if "inclusion" not in {c.lower() for c in docs.columns} else "mix_inclusion")[0]
    own, more = _key(docs)
    # what is taken grows with the corpus, so it is never broadcast: one plan at every size
    joined = docs.join(taken.hint("shuffle_hash"), own.eqNullSafe(taken[id_]) & (more == taken[other]))
    return joined.select(*[docs[c] for c in docs.columns], taken[p].alias(name))
