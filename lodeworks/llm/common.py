"""Shared pieces: table access, the shared folder for intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a sieve at most: 16 MB on an executor, whatever the size of the corpus.
SIEVE_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only a session on one machine may go without that setting; it then gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and outlive lost executors.

    Operators drop those that no result reads; the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lodeworks-{uuid.uuid4().hex}"
        self.n = 0
        where, files = self._path(self.root)
        files.mkdirs(where)
        files.deleteOnExit(where)

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still reads."""
        for df in tables:
            where, files = self._path(df._scratch_path)
            files.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of ``df`` already has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieve(spark: SparkSession, keys: DataFrame, hashes: int = 1, most: int = SIEVE_BITS):
    """A test of arrays of int64 hashes that holds for every value of the one column of ``keys``, and for few others.

    A bitmap of 16 bits a key for each of ``hashes`` probes, up to ``most`` bits in all. It is only ever used to
    thin what is shuffled into an exact join with the keys, in the same plan at every size: with more keys it
    fills up, and lets more of the others through. Words of the bitmap that have bits come to the driver.
    """
    key = keys.columns[0]
    n = keys.count()
    bits = min(most, 1 << max(10, (16 * hashes * n).bit_length()))
    probes = [F.pmod(F.shiftrightunsigned(F.col(key), 20 * k), F.lit(bits)) for k in range(hashes)]
    spots = keys.select(F.explode(F.array(*probes)).alias("b")) if hashes > 1 else keys.select(probes[0].alias("b"))
    spots = spots.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    bitmap = np.zeros(bits >> 6, dtype=np.int64)
    bitmap[spots["w"].to_numpy()] = spots["v"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def may_hold(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for k in range(hashes):
            b = ((h.view(np.uint64) >> np.uint64(20 * k)).view(np.int64) if k else h) & (bits - 1)
            out &= (shared.value[b >> 6] >> (b & 63)) & 1 == 1
        return out

    return may_hold


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least id of its component.

    Alternating large-star and small-star steps: each round writes its edges to the shared
    folder, and the loop ends when a round leaves the edges as they were.
    """
    canonical = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.write(edges.where("a <> b").select(*canonical).distinct())

    def seal(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = seal(now)
    if not before.n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        # minima by partial aggregation, joined back: a node with many edges is split where the join is skewed
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after_df = scratch.write(small)
        scratch.drop(now, large)
        now, after = after_df, seal(after_df)
        if tuple(after) == tuple(before):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
