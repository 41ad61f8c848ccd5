"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A word, as the contracts define it. bytes.split() without arguments splits at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="tracemill-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spilled(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: for wide tables, which a checkpoint would keep uncompressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column) -> list:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least index that each of n nodes reaches over the links a-b and those already in root."""
    root = np.arange(n) if root is None else root
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b): component is the least node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014): a logarithmic number of rounds,
    each an aggregation with map-side combine and an equi-join, so a hub is never gathered in one task.
    Lineage is cut every round by a reliable checkpoint. Null or equal ends are no links.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(d: DataFrame):
        return d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
        now = mark(e)
        if now == before:
            break
        before = now
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
