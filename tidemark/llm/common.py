"""Helpers shared by the operators for training corpora."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names; a temporary one only in local mode, where all tasks share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lineage ends, a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0).cast("long")) + 16
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8)


def bounded(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df, which must be cheap to read (cut), with a broadcast hint if its rows take `most` bytes or fewer, summed; else as it is."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= most else df


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with another text; used beside doc_id, never in its place."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; lower() alone would also fold other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def documents_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; columns that a caller's table has besides are left out, so no name can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long, undirected -> (node, component) for every node that has an edge to another; component: its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014), each cut by a checkpoint; no node's
    neighbours are gathered in one place, only their minimum. Self-loops, repeated edges and an empty table are allowed.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = big.join(low, F.col("u") == F.col("k"))
        e = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("k", "m")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
