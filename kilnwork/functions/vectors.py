"""Vector functions as columns, in double precision and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean of the vectors of each key at length one, by position, so that the aggregation is partial.

    Columns: key, vec (array<double>).
    """
    long = df.select(key, F.posexplode(as_double(F.col(vec))).alias("_at", "_x"))
    means = long.groupBy(key, "_at").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("_v"))
    return packed.select(key, unit(F.col("_v")).alias(vec))


def hashed_tokens(text: Column, dims: int = 128) -> Column:
    """Sparse hash embedding of a text as an array of (dimension, value), not normalised.

    A token adds 1 at h mod dims and +-1, by bit 4 of h, at (h >> 8) mod dims,
    with h the first eight hex digits of its md5.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_]+)"), 1), F.lower)
    h = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long")
    hashed = F.transform(tokens, h)
    one = F.transform(hashed, lambda x: F.struct(F.pmod(x, F.lit(dims)).alias("i"), F.lit(1.0).alias("x")))
    two = F.transform(
        hashed, lambda x: F.struct(F.pmod(F.shiftright(x, 8), F.lit(dims)).alias("i"), F.when(F.shiftright(x, 4).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("x"))
    )
    return F.concat(one, two)


def hash_embedding(df: DataFrame, key: str, text: str, dims: int = 128) -> DataFrame:
    """(key, i, x): the non-zero components of the unit hash embedding of each text."""
    long = df.select(key, F.explode(hashed_tokens(F.col(text), dims)).alias("_t")).groupBy(key, F.col("_t.i").alias("i")).agg(F.sum("_t.x").alias("x"))
    size = long.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n")).where("_n > 0")
    return long.where("x <> 0").join(size, key).select(key, "i", (F.col("x") / F.col("_n")).alias("x"))
