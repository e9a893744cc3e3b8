"""Full-text and vector retrieval over tables: postings, BM25, cosine, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.functions import vectors as v

K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion.
RRF_K = 60


def postings(df: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf) with field weights summed into tf, and (key, n) by ``lengths``."""
    parts = None
    for field, weight in fields.items():
        p = df.select(key, F.explode(t.search_tokens(F.col(field))).alias("term")).groupBy(key, "term").agg((F.count("*") * F.lit(float(weight))).alias("tf"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(key, "term").agg(F.sum("tf").alias("tf")) if len(fields) > 1 else parts


def lengths(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n) number of tokens over all fields; null fields count none."""
    n = sum((F.size(F.coalesce(t.search_tokens(F.col(f)), F.array())) for f in fields), F.lit(0))
    return df.select(key, n.cast("long").alias("n"))


def bm25(df: DataFrame, key: str, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """(key, score) of rows that hold all terms; higher is better, idf floored at 1e-6.

    Only the asked terms are exploded, so the shuffle carries postings of the
    query, not of the corpus; sizes of the corpus are one aggregation.
    """
    terms = sorted({w.lower() for w in terms})
    found = None
    for field, weight in fields.items():
        hit = F.filter(t.search_tokens(F.col(field)), lambda w: w.isin(terms))
        p = df.select(key, F.explode(hit).alias("term")).select(key, "term", F.lit(float(weight)).alias("w"))
        found = p if found is None else found.unionByName(p)
    tf = found.groupBy(key, "term").agg(F.sum("w").alias("tf"))
    sizes = lengths(df, key, list(fields))
    corpus = sizes.agg(F.count("*").alias("big_n"), F.avg("n").alias("avg_n"))
    dfs = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("big_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    return (
        tf.join(F.broadcast(dfs), "term")  # one row per asked term
        .join(sizes, key)
        .crossJoin(F.broadcast(corpus))  # one row
        .groupBy(key)
        .agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
        .where(F.col("hits") == len(terms))
        .select(key, "score")
    )


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in an order whose last key is unique."""
    return df.orderBy(*order).limit(k)


def ranks(df: DataFrame, key: str, score: str) -> DataFrame:
    """(key, rank) with rank from 1 by score, ties by key; for result lists, which are bounded by their k."""
    return df.select(key, F.row_number().over(W.orderBy(F.desc(score), key)).alias("rank"))


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, score) of the reciprocal rank fusion of ranked lists of (key, rank)."""
    allr = lists[0]
    for x in lists[1:]:
        allr = allr.unionByName(x)
    return allr.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def cosine_top(df: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """(key, score): exact cosine of unit vectors with a literal query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(df.select(key, v.dot(v.as_double(F.col(vec)), q).alias("score")), k, F.desc("score"), F.asc(key))


def best_per_group(hits: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(group, best, n, best_item) of scored items; ties take the smaller item."""
    return hits.groupBy(group).agg(F.max(score).alias("best"), F.count("*").alias("n"), F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))["i"].alias("best_item"))


def cap_per_group(df: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows of each group, the first in the order."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
