"""Writers by key: upsert, replace per document, cascades, exports, atomic publishing.

A table is a folder of parquet.  A writer computes the whole new state as a
DataFrame, writes it beside the old one and swaps the folders, so readers see
either state and a lost job leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows, the last of each key by all columns."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replaced_per(old: DataFrame, new: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """All rows of the touched keys are dropped, then the new rows come in."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of the keys that are gone: a cascade over every table that has the key."""
    dead = gone.select(key).distinct()
    return {name: df.join(dead, key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def edges_without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges neither end of which is gone."""
    dead = gone.select("id").distinct()
    return edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent insert: rows whose key is known are ignored."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def compacted(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last line of each key of an append-only log."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*")


def publish(df: DataFrame, path: str) -> None:
    """Write a state and swap it in: the old folder is renamed away only when the new one is complete."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(jvm.java.net.URI.create(path), conf)
    P = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    had = fs.exists(P(path))
    if had:
        fs.rename(P(path), P(old))
    if not fs.rename(P(fresh), P(path)):
        if had:
            fs.rename(P(old), P(path))
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(P(old), True)


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines ledger."""
    rows.write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``; a file system that does not answer raises."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Upsert into a published table, or make it where there is none; a table that cannot be read is left as it is and the error rises."""
    publish(upserted(spark.read.parquet(path), new, keys) if exists(spark, path) else new.dropDuplicates(keys), path)


def bibtex(works: DataFrame) -> DataFrame:
    """(doi, entry): one BibTeX entry per work; the key is the year and a hash of the DOI."""
    key = F.concat(F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("_"), F.substring(F.sha1(F.col("doi").cast("binary")), 1, 6))
    body = [F.lit("@article{"), key, F.lit(", title={"), F.col("title"), F.lit("}, journal={"), F.col("journal"), F.lit("}, doi={"), F.col("doi"), F.lit("}}")]
    return works.select("doi", F.concat(*body).alias("entry"))


def navigation(categories: DataFrame) -> DataFrame:
    """(parent_id, children): a category tree as adjacency lists, children by sort order, then name."""
    c = categories.select("category_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.coalesce("sort_order", F.lit(0)).alias("o"), F.lower("name").alias("n")).distinct()
    return c.groupBy("parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "n", "category_id"))), lambda s: s["category_id"]).alias("children"))
