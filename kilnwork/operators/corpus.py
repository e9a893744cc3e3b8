"""Corpus shapes: lines, segments, abstracts, coverage, duplicates, incremental diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as t


def lines(df: DataFrame, key: str, text: str, least_alnum: int = 0) -> DataFrame:
    """(key, line_no, line) of every line; lines with fewer alphanumerics than asked are dropped."""
    out = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.where(F.length(t.alnum_fold(F.col("line"))) >= least_alnum) if least_alnum else out


def repeated_lines(df: DataFrame, key: str, text: str, times: int = 3, longest: int = 250) -> DataFrame:
    """(key, line, n): short lines that stand at least ``times`` times in one text."""
    x = lines(df, key, text).select(key, F.trim("line").alias("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    return x.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def segments(chunks: DataFrame, doc: str, order: str, label: Column) -> DataFrame:
    """(doc, segment, label, first, last, n): runs of consecutive chunks with one label."""
    w = W.partitionBy(doc).orderBy(order)
    c = chunks.select(doc, order, label.alias("label")).withColumn("_new", (~F.col("label").eqNullSafe(F.lag("label").over(w))).cast("int"))
    c = c.withColumn("segment", F.sum(F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("_new"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return c.groupBy(doc, "segment").agg(F.first("label").alias("label"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def abstract_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id): one abstract per document.

    A chunk typed abstract; else one whose heading is an abstract; else one that
    starts with the word; else the longest of the leading third (at least three
    chunks); ties take the first.
    """
    w = W.partitionBy("doc_id").orderBy("ord", "chunk_id")
    words = F.size(F.split(F.trim("text"), "\\s+"))
    c = chunks.select("doc_id", "chunk_id", "ord", "section_type", "section_path_json", "text").withColumn("_w", words)
    total = F.sum("_w").over(W.partitionBy("doc_id"))
    ran = F.coalesce(F.sum("_w").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(w)
    c = c.withColumn("_lead", (ran * 3 < total) | (n <= 3))
    tier = (
        F.when(F.col("section_type") == "abstract", 1)
        .when(F.lower("section_path_json").rlike("\\babstract\\b"), 2)
        .when(F.lower(F.ltrim("text")).startswith("abstract"), 3)
        .when(F.col("_lead"), 4)
        .otherwise(5)
    )
    rank = F.struct(tier.alias("t"), F.when(tier == 4, -F.col("_w")).otherwise(0).alias("w"), "ord", "chunk_id")
    return c.groupBy("doc_id").agg(F.min(rank)["chunk_id"].alias("chunk_id"), F.min(rank)["t"].alias("tier"))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, unchanged, replaced or deleted, from two listings with content hashes."""
    j = old.select(key, F.col(digest).alias("_a")).join(new.select(key, F.col(digest).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("replaced")
    return j.select(key, change.alias("change"))


def coverage(chunks: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, addressable, covered, ratio): chunks that count and how many of them are used."""
    ok = chunks.where(~F.coalesce("is_boilerplate", F.lit(False)) & ~F.coalesce("section_type", F.lit("body")).isin(t.SKIPPED_SECTIONS))
    mark = used.select("chunk_id", F.lit(1).alias("_u")).distinct()
    j = ok.select("chunk_id", "doc_id").distinct().join(mark, "chunk_id", "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("addressable"), F.count("_u").alias("covered")).withColumn("ratio", F.round(F.col("covered") / F.col("addressable"), 6))
