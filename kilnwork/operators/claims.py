"""Claims extracted from papers: identity, grounding, registry and pivot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.runtime import join_measured, small_enough


def registry(points: DataFrame) -> DataFrame:
    """(property_norm, n_points, unit): claims not rejected and their most common unit, ties by name."""
    ok = points.where(~F.col("verification_status").eqNullSafe("rejected") & F.col("property_norm").isNotNull())
    units = ok.where("unit is not null and unit <> ''").groupBy("property_norm", "unit").agg(F.count("*").alias("n"))
    mode = units.groupBy("property_norm").agg(F.min(F.struct((-F.col("n")).alias("n"), "unit"))["unit"].alias("unit"))
    return ok.groupBy("property_norm").agg(F.count("*").alias("n_points")).join(mode, "property_norm", "left")


def grounded(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, is_figure, grounded): whether the folded quote stands in the folded text of its chunk."""
    j = points.join(chunks, "chunk_id", "left")
    return j.select(
        "claim_id", (F.col("value_type") == "figure").alias("is_figure"), F.coalesce(t.grounding_fold(F.col("text")).contains(t.grounding_fold(F.col("grounding_quote"))), F.lit(False)).alias("grounded")
    )


def cells(points: DataFrame) -> DataFrame:
    """(subject_norm, property_norm, n_values, conflict, cell) of verified claims; values by their first claim."""
    ok = points.where("verification_status = 'verified' and subject_norm is not null and property_norm is not null")
    one = ok.groupBy("subject_norm", "property_norm", "value_text").agg(F.min("claim_id").alias("first"))
    return one.groupBy("subject_norm", "property_norm").agg(
        F.count("*").alias("n_values"),
        (F.count("*") > 1).alias("conflict"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "value_text"))), lambda s: s["value_text"]), " | ").alias("cell"),
    )


def consolidate(points: DataFrame, properties: list[str]) -> DataFrame:
    """Subject by property table of the asked properties; rows without any value do not appear."""
    return cells(points.where(F.col("property_norm").isin(properties))).groupBy("subject_norm").pivot("property_norm", properties).agg(F.first("cell")).orderBy("subject_norm")


def sweep(chunks: DataFrame, needles: list[str], most: int) -> DataFrame:
    """(chunk_id, doc_id, needle): chunks that mention a phrasing, the first needle in order wins."""
    low = F.lower("text")
    hit = F.lit(None).cast("string")
    for n in reversed(needles):
        hit = F.when(low.contains(n), F.lit(n)).otherwise(hit)
    return chunks.select("chunk_id", "doc_id", hit.alias("needle")).where("needle is not null").orderBy("doc_id", "chunk_id").limit(most)


def add_points(known: DataFrame, new: DataFrame) -> DataFrame:
    """The claims after an idempotent insert: of one id the known row stays, then the first new one."""
    fresh = new.dropDuplicates(["claim_id"]).join(known.select("claim_id"), "claim_id", "left_anti")
    return known.unionByName(fresh)


def quoted(docs: DataFrame, items: DataFrame, fold, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item) of the items that stand whole in a document, both folded.

    An item of five words and more is looked up by the hash of its second to fourth
    word among those of the documents' runs of three words, and a hit is verified
    on the whole item, which may begin and end inside a word; only hashes are
    joined, and texts come back for the hits.  Shorter items are tried on every
    document.  Null and empty items and texts give nothing; repeated rows count once.
    """
    items = items.select(F.col(item_col), fold(F.col(text_col)).alias("_q")).where("length(_q) > 0").distinct()
    docs = docs.select(F.col(id_col), fold(F.col(text_col)).alias("_t")).where("length(_t) > 0").withColumn("_k", F.xxhash64("_t"))
    size = F.size(F.split("_q", " "))
    asked = items.where(size >= 5).withColumn("_w", F.split("_q", " ")).select(item_col, "_q", F.expr("xxhash64(_w[1], _w[2], _w[3])").alias("_h"))
    runs = F.expr("if(size(_w) >= 3, array_distinct(transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))), cast(array() as array<bigint>))")
    held = docs.withColumn("_w", F.split("_t", " ")).select(id_col, "_k", F.explode(runs).alias("_h"))
    met = join_measured(held, asked, "_h").select(id_col, "_k", item_col, "_q").distinct()
    out = met.join(docs, [id_col, "_k"]).where(F.col("_t").contains(F.col("_q"))).select(id_col, item_col)
    few = items.where(size < 5)
    if few.head(1):
        out = out.unionByName(docs.join(F.broadcast(few) if small_enough(few) else few, F.col("_t").contains(F.col("_q"))).select(id_col, item_col))
    return out.distinct()
