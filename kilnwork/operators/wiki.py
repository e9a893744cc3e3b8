"""Wiki pages over a corpus: evidence, links, grounding, recall, refinement, navigation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as t


def co_evidence(evidence: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared): pages that rest on the same documents; pairs a < b, counted per document once."""
    m = evidence.select("page_id", "doc_id").distinct()
    j = m.select("doc_id", F.col("page_id").alias("a")).join(m.select("doc_id", F.col("page_id").alias("b")), "doc_id").where("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def see_also(page: str, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(page_id): pages linked from, linked to, or resting on a document of the page, itself left out."""
    out = links.where(F.col("src") == page).select(F.col("dst").alias("page_id"))
    inn = links.where(F.col("dst") == page).select(F.col("src").alias("page_id"))
    docs = evidence.where(F.col("page_id") == page).select("doc_id").distinct()
    co = evidence.join(docs, "doc_id", "left_semi").select("page_id")
    return out.unionByName(inn).unionByName(co).distinct().where(F.col("page_id") != page)


def quote_found(quote: Column, source: Column) -> Column:
    """Whether a quote stands in its source: folded, or without any blanks if it has at least 12 characters."""
    tight = lambda c: F.regexp_replace(t.grounding_fold(c), "\\s", "")
    return F.coalesce(t.grounding_fold(source).contains(t.grounding_fold(quote)) | ((F.length(tight(quote)) >= 12) & tight(source).contains(tight(quote))), F.lit(False))


def grounding(sentences: DataFrame, evidence: DataFrame, window: int = 2) -> DataFrame:
    """(page_id, near, resolved, passed): share of sentences within ``window`` of a marker in their paragraph, share of markers with evidence.

    ``sentences`` has page_id, par, ord, text; a page without sentences or
    markers counts as one; passed needs .85 and .95.
    """
    mark = F.regexp_extract_all("text", F.lit("\\[\\^(e[0-9]+)\\]"), 1)
    s = sentences.withColumn("_m", mark)
    w = W.partitionBy("page_id", "par").orderBy("ord").rowsBetween(-window, window)
    near = s.withColumn("_near", F.max((F.size("_m") > 0).cast("int")).over(w)).groupBy("page_id").agg(F.avg("_near").alias("near"))
    used = s.select("page_id", F.explode("_m").alias("marker")).distinct()
    have = evidence.select("page_id", "marker", F.lit(1).alias("_ok")).distinct()
    res = used.join(have, ["page_id", "marker"], "left").groupBy("page_id").agg(F.avg(F.coalesce("_ok", F.lit(0))).alias("resolved"))
    j = near.join(res, "page_id", "left").select("page_id", F.round("near", 6).alias("near"), F.round(F.coalesce("resolved", F.lit(1.0)), 6).alias("resolved"))
    return j.withColumn("passed", (F.col("near") >= 0.85) & (F.col("resolved") >= 0.95))


def people_recall(expected: DataFrame, found: DataFrame, col: str) -> DataFrame:
    """(n, hit, recall) of expected people among the found ones, by last name and initial."""
    e = expected.select(t.last_initial(F.col(col)).alias("k")).where("k is not null").distinct()
    f = found.select(t.last_initial(F.col(col)).alias("k"), F.lit(1).alias("_h")).distinct()
    return e.join(f, "k", "left").agg(F.count("*").alias("n"), F.count("_h").alias("hit")).select("n", "hit", F.when(F.col("n") > 0, F.round(F.col("hit") / F.col("n"), 6)).alias("recall"))


def refine_candidates(snapshots: DataFrame, live: DataFrame, ratio: float = 1.5, delta: int = 6) -> DataFrame:
    """(slug, then, now): pages whose live evidence has outgrown the last committed snapshot (slug, n, at)."""
    last = snapshots.groupBy("slug").agg(F.max(F.struct("at", "n"))["n"].alias("then"))
    j = last.join(live.select("slug", F.col("n").alias("now")), "slug")
    return j.where((F.col("now") >= ratio * F.col("then")) | (F.col("now") - F.col("then") >= delta))


def mentioned_artifacts(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """(chunk_id, kind, number, caption): figures, tables and schemes a chunk names, joined with the captions of its document."""
    hits = F.regexp_extract_all("text", F.lit("(?i)\\b((?:fig(?:ure)?s?|tables?|schemes?)\\.? *[0-9]+)"), 1)
    m = chunks.select("chunk_id", "doc_id", F.explode(F.array_distinct(hits)).alias("h"))
    low = F.lower("h")
    kind = F.when(low.startswith("fig"), "figure").when(low.startswith("table"), "table").otherwise("scheme")
    m = m.select("chunk_id", "doc_id", kind.alias("kind"), F.regexp_extract("h", "([0-9]+)", 1).cast("int").alias("number")).distinct()
    first = captions.groupBy("doc_id", "kind", "number").agg(F.min(F.struct("char_start", "caption"))["caption"].alias("caption"))
    return m.join(first, ["doc_id", "kind", "number"]).select("chunk_id", "kind", "number", "caption")


def navigation_errors(groups: DataFrame, pages: DataFrame, deepest: int = 3) -> DataFrame:
    """(error, item) of a navigation (group_id, parent_id, page_id): unknown pages, pages in several groups, empty groups, too deep."""
    from kilnwork.operators.forest import hierarchy

    named = groups.where("page_id is not null")
    unknown = named.join(pages.select("page_id"), "page_id", "left_anti").select(F.lit("unknown page").alias("error"), F.col("page_id").alias("item"))
    twice = named.groupBy("page_id").agg(F.count_distinct("group_id").alias("k")).where("k > 1").select(F.lit("page in several groups").alias("error"), F.col("page_id").alias("item"))
    parents = groups.select(F.col("parent_id").alias("group_id")).where("group_id is not null").distinct()
    empty = groups.groupBy("group_id").agg(F.count("page_id").alias("k")).where("k = 0").join(parents, "group_id", "left_anti").select(F.lit("empty group").alias("error"), F.col("group_id").alias("item"))
    tree = hierarchy(groups.select("group_id", "parent_id"), "group_id", "parent_id")
    deep = tree.where((F.col("depth") >= deepest) | (F.col("depth") < 0)).select(F.lit("too deep").alias("error"), F.col("group_id").alias("item"))
    return unknown.unionByName(twice).unionByName(empty).unionByName(deep).distinct()


def draft(evidence: DataFrame, chunks: DataFrame, claims: DataFrame, most_per_doc: int = 3, target: int = 14) -> DataFrame:
    """(page_id, marker, chunk_id, doc_id, text, n_claims): evidence with its text, capped per document, then in all; evidence without text is dropped."""
    e = evidence.join(chunks.select("chunk_id", "text").distinct(), "chunk_id")
    w = W.partitionBy("page_id", "doc_id").orderBy("marker")
    e = e.withColumn("_d", F.row_number().over(w)).where(F.col("_d") <= most_per_doc)
    e = e.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("_d", "marker"))).where(F.col("_n") <= target)
    n = claims.where("verification_status = 'verified'").groupBy("chunk_id").agg(F.count_distinct("claim_id").alias("n_claims"))
    return e.join(n, "chunk_id", "left").select("page_id", "marker", "chunk_id", "doc_id", "text", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def marker_differences(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(page_id, marker, side): markers used without evidence and evidence never used."""
    a, b = used.select("page_id", "marker").distinct(), declared.select("page_id", "marker").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("undeclared")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unused")))
