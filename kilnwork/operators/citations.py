"""Citation resolution, fusion, handles, topics and inbox: set-based forms of record-linkage steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as t


def reresolve(refs: DataFrame, docs: DataFrame, least: int = 30) -> DataFrame:
    """(ref_id, doc_id, confidence): references (ref_id, doi, title, year, raw) led to documents, the first tier that hits wins.

    Same DOI 1.0; same year and 50 characters of the folded title 0.85; same year
    and 40 characters of the folded title inside the folded raw text 0.75.  The
    last tier is joined on the year and the first eight folded characters of
    words, so it is no product of the tables.
    """
    d = docs.select("doc_id", t.doi_normal(F.col("doi")).alias("d"), F.col("year").alias("y"), t.alnum_fold(F.col("title")).alias("tf")).where(F.col("d").isNotNull() | F.col("tf").isNotNull())
    r = refs.select("ref_id", t.doi_normal(F.col("doi")).alias("rd"), "year", t.alnum_fold(F.col("title"), 50).alias("rt"), t.alnum_fold(F.col("raw")).alias("rr"), t.title_key(F.col("raw"), 2**31 - 1).alias("rk"))
    one = r.join(d, r["rd"] == d["d"]).select("ref_id", "doc_id", F.lit(1.0).alias("confidence"))
    long = d.where(F.length("tf") >= least)
    two = r.where(F.length("rt") >= least).join(long.withColumn("p", F.substring("tf", 1, 50)), (F.col("year") == F.col("y")) & (F.col("rt") == F.col("p"))).select("ref_id", "doc_id", F.lit(0.85).alias("confidence"))
    first = docs.select(F.col("doc_id").alias("fid"), F.split(t.title_key(F.col("title")), " ").alias("w")).select("fid", F.filter("w", lambda x: F.length(x) > 3)[0].alias("w0"))
    keyed = long.join(first, F.col("fid") == F.col("doc_id")).where("w0 is not null").withColumn("p", F.substring("tf", 1, 40))
    asks = r.select("ref_id", "year", "rr", F.explode(F.array_distinct(F.filter(F.split("rk", " "), lambda x: F.length(x) > 3))).alias("w0"))
    three = asks.join(keyed, (asks["year"] == keyed["y"]) & (asks["w0"] == keyed["w0"])).where(F.col("rr").contains(F.col("p"))).select("ref_id", "doc_id", F.lit(0.75).alias("confidence"))
    every = one.unionByName(two).unionByName(three)
    return every.groupBy("ref_id").agg(F.max(F.struct("confidence", (-F.col("doc_id")).alias("k"))).alias("b")).select("ref_id", (-F.col("b.k")).alias("doc_id"), "b.confidence")


def fused(cits: DataFrame) -> DataFrame:
    """(key, n, title, year, doi): mentions of one work by DOI or by its key: longest title, most common year, first DOI."""
    key = F.coalesce(F.lower("doi"), t.title_key(F.col("title")))
    c = cits.select(key.alias("key"), "title", "year", F.lower("doi").alias("doi")).where("key is not null and key <> ''")
    years = c.where("year is not null").groupBy("key", "year").agg(F.count("*").alias("m")).groupBy("key").agg(F.min(F.struct((-F.col("m")).alias("m"), "year"))["year"].alias("year"))
    return c.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.length("title")).alias("l"), "title"))["title"].alias("title"), F.min("doi").alias("doi")).join(years, "key", "left")


def handles(ids: DataFrame, key: str, length: int = 8) -> DataFrame:
    """(handle, id): short ids by hash; handles that two ids share are left out."""
    h = ids.select(F.substring(F.sha1(F.col(key).cast("binary")), 1, length).alias("handle"), F.col(key).alias("id")).distinct()
    return h.groupBy("handle").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1").drop("_n")


def topics(docs: DataFrame, vocabulary: list[str], most: int = 8) -> DataFrame:
    """(doc_id, topic): vocabulary phrases in title and abstract on word boundaries, longest first, at most ``most`` a document."""
    text = F.concat(F.lit(" "), t.title_key(F.concat_ws(" ", "title", "abstract"), 100_000), F.lit(" "))
    known = F.array(*[F.lit(x) for x in sorted(set(vocabulary), key=lambda x: (-len(x), x))])
    hits = docs.select("doc_id", F.slice(F.filter(known, lambda x: text.contains(F.concat(F.lit(" "), x, F.lit(" ")))), 1, most).alias("ts"))
    return hits.select("doc_id", F.explode("ts").alias("topic"))


def fields(topic_rows: DataFrame, words: dict[str, list[str]], least: int = 3, lead: float = 2.0) -> str:
    """The field whose words occur most among the topics, if it is ahead; else ``generic``."""
    pairs = [(f, w) for f, ws in words.items() for w in ws]
    if not pairs:
        return "generic"
    spark = topic_rows.sparkSession
    n = topic_rows.select("topic").distinct().join(F.broadcast(spark.createDataFrame(pairs, "field string, topic string")), "topic").groupBy("field").count().orderBy(F.desc("count"), "field").limit(2).collect()
    if not n or n[0][1] < least or (len(n) > 1 and n[0][1] < lead * n[1][1]):
        return "generic"
    return n[0][0]


def drained(inbox: DataFrame, known: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, promoted, retained) of an inbox (slug, kind, chunk_id, deliberate, at).

    Evidence goes to concepts that exist; suggestions are promoted when they are
    deliberate or rest on ``least`` different chunks; the others stay.
    """
    have = known.select("slug").distinct()
    evidence = inbox.where("kind = 'evidence'").join(have, "slug", "left_semi")
    sug = inbox.where("kind = 'concept'").join(have, "slug", "left_anti")
    n = sug.groupBy("slug").agg(F.count_distinct("chunk_id").alias("_n"), F.max(F.coalesce(F.col("deliberate"), F.lit(False)).cast("int")).alias("_d"))
    ok = n.where((F.col("_d") == 1) | (F.col("_n") >= least)).select("slug")
    return evidence, ok, sug.join(ok, "slug", "left_anti")


def cited_walk(hits: DataFrame, cites: DataFrame, scored: DataFrame, depth: int = 2) -> DataFrame:
    """(hop, from_chunk, doc_id, to_chunk): from hit chunks to the best chunk of each paper they cite, visited once.

    ``cites`` (chunk_id, doc_id) and ``scored`` (chunk_id, doc_id, score) for the query.
    """
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id"))["chunk_id"].alias("to_chunk"))
    front, seen, out = hits.select("chunk_id").distinct(), hits.select("chunk_id").distinct(), None
    for hop in range(1, depth + 1):
        step = cites.join(front, "chunk_id").select(F.col("chunk_id").alias("from_chunk"), "doc_id").distinct().join(best, "doc_id").select(F.lit(hop).alias("hop"), "from_chunk", "doc_id", "to_chunk")
        out = step if out is None else out.unionByName(step)
        front = step.select(F.col("to_chunk").alias("chunk_id")).distinct().join(seen, "chunk_id", "left_anti")
        seen = seen.unionByName(front)
    return out


def rank_documents(docs: DataFrame, metric: str, other: str, k: int) -> DataFrame:
    """The first ``k`` documents by a metric, then the other, then id; missing metrics count 0."""
    return docs.orderBy(F.coalesce(F.col(metric), F.lit(0)).desc(), F.coalesce(F.col(other), F.lit(0)).desc(), "doc_id").limit(k)


def link_hints(mentions: DataFrame, shared: DataFrame, k: int = 5) -> DataFrame:
    """(page, other, score, rank): 1000 a mention, 100 a shared document; pages with neither do not appear."""
    m = mentions.groupBy("page", "other").agg((F.count("*") * 0 + 1000).alias("score"))
    s = shared.groupBy("page", "other").agg((F.count_distinct("doc_id") * 100).alias("score"))
    n = m.unionByName(s).groupBy("page", "other").agg(F.sum("score").alias("score"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), F.desc("other")))).where(F.col("rank") <= k)


def enriched(docs: DataFrame, works: DataFrame) -> DataFrame:
    """(doc_id, doi, container_title, year, source): blanks of a document filled from the resolved work of the same folded title.

    The document's own valid value comes first; a year outside 1500..2100 is no
    value; of several works the one with the smallest DOI fills.
    """
    w = works.select(t.title_key(F.col("title")).alias("k"), F.nullif("doi", F.lit("")).alias("wd"), F.nullif("journal", F.lit("")).alias("wj"), F.col("year").alias("wy")).where("length(k) >= 20")
    w = w.groupBy("k").agg(F.min(F.struct("wd", "wj", "wy")).alias("w")).select("k", "w.*")
    d = docs.select("doc_id", t.title_key(F.col("title")).alias("k"), "doi", "container_title", F.when(F.col("year").between(1500, 2100), F.col("year")).alias("year"))
    j = d.join(w, "k", "left")
    used = F.when(F.col("wd").isNotNull() & (F.col("doi").isNull() | F.col("container_title").isNull() | F.col("year").isNull()), "work").otherwise("document")
    return j.select("doc_id", F.coalesce("doi", "wd").alias("doi"), F.coalesce("container_title", "wj").alias("container_title"), F.coalesce("year", "wy").alias("year"), used.alias("source"))
