"""Citation resolution, fusion, topics and hints on the reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import citations as c
from kilnwork.plans.registry import query
from kilnwork.runtime import table

_FOLD = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH r AS (SELECT doi AS ref_id, year, substr({_FOLD.format('title')}, 1, 50) AS rt FROM works WHERE title <> ''),
           d AS (SELECT doc_id, year AS y, substr({_FOLD.format('title')}, 1, 50) AS p, length({_FOLD.format('title')}) AS n FROM documents)
           SELECT ref_id, min(doc_id) AS doc_id, 0.85::DOUBLE AS confidence FROM r JOIN d ON y = year AND rt = p WHERE n >= 30 AND length(rt) >= 30 GROUP BY 1""")
def works_reresolved(spark, d):
    w = table(spark, d, "works").where("title <> ''").select(F.col("doi").alias("ref_id"), F.lit(None).cast("string").alias("doi"), "title", "year", F.lit(None).cast("string").alias("raw"))
    return c.reresolve(w, table(spark, d, "documents"))


@query()
def references_reresolved(spark, d):
    r = table(spark, d, "string_cache").select(
        F.col("sha256").alias("ref_id"), F.col("resolved_doi").alias("doi"), F.lit(None).cast("string").alias("title"), F.regexp_extract("raw_text", "((?:19|20)[0-9]{2})", 1).try_cast("int").alias("year"), F.col("raw_text").alias("raw")
    )
    return c.reresolve(r.withColumn("doi", F.nullif("doi", F.lit(""))), table(spark, d, "documents"))


@query("""WITH s AS (SELECT coalesce(lower(doi), substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80)) AS key, title, year, lower(doi) AS doi FROM documents),
          k AS (SELECT * FROM s WHERE key IS NOT NULL AND key <> ''), y AS (SELECT key, min_by(year, {'m': -m, 'y': year}) AS year FROM (SELECT key, year, count(*) AS m FROM k WHERE year IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
          SELECT k.key, count(*) AS n, min_by(title, {'l': -length(title), 't': title}) AS title, min(doi) AS doi, any_value(y.year) AS year FROM k LEFT JOIN y ON y.key = k.key GROUP BY 1""")
def citations_fused(spark, d):
    return c.fused(table(spark, d, "documents").select("title", "year", "doi"))


@query("""WITH h AS (SELECT DISTINCT substr(sha1(chunk_id), 1, 8) AS handle, chunk_id AS id FROM chunks) SELECT handle, min(id) AS id FROM h GROUP BY 1 HAVING count(*) = 1""")
def chunk_handles(spark, d):
    return c.handles(table(spark, d, "chunks").select("chunk_id").distinct(), "chunk_id")


_VOCAB = ["graphene", "hafnium oxide", "oxide", "thin films", "nickel foam", "ellipsometry", "raman spectroscopy", "sputtering", "spray pyrolysis"]
_LIST = ", ".join(f"'{x}'" for x in sorted(_VOCAB, key=lambda x: (-len(x), x)))


@query(f"""SELECT doc_id, unnest(list_filter([{_LIST}], lambda x: contains(' ' || trim(regexp_replace(lower(concat_ws(' ', title, abstract)), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || x || ' '))[1:8]) AS topic FROM documents""")
def document_topics(spark, d):
    return c.topics(table(spark, d, "documents"), _VOCAB)


@query("""WITH m AS (SELECT DISTINCT subject_norm AS page, property_norm AS other FROM data_points WHERE subject_norm IS NOT NULL AND property_norm IS NOT NULL AND verification_status = 'verified'),
          s AS (SELECT subject_norm AS page, property_norm AS other, count(DISTINCT doc_id) * 100 AS score FROM data_points WHERE subject_norm IS NOT NULL AND property_norm IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
          n AS (SELECT page, other, sum(score)::BIGINT AS score FROM (SELECT page, other, 1000 AS score FROM m UNION ALL SELECT * FROM s) GROUP BY 1, 2)
          SELECT page, other, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, other DESC) AS rank FROM n) WHERE rank <= 5""")
def link_hints(spark, d):
    p = table(spark, d, "data_points").where("subject_norm is not null and property_norm is not null").select(F.col("subject_norm").alias("page"), F.col("property_norm").alias("other"), "doc_id", "verification_status")
    return c.link_hints(p.where("verification_status = 'verified'"), p.where("doc_id is not null"))


@query("""SELECT doc_id, n_chunks, n_tokens FROM documents ORDER BY coalesce(n_chunks, 0) DESC, coalesce(n_tokens, 0) DESC, doc_id LIMIT 30""")
def documents_ranked(spark, d):
    return c.rank_documents(table(spark, d, "documents").select("doc_id", "n_chunks", "n_tokens"), "n_chunks", "n_tokens", 30)


@query("""WITH i AS (SELECT DISTINCT subject_norm AS slug, chunk_id FROM data_points WHERE subject_norm IS NOT NULL), k AS (SELECT slug FROM i GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 4)
          SELECT slug, count(DISTINCT chunk_id) AS n FROM i WHERE slug NOT IN (SELECT slug FROM k) GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 3""")
def inbox_promoted(spark, d):
    i = table(spark, d, "data_points").where("subject_norm is not null").select(F.col("subject_norm").alias("slug"), "chunk_id").distinct()
    known = i.groupBy("slug").agg(F.count_distinct("chunk_id").alias("k")).where("k >= 4")
    box = i.select("slug", F.lit("concept").alias("kind"), "chunk_id", F.lit(False).alias("deliberate"))
    ok = c.drained(box, known)[1]
    return i.join(ok, "slug").groupBy("slug").agg(F.count_distinct("chunk_id").alias("n"))


_KEY = "substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80)"


@query(f"""WITH w AS (SELECT {_KEY} AS k, nullif(doi, '') AS wd, nullif(journal, '') AS wj, year AS wy FROM works), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY wd, wj NULLS FIRST, wy NULLS FIRST) AS r FROM w WHERE length(k) >= 20) WHERE r = 1),
           d AS (SELECT doc_id, {_KEY} AS k, doi, container_title, CASE WHEN year BETWEEN 1500 AND 2100 THEN year END AS year FROM documents)
           SELECT doc_id, coalesce(doi, wd) AS doi, coalesce(container_title, wj) AS container_title, coalesce(year, wy) AS year,
             CASE WHEN wd IS NOT NULL AND (doi IS NULL OR container_title IS NULL OR year IS NULL) THEN 'work' ELSE 'document' END AS source FROM d LEFT JOIN b USING (k)""")
def documents_enriched(spark, d):
    return c.enriched(table(spark, d, "documents"), table(spark, d, "works"))
