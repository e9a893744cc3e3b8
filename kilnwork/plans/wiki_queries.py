"""Wiki operators with subjects of claims as pages and their grounding as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import parsing, wiki
from kilnwork.plans.registry import query
from kilnwork.runtime import table

_E = "(SELECT DISTINCT property_norm AS page_id, doc_id, chunk_id, claim_id AS marker FROM data_points WHERE property_norm IS NOT NULL AND doc_id IS NOT NULL)"


def evidence(spark, d):
    p = table(spark, d, "data_points").where("property_norm is not null and doc_id is not null")
    return p.select(F.col("property_norm").alias("page_id"), "doc_id", "chunk_id", F.col("claim_id").alias("marker")).distinct()


@query(f"""WITH m AS (SELECT DISTINCT page_id, doc_id FROM {_E}) SELECT a.page_id AS a, b.page_id AS b, count(*) AS shared FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.page_id < b.page_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def pages_sharing_documents(spark, d):
    return wiki.co_evidence(evidence(spark, d), 2)


@query(f"""SELECT DISTINCT page_id FROM {_E} WHERE doc_id IN (SELECT doc_id FROM {_E} WHERE page_id = 'band gap') AND page_id <> 'band gap'""")
def see_also(spark, d):
    none = spark.createDataFrame([], "src string, dst string")
    return wiki.see_also("band gap", none, evidence(spark, d))


@query("""WITH e AS (SELECT DISTINCT trim(display_name) AS n FROM authors), a AS (SELECT DISTINCT unnest(from_json(authors_json, '["VARCHAR"]')) AS n FROM documents),
          k AS (SELECT DISTINCT CASE WHEN contains(n, ',') THEN lower(trim(string_split(n, ',')[1])) || '_' || lower(substr(trim(regexp_extract(n, ',(.*)$', 1)), 1, 1)) ELSE lower(regexp_split_to_array(trim(n), '\\s+')[-1]) || '_' || lower(substr(regexp_split_to_array(trim(n), '\\s+')[1], 1, 1)) END AS k FROM e),
          f AS (SELECT DISTINCT CASE WHEN contains(n, ',') THEN lower(trim(string_split(n, ',')[1])) || '_' || lower(substr(trim(regexp_extract(n, ',(.*)$', 1)), 1, 1)) ELSE lower(regexp_split_to_array(trim(n), '\\s+')[-1]) || '_' || lower(substr(regexp_split_to_array(trim(n), '\\s+')[1], 1, 1)) END AS k FROM a)
          SELECT count(*) AS n, count(f.k) AS hit, round(count(f.k) / count(*)::DOUBLE, 6) AS recall FROM k LEFT JOIN f USING (k) WHERE k.k IS NOT NULL""")
def people_recall(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.from_json("authors_json", "array<string>")).alias("display_name"))
    return wiki.people_recall(table(spark, d, "authors").select(F.trim("display_name").alias("display_name")), found, "display_name")


@query()
def mentioned_artifacts(spark, d):
    caps = parsing.captions(table(spark, d, "documents").select("doc_id", "text"))
    return wiki.mentioned_artifacts(table(spark, d, "chunks").select("chunk_id", "doc_id", "text").distinct(), caps)


@query(f"""WITH e AS (SELECT e.*, c.text FROM {_E} e JOIN (SELECT DISTINCT chunk_id, text FROM chunks) c USING (chunk_id)),
           a AS (SELECT *, row_number() OVER (PARTITION BY page_id, doc_id ORDER BY marker) AS d FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY d, marker) AS n FROM a WHERE d <= 3),
           k AS (SELECT chunk_id, count(DISTINCT claim_id) AS n_claims FROM data_points WHERE verification_status = 'verified' GROUP BY 1)
           SELECT page_id, marker, chunk_id, doc_id, text, coalesce(n_claims, 0) AS n_claims FROM b LEFT JOIN k USING (chunk_id) WHERE n <= 14""")
def draft_evidence(spark, d):
    return wiki.draft(evidence(spark, d), table(spark, d, "chunks"), table(spark, d, "data_points"))
