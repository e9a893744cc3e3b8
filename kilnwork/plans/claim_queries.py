"""Claims: verification, consolidation, registry, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.operators import claims as c
from kilnwork.plans.registry import query
from kilnwork.runtime import table

_P = "(SELECT DISTINCT * FROM data_points)"


def points(spark, d):
    return table(spark, d, "data_points").distinct()


@query(f"SELECT claim_id, subject_norm, property_norm, value_num FROM {_P} WHERE property_norm = 'band gap' AND verification_status = 'verified'")
def claims_filtered(spark, d):
    return points(spark, d).where("property_norm = 'band gap' and verification_status = 'verified'").select("claim_id", "subject_norm", "property_norm", "value_num")


@query(f"""WITH u AS (SELECT property_norm, unit, count(*) AS n FROM {_P} WHERE verification_status IS DISTINCT FROM 'rejected' AND unit IS NOT NULL AND unit <> '' GROUP BY 1, 2),
           m AS (SELECT property_norm, min_by(unit, {{'n': -n, 'u': unit}}) AS unit FROM u GROUP BY 1)
           SELECT p.property_norm, count(*) AS n_points, m.unit FROM {_P} p LEFT JOIN m USING (property_norm) WHERE verification_status IS DISTINCT FROM 'rejected' AND p.property_norm IS NOT NULL GROUP BY 1, m.unit""")
def registry_mode_unit(spark, d):
    return c.registry(points(spark, d))


@query(f"SELECT subject_norm, max(subject) AS subject, count(*) AS n FROM {_P} WHERE subject_norm IS NOT NULL GROUP BY 1")
def subjects(spark, d):
    return points(spark, d).where("subject_norm is not null").groupBy("subject_norm").agg(F.max("subject").alias("subject"), F.count("*").alias("n"))


@query(f"""SELECT property_norm, count(DISTINCT doc_id) AS docs, count(DISTINCT CASE WHEN verification_status = 'verified' THEN doc_id END) AS docs_verified FROM {_P} GROUP BY 1""")
def property_doc_stats(spark, d):
    return points(spark, d).groupBy("property_norm").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("verification_status") == "verified", F.col("doc_id"))).alias("docs_verified"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (verification_status = 'verified') AS verified, round(count(*) FILTER (verification_status = 'verified') / count(*)::DOUBLE, 4) AS ratio FROM {_P}""")
def claim_coverage(spark, d):
    p = points(spark, d)
    ok = F.sum((F.coalesce("verification_status", F.lit("")) == "verified").cast("long"))
    return p.agg(F.count("*").alias("n"), ok.alias("verified"), F.round(ok / F.count("*"), 4).alias("ratio"))


@query(f"""WITH v AS (SELECT subject_norm, property_norm, value_text, min(claim_id) AS first_claim FROM {_P}
             WHERE verification_status = 'verified' AND subject_norm IS NOT NULL AND property_norm IS NOT NULL GROUP BY 1, 2, 3)
           SELECT subject_norm, property_norm, count(*) AS n_values, count(*) > 1 AS conflict, string_agg(value_text, ' | ' ORDER BY first_claim) AS cell FROM v GROUP BY 1, 2""")
def pivot_cells(spark, d):
    return c.cells(points(spark, d))


@query()
def pivot_table(spark, d):
    return c.consolidate(points(spark, d), ["band gap", "hardness", "film thickness", "film density"])


@query(f"""WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), g(x) AS (VALUES (1))
           SELECT p.claim_id, p.value_type = 'figure' AS is_figure,
             coalesce(contains(lower(trim(regexp_replace(regexp_replace(regexp_replace(c.text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\[[0-9]+([-,][0-9]+)*\\]', '', 'g'), ' +', ' ', 'g'))),
                      lower(trim(regexp_replace(regexp_replace(regexp_replace(p.grounding_quote, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\[[0-9]+([-,][0-9]+)*\\]', '', 'g'), ' +', ' ', 'g')))), false) AS grounded
           FROM {_P} p LEFT JOIN c ON c.chunk_id = p.chunk_id""")
def claims_grounded(spark, d):
    ch = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return c.grounded(points(spark, d), ch)


@query("""SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> '' GROUP BY 1""")
def quotes_in_documents(spark, d):
    return c.quoted(table(spark, d, "documents"), table(spark, d, "benchmark"), F.lower).groupBy("item_id").agg(F.count("*").alias("n"))


@query()
def whole_quotes_in_documents(spark, d):
    """As ``quotes_in_documents``, both folded as quotes are grounded."""
    return c.quoted(table(spark, d, "documents"), table(spark, d, "benchmark"), t.grounding_fold).groupBy("item_id").agg(F.count("*").alias("n"))


@query(f"SELECT claim_id, 'dp_' || substr(sha256(concat_ws('|', coalesce(subject_norm, ''), coalesce(property_norm, ''), coalesce(value_text, ''), coalesce(unit, ''), coalesce(doc_id::VARCHAR, ''))), 1, 16) AS content_key FROM {_P}")
def claim_identity(spark, d):
    parts = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("subject_norm", "property_norm", "value_text", "unit", "doc_id")]
    return points(spark, d).select("claim_id", F.concat(F.lit("dp_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)).alias("content_key"))


_NUM = "[+-]?(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?(?:[eE][+-]?\\d+)?"


@query(f"""SELECT chunk_id, n::BIGINT AS n FROM (SELECT DISTINCT chunk_id, len(regexp_extract_all(text, '{_NUM}')) AS n FROM chunks
           WHERE coalesce(is_boilerplate, false) = false AND coalesce(section_type, '') NOT IN ('references', 'acknowledgments', 'appendix')) WHERE n >= 4 ORDER BY n DESC, chunk_id LIMIT 50""")
def number_dense_chunks(spark, d):
    ch = table(spark, d, "chunks").where("not coalesce(is_boilerplate, false) and coalesce(section_type, '') not in ('references', 'acknowledgments', 'appendix')")
    n = ch.select("chunk_id", t.number_count(F.col("text")).cast("long").alias("n")).distinct().where("n >= 4")
    return n.orderBy(F.desc("n"), "chunk_id").limit(50)


@query("""SELECT chunk_id, doc_id, CASE WHEN contains(lower(text), 'band gap') THEN 'band gap' WHEN contains(lower(text), 'band-gap') THEN 'band-gap' WHEN contains(lower(text), 'bandgap') THEN 'bandgap' END AS needle
          FROM (SELECT DISTINCT chunk_id, doc_id, text FROM chunks) WHERE contains(lower(text), 'band gap') OR contains(lower(text), 'band-gap') OR contains(lower(text), 'bandgap')
          ORDER BY doc_id, chunk_id LIMIT 500""")
def property_sweep(spark, d):
    ch = table(spark, d, "chunks").select("chunk_id", "doc_id", "text").distinct()
    return c.sweep(ch, ["band gap", "band-gap", "bandgap"], 500)


@query(f"SELECT claim_id, CASE WHEN value_text IS NULL THEN NULL ELSE TRY_CAST(regexp_extract(regexp_replace(replace(value_text, '−', '-'), '([0-9]),([0-9]{{3}})\\b', '\\1\\2'), '([+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?)', 1) AS DOUBLE) END AS leading FROM {_P} WHERE value_type = 'scalar' AND regexp_matches(value_text, '^[0-9]+([.][0-9]+)?$')")
def leading_numbers(spark, d):
    p = points(spark, d).where("value_type = 'scalar'").where(F.col("value_text").rlike("^[0-9]+([.][0-9]+)?$"))
    return p.select("claim_id", t.leading_number(F.col("value_text")).alias("leading"))


@query(f"""WITH s AS (SELECT property_norm, count(DISTINCT doc_id) AS mentioning, count(DISTINCT CASE WHEN verification_status = 'verified' THEN doc_id END) AS verified FROM {_P} WHERE property_norm IS NOT NULL GROUP BY 1)
           SELECT property_norm, round(least(verified / greatest(mentioning, 1)::DOUBLE, 1), 4) AS recall, mentioning >= 10 AND round(least(verified / greatest(mentioning, 1)::DOUBLE, 1), 4) < 0.75 AS blocked FROM s""")
def data_recall_gate(spark, d):
    s = points(spark, d).where("property_norm is not null").groupBy("property_norm").agg(F.count_distinct("doc_id").alias("m"), F.count_distinct(F.when(F.col("verification_status") == "verified", F.col("doc_id"))).alias("k"))
    r = F.round(F.least(F.col("k") / F.greatest("m", F.lit(1)), F.lit(1.0)), 4)
    return s.select("property_norm", r.alias("recall"), ((F.col("m") >= 10) & (r < 0.75)).alias("blocked"))
