"""Gates and small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.operators import curation as c
from kilnwork.plans.registry import query
from kilnwork.plans.text_queries import _DEF, _SOFT, _WORDS, _section_sql
from kilnwork.runtime import table

_CH = "(SELECT DISTINCT chunk_id, doc_id, ord, text, section_type, is_boilerplate, section_path_json FROM chunks)"
_HARD = f"""(contains(lower(text), 'wiley online library') OR contains(lower(text), 'onlinelibrary.wiley.com') OR (len(regexp_extract_all(lower(text), '[a-z]+')) >= 20
           AND len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({_WORDS}))) / len(regexp_extract_all(lower(text), '[a-z]+'))::DOUBLE >= 0.08))"""


@query("SELECT p_partkey, (least(p_size * 20, p_partkey % 400 + 50) < 120) OR (p_size * 20 * (p_partkey % 400 + 50) < 40000) OR (greatest(p_size * 20, p_partkey % 400 + 50) / least(p_size * 20, p_partkey % 400 + 50)::DOUBLE > 4) AS decoration FROM part")
def decoration_images(spark, d):
    """Parts stand in for images: two of their numbers are taken as width and height."""
    w, h = (F.col("p_size") * 20).cast("long"), (F.col("p_partkey") % 400 + 50).cast("long")
    return table(spark, d, "part").select("p_partkey", c.decoration(w, h).alias("decoration"))


_STOPS = ", ".join(f"'{x}'" for x in c.KEYWORD_STOPS)
_MONTHS = ", ".join(f"'{x}'" for x in c.MONTHS)


@query(f"""WITH h AS (SELECT DISTINCT unnest(from_json(section_path_json, '["VARCHAR"]')) AS h FROM chunks), l AS (SELECT h, lower(trim(h)) AS low, regexp_split_to_array(lower(trim(h)), '\\s+') AS parts FROM h)
           SELECT h AS word, coalesce(length(low) BETWEEN 3 AND 50 AND len(parts) <= 5 AND parts[1] NOT IN ({_STOPS}) AND low NOT IN ({_MONTHS}) AND regexp_matches(low, '[a-z]')
           AND NOT regexp_matches(low, '^[a-z]([. ]+[a-z])*[.]?$') AND NOT regexp_matches(low, '[@/\\\\]|https?:|^[0-9 .,-]+$'), false) AS valid FROM l""")
def keyword_validity(spark, d):
    h = table(spark, d, "chunks").select(F.explode(F.from_json("section_path_json", "array<string>")).alias("word")).distinct()
    return h.select("word", c.valid_keyword(F.col("word")).alias("valid"))


@query(f"""SELECT chunk_id FROM {_CH} WHERE coalesce(length(trim(text)) >= 80 AND NOT {_HARD} AND NOT (regexp_matches(lower(text), '(?m)^ *(received|accepted|published online|corresponding author|available online)\\b') AND length(text) < 600) AND regexp_matches(text, '[a-z][.;:!?](\\s|$)'), false)""")
def admissible_evidence(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "text").distinct().where(c.admissible(F.col("text"))).select("chunk_id")


@query(f"""WITH c AS (SELECT DISTINCT doc_id, ord, chunk_id, length(text)::BIGINT AS n FROM {_CH}) SELECT doc_id, ord, (sum(n) OVER w - n)::BIGINT AS char_start, (sum(n) OVER w)::BIGINT AS char_end FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""")
def running_offsets(spark, d):
    return c.running_offsets(table(spark, d, "chunks").select("doc_id", "ord", "chunk_id", "text").distinct(), "doc_id", "ord", "text")


@query(f"""WITH c AS (SELECT DISTINCT doc_id, ord, chunk_id, coalesce(section_type, 'body') AS kind FROM {_CH}),
           l AS (SELECT *, max(CASE WHEN kind = 'body' THEN ord END) OVER (PARTITION BY doc_id) AS last, max((kind = 'conclusion')::INT) OVER (PARTITION BY doc_id) AS has, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
           SELECT chunk_id, CASE WHEN has = 0 AND n >= 3 AND ord = last THEN 'conclusion' ELSE kind END AS kind FROM l""")
def conclusion_fallback(spark, d):
    s = table(spark, d, "chunks").select("doc_id", "ord", "chunk_id", F.coalesce("section_type", F.lit("body")).alias("kind")).distinct()
    return c.with_conclusion(s, "doc_id", "ord", "kind").select("chunk_id", "kind")


@query("""SELECT trim(regexp_replace(regexp_replace(lower(subject), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, count(*) AS n, min(confidence) AS low, round(avg(confidence), 6) AS mean, sum((verification_status = 'verified')::BIGINT)::BIGINT AS strong
          FROM (SELECT DISTINCT * FROM data_points) WHERE subject IS NOT NULL AND verification_status IS NOT NULL GROUP BY 1""")
def confidence_by_subject(spark, d):
    p = table(spark, d, "data_points").distinct().where("subject is not null and verification_status is not null")
    return c.confidence_by_key(p, t.normal_key(F.col("subject")), "confidence", "verification_status")


@query("""WITH a AS (SELECT property_norm AS k, count(DISTINCT doc_id) AS available, count(DISTINCT CASE WHEN verification_status = 'verified' THEN doc_id END) AS cited FROM data_points WHERE property_norm IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1)
          SELECT k, cited, available, available >= 5 AND cited < greatest(3, ceil(available * 0.5)) AS warn FROM a""")
def thin_coverage(spark, d):
    p = table(spark, d, "data_points").where("property_norm is not null and doc_id is not null").select(F.col("property_norm").alias("k"), "doc_id", "verification_status")
    return c.thin_coverage(p.where("verification_status = 'verified'"), p, "k")


@query(f"""WITH k AS (SELECT chunk_id, {_HARD} OR ({_DEF} OR (len(regexp_split_to_array(trim(text), '\\s+')) <= 600 AND {_SOFT} >= 2)) AS b, is_boilerplate AS ob, section_type AS os,
             coalesce(list_filter(list_transform(from_json(section_path_json, '["VARCHAR"]'), lambda h: {_section_sql('h')}), lambda x: x <> 'body')[-1], 'body') AS s FROM {_CH})
           SELECT chunk_id, b AS is_boilerplate, s AS section_type, ob IS DISTINCT FROM b OR os IS DISTINCT FROM s AS changed FROM k""")
def chunks_reclassified(spark, d):
    return c.reclassified(table(spark, d, "chunks").select("chunk_id", "text", "section_path_json", "is_boilerplate", "section_type").distinct())


@query("SELECT publisher, count(*) AS n, least(200, greatest(10, round(42.0 * log10(greatest(count(*), 1)) - 27.0)))::INT AS target FROM documents GROUP BY 1")
def target_sizes(spark, d):
    return table(spark, d, "documents").groupBy("publisher").agg(F.count("*").alias("n")).withColumn("target", c.target_size(F.col("n")))


@query(f"""SELECT c.chunk_id, substr(c.text, 1, 240) AS preview, d.year, d.n_chunks, coalesce(d.n_chunks, 0) = 0 AS stub FROM {_CH} c JOIN documents d USING (doc_id) WHERE contains(lower(c.text), 'graphene')""")
def enriched_results(spark, d):
    ch = table(spark, d, "chunks").select("chunk_id", "doc_id", "text").distinct().where(t.contains_literal(F.col("text"), "graphene"))
    docs = table(spark, d, "documents").select("doc_id", "year", "n_chunks")
    return ch.join(docs, "doc_id").select("chunk_id", F.substring("text", 1, 240).alias("preview"), "year", "n_chunks", (F.coalesce("n_chunks", F.lit(0)) == 0).alias("stub"))
