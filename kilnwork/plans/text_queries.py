"""Text functions and corpus shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.operators import corpus, parsing
from kilnwork.plans.registry import query
from kilnwork.runtime import table

_CH = "(SELECT DISTINCT chunk_id, doc_id, ord, text, section_type, is_boilerplate, section_path_json FROM chunks)"


def chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "doc_id", "ord", "text", "section_type", "is_boilerplate", "section_path_json").distinct()


@query("""SELECT chunk_id, line_no, line FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT DISTINCT chunk_id, text FROM chunks))
          WHERE length(regexp_replace(lower(line), '[^a-z0-9]', '', 'g')) >= 30""")
def chunk_lines(spark, d):
    return corpus.lines(table(spark, d, "chunks").select("chunk_id", "text").distinct(), "chunk_id", "text", 30)


@query("""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND length(line) <= 250 GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeated_headers(spark, d):
    return corpus.repeated_lines(table(spark, d, "documents"), "doc_id", "text")


_WORDS = ", ".join(f"'{w}'" for w in t.LICENCE_WORDS)


@query(f"""SELECT chunk_id FROM {_CH} WHERE contains(lower(text), 'wiley online library') OR contains(lower(text), 'onlinelibrary.wiley.com')
           OR (len(regexp_extract_all(lower(text), '[a-z]+')) >= 20 AND len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ({_WORDS}))) / len(regexp_extract_all(lower(text), '[a-z]+'))::DOUBLE >= 0.08)""")
def boilerplate_hard(spark, d):
    return chunks(spark, d).where(t.hard_boilerplate(F.col("text"))).select("chunk_id")


_ALL_SOFT = "(?i)" + "|".join(f"(?:{p})" for p in t.SOFT_MARKERS)
_SOFT = f"len(regexp_extract_all(text, '{_ALL_SOFT}'))"
_DEF = " OR ".join(
    [f"regexp_matches(substr(text, 1, 600), '{flags}{p}')" for ps, flags in ((t.DEFINITE_MARKERS, "(?im)"), (t.CASED_MARKERS, "(?m)")) for p in (x.replace("\\Z", "\\z") for x in ps)]
    + [f"coalesce(len(list_filter(from_json(section_path_json, '[\"VARCHAR\"]'), lambda h: regexp_matches(lower(h), '{'|'.join(t.SIDEBAR_HEADINGS)}'))) > 0, false)"]
)


@query(f"""SELECT chunk_id FROM {_CH} WHERE {_DEF} OR (len(regexp_split_to_array(trim(text), '\\s+')) <= 600 AND {_SOFT} >= 2)""")
def boilerplate_soft(spark, d):
    return chunks(spark, d).where(t.soft_boilerplate(F.col("text"), F.from_json("section_path_json", "array<string>"))).select("chunk_id")


def _section_sql(h: str) -> str:
    low = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({h}), '[*_`]+', '', 'g'), '^[ivxlcIVXLC]+[.]\\s*', ''), '^[0-9.]+\\s*', ''), '^[A-Z][.]\\s*', '')))"
    cases = " ".join(
        f"WHEN regexp_matches({low}, '{p}')" + (f" AND (NOT regexp_matches({low}, 'summary\\b.*information') OR regexp_matches({low}, '\\b(conclusion|concluding)'))" if n == "conclusion" else "") + f" THEN '{n}'"
        for n, p in t.SECTION_PATTERNS
    )
    return f"CASE WHEN length({low}) < 3 THEN 'body' {cases} ELSE 'body' END"


@query(f"SELECT h AS heading, {_section_sql('h')} AS kind FROM (SELECT DISTINCT unnest(from_json(section_path_json, '[\"VARCHAR\"]')) AS h FROM chunks)")
def section_types(spark, d):
    h = table(spark, d, "chunks").select(F.explode(F.from_json("section_path_json", "array<string>")).alias("heading")).distinct()
    return h.select("heading", t.section_type(F.col("heading")).alias("kind"))


@query(f"""WITH p AS (SELECT chunk_id, text, is_boilerplate, from_json(section_path_json, '["VARCHAR"]') AS path FROM {_CH}),
           k AS (SELECT chunk_id, coalesce(list_filter(list_transform(path, lambda h: {_section_sql('h')}), lambda x: x <> 'body')[-1], 'body') AS kind, text, is_boilerplate FROM p)
           SELECT chunk_id, CASE WHEN is_boilerplate THEN 'boilerplate' WHEN regexp_matches(trim(text), '(?i)^(fig(ure|[.])?|table|scheme) *[0-9]+[.:]') THEN 'caption'
             WHEN starts_with(trim(text), '|') AND ends_with(trim(text), '|') THEN 'table' WHEN starts_with(trim(text), '![') THEN 'figure' ELSE kind END AS kind FROM k""")
def chunk_kinds(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", t.chunk_kind(F.col("text"), F.from_json("section_path_json", "array<string>"), F.col("is_boilerplate")).alias("kind"))


@query(f"""WITH c AS (SELECT DISTINCT doc_id, ord, section_path_json AS label FROM {_CH}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY ord))::INT AS new FROM c),
           s AS (SELECT *, sum(CASE WHEN rn = 1 THEN 0 ELSE new END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS segment FROM o)
           SELECT doc_id, segment::BIGINT AS segment, first(label) AS label, min(ord) AS first, max(ord) AS last, count(*) AS n FROM s GROUP BY doc_id, segment""")
def section_segments(spark, d):
    c = chunks(spark, d).select("doc_id", "ord", "section_path_json").distinct()
    return corpus.segments(c, "doc_id", "ord", F.col("section_path_json")).withColumn("segment", F.col("segment").cast("long"))


@query(f"""WITH c AS (SELECT doc_id, chunk_id, ord, section_type, section_path_json, text, len(regexp_split_to_array(trim(text), '\\s+')) AS w FROM {_CH}),
           l AS (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS total, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY ord, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ran, row_number() OVER (PARTITION BY doc_id ORDER BY ord, chunk_id) AS n FROM c),
           k AS (SELECT *, CASE WHEN section_type = 'abstract' THEN 1 WHEN regexp_matches(lower(section_path_json), '\\babstract\\b') THEN 2 WHEN starts_with(lower(ltrim(text)), 'abstract') THEN 3 WHEN ran * 3 < total OR n <= 3 THEN 4 ELSE 5 END AS tier FROM l)
           SELECT doc_id, chunk_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, CASE WHEN tier = 4 THEN -w ELSE 0 END, ord, chunk_id) AS r FROM k) WHERE r = 1""")
def abstract_pick(spark, d):
    return corpus.abstract_of(chunks(spark, d))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://)?(dx[.])?doi[.]org/|^doi: *', ''), '[.,;:]+$', '') AS doi FROM documents WHERE doi IS NOT NULL")
def doi_normal(spark, d):
    return table(spark, d, "documents").where("doi is not null").select("doc_id", t.doi_normal(F.col("doi")).alias("doi"))


@query("SELECT doc_id, substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 50) AS fold, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS key FROM documents WHERE title IS NOT NULL")
def title_folds(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", t.alnum_fold(F.col("title"), 50).alias("fold"), t.title_key(F.col("title")).alias("key"))


@query("""SELECT author_id, trim(regexp_replace(replace(lower(display_name), '-', ''), '[^\\p{L}0-9]+', ' ', 'g')) AS person,
          CASE WHEN contains(display_name, ',') THEN lower(trim(string_split(display_name, ',')[1])) || '_' || lower(substr(trim(regexp_extract(display_name, ',(.*)$', 1)), 1, 1))
          ELSE lower(regexp_split_to_array(trim(display_name), '\\s+')[-1]) || '_' || lower(substr(regexp_split_to_array(trim(display_name), '\\s+')[1], 1, 1)) END AS last_initial FROM authors""")
def person_keys(spark, d):
    return table(spark, d, "authors").select("author_id", t.person_key(F.col("display_name")).alias("person"), t.last_initial(F.col("display_name")).alias("last_initial"))


@query(f"SELECT chunk_id, substr(sha1(text), 1, 12) AS content_id FROM {_CH}")
def content_ids(spark, d):
    return chunks(spark, d).select("chunk_id", t.content_id(F.col("text")).alias("content_id"))


@query("""WITH f AS (SELECT doc_id, sha1(substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 1000)) AS fp FROM documents WHERE length(trim(text)) > 0)
          SELECT fp, min(doc_id) AS kept, count(*) AS copies FROM f GROUP BY 1 HAVING count(*) > 1""")
def fingerprint_duplicates(spark, d):
    docs = table(spark, d, "documents").where("length(trim(text)) > 0")
    return docs.select("doc_id", t.text_fingerprint(F.col("text")).alias("fp")).groupBy("fp").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT sha256, TRY_CAST(regexp_extract(raw_text, '\\[([0-9]{1,3})\\]', 1) AS INT) AS mark FROM string_cache WHERE regexp_matches(raw_text, '\\[[0-9]{1,3}\\]')")
def citation_marks(spark, d):
    r = table(spark, d, "string_cache").select("sha256", t.citation_marks(F.col("raw_text")).alias("m")).where("size(m) > 0")
    return r.select("sha256", F.col("m")[0].alias("mark"))


@query("""WITH s AS (SELECT doc_id, sha1(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, h FROM s WHERE doc_id % 7 <> 0),
          n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN h || 'x' ELSE h END AS h FROM s WHERE doc_id % 11 <> 0)
          SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'replaced' END AS change
          FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""")
def incremental_diff(spark, d):
    """Two listings of the corpus, made from its one snapshot, so that every kind of change occurs."""
    s = table(spark, d, "documents").select("doc_id", F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
    new = s.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.concat("h", F.lit("x"))).otherwise(F.col("h")))
    return corpus.diff(s.where("doc_id % 7 <> 0"), new, "doc_id", "h")


@query()
def document_sections(spark, d):
    return parsing.sections(table(spark, d, "documents").select("doc_id", "text"))


@query()
def section_chunks(spark, d):
    return parsing.chunk_documents(table(spark, d, "documents").select("doc_id", "text"))


@query()
def equations(spark, d):
    return parsing.equations(table(spark, d, "documents").select("doc_id", "text"))


@query()
def captions(spark, d):
    return parsing.captions(table(spark, d, "documents").select("doc_id", "text"))


@query()
def bibliographies(spark, d):
    return parsing.bibliography(table(spark, d, "documents").select("doc_id", "text"))


@query("""SELECT doc_id, json_extract_string(metadata_json, '$.import') AS import, TRY_CAST(json_extract_string(metadata_json, '$.v') AS INT) AS v FROM documents""")
def json_columns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.get_json_object("metadata_json", "$.import").alias("import"), F.get_json_object("metadata_json", "$.v").cast("int").alias("v"))


@query("""SELECT doi, strftime(resolved_at, '%Y-%m-%dT%H:%M:%SZ') AS resolved, date_diff('day', resolved_at, TIMESTAMP '2021-06-01')::INT > 14 AND title = '' AS stale FROM works""")
def cache_freshness(spark, d):
    w = table(spark, d, "works")
    return w.select(
        "doi",
        F.date_format("resolved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("resolved"),
        ((F.datediff(F.lit("2021-06-01").cast("date"), F.to_date("resolved_at")) > 14) & (F.col("title") == "")).alias("stale"),
    )


@query("""SELECT doi, '@article{' || coalesce(year::VARCHAR, 'nd') || '_' || substr(sha1(doi), 1, 6) || ', title={' || title || '}, journal={' || journal || '}, doi={' || doi || '}}' AS entry FROM works WHERE title <> ''""")
def bibtex_export(spark, d):
    from kilnwork.sources import sinks

    return sinks.bibtex(table(spark, d, "works").where("title <> ''"))
