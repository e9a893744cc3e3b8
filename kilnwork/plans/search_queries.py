"""Filters, literal and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.functions import vectors as v
from kilnwork.operators import search as s
from kilnwork.plans.registry import query
from kilnwork.runtime import table


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "doc_id", "ord", "text", "section_type", "is_boilerplate").distinct()


_CH = "(SELECT DISTINCT chunk_id, doc_id, ord, text, section_type, is_boilerplate FROM chunks)"


@query(f"SELECT chunk_id, doc_id, substr(text, 1, 160) AS preview FROM {_CH} WHERE contains(lower(text), 'band gap') ORDER BY chunk_id LIMIT 50")
def grep_literal(spark, d):
    c = chunk_rows(spark, d).where(t.contains_literal(F.col("text"), "band gap"))
    return s.top(c.select("chunk_id", "doc_id", F.substring("text", 1, 160).alias("preview")), 50, F.asc("chunk_id"))


@query(f"SELECT chunk_id FROM {_CH} WHERE contains(lower(text), 'run_7') OR contains(text, '%')")
def grep_wildcards_are_literal(spark, d):
    return chunk_rows(spark, d).where(t.contains_literal(F.col("text"), "run_7") | F.col("text").contains("%")).select("chunk_id")


@query(f"""SELECT chunk_id FROM {_CH} WHERE contains(lower(text), 'films') AND section_type NOT IN ('references', 'caption', 'table')""")
def grep_without_kinds(spark, d):
    return chunk_rows(spark, d).where(t.contains_literal(F.col("text"), "films") & ~F.col("section_type").isin("references", "caption", "table")).select("chunk_id")


@query(f"""SELECT chunk_id FROM {_CH} WHERE contains(lower(text), 'films') AND coalesce(lower(section_type), '') NOT IN ('references', 'caption', 'table')""")
def hits_without_kinds(spark, d):
    kind = F.lower(F.coalesce("section_type", F.lit("")))
    return chunk_rows(spark, d).where(t.contains_literal(F.col("text"), "films") & ~kind.isin("references", "caption", "table")).select("chunk_id")


@query("""SELECT doc_id, (instr(lower(title), 'graphene') - 1)::BIGINT AS match_at, length(title)::BIGINT AS title_len FROM documents
          WHERE contains(lower(title), 'graphene') ORDER BY match_at, title_len, doc_id LIMIT 8""")
def title_search(spark, d):
    docs = table(spark, d, "documents").where(t.contains_literal(F.col("title"), "graphene"))
    hit = docs.select("doc_id", (F.instr(F.lower("title"), "graphene") - 1).cast("long").alias("match_at"), F.length("title").cast("long").alias("title_len"))
    return s.top(hit, 8, F.asc("match_at"), F.asc("title_len"), F.asc("doc_id"))


@query("SELECT doc_id FROM documents WHERE kind = 'pdf' AND source = 'scanroom' AND publisher IS NULL")
def where_equals(spark, d):
    return table(spark, d, "documents").where(F.col("kind").eqNullSafe("pdf") & F.col("source").eqNullSafe("scanroom") & F.col("publisher").eqNullSafe(F.lit(None))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(container_title, '')), 'coating')")
def match_substring(spark, d):
    return table(spark, d, "documents").where(t.contains_literal(F.coalesce("container_title", F.lit("")), "coating")).select("doc_id")


@query("SELECT doc_id, year FROM documents WHERE coalesce(year, 0) >= 2015")
def since_year(spark, d):
    return table(spark, d, "documents").where(F.coalesce("year", F.lit(0)) >= 2015).select("doc_id", "year")


@query(f"SELECT chunk_id, doc_id, ord FROM {_CH} WHERE doc_id = 7 ORDER BY ord, chunk_id")
def chunks_of_document(spark, d):
    return chunk_rows(spark, d).where("doc_id = 7").orderBy("ord", "chunk_id").select("chunk_id", "doc_id", "ord")


@query(f"""WITH want(pos, chunk_id) AS (VALUES (0, 'ch-00-0000009'), (1, 'ch-00-0000002'), (2, 'nope'), (3, 'ch-00-0000009'))
           SELECT w.pos, c.chunk_id, c.doc_id FROM want w JOIN {_CH} c USING (chunk_id)""")
def ordered_lookup(spark, d):
    want = spark.createDataFrame([(0, "ch-00-0000009"), (1, "ch-00-0000002"), (2, "nope"), (3, "ch-00-0000009")], "pos int, chunk_id string")
    return chunk_rows(spark, d).join(F.broadcast(want), "chunk_id").select("pos", "chunk_id", "doc_id")


@query("""SELECT chunk_id FROM (SELECT DISTINCT chunk_id, section_type, is_boilerplate, section_path_json FROM chunks)
          WHERE coalesce(is_boilerplate, false) = false
          AND coalesce(section_type, 'body') NOT IN ('references','acknowledgments','appendix','figure','table','caption','boilerplate')
          AND coalesce(json_extract_string(section_path_json, '$[0]'), '') <> '__image__'""")
def body_prose(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "section_type", "is_boilerplate", "section_path_json").distinct()
    return c.where(
        ~F.coalesce("is_boilerplate", F.lit(False))
        & ~F.coalesce("section_type", F.lit("body")).isin(t.SKIPPED_SECTIONS)
        & (F.coalesce(F.get_json_object("section_path_json", "$[0]"), F.lit("")) != "__image__")
    ).select("chunk_id")


@query("""SELECT DISTINCT chunk_id FROM chunks WHERE len(list_filter(list_transform(from_json(section_path_json, '["VARCHAR"]'),
          lambda x: trim(regexp_replace(lower(x), '^[0-9.]+ *', ''))), lambda x: x <> '' AND (contains(x, 'result') OR contains('result', x)))) > 0""")
def fuzzy_section(spark, d):
    parts = F.transform(F.from_json("section_path_json", "array<string>"), lambda x: F.trim(F.regexp_replace(F.lower(x), "^[0-9.]+ *", "")))
    hit = F.exists(parts, lambda x: (x != "") & (x.contains("result") | F.lit("result").contains(x)))
    return table(spark, d, "chunks").where(hit).select("chunk_id").distinct()


def _bm25_sql(src: str, key: str, fields: dict[str, float], terms: list[str]) -> str:
    posts = " UNION ALL ".join(f"SELECT {key}, unnest(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}-]+')) AS term, {w}::DOUBLE AS w FROM src" for f, w in fields.items())
    size = " + ".join(f"coalesce(len(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}-]+')), 0)" for f in fields)
    ts = ", ".join(f"'{x}'" for x in terms)
    return f"""
      src AS ({src}), posts AS ({posts}),
      tf AS (SELECT {key}, term, sum(w) AS tf FROM posts WHERE term IN ({ts}) GROUP BY 1, 2),
      sizes AS (SELECT {key}, {size} AS n FROM src),
      corpus AS (SELECT count(*) AS big_n, avg(n) AS avg_n FROM sizes),
      dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      bm AS (SELECT tf.{key}, sum(greatest(ln((big_n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) AS score, count(*) AS hits
             FROM tf JOIN dfs USING (term) JOIN sizes USING ({key}), corpus GROUP BY 1 HAVING count(*) = {len(terms)})"""


@query("WITH" + _bm25_sql("SELECT DISTINCT chunk_id, text FROM chunks", "chunk_id", {"text": 1.0}, ["graphene", "ellipsometry"]) + " SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_chunks(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return s.bm25(c, "chunk_id", {"text": 1.0}, ["graphene", "ellipsometry"]).select("chunk_id", F.round("score", 6).alias("score"))


@query("WITH" + _bm25_sql("SELECT doc_id, title, abstract FROM documents", "doc_id", {"title": 4.0, "abstract": 1.0}, ["hardness"]) + " SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_documents(spark, d):
    return s.bm25(table(spark, d, "documents"), "doc_id", {"title": 4.0, "abstract": 1.0}, ["hardness"]).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH" + _bm25_sql("SELECT DISTINCT chunk_id, text FROM chunks WHERE doc_id = 7", "chunk_id", {"text": 1.0}, ["wettability"]) + " SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_in_document(spark, d):
    c = table(spark, d, "chunks").where("doc_id = 7").select("chunk_id", "text").distinct()
    return s.bm25(c, "chunk_id", {"text": 1.0}, ["wettability"]).select("chunk_id", F.round("score", 6).alias("score"))


def _seed_vector(spark, d, vec_id):
    e = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(v.as_double(F.col("embedding")).alias("e")).head()
    return e["e"] if e else [0.0]


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
          SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 10""")
def cosine_top10(spark, d):
    e = table(spark, d, "embeddings")
    q = _seed_vector(spark, d, e.agg(F.min("vec_id")).first()[0])
    return s.cosine_top(e, "vec_id", "embedding", q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS seed, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
          SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q WHERE vec_id <> seed
          ORDER BY list_dot_product(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 10""")
def more_like_this(spark, d):
    e = table(spark, d, "embeddings")
    seed = e.agg(F.min("vec_id")).first()[0]
    return s.cosine_top(e.where(F.col("vec_id") != seed), "vec_id", "embedding", _seed_vector(spark, d, seed), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
          SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q WHERE label = 3
          ORDER BY list_dot_product(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 10""")
def scoped_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = _seed_vector(spark, d, e.agg(F.min("vec_id")).first()[0])
    return s.cosine_top(e.where("label = 3"), "vec_id", "embedding", q, 10).select("vec_id", F.round("score", 6).alias("score"))


def _hash_sql(src: str, key: str) -> str:
    h = "('0x' || substr(md5(lower(tok)), 1, 8))::BIGINT"
    return f"""
      toks AS (SELECT {key}, unnest(regexp_extract_all(txt, '[A-Za-z][A-Za-z0-9_]+')) AS tok FROM ({src})),
      hs AS (SELECT {key}, {h} AS h FROM toks),
      comps AS (SELECT {key}, h % 128 AS i, 1.0::DOUBLE AS x FROM hs UNION ALL SELECT {key}, (h >> 8) % 128, CASE WHEN (h >> 4) & 1 = 1 THEN 1.0 ELSE -1.0 END FROM hs),
      vs AS (SELECT {key}, i, sum(x) AS x FROM comps GROUP BY 1, 2),
      ns AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM vs GROUP BY 1 HAVING sum(x * x) > 0),
      emb AS (SELECT vs.{key}, i, x / n AS x FROM vs JOIN ns USING ({key}) WHERE x <> 0)"""


@query("WITH" + _hash_sql("SELECT doc_id, title AS txt FROM documents", "doc_id") + " SELECT doc_id, i::BIGINT AS i, round(x, 6) AS x FROM emb")
def hash_embedding(spark, d):
    return v.hash_embedding(table(spark, d, "documents"), "doc_id", "title").select("doc_id", "i", F.round("x", 6).alias("x"))


_HYBRID = (
    "WITH"
    + _bm25_sql("SELECT doc_id, title, abstract FROM documents", "doc_id", {"title": 4.0, "abstract": 1.0}, ["graphene"])
    + ","
    + _hash_sql("SELECT doc_id, title AS txt FROM documents UNION ALL SELECT -1, 'conductivity of graphene'", "doc_id")
    + """,
      b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50)),
      cs AS (SELECT e.doc_id, round(sum(e.x * q.x), 9) AS score FROM emb e JOIN emb q ON q.i = e.i AND q.doc_id = -1 WHERE e.doc_id >= 0 GROUP BY 1),
      c AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM cs ORDER BY score DESC, doc_id LIMIT 50)),
      f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1)
      SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10"""
)


@query(_HYBRID)
def hybrid_search(spark, d):
    docs = table(spark, d, "documents")
    lexical = s.bm25(docs, "doc_id", {"title": 4.0, "abstract": 1.0}, ["graphene"])
    emb = v.hash_embedding(docs, "doc_id", "title")
    asked = v.hash_embedding(spark.createDataFrame([(-1, "conductivity of graphene")], "doc_id long, title string"), "doc_id", "title").select("i", F.col("x").alias("q"))
    near = emb.join(F.broadcast(asked), "i").groupBy("doc_id").agg(F.round(F.sum(F.col("x") * F.col("q")), 9).alias("score"))
    lists = [s.ranks(s.top(x, 50, F.desc("score"), F.asc("doc_id")), "doc_id", "score") for x in (lexical, near)]
    fused = s.fuse(lists, "doc_id")
    return s.top(fused, 10, F.desc("score"), F.asc("doc_id")).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "WITH"
    + _bm25_sql("SELECT DISTINCT chunk_id, text FROM chunks", "chunk_id", {"text": 1.0}, ["band", "gap"])
    + """,
      b AS (SELECT chunk_id, 'bm25' AS mode, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 20)),
      l AS (SELECT chunk_id, 'literal' AS mode, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT chunk_id FROM chunks WHERE contains(lower(text), 'band gap') ORDER BY 1 LIMIT 20))
      SELECT chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(mode, ',' ORDER BY mode) AS modes FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY 1"""
)
def multi_mode(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    bm = s.top(s.bm25(c, "chunk_id", {"text": 1.0}, ["band", "gap"]), 20, F.desc("score"), F.asc("chunk_id"))
    lit = s.top(c.where(t.contains_literal(F.col("text"), "band gap")).select("chunk_id", F.lit(0.0).alias("score")), 20, F.asc("chunk_id"))
    both = s.ranks(bm, "chunk_id", "score").withColumn("mode", F.lit("bm25")).unionByName(s.ranks(lit, "chunk_id", "score").withColumn("mode", F.lit("literal")))
    return both.groupBy("chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"))


@query(
    "WITH"
    + _bm25_sql("SELECT DISTINCT chunk_id, text FROM chunks", "chunk_id", {"text": 1.0}, ["hardness"])
    + """, h AS (SELECT c.doc_id, b.chunk_id, round(b.score, 9) AS score FROM bm b JOIN (SELECT DISTINCT chunk_id, doc_id FROM chunks) c USING (chunk_id)),
      top AS (SELECT * FROM h ORDER BY score DESC, chunk_id LIMIT 40)
      SELECT doc_id, round(max(score), 6) AS best, count(*) AS n, min_by(chunk_id, {'s': -score, 'c': chunk_id}) AS best_item FROM top GROUP BY 1
      ORDER BY max(score) DESC, n DESC, doc_id LIMIT 8"""
)
def papers_by_best_chunk(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "text").distinct()
    hits = s.bm25(c.select("chunk_id", "text"), "chunk_id", {"text": 1.0}, ["hardness"]).withColumn("score", F.round("score", 9)).join(c.select("chunk_id", "doc_id"), "chunk_id")
    pool = s.top(hits, 40, F.desc("score"), F.asc("chunk_id"))
    best = s.best_per_group(pool, "doc_id", "chunk_id", "score")
    return s.top(best, 8, F.desc("best"), F.desc("n"), F.asc("doc_id")).select("doc_id", F.round("best", 6).alias("best"), "n", "best_item")


@query("""SELECT publisher, doc_id, n_chunks::BIGINT AS n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY n_chunks DESC, doc_id) AS rn FROM documents WHERE publisher IS NOT NULL) WHERE rn <= 2""")
def cap_per_publisher(spark, d):
    docs = table(spark, d, "documents").where("publisher is not null").select("publisher", "doc_id", F.col("n_chunks").cast("long").alias("n_chunks"))
    return s.cap_per_group(docs, "publisher", 2, F.desc("n_chunks"), F.asc("doc_id"))


@query("""SELECT doc_id, coalesce(n_chunks, 0)::BIGINT AS n FROM documents ORDER BY coalesce(n_chunks, 0) DESC, doc_id LIMIT 20""")
def top_by_metric(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n"))
    return s.top(docs, 20, F.desc("n"), F.asc("doc_id"))


@query("""WITH r AS (SELECT doc_id, n_chunks FROM documents ORDER BY coalesce(n_chunks, 0) DESC, doc_id LIMIT 5),
          c AS (SELECT DISTINCT chunk_id, doc_id, ord FROM chunks)
          SELECT c.chunk_id, c.doc_id, c.ord FROM r JOIN c USING (doc_id) ORDER BY r.n_chunks DESC, c.doc_id, c.ord, c.chunk_id LIMIT 20""")
def metric_to_chunks(spark, d):
    r = s.top(table(spark, d, "documents").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("m")), 5, F.desc("m"), F.asc("doc_id"))
    c = table(spark, d, "chunks").select("chunk_id", "doc_id", "ord").distinct()
    return s.top(c.join(F.broadcast(r), "doc_id"), 20, F.desc("m"), F.asc("doc_id"), F.asc("ord"), F.asc("chunk_id")).select("chunk_id", "doc_id", "ord")


@query("""WITH a AS (SELECT doc_id, unnest(from_json(authors_json, '["VARCHAR"]')) AS author FROM documents),
          g AS (SELECT author, count(DISTINCT doc_id) AS n FROM a GROUP BY 1)
          SELECT author, n FROM g ORDER BY n DESC, author LIMIT 8""")
def authors_by_papers(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.explode(F.from_json("authors_json", "array<string>")).alias("author"))
    return s.top(a.groupBy("author").agg(F.count_distinct("doc_id").alias("n")), 8, F.desc("n"), F.asc("author"))
