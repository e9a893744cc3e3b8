"""The event ledger, evaluation metrics, streams and writers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import vectors as v
from kilnwork.operators import corpus, evaluate
from kilnwork.plans.registry import query
from kilnwork.runtime import table
from kilnwork.sources import sinks
from kilnwork.streaming import ledger


def events(spark, d):
    return table(spark, d, "events")


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, GROUPING_ID(user_id, event_type)::BIGINT AS level FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), (event_type), ())""")
def telemetry_grouping_sets(spark, d):
    return ledger.rollup(events(spark, d))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
          count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def actor_type_matrix(spark, d):
    return events(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT CASE event_type WHEN 'purchase' THEN 'L' WHEN 'click' THEN 'M' ELSE 'S' END AS tier, count(*) AS calls,
          round(sum(value * (CASE event_type WHEN 'purchase' THEN 15.0 WHEN 'click' THEN 3.0 ELSE 1.0 END) + (CASE event_type WHEN 'purchase' THEN 300.0 WHEN 'click' THEN 100.0 ELSE 50.0 END)), 4) AS cost FROM events GROUP BY 1""")
def cost_by_tier(spark, d):
    e = events(spark, d)
    tier = F.when(F.col("event_type") == "purchase", "L").when(F.col("event_type") == "click", "M").otherwise("S")
    price = F.when(tier == "L", 15.0).when(tier == "M", 3.0).otherwise(1.0)
    over = F.when(tier == "L", 300.0).when(tier == "M", 100.0).otherwise(50.0)
    return e.groupBy(tier.alias("tier")).agg(F.count("*").alias("calls"), F.round(F.sum(F.col("value") * price + over), 4).alias("cost"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step FROM events")
def timeline_steps(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("step"))


@query("SELECT user_id, max_by(event_type, {'t': ts, 'i': event_id}) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return ledger.latest(events(spark, d).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25")
def event_tail(spark, d):
    return events(spark, d).where("event_type = 'error'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(25)


@query("""WITH r AS (SELECT *, (date_trunc('day', ts)::DATE - DATE '2024-01-01')::INT AS round FROM events), k AS (SELECT user_id, max(round) AS last_any, max(CASE WHEN event_type = 'purchase' THEN round END) AS last_evidence FROM r GROUP BY 1), m AS (SELECT max(round) AS now FROM r)
          SELECT user_id, last_any, last_evidence, coalesce(now - last_evidence >= 2, true) AS stalled FROM k, m""")
def round_stall(spark, d):
    r = events(spark, d).select("user_id", "event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("round"))
    now = r.agg(F.max("round").alias("now"))
    k = r.groupBy("user_id").agg(F.max("round").alias("last_any"), F.max(F.when(F.col("event_type") == "purchase", F.col("round"))).alias("last_evidence"))
    return k.crossJoin(F.broadcast(now)).select("user_id", "last_any", "last_evidence", F.coalesce((F.col("now") - F.col("last_evidence")) >= 2, F.lit(True)).alias("stalled"))


@query("SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def props_counts(spark, d):
    return events(spark, d).groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    s = ledger.read(spark, f"{d}/events.parquet")
    out = ledger.run(ledger.tumbling(s, "6 hours", ["event_type"]), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT time_bucket(INTERVAL '2 hours', ts) - k * INTERVAL '2 hours' AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    s = ledger.read(spark, f"{d}/events.parquet")
    out = ledger.run(ledger.sliding(s, "6 hours", "2 hours", ["event_type"]), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '12 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL)::INT AS new FROM events),
          s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    s = ledger.read(spark, f"{d}/events.parquet")
    out = ledger.run(ledger.sessions(s, "12 hours", "user_id"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_distinct(spark, d):
    s = ledger.read(spark, f"{d}/events.parquet")
    return ledger.run(ledger.distinct(s, ["event_id"], "400 days")).select("event_id")


@query("""SELECT user_id, max(ts) AS last_any, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_evidence FROM events GROUP BY 1""")
def stream_state(spark, d):
    s = ledger.read(spark, f"{d}/events.parquet").select("user_id", "event_type", "ts")
    out = ledger.run(ledger.latest_rounds(s, "user_id", "event_type", "purchase"), "update", ["user_id"])
    return out.select("user_id", F.col("last_any").cast("timestamp_ntz").alias("last_any"), F.col("last_evidence").cast("timestamp_ntz").alias("last_evidence"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, doc_id, section_type, is_boilerplate FROM chunks), u AS (SELECT DISTINCT chunk_id FROM data_points)
          SELECT c.doc_id, count(*) AS addressable, count(u.chunk_id) AS covered, round(count(u.chunk_id) / count(*)::DOUBLE, 6) AS ratio FROM c LEFT JOIN u USING (chunk_id)
          WHERE coalesce(is_boilerplate, false) = false AND coalesce(section_type, 'body') NOT IN ('references','acknowledgments','appendix','figure','table','caption','boilerplate') GROUP BY 1""")
def chunk_coverage(spark, d):
    return corpus.coverage(table(spark, d, "chunks"), table(spark, d, "data_points"))


@query("SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM chunks) EXCEPT SELECT chunk_id FROM data_points")
def residual_chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id").distinct().join(table(spark, d, "data_points").select("chunk_id").distinct(), "chunk_id", "left_anti")


@query("""WITH r AS (SELECT DISTINCT chunk_id FROM chunks), u AS (SELECT DISTINCT chunk_id FROM data_points WHERE verification_status = 'verified')
          SELECT count(*) AS n_read, count(u.chunk_id) AS n_used, round(count(u.chunk_id) / count(*)::DOUBLE, 6) AS rate FROM r LEFT JOIN u USING (chunk_id)""")
def hit_rate(spark, d):
    return evaluate.hit_rate(table(spark, d, "chunks"), table(spark, d, "data_points").where("verification_status = 'verified'"), "chunk_id")


@query("""WITH n AS (SELECT property_norm AS concept, doc_id, count(*) AS n FROM (SELECT DISTINCT * FROM data_points) WHERE property_norm IS NOT NULL GROUP BY 1, 2)
          SELECT concept, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS hhi FROM n GROUP BY 1""")
def concentration(spark, d):
    p = table(spark, d, "data_points").distinct().where("property_norm is not null").withColumnRenamed("property_norm", "concept")
    return evaluate.hhi(p, "concept", "doc_id").select("concept", F.round("hhi", 6).alias("hhi"))


@query("""WITH e AS (SELECT DISTINCT subject_norm AS concept, chunk_id, doc_id, value_type AS kind FROM data_points WHERE subject_norm IS NOT NULL AND chunk_id IS NOT NULL),
          b AS (SELECT concept, count(DISTINCT chunk_id) AS n, count(DISTINCT doc_id) AS docs, count(DISTINCT kind) AS kinds FROM e GROUP BY 1),
          c AS (SELECT concept, sum(n * n) / (sum(n) * sum(n))::DOUBLE AS hhi FROM (SELECT concept, doc_id, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
          s AS (SELECT concept, n, docs, kinds, round(0.25 * least(n / 12.0, 1.0) + 0.15 * least(docs / 8.0, 1.0) + 0.30 * least(kinds / 4.0, 1.0) + 0.20 + 0.10 * (1 - hhi), 6) AS score FROM b JOIN c USING (concept))
          SELECT *, CASE WHEN n < 8 OR docs < 4 THEN 'new' WHEN score >= 0.7 THEN 'ready' WHEN score >= 0.5 THEN 'growing' ELSE 'new' END AS band FROM s""")
def maturity(spark, d):
    e = table(spark, d, "data_points").where("subject_norm is not null and chunk_id is not null").select(F.col("subject_norm").alias("concept"), "chunk_id", "doc_id", F.col("value_type").alias("kind")).distinct()
    return evaluate.maturity(e)


@query("""WITH l AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2),
          n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1), p AS (SELECT label, list(CASE WHEN n > 0 THEN x / n ELSE x END ORDER BY i) AS e FROM m JOIN n USING (label) GROUP BY 1),
          s AS (SELECT vec_id, max(list_dot_product(embedding::DOUBLE[], p.e)) AS s FROM embeddings, p GROUP BY 1) SELECT round(avg(greatest(0, 1 - s)), 6) AS residual FROM s""")
def coverage_residual(spark, d):
    e = table(spark, d, "embeddings")
    pages = v.mean_pool(e, "label", "embedding").select(F.col("label").alias("page"), F.col("embedding").alias("e"))
    return evaluate.coverage_residual(e.select(F.col("vec_id").alias("id"), v.as_double(F.col("embedding")).alias("e")), pages).select(F.round("residual", 6).alias("residual"))


@query("""WITH f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), dd AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) AS cost FROM dd),
          u AS (SELECT c.day, c.cost, count(f.user_id) AS seen FROM c JOIN f ON date_trunc('day', f.t) <= c.day GROUP BY 1, 2)
          SELECT round(regr_slope(ln(greatest(seen::DOUBLE, 1)), ln(greatest(cost::DOUBLE, 1))), 6) AS exponent FROM u""")
def heaps_exponent(spark, d):
    e = events(spark, d)
    days = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("t")).groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("fresh"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)  # one row a day
    curve = days.join(first, "day", "left").select(F.sum("n").over(w).alias("cost"), F.sum(F.coalesce("fresh", F.lit(0))).over(w).alias("seen"))
    return evaluate.heaps(curve.where("seen > 0"), "cost", "seen").select(F.round("exponent", 6).alias("exponent"))


@query("""SELECT quantile_cont(year, 0.25) AS p25, quantile_cont(year, 0.75) AS p75, count(*) FILTER (year <= (SELECT quantile_cont(year, 0.25) FROM documents)) AS early, count(*) FILTER (year > (SELECT quantile_cont(year, 0.75) FROM documents)) AS late FROM documents""")
def era_buckets(spark, d):
    docs = table(spark, d, "documents").where("year is not null").select("year")
    q = docs.agg(F.percentile("year", 0.25).alias("p25"), F.percentile("year", 0.75).alias("p75"))
    return docs.crossJoin(F.broadcast(q)).groupBy("p25", "p75").agg(F.sum((F.col("year") <= F.col("p25")).cast("long")).alias("early"), F.sum((F.col("year") > F.col("p75")).cast("long")).alias("late"))


@query("""WITH a AS (SELECT doc_id AS id FROM documents WHERE kind = 'pdf'), b AS (SELECT doc_id AS id FROM documents WHERE source = 'scanroom')
          SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
          UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, d):
    docs = table(spark, d, "documents")
    a, b = docs.where("kind = 'pdf'").select(F.col("doc_id").alias("id")), docs.where("source = 'scanroom'").select(F.col("doc_id").alias("id"))
    one = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return one("union", a.unionByName(b).distinct()).unionByName(one("intersect", a.intersect(b))).unionByName(one("except", a.exceptAll(b)))


@query("""WITH n AS (SELECT p_partkey AS k, 'new' AS v FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey + 1000000, 'added' FROM part WHERE p_size = 1),
          o AS (SELECT p_partkey AS k, 'old' AS v FROM part) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upsert(spark, d):
    p = table(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("k"), F.lit("old").alias("v"))
    new = p.where("p_size > 40").select(F.col("p_partkey").alias("k"), F.lit("new").alias("v")).unionByName(p.where("p_size = 1").select((F.col("p_partkey") + 1000000).alias("k"), F.lit("added").alias("v")))
    return sinks.upserted(old, new, ["k"])


@query("""SELECT l_orderkey, l_linenumber, 0 AS fresh FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 1, 1 FROM orders WHERE o_orderstatus = 'F'""")
def replace_per_document(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("fresh"))
    new = done.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("fresh"))
    return sinks.replaced_per(old, new, "l_orderkey", done.select(F.col("o_orderkey").alias("l_orderkey")))


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return sinks.without({"lineitem": table(spark, d, "lineitem")}, gone, "l_orderkey")["lineitem"].agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT coalesce(parent_id, '') AS parent_id, string_agg(category_id, ',' ORDER BY coalesce(sort_order, 0), lower(name), category_id) AS children
          FROM (SELECT DISTINCT category_id, parent_id, sort_order, name FROM wiki_categories) GROUP BY 1""")
def navigation_lists(spark, d):
    return sinks.navigation(table(spark, d, "wiki_categories")).select("parent_id", F.array_join("children", ",").alias("children"))


@query("""SELECT 'documents' AS node, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'authors', count(*) FROM authors
          UNION ALL SELECT 'works', count(*) FROM works UNION ALL SELECT 'claims', count(DISTINCT claim_id) FROM data_points UNION ALL SELECT 'categories', count(DISTINCT category_id) FROM wiki_categories""")
def corpus_stats(spark, d):
    parts = [("documents", "doc_id"), ("chunks", "chunk_id"), ("authors", "author_id"), ("works", "doi"), ("data_points", "claim_id"), ("wiki_categories", "category_id")]
    names = {"data_points": "claims", "wiki_categories": "categories"}
    out = None
    for t_, k in parts:
        one = table(spark, d, t_).agg(F.lit(names.get(t_, t_)).alias("node"), F.count_distinct(k).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def louvain_pages(spark, d):
    """Communities of the nations by shared suppliers' parts; the graph of a fixed list of nations is bounded."""
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    m = li.join(F.broadcast(su.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g"))) if su.count() < 100_000 else su.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g")), "l_suppkey").select("g", F.col("l_partkey").alias("p")).distinct()
    pairs = m.groupBy("p").agg(F.sort_array(F.collect_set("g")).alias("gs")).select(F.explode(F.expr("flatten(transform(gs, (x, i) -> transform(slice(gs, i + 2, size(gs)), y -> struct(x as a, y as b))))")).alias("e"))
    w = pairs.groupBy("e.a", "e.b").agg(F.count("*").alias("w")).collect()
    n = max((r["b"] for r in w), default=-1) + 1
    groups = evaluate.louvain([(r["a"], r["b"], float(r["w"])) for r in w], n)
    return spark.createDataFrame(list(enumerate(groups)), "id int, community int")


@query()
def diverse_vectors(spark, d):
    picked = evaluate.diverse_rows(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return spark.createDataFrame(list(enumerate(picked)), "pick int, vec_id long")
