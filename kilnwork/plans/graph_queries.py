"""Graph operators on the order, supplier, author and region tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.functions import vectors as v
from kilnwork.operators import graph as g
from kilnwork.plans.registry import query
from kilnwork.runtime import join_measured, table


def ids(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], "id long")


def cites(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite the parts of their lines."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def bylines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.from_json("authors_json", "array<string>")).alias("author")).distinct()


_BY = """(SELECT DISTINCT doc_id, author FROM (SELECT doc_id, unnest(from_json(authors_json, '["VARCHAR"]')) AS author FROM documents))"""
_GEO = """(SELECT DISTINCT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL
           SELECT DISTINCT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT DISTINCT 'C' || o_custkey, 'O' || o_orderkey FROM orders)"""


def geo(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    k = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return (
        n.select(k("R", "n_regionkey").alias("src"), k("N", "n_nationkey").alias("dst")).distinct()
        .unionByName(c.select(k("N", "c_nationkey").alias("src"), k("C", "c_custkey").alias("dst")).distinct())
        .unionByName(o.select(k("C", "o_custkey").alias("src"), k("O", "o_orderkey").alias("dst")).distinct())
    )


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (1, 2, 3)")
def references(spark, d):
    return g.neighbours(cites(spark, d), ids(spark, 1, 2, 3), "out")


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (1, 2, 3)")
def cited_by(spark, d):
    return g.neighbours(cites(spark, d), ids(spark, 1, 2, 3), "in")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey = 1 AND l_linenumber IN (1, 3)")
def references_by_ordinal(spark, d):
    want = spark.createDataFrame([(1,), (3,)], "l_linenumber int")
    return table(spark, d, "lineitem").where("l_orderkey = 1").join(F.broadcast(want), "l_linenumber", "left_semi").select(F.col("l_partkey").alias("id")).distinct()


@query(f"SELECT b.author, count(*) AS n_docs FROM {_BY} b JOIN documents d USING (doc_id) WHERE d.publisher = 'Eldermoor Press' GROUP BY 1")
def authors_of_sources(spark, d):
    docs = table(spark, d, "documents").where("publisher = 'Eldermoor Press'").select("doc_id")
    return bylines(spark, d).join(docs, "doc_id").groupBy("author").agg(F.count("*").alias("n_docs"))


@query(f"SELECT a.author AS a, b.author AS b, count(*) AS shared FROM {_BY} a JOIN {_BY} b ON a.doc_id = b.doc_id AND a.author <> b.author WHERE a.author = 'J. Jaeleimoor' GROUP BY 1, 2")
def coauthors(spark, d):
    seed = spark.createDataFrame([("J. Jaeleimoor",)], "id string")
    return g.co_members(bylines(spark, d), "doc_id", "author", seed)


@query(f"""WITH p AS (SELECT DISTINCT a.author AS a, b.author AS b FROM {_BY} a JOIN {_BY} b ON a.doc_id = b.doc_id AND a.author < b.author)
           SELECT author, count(*) AS n FROM (SELECT a AS author FROM p UNION ALL SELECT b FROM p) GROUP BY 1""")
def coauthor_count(spark, d):
    b = bylines(spark, d)
    pairs = b.select("doc_id", F.col("author").alias("a")).join(b.select("doc_id", F.col("author").alias("b")), "doc_id").where("a < b").select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("author")).unionByName(pairs.select(F.col("b").alias("author")))
    return ends.groupBy("author").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
          n AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM m a JOIN m b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2 HAVING count(*) >= 3)
          SELECT a, b, shared, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM n) WHERE rank <= 5""")
def coupling_top5(spark, d):
    m = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return g.coupling(m, "l_partkey", "l_suppkey", strength=3, k=5)


@query("SELECT p_partkey AS id, count(DISTINCT l_orderkey) AS citations FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def citation_count(spark, d):
    inc = cites(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("citations"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(inc, "id", "left").select("id", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
          SELECT l_suppkey AS id, sum(n)::BIGINT AS citations FROM s JOIN c USING (l_partkey) GROUP BY 1""")
def author_citation_sum(spark, d):
    li = table(spark, d, "lineitem")
    c = li.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return li.select("l_suppkey", "l_partkey").distinct().join(c, "l_partkey").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("n").alias("citations"))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
          r AS (SELECT l_suppkey, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS r FROM s JOIN c USING (l_partkey))
          SELECT l_suppkey, max(CASE WHEN n >= r THEN r ELSE 0 END)::INT AS h FROM r GROUP BY 1""")
def h_index_supplier(spark, d):
    li = table(spark, d, "lineitem")
    c = li.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return g.h_index(li.select("l_suppkey", "l_partkey").distinct().join(c, "l_partkey"), "l_suppkey", "n")


@query(f"""SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {_GEO} UNION ALL SELECT dst, 0, 1 FROM {_GEO}) GROUP BY 1""")
def degree(spark, d):
    return g.degrees(geo(spark, d))


@query(f"""WITH e AS {_GEO}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), k AS (SELECT count(*) AS n FROM n)
           SELECT id, round(count(*) / (k.n - 1)::DOUBLE, 8) AS centrality FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e), k GROUP BY id, k.n""")
def degree_centrality(spark, d):
    deg = g.degrees(geo(spark, d))
    n = deg.count()
    return deg.select("id", F.round((F.col("out_degree") + F.col("in_degree")) / F.lit(float(n - 1)), 8).alias("centrality"))


def _pagerank_sql(rounds: int) -> str:
    steps, prev = [], "r0"
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT n.id, 0.85 * (coalesce(sum(p.rank * w.p), 0) + (SELECT coalesce(sum(rank), 0) FROM {prev} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n))"
            f" + 0.15 / (SELECT count(*) FROM n) AS rank FROM n LEFT JOIN w ON w.dst = n.id LEFT JOIN {prev} p ON p.id = w.src GROUP BY n.id)"
        )
        prev = f"r{k}"
    return f"""WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 1000000 + l_partkey, s_nationkey - 100 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
      n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
      w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM e),
      r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n), {', '.join(steps)}
      SELECT id, round(rank, 8) AS rank FROM {prev}"""


@query(_pagerank_sql(3))
def pagerank_three_rounds(spark, d):
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    part = (F.lit(1000000) + F.col("l_partkey")).cast("long")
    e = li.select(F.col("l_suppkey").cast("long").alias("src"), part.alias("dst")).distinct().unionByName(
        li.join(su, li["l_suppkey"] == su["s_suppkey"]).select(part.alias("src"), (F.col("s_nationkey") - 100).cast("long").alias("dst")).distinct()
    )
    n = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return g.pagerank(n, e, fixed=3).select("id", F.round("rank", 8).alias("rank"))


@query()
def pagerank(spark, d):
    e = geo(spark, d)
    n = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return g.pagerank(n, e).select("id", F.round("rank", 8).alias("rank"))


@query(f"""WITH RECURSIVE e AS {_GEO}, w AS (SELECT 1 AS depth, dst AS id FROM e WHERE src = 'R1'
           UNION SELECT depth + 1, e.dst FROM w JOIN e ON e.src = w.id WHERE depth < 3) SELECT depth::INT AS depth, id FROM w""")
def traverse_depth3(spark, d):
    return g.traverse(geo(spark, d), spark.createDataFrame([("R1",)], "id string"), depth=3)


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_GEO} UNION SELECT dst, src FROM {_GEO}),
           w AS (SELECT 0 AS depth, 'N3' AS id UNION SELECT depth + 1, e.dst FROM w JOIN e ON e.src = w.id WHERE depth < 2) SELECT DISTINCT id FROM w WHERE id <> 'N3'""")
def neighbourhood_two_hops(spark, d):
    return g.neighbourhood(geo(spark, d), spark.createDataFrame([("N3",)], "id string"), 2)


@query(f"""WITH e AS {_GEO}, n AS (SELECT 'R1' AS id UNION SELECT dst FROM e WHERE src = 'R1') SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def subgraph_one_hop(spark, d):
    return g.subgraph(geo(spark, d), spark.createDataFrame([("R1",)], "id string"), 1)


@query("""SELECT 'R' || n_regionkey || '>N' || n_nationkey || '>C1>O' || o AS path, 3 AS depth
          FROM (SELECT c_nationkey FROM customer WHERE c_custkey = 1) JOIN nation ON n_nationkey = c_nationkey, (SELECT min(o_orderkey) AS o FROM orders WHERE o_custkey = 1) WHERE o IS NOT NULL""")
def shortest_path(spark, d):
    e = geo(spark, d)
    c = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_regionkey").head()
    o = table(spark, d, "orders").where("o_custkey = 1").agg(F.min("o_orderkey")).first()[0]
    found = g.shortest_path(e, f"R{c[0] if c else -1}", f"O{o}")
    return found.select(F.array_join("path", ">").alias("path"), "depth")


@query("""WITH RECURSIVE k AS (SELECT doc_id, 'd' || lower(doi) AS k FROM documents WHERE doi IS NOT NULL
             UNION SELECT doc_id, 't' || substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) FROM documents WHERE length(title) > 30),
          e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (k) WHERE a.doc_id <> b.doc_id),
          w AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r)
          SELECT id, min(r) AS component FROM w GROUP BY 1""")
def duplicate_components(spark, d):
    docs = table(spark, d, "documents")
    k = docs.where("doi is not null").select("doc_id", F.concat(F.lit("d"), F.lower("doi")).alias("k")).unionByName(
        docs.where("length(title) > 30").select("doc_id", F.concat(F.lit("t"), t.title_key(F.col("title"))).alias("k"))
    )
    # a star per key: members are linked to the smallest one, not to each other
    low = k.groupBy("k").agg(F.min("doc_id").alias("dst"), F.count("*").alias("n")).where("n > 1")
    e = k.join(low, "k").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()
    return g.components(docs.select(F.col("doc_id").alias("id")), e)


@query("""WITH RECURSIVE k AS (SELECT doc_id, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS k FROM documents WHERE length(title) > 30),
          c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS component FROM k)
          SELECT component, min_by(c.doc_id, {'n': -coalesce(n_chunks, 0), 'i': c.doc_id}) AS canonical, count(*) AS members
          FROM c JOIN documents d ON d.doc_id = c.doc_id GROUP BY 1 HAVING count(*) > 1""")
def canonical_duplicates(spark, d):
    docs = table(spark, d, "documents").where("length(title) > 30")
    keyed = docs.select("doc_id", t.title_key(F.col("title")).alias("k"), F.coalesce("n_chunks", F.lit(0)).alias("n"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("component"), F.min(F.struct((-F.col("n")).alias("n"), "doc_id"))["doc_id"].alias("canonical"), F.count("*").alias("members")).where("members > 1").drop("k")


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS doc FROM lineitem),
          n AS (SELECT a.p AS a, b.p AS b, count(*) AS shared FROM m a JOIN m b ON a.doc = b.doc AND a.p <> b.p GROUP BY 1, 2 HAVING count(*) >= 2)
          SELECT a, b, shared, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM n) WHERE rank <= 5""")
def relink_pages(spark, d):
    m = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return g.coupling(m, "l_partkey", "l_suppkey", strength=2, k=5)


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS g, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
          e AS (SELECT DISTINCT a.g AS src, b.g AS dst FROM m a JOIN m b ON a.p = b.p AND a.g < b.g),
          n AS (SELECT count(DISTINCT g) AS n FROM m), c AS (SELECT count(*) AS e FROM e)
          SELECT n, e, round(2.0 * e / (n * (n - 1)), 6) AS density, round(2.0 * e / n, 6) AS avg_degree FROM n, c""")
def evidence_graph_structure(spark, d):
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    m = join_measured(li, su.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g")), "l_suppkey").select("g", F.col("l_partkey").alias("p")).distinct()
    # nations are a fixed set, so a part has at most as many as there are nations
    e = m.groupBy("p").agg(F.sort_array(F.collect_set("g")).alias("gs")).select(F.explode(F.expr("flatten(transform(gs, (x, i) -> transform(slice(gs, i + 2, size(gs)), y -> struct(x as src, y as dst))))")).alias("e")).select("e.*").distinct()
    n = m.agg(F.count_distinct("g").alias("n"))
    return n.crossJoin(e.agg(F.count("*").alias("e"))).select("n", "e", F.round(2.0 * F.col("e") / (F.col("n") * (F.col("n") - 1)), 6).alias("density"), F.round(2.0 * F.col("e") / F.col("n"), 6).alias("avg_degree"))


@query(f"""WITH e AS {_GEO}, m AS (SELECT count(*)::DOUBLE AS m FROM e), gr AS (SELECT id, substr(id, 1, 1) AS grp FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)),
           d AS (SELECT grp, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) JOIN gr USING (id) GROUP BY 1),
           l AS (SELECT a.grp, count(*) AS l FROM e JOIN gr a ON a.id = src JOIN gr b ON b.id = dst WHERE a.grp = b.grp GROUP BY 1)
           SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN l USING (grp), m""")
def modularity_of_kinds(spark, d):
    e = geo(spark, d)
    groups = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().select("id", F.substring("id", 1, 1).alias("grp"))
    return g.modularity(e, groups).select(F.round("modularity", 6).alias("modularity"))


_POOL = """l AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings),
           m AS (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
           u AS (SELECT label, i, CASE WHEN n > 0 THEN x / n ELSE x END AS x FROM m JOIN n USING (label))"""


@query(f"WITH {_POOL} SELECT label, i::INT AS i, round(x, 6) AS x FROM u")
def mean_pool_label(spark, d):
    return v.mean_pool(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(f"""WITH {_POOL}, s AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS sim FROM u a JOIN u b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM s)
           SELECT a, b, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 5""")
def label_similarity_top5(spark, d):
    from pyspark.sql import Window as W

    u = v.mean_pool(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x"))
    a, b = u.select(F.col("label").alias("a"), "i", F.col("x").alias("xa")), u.select(F.col("label").alias("b"), "i", F.col("x").alias("xb"))
    sim = a.join(b, "i").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("sim"))
    w = W.partitionBy("a").orderBy(F.desc("sim"), "b")
    return sim.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("a", "b", F.round("sim", 6).alias("sim"), "rank")


@query("""WITH c AS (SELECT n_nationkey AS id, count(c_custkey)::DOUBLE AS x FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), m AS (SELECT min(x) AS lo, max(x) AS hi FROM c)
          SELECT id, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM c, m""")
def minmax_scaled(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    x = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("id")).agg(F.count("c_custkey").cast("double").alias("x"))
    m = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return x.crossJoin(F.broadcast(m)).select("id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5), 6).alias("scaled"))


@query()
def similarity_walk(spark, d):
    """Walk from the three smallest vector ids over the pairs of the walk's frontier."""
    e = table(spark, d, "embeddings").select("vec_id", v.as_double(F.col("embedding")).alias("e"))
    seeds = [r[0] for r in e.orderBy("vec_id").limit(3).collect()]
    pairs = e.select(F.col("vec_id").alias("a"), F.col("e").alias("ea")).join(e.select(F.col("vec_id").alias("b"), F.col("e").alias("eb")), F.col("a") != F.col("b")).select("a", "b", v.dot(F.col("ea"), F.col("eb")).alias("score"))
    steps = g.similarity_walk(pairs, seeds, depth=2, fan=3, threshold=0.2)
    return spark.createDataFrame(steps, "hop int, a long, b long, score double")


@query("""WITH t AS (SELECT o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS lo, o_custkey FROM orders)
          SELECT o_custkey, count(*) AS n, (max(lo) + 1)::BIGINT AS span FROM t GROUP BY 1""")
def ordinal_positions(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("lo", F.row_number().over(w) - 1).groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("lo") + 1).cast("long").alias("span"))
