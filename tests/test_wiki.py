"""Wiki and citation operators on hand-made rows."""

from pyspark.sql import functions as F

from kilnwork.operators import citations, wiki


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_grounding_window(spark):
    s = spark.createDataFrame([("p", 0, i, "fact [^e1]." if i == 0 else "fact.") for i in range(4)] + [("q", 0, 0, "x [^e9].")], "page_id string, par int, ord int, text string")
    e = spark.createDataFrame([("p", "e1")], "page_id string, marker string")
    assert rows(wiki.grounding(s, e), "page_id", "near", "resolved", "passed") == [("p", 0.75, 1.0, False), ("q", 1.0, 0.0, False)]


def test_quotes(spark):
    df = spark.createDataFrame([("the  film", "On THE film [1-3] here"), ("thin films grown", "thinfilmsgrown well"), ("abc", "a bc"), (None, "x"), ("x", None)], "q string, s string")
    assert [r[0] for r in df.select(wiki.quote_found(F.col("q"), F.col("s"))).collect()] == [True, True, False, False, False]


def test_refine_and_markers(spark):
    snap = spark.createDataFrame([("a", 4, 1), ("a", 8, 2), ("b", 10, 1)], "slug string, n int, at int")
    live = spark.createDataFrame([("a", 12), ("b", 12)], "slug string, n int")
    assert rows(wiki.refine_candidates(snap, live), "slug", "then", "now") == [("a", 8, 12)]
    used = spark.createDataFrame([("p", "e1"), ("p", "e2")], "page_id string, marker string")
    have = spark.createDataFrame([("p", "e2"), ("p", "e3")], "page_id string, marker string")
    assert rows(wiki.marker_differences(used, have), "marker", "side") == [("e1", "undeclared"), ("e3", "unused")]


def test_navigation_errors(spark):
    g = spark.createDataFrame([("g1", None, "p1"), ("g1", None, "p2"), ("g2", "g1", "p2"), ("g3", "g2", "zz"), ("g4", "g3", None), ("g5", "g6", "p3"), ("g6", "g5", "p4")], "group_id string, parent_id string, page_id string")
    pages = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "page_id string")
    assert rows(wiki.navigation_errors(g, pages), "error", "item") == [("empty group", "g4"), ("page in several groups", "p2"), ("too deep", "g4"), ("too deep", "g5"), ("too deep", "g6"), ("unknown page", "zz")]


def test_mentioned_artifacts(spark):
    c = spark.createDataFrame([("c", 1, "see Fig. 2 and Table 1, figure 2"), ("d", 1, None)], "chunk_id string, doc_id int, text string")
    caps = spark.createDataFrame([(1, "figure", 2, 5, "F"), (1, "figure", 2, 9, "G"), (1, "table", 7, 1, "T")], "doc_id int, kind string, number int, char_start int, caption string")
    assert rows(wiki.mentioned_artifacts(c, caps), "chunk_id", "kind", "number", "caption") == [("c", "figure", 2, "F")]


def test_reresolve_tiers(spark):
    docs = spark.createDataFrame([(1, "10.1/a", 2000, "A first long title about thin films and glass"), (2, None, 2001, "Another rather long title about hardness of layers")], "doc_id long, doi string, year int, title string")
    refs = spark.createDataFrame([("r1", "https://doi.org/10.1/A", None, None, None), ("r2", None, "another rather long title about hardness of layers", 2001, None), ("r3", None, None, 2001, "[4] X., Another rather long title about hardness of layers, J. 2001"), ("r4", None, None, 1999, "Another rather long title about hardness of layers")], "ref_id string, doi string, title string, year int, raw string")
    assert rows(citations.reresolve(refs, docs), "ref_id", "doc_id", "confidence") == [("r1", 1, 1.0), ("r2", 2, 0.85), ("r3", 2, 0.75)]


def test_reresolve_reads_whole_references(spark):
    docs = spark.createDataFrame([(2, None, 2001, "Another rather long title about hardness of layers")], "doc_id long, doi string, year int, title string")
    refs = spark.createDataFrame([("r1", None, None, 2001, "Coauthor A., " * 120 + "Another rather long title about hardness of layers")], "ref_id string, doi string, title string, year int, raw string")
    assert rows(citations.reresolve(refs, docs), "ref_id", "doc_id", "confidence") == [("r1", 2, 0.75)]


def test_fusion_topics_inbox_walk(spark):
    c = spark.createDataFrame([("A title", 2000, "10.1/X"), ("A longer title", 2000, "10.1/x"), ("t", 1999, "10.1/X")], "title string, year int, doi string")
    assert rows(citations.fused(c), "n", "title", "year") == [(3, "A longer title", 2000)]
    d = spark.createDataFrame([(1, "Thin films of oxide", None)], "doc_id int, title string, abstract string")
    tp = citations.topics(d, ["oxide", "thin films", "film"])
    assert rows(tp, "topic") == [("oxide",), ("thin films",)]
    assert citations.fields(tp, {"m": ["oxide", "thin films"], "b": ["cell"]}, least=2) == "m" and citations.fields(tp, {}) == "generic"
    box = spark.createDataFrame([("a", "evidence", "c1", None), ("z", "concept", "c1", None), ("z", "concept", "c2", None), ("z", "concept", "c3", None), ("y", "concept", "c1", True), ("w", "concept", "c1", None)], "slug string, kind string, chunk_id string, deliberate boolean")
    ev, ok, rest = citations.drained(box, spark.createDataFrame([("a",)], "slug string"))
    assert rows(ev, "slug") == [("a",)] and rows(ok, "slug") == [("y",), ("z",)] and rows(rest, "slug") == [("w",)]
    hits = spark.createDataFrame([("c1",)], "chunk_id string")
    cites = spark.createDataFrame([("c1", "d2"), ("c2", "d1")], "chunk_id string, doc_id string")
    sc = spark.createDataFrame([("c1", "d1", 0.5), ("c2", "d2", 0.9), ("c3", "d2", 0.9)], "chunk_id string, doc_id string, score double")
    assert rows(citations.cited_walk(hits, cites, sc), "hop", "from_chunk", "doc_id", "to_chunk") == [(1, "c1", "d2", "c2"), (2, "c2", "d1", "c1")]
