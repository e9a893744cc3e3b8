"""Core operators against hand-computed results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.functions import vectors as v
from kilnwork.operators import claims, corpus, evaluate, fluent, forest, graph, parsing, search, units
from kilnwork.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "references") for a, b in pairs], "src string, dst string, kind string")


CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("50% done",), ("50 done",), ("a_b",), ("axb",), (None,)], "x string")
    assert rows(df.where(t.contains_literal(F.col("x"), "50%")), "x") == [("50% done",)]
    assert rows(df.where(t.contains_literal(F.col("x"), "A_B")), "x") == [("a_b",)]


def test_text_folds(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/ABC).",)], "x string")
    assert df.select(t.doi_normal(F.col("x"))).first()[0] == "10.1/abc"
    df = spark.createDataFrame([("see [1], [2-4] and [7, 9]",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(t.citation_marks(F.col("x"))).collect()] == [[1, 2, 3, 4, 7, 9], [], None]
    df = spark.createDataFrame([("1,200",), ("−2.5e-3",), ("10000",), ("1 200 nm",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(t.leading_number(F.col("x"))).collect()] == [1200.0, -2.5e-3, 10000.0, 1200.0, None, None]


def test_sections_and_kinds(spark):
    df = spark.createDataFrame([("2. Methods",), ("IV. Results and discussion",), ("**Summary**",), ("Summary of supporting information",), ("x",), ("Growth conditions",)], "h string")
    got = [r[0] for r in df.select(t.section_type(F.col("h"))).collect()]
    assert got == ["methods", "results", "conclusion", "appendix", "body", "methods"]


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, rank int")
    got = search.fuse([a, b], "id").orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in got] == ["y", "x", "z"] and got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_bm25_needs_all_terms(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None), (4, "beta gamma delta alpha")], "id int, text string")
    assert {r["id"] for r in search.bm25(df, "id", {"text": 1.0}, ["alpha", "beta"]).collect()} == {1, 4}


def test_traverse_repeats_nodes_at_depths(spark):
    seeds = spark.createDataFrame([("a",)], "id string")
    got = rows(graph.traverse(edges(spark, CYCLE), seeds, depth=3), "depth", "id")
    assert got == [(1, "b"), (1, "d"), (2, "c"), (3, "a")]
    assert rows(graph.neighbourhood(edges(spark, CYCLE), seeds, 2), "id") == [("b",), ("c",), ("d",)]


def test_shortest_path(spark):
    e = edges(spark, CYCLE)
    assert graph.shortest_path(e, "b", "d").collect()[0]["path"] == ["b", "c", "a", "d"]
    assert graph.shortest_path(e, "d", "a").collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)]
    top = list(range(80))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    nodes = spark.range(80).select(F.col("id"))
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert rows(graph.components(nodes, e), "id", "component") == [(i, find(i)) for i in range(80)]
    assert rows(graph.components(nodes.limit(0), e.limit(0)), "id") == []


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges(spark, [("a", "c"), ("b", "c"), ("d", "c"), ("a", "b")])).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and max(got, key=got.get) == "c" and got["b"] > got["e"]


def test_h_index(spark):
    df = spark.createDataFrame([("X", 3), ("X", 1), ("X", 0), *[("Y", 5)] * 4], "who string, n int")
    assert rows(graph.h_index(df, "who", "n"), "who", "h") == [("X", 1), ("Y", 4)]


def test_coupling(spark):
    m = spark.createDataFrame([(r, d) for d, rs in (("a", "1234"), ("b", "1234"), ("c", "12")) for r in rs], "ref string, doc string")
    assert rows(graph.coupling(m, "ref", "doc", strength=3), "a", "b", "shared") == [("a", "b", 4), ("b", "a", 4)]


def test_relink_pages_covers_every_page(spark, tmp_path):
    from kilnwork.plans.graph_queries import relink_pages

    spark.createDataFrame([(p, d) for p in (1, 41, 900) for d in (1, 2)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(relink_pages(spark, str(tmp_path)), "a", "b", "shared", "rank") == [(1, 41, 2, 1), (1, 900, 2, 2), (41, 1, 2, 1), (41, 900, 2, 2), (900, 1, 2, 1), (900, 41, 2, 2)]


def test_whole_quotes_need_the_whole_text(spark, tmp_path):
    from kilnwork.plans.claim_queries import whole_quotes_in_documents

    head = "The opening of this item is longer than forty characters"
    spark.createDataFrame([(1, f"{head} and ends so."), (2, f"{head} and ends otherwise."), (3, "   "), (4, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, f"Before. {head.upper()}  and [3]ends so. After."), (2, "forty characters and ends so."), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(whole_quotes_in_documents(spark, str(tmp_path)), "item_id", "n") == [(1, 1)]


def test_similarity_walk_claims_once(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (4, 2, 0.95), (4, 5, 0.7), (2, 3, 0.99), (2, 6, 0.66)], "a int, b int, score double")
    assert graph.similarity_walk(p, [1, 4], depth=2, fan=2, threshold=0.65) == [(1, 1, 2, 0.9), (1, 1, 3, 0.8), (1, 4, 5, 0.7), (2, 2, 6, 0.66)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    got = dict(v.mean_pool(df, "k", "v").collect())
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_segments_and_diff(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabba")] + [(1, 5, None)], "d int, o int, l string")
    assert rows(corpus.segments(df, "d", "o", F.col("l")), "segment", "first", "last") == [(0, 0, 1), (1, 2, 3), (2, 4, 4), (3, 5, 5)]
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string")
    new = spark.createDataFrame([(2, "y"), (3, "Z"), (4, "w")], "k int, h string")
    assert rows(corpus.diff(old, new, "k", "h"), "k", "change") == [(1, "deleted"), (2, "unchanged"), (3, "replaced"), (4, "new")]


def test_louvain_finds_two_blocks():
    e = [(a, b, 1.0) for block in (range(4), range(4, 8)) for a in block for b in block if a < b] + [(0, 4, 1.0)]
    got = evaluate.louvain(e, 8)
    assert len(set(got)) == 2 and len(set(got[:4])) == 1
    assert evaluate.louvain([], 3) == [0, 1, 2]


def test_diverse_sample_prefers_uncovered():
    assert evaluate.diverse_sample([[1, 0], [1, 0], [0, 1]], [0.5, 0.5, 0.5], 2) == [0, 2]


def test_diverse_vectors_reads_every_row(spark, tmp_path):
    from kilnwork.plans.event_queries import diverse_vectors

    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile([1.0, 0, 0, 0], (520, 1)), rng.random((400, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k * 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    stored = {r[0]: r[1] for r in df.collect()}
    want = [i * 3 for i in evaluate.diverse_sample([stored[k] for k in sorted(stored)], [1.0 / (i + 1) for i in range(len(x))], 10)]
    got = [r["vec_id"] for r in diverse_vectors(spark, str(tmp_path)).orderBy("pick").collect()]
    assert got == want and max(got) > 1500
    assert evaluate.diverse_rows(df, "vec_id", "embedding", 10, block=300) == want
    assert evaluate.diverse_rows(df.limit(0), "vec_id", "embedding", 10) == []


def test_maturity_gates(spark):
    few = [("c", f"k{i}", 1, "a") for i in range(3)]
    many = [("d", f"k{i}", i % 6, "abcd"[i % 4]) for i in range(14)]
    got = {r["concept"]: r["band"] for r in evaluate.maturity(spark.createDataFrame(few + many, "concept string, chunk_id string, doc_id int, kind string")).collect()}
    assert got == {"c": "new", "d": "ready"}


def test_claim_cells_conflict(spark):
    p = spark.createDataFrame([("c1", "s", "p", "1", "verified"), ("c2", "s", "p", "1", "verified"), ("c3", "s", "p", "2", "verified"), ("c4", "s", "q", "9", "rejected")], "claim_id string, subject_norm string, property_norm string, value_text string, verification_status string")
    assert rows(claims.cells(p), "property_norm", "n_values", "conflict", "cell") == [("p", 2, True, "1 | 2")]
    assert claims.add_points(p, p.limit(2)).count() == 4


def test_parsing():
    body = "lead\n# A\ntext a\n## B\ntext b\n# Keywords\nfolded\n# C\nrest"
    assert [p for p, *_ in parsing.section_spans(body)] == [[], ["A"], ["A", "B"], ["C"]]
    assert all(body[a:b].strip() for _, a, b in parsing.section_spans(body))
    chunks = parsing.chunk_spans("word " * 2000, limit=300)
    assert all(len(c[1]) <= 300 for c in chunks)
    assert [e[:2] for e in parsing.equation_spans("$$E=mc^2$$ and $x+1$ and $x+1$, 2 $ only")] == [("display", "E=mc^2"), ("inline", "x+1")]
    assert parsing.caption_rows("Fig. 1. First\nFigure 1: again\nTable 2 | Second")[0][:4] == ("figure", 1, "", "First")
    assert parsing.reference_rows("x\n# References\n[1] " + "A" * 30 + "\n[2] short\n[3] " + "B" * 30) == [(0, "A" * 30), (2, "B" * 30)]
    assert parsing.section_spans("") == [] and parsing.reference_rows("") == []


def test_equations_are_whole_and_of_all_kinds():
    long = "x+" * 300
    got = parsing.equation_spans(f"$${long}a$$ then $${long}b$$ and ${long}c$ and ${long}d$")
    assert [e[0] for e in got] == ["display", "display", "inline", "inline"] and len({e[4] for e in got}) == 4 and all(len(e[1]) == 500 for e in got)
    body = "The energy E = mc² + k holds, given by\n**==> picture [10 x 20] intentionally omitted <==**\nand Ohm's law, the Ohm's law; General law. Nothing = the and"
    assert [e[:2] for e in parsing.equation_spans(body)] == [("unicode", "E = mc² + k"), ("image", "[image equation]"), ("named", "Ohm's law"), ("named", "the Ohm's law")]
    assert [e[:2] for e in parsing.equation_spans("$a = b$ and a = b")] == [("inline", "a = b"), ("unicode", "a = b")]


def test_bind_spans(spark):
    spans = spark.createDataFrame([("d", "s1", 0, 10), ("d", "s2", 5, 20)], "doc string, span_id string, char_start int, char_end int")
    pts = spark.createDataFrame([("d", 7), ("d", 10), ("d", 30)], "doc string, offset int")
    assert rows(parsing.bind_spans(spans, pts, "doc"), "offset", "span_id") == [(7, "s1"), (10, "s2")]


def test_readers(spark, tmp_path):
    html = "<html><head><title> A  b </title><meta name='citation_date' content='2019/01'><script>x()</script></head><body><p>One &amp; two</p><a href='u'>l</a></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(readers.html_title(F.col("h")), readers.html_year(F.col("h")), readers.html_text(F.col("h")), readers.html_links(F.col("h"))).first()
    assert r[0] == "A b" and r[1] == 2019 and "One & two" in r[2] and "x()" not in r[2] and r[3] == ["u"]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "e.jsonl"), "a int"), "a") == [(1,), (2,)]
    (tmp_path / "p.md").write_text("---\ntitle: T\n---\n# H\nbody")
    (tmp_path / "p.txt").write_text("other")
    assert [r["path"].rsplit("/", 1)[-1] for r in readers.files(spark, str(tmp_path)).collect()] == ["p.md"]
    assert readers.markdown(readers.texts(spark, str(tmp_path / "p.md"))).first()["title"] == "T"
    xml = "<OAI-PMH><record><header><identifier>i1</identifier><datestamp>2020</datestamp></header><metadata><title>T\n t</title><creator>A</creator></metadata></record></OAI-PMH>"
    assert readers.harvested(spark.createDataFrame([(xml,), ("<bad",)], "xml string")).collect()[0]["title"] == "T t"
    work = '{"id": "W1", "doi": "https://doi.org/10.1/X", "title": "t", "publication_year": 2000}'
    assert readers.works(spark.createDataFrame([(work,), ("nope",)], "raw_json string")).collect()[0]["doi"] == "10.1/x"


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert rows(sinks.upserted(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(sinks.inserted(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    path = str(tmp_path / "t")
    sinks.publish(old, path)
    sinks.upsert_table(spark, path, new, ["k"])
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]
    e = edges(spark, CYCLE)
    assert rows(sinks.edges_without(e, spark.createDataFrame([("a",)], "id string")), "src", "dst") == [("b", "c")]


def test_fluent(spark):
    nodes = spark.createDataFrame([("1", "document", 2014), ("2", "document", 2016), ("3", "document", None), ("x", "author", None), ("y", "author", None)], "id string, type string, year int")
    e = spark.createDataFrame([("1", "2", "references"), ("3", "2", "references"), ("x", "1", "authored"), ("x", "2", "authored"), ("y", "2", "authored")], "src string, dst string, kind string")
    ch = spark.createDataFrame([("c1", 2, "alpha beta", False), ("c2", 2, "alpha", True), ("c3", 1, "beta", None)], "chunk_id string, doc_id long, text string, is_boilerplate boolean")
    kg = fluent.Graph(nodes, e, ch)
    assert kg.sources().since(2015).ids() == ["2"]
    assert kg.source("2").cited_by().ids() == ["1", "3"]
    assert kg.source("1").references().ids() == ["2"]
    assert kg.author("x").coauthors().ids() == ["y"]
    assert kg.source("2").chunks().ids() == ["c1"] and kg.source("2").chunks().with_boilerplate().ids() == ["c1", "c2"]
    assert kg.sources().top(2, "year").ids() == ["2", "1"]
    assert kg.search("alpha").ids() == ["c1"]
    assert kg.sources().where(missing=None).count() == 3 and not kg.sources().where(missing=1).exists()
    with pytest.raises(fluent.QueryError):
        kg.search("  ")


# -- hierarchies ---------------------------------------------------------------


def brute_forest(parent):
    out = {}
    for n in parent:
        at, seen = n, []
        while at not in seen:
            seen.append(at)
            up = parent.get(at)
            if up not in parent:
                out[n] = (at, len(seen) - 1)
                break
            at = up
        else:
            out[n] = (min(seen[seen.index(at) :]), -1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_against_walk(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 60)
    ids = [f"c{i:02}" for i in range(n)]
    parent = {c: rng.choice([*ids, None, "", "gone"]) if rng.random() < 0.8 else ids[max(0, i - 1)] for i, c in enumerate(ids)}
    data = [(c, p, "x") for c, p in parent.items()] + [(c, p, "x") for c, p in list(parent.items())[:5]] + [(None, "c00", "x")]
    df = spark.createDataFrame(data, "category_id string, parent_id string, node string").repartition(3)
    want = brute_forest({c: p or None for c, p in parent.items()})
    got = {r["category_id"]: (r["root_id"], r["depth"]) for r in forest.hierarchy(df).collect()}
    assert got == want
    for r in forest.hierarchy(df, paths=True).where("depth >= 0").collect():
        assert r["path"][0] == r["root_id"] and r["path"][-1] == r["category_id"] and len(r["path"]) == r["depth"] + 1


def test_hierarchy_deep_chain_and_empty(spark):
    df = spark.createDataFrame([(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(300)], "category_id string, parent_id string").repartition(7)
    assert forest.hierarchy(df).agg(F.max("depth")).first()[0] == 299
    assert forest.hierarchy(df.limit(0)).count() == 0
    assert forest.descendants(df.where("category_id < 'n0004'")).count() == 6


# -- units -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, like, factor",
    [("kg m-3", "g/cm3", 1e-3), ("g cm⁻³", "g/cm3", 1), ("Å/cycle", "nm/cycle", 0.1), ("nm·cycle-1", "nm/cycle", 1), ("angstrom per cycle", "nm/cycle", 0.1), ("mTorr", "Pa", 0.133322368), ("mm Hg", "Pa", 133.322368),
     ("×10⁻³ Ω cm", "µΩ·cm", 1000), ("ohm-m", "µΩ·cm", 1e8), ("microohm-cm", "µΩ·cm", 1), ("C g-1", "mAh/g", 1 / 3.6), ("Ah/kg", "mAh/g", 1), ("S m⁻¹", "mS/cm", 10), ("per cent", "%", 1), ("fraction", "%", 100), ("kgf/mm²", "GPa", 0.00980665),
     ("[standard L/min]", "sccm", 1000), ("10^3 cycles", "cycles", 1000), ("k cycles", "cycles", 1000), ("msec", "s", 1e-3), ("mil", "nm", 25400), ("meV", "eV", 1e-3), ("A/cycle", "nm/cycle", 0.1), ("nm rms", "nm", 1)],
)
def test_units(text, like, factor):
    to = units.read_unit(like)
    got = units.unit_for(text, to[0])
    assert got[0] == to[0] and float(got[1] / to[1]) == pytest.approx(factor, rel=1e-6)


def test_units_of_other_kinds():
    assert units.read_unit("V")[0] != units.read_unit("eV")[0] and units.read_unit("rpm")[0] != units.read_unit("%")[0] and units.read_unit("xyz") is None and units.read_unit("") is None
    k = units.read_unit("°F")
    assert float(212 * k[1] + k[2]) == pytest.approx(373.15)


@pytest.mark.parametrize(
    "text, value, rest",
    [("1,200", 1200, ""), ("12,5", 12.5, ""), ("1.233×10^-4", 1.233e-4, ""), ("4.5·10⁻⁴", 4.5e-4, ""), ("3 460 cyc.", 3460, "cyc."), ("0.207mg cm-2", 0.207, "mg cm-2"), ("367,4 ± 20 K", 367.4, "K"), ("≈ 1.35 eV", 1.35, "eV"),
     ("0.655 10^3 cycles", 0.655, "10^3 cycles"), ("30.56 ± 1 ×10⁻³ Ω cm", 30.56, "×10^-3 Ω cm"), ("−4.2", -4.2, ""), ("1.1E+03", 1100, "")],
)
def test_numbers(text, value, rest):
    got = units.read_number(text)
    assert float(got[0]) == pytest.approx(value) and got[1] == rest
    assert units.read_number("n/a") is None


def test_changepoints_are_exact():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 0.1, 12), rng.normal(3, 0.1, 9), rng.normal(0, 0.1, 7)])

    def cost(a, b):
        return float(((y[a:b] - y[a:b].mean()) ** 2).sum())

    n = len(y)
    best = [-1.0] + [0.0] * n
    for t_ in range(1, n + 1):
        best[t_] = min(best[s] + cost(s, t_) + 1.0 for s in range(t_))
    cuts = units.changepoints(y, 1.0)
    assert cuts == [0, 12, 21]
    assert sum(cost(a, b) + 1.0 for a, b in zip(cuts, [*cuts[1:], n])) - 1.0 == pytest.approx(best[n])


def test_common_units_end_to_end(spark):
    reg = spark.createDataFrame([("film thickness", "nm", '["thickness"]')], "property_norm string, canonical_unit string, aliases_json string")
    cols = "claim_id string, property_norm string, value_type string, value_original string, unit_original string, unit string, grounding_quote string, extractor string, created_at timestamp_ntz, number string"
    base = [("a", "thickness", "scalar", "1.5", "µm", None, None, "e", None, "clash"), ("b", "film thickness", "scalar", "2,0 Å", None, None, None, "e", None, "clash"), ("c", "film thickness", "scalar", "7", None, None, "a thickness of 7 nm was found", "e", None, "x"),
            ("d", "film thickness", "scalar", "7", "V", None, None, "e", None, "x"), ("e", "other", "scalar", "7", "nm", None, None, "e", None, "x"), ("f", None, None, None, None, None, None, None, None, None)]
    got = {r["claim_id"]: r for r in units.to_common_units(spark.createDataFrame(base + base[:1], cols), reg).collect()}
    assert got["a"]["value"] == 1500 and (got["a"]["mantissa"], got["a"]["exponent"]) == (150, 1)
    assert got["b"]["value"] == pytest.approx(0.2) and got["c"]["evidence"] == "grounding_quote" and got["d"]["evidence"] == "other kind" and "e" not in got and "f" not in got
    bare = [(f"x{i}", "film thickness", "scalar", str(100 + i), "nm", None, None, "s", None, "") for i in range(30)] + [(f"y{i}", "film thickness", "scalar", str(0.1 + i / 1000), None, None, None, "s", None, "") for i in range(12)]
    got = {r["claim_id"]: r for r in units.to_common_units(spark.createDataFrame(bare, cols), reg).collect()}
    assert got["y3"]["evidence"] == "level" and 50 < got["y3"]["value"] < 200
    assert units.to_common_units(spark.createDataFrame([], cols), reg).count() == 0


def test_long_histories_are_segmented_alike_in_windows(spark):
    """Windows by rank give what one search over the whole history gives, and no row is lost or doubled at their borders."""
    rng = np.random.default_rng(3)
    reg = spark.createDataFrame([("film thickness", "nm", "[]")], "property_norm string, canonical_unit string, aliases_json string")
    cols = "claim_id string, property_norm string, value_type string, value_original string, unit_original string, unit string, grounding_quote string, extractor string, created_at timestamp_ntz"
    import datetime as dt

    rows, k = [], 0
    while len(rows) < 700:
        run, unit = int(rng.integers(8, 20)), ("nm", None)[k % 2]
        for _ in range(run):
            x = 100 * float(rng.uniform(0.9, 1.1))
            rows.append((f"c{len(rows):04d}", "film thickness", "scalar", f"{x if unit else x / 1000:.5f}", unit, None, None, "s", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=len(rows))))
        k += 1
    df = spark.createDataFrame(rows, cols)
    pick = lambda block: sorted((r["claim_id"], r["evidence"], r["mantissa"], r["exponent"]) for r in units.to_common_units(df, reg, block=block).collect())
    whole = pick(10_000)
    assert len(whole) == len(rows) and all(e in ("level", "unit_original") for _, e, _, _ in whole)
    assert pick(128) == whole


def test_levels_reverse_a_wrong_unit(spark):
    reg = spark.createDataFrame([("film thickness", "nm", "[]")], "property_norm string, canonical_unit string, aliases_json string")
    cols = "claim_id string, property_norm string, value_type string, value_original string, unit_original string, unit string, grounding_quote string, extractor string, created_at timestamp_ntz"
    import datetime as dt

    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    rows = [(f"a{i}", "film thickness", "scalar", str(100 + i % 3), "nm", None, None, "s", at(i)) for i in range(30)]
    rows += [(f"b{i}", "film thickness", "scalar", str(100 + i % 3), "µm", None, None, "s", at(30 + i)) for i in range(10)]
    rows += [("one", "film thickness", "scalar", "3", "µm", None, None, "q", at(50))]
    got = {r["claim_id"]: r for r in units.to_common_units(spark.createDataFrame(rows, cols), reg).collect()}
    assert got["b4"]["evidence"] == "reversed" and got["b4"]["value"] == pytest.approx(101) and got["a4"]["evidence"] == "unit_original"
    assert got["one"]["evidence"] == "unit_original" and got["one"]["value"] == 3000


def test_quotes_stand_whole(spark):
    docs = spark.createDataFrame([(1, "The plate is made of zinc oxide and glass here"), (2, "made of zinc"), (3, None), (4, ""), (1, "The plate is made of zinc oxide and glass here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ate is made of zinc oxide an"), (2, "made of zinc"), (3, "is made of zinc oxide or glass"), (4, None), (5, ""), (6, "the plate is made of tin")], "item_id long, text string")
    from kilnwork.operators import claims

    assert {(r[0], r[1]) for r in claims.quoted(docs, items, F.lower).collect()} == {(1, 1), (1, 2), (2, 2)}
    assert claims.quoted(docs.limit(0), items, F.lower).count() == 0


def test_upsert_does_not_replace_what_it_cannot_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_table(spark, path, spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    for f in tmp_path.glob("t/*.parquet"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        sinks.upsert_table(spark, path, spark.createDataFrame([(2, "b")], "k long, v string"), ["k"])
    assert list(tmp_path.glob("t/*.parquet"))


def test_many_roots_without_parent(spark):
    rows = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("category_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("")).otherwise(F.lit("nowhere")).cast("string").alias("parent_id"))
    got = forest.hierarchy(rows)
    assert got.count() == 2000 and got.where("root_id = category_id and depth = 0").count() == 2000
