"""A fluent, immutable query builder over nodes and edges; every step is a lazy plan.

    Graph(nodes, edges, chunks).sources().since(2015).top(10, "pagerank").chunks().match("text", "band gap").ids()

``nodes`` has id, type and any attribute columns; ``edges`` has src, dst, kind;
``chunks`` has chunk_id, doc_id and its own columns.  Ids of documents and
chunks are strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import text as t
from kilnwork.operators import graph as g
from kilnwork.operators import search as s


class QueryError(ValueError):
    """A query that cannot be answered, with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    chunks_table: DataFrame | None = None

    def _of(self, kind: str) -> Query:
        return Query(self, self.nodes.where(F.col("type") == kind).select("id"), kind)

    def sources(self) -> Query:
        return self._of("document")

    def authors(self) -> Query:
        return self._of("author")

    def source(self, *ids: str) -> Query:
        q = self.sources()
        return replace(q, ids_df=q.ids_df.where(F.col("id").isin(list(ids))))

    def author(self, *ids: str) -> Query:
        q = self.authors()
        return replace(q, ids_df=q.ids_df.where(F.col("id").isin(list(ids))))

    def chunks(self) -> Query:
        return Query(self, self.chunks_table.select(F.col("chunk_id").alias("id")).distinct(), "chunk")

    def search(self, terms: str, k: int = 10) -> Query:
        return self.chunks().search(terms, k)

    def describe(self) -> dict[str, list[str]]:
        """Node types, edge kinds and steps."""
        return {
            "types": [r[0] for r in self.nodes.select("type").distinct().orderBy("type").limit(100).collect()],
            "kinds": [r[0] for r in self.edges.select("kind").distinct().orderBy("kind").limit(100).collect()],
            "steps": [m for m in dir(Query) if not m.startswith("_")],
        }


@dataclass(frozen=True)
class Query:
    graph: Graph
    ids_df: DataFrame
    kind: str
    order: DataFrame | None = None  # (id, rank) of the last ranking
    boilerplate: bool = False

    # -- filters -----------------------------------------------------------------

    def _rows(self) -> DataFrame:
        table = self.graph.chunks_table.withColumn("id", F.col("chunk_id")) if self.kind == "chunk" else self.graph.nodes
        return table.join(self.ids_df, "id", "left_semi")

    def _keep(self, condition) -> Query:
        return replace(self, ids_df=self._rows().where(condition).select("id").distinct())

    def where(self, **attrs) -> Query:
        """Conjunction of equalities; an attribute the rows do not have equals None."""
        rows = self._rows()
        cond = F.lit(True)
        for k, want in attrs.items():
            cond = cond & (F.col(k).eqNullSafe(F.lit(want)) if k in rows.columns else F.lit(want is None))
        return self._keep(cond)

    def match(self, field: str, needle: str) -> Query:
        rows = self._rows()
        return self._keep(t.contains_literal(F.coalesce(F.col(field).cast("string"), F.lit("")), needle) if field in rows.columns else F.lit(needle == ""))

    def since(self, year: int) -> Query:
        return self._keep(F.coalesce(F.col("year"), F.lit(0)) >= year)

    def of_type(self, kind: str) -> Query:
        return replace(self, ids_df=self.graph.nodes.where(F.col("type") == kind).select("id").join(self.ids_df, "id", "left_semi"), kind=kind)

    def with_boilerplate(self) -> Query:
        return replace(self, boilerplate=True)

    # -- steps -------------------------------------------------------------------

    def _step(self, kind: str, direction: str, to: str) -> Query:
        return replace(self, ids_df=g.neighbours(self.graph.edges, self.ids_df, direction, [kind]), kind=to, order=None)

    def cited_by(self) -> Query:
        return self._step("references", "in", "document")

    def references(self) -> Query:
        return self._step("references", "out", "document")

    def authored(self) -> Query:
        return self._step("authored", "out", "document")

    def by(self) -> Query:
        return self._step("authored", "in", "author")

    def coauthors(self) -> Query:
        """Authors who share a document with the seeds, the seeds left out."""
        docs = g.neighbours(self.graph.edges, self.ids_df, "out", ["authored"])
        return replace(self, ids_df=g.neighbours(self.graph.edges, docs, "in", ["authored"]).join(self.ids_df, "id", "left_anti"), order=None)

    def chunks(self) -> Query:
        c = self.graph.chunks_table.select(F.col("chunk_id").alias("cid"), F.col("doc_id").cast("string").alias("id")).join(self.ids_df, "id", "left_semi")
        return replace(self, ids_df=c.select(F.col("cid").alias("id")).distinct(), kind="chunk", order=None)

    def neighborhood(self, hops: int = 1) -> Query:
        return replace(self, ids_df=g.neighbourhood(self.graph.edges, self.ids_df, hops), order=None)

    # -- ranking -----------------------------------------------------------------

    def top(self, n: int, by: str) -> Query:
        """The first ``n`` by an attribute, missing as 0, ties by id."""
        if n < 1:
            raise QueryError("bad_top_k", "top needs n >= 1")
        ranked = s.top(self._rows().select("id", F.coalesce(F.col(by).cast("double"), F.lit(0.0)).alias("score")), n, F.desc("score"), F.asc("id"))
        return replace(self, ids_df=ranked.select("id"), order=s.ranks(ranked, "id", "score"))

    def search(self, terms: str, k: int = 10) -> Query:
        """The first ``k`` chunks by BM25 over all terms."""
        if self.kind != "chunk":
            raise QueryError("bad_field", "search runs on chunks")
        words = [w for w in terms.lower().split() if w]
        if not words:
            raise QueryError("missing_query", "an empty query")
        rows = self._rows() if self.boilerplate else self._rows().where(~F.coalesce(F.col("is_boilerplate"), F.lit(False)))
        hits = s.top(s.bm25(rows.select("id", "text").distinct(), "id", {"text": 1.0}, words), k, F.desc("score"), F.asc("id"))
        return replace(self, ids_df=hits.select("id"), order=s.ranks(hits, "id", "score"))

    # -- terminals ---------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The rows, in rank order if there is one, else by id; boilerplate chunks dropped unless asked for."""
        rows = self._rows()
        if self.kind == "chunk" and not self.boilerplate and "is_boilerplate" in rows.columns:
            rows = rows.where(~F.coalesce(F.col("is_boilerplate"), F.lit(False)))
        return rows.join(self.order, "id").orderBy("rank") if self.order is not None else rows.orderBy("id")

    def ids(self, limit: int = 10_000) -> list[str]:
        return [r[0] for r in self.to_df().select("id").limit(limit).collect()]

    def count(self) -> int:
        return self.to_df().select("id").distinct().count()

    def exists(self) -> bool:
        return bool(self.to_df().head(1))

    def first(self):
        got = self.to_df().head(1)
        return got[0] if got else None
