"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilnwork.plans import citation_queries, claim_queries, curation_queries, event_queries, general_problems, graph_queries, registry, search_queries, text_queries, wiki_queries

QUERIES = {**registry.QUERIES, **general_problems.QUERIES}
SQL = {**registry.SQL, **general_problems.SQL}
del citation_queries, claim_queries, curation_queries, event_queries, graph_queries, text_queries, wiki_queries


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Hybrid search: BM25 and hash-embedding cosine, fused by reciprocal ranks."""
    return search_queries.hybrid_search(spark, root)
