"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnwork.llm import boilerplate, bpe, langid, leakage, linkage, names, scans, splitting
from kilnwork.runtime import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "chunks"), table(spark, d, "documents"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, d, "chunks"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(table(spark, d, "authors"), table(spark, d, "documents"), table(spark, d, "works"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    a, b = names.linked_names(table(spark, d, "authors"), table(spark, d, "documents"), table(spark, d, "works"))
    return a.unionByName(b).select("key", "entity").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("key_a", "key_b").distinct()


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.matches(table(spark, d, "documents"), table(spark, d, "works"), table(spark, d, "string_cache"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(spread(table(spark, d, "chunks")), table(spark, d, "documents"))[0].select("record_id", "line_no", "kind")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_texts(table(spark, d, "chunks"), table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    return langid.mislabelled_or_mixed(docs).select("doc_id", "seg_no", "lang").distinct()


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segments(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_pieces, p3_found, p3_entities, p5_found, p5_matches, p6_found, p6_clean, p8_ids, p9_found, p9_clean, p10_found, p10_segments)
}

SQL: dict[str, str] = {
    "p1_found": r"""
        WITH c AS (SELECT DISTINCT chunk_id, doc_id, text FROM chunks WHERE text IS NOT NULL),
        l AS (SELECT chunk_id, doc_id, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(len(string_split(text, chr(10))))) AS line_no FROM c),
        k AS (SELECT d.publisher, l.doc_id, chunk_id, line_no,
                     lower(upper(replace(regexp_replace(line, '\P{L}+', '', 'g'), 'ß', 'ss'))) AS letters
              FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE d.publisher IS NOT NULL),
        n AS (SELECT publisher, count(DISTINCT doc_id) AS docs FROM documents GROUP BY publisher),
        g AS (SELECT k.publisher, letters FROM k JOIN n ON n.publisher = k.publisher
              WHERE length(letters) >= 10 GROUP BY k.publisher, letters, docs
              HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) >= docs * 0.15)
        SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM k JOIN g ON g.publisher = k.publisher AND g.letters = k.letters""",
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2000",
}
