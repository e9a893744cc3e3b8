"""Lines repeated across the documents of one source.

Two lines are the same when their letters agree in order, case aside.  A line
is repeated when it stands in at least ``least_docs`` documents and in at least
``share`` of all documents of its source.

First pass: every source gets a mergeable frequent-items summary of its lines
(built per input split, merged in the shuffle; its size is fixed), which yields
every line that can possibly reach the share.  Second pass: those candidates
are counted exactly, per distinct document.  A summary of ``tracked`` items
cannot miss a line as long as 7 / tracked of all lines of the source is below
the share; sources with so many lines per document that this does not hold are
counted exactly without a summary, so nothing depends on the summary being
lucky.  Confirmed lines are few per source (lines per document / share) and are
broadcast once counted; beyond a size limit the join is shuffled.

Lines travel as 64-bit hashes of their letters, not as text, so the join of
chunks with their source moves eight bytes a line.

Defined results: null texts have no lines; documents without source form no
group; lines with fewer than ``least_letters`` letters never count; duplicate
chunk rows add nothing; a chunk whose document is unknown has no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import cut, join_measured

#: Items of a summary, and how many of them a source may yield as candidates.
TRACKED, YIELD = 4096, 2000


def letters(line: Column) -> Column:
    """The letters of a line, case folded (by way of upper case, so that sharp s equals ss)."""
    return F.lower(F.upper(F.regexp_replace(line, r"\P{L}+", "")))


def line_hashes(text: Column, least_letters: int = 10) -> Column:
    """Hash of each line of a text, null for lines with too few letters."""
    folded = F.transform(F.split(text, "\n"), letters)
    return F.transform(folded, lambda f: F.when(F.length(f) >= least_letters, F.xxhash64(f)))


def _with_source(chunks: DataFrame, docs: DataFrame, source_col: str) -> DataFrame:
    owner = docs.select(F.col("doc_id").alias("_doc"), F.col(source_col).alias("_source")).where("_source is not null").distinct()
    return chunks.join(owner, chunks["doc_id"] == owner["_doc"]).drop("doc_id")


def confirmed_lines(
    chunks: DataFrame,
    docs: DataFrame,
    *,
    source_col: str = "publisher",
    least_docs: int = 4,
    share: float = 0.15,
    least_letters: int = 10,
    tracked: int = TRACKED,
) -> tuple[DataFrame, DataFrame]:
    """(occurrences of candidate lines, confirmed lines).

    Occurrences have _source, _hash, _doc, chunk_id, line_no; confirmed lines
    have _source, _hash, n_docs.
    """
    lines = chunks.select("chunk_id", "doc_id", line_hashes(F.col("text"), least_letters).alias("_hashes"))
    base = cut(_with_source(lines, docs, source_col).where(F.exists("_hashes", lambda h: h.isNotNull())))
    sizes = docs.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("_source")).agg(F.count_distinct("doc_id").alias("_docs"))
    stream = base.select("_source", F.explode(F.array_distinct("_hashes")).alias("_hash")).where("_hash is not null")
    summed = stream.groupBy("_source").agg(F.count("*").alias("_lines"), F.expr(f"approx_top_k(_hash, {min(YIELD, tracked)}, {tracked})").alias("_top"))
    tops = cut(summed.join(sizes, "_source"))
    # An item of the summary is surely reported if it is more frequent than twice the error, 3.5 / tracked of the lines.
    sure = (F.greatest(F.lit(float(least_docs)), F.col("_docs") * share) > F.col("_lines") * (7.0 / tracked)) & (F.col("_lines") < F.col("_docs") * share * min(YIELD, tracked)) | (F.col("_lines") <= tracked // 2)
    known = tops.where(sure).select("_source", F.explode("_top").alias("_item")).select("_source", F.col("_item.item").alias("_hash"))
    spots = base.select("_source", "_doc", "chunk_id", F.posexplode("_hashes").alias("line_no", "_hash")).where("_hash is not null")
    found = join_measured(spots, known, ["_source", "_hash"])
    unsure = tops.where(~sure).select("_source")
    if unsure.head(1):
        found = found.unionByName(join_measured(spots, unsure, ["_source"]).select(found.columns))
    n = found.groupBy("_source", "_hash").agg(F.count_distinct("_doc").alias("n_docs"))
    confirmed = n.join(tops.select("_source", "_docs"), "_source").where((F.col("n_docs") >= least_docs) & (F.col("n_docs") >= F.col("_docs") * share))
    return found, cut(confirmed.select("_source", "_hash", "n_docs"))


def repeated_lines(chunks: DataFrame, docs: DataFrame, **kw) -> DataFrame:
    """(chunk_id, line_no) of every line that is repeated in its source."""
    found, confirmed = confirmed_lines(chunks, docs, **kw)
    return join_measured(found, confirmed, ["_source", "_hash"]).select("chunk_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeated_lines(chunks: DataFrame, docs: DataFrame, *, source_col: str = "publisher", least_letters: int = 10, **kw) -> DataFrame:
    """Every chunk with its repeated lines taken out: chunk_id, text, n_removed.

    The confirmed hashes of a source are one short array, joined by source.
    """
    _, confirmed = confirmed_lines(chunks, docs, source_col=source_col, least_letters=least_letters, **kw)
    sets = confirmed.groupBy("_source").agg(F.collect_set("_hash").alias("_drop"))
    owner = docs.select("doc_id", F.col(source_col).alias("_source")).where("_source is not null").dropDuplicates(["doc_id"])
    rows = chunks.select("chunk_id", "doc_id", "text").distinct().join(owner, "doc_id", "left")
    rows = rows.join(F.broadcast(sets) if confirmed.count() <= 100_000 else sets, "_source", "left")
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), line_hashes(F.col("text"), least_letters).alias("hash"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_drop"), x["hash"]), F.lit(False)))
    return rows.select(
        "chunk_id",
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"),
        F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).alias("n_removed"),
    )
