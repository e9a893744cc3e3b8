"""Gates and small aggregates that decide what is used: images, keywords, evidence, sections, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as t

#: Words that start or make up no keyword: fixed values.
KEYWORD_STOPS = ["the", "a", "an", "of", "in", "on", "for", "and", "or", "with", "by", "to", "from", "this", "that", "received", "accepted", "published", "copyright", "doi", "issn", "volume", "keywords", "abstract"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def decoration(width: Column, height: Column, least_side: int = 120, least_area: int = 40_000, aspect: float = 4.0) -> Column:
    """Whether an image is a logo or rule: a short side, a small area or a long shape."""
    return (F.least(width, height) < least_side) | (width * height < least_area) | (F.greatest(width, height) / F.least(width, height) > aspect)


def valid_keyword(word: Column) -> Column:
    """A keyword of 3 to 50 characters and at most five words that starts with no stop word and holds letters, not digits alone, dates or initials."""
    low = F.lower(F.trim(word))
    parts = F.split(low, "\\s+")
    return F.coalesce(
        F.length(low).between(3, 50) & (F.size(parts) <= 5) & ~parts[0].isin(KEYWORD_STOPS) & ~low.isin(MONTHS) & low.rlike("[a-z]") & ~low.rlike("^[a-z]([. ]+[a-z])*[.]?$") & ~low.rlike("[@/\\\\]|https?:|^[0-9 .,-]+$"),
        F.lit(False),
    )


def admissible(text: Column, least: int = 80) -> Column:
    """Whether a chunk may serve as evidence: long enough, no licence notice, no front matter of a publisher, with a sentence."""
    low = F.lower(text)
    front = low.rlike("(?m)^ *(received|accepted|published online|corresponding author|available online)\\b") & (F.length(text) < 600)
    return F.coalesce((F.length(F.trim(text)) >= least) & ~t.hard_boilerplate(text) & ~front & text.rlike("[a-z][.;:!?](\\s|$)"), F.lit(False))


def running_offsets(pieces: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, order, char_start, char_end): spans of pieces laid end to end."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).over(w)
    return pieces.select(doc, order, (end - F.coalesce(F.length(text), F.lit(0))).alias("char_start"), end.alias("char_end"))


def with_conclusion(sections: DataFrame, doc: str, order: str, kind: str, least: int = 3) -> DataFrame:
    """Sections with the last body one retyped as conclusion where a document has none and at least ``least`` sections."""
    w = W.partitionBy(doc)
    last = F.max(F.when(F.col(kind) == "body", F.col(order))).over(w)
    none = F.max((F.col(kind) == "conclusion").cast("int")).over(w) == 0
    return sections.withColumn(kind, F.when(none & (F.count("*").over(w) >= least) & (F.col(order) == last), "conclusion").otherwise(F.col(kind)))


def confidence_by_key(candidates: DataFrame, key: Column, score: str, label: str) -> DataFrame:
    """(key, n, low, mean, strong): candidates merged by a normalised key."""
    return candidates.groupBy(key.alias("key")).agg(
        F.count("*").alias("n"), F.min(score).alias("low"), F.round(F.avg(score), 6).alias("mean"), F.sum((F.col(label) == "verified").cast("long")).alias("strong")
    )


def thin_coverage(cited: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """(key, cited, available, warn): pages that cite fewer documents than half of those at hand (at least three), where five are at hand."""
    a = available.groupBy(key).agg(F.count_distinct("doc_id").alias("available"))
    c = cited.groupBy(key).agg(F.count_distinct("doc_id").alias("cited"))
    j = a.join(c, key, "left").select(key, F.coalesce("cited", F.lit(0)).alias("cited"), "available")
    return j.withColumn("warn", (F.col("available") >= 5) & (F.col("cited") < F.greatest(F.lit(3), F.ceil(F.col("available") * 0.5))))


def reclassified(chunks: DataFrame) -> DataFrame:
    """(chunk_id, is_boilerplate, section_type, changed): both predicates recomputed for every chunk."""
    fresh_b = F.coalesce(t.hard_boilerplate(F.col("text")) | t.soft_boilerplate(F.col("text"), F.from_json("section_path_json", "array<string>")), F.lit(False))
    fresh_s = t.path_type(F.from_json("section_path_json", "array<string>"))
    changed = ~(F.col("is_boilerplate").eqNullSafe(fresh_b) & F.col("section_type").eqNullSafe(fresh_s))
    return chunks.select("chunk_id", fresh_b.alias("is_boilerplate"), fresh_s.alias("section_type"), changed.alias("changed"))


def target_size(documents: Column, slope: float = 42.0, offset: float = 27.0, low: int = 10, high: int = 200) -> Column:
    """How many pages a corpus of so many documents asks for: a clamped line in the logarithm."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.round(slope * F.log10(F.greatest(documents, F.lit(1)).cast("double")) - offset).cast("int")))


def clusters(sets: dict[str, set], least: float = 0.15, most: int = 5) -> list[list[str]]:
    """Greedy single-link groups of concepts by overlap of their evidence, larger sets first; for the bounded list of open concepts."""
    left = sorted(sets, key=lambda k: (-len(sets[k]), k))
    out = []
    while left:
        group = [left.pop(0)]
        grew = True
        while grew and len(group) < most:
            grew = False
            for c in left:
                if any(len(sets[c] & sets[g]) / max(1, len(sets[c] | sets[g])) >= least for g in group):
                    group.append(c)
                    left.remove(c)
                    grew = True
                    break
        out.append(group)
    return out
