"""Readers: files, markdown with front matter, HTML, JSON lines, harvested records, cached works.

Everything is read as a DataFrame of raw text or lines and shaped with built-in
functions; only front matter and XML records, which have structure along the
text, use Arrow batches.  Readers that would need a network take the saved
response instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions in the order in which one of several files of the same name is kept.
PREFERENCE = ["md", "markdown", "html", "htm", "docx", "pptx", "pdf", "txt"]


def files(spark: SparkSession, root: str, keep_best: bool = True) -> DataFrame:
    """(path, stem, ext, bytes) of the supported files under a folder; of the files of one stem the preferred kind."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    df = df.select("path", F.regexp_replace("path", "[.][^./]*$", "").alias("stem"), F.lower(F.regexp_extract(name, "[.]([^.]+)$", 1)).alias("ext"), "bytes")
    rank = F.array_position(F.array(*[F.lit(x) for x in PREFERENCE]), F.col("ext"))
    df = df.where(rank > 0)
    if not keep_best:
        return df
    best = df.groupBy("stem").agg(F.min(F.struct(rank.alias("r"), "path"))["path"].alias("path"))
    return df.join(best.select("path"), "path", "left_semi")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines ledger; blank and unreadable lines are skipped."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Simple ``key: value`` front matter and the body after it."""
    if not text.startswith("---"):
        return {}, text
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    meta = {}
    for line in m[1].split("\n"):
        k, sep, v = line.partition(":")
        if sep and k.strip():
            meta[k.strip()] = v.strip().strip("\"'")
    return meta, text[m.end() :]


def markdown(df: DataFrame) -> DataFrame:
    """(path, title, meta, body) from (path, text): the title is the front matter's, the first heading or the stem."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                meta, body = front_matter(text or "")
                head = re.search(r"^#\s+(.+?)\s*$", body, re.M)
                stem = re.sub(r"\.[^.]*$", "", (path or "").rsplit("/", 1)[-1])
                out.append((path, meta.get("title") or (head[1] if head else stem), meta, body))
            yield pd.DataFrame(out, columns=["path", "title", "meta", "body"])

    return df.select("path", "text").mapInPandas(run, "path string, title string, meta map<string,string>, body string")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, entities of the markup read, blanks collapsed."""
    x = F.regexp_replace(html, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", " ")
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, "(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>", "\n")
    x = F.regexp_replace(x, "(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[ \\t]+", " ")
    return F.trim(F.regexp_replace(x, " ?\\n[ \\n]*", "\n"))


def html_title(html: Column) -> Column:
    tag = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))
    h1 = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "), "\\s+", " "))
    return F.when(tag != "", tag).when(h1 != "", h1)


def html_meta(html: Column, name: str) -> Column:
    """Content of a meta tag by name or property, the attributes in either order."""
    a = F.regexp_extract(html, f"(?is)<meta[^>]+(?:name|property)=[\"']{re.escape(name)}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, f"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{re.escape(name)}[\"']", 1)
    return F.when(a != "", a).when(b != "", b)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*\\bhref=[\"']([^\"']+)[\"']"), 1)


def html_year(html: Column) -> Column:
    raw = F.coalesce(html_meta(html, "citation_publication_date"), html_meta(html, "citation_date"), html_meta(html, "article:published_time"), html_meta(html, "DC.date"))
    y = F.regexp_extract(raw, "((?:19|20)[0-9]{2})", 1)
    return F.when(y != "", y.cast("int"))


def harvested(df: DataFrame) -> DataFrame:
    """(identifier, datestamp, sets, title, authors, categories) from saved OAI-PMH responses (column xml); last of an id wins."""

    def run(parts: Iterator) -> Iterator:
        import xml.etree.ElementTree as ET

        import pandas as pd

        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for pdf in parts:
            out = []
            for xml in pdf["xml"]:
                try:
                    root = ET.fromstring(xml)
                except (ET.ParseError, TypeError):
                    continue
                for rec in (e for e in root.iter() if local(e) == "record"):
                    texts: dict[str, list[str]] = {}
                    for e in rec.iter():
                        if e.text and e.text.strip():
                            texts.setdefault(local(e), []).append(e.text.strip())
                    one = lambda k: (texts.get(k) or [None])[0]  # noqa: E731, B023
                    names = texts.get("creator") or [f"{k}, {f}" for k, f in zip(texts.get("keyname", []), texts.get("forenames", []))]
                    if one("identifier"):
                        out.append((one("identifier"), one("datestamp"), texts.get("setSpec", []), re.sub(r"\s+", " ", one("title") or ""), names, (one("categories") or "").split()))
            yield pd.DataFrame(out, columns=["identifier", "datestamp", "sets", "title", "authors", "categories"])

    rows = df.select("xml").mapInPandas(run, "identifier string, datestamp string, sets array<string>, title string, authors array<string>, categories array<string>")
    return rows.groupBy("identifier").agg(F.max(F.struct("datestamp", "sets", "title", "authors", "categories")).alias("r")).select("identifier", "r.*")


WORK_SCHEMA = (
    "id string, doi string, title string, publication_year int, type string, cited_by_count long,"
    " authorships array<struct<author:struct<display_name:string>>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>,"
    " primary_location struct<source:struct<display_name:string>>, referenced_works array<string>"
)


def works(df: DataFrame, col: str = "raw_json") -> DataFrame:
    """Resolved works from saved JSON records: one row a record, unreadable ones skipped."""
    w = df.select(F.from_json(col, WORK_SCHEMA).alias("w")).where("w.id is not null or w.doi is not null or w.title is not null")
    return w.select(
        F.col("w.id").alias("openalex_id"), F.regexp_replace(F.lower("w.doi"), "^https?://(dx[.])?doi[.]org/", "").alias("doi"), "w.title", F.col("w.publication_year").alias("year"),
        F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("w.biblio.volume").alias("volume"), F.col("w.biblio.issue").alias("issue"),
        F.col("w.primary_location.source.display_name").alias("journal"), F.col("w.cited_by_count"), F.col("w.type").alias("work_type"), "w.referenced_works",
    )


def cached(cache: DataFrame, asked: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Cache hits for the asked DOIs: a row counts unless its title is empty and it is older than ``days``."""
    old = F.datediff(F.lit(now).cast("date"), F.to_date("resolved_at")) > days
    return cache.join(asked.select("doi").distinct(), "doi", "left_semi").where(~((F.coalesce("title", F.lit("")) == "") & old))


def evidence_notes(df: DataFrame) -> DataFrame:
    """(path, marker, chunk, doc, quote) of the evidence footnotes of wiki pages (path, body)."""
    notes = df.select("path", F.explode(F.regexp_extract_all("body", F.lit('(?m)^(\\[\\^e[0-9]+\\]:.*)$'), 1)).alias("n"))
    g = lambda k: F.regexp_extract("n", '^\\[\\^(e[0-9]+)\\]: *(\\S+) *\\(([^,)]+)[^)]*\\) *> *"(.*)"', k)
    return notes.select("path", g(1).alias("marker"), g(2).alias("chunk_id"), g(3).alias("doc_id"), g(4).alias("quote")).where("marker <> ''")
