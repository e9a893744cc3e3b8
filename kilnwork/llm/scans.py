"""Noise of scanned pages: running headers, page numbers, cut words, misread characters.

Words are counted over the whole corpus first.  Every word gets an anagram hash
(a sum over its characters), so that replacing one group of characters by
another changes the hash by a known difference; rare words are joined in SQL
with frequent ones whose hash differs by the difference of a known confusion,
the replacement is verified, and the most frequent counterpart ranks first.  A
second pass finds the lines: edge lines are page numbers by their form and
running headers by the title and authors of their document; a hyphen at a line
end is a cut if the joined word has more evidence in the corpus than the
hyphenated one.

Defined results: null and empty texts give nothing; a null title leaves headers
made of author names and those repeated in the document; a line can have several
kinds; headers and page numbers are no running text and carry no misread words;
repeated rows give each case once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import cut, small_enough

#: What a scan makes of what: fixed values, misread form and true form.
CONFUSIONS = [
    ("c", "e"), ("f", "t"), ("1", "i"), ("1", "l"), ("5", "s"), ("0", "o"), ("9", "g"), ("6", "b"), ("8", "b"),
    ("cl", "d"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("m", "in"), ("h", "ti"), ("h", "li"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("e", "c"), ("@", "a"),
]
#: Ligature characters: fixed values of the Unicode presentation forms.
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"
HYPHENS = "-‐‑­¬"
WORD = re.compile(r"[\w@]+")
TOKEN = re.compile(r"[\w@]+(?:[-‐‑][\w@]+)*")
_LAST = re.compile(rf"([^\W_]+(?:[-‐‑][^\W_]+)*)[{HYPHENS}]\s*$")
_FIRST = re.compile(r"\s*([^\W_]+(?:[-‐‑][^\W_]+)*)")
_END = re.compile(rf"[{HYPHENS}] *\n")
_CUT = re.compile(rf"[^\W_]+(?:[-‐‑][^\W_]+)*[{HYPHENS}] *\n\s*[^\W_]+(?:[-‐‑][^\W_]+)*")
_NAMES = r"(?:p|pp|pag|pág|page|página|pagina|seite|s)"
_NUM = r"(?:[\dlOI]{1,5}|(?-i:c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})(?<=[ivxlc])))"
_PAGE = re.compile(rf"^\s*(?:(?P<deco>[-–—·•|~*]\s*{_NUM}\s*[-–—·•|~*]|[\[(<]\s*{_NUM}\s*[\])>]|{_NAMES}\.?\s*{_NUM}(?:\s*(?:/|of|de|von|sur|di)\s*{_NUM})?|{_NUM}\s*/\s*{_NUM})|(?P<bare>{_NUM}))\s*$", re.I)
_NUMERIC = re.compile(r"^[\s\d.,;:|%+\-−–]*$")
_PAGE_EDGE = re.compile(rf"^\s*(?:{_NUM}\s{{2,}}|{_NUM}\s+[·|—–-]\s+)|(?:\s{{2,}}|\s+[·|—–-]\s+){_NUM}\s*$")
_ET_AL = re.compile(r"^(?:[^\W\d_]|[ .'’\-])+\bet\s+al\b\.?\W*$", re.I)
_BYLINE = re.compile(r"^(?P<who>(?:[^\W\d_]|[ .,'’&\-])+?)\s+[—–-]\s+(?P<what>.+)$")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Letters of a text, without case and accents."""
    if not text:
        return ""
    text = "".join(_LETTERS.findall(text)).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if not text.isascii() else text


def page_numbers(lines: list[str]) -> set[int]:
    """Lines that are only a page number.  A bare number counts unless it stands in a column of figures."""
    out = set()
    for i, line in enumerate(lines):
        if not (m := _PAGE.match(line)):
            continue
        if not any(c.isdigit() for c in line) and "O" in line:
            continue
        if m["bare"] and (len(lines) < 2 or _in_column(lines, i)):
            continue
        out.add(i)
    return out


def _in_column(lines: list[str], i: int) -> bool:
    for step in (-1, 1):
        k = i + step
        while 0 <= k < len(lines) and not lines[k].strip():
            k += step
        if 0 <= k < len(lines) and (_NUMERIC.match(lines[k]) or lines[k].lstrip()[:1] == "|"):
            return True
    return False


def maybe_header(line: str) -> str | None:
    """The text of a line that could be a running header, its page number taken off."""
    if "|" in line[1:-1]:
        return None
    text = _PAGE_EDGE.sub("", line).strip()
    first = next((c for c in text if c.isalpha()), "")
    if not first.isupper() or sum(c.isalpha() for c in text) < 5:
        return None
    if text.endswith(".") and not _ET_AL.match(text):
        return None
    return text


def close(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most`` (banded)."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            new[j] = min(row.get(j - 1, 99) + (x != b[j - 1]), row.get(j, 99) + 1, new.get(j - 1, 99) + 1)
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), 99) <= most


def _starts(text: str, title: str) -> bool:
    """Whether ``text`` is a beginning of the title, a few misread letters allowed."""
    if len(text) < 5 or not title:
        return False
    if title.startswith(text):
        return True
    slack = 1 + len(text) // 12 if len(text) >= 10 else 0
    return any(close(text, title[: len(text) + d], slack) for d in (0, -1, 1)) if slack else False


def is_header(text: str, title: str | None, authors: str | None) -> bool:
    """Whether a candidate is made of the title or the authors of its paper."""
    if _ET_AL.match(text):
        return True
    t = fold(title)
    if _starts(fold(text), t):
        return True
    m = _BYLINE.match(text)
    if m:
        if _starts(fold(m["what"]), t):
            return True
        names = set(WORD.findall((authors or "").casefold()))
        who = [w for w in WORD.findall(m["who"].casefold()) if len(w) > 3]
        if who and sum(w in names for w in who) >= max(1, len(who) // 2) and len(who) <= 6:
            return True
    return False


# -- first pass: words of the corpus -------------------------------------------


def records(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_id, doc_id, text) of every chunk and abstract that has text."""
    a = chunks.select(F.concat(F.lit("chunk/"), "chunk_id").alias("record_id"), "doc_id", "text")
    b = docs.select(F.concat(F.lit("abstract/"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id", F.col("abstract").alias("text"))
    return a.unionByName(b).where("record_id is not null and length(text) > 0")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): words, and compounds with their hyphens, lower-cased; words cut at a line end are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out():
            for token in [t for t in counts if "-" in t or "‐" in t or "‑" in t]:
                for part in WORD.findall(token):
                    counts[part] += counts[token]
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if _END.search(text):
                    text = _CUT.sub(" ", text)
                counts.update(TOKEN.findall(text.lower()))
            if len(counts) > 500_000:
                yield out()
        yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _character_value(c):
    return F.shiftrightunsigned(F.xxhash64(c), 16)


def anagram_hash(word):
    """Sum of a fixed value of each character; the order of characters does not count."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + _character_value(c))


def corrections(words: DataFrame, *, ratio: int = 20, least: int = 20) -> DataFrame:
    """(word, fixed, strong) for words that a confusion turns into a more frequent one.

    ``strong`` pairs differ in frequency by ``ratio``; of the others only words met
    at most three times count, and only in a text that has the fixed word too.
    """
    spark = words.sparkSession
    plain = words.where(~F.col("word").rlike("[-‐‑]") & (F.length("word") >= 2))
    table = spark.createDataFrame([(x, y) for x, y in CONFUSIONS], "wrong string, right string")
    table = table.select("wrong", "right", (anagram_hash(F.col("right")) - anagram_hash(F.col("wrong"))).alias("step"))
    hashed = cut(plain.select("word", "n", anagram_hash(F.col("word")).alias("h")))
    asked = hashed.join(F.broadcast(table), F.col("word").contains(F.col("wrong"))).select("word", "n", "wrong", "right", (F.col("h") + F.col("step")).alias("h"))
    known = hashed.where("n >= 2 and word rlike '^\\\\p{L}+[0-9]{0,2}$'").select(F.col("word").alias("fixed"), F.col("n").alias("m"), "h")
    pairs = asked.join(known, "h").where(
        (F.col("m") > F.col("n"))
        & F.expr(
            "exists(sequence(1, length(word) - length(wrong) + 1), i -> substring(word, i, length(wrong)) = wrong"
            " and fixed = concat(substring(word, 1, i - 1), right, substring(word, i + length(wrong), length(word))))"
        )
    )
    letters = F.length(F.regexp_replace("word", r"\P{L}", ""))
    strong = (F.col("m") >= ratio * F.col("n")) & (F.col("m") >= least)
    short = F.length("fixed") < 3
    pairs = pairs.where((letters >= 1) & ~(short & (~strong | (F.col("m") < 50 * F.col("n")))))
    pairs = pairs.where(strong | (F.col("n") <= 3))
    best = pairs.groupBy("word").agg(F.max(F.struct("m", "fixed", strong.alias("strong"))).alias("b"))
    return best.select("word", "b.fixed", "b.strong")


# -- second pass: lines ----------------------------------------------------------

_KINDS = "record_id string, doc_id long, line_no int, kind string, text string, other string"


def _scan(texts, ids, docs, fixes, weak):
    """Candidate rows of a batch of texts."""
    for record, doc, text in zip(ids, docs, texts):
        lines = text.split("\n")
        pages = page_numbers(lines) if len(lines) > 1 else set()
        for i in pages:
            yield record, doc, i, "page_no", None, None
        heads = {}
        if len(lines) > 2:
            for i, line in enumerate(lines):
                if i not in pages and line and (t := maybe_header(line)):
                    near = (i - 1 in pages) or (i + 1 in pages) or bool(_PAGE_EDGE.search(line)) or t == t.upper()
                    heads[i] = t
                    yield record, doc, i, "header?", t, "edge" if near else None
        cut_from: dict[int, str] = {}
        for i, line in enumerate(lines[:-1]):
            if line and line.rstrip()[-1:] in HYPHENS and i not in pages and (m := _LAST.search(line)):
                a, tried, k = m[1], 0, i + 1
                while k < len(lines):
                    nxt = lines[k]
                    if k in pages or not nxt.strip():
                        k += 1
                        continue
                    f = _FIRST.match(nxt)
                    if f:
                        b = f[1]
                        yield record, doc, i, "hyphen?", f"{tried}\t{(a + b).lower()}", (a + "-" + b).lower()
                        if tried == 0:
                            cut_from[i], cut_from[k] = "end", cut_from.get(k, "") + "start"
                        if k not in heads and not b[:1].isupper():
                            break
                        tried += 1
                    k += 1
        low = text.lower()
        here = set(WORD.findall(low))
        any_ligature = not text.isascii() and any(c in text for c in LIGATURES)
        odd = fixes.keys() & here
        odd |= {w for w in weak.keys() & here if weak[w] in here}
        if odd or any_ligature:
            for i, line in enumerate(lines):
                if i in pages or not line:
                    continue
                words = WORD.findall(line.lower())
                if i in cut_from:
                    if "end" in cut_from[i]:
                        words = words[:-1]
                    if "start" in cut_from[i]:
                        words = words[1:]
                if not odd.isdisjoint(words) or any_ligature and any(c in line for c in LIGATURES):
                    yield record, doc, i, "misread?", None, None
        for i in cut_from:  # words that a line end cut may be misread as well
            if cut_from[i].startswith("end") and i + 1 < len(lines):
                a, b = WORD.findall(lines[i].lower()), WORD.findall(lines[i + 1].lower())
                if a and b and (a[-1] + b[0]) in fixes:
                    yield record, doc, i + _wrong_part(a[-1], b[0], fixes[a[-1] + b[0]]), "misread?", None, None


def _wrong_part(a: str, b: str, right: str) -> int:
    """0 if the misread character stands in the first part of a cut word, else 1."""
    return 1 if right.startswith(a) else 0


def line_candidates(rows: DataFrame, fixes: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Candidate lines of every record, the corrections broadcast once counted.

    With more corrections than ``limit`` they are taken in blocks by hash, and
    the text is read once per block.
    """
    spark = rows.sparkSession
    blocks = 1 if small_enough(fixes, limit) else -(-fixes.count() // limit)
    out = None
    for k in range(blocks):
        part = fixes if blocks == 1 else fixes.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k)
        strong, weak = {}, {}
        for r in part.toLocalIterator():
            (strong if r[2] else weak)[r[0]] = r[1]
        shared = spark.sparkContext.broadcast((strong, weak))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=(k == 0)) -> Iterator[pa.RecordBatch]:
            strong, weak = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    found = [x for x in _scan(part.column(2).to_pylist(), part.column(0).to_pylist(), part.column(1).to_pylist(), strong, weak) if first or x[3] == "misread?"]
                    if found:
                        cols = list(zip(*found))
                        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["record_id", "doc_id", "line_no", "kind", "text", "other"])

        got = rows.select("record_id", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _KINDS)
        out = got if out is None else out.unionByName(got)
    return out


def _headers(cand: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_id, line_no) of the candidates that are headers of their paper."""
    heads = cand.where("kind = 'header?'").select("record_id", "doc_id", "line_no", "text", "other")
    papers = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "authors_json").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, bool] = {}
            keep, folded = [], []
            for text, title, authors in zip(*(batch.column(k).to_pylist() for k in (3, 5, 6))):
                key = (text, title, authors)
                if key not in known:
                    known[key] = is_header(text, title, authors)
                keep.append(known[key])
                folded.append(fold(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(keep, pa.bool_()), pa.array(folded, pa.string()), batch.column(5)], ["record_id", "doc_id", "line_no", "other", "is", "folded", "title"])

    cols = heads.join(papers, "doc_id", "left").select("record_id", "doc_id", "line_no", "text", "other", "title", "authors_json")
    tested = cut(cols.mapInArrow(run, "record_id string, doc_id long, line_no int, other string, is boolean, folded string, title string"))
    sure = tested.where("is")
    # Papers whose title is unknown: an edge line that is repeated through the paper.
    bare = tested.where("not is and other = 'edge' and (title is null or title rlike '[.][A-Za-z0-9]{2,4}$') and length(folded) >= 8")
    again = bare.groupBy("doc_id", "folded").agg(F.count_distinct("record_id", "line_no").alias("times")).where("times >= 2")
    return sure.select("record_id", "line_no").unionByName(bare.join(again, ["doc_id", "folded"], "left_semi").select("record_id", "line_no")).distinct()


def noisy_lines(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((record_id, line_no, kind, text, other) of all confirmed lines, corrections)."""
    rows = records(chunks, docs)
    words = cut(word_counts(rows))
    fixes = cut(corrections(words))
    cand = cut(line_candidates(rows, fixes).distinct())
    heads = cut(_headers(cand, docs))
    pages = cand.where("kind = 'page_no'").select("record_id", "line_no", F.lit("page_no").alias("kind"))
    wrong = cand.where("kind = 'misread?'").select("record_id", "line_no").join(heads, ["record_id", "line_no"], "left_anti").select("record_id", "line_no", F.lit("misread").alias("kind"))
    hyph = cand.where("kind = 'hyphen?'").select(
        "record_id", "line_no", F.split("text", "\t")[0].cast("int").alias("at"), F.split("text", "\t")[1].alias("joined"), F.col("other").alias("dashed")
    ).join(heads, ["record_id", "line_no"], "left_anti")
    counts = lambda col: words.select(F.col("word").alias(col), F.col("n").alias("n_" + col))
    parts = hyph.withColumn("left", F.regexp_extract("dashed", r"^(.*)-", 1)).join(counts("joined"), "joined", "left").join(counts("dashed"), "dashed", "left").na.fill(0, ["n_joined", "n_dashed"])
    # The first continuation with evidence for either reading decides; without evidence a cut is assumed.
    best = parts.groupBy("record_id", "line_no").agg(
        F.min(F.when((F.col("n_joined") > 0) | (F.col("n_dashed") > 0), F.struct("at", "joined", "n_joined", "n_dashed"))).alias("known"),
        F.min(F.struct("at", "joined", "n_joined", "n_dashed")).alias("first"),
    )
    cutw = best.select("record_id", "line_no", F.coalesce("known", "first").alias("b")).where("b.n_joined >= b.n_dashed").select("record_id", "line_no", F.lit("hyphen").alias("kind"))
    head = heads.select("record_id", "line_no", F.lit("header").alias("kind"))
    return head.unionByName(pages).unionByName(cutw).unionByName(wrong).distinct(), fixes


def repaired_texts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_id, text): headers and page numbers out, cut words joined, misread words corrected, lines of a paragraph joined."""
    lines, fixes = noisy_lines(chunks, docs)
    lines = cut(lines)
    rows = records(chunks, docs).select("record_id", "text").distinct()
    # The corrections of a record's misread lines come to it by a join on the word, so their number is not bounded.
    wrong = lines.where("kind = 'misread'").select("record_id", "line_no")
    words = wrong.join(rows, "record_id").select("record_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.split("text", "\n")[F.col("line_no")]), F.lit("([\\p{L}\\p{M}\\p{N}_@]+)"), 1))).alias("word"))
    own = words.join(fixes.select("word", "fixed"), "word").distinct().groupBy("record_id").agg(F.collect_list(F.struct("word", "fixed")).alias("known"))
    marks = lines.groupBy("record_id").agg(F.collect_list(F.struct("line_no", "kind")).alias("marks")).join(own, "record_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks, known in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                texts.append(repair(text, marks, {k["word"]: k["fixed"] for k in known or ()}) if marks else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["record_id", "text"])

    return rows.join(marks, "record_id", "left").select("record_id", "text", "marks", "known").mapInArrow(run, "record_id string, text string")


def repair(text: str, marks: list[dict], known: dict[str, str]) -> str:
    """One text with its marked lines repaired."""
    kinds: dict[int, set[str]] = defaultdict(set)
    for m in marks:
        kinds[m["line_no"]].add(m["kind"])
    out: list[str] = []
    glue = ""
    for i, line in enumerate(text.split("\n")):
        if kinds[i] & {"header", "page_no"}:
            continue
        if "misread" in kinds[i]:
            line = unicodedata.normalize("NFKC", line) if any(c in line for c in LIGATURES) else line
            line = WORD.sub(lambda m: _like(m[0], known[m[0].lower()]) if m[0].lower() in known else m[0], line)
        if glue or (out and out[-1].strip() and line.strip() and len(out[-1]) < 200 and not re.match(r"\s*(?:[-*|]|\(?\w{1,2}[.)])\s", line)):
            line = out.pop() + ("" if glue else " ") + line.lstrip()
        glue = "hyphen" in kinds[i] and "-"
        if glue:
            line = line.rstrip().rstrip(HYPHENS)
        out.append(line)
    return "\n".join(out)


def _like(word: str, fixed: str) -> str:
    return fixed.upper() if word.isupper() and len(word) > 1 else fixed.capitalize() if word[:1].isupper() else fixed
