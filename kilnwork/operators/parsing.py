"""Table functions over whole texts that keep state along the text: one document per row, no cross-row state.

They run as Arrow batches; each takes (id, text) and gives rows of spans, so
character offsets always refer to the stored text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

_HEADING = re.compile(r"^(#{1,6})[ \t]+(\S.*?)\s*$", re.M)
#: Headings that open no section of their own: fixed values.
_TEMPLATE_HEADINGS = {"open access", "correspondence", "corresponding author", "citation", "copyright", "keywords", "article info", "article history", "publisher's note", "abbreviations", "orcid", "author information", "cite this", "received", "accepted", "revised", "published"}
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
_INLINE = re.compile(r"(?<![\\$])\$(?!\s)([^$\n]+?)(?<!\s)\$(?!\d)")
_CHEMICAL = re.compile(r"\b(?:[A-Z][a-z]?\d*){2,}(?:\s*(?:\+|->|→)\s*(?:\d*(?:[A-Z][a-z]?\d*)+))+")
_GREEK = "\u0391-\u03a9\u03b1-\u03c9"
_SUBSCRIPT = "\u2080-\u2089\u00b2\u00b3\u207f"
_RELATION = "[=<>\u2264\u2265\u2248\u221d\u00b1]"
_OPERAND = f"[A-Za-z0-9_(){_GREEK}{_SUBSCRIPT}^]+"
#: The operands may follow each other only with an operator between them.
_UNICODE = re.compile(rf"(?:^|(?<=\s))([A-Za-z{_GREEK}][A-Za-z0-9_(){_GREEK}{_SUBSCRIPT}]*\s*{_RELATION}+\s*{_OPERAND}(?:\s*[+\-*/\u00b7\u22c5]\s*{_OPERAND})*)(?=\s|$|[,;:!?.])", re.M)
_OMITTED = re.compile(r"\*?\*?=+>.*?(?:picture|image).*?(?:omitted|removed).*?<+=+\*?\*?", re.I)
_NEAR_EQUATION = re.compile(r"where|equation|given\s+by|defined\s+as|expressed\s+as|formula|can\s+be\s+written|is\s+described\s+by|according\s+to|Eq\.|relation", re.I)
_NAMED = re.compile(r"(?:the\s+)?([A-Z][a-z]{2,}(?:['\u2019]s)?)\s+(?:(?:first|second|third|fourth|zeroth)\s+)?(?:law|equation|relation|formula|rule|principle|theorem)")
#: Words that give no formula its name, and words of prose: fixed values.
_NO_NAME = set("the this that each our their its any new general simple basic above following resulting governing".split())
_PROSE = set(
    "is are was were the and that this which with from for not but its has have had been will can may also than then such each into over both only very when where while"
    " about after before other between through during without however because although therefore important".split()
)
_CAPTION = re.compile(r"^(?:\*\*)?(fig(?:ure)?|table|scheme)\.?\s*(\d+)([a-z])?(?:\*\*)?\s*[.:|]\s*(\S.*)$", re.I | re.M)
_REFS = re.compile(r"^#{0,6}\s*(references|bibliography|works cited|literature cited)\s*$", re.I | re.M)
_NUMBERED = re.compile(r"^\s*(?:\[(\d{1,3})\]|(\d{1,3})[.)])\s+", re.M)


def _rows(df: DataFrame, fn: Callable[[str], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    key, text = df.columns
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            out = [(k, *r) for k, body in zip(pdf[key], pdf[text]) if isinstance(body, str) and body.strip() for r in fn(body)]
            yield pd.DataFrame(out, columns=[key, *names])

    return df.mapInPandas(run, f"`{key}` {kind}, {schema}")


def section_spans(body: str) -> list[tuple[list[str], int, int]]:
    """(path of headings, start, end) of each section; what stands before the first heading has an empty path."""
    marks = [(m.start(), m.end(), len(m[1]), m[2].strip()) for m in _HEADING.finditer(body)]
    marks = [m for m in marks if m[3].strip("*#: ").lower() not in _TEMPLATE_HEADINGS]
    out, stack, start = [], [], 0
    for at, after, level, title in marks:
        if body[start:at].strip():
            out.append(([h for _, h in stack], start, at))
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        start = after
    if body[start:].strip():
        out.append(([h for _, h in stack], start, len(body)))
    return out


def _pack(text: str, base: int, limit: int) -> list[tuple[int, int]]:
    """Spans of paragraphs packed up to the limit; an oversized paragraph is cut at sentences, then words."""
    pieces: list[tuple[int, int]] = []
    for m in re.finditer(r"\S(?:.*?)(?=\n[ \t]*\n|\Z)", text, re.S):
        a, b = m.span()
        while b - a > limit:
            window = text[a : a + limit]
            cut = max((x.end() for x in re.finditer(r"[.!?]\s+", window)), default=0) or window.rfind(" ") + 1 or limit
            pieces.append((a, a + cut))
            a += cut
        if a < b:
            pieces.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(base + a, base + b) for a, b in out]


def chunk_spans(body: str, limit: int = 1280, least_alnum: int = 30) -> list[tuple[int, str, list[str], int, int]]:
    """(ord, text, path, start, end) of the chunks of a document: a section is a chunk if it fits."""
    out = []
    for path, a, b in section_spans(body):
        spans = [(a, b)] if b - a <= limit else _pack(body[a:b], a, limit)
        for s, e in spans:
            piece = body[s:e].strip()
            if sum(c.isalnum() for c in piece) >= least_alnum:
                s += len(body[s:e]) - len(body[s:e].lstrip())
                out.append((len(out), piece, path, s, s + len(piece)))
    return out


def _plausible(text: str) -> bool:
    """Whether a text with a relation sign is a formula and not prose."""
    parts = [p.strip() for p in re.split(rf"\s*{_RELATION}+\s*", text, maxsplit=1)]
    if len(parts) < 2 or not all(parts):
        return False
    for side in parts:
        words = re.findall(r"[A-Za-z]+", side.lower())
        if words and all(w in _PROSE for w in words) or sum(len(w) >= 4 for w in words) >= 3:
            return False
    return any(len(w) <= 3 for w in re.findall(r"[A-Za-z]+", "".join(parts))) or bool(re.search(rf"[\d(){_GREEK}{_SUBSCRIPT}^_/]", text))


def equation_spans(body: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, latex, start, end, hash): display, inline, chemical, plain-text, image and named formulas, one of each content, by offset.

    The hash is of the whole formula; ``latex`` shows its first 500 characters.
    """
    found = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, latex: str, start: int, end: int) -> None:
        found.append((kind, latex[:500], start, end, hashlib.sha1(f"{kind}:{latex}".encode()).hexdigest()[:12]))

    for kind, pattern in (("display", _DISPLAY), ("inline", _INLINE), ("chemical", _CHEMICAL), ("unicode", _UNICODE)):
        # the spans of one pass do not overlap each other, so they are looked up among those of the passes before
        before = sorted(taken)
        begins, ends = [a for a, _ in before], [b for _, b in before]
        for m in pattern.finditer(body):
            k = bisect.bisect_left(begins, m.end()) - 1
            if k >= 0 and ends[k] > m.start():
                continue
            latex = next((g for g in m.groups() if g), m[0]).strip()
            if kind == "unicode":
                latex = latex.rstrip(".")
                if len(latex) < 3 or not _plausible(latex):
                    continue
            taken.append(m.span())
            add(kind, latex, m.start(), m.end())
    for m in _OMITTED.finditer(body):
        if _NEAR_EQUATION.search(body[max(0, m.start() - 300) : m.end() + 300]):
            add("image", "[image equation]", m.start(), m.end())
    names = set()
    for m in _NAMED.finditer(body):
        name = m[0].strip()
        if m[1].rstrip("'s\u2019").lower() not in _NO_NAME and name.lower() not in names:
            names.add(name.lower())
            add("named", name, m.start(), m.end())
    seen, out = set(), []
    for row in sorted(found, key=lambda r: r[2]):
        if row[4] not in seen:
            seen.add(row[4])
            out.append(row)
    return out


def caption_rows(body: str) -> list[tuple[str, int, str, str, int]]:
    """(kind, number, sub-letter, caption, start) of figures, tables and schemes, the first of each."""
    seen, out = set(), []
    for m in _CAPTION.finditer(body):
        kind = "figure" if m[1].lower().startswith("fig") else m[1].lower()
        key = (kind, int(m[2]), (m[3] or "").lower())
        if key not in seen:
            seen.add(key)
            out.append((*key, m[4].strip()[:500], m.start()))
    return out


def reference_rows(body: str, least: int = 20) -> list[tuple[int, str]]:
    """(ord, raw text) of the reference list: after its heading, else a numbered cluster in the last two fifths."""
    heads = list(_REFS.finditer(body))
    tail = body[heads[-1].end() :] if heads else body[int(len(body) * 0.6) :]
    marks = list(_NUMBERED.finditer(tail))
    if len(marks) >= 3:
        ends = [m.start() for m in marks[1:]] + [len(tail)]
        parts = [tail[m.end() : e] for m, e in zip(marks, ends)]
    elif heads:
        parts = re.split(r"\n\s*\n", tail)
    else:
        return []
    parts = [re.sub(r"\s+", " ", p).strip() for p in parts]
    return [(i, p) for i, p in enumerate(parts) if len(p) >= least]


def sections(df: DataFrame) -> DataFrame:
    return _rows(df, section_spans, "path array<string>, char_start int, char_end int", ["path", "char_start", "char_end"])


def chunk_documents(df: DataFrame, limit: int = 1280) -> DataFrame:
    return _rows(df, lambda b: chunk_spans(b, limit), "ord int, chunk string, path array<string>, char_start int, char_end int", ["ord", "chunk", "path", "char_start", "char_end"])


def equations(df: DataFrame) -> DataFrame:
    return _rows(df, equation_spans, "kind string, latex string, char_start int, char_end int, equation_id string", ["kind", "latex", "char_start", "char_end", "equation_id"])


def captions(df: DataFrame) -> DataFrame:
    return _rows(df, caption_rows, "kind string, number int, sub string, caption string, char_start int", ["kind", "number", "sub", "caption", "char_start"])


def bibliography(df: DataFrame) -> DataFrame:
    return _rows(df, reference_rows, "ord int, raw_text string", ["ord", "raw_text"])


def bind_spans(spans: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Each point (key, offset) with the first span (key, span_id, char_start, char_end) of its document that holds it."""
    from pyspark.sql import functions as F

    hit = points.join(spans, key).where((F.col("char_start") <= F.col("offset")) & (F.col("offset") < F.col("char_end")))
    return hit.groupBy(key, "offset").agg(F.min(F.struct("char_start", "span_id"))["span_id"].alias("span_id"))
