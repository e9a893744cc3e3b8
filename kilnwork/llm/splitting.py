"""Oversized texts cut into overlapping pieces at natural boundaries.

Candidate ends are the paragraph, line, sentence and (where those leave a gap)
word boundaries of a text; where not even words end, plain positions stand in.
Dynamic programming picks the ends that minimise the sum of the penalties of
the cuts and of the squared deviation of each piece from the even size, over
all sequences of pieces of at most ``limit`` characters in which each piece
starts ``overlap`` characters, or slightly less so as to start at a word,
before the previous one ends.

Defined results: null texts and texts within the limit give no pieces; sizes
are code points; repeated rows are cut once per distinct (id, text); clashing
extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.bpe import encoder, vocabulary_path

#: Penalties of a cut after a paragraph, a line, a sentence, a word, and inside a word.
PENALTY = {"paragraph": 0.0, "line": 0.5, "sentence": 1.0, "word": 4.0, "none": 16.0}
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…。！？]['\"»”’)\]]*\s+|;\s+")
_SPACE = re.compile(r"\s+")
#: Weight of size imbalance against cut penalties, and the price of one piece more.
EVEN, PIECE = 6.0, 2.0


def boundaries(text: str, reach: int) -> tuple[list[int], list[float]]:
    """Positions at which a piece may end and their penalties, the end of the text last."""
    cost: dict[int, float] = {}
    for name, pattern in (("sentence", _SENTENCE), ("line", _LINE), ("paragraph", _PARAGRAPH)):
        for m in pattern.finditer(text):
            cost[m.end()] = PENALTY[name]
    cost[len(text)] = 0.0
    cost.pop(0, None)
    at, before = sorted(cost), 0
    for p in at:
        if p - before > reach:
            last = before
            for m in _SPACE.finditer(text, before, p):
                if m.end() - last >= 40 or p - m.end() < 40:
                    cost.setdefault(m.end(), PENALTY["word"])
                    last = m.end()
        before = p
    at, before = sorted(cost), 0
    for p in at:
        for q in range(before + reach // 2, p, reach // 2) if p - before > reach else ():
            cost.setdefault(q, PENALTY["none"])
        before = p
    at = sorted(cost)
    return at, [cost[p] for p in at]


def next_start(text: str, end: int, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` starts: a word start in the first fifth of the overlap, if any."""
    lo = max(0, end - overlap)
    if lo == 0 or not overlap or text[lo - 1].isspace() and not text[lo].isspace():
        return lo
    m = _SPACE.search(text, lo, lo + overlap // 5)
    return m.end() if m and m.end() < end else lo


def cut_points(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``; one span if it is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    fresh = limit - overlap
    at, cost = boundaries(text, max(2, fresh // 3))
    pieces = -(-(n - overlap) // fresh)
    even = (n + overlap * (pieces - 1)) / pieces
    starts = [0] + [next_start(text, p, overlap) for p in at]  # of the piece after candidate k - 1
    ends = [0, *at]
    best = [0.0] + [float("inf")] * len(at)
    back = [0] * len(ends)
    low = 0
    for j in range(1, len(ends)):
        e = ends[j]
        while starts[low] < e - limit:
            low += 1
        top = bisect_left(ends, e)
        for i in range(low, top):
            size = e - starts[i]
            if size > limit:
                continue
            c = best[i] + PIECE + cost[j - 1] + EVEN * ((size - even) / limit) ** 2
            if c < best[j]:
                best[j], back[j] = c, i
    spans, j = [], len(ends) - 1
    while j:
        spans.append((starts[back[j]], ends[j]))
        j = back[j]
    return spans[::-1]


def split_oversized(
    chunks: DataFrame,
    *,
    id_col: str = "chunk_id",
    text_col: str = "text",
    path_col: str = "section_path_json",
    limit: int = 2000,
    overlap: int = 200,
    tokenizer: str | None = None,
) -> DataFrame:
    """(id, piece_no, char_start, char_end, text, section path, token_count) of each text beyond the limit.

    The size filter runs in the scan; only oversized texts reach Python.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    path = tokenizer or vocabulary_path()
    big = chunks.select(F.col(id_col), F.col(text_col), F.col(path_col)).where(F.length(text_col) > limit).distinct()
    schema = f"`{id_col}` {big.schema[id_col].dataType.simpleString()}, piece_no int, char_start int, char_end int, `{text_col}` string, `{path_col}` {big.schema[path_col].dataType.simpleString()}, token_count int"
    names = [id_col, "piece_no", "char_start", "char_end", text_col, path_col, "token_count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                owner, spans, texts = [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for i, (a, b) in enumerate(cut_points(text, limit, overlap)):
                        owner.append(k)
                        spans.append((i, a, b))
                        texts.append(text[a:b])
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        *(pa.array([s[k] for s in spans], pa.int32()) for k in range(3)),
                        pa.array(texts, pa.string()),
                        part.column(2).take(take),
                        pa.array(enc.count_tokens(texts), pa.int32()),
                    ],
                    names,
                )

    return big.mapInArrow(run, schema)
