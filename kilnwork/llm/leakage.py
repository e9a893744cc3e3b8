"""Held-out evaluation passages inside corpus documents.

The evaluation items are numbered word by word; the hashes of all their runs of
``gram`` words form a sorted set that is broadcast in blocks of items, so its
size is bounded by ``block_words`` whatever the number of items.  Documents are
scanned once per block: words map to item-vocabulary numbers, rolling hashes of
runs inside that vocabulary are looked up in the set, and a hit is verified by
aligning the item with the document around it.

A passage counts if it has at least ``least`` consecutive words of the item of
which at most one in ``one_in`` was changed, the first and last word being
unchanged.  A run of ``gram`` = 5 unchanged words exists in every such passage
even when a line was put into it: with one change in eight, twenty words leave a
run of six.  Case, punctuation, spacing, line ends and hyphens at line ends do
not count; whole lines that stand between two words of a passage (page numbers,
running headers) are passed over.

Defined results: null, empty and blank texts and items give no rows; items
shorter than ``least`` words cannot leak; repeated rows give repeated hits that
``leaked_items`` folds; an empty benchmark gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
CUT = re.compile(r"(\w+)- ?\n\s*(\w+)")
SLICE = 512
#: Words of the inserted lines a chain may pass over at once.
REACH = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower-cased text in composed form, soft hyphens dropped, underscores as spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "")
    return text.replace("_", " ").lower()


def _run_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the run that starts at each position; the last ``gram - 1`` positions have none."""
    n = len(ids) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    wide = ids.astype(np.uint64)
    for k in range(gram):
        h = (h ^ wide[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class ItemIndex:
    """The broadcast side: vocabulary, item words and the sorted run hashes of one block of items."""

    def __init__(self, items: list[tuple[int, str]], gram: int, least: int, one_in: int, reach: int = REACH):
        self.gram, self.least, self.one_in, self.reach = gram, least, one_in, reach
        self.vocabulary: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.item_ids: list[int] = []
        where = []
        for item, text in items:
            words = WORD.findall(plain(text))
            if len(words) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
            hashes = _run_hashes(ids, gram)
            where.append(np.stack([hashes, np.full(len(hashes), len(self.words), dtype=np.uint64), np.arange(len(hashes), dtype=np.uint64)], axis=1))
            self.words.append(ids)
            self.item_ids.append(item)
        table = np.concatenate(where) if where else np.zeros((0, 3), dtype=np.uint64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.hashes, self.owner, self.place = table[:, 0].copy(), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)

    def tokens(self, text: str) -> list[str]:
        text = plain(text)
        if "-\n" in text or "- \n" in text:
            known = self.vocabulary
            text = CUT.sub(lambda m: m[1] + m[2] if m[1] + m[2] in known else m[0], text)
        return WORD.findall(text)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, item word from, item word to, changed words) of each passage."""
        if not len(self.hashes):
            return
        get, flat, start = self.vocabulary.get, [], [0]
        for t in texts:
            if t:
                flat += [get(w, -1) for w in self.tokens(t)]
            flat.append(-1)
            start.append(len(flat))
        ids = np.array(flat, dtype=np.int64)
        inside = np.concatenate([[0], np.cumsum(ids >= 0)])
        n = len(ids) - self.gram + 1
        if n <= 0:
            return
        runs = np.nonzero(inside[self.gram :][:n] - inside[:n] == self.gram)[0]
        if not len(runs):
            return
        h = np.zeros(len(runs), dtype=np.uint64)
        for k in range(self.gram):
            h = (h ^ ids[runs + k].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = np.nonzero(self.hashes[at] == h)[0]
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        owner_text = np.searchsorted(np.array(start), runs[hit], side="right") - 1
        for p, a, v, t in zip(runs[hit].tolist(), at[hit].tolist(), h[hit].tolist(), owner_text.tolist()):
            while a < len(self.hashes) and int(self.hashes[a]) == v:
                found[t, int(self.owner[a])].add(p - int(self.place[a]))
                a += 1
        lines: dict[int, list[int]] = {}
        for (t, item), offsets in sorted(found.items()):
            lo, hi = start[t], start[t + 1] - 1
            if len(offsets) > 1 and t not in lines:
                lines[t] = self.line_numbers(texts[t] or "")
            for a, b, wrong in self.passages(ids, lo, hi, self.words[item], sorted(offsets), lines.get(t)):
                yield t, self.item_ids[item], a, b, wrong

    def line_numbers(self, text: str) -> list[int]:
        """The line of each word; a word cut at a line end stands in the first of its lines."""
        text = plain(text)
        known, out = self.vocabulary, []
        kept = CUT.sub(lambda m: m[1] + m[2] + "\n" if m[1] + m[2] in known else m[0], text) if "-\n" in text or "- \n" in text else text
        for k, line in enumerate(kept.split("\n")):
            out += [k] * len(WORD.findall(line))
        return out

    def passages(self, ids, lo, hi, words, offsets, lines):
        """The longest accepted passage on each offset, or else one that passes over inserted lines."""
        n, seen = len(words), False
        rows = {}
        for d in offsets:
            p = np.arange(max(0, lo - d), min(n, hi - d))
            m = np.zeros(n, dtype=bool)
            m[p] = ids[d + p] == words[p]
            rows[d] = m
            got = self.window(m)
            if got:
                seen = True
                yield got
        if not seen and len(offsets) > 1:
            # chains reach at most so many words, so offsets further apart are never on one chain
            at = np.array(offsets)
            for group in np.split(at, np.nonzero(np.diff(at) > self.reach)[0] + 1):
                got = self.chained(rows, group, lines, lo) if len(group) > 1 else None
                if got:
                    yield got

    def chained(self, rows, group, lines, lo) -> tuple[int, int, int] | None:
        """An accepted passage along a chain of offsets, if there is one: forward over whole lines, or by one word lost or added.

        For each offset and each length of a stretch (all from ``least`` on as one)
        the best balance of matches and changes is kept, so no acceptable chain is
        missed because another has more matches elsewhere.
        """
        m = np.stack([rows[d] for d in group])
        k, n = m.shape
        top, total = self.least, len(lines) if lines else 0
        line = np.array(lines or [], dtype=np.int64)
        change = np.nonzero(np.diff(line))[0]
        begins, ends = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        begins[change + 1], ends[change] = True, True  # the first word of a line but the first, the last of one but the last
        shifts = [(s, group[s:] - group[:-s]) for s in range(1, min(k - 1, self.reach) + 1)]
        shifts = [(s, gap <= self.reach, gap == 1) for s, gap in shifts if (gap <= self.reach).any()]
        low = -(10**9)
        score, start = np.full((top + 1, k), low), np.zeros((top + 1, k), dtype=np.int64)
        best = None
        for p in range(n):
            new, frm = score.copy(), start.copy()
            first, last = group + p - lo, group + p - 1 - lo
            leaves = np.where((first >= 1) & (first < total), begins[np.clip(first, 0, total)], False)
            enters = np.where((last >= 0) & (last + 1 < total), ends[np.clip(last, 0, total)], False)

            def step(src, dst, ok):
                take = ok[None, :] & (score[:, src] > new[:, dst])
                new[:, dst] = np.where(take, score[:, src], new[:, dst])
                frm[:, dst] = np.where(take, start[:, src], frm[:, dst])

            for s, near_by, one in shifts:
                ok = near_by & (one | (leaves[:-s] & enters[s:]))
                if ok.any():
                    step(slice(0, k - s), slice(s, k), ok)
                if s == 1 and one.any():
                    step(slice(1, k), slice(0, k - 1), one)
            gain = np.where(m[:, p], 1, 1 - self.one_in)
            longer = new[top] >= new[top - 1]
            score[top] = np.maximum(new[top], new[top - 1]) + gain
            start[top] = np.where(longer, frm[top], frm[top - 1])
            score[2:top], start[2:top] = new[1 : top - 1] + gain, frm[1 : top - 1]
            score[1], start[1] = np.where(m[:, p], 1, low), p
            for d in np.nonzero(m[:, p] & (score[top] >= 0))[0]:
                a, length = int(start[top, d]), p + 1 - int(start[top, d])
                if best is None or length > best[1] - best[0]:
                    best = (a, p + 1, (length - int(score[top, d])) // self.one_in)
        return best

    def window(self, m: np.ndarray) -> tuple[int, int, int] | None:
        """The longest stretch with matching ends, long enough and with few enough changes."""
        at = np.nonzero(m)[0]
        if len(at) < self.least - self.least // self.one_in:
            return None
        # balance(a..b) = one_in * changes - length <= 0, over all pairs of matching ends
        wrong = np.concatenate([[0], np.cumsum(~m)])
        best = None
        for a in at:
            b = at[at >= a + self.least - 1]
            if not len(b):
                break
            bad = wrong[b + 1] - wrong[a]
            ok = np.nonzero(self.one_in * bad <= b + 1 - a)[0]
            if len(ok) and (best is None or b[ok[-1]] + 1 - a > best[1] - best[0]):
                best = (int(a), int(b[ok[-1]] + 1), int(bad[ok[-1]]))
        return best


def blocks_of_items(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_words`` words (a longer item stands alone)."""
    block, size = [], 0
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).dropDuplicates().orderBy(id_col)
    for r in rows.toLocalIterator():
        n = len(r[1].split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def leaked_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    gram: int = 5,
    least: int = 20,
    one_in: int = 8,
    block_words: int = 1_000_000,
    reach: int = REACH,
) -> DataFrame:
    """(id, item, word_from, word_to, n_changed) of every verified passage; no shuffle.

    ``reach`` is how many words of inserted lines a passage may be broken by at one
    place; a longer insertion makes two passages.
    """
    spark = docs.sparkSession
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, word_from int, word_to int, n_changed int"
    out = None
    for block in blocks_of_items(benchmark, item_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(ItemIndex(block, gram, least, one_in, reach))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, SLICE):
                    part = batch.slice(lo, SLICE)
                    hits = list(index.scan(part.column(1).to_pylist()))
                    if hits:
                        ids = part.column(0).take(pa.array([x[0] for x in hits]))
                        rest = [pa.array([x[k] for x in hits], t) for k, t in ((1, None), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
                        yield pa.RecordBatch.from_arrays([ids, *rest], [id_col, item_col, "word_from", "word_to", "n_changed"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def leaked_items(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row for each document and the item it holds a passage of."""
    found = leaked_passages(docs, benchmark, **kw)
    return found.select(found.columns[0], found.columns[1]).distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents that hold no passage of any item, all columns kept."""
    hit = leaked_items(docs, benchmark, id_col=id_col, **kw).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti")
