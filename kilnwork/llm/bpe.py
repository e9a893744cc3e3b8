"""Exact byte-pair encoding of a corpus by backtracking over longest matches.

A merge list is turned into three tables: an Aho-Corasick automaton over all
tokens, the longest shorter token that starts each token, and the pair of
tokens each token was merged from.  Two neighbouring tokens are compatible when
no merge across their border would have been applied before the merges inside
them; a chain of pairwise compatible tokens is exactly what the merge rules
produce.  Encoding takes the longest match at each position and steps back to
shorter ones only where the border to the previous token is not compatible, so
it is linear in the text.

Pieces (what the split pattern yields) recur, so a worker keeps the ids of the
pieces it has met in one flat table with offsets, and a batch of documents is
assembled from it with array gathers.

Defined results: a null text and an empty text give an empty list of ids;
characters outside the vocabulary fall apart into byte tokens; special-token
strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The public split pattern of the byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that are put together in one gather.
SLICE = 256
#: Pieces a worker remembers before it starts its table afresh.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("KILNWORK_TOKENIZERS", "/opt/tokenizers"), name)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies and the bytes they stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in table.values():
            table[chr(spare)] = b
            spare += 1
    return table


class PairEncoder:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = _bytes_of_symbols()
        raw = lambda s: bytes(stand_in[c] for c in s)
        ids = model["vocab"]
        # Ranks order the merges; ids are what comes out.  Bytes rank below all merges.
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        rank = {t: r for r, t in enumerate(self.token)}
        self.merged: dict[tuple[int, int], int] = {}
        out_id = [ids[next(s for s, v in stand_in.items() if v == b)] for b in range(256)]
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = rank[raw(left)], rank[raw(right)]
            whole = self.token[a] + self.token[b]
            if whole in rank:  # the same string by another merge: the first one counts
                self.merged.setdefault((a, b), rank[whole])
                continue
            rank[whole] = len(self.token)
            self.merged[a, b] = rank[whole]
            self.token.append(whole)
            self.parts.append((a, b))
            out_id.append(ids[left + right])
        self.out_id = np.array(out_id, dtype=np.int32)
        self.length = [len(t) for t in self.token]
        self.trie = ahocorasick.Automaton()
        for t, r in rank.items():
            self.trie.add_word(t.decode("latin-1"), r)
        self.trie.make_automaton()
        self.shorter = [-1] * len(self.token)
        for t, r in rank.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in rank:
                    self.shorter[r] = rank[t[:n]]
                    break
        self._fit: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PIECES).findall
        self.forget()

    # -- one piece -----------------------------------------------------------

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay two tokens under the merge rules."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) > 2_000_000:
                self._fit.clear()
            known = self._fit[a, b] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens step by step; at each state a merge across
        # the border that ranks before the merge undone last would have come first.
        before = len(self.token)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:
                before, inner = a, self.parts[a][1]
                if inner == a:
                    # a is a byte: only b can still come apart
                    before, inner = b + 1, self.parts[b][0]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                before, inner = b + 1, self.parts[b][0]
                if inner == b:
                    before, inner = a, self.parts[a][1]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        n = len(piece)
        longest = [0] * n
        length = self.length
        for end, r in self.trie.iter(piece.decode("latin-1")):
            start = end - length[r] + 1
            if length[r] > length[longest[start]] or longest[start] < 256:
                longest[start] = r
        if n and length[longest[0]] == n:
            return [longest[0]]
        chain: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest cannot be completed
        pos, cand = 0, longest[0] if n else -1
        while pos < n:
            while cand >= 0:
                end = pos + length[cand]
                if not dead[end] and (not chain or self.fits(chain[-1], cand)):
                    break
                cand = self.shorter[cand]
            if cand >= 0:
                chain.append(cand)
                pos = end
                cand = longest[pos] if pos < n else -1
            else:
                dead[pos] = 1
                last = chain.pop()
                pos -= length[last]
                cand = self.shorter[last]
        return chain

    # -- many texts ------------------------------------------------------------

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self, piece: str) -> int:
        ids = self.out_id[self.encode_piece(piece.encode("utf-8", "surrogatepass"))]
        k = self.known[piece] = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)
        return k

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; nulls and empty texts have no ids."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, learn, split = self.known, self._learn, self.split
        which: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                pieces = split(text)
                try:
                    which += [known[p] for p in pieces]
                except KeyError:
                    which += [known[p] if p in known else learn(p) for p in pieces]
            ends[i + 1] = len(which)
        w = np.fromiter(which, dtype=np.int64, count=len(which))
        counts = self.count[w]
        done = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.start[w] - done[:-1], counts) + np.arange(done[-1])
        return done[ends], self.flat[at]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[1].tolist()

    def count_tokens(self, texts: list[str | None]) -> list[int]:
        return np.diff(self.encode_all(texts)[0]).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ``ids``: token bytes gathered through the offset table."""
        if not hasattr(self, "_blob"):
            order = np.argsort(self.out_id)
            self._blob = np.frombuffer(b"".join(self.token[r] for r in order), dtype=np.uint8)
            self._at = np.concatenate([[0], np.cumsum([self.length[r] for r in order])])
        ids = np.asarray(list(ids), dtype=np.int64)
        if not len(ids):
            return ""
        counts = self._at[ids + 1] - self._at[ids]
        done = np.cumsum(counts)
        at = np.repeat(self._at[ids] - (done - counts), counts) + np.arange(done[-1])
        return self._blob[at].tobytes().decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> PairEncoder:
    """The encoder of a vocabulary, once per worker process."""
    return PairEncoder(path)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """One row per input row: ``id_col`` and ``ids`` (array<int>).

    No shuffle: each input split is encoded where it is read.  Other columns are
    not read at all.
    """
    path = path or vocabulary_path()
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ends, ids = enc.encode_all(part.column(1).to_pylist())
                if len(ids) < 2**31:
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])
                    continue
                for k in range(part.num_rows):  # texts so long that 32-bit offsets end
                    one = pa.ListArray.from_arrays(pa.array([0, ends[k + 1] - ends[k]], pa.int32()), pa.array(ids[ends[k] : ends[k + 1]]))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(k, 1), one], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
