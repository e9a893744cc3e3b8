"""Language of documents and of the stretches of mixed ones, by a conditional random field.

Each word is a position of a linear chain; its states are the languages.  State
scores come from features of the word (the word itself where it is frequent,
prefixes, suffixes, inner trigrams); transition scores are learned separately
for the start of a line and for the inside of a line.  Forward-backward gives
each word a distribution over languages; a line takes the language with the
largest sum over its words, and lines without words join the run around them.

Training uses a bounded sample: at most ``per_language`` documents of each
language whose label can be read, picked by the hash of their id.  Code-switched
sequences are made from it by putting lines of one language into documents of
another.  Documents whose label the first model contradicts are dropped and the
model is trained again, so wrong labels do not stick.

Scoring reads every document whole, in one pass without a shuffle.  A document
longer than ``BLOCK`` words runs as several chains cut at line ends, each with
``OVERLAP`` words of its neighbours, so that it does not begin without context.

Defined results: null, empty and blank texts have no segments, and neither have
texts without letters; ties go to the language first in the model's order;
repeated rows repeat their result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+")
#: Words of one chain; documents scored together.
BLOCK, SLICE = 4096, 1024
#: Words of its neighbours that a chain cut out of a longer text takes along at each end.
OVERLAP = 256
#: English and native names of languages that stand for a code in labels.
NAMED = {
    "english": "en", "german": "de", "deutsch": "de", "french": "fr", "français": "fr", "spanish": "es", "español": "es",
    "portuguese": "pt", "português": "pt", "italian": "it", "italiano": "it", "dutch": "nl", "nederlands": "nl",
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl",
}
#: Share of a line's words that its language must have; other lines join the run around them.
TELLS = 0.8
_NO_LANGUAGE = {"und", "mul", "zxx", "mis", "unknown", "none", "n/a", "xx"}


def label_code(label: str | None) -> str | None:
    """The two-letter code a label means, if it can be read."""
    if not label:
        return None
    low = label.strip().lower()
    if low in NAMED:
        return NAMED[low]
    head = re.split(r"[-_ ]", low)[0]
    if head in NAMED:
        return NAMED[head]
    return head if len(head) == 2 and head.isalpha() and head not in _NO_LANGUAGE else None


def words_of(line: str) -> list[str]:
    """The words of a lower-cased line: runs of letters that touch no digit.

    A line of which less than a third are words (a table row, a list of codes) has none.
    """
    tokens = _TOKEN.findall(line)
    words = [w for w in tokens if w.isalpha()]
    return words if 3 * len(words) >= len(tokens) else []


def features(word: str) -> list[str]:
    """Lexicon, affix and n-gram features of a lower-cased word."""
    n = len(word)
    out = ["=" + word, "#%d" % min(n, 12)]
    for k in range(1, min(n, 4) + 1):
        out.append("<" + word[:k])
        out.append(word[-k:] + ">")
    for k in range(n - 2):
        out.append("~" + word[k : k + 3])
    return out


class Tagger:
    """Weights of the field, and decoding of texts."""

    def __init__(self, languages: list[str], index: dict[str, int], weights: np.ndarray, inside: np.ndarray, at_line: np.ndarray):
        self.languages, self.index, self.weights = languages, index, weights
        self.inside, self.at_line = inside, at_line
        self.forget()

    def __getstate__(self):
        return self.languages, self.index, self.weights, self.inside, self.at_line

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.languages)), dtype=np.float32)

    def _learn(self, word: str) -> int:
        index = self.index
        ids = [index[f] for f in features(word) if f in index]
        k = self.known[word] = len(self.known)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if ids:
            self.rows[k] = self.weights[ids].sum(axis=0)
        return k

    def words(self, text: str) -> tuple[list[int], list[int], int]:
        """Word numbers, the line each word stands in, and the number of lines."""
        known, learn = self.known, self._learn
        ids: list[int] = []
        lines: list[int] = []
        parts = text.lower().split("\n")
        for k, line in enumerate(parts):
            found = words_of(line)
            if found:
                ids += [known[w] if w in known else learn(w) for w in found]
                lines += [k] * len(found)
        return ids, lines, len(parts)

    def marginals(self, chains: list[tuple[np.ndarray, np.ndarray]], expected: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
        """Posterior of each word of each chain; a chain is (word numbers, whether a word starts a line).

        ``expected`` are two arrays to which the expected transitions inside lines and
        at the starts of lines are added.
        """
        order = sorted(range(len(chains)), key=lambda c: -len(chains[c][0]))
        size = np.array([len(chains[c][0]) for c in order])
        top = int(size[0]) if len(size) else 0
        n, s = len(order), len(self.languages)
        emit = np.ones((top, n, s), dtype=np.float32)
        start = np.zeros((top, n), dtype=bool)
        for j, c in enumerate(order):
            rows = self.rows[chains[c][0]]
            emit[: size[j], j] = np.exp(rows - rows.max(axis=1, keepdims=True))
            start[: size[j], j] = chains[c][1]
        emit += 1e-12
        inside, at_line = np.exp(self.inside).astype(np.float32), np.exp(self.at_line).astype(np.float32)
        alive = np.searchsorted(-size, -np.arange(1, top + 1), side="right")
        alpha = np.empty_like(emit)
        for t in range(top):
            k = alive[t]
            if t:
                a = alpha[t - 1, :k] @ inside
                b = np.nonzero(start[t, :k])[0]
                if len(b):
                    a[b] = alpha[t - 1, b] @ at_line
                a *= emit[t, :k]
            else:
                a = emit[0, :k].copy()
            a /= a.sum(axis=1, keepdims=True)
            alpha[t, :k] = a
        beta = np.ones((n, s), dtype=np.float32)
        for t in range(top - 1, -1, -1):
            k = alive[t]
            g = alpha[t, :k]
            g *= beta[:k]
            g /= g.sum(axis=1, keepdims=True)
            if t:
                m = emit[t, :k] * beta[:k]
                if expected is not None:
                    for at, trans, total in ((~start[t, :k], inside, expected[0]), (start[t, :k], at_line, expected[1])):
                        if at.any():
                            pair = alpha[t - 1, :k][at].astype(np.float64)[:, :, None] * trans[None] * m[at].astype(np.float64)[:, None, :]
                            total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                nb = m @ inside.T
                b = np.nonzero(start[t, :k])[0]
                if len(b):
                    nb[b] = m[b] @ at_line.T
                beta[:k] = nb / nb.sum(axis=1, keepdims=True)
        out: list[np.ndarray] = [np.zeros((0, s))] * n
        for j, c in enumerate(order):
            out[c] = alpha[: size[j], j]
        return out

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(first line, last line, language, confidence) of each stretch of each text."""
        if len(self.known) > 1_000_000:
            self.forget()
        chains, owner, lines_of, total, inner = [], [], [], [], []
        for i, text in enumerate(texts):
            ids, lines, n = self.words(text) if text else ([], [], 0)
            total.append(n)
            a = 0
            while a < len(ids):
                b = min(a + BLOCK, len(ids))
                while a < b < len(ids) and b > a + BLOCK // 2 and lines[b] == lines[b - 1]:
                    b -= 1
                # a chain that is cut out of a longer text has words of its neighbours at both ends
                lo, hi = max(0, a - OVERLAP), min(len(ids), b + OVERLAP)
                at = np.array(lines[lo:hi])
                first = np.ones(hi - lo, dtype=bool)
                first[1:] = at[1:] != at[:-1]
                chains.append((np.array(ids[lo:hi]), first))
                owner.append(i)
                lines_of.append(np.array(lines[a:b]))
                inner.append((a - lo, b - lo))
                a = b
        found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if not chains:
            return found
        # chains of like length together, so that few positions are padding
        order = sorted(range(len(chains)), key=lambda c: len(chains[c][0]))
        post: list[np.ndarray] = [None] * len(chains)  # type: ignore[list-item]
        lo = 0
        while lo < len(order):
            hi, longest = lo, 0
            while hi < len(order) and (hi == lo or (hi - lo + 1) * len(chains[order[hi]][0]) <= 400_000):
                hi += 1
            for c, p in zip(order[lo:hi], self.marginals([chains[c] for c in order[lo:hi]])):
                post[c] = p.astype(np.float64)
            lo = hi
        per_text: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
        for c, i in enumerate(owner):
            at, (lo, hi) = lines_of[c], inner[c]
            first = chains[c][1][lo:hi].copy()
            first[0] = True
            cuts = np.nonzero(first)[0]
            sums = np.add.reduceat(post[c][lo:hi], cuts, axis=0)
            per_text[i].append((at[cuts], sums, np.diff(np.append(cuts, len(at)))))
        for i, parts in enumerate(per_text):
            if not parts:
                continue
            line = np.concatenate([p[0] for p in parts])
            sums = np.concatenate([p[1] for p in parts])
            n = np.concatenate([p[2] for p in parts])
            best = sums.argmax(axis=1)
            clear = sums.max(axis=1) >= TELLS * n
            if not clear.any():
                best[:] = sums.sum(axis=0).argmax()
            elif not clear.all():  # unclear lines join the run before them, or the first run
                last = np.maximum.accumulate(np.where(clear, np.arange(len(best)), -1))
                last[last < 0] = np.argmax(clear)
                best = best[last]
            edge = np.nonzero(np.diff(best))[0] + 1
            begins = [0, *edge.tolist()]
            for a, b in zip(begins, [*begins[1:], len(best)]):
                y = int(best[a])
                found[i].append((int(line[a]) if a else 0, int(line[b]) - 1 if b < len(best) else total[i] - 1, self.languages[y], float(sums[a:b, y].sum() / n[a:b].sum())))
        return found


class _Adam:
    """Step sizes of one parameter array."""

    def __init__(self, par: np.ndarray, rate: float):
        self.par, self.rate, self.m, self.v, self.t = par, rate, np.zeros_like(par), np.zeros_like(par), 0

    def up(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.par += self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9)


def _train_once(docs: list[tuple[str, str]], languages: list[str], seed: int, epochs: int, least: int, steps: int = 120, ridge: float = 1.0) -> Tagger:
    """State weights by maximum entropy on word-in-document counts, then the whole field by gradient."""
    rng = random.Random(seed)
    split = []
    for code, text in docs:
        lines = [ws for line in text.lower().split("\n") if (ws := words_of(line))]
        if lines:
            split.append((languages.index(code), lines))
    s = len(languages)
    spread: dict[str, np.ndarray] = {}
    for y, lines in split:
        for w in {w for ws in lines for w in ws}:
            spread.setdefault(w, np.zeros(s))[y] += 1
    in_docs: Counter[str] = Counter()
    for w, n in spread.items():
        for f in features(w):
            in_docs[f] += int(n.sum())
    index = {f: k for k, f in enumerate(sorted(f for f, n in in_docs.items() if n >= least))}
    vocabulary = {w: k for k, w in enumerate(spread)}
    ids = [[index[f] for f in features(w) if f in index] or [0] for w in vocabulary]
    flat = np.array([f for x in ids for f in x], dtype=np.int64)
    sizes = np.array([len(x) for x in ids])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(ids)), sizes)
    by_feature = np.argsort(flat, kind="stable")
    feature_begin = np.searchsorted(flat[by_feature], np.arange(len(index)))
    back_owner = owner[by_feature]
    counts = np.array([spread[w] for w in vocabulary])
    docs_of = np.array([max(1, sum(1 for y, _ in split if y == k)) for k in range(s)])
    counts = counts / docs_of * docs_of.mean()  # languages weigh the same
    total = counts.sum(axis=1, keepdims=True)
    weights = np.zeros((len(index), s))
    rows = lambda: np.add.reduceat(weights[flat], begin, axis=0)
    pull = lambda g: np.add.reduceat(g[back_owner], feature_begin, axis=0)
    step = _Adam(weights, 0.1)
    for _ in range(steps):
        r = rows()
        p = np.exp(r - r.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step.up(pull(counts - total * p) - ridge * weights)
    inside = np.full((s, s), -7.0) + np.eye(s) * 7.0
    at_line = np.full((s, s), -5.0) + np.eye(s) * 5.0
    ups = [_Adam(weights, 0.01), _Adam(inside, 0.05), _Adam(at_line, 0.05)]
    for _ in range(epochs):
        chains = []
        for y, lines in split:
            a = rng.randrange(max(1, len(lines) - 40))
            seq = [(y, ws) for ws in lines[a : a + 40]]
            for _k in range(rng.choice((0, 0, 0, 0, 1))):
                oy, olines = rng.choice(split)
                a = rng.randrange(len(olines))
                at = rng.randrange(len(seq) + 1)
                seq[at:at] = [(oy, ws) for ws in olines[a : a + rng.randint(1, 4)]]
            chains.append(seq)
        rng.shuffle(chains)
        for lo in range(0, len(chains), 64):
            model = Tagger(languages, {}, weights, inside, at_line)
            model.rows = rows().astype(np.float32)
            packed, gold = [], []
            for seq in chains[lo : lo + 64]:
                packed.append((np.array([vocabulary[x] for _, ws in seq for x in ws]), np.array([k == 0 for _, ws in seq for k in range(len(ws))])))
                gold.append(np.array([y for y, ws in seq for _ in ws]))
            grad_rows = np.zeros((len(vocabulary), s))
            g_in, g_line = np.zeros_like(inside), np.zeros_like(at_line)
            e_in, e_line = np.zeros_like(inside), np.zeros_like(at_line)
            for (w, first), y, p in zip(packed, gold, model.marginals(packed, (e_in, e_line))):
                p = p.astype(np.float64)
                d = -p
                d[np.arange(len(y)), y] += 1
                np.add.at(grad_rows, w, d)
                for flag, g in ((False, g_in), (True, g_line)):  # observed transitions
                    t = np.nonzero(first[1:] == flag)[0]
                    np.add.at(g, (y[t], y[t + 1]), 1.0)
            g_in -= e_in
            g_line -= e_line
            ups[0].up(pull(grad_rows) - ridge * 0.1 * weights)
            ups[1].up(g_in - 0.1 * (inside + 7 * (1 - np.eye(s))))
            ups[2].up(g_line - 0.1 * (at_line + 5 * (1 - np.eye(s))))
    return Tagger(languages, index, weights.astype(np.float32), inside, at_line)


def train(docs: list[tuple[str, str]], *, seed: int = 7, epochs: int = 3, least: int = 4) -> Tagger:
    """A tagger from (code, text) pairs, some of which may be labelled wrongly."""
    docs = [(c, t) for c, t in docs if t and t.strip()]
    languages = sorted({c for c, _ in docs})
    if not languages:
        raise ValueError("no labelled document to learn from")
    first = _train_once(docs, languages, seed, 0, least)
    kept = []
    for (code, text), segs in zip(docs, first.segments([t for _, t in docs])):
        own = sum(b - a + 1 for a, b, lang, _ in segs if lang == code)
        if segs and own >= 0.95 * sum(b - a + 1 for a, b, *_ in segs):
            kept.append((code, text))
    if {c for c, _ in kept} != set(languages):
        return _train_once(docs, languages, seed, epochs, least)
    return _train_once(kept, languages, seed, epochs, least)


def labelled_sample(docs: DataFrame, per_language: int, least_docs: int, *, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most about ``per_language`` documents of each readable label, by the hash of their id."""
    counts = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(1000).collect()}
    by_code: Counter[str] = Counter()
    for label, n in counts.items():
        if code := label_code(label):
            by_code[code] += n
    share = {code: min(1.0, per_language / n) for code, n in by_code.items() if n >= least_docs}
    exact = [(label, share[label]) for label in counts if label in share]
    if not exact:
        return []
    pick = F.lit(False)
    for label, part in exact:
        pick = pick | ((F.col(lang_col) == label) & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(part * 1_000_000)))
    rows = docs.where(pick & (F.length(F.trim(F.col(text_col))) > 80)).select(lang_col, text_col, F.xxhash64(F.col(id_col)).alias("_h")).orderBy("_h", lang_col, text_col).limit(2 * per_language * len(exact)).collect()
    return [(r[0], r[1]) for r in sorted(rows)]


def segments(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 150,
    least_docs: int = 10,
    model: Tagger | None = None,
) -> DataFrame:
    """(id, label, seg_no, n_segments, line_from, line_to, lang, confidence) of each stretch of each text."""
    spark = docs.sparkSession
    source = docs.select(id_col, text_col, lang_col)
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, label string, seg_no int, n_segments int, line_from int, line_to int, lang string, confidence double"
    names = [id_col, "label", "seg_no", "n_segments", "line_from", "line_to", "lang", "confidence"]
    if model is None:
        sample = labelled_sample(docs, per_language, least_docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
        if not sample:
            return spark.createDataFrame([], schema)
        model = train(sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts = [t if t and t.strip() else None for t in part.column(1).to_pylist()]
                owner, rows = [], []
                for k, segs in enumerate(tagger.segments(texts)):
                    for j, (a, b, lang, conf) in enumerate(segs):
                        owner.append(k)
                        rows.append((j, len(segs), a, b, lang, conf))
                take = pa.array(owner, pa.int64())
                kinds = [pa.int32()] * 4 + [pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], names)

    return source.mapInArrow(run, schema)


def mislabelled_or_mixed(docs: DataFrame, **kw) -> DataFrame:
    """Segments of the documents whose label is not exactly the code of their one language."""
    found = segments(docs, **kw)
    return found.where((F.col("n_segments") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))).drop("label", "n_segments")
