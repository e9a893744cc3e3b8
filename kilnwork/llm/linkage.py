"""The same publication in three tables without a shared key, each match with a confidence.

One inverted index holds all attributes of papers, resolved works and raw
references: the words of titles, and the words of author names together with the
year.  A term weighs its BM25 idf twice, as a term of the index and as a term of
the query; records are short and repeat no words, so term frequency and length
do not count.  A spelling one edit away is a typing error if one of both is met
at most ``TYPED`` times or the other ``OFTENER`` times as often; it counts 0.9 of
the word, and is taken to be as frequent as it.

Retrieval is exact for the score: whatever words a pair agrees in, frequent ones
and authors of many papers too, it is scored if it can reach the cover.  Each
titled record posts the keys of which such a pair must share one (see
``essentials``): rare words alone, pairs of frequent words where they could be
the heaviest that agree, with the year where that must agree too, and words of
authors with a title word.  Two upper bounds prune what is met.  Each key says by
how much what agrees can outweigh what the title then lacks; a pair is met only
if that makes up for the rare words of the query, which are missing as well where
no rare word is the key, and for authors and years that differ.  From a signature
of the query and a sketch of the title, its authors and year, the most the rest
can score is told, and pairs that cannot reach the cover are dropped in the join.
Nothing is cut off by number or frequency.

Retrieved pairs are scored by the share of their evidence that agrees; each
record keeps its nearest record in each other table (and those tied with it),
papers and works must be nearest to each other, and the score and its gap to the
runner-up give a confidence by a logistic curve fitted on a bounded sample of
references that carry a resolved DOI.  Copies of one record are matched once.
Where only frequent words agree, a record is matched only if no title with other
rare words is as near: what fits several publications tells none of them.

Defined results: null, empty and file-name titles match nothing; a title whose
marker of a continuation, reply or erratum differs is another publication; equal
records in one table all match; repeated rows add nothing.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.runtime import spread, written

_TOKEN = re.compile(r"[a-z]+-\d+|[a-z0-9]+")
_DASH = re.compile(r"[‐‑–—−]")
_TAG = re.compile(r"<[^<>]{1,40}>")
_FILE = re.compile(r"^\S+\.(?:pdf|docx?|html?|md|txt|tex)$|^scan[_-]?\d+\S*$", re.I)
_MARKER = re.compile(r"\b(?:erratum|corrigendum|correction|retraction|reply|response|comment|supplement|addendum|revisited|continued|continuation)\b|\bpart (?:[0-9]+|[ivx]+)\b|\b(?:ii|iii|iv)$")
_YEAR = re.compile(r"(?:19|20)\d\d")
_ORG = {"institute", "inst", "centre", "center", "ctr", "laboratory", "lab", "university", "univ", "department", "dept", "the", "for", "and", "prof", "von", "van", "der"}
#: Kinds of records; a query is of a higher kind than what it is held against.
DOC, WORK, REF = 0, 1, 2
#: Least weight of a rare title word, and of a rare pair of author and year, in words met once.
RARE, AUTHORED = 0.5, 0.65
#: A spelling is a typing error of another if it is met at most so often, or the other so many times oftener.
TYPED, OFTENER = 2, 20
#: Words in at least one of so many records are frequent; their number is at most this times the words of a record.
FREQUENT = 2000
#: What an agreeing year counts, what a differing one costs, and what one costs that is only read from a reference, in words met once.
SAME_YEAR, OTHER_YEAR, OTHER_READ = 0.17, 0.56, 0.22
#: Share of a title's evidence that must agree, the share from which a misspelt rare word counts as one that agrees, and the idf of a year.
SHARE, BLURRED, YEAR_IDF = 0.18, 0.6, 1.1
#: Least weight of a word whose errors are looked for by letters, in words met once.
FAINT = 0.2
#: Cost of a word that contradicts, and of a word beyond the end of the shorter copy.
AGAINST, BEYOND = 1.5, 0.4
_SHAPE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("authors", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("years", T.ArrayType(T.IntegerType())), T.StructField("clipped", T.BooleanType()), T.StructField("marker", T.StringType())]
)
_COLS = [f.name for f in _SHAPE.fields]
_BODY = _COLS[1:]


def plain(text: str) -> str:
    """Case, accents, markup, subscripts and dashes folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae")
        text = _DASH.sub("-", "".join(c for c in text if not unicodedata.combining(c)))
    return text.lower()


def marker_of(text: str) -> str:
    """The marker of a follow-up publication, if any, in one writing."""
    found = sorted({m.replace(" ii", " 2").replace(" iii", " 3") for m in _MARKER.findall(re.sub(r"[^a-z0-9]+", " ", text).strip())})
    return " ".join(found)


def title_record(key: str, kind: int, title, year, authors) -> tuple | None:
    """A row of a table that has titles."""
    if not isinstance(title, str) or not title.strip() or _FILE.match(title.strip()):
        return None
    low = plain(title)
    words = _TOKEN.findall(low)
    if not words:
        return None
    names = []
    if isinstance(authors, str) and authors.strip():
        try:
            listed = json.loads(authors)
        except ValueError:
            listed = [authors]
        for a in listed if isinstance(listed, list) else [listed]:
            of = [w for w in dict.fromkeys(_TOKEN.findall(plain(str(a)))) if len(w) > 2 and w not in _ORG]
            if of:
                names.append(of)
    return key, kind, words, names, [int(year)] if year is not None and year == year else [], bool(re.search(r"(?:\.\.\.|…)\s*$", title.strip())), marker_of(low)


def reference_record(key: str, raw) -> tuple | None:
    """A row of a table of raw reference strings: any of its words may be title or author."""
    if not isinstance(raw, str) or not raw.strip():
        return None
    low = plain(raw)
    words = _TOKEN.findall(low)
    return (key, REF, words, [], sorted({int(w) for w in words if _YEAR.fullmatch(w)}), True, marker_of(low)) if words else None


def _shaped(df: DataFrame, build) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()), pa.bool_(), pa.string()]
        for batch in batches:
            rows = [r for r in map(build, *(c.to_pylist() for c in batch.columns)) if r]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], _COLS)

    return df.mapInArrow(run, _SHAPE)


def paper_rows(docs: DataFrame) -> DataFrame:
    src = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.lit(DOC), "title", F.col("year").cast("int").alias("year"), "authors_json").where("key is not null and title is not null")
    return _shaped(src, title_record)


def work_rows(works: DataFrame) -> DataFrame:
    src = works.select(F.concat(F.lit("work/"), "doi").alias("key"), F.lit(WORK), "title", F.col("year").cast("int").alias("year"), "authors_json").where("key is not null and title <> ''")
    return _shaped(src, title_record)


def reference_rows(refs: DataFrame) -> DataFrame:
    src = refs.select(F.concat(F.lit("ref/"), "sha256").alias("key"), "raw_text").where("key is not null and raw_text is not null")
    return _shaped(src, reference_record)


# -- terms and their weights -----------------------------------------------------


def weight_of(n, size: int):
    """Weight of a term met in ``n`` of ``size`` records: the BM25 idf of the index times that of the query."""
    return F.pow(F.log(1 + (F.lit(size) - n + 0.5) / (n + 0.5)), 2) / 10 if not isinstance(n, (int, float)) else math.log(1 + (size - n + 0.5) / (n + 0.5)) ** 2 / 10


def _one_out(col: str):
    """A spelling and all it becomes with one letter left out, hashed: two spellings one edit or one swap apart share one of these."""
    return F.expr(f"array_distinct(transform(sequence(0, length({col})), i -> xxhash64(concat(substring({col}, 1, i - 1), substring({col}, i + 1)))))")


def near_spellings(vocabulary: DataFrame) -> DataFrame:
    """(x, w, n, clear): words of four letters and more with the other words one edit or swap away that have the same digits, both ways; n is how often w is met, clear whether it is met much oftener."""
    words = spread(vocabulary.where("length(term) >= 4 and term rlike '[a-z]'")).withColumns({"g": F.translate("term", "abcdefghijklmnopqrstuvwxyz-", ""), "o": F.expr("xxhash64(array_join(array_sort(split(term, '')), ''))")})
    keyed = words.select("term", "n", "g", "o", F.explode(_one_out("term")).alias("t"))
    a, b = keyed.select(F.col("term").alias("x"), F.col("n").alias("m"), "g", F.col("o").alias("p"), "t"), keyed.select(F.col("term").alias("w"), "n", "g", "o", "t")
    typed = (F.least("m", "n") <= TYPED) | (F.greatest("m", "n") >= OFTENER * F.least("m", "n"))
    pairs = a.join(b, ["t", "g"]).where("x < w").where(typed).where("o = p or levenshtein(x, w, 1) >= 0").select("x", "m", "w", "n").distinct()
    both = F.array(F.struct("x", "w", "n", (F.col("n") >= OFTENER * F.col("m")).alias("clear")), F.struct(F.col("w").alias("x"), F.col("x").alias("w"), F.col("m").alias("n"), (F.col("m") >= OFTENER * F.col("n")).alias("clear")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def near(a: str, b: str) -> bool:
    """One edit apart (a swap of neighbours counts as one), for words of four letters and more with the same digits."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 4 or abs(la - lb) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    m = min(la, lb)
    while i < m and a[i] == b[i]:
        i += 1
    if la == lb:
        one = a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    else:
        one = a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]
    return one and [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _year_key(years) -> np.ndarray:
    """What a year adds to the key of two words; 0 adds nothing."""
    y = np.asarray(years, np.int64).astype(np.uint64)
    return np.where(y > 0, _mixed(y + np.uint64(1 << 40)), np.uint64(0))


@functools.lru_cache(maxsize=1 << 15)
def _mixed_word(word: str) -> int:
    return int(_mixed(np.array([zlib.crc32(word.encode())], np.uint64))[0])


@functools.lru_cache(maxsize=1 << 12)
def _mixed_year(year: int) -> int:
    return int(_year_key([year])[0])


#: The room of a key that a pair is met by whatever else it lacks, and the toll of a key with an author.
_ANY, _BY_NAME = 1e30, -1.0


def essentials(title: dict[str, float], names: list[tuple[list[str], float]], year: int | None, once: float, cover: float = 0.5) -> dict[tuple[str, str, int], tuple[float, float]]:
    """Pairs of words, with a year or 0, of which every record shares one whose score with this title can reach ``cover``; a word alone is paired with itself.

    Words that weigh at least ``RARE`` of a word met once stand alone.  Of the
    records that share none of those, the two heaviest words they share are the
    key: two words are needed if what agrees could outweigh what is then known
    to be missing, the rest of the lighter words and the year agreeing.  Where
    only an author could make up for it, the key is a word of the author's name
    and the heaviest word shared.  ``names`` has the words and the weight of each.

    Each key has its room, by how much what agrees, without the year, can
    outweigh what is known to be missing of the title, and its toll, what it
    costs if both sides have authors: a pair that has only this key shares no
    rare word, and no author unless the toll is ``_BY_NAME``.
    """
    words, v = list(title), list(title.values())
    total, by_year, out = sum(v), SAME_YEAR * once, {}
    least, odds = SHARE * total * 0.999, _odds(cover)
    toll = odds * max((w for _, w in names), default=0.0)
    gone, lost, light = [0.0] * len(v), 0.0, []  # by position: what is known to be missing
    for i in sorted(range(len(v)), key=lambda i: -v[i]):
        if v[i] >= RARE * once:
            out[words[i], words[i], 0] = _ANY, 0.0
            gone[i] = v[i]
            lost += v[i]
        else:
            light.append(i)
    tails = [0.0] * (len(light) + 1)
    for x in range(len(light) - 1, -1, -1):
        tails[x] = tails[x + 1] + v[light[x]]

    def add(a: str, b: str, good: float, bad: float) -> None:
        if good >= bad:
            out[a, b, 0] = _looser((good - bad, toll), out.get((a, b, 0)))
        elif year and good + min(good, by_year) >= bad:
            out[a, b, year] = _looser((good - bad, toll), out.get((a, b, year)))

    def against(inside: float, rest: float) -> float:
        return odds * (AGAINST * inside + BEYOND * rest)

    for x, i in enumerate(light):
        if tails[x] < least:
            break
        u = sum(gone[:i])
        for name, weight in names:
            if tails[x] + min(tails[x], weight + by_year) >= (bad := against(u, lost - u)):
                room = tails[x] + min(tails[x], weight) - bad
                for w in name:
                    out[w, words[i], 0] = _looser((room, _BY_NAME), out.get((w, words[i], 0)))
        if v[i] >= least:
            u = sum(v[:i]) if i else total - v[i]  # one word is no beginning of a title
            add(words[i], words[i], v[i], against(u, total - v[i] - u))
        also, more = gone[:], lost
        for y in range(x + 1, len(light)):
            j = light[y]
            good = v[i] + tails[y]
            if good < least:
                break
            u = sum(also[: max(i, j)])
            add(words[i], words[j], good, against(u, more - u))
            also[j] = v[j]
            more += v[j]
        gone[i] = v[i]
        lost += v[i]
    return out


def _odds(cover: float) -> float:
    return 0.999 * cover / (1 - cover)


def _looser(a: tuple[float, float], b: tuple[float, float] | None) -> tuple[float, float]:
    """What holds for all pairs of two keys that are met as one."""
    return a if b is None else (max(a[0], b[0]), min(a[1], b[1]))


def keys_of(found: dict[tuple[str, str, int], tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """The hashes of the keys, with room and toll of each."""
    out: dict[int, tuple[float, float]] = {}
    for (a, b, year), room in found.items():
        k = (_mixed_word(a) + _mixed_word(b) + (_mixed_year(year) if year else 0)) & 0xFFFFFFFFFFFFFFFF
        k -= (k >> 63) << 64
        out[k] = _looser(room, out.get(k))
    return out


class Slots:
    """Which slots of a bounded table keys fall into; it only spares keys that nothing can meet, and tells no key away that it was built from."""

    def __init__(self, keys: DataFrame, col: str):
        n = keys.agg(F.approx_count_distinct(col)).first()[0]
        self.bits = min(28, max(12, math.ceil(math.log2(32 * n + 1))))
        slot = F.explode(F.array(F.shiftrightunsigned(col, 64 - self.bits), F.col(col).bitwiseAND(F.lit((1 << self.bits) - 1)))).alias("s")
        rows = keys.select(slot).groupBy(F.shiftrightunsigned("s", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v")).toArrow()
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)
        self.table[rows["k"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Each key is in two slots."""
        out = self._at(keys >> np.uint64(64 - self.bits))
        some = np.flatnonzero(out)
        out[some] = self._at(keys[some] & np.uint64((1 << self.bits) - 1))
        return out

    def _at(self, slot: np.ndarray) -> np.ndarray:
        return (self.table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


@functools.lru_cache(maxsize=128)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def asked_keys(words: np.ndarray, years: list[int], slots: Slots) -> list[int]:
    """The keys of all pairs of words, alone and with each year around those given, that fall into the slots."""
    h, out = _mixed(words.astype(np.uint64)), []
    when = _year_key([0, *sorted({z for y in years for z in (y - 1, y, y + 1)})])
    step = max(1, 200_000 // len(h))
    for i in range(0, len(h), step):
        a, b = _triangle(len(h)) if len(h) <= 80 else np.triu_indices(min(step, len(h) - i), 0, len(h) - i)
        keys = ((h[i + a] + h[i + b])[:, None] + when[None, :]).ravel()
        out.append(keys[slots.has(keys)])
    return np.unique(np.concatenate(out).view(np.int64)).tolist()


# A query's signature has 1,024 bits: two for each of its words, the years around its own and its marker, and the last one; the weight of the words
# that only agree with themselves and a byte of what it has follow.
_NEVER, _ALWAYS, _BYTES = 65534, 65535, 128
_ASKS = _BYTES + 5
_AUTHORED, _DATED, _READ = 1, 2, 4
#: The two bits of each code of a word; codes are below 65,521.
_ONE, _TWO = np.arange(1 << 16) % 1022, (np.arange(1 << 16) * 40503 % (1 << 16)) % 1022
_ONE[[_NEVER, _ALWAYS]] = _TWO[[_NEVER, _ALWAYS]] = 1022, 1023
_ONE, _TWO = _ONE.astype(np.uint16), _TWO.astype(np.uint16)
_BITS = [1 << int(a) | 1 << int(b) for a, b in zip(_ONE, _TWO)]
#: Words of a title and of its authors that a sketch has room for; what is beyond is taken to agree.
_HELD, _NAMED = 16, 12
_SKETCH = np.dtype([("at", "<u2", _HELD), ("weight", "<f2", _HELD), ("names", "<u2", _NAMED), ("parts", "<f2", _NAMED), ("author", "<f2"), ("dated", "<f2"), ("twice", "<f2"), ("year", "<u2"), ("marker", "<u2"), ("beyond", "<f2"), ("free", "<f2")])


def _code(word: str) -> int:
    return zlib.crc32(word.encode()) % 65521


def signature(hashes: list[int], years: list[int], marker: str, weight: float, has: int = 0) -> bytes:
    bits = 1 << 1023 | _BITS[_code("marker " + marker)]
    for h in hashes:
        bits |= _BITS[h % 65521]
    for y in years:
        for z in (y - 1, y, y + 1):
            bits |= _BITS[_code(f"year {z}")]
    return bits.to_bytes(_BYTES, "little") + struct.pack("<fB", weight, has)


def sketch(title: dict[str, float], names: list[tuple[list[str], float]], weights: dict[str, float], year: int | None, marker: str, once: float) -> bytes:
    """What ``reaches`` needs to know of a title: its words in order, those of its authors, and what these and the year count."""
    row = np.zeros((), _SKETCH)
    at, who = [_code(w) for w in title], list(dict.fromkeys(w for n, _ in names for w in n))
    row["at"], row["names"] = _NEVER, _NEVER
    row["at"][: len(at)], row["weight"][: len(at)] = at[:_HELD], list(title.values())[:_HELD]
    row["beyond"] = sum(list(title.values())[_HELD:])
    row["twice"] = sum(weights[w] for n, _ in names for w in n if w in title)
    if len(who) <= _NAMED:
        row["names"][: len(who)], row["parts"][: len(who)] = [_code(w) for w in who], [0.0 if w in title else weights[w] for w in who]
        row["twice"] += sum(weights[w] for n, _ in names for w in n if n.count(w) > 1)
    else:
        row["names"], row["free"] = _ALWAYS, sum(weights[w] for w in who)
    row["author"], row["dated"] = max((v for _, v in names), default=0.0), SAME_YEAR * once if year else 0.0
    row["year"], row["marker"] = _code(f"year {year}") if year else _NEVER, _code("marker " + marker)
    return row.tobytes()


def reaches(asked: np.ndarray, held: np.ndarray, cover: float) -> np.ndarray:
    """Whether the pairs of signatures and sketches can score ``cover``: the best over the word that is the last to agree."""

    def has(codes: np.ndarray) -> np.ndarray:
        codes = codes.reshape(len(asked), -1)
        bit = lambda at: np.take_along_axis(asked, (at >> 3).astype(np.int64), 1) >> (at & 7).astype(np.uint8) & 1 == 1
        return bit(_ONE[codes]) & bit(_TWO[codes])

    num = lambda name: held[name].astype(np.float32)
    w, there, flags = num("weight"), has(held["at"]), asked[:, _ASKS - 1]
    more, dated, most = num("beyond")[:, None], num("dated"), num("author")
    total = w.sum(1, keepdims=True) + more
    m, u = np.cumsum(np.where(there, w, 0), 1) + more, np.cumsum(np.where(there, 0, w), 1)
    named, same = has(held["names"]), has(held["year"])[:, 0]
    parts = np.where(named, num("parts"), 0).sum(1)
    # All names together agree in no less than the best of them does.
    author = np.where(named.any(1), np.where(num("free") > 0, most, np.minimum(most, 1.005 * (parts + num("twice")))), 0)
    with_ = author + np.where(same, dated, 0)
    # Of the query's words those are missing that are neither in the title nor in a name.
    theirs = m[:, -1] + parts + num("free")
    weight = np.ascontiguousarray(asked[:, _BYTES : _BYTES + 4]).view("<f4")[:, 0]
    bad = AGAINST * u + BEYOND * (total - m - u + np.maximum(0, 0.99 * weight - theirs)[:, None])
    # Authors that have no word in common, and years that differ.
    heavy = (there & (w >= 0.99 * RARE / SAME_YEAR * dated[:, None])).any(1) | (more[:, 0] > 0)
    late = np.where((flags & _READ > 0) & heavy, OTHER_READ, OTHER_YEAR) / np.float32(SAME_YEAR) * dated
    bad += (np.where(~named.any(1) & (flags & _AUTHORED > 0), most, 0) + np.where(~same & (flags & _DATED > 0), late, 0))[:, None]
    fits = m + np.minimum(m, with_[:, None]) >= 0.995 * cover / (1 - cover) * bad
    return ((fits & there).any(1) | (more[:, 0] > 0)) & (m[:, -1] >= 0.995 * SHARE * total[:, 0]) & has(held["marker"])[:, 0]


_INDEX = "cid long, kind int, years array<int>, hashes array<long>, asks binary, read boolean, authored boolean, lack float, keys array<long>, rooms array<float>, tolls array<float>, holds binary, body binary"


def _indexed(full: DataFrame, shared, once: float, cover: float) -> DataFrame:
    """Each record; queries with hashes of their words and a signature, titled ones with their keys and a sketch."""
    schema = T._parse_datatype_string(_INDEX)
    plain_types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32(), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(f.split(" ")[0], plain_types[f.split(" ")[1]]) for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            out = []
            # Column by column: rows of nested records are slow to read.
            rare, size = (batch.column(7).flatten().flatten(), batch.column(7).value_lengths().fill_null(0).to_pylist())
            terms, known, at = rare[0].to_pylist(), list(zip(*(c.to_pylist() for c in rare[1:]))), 0
            for cid, kind, words, authors, years, clipped, marker, n in zip(*(batch.column(k).to_pylist() for k in range(7)), size):
                own = common_of(words, authors, common)
                own.update(zip(terms[at : at + n], known[at : at + n]))
                at += n
                spelt = lambda ws: [own[w][1] for w in ws]  # noqa: B023, E731
                every = [*words, *(w for n in authors for w in n)]
                text = "\n".join((" ".join(spelt(words)), ";".join(" ".join(spelt(n)) for n in authors), " ".join(map(str, years)), "cut" if clipped else "", marker))
                body = struct.pack("<I", len(every)) + array("f", [own[w][0] for w in every]).tobytes() + array("I", [min(own[w][2], 2**32 - 1) for w in every]).tobytes() + text.encode()
                row = {"cid": cid, "kind": kind, "years": years, "body": body}
                if kind > DOC:
                    row["hashes"] = list({h for t in own.values() for h in (zlib.crc32(t[1].encode()), *(t[3] or ()))})
                    alone = {t[1]: t[0] for w in words if not (t := own[w])[3] and (authors or not clipped or len(t[1]) > 2 and not t[1].isdigit())}
                    row["read"], row["authored"] = not authors and clipped, bool(authors)
                    row["asks"] = signature(row["hashes"], years, marker, sum(alone.values()), _AUTHORED * row["authored"] | _DATED * bool(years) | _READ * row["read"])
                    # Where no rare word agrees, these are missing.
                    row["lack"] = _odds(cover) * BEYOND * sum(v for v in alone.values() if v >= RARE * once)
                if kind < REF:
                    title = {own[w][1]: own[w][0] for w in words}
                    names = [(spelt(n), sum(own[w][0] for w in n)) for n in authors]
                    keys = keys_of(essentials(title, names, years[0] if years else None, once, cover))
                    row["keys"], row["rooms"], row["tolls"] = list(keys), [r for r, _ in keys.values()], [t for _, t in keys.values()]
                    row["holds"] = sketch(title, names, {own[w][1]: own[w][0] for n in authors for w in n}, years[0] if years else None, marker, once)
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in arrow], schema=arrow)

    return full.select("cid", "kind", "words", "authors", "years", "clipped", "marker", "rare").mapInArrow(run, schema)


def common_of(words, authors, common) -> dict[str, tuple]:
    return {w: common[w] for ws in (words, *authors) for w in ws if w in common}


def indexed(rec: DataFrame, size: int, once: float, cover: float = 0.5) -> tuple[DataFrame, DataFrame, list[str]]:
    """(index of the records, near spellings, frequent words)."""
    tokens = rec.select("cid", F.explode(F.array_distinct(F.concat("words", F.flatten("authors")))).alias("term"))
    vocabulary = written(tokens.groupBy("term").agg(F.count("*").alias("n")))
    near_ = written(near_spellings(vocabulary))
    # A word is its canonical form: itself, or a spelling one edit away that is met much more often.
    crc = lambda c: F.crc32(F.col(c).cast("binary"))
    alike = near_.groupBy(F.col("x").alias("term")).agg(F.max("n").alias("m"), F.max(F.struct("n", "w")).alias("top"))
    canon = F.when(F.col("top.n") >= OFTENER * F.col("n"), F.col("top.w")).otherwise(F.col("term"))
    weight = weight_of(F.greatest("n", F.coalesce("m", "n")), size).cast("float")
    forms = written(vocabulary.join(alike, "term", "left").select("term", canon.alias("canon"), "n", weight.alias("u")))
    used = forms.where("canon <> term").select(F.col("canon").alias("w")).union(forms.where("canon = term").select("term")).distinct()
    around = near_.join(used, "w", "left_semi").groupBy(F.col("x").alias("canon")).agg(F.collect_list(crc("w")).alias("around"))
    # All that is known of a spelling is that of its canonical form.
    known = forms.select(F.col("term").alias("canon"), "u", "n").join(around, "canon", "left")
    terms = written(forms.select("term", "canon", (F.col("n") * FREQUENT >= size).alias("often")).join(known, "canon").select("term", "u", "canon", "n", "around", "often"))
    common = {r[0]: tuple(r)[1:] for r in terms.where("often").drop("often").toLocalIterator()}
    often = F.broadcast(terms.where("often").select("term"))  # at most FREQUENT times the words of a record
    own = tokens.join(often, "term", "left_anti").join(terms.drop("often"), "term").groupBy("cid").agg(F.collect_list(F.struct("term", "u", "canon", "n", "around")).alias("rare"))
    return written(_indexed(rec.join(own, "cid", "left"), rec.sparkSession.sparkContext.broadcast(common), once, cover)), near_, list(common)


def _filtered(held: DataFrame, slots) -> DataFrame:
    """The rows with those of their keys that fall into the slots, and what goes with the keys."""
    listed = {"keys": T.LongType(), "rooms": T.FloatType(), "tolls": T.FloatType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in listed}
            keys, size = of["keys"].flatten().to_numpy(zero_copy_only=False), of["keys"].value_lengths().to_numpy(zero_copy_only=False)
            keep = slots.value.has(keys.view(np.uint64))
            rows = np.repeat(np.arange(len(size)), size)[keep]
            got = batch.take(pa.array(rows))
            for c, lists in of.items():
                got = got.set_column(batch.schema.get_field_index(c), c, lists.flatten().filter(pa.array(keep)))
            yield got

    return held.mapInArrow(run, T.StructType([T.StructField(f.name, listed.get(f.name, f.dataType)) for f in held.schema.fields]))


def _asking(here: DataFrame, slots) -> DataFrame:
    """(q, kq, asks, lack, read, authored, years, keys): queries with the keys they share with a title."""
    cols = ["q", "kq", "asks", "lack", "read", "authored", "years", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [asked_keys(np.array(h, np.int64), y, slots.value) for h, y in zip(batch.column(7).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), pa.array(keys, pa.list_(pa.int64()))], cols)

    return here.mapInArrow(run, "q long, kq int, asks binary, lack float, read boolean, authored boolean, years array<int>, keys array<long>")


def _bounded(met: DataFrame, cover: float) -> DataFrame:
    """(q, d) of the pairs that can reach the cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda c: np.frombuffer(pa.concat_arrays([c]).buffers()[2] or b"", np.uint8)
        for batch in batches:
            if batch.num_rows:
                asks, holds = batch.column(2), batch.column(3)
                at = lambda c, k: whole(c)[c.offset * k : (c.offset + len(c)) * k]
                ok = reaches(at(asks, _ASKS).reshape(-1, _ASKS), np.frombuffer(at(holds, _SKETCH.itemsize), _SKETCH), cover)
                got = batch.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["q", "d"])

    return met.select("q", "d", "asks", "holds").mapInArrow(run, "q long, d long")


def _worth(once: float, cover: float):
    """Whether a pair met by a key can reach the cover by what is known of both sides: else it shares another key or none."""
    year = f"case when y = 0 or size(years) = 0 then 0d when array_contains(years, y) or array_contains(years, y - 1) or array_contains(years, y + 1) then {SAME_YEAR * once!r}d else {-_odds(cover) * OTHER_YEAR * once!r}d end"
    return F.expr(f"room >= {_ANY / 10!r}d or room + {year} - if(authored and toll > 0, toll, 0) + 0.01d >= if(read and toll < 0, 0, lack)")


def proposed(index: DataFrame, near_: DataFrame | None = None, common: list[str] | None = None, cover: float = 0.5, once: float | None = None) -> DataFrame:
    """(q, d): all pairs that share a key of the titled record ``d`` and whose evidence can reach ``cover``; the query ``q`` is of a higher kind.

    The index holds what is needed of ``near_`` and ``common``.
    """
    share = index.sparkSession.sparkContext.broadcast
    once = weight_of(1, max(index.count(), 2)) if once is None else once
    held = index.where("size(keys) > 0").select(F.col("cid").alias("d"), F.col("kind").alias("kd"), F.expr("coalesce(get(years, 0), 0)").alias("y"), "holds", "keys", "rooms", "tolls")
    here = index.where((F.col("kind") > DOC) & (F.size("hashes") > 0)).select("cid", "kind", "asks", "lack", "read", "authored", "years", "hashes")
    asking = written(_asking(here, share(Slots(held.select(F.explode("keys").alias("t")), "t"))))
    asked = asking.select(*asking.columns[:-1], F.explode("keys").alias("t"))
    posted = _filtered(held, share(Slots(asked.select("t"), "t"))).withColumnsRenamed({"keys": "t", "rooms": "room", "tolls": "toll"})
    return _bounded(asked.join(posted, "t").where("kq > kd").where(_worth(once, cover)), cover).distinct()


# -- scores ------------------------------------------------------------------------


class Query:
    """A record's words in their canonical spelling, ready to be looked up exactly or one edit away."""

    __slots__ = ("words", "weights", "marker", "bag", "_rest", "_authors", "_counts", "_names", "_sizes", "_numbers")

    def __init__(self, body: bytes):
        (n,) = struct.unpack_from("<I", body)
        self.weights, self._numbers = array("f", body[4 : 4 + 4 * n]), body[4 + 4 * n : 4 + 8 * n]
        words, *self._rest, self.marker = body[4 + 8 * n :].decode().split("\n")
        self.words = words.split(" ")
        self.bag = dict(zip(self.words, self.weights))
        self._authors = self._counts = self._names = self._sizes = None

    @property
    def authors(self) -> list[list[str]]:
        if self._authors is None:
            self._authors = [n.split(" ") for n in self._rest[0].split(";")] if self._rest[0] else []
        return self._authors

    @property
    def years(self) -> list[int]:
        return [int(y) for y in self._rest[1].split()]

    @property
    def clipped(self) -> bool:
        return bool(self._rest[2])

    @property
    def counts(self) -> dict[str, int]:
        if self._counts is None:
            self._counts = dict(zip([*self.words, *(w for n in self.authors for w in n)], array("I", self._numbers)))
        return self._counts

    @property
    def author_weights(self) -> list[array]:
        out, at = [], len(self.words)
        for name in self.authors:
            out.append(self.weights[at : at + len(name)])
            at += len(name)
        return out

    @property
    def names(self) -> set[str]:
        if self._names is None:
            self._names = {w for n in self.authors for w in n}
        return self._names

    def blurred(self, w: str, n: int, among) -> bool:
        """Whether a word of ``among`` is a typing error of ``w``, met ``n`` times, or the other way round."""
        if self._sizes is None:
            self._sizes = {}
            for x in self.counts:
                self._sizes.setdefault(len(x), []).append(x)
        k, a, z, m = len(w), w[0], w[-1], self.counts
        for size in (k - 1, k, k + 1):
            for x in self._sizes.get(size, ()):
                if (x[0] == a or x[-1] == z) and x in among and (min(n, m[x]) <= TYPED or max(n, m[x]) >= OFTENER * min(n, m[x])) and near(w, x):
                    return True
        return False


def _agree(mine: Query, other: Query, least: float) -> tuple[float, float, float]:
    """Evidence of a title that the other side has, that is missing inside, and that lies beyond its last word found.

    Only words that weigh at least ``least`` are looked for one edit away; errors
    of more frequent words are in the canonical spelling.
    """
    got, last, words, among = {}, -1, mine.words, other.bag
    for i, (w, v) in enumerate(zip(words, mine.weights)):
        if w not in got:
            got[w] = 1.0 if w in among else 0.9 if v >= least and other.blurred(w, mine.counts[w], among) else 0.0
        if got[w]:
            last = i
    if last < 1:  # one word is no beginning of a title
        last = len(words)
    m = u = c = 0.0
    for i, (w, v) in enumerate(zip(words, mine.weights)):
        g = got.pop(w, None)
        if g is None:
            continue
        if g:
            m += g * v
        elif i < last:
            u += v
        else:
            c += v
    return m, u, c


def score(q: Query, d: Query, once: float, least: float = 0.0) -> float:
    """The score of ``evidence``."""
    return evidence(q, d, once, least)[0]


def evidence(q: Query, d: Query, once: float, least: float = 0.0) -> tuple[float, bool]:
    """Share of the evidence of a pair that agrees, between 0 and 1, and whether a rare word or author does; 0 if they cannot be the same publication.

    What agrees is the title's evidence, and the best author and the year up to
    the same amount again.  Against it stand, weighted, the title words of either
    that the other lacks, those beyond the end of a copy that was cut off weighing
    less, and an author or a year that differs.  The year of a reference may be a
    page or volume, so that it costs less where it differs if something rare
    agrees.  A pair that is sure to stay below
    ``least`` may be given 0.
    """
    if q.marker != d.marker:
        return 0.0, False
    reference = not q.authors and q.clipped
    faint = FAINT * once
    m, u, c = _agree(d, q, faint)
    total = m + u + c  # near words count 0.9
    if m < SHARE * total or m * 2 < AGAINST * u + BEYOND * c:
        return 0.0, False
    author = most = 0.0
    among = q.bag if reference else q.names
    for name, weights in zip(d.authors, d.author_weights):
        got = sum(v if w in among else 0.9 * v if v >= faint and q.blurred(w, d.counts[w], among) else 0.0 for w, v in zip(name, weights))
        author, most = max(author, got), max(most, sum(weights))
    year = 0
    if (then := d.years) and (when := q.years):
        year = 1 if any(abs(y - then[0]) <= 1 for y in when) else -1
    good = m + min(m, author + (SAME_YEAR * once if year > 0 else 0.0))
    bad = AGAINST * u + BEYOND * c
    bad += most if most and not author and not reference and q.authors else 0.0
    bad += (OTHER_READ if reference else OTHER_YEAR) * once if year < 0 else 0.0
    if good < least * (good + bad):
        return 0.0, False
    if reference:
        # Where the title ends in the reference: its words looked up one after another.
        end = -1
        for w in d.words:
            try:
                end = q.words.index(w, end + 1)
            except ValueError:
                pass
        uq = cq = 0.0
        for w in dict.fromkeys(q.words):
            v = q.bag[w]
            if w in d.bag or w in d.names or w.isdigit() or len(w) < 3 or v >= faint and d.blurred(w, q.counts[w], d.counts):
                continue
            if q.words.index(w) < end:
                uq += v
            else:
                cq += v
    else:
        _, uq, cq = _agree(q, d, faint)
    bad += AGAINST * uq + BEYOND * cq
    if good < least * (good + bad):
        return 0.0, False
    heavy = [w for w, v in zip(d.words, d.weights) if v >= RARE * once]
    rare = any(w in q.bag for w in heavy) or m >= BLURRED * total and any(q.blurred(w, d.counts[w], q.bag) for w in heavy)
    if not rare and author and year >= 0:
        rare = any((math.sqrt(v) + YEAR_IDF) ** 2 >= AUTHORED * once and (w in among or q.blurred(w, d.counts[w], among)) for n, ws in zip(d.authors, d.author_weights) for w, v in zip(n, ws))
    if reference and year < 0 and not rare:
        bad += (OTHER_YEAR - OTHER_READ) * once
    return good / (good + bad), rare


def scored(pairs: DataFrame, index: DataFrame, once: float, cover: float) -> DataFrame:
    """(q, d, kq, kd, score, lack) of the proposed pairs whose score reaches the cover; ``lack`` stands for the rare words of the title that the query lacks, 0 where something rare agrees."""
    side = lambda k: index.select(F.col("cid").alias(k), F.col("kind").alias("k" + k), F.col("body").alias("b" + k))
    both = pairs.join(side("d"), "d").join(side("q"), "q").select("q", "d", "kq", "kd", "bq", "bd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Query] = {}
        at, query = None, None
        for batch in batches:
            keep, marks, lack = [], [], []
            for i, (q, d, bq, bd) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5)))):
                if q != at:
                    at, query = q, Query(bq)
                if d not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    known[d] = Query(bd)
                s, rare = evidence(query, known[d], once, cover)
                if s >= cover:
                    keep.append(i)
                    marks.append(s)
                    lack.append(0 if rare else 1 + zlib.crc32(" ".join(sorted({w for w, v in zip(known[d].words, known[d].weights) if v >= RARE * once and w not in query.bag})).encode()))
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(got.column(k) for k in range(4)), pa.array(marks, pa.float64()), pa.array(lack, pa.int64())], ["q", "d", "kq", "kd", "score", "lack"])

    return both.mapInArrow(run, "q long, d long, kq int, kd int, score double, lack long")


def nearest(pairs: DataFrame, by: str, among: str, margin: float = 0.12) -> DataFrame:
    """The pairs tied with the best of each ``by`` in each table ``among``, with the gap to the best of the rest.

    A pair is tied within ``margin`` of the best: a paper can be in a table twice, one copy less clean.
    """
    best = pairs.groupBy(by, among).agg(F.max("score").alias("_top"))
    kept = pairs.join(best, [by, among])
    tied = F.col("score") >= F.col("_top") - margin
    rest = kept.where(~tied).groupBy(by, among).agg(F.max("score").alias("_next"))
    return kept.where(tied).join(rest, [by, among], "left").select(*pairs.columns, (F.col("score") - F.coalesce("_next", F.lit(0.0))).alias("gap"))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a weak ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def matches(docs: DataFrame, works: DataFrame, refs: DataFrame, *, cover: float = 0.5, sample: int = 5000) -> DataFrame:
    """(key_a, key_b, score, confidence) of all matched pairs of two tables, the smaller key first.

    ``sample`` bounds the resolved references the confidence is fitted on, taken
    by the hash of their key.
    """
    rows = paper_rows(docs).unionByName(work_rows(works)).unionByName(reference_rows(refs))
    # Records go by a hash of their content, so that copies, however many, are matched once.
    keyed = written(rows.withColumn("cid", F.xxhash64(*_BODY)))
    rec = written(keyed.select("cid", *_BODY).dropDuplicates(["cid"]))
    size = rec.count()
    once = weight_of(1, max(size, 2))
    index, _, _ = indexed(rec, size, once, cover)
    pairs = written(proposed(index, cover=cover, once=once))
    got = written(scored(pairs, index, once, cover))
    forth = nearest(got, "q", "kd")
    # Where only frequent words agree and titles that differ in their rare words fit as well, none is told apart.
    one = forth.groupBy("q", "kd").agg((F.min("lack") == F.max("lack")).alias("alone"))
    forth = forth.join(one, ["q", "kd"]).where((F.col("lack") == 0) | F.col("alone"))
    # Papers and works must be nearest to each other; one publication has many references.
    back = nearest(got.where(F.col("kq") == WORK), "d", "kq").select("q", "d")
    kept = forth.join(back.withColumn("mutual", F.lit(True)), ["q", "d"], "left").where((F.col("kq") == REF) | F.col("mutual")).select("q", "d", "score", "gap")
    keys = keyed.select("cid", "key").distinct()
    named = written(kept.join(keys.select(F.col("cid").alias("q"), F.col("key").alias("a")), "q").join(keys.select(F.col("cid").alias("d"), F.col("key").alias("b")), "d").select("a", "b", "score", "gap"))
    told = refs.where("resolved_doi is not null and resolved_doi <> ''").select(F.concat(F.lit("ref/"), "sha256").alias("a"), F.concat(F.lit("work/"), "resolved_doi").alias("said"))
    marked = named.where("startswith(b, 'work/')").join(told, "a").select("score", "gap", (F.col("b") == F.col("said")).cast("double").alias("y"), "a", "b")
    marked = marked.orderBy(F.xxhash64("a"), "a", "b").limit(sample).collect()
    curve = np.array([6.0, 2.0, -5.0])
    if len(marked) >= 50 and 0 < sum(x["y"] for x in marked) < len(marked):
        curve = fit_logistic(np.array([[x["score"], x["gap"]] for x in marked]), np.array([x["y"] for x in marked]))
    z = F.col("score") * float(curve[0]) + F.col("gap") * float(curve[1]) + float(curve[2])
    return named.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), "score", (1.0 / (1.0 + F.exp(-z))).alias("confidence"))
