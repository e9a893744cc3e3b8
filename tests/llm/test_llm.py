"""Training-data operators against brute force, round trips and small defined cases."""

import glob
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kilnwork.llm import boilerplate, bpe, langid, leakage, linkage, names, scans, splitting

VOCAB = bpe.vocabulary_path()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files")
ROOT = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# -- repeated lines ---------------------------------------------------------------


def folded(line):
    return "".join(c for c in line.casefold() if c.isalpha())


def brute_lines(chunks, docs):
    pub = {d: p for d, p in docs if p is not None}
    size, where = {}, {}
    for d, p in docs:
        size.setdefault(p, set()).add(d)
    for c, d, text in set(chunks):
        for i, line in enumerate((text or "").split("\n")):
            f = folded(line)
            if text is not None and len(f) >= 10 and d in pub:
                where.setdefault((pub[d], f), []).append((d, c, i))
    return sorted({(c, i) for (p, f), w in where.items() for d, c, i in w if len({x[0] for x in w}) >= max(4, 0.15 * len(size[p]))})


@pytest.mark.parametrize("tracked", [4096, 4])
def test_repeated_lines_against_brute_force(spark, tracked):
    rng = random.Random(1)
    docs = [(i, rng.choice(["A", "B", None])) for i in range(60)]
    common = ["All rights reserved 2001", "ALL RIGHTS RESERVED, 1999!", "short", "Straße des Beispiels", "STRASSE DES BEISPIELS"]
    chunks = []
    for i in range(200):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"unique line of text {rng.choice('abcdefgh') * 3} {rng.choice('ijklmnop') * 4}" for _ in range(rng.randint(0, 5))]
        chunks.append((f"c{i}", rng.randrange(62), "\n".join(lines) if rng.random() > 0.05 else None))
    chunks += chunks[:10]
    c = spark.createDataFrame([(*x, "clash") for x in chunks], "chunk_id string, doc_id long, text string, publisher string")
    d = spark.createDataFrame(docs, "doc_id long, publisher string")
    got = rows(boilerplate.repeated_lines(c, d, tracked=tracked), "chunk_id", "line_no")
    assert got == brute_lines(chunks, docs) and got
    clean = {r["chunk_id"]: r for r in boilerplate.without_repeated_lines(c, d).collect()}
    assert len(clean) == 200 and sum(r["n_removed"] or 0 for r in clean.values()) == len(got)


def test_repeated_lines_of_empty_tables(spark):
    c = spark.createDataFrame([], "chunk_id string, doc_id long, text string")
    d = spark.createDataFrame([], "doc_id long, publisher string")
    assert boilerplate.repeated_lines(c, d).count() == 0


# -- splitting --------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    make = {
        0: lambda: "x" * 9001,
        1: lambda: " ".join("word" * rng.randint(1, 3) for _ in range(3000)),
        2: lambda: "\n\n".join("A sentence of some length. " * rng.randint(1, 30) for _ in range(40)),
        3: lambda: "\n".join("line" * rng.randint(1, 40) for _ in range(300)),
        4: lambda: "".join(rng.choice("ab. \n😀é") for _ in range(7001)),
        5: lambda: "a" * 2001,
    }
    text = make[seed]()
    spans = splitting.cut_points(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) > 1
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - a <= 2000 and 160 <= b - c <= 200 and c < b < d


def test_pieces_are_the_best_of_all_sequences():
    text = "One two three. Four five six seven.\n\nEight nine ten. " * 4
    limit, overlap = 60, 10
    at, cost = splitting.boundaries(text, max(2, (limit - overlap) // 3))
    n = len(text)
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n + overlap * (pieces - 1)) / pieces
    best = {0: (0.0, 0)}

    def price(spans):
        return sum(splitting.PIECE + dict(zip(at, cost))[b] + splitting.EVEN * ((b - a - even) / limit) ** 2 for a, b in spans)

    from functools import lru_cache

    @lru_cache(None)
    def solve(start, end_before):
        if end_before == n:
            return 0.0
        return min((splitting.PIECE + c + splitting.EVEN * ((e - start - even) / limit) ** 2 + solve(splitting.next_start(text, e, overlap) if e < n else n, e) for e, c in zip(at, cost) if e > end_before and e - start <= limit), default=float("inf"))

    assert price(splitting.cut_points(text, limit, overlap)) == pytest.approx(solve(0, 0)) and best


@needs_vocabulary
def test_split_operator(spark):
    big = "Sentence number one. " * 300
    df = spark.createDataFrame([("a", big, '["x"]', 1), ("a", big, '["x"]', 1), ("b", "small", None, 2), ("c", None, None, 3), ("d", "y" * 2000, None, 4)], "chunk_id string, text string, section_path_json string, piece_no int")
    got = splitting.split_oversized(df).orderBy("piece_no").collect()
    assert {r["chunk_id"] for r in got} == {"a"} and [r["piece_no"] for r in got] == list(range(len(got)))
    assert all(r["text"] == big[r["char_start"] : r["char_end"]] and r["section_path_json"] == '["x"]' and r["token_count"] > 0 for r in got)
    assert splitting.split_oversized(df.limit(0)).count() == 0


# -- encoding ---------------------------------------------------------------------


@needs_vocabulary
def test_encoding_equals_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    e = bpe.encoder(VOCAB)
    rng = random.Random(0)
    texts = ["", " ", "\n\n", "the the", "<|endoftext|>", "don't we'll", "naïve Straße 薄膜 😀​", "a" * 5000, "ab" * 3000, "x퟿"]
    texts += ["".join(rng.choice("abcdeing  \n\t.,'éü😀0123") for _ in range(rng.randint(1, 80))) for _ in range(600)]
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == want
        assert e.decode(want) == text
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate([*texts, None])], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df).collect()}
    assert got[len(texts)] == [] and got[0] == [] and all(got[i] == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))


# -- leakage ----------------------------------------------------------------------

ITEM = " ".join(f"word{i}" for i in range(60))


def altered(words, at):
    return [("changed%d" % i if i in at else w) for i, w in enumerate(words)]


def test_leaks(spark):
    w = ITEM.split()
    texts = {
        1: "intro text here. " + ITEM + " the end",
        2: "Some " + ", ".join(x.upper() for x in w[10:30]) + " rest",  # 20 words, other case and punctuation
        3: "Some " + " ".join(w[10:29]) + " rest",  # one word short
        4: " ".join(altered(w[5:45], {5, 13, 21, 29, 37})),  # one in eight changed
        5: " ".join(altered(w[5:45], {3, 6, 9, 12, 15, 18, 21, 24, 27, 30})),  # too many
        6: " ".join(w[0:15]) + "\nRunning Header of Something 12\n" + " ".join(w[15:32]),  # a line put in
        7: None,
        8: "",
        9: " ".join(w[i] for i in range(59, -1, -1)),
        10: " ".join(w[:12]) + " wo-\nrd12 " + " ".join(w[13:26]),  # a word cut at a line end
    }
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], "item_id long, text string")
    got = {r["doc_id"] for r in leakage.leaked_items(docs, bench).collect()}
    assert got == {1, 2, 4, 6, 10}
    assert {r["doc_id"] for r in leakage.leaked_items(docs, bench, block_words=10).collect()} == got
    assert leakage.without_leaks(docs, bench).count() == 5
    assert leakage.leaked_items(docs, bench.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), bench).count() == 0


def test_broken_leak_in_a_long_repetitive_text(spark):
    w = ITEM.split()
    noise = "\n".join(f"page {i} of the book says {' '.join(w[i % 50 : i % 50 + 5])} and then more" + " filler" * (i % 7) for i in range(300))
    header = noise + "\n" + " ".join(w[0:15]) + "\nRunning Header of Something 12\n" + " ".join(w[15:32]) + "\n" + noise
    dropped = noise + "\n" + " ".join(w[10:20] + w[21:35]) + "\n" + noise
    far = noise + "\n" + " ".join(w[0:15]) + "\n" + "unrelated words\n" * 30 + " ".join(w[15:32]) + "\n" + noise  # 60 words between
    docs = spark.createDataFrame([(1, header), (2, dropped), (3, noise), (4, far)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r["doc_id"] for r in leakage.leaked_items(docs, bench).collect()} == {1, 2}


def test_windows_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    ix = leakage.ItemIndex([(1, ITEM)], 5, 20, 8)
    for _ in range(300):
        m = np.array([rng.random() < rng.choice([0.8, 0.88, 0.95]) for _ in range(rng.randint(15, 60))])
        want = max((b - a for a in range(len(m)) for b in range(a + 20, len(m) + 1) if m[a] and m[b - 1] and 8 * int((~m[a:b]).sum()) <= b - a), default=0)
        got = ix.window(m)
        assert (got[1] - got[0] if got else 0) == want


# -- languages ----------------------------------------------------------------------

EN = ["the films were grown on the glass and the hardness of the layers increased with time", "we measured the growth rate of these films with ellipsometry", "this is the reason for which the data were corrected before use"]
DE = ["die schichten wurden auf dem glas gewachsen und die härte der proben nahm zu", "wir untersuchten die wachstumsrate der schichten mit hilfe der messung", "das ist der grund weshalb die daten vor der messung geprüft wurden"]


def mixed(rng, pool, n=6):
    return "\n".join(" ".join(rng.sample(x.split(), len(x.split()))) for x in rng.choices(pool, k=n))


def test_languages(spark):
    rng = random.Random(5)
    train = [(i, mixed(rng, EN), "en" if i % 12 else "de") for i in range(60)] + [(100 + i, mixed(rng, DE), "de-AT" if i % 9 == 0 else "de") for i in range(60)]
    cases = [(900, mixed(rng, EN, 3) + "\n12 | 14 | 99\n\n" + mixed(rng, DE, 3), "en"), (901, mixed(rng, DE), None), (902, mixed(rng, EN), "English"), (903, None, None), (904, "  \n ", "en"), (905, "123 456", None)]
    df = spark.createDataFrame([(*x, 7) for x in train + cases], "doc_id long, text string, lang string, seg_no int")
    got = {}
    for r in langid.mislabelled_or_mixed(df, least_docs=5).collect():
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["lang"]))
    assert sorted(got[900]) == [(0, "en"), (1, "de")] and got[901] == [(0, "de")] and got[902] == [(0, "en")]
    assert not {903, 904, 905} & set(got) and 1 not in got and 0 in got and 100 in got
    seg = [r for r in langid.segments(df, least_docs=5).where("doc_id = 900").orderBy("seg_no").collect()]
    assert seg[0]["line_to"] in (2, 3, 4) and seg[1]["line_to"] == 7 and all(0 <= r["confidence"] <= 1 for r in seg)
    assert langid.segments(df.limit(0)).count() == 0


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    tg = langid.Tagger(["a", "b"], {}, np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    tg.rows = rng.normal(size=(4, 2)).astype(np.float32)
    words, first = np.array([0, 1, 2, 3]), np.array([True, False, True, False])
    p, z = np.zeros((4, 2)), 0.0
    for ys in itertools.product(range(2), repeat=4):
        s = sum(tg.rows[w, y] for w, y in zip(words, ys)) + sum((tg.at_line if first[t] else tg.inside)[ys[t - 1], ys[t]] for t in range(1, 4))
        z += np.exp(s)
        for t in range(4):
            p[t, ys[t]] += np.exp(s)
    got = tg.marginals([(words, first), (np.array([1]), np.array([True]))])
    assert np.allclose(got[0], p / z, atol=1e-4) and got[1].shape == (1, 2)


# -- scans --------------------------------------------------------------------------


def test_page_numbers_and_headers():
    lines = ["text of the page that goes", "  113", "on here", "- 12 -", "Page 3 / 9", "xii", "[14]", "p. l9", "mild", "12"]
    assert scans.page_numbers(lines) == {1, 3, 4, 5, 6, 7, 9}
    assert scans.page_numbers(["3.5", "12", "13", "2.2"]) == set() and scans.page_numbers(["12"]) == set()
    title = "Growth of thin films on glass"
    for line in ("GROWTH OF THIN FILMS", "12   Growth of thin", "Growth of thin films · 14", "Miller et al.", "MILLER ET AL. · 7", "Miller and Smith — Growth of", "Gr0wth of thin films on"):
        t = scans.maybe_header(line)
        assert t and scans.is_header(t, title, '["Ann Miller"]'), line
    for line in ("growth of thin films", "Growth of other things", "Growth.", "| Growth | of |"):
        t = scans.maybe_header(line)
        assert not (t and scans.is_header(t, title, '["Ann Miller"]')), line


def test_noisy_lines(spark):
    page = "The hardness of the deposited films was measu-\nGrowth of thin films\n12\nred with care and the non-\nmonotonic trend was fouud in the hardncss of\nthe films during deposition"
    good = "the hardness of the deposited films was measured with care and the non-monotonic trend was found in the films " * 12
    chunks = spark.createDataFrame([("a", 1, page, "x"), ("a", 1, page, "x"), ("b", 2, good, "x"), ("c", 3, None, "x"), ("d", 3, "", "x")], "chunk_id string, doc_id long, text string, kind string")
    docs = spark.createDataFrame([(1, "Growth of thin films on glass", '["A. Miller"]', "The ﬁlms were\nmeasured"), (2, None, None, None)], "doc_id long, title string, authors_json string, abstract string")
    lines, _fixes = scans.noisy_lines(chunks, docs)
    assert rows(lines, "record_id", "line_no", "kind") == [("abstract/1", 0, "misread"), ("chunk/a", 0, "hyphen"), ("chunk/a", 1, "header"), ("chunk/a", 2, "page_no"), ("chunk/a", 4, "misread")]
    text = {r["record_id"]: r["text"] for r in scans.repaired_texts(chunks, docs).collect()}
    assert text["chunk/a"] == "The hardness of the deposited films was measured with care and the non- monotonic trend was fouud in the hardness of the films during deposition"
    assert text["abstract/1"].startswith("The films were")
    none = scans.noisy_lines(chunks.limit(0), docs.limit(0))[0]
    assert none.count() == 0


def test_anagram_hash_join_finds_every_single_confusion(spark):
    true = ["measured", "carbon", "films", "resistivity", "thermal", "steel"]
    wrong = {w[:i] + x + w[i + len(y) :]: w for w in true for x, y in scans.CONFUSIONS for i in range(len(w)) if w.startswith(y, i)}
    words = spark.createDataFrame([(w, 500) for w in true] + [(w, 1) for w in wrong if w not in true], "word string, n long")
    got = {r["word"]: r["fixed"] for r in scans.corrections(words).collect()}
    assert got == {k: v for k, v in wrong.items() if k not in true}


# -- names --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, want",
    [("Miller, Ann B.", ("p", "miller", "ann", "ab")), ("A. B. Miller", ("p", "miller", None, "ab")), ("Miller AB", ("p", "miller", None, "ab")), ("MILLER, Ann", ("p", "miller", "ann", "a")), ("Miller Ann", ("p", "miller", "ann", "a")),
     ("ann b. miller", ("p", "miller", "ann", "ab")), ("Dr.-Ing. Ann Miller", ("p", "miller", "ann", "a")), ("van der Berg Ann", ("p", "berg", "ann", "a")), ("J.-L. Miller", ("p", "miller", None, "jl")), ("Jean-Luc Miller,", ("p", "miller", "jeanluc", "jl")),
     ("Inst. of Applied Films (Xanadu)", ("o", "xanadu", "applied films institute", "")), ("The Xanadu Institute for Applied Films", ("o", "xanadu", "applied films institute", "")), ("  ", None), ("123", None)],
)
def test_read_name(raw, want):
    assert names.read_name(raw, {"ann", "jeanluc"}) == want


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(150)}
    df = spark.createDataFrame([("b", w) for w in words], "block string, text string")
    want = sorted((a, b) for a in words for b in words if a < b and min(len(a), len(b)) > 2 and names.osa(a, b))
    assert rows(names.near_pairs(df), "a", "b") == want and want


def test_osa():
    assert names.osa("abcd", "abdc") and names.osa("abcd", "abd") and names.osa("abcd", "abxcd") and not names.osa("abcd", "badc") and names.osa("", "a")


def test_linked_names(spark):
    authors = spark.createDataFrame(
        [("1", "Elizabeth Kornfeld", None), ("2", "Kornfeld, Liz", None), ("3", "E. Kornfeld", None), ("4", "Peter Kornfeld", None), ("5", "Elizabeth Kornfled", None), ("6", "", None), ("7", None, None), ("8", "J. Doppler", None)],
        "author_id string, display_name string, key string",
    )
    docs = spark.createDataFrame([(10, '["Kornfeld E", "James Doppler", "Elizabeth Kornfeld"]'), (11, '["John Doppler"]'), (12, None), (13, "broken")], "doc_id long, authors_json string")
    works = spark.createDataFrame([("w", '["KORNFELD, Elizabeth"]'), ("v", "")], "doi string, authors_json string")
    got = set(rows(names.same_names(authors, docs, works), "key_a", "key_b"))
    one = ["author/1", "author/2", "author/3", "author/5"]
    want = {(a, b) for a in one for b in one if a < b} | {(a, b) for a in one for b in ("document/10/0", "work/w/0")}
    assert got == want
    assert names.same_names(authors.limit(0), docs.limit(0), works.limit(0)).count() == 0


# -- publications -------------------------------------------------------------------


def test_matches(spark):
    docs = spark.createDataFrame(
        [(1, "Growth of zinoxide films on glass", 2001, '["Ann Miller"]'), (2, "GROWTH OF ZINOXIDE FILMS ON GLASS", None, '["Miller, A."]'), (3, "scan_1.pdf", 2001, '["Ann Miller"]'), (4, None, 2001, None), (5, "Hardness of brevatide layers under vacuum", 1999, '["Bob Stone"]')],
        "doc_id long, title string, year int, authors_json string",
    )
    works = spark.createDataFrame(
        [("w1", "Growth of zinoxide flims on glass", 2002, '["A. Miller"]'), ("w2", "Growth of zinoxide films on glass (erratum)", 2001, '["Ann Miller"]'), ("w3", "", None, ""), ("w4", "Hardness of morvatide layers under vacuum", 1999, '["Carl Stone"]')],
        "doi string, title string, year int, authors_json string",
    )
    refs = spark.createDataFrame(
        [("r1", "[3] Miller A., Growth of zinoxide films, J. Films 2001;3:14", None), ("r2", "B. Stone (1999). Hardness of brevatide layers under vacuum. J. Films, 3, 4.", "w4"), ("r3", "unrelated words entirely 2001", None), ("r4", None, None)],
        "sha256 string, raw_text string, resolved_doi string",
    )
    m = linkage.matches(docs, works, refs)
    got = set(rows(m, "key_a", "key_b"))
    assert got == {("doc/1", "work/w1"), ("doc/2", "work/w1"), ("doc/1", "ref/r1"), ("doc/2", "ref/r1"), ("ref/r1", "work/w1"), ("doc/5", "ref/r2")}
    assert all(0 < r["confidence"] < 1 for r in m.collect())
    assert linkage.matches(docs.limit(0), works.limit(0), refs.limit(0)).count() == 0


def test_matches_with_one_edit_a_word(spark):
    docs = spark.createDataFrame([(1, "Notes on brevatidex under load", 1999, '["Bob Stonefield"]'), (2, "Growth of zincal films on glass", 2001, None), (3, "Corvadite aging", 1988, '["Ann Miller"]')], "doc_id long, title string, year int, authors_json string")
    works = spark.createDataFrame(
        [("w1", "Notes on brevqtidex under load", 1999, '["Bob Stonefeild"]'), ("w2", "Growth of zimcal films on glass", 2002, None), ("w3", "Corvadite agieng", 1988, '["Ann Miller"]')], "doi string, title string, year int, authors_json string"
    )
    refs = spark.createDataFrame([("r1", "Stonefeild B., Notes on brevatidxe under load, J. Films 1999;3:14", None), ("r2", "2001 Growth of zimcal films on glass", None), ("r3", "Miller A, Corvadtie aging (1988)", None)], "sha256 string, raw_text string, resolved_doi string")
    got = set(rows(linkage.matches(docs, works, refs), "key_a", "key_b"))
    assert {(f"doc/{k}", x) for k in (1, 2, 3) for x in (f"work/w{k}", f"ref/r{k}")} <= got
    assert all(a[-1] == b[-1] for a, b in got)


def test_retrieval_finds_every_pair_that_scores(spark):
    """Index, pruning and scoring give what the score gives on all pairs."""
    import random

    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    people = ["".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(30)]

    def blur(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    titles = [(f"w{k}", " ".join(rng.sample(pool, rng.randint(1, 6))), rng.choice([1999, 2000, 2007, None]), rng.choice(["", f'["Al {rng.choice(people)}"]', f'["{rng.choice(people)}", "Bo {rng.choice(people)}"]'])) for k in range(120)]
    raw, docs = [], []
    for k in range(200):
        _, title, year, who = rng.choice(titles)
        words = [blur(w) if rng.random() < 0.3 else w for w in title.split()][: rng.randint(1, 6)]
        name = who.strip('["]').split('"')[0].removeprefix("Al ")
        raw.append((f"r{k}", f"{rng.choice([year, None]) or ''} {blur(name) if name and rng.random() < 0.4 else name} {' '.join(words)}"))
        docs.append((k, " ".join(words), rng.choice([year, year, None, 1990]), who))
    d = spark.createDataFrame(docs, "doc_id long, title string, year int, authors_json string")
    w = spark.createDataFrame(titles, "doi string, title string, year int, authors_json string")
    r = spark.createDataFrame(raw, "sha256 string, raw_text string")
    found = linkage.paper_rows(d).unionByName(linkage.work_rows(w)).unionByName(linkage.reference_rows(r))
    rec = found.withColumn("cid", F.xxhash64(*linkage._BODY)).drop("key").dropDuplicates(["cid"]).cache()
    size = rec.count()
    once = linkage.weight_of(1, size)
    index, near_, common = linkage.indexed(rec, size, once)
    got = {(x["q"], x["d"]) for x in linkage.scored(linkage.proposed(index, near_, common), index, once, 0.5).collect()}
    bodies = [(x["cid"], x["kind"], linkage.Query(x["body"])) for x in index.select("cid", "kind", "body").collect()]
    want = {(a, b) for a, ka, x in bodies for b, kb, y in bodies if ka > kb and linkage.score(x, y, once) >= 0.5}
    assert len(want) > 200
    assert got == want


def test_pairs_of_frequent_words_are_pruned_exactly(spark):
    """Titles of the same frequent words with other rare words, authors and years: what can reach the cover is scored, and little else."""
    rng = random.Random(1)
    letters = lambda n, of="abcdefghij": "".join(rng.choice(of) for _ in range(n))
    phrases = [[letters(rng.randint(4, 8)) for _ in range(rng.choice([4, 5, 6, 18]))] for _ in range(12)]
    people = [letters(8, "klmnopqrst") for _ in range(40)]
    docs, works, refs = [], [], []
    for k in range(150):
        phrase = rng.choice(phrases)
        words = rng.choice([[*phrase, letters(9)], [letters(9), *phrase], phrase, phrase[: len(phrase) // 2 + 1]])
        year, who = rng.choice([None, *range(1980, 2000)]), rng.sample(people, rng.choice([0, 1, 2, 14]))
        docs.append((k, " ".join(words), year, json.dumps([f"A. {p}" for p in who])))
        cut = words[: rng.randint(2, len(words))] if rng.random() < 0.3 else words
        works.append((f"w{k}", " ".join(w + "z" if rng.random() < 0.05 else w for w in cut) + rng.choice(["", " ..."]), rng.choice([year, year, None, 1985]), json.dumps(rng.choice([who, who[:1], rng.sample(people, 2), []]))))
        refs.append((f"r{k}", f"{' '.join(rng.choice([who, who[:1], []]))} {' '.join(cut)} {rng.choice([year, 1991, None]) or ''} {rng.choice(['', letters(9)])}"))
    found = linkage.paper_rows(spark.createDataFrame(docs, "doc_id long, title string, year int, authors_json string"))
    found = found.unionByName(linkage.work_rows(spark.createDataFrame(works, "doi string, title string, year int, authors_json string")))
    found = found.unionByName(linkage.reference_rows(spark.createDataFrame(refs, "sha256 string, raw_text string")))
    rec = found.withColumn("cid", F.xxhash64(*linkage._BODY)).drop("key").dropDuplicates(["cid"]).cache()
    size = rec.count()
    once = linkage.weight_of(1, size)
    index, near_, common = linkage.indexed(rec, size, once)
    pairs = {(x["q"], x["d"]) for x in linkage.proposed(index, near_, common).collect()}
    bodies = [(x["cid"], x["kind"], linkage.Query(x["body"])) for x in index.select("cid", "kind", "body").collect()]
    want = {(a, b) for a, ka, x in bodies for b, kb, y in bodies if ka > kb and linkage.score(x, y, once) >= 0.5}
    assert len(want) > 200
    assert want <= pairs
    assert len(pairs) < 2 * len(want)


def test_matches_of_frequent_words(spark):
    """Titles of words that many records have are matched too: a paper cited often, and tables of one publication."""
    docs = spark.createDataFrame([(1, "Growth of films on glass", None, None), (2, "Hardness of layers under load", 1999, '["Ann Miller"]')], "doc_id long, title string, year int, authors_json string")
    works = spark.createDataFrame([("w1", "Growth of films on glass", None, None)], "doi string, title string, year int, authors_json string")
    refs = spark.createDataFrame([(f"r{k}", f"[{k}] Growth of films on glass", None) for k in range(40)] + [(f"s{k}", f"[{k}] Hardness of layers under load", None) for k in range(40)], "sha256 string, raw_text string, resolved_doi string")
    got = set(rows(linkage.matches(docs, works, refs), "key_a", "key_b"))
    assert got == {("doc/1", "work/w1")} | {("doc/1", f"ref/r{k}") for k in range(40)} | {(f"ref/r{k}", "work/w1") for k in range(40)} | {("doc/2", f"ref/s{k}") for k in range(40)}
    one = refs.where("sha256 = 'r1'")
    assert set(rows(linkage.matches(docs.where("doc_id = 1"), works, one), "key_a", "key_b")) == {("doc/1", "work/w1"), ("doc/1", "ref/r1"), ("ref/r1", "work/w1")}


def test_what_fits_two_publications_tells_none(spark):
    """A reference cut off before the rare word of its title is matched only where one title is so begun."""
    fill = [(f"f{k}", f"Growth of steady silicon layers from pyxbat{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}", 1980, None) for k in range(20)]
    works = spark.createDataFrame([("w1", "Dry etching of silver films with zorblate", 2001, None), ("w2", "Dry etching of silver films with mirquat", 2001, None), ("w3", "Dry etching of copper films with halumene", 2001, None), *fill], "doi string, title string, year int, authors_json string")
    docs = spark.createDataFrame([], "doc_id long, title string, year int, authors_json string")
    refs = spark.createDataFrame([("r1", "2001 Dry etching of silver films with", None), ("r2", "2001 Dry etching of copper films with", None)], "sha256 string, raw_text string, resolved_doi string")
    assert set(rows(linkage.matches(docs, works, refs), "key_a", "key_b")) == {("ref/r2", "work/w3")}


def test_expected_transitions_are_those_of_all_paths():
    """Against the sum over all label sequences of short chains."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    inside, at_line = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    tagger = langid.Tagger(["a", "b", "c"], {}, np.zeros((0, 3), np.float32), inside, at_line)
    tagger.rows = rng.normal(size=(5, 3)).astype(np.float32)
    chains = [(np.array([0, 3, 1, 4]), np.array([True, False, True, False])), (np.array([2, 2]), np.array([True, True]))]
    got = (np.zeros((3, 3)), np.zeros((3, 3)))
    post = tagger.marginals(chains, got)
    want, each = (np.zeros((3, 3)), np.zeros((3, 3))), []
    for ids, first in chains:
        paths = list(itertools.product(range(3), repeat=len(ids)))
        value = [np.exp(sum(float(tagger.rows[w, y]) for w, y in zip(ids, p)) + sum((at_line if first[t] else inside)[p[t - 1], p[t]] for t in range(1, len(p)))) for p in paths]
        node = np.zeros((len(ids), 3))
        for p, v in zip(paths, value):
            for t, y in enumerate(p):
                node[t, y] += v / sum(value)
                if t:
                    want[1 if first[t] else 0][p[t - 1], y] += v / sum(value)
        each.append(node)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(post, each))
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(got, want))


def test_long_headers_and_names_of_many_steps(spark):
    title = "On the long and winding story of films that were grown on plates of glass under vacuum and measured for many years thereafter"
    assert len(title) > 110 and scans.maybe_header(title) == title and scans.is_header(title, title, None)
    chain = ["marbolden", "marbaldon", "marbalden"]  # the first and second are two edits apart, each one from the third
    df = spark.createDataFrame([(f"{s}, Theodora", n) for s, n in zip(chain, (2, 1, 5))] + [(f"{s}, Theodora", 9) for s in ("kern", "lohse", "mai")], "raw string, n long")
    got = {r["raw"].split(",")[0]: r["entity"] for r in names.entities(df).collect()}
    assert got["marbolden"] == got["marbaldon"] == got["marbalden"] and len({got["kern"], got["lohse"], got["mai"]}) == 3


# -- SQL ----------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found"])
def test_query_equals_sql(spark, name):
    import duckdb

    from kilnwork.llm import queries

    c = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = c.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, ROOT).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.itertuples(index=False, name=None))


def test_nothing_in_the_core_imports_this_subpackage():
    here = os.path.dirname(os.path.dirname(os.path.abspath(boilerplate.__file__)))
    for folder, _, files in os.walk(here):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f), encoding="utf-8").read()
                    assert not re.search(r"kilnwork\.llm|from \.+llm", text), f
    assert F is not None
