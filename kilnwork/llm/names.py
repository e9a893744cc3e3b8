"""Variant spellings of people and organisations linked to one entity.

A name is read into a surname (or the place of an organisation), a given name
(or what kind of organisation it is) and initials, whatever order and
punctuation it was typed in; short forms of given names are read as the given
name that occurs with the surname.  Misspelt surnames among bearers of one given
name, and misspelt given names among bearers of one surname, are found by a
pigeonhole segment join: each string is cut into ``k + 1`` segments, position
-shifted substrings of the others are looked up in the inverted index of
segments, and a hit is verified with a banded edit distance.  Initials are
attached to the one full name of the surname that fits them, or to none.

The joins run on distinct spellings, so the number of rows a name stands in does
not matter; a name that a third of all rows carry is one spelling.

Defined results: null and empty names are no entity; a name without letters is
its own; initials that fit several people of a surname link only to equal
initials; repeated rows repeat keys, not pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import cut

_SPACE = re.compile(r"\s+")
_TITLE = re.compile(r"^(?:(?:(?:professor|prof|dr\.?-ing|dipl\.?-ing|dr|mrs|mr|ms|sir)\b\.?)\s*)+", re.I)
_SUFFIX = re.compile(r",?\s+(?:jr|sr|ph\.?d|md)\.?$", re.I)
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?-?){1,4}$")
_PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "della", "dos", "du", "la", "le", "ten", "ter", "zu", "zur", "af", "av"}
#: Abbreviations in names of organisations: fixed values.
ORG_WORDS = {
    "inst": "institute", "institut": "institute", "instituto": "institute", "ctr": "centre", "center": "centre", "cent": "centre", "centro": "centre",
    "lab": "laboratory", "labs": "laboratory", "labor": "laboratory", "laboratories": "laboratory", "univ": "university", "dept": "department",
    "appl": "applied", "surf": "surface", "sci": "science", "sciences": "science", "mater": "materials", "material": "materials", "mat": "materials",
    "proc": "process", "chem": "chemistry", "phys": "physics", "technol": "technology", "tech": "technology", "nat": "national", "natl": "national",
    "eng": "engineering", "film": "films", "acad": "academy", "coll": "college", "res": "research", "polytech": "polytechnic",
}
_ORG_KINDS = {"institute", "centre", "laboratory", "university", "department", "polytechnic", "academy", "college", "school", "society", "company", "consortium", "foundation", "agency"}
_ORG_FILL = {"of", "for", "the", "and", "de", "für", "di", "do", "da"}
#: Short forms of given names: fixed values.
SHORT = {
    "alexander": "alex sasha sandy xander", "andrea": "andie", "anna": "annie anya", "anthony": "tony", "barbara": "barb barbie", "benjamin": "ben benny", "carla": "carly",
    "catherine": "cate cathy cat", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davey", "dorothea": "dora dot dorothy thea",
    "edward": "ed eddie ted ned", "elena": "lena ellie", "elizabeth": "liz beth lizzie betty eliza lisa", "frederick": "fred freddy fritz", "gabriel": "gabe", "giulia": "giulietta",
    "helena": "lena nell", "henrik": "rik henry", "irene": "rene", "isabel": "izzy bella isa", "jacob": "jake", "james": "jim jimmy jamie", "jeanluc": "jl", "johannes": "hannes hans jo",
    "jonathan": "jon jonny", "joseph": "joe joey", "julia": "jules julie", "katherine": "kate kathy katie kat", "kristina": "kris tina", "laura": "laurie lori", "leonard": "leo len lenny",
    "lucia": "lucy", "magnus": "mags", "margaret": "maggie peggy meg marge", "maria": "mary mia", "martin": "marty", "matthew": "matt mat", "michael": "mike mick mickey", "miguel": "migue",
    "mikhail": "misha", "natalie": "nat natasha", "nicholas": "nick nicky", "nikolai": "kolya niko", "oliver": "ollie", "patricia": "pat trish patty", "peter": "pete", "philip": "phil pip",
    "rafael": "rafa raf", "rebecca": "becky becca", "robert": "rob bob bobby robbie", "rosa": "rosie", "samuel": "sam sammy", "sofia": "sophie sonya", "stefan": "steff", "stephanie": "steph stephie",
    "susanna": "sue susie suzy", "tatiana": "tanya", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "valentina": "val", "victoria": "vicky tori vic",
    "vincent": "vince vinny", "william": "will bill billy liam", "ulrike": "uli rike", "karin": "kari", "yusuf": "yus", "stephen": "steve", "steven": "steve", "richard": "rick dick rich",
    "gregory": "greg", "jennifer": "jen jenny", "kenneth": "ken kenny", "lawrence": "larry", "deborah": "deb debbie", "pamela": "pam", "raymond": "ray", "ronald": "ron", "donald": "don",
}
_LONG: dict[str, list[str]] = {}
for _full, _shorts in SHORT.items():
    for _s in _shorts.split():
        _LONG.setdefault(_s, []).append(_full)


def fold(text: str) -> str:
    """Lower case, accents off, letters that do not decompose replaced."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("Æ", "AE").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def letters(text: str) -> str:
    return "".join(c for c in fold(text) if c.isalpha())


def osa(a: str, b: str, most: int = 1) -> bool:
    """Whether at most ``most`` edits (a swap of neighbours is one) turn ``a`` into ``b``; banded."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    before2: dict[int, int] = {}
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                row[0] = i
                continue
            v = min(before.get(j - 1, far) + (a[i - 1] != b[j - 1]), before.get(j, far) + 1, row.get(j - 1, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before2.get(j - 2, far) + 1)
            row[j] = v
        if min(row.values()) > most:
            return False
        before2, before = before, row
    return before.get(len(b), far) <= most


def ends_of(raw: str) -> tuple[str, str] | None:
    """First and last word of a name typed without comma, as letters."""
    text = _SUFFIX.sub("", _TITLE.sub("", _SPACE.sub(" ", raw).strip(" ,;"))).strip(" ,;")
    parts = text.split(" ")
    return None if "," in text or len(parts) < 2 else (letters(parts[0]), letters(parts[-1]))


def read_name(raw: str, given_names: set[str], near_given: set[str] | None = None) -> tuple[str, str, str | None, str] | None:
    """(kind, surname or place, given name or kind of organisation, initials) of a typed name.

    ``given_names`` and ``near_given`` have those of its first and last word that are
    given names, and that are one edit from one; without the latter the given names
    themselves are tried.
    """
    text = _SPACE.sub(" ", raw).strip(" ,;")
    if not text:
        return None
    words = [w for w in re.findall(r"[^\W\d_]+", fold(text))]
    if not words:
        return None
    plain = [ORG_WORDS.get(w, w) for w in words]
    if any(w in _ORG_KINDS for w in plain):
        kinds = sorted({w for w in plain if w not in _ORG_FILL and (w in _ORG_KINDS or w in set(ORG_WORDS.values()) or w in _ORG_COMMON)})
        place = [w for w in plain if w not in _ORG_FILL and w not in kinds]
        return "o", " ".join(sorted(place)), " ".join(kinds), ""
    text = _SUFFIX.sub("", _TITLE.sub("", text)).strip(" ,;")
    if not text:
        return None
    if "," in text:
        last, first = (x.strip() for x in text.split(",", 1))
        if not last or not first:
            last, first = last or first, ""
        lead = last.split(" ")
        if len(lead) > 1 and first and all(w.lower() in _PARTICLES for w in first.split(" ")):
            last, first = " ".join(lead), ""
    else:
        parts = text.split(" ")
        if len(parts) == 1:
            last, first = parts[0], ""
        elif re.fullmatch(r"[^\W\d_a-z]{1,3}", parts[-1]) and parts[-1].isupper() and not text.isupper():
            last, first = " ".join(parts[:-1]), ".".join(parts[-1])
        else:
            k = 0
            while k < len(parts) - 1 and (_INITIALS.match(parts[k]) and (parts[k].endswith(".") or len(parts[k]) == 1)):
                k += 1
            if k:
                last, first = " ".join(parts[k:]), " ".join(parts[:k])
            else:
                head, tail = letters(parts[0]), letters(parts[-1])
                known = lambda w: w in given_names or w in _LONG
                close = lambda w: w in given_names or (w in near_given if near_given is not None else any(len(g) > 3 and osa(w, g) for g in given_names))
                back = known(tail) and not known(head) or not known(head) and not close(head) and close(tail)
                if back and not parts[0].lower() in _PARTICLES or back and parts[0].lower() in _PARTICLES:
                    last, first = " ".join(parts[:-1]), parts[-1]
                else:
                    k = 1
                    while k < len(parts) - 1 and _INITIALS.match(parts[k]) and (parts[k].endswith(".") or len(parts[k]) == 1):
                        k += 1
                    if k == 1 and len(parts) > 2 and parts[1].lower() not in _PARTICLES:
                        k = len(parts) - 1 if not any(p.lower() in _PARTICLES for p in parts) else next(i for i, p in enumerate(parts) if p.lower() in _PARTICLES)
                    last, first = " ".join(parts[k:]), " ".join(parts[:k])
    surname = "".join(letters(w) for w in last.split(" ") if w.lower() not in _PARTICLES) or letters(last)
    if not surname:
        return None
    given, initials = None, ""
    for n, part in enumerate(re.split(r"[ ]+", first)):
        bits = [b for b in re.split(r"[-.]", part) if b]
        if not bits:
            continue
        whole = letters(part)
        if n == 0 and len(whole) > 2 and "." not in part and given is None and not (part.isupper() and len(part) <= 3):
            given = whole
            initials += "".join(letters(b)[:1] for b in bits)
        elif n == 0 and len(whole) == 2 and "." not in part and not part.isupper():
            given = whole
            initials += whole[:1]
        else:
            initials += "".join(letters(b)[:1] for b in bits) if any(len(b) == 1 for b in bits) or len(bits) > 1 else whole[:1]
    return "p", surname, given, initials


#: Words of fields that stand in names of organisations.
_ORG_COMMON = {"energy", "surface", "process", "applied", "films", "materials", "science", "chemistry", "physics", "technology", "national", "engineering", "research", "state"}


def near_pairs(strings: DataFrame, *, most: int = 1, among: DataFrame | None = None) -> DataFrame:
    """(block, a, b) with a < b: strings of one block at most ``most`` edits apart, swaps included; with ``among`` each string with those of the other table.

    ``strings`` has block and text, distinct.  A swap of neighbours counts two in
    the pigeonhole, so texts are cut into ``2 * most + 1`` segments.
    """
    k = 2 * most
    sized = strings.select("block", "text", F.length("text").alias("n")).where(F.col("n") > k)
    others = sized if among is None else among.select("block", "text", F.length("text").alias("n")).where(F.col("n") > k)
    seg = F.expr(
        f"transform(sequence(0, {k}), i -> struct(i as i, cast(floor(i * n / {k + 1}) as int) as at,"
        f" cast(floor((i + 1) * n / {k + 1}) as int) - cast(floor(i * n / {k + 1}) as int) as len))"
    )
    index = others.withColumn("s", F.explode(seg)).select("block", F.col("text").alias("b"), F.col("n").alias("m"), F.col("s.i").alias("i"), F.expr("substring(text, s.at + 1, s.len)").alias("part"))
    probe = F.expr(
        f"flatten(transform(sequence(greatest(n - {most}, {k + 1}), n + {most}), m -> flatten(transform(sequence(0, {k}), i ->"
        f" transform(sequence(-{most}, {most}), d -> struct(m as m, i as i, cast(floor(i * m / {k + 1}) as int) + d as at,"
        f" cast(floor((i + 1) * m / {k + 1}) as int) - cast(floor(i * m / {k + 1}) as int) as len)))))) "
    )
    probes = (
        sized.withColumn("s", F.explode(probe))
        .where("s.at >= 0 and s.at + s.len <= n and s.len > 0")
        .select("block", F.col("text").alias("a"), F.col("s.m").alias("m"), F.col("s.i").alias("i"), F.expr("substring(text, s.at + 1, s.len)").alias("part"))
    )
    pairs = probes.join(index, ["block", "m", "i", "part"]).where("a < b" if among is None else "a <> b").select("block", "a", "b").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [osa(a, b, most) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(verify, pairs.schema)


def _read(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every distinct name read; the lexicon of given names is joined to the first and last words, never sent to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(raw, w) for raw in batch.column(0).to_pylist() for w in (ends_of(raw) or ()) if w]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["raw", "word"])

    words = cut(names.select("raw").mapInArrow(ends, "raw string, word string").distinct())
    distinct = words.select("word").distinct()
    same = distinct.join(lexicon.select(F.col("given").alias("word")), "word", "left_semi").select("word", F.lit(True).alias("known"))
    one = F.lit("g").alias("block")
    pairs = near_pairs(distinct.where("length(word) >= 3").select(one, F.col("word").alias("text")), among=lexicon.where("length(given) > 3").select(one, F.col("given").alias("text")))
    close = pairs.select(F.col("a").alias("word"), F.lit(False).alias("known")).distinct()
    told = words.join(same.unionByName(close), "word").groupBy("raw").agg(F.collect_set(F.when(F.col("known"), F.col("word"))).alias("given_names"), F.collect_set(F.when(~F.col("known"), F.col("word"))).alias("near_given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, n, known, close in zip(*(batch.column(k).to_pylist() for k in range(4))):
                got = read_name(raw, set(known or ()), set(close or ()))
                if got:
                    longs = _LONG.get(got[2] or "", []) if got[0] == "p" else []
                    out.append((raw, n, *got, longs))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["raw", "n", "kind", "surname", "given", "initials", "longs"])

    asked = names.join(told, "raw", "left").select("raw", "n", "given_names", "near_given")
    return asked.mapInArrow(run, "raw string, n long, kind string, surname string, given string, initials string, longs array<string>")


def given_lexicon(names: DataFrame, least: int = 3) -> DataFrame:
    """(given): given names, learned from the names typed as ``Surname, Given``: words that follow several surnames."""
    m = names.where("raw rlike '^[^,]+, *[^,. ]{3,}( |$)'").select(F.regexp_extract("raw", r"^([^,]+),", 1).alias("s"), F.regexp_extract("raw", r", *([^, ]{3,})", 1).alias("g"))
    got = m.groupBy("g").agg(F.count_distinct(F.lower("s")).alias("k")).where(F.col("k") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([letters(g) for g in batch.column(0).to_pylist()], pa.string())], ["given"])

    return got.select("g").mapInArrow(run, "given string").where("given <> ''").distinct()


def _led(forms: DataFrame, edges: DataFrame) -> DataFrame:
    """(surname, given, to_surname, to_given): each form with the heaviest form its misspellings lead to, however many steps.

    Every form points to its heaviest neighbour if that is heavier (ties by
    spelling); pointers are doubled until none moves, so chains of any length end
    at their head in a logarithmic number of joins.
    """
    key = ["surname", "given"]
    heavy = forms.select(*[F.col(c).alias("b_" + c) for c in key], F.col("n").alias("m"))
    pull = edges.join(heavy, ["b_" + c for c in key]).groupBy(*["a_" + c for c in key]).agg(F.max(F.struct("m", *["b_" + c for c in key])).alias("best"))
    j = forms.join(pull, [forms[c] == pull["a_" + c] for c in key])
    lighter = (F.col("best.m") > F.col("n")) | ((F.col("best.m") == F.col("n")) & (F.struct(*["best.b_" + c for c in key]) < F.struct(*[F.col(c) for c in key])))
    to = cut(j.where(lighter).select(*key, *[F.col("best.b_" + c).alias("to_" + c) for c in key]))
    while True:
        hop = to.select(F.col("surname").alias("s1"), F.col("given").alias("g1"), F.col("to_surname").alias("s2"), F.col("to_given").alias("g2"))
        on = to.join(hop, (to["to_surname"] == hop["s1"]) & (to["to_given"] == hop["g1"]), "left")
        moved = cut(on.select("surname", "given", F.coalesce("s2", "to_surname").alias("to_surname"), F.coalesce("g2", "to_given").alias("to_given"), F.col("s2").isNotNull().alias("on")))
        to = moved.drop("on")
        if moved.where("on").isEmpty():
            return to


def entities(names: DataFrame) -> DataFrame:
    """(raw, entity) for distinct typed names; ``names`` has raw and n (how many rows have it)."""
    read = cut(_read(names.select("raw", "n"), cut(given_lexicon(names))))
    # Short forms: the given name that occurs with the surname, else the first one they stand for.
    full0 = read.where("given is not null").groupBy("surname", F.col("given").alias("long")).agg(F.sum("n").alias("k"))
    short = read.where("size(longs) > 0").select("raw", "surname", F.posexplode("longs").alias("at", "long"))
    pick = short.join(full0, ["surname", "long"], "left").groupBy("raw").agg(F.max(F.struct(F.coalesce("k", F.lit(0)).alias("k"), (-F.col("at")).alias("o"), "long")).alias("p"))
    read = cut(read.join(pick, "raw", "left").select("raw", "n", "kind", "surname", F.coalesce("p.long", "given").alias("given"), "initials"))

    forms = read.where("given is not null").groupBy("surname", "given").agg(F.sum("n").alias("n"), F.max(F.substring("initials", 1, 1)).alias("first"))
    forms = cut(forms)
    # One segment join for both: the block says which part is equal.
    near_ = near_pairs(
        forms.where("length(surname) >= 5").select(F.concat(F.lit("g"), "given").alias("block"), F.col("surname").alias("text")).unionByName(forms.where("length(given) >= 4").select(F.concat(F.lit("s"), "surname").alias("block"), F.col("given").alias("text")))
    )
    of, same = F.substring("block", 1, 1) == "g", F.expr("substring(block, 2)")
    part = lambda x: (F.when(of, F.col(x)).otherwise(same), F.when(of, same).otherwise(F.col(x)))
    e = near_.select(part("a")[0].alias("a_surname"), part("a")[1].alias("a_given"), part("b")[0].alias("b_surname"), part("b")[1].alias("b_given"))
    e = cut(e.unionByName(e.select(F.col("b_surname").alias("a_surname"), F.col("b_given").alias("a_given"), F.col("a_surname").alias("b_surname"), F.col("a_given").alias("b_given"))))
    to = _led(forms, e)
    full = cut(
        read.where("given is not null")
        .join(to, ["surname", "given"], "left")
        .select("raw", "n", "kind", F.coalesce("to_surname", "surname").alias("surname"), F.coalesce("to_given", "given").alias("given"), F.expr("substring(initials, 2)").alias("rest"))
    )
    # Middle initials: one, or none, makes one person of a name; several make several, and bare names of them stay apart.
    mids = full.where("length(rest) > 0").groupBy("surname", "given").agg(F.count_distinct("rest").alias("many"), F.max("rest").alias("only"))
    tree = full.join(mids, ["surname", "given"], "left").select(
        "raw", "surname", "given", F.when(F.coalesce("many", F.lit(0)) <= 1, F.coalesce("only", F.lit(""))).otherwise(F.col("rest")).alias("mid")
    )
    tree = cut(tree.withColumn("entity", F.concat_ws("|", "surname", "given", "mid")))

    # Initials only: surnames misspelt there are first led to the one surname near them.
    lone = read.where("given is null").select("raw", "n", "surname", "initials")
    known = tree.select("surname").distinct()
    strange = lone.join(known, "surname", "left_anti").where("length(surname) >= 6 and length(initials) > 0").select(F.substring("initials", 1, 1).alias("block"), F.col("surname").alias("text")).distinct()
    bearers = tree.select(F.substring("given", 1, 1).alias("block"), F.col("surname").alias("text")).where("length(text) >= 5").distinct()
    lead = near_pairs(bearers.unionByName(strange).distinct())
    lead = lead.select("block", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(lead.select("block", F.col("b").alias("x"), F.col("a").alias("y")))
    lead = lead.join(strange.select("block", F.col("text").alias("x")), ["block", "x"]).join(bearers.select("block", F.col("text").alias("y")), ["block", "y"], "left_semi")
    lead = lead.groupBy("block", "x").agg(F.count_distinct("y").alias("k"), F.max("y").alias("y")).where("k = 1").select("block", F.col("x").alias("surname"), "y")
    lone = lone.withColumn("block", F.substring("initials", 1, 1)).join(lead, ["block", "surname"], "left").select("raw", F.coalesce("y", "surname").alias("surname"), "initials")
    # Every entity's initials; hyphenated given names have two.
    heads = tree.join(read.select("raw", "initials"), "raw").where("substring(initials, 1, 1) = substring(given, 1, 1)").groupBy("entity", "surname").agg(F.max(F.struct(F.length("initials"), "initials"))["initials"].alias("of"))
    fit = lone.where("length(initials) > 0").join(heads, "surname").where("startswith(of, initials) or startswith(initials, of)")
    ranked = fit.withColumn("exact", (F.col("of") == F.col("initials")).cast("int"))
    choice = ranked.groupBy("raw").agg(F.count("*").alias("k"), F.sum("exact").alias("ke"), F.max(F.struct("exact", "entity")).alias("b"))
    sure = choice.where("k = 1 or ke = 1").select("raw", F.col("b.entity").alias("entity"))
    left = lone.join(sure, "raw", "left_anti").select("raw", "surname", "initials")
    # Without a full name: initials of one surname that extend each other are one, if only one extension exists.
    longer = left.where("length(initials) > 1").groupBy("surname", F.substring("initials", 1, 1).alias("f")).agg(F.count_distinct("initials").alias("k"), F.max("initials").alias("only"))
    taken = fit.select("raw").distinct().withColumn("several", F.lit(True))
    apart = left.withColumn("f", F.substring("initials", 1, 1)).join(longer, ["surname", "f"], "left").join(taken, "raw", "left").select(
        "raw", F.concat_ws("|", "surname", F.lit("~"), F.when((F.length("initials") == 1) & (F.col("k") == 1) & F.col("several").isNull(), F.col("only")).otherwise(F.col("initials"))).alias("entity")
    )
    return tree.select("raw", "entity").unionByName(sure).unionByName(apart)


def byline_names(rows: DataFrame, key: str, json_col: str, prefix: str) -> DataFrame:
    """(key, raw) of each name of a byline; keys are prefix/<id>/<position>."""
    names = F.from_json(F.col(json_col), "array<string>")
    return (
        rows.select(F.col(key).cast("string").alias("_id"), F.posexplode(names).alias("_at", "raw"))
        .where("raw is not null and trim(raw) <> ''")
        .select(F.concat(F.lit(prefix + "/"), "_id", F.lit("/"), F.col("_at").cast("string")).alias("key"), "raw")
        .distinct()
    )


def linked_names(authors: DataFrame, docs: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, raw, entity) of authors rows, the same of byline names)."""
    a = authors.where("author_id is not null and trim(display_name) <> ''").select(F.concat(F.lit("author/"), "author_id").alias("key"), F.col("display_name").alias("raw")).distinct()
    b = byline_names(docs, "doc_id", "authors_json", "document").unionByName(byline_names(works, "doi", "authors_json", "work"))
    b = cut(b)
    names = cut(a.unionByName(b).groupBy("raw").agg(F.count("*").alias("n")))
    ent = cut(entities(names))
    return a.join(ent, "raw"), b.join(ent, "raw")


def same_names(authors: DataFrame, docs: DataFrame, works: DataFrame) -> DataFrame:
    """(key_a, key_b): authors rows of one entity, and authors rows with byline names that equal no display name."""
    a, b = linked_names(authors, docs, works)
    a = cut(a)
    x, y = a.select(F.col("key").alias("key_a"), "entity"), a.select(F.col("key").alias("key_b"), "entity")
    own = x.join(y, "entity").where("key_a < key_b").select("key_a", "key_b")
    other = b.join(a.select("raw").distinct(), "raw", "left_anti").select(F.col("key").alias("key_b"), "entity")
    return own.unionByName(x.join(other, "entity").select("key_a", "key_b")).distinct()
