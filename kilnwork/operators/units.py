"""Measured quantities brought to one unit.

A printed unit is read by a small grammar (prefixes, powers, products and
quotients of base units) into a vector of dimensions and an exact factor, so
every spelling of a unit gives the same factor and a unit of another kind is
told by its dimensions.  Numbers are read in the conventions they are printed
in and converted exactly, as fractions.

The history of each source is then segmented: an exact penalised changepoint
search (pruned optimal partitioning) on the logarithm of its values gives its
levels, and a level that stands off the property's own by a factor of the
quantity's known units marks a change of unit.  It gives rows without unit the
unit of that level (evidence ``level``) and reverses printed units it contradicts
(``reversed``); the other rows carry the column that printed their unit.

Defined results: null or unreadable numbers and categorical rows give a null
value; a unit of another kind gives the evidence ``other kind`` and no value;
zero and negative numbers convert but have no mantissa; repeated rows count
once; unknown properties are left out.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.runtime import written

# Dimensions: metre, gram, second, ampere, kelvin, cycle, standard flow, and tags for units that stand alone.
_M, _G, _S, _A, _K, _CYC, _FLOW, _ALONE = range(8)


def _dim(**powers: int) -> tuple[int, ...]:
    names = {"m": _M, "g": _G, "s": _S, "A": _A, "K": _K, "cyc": _CYC, "flow": _FLOW, "alone": _ALONE}
    out = [0] * 8
    for k, v in powers.items():
        out[names[k]] = v
    return tuple(out)


_ENERGY = _dim(g=1, m=2, s=-2)
_PRESSURE = _dim(g=1, m=-1, s=-2)
_OHM = _dim(g=1, m=2, s=-3, A=-2)
_CHARGE = _dim(A=1, s=1)
_F = Fraction
#: Symbols (case counts, prefixes allowed): dimensions and factor to metre, gram, second, ampere, kelvin.
SYMBOLS = {
    "m": (_dim(m=1), _F(1)),
    "g": (_dim(g=1), _F(1)),
    "s": (_dim(s=1), _F(1)),
    "A": (_dim(A=1), _F(1)),
    "K": (_dim(K=1), _F(1)),
    "Å": (_dim(m=1), _F(1, 10**10)),
    "eV": (_ENERGY, _F("1.602176634e-16")),
    "J": (_ENERGY, _F(1000)),
    "Pa": (_PRESSURE, _F(1000)),
    "bar": (_PRESSURE, _F(10**8)),
    "Torr": (_PRESSURE, _F(101325 * 1000, 760)),
    "torr": (_PRESSURE, _F(101325 * 1000, 760)),
    "N": (_dim(g=1, m=1, s=-2), _F(1000)),
    "Ω": (_OHM, _F(1000)),
    "S": (tuple(-x for x in _OHM), _F(1, 1000)),
    "V": (_dim(g=1, m=2, s=-3, A=-1), _F(1000)),
    "W": (_dim(g=1, m=2, s=-3), _F(1000)),
    "C": (_CHARGE, _F(1)),
    "Ah": (_CHARGE, _F(3600)),
    "L": (_dim(m=3), _F(1, 1000)),
    "l": (_dim(m=3), _F(1, 1000)),
    "Hz": (_dim(s=-1), _F(1)),
    "mol": (_dim(alone=1), _F(1)),
    "cycles": (_dim(cyc=1), _F(1)),
    "cyc": (_dim(cyc=1), _F(1)),
}
#: Names (case does not count, no prefixes).
NAMES = {
    "h": (_dim(s=1), _F(3600)),
    "hr": (_dim(s=1), _F(3600)),
    "hrs": (_dim(s=1), _F(3600)),
    "hour": (_dim(s=1), _F(3600)),
    "min": (_dim(s=1), _F(60)),
    "minute": (_dim(s=1), _F(60)),
    "sec": (_dim(s=1), _F(1)),
    "second": (_dim(s=1), _F(1)),
    "msec": (_dim(s=1), _F(1, 1000)),
    "day": (_dim(s=1), _F(86400)),
    "d": (_dim(s=1), _F(86400)),
    "micron": (_dim(m=1), _F(1, 10**6)),
    "mil": (_dim(m=1), _F(254, 10**7)),
    "inch": (_dim(m=1), _F(254, 10**4)),
    "angstrom": (_dim(m=1), _F(1, 10**10)),
    "ångström": (_dim(m=1), _F(1, 10**10)),
    "meter": (_dim(m=1), _F(1)),
    "metre": (_dim(m=1), _F(1)),
    "cc": (_dim(m=3), _F(1, 10**6)),
    "atm": (_PRESSURE, _F(101325 * 1000)),
    "mmhg": (_PRESSURE, _F(101325 * 1000, 760)),
    "psi": (_PRESSURE, _F("6894757.293168")),
    "kgf": (_dim(g=1, m=1, s=-2), _F("9806.65")),
    "electronvolt": (_ENERGY, _F("1.602176634e-16")),
    "pascal": (_PRESSURE, _F(1000)),
    "kelvin": (_dim(K=1), _F(1)),
    "ohm": (_OHM, _F(1000)),
    "siemens": (tuple(-x for x in _OHM), _F(1, 1000)),
    "sccm": (_dim(flow=1), _F(1)),
    "slm": (_dim(flow=1), _F(1000)),
    "slpm": (_dim(flow=1), _F(1000)),
    "cycle": (_dim(cyc=1), _F(1)),
    "cy": (_dim(cyc=1), _F(1)),
    "kcycle": (_dim(cyc=1), _F(1000)),
    "%": (_dim(), _F(1, 100)),
    "pct": (_dim(), _F(1, 100)),
    "percent": (_dim(), _F(1, 100)),
    "fraction": (_dim(), _F(1)),
    "db": (_dim(alone=2), _F(1)),
    "lux": (_dim(alone=3), _F(1)),
    "rpm": (_dim(alone=4), _F(1)),
    "gram": (_dim(g=1), _F(1)),
}
#: Written-out and abbreviated prefixes.
PREFIXES = {"p": -12, "n": -9, "u": -6, "µ": -6, "m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "M": 6, "G": 9}
LONG_PREFIXES = {"pico": -12, "nano": -9, "micro": -6, "milli": -3, "centi": -2, "hecto": 2, "kilo": 3, "mega": 6, "giga": 9}
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_CELSIUS, _FAHRENHEIT = re.compile(r"(?i)(?:°\s*|deg(?:rees?)?\.?\s*)?(?:C|celsius)"), re.compile(r"(?i)(?:°\s*|deg(?:rees?)?\.?\s*)?(?:F|fahrenheit)")
_POWER = re.compile(r"(?:[×x*·]\s*)?\b10\s*\^\s*([+-]?\d+)")
_TOKEN = re.compile(r"([A-Za-zµΩÅåÅ°%ö]+)\.?(?:\^?([+-]?\d+))?")
_ALONE_WORDS = re.compile(r"(?i)\b(?:rms|abs|absolute)\b")


def tidy(text: str) -> str:
    """One writing of signs, superscripts and look-alike letters; outer brackets off."""
    text = re.sub("[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+", lambda m: "^" + m[0].translate(_SUPER), text.replace("º", "°"))
    text = unicodedata.normalize("NFKC", text).replace("μ", "µ").replace("−", "-").replace("–", "-").replace("‐", "-").replace("Ω", "Ω")
    text = text.strip()
    while len(text) > 1 and text[0] + text[-1] in ("()", "[]", "{}"):
        text = text[1:-1].strip()
    return text


def _one(name: str) -> tuple[tuple[int, ...], Fraction] | None:
    if name in SYMBOLS:
        return SYMBOLS[name]
    low = name.lower()
    for known in (low, low.rstrip("s") if len(low) > 2 else low):
        if known in NAMES:
            return NAMES[known]
    for long, power in LONG_PREFIXES.items():
        if low.startswith(long):
            rest = low[len(long) :]
            got = NAMES.get(rest) or NAMES.get(rest.rstrip("s")) or SYMBOLS.get(name[len(long) :])
            if got:
                return got[0], got[1] * Fraction(10) ** power
    if name[0] in PREFIXES and len(name) > 1:
        rest = name[1:]
        got = SYMBOLS.get(rest) or (NAMES.get(rest.lower()) if rest.lower() in ("ohm", "cycle", "cycles") else None)
        if got:
            return got[0], got[1] * Fraction(10) ** PREFIXES[name[0]]
    return None


@lru_cache(maxsize=65536)
def read_unit(text: str) -> tuple[tuple[int, ...], Fraction, Fraction] | None:
    """(dimensions, factor, zero point in kelvin) of a printed unit, or None if it cannot be read."""
    text = tidy(text)
    if not text:
        return None
    if _CELSIUS.fullmatch(text):
        return _dim(K=1), Fraction(1), Fraction("273.15")
    if _FAHRENHEIT.fullmatch(text):
        return _dim(K=1), Fraction(5, 9), Fraction("273.15") - Fraction(32 * 5, 9)
    factor = Fraction(1)
    text = re.sub(r"(?i)\bmm\s+hg\b", "mmHg", text)
    text = re.sub(r"(?i)\bper\s+cent\b", "%", text)
    text = re.sub(r"(?i)\b(?:standard|std\.?)\s+(?:L|litres?|liters?)\s*/\s*min\b", "slm", text)
    text = re.sub(r"(?i)\b(?:standard|std\.?)\s+(?:cm\^?3|cc)\s*/\s*min\b", "sccm", text)
    text = re.sub(r"(?i)\bk\s+(?=cycles?\b)", "k", text)
    text = _ALONE_WORDS.sub(" ", text)

    def power(m: re.Match) -> str:
        nonlocal factor
        factor *= Fraction(10) ** int(m[1])
        return " "

    text = _POWER.sub(power, text)
    text, n = re.subn(r"(?i)\bthousand\b", " ", text)
    factor *= 1000**n
    text = re.sub(r"(?i)\bper\b", "/", text)
    text = re.sub(r"(?<=[A-Za-zµΩÅ.])-(?=[A-Za-zµΩÅ])", " ", text)
    text = re.sub(r"[·*⋅×]", " ", text)
    dims, sign, at, seen = [0] * 8, 1, 0, False
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == "/":
            if not seen or sign < 0 and not seen:
                return None
            sign, at = -1, at + 1
            continue
        m = _TOKEN.match(text, at)
        if not m or not (got := _one(m[1])):
            return None
        p = sign * int(m[2] or 1)
        if abs(p) > 12:
            return None
        dims = [a + p * b for a, b in zip(dims, got[0])]
        factor *= got[1] ** p
        at, sign, seen = m.end(), 1, True
    return (tuple(dims), factor, Fraction(0)) if seen and sign > 0 else None


def unit_for(text: str, dims: tuple[int, ...]) -> tuple[tuple[int, ...], Fraction, Fraction] | None:
    """As ``read_unit``, an ``A`` read as ångström where the quantity is a length."""
    got = read_unit(text)
    if (got is None or got[0] != dims) and dims[_M] and not dims[_A]:
        again = read_unit(re.sub(r"(?<![A-Za-zµ])A(?![A-Za-z])", "Å", text))
        if again and again[0] == dims:
            return again
    return got


#: Spaces and apostrophes that group digits.
_GROUPING = "    ’'"
_NUMBER = re.compile(
    r"(?P<sign>[+-])?\s*(?P<int>\d{1,3}(?:[" + _GROUPING + r"]\d{3})+(?![\d^])(?:[.,]\d+)?|\d[\d.,]*|[.,]\d+)"
    r"(?:\s*[eE](?P<exp>[+-]?\d+)|\s*[×x*·⋅]\s*10\s*\^?\s*(?P<ten>[+-]?\d+))?"
)


@lru_cache(maxsize=65536)
def read_number(text: str) -> tuple[Fraction, str] | None:
    """The first number of a printed value and what follows it, its uncertainty taken off."""
    text = re.sub("[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+", lambda m: "^" + m[0].translate(_SUPER), text)
    text = unicodedata.normalize("NFC", text).replace("−", "-")
    m = _NUMBER.search(text)
    if not m:
        return None
    digits = re.sub(f"[{_GROUPING}]", "", m["int"]).rstrip(".,")
    rest = text[m.start("int") + len(m["int"].rstrip(".,")) :] if m.end() == m.end("int") else text[m.end() :]
    if "," in digits and "." in digits:
        last = max(digits.rfind(","), digits.rfind("."))
        digits = re.sub("[.,]", "", digits[:last]) + "." + digits[last + 1 :]
    elif "," in digits:
        grouped = re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+", digits)
        digits = digits.replace(",", "" if grouped else ".")
    if digits.count(".") > 1:
        digits = digits.replace(".", "")
    try:
        value = Fraction(digits)
    except ValueError:
        return None
    power = int(m["exp"] or m["ten"] or 0)
    if abs(power) > 300:
        return None
    value *= Fraction(10) ** power
    # A power of ten behind the uncertainty belongs to it only if the number has one of its own.
    ten = r"(?:\s*[×x·]\s*10\s*\^?\s*[+-]?\d+)?" if m["ten"] else ""
    rest = re.sub(r"^\s*(?:±|\+/-|\+-)\s*[\d.,]+(?:[eE][+-]?\d+)?" + ten, "", rest)
    rest = re.sub(r"^\s*\(\d+\)", "", rest)
    return (-value if m["sign"] == "-" else value), rest.strip()


@lru_cache(maxsize=65536)
def _part_of_unit(word: str) -> bool:
    """Whether a word can stand inside a printed unit: a unit, a power of ten, or one of the words that join units."""
    low = word.lower()
    if low in ("per", "cent", "standard", "std", "thousand", "/", "k", "of", "hg", "rms", "abs", "absolute") or re.fullmatch(r"[·*⋅×x/()^\d+-]+", word):
        return True
    return read_unit(word) is not None or read_unit(word.lstrip("/([").rstrip(")]")) is not None or all(_one(w) for w in re.findall(r"[A-Za-zµΩÅåÅ°%ö]+", tidy(word)) or ["?"])


def unit_in_quote(quote: str, printed: str, dims: tuple[int, ...]):
    """The unit that follows the printed value in a quote, if any."""
    at = quote.find(printed)
    if at < 0:
        return None
    behind = quote[at + len(printed) :]
    if not behind.strip():
        return None
    # As far as the words can belong to a unit: no more than the first that is none, and those that may follow it in one.
    words = re.split(r"\s+", behind.lstrip())
    end = next((k for k, w in enumerate(words) if k and w.rstrip(".,;:") and not _part_of_unit(w.rstrip(".,;:"))), len(words))
    words, other = words[: max(1, end)], None
    for n in range(len(words), 0, -1):
        text = " ".join(words[:n])
        for t in (text, text.rstrip(".,;:")):
            got = unit_for(t, dims) if t else None
            if got and got[0] == dims:
                return got
            other = other or got
    return other


def mantissa_exponent(value: float) -> tuple[int, int] | None:
    """Three significant digits: (mantissa, exponent) with 100 <= mantissa <= 999."""
    if not value > 0 or math.isinf(value):
        return None
    m, e = f"{value:.2e}".split("e")
    return int(m.replace(".", "")), int(e) - 2


# -- levels of a history -------------------------------------------------------


def changepoints(y: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments that minimise squared error plus ``penalty`` a segment, exactly (pruned)."""
    n = len(y)
    if not n:
        return []
    s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    open_ = np.array([0])
    for t in range(1, n + 1):
        size = t - open_
        cost = best[open_] + (s2[t] - s2[open_]) - (s1[t] - s1[open_]) ** 2 / size
        k = int(np.argmin(cost))
        best[t], back[t] = cost[k] + penalty, open_[k]
        open_ = np.append(open_[cost <= best[t]], t)
    starts, t = [], n
    while t:
        t = int(back[t])
        starts.append(t)
    return starts[::-1]


def unit_levels(logs: np.ndarray, level: float, factors: dict[str, float], penalty: float, within: float, least: int) -> list[tuple[str, float] | None]:
    """The known factor whose level each row's segment stands at, or None."""
    out: list[tuple[str, float] | None] = [None] * len(logs)
    for a, b, shift in segment_shifts(logs, level, penalty):
        if b - a >= least:
            name = min(factors, key=lambda u: abs(math.log10(factors[u]) - shift))
            if abs(math.log10(factors[name]) - shift) <= within:
                out[a:b] = [(name, factors[name])] * (b - a)
    return out


def segment_shifts(logs: np.ndarray, level: float, penalty: float) -> list[tuple[int, int, float]]:
    """(start, end, how far the level lies above the segment's mean) of each segment of a history."""
    cuts = [*changepoints(logs, penalty), len(logs)]
    return [(a, b, level - float(np.mean(logs[a:b]))) for a, b in zip(cuts, cuts[1:])]


_COLUMNS = ["claim_id", "property_norm", "value_type", "value_original", "unit_original", "unit", "grounding_quote", "extractor", "created_at"]


def registry_map(registry: DataFrame) -> dict[str, tuple[str, str]]:
    """Every name of a property to (property, canonical unit); the registry is a hand-kept list and comes to the driver whole."""
    out: dict[str, tuple[str, str]] = {}
    for r in registry.select("property_norm", "canonical_unit", "aliases_json").toLocalIterator():
        if r[0] and r[1]:
            for name in [r[0], *(json.loads(r[2]) if r[2] else [])]:
                out.setdefault(name.lower().replace("-", " ").strip(), (r[0], r[1]))
    return out


def printed_quantities(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Each distinct claim with its number read and, where printed, its unit and canonical value."""
    known = registry_map(registry)
    shared = points.sparkSession.sparkContext.broadcast(known)
    rows = points.select(*_COLUMNS).distinct()

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        names = shared.value
        target = {p: (read_unit(u), u) for p, u in names.values()}
        for pdf in parts:
            out = []
            for claim, prop, kind, value, u0, u1, quote, source, at in pdf.itertuples(index=False, name=None):
                entry = names.get(prop.lower().replace("-", " ").strip()) if isinstance(prop, str) else None
                if entry is None or target[entry[0]][0] is None:
                    continue
                dims, to, zero = target[entry[0]][0]
                number = read_number(value) if isinstance(value, str) and kind != "categorical" else None
                evidence = got = None
                if number:
                    for where, text in (("unit_original", u0), ("value_original", number[1]), ("unit", u1)):
                        if isinstance(text, str) and text.strip() and (got := unit_for(text, dims)):
                            evidence = where
                            break
                    if got is None and isinstance(quote, str) and (got := unit_in_quote(quote, value, dims)):
                        evidence = "grounding_quote"
                canonical = None
                if got and got[0] != dims:
                    evidence = "other kind"
                elif got:
                    canonical = float((number[0] * got[1] + got[2] - zero) / to)
                me = mantissa_exponent(canonical) if canonical is not None else None
                out.append((claim, entry[0], entry[1], kind, source, at, float(number[0]) if number else None, evidence, canonical, *(me or (None, None))))
            yield pd.DataFrame(out, columns=_OUT)

    return rows.mapInPandas(run, _SCHEMA)


_OUT = ["claim_id", "property_norm", "canonical_unit", "value_type", "source", "created_at", "number", "evidence", "value", "mantissa", "exponent"]
_SCHEMA = "claim_id string, property_norm string, canonical_unit string, value_type string, source string, created_at timestamp_ntz, number double, evidence string, value double, mantissa int, exponent int"


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with their place (``_at``, from 0) in the order of their group and the size of the group (``_n``), without one task for a group.

    Rows are range-partitioned by group and order; only the sizes of a group's parts
    are summed in a window.
    """
    parts = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(parts.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    heads = placed.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    w = W.partitionBy(*keys)
    heads = heads.withColumns({"_n": F.sum("_rows").over(w), "_before": F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows")})
    heads = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "_part"))], "_first", "_before", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate((*keys, "_part"))]
    return placed.join(heads, same).select(*rows.columns, (F.col("_before") + F.col("_seq") - F.col("_first")).alias("_at"), "_n")


def to_common_units(
    points: DataFrame, registry: DataFrame, *, penalty: float = 3.0, within: float = 0.08, least: int = 5, spread_most: float = 0.1, block: int = 4096
) -> DataFrame:
    """Every claim with its value in the property's canonical unit and the evidence for it.

    A history is all numbers of one (source, property) in the order of time, each
    converted by its printed unit where it has one.  The search segments it, and a
    segment whose level stands off the property's own by a known factor marks a
    change of unit: rows without unit get the unit of that level (evidence
    ``level``), and rows whose printed unit the level contradicts are reversed
    (``reversed``) where the segment is even, within ``spread_most`` decades, and
    holds at least ``least`` rows.  Rows the level does not contradict keep their
    printed unit.

    Histories are segmented in windows of ``block`` rows by rank, twice, the second
    time half a window on; each row takes the window in which it lies further from
    an inner border, so the borders do not show, no task holds more than a window,
    and a history is treated alike at every size.
    """
    read = written(printed_quantities(points, registry))
    usable = F.col("number").isNotNull() & (F.col("number") > 0) & (F.col("value").isNull() | (F.col("value") > 0)) & (F.coalesce("evidence", F.lit("")) != "other kind")
    told = read.where(~usable | F.col("number").isNull())
    level = read.where("value > 0").groupBy("property_norm").agg(F.percentile_approx(F.log10("value"), 0.5).alias("_level"))
    placed = ranked(read.where(usable), ["source", "property_norm"], ["created_at", "claim_id"])
    half = block // 2
    near_a, near_b = F.col("_at") % block, (F.col("_at") + half) % block
    # How far a row lies from the inner borders of its window in the first and in the shifted cut.
    far = lambda off, shift: F.least(
        F.when(F.col("_at") - off <= 0, F.lit(block)).otherwise(off), F.when(F.col("_at") - off + block >= F.col("_n"), F.lit(block)).otherwise(block - off)
    )
    first, second = F.struct(F.lit(0).alias("cut"), F.floor(F.col("_at") / block).alias("win"), (far(near_a, 0) >= far(near_b, half)).alias("mine")), F.struct(
        F.lit(1).alias("cut"), F.floor((F.col("_at") + half) / block).alias("win"), (far(near_a, 0) < far(near_b, half)).alias("mine")
    )
    windows = placed.withColumn("_w", F.explode(F.when(F.col("_n") <= block, F.array(first.withField("mine", F.lit(True)))).otherwise(F.array(first, second))))
    windows = windows.select(*_OUT, "_at", F.col("_w.cut").alias("_cut"), F.col("_w.win").alias("_win"), F.col("_w.mine").alias("_mine")).join(level, "property_norm", "left")
    factors = {}
    for prop, unit in set(registry_map(registry).values()):
        base = read_unit(unit)
        if base and base[2] == 0:
            factors[prop] = {u: float(f[1] / base[1]) for u in _COMMON if (f := unit_for(u, base[0])) and f[0] == base[0] and f[2] == 0}

    def segment(pdf):
        pdf = pdf.sort_values("_at", kind="stable").reset_index(drop=True)
        prop, lvl = pdf["property_norm"].iloc[0], pdf["_level"].iloc[0]
        known = factors.get(prop)
        if known and lvl is not None and lvl == lvl:
            number, value = pdf["number"].to_numpy(float), pdf["value"].to_numpy(float)
            printed = ~np.isnan(value)
            logs = np.log10(np.where(printed, value, number))
            evidence, mantissa, exponent = pdf["evidence"].tolist(), pdf["mantissa"].astype("Int64").tolist(), pdf["exponent"].astype("Int64").tolist()
            sizes = np.array(sorted({round(math.log10(a / b), 9) for a in known.values() for b in known.values() if a != b} or {math.inf}))
            for a, b, shift in segment_shifts(logs, float(lvl), penalty):
                if b - a < least:
                    continue
                bare = np.nonzero(~printed[a:b])[0] + a
                if len(bare):
                    name = min(known, key=lambda u: abs(math.log10(known[u]) - shift))
                    if abs(math.log10(known[name]) - shift) <= within:
                        for i in bare:
                            evidence[i], value[i] = "level", number[i] * known[name]
                            mantissa[i], exponent[i] = mantissa_exponent(value[i]) or (None, None)
                told_here = np.nonzero(printed[a:b])[0] + a
                if len(told_here) >= least and float(np.std(logs[told_here])) <= spread_most:
                    step = sizes[np.argmin(np.abs(sizes - shift))]
                    if abs(step) > 2 * within and abs(step - shift) <= within:
                        for i in told_here:
                            evidence[i], value[i] = "reversed", value[i] * 10.0**step
                            mantissa[i], exponent[i] = mantissa_exponent(value[i]) or (None, None)
            pdf = pdf.assign(evidence=evidence, value=value, mantissa=mantissa, exponent=exponent)
        return pdf.loc[pdf["_mine"], _OUT].astype({"mantissa": "Int32", "exponent": "Int32"})

    segmented = windows.groupBy("source", "property_norm", "_cut", "_win").applyInPandas(segment, _SCHEMA)
    return told.unionByName(segmented)


#: Units whose factors a level shift may match.
_COMMON = [
    "nm", "Å", "µm", "mil", "nm/cycle", "Å/cycle", "pm/cycle", "Pa", "kPa", "MPa", "GPa", "mbar", "Torr", "mTorr", "atm", "kgf/mm2",
    "µΩ cm", "mΩ cm", "Ω m", "Ω cm", "eV", "meV", "s", "ms", "min", "h", "sccm", "slm", "g/cm3", "kg/m3", "mg/cm2", "g/m2", "µg/cm2",
    "mAh/g", "Ah/kg", "C/g", "S/cm", "S/m", "mS/cm", "µS/cm", "%", "fraction", "cycles", "kcycles",
]
#: Evidence that a unit was printed, in the order it is looked for.
PRINTED = ["unit_original", "value_original", "unit", "grounding_quote"]
