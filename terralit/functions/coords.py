"""Coordinate strings to decimal degrees, as JVM expressions."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_D, _F2, _NUM = r"(\d+)", r"(-?\d+\.\d{2,})", r"(-?\d+\.\d+)"
_FRAC = r"(\d+\.?\d*)"
_NS, _EW, _SEP = r"\s*([NS])", r"\s*([EW])", r"\s*,?\s*"


def _twice(one: str) -> str:
    return one + _NS + _SEP + one + _EW


def _symbols(degree: str, minute: str, second: str | None = None, value: str = _FRAC) -> str:
    return _twice(_D + degree + (_D + minute + value + second if second else value + minute))


_LAT, _LON = r"(?:latitude|lat)[:\s]*", r"(?:longitude|long|lon)[:\s]*"
_RANGE = r"(\d+\.\d+)\s*-\s*(\d+\.\d+)\s*°?"
#: (name, pattern, kind) in the order in which the first hit wins.  Kinds: pair, reversed, degrees,
#: minutes, seconds, decimal minutes, range; sided ones have a hemisphere letter after each half.
RULES: list[tuple[str, str, str]] = [
    ("seven_prime", _symbols(r"\s+7\s+", r"\s*['′]", value=_D), "dm"),
    ("seven_b", _symbols(r"\s+7\s+", r"\s+b", value=_D), "dm"),
    ("seven_b_seconds", _symbols(r"\s+7\s+", r"\s+b\s+", r"\s*[\"″c]"), "dms"),
    ("decimal_minute", _twice(_D + r"\s*[°7o]\s*" + _D + r"\s*['′b]\s*\." + _D), "dmf"),
    ("letter_o", _symbols(r"\s*o\s*", r"\s*['′]", value=_D), "dm"),
    ("backtick", _symbols(r"\s*°\s*", r"\s*[`´]", value=_D), "dm"),
    ("u_nine", _twice(_D + r"\s*u\s*" + _D + r"\s*9\s*" + _FRAC), "dms"),
    ("u_nine_short", _symbols(r"\s*u\s*", r"\s*9", value=_D), "dm"),
    ("u_prime", _symbols(r"\s*u\s*", r"\s*['′]", value=_D), "dm"),
    ("pair", "^" + _F2 + r"\s*,\s*" + _F2 + "$", "pair"),
    ("labelled", _LAT + _NUM + r"[,\s]*" + _LON + _NUM, "pair"),
    ("labelled_reversed", _LON + _NUM + r"[,\s]*" + _LAT + _NUM, "reversed"),
    ("parentheses", r"\(\s*" + _F2 + r"\s*,\s*" + _F2 + r"\s*\)", "pair"),
    ("brackets", r"\[\s*" + _F2 + r"\s*,\s*" + _F2 + r"\s*\]", "pair"),
    ("seconds", _symbols(r"\s*°\s*", r"\s*['′]\s*", r"\s*[\"″]"), "dms"),
    ("minutes", _symbols(r"\s*°\s*", r"\s*['′]"), "dm"),
    ("degrees", _NUM + r"\s*°\s*([NS])?" + _SEP + _NUM + r"\s*°\s*([EW])?", "dd"),
    ("direction", r"(\d+\.\d+)\s+([NS])" + _SEP + r"(\d+\.\d+)\s+([EW])", "dd"),
    ("signed", r"^([+-]\d+\.\d{2,})\s*,\s*([+-]\d+\.\d{2,})$", "pair"),
    ("range", _RANGE + _NS + _SEP + _RANGE + _EW, "range"),
]


def to_decimal(degrees: Column, minutes: Column | None = None, seconds: Column | None = None, side: Column | None = None) -> Column:
    """Degrees, minutes and seconds as a number; S and W make it negative."""
    v = degrees
    if minutes is not None:
        v = v + minutes / 60
    if seconds is not None:
        v = v + seconds / 3600
    return v if side is None else F.when(F.upper(side).isin("S", "W"), -F.abs(v)).otherwise(v)


_GROUPS = {"pair": 2, "reversed": 2, "dd": 4, "range": 6, "dm": 6, "dms": 8, "dmf": 8}


def _numbers(kind: str, g: Column) -> tuple[Column, Column]:
    n = lambda i: F.get(g, F.lit(i - 1)).try_cast("double")
    s = lambda i: F.get(g, F.lit(i - 1))
    if kind == "pair":
        return n(1), n(2)
    if kind == "reversed":
        return n(2), n(1)
    if kind == "dd":
        return to_decimal(n(1), side=s(2)), to_decimal(n(3), side=s(4))
    if kind == "range":
        return to_decimal((n(1) + n(2)) / 2, side=s(3)), to_decimal((n(4) + n(5)) / 2, side=s(6))
    if kind == "dm":
        return to_decimal(n(1), n(2), side=s(3)), to_decimal(n(4), n(5), side=s(6))
    if kind == "dmf":
        part = lambda i: F.concat(F.lit("0."), s(i)).try_cast("double")
        return to_decimal(n(1), n(2) + part(3), side=s(4)), to_decimal(n(5), n(6) + part(7), side=s(8))
    return to_decimal(n(1), n(2), n(3), s(4)), to_decimal(n(5), n(6), n(7), s(8))


def parse(text: Column) -> Column:
    """struct<rule, lat, lon> by the first rule that the text meets; null where none does.

    A hit's groups are cut out once and bound by a lambda; the arithmetic is per kind of rule, not per
    rule, which keeps the generated code small."""
    clean = F.trim(F.regexp_replace(text, r"(?i)^\s*coordinates?\s*:\s*", ""))
    hit = F.lit(None).cast("struct<rule:string,kind:string,g:array<string>>")
    for name, pattern, kind in reversed(RULES):
        whole = pattern if pattern.startswith("^") else "^.*?" + pattern + ".*$"
        groups = ";".join(f"${i + 1}" for i in range(_GROUPS[kind]))
        cut = F.split(F.regexp_replace(clean, "(?is)" + whole, groups), ";", -1)
        hit = F.when(clean.rlike("(?i)" + pattern), F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"), cut.alias("g"))).otherwise(hit)

    def number(h: Column) -> Column:
        out = F.lit(None).cast("struct<rule:string,lat:double,lon:double>")
        for kind in _GROUPS:
            lat, lon = _numbers(kind, h["g"])
            out = F.when(h["kind"] == kind, F.struct(h["rule"].alias("rule"), lat.alias("lat"), lon.alias("lon"))).otherwise(out)
        return out
    return F.transform(F.array(hit), number)[0]


def valid(lat: Column, lon: Column, origin: bool = False) -> Column:
    """In range, and not exactly (0, 0) unless origin is allowed."""
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok if origin else ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def quality(text: Column, lat: Column, lon: Column) -> Column:
    """Precision score of a coordinate by its notation and digits (shortest decimal forms, so in Python)."""
    @F.pandas_udf("double")
    def digits(a: pd.Series, b: pd.Series) -> pd.Series:
        def n(v: float) -> int:
            return len(repr(float(v)).partition(".")[2])
        return pd.Series([None if x != x or y != y else (n(x) + n(y)) / 2 for x, y in zip(a, b)], dtype="float64")

    d = digits(lat, lon)
    return F.when(text.rlike('["″]'), 1.0).when(d >= 4, 0.95).when(d >= 3, 0.9).when(d >= 2, 0.8).when(d >= 1, 0.7).otherwise(0.6)


_ANY = [(n, re.compile(p.strip("^$") if n in ("pair", "signed") else p, re.I)) for n, p, _ in RULES]
_PRIME = "'\u2032"
#: Characters without which a rule finds nothing: one of each group, letters in any case.
NEEDS: dict[str, tuple[str, ...]] = {
    "seven_prime": ("7", _PRIME), "seven_b": ("7", "bB"), "seven_b_seconds": ("7", "bB", "\"\u2033cC"), "decimal_minute": ("°7oO", _PRIME + "bB", "."), "letter_o": ("oO", _PRIME),
    "backtick": ("°", "`´"), "u_nine": ("uU", "9"), "u_nine_short": ("uU", "9"), "u_prime": ("uU", _PRIME), "pair": (".", ","), "labelled": ("aA", "tT", "."), "labelled_reversed": ("aA", "tT", "."),
    "parentheses": ("(", ")", ",", "."), "brackets": ("[", "]", ",", "."), "seconds": ("°", _PRIME, "\"\u2033"), "minutes": ("°", _PRIME), "degrees": ("°", "."), "direction": (".",),
    "signed": ("+-", ".", ","), "range": ("-", ".")}
SPANS = T.ArrayType(T.StructType().add("text", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))


def longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest spans first, of equal ones the earlier, without overlaps; in order of place."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
        k = bisect.bisect_left(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            kept.insert(k, (a, b))
    return kept


def spans(text: str) -> list[tuple[int, int]]:
    """The places of the coordinate strings of a text, longest match winning."""
    there = set(text)
    patterns = [p for n, p in _ANY if all(not there.isdisjoint(one) for one in NEEDS[n])]
    return longest([(m.start(), m.start() + len(m.group().rstrip())) for p in patterns for m in p.finditer(text)])


@F.pandas_udf(SPANS)
def find(texts: pd.Series) -> pd.Series:
    """The coordinate strings of a text with their places, longest match winning."""
    return pd.Series([None if t is None else [{"text": t[a:b], "start": a, "end": b} for a, b in spans(t)] for t in texts])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
