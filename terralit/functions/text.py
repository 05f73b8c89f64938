"""Text cleaning, quality and section rules, as JVM expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .vocabulary import ABBREVIATIONS, GEO_WORDS  # noqa: F401

_SAME = {"°": "\u00ba \u02da &deg; Â° â°", "°C": "\u2103", "'": "\u2032 ` \u00b4 &prime; â€²", '"': "\u2033 &Prime; â€³", "~": "\u2248 \u223c",
         "-": "\u2013 \u2014 \u2212 \u2010 \u2011 \u2022 \u25e6 \u25aa \u25ab", "x": "\u00d7 \u2715", "*": "\u2217", "...": "\u2026",
         "fi": "\ufb01", "fl": "\ufb02", "ff": "\ufb00", "ffi": "\ufb03", "ffl": "\ufb04", "st": "\ufb05"}
#: Ordered literal rewrites.
SYMBOLS: list[tuple[str, str]] = [(old, new) for new in ("°", "°C") for old in _SAME[new].split()] + [(" 7 ", "°")] + \
    [(old, "'") for old in _SAME["'"].split()] + [(" b ", "'"), ("â", "'")] + [(old, '"') for old in _SAME['"'].split()] + [("''", '"'), (" F ", " ~ "), ("F ", "~")] + \
    [(old, "~") for old in _SAME["~"].split()] + [("Â ", " ")] + [(c, " ") for c in "\xa0\u2009\u200a\u202f\u3000"] + \
    [(old, new) for new in ("fi", "fl", "ff", "ffi", "ffl", "st", "-", "x", "*") for old in _SAME[new].split()] + \
    [(f" {c} ", f" {n} ") for c, n in ("I1", "O0", "l1")] + [("\u201e", '"'), ("\u201a", "'"), ("\u2026", "...")]
_SYM, _DIR = "([°'\"″′])", "([NSEW])"
CORRUPTIONS = [(r"(\d+)\s*o\s*(\d+)", "$1°$2"), (r"(\d+)\.(\d+)\s*[oO]\s*" + _DIR, "$1.$2°$3")] + \
    [(r"(\d+)\s+7\s+(\d+)" + tail, "$1°$2" + to) for tail, to in ((r"\s+b\s+", "'"), (r"\s+b", "'"), ("", ""))] + \
    [(_DIR + r"\s*,\s*(\d+)", "$1, $2"), (r"(\d+)\s+" + _SYM + r"\s*" + _DIR, "$1$2$3"), (_DIR + r"\s*" + _SYM + r"\s*(\d+)", "$3$2$1")] + \
    [(rf"{a}(?:{b})?\.?\s*[:=]?\s*", f"{a}{b}: ") for a, b in (("Lat", "itude"), ("Lon", "gitude"))] + [(r"F\s*(\d+)", "~$1"), (r"(\d+)\s*F\s*(\d+)", "$1~$2")]
SCIENTIFIC = [(r"10\s*\^\s*([0-9-]+)", "10^$1"), (r"10\s+([0-9-]+)", "10^$1")] + [(rf"{u}\s*{n}", u + s) for u in ("km", "m") for n, s in (("2", "²"), ("3", "³"))] + \
    [(rf"(\d+)\s*{c}\s*C\b", "$1°C") for c in "7o"]
SPACING = [(r"\s*" + _SYM + r"\s*", "$1"), (r",(\S)", ", $1"), (r"(\d+)\s+°", "$1°")]
MINUTES = [(r"(\d+)\s+\.(\d+)\s+" + _DIR, "$1'.$2$3"), (r"(\d+°\d+)\s+(\d+)\s+" + _DIR, "$1'$2\"$3")]
ARTIFACTS = [(r"(?m)^\d{1,4}\s*$", ""), (r"\s+\d{1,3}\s+(?=[A-Z])", " "), (r"(?m)(^.{1,80}$)(\n\1){2,}", "$1"), (r"\n{3,}", "\n\n")]
#: One character before the hyphen does: a whole word would be read again from each of its characters.
HYPHENS = [(r"(?U)(\w)-\s*\n\s*(\w+)", "$1$2"), ("\u00ad", ""), (_SYM[:-1] + r"\d+)-\s*\n\s*(\d+" + _SYM[1:-1] + ")", "$1'$2")]
CONFUSIONS = [(r"\bO(?=\d)", "0"), (r"(?<=\d)O\b", "0"), (r"\bl(?=\d)", "1"), (r"(?<=\d)l\b", "1"), (r"\bI(?=\d)", "1"), (r"\b([Nn])arn", "$1am"), (r"\bvv", "w")] + \
    [(rf"\b0RS{t}\b", "ORS" + t) for t in ("TOM", "")]
BLANKS = [(r"[ \t]+", " "), (r"\n\s*\n", "\n\n"), (r"(?<!\n)\n(?!\n)", " "), (r"\s+([.,;:!?])", "$1"), (r"([.,;:!?])(?=[A-Za-z])", "$1 ")]
COMMON = [(r"(\d+)\s*x\s*10\s*([−-]?\d+)", "$1×10^$2"), (r"(\d+),(\d{3})\s+m\b", "$1.$2 m"), (r"\b14\s*C\b", "¹⁴C"), (r"(\d+)\s*-\s*(\d+)\s+years\s+BP", "$1-$2 years BP")]
_PLACE = r"([0-9°'\"″′]+[NSEW])"
PRESERVE = [(_PLACE + r"\s*,?\s*" + _PLACE, "$1, $2")] + [(r"(\d+[°'\"″′]+)" + c + r"\b", "$1" + c.upper()) for c in "nsew"]


def nfkc(c: Column) -> Column:
    """Unicode normal form NFKC, by the ICU library that comes with Spark; no Python worker holds the texts."""
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, c)


def symbols(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), SYMBOLS, c)


def clean_symbols(c: Column) -> Column:
    """The symbol cleaner: literal fixes, coordinate and scientific corruptions, spacing, minutes."""
    return rewrite(symbols(nfkc(c)), CORRUPTIONS + SCIENTIFIC + SPACING + MINUTES)


def clean_all(c: Column) -> Column:
    return F.trim(rewrite(clean_symbols(c), ARTIFACTS + HYPHENS + CONFUSIONS + BLANKS + COMMON + PRESERVE))


# --- quality -----------------------------------------------------------------------------

CORRUPT = ("â€™", "â€œ", "â€", "â€¦", "Ã©", "Ã±", "ï¿½", "\\x")


def char_ratio(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", "")).cast("double"), F.length(c)), F.lit(0.0))


def word_completeness(c: Column) -> Column:
    """Share of words of three letters or more."""
    words = F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
    good = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", "")), lambda w: w.rlike(r"(?U)^\p{L}{3,}$"))
    return F.coalesce(F.try_divide(F.size(good).cast("double"), F.size(words)), F.lit(0.0))


def encoding_health(c: Column) -> Column:
    hits = reduce(lambda a, b: a + b, [(F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p) for p in CORRUPT])
    base = F.greatest(F.lit(0.0), 1 - 1000 * F.coalesce(F.try_divide(hits, F.length(c)), F.lit(0.0)))
    wide = F.coalesce(F.try_divide(F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")).cast("double"), F.length(c)), F.lit(0.0))
    return F.when(wide > 0.3, base * 0.8).otherwise(base)


def fragmentation(c: Column) -> Column:
    n = F.filter(F.transform(F.split(c, "\n"), lambda x: F.length(F.trim(x))), lambda x: x > 0)
    total = F.aggregate(n, F.lit(0), lambda s, x: s + F.when(x < 10, 1).when(x < 30, 5).otherwise(10))
    return F.coalesce(F.try_divide(total.cast("double") / 10, F.size(n)), F.lit(0.0))


def whitespace_health(c: Column) -> Column:
    one = lambda p: F.greatest(F.lit(0.0), 1 - 100 * F.coalesce(F.try_divide(F.regexp_count(c, F.lit(p)).cast("double"), F.length(c)), F.lit(0.0)))
    return (one("  +") + one(r"\n\n\n+")) / 2


def quality(c: Column) -> Column:
    """struct of the five parts and their weighted sum; texts under ten characters have zeros."""
    parts = {"char_ratio": char_ratio(c), "word_completeness": word_completeness(c), "encoding_health": encoding_health(c),
             "line_fragmentation": fragmentation(c), "whitespace_health": whitespace_health(c)}
    weights = (0.15, 0.30, 0.25, 0.15, 0.15)
    total = reduce(lambda a, b: a + b, [p * w for p, w in zip(parts.values(), weights)])
    short = F.length(F.coalesce(c, F.lit(""))) < 10
    return F.struct(*[F.when(short, 0.0).otherwise(F.round(p, 6)).alias(k) for k, p in (parts | {"overall_score": total}).items()])


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


# --- sections ----------------------------------------------------------------------------

SITE_WORDS = tuple(f"{a} {b}" for a, bs in (("experimental", ("site",)), ("observation", ("site",)), ("sampling", ("location", "area", "site")), ("area", ("description",)),
                                            ("site", ("description",)), ("field", ("area", "site")), ("study", ("location", "region", "site", "area"))) for b in bs)
RELEVANT = ("study_area", "data collection", "field methods", "methods", "abstract")


def section_class(heading: Column, text: Column) -> Column:
    """The class of a section by its heading and its first 100 characters; earlier rules win."""
    h, start = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.substring(F.trim(text), 1, 100))
    has = lambda c, *ws: reduce(lambda a, b: a | b, [c.contains(w) for w in ws])
    begins = lambda *ws: reduce(lambda a, b: a | b, [start.startswith(w) for w in ws])
    method = has(h, "sampling", "data", "experiment", "material", "method") | begins("sampling", "material", "data", "method")
    inner = lambda w: h.contains(w) | F.substring(start, 1, 50).contains(w)
    return (F.when(has(h, *SITE_WORDS) | has(F.substring(start, 1, 80), *SITE_WORDS), "study_area")
            .when(method & inner("data collection"), "data collection").when(method & inner("field method"), "field methods").when(method, "methods")
            .when(h.contains("abstract") | begins("abstract"), "abstract")
            .when(has(h, "finding", "result") | begins("result"), "results").when(h.contains("discuss") | begins("discuss"), "discussion")
            .when(has(h, "outlook", "summary", "conclusion") | begins("outlook", "conclusion"), "conclusion")
            .when(has(h, "background", "intro") | begins("background", "intro"), "introduction")
            .when(has(h, "acknowledgment", "bibliography", "reference") | begins("acknowledgment", "bibliograph", "reference"), "references").otherwise("other"))


# --- confidence --------------------------------------------------------------------------

MULTIPLIERS = [(2.5, "study area|study site|study sites|study_area|study_site"), (2.0, "data and methods|materials and methods|methods"), (1.8, "materials"), (2.0, "data collection"),
               (2.2, "field methods"), (2.3, "site description"), (1.3, "results"), (1.2, "abstract"), (1.5, "figure"), (1.4, "caption"), (1.3, "table"), (0.8, "introduction"),
               (0.7, "background|discussion"), (0.6, "conclusion|conclusions"), (0.1, "references|bibliography"), (0.2, "acknowledgments|acknowledgements")]
SECTION_KEYS = [(k, m) for m, ks in MULTIPLIERS for k in ks.split("|")]
TIERS = [(0.7, "collection site|data collection site|field site|sampling site|research site|study was conducted|area was located|sites were located|study area was|study sites were|"
               "our study area|our study site|study location|study area|study site"),
         (0.5, "survey site|measurement site|collected at|our location|our sites|our site|monitoring station|monitoring site|observation site|experimental site|research area|"
               "research station|field station|samples were collected|sample collection|sample location|sample site|sampling station|sampling location"),
         (0.3, "transect|quadrat|plot|station|site|area|region|location|conducted|performed|established|located|situated")]
CITING = "referenced|following|compared to|similar to|published|literature|prior study|earlier work|previous study|according to|described by|reported|cited|et al"
INSTITUTES = "grant|supported by|funded by|research centre|research center|institution|institute|laboratory|correspondence|address|university|department|affiliation|author"
TYPES = {"COORDINATE": 1.5, "STUDY_SITE": 1.4, "MULTIWORD_LOCATION": 1.3, "SPATIAL_RELATION": 1.2, "GPE": 1.1, "FAC": 1.1, "LOC": 1.0, "CONTEXTUAL_LOCATION": 0.9}
ROLES = {"pobj": 1.2, "dobj": 1.2, "nsubj": 1.1, "appos": 1.3}


def _lookup(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def scored(entities, role: str | None = None):
    """entities (confidence, section, context, entity_type, ...) with their confidence scored; with role, the name of a
    column of grammatical roles.  Study sites stand for grammatical patterns."""
    kind = F.col("entity_type")
    new = confidence(F.col("confidence"), F.col("section"), F.col("context"), kind, None if role is None else F.col(role), kind == "STUDY_SITE", kind == "MULTIWORD_LOCATION")
    return entities.withColumn("confidence", new)


def section_multiplier(section: Column) -> Column:
    s = F.lower(F.trim(section))
    out = F.lit(1.0)
    for k, m in reversed(SECTION_KEYS):
        out = F.when(s.contains(k) | F.lit(k).contains(s), m).otherwise(out)
    for k, m in SECTION_KEYS:
        out = F.when(s == k, m).otherwise(out)
    return out


def context_adjustment(context: Column) -> Column:
    c = F.lower(context)
    has = lambda ws: reduce(lambda a, b: a | b, [c.contains(w) for w in ws.split("|")])
    up = F.when(has(TIERS[0][1]), 0.7).when(has(TIERS[1][1]), 0.5).when(has(TIERS[2][1]), 0.3).otherwise(0.0)
    return up - F.when(has(CITING), 0.5).otherwise(0.0) - F.when(has(INSTITUTES), 0.4).otherwise(0.0)


def confidence(base: Column, section: Column, context: Column, kind: Column, role: Column | None = None, pattern: Column | None = None, known: Column | None = None) -> Column:
    """Base confidence times section, plus context, times role and type, times 1.3 where a grammatical pattern was met
    and 1.2 for a known name of several words, within 0 and 1."""
    v = (base * section_multiplier(section) + context_adjustment(context)) * (F.lit(1.0) if role is None else _lookup(role, ROLES, 1.0)) * _lookup(kind, TYPES, 1.0)
    for flag, more in ((pattern, 1.3), (known, 1.2)):
        v = v if flag is None else v * F.when(flag, more).otherwise(1.0)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


# --- sentences and relations --------------------------------------------------------------

_TAIL = r"\s+([A-Z][a-zA-Z\s]+)"
_UNITS = "(" + "|".join(("km", "kilomet(?:er|re)s", "metres", "miles", "m", "meters")) + ")"
RELATIONS = [r"(\d+\.?\d*)\s*" + _UNITS + r"\s*(north|south|east|west|[NSEW])\s*(?:of|from)" + _TAIL,
             "(?:" + "|".join(("near", "nearby", "close to", "adjacent to", "in the vicinity of")) + ")" + _TAIL,
             "(?:situated|located)" + r"\s+" + "(?:near|in|at)" + _TAIL]


TABLE_REF = r"(?i)\b((?:Supplementary\s+)?Table\.?\s+S?\s?\d+[A-Z]?)"
#: In their order: a figure, a table, a supplementary figure, an appendix.
FIGURE_REFS = (r"(?i)\bfig(?:ure)?\.?\s*\d+[a-z]?\b", r"(?i)\btable\.?\s*\d+\b", r"(?i)\bsupplementary\s+fig(?:ure)?\.?\s*\d+\b", r"(?i)\bappendix\s+[a-z]\d*\b")


def figure_ref(text: Column) -> Column:
    """The first reference of the first pattern that a text has; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in FIGURE_REFS])


_STOP = re.compile(r"[.!?]+[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])")
_ITEM = re.compile(r"\((?:\d+|[A-Za-z]+)\)$")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences.  A stop, blanks and a capital or digit end one, unless the stop belongs to an
    abbreviation or an initial, stands between a figure's or table's word and its number, or follows the
    number of a list, as in (1) or (a).  A comma never ends one."""
    out, start = [], 0
    for m in _STOP.finditer(text):
        before, following = text[start:m.start()], text[m.end():m.end() + 1]
        w = before.rsplit(None, 1)[-1].lstrip("([\"'").lower() if before.strip() else ""
        two = " ".join(before.split()[-2:]).lower()
        if text[m.start()] == "." and (w in ABBREVIATIONS or two.lstrip("(") in ABBREVIATIONS or len(w) == 1 and w.isalpha() and following.isalpha()):
            if not (two.endswith("et al") and following.isupper()):
                continue
        if w in ("figure", "table") and following.isdigit() or _ITEM.search(text[start:m.end()].rstrip().rstrip(".")) and text[m.start()] == "." and len(before.strip()) < 6:
            continue
        out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("text", T.StringType())))
def sentences(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"start": a, "end": b, "text": t[a:b].strip()} for a, b in split_sentences(t)] for t in texts])
