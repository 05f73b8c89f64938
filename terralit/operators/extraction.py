"""Entities to study sites: tables, names, geocoding, clustering, ranking."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import coords, text as tx, vocabulary as v
from .library import exact_mean, shared


# --- entities ----------------------------------------------------------------------------

def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is made once a row: filters and later columns don't repeat it, as they aren't moved below
    a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def table_rows(df: DataFrame, column: str) -> DataFrame:
    """Text tables to rows: blank lines go, cells part at tabs or two blanks, empty cells go, the first line
    is the header and short rows are padded.  Tables of fewer than two lines give no rows."""
    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\t+|\s{2,}"), lambda c: F.trim(c)), lambda c: c != ""))
    t = _once(df, "__t", cells).filter(F.size("__t") >= 2).withColumn("header", F.col("__t")[0])
    t = t.select("*", F.posexplode(F.slice("__t", F.lit(2), F.size("__t"))).alias("row_idx", "__c"))
    pad = F.concat(F.col("__c"), F.array_repeat(F.lit(""), F.greatest(F.size("header") - F.size("__c"), F.lit(0))))
    return t.withColumn("cells", F.slice(pad, F.lit(1), F.size("header"))).drop("__t", "__c")


def table_coordinates(rows: DataFrame) -> DataFrame:
    """Rows (header, cells, row_idx) with a latitude and a longitude column in range, (0, 0) included."""
    first = lambda low, *ws: F.array_position(F.transform(low, lambda h: F.exists(F.array(*map(F.lit, ws)), lambda w: h.contains(w))), True).cast("int")
    at = F.transform(F.array(F.transform("header", lambda h: F.lower(h))), lambda low: F.struct(
        first(low, "latitude", "lat", "y").alias("lat"), first(low, "longitude", "long", "lon", "x").alias("lon"), first(low, "name", "site", "location", "station", "plot", "id").alias("name")))[0]
    cell = lambda i: F.when(i > 0, F.get(F.col("cells"), i - 1))
    number = lambda i: F.regexp_replace(cell(i), "[°\\s]", "").try_cast("double")
    i = F.col("__at")
    out = _once(_once(rows, "__at", at), "__v", F.struct(number(i["lat"]).alias("lat"), number(i["lon"]).alias("lon"), cell(i["name"]).alias("name")))
    out = out.withColumns({k: F.col("__v")[k] for k in ("lat", "lon", "name")}).drop("__at", "__v")
    return out.filter(coords.valid(F.col("lat"), F.col("lon"), True)).withColumn("confidence", F.lit(0.9))


def table_entities(tables: DataFrame, column: str) -> DataFrame:
    """tables (doc_id, table_idx, ...) with text tables -> their coordinates as entities, whose context names table
    and row and lists the cells by header, 150 characters at most."""
    rows = table_coordinates(table_rows(tables, column))
    pairs = F.array_join(F.zip_with("header", "cells", lambda h, v: F.concat(h, F.lit("="), v)), ", ")
    context = F.concat(F.lit("Table "), (F.col("table_idx") + 1).cast("string"), F.lit(", Row "), (F.col("row_idx") + 1).cast("string"), F.lit(": "), F.substring(pairs, 1, 150))
    name = F.concat(F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string"))
    return rows.select("doc_id", F.col("table_idx").cast("int").alias("span_idx"), F.lit("table").alias("section"), F.lit(len(BUILT_IN)).alias("extractor"), F.col("row_idx").cast("int").alias("n"),
                       name.alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("COORDINATE").alias("entity_type"), F.col("confidence"), context.alias("context"), "lat", "lon")


CONTEXT_WINDOW = 250
Spans = list[tuple[int, int]]


class Extractor(NamedTuple):
    """What finds entities of a kind: spans tells the places of one text.  Any function will do, a tagger's too;
    it is pickled to the workers, and is called once for each text."""

    kind: str
    confidence: float
    spans: Callable[[str], Spans]


class Names:
    """The places of known names in a text, in any case, as whole words; the longest name at a place wins.

    The names are kept in a dictionary by first word, some hundred bytes each, in every worker; a gazetteer of more
    than MOST is to be joined instead (join_names)."""

    MOST = 2_000_000
    _word = re.compile(r"\w+")

    def __init__(self, names: Iterable[str]):
        self.by: dict[str, list[str]] = {}
        for n in sorted({n.strip().lower() for n in names if n and n.strip()}, key=len, reverse=True):
            if first := self._word.match(n):
                self.by.setdefault(first.group(), []).append(n)
        if sum(map(len, self.by.values())) > self.MOST:
            raise ValueError(f"more than {self.MOST} names: use join_names")

    def __call__(self, text: str) -> Spans:
        low, out, end, z, by = text.lower(), [], 0, 0, self.by
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = self._word.findall(low)
        if by.keys().isdisjoint(words):
            return out
        for w in words:
            a = low.find(w, z)
            z = a + len(w)
            if w in by and a >= end:
                for n in by[w]:
                    e = a + len(n)
                    if low.startswith(n, a) and not (e < len(low) and (low[e].isalnum() or low[e] == "_") and (n[-1].isalnum() or n[-1] == "_")):
                        out.append((a, e))
                        end = e
                        break
        return out


#: A run of capitalised words that doesn't begin with one that is only the first of its sentence.
_NAME = r"(?!(?:The|An?|In|On|At|We|Our|This|These|Those|It|Fig|Figs|Figure|Table|Tab|Eq|Appendix|Site|Sites|Samples?|Data|Study|Plots?|Area)\b)[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*"
_either = lambda words: "(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")"
_verbs = lambda words: "(?:" + "|".join(v.forms(w) for w in sorted(words, key=len, reverse=True)) + ")"
_THE = r"(?:(?:the|a|an)\s+)?"


_FOLD = {0x130: "i", 0x131: "i", 0x17f: "s", 0x212a: "k"}


def folded(text: str) -> str:
    """text in lower case, with as many characters, in which what (?i) takes for one letter is one."""
    return text.lower() if text.isascii() else text.translate(_FOLD).lower()


class Start(NamedTuple):
    """Where matches of a pattern can begin: at words that fit a pattern, in lower case unless cased; at given strings in
    lower case; or where another pattern begins.  needs: patterns of words, one of each must be in the text."""

    word: str = ""
    strings: tuple[str, ...] = ()
    other: str = ""
    cased: bool = False
    needs: tuple[str, ...] = ()


_CAPITAL, _DIGIT = Start(r"[A-Z]\w*", cased=True), Start(r"\d\w*")


class Words:
    """Words sorted into classes by patterns, the lower-cased ones unless cased.  Most words of a text are known from
    before, and cost one look into a dictionary."""

    _word, MOST = re.compile(r"\w+"), 50_000

    def __init__(self, classes: list[tuple[str, bool]]):
        self.classes = [(1 << k, re.compile(p), cased) for k, (p, cased) in enumerate(classes)]
        self.known: dict[str, int] = {}

    def _of(self, word: str) -> int:
        if not word[0].isalpha():
            word = word[0]  # no keyword begins so, and numbers are many
        if (bits := self.known.get(word)) is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            low = folded(word)
            bits = self.known[word] = sum(b for b, p, cased in self.classes if p.fullmatch(word if cased else low))
        return bits

    def __call__(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        """All classes of the text's words, and (start, end, classes) of each word that has one."""
        known, all_, out, end = self.known, 0, [], 0
        for w in self._word.findall(text):
            bits = known.get(w)
            if bits is None:
                bits = self._of(w)
            start = text.find(w, end)
            end = start + len(w)
            if bits:
                all_ |= bits
                out.append((start, end, bits))
        return all_, out


class Patterns:
    """Spans of the first group, or of all, of patterns; longest first, without overlaps.  Texts without a word of the
    stems are passed over.  A pattern with a Start is tried where that allows a match only, which finds what it finds
    everywhere."""

    def __init__(self, patterns: Iterable[str | tuple[str, Start]], stems: Iterable[str] = ()):
        given = [(p, None) if isinstance(p, str) else p for p in patterns]
        classes = list(dict.fromkeys(c for _, s in given if s for c in [*[(s.word, s.cased)] * bool(s.word), *[(n, False) for n in s.needs]]))
        bit = {c: 1 << k for k, c in enumerate(classes)}
        self.words = Words(classes) if classes else None
        #: (pattern, group, its start's class, classes that the text must have, strings, other)
        self.patterns = [(q := re.compile(p), 1 if q.groups else 0, bit[s.word, s.cased] if s and s.word else 0, sum(bit[n, False] for n in s.needs) if s else 0, s.strings if s else (),
                          re.compile(s.other) if s and s.other else None) for p, s in given]
        self.stems = frozenset(w[:4].lower() for w in stems)

    def __call__(self, text: str) -> Spans:
        if self.stems and not any(w[:4] in self.stems for w in text.lower().replace("(", " ").split()):
            return []
        there, words = self.words(text) if self.words else (0, [])
        found, low = [], None
        for p, g, start, needs, strings, other in self.patterns:
            if needs & there != needs or start & there != start:
                continue
            if start:
                places = [a for a, _, bits in words if bits & start]
            elif strings:
                low, places = folded(text) if low is None else low, []
                for s in strings:
                    i = low.find(s)
                    while i >= 0:
                        places.append(i)
                        i = low.find(s, i + 1)
                places.sort()
            elif other:
                places = [m.start() for m in other.finditer(text)]
            else:
                found += [(m.start(g), m.start(g) + len(m.group(g).rstrip())) for m in p.finditer(text)]
                continue
            end = 0
            for i in places:
                if i >= end and (m := p.match(text, i)):
                    found.append((m.start(g), m.start(g) + len(m.group(g).rstrip())))
                    end = m.end()
        return coords.longest(found) if len(found) > 1 else found


def _in(words: str) -> str:
    return rf"(?i:\b{words})\s+"


def _first(phrases: Iterable[str]) -> Start:
    return Start(_either(sorted({p.partition(" ")[0].lower() for p in phrases})))


def study_sites_of_text() -> Patterns:
    """Eight surface patterns for the grammatical ones of a parser; the place is the name that they lead to."""
    few, prep = r"(?:[\w-]+\s+){0,3}?", rf"(?i:{_either(v.SITE_PREPS)})\s+{_THE}({_NAME})"
    noun, verb = _in(_either(v.SITE_NOUNS)), _in(_verbs(v.STUDY_VERBS))
    nouns, verbs = _first(v.SITE_NOUNS), lambda words: Start(_verbs(sorted({w.partition(" ")[0] for w in words})))
    return Patterns([
        (verb + few + prep, verbs(v.STUDY_VERBS)),
        (noun + few + prep, nouns),
        (rf"\b({_NAME})\s+(?i:{_either(v.SITE_NOUNS)})\b", _CAPITAL._replace(needs=(nouns.word,))),
        (_in(_verbs(v.SET_VERBS)) + prep, verbs(v.SET_VERBS)),
        (noun + few + verb + few + prep, nouns._replace(needs=(verbs(v.STUDY_VERBS).word,))),
        (_in(_verbs(v.FOCUS_VERBS)) + rf"(?i:on)\s+{_THE}({_NAME})", verbs(v.FOCUS_VERBS)),
        (_in(_either(v.DATA_NOUNS)) + few + _in(_verbs(v.DATA_VERBS)) + few + prep, _first(v.DATA_NOUNS)._replace(needs=(verbs(v.DATA_VERBS).word,))),
        (_in(_either(v.DOMAIN_NOUNS)) + _in(_verbs(v.DOMAIN_VERBS)) + rf"{_THE}({_NAME})", _first(v.DOMAIN_NOUNS)._replace(needs=(verbs(v.DOMAIN_VERBS).word,)))],
        (*v.SITE_NOUNS, *v.STUDY_VERBS, *v.FOCUS_VERBS, *v.DATA_VERBS, "took", "undertook"))


#: The patterns over text; they may begin within a word.
TEXT_RELATIONS = [(f"(?i){re.sub(r'[(](?![?])', '(?:', p)}", s) for p, s in zip(tx.RELATIONS, (
    Start(other=r"\d+"), Start(strings=("near", "close to", "adjacent to", "in the vicinity of")), Start(strings=("situated", "located"))))]


def relations_of_text() -> Patterns:
    """The relation patterns over text and those over the vocabulary: distance and direction, nearness, containment,
    direction, placing verbs, and a name with a descriptor."""
    word = lambda words: rf"(?i:\b{_either(words)}\b)"
    return Patterns([*TEXT_RELATIONS,
                     (rf"\b\d+(?:\.\d+)?\s*{word(v.UNITS)}\s+{word(v.DIRECTIONS)}\s+{word(v.TOWARDS)}\s+{_THE}{_NAME}", _DIGIT._replace(needs=(_first(v.DIRECTIONS).word, _first(v.TOWARDS).word))),
                     (rf"{word(v.NEARNESS)}(?:\s+to)?\s+{_THE}{_NAME}", _first(v.NEARNESS)), (rf"{word(v.CONTAINMENT)}\s+{_THE}{_NAME}", _first(v.CONTAINMENT)),
                     (rf"{word(v.DIRECTIONS)}\s+of\s+{_THE}{_NAME}", _first(v.DIRECTIONS)),
                     (rf"{word(v.PLACING_VERBS)}\s+{word(v.PLACING_PREPS)}\s+{_THE}{_NAME}", _first(v.PLACING_VERBS)), (rf"\b{_NAME}\s+{word(v.DESCRIPTORS)}", _CAPITAL._replace(needs=(_first(v.DESCRIPTORS).word,)))],
                    (*v.NEARNESS, *v.CONTAINMENT, *v.DIRECTIONS, *v.PLACING_VERBS, *v.DESCRIPTORS, *v.UNITS, "in"))


def contextual_of_text() -> Patterns:
    """The first name within 50 characters after an indicator, in its sentence."""
    return Patterns([rf"(?i:\b{_either(v.INDICATORS)}\b)[^.!?]{{0,50}}?\b({_NAME})"], v.INDICATORS)


def _coordinates(text: str) -> Spans:
    return coords.spans(text) if any(c.isdigit() for c in text) else []


BUILT_IN = ("COORDINATE", "SPATIAL_RELATION", "GPE", "STUDY_SITE", "CONTEXTUAL_LOCATION", "MULTIWORD_LOCATION")


def built_in(names: Iterable[str], custom: Iterable[str] = ()) -> list[Extractor]:
    """The extractors in their order; custom adds phrases to the known names of several words.  There is no trained
    tagger and no parser: names come from the gazetteer, the phrases and capitals."""
    return [Extractor("COORDINATE", 1.0, _coordinates), Extractor("SPATIAL_RELATION", 0.85, relations_of_text()), Extractor("GPE", 0.95, Names(names)),
            Extractor("STUDY_SITE", 0.9, study_sites_of_text()), Extractor("CONTEXTUAL_LOCATION", 0.75, contextual_of_text()),
            Extractor("MULTIWORD_LOCATION", 0.85, Names((*v.MULTIWORD, *custom)))]


def context_at(text: str, start: int, sentences: Spans) -> str:
    """The sentence that holds a place in text, else CONTEXT_WINDOW characters on each side of it."""
    k = bisect.bisect_right(sentences, (start, len(text) + 1)) - 1
    if k >= 0 and sentences[k][0] <= start < sentences[k][1]:
        return text[slice(*sentences[k])].strip()
    return text[max(0, start - CONTEXT_WINDOW):start + CONTEXT_WINDOW].strip()


HITS = "array<struct<extractor:int,n:int,text:string,start:int,end:int,context:string>>"


def hits(extractors: list[Extractor]):
    """A function of a text column: what all extractors find, with contexts, in one pass of a worker."""
    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        rows: list[tuple] = []
        ends = [0]
        for t in texts.to_pylist():
            if t:
                sentences = None
                for k, e in enumerate(extractors):
                    for n, (a, b) in enumerate(e.spans(t)):
                        if sentences is None:
                            sentences = tx.split_sentences(t)
                        rows.append((k, n, t[a:b].strip(), a, b, context_at(t, a, sentences)))
            ends.append(len(rows))
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        parts = [pa.array(x, y) for x, y in zip(zip(*rows) if rows else [()] * 6, types)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["extractor", "n", "text", "start", "end", "context"]))
    return find


def entities_of(sections: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """sections (doc_id, span_idx, section, text) -> the entities of these extractors, one row each.  Null and empty
    texts have none."""
    e = sections.select("doc_id", "span_idx", "section", F.explode(hits(extractors)("text")).alias("e")).select("doc_id", "span_idx", "section", "e.*")
    kinds, sure = (F.array(*[F.lit(x[i]) for x in extractors]) for i in (0, 1))
    return e.select("doc_id", "span_idx", "section", "extractor", "n", F.col("text").alias("name"), "start", "end", kinds[F.col("extractor")].alias("entity_type"), sure[F.col("extractor")].alias("confidence"), "context")


def extract_entities(sections: DataFrame, names: list[str], custom: Iterable[str] = (), more: Iterable[Extractor] = (), kinds: Iterable[str] | None = None) -> DataFrame:
    """sections (doc_id, span_idx, section, text) -> entities of all extractors, and of more, which come after the built-in
    ones; with kinds, of those of these kinds, under their usual numbers.  Coordinates are parsed, and those out of
    range go."""
    every = [*built_in(names, custom), *more]
    e = entities_of(sections, every if kinds is None else [x if x.kind in kinds else x._replace(spans=_nothing) for x in every])
    none = F.lit(None).cast("double")
    p = F.when(F.col("entity_type") == "COORDINATE", coords.parse(F.col("name")))
    # exploded, as a filter on a projected column is moved below it and parses once for each time that it names it
    e = e.select("*", F.explode(F.array(F.struct(p.alias("p")))).alias("x")).withColumn("p", F.col("x.p")).drop("x")
    e = e.withColumn("lat", F.coalesce(F.col("p.lat"), none)).withColumn("lon", F.coalesce(F.col("p.lon"), none)).drop("p")
    return e.filter((F.col("entity_type") != "COORDINATE") | coords.valid(F.col("lat"), F.col("lon"))).withColumn("entity_idx", F.struct("extractor", "span_idx", "start", "n"))


def _nothing(text: str) -> Spans:
    return []


def join_names(sections: DataFrame, gazetteer: DataFrame, words: int = 5) -> DataFrame:
    """sections (doc_id, span_idx, text), gazetteer (name, ...) of any size -> (doc_id, span_idx, name, n): the names of
    up to `words` words in each text and how often each occurs.

    Each word is joined with the names that begin so, and the words from there are compared only where one does; only
    names found are grouped."""
    split = lambda x: F.split(F.lower(x), r"(?U)\W+")
    g = gazetteer.select("name", F.filter(split("name"), lambda w: w != "").alias("of")).filter(F.size("of").between(1, words)).distinct().select("name", "of", F.get("of", F.lit(0)).alias("first"))
    w = sections.select("doc_id", "span_idx", split("text").alias("w"))  # empty strings at its ends are in no name
    w = w.select("doc_id", "span_idx", "w", F.posexplode("w").alias("at", "first"))
    ahead = w.select("doc_id", "span_idx", "first", F.slice("w", F.col("at") + 1, F.lit(words)).alias("ahead"))
    found = ahead.join(g, (ahead["first"] == g["first"]) & (F.slice("ahead", F.lit(1), F.size("of")) == F.col("of")))
    return found.groupBy("doc_id", "span_idx", "name").agg(F.count("*").alias("n"))


# --- geocoding ---------------------------------------------------------------------------

def geocode(entities: DataFrame, gazetteer: DataFrame, bias: DataFrame | None = None, box_km: float = 500.0, name: str = "name") -> DataFrame:
    """entities (doc_id, name, entity_type, confidence, lat, lon) with coordinates from the gazetteer for
    LOC and GPE that have none, and 0.1 more confidence, 1 at most, where that succeeds.

    A name is looked up once.  With bias (doc_id, bias_lat, bias_lon), places within the box around it
    come first, then priority, then latitude and longitude."""
    g = gazetteer.select(F.lower(F.trim("name")).alias("__n"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("priority").alias("__p"))
    wanted = entities.filter(F.col("entity_type").isin("LOC", "GPE") & F.col("lat").isNull()).select("doc_id", F.lower(F.trim(name)).alias("__n")).distinct()
    wanted = wanted.join(bias, "doc_id", "left") if bias is not None else wanted.withColumn("bias_lat", F.lit(None).cast("double")).withColumn("bias_lon", F.lit(None).cast("double"))
    inside = (F.abs(F.col("__lat") - F.col("bias_lat")) <= box_km / 111) & (F.abs(F.col("__lon") - F.col("bias_lon")) <= box_km / 111)
    w = W.partitionBy("doc_id", "__n").orderBy(F.coalesce(inside, F.lit(False)).desc(), F.desc("__p"), "__lat", "__lon")
    found = wanted.join(g, "__n").withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("doc_id", "__n", "__lat", "__lon")
    e = entities.withColumn("__n", F.when(F.col("entity_type").isin("LOC", "GPE") & F.col("lat").isNull(), F.lower(F.trim(name)))).join(found, ["doc_id", "__n"], "left")
    hit = F.col("__lat").isNotNull()
    return (e.withColumn("confidence", F.when(hit, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence")))
            .withColumn("lat", F.coalesce("lat", "__lat")).withColumn("lon", F.coalesce("lon", "__lon")).drop("__n", "__lat", "__lon"))


# --- clustering --------------------------------------------------------------------------

BLOCK = 512


def _distances(lat: np.ndarray, lon: np.ndarray, to_lat: np.ndarray, to_lon: np.ndarray) -> np.ndarray:
    """Great-circle kilometres from each of some points, in radians, to each of others."""
    a = np.sin((lat[:, None] - to_lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(to_lat) * np.sin((lon[:, None] - to_lon) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def adaptive_eps(lat: np.ndarray, lon: np.ndarray, default: float = 50.0) -> float:
    """1.5 times the median distance to the third neighbour, the point itself counted, within 10 and 200 km;
    the default for fewer than three points.  Distances are taken a block of rows at a time."""
    n = len(lat)
    if n < 3:
        return default
    third = [np.partition(_distances(lat[i:i + BLOCK], lon[i:i + BLOCK], lat, lon), min(3, n - 1) - 1, 1)[:, min(3, n - 1) - 1] for i in range(0, n, BLOCK)]
    return float(np.clip(1.5 * np.median(np.concatenate(third)), 10, 200))


def component_labels(lat: np.ndarray, lon: np.ndarray, eps: float) -> np.ndarray:
    """Labels of the components of the graph of distances up to eps, numbered by first point.  Each point's distances
    to the points that have no label yet are taken once, a block at a time, so no matrix is kept."""
    label = np.full(len(lat), -1, np.int32)
    free = np.arange(len(lat))
    now = 0
    while len(free):
        label[free[0]] = now
        todo, free = free[:1], free[1:]
        while len(todo) and len(free):
            some, todo = todo[:BLOCK], todo[BLOCK:]
            near = (_distances(lat[some], lon[some], lat[free], lon[free]) <= eps).any(0)
            label[free[near]] = now
            todo, free = np.concatenate((todo, free[near])), free[~near]
        now += 1
    return label


#: Groups of up to so many points are done together, those of one size at a time.
TOGETHER = 32


def _small(lat: np.ndarray, lon: np.ndarray, eps: float | None) -> tuple[np.ndarray, np.ndarray]:
    """adaptive_eps (or eps) and component_labels of many groups of k points each, given as rows of two matrices."""
    n, k = lat.shape
    a = np.sin((lat[:, :, None] - lat[:, None]) / 2) ** 2 + np.cos(lat)[:, :, None] * np.cos(lat)[:, None] * np.sin((lon[:, :, None] - lon[:, None]) / 2) ** 2
    d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(a, 1)))
    far = np.full(n, 50.0 if eps is None else eps)
    if eps is None and k > 2:
        at = min(3, k - 1) - 1
        far = np.clip(1.5 * np.median(np.partition(d, at, 2)[:, :, at], 1), 10, 200)
    near = d <= far[:, None, None]
    root = np.broadcast_to(np.arange(k, dtype=np.int32), (n, k)).copy()
    while True:  # the least point within reach, until none changes
        least = np.where(near, root[:, None, :], k).min(2).astype(np.int32)
        np.minimum(least, root, out=least)
        least = np.take_along_axis(least, least, 1)
        if (least == root).all():
            break
        root = least
    number = np.cumsum(root == np.arange(k), 1, dtype=np.int32) - 1  # roots by first point
    return far, np.take_along_axis(number, root, 1)


def cluster_arrays(edge: np.ndarray, lat: np.ndarray, lon: np.ndarray, eps: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """eps and cluster of the points of groups that lie one after the other; edge has their ends, from 0.  lat and lon
    are in radians."""
    e, c = np.full(len(lat), 50.0 if eps is None else eps), np.zeros(len(lat), np.int32)
    size = np.diff(edge)
    for k in np.unique(size[size > 1]):
        first = edge[:-1][size == k]
        if k > TOGETHER:
            for a in first:
                z = a + k
                if eps is None:
                    e[a:z] = adaptive_eps(lat[a:z], lon[a:z])
                c[a:z] = component_labels(lat[a:z], lon[a:z], e[a])
            continue
        step = max(1, 1_000_000 // int(k * k))
        for i in range(0, len(first), step):
            at = first[i:i + step, None] + np.arange(k)
            far, c[at] = _small(lat[at], lon[at], eps)
            e[at] = far[:, None]
    return e, c


def cluster(points: DataFrame, group: str, order: str, eps: float | None = None) -> DataFrame:
    """points (group, order, lat, lon) -> group, order, eps, cluster, root: haversine density clusters in which
    every point is a core point, so the components of the graph of distances up to eps.  root is the least order of
    the cluster.

    Groups are sorted together in their partitions and many are done a call, as most are small; memory is that of one
    group's rows.  Coordinates aren't null."""
    def rows(g, o, lat, lon, edge):
        e, c = cluster_arrays(edge, lat, lon, eps)
        _, first, of, _ = _sizes(edge, c)
        return [g, o, pa.array(e), pa.array(c), o.take(pa.array(first[of]))]
    return _by_group(points, group, order, rows, "{g}, {o}, eps double, cluster int, root {k}")


def cluster_sizes(points: DataFrame, group: str, order: str, eps: float | None = None) -> DataFrame:
    """points as of cluster -> group, cluster, root, n: a row a cluster, made where the clusters are."""
    def rows(g, o, lat, lon, edge):
        c = cluster_arrays(edge, lat, lon, eps)[1]
        _, first, _, n = _sizes(edge, c)
        at = pa.array(first)
        return [g.take(at), pa.array(c[first]), o.take(at), pa.array(n)]
    return _by_group(points, group, order, rows, "{g}, cluster int, root {k}, n long")


def largest_cluster(points: DataFrame, group: str, order: str, eps: float | None = None) -> DataFrame:
    """points as of cluster -> group, order of those in the largest cluster of their group, of equal ones the earliest."""
    def rows(g, o, lat, lon, edge):
        c = cluster_arrays(edge, lat, lon, eps)[1]
        own, _, of, n = _sizes(edge, c)
        by = np.lexsort((np.arange(len(n)), -n, own))
        best = np.zeros(len(n), bool)
        best[by[np.concatenate(([True], own[by][1:] != own[by][:-1]))]] = True
        at = pa.array(np.flatnonzero(best[of]))
        return [g.take(at), o.take(at)]
    return _by_group(points, group, order, rows, "{g}, {o}")


def _sizes(edge: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of clusters c of groups with these ends, in order of group and number: its group, its first point; the cluster of each
    point; its number of points."""
    group = np.repeat(np.arange(len(edge) - 1, dtype=np.int64), np.diff(edge))
    key, first, of, n = np.unique(group << 32 | c.astype(np.int64), return_index=True, return_inverse=True, return_counts=True)
    return key >> 32, first, of, n


def _by_group(points: DataFrame, group: str, order: str, rows: Callable, schema: str) -> DataFrame:
    """rows of (group, order, lat, lon, ends of the groups), whole groups at a time, sorted by group and order."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = schema.format(g=f"`{group}` {kinds[group]}", o=f"`{order}` {kinds[order]}", k=kinds[order])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            new = _changes(g)
            if held and not g[0].equals(held[-1].column(0)[0]):
                new = np.concatenate(([0], new))
            if not len(new):
                held.append(batch)
                continue
            yield from done([*held, batch.slice(0, new[-1])])
            held = [batch.slice(new[-1])]
        if held:
            yield from done(held)

    def done(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some)
        g, o = (pa.concat_arrays(t.column(k).chunks) for k in (0, 1))
        lat, lon = (np.radians(t.column(k).to_numpy()) for k in (2, 3))
        out = rows(g, o, lat, lon, np.concatenate(([0], _changes(g), [len(g)])))
        names = [f"c{k}" for k in range(len(out))]
        yield from pa.table(out, names).rename_columns(columns).to_batches()

    columns = [x.split(" ")[0].strip("`") for x in schema.split(", ")]
    d = points.select(group, order, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).repartition(group).sortWithinPartitions(group, order)
    return d.mapInArrow(of, schema)


def _changes(values: pa.Array) -> np.ndarray:
    """The places at which sorted values change."""
    if len(values) < 2:
        return np.empty(0, np.int64)
    a, b = values[1:], values[:-1]
    return np.flatnonzero(pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)) + 1


def keep_largest(entities: DataFrame, group: str, order: str) -> DataFrame:
    """Coordinates and unlocated entities stay; of the other located ones only the largest cluster, of equal
    ones that of the earliest entity.  Groups with one such entity or none aren't clustered."""
    located = entities.filter((F.col("entity_type") != "COORDINATE") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    kept = largest_cluster(located, group, order).withColumn("__k", F.lit(True))
    out = entities.join(kept, [group, order], "left")
    return out.filter(F.col("__k") | (F.col("entity_type") == "COORDINATE") | F.col("lat").isNull() | F.col("lon").isNull()).drop("__k")


def cluster_info(entities: DataFrame, group: str, order: str) -> DataFrame:
    """group, info map: size of each cluster, largest size, number of clusters, coordinates kept."""
    located = entities.filter((F.col("entity_type") != "COORDINATE") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    sizes = cluster_sizes(located, group, order).withColumn("n", F.col("n").cast("int"))
    m = sizes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("k"), F.col("n").alias("v")))).alias("e"),
                                 F.max("n").alias("most"), F.count("*").cast("int").alias("total"), F.sum("n").alias("points")).filter("points > 1")
    own = entities.groupBy(group).agg(F.count_if(F.col("entity_type") == "COORDINATE").cast("int").alias("coordinates"))
    more = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (("largest_cluster_size", "most"), ("total_clusters", "total"), ("coordinates_always_included", "coordinates"))])
    return m.join(own, group).select(group, F.map_from_entries(F.concat("e", more)).alias("info"))


# --- ranking and adapters ----------------------------------------------------------------

def dedup(entities: DataFrame, group: str, order: str) -> DataFrame:
    """The first entity of each (lower name, section, type) in a group."""
    w = W.partitionBy(group, F.lower("name"), "section", "entity_type").orderBy(order)
    return entities.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def confident(entities: DataFrame, least: float = 0.5) -> DataFrame:
    return entities.filter((F.col("entity_type") == "COORDINATE") | (F.col("confidence") >= least))


def type_priority() -> Column:
    return F.when(F.col("entity_type") == "COORDINATE", 3).when(F.col("entity_type") == "STUDY_SITE", 2).otherwise(1)


def rank(entities: DataFrame, group: str, order: str) -> DataFrame:
    """rank from 1 by type, confidence and having coordinates; ties in their order."""
    w = W.partitionBy(group).orderBy(type_priority().desc(), F.desc("confidence"), F.col("lat").isNotNull().desc(), order)
    return entities.withColumn("rank", F.row_number().over(w))


def method_of() -> Column:
    return (F.when(F.col("entity_type") == "COORDINATE", F.when(F.col("context").contains("Table"), "table_parsing").otherwise("regex"))
            .when(F.col("entity_type").isin("LOC", "GPE", "CONTEXTUAL", "CONTEXTUAL_LOCATION"), "geocoded").otherwise("ner"))


def source_of() -> Column:
    return F.when(F.col("context").contains("Table"), "table").when(F.upper("section").isin("CAPTION", "FIGURE"), "caption").otherwise("text")


def section_of() -> Column:
    """The eight sections that results can have, else other."""
    s = F.lower("section")
    return F.when(s.isin("title", "abstract", "introduction", "methods", "results", "discussion", "conclusion", "references"), s).otherwise("other")


def site_name() -> Column:
    m = F.regexp_extract("context", r"(?i)(?:station|location|site)\s+([A-Z]\w*(?:\s+[A-Z]\w*)*)", 1)
    return F.when(F.col("entity_type") == "COORDINATE", F.when(m != "", m).otherwise(F.concat(F.lit("Site at "), F.col("name")))).otherwise(F.substring("name", 1, 100))


def validation_score(confidence: Column, info: Column) -> Column:
    """The confidence, 0.1 higher up to 1 if any count of the clusters is over 1, to 3 digits."""
    more = F.coalesce(F.array_max(F.map_values(info)) > 1, F.lit(False))
    return F.round(F.when(more, F.least(confidence + 0.1, F.lit(1.0))).otherwise(confidence), 3)


def study_sites(entities: DataFrame, group: str, order: str, top: int = 10, least: float = 0.5, info: DataFrame | None = None) -> DataFrame:
    """Located entities as sites: coordinates first, then by rank; the first `top` are saved.  With info (group, info),
    as of cluster_info, also their validation."""
    e = confident(entities.filter("lat is not null and lon is not null"), least)
    w = W.partitionBy(group).orderBy((F.col("entity_type") == "COORDINATE").desc(), "rank")
    e = e.withColumn("site_rank", F.row_number().over(w))
    more = [] if info is None else [validation_score(F.col("confidence"), F.col("info")).alias("validation")]
    e = e if info is None else e.join(info, group, "left")
    return e.select(group, site_name().alias("site_name"), "lat", "lon", F.substring("context", 1, 500).alias("context"), "confidence", method_of().alias("method"),
                    source_of().alias("source"), section_of().alias("section"), F.col("site_rank"), (F.col("site_rank") <= top).alias("is_saved"), *more)


def title_bias(titles: DataFrame, gazetteer: DataFrame, names: list[str]) -> DataFrame:
    """titles (doc_id, title) -> (doc_id, bias_lat, bias_lon): where the first place named in the title lies."""
    e = entities_of(titles.select("doc_id", F.lit(0).alias("span_idx"), F.lit("title").alias("section"), F.col("title").alias("text")), [Extractor("GPE", 0.95, Names(names))])
    first = e.groupBy("doc_id").agg(F.min_by("name", "start").alias("name")).withColumn("entity_type", F.lit("GPE")).withColumn("confidence", F.lit(0.95))
    located = geocode(first.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")), gazetteer)
    return located.filter("lat is not null").select("doc_id", F.col("lat").alias("bias_lat"), F.col("lon").alias("bias_lon"))


def text_quality(sections: DataFrame) -> DataFrame:
    """sections (doc_id, span_idx, section, text) -> (doc_id, sections, quality): how many of the relevant sections have
    text, and the mean of the quality of each section name's last one."""
    q = sections.select("doc_id", "span_idx", "section", tx.quality(F.col("text"))["overall_score"].alias("o"))
    last = q.groupBy("doc_id", "section").agg(F.max_by("o", "span_idx").alias("o"), F.count("*").alias("n"))
    return last.groupBy("doc_id").agg(F.sum("n").alias("sections"), exact_mean("o", 5).alias("quality"))


def extract_pipeline(sections: DataFrame, gazetteer: DataFrame, names: list[str], tables: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """The flagship: sections (doc_id, span_idx, heading, text), tables (doc_id, table_idx, tbl) and titles (doc_id,
    title) -> ranked study sites of all documents, in one plan partitioned by document.

    Relevant sections with text are kept, symbols of texts with digits cleaned, entities found in one pass, table
    coordinates added, places geocoded with the title's place as bias, the largest cluster kept, entities
    de-duplicated, sifted by confidence and ranked; sites have method, source, name and validation."""
    s = sections.withColumn("section", tx.section_class(F.col("heading"), F.col("text"))).filter(F.col("section").isin(*tx.RELEVANT) & (F.trim("text") != ""))
    s = s.withColumn("text", F.when(F.col("text").rlike("[0-9]"), tx.clean_symbols(F.col("text"))).otherwise(F.col("text")))
    shared(sections.sparkSession)
    e = extract_entities(s, names)
    if tables is not None:
        e = e.unionByName(table_entities(tables, "tbl").withColumn("entity_idx", F.struct("extractor", "span_idx", "start", "n")))
    e = e.checkpoint()  # read several times below: as entities, as names, as points
    e = geocode(e, gazetteer, None if titles is None else title_bias(titles, gazetteer, names))
    e = e.withColumn("order_id", F.row_number().over(W.partitionBy("doc_id").orderBy("entity_idx"))).drop("entity_idx").checkpoint()
    info = cluster_info(e, "doc_id", "order_id")
    e = rank(confident(dedup(keep_largest(e, "doc_id", "order_id"), "doc_id", "order_id")), "doc_id", "order_id")
    return study_sites(e, "doc_id", "order_id", info=info)


def deduplicated_locations(sites: DataFrame) -> DataFrame:
    """One location per exact (latitude, longitude), with a key that is the same in every run."""
    lat, lon = (F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c in ("latitude", "longitude"))
    return sites.select(lat.alias("latitude"), lon.alias("longitude")).distinct().withColumn("location_id", F.sha2(F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string")), 256))
