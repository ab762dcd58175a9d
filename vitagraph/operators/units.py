"""Quantities recorded in different units, brought to one unit.

Stated values are read from text and attribute cells with their units. The history
of a source and measure (here: of a case) is the sequence of its stated values in
the common unit followed by the values recorded without a unit. It is segmented by
an exact penalised changepoint search (pruned optimal partitioning) on the log
values; a segment whose level lies a known unit's factor away from the stated
level is read in that unit and reversed. A value counts only if, so read, it is
one that the source states (exact check).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.sources.tables import checkpointed

# ---- fixed values: unit spellings (lower case, without blanks) --------------
_MASS_VOLUME = {
    "mg/dl": "mg/dl mg% mg/100ml mgdl-1 mg·dl-1 mg.dl-1 milligramsperdeciliter milligramsperdecilitre milligramsper100ml",
    "g/l": "g/l gramsperlitre gramsperliter gl-1 g·l-1",
    "g/dl": "g/dl gm/dl gms/dl g% gm% g/100ml gramsperdecilitre gramsperdeciliter gdl-1 g·dl-1",
    "mmol/l": "mmol/l mm mmol·l-1 mmoll-1 mmol.l-1 millimolesperliter millimolesperlitre millimol/l",
    "umol/l": "umol/l mcmol/l micromol/l umoll-1 umol·l-1 um micromolesperliter micromolesperlitre",
    "ng/ml": "ng/ml ngperml nanogramspermillilitre nanogramspermilliliter ngml-1 ng·ml-1 ug/l mcg/l microgramsperlitre microgramsperliter ugl-1",
    "ug/dl": "ug/dl mcg/dl microgramsperdecilitre microgramsperdeciliter",
}
_SPELLINGS = {
    "°c": "°c degc degreescelsius degreecelsius celsius c gradcelsius gradoscelsius grauscelsius degréscelsius",
    "°f": "°f degf degreesfahrenheit degreefahrenheit fahrenheit f",
    "kg": "kg kgs kilograms kilogram kilogrammes kilos kilo 公斤 千克 キロ",
    "g": "g gm grams gram grammes 克 グラム",
    "lb": "lb lbs pounds pound",
    "mm": "mm millimeters millimetres millimeter millimetre 毫米 ミリ",
    "cm": "cm centimeters centimetres centimeter centimetre 厘米 センチ",
    "inch": "in inch inches",
    "mmhg": "mmhg millimetresofmercury millimetersofmercury torr",
    "kpa": "kpa kilopascal kilopascals",
    "ml": "ml cc cm3 millilitres milliliters millilitre milliliter 毫升",
    "l": "l litres liters litre liter 升 リットル",
    "dl": "dl decilitres deciliters",
    **_MASS_VOLUME,
}
#: Known factors to the common unit; a pair is factor and offset, "molar" takes
#: the measure's molar mass (g/mol) times the number.
_TO_COMMON = {
    "°C": {"°c": 1.0, "°f": (5 / 9, -160 / 9)},
    "kg": {"kg": 1.0, "g": 0.001, "lb": 0.45359237},
    "mm": {"mm": 1.0, "cm": 10.0, "inch": 25.4},
    "mmHg": {"mmhg": 1.0, "kpa": 7.500617},
    "mL": {"ml": 1.0, "l": 1000.0, "dl": 100.0},
    "mg/dL": {"mg/dl": 1.0, "g/l": 100.0, "g/dl": 1000.0, "mmol/l": ("molar", 0.1), "umol/l": ("molar", 0.0001)},
    "g/dL": {"g/dl": 1.0, "g/l": 0.1, "mg/dl": 0.001},
    "ng/mL": {"ng/ml": 1.0, "ug/dl": 10.0},
}
#: Words between a name and a number that make it no measured value.
_NOT_VALUE = (
    r"\b(?:below|above|beneath|behind|beyond|from|proximal|distal|limit|limits|normal|norm|range|reference|ref|target|"
    r"threshold|goal|dose|doses|upper|lower|maximum|minimum|less|more|under|over|if|should|until|desde|hasta|normale?s?|"
    r"referencia|referência|référence|Referenz|límite|limite|Grenzwert|lay|lies|away|apart|distance)\b|[<>≤≥]|正常|参考|基準|上限|下限"
)
#: Words of the languages that write a decimal comma, and of English.
_COMMA_WORDS = (
    "de del el la los las al una un con se por y en que ingreso da do dos das os ao na no à à's entrada uma com foi em dia "
    "der die das und bei mit am betrug wurde aufnahme im den von zu ein eine le les du des au une est l'entrée jour dans par día"
)
_POINT_WORDS = "the of was and on in at with a an to were is for by from not had patient she he no showed"
# ---------------------------------------------------------------------------

_THIN = "    "
_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
_NUMBER = rf"(?:\d{{1,3}}(?:[{_THIN}]\d{{3}})+(?:[.,]\d+)?(?![\d])|\d+(?:[.,]\d+)*)"
_SPELLED = rf"(?:{_NUMBER}|\b(?:{'|'.join(_WORDS)})\b)"
_NOT_SPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")

_WORD_SIGN = re.compile(r"(?![฀-๿぀-ヿ㐀-鿿])\w")
_NAME_END = re.compile(r"(?:e?s)?(?!(?![฀-๿぀-ヿ㐀-鿿])\w)")


def plain_unit(unit: str) -> str:
    """A unit's spelling without blanks, in lower case, one sign for micro and degree."""
    unit = re.sub(r"[\s    ]+", "", unit.lower())
    for sign in "µμ𝜇":
        unit = unit.replace(sign, "u")
    return unit.replace("º", "°").replace("℃", "°c").replace("℉", "°f").replace("³", "3").replace("−", "-").replace("⁻¹", "-1")


def read_number(text: str, comma: bool) -> float:
    """A number in the notation of its language (``comma``: a decimal comma)."""
    if text.lower() in _WORDS:
        return float(_WORDS.index(text.lower()) + 1)
    text = re.sub(rf"[{_THIN}]", "", text)
    last = max(text.rfind(","), text.rfind("."))
    if "," in text and "." in text:
        whole, part = text[:last], text[last + 1 :]
        return float(re.sub(r"[.,]", "", whole) + "." + part)
    if last < 0:
        return float(text)
    mark = text[last]
    grouped = re.fullmatch(rf"[1-9]\d{{0,2}}(?:\{mark}\d{{3}})+", text)
    if text.count(mark) > 1 or (grouped and (mark == ",") != comma):
        return float(text.replace(mark, ""))
    return float(text.replace(mark, "."))


def ambiguous(text: str) -> bool:
    """Whether a number is read differently with and without a decimal comma."""
    return read_number(text, True) != read_number(text, False)


@dataclass
class Measure:
    """One measure: its names, and its units' way to the common unit."""

    name: str
    names: list[str]
    common: str
    molar: float | None
    units: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        for unit, way in _TO_COMMON.get(self.common, {}).items():
            if isinstance(way, tuple) and way[0] == "molar":
                if not self.molar:
                    continue
                way = self.molar * way[1]
            a, b = way if isinstance(way, tuple) else (way, 0.0)
            for spelling in _SPELLINGS[unit].split():
                self.units[spelling] = (a, b)

    def convert(self, value: float, unit: str) -> float | None:
        way = self.units.get(plain_unit(unit))
        return None if way is None else value * way[0] + way[1]

    def ways(self) -> list[tuple[float, float]]:
        return sorted(set(self.units.values()))


def tenths(value: float) -> int:
    """Ten times the value, to the nearest integer, halves up (with room for the
    binary error of a product)."""
    return math.floor(value * 10 + 0.5 + 1e-9)


def _unit_pattern(units: dict) -> str:
    """Matches any spelling with blanks between its parts."""
    def loose(u: str) -> str:
        u = re.escape(u).replace("°", "[°º]")
        u = re.sub(r"(?<![a-z\\])u(?=mol|g/|m\b|gl)", "[uµμ𝜇]", u)
        for word in ("per", "of"):
            u = re.sub(rf"(?<=[a-z]){word}(?=[a-z])", rf"\\s+{word}\\s+", u)
        u = u.replace("degrees", r"degrees\s+").replace("degree(?!s)", r"degree\s+").replace("grados", r"grados\s+").replace("graus", r"graus\s+")
        u = re.sub(r"^deg(?=[cf]$)", r"deg\\s+", u)
        u = u.replace("100ml", r"100\s*ml").replace("mmhg", r"mm\s*hg")
        u = re.sub(r"(mg|g|mmol|umol|\[uµμ𝜇\]mol|ng)(?=d?l\\-1)", r"\1\\s+", u)
        return u
    words = sorted(units, key=len, reverse=True)
    extra = ["℃", "℉", r"cm³"] if "°c" in units or "cm3" in units else []
    alternatives = [loose(w) for w in words]
    return "(?:" + "|".join([*extra, *alternatives]) + r")(?!(?!x\s*\d)[a-zà-ÿ])"


class TextMeasures:
    """Reads the stated values of all measures from texts."""

    def __init__(self, rows: list[tuple]):
        self.measures = [Measure(m, [n for n in names.split("|") if n], common, molar) for m, names, common, molar in rows]
        self.by_name: dict[str, list[Measure]] = {}
        for m in self.measures:
            for n in m.names:
                self.by_name.setdefault(_plain_name(n), []).append(m)
        import ahocorasick

        # longest names win; blanks inside a name are matched as one blank
        self.names = ahocorasick.Automaton()
        for n in {n.lower() for m in self.measures for n in m.names}:
            self.names.add_word(n, n)
        if len(self.names):
            self.names.make_automaton()
        self.forward, self.backward = {}, {}
        for m in self.measures:
            unit = _unit_pattern(m.units)
            number = _SPELLED if m.common == "mm" else _NUMBER
            part = rf"{number}(?:\s*-?\s*{unit})?"
            if m.common == "mm":
                times = r"\s*(?:[x×*]|\bby\b|\bpor\b|\bpar\b|\bmal\b)\s*"
                value = rf"(?P<v>(?:{part}{times}){{0,3}}{number}\s*-?\s*{unit})"
            elif m.common == "mmHg":
                value = rf"(?P<v>{_NUMBER}\s*/\s*{_NUMBER}\s*-?\s*{unit})"
            else:
                value = rf"(?P<v>{_NUMBER}\s*-?\s*{unit})"
            self.forward[m.name] = re.compile(rf"(?P<gap>[^\d.!?。！？；;\n\r]*?){value}", re.I)
            self.backward[m.name] = re.compile(rf"(?<![\w.,]){value}[\s-]*(?:(?:of|de|的|の)\s*)?(?:\w+\s+)?\Z", re.I)
            m.part = re.compile(rf"({number})(?:\s*-?\s*({unit}))?", re.I)
        self.not_value = re.compile(_NOT_VALUE, re.I)
        self.comma = frozenset(_COMMA_WORDS.split())
        self.point = frozenset(_POINT_WORDS.split())

    def decimal_comma(self, text: str, at: int) -> bool:
        """Whether the language around ``at`` writes a decimal comma."""
        start = max(text.rfind("\n", 0, at), 0)
        stop = text.find("\n", at)
        for part in (text[max(start, at - 80) : at + 80 if stop < 0 else min(stop, at + 80)], text):
            if _NOT_SPACED.search(part[:200]):
                return False
            words = re.findall(r"[^\W\d_]+", part.lower())
            score = sum(w in self.comma for w in words) - sum(w in self.point for w in words)
            if score:
                return score > 0
        return False

    def values_of(self, m: Measure, stated: str, comma: bool) -> list[tuple[str, float]]:
        """(number as written, value in the common unit) of a stated value; parts
        without a unit take the unit that follows them."""
        parts = [(n, u) for n, u in m.part.findall(stated)]
        unit, found = "", []
        for number, own in reversed(parts):
            unit = own or unit
            value = m.convert(read_number(number, comma), unit) if unit else None
            if value is None:
                return []
            found.append((number, value))
        return found[::-1]

    def _named(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of the names in a text, as whole words where the
        script has words; a plural ending is allowed."""
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int, str]] = []
        for last, name in self.names.iter(lower):
            start, end = last + 1 - len(name), last + 1
            if not _NOT_SPACED.match(name):
                if start and _WORD_SIGN.match(lower, start - 1):
                    continue
                tail = _NAME_END.match(lower, end)
                if tail is None:
                    continue
                end = tail.end()
            while found and found[-1][0] >= start:
                found.pop()
            if not found or found[-1][1] <= start:
                found.append((start, end, name))
        return found

    def read(self, text: str) -> list[tuple[str, str, float, int]]:
        """(measure, number as written, value in the common unit, place of the
        statement) of a text."""
        found, names = [], self._named(text)
        for k, (start, end, name) in enumerate(names):
            measures = self.by_name[_plain_name(name)]
            m = measures[0]
            # a value stands in the line of its name, between it and the adjacent names
            since = max(text.rfind("\n", 0, start) + 1, names[k - 1][1] if k else 0)
            got = self.backward[m.name].search(text, since, start) if m.common in ("mm", "mL") else None
            if got is None:
                until = names[k + 1][0] + 1 if k + 1 < len(names) else len(text)
                got = self.forward[m.name].match(text, end, until)
                if got is not None and self.not_value.search(got.group("gap")):
                    got = None
            if got is None:
                continue
            stated = got.group("v")
            comma = any(ambiguous(n) for n, _ in m.part.findall(stated)) and self.decimal_comma(text, got.start("v"))
            values = self.values_of(m, stated, comma)
            if len(measures) > 1:
                if len(values) == len(measures):
                    found += [(x.name, n, v, k) for x, (n, v) in zip(measures, values)]
            else:
                found += [(m.name, n, v, k) for n, v in values]
        return found

    def node(self, label: str | None, node_id: str | None, value: str, unit: str) -> list[tuple]:
        """(measure, number as written, value, unit, whether the value is sure) of a
        node's attributes; the unit may stand in the value, on its own or in the
        label. A number of doubtful notation is read as one with thousands' marks
        until the case's text decides; without a unit there is no value yet."""
        if label is not None:
            plain = _plain_name(re.sub(r"\(.*\)\s*\Z", "", label))
            added = re.search(r"\((.*)\)\s*\Z", label)
            tail = added.group(1) if added else ""
            measures = self.by_name.get(plain)
            if measures is None:
                plain, tail = _plain_name(label), ""
                measures, tail = self._prefixed(plain)
        else:
            measures, tail = self._prefixed(_plain_name((node_id or "").split(":", 1)[-1].replace("_", " ")))
        if not measures:
            return []
        m = measures[0]
        parts = m.part.findall(value)
        if not parts or (len(measures) > 1 and len(parts) != len(measures)):
            return []
        own = next((u for _, u in reversed(parts) if u), "")
        if not own:
            own = next((u for u in (unit, tail) if u and plain_unit(u) in m.units), "")
            if not own and tail:
                bare = {re.sub(r"[^\w]", "", u): u for u in m.units}
                own = bare.get(re.sub(r"[^\w]", "", plain_unit(tail)), "")
        found = []
        for x, (number, u) in zip(measures if len(measures) > 1 else [m] * len(parts), parts):
            u = u or own
            doubtful = ambiguous(number)
            guess = max(read_number(number, False), read_number(number, True))
            found.append((x.name, number, m.convert(guess, u) if u else None, plain_unit(u), bool(u) and not doubtful))
        return found

    def _prefixed(self, plain: str) -> tuple[list[Measure] | None, str]:
        if plain in self.by_name:
            return self.by_name[plain], ""
        for n in sorted(self.by_name, key=len, reverse=True):
            if plain.startswith(n) and self._is_unit(self.by_name[n][0], plain[len(n) :]):
                return self.by_name[n], plain[len(n) :]
        return None, ""

    @staticmethod
    def _is_unit(m: Measure, tail: str) -> bool:
        tail = re.sub(r"[^\w]", "", plain_unit(tail))
        return any(re.sub(r"[^\w]", "", u) == tail for u in m.units)


def _plain_name(name: str) -> str:
    return re.sub(r"[\s_    ]+", "", name.lower())


@lru_cache(maxsize=4)
def reader(rows: tuple) -> TextMeasures:
    return TextMeasures(list(rows))


def changepoints(values: list[float], penalty: float) -> list[int]:
    """Starts of the segments of the exact least-cost partition of ``values``:
    squared deviation from each segment's mean plus ``penalty`` for each further
    segment (optimal partitioning with pruning)."""
    n = len(values)
    one, two = [0.0], [0.0]
    for v in values:
        one.append(one[-1] + v)
        two.append(two[-1] + v * v)

    def cost(a: int, b: int) -> float:
        s = one[b] - one[a]
        return max(0.0, two[b] - two[a] - s * s / (b - a))

    best, back, open_ = [-penalty], [0], [0]
    for t in range(1, n + 1):
        options = [(best[s] + cost(s, t) + penalty, s) for s in open_]
        least, at = min(options)
        best.append(least)
        back.append(at)
        open_ = [s for (c, s) in options if c - penalty <= least] + [t]
    starts, t = [], n
    while t:
        starts.append(back[t])
        t = back[t]
    return starts[::-1]


#: Penalty of a further segment, and how far (in logs) a level may lie from a factor's.
PENALTY, NEAR = 0.05, 0.35
#: How far (in logs) rounding in another unit may move a value.
ROUNDED = 0.06


def resolve_history(
    stated: list[list[float]],
    recorded: list[tuple[list[str], list[tuple[float, float]]]],
    numbers: dict[str, set[float]],
) -> list[list[float] | None]:
    """Values in the common unit of each recorded event, or None.

    stated: the source's statements in their order, each with its values in the common
    unit. recorded: its events in their order, each with its numbers as written and the
    ways of the units that they may be in, all in one. The history is the log level of
    every statement and event. A segment that holds statements is in the common unit;
    of another, the level's shift from those tells by which known factor it is to be
    reversed. numbers: the stated values by the number they are written with, for the
    exact check that follows: a reversed value counts if the source states it so, or
    within rounding.
    """
    log = lambda x: math.log(max(x, 1e-9))
    history, read = [log(max(v)) for v in stated], []
    for i, (written, ways) in enumerate(recorded):
        for comma in (False, True) if any(map(ambiguous, written)) else (False,):
            values = [read_number(n, comma) for n in written]
            a, b = ways[0] if len(ways) == 1 else (1.0, 0.0)
            history.append(log(a * max(values) + b))
            read.append((i, values))
    starts = changepoints(history, PENALTY)
    level, sure = [0.0] * len(history), [False] * len(history)
    for a, b in zip(starts, [*starts[1:], len(history)]):
        level[a:b] = [sum(history[a:b]) / (b - a)] * (b - a)
        sure[a:b] = [a < len(stated)] * (b - a)
    known = {x for x, s in zip(level, sure) if s}

    def off(way: tuple[float, float], at: float) -> float:
        shifted = way[0] * math.exp(at) + way[1]
        return min((abs(log(shifted) - x) for x in known), default=math.inf) if shifted > 0 else math.inf

    def stands(value: float, number: str, exact: bool) -> bool:
        if exact:
            return any(abs(value - s) <= 1e-6 * max(1.0, abs(s)) for s in numbers.get(number, ()))
        return any(abs(log(value) - log(s)) <= ROUNDED for v in stated for s in v)

    found: list[list[float] | None] = [None] * len(recorded)
    for exact in (True, False):
        for k, (i, values) in enumerate(read, len(stated)):
            written, ways = recorded[i]
            if found[i] is not None:
                continue
            if len(ways) == 1 or sure[k]:
                options = [ways[0] if len(ways) == 1 else (1.0, 0.0)]
            else:
                options = [w for d, w in sorted((off(w, level[k]), w) for w in ways) if d < NEAR]
            for a, b in options:
                reversed_ = [a * x + b for x in values]
                if all(stands(v, n, exact) for v, n in zip(reversed_, written)):
                    found[i] = reversed_
                    break
    return found


def _catalogue(measures: DataFrame) -> tuple:
    """The measures as plain rows; a parameter table of at most 1,000 rows."""
    rows = measures.select("measure", "spoken_names", "common_unit", "molar_mass").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 measures")
    return tuple(tuple(r) for r in rows if r[0] and r[1] and r[2])


_VALUES = "array<struct<measure:string,number:string,value:double,event:int>>"


def stated_values(texts: DataFrame, keys: list[str], text: str, measures: tuple) -> DataFrame:
    """``keys``, ``measure``, ``number`` (as written), ``value``, ``event`` (place of the
    statement in the text) of all stated values."""

    @F.pandas_udf(_VALUES)
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = reader(measures)
        for part in parts:
            yield pd.Series([[dict(zip(("measure", "number", "value", "event"), v)) for v in run.read(t)] for t in part], index=part.index, dtype=object)

    return (
        texts.where(F.length(text) > 0).select(*keys, F.explode(read(F.col(text))).alias("v_"))
        .select(*keys, "v_.measure", "v_.number", "v_.value", "v_.event")
    )


def node_values(nodes: DataFrame, measures: tuple) -> DataFrame:
    """``row_id``, ``case_id``, ``measure``, ``number``, ``value``, ``unit``, ``sure``
    (false where the unit or the notation has to come from the case's text) of
    attribute cells."""
    names = sorted({_plain_name(n) for _, s, _, _ in measures for n in s.split("|") if n})
    mine = F.lower(F.regexp_replace(F.coalesce("label", F.regexp_replace("node_id", r"\A[A-Za-z]+:", "")), r"[\s_ ]+", ""))
    # the value stands under a general name or under the measure's own
    own = "|".join(re.escape(m).replace("_", "[_ ]") for m, *_ in measures)
    value = F.regexp_extract("attributes", rf"(?i)(?:\A|[;|,\n{{]\s*)\"?(?:value|size|{own})\s*=\s*([^;|\n\"}}]*)", 1)
    unit = F.regexp_extract("attributes", r"(?i)(?:\A|[;|,\n{]\s*)\"?unit\s*=\s*([^;|\n\"}]*)", 1)
    wanted = nodes.where(mine.rlike(r"\A(?:" + "|".join(map(re.escape, names)) + ")")).select(
        "row_id", "case_id", "label", "node_id", value.alias("value_"), F.trim(unit).alias("unit_")
    )

    names_of = ("measure", "number", "value", "unit", "sure")

    @F.pandas_udf("array<struct<measure:string,number:string,value:double,unit:string,sure:boolean>>")
    def read(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        run = reader(measures)
        for label, node, value, unit in parts:
            found = [run.node(*x) for x in zip(label, node, value, unit)]
            yield pd.Series([[dict(zip(names_of, v)) for v in f] for f in found], index=label.index, dtype=object)

    return (
        wanted.where("value_ <> ''").select("row_id", "case_id", F.explode(read("label", "node_id", "value_", "unit_")).alias("v_"))
        .select("row_id", "case_id", "v_.*")
    )


def resolve_from_text(open_values: DataFrame, stated: DataFrame, measures: tuple) -> DataFrame:
    """``row_id``, ``measure``, ``number``, ``value`` of values that lack a unit (an empty
    ``unit``) or are written in doubtful notation.

    open_values: ``row_id``, ``case_id``, ``measure``, ``number``, ``unit``; stated:
    ``case_id``, ``measure``, ``number``, ``value``, ``event``. A source's history of a
    measure is the statements of its case in the order of the text, then the rows of
    its case in the order of ``row_id``. Repeated statements and rows stand in it once,
    so it is bounded by what is different in a case, and all its rows take its values.
    A case without stated values, and a null case, give nothing.
    """
    key = ["case_id", "measure"]
    cells = (
        open_values.where("case_id is not null").groupBy("row_id", *key)
        .agg(F.array_sort(F.collect_set("number")).alias("numbers"), F.max("unit").alias("unit"))
    )
    events = cells.groupBy(*key, "numbers", "unit").agg(F.min("row_id").alias("first_row"))
    lists = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first_row", "numbers", "unit"))).alias("open"))
    known = (
        stated.where("case_id is not null").join(events.select(*key).distinct(), key, "left_semi")
        .groupBy(*key, "number", "value").agg(F.min("event").alias("event"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("event", "number", "value"))).alias("known"))
    )

    @F.pandas_udf("array<array<double>>")
    def resolve(measure: pd.Series, known: pd.Series, recorded: pd.Series) -> pd.Series:
        by_name = {m.name: m for m in reader(measures).measures}
        out = []
        for m, have, rows in zip(measure, known, recorded):
            by: dict[str, set[float]] = {}
            told: dict[int, list[float]] = {}
            for h in have:
                by.setdefault(h["number"], set()).add(h["value"])
                told.setdefault(h["event"], []).append(h["value"])
            units = by_name[m].units
            asked = [(list(r["numbers"]), [units[r["unit"]]] if r["unit"] in units else by_name[m].ways()) for r in rows]
            out.append(resolve_history(list(told.values()), asked, by))
        return pd.Series(out, dtype=object)

    solved = (
        lists.join(known, key)
        .select(*key, F.explode(F.arrays_zip("open", resolve("measure", "known", "open").alias("v"))).alias("r"))
        .select(*key, "r.open.numbers", "r.open.unit", F.col("r.v").alias("vals")).where("vals is not null")
    )
    return (
        cells.join(solved, [*key, "numbers", "unit"])
        .select("row_id", "measure", F.explode(F.arrays_zip("numbers", "vals")).alias("x")).select("row_id", "measure", F.col("x.numbers").alias("number"), F.col("x.vals").alias("value"))
    )


def in_tenths(value: Column) -> Column:
    """Ten times the value to the nearest integer (see :func:`tenths`)."""
    return F.floor(value * 10 + 0.5 + 1e-9).cast("bigint")


def measured_values(cases: DataFrame, nodes: DataFrame, measures: DataFrame) -> DataFrame:
    """``src``, ``row_id``, ``measure``, ``value`` (in the common unit) of all values
    stated in case texts and held by nodes; distinct rows.

    Null and empty texts and attributes give no row. Every row of a redelivered
    case or node counts. A node's value whose unit or notation stands only in its
    case's text is resolved there, and left out if the text does not state it.
    """
    rows = _catalogue(measures)
    # written once: the sure and the doubtful values, and the histories, read them again
    stated = checkpointed(stated_values(cases, ["row_id", "case_id"], "case_text", rows))
    held = checkpointed(node_values(nodes, rows))
    doubtful = held.where("not sure").withColumnRenamed("value", "guess").drop("sure")
    resolved = resolve_from_text(doubtful, stated, rows)
    sure = held.where("sure").select("row_id", "measure", "value")
    opened = (
        doubtful.join(resolved, ["row_id", "measure", "number"], "left")
        .select("row_id", "measure", F.coalesce("value", "guess").alias("value")).where("value is not null")
    )
    return (
        stated.select(F.lit("cases").alias("src"), "row_id", "measure", "value")
        .unionByName(sure.unionByName(opened).select(F.lit("v4_nodes").alias("src"), "row_id", "measure", "value"))
    )
