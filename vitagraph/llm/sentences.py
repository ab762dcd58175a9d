"""Sentence boundaries across languages and scripts.

Method. Every line of a text is its own stretch. In spaced scripts the stretch's
terminators (with their closing quotes and brackets) are the nodes of a lattice; an
edge between two nodes is a candidate sentence. Its cost is what speaks against the
terminator that ends it (abbreviation, initial, number, lower-case opening), against
cutting a quotation, and against a sentence without a word between its ends; the
cheapest path gives the sentences. In scripts without spaces a dictionary word lattice
divides the stretch around each gap (a blank, or a terminator or closing quotation
mark), and the gap is classified by the word before it (a final particle) and the word
after it (an opening word, or a particle that continues the sentence). The dictionary
is the words below and those that a public vocabulary holds in these scripts.
Everything is a map over rows, without a shuffle.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
#: Abbreviations that are followed by a name or number: never end a sentence.
TITLES = (
    "dr dra drs prof profa mr mrs ms sr sra srta srs st ste mme mlle m hr fr frau no nos nr núm núms fig figs tab table "
    "abb tabl vol bldg rm ref refs eq pp p pg pág cf vgl ca approx aprox env vs v i.v i.m s.c e.g i.e d.h z.b p.ex p.ej u.a s "
    "med dipl ing rer nat phil bzw bzgl ggf sog inkl exkl ver vid рис см табл стр г-н г-жа проф д-р др св т.е т.н напр "
    "डॉ श्री सुश्री मि.ग्रा मि ग्रा कि.ग्रा रु art sect ch chap op ed eds gen col capt lt maj rev hon sen rep gov"
)
#: Abbreviations that may stand at a sentence's end.
OPEN_ABBREVIATIONS = (
    "etc al ltd co inc corp jr a.m p.m m.d ph.d b.sc m.sc u.s u.k d.c approx min max std tel hrs hr wk wks mo mos yr yrs d "
    "p.o b.i.d t.i.d q.i.d q.d prn и.т.д т.д т.п др usw u.s.w ff bis "
    "г гг в вв тыс млн руб jan feb mar apr jun jul aug sep sept oct nov dec"
)
#: Thai and Han-script opening words and final particles, used around gaps.
THAI_OPENERS = "ผู้ป่วย แพทย์ พยาบาล ญาติ หลังจาก ไม่พบ ผล ตรวจ พบ การ เมื่อ ต่อมา จากนั้น แต่ และ ครอบครัว"
THAI_FINALS = "ครับ ค่ะ คะ นะ แล้ว มาก่อน ทันที หายไป เท่า ปีนี้ กลางคืน ก่อน ด้วย อีก เลย"
HAN_OPENERS = "患者 家属 家族 入院 既往 术中 随访 指标 会诊 护士 给予 饮食 第 这 手術 看護 値 これ その しかし また"
#: Words after a gap that continue the sentence before it.
THAI_CONTINUERS = "ๆ ฯ ฯลฯ"
HAN_CONTINUERS = "と って という といった ということ ということで と思 と思います との とか 并 并且 等 等等 的 ， 、"
HAN_FINALS = "了 吗 呢 吧 啊 た です ます だ である か ね よ した ない"
# ---------------------------------------------------------------------------

_OPENING = "\"'“‘„«‹「『（([{¿¡"
_CLOSING = "\"'”’“»›」』）)]}"
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’"}
_LINE = re.compile(r"[^\n\r  \x0b\x0c\x85]+")
_SPACES = r"\s​﻿"
_TERMINATOR = re.compile(
    r"(?:[.!?…।॥‼⁇⁈⁉؟۔]+)(?P<close>(?:[\"'”’“»›)\]}]|[   ]»)*)(?=[\s​]|$|(?<=[\w%)°\]][.!?])(?=[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]|[A-ZÀ-Ý]\s|[¿¡«„“\"]\w))"
    r"|[。！？｡](?:[。！？｡…]*)[」』”’）)\"]*"
)
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[  \t -​ 　]+(?=[ก-ฺเ-๎])")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_TRIM = re.compile(r"\A[\s​﻿]+|[\s​﻿]+\Z")
_TITLES = frozenset(TITLES.split())
_OPEN = frozenset(OPEN_ABBREVIATIONS.split())
#: Blanks that are no part of a sentence's ends.
_OUTER = " \t            ​  　﻿\x1c\x1d\x1e\x1f"
#: Without one of these a text is one sentence.
_DIVISIBLE = re.compile(r"[.!?…।॥‼⁇⁈⁉؟۔。！？｡\n\r\x0b\x0c\x85\u2028\u2029\u0e01-\u0e5b]")
_CLOSERS = frozenset("a.m p.m etc ltd co inc corp".split())
_CUT_QUOTE, _NEVER = 6.0, 50.0


#: Where the public vocabulary lies (a parameter); with an empty one the words above are
#: all. Every executor needs the file: one that lacks it fails.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


class WordLattice:
    """Words of a dictionary over a spaceless stretch: the path with the fewest
    characters outside the dictionary, then with the fewest words."""

    def __init__(self, words):
        self.words = frozenset(words.split() if isinstance(words, str) else words)
        self.longest = max(map(len, self.words))

    def cut(self, text: str) -> list[str]:
        best: list[tuple[int, int, int]] = [(0, 0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[end - 1][0] + 1, best[end - 1][1] + 1, end - 1)]
            for start in range(max(0, end - self.longest), end):
                if text[start:end] in self.words:
                    options.append((best[start][0], best[start][1] + 1, start))
            best.append(min(options))
        cuts, end = [], len(text)
        while end:
            start = best[end][2]
            cuts.append(text[start:end])
            end = start
        return cuts[::-1]


def vocabulary_words(path: str) -> list[str]:
    """Words of two and more characters of the spaceless scripts in a vocabulary file; none
    without a path. A file that can't be read is an error: sentences would differ."""
    if not path:
        return []
    with open(path, "rb") as file:
        pieces = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    words = (p.decode("utf-8", "ignore").strip() for p in pieces)
    return [w for w in words if len(w) > 1 and _SPACELESS_WORD.fullmatch(w)]


_SPACELESS_WORD = re.compile(r"[\u0e40-\u0e44\u0e01-\u0e2e][\u0e01-\u0e4e]+|[\u3041-\u30ff\u3400-\u9fff]+")


@lru_cache(maxsize=None)
def _lattice(thai: bool, path: str) -> tuple[WordLattice, dict[str, float], dict[str, float]]:
    """The lattice, the weights of words before a gap and those of words after it."""
    openers, finals, on = (THAI_OPENERS, THAI_FINALS, THAI_CONTINUERS) if thai else (HAN_OPENERS, HAN_FINALS, HAN_CONTINUERS)
    lattice = WordLattice([*openers.split(), *finals.split(), *on.split(), *vocabulary_words(path)])
    return lattice, dict.fromkeys(finals.split(), 1.0), dict.fromkeys(openers.split(), 1.0) | dict.fromkeys(on.split(), -8.0)


@lru_cache(maxsize=100_000)
def _gap_evidence(before: str, after: str, thai: bool, path: str) -> float:
    """For (above 0) or against a boundary in a spaceless script's gap."""
    lattice, ends, opens = _lattice(thai, path)
    left, right = lattice.cut(before), lattice.cut(after)
    return ends.get(left[-1] if left else "", 0.0) + opens.get(right[0] if right else "", 0.0)


#: Characters beside a gap that the word lattice divides; no word is longer.
_REACH = 12
_BLANKS = " \u00a0\u2007\u2009\u202f\u200b\t\u3000"
_NOT_BLANK = re.compile(f"[^{_BLANKS}]")


def _next(line: str, at: int, skip: re.Pattern = _NOT_BLANK) -> int:
    """Place of the first sign from ``at`` on that is not skipped, else the line's end."""
    m = skip.search(line, at)
    return m.start() if m else len(line)


_NOT_SPACE = re.compile(r"\S")
_NOT_OPENING = re.compile("[^" + re.escape(_OPENING) + "—– -]")


def _sign(line: str, at: int) -> str:
    return line[at : at + 1] if at >= 0 else ""


def _last(line: str, at: int) -> int:
    """End of what stands before ``at`` without the blanks there."""
    while at and line[at - 1].isspace():
        at -= 1
    return at


def _word_before(line: str, at: int) -> str:
    """What stands before ``at`` up to a blank; empty if longer than any abbreviation."""
    start = at
    while start and at - start <= _LONGEST and not line[start - 1].isspace():
        start -= 1
    return line[start:at] if at - start <= _LONGEST else ""


#: Characters of the longest abbreviation, and of the longest word of the lists here.
_LONGEST = 40


def _terminator_cost(line: str, m: re.Match, first_mark: int) -> float:
    """Cost of ending a sentence after terminator ``m``; negative is a gain."""
    mark = line[first_mark]
    at = _next(line, m.end())
    if at == len(line):
        return -9.0
    opened = _next(line, at, _NOT_OPENING)
    nxt, after = line[at : at + _LONGEST], line[opened : opened + _LONGEST]
    after = after or nxt
    head = after[0]
    lower = head.islower() and not after[1:2].isupper()  # "pH" opens a sentence
    closed = line[m.start() : m.end()][-1:] in _CLOSING
    if mark in "。！？｡":
        if nxt[0] in "，、,；;」』”）":
            return _NEVER
        if not _HAN.match(after):
            return -3.0
        # a closed quotation may go on with a particle; which word it is, the lattice says
        evidence = _gap_evidence(line[max(0, first_mark - _REACH) : first_mark], after[:_REACH], False, VOCABULARY)
        return -3.0 - evidence if closed else -3.0 - max(evidence, 0.0)
    if mark in "।॥":
        return -3.0
    if mark in "!?؟‼⁇⁈⁉":
        if mark == "!" and nxt[:1] in ",;":
            return _NEVER
        return 3.0 if lower or nxt[:1] in ",;:—–" else -3.0
    if mark == "…" or line.startswith("...", first_mark):
        return 3.0 if lower or nxt[:1] in ",;:" else -2.5
    if nxt[:1] in ",;:)":
        return _NEVER
    if lower:
        return 4.0
    word = _word_before(line, first_mark).lstrip(_OPENING)
    plain = word.lower()
    if plain in _TITLES:
        return 5.0
    if len(word) == 1 and word.isalpha() and word.islower() and re.match(r"[^\W\d_]\.", after):
        return 5.0  # "z. B.", "d. h."
    if len(word) == 1 and word.isalpha() and word.isupper() and not closed:
        end = _last(line, first_mark - 1)
        # an initial before a name; a unit such as L, F or C after a number ends a sentence
        return -1.0 if line[end - 1 : end].isdigit() or line[max(0, end - 1) : end] in "°%/" or line.endswith("deg", 0, end) else 4.0
    if re.fullmatch(r"(?:\w\.)+\w", word) and word.replace(".", "").isupper() and plain not in _OPEN:
        return 4.0
    if plain in _CLOSERS and head.isdigit():
        return -0.5
    if plain in _OPEN or re.fullmatch(r"(?:[^\W\d]\.)+[^\W\d]", word):
        return -0.5 if head.isupper() or not head.isalpha() and not head.isdigit() or _other_letter(head) else 2.0
    if word.isdigit() and not closed:
        line_start = not line[: first_mark - len(word)].strip()
        if line_start:
            return _NEVER  # the number of a list line
        if head.isdigit():
            return -1.0
        if len(word) <= 2 and _ordinal(line, first_mark - len(word), after):
            return 4.0
    if head.isdigit():
        return -1.5
    return -3.0


def _other_letter(head: str) -> bool:
    return head.isalpha() and not head.islower() and not head.isupper()


#: Words that follow a numeral with a full stop in German (days and months) and words before it.
_MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember tag woche monat jahr lebensjahr".split()
)


def _ordinal(line: str, at: int, after: str) -> bool:
    word = re.match(r"\w+", after)
    before = _word_before(line, _last(line, at)).lower()
    return bool(word) and (word.group().lower() in _MONTHS or before in ("am", "der", "die", "dem", "den", "bis", "zum", "vom", "im", "ao", "no"))


_QUOTE_SIGN = re.compile("[\"'" + "".join(_PAIRS) + "]")


def _quotes(line: str) -> list[tuple[int, int]]:
    """Spans of quotations of a line; an unclosed mark opens none."""
    spans, sign = [], _QUOTE_SIGN.search(line)
    while sign is not None:
        i, c, end = sign.start(), sign.group(), -1
        if c in _PAIRS:
            end = line.find(_PAIRS[c], i + 1)
        elif c == '"':
            end = line.find('"', i + 1)
        elif c == "'" and (i == 0 or not line[i - 1].isalnum()) and i + 1 < len(line) and not line[i + 1].isspace():
            m = re.compile(r"'(?!\w)").search(line, i + 1)
            end = m.start() if m else -1
        if end > i:
            spans.append((i, end + 1))
            i = end
        sign = _QUOTE_SIGN.search(line, i + 1)
    return spans


def _brackets(line: str) -> list[tuple[list[int], list[int]]]:
    """Starts and ends of the outermost closed brackets of each kind, in one pass."""
    found = []
    for a, b in ("()", "[]"):
        opened, starts, ends = [], [], []
        for m in re.finditer(f"[{re.escape(a + b)}]", line):
            if m.group() == a:
                opened.append(m.start())
            elif opened:
                start = opened.pop()
                while starts and starts[-1] > start:
                    starts.pop(), ends.pop()
                starts.append(start), ends.append(m.start())
        found.append((starts, ends))
    return found


def _bracketed(line: str, brackets: list[tuple[list[int], list[int]]], mark: int, end: int) -> bool:
    """Whether a terminator stands in a bracket that is closed after it."""
    for starts, ends in brackets:
        k = bisect.bisect_left(starts, mark) - 1
        if k >= 0 and ends[k] >= mark and (ends[k] >= end or _sign(line, _next(line, end, _NOT_SPACE)).islower()):
            return True
    return False


def _line_spans(line: str) -> list[tuple[int, int]]:
    """Sentences of one line, by the cheapest path through its lattice."""
    nodes: list[tuple[int, int, float]] = []
    for m in _TERMINATOR.finditer(line):
        nodes.append((m.end(), m.start(), _terminator_cost(line, m, m.start())))
    for m in _THAI_GAP.finditer(line):
        score = 2.0 + _gap_evidence(line[max(0, m.start() - _REACH) : m.start()], line[m.end() : m.end() + _REACH], True, VOCABULARY)
        nodes.append((m.start(), m.start(), -score))
    nodes = [n for n in nodes if n[2] < _NEVER]
    if not nodes:
        return [(0, len(line))]
    nodes.sort()
    if "(" in line or "[" in line:
        brackets = _brackets(line)
        nodes = [n for n in nodes if not _bracketed(line, brackets, n[1], n[0])]
    quotes = _quotes(line) if _QUOTE_SIGN.search(line) else []
    if not quotes:
        return _plain_path(line, nodes)
    return _cheapest_path(line, nodes, quotes)


def _plain_path(line: str, nodes: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The cheapest path of a line without quotations. There every node that gains is
    taken, but one of those between which no word stands: the cheapest, then the last."""
    cuts: list[tuple[int, float]] = []
    for end, mark, cost in nodes:
        if cost < 0:
            at, since = mark - 1, cuts[-1][0] if cuts else 0
            while at >= since and not line[at].isalnum():
                at -= 1
            if at >= since:
                cuts.append((end, cost))
            elif cuts and cost <= cuts[-1][1]:
                cuts[-1] = (end, cost)
    while cuts and not any(map(str.isalnum, line[cuts[-1][0] :])):
        cuts.pop()
    bounds = [0, *(end for end, _ in cuts), len(line)]
    return list(zip(bounds, bounds[1:]))


def _cheapest_path(line: str, nodes: list[tuple[int, int, float]], quotes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cheapest path of any line."""
    # the cheapest way to each node: from the cheapest node before it with a word in
    # between, or, at a cost, from one without; a boundary inside a quotation costs more
    # than any terminator gains
    ends, total, back, q = [0], [0.0], [0], 0
    best, near, upto, wordy = 0, None, 1, 0
    last_word, seen = -1, 0
    for end, mark, cost in [*nodes, (len(line), len(line), 0.0)]:
        at = mark - 1
        while at >= seen and not line[at].isalnum():
            at -= 1
        last_word, seen = (at if at >= seen else last_word), mark
        # nodes that lie before the last word: the cheapest of them is ``best``
        while upto < len(ends) and ends[upto] <= last_word:
            if total[upto] <= total[best]:
                best = upto
            upto += 1
        if wordy != upto:
            near, wordy = None, upto
        if upto < len(ends) and (near is None or total[-1] < total[near]):
            near = len(ends) - 1
        while q < len(quotes) and quotes[q][1] <= mark:
            q += 1
        if q < len(quotes) and quotes[q][0] < mark:
            if end < quotes[q][1]:
                cost += _CUT_QUOTE + 10
            else:
                cost = max(cost, _after_quote(line, quotes[q], end))
        k = best if near is None or total[best] <= total[near] + _NO_WORD else near
        ends.append(end)
        total.append(total[k] + cost + (_NO_WORD if k == near or last_word < ends[k] else 0.0))
        back.append(k)
    k, cuts = back[-1], []
    while k:
        cuts.append(ends[k])
        k = back[k]
    bounds = [0, *reversed(cuts), len(line)]
    return list(zip(bounds, bounds[1:]))


#: Cost of a sentence without a word.
_NO_WORD = 20.0


#: Verbs of saying (fixed values) that join a quotation to the words after it.
_SAID = re.compile(
    r"[\s,—–-]*(?:the (?:patient|man|woman|child|mother|father|wife|husband)\b|he\b|she\b|and\b|"
    r"said|told|explained|reported|recalled|asked|wrote|sagte|erklärte|berichtete|gab|dijo|explicó|refirió|contó|disse|"
    r"explicou|relatou|contou|dit|disait|expliquait|a dit|raconte|сказал|сказала|пояснил|रोगी ने|उसने|患者)",
    re.I,
)


def _after_quote(line: str, quote: tuple[int, int], end: int) -> float:
    """Cost of a boundary at the end of a quotation that closes with a terminator."""
    at = _next(line, end, _NOT_SPACE)
    if at == len(line):
        return -9.0
    before = _sign(line, _last(line, quote[0]) - 1)
    own = not before or before in ".!?…。！？।"
    follows = line[at : at + 2]
    if (follows[:1].islower() and not follows[1:2].isupper()) or follows[:1] in ",;:—–":
        return 4.0
    if _HAN.match(line, at) and _gap_evidence(line[max(0, quote[1] - _REACH) : quote[1] - 1], line[at : at + _REACH], False, VOCABULARY) < 0:
        return 4.0
    if own and _SAID.match(line, end):
        return 4.0
    return -3.0


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each sentence of a text, without outer
    blanks. A text of blanks has none."""
    if not _DIVISIBLE.search(text):
        core = text.strip(_OUTER)
        start = text.find(core) if core else 0
        return [(start, start + len(core))] if core else []
    found = []
    for m in _LINE.finditer(text):
        line, base = m.group(), m.start()
        for a, b in _line_spans(line):
            part = line[a:b]
            core = part.strip(_OUTER)
            if core:
                start = base + a + part.index(core)
                found.append((start, start + len(core)))
    return found


def split_sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``sent_no`` (from 1), ``char_start`` (0-based, inclusive) and
    ``char_end`` (exclusive) of every sentence of column ``text``.

    Null, empty and blank texts give no row; repeated rows are divided each;
    offsets count code points, also in very long texts. Extra columns are pruned.
    """

    @F.pandas_udf("array<int>")
    def bounds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.array(sentence_spans(t), np.int32).ravel() for t in part], index=part.index, dtype=object)

    full = df.select(*keys, F.col(text).alias("text_")).where(F.length("text_") > 0)
    flat = full.select(*keys, bounds("text_").alias("b_")).where(F.size("b_") > 0)
    places = F.sequence(F.lit(1), (F.size("b_") / 2).cast("int"))
    return flat.select(*keys, "b_", F.explode(places).alias("sent_no")).select(
        *keys,
        "sent_no",
        F.element_at("b_", F.col("sent_no") * 2 - 1).alias("char_start"),
        F.element_at("b_", F.col("sent_no") * 2).alias("char_end"),
    )
