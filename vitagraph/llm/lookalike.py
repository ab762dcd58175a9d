"""Visually identical text in one consistent form.

Method: a transducer is compiled once from a precomputed mapping (widths,
ligatures, accents, blanks, hyphens, look-alike letters and signs) that is checked
for conflicts: every output must itself be in final form. It runs over grapheme
clusters (a base with its combining marks, or an emoji sequence) and takes the
longest match, so a text is rewritten in one pass. Letter case, accents, raised or
lowered digits, words and punctuation are kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.sources.tables import checkpointed

# ---- fixed values: letters and signs of other code but the same shape ------
CYRILLIC = "АВЕЅЗІЇЈКМНОРСТУХҮаеѕіїјорсухһԁԛԝӏ"
CYRILLIC_AS = "ABES3IÏJKMHOPCTYXYaesiïjopcyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικμϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXavopuiкµcj"
ARMENIAN = "ՕօոսհցզյՍՏ"
ARMENIAN_AS = "OonuhgqjUS"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦ"
CHEROKEE_AS = "DRTiAJEWMHGZVSLCPK"
SIGNS = {
    "‐": "-", "‑": "-", "⁃": "-", "﹣": "-", "－": "-", "…": "...", "‥": "..", "․": ".", "ʼ": "’",
    "ꞏ": "·", "‧": "·", "∙": "·", "⋅": "·", "∶": ":", "℃": "°C", "℉": "°F", "˚": "°", "∗": "*",
    "ǃ": "!", "ⅼ": "l", "ɡ": "g", "ɑ": "a", "ʋ": "v", "∣": "|", "❘": "|", "∕": "/", "⁄": "/",
}
#: Compatibility classes whose members look like what they stand for.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>")
# ---------------------------------------------------------------------------

#: Ligatures, digraphs, Roman numerals and radicals: drawn like what they stand for.
_JOINED = (range(0xFB00, 0xFB07), range(0x132, 0x134), range(0x1C4, 0x1CD), range(0x1F1, 0x1F4), range(0x2160, 0x2180), range(0x2F00, 0x2FD6))
_INVISIBLE = "Cf"
_JOINER, _EMOJI_VARIANT = "‍", "️"


def _fixed() -> dict[str, str]:
    """The explicit part of the mapping."""
    tables = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS))
    found = {k: v for old, new in tables for k, v in zip(old, new, strict=True)} | SIGNS
    found["к"] = "к"  # small Cyrillic and Greek kappa share a form, apart from Latin k
    found["κ"] = "к"
    return {k: v for k, v in found.items() if k != v}


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every single character that is rewritten, with its final form.

    Raises ValueError when an output would be rewritten again to something else
    (a conflict), so that one pass is enough and the result is stable.
    """
    fixed = _fixed()
    raw: dict[str, str] = {}
    targets = set("".join(fixed.values()))
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if c in fixed:
            raw[c] = fixed[c]
        elif c in targets:
            continue
        elif kind == "Zs":
            raw[c] = " "
        elif kind == _INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            raw[c] = ""
        elif kind in ("Zl", "Zp"):
            raw[c] = "\n"
        else:
            decomposed = unicodedata.decomposition(c)
            tag = decomposed.split(" ", 1)[0]
            if tag in SAME_SHAPE or (tag == "<compat>" and any(o in r for r in _JOINED)):
                raw[c] = unicodedata.normalize("NFKC", c)
            elif decomposed and not tag.startswith("<"):
                raw[c] = unicodedata.normalize("NFC", "".join(fixed.get(x, x) for x in unicodedata.normalize("NFD", c)))
    # follow each output to its end, e.g. a full-width letter to its look-alike
    final: dict[str, str] = {}
    for c, out in raw.items():
        for _ in range(8):
            step = "".join(raw.get(x, x) for x in out)
            if step == out:
                break
            out = step
        else:
            raise ValueError(f"the mapping of {c!r} does not end")
        if out != c:
            final[c] = out
    for c, out in final.items():
        if any(x in final for x in out):
            raise ValueError(f"{c!r} is rewritten to {out!r}, which is not final")
    return final


#: Combining marks of the scripts whose letters the mapping rewrites, and of kana.
_REWRITTEN_MARKS = "\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\uff9e\uff9f"


@lru_cache(maxsize=1)
def _marks() -> str:
    """All combining marks and conjoining Hangul vowels and finals, as ranges."""
    kinds = [o for o in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(o))[0] == "M" or 0x1160 <= o <= 0x11FF or 0xD7B0 <= o <= 0xD7FF or o in (0xFF9E, 0xFF9F)]
    ranges: list[list[int]] = []
    for o in kinds:
        if ranges and ranges[-1][1] == o - 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


class Transducer:
    """Longest match over grapheme clusters."""

    def __init__(self):
        self.map = mapping()
        simple = "".join(re.escape(c) for c in self.map)
        marks = _marks()
        unseen = "".join(re.escape(c) for c, out in self.map.items() if out == "")
        emoji = "\U0001f000-\U0001faff☀-➿⬀-⯿"
        self.parts = re.compile(
            f"(?P<emoji>[{emoji}][️\U0001f3fb-\U0001f3ff]*(?:‍[{emoji}♀♂][️\U0001f3fb-\U0001f3ff]*)+)"
            f"|(?P<cluster>[^{marks}\\s][{unseen}]*[{marks}][{marks}{unseen}]*)"
            f"|\r\n?|(?:[{simple}](?![{unseen}]*[{marks}]))+"
        )
        # marks of the scripts whose letters are rewritten; elsewhere composing is enough
        self.special = re.compile(f"[{_REWRITTEN_MARKS}]|[{emoji}][️\U0001f3fb-\U0001f3ff]*‍")
        self.table = str.maketrans(self.map)
        self.clusters: dict[str, str] = {}

    def _cluster(self, text: str) -> str:
        """A base with combining marks: mapped, then composed as far as may be."""
        known = self.clusters.get(text)
        if known is None:
            mapped = "".join(self.map.get(c, c) for c in text)
            known = unicodedata.normalize("NFC", mapped)
            known = unicodedata.normalize("NFC", "".join(self.map.get(c, c) for c in unicodedata.normalize("NFD", known)))
            if len(self.clusters) < 50_000:
                self.clusters[text] = known
        return known

    def _one(self, m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "cluster":
            return self._cluster(m.group())
        if kind == "emoji":
            return m.group().replace(_EMOJI_VARIANT, "")
        text = m.group()
        if text[0] == "\r":
            return "\n"
        get = self.map.get
        return "".join([get(c, c) for c in text])

    def __call__(self, text: str) -> str:
        if text.isascii() and "\r" not in text:
            return text
        text = unicodedata.normalize("NFC", text)
        if self.special.search(text):
            text = self.parts.sub(self._one, text)
        else:  # clusters that no mapping reaches into: the same mapping as a table
            text = text.replace("\r\n", "\n").replace("\r", "\n").translate(self.table)
        return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent_form(text: Column) -> Column:
    """The text's one consistent form. Null gives null, empty gives empty; a text
    of invisible characters gives an empty text."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = transducer()
        for part in parts:
            yield pd.Series([None if t is None else run(t) for t in part], index=part.index, dtype=object)

    return rewrite(text)


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``form_id`` (hash of the consistent form) and ``raw_id`` (hash of
    the text) of every row with a visible character; null, empty and blank texts
    have none. The 128-bit hashes take the texts' place in later shuffles."""
    formed = df.select(key, F.col(text).alias("t_")).where(F.length("t_") > 0).withColumn("f_", consistent_form(F.col("t_")))
    visible = F.regexp_replace("f_", r"[\s]+", "") != ""
    return formed.where(visible).select(key, F.md5("f_").alias("form_id"), F.md5("t_").alias("raw_id"))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``class_id``, ``strings``, ``members``: every row whose text looks like
    another row's different string, with its class and the class's numbers of different
    strings and of rows. One row for each row of ``df``, however large the classes."""
    rows = checkpointed(look_alikes(df, key, text))
    sizes = rows.groupBy("form_id", "raw_id").agg(F.count("*").alias("n")).groupBy("form_id").agg(F.count("*").alias("strings"), F.sum("n").alias("members"))
    return rows.join(sizes.where("strings > 1"), "form_id").select(key, F.col("form_id").alias("class_id"), "strings", "members")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_lo``, ``doc_hi``: pairs of rows whose texts look the same without being
    the same string. Exact copies are grouped before the join, so a class without
    a second string costs nothing, however many copies it has; only the classes
    that have one are paired, along their distinct strings."""
    rows = checkpointed(look_alikes(df, key, text))  # the texts are rewritten once
    strings = rows.groupBy("form_id", "raw_id").agg(F.count("*").alias("n"))
    mixed = strings.groupBy("form_id").agg(F.count("*").alias("k")).where("k > 1").select("form_id")
    kept = rows.join(mixed, "form_id", "left_semi")
    variants = kept.select("form_id", "raw_id").distinct()
    a = variants.select("form_id", F.col("raw_id").alias("raw_a"))
    b = variants.select("form_id", F.col("raw_id").alias("raw_b"))
    links = a.join(b, "form_id").where("raw_a < raw_b")
    left = kept.select("form_id", F.col("raw_id").alias("raw_a"), F.col(key).alias("x"))
    right = kept.select("form_id", F.col("raw_id").alias("raw_b"), F.col(key).alias("y"))
    pairs = links.join(left, ["form_id", "raw_a"]).join(right, ["form_id", "raw_b"])
    return pairs.where("x <> y").select(F.least("x", "y").alias("doc_lo"), F.greatest("x", "y").alias("doc_hi")).distinct()
