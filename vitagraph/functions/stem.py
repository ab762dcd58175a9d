"""English stems by the published Porter2 algorithm, as SQL expressions.

The algorithm is a fixed chain of suffix rules over regions of the word. Each step is a
column that reads the columns before it, so that a plan computes it once, in the JVM,
over distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values of the algorithm --------------------------------------------
#: Words with a stem of their own.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes", "inning": "inning", "innings": "inning", "outing": "outing",
    "outings": "outing", "canning": "canning", "cannings": "canning", "herring": "herring", "herrings": "herring",
    "earring": "earring", "earrings": "earring", "proceed": "proceed", "proceeds": "proceed", "proceeded": "proceed",
    "proceeding": "proceed", "exceed": "exceed", "exceeds": "exceed", "exceeded": "exceed", "exceeding": "exceed",
    "succeed": "succeed", "succeeds": "succeed", "succeeded": "succeed", "succeeding": "succeed",
}
_SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less",
    "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
# ------------------------------------------------------------------------------


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _cut(text: str, n: str | int, more: str = "") -> str:
    return f"concat(substr({text}, 1, length({text}) - {n}), '{more}')"


def _suffix(text: str, suffixes) -> str:
    return f"regexp_extract({text}, '({'|'.join(suffixes)})$', 1)"


def _marked(text: str) -> str:
    """A consonantal y is written Y: at the start, and after a vowel."""
    text = f"case when {text} like 'y%' then concat('Y', substr({text}, 2)) else {text} end"
    for v in "aeiouy":
        text = f"replace({text}, '{v}y', '{v}Y')"
    return text


def _region(rest: str) -> str:
    """Characters up to the first consonant after a vowel, else all."""
    found = f"regexp_extract({rest}, '^.*?[aeiouy][^aeiouy]', 0)"
    return f"case when {found} = '' then length({rest}) else length({found}) end"


_SHORT = "(length({0}) >= 3 and " + _has("{0}", "[^aeiouy][aeiouy][^aeiouywxY]$") + ") or (length({0}) = 2 and " + _has("{0}", "^[aeiouy][^aeiouy]$") + ")"
#: (column, expression over ``low`` and the columns before it), valid in Spark and ANSI SQL.
STEPS = [
    ("w0", _marked("low")),
    ("p1", f"case when w0 like 'gener%' or w0 like 'arsen%' then 5 when w0 like 'commun%' then 6 else {_region('w0')} end"),
    ("p2", f"p1 + {_region('substr(w0, p1 + 1)')}"),
    ("s1", _suffix("w0", ["sses", "ied", "ies", "us", "ss", "s"])),
    ("w1", f"case when s1 = 'sses' then {_cut('w0', 2)} when s1 in ('ied', 'ies') then case when length(w0) > 4 then {_cut('w0', 2)} else {_cut('w0', 1)} end when s1 = 's' and {_has('substr(w0, 1, length(w0) - 2)', '[aeiouy]')} then {_cut('w0', 1)} else w0 end"),
    ("s2", _suffix("w1", ["eedly", "ingly", "edly", "eed", "ing", "ed"])),
    ("c2", f"s2 not in ('', 'eed', 'eedly') and {_has('substr(w1, 1, length(w1) - length(s2))', '[aeiouy]')}"),
    ("w2", f"case when s2 in ('eed', 'eedly') and length(w1) - length(s2) >= p1 then {_cut('w1', 'length(s2)', 'ee')} when c2 then {_cut('w1', 'length(s2)')} else w1 end"),
    ("w3", f"case when not c2 then w2 when {_has('w2', '(at|bl|iz)$')} then concat(w2, 'e') when {_has('w2', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} then {_cut('w2', 1)} when p1 >= length(w2) and ({_SHORT.format('w2')}) then concat(w2, 'e') else w2 end"),
    ("w4", f"case when {_has('w3', '.[^aeiouy][yY]$')} then {_cut('w3', 1, 'i')} else w3 end"),
    ("s5", _suffix("w4", [*sorted(_SECOND, key=lambda x: -len(x)), "ogi", "li"])),
    ("w5", f"case when s5 = '' or length(w4) - length(s5) < p1 then w4 when s5 = 'ogi' then case when w4 like '%logi' then {_cut('w4', 1)} else w4 end when s5 = 'li' then case when {_has('w4', '[cdeghkmnrt]li$')} then {_cut('w4', 2)} else w4 end "
     + " ".join(f"when s5 = '{k}' then {_cut('w4', len(k), v)}" for k, v in _SECOND.items()) + " else w4 end"),
    ("s6", _suffix("w5", [*sorted(_THIRD, key=lambda x: -len(x)), "ative"])),
    ("w6", f"case when s6 = '' or length(w5) - length(s6) < p1 then w5 when s6 = 'ative' then case when length(w5) - 5 >= p2 then {_cut('w5', 5)} else w5 end " + " ".join(f"when s6 = '{k}' then {_cut('w5', len(k), v)}" for k, v in _THIRD.items()) + " else w5 end"),
    ("s7", _suffix("w6", _FOURTH)),
    ("w7", f"case when s7 = '' or length(w6) - length(s7) < p2 then w6 when s7 = 'ion' then case when {_has('w6', '[st]ion$')} then {_cut('w6', 3)} else w6 end else {_cut('w6', 'length(s7)')} end"),
    ("w8", f"case when w7 like '%ll' and length(w7) - 1 >= p2 then {_cut('w7', 1)} when w7 like '%e' and length(w7) - 1 >= p2 then {_cut('w7', 1)} when w7 like '%e' and length(w7) - 1 >= p1 and length(w7) >= 4 and not {_has('w7', '[^aeiouy][aeiouy][^aeiouywxY]e$')} then {_cut('w7', 1)} else w7 end"),
    ("stem", "case when length(low) <= 2 or not " + _has("low", "^[a-z]+$") + " then low " + " ".join(f"when low = '{k}' then '{v}'" for k, v in EXCEPTIONS.items()) + " else replace(w8, 'Y', 'y') end"),
]


def stem_words(words: DataFrame, word: str) -> DataFrame:
    """``word``, ``stem`` of the distinct words; words that are not all letters keep their
    lower case. Join it back to the tokens: there are far fewer words than tokens."""
    rows = words.select(word).where(F.col(word).isNotNull()).distinct().withColumn("low", F.lower(word))
    for name, expression in STEPS:
        rows = rows.withColumn(name, F.expr(expression))
    return rows.select(word, "stem")


def stem_sql(words: str) -> str:
    """The same as a query over a query of distinct ``word``."""
    sql = f"select word, lower(word) as low from ({words})"
    for name, expression in STEPS:
        sql = f"select *, {expression} as {name} from ({sql})"
    return f"select word, stem from ({sql})"
