"""Features and training rows of tokens for a classifier of nodes.

Tokens of a sentence are one array, so the window, the bag and the dictionary's
neighbours are expressions over that row; nothing crosses a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.functions.stem import stem_words
from vitagraph.sources.tables import ranked

# ---- fixed values -------------------------------------------------------------
UNIT_WORDS = ["mg", "mcg", "g", "kg", "ml", "l", "mmhg", "mmol", "iu", "cm", "mm", "bpm", "%"]
# ------------------------------------------------------------------------------
WINDOW, BAG = 2, 5


def sentence_tokens(sentences: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``toks``: ``array<struct<i, token, low, norm, punct>>`` of each sentence,
    ``norm`` being the stem of all-letter tokens."""
    toks = sentences.select(*keys, F.posexplode(T.word_tokens(F.col(text))).alias("i", "token"))
    stems = stem_words(toks.select("token"), "token")
    row = F.struct("i", "token", F.lower("token").alias("low"), F.col("stem").alias("norm"), (~F.col("token").rlike("[A-Za-z0-9]")).alias("punct"))
    return toks.join(stems, "token").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("toks"))


def _when(hit: Column, *names: Column) -> Column:
    return F.when(hit, F.array(*names)).otherwise(F.array().cast("array<string>"))


def token_features(window: int = WINDOW, bag: int = BAG) -> Column:
    """``array<struct<i, names>>`` from ``toks``: the names of each token's features, a
    string's as ``key=value``; ``len`` is given as ``len=n``. Neighbours past the
    sentence have ``edge``; the bag holds each different word once."""
    at = lambda j: F.get(F.col("toks"), j)
    eq = lambda k, v: F.concat(F.lit(f"{k}="), v)

    def own(t: Column) -> Column:
        w, low = t["token"], t["low"]
        capital = F.substr(w, F.lit(1), F.lit(1)).rlike("[A-Z]")
        return F.concat(
            F.array(F.lit("bias"), eq("lower", low), eq("norm", t["norm"]), eq("shape", T.word_shape(w)), eq("pre3", F.left(low, F.lit(3))), *[eq(f"suf{n}", F.right(low, F.lit(n))) for n in (2, 3, 4)], eq("len", F.least(F.length(w), F.lit(12)).cast("string"))),
            _when(capital, F.lit("is_title")), _when(w.rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length(w) > 1), F.lit("is_upper")), _when(low.rlike("[0-9]"), F.lit("has_digit")), _when(low.contains("-"), F.lit("has_hyphen")),
        )

    def near(i: Column, d: int) -> Column:
        n, k = at(i + d), f"{d:+d}:"
        parts = [F.array(eq(k + "norm", n["norm"]), eq(k + "shape", T.word_shape(n["token"]))), _when(n["low"].isin(UNIT_WORDS), F.lit(k + "is_unit"))]
        if abs(d) == 1:
            parts.append(F.array(eq(k + "suf3", F.right(n["low"], F.lit(3)))))
        if d == -1:
            parts.append(F.array(F.concat(F.lit("prev+cur="), n["norm"], F.lit("|"), at(i)["norm"])))
        return F.when(n.isNull() | (i + d < 0), F.array(F.lit(k + "edge"))).otherwise(F.concat(*parts))

    def context(i: Column) -> Column:
        around = F.slice("toks", F.greatest(i - bag, F.lit(0)) + 1, F.least(i, F.lit(bag)) + bag + 1)
        words = F.filter(around, lambda t: (t["i"] != i) & ~t["punct"])
        return F.array_distinct(F.transform(words, lambda t: eq("ctx:", t["norm"])))

    def all_of(t: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), F.concat(own(t), *[near(i, d) for d in range(-window, window + 1) if d], context(i)).alias("names"))

    return F.transform("toks", all_of)


def dictionary_features(spans: str = "spans", window: int = WINDOW) -> Column:
    """``array<struct<i, names>>`` from ``toks`` and spans (``start``, ``stop``,
    ``candidates``): a token's own candidates and whether it begins a term, and the
    candidates of its neighbours."""
    holds = lambda i: F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["stop"])), F.lit(0))

    def named(prefix: str, candidates: Column) -> Column:
        return F.transform(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: F.concat(F.lit(prefix), c))

    def names(t: Column, i: Column) -> Column:
        mine = holds(i)
        own = _when(mine.isNotNull(), F.concat(F.lit("dict:"), F.array_join(mine["candidates"], "|")), F.when(mine["start"] == i, "dict_first").otherwise("dict_inside"))
        near = [named(f"{d:+d}:dict:", holds(i + d)["candidates"]) for d in range(-window, window + 1) if d]
        return F.struct(i.alias("i"), F.concat(own, *near).alias("names"))

    return F.transform("toks", names)


def bio_labels(spans: str = "spans") -> Column:
    """``array<struct<i, label, ambiguous>>`` from ``toks`` and spans with ``label`` and
    ``candidates``: B- and I- tags, IGNORE for terms that are no nodes, O elsewhere."""
    holds = lambda i: F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["stop"])), F.lit(0))

    def label(t: Column, i: Column) -> Column:
        s = holds(i)
        tag = F.when(s.isNull(), "O").when(s["label"] == "IGNORE", "IGNORE").otherwise(F.concat(F.when(s["start"] == i, "B-").otherwise("I-"), s["label"]))
        return F.struct(i.alias("i"), tag.alias("label"), F.coalesce(F.size(s["candidates"]) > 1, F.lit(False)).alias("ambiguous"))

    return F.transform("toks", label)


def choose_ambiguous(tag: Column, candidates: Column, first: Column, scores: Column) -> Column:
    """The tag of a token: O for terms that are no nodes; of an ambiguous term the
    candidate with the greatest sum of its B- and I- scores (``map<string, double>``),
    ties to the earlier candidate, B- or I- by the term's place; else ``tag``."""
    both = lambda c: F.coalesce(F.try_element_at(scores, F.concat(F.lit("B-"), c)), F.lit(0.0)) + F.coalesce(F.try_element_at(scores, F.concat(F.lit("I-"), c)), F.lit(0.0))
    best = F.array_max(F.transform(candidates, lambda c, k: F.struct(both(c).alias("p"), (-k).alias("k"), c.alias("c"))))["c"]
    return F.when(F.array_contains(candidates, "IGNORE"), "O").when(F.size(candidates) > 1, F.concat(F.when(first, "B-").otherwise("I-"), best)).otherwise(tag)


def feature_index(rows: DataFrame, names: str) -> DataFrame:
    """``name``, ``column``: the different feature names of training rows, numbered in
    their order; a name that a later row has and this table lacks is dropped by a join."""
    every = rows.select(F.explode(names).alias("name")).distinct()
    return ranked(every, [], ["name"], "number").select("name", (F.col("number") - 1).alias("column"))
