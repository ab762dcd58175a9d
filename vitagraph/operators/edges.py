"""Candidate pairs of a sentence's entities, their weak labels and features.

Everything of a sentence lies in one row: its words, and its entities as an array.
Pairs are made by expressions over that row, so there is no self-join and nothing is
paired across sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.operators import scope
from vitagraph.operators.graph import VALID_PAIRS
from vitagraph.operators.matching import LONGEST_FIRST, PATIENT_WORDS, match_terms

#: Words of context beside a pair.
CONTEXT = 4


def _is_pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(">"), b).isin([f"{x}>{y}" for x, y, _ in VALID_PAIRS])


def patient_runs(words: Column) -> Column:
    """``array<struct<start, stop, term, label>>``: maximal runs of patient words."""
    hit = F.transform(words, lambda w: F.lower(w).isin(PATIENT_WORDS) | T.lemmatize(w).isin(PATIENT_WORDS))

    def runs(h: Column) -> Column:
        n = F.size(h)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: F.get(h, i) & ((i == 0) | ~F.coalesce(F.get(h, i - 1), F.lit(False))))
        stop = lambda i: F.get(F.filter(F.sequence(i + 1, n), lambda j: (j == n) | ~F.coalesce(F.get(h, j), F.lit(False))), F.lit(0))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), stop(i).alias("stop"), F.lower(F.array_join(F.slice(words, i + 1, stop(i) - i), " ")).alias("term"), F.lit("Patient").alias("label")))

    return T.let(hit, runs)


def sentence_entities(sentences: DataFrame, terms: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """``keys``, ``text``, ``words`` and ``ents`` (``start``, ``stop``, ``term``,
    ``label``, by place) of every sentence with an entity. Patient words come first: a
    term that overlaps a run of them is left out. ``keys`` identify the sentences."""
    spans = match_terms(sentences, keys, text, terms, LONGEST_FIRST)
    listed = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "term", "label")).alias("found"))
    rows = sentences.select(*keys, text).join(listed, keys, "left").withColumn("words", T.words(F.col(text)))
    people = patient_runs(F.col("words"))
    free = lambda p: F.filter(F.coalesce("found", F.array().cast("array<struct<start:int,stop:int,term:string,label:string>>")), lambda s: ~F.exists(p, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])))
    return rows.select(*keys, text, "words", T.let(people, lambda p: F.array_sort(F.concat(p, free(p)))).alias("ents")).where(F.size("ents") > 0)


def candidate_pairs(entities: DataFrame, keys: list[str], text: str = "sentence") -> DataFrame:
    """Every candidate pair of :func:`sentence_entities`, with its context.

    Each entity that may be a patient's is paired with the nearest patient before it,
    else the nearest one, else a virtual patient without words at the sentence's start.
    Two other entities that do not overlap are a pair in the direction that the schema
    has, else as read. Result: keys, text, ``e1``, ``type_e1``, ``e1_start``,
    ``e1_stop``, ``e1_is_virtual``, ``e2``, ``type_e2``, ``e2_start``, ``e2_stop``,
    ``reading_order``, ``between``, ``left_context``, ``right_context``, ``token_dist``,
    ``same_clause`` and ``intervening`` (types strictly between, joined by commas).
    """
    rows = entities.select(
        *keys, text, "words",
        F.filter("ents", lambda e: e["label"] == "Patient").alias("people"), F.filter("ents", lambda e: e["label"] != "Patient").alias("others"),
    )
    virtual = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("patient").alias("term"), F.lit("Patient").alias("label"))

    def nearest(t: Column) -> Column:
        order = lambda p: F.struct((p["stop"] > t["start"]).alias("after"), F.when(p["stop"] <= t["start"], t["start"] - p["stop"]).otherwise(F.abs(p["start"] - t["start"])).alias("d"), p["start"].alias("s"), p.alias("p"))
        return F.coalesce(F.array_min(F.transform("people", order))["p"], virtual)

    one = F.transform(F.filter("others", lambda t: _is_pair(F.lit("Patient"), t["label"])), lambda t: F.struct(nearest(t).alias("a"), t.alias("b")))
    turned = lambda a, b: ~_is_pair(a["label"], b["label"]) & _is_pair(b["label"], a["label"])
    pair = lambda a, b: F.when(turned(a, b), F.struct(b.alias("a"), a.alias("b"))).otherwise(F.struct(a.alias("a"), b.alias("b")))
    two = F.flatten(F.transform("others", lambda a, i: F.transform(F.filter(F.slice("others", i + 2, F.size("others")), lambda b: b["start"] >= a["stop"]), lambda b: pair(a, b))))
    pairs = rows.select(*keys, text, "words", "people", "others", F.explode(F.concat(one, two)).alias("p")).select("*", "p.a", "p.b").drop("p")
    forward = F.col("a.start") <= F.col("b.start")
    pairs = pairs.withColumn("forward", forward).withColumn("f", F.when(forward, F.col("a")).otherwise(F.col("b"))).withColumn("s", F.when(forward, F.col("b")).otherwise(F.col("a")))
    size = F.greatest(F.col("s.start") - F.col("f.stop"), F.lit(0))
    left = F.greatest(F.col("f.start") - CONTEXT, F.lit(0))
    between = F.array_join(F.slice("words", F.col("f.stop") + 1, size), " ")
    inside = F.filter("others", lambda e: (e["start"] >= F.col("f.stop")) & (e["stop"] <= F.col("s.start")))
    return pairs.select(
        *keys, text, F.col("a.term").alias("e1"), F.col("a.label").alias("type_e1"), F.col("a.start").alias("e1_start"), F.col("a.stop").alias("e1_stop"),
        ((F.col("a.label") == "Patient") & (F.size("people") == 0)).alias("e1_is_virtual"),
        F.col("b.term").alias("e2"), F.col("b.label").alias("type_e2"), F.col("b.start").alias("e2_start"), F.col("b.stop").alias("e2_stop"),
        F.when(F.col("forward"), "E1_before_E2").otherwise("E2_before_E1").alias("reading_order"), between.alias("between"),
        F.lower(F.array_join(F.slice("words", left + 1, F.col("f.start") - left), " ")).alias("left_context"),
        F.lower(F.array_join(F.slice("words", F.col("s.stop") + 1, F.lit(CONTEXT)), " ")).alias("right_context"),
        size.alias("token_dist"), scope.same_clause(between).alias("same_clause"), F.array_join(F.transform(inside, lambda e: e["label"]), ",").alias("intervening"),
    )


def matched_cues(text: Column) -> Column:
    """Names of the cues of a pair; which text each looks at is part of the rules."""
    c = F.col
    around = F.trim(F.concat_ws(" ", "left_context", "between", "right_context"))
    where = {
        "NEGATION": scope.has(c("between"), scope.PAIR_NEGATION) | scope.has(c("left_context"), scope.PAIR_NEGATION),
        **{n: scope.has(around, scope.CUES[n]) | scope.has(text, scope.CUES[n]) for n in ("FAMILY", "HISTORY")},
        "DIAGNOSED": scope.has(around, scope.CUES["DIAGNOSED"]), "LOCATED": scope.has(c("between"), scope.CUES["LOCATED"]),
        "REVEALS": scope.has(c("between"), scope.CUES["REVEALS"]) | scope.has(c("left_context"), scope.CUES["REVEALS"]),
        "EFFECT": scope.has(around, scope.CUES["EFFECT"]),
    }
    return F.array_join(F.filter(F.array(*[F.when(hit, name) for name, hit in where.items()]), lambda x: x.isNotNull()), ",")


def weak_labels(pairs: DataFrame, text: str = "sentence") -> DataFrame:
    """Candidate pairs with ``cues`` and ``label``: the relation that the rules give,
    or NONE."""
    c = F.col
    rows = pairs.withColumn("cues", matched_cues(F.col(text)))
    cue = lambda name: F.array_contains(F.split("cues", ","), name)
    patient, near = c("type_e1") == "Patient", F.size(F.regexp_extract_all("between", F.lit(r"\S+"), F.lit(0))) <= 3
    negated = scope.has(scope.last_clause(c("between")), scope.PAIR_NEGATION) | ((patient | near) & scope.has(scope.last_clause(c("left_context")), scope.PAIR_NEGATION))
    inside = lambda t: F.array_contains(F.split("intervening", ","), t)
    d, two, clause = c("token_dist"), c("type_e2"), c("same_clause")
    label = (
        F.when(~_is_pair(c("type_e1"), two) | negated, "NONE")
        .when(patient & (two == "Disease"), F.when(cue("FAMILY"), "FAMILIAR_HISTORY").when(cue("HISTORY"), "HISTORY").otherwise("DIAGNOSED_WITH"))
        .when(patient & (two == "Symptom"), F.when(cue("FAMILY"), "NONE").otherwise("PRESENTS_WITH"))
        .when(patient & (two == "Medication"), "TAKES").when(patient, "UNDERWENT_EXAM")
        .when((two == "Anatomy") & ~inside("Anatomy") & ~inside(c("type_e1")) & clause & ((d <= 4) | (cue("LOCATED") & (d <= 10))), "LOCATED_IN")
        .when((c("type_e1") == "Exam") & ~inside("Exam") & ((cue("REVEALS") & (d <= 15)) | (clause & (d <= 8))), "REVEALS")
        .when((c("type_e1") == "Medication") & ~inside("Medication") & (((two == "Effect") & clause & (d <= 10)) | (cue("EFFECT") & (d <= 12))), "HAS_EFFECT")
        .otherwise("NONE")
    )
    return rows.withColumn("label", label)


def edge_summary(labelled: DataFrame) -> DataFrame:
    """``section``, ``name``, ``n``: cases and pairs, pairs by label, and positive pairs
    by types."""
    pos = F.col("label") != "NONE"
    totals = labelled.agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("pairs"), F.count_if(pos).alias("positive"))
    parts = [totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(x).alias("name"), F.col(x).alias("n")) for x in ("cases", "pairs", "positive")])))]
    parts.append(labelled.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("section"), F.col("label").alias("name"), "n"))
    parts.append(labelled.where(pos).groupBy(F.concat("type_e1", F.lit("->"), "type_e2").alias("name")).agg(F.count("*").alias("n")).select(F.lit("types").alias("section"), "name", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def class_scores(rows: DataFrame, truth: str, guess: str, none: str = "NONE") -> DataFrame:
    """``label``, ``support``, ``predicted``, ``tp``, precision, recall and f1 of every
    class but ``none``, with ``macro`` and ``micro`` rows over them. An empty
    denominator gives 0."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = counts.select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("g").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")))))
    per = each.where(F.col("label") != none).groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("tp"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    scored = per.withColumn("p_", share("tp", "predicted")).withColumn("r_", share("tp", "support")).withColumn("f_", f1(F.col("p_"), F.col("r_")))
    sums = [F.sum(x).alias(x) for x in ("support", "predicted", "tp")]
    macro = scored.agg(*sums, *[F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in ("p_", "r_", "f_")]).withColumn("label", F.lit("macro"))
    micro = scored.agg(*sums).withColumn("label", F.lit("micro")).withColumn("p_", share("tp", "predicted")).withColumn("r_", share("tp", "support")).withColumn("f_", f1(F.col("p_"), F.col("r_")))
    return scored.unionByName(macro).unionByName(micro).select(
        "label", "support", "predicted", "tp", F.round("p_", 6).alias("precision"), F.round("r_", 6).alias("recall"), F.round("f_", 6).alias("f1")
    )


def class_confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """``truth``, ``guess``, ``n`` and ``share`` of the rows of that truth."""
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    total = counts.groupBy("truth").agg(F.sum("n").alias("all"))
    return counts.join(total, "truth").select("truth", "guess", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
