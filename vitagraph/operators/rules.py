"""Rule graph of case sentences: typed entities, attributes bound by distance, edges.

Everything of a sentence lies in one row of arrays, so all rules are expressions over
that row; the plan has the matching join and one aggregate per sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.operators import attributes as X
from vitagraph.operators import scope
from vitagraph.operators.matching import LEFT_TO_RIGHT, match_terms

#: Farthest characters from a size to its result, and from a lab value to the result before it.
SIZE_REACH, LAB_REACH = 30, 60


def _spans(text: Column, pattern: str) -> Column:
    """``array<struct<at, stop, text>>`` of a pattern's matches."""
    cut = F.split(F.regexp_replace(text, f"(?i)({pattern})", "\u0001$0\u0001"), "\u0001", -1)
    return F.aggregate(
        cut,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<at:int,stop:int,text:string>>").alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"), (acc["i"] + 1).alias("i"),
            F.when(acc["i"] % 2 == 1, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), (acc["at"] + F.length(p)).alias("stop"), p.alias("text")))))
            .otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )


_SIZES = rf"(?:{X.SIZE_3D}|{X.SIZE_2D}|{X.SIZE_1D})".replace("(cm|mm)", "(?:cm|mm)").replace(r"(\d+", r"(?:\d+")


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a["at"] - b["stop"], b["at"] - a["stop"])


def _nearest(spans: Column, score) -> Column:
    """The first span of least score, or null."""
    return F.array_min(F.transform(spans, lambda s: F.struct(score(s).alias("d"), s["at"].alias("at"), s.alias("s"))))


def sentence_entities(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """``case_id``, ``sent_no``, ``sentence`` and ``ents`` (``label``, ``term``, ``at``,
    ``stop``: the term's first place in the text), without negated entities."""
    keys = ["case_id", "sent_no"]
    hits = match_terms(sentences, keys, "sentence", terms, LEFT_TO_RIGHT)
    at = F.instr(F.lower("sentence"), F.col("term")) - 1
    rows = hits.join(sentences.select(*keys, "sentence"), keys).where(~scope.negated_in_clause(F.col("sentence"), F.col("term")))
    ent = F.struct("start", "label", "term", at.alias("at"), (at + F.length("term")).alias("stop"))
    return rows.groupBy(*keys, "sentence").agg(F.array_sort(F.collect_list(ent)).alias("ents"))


# ---- fixed values of the variant: sentences it skips, and words that tell of a symptom
SKIPPED = ["non-contributory", "were normal"]
TELLING = ["presented", "history", "pain", "complained", "had", "symptom"]
# ------------------------------------------------------------------------------------


def variant_edges(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """:func:`rule_edges` of the stricter variant, with ``target_attributes``: sentences
    that say nothing new are skipped, symptoms need a telling word in their sentence,
    and a result's attributes are those of its node instead of the edge's."""
    low = F.lower("sentence")
    kept = sentences
    for words in SKIPPED:
        kept = kept.where(~F.contains(low, F.lit(words)))
    told = kept.select("case_id", "sent_no", low.rlike("|".join(TELLING)).alias("told_"))
    rows = rule_edges(kept, terms).join(told, ["case_id", "sent_no"]).where((F.col("rule") != "symptom") | F.col("told_")).drop("told_")
    reveals = F.col("relation") == "REVEALS"
    return rows.withColumn("target_attributes", F.when(reveals, F.col("attributes")).otherwise("")).withColumn("attributes", F.when(reveals, "").otherwise(F.col("attributes")))


def rule_edges(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges by the sentence rules: ``case_id``, ``sent_no``, ``rule``, ``source``,
    ``source_type``, ``target``, ``target_type``, ``relation``, ``attributes``.

    Symptoms: PRESENTS_WITH with the duration; pains LOCATED_IN the sentence's
    anatomy. Medications: TAKES with the dose nearest to the drug, the first one where the
    drug does not stand literally. Exams: UNDERWENT_EXAM with the
    timeline, REVEALS each result with its size, lab values and status, and results
    LOCATED_IN anatomy, once for each exam. Diseases: history or DIAGNOSED_WITH, and
    LOCATED_IN. Edges are a multiset: repeats are kept.
    """
    c = F.col
    text, low = c("sentence"), F.lower("sentence")
    kind = lambda t: F.filter("ents", lambda e: e["label"] == t)
    base = sentence_entities(sentences, terms).select(
        "*", *[kind(t).alias(t.lower()) for t in ("Symptom", "Disease", "Exam", "Result", "Anatomy", "Medication")],
        _spans(text, _SIZES).alias("sizes"), _spans(text, X.LAB).alias("labs"), _spans(text, X.DOSAGE).alias("doses"), *X.modifiers(text)[:4],
    )
    attr = lambda name, col: F.coalesce(F.concat(F.lit(f"{name}="), c(col)), F.lit(""))
    placed = lambda r: r["at"] >= 0

    def result_attributes(r: Column) -> Column:
        mine = F.filter("sizes", lambda s: (_nearest(F.filter("result", placed), lambda o: _gap(o, s))["s"]["term"] == r["term"]) & (_gap(r, s) < SIZE_REACH))
        last = F.try_element_at(mine, F.lit(-1))["text"]
        values = F.filter("labs", lambda v: _nearest(F.filter("result", lambda o: placed(o) & (o["stop"] <= v["at"])), lambda o: v["at"] - o["stop"])["s"]["term"] == r["term"])
        near = F.filter(values, lambda v: v["at"] - r["stop"] < LAB_REACH)
        lab = F.transform(near, lambda v: F.concat(F.lit("value="), F.regexp_extract(v["text"], "(?i)" + X.LAB, 1), F.lit("; unit="), F.regexp_extract(v["text"], "(?i)" + X.LAB, 2)))
        status = F.when(F.contains(low, F.lit("normal")) & F.contains(r["term"], F.lit("echotexture")), "status=normal")
        return F.array_join(F.concat(F.array(F.concat(F.lit("size="), last)), lab, F.array(status)), "; ")

    def edge(rule, source, source_type, target, target_type, relation, attributes) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), source.alias("source"), F.lit(source_type).alias("source_type"), target.alias("target"), F.lit(target_type).alias("target_type"),
            (relation if isinstance(relation, Column) else F.lit(relation)).alias("relation"), attributes.alias("attributes"),
        )

    me = F.concat(F.lit("P:"), c("case_id"))
    history = F.contains(low, F.lit("history")) & (F.contains(low, F.lit("medical")) | F.contains(low, F.lit("past")))
    status = (
        F.when(history, "").when(F.contains(low, F.lit("pathology")), "status=confirmed; method=pathology")
        .when(low.rlike("suggesting|suspected"), "status=suspected; method=clinical/imaging").otherwise("status=confirmed")
    )
    known = F.when(~history, "DIAGNOSED_WITH").when(F.contains(low, F.lit("family")), "HAS_FAMILY_HISTORY").otherwise("HAS_PERSONAL_HISTORY")
    nearest_dose = lambda m: F.coalesce(F.concat(F.lit("dosage="), _nearest(c("doses"), lambda d: F.when(placed(m), F.abs(d["at"] - m["stop"])).otherwise(d["at"]))["s"]["text"]), F.lit(""))
    located = lambda rule, e, t, a: F.transform("anatomy", lambda x: edge(rule, e["term"], t, x["term"], "Anatomy", "LOCATED_IN", a))
    edges = F.concat(
        F.transform("symptom", lambda s: edge("symptom", me, "Patient", s["term"], "Symptom", "PRESENTS_WITH", attr("duration", "duration"))),
        F.flatten(F.transform(F.filter("symptom", lambda s: F.contains(s["term"], F.lit("pain"))), lambda s: located("symptom", s, "Symptom", attr("laterality", "laterality")))),
        F.transform("medication", lambda m: edge("medication", me, "Patient", m["term"], "Medication", "TAKES", nearest_dose(m))),
        F.transform("exam", lambda x: edge("exam", me, "Patient", x["term"], "Exam", "UNDERWENT_EXAM", attr("timeline", "pod"))),
        F.flatten(F.transform("exam", lambda x: F.transform("result", lambda r: edge("exam", x["term"], "Exam", r["term"], "Result", "REVEALS", result_attributes(r))))),
        F.flatten(F.transform("exam", lambda x: F.flatten(F.transform("result", lambda r: located("exam", r, "Result", attr("aspect", "aspect")))))),
        F.transform("disease", lambda d: edge("disease", me, "Patient", d["term"], "Disease", known, status)),
        F.flatten(F.transform("disease", lambda d: located("disease", d, "Disease", attr("aspect", "aspect")))),
    )
    return base.select("case_id", "sent_no", F.explode(edges).alias("e")).select("case_id", "sent_no", "e.*")
