"""Negation, uncertainty and cue words, as expressions over a sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: cue words -------------------------------------------------
CONTRAST = r"\b(?:but|however|although)\b"
NEGATED_AFTER = r"(?:no\s+evidence\s+of|negative\s+for|free\s+of|denies|denied|without|resolution\s+of|resolved|uninvolved)\s+([^.,;]+)"
WINDOW_NEGATION = r"\b(?:no|not|without|denies|denied|negative for|free of|unremarkable|non-contributory|nonoperable)\b"
WINDOW_UNCERTAINTY = r"\b(?:possible|possibly|probable|probably|suspected|suspicion|suggestive of|thought to be|may|might|could)\b"
PAIR_NEGATION = (
    r"\b(?:no|not|without|denies|denied|negative\s+for|free\s+of|unremarkable|non-contributory|ruled\s+out|absence\s+of|neither|nor|declined|refused)\b"
)
CLAUSE_BARRIER = r"\b(?:but|however|although|though|whereas|except|yet)\b|[;:]"
CUES = {
    "FAMILY": r"\b(?:family\s+history|familial|familiar|mother|father|sister|brother|maternal|paternal|parents|grandmother|grandfather|son|daughter|hereditary)\b",
    "HISTORY": r"\b(?:history\s+of|past\s+medical|medical\s+history|previously|prior|former|childhood|chronic|known|long-standing|years\s+ago|months\s+ago|had\s+a\s+history|underlying|pre-existing)\b",
    "DIAGNOSED": r"\b(?:diagnosed|diagnosis|consistent\s+with|confirmed|confirming|final\s+diagnosis|pathology\s+revealed|biopsy\s+confirmed|suffered\s+from)\b",
    "LOCATED": r"\b(?:in|of|on|at|within|from|to|into|throughout|involving|affecting|located|arising|adherent|extending|region|wall|lobe|tract|cavity)\b",
    "REVEALS": r"\b(?:revealed|reveals|showed|shows|demonstrated|demonstrates|confirmed|found|detected|identified|indicated|noted|seen|visualized|yielded|positive\s+for|consistent\s+with|evidence\s+of)\b",
    "EFFECT": r"\b(?:caused|causes|induced|induces|led\s+to|resulted\s+in|relieved|improved|resolved|alleviated|controlled|reduced|worsened|adverse|side\s+effect|reaction\s+to|secondary\s+to|following\s+administration|response\s+to|after\s+receiving|after\s+taking)\b",
}
RELATION_CUES = {
    "HAS_HISTORY": r"\b(?:history|historical|previously|past)\b",
    "PRESENTS_WITH": r"\b(?:presented|presents|complaint|pain|nausea|vomit)\w*\b",
    "DIAGNOSED_WITH": r"\b(?:diagnos\w*|consistent with|suggesting the diagnosis|pathology revealed|confirmed)\b",
    "UNDERWENT_EXAM": r"\b(?:underwent|performed|imaging|scan|study|endoscopy|examination|biopsy)\w*\b",
    "TAKES": r"\b(?:takes|taking|started on|treated with|received|medication|therapy)\b",
    "LOCATED_IN": r"\b(?:in|within|from|arising from|located|adherent to|between)\b",
}
ALLOWED_RELATIONS = {
    "Disease": ["HAS_HISTORY", "PRESENTS_WITH", "DIAGNOSED_WITH", "LOCATED_IN"],
    "Symptom": ["HAS_HISTORY", "PRESENTS_WITH", "LOCATED_IN"],
    "Exam": ["UNDERWENT_EXAM"], "Procedure": ["UNDERWENT_EXAM"], "Medication": ["HAS_HISTORY", "TAKES"],
    "Result": ["UNDERWENT_EXAM", "DIAGNOSED_WITH"], "Anatomy": ["LOCATED_IN"], "Effect": ["PRESENTS_WITH"],
}
DEFAULT_RELATION = {
    "Disease": "DIAGNOSED_WITH", "Symptom": "PRESENTS_WITH", "Exam": "UNDERWENT_EXAM", "Procedure": "UNDERWENT_EXAM",
    "Medication": "TAKES", "Anatomy": "LOCATED_IN",
}
# ------------------------------------------------------------------------------


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def negated_in_clause(text: Column, entity: Column) -> Column:
    """Whether the entity stands after a clause's first negation, up to a stop."""
    return F.exists(
        F.split(text, "(?i)" + CONTRAST),
        lambda c: F.contains(F.lower(F.regexp_extract(c, "(?i)" + NEGATED_AFTER, 1)), F.lower(entity)) & has(c, NEGATED_AFTER),
    )


def blocked_in_window(text: Column, position: Column) -> Column:
    """Negation in the 60 characters before a position (from 0), or uncertainty from
    35 before to 90 after it."""
    before = F.substr(text, F.greatest(position - 60, F.lit(0)) + 1, F.least(position, F.lit(60)))
    around = F.substr(text, F.greatest(position - 35, F.lit(0)) + 1, F.least(position, F.lit(35)) + 90)
    return has(before, WINDOW_NEGATION) | has(around, WINDOW_UNCERTAINTY)


def last_clause(between: Column) -> Column:
    return F.element_at(F.split(between, "(?i)" + CLAUSE_BARRIER), -1)


def negated_pair(left: Column, between: Column, patient_edge: Column) -> Column:
    """Negation after the last barrier between two entities, or to the left of a
    patient's edge or of two entities with at most three words between them."""
    near = patient_edge | (F.size(F.regexp_extract_all(between, F.lit(r"\S+"), F.lit(0))) <= 3)
    return has(last_clause(between), PAIR_NEGATION) | (near & has(left, PAIR_NEGATION))


def same_clause(between: Column) -> Column:
    return ~has(between, CLAUSE_BARRIER)


def cue_positions(text: Column) -> Column:
    """``array<struct<relation, at>>`` of all relation cues (``at`` from 0)."""
    def places(relation: str, pattern: str) -> Column:
        cut = F.split(F.regexp_replace(text, "(?i)(" + pattern + ")", "\u0001$1\u0001"), "\u0001", -1)
        start = F.aggregate(
            cut,
            F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("found")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p)).alias("at"), (acc["i"] + 1).alias("i"),
                F.when(acc["i"] % 2 == 1, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"]).alias("found"),
            ),
            lambda acc: acc["found"],
        )
        return F.transform(start, lambda a: F.struct(F.lit(relation).alias("relation"), a.alias("at")))

    return F.concat(*[places(r, p) for r, p in RELATION_CUES.items()])


def nearest_relation(cues: Column, category: Column, position: Column) -> Column:
    """The allowed relation whose cue is nearest (ties by name), else the type's
    default, else MENTIONS."""
    allowed = F.create_map(*[x for k, v in ALLOWED_RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fallback = F.create_map(*[F.lit(x) for p in DEFAULT_RELATION.items() for x in p])
    mine = F.coalesce(F.try_element_at(allowed, category), F.array(*map(F.lit, RELATION_CUES)))
    near = F.transform(F.filter(cues, lambda c: F.array_contains(mine, c["relation"])), lambda c: F.struct(F.abs(c["at"] - position).alias("d"), c["relation"].alias("r")))
    return F.coalesce(F.array_min(near)["r"], F.try_element_at(fallback, category), F.lit("MENTIONS"))
