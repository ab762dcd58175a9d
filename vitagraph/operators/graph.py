"""Star graphs and candidate pairs from matched entities; graph assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.functions import text as T
from vitagraph.operators import attributes, scope
from vitagraph.operators.matching import LONGEST_FIRST, match_terms
from vitagraph.sources.tables import ranked

# ---- fixed values: types that may be linked, and their relations -------------
VALID_PAIRS = [
    ("Patient", "Disease", ["FAMILIAR_HISTORY", "HISTORY", "DIAGNOSED_WITH"]), ("Patient", "Symptom", ["PRESENTS_WITH"]),
    ("Patient", "Medication", ["TAKES"]), ("Patient", "Exam", ["UNDERWENT_EXAM"]), ("Patient", "Procedure", ["UNDERWENT_EXAM"]),
    ("Disease", "Anatomy", ["LOCATED_IN"]), ("Symptom", "Anatomy", ["LOCATED_IN"]), ("Exam", "Result", ["REVEALS"]),
    ("Medication", "Effect", ["HAS_EFFECT"]), ("Medication", "Symptom", ["HAS_EFFECT"]), ("Medication", "Result", ["HAS_EFFECT"]),
]
RULE_RELATIONS = {
    "dimension": ["REVEALS", "DIAGNOSED_WITH", "LOCATED_IN"], "lenght": ["REVEALS", "DIAGNOSED_WITH", "LOCATED_IN"],
    "weight": ["TAKES", "REVEALS", "HAS_EFFECT", "DIAGNOSED_WITH"], "volume": ["TAKES", "REVEALS", "HAS_EFFECT"],
    "especial": ["REVEALS", "TAKES", "HAS_EFFECT"], "pressure": ["REVEALS", "PRESENTS_WITH"],
    "frequency": ["TAKES", "PRESENTS_WITH", "HAS_EFFECT"],
    "time": ["PRESENTS_WITH", "HISTORY", "FAMILIAR_HISTORY", "UNDERWENT_EXAM", "TAKES", "HAS_EFFECT"],
    "numero_puro": ["UNDERWENT_EXAM", "PRESENTS_WITH", "TAKES", "REVEALS"],
}
# ------------------------------------------------------------------------------


def keep_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """One row for each value of ``subset``: the first by ``order``. A partial
    aggregate over the rows, so repeated rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("f_")
    return df.groupBy(*subset).agg(first).select(*[F.col(c) if c in subset else F.col(f"f_.{c}").alias(c) for c in df.columns])


def star_edges(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges from each case's patient to the entities of its sentences.

    sentences: ``case_id``, ``sent_no``, ``sentence`` (a case and number identify a
    row). Entities are matched longest first, blocked by negation or uncertainty
    near them, and related by the nearest cue; all edges of a sentence carry its
    attributes. Edges equal in all columns are kept once.
    """
    keys = ["case_id", "sent_no"]
    hits = match_terms(sentences, keys, "sentence", terms, LONGEST_FIRST)
    texts = sentences.select(
        *keys, "sentence", T.word_starts(F.col("sentence")).alias("starts"), scope.cue_positions(F.col("sentence")).alias("cues"),
        attributes.sentence_attributes(F.col("sentence")).alias("attributes"),
    )
    at = F.get("starts", F.col("start"))
    rows = hits.join(texts, keys).withColumn("at", at).where(~scope.blocked_in_window(F.col("sentence"), F.col("at")))
    edges = rows.select(
        F.concat(F.lit("P:"), F.col("case_id")).alias("source_id"), T.node_id(F.col("label"), F.col("term")).alias("target_id"),
        scope.nearest_relation(F.col("cues"), F.col("label"), F.col("at")).alias("relation"), "attributes", "case_id",
        F.col("sent_no").alias("sentence_number"), "sentence", F.col("term").alias("label"), F.col("label").alias("type"),
    )
    return edges.distinct()


def star_nodes(edges: DataFrame) -> DataFrame:
    """Patients and entities of star edges, one row for each node id."""
    patients = edges.select(F.col("source_id").alias("node_id"), F.col("case_id").alias("label"), F.lit("Patient").alias("type")).distinct()
    entities = edges.groupBy(F.col("target_id").alias("node_id")).agg(F.min("label").alias("label"), F.min("type").alias("type"))
    return patients.unionByName(entities)


def nearest_anchor(targets: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Each target with its closest preceding anchor, else the closest one.

    targets, anchors: ``keys``, ``start``, ``stop``. Targets without an anchor in
    their sentence keep nulls. The join is on the sentence.
    """
    a = anchors.select(*keys, F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
    gap = F.abs(F.col("start") - F.col("a_start"))
    order = F.struct((~(F.col("a_stop") <= F.col("start"))).alias("after"), gap.alias("gap"), F.col("a_start").alias("s"))
    every = [c for c in targets.columns]
    return targets.join(a, keys, "left").groupBy(*every).agg(F.min_by(F.struct("a_start", "a_stop"), order).alias("m")).select(*every, "m.a_start", "m.a_stop")


def bind_quantities(quantities: DataFrame, edges: DataFrame, keys: list[str], most: int = 110) -> DataFrame:
    """Each quantity with the nearest edge of its sentence whose relation fits its
    rule, else the nearest of any, within ``most`` characters, and its ordinal there.

    quantities: ``keys``, ``q_start``, ``q_end``, ``value``, ``unit``, ``matched_rule``.
    edges: ``keys``, ``edge``, ``relation``, ``e_start``, ``e_end``.
    """
    fits = F.create_map(*[x for k, v in RULE_RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    gap = F.greatest(F.lit(0), F.col("e_start") - F.col("q_end"), F.col("q_start") - F.col("e_end"))
    ok = F.array_contains(F.try_element_at(fits, F.col("matched_rule")), F.col("relation"))
    q = [c for c in quantities.columns]
    near = quantities.join(edges, keys).withColumn("gap", gap).where(F.col("gap") <= most)
    best = near.groupBy(*q).agg(F.min_by("edge", F.struct((~F.coalesce(ok, F.lit(False))).alias("x"), F.col("gap"), F.col("edge"))).alias("edge"))
    return best.withColumn("n", F.row_number().over(W.partitionBy(*keys, "edge").orderBy("q_start", "value")))


def number_nodes(entities: DataFrame, order: list[str]) -> DataFrame:
    """``node_id`` (prefix and count by type in first-seen order), ``type``, ``label``
    of entities with ``label``, ``type``: one node for each (lower label, type)."""
    first = entities.where("label is not null").groupBy(F.lower("label").alias("low"), "type").agg(F.min(F.struct(*order, "label")).alias("f"))
    prefix = F.create_map(*[F.lit(x) for p in T.NODE_PREFIX.items() for x in p])
    placed = first.select("type", "low", F.col("f.label").alias("label"), *[F.col(f"f.{o}").alias(f"o_{i}") for i, o in enumerate(order)])
    found = ranked(placed, ["type"], [*[f"o_{i}" for i in range(len(order))], "low"], "rank")
    return found.select(F.concat(F.coalesce(F.try_element_at(prefix, F.col("type")), F.lit("N")), F.col("rank").cast("string")).alias("node_id"), "type", "label")
