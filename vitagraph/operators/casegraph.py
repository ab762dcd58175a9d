"""Graph of a case from its entities and its positive edges: nodes, quantities, edges.

All steps are joins and aggregates on the case and sentence, over all cases at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.functions import text as T
from vitagraph.operators.graph import RULE_RELATIONS

_EDGE = ["case_id", "sent_no", "e1_start", "e2_start"]


def case_nodes(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_id``, ``node``, ``type``, ``label``, ``attributes``: node 0 is the patient
    with age and gender, the others are the case's different (term, type) in the order in
    which they are first mentioned. entities: ``case_id``, ``sent_no``, ``ents``; cases:
    ``case_id``, ``age``, ``gender``, one row a case."""
    text = F.concat_ws("; ", F.concat(F.lit("case_id="), "case_id"), F.concat(F.lit("age="), F.when(~F.isnan("age"), F.col("age")).cast("string")), F.concat(F.lit("gender="), "gender"))
    root = cases.select("case_id", F.lit(0).alias("node"), F.lit("Patient").alias("type"), F.concat(F.lit("Patient ("), "case_id", F.lit(")")).alias("label"), text.alias("attributes"))
    said = entities.select("case_id", "sent_no", F.explode("ents").alias("e")).where("e.label <> 'Patient'")
    first = said.groupBy("case_id", F.col("e.term").alias("label"), F.col("e.label").alias("type")).agg(F.min(F.struct("sent_no", "e.start")).alias("at"))
    order = W.partitionBy("case_id").orderBy("at.sent_no", "at.start")  # a case's different terms
    return root.unionByName(first.select("case_id", F.row_number().over(order).alias("node"), "type", "label", F.lit("").alias("attributes")))


def edge_places(edges: DataFrame, text: str = "sentence") -> DataFrame:
    """Edges with ``a_from``, ``a_to``, ``b_from`` and ``b_to``: the characters of both
    ends in their sentence; a virtual patient has none."""
    starts, words = T.word_starts(F.col(text)), T.words(F.col(text))
    stop = lambda i: F.get("st_", i - 1) + F.length(F.get("w_", i - 1))
    rows = edges.withColumn("st_", starts).withColumn("w_", words)
    real = ~F.col("e1_is_virtual")
    return rows.select(
        *edges.columns, F.when(real, F.get("st_", F.col("e1_start"))).alias("a_from"), F.when(real, stop(F.col("e1_stop"))).alias("a_to"),
        F.get("st_", F.col("e2_start")).alias("b_from"), stop(F.col("e2_stop")).alias("b_to"),
    )


def bind_quantities(edges: DataFrame, quantities: DataFrame, most: int = 110) -> DataFrame:
    """``case_id``, ``sent_no``, ``e1_start``, ``e2_start``, ``n``, ``value``, ``unit``,
    ``matched_rule``, ``quantity``: each quantity at the nearest edge of its sentence
    whose relation fits its rule, else of any; the distance is that to the nearer end,
    and farther than ``most`` characters it is left out. ``n`` counts an edge's
    quantities from 1. edges: from :func:`edge_places`, with ``label``; quantities:
    ``case_id``, ``sent_no``, ``q_start``, ``q_end`` and the four columns above."""
    fits = F.create_map(*[x for k, v in RULE_RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    gap = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col("q_end"), F.col("q_start") - F.col(b))
    near = F.least(gap("b_from", "b_to"), F.when(F.col("a_from").isNotNull(), gap("a_from", "a_to")))
    ok = F.coalesce(F.array_contains(F.try_element_at(fits, F.col("matched_rule")), F.col("label")), F.lit(False))
    q = ["case_id", "sent_no", "q_start", "q_end", "value", "unit", "matched_rule", "quantity"]
    mine = edges.select(*_EDGE, "label", "a_from", "a_to", "b_from", "b_to")
    rows = quantities.select(*q).join(mine, ["case_id", "sent_no"]).withColumn("gap", near)
    best = F.min(F.struct((~ok).alias("odd"), F.col("gap"), (F.col("a_from").isNotNull()).alias("named"), F.col("e1_start"), F.col("e2_start"))).alias("m")
    chosen = rows.groupBy(*q).agg(best).where(F.col("m.gap") <= most)
    order = W.partitionBy(*_EDGE).orderBy("q_start", "q_end")
    return chosen.select("case_id", "sent_no", "m.e1_start", "m.e2_start", "q_start", "q_end", "value", "unit", "matched_rule", "quantity").withColumn("n", F.row_number().over(order)).drop("q_start", "q_end")


def quantity_attributes(bound: DataFrame) -> DataFrame:
    """``case_id``, ``sent_no``, ``e1_start``, ``e2_start``, ``quantity`` (the first) and
    ``attributes``: ``value``, ``unit``, ``type`` and ``quantity``, of further ones
    ``value_2`` and so on; empty ones are left out."""
    listed = bound.groupBy(*_EDGE).agg(F.array_sort(F.collect_list(F.struct("n", "value", "unit", "matched_rule", "quantity"))).alias("q"))

    def named(x: Column) -> Column:
        tail = F.when(x["n"] == 1, "=").otherwise(F.concat(F.lit("_"), x["n"].cast("string"), F.lit("=")))
        part = lambda name, v: F.when(v != "", F.concat(F.lit(name), tail, v))
        return F.concat_ws("; ", part("value", x["value"]), part("unit", x["unit"]), part("type", x["matched_rule"]), F.when(x["n"] == 1, part("quantity", x["quantity"])))

    return listed.select(*_EDGE, F.get("q", F.lit(0))["quantity"].alias("quantity"), F.array_join(F.transform("q", named), "; ").alias("attributes"))


def case_edges(edges: DataFrame, nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """``case_id``, ``from_node``, ``to_node``, ``relation``, ``attributes``: edges whose
    ends are nodes, once for each relation and quantity text, the first in the text.
    A patient's end is node 0; an edge with ``confidence`` keeps it as an attribute."""
    ids = nodes.select("case_id", "node", "type", F.col("label").alias("term"))
    end = lambda k: ids.select("case_id", F.col("node").alias(f"n{k}"), F.col("type").alias(f"type_e{k}"), F.col("term").alias(f"e{k}"))
    rows = edges.join(attributes, _EDGE, "left").join(end(1).where("type_e1 <> 'Patient'"), ["case_id", "type_e1", "e1"], "left").join(end(2), ["case_id", "type_e2", "e2"])
    one = F.when(F.col("type_e1") == "Patient", 0).otherwise(F.col("n1"))
    more = [F.concat(F.lit("confidence="), F.col("confidence").cast("string"))] if "confidence" in edges.columns else []
    rows = rows.select(
        "case_id", one.alias("from_node"), F.col("n2").alias("to_node"), F.col("label").alias("relation"), F.coalesce("quantity", F.lit("")).alias("quantity"),
        F.concat_ws("; ", F.when(F.col("attributes") != "", F.col("attributes")), *more).alias("attributes"), F.struct("sent_no", "e1_start", "e2_start").alias("at"),
    ).where("from_node is not null")
    return rows.groupBy("case_id", "from_node", "to_node", "relation", "quantity").agg(F.min_by("attributes", "at").alias("attributes")).drop("quantity")


def hydrate(edges: DataFrame, sentences: DataFrame) -> DataFrame:
    """Positions of edges that have lost them: ``sent_no`` and ``e2_start`` (a word's
    number). The sentence is the first that holds ``e2`` and ``between``, else the first
    that holds ``e2``, else the first; a term not found stands at 0. edges: ``case_id``,
    ``e2``, ``between`` and others; sentences: ``case_id``, ``sent_no``, ``sentence``.
    A case's sentences are one array beside its edges, so nothing is paired."""
    listed = sentences.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))).alias("s_"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    has = F.filter("s_", lambda s: F.contains(F.lower(s["sentence"]), low("e2")) & (low("e2") != ""))
    both = F.filter(has, lambda s: F.contains(F.lower(s["sentence"]), low("between")))
    rows = edges.join(listed, "case_id").withColumn("h_", F.coalesce(F.get(both, F.lit(0)), F.get(has, F.lit(0)), F.get("s_", F.lit(0))))
    at = F.when(low("e2") != "", F.instr(F.lower("h_.sentence"), low("e2"))).otherwise(0)
    before = F.substr(F.col("h_.sentence"), F.lit(1), F.greatest(at - 1, F.lit(0)))
    # a word that the term begins inside of is not before it
    inside = before.rlike("[A-Za-z0-9]$")
    start = F.when(at > 0, F.size(T.words(before)) - inside.cast("int")).otherwise(0)
    return rows.select(*edges.columns, F.col("h_.sent_no").alias("sent_no"), start.alias("e2_start"))
