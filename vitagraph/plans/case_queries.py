"""Queries of the case graphs of learned edges, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.operators import attributes as X
from vitagraph.operators import casegraph as C
from vitagraph.plans.clinical_queries import _FITS_SQL, case_sentences, quantities_sql
from vitagraph.plans.edge_queries import _KEYS, _PAIRS, entities, labelled
from vitagraph.sources.tables import checkpointed, latest_by, table


def _positive(spark, sf_dir):
    return labelled(spark, sf_dir).where("label <> 'NONE'")


def _cases(spark, sf_dir):
    return latest_by(table(spark, sf_dir, "cases"), "case_id", "age", "gender")


def nodes(spark, sf_dir):
    return C.case_nodes(entities(spark, sf_dir), _cases(spark, sf_dir))


def _bound(spark, sf_dir, edges):
    q = X.typed_quantities(case_sentences(spark, sf_dir), _KEYS, "sentence")
    return C.bind_quantities(C.edge_places(edges), q)


def bound(spark, sf_dir):
    """Quantities with their edges, and their number at the edge."""
    return _bound(spark, sf_dir, checkpointed(_positive(spark, sf_dir)))


def edges(spark, sf_dir):
    """Edges of all cases between their nodes, with their quantities."""
    e = checkpointed(_positive(spark, sf_dir))
    return C.case_edges(e, nodes(spark, sf_dir), C.quantity_attributes(_bound(spark, sf_dir, e)))


def hydrated(spark, sf_dir):
    """Positions found again of edges that kept only their texts."""
    e = _positive(spark, sf_dir).select("case_id", "e1", "e2", "label", "between").distinct()
    return C.hydrate(e, case_sentences(spark, sf_dir))


def numeric(spark, sf_dir):
    """Relations of the edges that hold a value, with their values."""
    found = edges(spark, sf_dir).withColumn("value", F.regexp_extract("attributes", r"(?:^|; )value=([^;]*)", 1)).where("value <> ''")
    return found.select("case_id", "from_node", "to_node", "relation", "value")


_GRAPH = f"""{_PAIRS}, pos as (select * from lb where label <> 'NONE'), {quantities_sql("n", "case_id, sent_no")},
 cx as (select case_id, sent_no, string_split(regexp_replace(sentence, '([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p from n),
 pl as (select pos.case_id, pos.sent_no, cast(a0 as integer) as e1_start, cast(b0 as integer) as e2_start, label, virt, cast(length(array_to_string(p[1:2*a0+1], '')) as integer) as a_from, cast(length(array_to_string(p[1:2*a1], '')) as integer) as a_to,
   cast(length(array_to_string(p[1:2*b0+1], '')) as integer) as b_from, cast(length(array_to_string(p[1:2*b1], '')) as integer) as b_to from pos join cx on cx.case_id = pos.case_id and cx.sent_no = pos.sent_no),
 nr as (select q3.*, e1_start, e2_start, label, virt, least(greatest(0, b_from - q_end, q_start - b_to), case when virt then null else greatest(0, a_from - q_end, q_start - a_to) end) as gap from q3 join pl on pl.case_id = q3.case_id and pl.sent_no = q3.sent_no),
 bt as (select *, row_number() over (partition by case_id, sent_no, q_start, q_end, value, unit, matched_rule, quantity order by not ({_FITS_SQL}), gap, not virt, e1_start, e2_start) as rn from nr),
 bd as (select case_id, sent_no, e1_start, e2_start, value, unit, matched_rule, quantity, cast(row_number() over (partition by case_id, sent_no, e1_start, e2_start order by q_start, q_end) as integer) as n from bt where rn = 1 and gap <= 110),
 qa as (select case_id, sent_no, e1_start, e2_start, max(case when n = 1 then quantity end) as quantity, string_agg(concat_ws('; ', case when value <> '' then 'value' || t || value end, case when unit <> '' then 'unit' || t || unit end, 'type' || t || matched_rule, case when n = 1 then 'quantity=' || quantity end), '; ' order by n) as attributes
   from (select *, case when n = 1 then '=' else '_' || n || '=' end as t from bd) group by 1, 2, 3, 4),
 nd as (select case_id, label, type, cast(row_number() over (partition by case_id order by a) as integer) as node from (select case_id, term as label, label as type, min({{'s': sent_no, 'w': start}}) as a from en group by 1, 2, 3)),
 cr as (select case_id, age, gender from (select *, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from cases where case_id is not null) where rn = 1),
 ge as (select pos.case_id, case when type_e1 = 'Patient' then 0 else x.node end as from_node, y.node as to_node, pos.label as relation, coalesce(quantity, '') as quantity, coalesce(attributes, '') as attributes, pos.sent_no, a0, b0
   from pos left join qa on qa.case_id = pos.case_id and qa.sent_no = pos.sent_no and qa.e1_start = a0 and qa.e2_start = b0 left join nd x on x.case_id = pos.case_id and x.type = type_e1 and x.label = e1 join nd y on y.case_id = pos.case_id and y.type = type_e2 and y.label = e2),
 gd as (select case_id, from_node, to_node, relation, quantity, first(attributes order by sent_no, a0, b0) as attributes from ge where from_node is not null group by 1, 2, 3, 4, 5)"""
_HYDRATE = f"""with {_PAIRS}, e as (select distinct case_id, e1, e2, label, btw from lb where label <> 'NONE'),
 c as (select e.*, n.sent_no, sentence, strpos(lower(sentence), lower(e2)) as at2, row_number() over (partition by e.case_id, e1, e2, label, btw order by case when contains(lower(sentence), lower(e2)) then case when contains(lower(sentence), lower(btw)) then 0 else 1 end else 2 end, n.sent_no) as rn from e join n on n.case_id = e.case_id),
 d as (select *, substr(sentence, 1, greatest(at2 - 1, 0)) as bef from c where rn = 1)
 select case_id, e1, e2, label, btw as "between", sent_no, cast(case when at2 > 0 then len(regexp_extract_all(bef, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) - case when regexp_matches(bef, '[A-Za-z0-9]$') then 1 else 0 end else 0 end as integer) as e2_start from d"""

QUERIES = {
    "g15_case_nodes": (
        nodes,
        f"with {_GRAPH} select case_id, 0 as node, 'Patient' as type, 'Patient (' || case_id || ')' as label, concat_ws('; ', 'case_id=' || case_id, 'age=' || cast(case when not isnan(age) then age end as varchar), 'gender=' || gender) as attributes from cr union all select case_id, node, type, label, '' from nd",
    ),
    "j9_bound_quantities": (bound, f"with {_GRAPH} select case_id, sent_no, e1_start, e2_start, value, unit, matched_rule, quantity, n from bd"),
    "g15_case_edges": (edges, f"with {_GRAPH} select case_id, from_node, to_node, relation, attributes from gd"),
    "u4_edge_dedupe": (
        lambda s, d: edges(s, d).groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("case_id").alias("cases")),
        f"with {_GRAPH} select relation, count(*) as edges, count(distinct case_id) as cases from gd group by relation",
    ),
    "g20_edge_values": (numeric, f"with {_GRAPH} select case_id, from_node, to_node, relation, regexp_extract(attributes, '(?:^|; )value=([^;]*)', 1) as value from gd where regexp_extract(attributes, '(?:^|; )value=([^;]*)', 1) <> ''"),
    "j10_hydrated_edges": (hydrated, _HYDRATE),
}
