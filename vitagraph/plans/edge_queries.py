"""Queries on candidate pairs of entities, their labels and features, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.operators import edgemodel as Y
from vitagraph.operators import edges as P
from vitagraph.operators import learn as L
from vitagraph.operators import scope as R
from vitagraph.operators.graph import VALID_PAIRS
from vitagraph.operators.matching import PATIENT_WORDS
from vitagraph.plans.clinical_queries import _NUMBERED, _TEXTS, _greedy_sql, _q, _wordy, case_sentences, lexicon
from vitagraph.plans.text_queries import LEMMA_SQL
from vitagraph.sources.tables import checkpointed, table

_KEYS = ["case_id", "sent_no"]


def entities(spark, sf_dir):
    return P.sentence_entities(case_sentences(spark, sf_dir), lexicon(spark, sf_dir), _KEYS)


def labelled(spark, sf_dir):
    return P.weak_labels(P.candidate_pairs(entities(spark, sf_dir), _KEYS))


def pairs(spark, sf_dir):
    return P.candidate_pairs(entities(spark, sf_dir), _KEYS).select(*_KEYS, "e1", "type_e1", "e1_start", "e1_stop", "e2", "type_e2", "e2_start", "e2_stop", "reading_order")


def virtual(spark, sf_dir):
    """Pairs whose patient is implied, by the type of their entity."""
    p = P.candidate_pairs(entities(spark, sf_dir), _KEYS).where("type_e1 = 'Patient'")
    return p.groupBy("type_e2").agg(F.count_if("e1_is_virtual").alias("implied"), F.count("*").alias("pairs"))


def records(spark, sf_dir):
    return P.candidate_pairs(entities(spark, sf_dir), _KEYS).select(*_KEYS, "e1_start", "e2_start", "e1_is_virtual", "between", "left_context", "right_context", "token_dist", "same_clause", "intervening")


def positives(spark, sf_dir):
    return labelled(spark, sf_dir).where("label <> 'NONE'").groupBy("label").agg(F.count("*").alias("edges"), F.count_distinct("case_id").alias("cases"))


def features(spark, sf_dir):
    f = L.pair_features(labelled(spark, sf_dir))
    return f.select(*_KEYS, "e1_start", "e2_start", "pair", "pair_order", "valid_schema_pair", F.round("token_dist_scaled", 6).alias("token_dist_scaled"), F.round("log_dist", 6).alias("log_dist"), "dist_bin", "pair_dist", "same_clause", "head_e1", "head_e2", "num_intervening", "has_same_type_intervening")


def tables(spark, sf_dir):
    return L.pair_pmi_tables(L.pair_features(checkpointed(P.candidate_pairs(entities(spark, sf_dir), _KEYS))))


def _guessed(spark, sf_dir):
    """Labels against those of a plain rule: the schema's first relation within 8 words."""
    first = F.create_map(*[F.lit(x) for a, b, r in VALID_PAIRS for x in (f"{a}>{b}", r[0])])
    guess = F.when(F.col("token_dist") <= 8, F.coalesce(F.try_element_at(first, F.concat("type_e1", F.lit(">"), "type_e2")), F.lit("NONE"))).otherwise("NONE")
    return labelled(spark, sf_dir).withColumn("guess", guess)


def _featured(spark, sf_dir):
    f = L.pair_features(labelled(spark, sf_dir))
    return checkpointed(f.withColumn("article_id", F.regexp_replace("case_id", r"_[^_]*\z", "")))


def folds(spark, sf_dir):
    """Five folds of articles, balanced by their rows."""
    sizes = table(spark, sf_dir, "metadata").where("article_id is not null").groupBy("article_id").agg(F.count("*").alias("n"))
    return Y.group_folds(sizes, "article_id", "n")


def model_scores(spark, sf_dir):
    """Scores of predictions by models that have not seen the pair's article (three folds)."""
    f = _featured(spark, sf_dir)
    sizes = f.groupBy("article_id").agg(F.count("*").alias("n"))
    return P.class_scores(Y.out_of_fold(f, Y.group_folds(sizes, "article_id", "n", 3), "article_id", 3), "label", "pred_label")


def predicted_edges(spark, sf_dir):
    """The positive edges that a model of the first four folds gives to all cases."""
    f = _featured(spark, sf_dir)
    sizes = f.groupBy("article_id").agg(F.count("*").alias("n"))
    held = f.join(Y.group_folds(sizes, "article_id", "n").where("fold < 4"), "article_id", "left_semi")
    found = Y.predict(Y.fit(held), f).where("pred_label <> 'NONE'")
    return found.select(*_KEYS, "e1", "type_e1", "e2", "type_e2", "pred_label", "pred_confidence", "pmi_head")


def top_features(spark, sf_dir):
    """The features that speak most for each relation."""
    rows = Y.top_features(Y.fit(_featured(spark, sf_dir)))
    return spark.createDataFrame(rows, "label string, rank int, feature string, coefficient double")


_LIST = ",".join(f"'{w}'" for w in PATIENT_WORDS)
_OK = lambda a, b: f"({a} || '>' || {b}) in (" + ",".join(f"'{x}>{y}'" for x, y, _ in VALID_PAIRS) + ")"
_HAS = lambda col, p: f"regexp_matches({col}, '{_q(p)}', 'i')"
_SENT = _wordy("sentence")
_AROUND = "trim(left_context || ' ' || btw || ' ' || right_context)"
_PAIRS = f"""sp as ({_greedy_sql("n desc, start").replace(_NUMBERED, _TEXTS)}), {_TEXTS},
 ww as (select case_id, sent_no, sentence, regexp_extract_all(sentence, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*') as w from n),
 tk as (select case_id, sent_no, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from ww),
 hit as (select case_id, sent_no, word, i, i - row_number() over (partition by case_id, sent_no order by i) as isle from tk where lower(word) in ({_LIST}) or ({LEMMA_SQL}) in ({_LIST})),
 pr as (select case_id, sent_no, min(i) as start, max(i) + 1 as stop, string_agg(lower(word), ' ' order by i) as term from hit group by case_id, sent_no, isle),
 en as (select * from sp where not exists (select 1 from pr where pr.case_id = sp.case_id and pr.sent_no = sp.sent_no and pr.start < sp.stop and sp.start < pr.stop)),
 an as (select t.case_id, t.sent_no, t.start as b0, t.stop as b1, t.term as e2, t.label as type_e2, p.start as a0, p.stop as a1, p.term as e1,
   row_number() over (partition by t.case_id, t.sent_no, t.start order by p.stop > t.start, case when p.stop <= t.start then t.start - p.stop else abs(p.start - t.start) end, p.start) as rn
   from en t left join pr p on p.case_id = t.case_id and p.sent_no = t.sent_no where {_OK("'Patient'", "t.label")}),
 pp as (select case_id, sent_no, coalesce(e1, 'patient') as e1, 'Patient' as type_e1, coalesce(a0, 0) as a0, coalesce(a1, 0) as a1, e1 is null as virt, e2, type_e2, b0, b1 from an where rn = 1),
 ab as (select x.case_id, x.sent_no, x.term as t1, x.label as l1, x.start as s1, x.stop as p1, y.term as t2, y.label as l2, y.start as s2, y.stop as p2, (not {_OK("x.label", "y.label")}) and {_OK("y.label", "x.label")} as turned
   from en x join en y on x.case_id = y.case_id and x.sent_no = y.sent_no and y.start >= x.stop),
 ep as (select case_id, sent_no, case when turned then t2 else t1 end as e1, case when turned then l2 else l1 end as type_e1, case when turned then s2 else s1 end as a0, case when turned then p2 else p1 end as a1, false as virt,
   case when turned then t1 else t2 end as e2, case when turned then l1 else l2 end as type_e2, case when turned then s1 else s2 end as b0, case when turned then p1 else p2 end as b1 from ab),
 al as (select *, case when a0 <= b0 then a0 else b0 end as f0, case when a0 <= b0 then a1 else b1 end as f1, case when a0 <= b0 then b0 else a0 end as s0, case when a0 <= b0 then b1 else a1 end as s1 from (select * from pp union all select * from ep)),
 rec as (select al.*, w, sentence, array_to_string(w[f1+1:s0], ' ') as btw, lower(array_to_string(w[greatest(f0-4,0)+1:f0], ' ')) as left_context, lower(array_to_string(w[s1+1:s1+4], ' ')) as right_context,
   cast(greatest(s0 - f1, 0) as integer) as token_dist, coalesce((select string_agg(e.label, ',' order by e.start) from en e where e.case_id = al.case_id and e.sent_no = al.sent_no and e.start >= f1 and e.stop <= s0), '') as intervening
   from al join ww on ww.case_id = al.case_id and ww.sent_no = al.sent_no),
 cu as (select *, not {_HAS("btw", R.CLAUSE_BARRIER)} as same_clause, case when a0 <= b0 then 'E1_before_E2' else 'E2_before_E1' end as reading_order, array_to_string(list_filter([
   case when {_HAS("btw", R.PAIR_NEGATION)} or {_HAS("left_context", R.PAIR_NEGATION)} then 'NEGATION' end,
   case when {_HAS(_AROUND, R.CUES["FAMILY"])} or {_HAS(_SENT, R.CUES["FAMILY"])} then 'FAMILY' end, case when {_HAS(_AROUND, R.CUES["HISTORY"])} or {_HAS(_SENT, R.CUES["HISTORY"])} then 'HISTORY' end,
   case when {_HAS(_AROUND, R.CUES["DIAGNOSED"])} then 'DIAGNOSED' end, case when {_HAS("btw", R.CUES["LOCATED"])} then 'LOCATED' end,
   case when {_HAS("btw", R.CUES["REVEALS"])} or {_HAS("left_context", R.CUES["REVEALS"])} then 'REVEALS' end, case when {_HAS(_AROUND, R.CUES["EFFECT"])} then 'EFFECT' end], lambda x: x is not null), ',') as cues,
   {_HAS(f"regexp_split_to_array(btw, '{_q(R.CLAUSE_BARRIER)}', 'i')[-1]", R.PAIR_NEGATION)} as neg_btw, {_HAS(f"regexp_split_to_array(left_context, '{_q(R.CLAUSE_BARRIER)}', 'i')[-1]", R.PAIR_NEGATION)} as neg_left from rec),
 lb as (select *, case when not {_OK("type_e1", "type_e2")} or neg_btw or ((type_e1 = 'Patient' or len(regexp_extract_all(btw, '\\S+')) <= 3) and neg_left) then 'NONE'
   when type_e1 = 'Patient' and type_e2 = 'Disease' then case when contains(cues, 'FAMILY') then 'FAMILIAR_HISTORY' when contains(cues, 'HISTORY') then 'HISTORY' else 'DIAGNOSED_WITH' end
   when type_e1 = 'Patient' and type_e2 = 'Symptom' then case when contains(cues, 'FAMILY') then 'NONE' else 'PRESENTS_WITH' end
   when type_e1 = 'Patient' and type_e2 = 'Medication' then 'TAKES' when type_e1 = 'Patient' then 'UNDERWENT_EXAM'
   when type_e2 = 'Anatomy' then case when not list_contains(string_split(intervening, ','), 'Anatomy') and not list_contains(string_split(intervening, ','), type_e1) and same_clause and (token_dist <= 4 or (contains(cues, 'LOCATED') and token_dist <= 10)) then 'LOCATED_IN' else 'NONE' end
   when type_e1 = 'Exam' then case when not list_contains(string_split(intervening, ','), 'Exam') and ((contains(cues, 'REVEALS') and token_dist <= 15) or (same_clause and token_dist <= 8)) then 'REVEALS' else 'NONE' end
   when list_contains(string_split(intervening, ','), 'Medication') then 'NONE'
   when (type_e2 = 'Effect' and same_clause and token_dist <= 10) or (contains(cues, 'EFFECT') and token_dist <= 12) then 'HAS_EFFECT' else 'NONE' end as label from cu)"""
_FROM = f"with {_PAIRS} select "
_AT = "case_id, sent_no, cast(a0 as integer) as e1_start, cast(b0 as integer) as e2_start"
_DIST_BIN = "case when token_dist = 0 then 'adj_0' when token_dist <= 3 then 'close_1_3' when token_dist <= 8 then 'med_4_8' when token_dist <= 15 then 'far_9_15' else 'very_far_16+' end"
_BETWEEN = "list_filter(string_split(intervening, ','), lambda x: x <> '')"
_GUESS = "case when token_dist <= 8 then case type_e1 || '>' || type_e2 " + " ".join(f"when '{a}>{b}' then '{r[0]}'" for a, b, r in VALID_PAIRS) + " else 'NONE' end else 'NONE' end"
_F1 = "case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end"

_FOLDS = """with recursive a as (select article_id, count(*) as n from metadata where article_id is not null group by 1), o as (select *, row_number() over (order by n desc, article_id) as rn from a),
 f as (select 0::bigint as rn, [0, 0, 0, 0, 0]::bigint[] as held, null::varchar as article_id, null::integer as fold union all
   select o.rn, list_transform(held, lambda x, i: case when i = list_position(held, list_min(held)) then x + n else x end), o.article_id, cast(list_position(held, list_min(held)) - 1 as integer) from f join o on o.rn = f.rn + 1)
 select article_id, fold from f where article_id is not null"""

QUERIES = {
    "l3_group_folds": (folds, _FOLDS),
    "l9_edge_scores": (model_scores, None),
    "l15_predicted_edges": (predicted_edges, None),
    "l16_top_features": (top_features, None),
    "j3_candidate_pairs": (pairs, _FROM + f"{_AT}, e1, type_e1, cast(a1 as integer) as e1_stop, e2, type_e2, cast(b1 as integer) as e2_stop, reading_order from cu"),
    "j5_virtual_patients": (virtual, _FROM + "type_e2, count(*) filter (virt) as implied, count(*) as pairs from cu where type_e1 = 'Patient' group by type_e2"),
    "j6_pair_records": (records, _FROM + f"{_AT}, virt as e1_is_virtual, btw as between, left_context, right_context, token_dist, same_clause, intervening from cu".replace("as between", 'as "between"')),
    "r11_pair_cues": (lambda s, d: labelled(s, d).select(*_KEYS, "e1_start", "e2_start", "cues"), _FROM + f"{_AT}, cues from cu"),
    "r12_weak_labels": (lambda s, d: labelled(s, d).select(*_KEYS, "e1_start", "e2_start", "e1", "type_e1", "e2", "type_e2", "label"), _FROM + f"{_AT}, e1, type_e1, e2, type_e2, label from lb"),
    "f7_positive_edges": (positives, _FROM + "label, count(*) as edges, count(distinct case_id) as cases from lb where label <> 'NONE' group by label"),
    "a8_pair_report": (
        lambda s, d: P.edge_summary(checkpointed(labelled(s, d))),
        _FROM + """section, name, n from (select 'label' as section, label as name, count(*) as n from lb group by label union all select 'types', type_e1 || '->' || type_e2, count(*) from lb where label <> 'NONE' group by 2
        union all select 'total', 'pairs', count(*) from lb union all select 'total', 'positive', count(*) from lb where label <> 'NONE' union all select 'total', 'cases', count(distinct case_id) from lb)""",
    ),
    "a11_class_scores": (
        lambda s, d: P.class_scores(_guessed(s, d), "label", "guess"),
        f"with {_PAIRS}, g as (select label as t, {_GUESS} as g from lb), c as (select l as label, sum(s) as support, sum(q) as predicted, sum(h) as tp from (select t as l, 1 as s, 0 as q, case when t = g then 1 else 0 end as h from g union all select g, 0, 1, 0 from g) where l <> 'NONE' group by l),"
        " z as (select *, case when predicted = 0 then 0 else tp::double / predicted end as p, case when support = 0 then 0 else tp::double / support end as r from c),"
        f" y as (select label, support, predicted, tp, p, r, {_F1} as f from z), m as (select 'micro' as label, sum(support) as support, sum(predicted) as predicted, sum(tp) as tp, sum(tp)::double / sum(predicted) as p, sum(tp)::double / sum(support) as r from c)"
        f" select label, cast(support as bigint) as support, cast(predicted as bigint) as predicted, cast(tp as bigint) as tp, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from (select * from y union all select 'macro', sum(support), sum(predicted), sum(tp), avg(p), avg(r), avg(f) from y union all select *, {_F1} from m)",
    ),
    "a11_class_confusion": (
        lambda s, d: P.class_confusion(_guessed(s, d), "label", "guess"),
        f"with {_PAIRS}, g as (select label as truth, {_GUESS} as guess, count(*) as n from lb group by 1, 2) select truth, guess, n, round(n / sum(n) over (partition by truth), 6) as share from g",
    ),
    "l11_pair_features": (
        features,
        _FROM + f"""{_AT}, type_e1 || '->' || type_e2 as pair, type_e1 || '->' || type_e2 || '|' || reading_order as pair_order, {_OK("type_e1", "type_e2")} as valid_schema_pair, round(token_dist / 10.0::double, 6) as token_dist_scaled, round(ln(1 + token_dist), 6) as log_dist,
        {_DIST_BIN} as dist_bin, type_e1 || '->' || type_e2 || '|' || {_DIST_BIN} as pair_dist, same_clause, string_split(e1, ' ')[-1] as head_e1, string_split(e2, ' ')[-1] as head_e2, cast(len({_BETWEEN}) as integer) as num_intervening,
        list_contains({_BETWEEN}, type_e1) or list_contains({_BETWEEN}, type_e2) as has_same_type_intervening from cu""",
    ),
    "a18_pmi_tables": (
        tables,
        f"""with {_PAIRS}, x as (select unnest([{{'level': 'lexical', 'x': e1, 'y': e2, 'near': true}}, {{'level': 'head', 'x': string_split(e1, ' ')[-1], 'y': string_split(e2, ' ')[-1], 'near': true}}, {{'level': 'type', 'x': type_e1, 'y': type_e2, 'near': token_dist <= 10}}], recursive := true) from cu),
        c as (select level, x, y, count(*) as n_all, count(*) filter (near) as n_xy from x group by all), k as (select *, sum(n_all) over (partition by level, x) as n_x, sum(n_all) over (partition by level, y) as n_y, (select count(*) from cu) as n from c)
        select level, x, y, n_xy, cast(n_x as bigint) as n_x, cast(n_y as bigint) as n_y, round(log2(((n_xy + 0.5::double) / (n + 0.5::double)) / (((n_x + 0.5::double) / (n + 0.5::double)) * ((n_y + 0.5::double) / (n + 0.5::double)))), 6) as pmi from k""",
    ),
}
