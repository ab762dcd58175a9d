"""Scores of two dictionary readers against spans by stems, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.operators import evaluate as E
from vitagraph.operators import matching as M
from vitagraph.plans.clinical_queries import _NUMBERED, _TEXTS, _greedy_sql, _spans
from vitagraph.plans.token_queries import _FOUND, stem_matches
from vitagraph.sources.tables import checkpointed


def _keyed(spans):
    """Spans whose ``case_id`` is that of their sentence, so that places are unique."""
    return spans.select(F.concat("case_id", F.lit("#"), F.col("sent_no").cast("string")).alias("case_id"), "start", "stop", "label", "term")


def _gold(spark, sf_dir):
    return checkpointed(_keyed(stem_matches(spark, sf_dir).where("label <> 'Patient'")))


def modes(spark, sf_dir):
    """The longest-first reader in the four ways of matching spans."""
    return E.match_modes(_gold(spark, sf_dir), checkpointed(_keyed(_spans(spark, sf_dir, M.LONGEST_FIRST))))


def comparison(spark, sf_dir):
    """Both readers' scores by type against the same spans."""
    gold, found = _gold(spark, sf_dir), None
    for name, by in (("left_to_right", M.LEFT_TO_RIGHT), ("longest_first", M.LONGEST_FIRST)):
        part = E.span_scores(gold, _keyed(_spans(spark, sf_dir, by))).withColumn("model", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def errors(spark, sf_dir):
    """The ten terms most often found wrongly, and most often missed, ties by name."""
    return E.top_errors(_gold(spark, sf_dir), _keyed(_spans(spark, sf_dir, M.LONGEST_FIRST)))


_SETS = f"""with recursive sp as ({_greedy_sql("n desc, start").replace(_NUMBERED, _TEXTS)}), lr as ({_greedy_sql("start, n desc").replace(_NUMBERED, _TEXTS)}), {_FOUND.replace('{where}', "label <> 'IGNORE'")},
 g as (select distinct case_id || '#' || sent_no as k, start, stop, label, term from fs), p as (select distinct case_id || '#' || sent_no as k, start, stop, label, term from sp), q as (select distinct case_id || '#' || sent_no as k, start, stop, label, term from lr)"""
_BOTH = lambda c: f"(select count(*) from p where exists (select 1 from g where g.k = p.k and {c})) as hit_pred, (select count(*) from g where exists (select 1 from p where g.k = p.k and {c})) as hit_gold"
_MODES = {
    "strict": "g.start = p.start and g.stop = p.stop and g.label = p.label", "start_tag": "g.start = p.start and g.label = p.label",
    "start": "g.start = p.start", "overlap": "g.label = p.label and g.start < p.stop and p.start < g.stop",
}

QUERIES = {
    "l24_match_modes": (
        modes,
        _SETS + ", h as (" + " union all ".join(f"select '{m}' as mode, {_BOTH(c)}" for m, c in _MODES.items()) + "), r as (select *, round(hit_pred::double / (select count(*) from p), 6) as precision, round(hit_gold::double / (select count(*) from g), 6) as recall from h)"
        " select *, round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from r",
    ),
    "l25_model_comparison": (
        comparison,
        _SETS + """, m as (select 'longest_first' as model, * from p union all select 'left_to_right', * from q), b as (select model, g.* from g cross join (values ('longest_first'), ('left_to_right')) v(model)),
        j as (select coalesce(b.model, m.model) as model, coalesce(b.label, m.label) as label, b.k is not null as g, m.k is not null as p from b full join m on b.model = m.model and b.k = m.k and b.start = m.start and b.stop = m.stop and b.label = m.label),
        c as (select model, label, count(*) filter (g) as support, count(*) filter (p) as predicted, count(*) filter (g and p) as tp, count(*) filter (p and not g) as fp, count(*) filter (g and not p) as fn from j group by 1, 2),
        r as (select *, round(case when tp + fp = 0 then 0 else tp::double / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp::double / (tp + fn) end, 6) as recall from c)
        select *, round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from r""",
    ),
    "a15_top_errors": (
        errors,
        _SETS + """, x as (select 'false positive' as kind, p.label, p.term, count(*) as n from p where not exists (select 1 from g where g.k = p.k and g.start = p.start and g.stop = p.stop and g.label = p.label) group by 2, 3
        union all select 'missed', g.label, g.term, count(*) from g where not exists (select 1 from p where g.k = p.k and g.start = p.start and g.stop = p.stop and g.label = p.label) group by 2, 3),
        y as (select *, row_number() over (partition by kind order by n desc, label, term) as rn from x) select kind, label, term, n from y where rn <= 10""",
    ),
}
