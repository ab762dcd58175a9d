"""Queries that join, report and resolve records, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.operators.analytics import percent
from vitagraph.operators.packed import FIELDS, packed_values
from vitagraph.plans.general_problems import packed_sql
from vitagraph.sources.tables import latest_by, table

# ---- fixed values ----------------------------------------------------------
#: Types of a term in several categories: the last of these wins.
CATEGORY_ORDER = ["Anatomy", "Disease", "Exam", "Medication", "Procedure", "Result", "Symptom"]
RENAMED = {"computed tomography": "CT", "tomography": "TOMO", "body weight": "weight", "bp": "blood pressure"}
GENERIC = ["humans", "human subjects", "adults", "male", "female", "men", "women", "case description"]
# ----------------------------------------------------------------------------


def term_types(spark, sf_dir):
    """One type for each label: the last category that has it."""
    order = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("type"))
    n = table(spark, sf_dir, "v4_nodes").where("label is not null").where(F.col("type").isin(CATEGORY_ORDER))
    return n.groupBy(F.lower("label").alias("term")).agg(F.max_by("type", order).alias("type"))


def containment(spark, sf_dir):
    """Words of each sentence, and the number of its first word in the text: a sentence's
    words are cut in it, and its place is a running sum over the text's sentences."""
    c = table(spark, sf_dir, "cases").select("row_id", "case_text")
    sents = T.sentences_with_offsets(c, ["row_id"], "case_text").select("row_id", "sent_id", F.size(T.words(F.col("sentence"))).cast("bigint").alias("words"))
    before = W.partitionBy("row_id").orderBy("sent_id").rowsBetween(W.unboundedPreceding, -1)
    return sents.withColumn("first_word", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("int"))


_CONTAIN = r"""with f as (select row_id, string_split(regexp_replace(regexp_replace(case_text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1)) as parts from cases where case_text is not null),
 e as (select row_id, unnest(parts) as s, generate_subscripts(parts,1)-1 as sent_id from f), w as (select row_id, cast(sent_id as integer) as sent_id, cast(len(regexp_extract_all(s,'[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) as bigint) as words from e where regexp_matches(s,'[A-Za-z0-9]'))
 select row_id, sent_id, words, cast(coalesce(sum(words) over (partition by row_id order by sent_id rows between unbounded preceding and 1 preceding),0) as integer) as first_word from w"""


def virtual_anchors(spark, sf_dir):
    """Sentences of a case with entities but no edge from a named patient: they get
    an anchor of their own at their first word."""
    e = table(spark, sf_dir, "v2_edges_gemini").where("case_id is not null and sentence_number is not null")
    said = e.select("case_id", "sentence_number").distinct()
    named = e.where(F.lower("sentence").rlike(r"\bpatient\b")).select("case_id", "sentence_number").distinct()
    real = named.withColumn("is_virtual", F.lit(False))
    return said.join(named, ["case_id", "sentence_number"], "left_anti").withColumn("is_virtual", F.lit(True)).unionByName(real)


def resolved_nodes(spark, sf_dir):
    """Nodes of all edges: by id, else by the same id in lower case; edges without
    one are counted as unresolved."""
    n = table(spark, sf_dir, "v4_nodes").select(F.col("node_id").alias("target_id")).where("target_id is not null").distinct()
    low = n.select(F.lower("target_id").alias("low")).distinct().withColumn("by_low", F.lit(True))
    e = table(spark, sf_dir, "v2_edges_gemini").select("target_id", F.lower("target_id").alias("low"))
    rows = e.join(n.withColumn("by_id", F.lit(True)), "target_id", "left").join(low, "low", "left")
    how = F.when(F.col("by_id"), "id").when(F.col("by_low"), "lower").otherwise("unresolved")
    return rows.groupBy(how.alias("how")).agg(F.count("*").alias("edges"))


def same_sets(spark, sf_dir):
    """Cases whose tables disagree: ids of the manifest and of the case table."""
    c = table(spark, sf_dir, "cases").select("case_id").where("case_id is not null").distinct().withColumn("in_cases", F.lit(True))
    m = table(spark, sf_dir, "split_manifest").select("case_id").where("case_id is not null").distinct().withColumn("in_manifest", F.lit(True))
    both = c.join(m, "case_id", "full_outer")
    state = F.when(F.col("in_cases").isNull(), "only manifest").when(F.col("in_manifest").isNull(), "only cases").otherwise("both")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("cases"))


def edge_report(spark, sf_dir):
    """Per relation: edges, cases, share of all edges."""
    e = table(spark, sf_dir, "v2_edges_gemini").groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("case_id").alias("cases"))
    total = e.agg(F.sum("edges").alias("total"))
    return e.join(F.broadcast(total)).select("relation", "edges", "cases", percent(F.col("edges"), F.col("total")).alias("share"))


def label_agreement(spark, sf_dir):
    """Gender and age of the patient nodes against the case table's current rows."""
    c = latest_by(table(spark, sf_dir, "cases"), "case_id", "age", "gender")
    n = table(spark, sf_dir, "v4_nodes").where("type = 'Patient'")
    age = F.regexp_extract("attributes", r"age=([0-9.]+)", 1).try_cast("double")
    sex = F.regexp_extract("attributes", r"gender=(\w+)", 1)
    rows = n.select("case_id", age.alias("n_age"), sex.alias("n_sex")).join(c, "case_id")
    close = F.count_if(F.coalesce(F.abs(F.col("n_age") - F.col("age")) < 1, F.lit(False)))
    same = F.count_if(F.coalesce(F.lower("n_sex") == F.lower("gender"), F.lit(False)))
    return rows.agg(F.count("*").alias("patients"), close.alias("same_age"), same.alias("same_gender"))


def patient_nodes(spark, sf_dir):
    """A root node for each case with its age and gender."""
    c = latest_by(table(spark, sf_dir, "cases"), "case_id", "age", "gender")
    text = F.concat_ws("; ", F.concat(F.lit("age="), F.col("age").cast("int")), F.concat(F.lit("gender="), F.col("gender")))
    return c.select(F.concat(F.lit("P:"), "case_id").alias("node_id"), F.lit("Patient").alias("type"), text.alias("attributes"))


def numeric_edges(spark, sf_dir):
    """Edges whose attributes hold a number, with the first of them."""
    e = table(spark, sf_dir, "v2_edges_gemini").select("row_id", "relation", F.regexp_extract("attributes", r"([0-9]+(?:[.][0-9]+)?)", 1).alias("number"))
    return e.where(F.coalesce(F.col("number"), F.lit("")) != "").select("row_id", "relation", F.col("number").cast("double").alias("number"))


def mesh_heads(spark, sf_dir):
    """Heads of the mesh terms (before the slash), without short and generic ones."""
    v = table(spark, sf_dir, "metadata").select(F.explode(packed_values(F.col("mesh_terms"), **FIELDS["mesh_terms"])).alias("t"))
    head = F.lower(F.trim(F.regexp_replace(F.split_part("t", F.lit("/"), F.lit(1)), r"\s+", " ")))
    return v.select(head.alias("term")).where((F.length("term") >= 4) & ~F.col("term").isin(GENERIC)).groupBy("term").agg(F.count("*").alias("n"))


def best_rows(spark, sf_dir):
    """The node with most rows of each case, ties by id."""
    n = table(spark, sf_dir, "v4_nodes").groupBy("case_id", "node_id").agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.min_by("node_id", F.struct(-F.col("n"), F.col("node_id"))).alias("node_id"), F.max("n").alias("n"))


def shared_concepts(spark, sf_dir):
    """Concepts of both node tables, of one only."""
    a = table(spark, sf_dir, "v1_nodes").where("type <> 'Patient'").select(F.lower("label").alias("c")).where("c is not null").distinct()
    b = table(spark, sf_dir, "v4_nodes").where("type <> 'Patient'").select(F.lower("label").alias("c")).where("c is not null").distinct()
    parts = [("both", a.intersect(b)), ("first only", a.subtract(b)), ("second only", b.subtract(a))]
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def substituted(spark, sf_dir):
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null").select("sentence").distinct()
    return e.select("sentence", T.substitute(F.col("sentence"), RENAMED).alias("changed")).where("sentence <> changed")


_LATEST = "c as (select case_id, age, gender from (select *, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from cases where case_id is not null) where rn = 1)"
_ORDER = "case type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(CATEGORY_ORDER, 1)) + " end"

_CHANGED = "sentence"
for _term, _new in sorted(RENAMED.items(), key=lambda x: (-len(x[0]), x[0])):
    _CHANGED = rf"regexp_replace({_CHANGED}, '\b{_term}\b', '{_new}', 'gi')"

_MESH_CELLS = "select row_id as id, 'mesh_terms' as field_name, mesh_terms as cell from metadata"

QUERIES = {
    "m5_term_types": (term_types, f"select lower(label) as term, arg_max(type, {_ORDER}) as type from v4_nodes where label is not null and {_ORDER} is not null group by 1"),
    "j2_containment": (containment, _CONTAIN),
    "j5_virtual_anchors": (
        virtual_anchors,
        r"select case_id, sentence_number, not bool_or(coalesce(regexp_matches(lower(sentence), '\bpatient\b'), false)) as is_virtual from v2_edges_gemini where case_id is not null and sentence_number is not null group by 1,2",
    ),
    "j11_resolve_nodes": (
        resolved_nodes,
        "select case when target_id in (select node_id from v4_nodes where node_id is not null) then 'id' when lower(target_id) in (select lower(node_id) from v4_nodes where node_id is not null) then 'lower' else 'unresolved' end as how, count(*) as edges from v2_edges_gemini group by 1",
    ),
    "j14_same_sets": (
        same_sets,
        "with a as (select distinct case_id as x from cases where case_id is not null), b as (select distinct case_id as y from split_manifest where case_id is not null) select case when x is null then 'only manifest' when y is null then 'only cases' else 'both' end as state, count(*) as cases from a full join b on x = y group by 1",
    ),
    "a7_label_agreement": (
        label_agreement,
        f"""with {_LATEST}, n as (select case_id, try_cast(regexp_extract(attributes,'age=([0-9.]+)',1) as double) as n_age, regexp_extract(attributes,'gender=(\\w+)',1) as n_sex from v4_nodes where type='Patient')
        select count(*) as patients, count(*) filter (abs(n_age-age) < 1) as same_age, count(*) filter (lower(n_sex)=lower(gender)) as same_gender from n join c using (case_id)""",
    ),
    "a8_edge_report": (edge_report, "select relation, count(*) as edges, count(distinct case_id) as cases, round(100.0::double*count(*)/(select count(*) from v2_edges_gemini),4) as share from v2_edges_gemini group by relation"),
    "g15_patient_nodes": (patient_nodes, f"with {_LATEST} select 'P:' || case_id as node_id, 'Patient' as type, concat_ws('; ', 'age=' || cast(trunc(case when isnan(age) then 0 else age end) as integer), 'gender=' || gender) as attributes from c"),
    "g20_numeric_edges": (numeric_edges, "select row_id, relation, cast(regexp_extract(attributes,'([0-9]+(?:[.][0-9]+)?)',1) as double) as number from v2_edges_gemini where regexp_matches(attributes,'[0-9]')"),
    "s4_substitute": (substituted, f"with s as (select distinct sentence from v2_edges_gemini where sentence is not null), c as (select sentence, {_CHANGED} as changed from s) select * from c where sentence <> changed"),
    "s17_mesh_heads": (
        mesh_heads,
        f"with recursive {packed_sql(_MESH_CELLS)}, h as (select lower(trim(regexp_replace(split_part(item, '/', 1), '\\s+', ' ', 'g'))) as term from pv) select term, count(*) as n from h where length(term) >= 4 and term not in ({', '.join(map(repr, GENERIC))}) group by term",
    ),
    "w8_best_rows": (best_rows, "with n as (select case_id, node_id, count(*) as n from v4_nodes group by 1,2) select case_id, first(node_id order by n desc, node_id) as node_id, max(n) as n from n group by case_id"),
    "u5_shared_concepts": (
        shared_concepts,
        """with a as (select distinct lower(label) as c from v1_nodes where type<>'Patient' and label is not null), b as (select distinct lower(label) as c from v4_nodes where type<>'Patient' and label is not null)
        select 'both' as kind, count(*) as n from a where c in (select c from b) union all select 'first only', count(*) from a where c not in (select c from b) union all select 'second only', count(*) from b where c not in (select c from a)""",
    ),
}
