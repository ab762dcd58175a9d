"""Queries on node, edge and manifest tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.functions import text as T
from vitagraph.operators import analytics as A
from vitagraph.operators import graph as G
from vitagraph.sources.tables import latest_by, table

_T = table
V1N, V1E, V4N, V2E = "v1_nodes", "v1_edges", "v4_nodes", "v2_edges_gemini"


def top_terms(spark, sf_dir):
    rows = _T(spark, sf_dir, V4N).where("label is not null").select("type", F.lower(F.trim("label")).alias("term"))
    return A.top_per_group(rows, "type", "term", 8)


def patient_concepts(spark, sf_dir):
    e = _T(spark, sf_dir, V1E).where(F.col("source_id").rlike("^P[0-9]+$") & F.col("target_id").isNotNull())
    return e.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("concepts"))


def hub_subgraph(spark, sf_dir):
    """The first 30 edges, by id, into the four largest hubs."""
    e, n = _T(spark, sf_dir, V1E), _T(spark, sf_dir, V1N)
    top = A.hubs(e, n).orderBy(F.desc("patients"), "target_id").limit(4).select("target_id")
    return e.join(F.broadcast(top), "target_id", "left_semi").orderBy("edge_id", "source_id", "target_id", "relation").limit(30).select("edge_id", "source_id", "target_id", "relation")


def edges_once(spark, sf_dir):
    sub = ["source_id", "target_id", "relation", "attributes", "case_id", "sentence_number", "sentence"]
    return G.keep_first(_T(spark, sf_dir, V2E).select(*sub, "row_id"), sub, ["row_id"]).select("row_id", "case_id", "target_id")


def nodes_once(spark, sf_dir):
    return G.keep_first(_T(spark, sf_dir, V4N).select("node_id", "row_id", "label", "type"), ["node_id"], ["row_id"])


def leaks(spark, sf_dir):
    """Articles with current cases in several splits."""
    m = latest_by(_T(spark, sf_dir, "split_manifest"), "case_id", "split")
    s = F.substr(F.lower(F.trim("split")), F.lit(1), F.lit(2))
    rows = m.select(F.regexp_extract("case_id", "^(.*)_[^_]*$", 1).alias("article"), s.alias("s")).where("s <> ''")
    return rows.groupBy("article").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi")


def text_column(spark, sf_dir):
    """The string column of cases with the greatest mean length."""
    df = _T(spark, sf_dir, "cases")
    names = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    lengths = df.agg(*[F.avg(F.length(c)).alias(c) for c in names])
    return lengths.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c), 6).alias("mean_length")) for c in names])).alias("s")).select("s.*").orderBy(F.desc("mean_length")).limit(1)


def type_lengths(spark, sf_dir):
    return _T(spark, sf_dir, V4N).where("label is not null").groupBy("type").agg(F.round(F.avg(F.length("label")), 6).alias("mean"), F.percentile(F.length("label"), F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def pivot_types(spark, sf_dir):
    kinds = ["Anatomy", "Disease", "Exam", "Medication", "Result", "Symptom"]
    rows = _T(spark, sf_dir, V4N).groupBy("case_id").pivot("type", kinds).agg(F.count(F.lit(1)))
    return rows.select("case_id", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in kinds])


def semi_anti(spark, sf_dir):
    """Cases with and without edges, and rows kept by not-null filters."""
    c, e = _T(spark, sf_dir, "cases"), _T(spark, sf_dir, V2E).select("case_id").distinct()
    parts = [("with edges", c.join(e, "case_id", "left_semi")), ("without edges", c.join(e, "case_id", "left_anti")), ("with text", c.na.drop(subset=["case_text"]))]
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def numbered(spark, sf_dir):
    rows = _T(spark, sf_dir, V4N).select("row_id", "label", "type")
    return G.number_nodes(rows, ["row_id"])


def json_round(spark, sf_dir):
    """Edges of each case as JSON and back."""
    e = _T(spark, sf_dir, V2E).select("case_id", F.struct("sentence_number", "relation").alias("s")).distinct()
    packed = e.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("j"))
    back = F.from_json("j", "array<struct<sentence_number:int,relation:string>>")
    return packed.select("case_id", F.explode(back).alias("x")).select("case_id", "x.sentence_number", "x.relation")


def lookups(spark, sf_dir):
    """Per type: the first node by row and the number of nodes."""
    return _T(spark, sf_dir, V1N).groupBy("type").agg(F.min_by("node_id", "row_id").alias("first_node"), F.min_by("label", "row_id").alias("first_label"), F.count("*").alias("n"))


def mermaid(spark, sf_dir):
    from vitagraph.sources.sinks import mermaid_lines

    nodes = _T(spark, sf_dir, V1N).groupBy("node_id").agg(F.min_by("type", "row_id").alias("type"), F.min_by("label", "row_id").alias("label"))
    return mermaid_lines(nodes, _T(spark, sf_dir, V1E))


QUERIES = {
    "a1_type_histogram": (lambda s, d: A.histogram(_T(s, d, V1N), "type"), "select type, count(*) as n from v1_nodes group by type"),
    "a1_relation_histogram": (lambda s, d: A.histogram(_T(s, d, V2E), "relation"), "select relation, count(*) as n from v2_edges_gemini group by relation"),
    "a2_attribute_coverage": (
        lambda s, d: A.attribute_coverage(_T(s, d, V2E)),
        "select relation, count(*) as n_edges, count(*) filter (coalesce(attributes,'')<>'') as n_filled, round(100.0::double*count(*) filter (coalesce(attributes,'')<>'')/count(*),4) as coverage from v2_edges_gemini group by relation",
    ),
    "a3_top_terms": (
        top_terms,
        """with c as (select type, lower(trim(label)) as term, count(*) as n from v4_nodes where label is not null group by 1,2)
        select type, term, n, cast(rank as integer) as rank from (select *, row_number() over (partition by type order by n desc, term) as rank from c) where rank <= 8""",
    ),
    "a4_hubs": (
        lambda s, d: A.hubs(_T(s, d, V1E), _T(s, d, V1N)),
        """with p as (select distinct node_id from v1_nodes where type='Patient'), n as (select node_id as target_id, min(label) as label, min(type) as type from v1_nodes group by 1)
        select target_id, count(distinct source_id) as patients, cast(count(*) as bigint) as edges, any_value(label) as label, any_value(type) as type,
        round(100.0::double*count(distinct source_id)/(select count(*) from p),4) as share from v1_edges join n using (target_id) where source_id in (select node_id from p) group by target_id""",
    ),
    "a5_patient_concepts": (patient_concepts, "select source_id, string_agg(t, ',' order by t) as concepts from (select distinct source_id, target_id as t from v1_edges where regexp_full_match(source_id,'P[0-9]+') and target_id is not null) group by source_id"),
    "a6_isolated": (
        lambda s, d: A.isolated(_T(s, d, V1E), _T(s, d, V1N)),
        "select case when node_id in (select source_id from v1_edges) then 'connected' else 'isolated' end as state, count(*) as patients from (select distinct node_id from v1_nodes where type='Patient') group by 1",
    ),
    "a12_type_lengths": (type_lengths, "select type, round(avg(length(label)),6) as mean, quantile_cont(length(label),0.5)::double as median, count(*) as n from v4_nodes where label is not null group by type"),
    "a13_crosstab": (
        lambda s, d: A.crosstab_percent(_T(s, d, V2E).select("relation", F.split_part("target_id", F.lit(":"), F.lit(1)).alias("kind")), "relation", "kind"),
        "with c as (select relation, split_part(target_id,':',1) as kind, count(*) as n from v2_edges_gemini group by 1,2) select relation, kind, n, round(100.0::double*n/sum(n) over (partition by relation),4) as share from c",
    ),
    "a20_case_summary": (
        lambda s, d: A.case_summary(_T(s, d, V4N), _T(s, d, V2E)),
        """with n as (select case_id, count(distinct node_id) as nodes from v4_nodes group by 1), e as (select case_id, count(*) as edges from v2_edges_gemini group by 1)
        select coalesce(n.case_id, e.case_id) as case_id, coalesce(nodes,0) as nodes, coalesce(edges,0) as edges from n full join e on n.case_id = e.case_id""",
    ),
    "a22_pivot_types": (pivot_types, "select case_id, " + ", ".join(f"count(*) filter (type='{k}') as {k.lower()}" for k in ["Anatomy", "Disease", "Exam", "Medication", "Result", "Symptom"]) + " from v4_nodes group by case_id"),
    "a23_balanced_weights": (
        lambda s, d: A.balanced_weights(_T(s, d, V4N), "type"),
        "with c as (select type, count(*) as n from v4_nodes group by 1) select type, n, round(cast((select sum(n) from c) as double)/((select count(*) from c)*n),6) as weight from c",
    ),
    "g17_co_patients": (
        lambda s, d: A.co_patients(_T(s, d, V1E).where(F.col("source_id").rlike("^P[0-9]+$"))),
        """with l as (select distinct source_id, target_id from v1_edges where regexp_full_match(source_id,'P[0-9]+') and target_id is not null),
        s as (select source_id, list_sort(list(target_id)) as items from l group by 1 having count(*) >= 2), c as (select items, min(source_id) as c, count(*) as members from s group by items),
        x as (select c, members, unnest(items) as t, len(items) as n from c), p as (select a.c as class_lo, b.c as class_hi, any_value(a.members) as members_lo, any_value(b.members) as members_hi, cast(count(*) as integer) as shared from x a join x b on a.t=b.t and a.c<b.c group by 1,2 having count(*)>=2)
        select * from p union all select c, c, members, members, cast(len(items) as integer) from c where members > 1""",
    ),
    "g18_hub_subgraph": (
        hub_subgraph,
        """with p as (select distinct node_id from v1_nodes where type='Patient'), h as (select target_id from v1_edges where source_id in (select node_id from p) and target_id in (select node_id from v1_nodes) group by 1 order by count(distinct source_id) desc, target_id limit 4)
        select edge_id, source_id, target_id, relation from v1_edges where target_id in (select target_id from h) order by edge_id, source_id, target_id, relation limit 30""",
    ),
    "g19_integrity": (
        lambda s, d: A.integrity(_T(s, d, V1N), _T(s, d, V1E)),
        """select 'repeated node ids' as "check", count(*) as violations from (select node_id from v1_nodes group by 1 having count(*)>1)
        union all select 'source_id without node', count(*) from v1_edges where not exists (select 1 from v1_nodes n where n.node_id = source_id)
        union all select 'target_id without node', count(*) from v1_edges where not exists (select 1 from v1_nodes n where n.node_id = target_id)""",
    ),
    "g10_number_nodes": (
        numbered,
        f"""with f as (select lower(label) as low, type, min(row_id) as r, arg_min(label, row_id) as label from v4_nodes where label is not null group by 1,2)
        select (case type {" ".join(f"when '{k}' then '{v}'" for k, v in T.NODE_PREFIX.items())} else 'N' end) || row_number() over (partition by type order by r, low) as node_id, type, label from f""",
    ),
    "u2_edges_keep_first": (edges_once, "select min(row_id) as row_id, case_id, target_id from v2_edges_gemini group by source_id, target_id, relation, attributes, case_id, sentence_number, sentence"),
    "u2_nodes_keep_first": (nodes_once, "select node_id, min(row_id) as row_id, arg_min({'v': label}, row_id).v as label, arg_min({'v': type}, row_id).v as type from v4_nodes group by node_id"),
    "u7_leak_check": (
        leaks,
        """with m as (select case_id, split, row_number() over (partition by case_id order by loaded_at desc nulls last, row_id desc) as rn from split_manifest where case_id is not null),
        r as (select regexp_extract(case_id,'^(.*)_[^_]*$',1) as article, substr(lower(trim(split)),1,2) as s from m where rn=1)
        select article, min(s) as lo, max(s) as hi from r where s <> '' group by 1 having min(s) <> max(s)""",
    ),
    "f2_semi_anti": (
        semi_anti,
        """select 'with edges' as kind, count(*) as n from cases where case_id in (select case_id from v2_edges_gemini) union all
        select 'without edges', count(*) from cases where not exists (select 1 from v2_edges_gemini e where e.case_id = cases.case_id) union all select 'with text', count(*) from cases where case_text is not null""",
    ),
    "f5_text_column": (text_column, "select * from (select 'case_text' as name, round(avg(length(case_text)),6) as mean_length from cases union all select 'article_id', round(avg(length(article_id)),6) from cases union all select 'case_id', round(avg(length(case_id)),6) from cases union all select 'gender', round(avg(length(gender)),6) from cases) order by mean_length desc limit 1"),
    "f6_first_by_type": (lookups, "select type, arg_min(node_id, row_id) as first_node, arg_min(label, row_id) as first_label, count(*) as n from v1_nodes group by type"),
    "s19_json_round": (json_round, "select distinct case_id, sentence_number, relation from v2_edges_gemini"),
    "io19_mermaid": (
        mermaid,
        """with n as (select node_id, arg_min(type,row_id) as type, arg_min(label,row_id) as label from v1_nodes group by 1)
        select case when type='Patient' then node_id || '((' || chr(34) || replace(coalesce(label,''),chr(34),'''') || chr(34) || '))' else node_id || '[' || chr(34) || replace(coalesce(label,''),chr(34),'''') || chr(34) || ']' end as line from n
        union all select source_id || ' -->|' || relation || '| ' || target_id from v1_edges where source_id is not null and target_id is not null and relation is not null""",
    ),
}
