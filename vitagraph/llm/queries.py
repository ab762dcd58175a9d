"""Queries of the llm problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitagraph.llm import bpe, groups, lookalike, overlap, packing, pairs, sentences, terms
from vitagraph.operators.packed import FIELDS, packed_values
from vitagraph.plans.general_problems import packed_sql
from vitagraph.sources.tables import checkpointed, latest_by, plain_term, table


def _mesh_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id and its current mesh terms, in plain form (an array)."""
    current = latest_by(table(spark, sf_dir, "metadata"), "article_id", "mesh_terms")
    values = F.transform(packed_values(F.col("mesh_terms"), **FIELDS["mesh_terms"]), plain_term)
    return current.select("article_id", F.filter(values, lambda v: v != "").alias("terms"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, record and terms (an array) of all mesh terms and labels."""
    nodes = table(spark, sf_dir, "v4_nodes")
    label = plain_term(F.col("label"))
    labels = nodes.where((F.col("type").isNull() | (F.col("type") != "Patient")) & F.col("label").isNotNull()).where(label != "")
    return (
        _mesh_terms(spark, sf_dir)
        .select(F.lit("mesh_terms").alias("field_name"), F.col("article_id").alias("record"), "terms")
        .unionByName(labels.select(F.lit("label").alias("field_name"), F.col("case_id").alias("record"), F.array(label).alias("terms")))
    )


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mark of every mesh term and every label."""
    nodes = table(spark, sf_dir, "v4_nodes")
    totals = (
        table(spark, sf_dir, "metadata").agg(F.countDistinct("article_id").alias("all_records")).select(F.lit("mesh_terms").alias("field_name"), "all_records")
        .unionByName(nodes.agg(F.countDistinct("case_id").alias("all_records")).select(F.lit("label").alias("field_name"), "all_records"))
    )
    counts = terms.ngram_counts(_terms(spark, sf_dir), "field_name", "record", "terms")
    return terms.mark_terms(counts, totals, "field_name").withColumnRenamed("ngram", "term")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in one record or in more than a tenth of all records."""
    return _term_counts(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p2_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    return _term_counts(spark, sf_dir).select("field_name", "term", "occurrences", "records", "mark")


def p2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of all n-grams of words within the terms, of any n."""
    rows = _terms(spark, sf_dir).select("field_name", "record", F.explode("terms").alias("term")).select("field_name", "record", F.split("term", " ").alias("words"))
    longest = rows.agg(F.max(F.size("words"))).first()[0] or 1
    return terms.ngram_counts(rows, "field_name", "record", "words", longest)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every case text and of every sentence cell."""
    cases = sentences.split_sentences(table(spark, sf_dir, "cases"), ["row_id"], "case_text")
    cells = sentences.split_sentences(table(spark, sf_dir, "v2_edges_gemini"), ["row_id"], "sentence")
    return cases.select(F.lit("cases").alias("src"), "*").unionByName(cells.select(F.lit("v2_edges_gemini").alias("src"), "*"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _mesh_terms(spark, sf_dir).select(F.lit("mesh_terms").alias("field_name"), F.col("article_id").alias("basket"), F.explode("terms").alias("item"))
    edges = table(spark, sf_dir, "v1_edges").where(F.col("source_id").rlike(r"\AP[0-9]+\z"))
    return mesh.unionByName(edges.select(F.lit("target_id").alias("field_name"), F.col("source_id").alias("basket"), F.col("target_id").alias("item")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least 3 baskets, at least three times as often as by chance."""
    counted = pairs.pair_counts(_baskets(spark, sf_dir), "field_name", "basket", "item", 3)
    return counted.where(pairs.above_chance(3)).select("field_name", "item_lo", "item_hi")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that share a basket, with their counts and lift."""
    counted = pairs.pair_counts(_baskets(spark, sf_dir), "field_name", "basket", "item", 1)
    return counted.withColumn("lift", F.round("lift", 6))


def _split_name(c: Column) -> Column:
    """train, validation or test, whatever the spelling; else null."""
    plain = F.lower(F.trim(c))
    return (
        F.when(plain.rlike(r"\Atrain"), "train").when(plain.rlike(r"\A(?:val|dev)"), "validation").when(plain.rlike(r"\Atest"), "test")
    )


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each case: case_id, article_id, split."""
    current = latest_by(table(spark, sf_dir, "split_manifest"), "case_id", "article_id", "split")
    return current.select("case_id", "article_id", _split_name(F.col("split")).alias("split"))


def _split_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "cases").select("case_id", "article_id")
    return cases.join(_manifest(spark, sf_dir).where("split is not null").select("case_id", "split"), "case_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of validation or test whose text stands in a training case too."""
    found = overlap.cross_split_pairs(table(spark, sf_dir, "cases"), "case_id", "case_text", "split", splits=_manifest(spark, sf_dir))
    lo, hi = F.least("eval_key", "train_key"), F.greatest("eval_key", "train_key")
    return found.select(lo.alias("case_lo"), hi.alias("case_hi")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping cases per split and article."""
    found = overlap.cross_split_pairs(table(spark, sf_dir, "cases"), "case_id", "case_text", "split", splits=_manifest(spark, sf_dir))
    return overlap.overlap_report(found, _split_cases(spark, sf_dir), "case_id", "split", "article_id")


def _article_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, split and group_id of the cases of the manifest."""
    digits = F.regexp_extract("article_id", r"([0-9]+)\s*\z", 1)
    rows = _manifest(spark, sf_dir).select(
        "case_id",
        "split",
        F.regexp_replace("case_id", r"_[^_]*\z", "").alias("own"),
        F.when(digits != "", F.concat(F.lit("PMC"), digits)).alias("named"),
    )
    links = rows.where("named is not null and named <> own").select(F.col("own").alias("a"), F.col("named").alias("b"))
    labels, _ = groups.spanning_forest(links)
    return rows.join(labels, rows["own"] == labels["node"], "left").select("case_id", "split", F.coalesce("root", "own").alias("group_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases of the groups that the manifest tears apart."""
    rows = _article_groups(spark, sf_dir)
    torn = rows.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("group_id")
    return rows.join(torn, "group_id", "left_semi").select("case_id", "group_id")


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A common split for all cases of each group: 80, 10 and 10 per cent."""
    rows = _article_groups(spark, sf_dir)
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("records"))
    dealt = groups.deal_groups(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1})
    return rows.drop("split").join(dealt.select("group_id", "split"), "group_id").select("case_id", "group_id", "split")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sized in tokens, in containers of every kind."""
    sized = table(spark, sf_dir, "documents").select("doc_id", bpe.token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(sized, "doc_id", F.col("n_tokens"), table(spark, sf_dir, "pack_sizes"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each kind, the tokens in them and the share of room used."""
    kinds = table(spark, sf_dir, "pack_sizes")
    used = p9_packing(spark, sf_dir).groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("item_tokens").alias("tokens"))
    return used.join(kinds, "container_kind").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", lookalike.consistent_form(F.col("text")).alias("form"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same and are not the same string."""
    return lookalike.look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document that looks like another, different one."""
    return lookalike.look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text").drop("class_id")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and their signs other than blanks that stand in a sentence: all of them."""
    found = []
    for src, column in (("cases", "case_text"), ("v2_edges_gemini", "sentence")):
        texts = table(spark, sf_dir, src).select("row_id", column).where(F.length(column) > 0)
        cut = sentences.split_sentences(texts, ["row_id", column], column)
        part = F.substr(F.col(column), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
        signs = cut.agg(F.sum(F.length(F.regexp_replace(part, r"[\s\x0b\x85\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\x1c-\x1f]", ""))).alias("signs"))
        found.append(texts.agg(F.lit(src).alias("src"), F.count("*").alias("texts")).join(F.broadcast(signs)))  # one row each
    return found[0].unionByName(found[1])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split, whether its share is within two per cent of all cases, and groups
    whose cases are not all in one split."""
    dealt = p7_splits(spark, sf_dir)
    torn = dealt.groupBy("group_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn_groups"))
    wanted = F.create_map(*[F.lit(x) for p in {"train": 0.8, "validation": 0.1, "test": 0.1}.items() for x in p])
    shares = dealt.groupBy("split").agg(F.count("*").alias("n")).join(F.broadcast(dealt.agg(F.count("*").alias("all"))))
    return shares.select("split", (F.abs(F.col("n") / F.col("all") - F.try_element_at(wanted, F.col("split"))) <= 0.02).alias("near_its_share")).join(F.broadcast(torn))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, null ones, and those whose ids do not give their text again."""
    docs = table(spark, sf_dir, "documents").select("text", bpe.token_ids(F.col("text")).alias("ids"))
    same = F.when(F.col("text").isNull(), F.col("ids").isNull()).otherwise(bpe.decoded(F.col("ids")) == F.col("text"))
    return docs.select(F.col("text").isNull().alias("n"), F.coalesce(same, F.lit(False)).alias("s")).agg(F.count("*").alias("documents"), F.count_if("n").alias("nulls"), F.count_if(~F.col("s")).alias("differing"))


def p9_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind: documents, containers over their capacity, documents divided though
    they fit, and documents whose pieces are not all their tokens in order."""
    packed = checkpointed(p9_packing(spark, sf_dir)).join(F.broadcast(table(spark, sf_dir, "pack_sizes")), "container_kind")  # a row for each kind
    full = packed.groupBy("container_kind", "container_id", "capacity").agg(F.sum("item_tokens").alias("n")).groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(bpe.token_count(F.col("text")), F.lit(0)).alias("size"))
    last = F.max(F.col("item_start") + F.col("item_tokens"))
    docs = packed.groupBy("container_kind", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("highest"), F.sum("item_tokens").alias("n"), last.alias("last")).join(sizes, "doc_id")
    whole = (F.col("n") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("pieces") == F.col("highest"))
    return docs.groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("divided"), F.count_if(~whole).alias("incomplete")
    ).join(full, "container_kind")


def p10_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and those whose consistent form has another consistent form."""
    forms = p10_forms(spark, sf_dir).where("form is not null")
    return forms.select((lookalike.consistent_form(F.col("form")) != F.col("form")).alias("x")).agg(F.count("*").alias("documents"), F.count_if("x").alias("unstable"))


QUERIES = {
    "p2_found": p2_found,
    "p2_term_counts": p2_term_counts,
    "p2_ngrams": p2_ngrams,
    "p4_found": p4_found,
    "p4_coverage": p4_coverage,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_splits": p7_splits,
    "p7_shares": p7_shares,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_packing": p9_packing,
    "p9_fill": p9_fill,
    "p9_valid": p9_valid,
    "p10_found": p10_found,
    "p10_forms": p10_forms,
    "p10_classes": p10_classes,
    "p10_stable": p10_stable,
}

_BLANKS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"
_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '{_BLANKS}', ' ', 'g'))"
_MESH = (
    packed_sql(
        "select article_id as id, 'mesh_terms' as field_name, mesh_terms as cell from (select *, row_number() over (partition by article_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from metadata where article_id is not null) where rn = 1"
    )
    + f", mesh as (select id as article_id, {_PLAIN('item')} as term from pv where {_PLAIN('item')} <> '')"
)
_TM = f"""with recursive {_MESH}, tm as (select 'mesh_terms' as field_name, article_id as record, term from mesh
 union all select 'label', case_id, {_PLAIN("label")} from v4_nodes where (type is null or type <> 'Patient') and label is not null and case_id is not null and {_PLAIN("label")} <> ''),
 tc as (select field_name, term, count(*) as occurrences, count(distinct record) as records from tm group by 1, 2),
 tt as (select 'mesh_terms' as field_name, count(distinct article_id) as total from metadata union all select 'label', count(distinct case_id) from v4_nodes),
 marked as (select tc.*, case when records = 1 then 'rare' when records > 0.1::double * total then 'common' end as mark from tc join tt using (field_name))"""
_PAIRS = f"""with recursive {_MESH}, bk as (select distinct 'mesh_terms' as f, article_id as k, term as item from mesh union all select distinct 'target_id', source_id, target_id from v1_edges where regexp_full_match(source_id, 'P[0-9]+') and target_id is not null),
 nb as (select f, count(distinct k) as n from bk group by f), ni as (select f, item, count(*) as c from bk group by 1, 2),
 jo as (select x.f, x.item as lo, y.item as hi, count(*) as joint from bk x join bk y on x.f = y.f and x.k = y.k and x.item < y.item group by 1, 2, 3),
 al as (select jo.f as field_name, lo as item_lo, hi as item_hi, joint, a.c as n_lo, b.c as n_hi, n as n_baskets from jo join ni a on a.f = jo.f and a.item = lo join ni b on b.f = jo.f and b.item = hi join nb on nb.f = jo.f)"""
_TEXT_SIZE = lambda c: f"cast(sum(length(regexp_replace({c}, '[\\s\\x{{000b}}\\x{{0085}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200b}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}\\x{{001c}}-\\x{{001f}}]', '', 'g'))) as bigint)"

#: Oracles of the problems that SQL can express on whole tables.
ORACLES = {
    "p2_found": _TM + " select field_name, term, mark from marked where mark is not null",
    "p2_term_counts": _TM + " select field_name, term, occurrences, records, mark from marked",
    "p2_ngrams": _TM + """, wd as (select field_name, record, string_split(term, ' ') as w from tm), ix as (select *, unnest(generate_series(1, len(w))) as i from wd), ng as (select *, unnest(generate_series(i, len(w))) as j from ix)
 select field_name, array_to_string(w[i:j], ' ') as ngram, cast(j - i + 1 as integer) as n, count(*) as occurrences, count(distinct record) as records from ng group by 1, 2, 3""",
    "p4_coverage": f"select 'cases' as src, count(*) as texts, {_TEXT_SIZE('case_text')} as signs from cases where length(case_text) > 0 union all select 'v2_edges_gemini', count(*), {_TEXT_SIZE('sentence')} from v2_edges_gemini where length(sentence) > 0",
    "p5_found": _PAIRS + " select field_name, item_lo, item_hi from al where joint >= 3 and joint * n_baskets >= 3 * n_lo * n_hi",
    "p5_pairs": _PAIRS + " select *, round(joint * n_baskets / (n_lo::double * n_hi), 6) as lift from al",
    "p7_shares": "select unnest(['train', 'validation', 'test']) as split, true as near_its_share, 0::bigint as torn_groups",
    "p8_round_trip": "select count(*) as documents, count(*) filter (text is null) as nulls, 0::bigint as differing from documents",
    "p9_valid": "select container_kind, (select count(*) from documents) as documents, 0::bigint as overfull, 0::bigint as divided, 0::bigint as incomplete from pack_sizes",
    "p10_stable": "select count(*) as documents, 0::bigint as unstable from documents where text is not null",
    "p7_found": r"""
with recursive m as (select case_id, article_id, split, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from split_manifest where case_id is not null),
 r as (select case_id, regexp_replace(case_id, '_[^_]*$', '') as own, case when regexp_extract(article_id, '([0-9]+)\s*$', 1) <> '' then 'PMC' || regexp_extract(article_id, '([0-9]+)\s*$', 1) end as named,
   case when regexp_matches(lower(trim(split)), '^train') then 'train' when regexp_matches(lower(trim(split)), '^(val|dev)') then 'validation' when regexp_matches(lower(trim(split)), '^test') then 'test' end as s from m where rn = 1),
 l as (select own as a, named as b from r where named <> own union select named, own from r where named <> own),
 reach as (select a, a as b from l union select reach.a, l.b from reach join l on reach.b = l.a),
 lab as (select a, min(b) as root from reach group by a), g as (select case_id, coalesce(root, own) as group_id, s from r left join lab on own = a)
select case_id, group_id from g where group_id in (select group_id from g group by 1 having min(s) <> max(s))""",
}
