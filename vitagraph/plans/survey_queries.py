"""Smaller queries of the inventory, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.functions import text as T
from vitagraph.operators import attributes as X
from vitagraph.operators import graph as G
from vitagraph.operators import matching as M
from vitagraph.operators import rules
from vitagraph.operators.edges import patient_runs
from vitagraph.plans import clinical_queries as Q
from vitagraph.plans.text_queries import _RULE, LEMMA_SQL, apart, plain_regex
from vitagraph.sources.tables import latest_by, table

_KEYS = ["case_id", "sent_no"]


def reconstructed(spark, sf_dir):
    """Sentences' tokens with vocabulary terms joined and acronyms expanded."""
    words = table(spark, sf_dir, "v4_nodes").where("label is not null").select(F.lower("label").alias("key")).distinct()
    found = M.reconstruct_tokens(Q.case_sentences(spark, sf_dir), _KEYS, "sentence", words)
    return found.select(*_KEYS, F.array_join("tokens", "|").alias("tokens"))


def newline_sentences(spark, sf_dir):
    return T.rule_sentences(table(spark, sf_dir, "cases").select("row_id", "case_text"), ["row_id"], "case_text", newline=True)


def punctuation_runs(spark, sf_dir):
    texts = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null").select("sentence").distinct()
    return texts.select(F.explode(T.clinical_tokens(F.col("sentence"), runs=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def first_nodes(spark, sf_dir):
    """The first node of each label, whatever its case, and how many there are."""
    n = table(spark, sf_dir, "v4_nodes").where("label is not null")
    return n.groupBy(F.lower("label").alias("label")).agg(F.min_by("node_id", "row_id").alias("node_id"), F.count("*").alias("n"))


def edges_by_relation(spark, sf_dir):
    e = table(spark, sf_dir, "v1_edges")
    return e.groupBy("relation").agg(F.count("*").alias("edges"), F.min("edge_id").alias("first_id"), F.max("edge_id").alias("last_id"))


def contributory(spark, sf_dir):
    """Sentences of each case that are not skipped as saying nothing new."""
    low = F.lower("sentence")
    kept = Q.case_sentences(spark, sf_dir).where(~F.contains(low, F.lit("non-contributory")) & ~F.contains(low, F.lit("were normal")))
    return kept.groupBy("case_id").agg(F.count("*").alias("sentences"))


def ceilings(spark, sf_dir):
    """Share of each type's nodes whose label stands in their case's text: what a
    reader of the text can find at most."""
    c = latest_by(table(spark, sf_dir, "cases").where("case_text is not null"), "case_id", "case_text")
    n = table(spark, sf_dir, "v4_nodes").where("label is not null and type is not null").select("case_id", "type", F.lower(F.trim("label")).alias("l"))
    rows = n.join(c, "case_id").select("type", F.contains(F.lower("case_text"), F.col("l")).alias("ok"))
    return rows.groupBy("type").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("ceiling"), F.count("*").alias("nodes"))


def blocked_words(spark, sf_dir):
    """The ten words that stand most often just before blocked entities, ties by word."""
    m = Q._mentions(spark, sf_dir).withColumn("at", F.instr(F.lower("sentence"), F.lower("entity")) - 1).where("at >= 0")
    blocked = m.where(Q.R.blocked_in_window(F.col("sentence"), F.col("at")))
    before = F.lower(F.regexp_extract(F.substr(F.col("sentence"), F.lit(1), F.col("at")), r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return blocked.select(before.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


def adjacency(spark, sf_dir):
    """Tags in the tagged sentences, those with a tag right after them, and the ratio."""
    t = Q.tagged(spark, sf_dir)
    sums = t.agg(F.sum(F.regexp_count("tagged", F.lit("TAG-[A-Z]+"))).cast("bigint").alias("tags"), F.sum(F.regexp_count("tagged", F.lit("TAG-[A-Z]+ TAG-[A-Z]+"))).cast("bigint").alias("adjacent"))
    return sums.withColumn("ratio", F.round(F.col("adjacent") / F.col("tags"), 6))


def same_texts(spark, sf_dir):
    """Cases whose first and last deliveries have the same text, and others."""
    c = table(spark, sf_dir, "cases").where("case_id is not null")
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "row_id")
    ends = c.groupBy("case_id").agg(F.min_by("case_text", order).alias("a"), F.max_by("case_text", order).alias("b"))
    return ends.groupBy(F.when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("different").alias("state")).agg(F.count("*").alias("cases"))


def numbers(spark, sf_dir):
    """Different numbers of the nodes' attributes, whole ones without decimals."""
    n = table(spark, sf_dir, "v4_nodes").select(F.explode(F.regexp_extract_all("attributes", F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))).alias("written")).distinct()
    return n.select("written", T.number_text(F.col("written")).alias("number"))


def label_statistics(spark, sf_dir):
    n = table(spark, sf_dir, "v4_nodes").where("label is not null and type is not null").select("type", F.length("label").alias("n"))
    return n.groupBy("type").agg(
        F.round(F.avg("n"), 3).alias("mean"), F.round(F.stddev_pop("n"), 3).alias("deviation"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.round(F.sqrt(F.greatest(F.stddev_pop("n") * F.avg("n"), F.lit(1e-12))), 3).alias("geometric"), F.round(F.avg(F.log1p("n")), 3).alias("logs"),
    )


def edge_ids(spark, sf_dir):
    """Rule edges with ids that count them in each case."""
    e = rules.rule_edges(Q.case_sentences(spark, sf_dir), Q.lexicon(spark, sf_dir))
    order = W.partitionBy("case_id").orderBy("sent_no", "rule", "source", "target", "relation", "attributes")
    return e.select("case_id", F.concat(F.lit("E"), F.row_number().over(order).cast("string")).alias("edge_id"), "source", "target", "relation", "attributes")


def strided_folds(spark, sf_dir, k: int = 5, seed: int = 42):
    """Folds of articles by their place, modulo ``k``, in a seeded shuffle. Places come
    from counts per first byte of the hash, so that no task orders them all."""
    a = table(spark, sf_dir, "metadata").select("article_id").where("article_id is not null").distinct().withColumn("h", F.md5(F.concat("article_id", F.lit(f":{seed}"))))
    a = a.withColumn("b", F.left("h", F.lit(2)))
    counts = a.groupBy("b").agg(F.count("*").alias("n"))
    before = counts.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows
    place = F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "article_id")) - 1
    return a.join(F.broadcast(before), "b").select("article_id", (place % k).cast("int").alias("fold"))


_ACRONYMS = "{" + ", ".join(f"'{k}': '{v}'" for k, v in T.ACRONYMS.items()) + "}"
_ACRONYM_LIST = ", ".join(f"'{k}'" for k in T.ACRONYMS)
_M1 = f"""with recursive {Q._TEXTS}, voc as (select distinct lower(label) as key from v4_nodes where label is not null),
 mt as (select case_id, sent_no, regexp_extract_all({apart('sentence')}, '{plain_regex(T.CLINICAL_TOKEN)}') as t from n), tk as (select case_id, sent_no, unnest(t) as word, cast(generate_subscripts(t, 1) - 1 as integer) as i from mt), tl as (select *, {LEMMA_SQL} as lemma from tk),
 gr as (select a.case_id, a.sent_no, a.i as start, b.i + 1 as stop, lower(string_agg(c.word, ' ' order by c.i)) as raw, string_agg(c.lemma, ' ' order by c.i) as lem, string_agg(c.word, ' ' order by c.i) as term from tl a join tl b on a.case_id = b.case_id and a.sent_no = b.sent_no and b.i between a.i + 1 and a.i + 4
   join tl c on c.case_id = a.case_id and c.sent_no = a.sent_no and c.i between a.i and b.i where a.word not in ({_ACRONYM_LIST}) group by 1, 2, 3, 4 having not bool_or(c.word in ('.', ';', '!', '?', '(', ')'))),
 d as (select gr.*, row_number() over (partition by case_id, sent_no order by start, stop desc) as rn from gr where raw in (select key from voc) or lem in (select key from voc)),
 f as (select case_id, sent_no, 0::bigint as rn, -1 as upto, null::integer as start, null::integer as stop, null::varchar as term from (select distinct case_id, sent_no from d)
   union all select d.case_id, d.sent_no, d.rn, case when d.start >= f.upto then d.stop else f.upto end, case when d.start >= f.upto then d.start end, d.stop, d.term from f join d on d.case_id = f.case_id and d.sent_no = f.sent_no and d.rn = f.rn + 1),
 x as (select tk.case_id, tk.sent_no, i, case when f.start is null then case when word in ({_ACRONYM_LIST}) then word || ' [' || map_extract(map {_ACRONYMS}, word)[1] || ']' else word end when f.start = i then f.term end as w from tk left join f on f.start is not null and f.case_id = tk.case_id and f.sent_no = tk.sent_no and f.start <= i and i < f.stop)
 select n.case_id, n.sent_no, coalesce(string_agg(w, '|' order by i), '') as tokens from n left join x on x.case_id = n.case_id and x.sent_no = n.sent_no group by 1, 2"""

QUERIES = {
    "m1_reconstructed_tokens": (reconstructed, _M1),
    "t2b_newline_sentences": (newline_sentences, _RULE.replace(r"([.!?]\s+)([A-Z])", r"([.!?]\s*\n\s*)([A-Z])")),
    "t5b_punctuation_runs": (
        punctuation_runs,
        f"with s as (select distinct sentence from v2_edges_gemini where sentence is not null), t as (select unnest(regexp_extract_all({apart('sentence')}, '{plain_regex(T.CLINICAL_TOKEN_RUNS)}')) as token from s) select token, count(*) as n from t group by token",
    ),
    "f6_first_nodes": (first_nodes, "select lower(label) as label, arg_min(node_id, row_id) as node_id, count(*) as n from v4_nodes where label is not null group by 1"),
    "f6_edges_by_relation": (edges_by_relation, "select relation, count(*) as edges, min(edge_id) as first_id, max(edge_id) as last_id from v1_edges group by relation"),
    "f10_contributory": (contributory, f"with {Q._TEXTS} select case_id, count(*) as sentences from n where not contains(lower(sentence), 'non-contributory') and not contains(lower(sentence), 'were normal') group by case_id"),
    "a14_ceilings": (
        ceilings,
        "with c as (select case_id, case_text from (select *, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from cases where case_id is not null and case_text is not null) where rn = 1)"
        " select type, round(avg(contains(lower(case_text), lower(trim(label)))::int), 6) as ceiling, count(*) as nodes from v4_nodes join c using (case_id) where label is not null and type is not null group by type",
    ),
    "a14_blocked_words": (
        blocked_words,
        f"""with {Q._MEN}, a as (select *, strpos(lower(sentence), lower(entity)) - 1 as pos0 from m), b as (select * from a where pos0 >= 0 and (regexp_matches(substr(sentence, greatest(pos0-60,0)+1, least(pos0,60)), '{Q._q(Q.R.WINDOW_NEGATION)}', 'i')
        or regexp_matches(substr(sentence, greatest(pos0-35,0)+1, least(pos0,35)+90), '{Q._q(Q.R.WINDOW_UNCERTAINTY)}', 'i'))) select word, count(*) as n from (select lower(regexp_extract(substr(sentence, 1, pos0), '([A-Za-z]+)[^A-Za-z]*$', 1)) as word from b) where word <> '' group by word order by n desc, word limit 10""",
    ),
    "a17_adjacency": (
        adjacency,
        "with z as (" + Q._TAGGED + "), k as (select cast(sum(len(regexp_extract_all(tagged, 'TAG-[A-Z]+'))) as bigint) as tags, cast(sum(len(regexp_extract_all(tagged, 'TAG-[A-Z]+ TAG-[A-Z]+'))) as bigint) as adjacent from z) select *, round(adjacent / tags, 6) as ratio from k",
    ),
    "j14_same_texts": (
        same_texts,
        "with o as (select case_id, case_text, row_number() over (partition by case_id order by loaded_at is not null, loaded_at, row_id) as a, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as z from cases where case_id is not null)"
        " select case when x.case_text is not distinct from y.case_text then 'same' else 'different' end as state, count(*) as cases from o x join o y on x.case_id = y.case_id and x.a = 1 and y.z = 1 group by 1",
    ),
    "s6_numbers": (
        numbers,
        r"with w as (select distinct unnest(regexp_extract_all(attributes, '\d+(?:,\d{3})*(?:\.\d+)?')) as written from v4_nodes), d as (select written, cast(replace(written, ',', '') as double) as v from w) select written, case when v = trunc(v) then cast(cast(v as bigint) as varchar) else regexp_replace(replace(written, ',', ''), '^0+([0-9])|0+$', '\1', 'g') end as number from d",
    ),
    "s20_label_statistics": (
        label_statistics,
        "select type, round(avg(length(label)), 3) as mean, round(stddev_pop(length(label)), 3) as deviation, cast(min(length(label)) as integer) as least, cast(max(length(label)) as integer) as most, round(sqrt(greatest(stddev_pop(length(label)) * avg(length(label)), 1e-12)), 3) as geometric, round(avg(ln(1 + length(label))), 3) as logs from v4_nodes where label is not null and type is not null group by type",
    ),
    "g11_edge_ids": (
        edge_ids,
        f"with r as ({Q._RULES}) select case_id, 'E' || row_number() over (partition by case_id order by sent_no, rule, source, target, relation, attributes) as edge_id, source, target, relation, attributes from r",
    ),
    "l2_strided_folds": (strided_folds, "select article_id, cast((row_number() over (order by md5(article_id || ':42'), article_id) - 1) % 5 as integer) as fold from (select distinct article_id from metadata where article_id is not null)"),
}


def cleaned(spark, sf_dir):
    """Different attribute cells, fit for a serialized list."""
    return table(spark, sf_dir, "v4_nodes").where("attributes is not null").select("attributes", X.clean_attribute(F.col("attributes")).alias("cleaned")).distinct()


def tags(spark, sf_dir):
    """Tags of the tagged sentences without their prefix."""
    t = Q.tagged(spark, sf_dir).select(F.explode(F.split("tagged", " ")).alias("token")).where(T.is_tag(F.col("token")))
    return t.groupBy(T.tag_name(F.col("token")).alias("label")).agg(F.count("*").alias("n"))


def signs(spark, sf_dir):
    """Tokens without a letter."""
    t = table(spark, sf_dir, "cases").select(F.explode(T.word_tokens(F.col("case_text"))).alias("token")).where(~F.col("token").rlike("[A-Za-z]"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def population_nodes(spark, sf_dir):
    """One node for each (term, type) of all cases, numbered in first-seen order."""
    spans = Q._spans(spark, sf_dir, M.LEFT_TO_RIGHT).select("case_id", "sent_no", "start", F.col("term").alias("label"), F.col("label").alias("type"))
    return G.number_nodes(spans, ["case_id", "sent_no", "start"])


def patients(spark, sf_dir):
    """Age and gender of each case's patient as its text tells them."""
    rows = Q.case_sentences(spark, sf_dir).select(*_KEYS, "sentence", patient_runs(T.words(F.col("sentence"))).alias("runs"), T.word_starts(F.col("sentence")).alias("starts"))
    found = rows.groupBy("case_id").agg(F.min(F.when(F.size("runs") > 0, F.struct("sent_no", "sentence", "runs", "starts"))).alias("m"), F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))).alias("all"))
    first = F.coalesce("m.sent_no", F.lit(1))
    near = F.array_join(F.transform(F.filter("all", lambda x: (x["sent_no"] >= first) & (x["sent_no"] <= first + 1)), lambda x: x["sentence"]), " ")
    text = latest_by(table(spark, sf_dir, "cases").where("case_text is not null"), "case_id", "case_text")
    anchor = F.get("m.starts", F.get("m.runs", F.lit(0))["start"])
    age = F.coalesce(X.nearest_age(F.col("m.sentence"), anchor), X.nearest_age(F.substring("case_text", 1, 300), F.lit(0)))
    noun = F.get(F.filter(F.split(F.get("m.runs", F.lit(0))["term"], " "), lambda w: w.isin(X.MALE_WORDS + X.FEMALE_WORDS)), F.lit(0))
    return text.join(found, "case_id", "left").select("case_id", age.alias("age"), X.gender_of(noun, F.coalesce(near, F.lit("")), F.col("case_text")).alias("gender"))


_AGES = lambda source, keys: " union all ".join(
    f"select {keys}, cast(length(array_to_string(p[1:i-1], '')) as integer) as pos0, regexp_extract(p[i], '(?i){Q._q(r)}', 1) as num, {u} as unit from (select {keys}, p, unnest(generate_series(2, len(p), 2)) as i from (select {keys}, string_split(regexp_replace(t, '({Q._q(r)})', chr(1) || '\\1' || chr(1), 'gi'), chr(1)) as p from {source}))"
    for r, u in ((X.AGE_PATTERNS[0], f"lower(regexp_extract(p[i], '(?i){Q._q(X.AGE_PATTERNS[0])}', 2))"), (X.AGE_PATTERNS[1], "'year'"), (X.AGE_PATTERNS[2], "'year'"))
)
_YEARS = "round((case lower(num) " + " ".join(f"when '{w}' then {i}.0::double" for i, w in enumerate(X.NUMBER_WORDS, 1)) + " else try_cast(num as double) end) * (case unit when 'month' then 1.0::double/12 when 'week' then 1.0::double/52 when 'day' then 1.0::double/365 else 1.0::double end), 3)"
_MEN, _WOMEN = ", ".join(f"'{w}'" for w in X.MALE_WORDS), ", ".join(f"'{w}'" for w in X.FEMALE_WORDS)
_WHO = f"""with {Q._SP}, h as (select *, i - row_number() over (partition by case_id, sent_no order by i) as isle from tk where {Q._PATIENT}),
 r as (select case_id, sent_no, min(i) as a, string_agg(lower(word), ' ' order by i) as term from h group by case_id, sent_no, isle), f as (select *, row_number() over (partition by case_id order by sent_no, a) as rn from r),
 m as (select f.case_id, f.sent_no, f.a, f.term, regexp_replace(sentence, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Devanagari}}\\p{{Cyrillic}}\\p{{Greek}}À-ÖØ-öø-ɏªºµ]', '_', 'g') as t, cast(length(array_to_string(string_split(regexp_replace(sentence, '([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*)', chr(1) || '\\1' || chr(1), 'g'), chr(1))[1:2*f.a+1], '')) as integer) as anchor
   from f join n on n.case_id = f.case_id and n.sent_no = f.sent_no where rn = 1),
 c as (select case_id, case_text, regexp_replace(substr(case_text, 1, 300), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Devanagari}}\\p{{Cyrillic}}\\p{{Greek}}À-ÖØ-öø-ɏªºµ]', '_', 'g') as t, {Q._wordy('case_text')} as whole from ct where rn = 1),
 g1 as (select case_id, first(y order by abs(pos0 - anchor), y) as age from (select case_id, pos0, anchor, {_YEARS} as y from ({_AGES("m", "case_id, anchor")})) group by case_id),
 g2 as (select case_id, first(y order by pos0, y) as age from (select case_id, pos0, {_YEARS} as y from ({_AGES("c", "case_id")})) group by case_id),
 nx as (select n.case_id, string_agg(sentence, ' ' order by n.sent_no) as t from n left join m on m.case_id = n.case_id where n.sent_no between coalesce(m.sent_no, 1) and coalesce(m.sent_no, 1) + 1 group by 1),
 np as (select case_id, len(regexp_extract_all({Q._wordy('t')}, '{X.MALE_PRONOUNS}', 0, 'i')) as nhe, len(regexp_extract_all({Q._wordy('t')}, '{X.FEMALE_PRONOUNS}', 0, 'i')) as nshe from nx),
 k as (select c.case_id, coalesce(nhe, 0) as nhe, coalesce(nshe, 0) as nshe, list_filter(string_split(term, ' '), lambda w: w in ({_MEN}, {_WOMEN}))[1] as noun, len(regexp_extract_all(whole, '{X.MALE_PRONOUNS}', 0, 'i')) as he, len(regexp_extract_all(whole, '{X.FEMALE_PRONOUNS}', 0, 'i')) as she from c left join m using (case_id) left join np on np.case_id = c.case_id)
 select k.case_id, coalesce(g1.age, g2.age) as age, case when noun in ({_MEN}) then 'male' when noun is not null then 'female' when nhe > nshe then 'male' when nshe > nhe then 'female' when he > she then 'male' when she > he then 'female' end as gender from k left join g1 using (case_id) left join g2 using (case_id)"""
QUERIES |= {
    "s12_clean_attributes": (cleaned, "select distinct attributes, replace(replace(replace(attributes, ';', ','), chr(13), ''), chr(10), ' ') as cleaned from v4_nodes where attributes is not null"),
    "s14_signs": (signs, f"select token, count(*) as n from (select unnest(regexp_extract_all(case_text, '{T.WORD_TOKEN.replace(chr(39), chr(39) * 2)}')) as token from cases) where not regexp_matches(token, '[A-Za-z]') group by token"),
    "s15_tags": (tags, "with z as (" + Q._TAGGED + "), t as (select unnest(string_split(tagged, ' ')) as token from z) select substr(token, 5) as label, count(*) as n from t where starts_with(token, 'TAG-') group by 1"),
    "g12_population_nodes": (
        population_nodes,
        f"with sp as ({Q._greedy_sql('start, n desc').replace(Q._NUMBERED, Q._TEXTS)}), f as (select term as label, label as type, min({{'c': case_id, 's': sent_no, 'w': start}}) as a from sp group by 1, 2)"
        " select case type " + " ".join(f"when '{k}' then '{v}'" for k, v in T.NODE_PREFIX.items()) + " else 'N' end || row_number() over (partition by type order by a, label) as node_id, type, label from f",
    ),
    "x12_patients": (patients, _WHO),
}
