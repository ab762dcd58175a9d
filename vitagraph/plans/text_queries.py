"""Queries on strings, tokens and sentences, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.sources.tables import table

_NORM = "trim(regexp_replace(replace(lower({0}),'-',' '),'[^a-z0-9]+',' ','g'))"


def _words(spark, sf_dir):
    """Distinct words of all case texts."""
    return table(spark, sf_dir, "cases").select(F.explode(T.words(F.col("case_text"))).alias("word")).distinct()


_WORDS_SQL = "select distinct unnest(regexp_extract_all(case_text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) as word from cases"


def normalize_phrases(spark, sf_dir):
    return table(spark, sf_dir, "v4_nodes").where("label is not null").select("row_id", T.normalize_phrase(F.col("label")).alias("normalized"))


def lemmas(spark, sf_dir):
    return _words(spark, sf_dir).select("word", T.lemmatize(F.col("word")).alias("lemma"))


_IRREGULAR_SQL = " ".join(f"when lower(word)='{k}' then '{v}'" for k, v in T.IRREGULAR.items())


LEMMA_SQL = f"""case when length(word) >= 2 and upper(word) = word and lower(word) <> word then word
        {_IRREGULAR_SQL}
        when lower(word) like '%ies' and length(word) > 4 then left(lower(word), length(word) - 3) || 'y'
        when regexp_matches(lower(word), '[shxz]es$') and length(word) > 3 then left(lower(word), length(word) - 2)
        when lower(word) like '%s' and lower(word) not like '%ss' and length(word) > 3 then left(lower(word), length(word) - 1)
        else lower(word) end"""


SHAPE_SQL = "regexp_replace(regexp_replace(regexp_replace(word,'[A-Z]','X','g'),'[a-z]','x','g'),'[0-9]','d','g')"
for _c, _d in (("X", "X"), ("x", "x"), ("d", "d"), ("-", "-"), ("''", "''")):
    SHAPE_SQL = f"regexp_replace({SHAPE_SQL},'{_c}+','{_d}','g')"


def word_shapes(spark, sf_dir):
    return _words(spark, sf_dir).select("word", T.word_shape(F.col("word")).alias("shape"))


def affixes(spark, sf_dir):
    return _words(spark, sf_dir).select("word", *T.affix_features(F.col("word")))


def headwords(spark, sf_dir):
    return table(spark, sf_dir, "v4_nodes").where("label is not null").select("row_id", T.headword(T.normalize_phrase(F.col("label"))).alias("head"))


def variants(spark, sf_dir):
    terms = table(spark, sf_dir, "v4_nodes").where("label is not null").select("label").distinct()
    return terms.select("label", F.explode(T.term_variants(F.col("label"))).alias("variant"))


def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "v4_nodes").where("label is not null").select("row_id", T.node_id(F.col("type"), F.col("label")).alias("made_id"))


_PREFIX_SQL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in T.NODE_PREFIX.items()) + " else 'N' end"


def token_offsets(spark, sf_dir):
    cases = table(spark, sf_dir, "cases").select("row_id", "case_text")
    return T.offset_tokens(cases, ["row_id"], "case_text")


_TOKEN_SQL = r"""
with cut as (select row_id, string_split(regexp_replace(case_text, '([A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as parts from cases where case_text is not null),
 each as (select row_id, unnest(parts) as token, generate_subscripts(parts, 1) - 1 as p from cut),
 placed as (select row_id, token, p, coalesce(sum(length(token)) over (partition by row_id order by p rows between unbounded preceding and 1 preceding), 0) as off from each)
select row_id, cast((p - 1) / 2 as integer) as tok_idx, token, cast(off as integer) as char_start, cast(off + length(token) as integer) as char_end from placed where p % 2 = 1
"""


def corpus_totals(spark, sf_dir):
    cases = table(spark, sf_dir, "cases")
    size = F.size(F.filter(T.split_lines_and_stops(F.col("case_text")), lambda s: s.rlike("[A-Za-z0-9]")))
    return cases.where("case_text is not null").agg(
        F.sum(size).alias("sentences"), F.sum(F.size(T.words(F.col("case_text")))).alias("tokens"),
        F.count_distinct("article_id").alias("articles"), F.count("*").alias("texts"),
    )


_FRAGMENTS = r"string_split(regexp_replace(regexp_replace(case_text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1))"


def sentences_by_stops(spark, sf_dir):
    cases = table(spark, sf_dir, "cases").select("row_id", "case_text")
    return T.sentences_with_offsets(cases, ["row_id"], "case_text").select("row_id", "sent_id", "sentence")


def sentences_by_rule(spark, sf_dir):
    cases = table(spark, sf_dir, "cases").select("row_id", "case_text")
    return T.rule_sentences(cases, ["row_id"], "case_text")


def clinical_tokens(spark, sf_dir):
    texts = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null").select("sentence").distinct()
    return texts.select(F.explode(T.clinical_tokens(F.col("sentence"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def preprocessed(spark, sf_dir):
    """Tokens in lower case without punctuation and pure numbers, counted."""
    tokens = T.drop_punctuation(F.transform(T.words(F.col("case_text")), F.lower))
    kept = F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))
    return table(spark, sf_dir, "cases").select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def acronyms(spark, sf_dir):
    """Acronyms of the texts with their expansion and number of texts."""
    table_ = F.create_map(*[F.lit(x) for p in T.ACRONYMS.items() for x in p])
    found = table(spark, sf_dir, "cases").select("row_id", F.explode(F.array_distinct(T.words(F.col("case_text")))).alias("acronym"))
    return found.withColumn("expansion", F.try_element_at(table_, F.col("acronym"))).where("expansion is not null").groupBy("acronym", "expansion").agg(F.count("*").alias("texts"))


def plain_regex(pattern: str) -> str:
    """A pattern for an engine without look-ahead: where no letter may follow a unit, a
    word's end must."""
    return pattern.replace("(?![A-Za-z])", r"\b").replace("'", "''")


def apart(text: str) -> str:
    """A text with a mark between letters and digits, so that a unit before a digit ends
    a word, and before the last digit of a ratio whose unit the patterns do not know,
    where an engine with look-ahead gives up that digit."""
    split = f"regexp_replace({text}, '([A-WYZa-wyz])([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_replace({split}, '(/[0-9]*[0-9])([0-9]k)', '\\1' || chr(1) || '\\2', 'g')"


_RULE_MARKS = r"regexp_replace(regexp_replace(regexp_replace(case_text, '\b([Ff]ig|[Dd]r|[Aa]rt)[.](\s)', '\1' || chr(2) || '\2', 'g'), '\b([Ff]ig|[Dd]r|[Aa]rt)[!](\s)', '\1' || chr(3) || '\2', 'g'), '\b([Ff]ig|[Dd]r|[Aa]rt)[?](\s)', '\1' || chr(4) || '\2', 'g')"
_RULE = rf"""with m as (select row_id, string_split(regexp_replace({_RULE_MARKS}, '([.!?]\s+)([A-Z])', chr(1) || '\1' || chr(1) || '\2', 'g'), chr(1)) as p from cases where case_text is not null),
 e as (select row_id, unnest(p) as piece, generate_subscripts(p, 1) as i from m), o as (select *, cast(coalesce(sum(length(piece)) over w, 0) as integer) as off, lag(piece) over (partition by row_id order by i) as sb, lead(piece) over (partition by row_id order by i) as sa from e window w as (partition by row_id order by i rows between unbounded preceding and 1 preceding)),
 k as (select row_id, i, off + case when starts_with(coalesce(sb, ''), '?') then 1 else 0 end as pos, substr(piece, 1 + case when starts_with(coalesce(sb, ''), '?') then 1 else 0 end) as s from o where i % 2 = 1 and not starts_with(coalesce(sa, ''), '?'))
 select row_id, cast(row_number() over (partition by row_id order by i) as integer) as sent_no, pos, translate(s, chr(2) || chr(3) || chr(4), '.!?') as sentence from k where s <> ''"""

QUERIES = {
    "s1_normalize_phrase": (normalize_phrases, f"select row_id, {_NORM.format('label')} as normalized from v4_nodes where label is not null"),
    "s2_lemmatize": (lemmas, f"with w as ({_WORDS_SQL}) select word, {LEMMA_SQL} as lemma from w"),
    "s5_node_id": (node_ids, f"select row_id, {_PREFIX_SQL} || ':' || replace({_NORM.format('label')}, ' ', '_') as made_id from v4_nodes where label is not null"),
    "s7_word_shape": (
        word_shapes,
        f"with w as ({_WORDS_SQL}) select word, {SHAPE_SQL} as shape from w",
    ),
    "s8_affixes": (
        affixes,
        f"""with w as ({_WORDS_SQL}) select word, left(lower(word),3) as prefix3, right(lower(word),2) as suffix2, right(lower(word),3) as suffix3, right(lower(word),4) as suffix4,
        cast(least(length(word),12) as integer) as capped_length, regexp_matches(word,'^[A-Z][a-z]+$') as is_title, regexp_matches(word,'^[A-Z]+$') as is_upper,
        regexp_matches(word,'[0-9]') as has_digit, contains(word,'-') as has_hyphen from w""",
    ),
    "s9_headword": (headwords, f"select row_id, string_split({_NORM.format('label')}, ' ')[-1] as head from v4_nodes where label is not null"),
    "s10_term_variants": (
        variants,
        r"""with l as (select distinct label from v4_nodes where label is not null), a as (select label, trim(regexp_replace(lower(label),'\s+',' ','g')) as low from l),
        b as (select label, low, trim(regexp_replace(regexp_replace(low,'\([^)]*\)',' ','g'),'\s+',' ','g')) as bare from a),
        c as (select label, low, bare, string_split(bare, ', ') as p from b)
        select distinct label, variant from (select label, unnest([low, bare, case when len(p)=2 then p[2] || ' ' || p[1] end]) as variant from c) where variant is not null and variant <> ''""",
    ),
    "t3_sentences": (
        sentences_by_stops,
        rf"""with f as (select row_id, {_FRAGMENTS} as parts from cases where case_text is not null), e as (select row_id, unnest(parts) as s, generate_subscripts(parts,1)-1 as sent_id from f)
        select row_id, cast(sent_id as integer) as sent_id, regexp_extract(s,'(?s)([A-Za-z0-9].*[A-Za-z0-9]|[A-Za-z0-9])',1) as sentence from e where regexp_matches(s,'[A-Za-z0-9]')""",
    ),
    "t2_rule_sentences": (sentences_by_rule, _RULE),
    "t5_clinical_tokens": (
        clinical_tokens,
        f"with s as (select distinct sentence from v2_edges_gemini where sentence is not null), t as (select unnest(regexp_extract_all({apart("sentence")}, '{plain_regex(T.CLINICAL_TOKEN)}')) as token from s) select token, count(*) as n from t group by token",
    ),
    "t9_token_offsets": (token_offsets, _TOKEN_SQL),
    "t14_preprocess": (
        preprocessed,
        f"""with t as (select unnest(list_transform(regexp_extract_all(case_text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x))) as token from cases)
        select token, count(*) as n from t where not regexp_matches(token,'^[0-9]+$') group by token""",
    ),
    "m1_acronyms": (
        acronyms,
        f"""with a(acronym, expansion) as (values {", ".join(f"('{k}','{v}')" for k, v in T.ACRONYMS.items())}),
        w as (select distinct row_id, unnest(regexp_extract_all(case_text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) as acronym from cases)
        select acronym, expansion, count(*) as texts from w join a using (acronym) group by acronym, expansion""",
    ),
    "a16_corpus_totals": (
        corpus_totals,
        rf"""select cast(sum(len(list_filter({_FRAGMENTS}, lambda s: regexp_matches(s,'[A-Za-z0-9]')))) as bigint) as sentences,
        cast(sum(len(regexp_extract_all(case_text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'))) as bigint) as tokens, count(distinct article_id) as articles, count(*) as texts from cases where case_text is not null""",
    ),
}
