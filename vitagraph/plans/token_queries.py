"""Queries of the token pipeline: stems, normal forms, stem matching; with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.functions import stem as S
from vitagraph.functions import text as T
from vitagraph.operators import matching as M
from vitagraph.operators import nodes as N
from vitagraph.operators.edges import patient_runs
from vitagraph.plans.clinical_queries import _ORDER_SQL, _PATIENT, _TEXTS, case_sentences
from vitagraph.plans.text_queries import SHAPE_SQL
from vitagraph.sources.tables import checkpointed, table

_KEYS = ["case_id", "sent_no"]
#: Words whose case is kept (a parameter).
KEPT = ["CT", "MRI", "CEA", "COVID", "HIV"]


def _stems(words):
    return S.stem_words(words, "word")


def stems(spark, sf_dir):
    return _stems(table(spark, sf_dir, "cases").select(F.explode(T.words(F.col("case_text"))).alias("word")))


def word_tokens(spark, sf_dir):
    """Word and punctuation tokens of all texts, in lower case but for a kept list."""
    toks = table(spark, sf_dir, "cases").select(F.explode(T.lower_but(T.word_tokens(F.col("case_text")), KEPT)).alias("token"))
    return toks.groupBy("token").agg(F.count("*").alias("n"))


def processed(spark, sf_dir):
    """Tokens of every case's sentences with place, punctuation flag and normal form."""
    toks = case_sentences(spark, sf_dir).select(*_KEYS, F.posexplode(T.word_tokens(F.col("sentence"))).alias("at", "token"))
    stem = _stems(toks.select(F.col("token").alias("word"))).select(F.col("word").alias("token"), F.col("stem").alias("norm"))
    return toks.withColumn("is_punct", ~F.col("token").rlike(r"[A-Za-z0-9]")).join(stem, "token").select(*_KEYS, "at", "token", "is_punct", "norm")


def preprocessed(spark, sf_dir):
    """Stems of the texts' tokens without punctuation and numbers; a kept list stays."""
    toks = table(spark, sf_dir, "cases").select(F.explode(T.lower_but(T.word_tokens(F.col("case_text")), KEPT)).alias("token"))
    toks = toks.where(F.col("token").rlike("[A-Za-z0-9]") & ~F.col("token").rlike(r"^[0-9.,/]+$"))
    counted = toks.groupBy("token").agg(F.count("*").alias("n"))
    stem = _stems(counted.select(F.col("token").alias("word")))
    out = F.when(F.col("token").isin(KEPT), F.col("token")).otherwise(F.col("stem"))
    return counted.join(stem, counted["token"] == stem["word"]).groupBy(out.alias("stem")).agg(F.sum("n").alias("n"))


def phrases(spark, sf_dir):
    """Labels as the stems of their words."""
    return M.stemmed_phrases(table(spark, sf_dir, "v4_nodes").where("label is not null").select("label").distinct(), "label")


#: Terms that are no entities (a parameter).
STOPPED = ["pain"]


def full_dictionary(spark, sf_dir):
    n = table(spark, sf_dir, "v4_nodes").where("type <> 'Patient'")
    return M.stem_dictionary(n, "label", "type", STOPPED)


def shown_dictionary(spark, sf_dir):
    d = full_dictionary(spark, sf_dir)
    return d.select("key", "n_words", "label", F.array_join("candidates", ",").alias("candidates"))


def stem_dictionary(spark, sf_dir):
    return checkpointed(full_dictionary(spark, sf_dir).where("label <> 'IGNORE'").select("key", "label"))


def _tokens(spark, sf_dir):
    return N.sentence_tokens(case_sentences(spark, sf_dir), _KEYS, "sentence")


def feature_counts(spark, sf_dir):
    """How many tokens have each feature."""
    f = _tokens(spark, sf_dir).select(F.explode(N.token_features()).alias("f")).select(F.explode("f.names").alias("feature"))
    return f.groupBy("feature").agg(F.count("*").alias("n"))


def bags(spark, sf_dir):
    """The bag of words around each token."""
    f = _tokens(spark, sf_dir).select(*_KEYS, F.explode(N.token_features()).alias("f"))
    bag = F.array_join(F.array_sort(F.filter("f.names", lambda x: x.startswith("ctx:="))), " ")
    return f.select(*_KEYS, F.col("f.i").alias("at"), bag.alias("bag"))


def _spans(spark, sf_dir):
    """Each sentence's tokens, and its dictionary terms by words with their candidates."""
    words = T.words(F.col("sentence"))
    d = checkpointed(full_dictionary(spark, sf_dir))
    found = M.match_stems(case_sentences(spark, sf_dir), _KEYS, "sentence", d.select("key", "label"), patient_runs).where("label <> 'Patient'")
    spans = found.join(d.select(F.col("key").alias("term"), "candidates"), "term").groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "candidates"))).alias("spans"))
    toks = case_sentences(spark, sf_dir).select(*_KEYS, F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("token"))).alias("toks"))
    return toks.join(spans, _KEYS)


def dictionary_counts(spark, sf_dir):
    """How many words have each dictionary feature."""
    f = _spans(spark, sf_dir).select(F.explode(N.dictionary_features()).alias("f")).select(F.explode("f.names").alias("feature"))
    return f.groupBy("feature").agg(F.count("*").alias("n"))


def training_labels(spark, sf_dir):
    """Words by label, and how many of them are left out of training."""
    f = _spans(spark, sf_dir).select(F.explode(N.bio_labels()).alias("f")).select("f.label", "f.ambiguous")
    return f.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("ambiguous") | (F.col("label") == "IGNORE")).alias("left_out"))


def label_report(spark, sf_dir):
    """``section``, ``name``, ``n``: words and how many a span covers, spans by label, and
    spans of ambiguous terms by their candidates."""
    d = checkpointed(full_dictionary(spark, sf_dir).where("label <> 'IGNORE'"))
    lines = case_sentences(spark, sf_dir)
    spans = checkpointed(M.match_stems(lines, _KEYS, "sentence", d.select("key", "label"), patient_runs))
    section = lambda name, df: df.select(F.lit(name).alias("section"), "name", "n")
    words = lines.agg(F.sum(F.size(T.words(F.col("sentence")))).cast("bigint").alias("n")).withColumn("name", F.lit("words"))
    covered = spans.agg(F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("n")).withColumn("name", F.lit("covered"))
    labels = spans.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"))
    unsure = spans.join(d.where(F.size("candidates") > 1).select(F.col("key").alias("term"), "candidates"), "term").groupBy(F.array_join("candidates", "|").alias("name")).agg(F.count("*").alias("n"))
    return section("total", words).unionByName(section("total", covered)).unionByName(section("label", labels)).unionByName(section("ambiguous", unsure))


def vectorizer(spark, sf_dir):
    """Feature names of the tokens with their columns."""
    f = _tokens(spark, sf_dir).select(F.explode(N.token_features()).alias("f"))
    return N.feature_index(f.select("f.names"), "names")


def stem_matches(spark, sf_dir):
    """Dictionary terms in the sentences of the cases, by their stems, patients first."""
    return M.match_stems(case_sentences(spark, sf_dir), _KEYS, "sentence", stem_dictionary(spark, sf_dir), patient_runs)


_RANK = _ORDER_SQL.replace("case t ", "case c ")
_W = "regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')"
_TOK = f"regexp_extract_all({{0}}, '{T.WORD_TOKEN.replace(chr(39), chr(39) * 2)}')"
_KEEP = ", ".join(f"'{k}'" for k in KEPT)
_LOWERED = f"case when token in ({_KEEP}) then token else lower(token) end"
_ALL_TOKENS = f"select {_LOWERED} as token from (select unnest({_TOK.format('case_text')}) as token from cases where case_text is not null)"
_PHRASES = f"""pw as (select label, unnest({_W.format('label')}) as word, generate_subscripts({_W.format('label')}, 1) as i from (select distinct label from v4_nodes where label is not null)),
 ps as ({S.stem_sql("select distinct word from pw")}), pk as (select label, string_agg(stem, ' ' order by i) as key from pw join ps using (word) group by label)"""

_VARIANTS = r"""l as (select distinct label, type as c from v4_nodes where label is not null and type is not null and type <> 'Patient' and not (type = 'Anatomy' and regexp_matches(lower(label), '%s'))),
 va as (select c, trim(regexp_replace(lower(label),'\\s+',' ','g')) as low from l), vb as (select c, low, trim(regexp_replace(regexp_replace(low,'\\([^)]*\\)',' ','g'),'\\s+',' ','g')) as bare from va), vc as (select c, low, bare, string_split(bare, ', ') as p from vb),
 vv as (select distinct c, v from (select c, unnest([low, bare, case when len(p)=2 then p[2] || ' ' || p[1] end]) as v from vc) where v is not null and v <> '')""" % M.CELL_LINE
_DICT = f"""{_VARIANTS}, vw as (select v, unnest({_W.format('v')}) as word, generate_subscripts({_W.format('v')}, 1) as i from (select distinct v from vv)), vs as ({S.stem_sql("select distinct word from vw")}),
 vk as (select v, string_agg(stem, ' ' order by i) as key from vw join vs using (word) group by v), r0 as (select distinct key, c from vv join vk using (v) where key <> '' and not (not contains(key, ' ') and (length(key) < {M.LEAST_SINGLE} or regexp_full_match(key, '[0-9]+'))) and key not in ({", ".join(f"'{w}'" for w in STOPPED)})),
 r1 as (select *, count(*) over (partition by key) as n from r0), r2 as (select * from r1 where not (c = 'Procedure' and n > 1)), r3 as (select *, count(*) over (partition by key) as n2 from r2), r4 as (select * from r3 where not (c = 'Anatomy' and n2 > 1)),
 dict as (select key, cast(len(string_split(key,' ')) as integer) as n_words, case when max(n) = 1 and min(c) = 'Procedure' then 'IGNORE' else first(c order by {_RANK}, c) end as label, list(c order by {_RANK}, c) as candidates from r4 group by key)"""
_FOUND = f"""{_TEXTS}, {_DICT}, tk as (select case_id, sent_no, unnest({_W.format('sentence')}) as word, cast(generate_subscripts({_W.format('sentence')}, 1) - 1 as integer) as i from n), st as ({S.stem_sql("select distinct word from tk")}),
 tw as (select tk.*, stem, {_PATIENT} as person from tk join st using (word)),
 gr as (select a.case_id, a.sent_no, a.i as start, b.i + 1 as stop, string_agg(c.stem, ' ' order by c.i) as key from tw a join tw b on a.case_id = b.case_id and a.sent_no = b.sent_no and b.i between a.i and a.i + (select max(n_words) from dict) - 1
   join tw c on c.case_id = a.case_id and c.sent_no = a.sent_no and c.i between a.i and b.i group by 1, 2, 3, 4 having not bool_or(c.person)),
 d as (select gr.*, label, candidates, row_number() over (partition by case_id, sent_no order by start, stop desc) as rn from gr join dict using (key) where {{where}}),
 f as (select case_id, sent_no, 0::bigint as rn, -1 as upto, null::integer as start, null::integer as stop, null::varchar as term, null::varchar as label, null::varchar[] as candidates from (select distinct case_id, sent_no from d)
   union all select d.case_id, d.sent_no, d.rn, case when d.start >= f.upto then d.stop else f.upto end, case when d.start >= f.upto then d.start end, d.stop, d.key, d.label, d.candidates from f join d on d.case_id = f.case_id and d.sent_no = f.sent_no and d.rn = f.rn + 1),
 fs as (select * from f where start is not null), pr as (select case_id, sent_no, min(i) as start, max(i) + 1 as stop, string_agg(lower(word), ' ' order by i) as term, 'Patient' as label from (select *, i - row_number() over (partition by case_id, sent_no order by i) as isle from tw where person) group by case_id, sent_no, isle),
 own as (select tk.case_id, tk.sent_no, tk.i, fs.start, fs.label, fs.candidates from tk left join fs on fs.case_id = tk.case_id and fs.sent_no = tk.sent_no and fs.start <= tk.i and tk.i < fs.stop where exists (select 1 from fs g where g.case_id = tk.case_id and g.sent_no = tk.sent_no))"""
_SHAPE = lambda x: SHAPE_SQL.replace("(word,", f"({x},")
_FEATURES = f"""{_TEXTS}, tk as (select case_id, sent_no, unnest({_TOK.format('sentence')}) as token, cast(generate_subscripts({_TOK.format('sentence')}, 1) - 1 as integer) as i from n), st as ({S.stem_sql("select distinct token as word from tk")}),
 tn as (select tk.*, lower(token) as low, stem as norm, not regexp_matches(token, '[A-Za-z0-9]') as punct from tk join st on st.word = token),
 bg as (select distinct a.case_id, a.sent_no, a.i, 'ctx:=' || b.norm as feature from tn a join tn b on a.case_id = b.case_id and a.sent_no = b.sent_no and b.i between a.i - 5 and a.i + 5 and b.i <> a.i and not b.punct),
 nb as (select a.case_id, a.sent_no, a.i, d, b.token as t, b.norm as nn, b.low as nl, a.norm as an, (case when d > 0 then '+' else '' end) || d || ':' as k from tn a cross join (values (-2), (-1), (1), (2)) v(d) left join tn b on a.case_id = b.case_id and a.sent_no = b.sent_no and b.i = a.i + d),
 ft as (select 'bias' as feature from tn union all select unnest(['lower=' || low, 'norm=' || norm, 'shape=' || {_SHAPE("token")}, 'pre3=' || left(low, 3), 'suf2=' || right(low, 2), 'suf3=' || right(low, 3), 'suf4=' || right(low, 4), 'len=' || least(length(token), 12)]) from tn
  union all select 'is_title' from tn where regexp_matches(token, '^[A-Z]') union all select 'is_upper' from tn where regexp_full_match(token, '[^a-z]*[A-Z][^a-z]*') and length(token) > 1 union all select 'has_digit' from tn where regexp_matches(low, '[0-9]') union all select 'has_hyphen' from tn where contains(low, '-')
  union all select k || 'edge' from nb where t is null union all select k || 'norm=' || nn from nb where t is not null union all select k || 'shape=' || {_SHAPE("t")} from nb where t is not null union all select k || 'is_unit' from nb where nl in ({", ".join(f"'{u}'" for u in N.UNIT_WORDS)})
  union all select k || 'suf3=' || right(nl, 3) from nb where abs(d) = 1 and t is not null union all select 'prev+cur=' || nn || '|' || an from nb where d = -1 and t is not null union all select feature from bg)"""

QUERIES = {
    "m7_stem_dictionary": (shown_dictionary, f"with {_DICT} select key, n_words, label, array_to_string(candidates, ',') as candidates from dict"),
    "m9_widest_term": (lambda s, d: M.widest(full_dictionary(s, d)), f"with {_DICT} select max(n_words) as n_words from dict"),
    "l4_token_features": (feature_counts, f"with {_FEATURES} select feature, count(*) as n from ft group by feature"),
    "w2_context_bags": (bags, f"with {_FEATURES}, b as (select case_id, sent_no, i, string_agg(feature, ' ' order by feature) as bag from bg group by 1, 2, 3) select tn.case_id, tn.sent_no, tn.i as \"at\", coalesce(bag, '') as bag from tn left join b on b.case_id = tn.case_id and b.sent_no = tn.sent_no and b.i = tn.i"),
    "l5_dictionary_features": (
        dictionary_counts,
        f"with recursive {_FOUND.replace('{where}', 'true')}, x as (select 'dict:' || array_to_string(candidates, '|') as feature from own where label is not null union all select case when start = i then 'dict_first' else 'dict_inside' end from own where label is not null"
        " union all select (case when d > 0 then '+' else '' end) || d || ':dict:' || unnest(b.candidates) from own a cross join (values (-2), (-1), (1), (2)) v(d) join own b on a.case_id = b.case_id and a.sent_no = b.sent_no and b.i = a.i + d and b.label is not null) select feature, count(*) as n from x group by feature",
    ),
    "l7_training_labels": (
        training_labels,
        f"with recursive {_FOUND.replace('{where}', 'true')}, x as (select case when label is null then 'O' when label = 'IGNORE' then 'IGNORE' else (case when start = i then 'B-' else 'I-' end) || label end as label, coalesce(len(candidates) > 1, false) as amb from own) select label, count(*) as n, count(*) filter (amb or label = 'IGNORE') as left_out from x group by label",
    ),
    "a7_label_report": (
        label_report,
        "with recursive " + _FOUND.replace("{where}", "label <> 'IGNORE'") + """ select 'total' as section, 'words' as name, count(*) as n from tk union all select 'total', 'covered', cast(sum(k) as bigint) from (select stop - start as k from fs union all select stop - start from pr)
        union all select 'label', label, count(*) from (select label from fs union all select label from pr) group by label union all select 'ambiguous', array_to_string(candidates, '|'), count(*) from fs where len(candidates) > 1 group by 2""",
    ),
    "l8_feature_index": (vectorizer, f"with {_FEATURES} select feature as name, row_number() over (order by feature) - 1 as \"column\" from (select distinct feature from ft)"),
    "t7_word_tokens": (word_tokens, f"select token, count(*) as n from ({_ALL_TOKENS}) group by token"),
    "t10_processed_tokens": (
        processed,
        f"""with {_TEXTS}, tk as (select case_id, sent_no, unnest({_TOK.format('sentence')}) as token, cast(generate_subscripts({_TOK.format('sentence')}, 1) - 1 as integer) as i from n), st as ({S.stem_sql("select distinct token as word from tk")})
        select case_id, sent_no, i as "at", token, not regexp_matches(token, '[A-Za-z0-9]') as is_punct, stem as norm from tk join st on st.word = token""",
    ),
    "t11_stems": (stems, S.stem_sql(f"select distinct unnest({_W.format('case_text')}) as word from cases")),
    "t14_preprocess_stems": (
        preprocessed,
        f"""with tk as ({_ALL_TOKENS}), k as (select token from tk where regexp_matches(token, '[A-Za-z0-9]') and not regexp_full_match(token, '[0-9.,/]+')), st as ({S.stem_sql("select distinct token as word from k")})
        select case when token in ({_KEEP}) then token else stem end as stem, count(*) as n from k join st on st.word = token group by 1""",
    ),
    "t15_phrase_stems": (phrases, f"with {_PHRASES} select label, key from pk"),
    "m3_match_stems": (
        stem_matches,
        f"""with recursive {_FOUND.replace('{where}', "label <> 'IGNORE'")} select case_id, sent_no, start, stop, term, label from fs union all select * from pr""",
    ),
}
