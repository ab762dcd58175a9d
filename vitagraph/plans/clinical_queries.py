"""Queries that extract, match, relate, score and count, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.operators import attributes as X
from vitagraph.operators import evaluate as E
from vitagraph.operators import graph as G
from vitagraph.operators import learn as L
from vitagraph.operators import matching as M
from vitagraph.operators import rules, tagger
from vitagraph.operators import scope as R
from vitagraph.plans.text_queries import LEMMA_SQL, SHAPE_SQL, apart, plain_regex
from vitagraph.sources.tables import checkpointed, latest_by, table


def _q(s: str) -> str:
    return s.replace("'", "''")


def sentences(spark, sf_dir):
    """Different sentence cells."""
    return table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null").select("sentence").distinct()


_S = "with s as (select distinct sentence from v2_edges_gemini where sentence is not null)"


def numbered(spark, sf_dir):
    """One sentence for each case and number."""
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null and case_id is not null and sentence_number is not null")
    return e.groupBy("case_id", F.col("sentence_number").alias("sent_no")).agg(F.min("sentence").alias("sentence"))


_NUMBERED = "n as (select case_id, sentence_number as sent_no, min(sentence) as sentence from v2_edges_gemini where sentence is not null and case_id is not null and sentence_number is not null group by 1,2)"


def case_sentences(spark, sf_dir):
    """All sentences of each case's current text, numbered from 1."""
    current = latest_by(table(spark, sf_dir, "cases").where("case_text is not null"), "case_id", "case_text")
    pieces = F.transform(T.split_lines_and_stops(F.col("case_text")), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    numbers = current.select("case_id", F.posexplode(F.filter(pieces, lambda p: p != "")).alias("at", "sentence"))
    return numbers.select("case_id", (F.col("at") + 1).alias("sent_no"), "sentence")


def text_sentences(spark, sf_dir):
    """Different sentences of the case texts."""
    return case_sentences(spark, sf_dir).select("sentence").distinct()


_PIECES = r"string_split(regexp_replace(regexp_replace(case_text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g'), chr(1))"
_TEXTS = (
    "ct as (select case_id, case_text, row_number() over (partition by case_id order by loaded_at is not null desc, loaded_at desc, row_id desc) as rn from cases where case_id is not null and case_text is not null), "
    rf"cp as (select case_id, list_filter(list_transform({_PIECES}, lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as ps from ct where rn = 1), "
    "n as (select case_id, cast(unnest(generate_series(1, len(ps))) as integer) as sent_no, unnest(ps) as sentence from cp)"
)
_S_TEXTS = f"with {_TEXTS}, s as (select distinct sentence from n)"


def lexicon(spark, sf_dir):
    """Dictionary of the node labels: key, label (the smallest type)."""
    n = table(spark, sf_dir, "v4_nodes").where("label is not null and type <> 'Patient'")
    return n.select(T.normalize_phrase(F.col("label")).alias("key"), "type").where("key <> ''").groupBy("key").agg(F.min("type").alias("label"))


_KEY = "trim(regexp_replace(replace(lower({0}),'-',' '),'[^a-z0-9]+',' ','g'))"
_LEX = f"lex as (select key, min(type) as label from (select {_KEY.format('label')} as key, type from v4_nodes where label is not null and type <> 'Patient') where key <> '' group by key)"


def _extract(name, of):
    return lambda s, d: of(s, d).select("sentence", F.array_join(name(F.col("sentence")), "; ").alias("found")).where("found <> ''")


def _labs(text):
    return F.regexp_extract_all(text, F.lit("(?i)" + X.LAB), F.lit(0))


def _wordy(column):
    """Letters beyond ASCII as ``_``: word characters for the oracle's ``\\b`` too."""
    return f"regexp_replace({column}, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Devanagari}}\\p{{Cyrillic}}\\p{{Greek}}À-ÖØ-öø-ɏªºµ]', '_', 'g')"


def _rx(p, g=0):
    return f"regexp_extract_all({_wordy('sentence')}, '{_q(p)}', {g}, 'i')"


_ATTR = "list_concat(" + ", ".join(f"list_transform({_rx(p)}, lambda x: '{n}=' || x)" for n, p in X.SENTENCE_PATTERNS.items()) + ")"


def modifiers(spark, sf_dir, of=sentences):
    return of(spark, sf_dir).select("sentence", *X.modifiers(F.col("sentence")))


def demographics(spark, sf_dir):
    return table(spark, sf_dir, "cases").where("case_text is not null").select("row_id", X.gender(F.col("case_text")).alias("gender"))


def ages(spark, sf_dir, of=sentences):
    return of(spark, sf_dir).select("sentence", X.age_years(F.col("sentence")).alias("age")).where("age is not null")


def vitals(spark, sf_dir):
    a = table(spark, sf_dir, "cases").where("case_text is not null").select("row_id", X.clinical_attributes(F.col("case_text")).alias("a"))
    names = ["demographics", "pressures", "heart_rates", "respiratory_rates", "saturations", "temperatures", "labs", "postoperative_days", "histories", "intervals", "dosages", "weights", "volumes"]
    return a.select("row_id", *[F.size(f"a.{n}").alias(n) for n in names])


_VITALS = {
    "demographics": X.DEMOGRAPHICS, "pressures": X.PRESSURE, "heart_rates": X.HEART_RATE, "respiratory_rates": X.RESPIRATION,
    "saturations": X.SATURATION, "temperatures": X.TEMPERATURE, "labs": X.LAB, "postoperative_days": X.POD, "histories": X.DURATION_HISTORY,
    "intervals": X.INTERVAL, "dosages": X.DOSAGE, "weights": X.BIRTH_WEIGHT, "volumes": X.VOLUME,
}


def sentence_attributes(spark, sf_dir, of=sentences):
    return of(spark, sf_dir).select("sentence", X.sentence_attributes(F.col("sentence")).alias("found")).where("found <> ''")


def quantities(spark, sf_dir, of=sentences):
    return X.typed_quantities(of(spark, sf_dir), ["sentence"], "sentence")


def merged(spark, sf_dir):
    n = table(spark, sf_dir, "v4_nodes").select("node_id", "row_id", "attributes")
    return X.merge_attributes(n, ["node_id"], "row_id", "attributes")


def _mentions(spark, sf_dir):
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null")
    entity = F.replace(F.split_part("target_id", F.lit(":"), F.lit(2)), F.lit("_"), F.lit(" "))
    kind = F.split_part("target_id", F.lit(":"), F.lit(1))
    return e.select("sentence", entity.alias("entity"), kind.alias("kind")).where("entity <> ''").distinct()


_MEN = "m as (select distinct sentence, replace(split_part(target_id,':',2),'_',' ') as entity, split_part(target_id,':',1) as kind from v2_edges_gemini where sentence is not null and replace(split_part(target_id,':',2),'_',' ') <> '')"


def negated(spark, sf_dir):
    return _mentions(spark, sf_dir).select("sentence", "entity", "kind", R.negated_in_clause(F.col("sentence"), F.col("entity")).alias("negated"))


def blocked(spark, sf_dir):
    m = _mentions(spark, sf_dir).withColumn("at", F.instr(F.lower("sentence"), F.lower("entity")) - 1).where("at >= 0")
    return m.select("sentence", "entity", "kind", R.blocked_in_window(F.col("sentence"), F.col("at")).alias("blocked"))


_KINDS = {"D": "Disease", "S": "Symptom", "E": "Exam", "R": "Result", "A": "Anatomy", "M": "Medication", "Pr": "Procedure", "Ef": "Effect"}


def related(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p])
    at = F.instr(F.lower("sentence"), F.lower("entity")) - 1
    m = _mentions(spark, sf_dir).withColumn("at", at).where("at >= 0").withColumn("type", F.coalesce(F.try_element_at(names, F.col("kind")), F.lit("Other")))
    return m.select("sentence", "entity", "kind", R.nearest_relation(R.cue_positions(F.col("sentence")), F.col("type"), F.col("at")).alias("relation"))


_CUES_SQL = " union all ".join(
    f"select sentence, '{r}' as relation, unnest(list_filter(list_transform(p, lambda x, i: case when i % 2 = 0 then cast(length(array_to_string(p[1:i-1], '')) as integer) end), lambda x: x is not null)) as c "
    f"from (select sentence, string_split(regexp_replace(sentence, '({_q(p)})', chr(1) || '\\1' || chr(1), 'gi'), chr(1)) as p from (select distinct sentence from m))"
    for r, p in R.RELATION_CUES.items()
)
_ALLOWED_SQL = " union all ".join(f"select '{k}' as type, '{x}' as relation" for k, v in R.ALLOWED_RELATIONS.items() for x in v)
_ALLOWED_SQL += " union all " + " union all ".join(f"select 'Other', '{x}'" for x in R.RELATION_CUES)
_DEFAULT_SQL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in R.DEFAULT_RELATION.items()) + " else 'MENTIONS' end"
_KIND_SQL = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in _KINDS.items()) + " else 'Other' end"


def _spans(spark, sf_dir, by, of=case_sentences):
    return M.match_terms(of(spark, sf_dir), ["case_id", "sent_no"], "sentence", lexicon(spark, sf_dir), by)


def _greedy_sql(order):
    return f"""with recursive {_NUMBERED}, {_LEX},
    w as (select case_id, sent_no, list_transform(regexp_extract_all(sentence, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda x: trim(regexp_replace(replace(lower(x),'-',' '),'[^a-z0-9]+',' ','g'))) as ws from n),
    g as (select case_id, sent_no, k as n, unnest(generate_series(1, len(ws)-k+1)) as st, ws from w, (values (1),(2),(3),(4),(5)) v(k) where len(ws) >= k),
    c as (select case_id, sent_no, st-1 as start, st-1+n as stop, array_to_string(ws[st:st+n-1], ' ') as term, n from g),
    d as (select c.case_id, c.sent_no, start, stop, term, label, row_number() over (partition by c.case_id, c.sent_no order by {order}) as rn from c join lex on term = key),
    f as (select case_id, sent_no, 0::bigint as rn, []::struct(a bigint, b bigint)[] as occ, null::bigint as start, null::bigint as stop, null::varchar as term, null::varchar as label from (select distinct case_id, sent_no from d)
      union all select d.case_id, d.sent_no, d.rn,
        case when len(list_filter(f.occ, lambda o: o.a < d.stop and d.start < o.b)) = 0 then list_append(f.occ, {{'a': d.start, 'b': d.stop}}) else f.occ end,
        case when len(list_filter(f.occ, lambda o: o.a < d.stop and d.start < o.b)) = 0 then d.start end, d.stop, d.term, d.label
      from f join d on d.case_id = f.case_id and d.sent_no = f.sent_no and d.rn = f.rn + 1)
    select case_id, sent_no, cast(start as integer) as start, cast(stop as integer) as stop, term, label from f where start is not null"""


def entity_types(spark, sf_dir, of=numbered):
    """How many entities of each type the cases' sentences mention, and in how many cases."""
    return _spans(spark, sf_dir, M.LONGEST_FIRST, of).groupBy("label").agg(F.count("*").alias("mentions"), F.count_distinct("case_id").alias("cases"))


def star_edges(spark, sf_dir):
    return G.star_edges(case_sentences(spark, sf_dir), lexicon(spark, sf_dir)).select("source_id", "target_id", "relation", "attributes", "case_id", "sentence_number")


def star_nodes(spark, sf_dir):
    return G.star_nodes(G.star_edges(case_sentences(spark, sf_dir), lexicon(spark, sf_dir)))


def tagged(spark, sf_dir):
    n = case_sentences(spark, sf_dir)
    return M.tag_text(n, ["case_id", "sent_no"], "sentence", _spans(spark, sf_dir, M.LONGEST_FIRST))


def quantity_edges(spark, sf_dir):
    """Doses and sizes of each sentence with the nearest of its edges."""
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null")
    entity = F.replace(F.split_part("target_id", F.lit(":"), F.lit(2)), F.lit("_"), F.lit(" "))
    edges = e.select("sentence", F.col("target_id").alias("edge"), "relation", (F.instr(F.lower("sentence"), F.lower(entity)) - 1).alias("e_start"), F.length(entity).alias("n")).where("e_start >= 0").distinct()
    edges = edges.select("sentence", "edge", "relation", "e_start", (F.col("e_start") + F.col("n")).alias("e_end"))
    q = quantities(spark, sf_dir).select("sentence", "q_start", "q_end", "value", "unit", "matched_rule").distinct()
    return G.bind_quantities(q, edges, ["sentence"])


def dictionary(spark, sf_dir):
    n = table(spark, sf_dir, "v4_nodes").where("type <> 'Patient'")
    d = M.dictionary(n, "label", "type")
    return d.select("key", "n_words", "label", F.array_join("candidates", ",").alias("candidates"))


_PEOPLE = ",".join(f"'{w}'" for w in M.PATIENT_WORDS)
_ORDER_SQL = "case t " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(M.PRIORITY, 1)) + " else 99 end"


def patient_runs(spark, sf_dir):
    toks = T.offset_tokens(table(spark, sf_dir, "cases").select("row_id", "case_text"), ["row_id"], "case_text")
    return M.word_runs(toks, ["row_id"], "tok_idx", "token")


def anchors(spark, sf_dir):
    """Each entity's nearest preceding patient mention in its sentence, -1 without one."""
    n = case_sentences(spark, sf_dir)
    keys = ["case_id", "sent_no"]
    toks = n.select(*keys, F.posexplode(T.words(F.col("sentence"))).alias("at", "token"))
    people = M.word_runs(toks, keys, "at", "token").select(*keys, F.col("run_start").alias("start"), (F.col("run_stop") + 1).alias("stop"))
    found = G.nearest_anchor(_spans(spark, sf_dir, M.LONGEST_FIRST), people, keys)
    return found.fillna(-1, ["a_start", "a_stop"])


_GUESS = {"TAKES": "M", "UNDERWENT_EXAM": "E", "REVEALS": "R", "DIAGNOSED_WITH": "D", "PRESENTS_WITH": "S", "LOCATED_IN": "A"}


def _gold_pred(spark, sf_dir):
    """The kind of each edge's target, and the kind that its relation suggests."""
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence_number is not null")
    guess = F.create_map(*[F.lit(x) for p in _GUESS.items() for x in p])
    base = e.select("case_id", F.col("sentence_number").alias("start"), (F.col("sentence_number") + 1).alias("stop"), F.split_part("target_id", F.lit(":"), F.lit(1)).alias("g"), F.coalesce(F.try_element_at(guess, F.col("relation")), F.lit("N")).alias("p"))
    return base.select("case_id", "start", "stop", F.col("g").alias("label")), base.select("case_id", "start", "stop", F.col("p").alias("label"))


_GP = "base as (select case_id, sentence_number as start, split_part(target_id,':',1) as g, case relation " + " ".join(f"when '{k}' then '{v}'" for k, v in _GUESS.items()) + " else 'N' end as p from v2_edges_gemini where sentence_number is not null), gs as (select distinct case_id, start, g as label from base), ps as (select distinct case_id, start, p as label from base)"
_SCORES = f"""with {_GP}, j as (select coalesce(gs.label, ps.label) as label, gs.label is not null as g, ps.label is not null as p from gs full join ps on gs.case_id=ps.case_id and gs.start=ps.start and gs.label=ps.label),
 k as (select label, count(*) filter (g) as support, count(*) filter (p) as predicted, count(*) filter (g and p) as tp, count(*) filter (p and not g) as fp, count(*) filter (g and not p) as fn from j group by label),
 r as (select *, round(case when tp+fp=0 then 0 else tp::double/(tp+fp) end,6) as precision, round(case when tp+fn=0 then 0 else tp::double/(tp+fn) end,6) as recall from k),
 z as (select *, round(case when precision+recall=0 then 0 else 2*precision*recall/(precision+recall) end,6) as f1 from r) """


def lm(spark, sf_dir, of=sentences):
    s = of(spark, sf_dir).select(T.words(F.lower("sentence")).alias("t"))
    return L.laplace(L.ngram_model(s, "t", 3))


_LM = r"""with s as (select distinct sentence from v2_edges_gemini where sentence is not null), t as (select list_concat(['<s>','<s>'], regexp_extract_all(lower(sentence), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), ['</s>','</s>']) as p from s),
 g as (select k as n, unnest(list_transform(generate_series(1, len(p)-k+1), lambda i: {'context': array_to_string(p[i:i+k-2], ' '), 'word': p[i+k-1]})) as x from t, (values (1),(2),(3)) v(k)),
 c as (select n, case when n = 1 then '' else x.context end as context, x.word as word, count(*) as c from g group by 1,2,3), v as (select count(*) as v from c where n=1)
 select n, context, word, c, cast(sum(c) over (partition by n, context) as bigint) as total, round((c+1)::double/(sum(c) over (partition by n, context) + v.v),9) as p from c, v"""


def pmi(spark, sf_dir):
    e = table(spark, sf_dir, "v2_edges_gemini").select("relation", "target_id").where("relation is not null and target_id is not null")
    return L.pmi(e, "relation", "target_id")


def tfidf(spark, sf_dir):
    e = table(spark, sf_dir, "v2_edges_gemini").where("sentence is not null and relation is not null").select("relation", F.explode(T.words(F.lower("sentence"))).alias("token"))
    return L.tfidf(e, "relation", "token")


def neighbours(spark, sf_dir):
    n = case_sentences(spark, sf_dir)
    toks = n.select("case_id", "sent_no", F.posexplode(T.words(F.col("sentence"))).alias("at", "token"))
    return L.neighbour_features(toks, ["case_id", "sent_no"], "at", "token")


def bio(spark, sf_dir):
    """Spans again from the tags of all words, those of matched entities being I- tags."""
    keys = ["case_id", "sent_no"]
    listed = _spans(spark, sf_dir, M.LONGEST_FIRST).groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "label")).alias("s"))
    words = case_sentences(spark, sf_dir).select(*keys, T.words(F.col("sentence")).alias("w")).join(listed, keys)
    own = lambda i: F.get(F.filter("s", lambda x: (x["start"] <= i) & (i < x["stop"])), F.lit(0))["label"]
    tags = words.select(*keys, F.posexplode(F.transform("w", lambda w, i: F.coalesce(F.concat(F.lit("I-"), own(i)), F.lit("O")))).alias("at", "tag"))
    return E.bio_spans(E.repair_bio(tags, keys, "at", "tag"), keys, "at")


def rule_edges(spark, sf_dir):
    e = rules.rule_edges(case_sentences(spark, sf_dir), lexicon(spark, sf_dir))
    return e.select("case_id", "sent_no", "rule", "source", "target", "relation", "attributes")


def ngram_entities(spark, sf_dir):
    """Entities of all sentences, each by models of the tagged sentences of the other
    half of the articles."""
    keys = ["case_id", "sent_no"]
    half = F.pmod(F.xxhash64(F.regexp_replace("case_id", r"_[^_]*\z", "")), F.lit(2))
    lines = checkpointed(tagged(spark, sf_dir).select(*keys, F.transform(F.split("tagged", " "), lambda t: F.when(t.startswith("TAG-"), t).otherwise(F.lower(t))).alias("tokens")))
    plain = case_sentences(spark, sf_dir).select(*keys, T.words(F.lower("sentence")).alias("tokens"))
    found = None
    for h in (0, 1):
        part = tagger.find_entities(plain.where(half == h), keys, "tokens", tagger.fit_tagger(lines.where(half != h).select("tokens"), "tokens"))
        found = part if found is None else found.unionByName(part)
    return found


_WORDS = "regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-\'\'][A-Za-z0-9]+)*')"
_SP = f"sp as ({_greedy_sql('n desc, start').replace(_NUMBERED, _TEXTS)}), {_TEXTS}, ww as (select case_id, sent_no, sentence, {_WORDS.format('sentence')} as w from n), tk as (select case_id, sent_no, unnest(w) as word, cast(generate_subscripts(w, 1) - 1 as integer) as i from ww)"
_PATIENT = f"(lower(word) in ({_PEOPLE}) or ({LEMMA_SQL}) in ({_PEOPLE}))"
_BIO = f"""with {_SP}, t as (select tk.case_id, tk.sent_no, i, label from tk join sp on sp.case_id = tk.case_id and sp.sent_no = tk.sent_no and start <= i and i < stop),
 g as (select *, lag(i) over (partition by case_id, sent_no order by i) as pi, lag(label) over (partition by case_id, sent_no order by i) as pl from t),
 k as (select *, sum(case when pi = i - 1 and pl = label then 0 else 1 end) over (partition by case_id, sent_no order by i) as isle from g)
 select case_id, sent_no, min(i) as start, max(i) + 1 as stop, min(label) as label from k group by case_id, sent_no, isle"""
_ANCHOR = f"""with {_SP}, pr as (select case_id, sent_no, min(i) as a_start, max(i) + 1 as a_stop from (select *, i - row_number() over (partition by case_id, sent_no order by i) as isle from tk where {_PATIENT}) group by case_id, sent_no, isle),
 j as (select sp.*, a_start, a_stop, row_number() over (partition by sp.case_id, sp.sent_no, start, stop, term, label order by not (a_stop <= start), abs(start - a_start), a_start) as rn from sp left join pr on pr.case_id = sp.case_id and pr.sent_no = sp.sent_no)
 select case_id, sent_no, start, stop, term, label, coalesce(a_start, -1) as a_start, coalesce(a_stop, -1) as a_stop from j where rn = 1"""
_TAGGED = f"""with {_SP}, t as (select tk.case_id, tk.sent_no, i, case when start is null then word when start = i then 'TAG-' || upper(label) end as x from tk left join sp on sp.case_id = tk.case_id and sp.sent_no = tk.sent_no and start <= i and i < stop),
 u as (select case_id, sent_no, string_agg(x, ' ' order by i) as tagged from t group by 1, 2) select n.case_id, n.sent_no, coalesce(tagged, '') as tagged from n left join u on u.case_id = n.case_id and u.sent_no = n.sent_no"""
_NEAR = f"""with {_TEXTS}, ww as (select case_id, sent_no, {_WORDS.format('sentence')} as w from n), tk as (select case_id, sent_no, unnest(w) as word, cast(generate_subscripts(w, 1) - 1 as integer) as i from ww)
 select case_id, sent_no, i as "at", lower(word) as w, {SHAPE_SQL} as shape, {", ".join(f"coalesce({'lag' if d > 0 else 'lead'}(lower(word), {abs(d)}) over (partition by case_id, sent_no order by i), 'edge') as w{'m' if d > 0 else 'p'}{abs(d)}" for d in (2, 1, -1, -2))} from tk"""
_TEXT_CUES = " union all ".join(
    f"select case_id, sent_no, '{r}' as relation, unnest(list_filter(list_transform(p, lambda x, i: case when i % 2 = 0 then cast(length(array_to_string(p[1:i-1], '')) as integer) end), lambda x: x is not null)) as c "
    f"from (select case_id, sent_no, string_split(regexp_replace({_wordy('sentence')}, '({_q(p)})', chr(1) || '\\1' || chr(1), 'gi'), chr(1)) as p from n)"
    for r, p in R.RELATION_CUES.items()
)
_LABEL_DEFAULT = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in R.DEFAULT_RELATION.items()) + " else 'MENTIONS' end"
_NODE = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in T.NODE_PREFIX.items()) + f" else 'N' end || ':' || replace({_KEY.format('term')}, ' ', '_')"
_WINDOWED = lambda p, a, b: f"regexp_matches(substr({_wordy('sentence')}, greatest(pos0 - {a}, 0) + 1, least(pos0, {a}) + {b}), '{_q(p)}', 'i')"
_STAR = f"""with {_SP}, cutp as (select case_id, sent_no, string_split(regexp_replace(sentence, '([A-Za-z0-9]+(?:[-\'\'][A-Za-z0-9]+)*)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p from n),
 ats as (select case_id, sent_no, unnest(list_transform(p, lambda x, i: {{'i': i, 'a': cast(length(array_to_string(p[1:i-1], '')) as integer)}}), recursive := true) from cutp),
 e as (select sp.*, ats.a as pos0, sentence from sp join ats on ats.case_id = sp.case_id and ats.sent_no = sp.sent_no and ats.i = 2 * sp.start + 2 join n on n.case_id = sp.case_id and n.sent_no = sp.sent_no),
 f as (select * from e where not ({_WINDOWED(R.WINDOW_NEGATION, 60, 0)} or {_WINDOWED(R.WINDOW_UNCERTAINTY, 35, 90)})),
 cues as ({_TEXT_CUES}), allowed as ({_ALLOWED_SQL}),
 x as (select f.case_id, f.sent_no, f.start, first(c.relation order by abs(c.c - f.pos0), c.relation) as r from f join cues c on c.case_id = f.case_id and c.sent_no = f.sent_no
   join allowed w on w.type = (case when f.label in ({", ".join(f"'{k}'" for k in R.ALLOWED_RELATIONS)}) then f.label else 'Other' end) and w.relation = c.relation group by 1, 2, 3),
 at0 as (select case_id, sent_no, {_ATTR} as l from n), at1 as (select case_id, sent_no, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') as attributes from at0),
 st as (select distinct 'P:' || f.case_id as source_id, {_NODE} as target_id, coalesce(x.r, {_LABEL_DEFAULT}) as relation, attributes, f.case_id, f.sent_no as sentence_number, f.sentence, f.term as label, f.label as type
   from f left join x on x.case_id = f.case_id and x.sent_no = f.sent_no and x.start = f.start join at1 on at1.case_id = f.case_id and at1.sent_no = f.sent_no)"""

_QN = r"\d+(?:,\d{3})*(?:\.\d+)?"


def quantities_sql(source: str, keys: str) -> str:
    """``q3``: the quantities of a table of sentences with their places."""
    first = lambda x: f"regexp_extract({x}, '^{_QN}(?:/{_QN})?', 0)"
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    return f"""q0 as (select {keys}, string_split(regexp_replace({apart('sentence')}, '({plain_regex(X.QUANTITY_TOKEN)})', chr(2) || '\\1' || chr(2), 'g'), chr(2)) as p from {source}),
 q1 as (select {keys}, p, unnest(generate_series(2, len(p), 2)) as i from q0),
 q2 as (select {keys}, cast(i // 2 - 1 as integer) as token_index, p[i] as quantity, cast(length(replace(array_to_string(p[1:i-1], ''), chr(1), '')) as integer) as q_start, case when i > 2 then lower(p[i-2]) else '' end as b1, case when i > 4 then lower(p[i-4]) else '' end as b2,
   case {" ".join(f"when regexp_matches(p[i], '{_q(r)}') then '{n}'" for n, r in X.QUANTITY_RULES.items())} end as rule from q1 where regexp_matches(p[i], '^[0-9]')),
 q3 as (select {keys}, token_index, quantity, q_start, cast(q_start + length(quantity) as integer) as q_end, case when rule = 'dimension' then quantity else {first("quantity")} end as value,
   case when rule = 'numero_puro' and b1 in ('day', 'pod') then b1 when rule = 'numero_puro' then '' when rule = 'dimension' then lower(regexp_extract(quantity, '(?i)(?:cm|mm)', 0)) else regexp_replace(substr(quantity, length({first("quantity")}) + 1), '^[\\s-]+', '') end as unit,
   case when rule = 'numero_puro' and b1 in ('day', 'pod') then 'time' else rule end as matched_rule from q2
   where rule is not null and not (b1 in ({words(X._FIGURE)}) or b2 in ({words(X._FIGURE)})) and not regexp_matches(quantity, '(?i)(?:year|years|month)-old$') and (rule <> 'numero_puro' or b1 in ({words(X._COUNTED)})))"""


_FITS_SQL = "case matched_rule " + " ".join("when '{}' then label in ({})".format(k, ", ".join(f"'{x}'" for x in v)) for k, v in G.RULE_RELATIONS.items()) + " else false end"


def _found_sql(name: str, pattern: str) -> str:
    """Matches of a pattern in each sentence: ``at``, ``stop``, ``x`` and their order."""
    cut = f"string_split(regexp_replace({_wordy('sentence')}, '({_q(pattern)})', chr(1) || '\\1' || chr(1), 'gi'), chr(1))"
    return (
        f"{name} as (select case_id, sent_no, i, cast(length(array_to_string(p[1:i-1], '')) as integer) as pos0, cast(length(array_to_string(p[1:i], '')) as integer) as stop, p[i] as x"
        f" from (select case_id, sent_no, p, unnest(generate_series(2, len(p), 2)) as i from (select case_id, sent_no, {cut} as p from n)))"
    )


_IN = lambda a, b: f"{a}.case_id = {b}.case_id and {a}.sent_no = {b}.sent_no"
_NEGATED_SQL = f"len(list_filter(regexp_split_to_array(sentence, '{_q(R.CONTRAST)}', 'i'), lambda c: regexp_matches(c, '{_q(R.NEGATED_AFTER)}', 'i') and contains(lower(regexp_extract(c, '{_q(R.NEGATED_AFTER)}', 1, 'i')), lower(term)))) > 0"
_GAP = lambda a, b: f"greatest(0, {a}.pos0 - {b}.stop, {b}.pos0 - {a}.stop)"
_RULES = f"""with sp as ({_greedy_sql("start, n desc").replace(_NUMBERED, _TEXTS)}), {_TEXTS},
 en as (select sp.case_id, sp.sent_no, sp.start, sp.term, sp.label, strpos(lower(sentence), term) - 1 as pos0, strpos(lower(sentence), term) - 1 + length(term) as stop, lower(sentence) as low, sentence from sp join n on {_IN("sp", "n")} where not ({_NEGATED_SQL})),
 md as (select case_id, sent_no, {_rx(X.POD, 1)}[1] as pod, coalesce({_rx(X.DURATION_HISTORY)}[1], {_rx(X.DURATION)}[1]) as duration, lower({_rx(X.LATERALITY, 1)}[1]) as laterality, lower({_rx(X.ASPECT, 1)}[1]) as aspect from n),
 {_found_sql("sz", rules._SIZES)}, {_found_sql("lv", X.LAB)}, {_found_sql("ds", X.DOSAGE)},
 rs as (select * from en where label = 'Result'),
 szn as (select sz.*, r.term, row_number() over (partition by sz.case_id, sz.sent_no, sz.i order by {_GAP("r", "sz")}, r.pos0, r.start) as rn from sz join rs r on {_IN("r", "sz")} where r.pos0 >= 0),
 mine as (select r.case_id, r.sent_no, r.start, arg_max(szn.x, szn.i) as size from rs r join szn on {_IN("r", "szn")} and szn.rn = 1 and szn.term = r.term where {_GAP("r", "szn")} < {rules.SIZE_REACH} group by 1, 2, 3),
 lvn as (select lv.*, r.term, row_number() over (partition by lv.case_id, lv.sent_no, lv.i order by lv.pos0 - r.stop, r.pos0, r.start) as rn from lv join rs r on {_IN("r", "lv")} where r.pos0 >= 0 and r.stop <= lv.pos0),
 labs as (select r.case_id, r.sent_no, r.start, string_agg('value=' || regexp_extract(lvn.x, '(?i){_q(X.LAB)}', 1) || '; unit=' || regexp_extract(lvn.x, '(?i){_q(X.LAB)}', 2), '; ' order by lvn.i) as lab from rs r join lvn on {_IN("r", "lvn")} and lvn.rn = 1 and lvn.term = r.term where lvn.pos0 - r.stop < {rules.LAB_REACH} group by 1, 2, 3),
 ra as (select rs.*, concat_ws('; ', 'size=' || size, lab, case when contains(low, 'normal') and contains(rs.term, 'echotexture') then 'status=normal' end) as attributes from rs left join mine on {_IN("mine", "rs")} and mine.start = rs.start left join labs on {_IN("labs", "rs")} and labs.start = rs.start),
 dn as (select m.case_id, m.sent_no, m.start, ds.x, row_number() over (partition by m.case_id, m.sent_no, m.start order by case when m.pos0 >= 0 then abs(ds.pos0 - m.stop) else ds.pos0 end, ds.pos0) as rn from en m join ds on {_IN("m", "ds")} where m.label = 'Medication'),
 an as (select * from en where label = 'Anatomy'), ex as (select * from en where label = 'Exam'),
 di as (select *, contains(low, 'history') and (contains(low, 'medical') or contains(low, 'past')) as hist from en where label = 'Disease')
 select case_id, cast(sent_no as integer) as sent_no, rule, source, target, relation, attributes from (
 select e.case_id, e.sent_no, 'symptom' as rule, 'P:' || e.case_id as source, e.term as target, 'PRESENTS_WITH' as relation, coalesce('duration=' || duration, '') as attributes from en e join md on {_IN("e", "md")} where e.label = 'Symptom'
 union all select e.case_id, e.sent_no, 'symptom', e.term, an.term, 'LOCATED_IN', coalesce('laterality=' || laterality, '') from en e join an on {_IN("e", "an")} join md on {_IN("e", "md")} where e.label = 'Symptom' and contains(e.term, 'pain')
 union all select m.case_id, m.sent_no, 'medication', 'P:' || m.case_id, m.term, 'TAKES', coalesce('dosage=' || dn.x, '') from en m left join dn on {_IN("m", "dn")} and dn.start = m.start and dn.rn = 1 where m.label = 'Medication'
 union all select ex.case_id, ex.sent_no, 'exam', 'P:' || ex.case_id, ex.term, 'UNDERWENT_EXAM', coalesce('timeline=' || pod, '') from ex join md on {_IN("ex", "md")}
 union all select ex.case_id, ex.sent_no, 'exam', ex.term, ra.term, 'REVEALS', ra.attributes from ex join ra on {_IN("ex", "ra")}
 union all select ex.case_id, ex.sent_no, 'exam', rs.term, an.term, 'LOCATED_IN', coalesce('aspect=' || aspect, '') from ex join rs on {_IN("ex", "rs")} join an on {_IN("ex", "an")} join md on {_IN("ex", "md")}
 union all select di.case_id, di.sent_no, 'disease', 'P:' || di.case_id, di.term, case when not hist then 'DIAGNOSED_WITH' when contains(low, 'family') then 'HAS_FAMILY_HISTORY' else 'HAS_PERSONAL_HISTORY' end,
   case when hist then '' when contains(low, 'pathology') then 'status=confirmed; method=pathology' when regexp_matches(low, 'suggesting|suspected') then 'status=suspected; method=clinical/imaging' else 'status=confirmed' end from di
 union all select di.case_id, di.sent_no, 'disease', di.term, an.term, 'LOCATED_IN', coalesce('aspect=' || aspect, '') from di join an on {_IN("di", "an")} join md on {_IN("di", "md")})"""

QUERIES = {
    "r4_rule_edges": (rule_edges, _RULES),
    "r9_variant_edges": (
        lambda s, d: rules.variant_edges(case_sentences(s, d), lexicon(s, d)).select("case_id", "sent_no", "rule", "source", "target", "relation", "attributes", "target_attributes"),
        f"with r as ({_RULES}), {_TEXTS} select r.case_id, r.sent_no, rule, source, target, relation, case when relation = 'REVEALS' then '' else attributes end as attributes, case when relation = 'REVEALS' then attributes else '' end as target_attributes from r join n on n.case_id = r.case_id and n.sent_no = r.sent_no"
        f" where {' and '.join(f'not contains(lower(sentence), {w!r})' for w in rules.SKIPPED)} and (rule <> 'symptom' or regexp_matches(lower(sentence), '{'|'.join(rules.TELLING)}'))",
    ),
    "l19_ngram_entities": (ngram_entities, None),
    "x5_sentence_attributes": (
        sentence_attributes,
        f"{_S}, l as (select sentence, {_ATTR} as l from s) select sentence, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') as found from l where len(l) > 0",
    ),
    "x1_sizes": (
        _extract(X.sizes, text_sentences),
        f"""{_S_TEXTS}, a as (select sentence, {_wordy('sentence')} as t from s), b as (select sentence, t, regexp_replace(t, '{X.SIZE_3D}', chr(1), 'gi') as t2 from a), c as (select *, regexp_replace(t2, '{X.SIZE_2D}', chr(1), 'gi') as t1 from b),
        d as (select sentence, list_concat(regexp_extract_all(t, '{X.SIZE_3D}', 0, 'i'), regexp_extract_all(t2, '{X.SIZE_2D}', 0, 'i'), regexp_extract_all(t1, '{X.SIZE_1D}', 0, 'i')) as l from c) select sentence, array_to_string(l, '; ') as found from d where len(l) > 0""",
    ),
    "x2_labs": (_extract(_labs, sentences), f"{_S} select sentence, array_to_string({_rx(X.LAB)}, '; ') as found from s where len({_rx(X.LAB)}) > 0"),
    "x4_modifiers": (
        modifiers,
        f"{_S} select sentence, {_rx(X.POD, 1)}[1] as pod, coalesce({_rx(X.DURATION_HISTORY)}[1], {_rx(X.DURATION)}[1]) as duration, lower({_rx(X.LATERALITY, 1)}[1]) as laterality, lower({_rx(X.ASPECT, 1)}[1]) as aspect, array_to_string({_rx(X.DOSAGE)}, '; ') as dosages from s",
    ),
    "x6_clinical_attributes": (vitals, "select row_id, " + ", ".join(f"cast(len(regexp_extract_all({_wordy('case_text')}, '{_q(p)}', 0, 'i')) as integer) as {n}" for n, p in _VITALS.items()) + " from cases where case_text is not null"),
    "x8_typed_quantities": (lambda s, d: quantities(s, d, text_sentences).drop("q_start", "q_end"), f"{_S_TEXTS}, {quantities_sql('s', 'sentence')} select sentence, token_index, quantity, value, unit, matched_rule from q3"),
    "x11_age": (
        ages,
        f"{_S}, a as (select sentence, lower({_rx(X.AGE, 1)}[1]) as num, lower({_rx(X.AGE, 2)}[1]) as u from s) select sentence, round(coalesce(case num "
        + " ".join(f"when '{w}' then {i}.0" for i, w in enumerate(X.NUMBER_WORDS, 1)) + " end::double, try_cast(num as double)) * (case u when 'year' then 1.0::double when 'yr' then 1.0::double when 'month' then 1.0::double/12 when 'week' then 1.0::double/52 when 'day' then 1.0::double/365 end), 3) as age from a where num is not null",
    ),
    "x12_gender": (
        demographics,
        f"""with c as (select row_id, lower(regexp_extract_all(case_text, '\\b(?:male|man|men|boy|gentleman|female|woman|women|girl|lady)\\b', 0, 'i')[1]) as noun,
        len(regexp_extract_all(case_text, '{X.MALE_PRONOUNS}', 0, 'i')) as m, len(regexp_extract_all(case_text, '{X.FEMALE_PRONOUNS}', 0, 'i')) as f from cases where case_text is not null)
        select row_id, case when regexp_full_match(noun, 'male|man|men|boy|gentleman') then 'Male' when noun is not null then 'Female' when m > f then 'Male' when f > m then 'Female' end as gender from c""",
    ),
    "s13_merge_attributes": (
        merged,
        "select node_id, list_reduce(list(coalesce(attributes, '') order by row_id), lambda acc, x: case when x = '' then acc when acc = '' then x when contains(acc, x) then acc else acc || '; ' || x end) as attributes from v4_nodes group by node_id",
    ),
    "r1_negated": (
        negated,
        f"with {_MEN} select sentence, entity, kind, len(list_filter(regexp_split_to_array(sentence, '{_q(R.CONTRAST)}', 'i'), lambda c: regexp_matches(c, '{_q(R.NEGATED_AFTER)}', 'i') and contains(lower(regexp_extract(c, '{_q(R.NEGATED_AFTER)}', 1, 'i')), lower(entity)))) > 0 as negated from m",
    ),
    "r2_blocked": (
        blocked,
        f"""with {_MEN}, a as (select *, strpos(lower(sentence), lower(entity)) - 1 as pos0 from m) select sentence, entity, kind, regexp_matches(substr(sentence, greatest(pos0-60,0)+1, least(pos0,60)), '{_q(R.WINDOW_NEGATION)}', 'i')
        or regexp_matches(substr(sentence, greatest(pos0-35,0)+1, least(pos0,35)+90), '{_q(R.WINDOW_UNCERTAINTY)}', 'i') as blocked from a where pos0 >= 0""",
    ),
    "r3_nearest_relation": (
        related,
        f"""with {_MEN}, a as (select *, strpos(lower(sentence), lower(entity)) - 1 as pos0, {_KIND_SQL} as type from m), cues as ({_CUES_SQL}), allowed as ({_ALLOWED_SQL}),
        x as (select a.sentence, a.entity, a.kind, first(c.relation order by abs(c.c - a.pos0), c.relation) as r from a join cues c on a.sentence = c.sentence join allowed w on w.type = a.type and w.relation = c.relation where pos0 >= 0 group by 1,2,3)
        select a.sentence, a.entity, a.kind, coalesce(x.r, {_DEFAULT_SQL}) as relation from a left join x on a.sentence=x.sentence and a.entity=x.entity and a.kind=x.kind where pos0 >= 0""",
    ),
    "m1_match_left_to_right": (lambda s, d: _spans(s, d, M.LEFT_TO_RIGHT, numbered), _greedy_sql("start, n desc")),
    "m2_match_longest_first": (lambda s, d: _spans(s, d, M.LONGEST_FIRST, numbered), _greedy_sql("n desc, start")),
    "m4_tag_text": (tagged, _TAGGED),
    "m6_patient_runs": (
        patient_runs,
        f"""with w as (select row_id, {_WORDS.format('case_text')} as w from cases where case_text is not null), tk as (select row_id, unnest(w) as word, cast(generate_subscripts(w, 1) - 1 as integer) as i from w)
        select row_id, min(i) as run_start, max(i) as run_stop from (select *, i - row_number() over (partition by row_id order by i) as isle from tk where {_PATIENT}) group by row_id, isle""",
    ),
    "m7_dictionary": (
        dictionary,
        f"""with r as (select distinct {_KEY.format('label')} as key, type as t from v4_nodes where label is not null and type is not null and type <> 'Patient'), k as (select * from r where key <> '' and not (t = 'Anatomy' and regexp_matches(key, '{M.CELL_LINE}'))),
        a as (select *, count(*) over (partition by key) as n from k), b as (select * from a where not (t = 'Procedure' and n > 1)), c as (select *, count(*) over (partition by key) as n2 from b), d as (select * from c where not (t = 'Anatomy' and n2 > 1))
        select key, cast(len(string_split(key,' ')) as integer) as n_words, case when max(n)=1 and min(t)='Procedure' then 'IGNORE' else first(t order by {_ORDER_SQL}, t) end as label, string_agg(t, ',' order by {_ORDER_SQL}, t) as candidates from d group by key""",
    ),
    "entity_types": (entity_types, "with z as (" + _greedy_sql("n desc, start") + ") select label, count(*) as mentions, count(distinct case_id) as cases from z group by label"),
    "g14_star_edges": (star_edges, _STAR + " select source_id, target_id, relation, attributes, case_id, sentence_number from st"),
    "g14_star_nodes": (star_nodes, _STAR + " select distinct source_id as node_id, case_id as label, 'Patient' as type from st union all select target_id, min(label), min(type) from st group by 1"),
    "j4_nearest_anchor": (anchors, _ANCHOR),
    "j8_quantity_edges": (
        quantity_edges,
        f"""{_S}, {quantities_sql('s', 'sentence')}, qd as (select distinct sentence, q_start, q_end, value, unit, matched_rule from q3), ent as (select sentence, target_id as edge, relation as label, replace(split_part(target_id, ':', 2), '_', ' ') as e from v2_edges_gemini where sentence is not null),
        ed as (select distinct sentence, edge, label, strpos(lower(sentence), lower(e)) - 1 as e_start, strpos(lower(sentence), lower(e)) - 1 + length(e) as e_end from ent where strpos(lower(sentence), lower(e)) > 0),
        nr as (select qd.*, edge, label, greatest(0, e_start - q_end, q_start - e_end) as gap from qd join ed using (sentence)), bt as (select *, row_number() over (partition by sentence, q_start, q_end, value, unit, matched_rule order by not ({_FITS_SQL}), gap, edge) as rn from nr where gap <= 110)
        select sentence, q_start, q_end, value, unit, matched_rule, edge, cast(row_number() over (partition by sentence, edge order by q_start, value) as integer) as n from bt where rn = 1""",
    ),
    "w7_bio_spans": (bio, _BIO),
    "a9_span_scores": (lambda s, d: E.span_scores(*_gold_pred(s, d)), _SCORES + "select label, support, predicted, tp, fp, fn, precision, recall, f1 from z"),
    "a9_averages": (
        lambda s, d: E.averages(E.span_scores(*_gold_pred(s, d))),
        _SCORES + """, t as (select cast(sum(support) as bigint) as support, cast(sum(predicted) as bigint) as predicted, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, round(avg(precision),6) as macro_precision, round(avg(recall),6) as macro_recall, round(avg(f1),6) as macro_f1,
        round(case when sum(support)=0 then 0 else sum(f1*support)/sum(support) end,6) as weighted_f1 from z), u as (select *, round(tp::double/(tp+fp),6) as precision, round(tp::double/(tp+fn),6) as recall from t) select *, round(2*precision*recall/(precision+recall),6) as f1 from u""",
    ),
    "a10_match_modes": (
        lambda s, d: E.match_modes(*_gold_pred(s, d)),
        f"""with {_GP}, n as (select (select count(*) from gs) as ng, (select count(*) from ps) as np), h as (
        select m as mode, (select count(*) from ps) as x, 0 as hit_pred, 0 as hit_gold from (values ('none')) v(m) where false
        union all select v.m, 0, (select count(*) from ps where exists (select 1 from gs where gs.case_id=ps.case_id and gs.start=ps.start and gs.label=ps.label)), (select count(*) from gs where exists (select 1 from ps where gs.case_id=ps.case_id and gs.start=ps.start and gs.label=ps.label)) from (values ('strict'),('start_tag'),('overlap')) v(m)
        union all select 'start', 0, (select count(*) from ps where exists (select 1 from gs where gs.case_id=ps.case_id and gs.start=ps.start)), (select count(*) from gs where exists (select 1 from ps where gs.case_id=ps.case_id and gs.start=ps.start))),
        r as (select mode, hit_pred, hit_gold, round(hit_pred::double/np,6) as precision, round(hit_gold::double/ng,6) as recall from h, n) select *, round(case when precision+recall=0 then 0 else 2*precision*recall/(precision+recall) end,6) as f1 from r""",
    ),
    "a15_confusion": (
        lambda s, d: E.confusion(*_gold_pred(s, d)),
        f"with {_GP}, a as (select case_id, start, min(label) as gl from gs group by 1,2), b as (select case_id, start, min(label) as pl from ps group by 1,2) select coalesce(gl,'SPURIOUS') as gold_label, coalesce(pl,'MISSED') as pred_label, count(*) as n from a full join b on a.case_id=b.case_id and a.start=b.start group by 1,2",
    ),
    "a19_pmi": (
        pmi,
        """with j as (select relation, target_id, count(*) as n_xy from v2_edges_gemini where relation is not null and target_id is not null group by 1,2), k as (select *, cast(sum(n_xy) over (partition by relation) as bigint) as n_x, cast(sum(n_xy) over (partition by target_id) as bigint) as n_y, sum(n_xy) over () as n from j),
        p as (select relation, target_id, n_xy, n_x, n_y, round(log2(((n_xy+0.5::double)/(n+0.5::double))/(((n_x+0.5::double)/(n+0.5::double))*((n_y+0.5::double)/(n+0.5::double)))),6) as pmi from k) select *, greatest(pmi, 0.0::double) as ppmi from p""",
    ),
    "l13_tfidf": (
        tfidf,
        """with t as (select relation, unnest(regexp_extract_all(lower(sentence), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) as token from v2_edges_gemini where sentence is not null and relation is not null), f as (select relation, token, count(*) as tf from t group by 1,2),
        n as (select count(distinct relation) as n from f), r as (select relation, token, (1+ln(tf))*(ln((1+n.n)::double/(1+count(*) over (partition by token)))+1) as raw from f, n) select relation, token, round(raw/sqrt(sum(raw*raw) over (partition by relation)),6) as weight from r""",
    ),
    "l17_ngram_model": (lm, _LM),
    "w1_neighbours": (neighbours, _NEAR),
}

#: The queries whose SQL reads the edges' sentences, over all sentences of the case texts.
_WHOLE = {
    "entity_types": lambda s, d: entity_types(s, d, case_sentences),
    "m1_match_left_to_right": lambda s, d: _spans(s, d, M.LEFT_TO_RIGHT),
    "m2_match_longest_first": lambda s, d: _spans(s, d, M.LONGEST_FIRST),
    "x2_labs": _extract(_labs, text_sentences),
    "x4_modifiers": lambda s, d: modifiers(s, d, text_sentences),
    "x5_sentence_attributes": lambda s, d: sentence_attributes(s, d, text_sentences),
    "x11_age": lambda s, d: ages(s, d, text_sentences),
    "l17_ngram_model": lambda s, d: lm(s, d, text_sentences),
}
QUERIES |= {
    f"{k}_texts": (f, QUERIES[k][1].replace(_NUMBERED, _TEXTS).replace(_S, _S_TEXTS)) for k, f in _WHOLE.items()
}
