"""Dictionary matching on text and selection of non-overlapping spans.

A text's n-grams, bounded by the longest term, pass a bit filter of the dictionary's
hashed keys, which loses none, and are joined to the dictionary by equality; the few candidates of each sentence are then folded in the order of a
greedy key. The dictionary is a table: Spark broadcasts it below its size threshold
and shuffles both sides on the n-gram beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.functions.stem import stem_words
from vitagraph.sources.tables import checkpointed

# ---- fixed values ----------------------------------------------------------
#: Types of an ambiguous term: the first of these is its label.
PRIORITY = ["Symptom", "Disease", "Result", "Exam", "Medication", "Anatomy"]
PATIENT_WORDS = [
    "patient", "man", "woman", "male", "female", "boy", "girl", "infant", "newborn", "neonate", "baby", "toddler",
    "gentleman", "lady", "adolescent", "child", "men", "women", "patients", "children",
]
CELL_LINE = r"\b(cells?|cell lines?)$"
FILE_CATEGORY = {
    "anatomy": "Anatomy", "diseases": "Disease", "disease": "Disease", "exams": "Exam", "exam": "Exam",
    "medications": "Medication", "medication": "Medication", "procedures": "Procedure", "procedure": "Procedure",
    "results": "Result", "result": "Result", "symptoms": "Symptom", "symptom": "Symptom",
}
OVERRIDES = {"biopsy": "Exam"}
#: Bits of the filter that keeps n-grams outside the dictionary from the shuffle.
FILTER_BITS = 1 << 20
# ----------------------------------------------------------------------------


def dictionary(terms: DataFrame, term: str, category: str) -> DataFrame:
    """``key``, ``n_words``, ``label``, ``candidates``: one row for each normalized
    term. Anatomy terms that name cell lines are left out, Procedure and then Anatomy
    give way to other types, and the label is the first candidate by priority; a
    term that is only a Procedure has the label IGNORE. Null terms are left out."""
    rows = (
        terms.select(T.normalize_phrase(F.col(term)).alias("key"), F.col(category).alias("c"))
        .where("key <> '' and c is not null").where(~((F.col("c") == "Anatomy") & F.col("key").rlike(CELL_LINE)))
    )
    return resolve_types(rows)


def resolve_types(rows: DataFrame) -> DataFrame:
    """``key``, ``n_words``, ``label``, ``candidates`` of rows of ``key`` and type ``c``."""
    kinds = rows.groupBy("key").agg(F.collect_set("c").alias("all"))
    less = lambda a, x: F.when(F.size(a) > 1, F.array_remove(a, x)).otherwise(a)
    left = less(less(F.col("all"), "Procedure"), "Anatomy")
    order = F.array(*map(F.lit, PRIORITY))
    ranked = F.transform(
        F.array_sort(F.transform(left, lambda t: F.struct(F.when(F.array_position(order, t) == 0, 99).otherwise(F.array_position(order, t)).alias("p"), t.alias("t")))),
        lambda s: s["t"],
    )
    only = (F.size("all") == 1) & (F.get("all", F.lit(0)) == "Procedure")
    return kinds.select("key", F.size(F.split("key", " ")).alias("n_words"), F.when(only, "IGNORE").otherwise(F.get(ranked, F.lit(0))).alias("label"), ranked.alias("candidates"))


def ngrams(words: Column, most: Column) -> Column:
    """``array<struct<start, n, key>>`` of all runs of 1 to ``most`` normalized words."""
    def runs(w: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - n)
        key = lambda i: F.when(n == 1, F.get(w, i)).otherwise(F.array_join(F.slice(w, i + 1, n), " "))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), n.alias("n"), key(i).alias("key")))

    def lengths(w: Column) -> Column:
        longest = F.least(most, F.size(w))
        return F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))

    return T.let(words, lambda w: F.flatten(F.transform(lengths(w), lambda n: runs(w, n))))


def key_filter(terms: DataFrame) -> DataFrame:
    """One row of FILTER_BITS bits in longs: those set that a term's ``key`` hashes to."""
    set_ = terms.select(F.expr(f"int(pmod(xxhash64(key), {FILTER_BITS}) / 64)").alias("i"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(key), {FILTER_BITS}) % 64))").alias("w"))
    none = terms.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("bigint").alias("w"))
    longs = set_.unionByName(none).groupBy("i").agg(F.bit_or("w").alias("w"))
    return longs.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("bits"))


def greedy(spans: Column, order: Column) -> Column:
    """The spans that a greedy choice in ``order`` keeps: each unless it overlaps one
    chosen before. ``order`` is an array of the spans' structs, sorted by the key;
    they have ``start`` and ``stop`` (exclusive)."""
    return F.aggregate(
        order, F.slice(spans, 1, 0),
        lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"])), acc).otherwise(F.concat(acc, F.array(s))),
    )


#: Greedy keys: expressions over start and n that sort first what is chosen first.
LEFT_TO_RIGHT = ("start", "-n")
LONGEST_FIRST = ("-n", "start")


def match_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, by: tuple[str, str] = LONGEST_FIRST) -> DataFrame:
    """``keys``, ``start``, ``stop`` (word positions, exclusive), ``term``, ``label`` of
    the dictionary terms in each text, not overlapping.

    texts: one row for each sentence, identified by ``keys``. terms: ``key``,
    ``label`` (one row a key). by: LEFT_TO_RIGHT (earliest, then longest) or
    LONGEST_FIRST (longest, then earliest). Terms of any number of words match; null
    texts match nothing.
    """
    longest = terms.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(0)).alias("most"))
    normalized = F.transform(T.words(F.col(text)), T.normalize_word)
    cand = (
        texts.withColumn("most_", longest.scalar()).select(*keys, F.explode(ngrams(normalized, F.col("most_"))).alias("g")).select(*keys, "g.start", "g.n", "g.key")
        .withColumn("h_", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)))
        .where(F.getbit(F.get(key_filter(terms).scalar(), F.expr("int(h_ / 64)")), F.expr("int(h_ % 64)")) == 1).drop("h_")
        .join(terms.select("key", "label"), "key")
    )
    a, b = (F.expr(x) for x in by)
    span = F.struct(a.alias("a"), b.alias("b"), F.col("start"), (F.col("start") + F.col("n")).alias("stop"), F.col("key").alias("term"), F.col("label"))
    listed = cand.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("s_"))
    return listed.select(*keys, F.explode(greedy(F.col("s_"), F.col("s_"))).alias("s")).select(*keys, "s.start", "s.stop", "s.term", "s.label")


#: Tokens that no term crosses, and the most tokens of a joined term (fixed values).
BARRIERS = [".", ";", "!", "?", "(", ")"]
MOST_JOINED = 5


def reconstruct_tokens(texts: DataFrame, keys: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """``keys``, ``tokens``: clinical tokens of each text, those of a vocabulary term
    joined by blanks and acronyms followed by their expansion in brackets.

    From left to right the longest window of 5 to 2 tokens is taken whose lower-case
    tokens, or whose lemmas, are a term; no window crosses a full stop, semicolon,
    exclamation or question mark or bracket, and none begins with an acronym.
    vocabulary: distinct ``key`` in lower case."""
    tokens = T.clinical_tokens(F.col(text))
    acronym = F.create_map(*[F.lit(x) for p in T.ACRONYMS.items() for x in p])

    def windows(t: Column, lemmas: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
            cut = lambda a, i: F.slice(a, i + 1, F.lit(n))
            free = F.filter(starts, lambda i: ~F.arrays_overlap(cut(t, i), F.array(*map(F.lit, BARRIERS))) & ~F.get(t, i).isin(list(T.ACRONYMS)))
            return F.transform(free, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.lower(F.array_join(cut(t, i), " ")).alias("raw"), F.array_join(cut(lemmas, i), " ").alias("lemma")))

        return F.concat(*[of(n) for n in range(2, MOST_JOINED + 1)])

    rows = texts.select(*keys, tokens.alias("t")).withColumn("l", F.transform("t", T.lemmatize))
    cand = rows.select(*keys, F.explode(windows(F.col("t"), F.col("l"))).alias("w")).select(*keys, "w.start", "w.stop", F.explode(F.array_distinct(F.array("w.raw", "w.lemma"))).alias("key"))
    hash_ = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    kept = cand.withColumn("h_", hash_).where(F.getbit(F.get(key_filter(vocabulary).scalar(), F.expr("int(h_ / 64)")), F.expr("int(h_ % 64)")) == 1).drop("h_").join(vocabulary.select("key"), "key", "left_semi")
    span = F.struct(F.col("start").alias("a"), (-F.col("stop")).alias("b"), "start", "stop")
    found = kept.groupBy(*keys).agg(F.array_sort(F.collect_set(span)).alias("c")).select(*keys, greedy(F.col("c"), F.col("c")).alias("s"))
    own = lambda i: F.get(F.filter("s", lambda x: (x["start"] <= i) & (i < x["stop"])), F.lit(0))
    alone = lambda w: F.when(F.try_element_at(acronym, w).isNotNull(), F.concat(w, F.lit(" ["), F.try_element_at(acronym, w), F.lit("]"))).otherwise(w)
    joined = lambda w, i: F.when(F.col("s").isNull() | own(i).isNull(), alone(w)).when(own(i)["start"] == i, F.array_join(F.slice("t", i + 1, own(i)["stop"] - i), " "))
    return rows.join(found, keys, "left").select(*keys, F.filter(F.transform("t", joined), lambda w: w.isNotNull()).alias("tokens"))


#: Characters of the shortest dictionary term of one word.
LEAST_SINGLE = 3


def stemmed_phrases(phrases: DataFrame, phrase: str) -> DataFrame:
    """``phrase``, ``key``: the stems of a phrase's words, joined by blanks. Phrases
    without a word give no row."""
    words = phrases.select(phrase, F.posexplode(T.words(F.col(phrase))).alias("i_", "word"))
    stems = stem_words(words, "word")
    listed = words.join(stems, "word").groupBy(phrase).agg(F.array_sort(F.collect_list(F.struct("i_", "stem"))).alias("s_"))
    return listed.select(phrase, F.array_join(F.transform("s_", lambda x: x["stem"]), " ").alias("key"))


def stem_dictionary(terms: DataFrame, term: str, category: str, stopped: list[str] | None = None) -> DataFrame:
    """:func:`dictionary` with stems as keys, of all spellings of each term
    (:func:`text.term_variants`). Terms of ``stopped``, single words of fewer than
    ``LEAST_SINGLE`` characters and single numbers are left out."""
    rows = terms.select(F.col(term).alias("t_"), F.col(category).alias("c")).where("t_ is not null and c is not null").where(~((F.col("c") == "Anatomy") & F.lower("t_").rlike(CELL_LINE))).distinct()
    rows = rows.select(F.explode(T.term_variants(F.col("t_"))).alias("v_"), "c").distinct()
    rows = rows.join(stemmed_phrases(rows.select("v_").distinct(), "v_"), "v_").select("key", "c").distinct()
    single = F.size(F.split("key", " ")) == 1
    rows = rows.where((F.col("key") != "") & ~(single & ((F.length("key") < LEAST_SINGLE) | F.col("key").rlike("^[0-9]+$"))))
    if stopped:
        out = stemmed_phrases(terms.sparkSession.createDataFrame([(w.lower(),) for w in stopped], "v_ string"), "v_").select("key")
        rows = rows.join(out, "key", "left_anti")
    return resolve_types(rows)


def widest(terms: DataFrame) -> DataFrame:
    """One row, ``n_words``: the words of the dictionary's longest term, at least 1."""
    return terms.agg(F.coalesce(F.max("n_words"), F.lit(1)).alias("n_words"))


def match_stems(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, first) -> DataFrame:
    """``keys``, ``start``, ``stop``, ``term``, ``label``: dictionary terms by their stems,
    the earliest and then the longest, within a sentence and across punctuation, and
    before them the runs that ``first`` (words -> array of spans) takes. terms: ``key``
    (stems joined by blanks), ``label``, one row a key."""
    words = texts.select(*keys, T.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    taken = words.select(*keys, "w", first(F.col("w")).alias("taken"))
    # only words whose stem stands in a term, outside the runs taken before, can match
    known = terms.select(F.explode(F.split("key", " ")).alias("stem")).distinct()
    stems = checkpointed(stem_words(words.select(F.explode("w").alias("word")), "word")).join(known, "stem", "left_semi").select("word", "stem")
    tokens = (
        taken.select(*keys, "taken", F.posexplode("w").alias("i_", "word")).where(~F.exists("taken", lambda o: (o["start"] <= F.col("i_")) & (F.col("i_") < o["stop"]))).select(*keys, "i_", "word")
        .withColumn("h_", F.pmod(F.xxhash64("word"), F.lit(FILTER_BITS)))
        .where(F.getbit(F.get(key_filter(stems.select(F.col("word").alias("key"))).scalar(), F.expr("int(h_ / 64)")), F.expr("int(h_ % 64)")) == 1).drop("h_")
        .join(stems, "word")
    )
    listed = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i_", "stem"))).alias("t"))
    longest = terms.agg(F.coalesce(F.max(F.size(F.split("key", " "))), F.lit(0)).alias("most"))
    place = lambda at: F.get("t", at)["i_"]
    cand = (
        listed.withColumn("most_", longest.scalar()).select(*keys, "t", F.explode(ngrams(F.transform("t", lambda x: x["stem"]), F.col("most_"))).alias("g"))
        .select(*keys, place(F.col("g.start")).alias("start"), (place(F.col("g.start") + F.col("g.n") - 1) + 1).alias("stop"), F.col("g.n").alias("n_"), F.col("g.key").alias("key"))
        .where(F.col("stop") - F.col("start") == F.col("n_")).drop("n_")
        .withColumn("h_", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)))
        .where(F.getbit(F.get(key_filter(terms).scalar(), F.expr("int(h_ / 64)")), F.expr("int(h_ % 64)")) == 1).drop("h_")
        .join(terms.select("key", "label"), "key")
    )
    span = F.struct(F.col("start").alias("a"), (-F.col("stop")).alias("b"), "start", "stop", F.col("key").alias("term"), "label")
    found = cand.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("c"))
    chosen = found.select(*keys, F.explode(greedy(F.col("c"), F.col("c"))).alias("x")).select(*keys, "x.start", "x.stop", "x.term", "x.label")
    return chosen.unionByName(taken.select(*keys, F.inline("taken")))


def mesh_categories(tree: Column, acts: Column) -> Column:
    """Category of one tree number; ``acts``: the descriptor has a pharmacological
    action. Null if it belongs to none."""
    under = lambda *p: tree.rlike("^(?:" + "|".join(x.replace(".", r"\.") for x in p) + r")(?:\.|$)")
    return (
        F.when(under("C23.888"), "Symptom").when(under("C23.149", "C23.300", "C23.550"), "Result").when(tree.startswith("C"), "Disease")
        .when(tree.startswith("A"), "Anatomy").when(under("E01", "E05"), "Exam").when(under("E02", "E03", "E04"), "Procedure")
        .when(tree.startswith("D") & (acts | under("D26")), "Medication")
    )


def classify_descriptors(descriptors: DataFrame) -> DataFrame:
    """``category``, ``term`` (lower case), distinct, of descriptors with ``trees``
    (array), ``acts`` (boolean) and ``terms`` (array); some terms are overridden."""
    rows = descriptors.select(F.explode("trees").alias("tree"), "acts", "terms").select(mesh_categories(F.col("tree"), F.col("acts")).alias("c"), F.explode("terms").alias("term"))
    forced = F.create_map(*[F.lit(x) for p in OVERRIDES.items() for x in p])
    low = F.lower(F.trim("term"))
    return rows.where("c is not null").select(F.coalesce(F.try_element_at(forced, low), F.col("c")).alias("category"), low.alias("term")).distinct()


def word_runs(tokens: DataFrame, keys: list[str], at: str, token: str, chosen: list[str] = PATIENT_WORDS) -> DataFrame:
    """``keys``, ``run_start``, ``run_stop`` (inclusive): maximal runs of consecutive
    positions whose token or lemma is one of the chosen words."""
    from pyspark.sql import Window as W

    hit = F.lower(token).isin(chosen) | T.lemmatize(F.col(token)).isin(chosen)
    rows = tokens.where(hit).withColumn("isle", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    return rows.groupBy(*keys, "isle").agg(F.min(at).alias("run_start"), F.max(at).alias("run_stop")).drop("isle")


def tag_text(texts: DataFrame, keys: list[str], text: str, spans: DataFrame) -> DataFrame:
    """``keys``, ``tagged``: the words of each text with chosen spans replaced by
    ``TAG-LABEL``. spans: as from :func:`match_terms`. Texts without spans stay."""
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.upper("label").alias("label")))).alias("s_"))
    words = T.words(F.col(text))
    tag = lambda w, i: F.when(F.exists("s_", lambda s: (s["start"] < i) & (i < s["stop"])), F.lit(None)).otherwise(
        F.coalesce(F.get(F.transform(F.filter("s_", lambda s: s["start"] == i), lambda s: F.concat(F.lit("TAG-"), s["label"])), F.lit(0)), w)
    )
    return texts.join(listed, keys, "left").select(
        *keys, F.when(F.col("s_").isNull(), F.array_join(words, " ")).otherwise(F.array_join(F.filter(F.transform(words, tag), lambda w: w.isNotNull()), " ")).alias("tagged")
    )


def merge_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """``keys``, ``tokens``: the words of each text, those of a dictionary term (the
    earliest, then the longest) joined by ``_``. Null texts have null tokens."""
    spans = match_terms(texts, keys, text, terms, LEFT_TO_RIGHT)
    listed = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop")).alias("s_"))
    words = T.words(F.col(text))

    def joined(w: Column, i: Column) -> Column:
        own = F.filter("s_", lambda s: (s["start"] <= i) & (i < s["stop"]))
        inside = F.array_join(F.slice(words, i + 1, F.get(own, F.lit(0))["stop"] - i), "_")
        return F.when(F.col("s_").isNull() | (F.size(own) == 0), w).when(F.get(own, F.lit(0))["start"] == i, inside)

    return texts.join(listed, keys, "left").select(*keys, F.filter(F.transform(words, joined), lambda w: w.isNotNull()).alias("tokens"))
