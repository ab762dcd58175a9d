"""Counts, language models, features and classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitagraph.functions import text as T
from vitagraph.operators.graph import VALID_PAIRS
from vitagraph.operators.scope import same_clause


def padded_ngrams(tokens: Column, order: int) -> Column:
    """``array<struct<n, context, word>>`` of all n-grams of up to ``order`` tokens of
    a sentence padded at both ends."""
    pad = lambda s: F.array_repeat(F.lit(s), order - 1)

    def runs(padded: Column, n: int) -> Column:
        starts = F.when(F.size(padded) >= n, F.sequence(F.lit(1), F.size(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(padded, i, n - 1), " ").alias("context"), F.element_at(padded, i + (n - 1)).alias("word")),
        )

    return T.let(F.concat(pad("<s>"), tokens, pad("</s>")), lambda p: F.concat(*[runs(p, n) for n in range(1, order + 1)]))


def ngram_model(sentences: DataFrame, tokens: str, order: int, backward: bool = False) -> DataFrame:
    """``n``, ``context``, ``word``, ``c``, ``total`` (count of the context): a Laplace
    model's counts, forward or over reversed sentences. Null sentences are left out."""
    seq = F.reverse(F.col(tokens)) if backward else F.col(tokens)
    counted = sentences.where(F.col(tokens).isNotNull()).select(F.explode(padded_ngrams(seq, order)).alias("g")).groupBy("g.n", "g.context", "g.word").agg(F.count("*").alias("c"))
    total = counted.groupBy("n", "context").agg(F.sum("c").alias("total"))
    return counted.join(total, ["n", "context"])


def laplace(model: DataFrame) -> DataFrame:
    """Adds ``p`` = (c + 1) / (total + V), V the number of different words."""
    vocabulary = model.where("n = 1").agg(F.count("*").alias("v"))
    return model.join(F.broadcast(vocabulary)).withColumn("p", F.round((F.col("c") + 1) / (F.col("total") + F.col("v")), 9)).drop("v")


def pmi(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``x``, ``y``, joint and marginal counts and the smoothed PMI
    log2(p_xy / (p_x p_y)) with p = (count + 0.5) / (N + 0.5), and its positive part."""
    joint = pairs.groupBy(x, y).agg(F.count("*").alias("n_xy"))
    nx = joint.groupBy(x).agg(F.sum("n_xy").alias("n_x"))
    ny = joint.groupBy(y).agg(F.sum("n_xy").alias("n_y"))
    total = joint.agg(F.sum("n_xy").alias("n"))
    p = lambda c: (F.col(c) + 0.5) / (F.col("n") + 0.5)
    rows = joint.join(nx, x).join(ny, y).join(F.broadcast(total))
    rows = rows.withColumn("pmi", F.round(F.log2(p("n_xy") / (p("n_x") * p("n_y"))), 6))
    return rows.select(x, y, "n_xy", "n_x", "n_y", "pmi", F.greatest("pmi", F.lit(0.0)).alias("ppmi"))


def tfidf(docs: DataFrame, doc: str, token: str) -> DataFrame:
    """``doc``, ``token``, ``weight``: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of
    unit length in each document."""
    tf = docs.groupBy(doc, token).agg(F.count("*").alias("tf"))
    df = tf.groupBy(token).agg(F.count("*").alias("df"))
    n = tf.select(doc).distinct().agg(F.count("*").alias("n"))
    raw = (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    rows = tf.join(df, token).join(F.broadcast(n)).withColumn("raw", raw)
    norm = rows.groupBy(doc).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return rows.join(norm, doc).select(doc, token, F.round(F.col("raw") / F.col("norm"), 6).alias("weight"))


def neighbour_features(tokens: DataFrame, keys: list[str], at: str, token: str, reach: int = 2) -> DataFrame:
    """Tokens with their neighbours up to ``reach`` away (``edge`` past the sentence),
    shape and the bigram before."""
    row = W.partitionBy(*keys).orderBy(at)
    low = F.lower(token)
    near = [F.coalesce(F.lag(low, d).over(row) if d > 0 else F.lead(low, -d).over(row), F.lit("edge")).alias(f"w{-d:+d}".replace("+", "p").replace("-", "m")) for d in range(-reach, reach + 1) if d]
    return tokens.select(*keys, at, low.alias("w"), T.word_shape(F.col(token)).alias("shape"), *near)


def context_bag(tokens: DataFrame, keys: list[str], at: str, token: str, reach: int = 5) -> DataFrame:
    """Tokens with ``bag``: the different tokens, in lower case and without
    punctuation, up to ``reach`` positions away in their sentence."""
    near = F.collect_list(F.struct(F.col(at).alias("at"), F.lower(token).alias("w"))).over(W.partitionBy(*keys).orderBy(at).rowsBetween(-reach, reach))
    others = F.transform(F.filter(near, lambda x: (x["at"] != F.col(at)) & x["w"].rlike(r"[\p{L}\p{N}]")), lambda x: x["w"])
    return tokens.select(*keys, at, F.lower(token).alias("w"), F.array_sort(F.array_distinct(others)).alias("bag"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (:func:`edges.candidate_pairs`) with ``pair``, ``pair_order``,
    ``valid_schema_pair``, ``token_dist_scaled``, ``log_dist``, ``dist_bin``,
    ``pair_dist``, ``same_clause``, ``head_e1``, ``head_e2``, ``num_intervening`` and
    ``has_same_type_intervening``."""
    d, pair = F.col("token_dist"), F.concat("type_e1", F.lit("->"), "type_e2")
    bins = F.when(d == 0, "adj_0").when(d <= 3, "close_1_3").when(d <= 8, "med_4_8").when(d <= 15, "far_9_15").otherwise("very_far_16+")
    between = F.when(F.col("intervening") == "", F.array().cast("array<string>")).otherwise(F.split("intervening", ","))
    return pairs.withColumn("same_clause", same_clause(F.col("between"))).select(
        "*", pair.alias("pair"), F.concat(pair, F.lit("|"), "reading_order").alias("pair_order"),
        pair.isin([f"{a}->{b}" for a, b, _ in VALID_PAIRS]).alias("valid_schema_pair"),
        (d / 10.0).alias("token_dist_scaled"), F.log1p(d).alias("log_dist"), bins.alias("dist_bin"), F.concat(pair, F.lit("|"), bins).alias("pair_dist"),
        T.headword(F.col("e1")).alias("head_e1"), T.headword(F.col("e2")).alias("head_e2"), F.size(between).alias("num_intervening"),
        (F.array_contains(between, F.col("type_e1")) | F.array_contains(between, F.col("type_e2"))).alias("has_same_type_intervening"),
    )


def pair_pmi_tables(features: DataFrame, reach: int = 10) -> DataFrame:
    """``level`` (lexical, head or type), ``x``, ``y``, joint and marginal counts and
    the smoothed PMI of pairs from :func:`pair_features`. Marginals count all pairs,
    the joint counts of types those at most ``reach`` words apart."""
    levels = {"lexical": ("e1", "e2"), "head": ("head_e1", "head_e2"), "type": ("type_e1", "type_e2")}
    rows = features.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.col(x).alias("x"), F.col(y).alias("y"), ((F.col("token_dist") <= reach) | F.lit(k != "type")).alias("near")) for k, (x, y) in levels.items()]))
    )
    counts = rows.groupBy("level", "x", "y").agg(F.count("*").alias("n_all"), F.count_if("near").alias("n_xy"))
    nx = counts.groupBy("level", "x").agg(F.sum("n_all").alias("n_x"))
    ny = counts.groupBy("level", "y").agg(F.sum("n_all").alias("n_y"))
    total = counts.where("level = 'lexical'").agg(F.sum("n_all").alias("n"))
    p = lambda c: (F.col(c) + 0.5) / (F.col("n") + 0.5)
    found = counts.join(nx, ["level", "x"]).join(ny, ["level", "y"]).join(F.broadcast(total))
    return found.select("level", "x", "y", "n_xy", "n_x", "n_y", F.round(F.log2(p("n_xy") / (p("n_x") * p("n_y"))), 6).alias("pmi"))


def schema_prediction(probability: Column, labels: list[str], type_e1: Column, type_e2: Column) -> Column:
    """``struct<pred_label, pred_confidence, probabilities>``: the most probable of the
    relations that the schema allows for the types, or NONE; ties go to the first
    label. Numbers have four decimals; without an allowed label NONE has -1."""
    pair = F.concat(type_e1, F.lit(">"), type_e2)
    allowed = F.lit(None).cast("array<string>")
    for a, b, relations in VALID_PAIRS:
        allowed = F.when(pair == f"{a}>{b}", F.array(*map(F.lit, relations))).otherwise(allowed)
    allowed = F.concat(F.coalesce(allowed, F.array().cast("array<string>")), F.array(F.lit("NONE")))
    scored = F.array(*[F.struct(F.get(probability, F.lit(i)).alias("p"), F.lit(-i).alias("i"), F.lit(x).alias("l")) for i, x in enumerate(labels)])
    best = F.array_max(F.filter(scored, lambda s: F.array_contains(allowed, s["l"])))
    return F.struct(
        F.coalesce(best["l"], F.lit("NONE")).alias("pred_label"), F.coalesce(F.round(best["p"], 4), F.lit(-1.0)).alias("pred_confidence"),
        F.map_from_arrays(F.array(*map(F.lit, labels)), F.transform(probability, lambda x: F.round(x, 4))).alias("probabilities"),
    )


def top_features(names: list[str], labels: list[str], coefficients, k: int = 8) -> list[tuple[str, int, str, float]]:
    """(label, rank from 1, feature, coefficient) of each label's ``k`` largest
    coefficients (a matrix of labels by features)."""
    return [
        (label, r, names[i], float(row[i]))
        for label, row in zip(labels, coefficients)
        for r, i in enumerate(sorted(range(len(names)), key=lambda i: (-row[i], i))[:k], 1)
    ]


def hidden(keys: list[Column], share: float, seed: int) -> Column:
    """Whether a span is hidden in training, by a hash of its key: the same in every
    run and whatever the order of the rows."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def split_groups(groups: list, test_size: float = 0.2, seed: int = 42) -> set:
    """The groups of the test side: the first ceil(test_size * n) of a seeded
    permutation of the sorted groups (a list of keys on the driver)."""
    import numpy as np

    ordered = sorted(set(groups))
    order = np.random.RandomState(seed).permutation(len(ordered))
    return {ordered[i] for i in order[: int(np.ceil(test_size * len(ordered)))]}


def align_entities(cases: DataFrame) -> DataFrame:
    """``case_id``, ``text``, ``label``, ``char_start``, ``char_end`` of entities found
    again in their text, each searched from where the last one was found and, failing
    that, from the start (case-insensitive substrings). Entities not found, and those
    labelled IGNORE or O, are left out; repeated spans are kept once.

    cases: ``case_id``, ``case_text``, ``entities`` (``array<struct<text, label>>``).
    The search is sequential in a case, so it runs as an Arrow UDF over rows.
    """

    @F.pandas_udf("array<struct<text:string,label:string,char_start:int,char_end:int>>")
    def align(texts: pd.Series, entities: pd.Series) -> pd.Series:
        out = []
        for text, ents in zip(texts, entities):
            low, cursor, seen = (text or "").lower(), 0, {}
            for e in ents if ents is not None else []:
                if not e["text"] or e["label"] in ("IGNORE", "O"):
                    continue
                at = low.find(e["text"].lower(), cursor)
                at = low.find(e["text"].lower()) if at < 0 else at
                if at >= 0:
                    cursor = at + len(e["text"])
                    seen.setdefault((at, cursor, e["label"]), e["text"])
            out.append([{"text": t, "label": l, "char_start": a, "char_end": b} for (a, b, l), t in sorted(seen.items())])
        return pd.Series(out, dtype=object)

    return cases.select("case_id", F.explode(align("case_text", "entities")).alias("e")).select("case_id", "e.*")


def align_tags(rows: DataFrame, most: int = 15) -> DataFrame:
    """``id``, ``spans``: positions of tags in the original tokens, where each tag
    stands for 1 to ``most`` tokens, the fewest that let the rest fit. Null if the
    sequences cannot be aligned. rows: ``id``, ``original``, ``tagged`` (arrays)."""

    @F.pandas_udf("array<struct<start:int,stop:int,label:string>>")
    def align(originals: pd.Series, taggeds: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(originals, taggeds):
            a, b = list(a), list(b)
            step: list[dict[int, int]] = [{} for _ in range(len(b) + 1)]
            step[len(b)] = {len(a): 0}
            for j in range(len(b) - 1, -1, -1):
                for i in range(len(a)):
                    sizes = range(1, most + 1) if b[j].startswith("TAG-") else (1,) if a[i] == b[j] else ()
                    fit = next((n for n in sizes if i + n in step[j + 1]), None)
                    if fit:
                        step[j][i] = fit
            if 0 not in step[0]:
                out.append(None)
                continue
            i, spans = 0, []
            for j, t in enumerate(b):
                n = step[j][i]
                if t.startswith("TAG-"):
                    spans.append({"start": i, "stop": i + n, "label": t.removeprefix("TAG-")})
                i += n
            out.append(spans)
        return pd.Series(out, dtype=object)

    return rows.select("id", align("original", "tagged").alias("spans"))
