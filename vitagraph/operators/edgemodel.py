"""Multinomial model of edges over candidate pairs: vectors, fit, prediction, folds."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.functions import text as T
from vitagraph.operators import learn as L
from vitagraph.sources.tables import checkpointed, ranked

#: Pairs that one model is fitted on, at most: a hash sample of the training pairs.
MOST_PAIRS = 5_000
#: Different n-grams of the text between and of the contexts, and structural names.
SPAN_TERMS, CONTEXT_TERMS, STRUCT_NAMES = 1_500, 800, 20_000
_NUMBERS = ["token_dist_scaled", "log_dist", "num_intervening", "pmi_lex", "ppmi_lex", "pmi_head", "ppmi_head", "pmi_type"]
_LEVELS = {"lex": ("e1", "e2"), "head": ("head_e1", "head_e2"), "type": ("type_e1", "type_e2")}


def structure(features: DataFrame) -> Column:
    """``array<string>``: the names of a pair's structural features."""
    eq = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c).cast("string"))
    flag = lambda hit, name: F.when(hit, F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.array(
            *[eq(k, c) for k, c in (("type_E1", "type_e1"), ("type_E2", "type_e2"), ("pair", "pair"), ("order", "reading_order"), ("pair_order", "pair_order"), ("dist_bin", "dist_bin"), ("pair_dist", "pair_dist"), ("head_E1", "head_e1"), ("head_E2", "head_e2"))],
            F.concat(F.lit("pair_clause="), "pair", F.lit("|same="), F.col("same_clause").cast("string")),
        ),
        flag(F.col("valid_schema_pair"), F.lit("valid_schema_pair")), flag(F.col("e1_is_virtual"), F.lit("e1_is_virtual")), flag(F.col("same_clause"), F.lit("same_clause")),
        flag(F.col("has_same_type_intervening"), F.concat(F.lit("pair_intervening="), "pair")),
    )


def grams(text: Column) -> Column:
    """Different words and pairs of adjacent words of a text, in lower case."""
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return T.let(T.words(F.lower(text)), lambda w: F.array_distinct(F.concat(w, pairs(w))))


@dataclass
class EdgeModel:
    """A fitted model: counts for PMI, the stages of the vectors, and the regression."""

    counts: DataFrame
    total: int
    stages: list
    labels: list[str]

    def save(self, path: str) -> None:
        """Into a folder: the stages, the counts as a table, and the labels."""
        PipelineModel(self.stages).write().overwrite().save(f"{path}/stages")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        row = self.counts.sparkSession.createDataFrame([(json.dumps({"labels": self.labels, "total": self.total}),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> EdgeModel:
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        return cls(spark.read.parquet(f"{path}/counts"), about["total"], PipelineModel.load(f"{path}/stages").stages, about["labels"])


def pmi_counts(features: DataFrame) -> DataFrame:
    """``level``, ``x``, ``y``, ``n``: joint counts, and marginals where ``x`` or ``y`` is
    null. The joint counts of types are those at most ten words apart."""
    near = F.col("token_dist_scaled") <= 1.0
    rows = features.select(F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.col(a).alias("x"), F.col(b).alias("y"), (near | F.lit(k != "type")).alias("near")) for k, (a, b) in _LEVELS.items()])))
    joint = rows.groupBy("level", "x", "y").agg(F.count("*").alias("all"), F.count_if("near").alias("n"))
    left = joint.groupBy("level", "x").agg(F.sum("all").alias("n")).select("level", "x", F.lit(None).cast("string").alias("y"), "n")
    right = joint.groupBy("level", "y").agg(F.sum("all").alias("n")).select("level", F.lit(None).cast("string").alias("x"), "y", "n")
    return joint.select("level", "x", "y", "n").unionByName(left).unionByName(right)


def with_pmi(features: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Features with the smoothed PMI of terms, heads and types and their positive
    parts; what the counts have not seen counts as 0."""
    p = lambda c: (F.coalesce(F.col(c), F.lit(0)) + 0.5) / (total + 0.5)
    rows = features
    for k, (a, b) in _LEVELS.items():
        mine = counts.where(F.col("level") == k)
        rows = (
            rows.join(mine.where("x is not null and y is not null").select(F.col("x").alias(a), F.col("y").alias(b), F.col("n").alias("n_xy")), [a, b], "left")
            .join(mine.where("y is null").select(F.col("x").alias(a), F.col("n").alias("n_x")), a, "left").join(mine.where("x is null").select(F.col("y").alias(b), F.col("n").alias("n_y")), b, "left")
            .withColumn(f"pmi_{k}", F.log2(p("n_xy") / (p("n_x") * p("n_y")))).drop("n_xy", "n_x", "n_y")
        )
    return rows.withColumn("ppmi_lex", F.greatest("pmi_lex", F.lit(0.0))).withColumn("ppmi_head", F.greatest("pmi_head", F.lit(0.0)))


def _prepared(features: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    rows = with_pmi(features, counts, total)
    return rows.withColumn("struct_", structure(rows)).withColumn("span_", grams(F.col("between"))).withColumn("context_", grams(F.concat_ws(" ", "left_context", "right_context")))


def _weights(rows: DataFrame, column: str, vocabulary: list[str]) -> list[float]:
    """ln((1 + n) / (1 + df)) + 1 of each term of a vocabulary (at most SPAN_TERMS)."""
    n = rows.count()
    df = {r.t: r.n for r in rows.select(F.explode(column).alias("t")).where(F.col("t").isin(vocabulary)).groupBy("t").agg(F.count("*").alias("n")).collect()}
    import math

    return [math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary]


def fit(features: DataFrame, label: str = "label", reg: float = 1.0, most: int = MOST_PAIRS) -> EdgeModel:
    """A model of ``label`` from pairs with features (:func:`learn.pair_features`).

    Multinomial regression with L2 and balanced weights over structural names, PMI and
    distances, and the 1- and 2-grams of the text between and of the contexts, weighted
    by inverse frequency to unit length. Counts for PMI are of all pairs; the vectors
    and the regression are fitted on a hash sample of at most about ``most`` pairs.
    """
    total = features.count()
    counts = checkpointed(pmi_counts(features))
    keep = F.pmod(F.xxhash64("case_id", "sent_no", "e1_start", "e2_start"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * min(1.0, most / max(total, 1)))))
    rows = checkpointed(_prepared(features.where(keep), counts, total))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    weight = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sum(sizes.values()) / (len(sizes) * n))])
    rows = rows.withColumn("weight_", F.element_at(weight, F.col(label)))
    stages, parts = [], []
    for name, size in (("struct", STRUCT_NAMES), ("span", SPAN_TERMS), ("context", CONTEXT_TERMS)):
        counter = CountVectorizer(inputCol=f"{name}_", outputCol=f"{name}_n", vocabSize=size, minDF=1.0, binary=True).fit(rows)
        stages.append(counter)
        if name == "struct":
            parts.append("struct_n")
        elif counter.vocabulary:
            scale = ElementwiseProduct(scalingVec=Vectors.dense(_weights(rows, f"{name}_", counter.vocabulary)), inputCol=f"{name}_n", outputCol=f"{name}_w")
            stages += [scale, Normalizer(inputCol=f"{name}_w", outputCol=f"{name}_v", p=2.0)]
            parts.append(f"{name}_v")
    stages.append(VectorAssembler(inputCols=[*parts, *_NUMBERS], outputCol="features"))
    indexer = StringIndexer(inputCol=label, outputCol="label_i", stringOrderType="alphabetAsc").fit(rows)
    vectors = indexer.transform(rows)
    for stage in stages:
        vectors = stage.transform(vectors)
    sure = sum(sizes.values())  # balanced weights sum to the number of rows
    regression = LogisticRegression(featuresCol="features", labelCol="label_i", weightCol="weight_", family="multinomial", regParam=reg / max(sure, 1), elasticNetParam=0.0, standardization=False, maxIter=30)
    stages.append(regression.fit(vectors.select("features", "label_i", "weight_")))
    return EdgeModel(counts, total, stages, list(indexer.labels))


def predict(model: EdgeModel, features: DataFrame) -> DataFrame:
    """Pairs with ``pred_label``, ``pred_confidence``, ``probabilities`` (under the schema,
    four decimals) and ``pmi_head`` (three)."""
    rows = _prepared(features, model.counts, model.total)
    for stage in model.stages:
        rows = stage.transform(rows)
    rows = rows.withColumn("p_", L.schema_prediction(vector_to_array("probability"), model.labels, F.col("type_e1"), F.col("type_e2")))
    return rows.select(*[c for c in features.columns if c != "pmi_head"], "p_.pred_label", "p_.pred_confidence", "p_.probabilities", F.round("pmi_head", 3).alias("pmi_head"))


def feature_names(model: EdgeModel) -> list[str]:
    """The names of the vector's columns."""
    names: list[str] = []
    for prefix, stage in zip(("", "span_tfidf:", "ctx_tfidf:"), [s for s in model.stages if hasattr(s, "vocabulary")]):
        names += [prefix + t for t in stage.vocabulary] if stage.vocabulary else []
    return names + _NUMBERS


def top_features(model: EdgeModel, k: int = 8) -> list[tuple[str, int, str, float]]:
    """(label, rank, feature, coefficient) of each label's largest coefficients."""
    return L.top_features(feature_names(model), model.labels, model.stages[-1].coefficientMatrix.toArray(), k)


def group_folds(sizes: DataFrame, group: str, n: str, k: int = 5) -> DataFrame:
    """``group``, ``fold``: by falling size and then by name, each group into the fold
    that is smallest so far (the first of equal ones).

    The driver holds one row for each different size. Groups of one size are dealt in
    turn once the folds differ by less than that size, so their fold follows from their
    rank alone.
    """
    held, plans = [0] * k, []
    for r in sizes.groupBy(n).agg(F.count("*").alias("m")).orderBy(F.desc(n)).collect():
        size, left, first = int(r[0]), r.m, []
        while left and size and max(held) - min(held) >= size:
            f = held.index(min(held))
            first.append(f)
            held[f] += size
            left -= 1
        turn = sorted(range(k), key=lambda f: (held[f], f))
        for j, f in enumerate(turn):
            held[f] += size * (left // k + (j < left % k))
        plans.append((size, first, turn))
    plan = sizes.sparkSession.createDataFrame(plans, f"`{n}` bigint, first_ array<int>, turn_ array<int>")
    rows = ranked(sizes.select(group, F.col(n).cast("bigint").alias(n)), [n], [group], "r_").withColumn("r_", (F.col("r_") - 1).cast("int")).join(plan, n)
    fold = F.when(F.col("r_") < F.size("first_"), F.get("first_", F.col("r_"))).otherwise(F.get("turn_", ((F.col("r_") - F.size("first_")) % k).cast("int")))
    return rows.select(group, fold.alias("fold"))


def out_of_fold(features: DataFrame, folds: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Predictions of every pair by the model that has not seen its group."""
    rows = checkpointed(features.join(folds, group))
    found = None
    for fold in range(k):
        part = predict(fit(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold))
        found = part if found is None else found.unionByName(part)
    return found
