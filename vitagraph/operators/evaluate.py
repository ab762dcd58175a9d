"""Scores of predicted spans and labels against a reference."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)


def _f1(p: Column, r: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)


def span_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per label: support, predicted, tp, fp, fn, precision, recall, f1, by exact span.

    gold, pred: ``case_id``, ``start``, ``stop``, ``label``; sets, so repeated rows
    count once. A score with an empty denominator is 0.
    """
    key = ["case_id", "start", "stop", "label"]
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(pred.select(*key).distinct().withColumn("p", F.lit(1)), key, "full_outer")
    n = lambda c: F.count_if(c)
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    out = both.groupBy("label").agg(n(g).alias("support"), n(p).alias("predicted"), n(g & p).alias("tp"), n(p & ~g).alias("fp"), n(g & ~p).alias("fn"))
    return _with_prf(out)


def _with_prf(df: DataFrame) -> DataFrame:
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def averages(per_label: DataFrame) -> DataFrame:
    """Micro scores, and macro and support-weighted f1, of :func:`span_scores`."""
    total = per_label.agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp", "fp", "fn")],
        F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    return _with_prf(total)


def match_modes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``mode``, ``hit_pred``, ``hit_gold``, precision, recall, f1 in four modes: the
    whole span and label, start and label, start, and overlap with the label."""
    span = F.struct("start", "stop", "label")
    # both sides of a case meet once, whatever the modes
    sides = gold.select("case_id", span.alias("g")).unionByName(pred.select("case_id", span.alias("p")), allowMissingColumns=True)
    both = sides.groupBy("case_id").agg(F.collect_set("g").alias("g"), F.collect_set("p").alias("p"))
    same = lambda *names: lambda a, b: reduce(and_, [a[n] == b[n] for n in names])
    meets = {
        "strict": same("start", "stop", "label"), "start_tag": same("start", "label"), "start": same("start"),
        "overlap": lambda a, b: (a["label"] == b["label"]) & (a["start"] < b["stop"]) & (b["start"] < a["stop"]),
    }

    def hits(these: str, those: str, meet) -> Column:
        n = F.size(F.filter(these, lambda a: F.exists(those, lambda b: meet(a, b))))
        return F.coalesce(F.sum(F.when(F.col("case_id").isNotNull(), n)), F.lit(0))

    size = lambda side: F.coalesce(F.sum(F.size(side)), F.lit(0))
    counts = [F.struct(F.lit(mode).alias("mode"), hits("p", "g", m).alias("hit_pred"), hits("g", "p", m).alias("hit_gold"), size("p").alias("n_pred"), size("g").alias("n_gold")) for mode, m in meets.items()]
    every = both.agg(F.array(*counts).alias("m")).select(F.inline("m"))
    scored = every.withColumn("precision", ratio(F.col("hit_pred"), F.col("n_pred"))).withColumn("recall", ratio(F.col("hit_gold"), F.col("n_gold")))
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).select("mode", "hit_pred", "hit_gold", "precision", "recall", "f1")


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``gold_label``, ``pred_label``, ``n`` by start; MISSED and SPURIOUS where a side
    has no span there."""
    key = ["case_id", "start"]
    g = gold.groupBy(*key).agg(F.min("label").alias("gl"))
    p = pred.groupBy(*key).agg(F.min("label").alias("pl"))
    return g.join(p, key, "full_outer").groupBy(F.coalesce("gl", F.lit("SPURIOUS")).alias("gold_label"), F.coalesce("pl", F.lit("MISSED")).alias("pred_label")).agg(F.count("*").alias("n"))


def top_errors(gold: DataFrame, pred: DataFrame, k: int = 10) -> DataFrame:
    """``kind`` (false positive or missed), ``label``, ``term``, ``n``: the ``k`` terms of
    each kind that are most often wrong by exact span and label, ties by name."""
    key = ["case_id", "start", "stop", "label"]
    parts = []
    for kind, these, those in (("false positive", pred, gold), ("missed", gold, pred)):
        wrong = these.select(*key, "term").distinct().join(those.select(*key).distinct(), key, "left_anti")
        counted = wrong.groupBy("label", "term").agg(F.count("*").alias("n"))
        parts.append(counted.orderBy(F.desc("n"), "label", "term").limit(k).select(F.lit(kind).alias("kind"), "label", "term", "n"))
    return parts[0].unionByName(parts[1])


def repair_bio(df: DataFrame, keys: list[str], at: str, tag: str) -> DataFrame:
    """``keys``, ``at``, ``tag``: an I- tag without a like predecessor becomes B-."""
    from pyspark.sql import Window as W

    before = F.lag(tag).over(W.partitionBy(*keys).orderBy(at))
    alone = F.startswith(F.col(tag), F.lit("I-")) & (F.coalesce(F.substr(before, F.lit(3)), F.lit("")) != F.substr(F.col(tag), F.lit(3)))
    return df.select(*keys, at, F.when(alone, F.concat(F.lit("B-"), F.substr(F.col(tag), F.lit(3)))).otherwise(F.col(tag)).alias("tag"))


def bio_spans(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys``, ``start``, ``stop`` (exclusive), ``label`` of repaired tags."""
    from pyspark.sql import Window as W

    row = W.partitionBy(*keys).orderBy(at)
    isle = F.sum(F.when(F.startswith("tag", F.lit("B-")), 1).otherwise(0)).over(row.rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("isle", isle).where("tag <> 'O'")
    return rows.groupBy(*keys, "isle").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop"), F.min(F.substr(F.col("tag"), F.lit(3))).alias("label")).drop("isle")
