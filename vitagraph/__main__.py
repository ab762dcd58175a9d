"""Command line: python -m vitagraph COMMAND --data DIR ... (see --help)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitagraph import registry
from vitagraph.operators import edgemodel, learn, matching
from vitagraph.operators import edges as pairs
from vitagraph.plans import case_queries, clinical_queries, edge_queries, token_queries
from vitagraph.sources import readers, sinks
from vitagraph.sources.tables import checkpointed, table


def _write(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def run_query(spark, a) -> None:
    _write(registry.queries()[a.name](spark, a.data), a.out)


def build_vocabulary(spark, a) -> None:
    """Categories of a descriptor file's terms, as CSV folders."""
    found = matching.classify_descriptors(readers.read_descriptors(spark, a.descriptors))
    sinks.write_category_csv(found.withColumn("source", F.lit("descriptors")), a.out)


def split(spark, a) -> None:
    """Balanced folds of articles; the last one is the test side."""
    cases = table(spark, a.data, "cases").where("article_id is not null")
    folds = edgemodel.group_folds(cases.groupBy("article_id").agg(F.count("*").alias("n")), "article_id", "n", a.folds)
    _write(cases.join(folds, "article_id").withColumn("split", F.when(F.col("fold") == a.folds - 1, "test").otherwise("train")), a.out)


def weak_labels(spark, a) -> None:
    _write(token_queries.stem_matches(spark, a.data), f"{a.out}/spans")
    sinks.save_dictionary(token_queries.full_dictionary(spark, a.data), f"{a.out}/dictionary", "words and stems")


def tag(spark, a) -> None:
    _write(clinical_queries.tagged(spark, a.data), a.out)


def lexicon(spark, a) -> None:
    sinks.write_lexicon(table(spark, a.data, "v4_nodes").select(F.lower("label").alias("term")), a.out)


def graph(spark, a) -> None:
    sinks.write_case_graphs(case_queries.nodes(spark, a.data), case_queries.edges(spark, a.data), f"{a.out}/nodes", f"{a.out}/edges")


def train(spark, a) -> None:
    rows = checkpointed(learn.pair_features(edge_queries.labelled(spark, a.data)))
    edgemodel.fit(rows, most=a.most).save(a.out)


def predict(spark, a) -> None:
    model = edgemodel.EdgeModel.load(spark, a.model)
    found = edgemodel.predict(model, learn.pair_features(edge_queries.labelled(spark, a.data)))
    _write(found if a.all else found.where("pred_label <> 'NONE'"), a.out)


def evaluate(spark, a) -> None:
    """Scores of predictions by class, printed as JSON lines."""
    for r in pairs.class_scores(spark.read.parquet(a.predictions), "label", "pred_label").orderBy("label").collect():
        print(json.dumps(r.asDict()))


def list_queries(spark, a) -> None:
    print("\n".join(sorted(registry.queries())))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vitagraph")
    commands = top.add_subparsers(required=True)

    def add(command: str, run, /, data: bool = True, out: bool = True, **options) -> None:
        p = commands.add_parser(command, help=run.__doc__)
        p.set_defaults(run=run)
        if data:
            p.add_argument("--data", required=True, help="folder of the parquet tables")
        if out:
            p.add_argument("--out", required=True)
        for option, how in options.items():
            p.add_argument(f"--{option}", **how)

    add("queries", list_queries, data=False, out=False)
    add("run", run_query, name={"required": True, "help": "name of a query"})
    add("vocabulary", build_vocabulary, data=False, descriptors={"required": True})
    add("split", split, folds={"type": int, "default": 5})
    add("weak-labels", weak_labels)
    add("tag", tag)
    add("lexicon", lexicon)
    add("graph", graph)
    add("train-edges", train, most={"type": int, "default": edgemodel.MOST_PAIRS})
    add("predict-edges", predict, model={"required": True}, all={"action": "store_true"})
    add("evaluate", evaluate, data=False, out=False, predictions={"required": True})
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("vitagraph").getOrCreate(), a)


if __name__ == "__main__":
    main()
