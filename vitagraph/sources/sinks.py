"""Graph sinks: viewer CSV files and Mermaid text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = ["node_id", "type", "label", "attributes"]
EDGE_FIELDS = ["edge_id", "source_id", "target_id", "relation", "attributes"]


def mermaid_lines(nodes: DataFrame, edges: DataFrame, rhombus: list[str] | None = None) -> DataFrame:
    """``line``: a Mermaid line for each node (a circle for patients, a rhombus for the
    types of ``rhombus``) and edge."""
    name = F.replace(F.coalesce("label", F.lit("")), F.lit('"'), F.lit("'"))
    framed = lambda a, b: F.concat("node_id", F.lit(a), name, F.lit(b))
    shape = F.when(F.col("type") == "Patient", framed('(("', '"))'))
    if rhombus:
        shape = shape.when(F.col("type").isin(rhombus), framed('{"', '"}'))
    shape = shape.otherwise(framed('["', '"]'))
    link = F.concat("source_id", F.lit(" -->|"), "relation", F.lit("| "), "target_id")
    return nodes.select(shape.alias("line")).unionByName(edges.select(link.alias("line")).where("line is not null"))


def mermaid_text(nodes: DataFrame, edges: DataFrame, direction: str = "LR", most: int = 10_000, rhombus: list[str] | None = None) -> str:
    """The text of a small graph; raises ValueError for more than ``most`` lines."""
    rows = mermaid_lines(nodes, edges, rhombus).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a graph of more than {most} lines is no diagram")
    return "\n".join([f"graph {direction}", *sorted(r.line for r in rows)])


def write_viewer_csv(df: DataFrame, fields: list[str], path: str, by_case: bool = False) -> None:
    """The table as CSV with a fixed field order; ``by_case`` gives a folder a case."""
    options = {"header": True, "escape": '"', "quoteAll": False}
    if by_case:
        df.select("case_id", *fields).write.mode("overwrite").options(**options).partitionBy("case_id").csv(path)
    else:
        df.select(*fields).write.mode("overwrite").options(**options).csv(path)


def write_category_csv(terms: DataFrame, path: str) -> None:
    """``term``, ``source`` in a folder for each ``category``, sorted by term over its
    files; a category is divided among tasks by ranges of its terms."""
    terms.select("term", "source", "category").repartitionByRange("category", "term").sortWithinPartitions("category", "term").write.mode("overwrite").option("header", True).partitionBy("category").csv(path)


def write_json_lines(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Records as JSON lines; ``meta`` goes into a folder ``<path>_meta`` beside them."""
    df.write.mode("overwrite").json(path)
    if meta:
        row = df.sparkSession.createDataFrame([tuple(meta.values())], ", ".join(f"`{k}` string" for k in meta))
        row.coalesce(1).write.mode("overwrite").json(f"{path}_meta")


def save_dictionary(terms: DataFrame, path: str, preparation: str) -> None:
    """A dictionary with the name of the preparation that made its keys."""
    terms.withColumn("preparation", F.lit(preparation)).write.mode("overwrite").parquet(path)


def load_dictionary(spark, path: str, preparation: str) -> DataFrame:
    """A saved dictionary; ValueError if its keys were made by another preparation."""
    terms = spark.read.parquet(path)
    if not terms.where(F.col("preparation") != preparation).isEmpty():
        raise ValueError("the dictionary was made by another preparation")
    return terms.drop("preparation")


def write_case_graphs(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """The graphs of many cases as one pair of tables: ids begin with ``<case_id>:``.
    nodes: ``case_id``, ``node``, ``type``, ``label``, ``attributes``; edges: ``case_id``,
    ``from_node``, ``to_node``, ``relation``, ``attributes``."""
    node = lambda c: F.concat("case_id", F.lit(":N"), F.col(c).cast("string"))
    write_viewer_csv(nodes.withColumn("node_id", node("node")), NODE_FIELDS, nodes_path)
    edge = F.concat("case_id", F.lit(":E"), F.col("from_node").cast("string"), F.lit("-"), F.col("to_node").cast("string"), F.lit("-"), "relation")
    write_viewer_csv(edges.select(edge.alias("edge_id"), node("from_node").alias("source_id"), node("to_node").alias("target_id"), "relation", "attributes"), EDGE_FIELDS, edges_path)


def hub_subgraph(nodes: DataFrame, edges: DataFrame, hub: str) -> tuple[DataFrame, DataFrame]:
    """The edges at a hub and their nodes."""
    near = edges.where((F.col("source_id") == hub) | (F.col("target_id") == hub))
    ids = near.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.join(ids, "node_id", "left_semi"), near


def write_lexicon(terms: DataFrame, path: str, most: int = 1_000_000) -> None:
    """The different terms, sorted, as one JSON list (a file on the driver's machine);
    ValueError for more than ``most``."""
    import json

    rows = terms.select("term").where("term is not null").distinct().orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} terms is no single file")
    with open(path, "w", encoding="utf-8") as file:
        json.dump([r.term for r in rows], file, indent=4, ensure_ascii=False)


def write_category_module(terms: DataFrame, path: str, name: str = "ENTITY_CATEGORIES", most: int = 1_000_000) -> None:
    """A Python module with the set of terms of each category, sorted; ValueError for
    more than ``most`` terms."""
    rows = terms.select("category", "term").where("category is not null and term is not null").distinct().orderBy("category", "term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a module of more than {most} terms")
    groups: dict[str, list[str]] = {}
    for r in rows:
        groups.setdefault(r.category, []).append(r.term)
    with open(path, "w", encoding="utf-8") as file:
        file.write(f"{name} = {{\n")
        for category, found in groups.items():
            file.write(f"    {category!r}: {{\n" + "".join(f"        {t!r},\n" for t in found) + "    },\n")
        file.write("}\n")
