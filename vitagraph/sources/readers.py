"""Readers of case, dictionary and descriptor files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "article_id string, case_id string, case_text string, age double, gender string"
METADATA = (
    "article_id string, authors string, case_amount int, doi string, journal string, journal_detail string, keywords string, license string, "
    "link string, major_mesh_terms string, mesh_terms string, pmcid string, pmid bigint, title string, year int"
)
TERMS = "term string, source string, category string"
DESCRIPTOR = (
    "TreeNumberList struct<TreeNumber:array<string>>, PharmacologicalActionList struct<PharmacologicalAction:array<string>>, "
    "ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1).csv(path)


def read_dictionaries(spark: SparkSession, pattern: str, exact: bool = True) -> DataFrame:
    """``term``, ``category`` of many dictionary files; the category comes from the
    file name: after ``mesh_`` (``exact``), or from the first type named in it."""
    from vitagraph.operators.matching import FILE_CATEGORY

    rows = spark.read.option("header", True).schema("term string").option("enforceSchema", True).csv(pattern).withColumn("file", F.lower(F.col("_metadata.file_name")))
    if exact:
        table = F.create_map(*[F.lit(x) for p in FILE_CATEGORY.items() for x in p])
        category = F.try_element_at(table, F.regexp_extract("file", r"^mesh_(.*)\.csv$", 1))
    else:
        category = F.when(F.col("file").rlike("disease|icd|mesh"), "Disease")
        for word in ("symptom", "exam", "result", "anatomy", "medication", "effect"):
            category = category.when(F.contains(F.col("file"), F.lit(word)), word.capitalize())
    return rows.select("term", category.alias("category")).where("category is not null and term is not null")


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """``trees``, ``acts``, ``terms`` of a descriptor XML file."""
    xml = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    return xml.select(F.coalesce("TreeNumberList.TreeNumber", F.array()).alias("trees"), F.col("PharmacologicalActionList").isNotNull().alias("acts"), terms.alias("terms"))


def load_lexicon(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """A JSON lexicon, or ``fallback`` where there is no file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        return fallback


# ---- fixed values: names of the columns of a term and of its preferred form ----
TERM_COLUMNS = ["term", "termo", "synonym", "sinonimo", "entry", "original", "label"]
NAME_COLUMNS = ["preferredterm", "preferredname", "canonical", "canonico", "nomenclature", "nome", "name", "normalized"]
# --------------------------------------------------------------------------------


def plain_header(name: str) -> str:
    """A column's name in lower case, letters and digits only."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def canonical_token(c: Column) -> Column:
    """A preferred name as one token: no punctuation, blanks and hyphens to ``_``."""
    bare = F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"[\s-]+", "_")), "^_+|_+$", "")


def read_named_dictionaries(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(``term``, ``name``, longest terms first; files left out). Each CSV or JSON file is
    read by its own header: the first column that is named like a term and the first
    named like a preferred form. Of a term's several names the last in the last file
    counts. A file without such columns, or that cannot be read, is left out."""
    from pyspark.errors import PySparkException

    found, skipped = None, []
    for at, path in enumerate(paths):
        try:
            df = spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.options(header=True, multiLine=True, escape='"').csv(path)
            columns = {plain_header(c): c for c in reversed(df.columns)}
            term, name = (next((columns[k] for k in known if k in columns), None) for known in (TERM_COLUMNS, NAME_COLUMNS))
            if term is None or name is None:
                raise ValueError("no column of terms and names")
            rows = df.select(F.trim(F.col(f"`{term}`").cast("string")).alias("term"), canonical_token(F.col(f"`{name}`").cast("string")).alias("name"))
            rows = rows.where("term <> '' and name <> ''").select("term", "name", F.lit(at).alias("file"), F.monotonically_increasing_id().alias("line"))
            found = rows if found is None else found.unionByName(rows)
        except (PySparkException, ValueError):
            skipped.append(path)
    if found is None:
        return spark.createDataFrame([], "term string, name string"), skipped
    last = found.groupBy("term").agg(F.max_by("name", F.struct("file", "line")).alias("name"))
    return last.orderBy(F.desc(F.length("term")), "term"), skipped
