"""Queries of the general data problems (their llm counterparts are apart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitagraph.operators.packed import FIELDS, split_packed
from vitagraph.operators.units import in_tenths, measured_values
from vitagraph.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed cell of metadata and v1_nodes."""
    meta = split_packed(
        table(spark, sf_dir, "metadata"), ["row_id"], {f: FIELDS[f] for f in ("authors", "mesh_terms", "keywords")}
    )
    nodes = split_packed(table(spark, sf_dir, "v1_nodes"), ["row_id"], {"attributes": FIELDS["attributes"]})
    return meta.select(F.lit("metadata").alias("src"), "*").unionByName(
        nodes.select(F.lit("v1_nodes").alias("src"), "*")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured value of case texts and nodes, in tenths of the common unit."""
    values = measured_values(
        table(spark, sf_dir, "cases"), table(spark, sf_dir, "v4_nodes"), table(spark, sf_dir, "clinical_measures")
    )
    return values.select("src", "row_id", "measure", in_tenths(F.col("value")).alias("tenths")).distinct()


_HARD = r";|\t\r\n•·"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _literal_sql(names: bool) -> str:
    """The first quoted whole value of ``rest``: what stands before it, its delimiter,
    the blanks after that, and the value; empty strings without one."""
    body, also = r"(?:\\.|[^\\])*?", "|[ ](?:&|and)[ ]"
    pattern = rf"""(?s)^(.*?)(^|[\[{{,{_HARD}]{also})([ \x{{00a0}}]*)("{body}"|'{body}')[ \x{{00a0}}]*(?:$|[\]}},{_HARD}]{also if names else ""})"""
    return f"regexp_extract(rest, {_sql(pattern)}, ['pre', 'del', 'gap', 'lit'])"


def packed_sql(cells: str) -> str:
    """Common table expressions that end in ``pv`` (``id``, ``field_name``, ``pos``,
    ``item``): the values of ``cells`` (a query of ``id``, ``field_name``, ``cell``).
    To be put after ``with recursive``."""
    kept = _sql(rf",(\s*(?:(?:\p{{Lu}}\p{{M}}*\.[ -]?)+|Jr\.)\s*)($|[,{_HARD}&])")
    names = "piece"
    for _ in range(3):  # a match takes the next comma along, so once is not enough
        names = f"regexp_replace({names}, {kept}, chr(4) || '\\1\\2', 'g')"
    square, braces = _sql(r"(?s)\s*\[.*\]\s*"), _sql(r"(?s)^\s*(?:\[(.*)\]|\{(.*)\})\s*$")
    soft, person, hard = _sql(f"[,{_HARD}]"), _sql(rf"[,{_HARD}]|\s+(?:&|and)\s+"), _sql(f"[{_HARD}]")
    mark, outer, escaped = _sql(r"^\s*(?:[-*‣◦▪●]\s+)"), _sql(r"^[\s\x{00a0}]+|[\s\x{00a0}]+$"), _sql(r"""\\(["'\\])""")
    inner = f"regexp_replace(substr(lit, 2, length(lit) - 2), {escaped}, '\\1', 'g')"
    return f"""pcell as ({cells}),
 pbare as (select id, field_name, regexp_full_match(cell, {square}) as sq, regexp_replace(cell, {braces}, '\\1\\2') as bare from pcell where cell is not null),
 prec as (select id, field_name, sq, 0 as k, bare as rest, ''::varchar as piece, ''::varchar as lit, ''::varchar as del, false as done from pbare
  union all select id, field_name, sq, k + 1, substr(rest, 1 + length(m.pre) + length(m.del) + length(m.gap) + length(m.lit)), case when m.lit = '' then rest else m.pre end, m.lit, m.del, m.lit = '' from
   (select *, case when field_name = 'authors' then {_literal_sql(True)} else {_literal_sql(False)} end as m from prec where not done)),
 pother as (select id, field_name, bool_or(regexp_matches(piece || del, {hard})) as other from prec where k > 0 group by 1, 2),
 psplit as (select id, field_name, k, string_split_regex(case when field_name = 'authors' then {names} else piece end,
   case when field_name = 'authors' then {person} when field_name = 'attributes' or sq or not other then {soft} else {hard} end) as parts from prec join pother using (id, field_name) where k > 0),
 pall as (select id, field_name, 2 * k as a, generate_subscripts(parts, 1) as b, replace(regexp_replace(unnest(parts), {mark}, ''), chr(4), ',') as v from psplit
  union all select id, field_name, 2 * k + 1, 1, case when lit[1] = '"' then replace({inner}, '""', '"') else replace({inner}, '''''', '''') end from prec where k > 0 and lit <> ''),
 pclean as (select id, field_name, a, b, regexp_replace(v, {outer}, '', 'g') as item from pall),
 pv as (select id, field_name, cast(row_number() over (partition by id, field_name order by a, b) as integer) as pos, item from pclean where item <> '')"""


_P3 = (
    "with recursive "
    + packed_sql(" union all ".join([*[f"select 'metadata:' || row_id as id, '{f}' as field_name, {f} as cell from metadata" for f in ("authors", "mesh_terms", "keywords")], "select 'v1_nodes:' || row_id, 'attributes', attributes from v1_nodes"]))
    + " select split_part(id, ':', 1) as src, cast(split_part(id, ':', 2) as bigint) as row_id, field_name, pos, item from pv"
)
#: Oracles of the problems that SQL can express on whole tables.
ORACLES = {"p3_found": _P3}
QUERIES = {"p1_found": p1_found, "p3_found": p3_found}
